"""Fixture rows with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("alpha beta gamma delta " * 40_000).strip()
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "same text of this row, here and there", "en", None, 5),
    (3, "same text of this row, here and there", "en", None, 5),
    (4, "same text of this row, here and there", None, "a", 5),
    (5, " \n\t\r\n ", "de", "b", 1),
    (6, LONG, "de", "b", 1),
    (7, "éß \U0001f600‍ 中文 İ Á", None, None, 1),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def clashing(df, *names):
    """df with columns of the names that an operator adds."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})
