"""Columns whose names differ from an operator's own only in case give way, and others pass through."""

from helpers import awkward, clashing
from pyspark.sql import functions as F

from sorrel.llm import bpe, common, outliers, pii, simhash
from sorrel.llm.queries import vocabulary_path


def once(df, *names):
    """df has each name once, whatever its case, and can be read."""
    lower = [c.lower() for c in df.columns]
    assert len(set(lower)) == len(lower)
    assert set(n.lower() for n in names) <= set(lower)
    return df.select(*[F.col(c) for c in df.columns]).collect()


def test_outliers(spark):
    odd = clashing(awkward(spark), "Kept", "DISTANCE", "N_Words", "Other")
    rows = once(outliers.keep_normal(odd), "kept", "distance", "other")
    assert {type(r["kept"]) for r in rows} == {bool} and {r["Other"] for r in rows} == {"mine"}


def test_personal(spark):
    odd = clashing(awkward(spark), "Base_Spans", "ADDED_spans", "Other")
    rows = once(pii.find_personal(odd), "base_spans", "added_spans", "other")
    assert all(isinstance(r["base_spans"], list) for r in rows) and {r["Other"] for r in rows} == {"mine"}


def test_annotated(spark):
    common.arrow_rows(spark)
    first = clashing(awkward(spark), "FP", "IDs", "Score")
    first = first.select("FP", "IDs", "Score", "doc_id", "lang", "source", "n_chars", "text")
    plain = sorted(r["fp"] for r in simhash.fingerprint(awkward(spark)).collect())
    assert sorted(r["fp"] for r in once(simhash.fingerprint(first), "fp", "ids")) == plain
    assert {tuple(r["ids"]) for r in once(bpe.encode(first, vocabulary_path()), "ids", "fp")} == {tuple(r["ids"]) for r in bpe.encode(awkward(spark), vocabulary_path()).collect()}
    rows = once(simhash.fingerprint(clashing(awkward(spark), "FP", "Other")), "fp", "other")
    assert all(isinstance(r["fp"], int) for r in rows) and {r["Other"] for r in rows} == {"mine"}
    rows = once(bpe.encode(clashing(awkward(spark), "IDs", "Same"), vocabulary_path(), same_col="same"), "ids", "same")
    assert all(r["same"] is True for r in rows)
