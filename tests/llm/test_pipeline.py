"""The pipeline's stages: on the test tables one after the other, and each by itself against brute force and awkward rows."""

import re
from pathlib import Path

import pytest
import test_linededup
import test_nearcopies
from helpers import awkward
from pyspark.sql import functions as F

import corpus_pipeline
from sorrel.llm import toxicity
from sorrel.llm.queries import ORACLES, QUERIES, vocabulary_path

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@tables
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.dtypes, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
    assert kept["toxicity"] <= 200 and kept["line_dedup"] == kept["toxicity"] and kept["simhash"] < kept["line_dedup"] and kept["decontamination"] <= kept["simhash"]
    assert kept["bpe"] == kept["decontamination"] and docs.where("not round_trip").count() == 0


@tables
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_divergence"}))
def test_query_has_a_row_for_each_input(spark, name):
    out = QUERIES[name](spark, SF)
    key = next(k for k in ("conv_id", "vec_id", "doc_id") if k in out.columns)
    source = {"conv_id": "conversations", "vec_id": "embeddings", "doc_id": "documents"}[key]
    want = spark.read.parquet(f"{SF}/{source}.parquet").select(key).distinct().count() + (key == "conv_id")
    assert out.select(key).distinct().count() == out.count() == want


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(out.columns) == columns
    texts = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert texts(out.select(*columns).collect()) == texts(want.select(*[f'"{x}"' for x in columns]).fetchall())


ITEM = "what a benchmark item asks in these its very own fourteen words of text"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a benchmark and labels."""
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame([(1, ITEM), (2, "two words"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], SCHEMA)


def test_toxic_documents_go(spark, small):
    rows = [(i, f"word{i % 7} and word{i % 5} with more " + ("grubble " if i % 4 == 0 else "") + f"end{i % 3}") for i in range(240)]
    rows += [(None, "a grubble of no id"), (None, "an end of no id"), (9, "an end of a repeated id")]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    got = rows_of(STAGES["toxicity"](spark, docs.withColumn("score", F.lit("mine")), small), "doc_id", "text", "score")
    want = [r for r in toxicity.score(docs, model).collect() if r["score"] < model.thresholds.get(r["lang"], model.threshold)]
    assert got == sorted(((r["doc_id"], r["text"], "mine") for r in want), key=repr)
    assert {t for _, t, _ in got} == {t for _, t in rows if "grubble" not in t}


def test_lines_go(spark, small):
    rows = test_linededup.cases(11, 10) + [(None, "A line of no id, and of its own"), (None, "another line of no id, also its own"), (3, "one more line under a repeated id"), (500, None)]
    docs = frame(spark, rows).withColumns({"_dropped": F.lit("mine"), "n_words": F.lit(3)})
    got = rows_of(STAGES["line_dedup"](spark, docs, small), "doc_id", "text", "n_chars", "_dropped")
    long_ = lambda x: len(x) >= 20
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = [], [(500, None, None, "mine")]
    for i, t in order:
        kept = []
        for x in t.split("\n"):
            near = any(test_linededup.edits(x, y) <= 2 if long_(x) and long_(y) else x == y for y in seen) if re.search(r"\S", x) else False
            if not near:
                kept.append(x)
            seen.append(x)
        text = "\n".join(kept)
        want.append((i, text, len(text), "mine"))
    # of the rows that share an id, or have none, texts have no line in common: their order does not matter
    assert got == sorted(want, key=repr)


def test_near_copies_go(spark, small):
    rows = test_nearcopies.planted(5)
    docs = frame(spark, rows).withColumns({"fp": F.lit("mine"), "least": F.lit(1)})
    got = STAGES["simhash"](spark, docs, small)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == test_nearcopies.kept(rows)


def test_contaminated_documents_go(spark, small):
    passage = " ".join(ITEM.split()[:13])
    filler = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = [(1, f"{filler(100)} {passage}"), (1, filler(30)), (2, f"{filler(247)} {passage}"), (3, f"{filler(248)} {passage}"), (None, passage.upper()), (None, filler(9)), (4, "Two, words!"), (5, None), (6, "")]
    docs = frame(spark, rows).withColumns({"n_words": F.lit("mine"), "contaminated": F.lit("mine"), "item_ids": F.lit("mine")})
    got = STAGES["decontamination"](spark, docs, small)
    assert got.columns == docs.columns
    assert rows_of(got, "doc_id", "text", "n_words", "item_ids") == sorted(((i, t, "mine", "mine") for i, t in (rows[1], rows[3], rows[5], rows[7], rows[8])), key=repr)


def test_ids_decode(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    docs = awkward(spark).withColumn("ids", F.lit("mine"))
    got = STAGES["bpe"](spark, docs, small).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert all(r["round_trip"] for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows_and_empty_tables(spark, small, name):
    docs = awkward(spark).withColumns({"score": F.lit("mine"), "_id": F.lit("mine"), "_own_0": F.lit(2), "h": F.lit(3)})
    out = STAGES[name](spark, docs, small)
    if name != "bpe":
        assert out.columns == docs.columns and {r["score"] for r in out.collect()} <= {"mine"}
    texts = docs.count()
    assert out.count() == {"simhash": 4}.get(name, texts)
    assert STAGES[name](spark, docs.limit(0), small).count() == 0
