"""Splits, factor models and neighbourhood filtering on small fixtures."""

import pytest
from pyspark.sql import functions as F

from sorrel.operators import collaborative as cf
from sorrel.operators import content, factors, split

RATINGS = "userId int, movieId int, rating double, timestamp bigint"
TOY = [(1, 1, 5.0, 1), (1, 2, 4.0, 2), (1, 3, 3.0, 3), (2, 1, 2.0, 1), (2, 2, 5.0, 2)]


def model(spark, users, items, mean=0.0):
    vectors = lambda rows: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "id int, features array<double>")
    return factors.Model(vectors(users), vectors(items), mean)


@pytest.mark.parametrize(("n", "parts"), [(5, (4, 0, 1)), (9, (7, 0, 2)), (10, (8, 1, 1)), (11, (8, 1, 2)), (15, (12, 1, 2)), (20, (16, 2, 2)), (99, (79, 9, 11))])
def test_split_sizes(spark, n, parts):
    rows = spark.createDataFrame([(1, i, 3.0, n - i) for i in range(n)], RATINGS)
    got = {r["part"]: r["count"] for r in split.split_by_time(rows, ["timestamp", "movieId"]).groupBy("part").count().collect()}
    assert tuple(got.get(p, 0) for p in ("train", "val", "test")) == parts


def test_split_exclusion_and_summary(spark):
    rows = spark.createDataFrame([(1, i, 3.0, i) for i in range(4)], RATINGS)
    assert [tuple(r) for r in split.exclusions(rows).collect()] == [(1, 4, "fewer than 5 ratings")]
    assert {tuple(r) for r in split.split_summary(split.split_by_time(rows, ["timestamp"])).collect()} == {("train", 0, 0.0), ("val", 0, 0.0), ("test", 0, 0.0)}


def test_baseline(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 4.0, 2)], RATINGS)
    assert factors.baseline_rmse(rows, rows).first()[0] == 1.0
    assert factors.baseline_rmse(rows, rows.limit(0)).first()[0] == 0.0


def test_global_mean_and_initial_factors(spark):
    rows = spark.createDataFrame(TOY, RATINGS)
    m = factors.initial_factors(rows, 4)
    assert m.mean == pytest.approx(3.8)
    items = m.items.collect()
    assert len(items) == 4 and all(len(r["features"]) == 4 for r in items)
    assert m.items.collect() == factors.initial_factors(rows, 4).items.collect()


def test_predict(spark):
    m = model(spark, {1: [1, 2]}, {3: [3, 4]}, 3.0)
    assert factors.predict_one(spark, m, 1, 3) == 5.0
    assert factors.predict_one(spark, m, 100_000, 3) == 3.0
    assert factors.predict_one(spark, None, 1, 3) == 0.0


def test_best_checkpoint(spark):
    schema = "epoch int, trainRMSE double, valRMSE double"
    rows = spark.createDataFrame([(2, 0.9, 0.4), (1, 1.0, 0.3), (3, 0.8, 0.3)], schema)
    assert factors.best_checkpoint(rows).first()["epoch"] == 1
    assert factors.best_checkpoint(rows.limit(0)).first() is None


def test_top_k(spark, monkeypatch):
    movies = spark.createDataFrame([(i, f"m{i}") for i in range(1, 6)], "id int, title string")
    m = model(spark, {1: [1]}, {i: [6 - i] for i in range(1, 6)})
    seen = spark.createDataFrame([(1, 1), (1, 2)], "userId int, movieId int")
    user = spark.createDataFrame([(1,)], "userId int")
    want = [(3, 3.0), (4, 2.0), (5, 1.0)]
    assert [(r["movieId"], r["score"]) for r in factors.top_k(user, m, movies, seen).orderBy("rank").collect()] == want
    monkeypatch.setattr(factors, "BROADCAST_ITEMS", 2)
    assert [(r["movieId"], r["score"]) for r in factors.top_k(user, m, movies, seen).orderBy("rank").collect()] == want
    assert factors.top_k(user, m, movies, seen, 0).count() == 0


@pytest.mark.parametrize(("q2", "rest", "want"), [(5.0, 1.0, 1.0), (1.0, 1.1, 0.0)])
def test_recall(spark, q2, rest, want):
    movies = spark.createDataFrame([(i, f"m{i}") for i in range(1, 13)], "id int, title string")
    items = {1: [3.0], 2: [q2]} | {i: [rest + 0.01 * i] for i in range(3, 13)}
    m = model(spark, {1: [1.0]}, items)
    train = spark.createDataFrame([(1, 1, 5.0, 1), (2, 2, 5.0, 1), (2, 3, 4.0, 1)], RATINGS)
    test = spark.createDataFrame([(1, 2, 5.0, 9)], RATINGS)
    r = factors.recall_at_k(train, train.limit(0), test, m, movies)
    assert r.overall.first()["overall_recall"] == want
    empty = factors.recall_at_k(train, train.limit(0), test.limit(0), m, movies)
    assert empty.overall.first()["overall_recall"] == 0.0 and empty.per_user.count() == 0


def test_recall_exclusions(spark):
    movies = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    m = model(spark, {1: [1.0]}, {1: [1.0], 2: [2.0]})
    train = spark.createDataFrame([(1, 1, 5.0, 1)], RATINGS)
    test = spark.createDataFrame([(1, 2, 5.0, 9), (3, 1, 2.0, 9)], RATINGS)
    r = factors.recall_at_k(train, train.limit(0), test, m, movies)
    assert [x[0] for x in r.unseen_ids.collect()] == [2]
    assert sorted(x[0] for x in r.users_without_relevant.collect()) == [1, 3]


def test_als_beats_the_mean_on_a_planted_model(spark):
    rows = [(u, i, 3.0 + (1 if u % 2 else -1) * (1 if i % 3 else -1), u + i) for u in range(30) for i in range(30) if (u * i) % 4]
    data = spark.createDataFrame(rows, RATINGS)
    history, models = factors.train_with_history(data, data, [1, 6], factors.TrainOptions(factors=4))
    last = history.orderBy("epoch").collect()[-1]
    assert last["trainRMSE"] < 0.5 * factors.baseline_rmse(data, data).first()[0]
    assert set(models) == {1, 6}


def test_cosine(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (2, 1, 5.0), (3, 2, 1.0)], "userId int, movieId int, rating double")
    got = {(r["a"], r["b"]): r["sim"] for r in cf.similarities(rows, "userId", "movieId").collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0}


@pytest.mark.parametrize("strategy", cf.STRATEGIES)
def test_user_based(spark, strategy):
    rows = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0), (2, 2, 4.0), (3, 1, 1.0), (3, 3, 2.0)], "userId int, movieId int, rating double")
    active = rows.select("userId").distinct()
    got = {(r["userId"], r["movieId"]): r["score"] for r in cf.user_based(rows, active, strategy=strategy).collect()}
    assert got[(1, 2)] == pytest.approx(4.0) and got[(1, 3)] == pytest.approx(2.0)
    assert all((u, m) not in got for u, m, _ in [tuple(r) for r in rows.collect()])


def test_item_based(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (2, 1, 4.0), (2, 2, 3.0)], "userId int, movieId int, rating double")
    one = rows.select("userId").distinct().where("userId = 1")
    assert [(r["movieId"], r["score"]) for r in cf.item_based(rows, one).collect()] == [(2, 5.0)]
    assert cf.item_based(rows, one, normalize=True).first()["score"] == 5.0


def test_last_write_wins(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 1), (1, 1, 5.0, 2)], RATINGS)
    assert cf.rating_matrix(rows, ["timestamp"]).first()["rating"] == 5.0


def test_similar_items(spark):
    items = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["y", "z"]), (3, "c", ["x", "y"]), (4, "d", ["q"])], "id int, title string, genres array<string>")
    assert [r["id"] for r in content.similar_to(items, 1).collect()] == [3, 2]
    assert content.similar_to(items, F.lit(99)).count() == 0


def test_all_movies_by_title(spark):
    titles = {i: f"{'bBaA'[i % 4]} {i * 7 % 400:03d}" for i in range(400)}
    df = spark.createDataFrame(list(titles.items()), "id long, title string").repartition(5)
    got = [(r["place"], r["id"]) for r in content.by_title(df).collect()]
    want = sorted(titles, key=lambda i: (titles[i].lower(), titles[i].swapcase(), i))
    assert sorted(got) == list(enumerate(want, 1))


def test_top_k_leaves_out_seen_items_and_breaks_ties_by_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sorrel.operators import factors

    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, features array<double>")
    items = spark.createDataFrame([(i, [float(i % 3), float(i % 2)]) for i in range(1, 12)], "id int, features array<double>")
    movies = spark.createDataFrame([(i, f"m{i}") for i in range(1, 11)], "id int, title string")
    seen = spark.createDataFrame([(1, 2), (1, 5), (3, 5), (3, 5)], "userId int, movieId int")
    model = factors.Model(users, items, 3.0)
    factor = {r["id"]: r["features"] for r in items.collect()}
    own = {r["id"]: r["features"] for r in users.collect()}
    gone = {(r["userId"], r["movieId"]) for r in seen.collect()}
    want = []
    for u, p in own.items():
        scored = sorted((-(3.0 + sum(a * b for a, b in zip(p, factor[i], strict=True))), i) for i in range(1, 11) if (u, i) not in gone)
        want += [(u, i, f"m{i}", -s, k + 1) for k, (s, i) in enumerate(scored[:4])]
    asked = users.select(F.col("id").alias("userId"))
    for block in (100_000, 3):
        monkeypatch.setattr(factors, "BROADCAST_ITEMS", block)
        assert sorted(map(tuple, factors.top_k(asked, model, movies, seen, 4).collect())) == sorted(want)
    assert factors.top_k(asked, model, movies, seen, 0).count() == 0


@pytest.mark.parametrize(("block", "entries"), [(7, 2_000_000), (1024, 9), (3, 5)])
def test_tiles_and_pieces(spark, monkeypatch, block, entries):
    """The result does not depend on how ids are dealt into blocks, nor on pieces of hot ids; pairs are those of a plain loop."""
    from sorrel.operators import collaborative, products

    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(30) for i in range(8) if (u + i) % 3 or i == 2]
    r = spark.createDataFrame(rows, "userId int, movieId int, rating double")
    own = {}
    for u, i, x in rows:
        own.setdefault(u, {})[i] = x
    want = {}
    for a in own:
        for b in own:
            both = own[a].keys() & own[b].keys()
            if a != b and both:
                xx, yy = (sum(own[z][i] ** 2 for i in both) for z in (a, b))
                want[a, b] = (sum(own[a][i] * own[b][i] for i in both) / (xx * yy) ** 0.5, len(both))
    active = r.select("userId").distinct()
    whole = [sorted(map(tuple, f(r, active).collect())) for f in (collaborative.user_based, collaborative.item_based)]
    plain = lambda *c: products.products(*c[:4], *c[4:], block=block, entries=entries)
    monkeypatch.setattr(collaborative, "products", plain)
    got = {(x["a"], x["b"]): (x["sim"], x["n"]) for x in collaborative.similarities(r, "userId", "movieId").collect()}
    assert set(got) == set(want)
    assert all(got[p] == (pytest.approx(want[p][0], abs=1e-11), want[p][1]) for p in want)
    assert [sorted(map(tuple, f(r, active).collect())) for f in (collaborative.user_based, collaborative.item_based)] == whole


def test_run_pipeline_and_older_flow(spark):
    from sorrel.operators import factors

    rows = [(u, i, float((u + i) % 5 + 1), u * 100 + i) for u in range(1, 12) for i in range(1, 13)]
    r = spark.createDataFrame(rows, "userId int, movieId int, rating double, timestamp long")
    movies = spark.createDataFrame([(i, f"m{i}") for i in range(1, 13)], "id int, title string")
    got = factors.run_pipeline(r, movies, ["timestamp", "movieId"], [1, 3], factors.TrainOptions(epochs=3, factors=2)).collect()
    assert len(got) == 1 and (got[0]["n_train"], got[0]["n_val"], got[0]["n_test"]) == (99, 11, 22) and got[0]["best_epoch"] in (1, 3)
    assert 0 <= got[0]["overall_recall"] <= 1 and got[0]["baseline_rmse"] > 0
    loss = factors.train_embeddings(r)[1].first()
    assert 0 <= loss["loss"] < 5 and loss["val_loss"] >= 0


@pytest.mark.parametrize(("wave", "block"), [(100_000, 8), (40, 8), (7, 3)])
def test_top_k_stops_by_norm(spark, monkeypatch, wave, block):
    """Falling norms: few blocks are scored, and the result is that of scoring everything; ties and seen items included."""
    import numpy as np

    from sorrel.operators import factors

    monkeypatch.setattr(factors, "BROADCAST_ITEMS", wave)
    pick = np.random.default_rng(8)
    items = {i: (pick.integers(-4, 5, 3) / (1 + i // 10)).tolist() for i in range(1, 121)}
    items[200] = items[201] = items[5]
    people = {u: pick.integers(-3, 4, 3).astype(float).tolist() for u in range(1, 30)} | {99: [0.0, 0.0, 0.0]}
    gone = {(u, i) for u in people for i in range(1, 40) if (u * i) % 5 == 0}
    model = factors.Model(spark.createDataFrame(list(people.items()), "id int, features array<double>"), spark.createDataFrame(list(items.items()), "id int, features array<double>"), 3.0)
    movies = spark.createDataFrame([(i, f"m{i}") for i in items if i != 3], "id int, title string")
    users = spark.createDataFrame([(u,) for u in [*people, 1, 555]], "userId int")
    seen = spark.createDataFrame(sorted(gone), "userId int, movieId int")
    done = {r["user"]: r for r in factors.best_items(users, model, movies, seen, 4, block=block).collect()}
    assert set(done) == set(people)
    for u, p in people.items():
        scored = sorted((-round(3.0 + sum(a * b for a, b in zip(p, q, strict=True)), 9), i) for i, q in items.items() if i != 3 and (u, i) not in gone)
        assert list(zip((-np.round(done[u]["scores"], 9)).tolist(), done[u]["items"], strict=True)) == scored[:4]
    blocks = sum(-(-min(wave, 121 - first) // block) for first in range(0, 121, wave))
    assert max(r["visited"] for r in done.values()) == done[99]["blocks"] == blocks
    assert sum(r["visited"] for r in done.values()) < 0.8 * sum(r["blocks"] for r in done.values())


def test_entries_are_dealt_out_only_where_their_key_is(spark, monkeypatch):
    """Communities that share nothing: what is dealt out does not grow with blocks times entries."""
    from sorrel.operators import products

    rows = [(100 * g + u, 100 * g + i, float((u * i) % 5 + 1)) for g in range(12) for u in range(6) for i in range(5)]
    left = spark.createDataFrame(rows, "a long, k long, x double")
    dealt, sizes = [], products.tile_sizes
    monkeypatch.setattr(products, "tile_sizes", lambda df, entries: dealt.append(df.count()) or sizes(df, entries))
    got = products.products(left, left.toDF("b", "k", "y"), lambda t: [t.row, t.column, t.sums["n"].astype("int64")], "a long, b long, n long", block=6).collect()
    assert sorted(map(tuple, got)) == sorted((100 * g + u, 100 * g + v, 5) for g in range(12) for u in range(6) for v in range(6))
    assert dealt[0] <= 4 * len(rows)


def test_item_based_keeps_no_similarities_as_rows(spark, monkeypatch):
    """Few users and many items: the pairs of items are many more than the ratings, and none is saved; scores are those of a plain loop."""
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(6) for i in range(120) if (u + i) % 6]
    r = spark.createDataFrame(rows, "userId int, movieId int, rating double")
    saved, save = [], cf.Scratch.save
    monkeypatch.setattr(cf.Scratch, "save", lambda self, df: saved.append(save(self, df)) or saved[-1])
    got = {(x["userId"], x["movieId"]): x["score"] for x in cf.item_based(r, r.select("userId").distinct(), k=3).collect()}
    assert max(t.count() for t in saved) <= 2 * len(rows)
    own = {}
    for u, i, x in rows:
        own.setdefault(i, {})[u] = x

    def sim(i, j):
        both = own[i].keys() & own[j].keys()
        return round(sum(own[i][u] * own[j][u] for u in both) / (sum(own[i][u] ** 2 for u in both) * sum(own[j][u] ** 2 for u in both)) ** 0.5, 12)

    for u in range(6):
        mine = {i: x for v, i, x in rows if v == u}
        scored = sorted((-round(sum(sim(i, j) * x for j, x in mine.items()), 9), i) for i in own if i not in mine)
        assert {i: s for (v, i), s in got.items() if v == u} == {i: pytest.approx(-s, abs=1e-8) for s, i in scored[:3]}


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_only_known_pairs_meet_factors(spark, monkeypatch, most):
    """Predictions with unknown ids on either side, whether ids are broadcast or joined; an id that a side holds twice counts twice."""
    monkeypatch.setattr(factors, "BROADCAST_IDS", most)
    m = model(spark, {1: [1, 0], 2: [0.5, 0.5]}, {3: [1, 1], 4: [0, 0.5]}, 3.0)
    m = factors.Model(m.users.union(m.users.where("id = 2")), m.items, m.mean)
    pairs = spark.createDataFrame([(u, i) for u in (1, 2, 9, None) for i in (3, 4, 8)], "userId int, movieId int")
    scored = factors.score(pairs, m)
    assert scored.columns == ["userId", "movieId", "prediction"]
    assert "_both" in scored._jdf.queryExecution().analyzed().toString()
    want = {(1, 3): 4.0, (1, 4): 3.0, (2, 3): 4.0, (2, 4): 3.25}
    got = sorted((r["userId"] or 0, r["movieId"], r["prediction"]) for r in scored.collect())
    assert got == sorted((u or 0, i, want.get((u, i), 3.0)) for u in (1, 2, 9, None) for i in (3, 4, 8) for _ in range(1 + (u == 2)))


def test_recall_splits_once(spark):
    """Nothing of the split is left in the plans of recall."""
    from sorrel.plans import queries

    for name in ("recall_per_user", "recall_exclusions"):
        assert "Window" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_als_deletes_its_shuffles_on_the_way(spark, monkeypatch):
    given, als = [], factors.ALS
    monkeypatch.setattr(factors, "ALS", lambda **o: given.append(o) or als(**o))
    rows = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(8) for i in range(8)], "userId int, movieId int, rating double")
    history, models = factors.train_with_history(rows, rows, [1, 3], factors.TrainOptions(factors=2))
    assert history.count() == 2 and all(o["checkpointInterval"] == factors.CUT_EVERY for o in given)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert all("FileScan" in s._jdf.queryExecution().executedPlan().toString() for m in models.values() for s in (m.users, m.items))
