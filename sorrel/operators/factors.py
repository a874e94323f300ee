"""Matrix factorisation: training by alternating least squares on centred ratings, scoring, top-K and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.metrics import dot
from ..functions.text import clamp
from ..scratch import Scratch, use_checkpoints
from .ranks import with_place
from .split import split_by_time

FACTORS = 16
LOW, HIGH = 1.0, 5.0
RELEVANT = 4.0
#: Items whose factors are broadcast at once in top-K; items of a block, and users that are scored in one product.
BROADCAST_ITEMS = 100_000
ITEM_BLOCK = 512
USERS = 256
#: Iterations of ALS after which the shuffle files of those before are deleted.
CUT_EVERY = 2
#: Ids of one side of a model that are broadcast, to tell known pairs.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Model:
    """users and items: (id, features array<double>); mean: the train mean."""

    users: DataFrame
    items: DataFrame
    mean: float


@dataclass(frozen=True)
class TrainOptions:
    epochs: int = 20
    reg: float = 0.05
    factors: int = FACTORS
    seed: int = 42


def global_mean(train: DataFrame, value: str = "rating") -> float:
    """0 for no ratings."""
    return train.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("m")).first()["m"]


def initial_factors(train: DataFrame, factors: int = FACTORS, seed: int = 42, user: str = "userId", item: str = "movieId", top_user: int | None = None, top_item: int | None = None, uniform: bool = False) -> Model:
    """Seeded factors for ids 0 .. the largest (of train, unless given), made from hashes, so that any partitioning gives the same: normal with deviation 0.05, or uniform within 0.05."""
    top = train.agg(F.max(user).alias("u"), F.max(item).alias("i")).first()
    top = {"u": top["u"] if top_user is None else top_user, "i": top["i"] if top_item is None else top_item}
    spark = train.sparkSession

    def make(n: int | None, salt: int) -> DataFrame:
        unit = lambda c: (F.pmod(F.xxhash64("id", c, F.lit(salt), F.lit(seed)), F.lit(1 << 40)).cast("double") + 1) / F.lit(float((1 << 40) + 1))
        normal = lambda c: F.sqrt(-2 * F.log(unit(c))) * F.cos(2 * F.pi() * unit(c + 1000)) * 0.05
        flat = lambda c: (unit(c) * 2 - 1) * 0.05
        return spark.range((n if n is not None else -1) + 1).select(F.col("id").cast("int").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(factors)), flat if uniform else normal).alias("features"))

    return Model(make(top["u"], 1), make(top["i"], 2), global_mean(train))


def train(ratings: DataFrame, options: TrainOptions = TrainOptions(), user: str = "userId", item: str = "movieId", value: str = "rating") -> Model:
    mean = global_mean(ratings, value)
    centred = ratings.select(F.col(user).cast("int").alias(user), F.col(item).cast("int").alias(item), (F.col(value) - mean).alias("centred"))
    use_checkpoints(ratings.sparkSession)
    als = ALS(checkpointInterval=CUT_EVERY, rank=options.factors, maxIter=options.epochs, regParam=options.reg, userCol=user, itemCol=item, ratingCol="centred", seed=options.seed, coldStartStrategy="nan")
    fitted = als.fit(centred)
    as_double = F.transform("features", lambda x: x.cast("double")).alias("features")
    return Model(fitted.userFactors.select("id", as_double), fitted.itemFactors.select("id", as_double), mean)


def score(pairs: DataFrame, model: Model, user: str = "userId", item: str = "movieId", clamped: bool = True) -> DataFrame:
    """pairs with `prediction`: mean + product of the factors, within 1 .. 5; the mean itself for an unknown id (as it is, if not clamped alike by the caller)."""
    # only pairs of two known ids carry factors through a shuffle
    marked = pairs
    for ids, key, name in ((model.users, user, "_u"), (model.items, item, "_i")):
        own = ids.select(F.col("id").alias(name)).distinct()
        small = own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        marked = marked.join(F.broadcast(own) if small else own, F.col(key) == F.col(name), "left")
    both = (F.col("_u").isNotNull() & F.col("_i").isNotNull()).alias("_both")
    marked = marked.select(*[F.col(f"`{c}`") for c in pairs.columns], both)
    u = model.users.select(F.col("id").alias("_u"), F.col("features").alias("_p"))
    i = model.items.select(F.col("id").alias("_i"), F.col("features").alias("_q"))
    met = marked.join(u, F.col(user) == F.col("_u"), "left").withColumn("_p", F.when(F.col("_both"), F.col("_p")))
    joined = met.join(i, F.col(item) == F.col("_i"), "left")
    known = F.col("_p").isNotNull() & F.col("_q").isNotNull()
    value = F.lit(model.mean) + dot(F.col("_p"), F.col("_q"))
    value = clamp(value, LOW, HIGH) if clamped else value
    return joined.withColumn("prediction", F.when(known, value).otherwise(F.lit(model.mean))).drop("_u", "_p", "_i", "_q", "_both")


def predict_one(spark: SparkSession, model: Model | None, user_id: int, item_id: int) -> float:
    """One clamped prediction; 0 without a model."""
    if model is None:
        return 0.0
    row = spark.createDataFrame([(user_id, item_id)], "userId long, movieId long")
    return score(row, model).first()["prediction"]


def rmse(scored: DataFrame, value: str = "rating") -> DataFrame:
    """One row rmse; predictions clamped, 0 for no rows."""
    error = F.pow(clamp(F.col("prediction"), LOW, HIGH) - F.col(value), F.lit(2.0))
    return scored.agg(F.coalesce(F.sqrt(F.avg(error)), F.lit(0.0)).alias("rmse"))


def baseline_rmse(train_rows: DataFrame, rows: DataFrame, value: str = "rating") -> DataFrame:
    """One row rmse of the train mean."""
    mean = train_rows.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("m"))
    error = F.pow(F.col(value) - F.col("m"), F.lit(2.0))
    return rows.join(F.broadcast(mean)).agg(F.coalesce(F.sqrt(F.avg(error)), F.lit(0.0)).alias("rmse"))


def best_checkpoint(history: DataFrame) -> DataFrame:
    """The row (epoch, trainRMSE, valRMSE) of the smallest valRMSE, the earliest of equals; no row for none."""
    return history.orderBy("valRMSE", "epoch").limit(1)


def train_with_history(train_rows: DataFrame, val_rows: DataFrame, epochs: list[int], options: TrainOptions = TrainOptions()) -> tuple[DataFrame, dict[int, Model]]:
    """A model for each number of epochs, by one seed, and (epoch, trainRMSE, valRMSE). Models are saved, and what their training left on disk is deleted before the next one."""
    scratch = Scratch(train_rows.sparkSession, "als")
    models, rows, kept = {}, [], []
    for e in epochs:
        m = train(train_rows, TrainOptions(e, options.reg, options.factors, options.seed))
        m = models[e] = Model(scratch.save(m.users), scratch.save(m.items), m.mean)
        kept += [m.users, m.items]
        errors = []
        for part in (train_rows, val_rows):
            scratch.keep(*kept)
            errors.append(rmse(score(part, m)).first()["rmse"])
        scratch.keep(*kept)
        rows.append((e, *errors))
    return train_rows.sparkSession.createDataFrame(rows, "epoch int, trainRMSE double, valRMSE double"), models


@dataclass
class _Best:
    """The k best items so far of some users, as matrices with -inf for places still empty: rounded scores rank, ties go to the smaller item."""

    items: np.ndarray
    scores: np.ndarray

    def kth(self) -> np.ndarray:
        return np.round(self.scores[:, -1], 9)

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in the scores of one block of items for these rows."""
        k = self.scores.shape[1]
        every = np.concatenate([self.scores[rows], scores], axis=1)
        rounded = np.round(every, 9)
        least = np.partition(rounded, rounded.shape[1] - k, axis=1)[:, -k]
        at, place = np.nonzero((rounded >= least[:, None]) & (every > -np.inf))
        own = np.where(place < k, self.items[rows[at], np.minimum(place, k - 1)], ids[np.maximum(place - k, 0)])
        order = np.lexsort((own, -rounded[at, place], at))
        at, place, own = at[order], place[order], own[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        at, place, own, nth = (x[nth < k] for x in (at, place, own, nth))
        self.scores[rows] = -np.inf
        self.scores[rows[at], nth] = every[at, place]
        self.items[rows[at], nth] = own


def _visit(ids: np.ndarray, factors: np.ndarray, norms: np.ndarray, next_norm: float, mean: float, k: int, block: int, item_kind: pa.DataType):
    """Rows (user, features, seen, items, scores, visited, open) after the items of one wave, which come by falling norm. A user is open while |p| |q| of the next item could still reach the k-th score."""
    by_id = np.argsort(ids, kind="stable")
    starts = np.arange(0, len(ids), block)
    # the largest norm from each block on, and beyond the wave
    ahead = np.append(norms[starts], next_norm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, USERS):
                part = batch.slice(a, USERS)
                n = part.num_rows
                p = np.array(part.column(1).to_pylist(), np.float64).reshape(n, -1)
                best = _Best(np.zeros((n, k), ids.dtype), np.full((n, k), -np.inf))
                for i, (own, scores) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
                    best.items[i, : len(own)], best.scores[i, : len(own)] = own, scores
                seen = [np.asarray(s.values) if s.is_valid and len(s) else np.zeros(0, ids.dtype) for s in part.column(2)]
                user, gone = np.repeat(np.arange(n), [len(s) for s in seen]), np.concatenate(seen)
                at = by_id[np.minimum(np.searchsorted(ids[by_id], gone), len(ids) - 1)]
                user, at = user[ids[at] == gone], at[ids[at] == gone]
                reach = np.linalg.norm(p, axis=1) * (1 + 1e-9)
                visited = part.column(5).to_numpy().copy()
                rows = np.arange(n)
                for j, start in enumerate(starts):
                    # strictly below the k-th, by more than rounding can make up for
                    rows = rows[~(mean + reach[rows] * ahead[j] < best.kth()[rows] - 1e-8)]
                    if not len(rows):
                        break
                    scores = mean + p[rows] @ factors[start : start + block].T
                    place = np.full(n, -1)
                    place[rows] = np.arange(len(rows))
                    hide = (at >= start) & (at < start + block) & (place[user] >= 0)
                    scores[place[user[hide]], at[hide] - start] = -np.inf
                    best.merge(rows, ids[start : start + block], scores)
                    visited[rows] += 1
                left = ~(mean + reach * ahead[-1] < best.kth() - 1e-8) if next_norm > -np.inf else np.zeros(n, bool)
                full = best.scores > -np.inf
                offsets = np.concatenate([[0], np.cumsum(full.sum(1))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[full], kind)) for x, kind in ((best.items, item_kind), (best.scores, pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *lists, pa.array(visited), pa.array(left)], names=["user", "features", "seen", "items", "scores", "visited", "open"])

    return run


def best_items(users: DataFrame, model: Model, movies: DataFrame, seen: DataFrame, k: int = 10, user: str = "userId", item: str = "movieId", block: int = ITEM_BLOCK) -> DataFrame:
    """(user, items, scores, visited, blocks): each user's k best unseen items in order, and how many of all blocks of items were scored for it.

    Items lie in blocks by falling norm. |p| |q| bounds every score that is still to come, so a user
    stops as soon as that is below the k-th score; most blocks are scored for few users. A user
    travels with the items they have seen and their k best. At most BROADCAST_ITEMS items are
    broadcast at once, a wave; users that are still open after it are saved and go through the next."""
    spark = users.sparkSession
    scratch = Scratch(spark, "best")
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")
    known = with_place(model.items.join(movies.select("id").distinct(), "id", "left_semi").select("id", "features", norm), F.desc("norm"), "id", name="place", first=0)
    n = known.count()
    own = seen.select(F.col(user).alias("_s"), F.col(item).alias("_i")).groupBy("_s").agg(F.collect_set("_i").alias("seen"))
    u = users.select(F.col(user)).distinct().join(model.users, F.col(user) == F.col("id")).join(own, F.col(user) == F.col("_s"), "left")
    id_kind = model.items.schema["id"].dataType
    nothing = F.array().cast(T.ArrayType(id_kind)), F.array().cast("array<double>")
    state = u.select(F.col(user).alias("user"), "features", F.col("seen").cast(T.ArrayType(id_kind)).alias("seen"), nothing[0].alias("items"), nothing[1].alias("scores"), F.lit(0).cast("long").alias("visited"), F.lit(True).alias("open"))
    schema, done = state.schema, None
    for first in range(0, n if k > 0 else 0, BROADCAST_ITEMS):
        rows = known.where((F.col("place") >= first) & (F.col("place") <= first + BROADCAST_ITEMS)).toPandas().sort_values("place")
        following = rows["norm"].iloc[BROADCAST_ITEMS] if len(rows) > BROADCAST_ITEMS else -np.inf
        wave = rows.iloc[:BROADCAST_ITEMS]
        factors = np.stack(wave["features"].to_numpy()).astype(np.float64)
        run = _visit(wave["id"].to_numpy(), factors, wave["norm"].to_numpy(), following, model.mean, k, block, to_arrow_type(id_kind))
        state = scratch.save(state.mapInArrow(run, schema))
        ended = state.where(~F.col("open"))
        done = ended if done is None else done.unionByName(ended)
        state = state.where("open")
        if following == -np.inf or state.isEmpty():
            break
    out = state.limit(0) if done is None else done
    blocks = sum(-(-min(BROADCAST_ITEMS, n - first) // block) for first in range(0, n, BROADCAST_ITEMS))
    return out.select("user", "items", "scores", "visited", F.lit(blocks).cast("long").alias("blocks"))


def top_k(users: DataFrame, model: Model, movies: DataFrame, seen: DataFrame, k: int = 10, user: str = "userId", item: str = "movieId") -> DataFrame:
    """(user, item, title, score, rank): for given users, unclamped scores of the movies (id, title) that they have not seen. No rows for k <= 0. See best_items; pairs of users and items are never rows."""
    found = best_items(users, model, movies, seen, k, user, item).select("user", F.posexplode(F.arrays_zip("items", "scores")).alias("place", "best"))
    ranked = found.select("user", F.col("best.items").alias("item"), F.col("best.scores").alias("score"), (F.col("place") + 1).alias("rank"))
    titles = movies.select(F.col("id").alias("item"), "title")
    return ranked.join(titles, "item").select(F.col("user").alias(user), F.col("item").alias(item), "title", "score", "rank")


@dataclass(frozen=True)
class Recall:
    overall: DataFrame
    per_user: DataFrame
    unseen_ids: DataFrame
    users_without_relevant: DataFrame


def recall_at_k(train_rows: DataFrame, val_rows: DataFrame, test_rows: DataFrame, model: Model, movies: DataFrame, k: int = 10, least: Column | float = RELEVANT, user: str = "userId", item: str = "movieId") -> Recall:
    """Recall of each user's relevant test items (rated at least `least`, known from train) in their top-K over all movies."""
    relevant = test_rows.where(F.col("rating") >= least)
    pool = train_rows.select(item).distinct()
    known = relevant.select(user, item).distinct().join(pool, item, "left_semi")
    seen = train_rows.select(user, item).union(val_rows.select(user, item))
    best = top_k(known.select(user), model, movies, seen, k, user, item).select(user, item, F.lit(1).alias("hit"))
    each = known.join(best, [user, item], "left").groupBy(user).agg(F.count(F.lit(1)).alias("relevant"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    each = each.withColumn("recall", F.col("hits") / F.col("relevant"))
    overall = each.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("overall_recall"), F.count(F.lit(1)).alias("n_users"))
    unseen = relevant.select(item).distinct().join(pool, item, "left_anti")
    without = test_rows.select(user).distinct().join(known, user, "left_anti")
    return Recall(overall, each, unseen, without)


#: From train and validation rows to a history and the models of its epochs.
Trainer = Callable[[DataFrame, DataFrame], tuple[DataFrame, dict[int, Model]]]


def run_pipeline(ratings: DataFrame, movies: DataFrame, order: list[str], epochs: list[int] | None = None, options: TrainOptions = TrainOptions(), k: int = 10, user: str = "userId", item: str = "movieId", trainer: Trainer | None = None) -> DataFrame:
    """One row of the whole evaluation: split by time, train with a history, take the epoch of the smallest validation error, and measure it on the test rows. Trained by alternating least squares for each of `epochs`, or by `trainer`.

    (n_train, n_val, n_test, best_epoch, trainRMSE, valRMSE, test_rmse, baseline_rmse, overall_recall, n_users)"""
    parts = Scratch(ratings.sparkSession, "split").save(split_by_time(ratings, order, user))
    train_rows, val_rows, test_rows = (parts.where(F.col("part") == p) for p in ("train", "val", "test"))
    sizes = parts.groupBy().pivot("part", ["train", "val", "test"]).agg(F.count(F.lit(1)))
    trainer = trainer or (lambda rows, val: train_with_history(rows, val, epochs or [options.epochs], options))
    history, models = trainer(train_rows, val_rows)
    best = best_checkpoint(history.select("epoch", "trainRMSE", "valRMSE"))
    model = models[best.first()["epoch"]]
    one = [
        sizes.select(F.coalesce("train", F.lit(0)).alias("n_train"), F.coalesce("val", F.lit(0)).alias("n_val"), F.coalesce("test", F.lit(0)).alias("n_test")),
        best.withColumnRenamed("epoch", "best_epoch"),
        rmse(score(test_rows, model, user, item)).toDF("test_rmse"),
        baseline_rmse(train_rows, test_rows).toDF("baseline_rmse"),
        recall_at_k(train_rows, val_rows, test_rows, model, movies, k, user=user, item=item).overall,
    ]
    out = one[0]
    for more in one[1:]:
        out = out.join(F.broadcast(more))
    return out


def train_embeddings(ratings: DataFrame, options: TrainOptions = TrainOptions(epochs=10, factors=10), validation: float = 0.1, seed: int = 42, user: str = "userId", item: str = "movieId") -> tuple[Model, DataFrame]:
    """The older flow: a model of rank 10 on all but a tenth of the ratings, picked by hash, and (loss, val_loss) as mean squared errors of unclamped predictions."""
    held = F.pmod(F.xxhash64(F.col(user), F.col(item), F.lit(seed)), F.lit(1_000_000)) < int(validation * 1_000_000)
    fit_rows, val_rows = ratings.where(~held), ratings.where(held)
    model = train(fit_rows, options, user, item)
    loss = lambda rows, name: score(rows, model, user, item, clamped=False).agg(F.avg(F.pow(F.col("prediction") - F.col("rating"), F.lit(2.0))).alias(name))
    return model, loss(fit_rows, "loss").join(F.broadcast(loss(val_rows, "val_loss")))
