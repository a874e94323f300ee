"""Readers and writers of ratings, items, edges, retail logs and encoded baskets. Typed, lazy, no collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 18 genre names, in the order of the flags after the "unknown" flag.
GENRES = [
    "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy",
    "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
]
#: Fields of an item line before the genre flags: id, title, three more, and the "unknown" flag.
FIRST_GENRE = 6

# The menu of the random pick.
LUNCH_MENU = [
    ("Pizza", "fas fa-pizza-slice"),
    ("Sushi", "fas fa-fish"),
    ("Burger", "fas fa-hamburger"),
    ("Salad", "fas fa-leaf"),
    ("Tacos", "fas fa-utensil-spoon"),
    ("Ramen", "fas fa-bowl-hot"),
    ("Sandwich", "fas fa-bread-slice"),
    ("Pasta", "fas fa-pasta"),
    ("Curry", "fas fa-mortar-pestle"),
    ("Steak", "fas fa-drumstick-bite"),
    ("Soup", "fas fa-bowl"),
    ("BBQ", "fas fa-fire"),
]

RETAIL_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
RETAIL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RETAIL_COLUMNS] + [T.StructField("_corrupt_record", T.StringType())])


def _fields(spark: SparkSession, path: str, separator: str, least: int) -> DataFrame:
    """Non-blank lines of at least `least` fields, as an array column f."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.split("value", separator, -1).alias("f")).where(F.size("f") >= least)


def genres_of(flags: Column, names: list[str] = GENRES) -> Column:
    """Names whose flag is "1"."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), flags.alias("flag"))
    return F.transform(F.filter(pairs, lambda p: p["flag"] == "1"), lambda p: p["name"])


def read_items(spark: SparkSession, path: str, min_fields: int = 24, legacy_shift: bool = False) -> DataFrame:
    """Pipe-separated items: id, title, genres. legacy_shift reads the flags one place early, as older data pages did."""
    first = FIRST_GENRE - (1 if legacy_shift else 0)
    f = _fields(spark, path, r"\|", min_fields)
    number = F.nullif(F.regexp_extract(F.get("f", F.lit(0)), r"^\s*([+-]?\d+)", 1), F.lit(""))
    rows = f.select(number.try_cast("int").alias("id"), F.get("f", F.lit(1)).alias("title"), genres_of(F.slice("f", first + 1, len(GENRES))).alias("genres"))
    return rows.where(F.col("id").isNotNull())


def read_ratings(spark: SparkSession, path: str, item_col: str = "movieId", min_fields: int = 4) -> DataFrame:
    """Tab-separated ratings: userId, item, rating, and the timestamp in seconds if the lines have it."""
    f = _fields(spark, path, "\t", min_fields)
    get = lambda i, kind: F.expr(f"try_cast(trim(get(f, {i})) as {kind})")
    columns = [get(0, "int").alias("userId"), get(1, "int").alias(item_col), get(2, "double").alias("rating")]
    return f.select(*columns, get(3, "bigint").alias("timestamp")) if min_fields >= 4 else f.select(*columns)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A header-less list of undirected edges."""
    return spark.read.csv(path, schema="src int, dst int").where("src is not null and dst is not null")


def read_retail(spark: SparkSession, path: str) -> DataFrame:
    """A retail log, all fields as strings; a header other than the agreed one fails, and lines of another width keep their text in _corrupt_record."""
    return spark.read.csv(path, schema=RETAIL_SCHEMA, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", encoding="UTF-8")


def with_position(rows: DataFrame, name: str = "place") -> DataFrame:
    """Rows just read from files, with their place in them: file by file, then as they stand. Rows of a split are read in order, so numbers that rise within a task order them; no shuffle."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(name))


def lunch_menu(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LUNCH_MENU, "name string, icon string")


def id_list(spark: SparkSession, n: int) -> DataFrame:
    """Every id from 1 to n, gaps included."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"))


def write_encoded(items: DataFrame, baskets: DataFrame, provenance: str, path: str) -> int:
    """Write an encoded dataset as three tables; returns the number of baskets."""
    spark = items.sparkSession
    items.write.mode("overwrite").parquet(f"{path}/items")
    baskets.write.mode("overwrite").parquet(f"{path}/baskets")
    n = spark.read.parquet(f"{path}/baskets").count()
    meta = [(n, spark.read.parquet(f"{path}/items").count(), provenance)]
    spark.createDataFrame(meta, "n_baskets bigint, n_items bigint, dataset_provenance string").write.mode("overwrite").json(f"{path}/meta")
    return n


def read_encoded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, baskets, meta); Spark raises where they are missing."""
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/baskets"), spark.read.json(f"{path}/meta")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
