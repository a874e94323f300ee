"""Retail log to clean, dictionary-encoded baskets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import normal_code, normal_description, number_of, strip
from ..scratch import Scratch
from .ranks import with_place

# What marks a row as no product.
NON_PRODUCT_DESCRIPTIONS = ["POSTAGE", "DOTCOM POSTAGE", "CARRIAGE", "CRUK COMMISSION", "MANUAL", "SAMPLES", "DISCOUNT"]
NON_PRODUCT_CODES = ["AMAZONFEE", "B", "PADS", "23444", "23574", "23595"]
NON_PRODUCT_CODE_PATTERNS = [r"^BANK CHARGES$", r"^TEST\d*$", r"^gift_\d+"]
INTERNAL_DESCRIPTIONS = [
    "AMAZON FEE", "MANUAL", "DISCOUNT", "ADJUSTMENT", "RE-ADJUSTMENT", "DOTCOM POSTAGE",
    "POSTAGE", "PACKING CHARGE", "NEXT DAY CARRIAGE", "BANK CHARGES", "CRUK COMMISSION",
]
INTERNAL_CODE_PATTERN = r"^[MD][A-Za-z0-9]{4,}$"

#: Reasons in the order in which they are tried.
REASONS = ["bad_columns", "cancellation_or_adjustment", "blank_description", "bad_number", "quantity", "price", "blank_customer", "blank_code", "non_product"]


def is_non_product(code: Column, description: Column) -> Column:
    """code: normalised; description: as it is in the log."""
    text = F.upper(strip(description))
    return text.isin(NON_PRODUCT_DESCRIPTIONS) | code.rlike("(?i)" + "|".join(NON_PRODUCT_CODE_PATTERNS)) | code.isin(NON_PRODUCT_CODES) | (code.rlike(INTERNAL_CODE_PATTERN) & text.isin(INTERNAL_DESCRIPTIONS))


def with_drop_reason(log: DataFrame) -> DataFrame:
    """log with drop_reason (null: kept), stock, quantity and price. One projection, whatever the number of rules."""
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    out = log.withColumns({"stock": normal_code(F.coalesce("StockCode", F.lit(""))), "quantity": number_of(F.col("Quantity")), "price": number_of(F.col("UnitPrice"))})
    bad_width = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in log.columns else F.lit(False)
    reason = (
        F.when(bad_width, REASONS[0])
        .when(F.substring("InvoiceNo", 1, 1).isin("C", "A"), REASONS[1])
        .when(blank("Description"), REASONS[2])
        .when(F.col("quantity").isNull() | F.col("price").isNull(), REASONS[3])
        .when(F.col("quantity") <= 0, REASONS[4])
        .when(F.col("price") <= 0, REASONS[5])
        .when(blank("CustomerID"), REASONS[6])
        .when(F.col("stock") == "", REASONS[7])
        .when(is_non_product(F.col("stock"), F.col("Description")), REASONS[8])
    )
    return out.withColumn("drop_reason", reason)


def waterfall(reasoned: DataFrame) -> DataFrame:
    """(reason, n) with a row `kept`."""
    return reasoned.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kept_lines(reasoned: DataFrame) -> DataFrame:
    """(invoice, stock, description) of the kept rows."""
    return reasoned.where(F.col("drop_reason").isNull()).select(F.col("InvoiceNo").alias("invoice"), "stock", strip(F.col("Description")).alias("description"))


def canonical_descriptions(kept: DataFrame) -> DataFrame:
    """(stock, description): the most frequent normalised description, the smallest of equals. Counted first, so a hot code shuffles one row per description."""
    counts = kept.groupBy("stock", normal_description(F.col("description")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("stock").agg(F.min(F.struct(-F.col("n"), "d"))["d"].alias("description"))


def build_baskets(kept: DataFrame, canonical: DataFrame, min_items: int = 2) -> DataFrame:
    """(invoice, items): distinct codes with their description, sorted by code; baskets of at least min_items."""
    # dealt out by invoice first, which serves both groupings where the descriptions are few
    own = kept.groupBy("invoice").agg(F.collect_set("stock").alias("stocks"))
    lines = own.select("invoice", F.explode("stocks").alias("stock")).join(canonical, "stock")
    items = F.array_sort(F.collect_list(F.struct("stock", "description")))
    return lines.groupBy("invoice").agg(items.alias("items")).where(F.size("items") >= min_items)


def item_dictionary(baskets: DataFrame) -> DataFrame:
    """(idx, stock, description, n): items by falling basket count, then code, from 0. Ranked by ranges, so many items of one count are no single task."""
    each = baskets.select(F.explode("items").alias("item")).groupBy("item.stock", "item.description").agg(F.count(F.lit(1)).alias("n"))
    return with_place(each, F.desc("n"), "stock", name="idx", first=0).select(F.col("idx").cast("int").alias("idx"), "stock", "description", "n")


@dataclass(frozen=True)
class Cleaned:
    """What a log was cleaned to: tables already saved, and the report of the passes that wrote them."""

    kept: DataFrame
    canonical: DataFrame
    baskets: DataFrame
    dictionary: DataFrame
    report: DataFrame


def clean_log(log: DataFrame, min_items: int = 2, top: int = 10) -> Cleaned:
    """The whole cleaning, each table written once. The rows and reasons are observed while the kept rows are written, baskets and their rows while the baskets are.

    report: (section, name, n) with sections `rows` (raw, kept, in_baskets), `dropped` (each reason), `size` (baskets, items) and `top` (codes by basket count)."""
    spark = log.sparkSession
    scratch = Scratch(spark, "cleaning")
    rows, ends = Observation(), Observation()
    counts = [F.count(F.when(F.col("drop_reason") == r, 1)).alias(r) for r in REASONS]
    kept = scratch.save(kept_lines(with_drop_reason(log).observe(rows, F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("drop_reason").isNull(), 1)).alias("kept"), *counts)))
    canonical = scratch.save(canonical_descriptions(kept))
    made = build_baskets(kept, canonical, min_items).observe(ends, F.count(F.lit(1)).alias("baskets"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("in_baskets"))
    baskets = scratch.save(made)
    dictionary = item_dictionary(baskets)
    seen = rows.get | ends.get
    report = [("rows", c, seen[c]) for c in ("raw", "kept", "in_baskets")] + [("dropped", r, seen[r]) for r in REASONS] + [("size", "baskets", seen["baskets"])]
    listed = spark.createDataFrame(report, "section string, name string, n long")
    items = dictionary.agg(F.count(F.lit(1)).alias("n")).select(F.lit("size").alias("section"), F.lit("items").alias("name"), "n")
    best = dictionary.where(F.col("idx") < top).select(F.lit("top").alias("section"), F.col("stock").alias("name"), "n")
    return Cleaned(kept, canonical, baskets, dictionary, listed.unionByName(items).unionByName(best))


def first_entries(rows: DataFrame, key: str = "stock", value: str = "description", place: str = "place") -> DataFrame:
    """(key, value): of repeated keys the entry that comes first in the order of `place` (see sources.with_position)."""
    return rows.groupBy(key).agg(F.min_by(value, place).alias(value))


def in_first_seen_order(kept: DataFrame, baskets: DataFrame, place: str = "place") -> DataFrame:
    """baskets with `nth`, from 0, in the order in which their invoices first appear among the kept rows."""
    first = kept.groupBy("invoice").agg(F.min(place).alias("first"))
    return with_place(baskets.join(first, "invoice"), "first", name="nth", first=0).drop("first")


def encode_baskets(baskets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(invoice, item_idx)."""
    each = baskets.select("invoice", F.explode("items.stock").alias("stock")).join(dictionary.select("stock", "idx"), "stock")
    return each.groupBy("invoice").agg(F.array_sort(F.collect_list("idx")).alias("item_idx"))


def decode_baskets(encoded: DataFrame, dictionary: DataFrame, basket_col: str = "invoice") -> DataFrame:
    """(basket, items) from indices."""
    each = encoded.select(basket_col, F.explode("item_idx").alias("idx")).join(dictionary.select("idx", "stock", "description"), "idx")
    return each.groupBy(basket_col).agg(F.array_sort(F.collect_list(F.struct("stock", "description"))).alias("items"))


def provenance(source: str, n_rows: int, n_baskets: int) -> str:
    """One line that says what a dataset was made from."""
    return f"{source} cleaned to {n_rows:,} rows and {n_baskets:,} baskets: no cancellations, quantities or prices of 0 or less, blank descriptions, non-product codes or single-item baskets."
