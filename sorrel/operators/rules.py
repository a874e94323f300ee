"""Association rules: all splits of frequent itemsets, with counts and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import confidence, lift, support
from ..scratch import Scratch


def generate_rules(itemsets: DataFrame, n: int, min_confidence: float) -> DataFrame:
    """Rules from (items, count): every split of an itemset into two non-empty sides with enough confidence.

    Consequents grow by one item a level. Moving an item to the consequent can only lower the
    confidence, as fewer items on the left are in at least as many baskets; so a consequent is built
    from one that was confident and a later item that was confident alone, and the splits that are
    looked at are about those that are kept. Sides are looked up among the itemsets (which hold
    every part of a frequent set) by their sorted arrays."""
    scratch = Scratch(itemsets.sparkSession, "rules")
    counts = scratch.save(itemsets.select(F.array_sort("items").alias("items"), "count"))
    numbered = scratch.save(counts.where(F.size("items") >= 2).withColumn("set", F.monotonically_increasing_id()))
    most = numbered.agg(F.max(F.size("items"))).first()[0] or 0
    antecedents = counts.toDF("antecedent", "antecedent_count")

    def confident(splits: DataFrame) -> DataFrame:
        """(set, items, joint, consequent) to those with enough confidence, with antecedent and its count."""
        met = splits.withColumn("antecedent", F.array_except("items", "consequent")).join(antecedents, "antecedent")
        return scratch.save(met.where(confidence(F.col("joint"), F.col("antecedent_count"))["value"] >= min_confidence))

    level = confident(numbered.select("set", "items", F.col("count").alias("joint"), F.explode(F.transform("items", lambda x: F.array(x))).alias("consequent")))
    single = level.select("set", F.col("consequent")[0].alias("next"))
    levels = [level]
    for _ in range(2, most):
        grown = level.where(F.size("antecedent") > 1).join(single, "set").where(F.col("next") > F.element_at("consequent", -1))
        level = confident(grown.select("set", "items", "joint", F.concat("consequent", F.array("next")).alias("consequent")))
        if level.isEmpty():
            break
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels)
    rules = found.join(counts.toDF("consequent", "consequent_count"), "consequent")
    return with_metrics(rules, F.lit(n)).where(F.col("confidence") >= min_confidence)


def with_metrics(rules: DataFrame, n: Column) -> DataFrame:
    """Rules with three counts to rules with metrics and whether each is defined."""
    s = support(F.col("joint"), n)
    c = confidence(F.col("joint"), F.col("antecedent_count"))
    up = lift(c, F.col("consequent_count"), n)
    columns = ["antecedent", "consequent", "joint", "antecedent_count", "consequent_count"]
    parts = [(s, "support"), (c, "confidence"), (up, "lift")]
    return rules.select(*columns, *[m["value"].alias(name) for m, name in parts], *[m["defined"].alias(f"{name}_defined") for m, name in parts])


def enrich(rules: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """Rules (antecedent, consequent) with the counts and metrics that they lack; given ones stay."""
    names = ["joint", "antecedent_count", "consequent_count", "support", "confidence", "lift"]
    have = [c for c in names if c in rules.columns]
    scratch = Scratch(rules.sparkSession, "enrich")
    # saved, since both the items to count and the rules themselves refer to these numbers
    keyed = scratch.save(rules.select(F.monotonically_increasing_id().alias("_r"), "*")).withColumn("_all", F.array_union("antecedent", "consequent"))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.array_sort(F.array_distinct(c)).alias("items")) for k, c in enumerate(("antecedent", "consequent", "_all"))])
    wants = keyed.select("_r", F.explode(sides).alias("w")).select("_r", "w.side", "w.items")
    # each set once, however many rules have it; a basket meets the sets whose first item it holds, and only counts are shuffled
    sets = scratch.save(wants.select("items").distinct().where(F.size("items") > 0).select(F.col("items")[0].alias("head"), "items"))
    baskets = index.groupBy("basket_id").agg(F.collect_set("stock").alias("own"))
    met = baskets.select("own", F.explode("own").alias("head")).join(sets, "head").where(F.size(F.array_except("items", "own")) == 0)
    each = met.groupBy("items").agg(F.count(F.lit(1)).alias("m"))
    full = wants.join(each, "items").groupBy("_r").pivot("side", [0, 1, 2]).agg(F.first("m"))
    counted = keyed.join(full.toDF("_r", "_a", "_c", "_j"), "_r", "left")
    get = lambda c, own: F.coalesce(*([F.col(c)] if c in have else []), F.col(own), F.lit(0))
    counted = counted.withColumns({"joint": get("joint", "_j"), "antecedent_count": get("antecedent_count", "_a"), "consequent_count": get("consequent_count", "_c")})
    columns = ["antecedent", "consequent", "joint", "antecedent_count", "consequent_count"]
    given = [c for c in ("support", "confidence", "lift") if c in have]
    s = support(F.col("joint"), F.lit(n))
    c = confidence(F.col("joint"), F.col("antecedent_count"))
    parts = [(s, "support"), (c, "confidence"), (lift(c, F.col("consequent_count"), F.lit(n)), "lift")]
    values = [F.coalesce(F.col(name), m["value"]).alias(name) if name in given else m["value"].alias(name) for m, name in parts]
    return counted.select(*columns, *values, *[m["defined"].alias(f"{name}_defined") for m, name in parts])


def reverse(rules: DataFrame, n: Column) -> DataFrame:
    """Rules with their sides exchanged; joint counts stay, metrics are made anew."""
    swapped = rules.select(F.col("consequent").alias("antecedent"), F.col("antecedent").alias("consequent"), "joint", F.col("consequent_count").alias("antecedent_count"), F.col("antecedent_count").alias("consequent_count"))
    return with_metrics(swapped, n)


def lift_above(rules: DataFrame, least: float = 1.0) -> DataFrame:
    return rules.where(F.col("lift") > least)
