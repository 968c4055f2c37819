"""Corpus reports over scored receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup_report(scores: DataFrame, by: str) -> DataFrame:
    """Counts and means for each group and for all, in one pass (``n_groups`` 0: all)."""
    out = scores.rollup(by).agg(F.grouping(by).alias("is_all"), F.count("*").alias("n"), F.sum("items").alias("items"), F.count_if(F.col("header_ok")).alias("header_ok"), F.count_if(F.col("items_ok")).alias("items_ok"), F.count_if(F.col("header_ok") & F.col("items_ok")).alias("full_ok"))
    return out.select(by, "is_all", "n", "items", "header_ok", "items_ok", "full_ok")


def box_recall(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """receipt_id, wanted, found: wanted boxes whose centre lies in a live box of the receipt."""
    x, y = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2
    inside = x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    found = wanted.alias("a").join(live.alias("b"), (F.col("a.receipt_id") == F.col("b.receipt_id")) & inside, "left_semi").groupBy("receipt_id").agg(F.count("*").alias("found"))
    every = wanted.groupBy("receipt_id").agg(F.count("*").alias("wanted"))
    return every.join(found, "receipt_id", "left").select("receipt_id", "wanted", F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def exact_sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Exactly ``k`` rows (or all), chosen by a seeded hash of the key that any engine can compute."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)
