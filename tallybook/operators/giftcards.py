"""Gift-card evidence: blocks of rows around tenders, associations by rank, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identifier(text: Column) -> Column:
    """Masking characters as one kind."""
    return F.translate(text, "xX×", "***")


def blocks(rows: DataFrame, ends: Column) -> DataFrame:
    """rows (receipt_id, line_no, ...) with ``block``: a row where ``ends`` holds closes its block."""
    before = Window.partitionBy("receipt_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("block", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)))


def redemptions(tenders: DataFrame, rows: DataFrame, reach: int) -> DataFrame:
    """For each tender (receipt_id, line_no) the rows after it, up to the next tender and ``reach`` rows:
    its card and approval if each has one distinct value, else null, with what stayed unresolved."""
    w = Window.partitionBy("receipt_id").orderBy("line_no")
    spans = tenders.select("receipt_id", F.col("line_no").alias("start"), F.least(F.coalesce(F.lead("line_no").over(w), F.col("line_no") + reach), F.col("line_no") + reach).alias("stop"))
    met = spans.alias("s").join(rows.alias("r"), (F.col("s.receipt_id") == F.col("r.receipt_id")) & (F.col("r.line_no") >= F.col("start")) & (F.col("r.line_no") < F.col("stop")), "left")
    found = met.groupBy(F.col("s.receipt_id").alias("receipt_id"), "start").agg(*[F.min(c).alias(c) for c in ("card", "approval")], *[F.max(c).alias(f"{c}_high") for c in ("card", "approval")])
    one = lambda c: F.when(F.col(c) == F.col(f"{c}_high"), F.col(c)).alias(c)
    open_ = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c) != F.col(f"{c}_high")), F.lit(c)) for c in ("card", "approval")])), ",")
    return found.select("receipt_id", "start", one("card"), one("approval"), open_.alias("unresolved"))


def attached_by_rank(items: DataFrame, slips: DataFrame, key: str) -> DataFrame:
    """items and slips (receipt_id, key, line_no) paired in order, only where both sides count the same."""
    side = Window.partitionBy("receipt_id", key)

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select("receipt_id", key, F.col("line_no").alias(name), F.row_number().over(side.orderBy("line_no")).alias("nth"), F.count("*").over(side).alias("n"))

    return numbered(items, "item_line").join(numbered(slips, "slip_line"), ["receipt_id", key, "nth", "n"]).select("receipt_id", key, "item_line", "slip_line")


def corrected_fields(old: str, new: str, fields: list[str]) -> Column:
    """Names of the fields whose values differ, nulls told apart from values."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")), F.lit(c)) for c in fields])), ",")
