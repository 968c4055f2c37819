"""Boxes of one page: filters, clusters, angles, pairing, lowering to lines.

``boxes``: receipt_id, det_idx, x0, x1, y0, y1, text, confidence.  Every self-join is an equi join
on the receipt with a range condition inside, since boxes of different receipts never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_y(a: str, b: str) -> Column:
    """Shared height of two boxes; negative when apart."""
    return F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))


def overlaps(a: str, b: str, tenths: int) -> Column:
    """Shared height of at least ``tenths``/10 of the lower box."""
    low = F.least(F.col(f"{a}.y1") - F.col(f"{a}.y0"), F.col(f"{b}.y1") - F.col(f"{b}.y0"))
    return 10 * overlap_y(a, b) >= tenths * low


def with_neighbour(boxes: DataFrame, others: DataFrame, tenths: int = 3, how: str = "left_semi") -> DataFrame:
    """Boxes that share a row with one of ``others`` (semi) or with none (anti)."""
    met = (F.col("a.receipt_id") == F.col("b.receipt_id")) & (F.col("a.det_idx") != F.col("b.det_idx")) & overlaps("a", "b", tenths)
    return boxes.alias("a").join(others.alias("b"), met, how)


def quality_filtered(boxes: DataFrame, floor: int, min_chars: int = 2) -> DataFrame:
    """Confident boxes with enough text, and unsure ones that are the only text of a priced row."""
    sure = (F.col("confidence") >= floor) & (F.length(F.trim("text")) >= min_chars)
    wordlike = F.col("text").rlike("[A-Za-z]{3}")
    good, poor = boxes.where(sure), boxes.where(~sure & wordlike)
    priced = with_neighbour(poor, boxes.where(F.col("text").rlike(r"^[0-9]+\.[0-9]{2}$")))
    alone = with_neighbour(priced, good.where(wordlike), how="left_anti")
    return good.unionByName(alone)


def row_clusters(boxes: DataFrame, link: int) -> DataFrame:
    """Single linkage along the page: a gap over ``link`` between neighbouring centres (both doubled,
    to stay whole) opens a new row."""
    w = Window.partitionBy("receipt_id").orderBy("centre2", "det_idx")
    rows = boxes.withColumn("centre2", F.col("y0") + F.col("y1"))
    rows = rows.withColumn("_gap", F.col("centre2") - F.lag("centre2").over(w))
    return rows.withColumn("row_no", F.sum(F.when(F.col("_gap") > 2 * link, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def upper_median(boxes: DataFrame, value: Column, name: str) -> DataFrame:
    """The element at n/2 of the sorted values of each receipt."""
    return boxes.groupBy("receipt_id").agg(F.sort_array(F.collect_list(value)).alias("_v")).select("receipt_id", F.element_at("_v", F.floor(F.size("_v") / 2).cast("int") + 1).alias(name))


def pair_candidates(boxes: DataFrame, width: int, reach: int) -> DataFrame:
    """Left box and right box of a possible row, with the milli-slope between their centres."""
    left = boxes.where(5 * F.col("x1") <= 2 * width).alias("a")
    right = boxes.where((5 * F.col("x0") >= 3 * width) & F.col("text").rlike("[0-9]")).alias("b")
    mid = lambda t: (F.col(f"{t}.y0") + F.col(f"{t}.y1")) / 2
    met = left.join(right, (F.col("a.receipt_id") == F.col("b.receipt_id")) & (F.abs(mid("a") - mid("b")) <= reach))
    slope = F.round(1000 * (mid("b") - mid("a")) / (F.col("b.x0") - F.col("a.x0"))).cast("long")
    return met.select("a.receipt_id", F.col("a.det_idx").alias("left_idx"), F.col("b.det_idx").alias("right_idx"), slope.alias("slope"))


def best_slope(candidates: DataFrame, tolerance: int) -> DataFrame:
    """The slope that most pairs of distinct left rows support within ``tolerance``; ties to the flatter,
    then the smaller.

    One pass over each receipt's candidates in order of slope: a left row supports the slopes from its own
    less the tolerance up to its own plus it, so the rows behind a slope are those of a range window."""
    near = Window.partitionBy("receipt_id").orderBy("slope").rangeBetween(-tolerance, tolerance)
    backed = candidates.select("receipt_id", "slope", F.size(F.collect_set("left_idx").over(near)).alias("support"))
    order = F.struct(F.col("support"), -F.abs("slope"), -F.col("slope"))
    return backed.groupBy("receipt_id").agg(F.max_by(F.struct("slope", "support"), order).alias("best")).select("receipt_id", "best.slope", "best.support")


def reading_order(boxes: DataFrame, band: int) -> DataFrame:
    """Top to bottom in bands, then left to right; ties keep the source order."""
    w = Window.partitionBy("receipt_id").orderBy(F.floor((F.col("y0") + F.col("y1")) / (2 * band)), "x0", "det_idx")
    return boxes.withColumn("position", F.row_number().over(w))


def nearest_above(targets: DataFrame, rows: DataFrame, reach: int, most: int) -> DataFrame:
    """For each target box the nearest rows whose centre is at most ``reach`` higher or level, in order."""
    t, r = targets.alias("t"), rows.alias("r")
    gap = (F.col("t.y0") + F.col("t.y1")) - (F.col("r.y0") + F.col("r.y1"))
    met = t.join(r, (F.col("t.receipt_id") == F.col("r.receipt_id")) & gap.between(0, 2 * reach))
    w = Window.partitionBy("receipt_id", "target_idx").orderBy("gap2", "row_idx")
    out = met.select(F.col("t.receipt_id").alias("receipt_id"), F.col("t.det_idx").alias("target_idx"), F.col("r.det_idx").alias("row_idx"), gap.alias("gap2"))
    return out.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def nearest_row(targets: DataFrame, rows: DataFrame, reach: int) -> DataFrame:
    """The row for each target box: same band before outside, then the smaller distance, then the upper."""
    t, r = targets.alias("t"), rows.alias("r")
    gap = (F.col("r.y0") + F.col("r.y1")) - (F.col("t.y0") + F.col("t.y1"))
    met = t.join(r, (F.col("t.receipt_id") == F.col("r.receipt_id")) & (F.abs(gap) <= 2 * reach))
    out = met.select(F.col("t.receipt_id").alias("receipt_id"), F.col("t.det_idx").alias("target_idx"), F.col("r.det_idx").alias("row_idx"), F.abs(gap).alias("gap2"), overlaps("t", "r", 3).alias("same_band"))
    w = Window.partitionBy("receipt_id", "target_idx").orderBy(F.desc("same_band"), "gap2", "row_idx")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lowered(clustered: DataFrame) -> DataFrame:
    """Row clusters as text lines, words joined left to right."""
    words = F.sort_array(F.collect_list(F.struct("x0", "det_idx", "text")))
    return clustered.groupBy("receipt_id", "row_no").agg(words.alias("w"), F.min("y0").alias("top"), F.max("y1").alias("bottom")).select("receipt_id", "row_no", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"), "top", "bottom")


def line_spans(clustered: DataFrame) -> DataFrame:
    """receipt_id, row_no, top, bottom and middle (mean centre, doubled) of each row."""
    return clustered.groupBy("receipt_id", "row_no").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.avg(F.col("y0") + F.col("y1")).alias("middle2"))


def to_lines(boxes: DataFrame, spans: DataFrame, reach: int) -> DataFrame:
    """Boxes against the rows of their receipt at most ``reach`` away: shared height by the lower of the two,
    whether either centre lies within the other, and how far the box's centre is from the row."""
    met = boxes.alias("b").join(spans.alias("s"), (F.col("b.receipt_id") == F.col("s.receipt_id")) & (F.col("b.y0") <= F.col("s.bottom") + reach) & (F.col("b.y1") >= F.col("s.top") - reach))
    centre = F.col("b.y0") + F.col("b.y1")
    shared = F.greatest(F.least("b.y1", "s.bottom") - F.greatest("b.y0", "s.top"), F.lit(0))
    low = F.greatest(F.least(F.col("b.y1") - F.col("b.y0"), F.col("s.bottom") - F.col("s.top")), F.lit(1e-6))
    agree = centre.between(2 * F.col("s.top"), 2 * F.col("s.bottom")) | F.col("s.middle2").between(2 * F.col("b.y0"), 2 * F.col("b.y1"))
    away = F.greatest(2 * F.col("s.top") - centre, centre - 2 * F.col("s.bottom"), F.lit(0)) / 2
    return met.select("b.receipt_id", "b.det_idx", "s.row_no", F.round(shared / low, 6).alias("overlap"), agree.alias("centres_agree"), away.alias("away"))


def indent_levels(boxes: DataFrame, link: int) -> DataFrame:
    """Left edges clustered by single linkage: level number and its boxes."""
    w = Window.partitionBy("receipt_id").orderBy("x0", "det_idx")
    rows = boxes.withColumn("_gap", F.col("x0") - F.lag("x0").over(w))
    return rows.withColumn("level", F.sum(F.when(F.col("_gap") > link, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0")), F.lit(0))
    h = F.greatest(overlap_y(a, b), F.lit(0))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    return w * h / (area(a) + area(b) - w * h)


def causes(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Why a wanted box failed, by its best overlap with a live one: missed, badly cut or misread."""
    met = wanted.alias("a").join(live.alias("b"), (F.col("a.receipt_id") == F.col("b.receipt_id")) & (overlap_y("a", "b") > 0), "left")
    best = met.groupBy(F.col("a.receipt_id").alias("receipt_id"), F.col("a.det_idx").alias("det_idx")).agg(F.coalesce(F.max(iou("a", "b")), F.lit(0.0)).alias("iou"))
    return best.withColumn("cause", F.when(F.col("iou") <= 0.05, "miss").when(F.col("iou") <= 0.5, "bad_crop").otherwise("misread"))
