"""OCR snapshots: one JSON file a receipt, with heterogeneous arrays, as a relation of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels of padding that snapshots carry on every side.
PADDING = 50


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """receipt_id, det_idx, points, text, confidence, width, height of every detection."""
    files = spark.read.option("pathGlobFilter", "*.ocr.json").text(path, wholetext=True)
    doc = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.ocr\.json$", 1).alias("receipt_id"), F.from_json("value", "struct<image_width:int,image_height:int,detections:array<string>>").alias("j"))
    rows = doc.select("receipt_id", F.col("j.image_width").alias("width"), F.col("j.image_height").alias("height"), F.posexplode("j.detections").alias("det_idx", "d"))
    # a detection is [points, [text, confidence]]; read its two halves as JSON again
    return rows.select(
        "receipt_id", "det_idx", F.from_json(F.get_json_object("d", "$[0]"), "array<array<double>>").alias("points"),
        F.get_json_object("d", "$[1][0]").alias("text"), F.get_json_object("d", "$[1][1]").cast("double").alias("confidence"), "width", "height",
    )


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """receipt_id and what its file expects, as typed columns."""
    files = spark.read.option("pathGlobFilter", "*.expected.json").text(path, wholetext=True)
    part = lambda key, shape: F.from_json(F.get_json_object("value", f"$.{key}"), shape).alias(key)
    return files.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.expected\.json$", 1).alias("receipt_id"),
        *[F.get_json_object("value", f"$.{k}").alias(k) for k in ("merchant", "date", "total")],
        part("merchant_any_of", "array<string>"), part("tenders", "array<struct<kind:string,amount:string>>"), part("critical_items", "array<struct<description:string,price:string,category:string>>"),
    )


def boxes_of(detections: DataFrame, padding: int = PADDING) -> DataFrame:
    """Polygons as boxes, padding removed once; unusable polygons (under four points, not finite) go."""
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    sound = (F.size("points") >= 4) & F.forall("points", lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull() & ~F.isnan(p[0]) & ~F.isnan(p[1]))
    return detections.where(sound).select(
        "receipt_id", "det_idx", (F.array_min(xs) - padding).alias("x0"), (F.array_max(xs) - padding).alias("x1"), (F.array_min(ys) - padding).alias("y0"), (F.array_max(ys) - padding).alias("y1"),
        (F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size("points") - padding).alias("cy"), "text", "confidence", (F.col("width") - 2 * padding).alias("page_w"), (F.col("height") - 2 * padding).alias("page_h"),
    )

