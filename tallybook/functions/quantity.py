"""Quantity expressions on printed rows: counts, weights, offers; whole numbers throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT = r"^\(?([0-9]{1,3})\)? ?@ ?\$?([0-9]+)\.([0-9]{2})"
WEIGHT = r"^([0-9]+)\.([0-9]{3}) ?(?:kg|k9|lb|ib|1b) ?@ ?\$?([0-9]+)\.([0-9]{2})"
OFFER = r"^\(?([0-9]{1,2}) ?(?:/|for) ?\$?([0-9]+)\.([0-9]{2})"
COUNT_CENTS, WEIGHT_CENTS = 2, 3


def _number(text: Column, pattern: str, *groups: int) -> Column:
    """The digits of some groups read as one whole number."""
    return F.concat(*[F.regexp_extract(text, pattern, g) for g in groups]).try_cast("bigint")


def parsed(text: Column) -> Column:
    """struct<pattern, count, milli, cents>: count @ price, weight (in thousandths) @ rate, n for price;
    null when the row is none of them."""
    low = F.lower(F.trim(text))

    def row(kind: str, count: Column, milli: Column, cents: Column) -> Column:
        return F.struct(F.lit(kind).alias("pattern"), count.cast("bigint").alias("count"), milli.cast("bigint").alias("milli"), cents.cast("bigint").alias("cents"))

    none = F.lit(None)
    return (
        F.when(low.rlike(WEIGHT), row("weight", none, _number(low, WEIGHT, 1, 2), _number(low, WEIGHT, 3, 4)))
        .when(low.rlike(COUNT), row("count", _number(low, COUNT, 1), none, _number(low, COUNT, 2, 3)))
        .when(low.rlike(OFFER), row("offer", _number(low, OFFER, 1), none, _number(low, OFFER, 2, 3)))
    )


def extends_to(quantity: Column, total: Column) -> Column:
    """Whether the expression's extension is the printed total, within the pattern's tolerance."""
    weighed = F.floor((quantity["milli"] * quantity["cents"] + 500) / 1000)
    return (
        F.when(quantity["pattern"] == "weight", F.abs(weighed - total) <= WEIGHT_CENTS)
        .when(quantity["pattern"] == "count", F.abs(quantity["count"] * quantity["cents"] - total) <= COUNT_CENTS)
        .when(quantity["pattern"] == "offer", F.abs(quantity["cents"] - total) <= COUNT_CENTS)
    )
