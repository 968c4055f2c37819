"""Exact money as integer cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.columns import let

#: The least and the largest bigint.
LEAST, MOST = -(2**63), 2**63 - 1


def cents(amount: Column) -> Column:
    """A double amount as cents."""
    return F.round(amount * 100).cast("bigint")


def parse_strict(text: Column) -> Column:
    """``-?digits(.d{0,2})?`` as cents; null for anything else or on overflow."""
    whole = F.regexp_extract(text, r"^-?([0-9]*)(?:\.([0-9]{0,2}))?\z", 1)
    part = F.rpad(F.regexp_extract(text, r"^-?([0-9]*)(?:\.([0-9]{0,2}))?\z", 2), 2, "0")
    value = F.try_add(F.try_multiply(F.when(whole == "", F.lit(0)).otherwise(whole.try_cast("bigint")), F.lit(100).cast("bigint")), part.cast("bigint"))
    return F.when(text.rlike(r"^-?(?:[0-9]+(?:\.[0-9]{0,2})?|\.[0-9]{1,2})\z"), F.when(text.startswith("-"), -value).otherwise(value))


def parse_lenient(text: Column) -> Column:
    """Cents of a decimal text: a bad part counts 0, digits beyond two are cut off, overflow is 0."""
    plain = F.regexp_replace(F.trim(text), "^-", "")
    whole = F.coalesce(F.substring_index(plain, ".", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    tail = F.when(F.contains(plain, F.lit(".")), F.substring_index(plain, ".", -1)).otherwise("")
    part = F.coalesce(F.rpad(F.substring(tail, 1, 2), 2, "0").try_cast("bigint"), F.lit(0).cast("bigint"))
    value = F.coalesce(F.try_add(F.try_multiply(whole, F.lit(100).cast("bigint")), part), F.lit(0).cast("bigint"))
    return F.when(F.trim(text).startswith("-"), -value).otherwise(value)


def from_scaled4(scaled: Column) -> Column:
    """Amounts scaled by 10,000 as cents, toward zero."""
    return F.when(scaled >= 0, F.floor(scaled / 100)).otherwise(F.ceil(scaled / 100)).cast("bigint")


def text(amount: Column) -> Column:
    """Cents with two decimals."""
    size = F.abs(amount)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def less(a: Column, b: Column) -> Column:
    """``a`` without ``b``; null on overflow, which is seen beforehand: a subtraction that fails costs as much as dozens that don't."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.when(b >= 0, F.when(a >= F.lit(LEAST) + b, a - b)).otherwise(F.when(a <= F.lit(MOST) + b, a - b))


def whole_dollars(digits: Column) -> Column:
    """Dollars without a fraction as cents; null on overflow or for anything else."""
    return F.try_multiply(digits.try_cast("bigint"), F.lit(100).cast("bigint"))


def scaled(text: Column, places: int) -> Column:
    """A decimal text times 10**``places``, rounded half away from zero on the next digit; null without a whole part."""

    def read(t: Column) -> Column:
        plain = F.ltrim(t, F.lit("-"))
        whole = F.substring_index(plain, ".", 1).try_cast("bigint")
        digits = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.substring(plain, F.instr(plain, ".") + 1, F.length(plain)), "[^0-9]", "")).otherwise("")

        def rounded(part: Column) -> Column:
            size = F.try_multiply(whole, F.lit(10**places).cast("bigint")) + F.substring(part, 1, places).cast("bigint") + F.when(F.substring(part, places + 1, 1) >= "5", 1).otherwise(0)
            return F.when(t.startswith("-"), -size).otherwise(size)

        return let(F.rpad(digits, places + 1, "0"), rounded)

    return let(F.trim(text), read)
