"""Store details in header rows: postal codes, phones, streets, store numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSTAL = r"([A-Z][0-9][A-Z]) ?([0-9][A-Z][0-9])"
ZIP = r"(?:^|[^0-9])([0-9]{5})(?:-[0-9]{4})?(?:$|[^0-9])"
PHONE = r"\(?([0-9]{3})\)?[ .-]?([0-9]{3})[ .-]([0-9]{4})"
STREET = r"(?i)([0-9]{1,6} [a-z][a-z .'-]* (?:st|street|ave|avenue|rd|road|blvd|dr|drive|way|pkwy|hwy)\.?)(?:$|[^a-z])"
STORE = r"(?i)(?:store|str|branch) ?(?:#|no\.?|number)? ?:? ?#?([0-9]{2,6})"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def postal_code(text: Column) -> Column:
    """A Canadian code as ``A1A 1A1``, else a five-digit one."""
    up = F.upper(text)
    return F.coalesce(F.when(up.rlike(POSTAL), F.concat(F.regexp_extract(up, POSTAL, 1), F.lit(" "), F.regexp_extract(up, POSTAL, 2))), _first(up, ZIP))


def phone_number(text: Column) -> Column:
    """Ten digits with dashes."""
    return F.when(text.rlike(PHONE), F.concat_ws("-", *[F.regexp_extract(text, PHONE, g) for g in (1, 2, 3)]))


def street(text: Column) -> Column:
    return _first(text, STREET)


def store_number(text: Column) -> Column:
    return F.nullif(F.ltrim(F.regexp_extract(text, STORE, 1), F.lit("0")), F.lit(""))
