"""Whether what was read is what was expected, for reports over a corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions import money
from tallybook.functions.columns import let

#: Share of letters that two names must have in common.
ALIKE = 0.85
#: Strings that tell a chain, in order, and the chain (fixed values).
CHAINS = [
    ("COSTCO", "Costco"), ("FOODY", "Foody Mart"), ("FRESHCO", "FreshCo"), ("BESTCO", "Bestco Fresh"), ("FRILL", "No Frills"), ("T&T", "T&T"), ("C&C", "C&C"), ("JIN LIAN", "Jin Lian"), ("LOBLAW", "Loblaw"),
    ("LCBO", "LCBO"), ("WALMART", "Walmart"), ("SHOPPERS", "Shoppers"), ("SUNNY", "Sunny Foodmart"), ("PREMIUM", "Al-Premium"), ("REAL CANADIAN", "Real Canadian"), ("RCSS", "Real Canadian"),
]
#: Names of provinces, without blanks, and their codes (fixed values).
REGIONS = {
    "ALBERTA": "AB", "BRITISHCOLUMBIA": "BC", "MANITOBA": "MB", "NEWBRUNSWICK": "NB", "NEWFOUNDLAND": "NL", "NEWFOUNDLANDANDLABRADOR": "NL", "NOVASCOTIA": "NS", "ONTARIO": "ON", "PRINCEEDWARDISLAND": "PE",
    "QUEBEC": "QC", "SASKATCHEWAN": "SK",
}


def plain_name(text: Column) -> Column:
    """Letters and digits in capitals."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def holds(a: Column, b: Column) -> Column:
    """One holds the other."""
    return F.contains(a, b) | F.contains(b, a)


def names_match(expected: Column, actual: Column) -> Column:
    """One plain name holds the other, or they have ``ALIKE`` of the longer one in common."""

    def alike(names: Column) -> Column:
        e, a = names["e"], names["a"]
        longer = F.greatest(F.length(e), F.length(a))
        return (e != "") & (a != "") & (holds(a, e) | ((longer - F.levenshtein(e, a)) / longer >= ALIKE))

    return let(F.struct(plain_name(expected).alias("e"), plain_name(actual).alias("a")), alike)


def plain_item(text: Column) -> Column:
    """An item's text in capitals without blanks and without a leading code; the letter O is a zero."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.upper(text), F.lit("O"), F.lit("0")), r"^[0-9]+\s+", ""), r"\s+", "")


def items_match(expected: Column, actual: Column) -> Column:
    return let(F.struct(plain_item(expected).alias("e"), plain_item(actual).alias("a")), lambda x: (x["e"] != "") & holds(x["a"], x["e"]))


def descriptions_match(expected: Column, actual: Column) -> Column:
    """The stricter test of golden files: capitals alone are made equal."""
    return (expected != "") & holds(F.upper(actual), F.upper(expected))


def categories_match(expected: Column, actual: Column, accounts: dict[str, str]) -> Column:
    """One name holds the other, or both stand for one account (a name without an account is its own)."""
    known = F.create_map(*[F.lit(x) for pair in accounts.items() for x in pair])
    account = lambda c: F.coalesce(F.try_element_at(known, c), c)
    return holds(F.upper(expected), F.upper(actual)) | (account(expected) == account(actual))


def prices_match(expected: Column, actual: Column) -> Column:
    """A printed price against cents."""
    return money.parse_lenient(expected) == actual


def details_match(key: Column, expected: Column, actual: Column) -> Column:
    """Plain names are equal; a region may be named or coded."""
    known = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    code = lambda c: F.coalesce(F.try_element_at(known, c), c)
    return let(F.struct(plain_name(expected).alias("e"), plain_name(actual).alias("a")), lambda x: (x["e"] == x["a"]) | ((key == "region") & (code(x["e"]) == code(x["a"]))))


def chain(merchant: Column) -> Column:
    """The chain that a merchant's name tells, else the name."""
    upper = F.upper(merchant)
    out = F.when(merchant == "", "(unknown)").otherwise(merchant)
    for needle, name in reversed(CHAINS):
        told = F.contains(upper, F.lit(needle))
        if name == "Bestco Fresh":
            told = told | (F.trim(upper) == "FRESH")
        out = F.when(told, name).otherwise(out)
    return out


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def percent(part: Column, whole: Column) -> Column:
    """100 where there is nothing to count."""
    return F.when(whole == 0, 100.0).otherwise(100.0 * part / F.nullif(whole, F.lit(0)))


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` characters, with an ellipsis where some are left out."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))
