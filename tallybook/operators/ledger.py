"""Double-entry text from receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import money


def escaped(text: Column) -> Column:
    """Text for a quoted string: quotes become apostrophes, backslashes double, breaks become blanks."""
    return F.regexp_replace(F.replace(F.translate(text, '"', "'"), F.lit("\\"), F.lit("\\\\")), r"[\r\n\x0B\x0C\x85  ]", " ")


#: Accounts that wait for a tender of a kind, and for any other (fixed values).
PENDING = {"gift_card": "Assets:GiftCards:PENDING", "cash": "Assets:Cash:PENDING", "store_credit": "Assets:StoreCredit:PENDING"}
PENDING_OTHER = "Liabilities:CreditCard:PENDING"


def pending_account(kind: Column) -> Column:
    """The account that a tender of this kind is booked on until it is settled."""
    out = F.lit(PENDING_OTHER)
    for name, account in PENDING.items():
        out = F.when(kind == name, account).otherwise(out)
    return out


def comment_text(text: Column) -> Column:
    """Text for a comment, which ends where the line does: breaks become blanks."""
    return F.regexp_replace(text, "[\\r\\n\\x0B\\x0C\\x85\u2028\u2029]", " ")


def in_ledger_text(kind: Column) -> Column:
    """Whether a warning is written into the ledger: all but the one that its posting tells already."""
    return kind != "uncategorized_item"


def card_digits(text: Column) -> Column:
    """The last four digits of the first masked card number: two stars or more, blanks, four digits and no fifth."""
    return F.nullif(F.regexp_extract(text, r"\*{2,}\s*([0-9]{4})(?![0-9])", 1), F.lit(""))


def aligned_postings(postings: DataFrame, key: str) -> DataFrame:
    """Lines with account and amount padded to the widest of their receipt."""
    w = Window.partitionBy(key)
    rows = postings.withColumn("_a", money.text(F.col("amount")))
    rows = rows.withColumn("_wide", F.max(F.length("account")).over(w)).withColumn("_tall", F.max(F.length("_a")).over(w))
    return rows.withColumn("line", F.concat(F.lit("  "), F.rpad("account", F.col("_wide"), F.lit(" ")), F.lit("  "), F.lpad("_a", F.col("_tall"), F.lit(" ")), F.lit(" CAD"))).drop("_a", "_wide", "_tall")


def sha_token(digest: Column) -> Column:
    """First eight hex digits of a digest, if it is one."""
    return F.when(F.lower(digest).rlike("^[0-9a-f]{64}$"), F.substring(F.lower(digest), 1, 8))


def slug(name: Column) -> Column:
    """Lower case words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ledger_id(day: Column, token: Column) -> Column:
    """Compact date and token."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), token)


def ledger_text(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """One text per receipt: header line and its aligned postings in order."""
    body = lines.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))
    head = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(' * "'), escaped(F.col("merchant")), F.lit('"'))
    return receipts.join(body, "receipt_id").select("receipt_id", F.concat_ws("\n", F.concat(F.array(head), F.transform("l", lambda x: x["line"]))).alias("ledger"))


def corrected(receipts: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sparse edits over receipts: a null leaves the old value alone; which columns changed is noted."""
    new = corrections.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    met = receipts.join(new, key, "left")
    changed = F.array_compact(F.array(*[F.when(F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns]))
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in receipts.columns], F.array_join(changed, ",").alias("changed"))


def with_warnings(postings: DataFrame, warnings: DataFrame) -> DataFrame:
    """postings (receipt_id, seq, line) and warnings (receipt_id, seq, message) as one ordered text: a
    warning stands after its posting as a comment, several in order of message."""
    lines = postings.select("receipt_id", "seq", F.lit(0).alias("k"), "line")
    notes = warnings.select("receipt_id", "seq", F.lit(1).alias("k"), F.concat(F.lit("  ; "), "message").alias("line"))
    every = lines.unionByName(notes).groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("seq", "k", "line"))).alias("l"))
    return every.select("receipt_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def file_name(day: Column, placeholder: Column, merchant: Column) -> Column:
    """Date (or ``unknown-date``) and slug."""
    name = F.coalesce(F.nullif(slug(merchant), F.lit("")), F.lit("unknown"))
    return F.concat(F.when(placeholder | day.isNull(), F.lit("unknown-date")).otherwise(F.date_format(day, "yyyy-MM-dd")), F.lit("-"), name, F.lit(".txt"))


def document_path(day: Column, merchant: Column, token: Column) -> Column:
    """Year folder, then date, slug and token."""
    return F.concat(F.date_format(day, "yyyy"), F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit("-"), slug(merchant), F.lit("-"), token)


def refreshed(old: DataFrame, new: DataFrame, kept_kinds: list[str]) -> DataFrame:
    """Warnings after an edit: old ones of kinds that an edit cannot falsify, and those computed anew."""
    return old.where(F.col("kind").isin(kept_kinds)).unionByName(new.where(~F.col("kind").isin(kept_kinds))).distinct()
