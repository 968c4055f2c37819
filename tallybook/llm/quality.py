"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

The contract's counts are computed for every row.  Documents that pass the base limits go
through the rules of ``RULES``: on a bounded sample each rule's cost (time over the sample)
and rejections are measured, rules are ordered by rejections per cost, and the verdict
evaluates them in that order, each only where all before it passed (nested CASE WHEN).  The
order changes the work, never the verdict, since a document is kept when no rule rejects it.

Defined results: a null text has no words, so it fails the base limit; an empty table gives no rows; extra
columns are ignored; repeated rows are judged each by itself; a very long text is judged whole.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.textkit import WHITE, only

#: Expected rows of the sample that orders the rules.
SAMPLE_ROWS = 2_000
#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Times that a rule is evaluated on each sampled row, so that its cost stands out from a job's.
TIMES = 10


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; Catalyst cannot copy it into lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(F.lit(3), b - a))
        return F.lit(3) + F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def exact(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        marked = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        places = let(pairs, lambda s: F.sort_array(F.transform(marked(s), lambda x: x["i"])))
        return let(places, lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(0))

    def counted(w: Column) -> Column:
        keys = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(keys, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(counted(w)))


def symbol_count(text: Column) -> Column:
    rest = text
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and the contract's counts, each computed once."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    row = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = only(docs, "doc_id", "text").select("doc_id", "text", row.alias("c"), symbol_count(text).cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"))
    n, again = F.col("c.n_words"), F.col("c.n_repeat_words")
    return out.select("doc_id", "text", n.alias("n_words"), F.col("c.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", again.alias("n_repeat_words"), ((n < MIN_WORDS) | (100 * again > REPEAT_PERCENT * n)).alias("base_failed"))


def rules() -> dict[str, Column]:
    """Each rule rejects where its condition holds; integers only, so that SQL agrees exactly."""
    text = F.coalesce("text", F.lit(""))
    upper = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    digits = F.length(F.regexp_replace(text, r"[^0-9]+", ""))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]")))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
        "duplicate_lines": (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * lines),
        "shouting": 10 * upper > 3 * F.col("word_chars"),
        "digits": 5 * digits > F.col("word_chars"),
    }


def rule_order(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per cost on a sample of about ``rows`` documents, best first.

    The sample is drawn from the raw rows and counted once.  A rule's cost is what evaluating it ``TIMES`` over
    takes longer than a rule that reads nothing does, the least of three runs each."""
    share = min(1.0, rows / max(docs.select("doc_id").count(), 1))
    drawn = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(1_000_003 * share) + 1)
    sample = base_columns(drawn).persist()
    again = F.sequence(F.lit(1), F.lit(TIMES))
    turn = F.col("turn")

    def timed(rejects: Column) -> tuple[float, int]:
        # the number of the turn stands in the text, so that no turn is taken from the one before
        turns = sample.where(~F.col("base_failed")).withColumn("turn", F.explode(again)).withColumn("text", F.concat("text", F.substring(turn.cast("string"), 1, 0)))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            hits = turns.agg(F.sum(F.coalesce(rejects, F.lit(False)).cast("int"))).first()[0] or 0
            took.append(time.perf_counter() - began)
        return min(took), hits

    try:
        sample.count()
        idle, _ = timed(turn < 0)
        costs = {name: timed(rejects) for name, rejects in rules().items()}
    finally:
        sample.unpersist()
    return sorted(costs, key=lambda name: -costs[name][1] / max(costs[name][0] - idle, 1e-3))


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The contract's columns and ``kept``, with ``rejected_by`` naming the first rule that fired."""
    counted = base_columns(docs)
    known = rules()
    verdict = F.lit(None).cast("string")
    for name in reversed(order or rule_order(docs)):
        verdict = F.when(known[name], F.lit(name)).otherwise(verdict)
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict)
    return counted.withColumn("rejected_by", verdict).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, text, words, lines,
         [ {{'t': [words[i], words[i + 1], words[i + 2]], 'i': i}} for i in range(1, len(words) - 1) ] AS grams
  FROM w),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, u.i AS i, count(*) OVER (PARTITION BY doc_id, u.t) AS c FROM (SELECT doc_id, unnest(grams) AS u FROM g))
    WHERE c > 1) GROUP BY doc_id),
b AS (
  SELECT g.doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM g LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digit_chars
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * upper_chars > 3 * word_chars OR 5 * digit_chars > word_chars) AS kept
FROM f
"""
