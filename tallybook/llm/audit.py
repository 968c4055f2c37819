"""Filter interaction audit: what each of five filters removes, in each of the 120 orders they may stand in.

Filters fail a text (null: empty; words are maximal runs outside white space) for: A, under ``MIN_WORDS``
words; B, too few distinct words; C, too many capitals; D, one of ``SIGNS``; E, being identical to the
text of a smaller doc_id.

E is found by sorting.  Rows are range-partitioned by the text's fingerprint, doc_id and the row's number,
so that a group of copies of any size spreads over partitions, and sorted there by fingerprint, full
text and doc_id.  One pass compares each row with its predecessor.  Texts that may have started in the partition
before (those with its first fingerprint) are named by their digest; each partition ends with the least
doc_id of the texts of its last fingerprint, and both meet afterwards.  Texts cross the network once; from
there on a row is its doc_id, part and failure mask.

Masks add up: ``counters`` holds the documents, and the good and toxic ones, of each part and mask, whatever
number of orders is asked for.  ``report`` reads all orders off the 32 masks.

Only two tables are broadcast: the edges, one row for each sorted partition (one more for each other text of
the same 64-bit fingerprint), and the fixed table of 32 masks by 120 orders by 5 steps.

Defined results: a null text is empty, and a null source the empty string, as its own part with real empty
ones; a null doc_id is no smaller nor larger than another, so its row never fails E nor fails others, and it has
no label; repeated rows count each, and equal doc_ids with one text don't fail each other; a document has a label if
any of its label rows says so; very long texts are judged whole; ties cannot arise; an empty table gives no
rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import textkit
from tallybook.llm.quality import let, words_of
from tallybook.llm.shared import stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "#$%&*|"
#: The bit of the filter that ``marked`` decides.
COPY = 1 << FILTERS.index("E")
MARKED = "doc_id long, part string, mask int, head binary, tail binary"
ROLES = "mask int, filter_order string, step int, kept int, removed int, redundant int, unique_fails int, weight int"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text alone."""
    wordy = let(words_of(text), lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w), 2).otherwise(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (wordy + F.when(100 * capitals > CAPITAL_PERCENT * F.length(text), 4).otherwise(0) + F.when(text.rlike(f"[{SIGNS}]"), 8).otherwise(0)).cast("int")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, part, mask, fp, text) to rows of MARKED: the mask says whether a smaller doc_id
    of the same partition has the text; ``head`` is the digest of a text that may have begun before it.  The last
    rows, with ``tail``, are the texts that may go on after it, with their least doc_id here."""
    first = fp = None
    runs: list[list] = []  # of this fingerprint: text, least doc_id, digest if it may have begun before
    for batch in batches:
        ids, masks, prints, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
        heads: list[bytes | None] = []
        for k, (own, mine) in enumerate(zip(ids, prints, strict=True)):
            text = texts[k].as_buffer()
            if mine != fp:
                first, fp, runs = mine if fp is None else first, mine, []
            if not runs or not runs[-1][0].equals(text):
                runs.append([text, None, hashlib.sha256(text).digest() if fp == first else None])
            least = runs[-1][1]
            if own is not None and least is not None and least < own:
                masks[k] |= COPY
            heads.append(None if masks[k] & COPY else runs[-1][2])
            if least is None:
                runs[-1][1] = own
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(heads, pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "part", "mask", "head", "tail"])
    rows = [(least, hashlib.sha256(text).digest()) for text, least, _ in runs if least is not None]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["doc_id", "part", "mask", "head", "tail"])


def masks(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, part and failure mask of every row of ``docs`` (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), "fp", "doc_id", "row").sortWithinPartitions("fp", "text", "doc_id")
    judged = dealt.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), "fp", F.col("text").cast("binary").alias("text"))
    marked = stored(judged.mapInArrow(textkit.tidy(_copies), MARKED), "masks")
    edges = marked.where("tail IS NOT NULL").groupBy(F.col("tail").alias("head")).agg(F.min("doc_id").alias("least"))
    found = marked.where("tail IS NULL").join(F.broadcast(edges), "head", "left")
    return found.select("doc_id", "part", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")).alias("mask"))


def counters(docs: DataFrame, labels: DataFrame, partitions: int | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents of each failure mask, all and by label."""
    said = labels.groupBy("doc_id").agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "is_good"), ("toxic", "is_toxic"))))
    found = masks(docs, partitions).join(said, "doc_id", "left")
    return found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("is_good", F.lit(0))).alias("good"), F.sum(F.coalesce("is_toxic", F.lit(0))).alias("toxic"))


def roles(spark: SparkSession) -> DataFrame:
    """What happens at each step of each order to a document of each mask.  ``weight`` is in how many orders
    the step's filter is the one that removes it."""
    rows = []
    for mask in range(1 << len(FILTERS)):
        for order in permutations(FILTERS):
            gone = 0
            for step, name in enumerate(order, 1):
                bit = 1 << FILTERS.index(name)
                fails, before = bool(mask & bit), bool(mask & gone)
                gone |= bit
                rows.append((mask, "".join(order), step, int(not mask & gone), int(fails and not before), int(fails and before), int(mask == bit), 120 // mask.bit_count() if fails else 0))
    return spark.createDataFrame(rows, ROLES)


def report(counted: DataFrame) -> DataFrame:
    """The contract's counts for each part, order and step, from ``counters``."""
    met = counted.join(F.broadcast(roles(counted.sparkSession)), "mask")
    sums = {"kept": "n * kept", "removed": "n * removed", "redundant": "n * redundant", "unique_fails": "n * unique_fails", "good_lost": "good * removed", "toxic_lost": "toxic * removed", "shapley": "n * weight"}
    return met.groupBy("part", "filter_order", "step").agg(*(F.sum(F.expr(x)).alias(name) for name, x in sums.items()))


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t))::INT
         + 8 * regexp_matches(t, '[{SIGNS}]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS name, (1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1)) AS bit,
         coalesce(list_sum([ 1 << (strpos('ABCDE', substr(filter_order, i, 1)) - 1) for i in range(1, step) ]), 0)::BIGINT AS gone
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, name,
         sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, name)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, name)::BIGINT AS shapley FROM r
"""
