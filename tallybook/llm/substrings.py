"""Substring dedup by relative Lempel-Ziv parsing against all reference blocks.

Reference blocks are cut by content: one block around each anchor (passages.py), the text that
the anchor's windows cover.  The index holds every block of every document (gram and block
hash), so each document is factored against the whole corpus, itself included:

1. a block that stands in the index more than once is copied as a whole, and its source is the
   block's first place in the index (its last one for that place itself);
2. at factor boundaries, where a block's gram is known but the block as a whole is not, its
   windows are checked one by one against the windows of the other blocks with that gram
   (one representative for each different block);
3. the parse goes through a document from left to right and makes the running factor longer as long
   as what follows is copied from the same source one word on; where it isn't, a factor ends and the next
   one begins.  Words inside factors of ``WINDOW`` words or more leave the text, the others are literals.

The result is exact: a word goes if and only if some window of ``WINDOW`` consecutive words of
its document covers it whose words also start elsewhere, in the same document or another.
Windows are judged on the input.  Comparisons are by pairs of 64-bit hashes.

Texts are dealt into stored chunks (chunks.py) and not shuffled; blocks, windows and copies are.

Defined results: null texts have no words; texts under ``WINDOW`` words keep all; repeated rows
are rows of their own, copies of each other that lose all their windows; an empty table gives no rows; a
text longer than a chunk is a chunk; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import passages, textkit
from tallybook.llm.chunks import ByRow, chunk_of, chunked
from tallybook.llm.shared import apart, stored

WINDOW, GRAM = 35, 8
FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,length:int,source:long,source_start:int>>"


def blocks(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """rid, h (gram), ctx (block), spot: first window, windows and anchor place, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passages.gather(batches):
            a = passages.Anchors(part.column(1), gram, window)
            spot = ((a.lo - a.base()) << 16) | ((a.hi - a.lo) << 8) | (a.at - a.lo)
            rid = part.column(0).to_numpy()[a.row]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(a.gram.view(np.int64)), pa.array(a.context().view(np.int64)), pa.array(spot)], ["rid", "h", "ctx", "spot"])

    return rows.select("rid", "text").mapInArrow(textkit.tidy(run), "rid long, h long, ctx long, spot long")


def copies(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """rid, start and end of words, source (rid) and source_start: what each row copies from elsewhere.
    ``rows`` are chunks."""
    if window - gram > 255:
        raise ValueError("window - gram must be under 256")
    known = stored(passages.repeated(blocks(rows, window, gram)).select("rid", "h", "ctx", "spot"), "blocks")
    place = F.struct("rid", "spot")
    index = known.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    source = F.when(place == F.col("first"), F.col("last")).otherwise(F.col("first"))
    full = known.join(apart(index.where("n > 1").select("h", "ctx", "first", "last"), "h", "ctx").hint("shuffle_merge"), ["h", "ctx"]).select("rid", "spot", source.alias("source"))
    begin, windows_of = F.expr("shiftright(spot, 16)"), F.expr("shiftright(spot, 8) & 255")
    full = full.select("rid", begin.alias("start"), (begin + windows_of + window).alias("end"), F.col("source.rid").alias("source"), F.expr("shiftright(source.spot, 16)").alias("source_start"))
    torn = index.groupBy("h").agg(F.count("*").alias("blocks"), F.min("n").alias("least")).where("blocks > 1 AND least = 1").select("h")
    edges = apart(index, "h").join(apart(torn, "h").hint("shuffle_merge"), "h").select(chunk_of(F.col("first.rid")).alias("chunk"), "first.rid", "first.spot", "h", (F.col("n") == 1).alias("alone"))

    def windows(docs: pa.Table, edges: pa.Table) -> pa.Table:
        mine, out = ByRow(edges), []
        spots, grams = mine.column("spot"), mine.column("h")
        alone = edges.column("alone").combine_chunks().to_numpy(zero_copy_only=False) if edges.num_rows else np.zeros(0, bool)
        for batch in docs.select(["rid", "text"]).to_batches() if edges.num_rows else []:
            for part in passages.gather([batch]):
                rids = part.column(0).to_numpy()
                owner, at = mine.of(rids)
                if not len(at):
                    continue
                words = textkit.Words(part.column(1))
                prefix = textkit.prefix_hash(words.hash)
                count = ((spots[at] >> 8) & 255) + 1
                start = textkit.ragged(spots[at] >> 16, count)
                doc = np.repeat(owner, count)
                first = start + words.row_at[doc]
                keys = textkit.range_hash(prefix, first, first + window)
                out.append(pa.table([pa.array(rids[doc]), pa.array(np.repeat(grams[at], count)), pa.array(keys.view(np.int64)), pa.array(start), pa.array(np.repeat(alone[at], count))], ["rid", "h", "w", "start", "alone"]))
        empty = pa.schema([("rid", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("start", pa.int64()), ("alone", pa.bool_())]).empty_table()
        return pa.concat_tables([empty, *out])

    checked = rows.groupBy("chunk").cogroup(edges.groupBy("chunk")).applyInArrow(windows, "rid long, h long, w long, start long, alone boolean")
    spot = F.struct("rid", "start")
    met = checked.groupBy("h", "w").agg(F.count("*").alias("n"), F.min(spot).alias("first"), F.max(spot).alias("last")).where("n > 1").select("h", "w", "first", "last")
    other = F.when(spot == F.col("first"), F.col("last")).otherwise(F.col("first"))
    partly = checked.where("alone").join(apart(met, "h", "w").hint("shuffle_merge"), ["h", "w"]).select("rid", "start", other.alias("source"))
    partly = partly.select("rid", "start", (F.col("start") + window).alias("end"), F.col("source.rid").alias("source"), F.col("source.start").alias("source_start"))
    return full.unionByName(partly)


def parsed(owner: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The factors of several documents from their copies: owner, start, length, source and source_start.
    Copies that go on in the same source at the same distance are one factor."""
    order = np.lexsort((start, source_start - start, source, owner))
    owner, start, end, source, distance = owner[order], start[order], end[order], source[order], (source_start - start)[order]
    if not len(owner):
        return owner, start, end, source, distance
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (source[1:] != source[:-1]) | (distance[1:] != distance[:-1])
    line = np.cumsum(fresh)
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(end + line * top)
    fresh[1:] |= start[1:] + line[1:] * top > reach[:-1]
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(owner)) - 1
    last = reach[tails] - line[tails] * top
    owner, start, length, source, distance = owner[heads], start[heads], last - start[heads], source[heads], distance[heads]
    order = np.lexsort((-length, start, owner))
    return owner[order], start[order], length[order], source[order], (start + distance)[order]


def remove_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, finish=None, schema: str = SCHEMA) -> DataFrame:
    """Every row with its words outside factors, joined by one space, and the factors."""
    rows = chunked(docs)
    found = copies(rows, window, gram).withColumn("chunk", chunk_of(F.col("rid")))
    then = finish or (lambda batch: batch)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        mine, out = ByRow(found), []
        columns = [mine.column(c) for c in ("start", "end", "source", "source_start")]
        for batch in docs.select(["rid", "doc_id", "text"]).to_batches():
            for part in passages.gather([batch]):
                owner, at = mine.of(part.column(0).to_numpy())
                owner, start, length, source, source_start = parsed(owner, *(c[at] for c in columns))
                words = textkit.Words(part.column(2), hashed=False)
                base = words.row_at[owner]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start + base, 1)
                np.add.at(change, start + length + base, -1)
                stays = np.cumsum(change)[:-1] == 0
                upto = np.zeros(len(words) + 1, np.int64)
                np.cumsum(~stays, out=upto[1:])
                removed = np.diff(upto[words.row_at])
                raw, kept = words.raw.tobytes(), []
                for a, b in zip(words.row_at[:-1], words.row_at[1:], strict=True):
                    here = np.flatnonzero(stays[a:b]) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[here].tolist(), words.end[here].tolist(), strict=True)]))
                factors = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(source), pa.array(source_start.astype(np.int32))], fields=list(FACTOR))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=part.num_rows))).astype(np.int32)), factors)
                out.append(then(pa.RecordBatch.from_arrays([part.column(1).cast(pa.int64()), pa.array(words.count.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), lists], ["doc_id", "n_words", "n_removed", "kept_text", "factors"])))
        textkit.trim()
        return pa.Table.from_batches(out)

    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(3).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"

ORACLE = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
f AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM d)),
p AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
k AS (SELECT p.doc_id, count(*) FILTER (f.p IS NOT NULL) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (f.p IS NULL) AS kept FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.p = p.i GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
