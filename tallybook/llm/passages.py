"""Repeated passages: the anchors that both passage operators index.

An anchor is a k-word gram that is the minimiser (smallest mixed hash, leftmost on ties) of at
least one window of ``window`` words.  Equal windows pick the same anchor at the same place,
so every repeated window shares an anchor, while only about 2 in ``window - gram + 2`` grams
are kept.  Anchors are computed on whole texts, one vectorised step of about a megabyte at a
time (a longer document is one step).

Rows are keyed by ``rid``, a 64-bit hash of doc_id and text, so repeated doc_ids with
different texts stay apart and repeated rows share one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import textkit
from tallybook.llm.shared import apart


def keyed(docs: DataFrame) -> DataFrame:
    """rid, doc_id and text of every row."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


class Anchors:
    """Anchors of one step: word index ``at``, first and last window start ``lo`` and ``hi`` that
    chose it, its row, and the gram hashes and prefix sums for further hashes."""

    def __init__(self, texts: pa.Array, gram: int, window: int):
        self.words = words = textkit.Words(texts)
        n, self.window = len(words), window
        self.prefix = textkit.prefix_hash(words.hash)
        if n < window:
            self.at = self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        first = np.arange(n - gram + 1)
        grams = textkit.range_hash(self.prefix, first, first + gram)
        bits = np.uint64(max(20, int(n).bit_length()))
        keys = (grams >> bits << bits) | first.astype(np.uint64)
        at = (textkit.windows_min(keys, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        row = np.repeat(np.arange(len(words.count)), words.count)
        start = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
        at = at[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
        self.at, self.lo, self.hi = at[heads], start[heads], start[tails]
        self.row = row[self.lo] if len(heads) else heads
        self.gram = grams[self.at]

    def base(self) -> np.ndarray:
        """Word index of each anchor's document."""
        return self.words.row_at[self.row]

    def context(self) -> np.ndarray:
        """Hash of the text that the anchor's windows cover, and of the anchor's place in it."""
        covered = textkit.range_hash(self.prefix, self.lo, self.hi + self.window)
        return textkit.mix64(covered + (self.at - self.lo).astype(np.uint64))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as sorted, disjoint, non-adjacent ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return start[heads], end[np.append(heads[1:], len(start)) - 1]


def repeated(anchors: DataFrame) -> DataFrame:
    """The anchors whose gram occurs more than once; counts combine before the shuffle, and
    the join back to the rows lets Spark split a hot gram."""
    again = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return anchors.join(apart(again, "h").hint("shuffle_merge"), "h")


def gather(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from textkit.steps(batch, text)
