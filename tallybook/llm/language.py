"""Language identification by word-first backoff.

A word (a letter and the letters and marks after it, lower-cased) that the model knows is scored by its log frequency
per language.  An unseen word falls back to character n-grams: the longest known suffix of
context predicts each next character (``ORDERS`` down to single letters), every step to a
shorter n-gram costing ``BACKOFF``.  A document's score is the posterior of its best language
from the mean score of its words, tempered by ``EVIDENCE`` words at most.

The model is arrays sorted by 64-bit hash of word or n-gram; texts are cut, hashed and looked up a
step of about a megabyte at a time, each distinct word of a step once.

Defined results: null, empty and letterless texts give ``und`` with score 0; ties go to the
alphabetically first language; with nothing to learn from, every document is ``und``; an empty table
gives no rows; repeated rows are each predicted by themselves; a very long text is one step; extra
columns are neither read nor returned unless asked for.
Learning uses a bounded sample of labelled rows (``FIT_ROWS`` expected, chosen by a hash of the
row's text and label, never by table order) and keeps every word and n-gram of it; predictions see
the text alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.llm import textkit

#: Labelled rows that the classifier is fitted on, in expectation.
FIT_ROWS = 8_000
#: Character n-gram lengths, longest first.
ORDERS = (5, 4, 3, 2, 1)
BACKOFF = 0.4
EVIDENCE = 40
#: Unseen words whose scores a worker remembers before it starts anew.
MEMO = 200_000
LETTERS = r"\p{L}[\p{L}\p{M}]*"


@dataclass
class Model:
    """Hashes of known words and n-grams, sorted, with a row of log scores each."""

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray
    floor: np.ndarray


NOTHING = Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))


@cache
def _letters() -> np.ndarray:
    """1 for letters, 2 for marks, 0 for all other code points."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{M}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _points(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, one after the other, and where each row ends."""
    return np.frombuffer("".join(rows).encode("utf-32-le", "replace"), "<u4"), np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))


def _prefix(points: np.ndarray) -> np.ndarray:
    return textkit.prefix_hash(points.astype(np.uint64) + np.uint64(1))


def _hashes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole strings, and of each without its last character."""
    points, ends = _points(strings)
    starts, prefix = np.append(0, ends[:-1]) if len(ends) else ends, _prefix(points)
    return textkit.range_hash(prefix, starts, ends), textkit.range_hash(prefix, starts, np.maximum(ends - 1, starts))


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from (text, lang).  What reaches the driver are the counts of words and n-grams of the sample."""
    labelled = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    total = labelled.count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003)) < int(1_000_003 * rows / total) + 1)
    words = labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("w")).groupBy("w", "lang").agg(F.count("*").alias("n")).persist()
    try:
        languages = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
        if not languages:
            return NOTHING

        def counts(df: DataFrame, key: str) -> tuple[list[str], np.ndarray]:
            pivot = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(languages)]
            got = df.groupBy(key).agg(*pivot).toArrow()
            return got.column(0).to_pylist(), np.stack([c.to_numpy() for c in got.columns[1:]], 1).astype(np.float64)

        known, n = counts(words, "w")
        order = np.argsort(hashes := _hashes(known)[0])
        hashes, n = hashes[order], n[order]
        word_scores = np.log((n + 0.05) / (n.sum(0) + 1)).astype(np.float32)
        padded = F.concat(F.lit("<"), F.col("w"), F.lit(">"))
        cut = lambda k: F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, F.lit(k)))
        cuts = [F.when(F.length(padded) >= k, cut(k)).otherwise(F.array()) for k in ORDERS]
        grams, n = counts(words.select("lang", "n", F.explode(F.concat(*cuts)).alias("g")), "g")
    finally:
        words.unpersist()
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    keys, heads = _hashes(grams)
    order = np.argsort(keys)
    size, keys, heads, n = size[order], keys[order], heads[order], n[order]
    at = _found(keys, heads)
    context = np.where((at >= 0)[:, None], n[at], n)
    context[size == 1] = n[size == 1].sum(0)
    gram_scores = np.log((n + 0.05) / (np.maximum(context, n) + 1)).astype(np.float32)
    floor = np.log(0.05 / (n[size == 1].sum(0) + 1))
    return Model(languages, hashes, word_scores, keys, gram_scores, floor)


def unseen(model: Model, words: list[str]) -> np.ndarray:
    """Scores of words that the model doesn't know, from progressively shorter n-grams."""
    points, ends = _points([f"<{w}>" for w in words])
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    prefix = _prefix(points)
    sizes = ends - starts - 1
    end = textkit.ragged(starts + 2, sizes)
    begin = np.repeat(starts, sizes)
    scores = np.tile(model.floor + len(ORDERS) * np.log(BACKOFF), (len(end), 1))
    open_ = np.arange(len(end))
    for step, k in enumerate(ORDERS):
        fits = open_[end[open_] - begin[open_] >= k]
        at = _found(model.grams, textkit.range_hash(prefix, end[fits] - k, end[fits]))
        hit = at >= 0
        scores[fits[hit]] = model.gram_scores[at[hit]] + step * np.log(BACKOFF)
        left = np.ones(len(end), bool)
        left[fits[hit]] = False
        open_ = open_[left[open_]]
    return np.add.reduceat(scores, np.cumsum(sizes) - sizes, axis=0) if len(words) else np.zeros((0, len(model.languages)))


class Scorer:
    """Scores of words under a model; those of unseen words are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.memo, self.memo_scores = np.zeros(0, np.uint64), np.zeros((0, len(self.model.languages)))

    def texts(self, rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and the mean of their scores."""
        lowered = [t.lower() if t else "" for t in rows]
        points, ends = _points(lowered)
        start, end = self._words(points, ends)
        counts = np.diff(np.searchsorted(start, np.append(0, ends)))
        mean = np.zeros((len(rows), len(self.model.languages)))
        if len(start):
            keys, first, back = np.unique(textkit.range_hash(_prefix(points), start, end), return_index=True, return_inverse=True)
            scores = self._scores(keys, lambda which: [points[start[i] : end[i]].tobytes().decode("utf-32-le") for i in first[which].tolist()])
            full = np.flatnonzero(counts)
            mean[full] = np.add.reduceat(scores[back], (np.cumsum(counts) - counts)[full], axis=0) / counts[full, None]
        return counts, mean

    @staticmethod
    def _words(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of words: runs of letters and marks, from the first letter on."""
        n = len(points)
        kind = _letters()[points] if n else np.zeros(0, np.uint8)
        word = kind > 0
        opens = np.zeros(n + 1, bool)
        opens[np.append(0, ends)] = True
        runs = np.flatnonzero(word & (opens[:n] | ~np.append(False, word[:-1])))
        stops = np.flatnonzero(word & (opens[1:] | ~np.append(word[1:], False))) + 1
        letters = np.append(np.flatnonzero(kind == 1), n)
        start = letters[np.searchsorted(letters, runs)]
        real = start < stops
        return start[real], stops[real]

    def _scores(self, keys: np.ndarray, spell) -> np.ndarray:
        m = self.model
        at = _found(m.words, keys)
        out = np.empty((len(keys), len(m.languages)))
        out[at >= 0] = m.word_scores[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        if len(self.memo) > MEMO:
            self._forget()
        at = _found(self.memo, keys[rest])
        out[rest[at >= 0]] = self.memo_scores[at[at >= 0]]
        rest = rest[at < 0]
        if len(rest):
            out[rest] = unseen(m, spell(rest))
            memo, scores = np.concatenate([self.memo, keys[rest]]), np.concatenate([self.memo_scores, out[rest]])
            order = np.argsort(memo, kind="stable")
            self.memo, self.memo_scores = memo[order], scores[order]
        return out


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the columns in ``keep`` and two ``added`` ones, the prediction and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys(("text", *keep)))
    kinds = {f.name: f for f in docs.schema.fields}
    docs = docs.select(*textkit.quoted(names)).toDF("text", *[f"c{i}" for i in range(1, len(names))])
    schema = StructType([kinds[n] for n in keep]).add(added[0], "string").add(added[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, labels = Scorer(m), np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part in textkit.steps(batch, "text"):
                if m.languages:
                    counts, mean = scorer.texts(part.column(0).to_pylist())
                    scores = mean * np.minimum(counts[:, None], EVIDENCE)
                else:
                    counts, scores = np.zeros(part.num_rows, np.int64), np.zeros((part.num_rows, 1))
                top = np.exp(scores - scores.max(1, keepdims=True))
                share = np.where(counts > 0, top.max(1) / top.sum(1), 0.0)
                label = labels[np.where(counts > 0, scores.argmax(1), len(m.languages))]
                yield pa.RecordBatch.from_arrays([part.column(names.index(n)) for n in keep] + [pa.array(label.tolist(), pa.string()), pa.array(share)], [*keep, *added])

    return docs.mapInArrow(textkit.tidy(run), schema)


def training_rows(docs: DataFrame) -> Column:
    """Rows to learn from: the fold number of the id (modulo 4) is not 2."""
    return textkit.crc_mod("doc_id", 4) != 2
