"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: one from the words that mark toxic
documents (document frequency far above that in ordinary ones), one from ordinary words.  A
text's windows are its words; each is written with ``SPREAD`` bytes per byte, so that a
dictionary match is worth much more than literals, and compressed with both dictionaries.  A
window's gain is how much shorter the toxic dictionary makes it.  Counts of windows above
several gains and the largest gains, calibrated by a logistic fit on other labelled rows, give
the score; 0.5 is the threshold.

Learning uses a bounded sample of labelled rows (``FIT_ROWS`` of each class in expectation, by a
hash of the id); what reaches the driver are at most ``TOXIC_WORDS`` + ``ORDINARY_WORDS`` words
and one row of figures for each calibration text.  A score sees the text alone.

Defined results: null and wordless texts have no windows and get the score of zero gains;
without labels of both classes every score is 0; doc_ids labelled twice count as toxic if any
label says so; repeated rows are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import textkit

#: Labelled rows of each class that are learned from, in expectation.
FIT_ROWS = 5_000
TOXIC_WORDS, ORDINARY_WORDS = 3_000, 20_000
#: Least z of a toxic word's document frequency, most z of an ordinary word's.
MARKED_Z, PLAIN_Z = 3.3, 1.0
SPREAD, LEVEL = 3, 9
#: Gains (bytes) above which windows are counted.
STEPS = (4, 6, 8, 10, 12, 14, 16)
#: Distinct words that a worker remembers before it starts anew.
MEMO = 300_000
WORD = r"[^\W_]+"


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def spread(word: str) -> bytes:
    """A word between two marks, each byte written as three that depend on it alone."""
    b = np.frombuffer(b"\x01" + word.encode() + b"\x02", np.uint8)
    return np.stack([b, b ^ 0x55, (b * 7) ^ 0x33], 1).tobytes()


class Gains:
    """Compression gains of words under a model's two dictionaries, remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.both = [self._compressor(x) for x in (toxic, ordinary)]
        self.find, self.memo = regex.compile(WORD).findall, {}

    @staticmethod
    def _compressor(content: bytes):
        import zstandard as zs

        held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        how = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
        held.precompute_compress(compression_params=how)
        return zs.ZstdCompressor(dict_data=held, compression_params=how)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: counts above each step (log), their shares, the three largest gains."""
        cut = [self.find(t.lower()) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        new = list({w for words in cut for w in words if w not in self.memo})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            windows = [spread(w) for w in part]
            a, b = (c.multi_compress_to_buffer(windows) for c in self.both)
            self.memo.update((w, len(b[i]) - len(a[i])) for i, w in enumerate(part))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        out = np.zeros((len(cut), 2 * len(STEPS) + 3))
        full = np.flatnonzero(counts)
        if len(full):
            get = self.memo.__getitem__
            g = np.fromiter((get(w) for words in cut for w in words), np.int64, int(counts.sum()))
            starts = (np.cumsum(counts) - counts)[full]
            for k, step in enumerate(STEPS):
                n = np.add.reduceat((g >= step).astype(np.int64), starts)
                out[full, k] = np.log1p(n)
                out[full, len(STEPS) + k] = n / counts[full]
            packed = g * (len(g) + 1) + np.arange(len(g))
            for k in range(3):
                top = np.maximum.reduceat(packed, starts)
                out[full, 2 * len(STEPS) + k] = np.where(counts[full] > k, np.maximum(top // (len(g) + 1), 0), 0)
                packed[top % (len(g) + 1)] = -(10**15)
        return out


def _features(docs: DataFrame, toxic: bytes, ordinary: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(toxic, ordinary)
        for batch in batches:
            for part in textkit.steps(batch, "text"):
                rows = gains.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["toxic", "x"])

    return docs.select("toxic", "text").mapInArrow(textkit.tidy(run), "toxic int, x array<double>")


def training_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic, part: a bounded, hash-chosen sample of the labels that may be learned from."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(textkit.crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    bound = F.lit(0)
    for kind, n in sizes.items():
        bound = F.when(F.col("toxic") == kind, int(1_000_003 * min(1.0, rows / n)) + 1).otherwise(bound)
    spread_by = F.xxhash64("doc_id")
    return usable.where(F.pmod(spread_by, F.lit(1_000_003)) < bound).withColumn("part", F.pmod(F.shiftright(spread_by, 40), F.lit(5)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Learn from (doc_id, text) and (doc_id, toxic)."""
    chosen = training_labels(labels, rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "part").persist()
    try:
        learn, check = known.where("part < 3"), known.where("part >= 3")
        sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
        if not sizes.get(0) or not sizes.get(1):
            return None
        words = learn.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))).alias("w"))
        seen = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
        share_t, share_o, share = F.col("t") / sizes[1], F.col("o") / sizes[0], (F.col("t") + F.col("o")) / (sizes[0] + sizes[1])
        z = (share_t - share_o) / F.sqrt(F.greatest(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]), F.lit(1e-9)))
        seen = seen.withColumn("z", z).persist()
        marked = [r["w"] for r in seen.where(f"z > {MARKED_Z} AND t >= 3 AND length(w) >= 3").orderBy(F.desc("z"), "w").limit(TOXIC_WORDS).collect()]
        plain = [r["w"] for r in seen.where(f"z < {PLAIN_Z} AND o > 0").orderBy(F.desc("o"), "w").limit(ORDINARY_WORDS).collect()]
        seen.unpersist()
        if not marked or not plain:
            return None
        toxic, ordinary = (b"".join(spread(w) for w in reversed(x)) for x in (marked, plain))
        if min(len(toxic), len(ordinary)) < 8:
            return None
        got = _features(check, toxic, ordinary).toArrow()
    finally:
        known.unpersist()
    y = got.column(0).to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array(got.column(1).to_pylist(), float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    weights = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -30, 30)))
        bend = a.T @ (a * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(weights))
        weights -= np.linalg.solve(bend, a.T @ (p - y) + 0.1 * weights)
    return Model(toxic, ordinary, mean, scale, weights)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gains = Gains(m.toxic, m.ordinary)
        for batch in batches:
            for part in textkit.steps(batch, "text"):
                x = (gains.features(part.column(1).to_pylist()) - m.mean) / m.scale
                p = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(textkit.tidy(run), "doc_id long, score double, predicted int")
