"""Documents dealt into chunks that later steps come back to without shuffling a text.

A chunk is about ``CHUNK_BYTES`` of text from one task's rows, one document at least.  Chunks are stored
once, in buckets by chunk, so that grouping them or meeting them with rows keyed by chunk needs no
exchange of the texts: only what a step found about them moves.

Every row has an id of its own (``rid``), whatever its doc_id; ``chunk_of`` tells the chunk from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import textkit
from tallybook.llm.shared import release, shared_folder

#: Bytes of text in one chunk (one document at least).
CHUNK_BYTES = 8 << 20
#: Bits of an id that number the rows of a chunk, and the chunks of a task.
ROW_BITS, CHUNK_BITS = 26, 16


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, rid, doc_id and text of every row, stored in buckets by chunk."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, rows = TaskContext.get().partitionId() << CHUNK_BITS, 0, 0
        for batch in batches:
            for part in textkit.steps(batch, "text"):
                size = int(np.diff(textkit.offsets_of(part.column(1))[[0, -1]])[0])
                if held and held + size > chunk_bytes:
                    chunk, held, rows = chunk + 1, 0, 0
                rid = (chunk << ROW_BITS) + np.arange(rows, rows + part.num_rows)
                held, rows = held + max(size, 1), rows + part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, chunk)), pa.array(rid), part.column(0).cast(pa.int64()), part.column(1)], ["chunk", "rid", "doc_id", "text"])

    name = f"chunks_{uuid.uuid4().hex}"
    dealt = docs.select("doc_id", "text").mapInArrow(textkit.tidy(run), "chunk long, rid long, doc_id long, text string")
    dealt.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(textkit.shuffle_partitions(spark), "chunk").saveAsTable(name)
    release(spark)
    return spark.table(name)


def chunk_of(rid: Column) -> Column:
    return F.shiftright(rid, ROW_BITS)


class ByRow:
    """Rows found about the documents of one chunk, sorted by ``rid``."""

    def __init__(self, found: pa.Table):
        rid = found.column("rid").to_numpy() if found.num_rows else np.zeros(0, np.int64)
        self.order = np.argsort(rid, kind="stable")
        self.rid, self.found = rid[self.order], found

    def of(self, rids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the documents ``rids``: the owner (place in ``rids``) and the place in the table of each row."""
        low, high = np.searchsorted(self.rid, rids, "left"), np.searchsorted(self.rid, rids, "right")
        return np.repeat(np.arange(len(rids)), high - low), self.order[textkit.ragged(low, high - low)]

    def column(self, name: str) -> np.ndarray:
        return self.found.column(name).to_numpy() if self.found.num_rows else np.zeros(0, np.int64)
