"""Suffix-array dedup over sparse suffixes.

Suffixes are kept only at minimiser positions (passages.py, windows of ``INNER`` words).  Those
whose first ``GRAM`` words occur more than once are sorted twice, as one range-partitioned
sort: by the words that follow, and by the words that precede, read backwards.  Neighbours in
either order are compared word by word, which gives for each suffix the longest match to its
right (R words, the suffix's own start included) and to its left (L words) with any other
suffix.  A suffix with L + R >= ``LEAST`` yields the span [at - L, at + R).

Every passage of ``LEAST`` words or more that stands in two places is covered whole: it holds a
suffix within its first words whose R reaches 50 words or the passage's end, and the rest by
the later suffixes, since sort neighbours share at least as much as any other pair does.  L and
R of one span may come from different partners; each side then is a true repeat by itself.

Ties in the sort are broken by row and place, so that one passage in very many documents is
dealt over as many tasks as it fills.  The first and last suffix of each task are compared
once more among themselves.

Defined results: texts under ``INNER`` words and null texts have no suffixes; a null doc_id is a doc_id of its own; documents without spans give no row; repeated rows (equal doc_id and text) are repeats of each other and share one result
row, and any number of them costs what two do; a very long text is cut whole; ties in the order of suffixes go by row and place; an
empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import passages, textkit
from tallybook.llm.shared import stored

LEAST, INNER, GRAM = 50, 33, 8
SCHEMA = "doc_id long, n_words long, n_duplicate_words long, spans array<struct<start:int,end:int>>"


def anchors(docs: DataFrame, inner: int = INNER, gram: int = GRAM) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passages.gather(batches):
            a = passages.Anchors(part.column(1), gram, inner)
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[a.row]), pa.array(a.gram.view(np.int64)), pa.array((a.at - a.base()).astype(np.int32))], ["rid", "h", "at"])

    return passages.keyed(docs).select("rid", "text").mapInArrow(textkit.tidy(run), "rid long, h long, at int")


def repeated_spans(docs: DataFrame, least: int = LEAST, inner: int = INNER, gram: int = GRAM) -> DataFrame:
    """doc_id, its words, words inside repeats, and the spans of repeats in words."""
    if least - inner < gram:
        raise ValueError("least must be at least inner + gram")
    known = stored(passages.repeated(anchors(docs, inner, gram)).groupBy("rid").agg(F.collect_set(F.struct("h", "at")).alias("found")), "anchors")
    whole = passages.keyed(docs).repartition("rid")
    right, left = least - gram, inner - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passages.gather(_two_of_each(batches)):
            words = textkit.Words(part.column(2))
            small = (words.hash >> np.uint64(32)).astype(">u4")
            found = part.column(3)
            owner = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
            h = found.flatten().field(0).to_numpy().astype(">i8")
            at = found.flatten().field(1).to_numpy()
            here, low, high = at + words.row_at[owner], words.row_at[owner], words.row_at[owner + 1]
            ahead = np.minimum(high - here - gram, right)
            behind = np.minimum(here - low, left)
            after = small[textkit.ragged(here + gram, ahead)]
            before = small[np.repeat(here - 1, behind) - textkit.ragged(np.zeros(len(here), np.int64), behind)]
            keys = []
            for side, words_of, sizes in ((b"\x01", after, ahead), (b"\x00", before, behind)):
                data, ends = words_of.tobytes(), np.cumsum(sizes) * 4
                keys += [side + h[i].tobytes() + data[e - 4 * s : e] for i, (e, s) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True))]
            twice = np.concatenate([owner, owner])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0).take(pa.array(twice)), part.column(1).take(pa.array(twice)), pa.array(words.count[twice]), pa.array(np.concatenate([at, at]).astype(np.int32))], ["key", "rid", "doc_id", "n_words", "at"])

    shape = "key binary, rid long, doc_id long, n_words long, at int"
    suffixes = whole.join(known.hint("shuffle_merge"), "rid").select("rid", "doc_id", "text", "found").mapInArrow(textkit.tidy(cut), shape)
    placed = suffixes.repartitionByRange("key", "rid", "at").sortWithinPartitions("key", "rid", "at")
    matched = "rid long, doc_id long, n_words long, at int, side int, reach int, key binary"
    compared = placed.mapInArrow(textkit.tidy(_neighbours), matched)
    edges = compared.where("key IS NOT NULL").select("key", "rid", "doc_id", "n_words", "at").repartition(1).sortWithinPartitions("key", "rid", "at").mapInArrow(textkit.tidy(_neighbours), matched)
    every = compared.drop("key").unionByName(edges.drop("key"))
    per_doc = every.groupBy("rid", "doc_id", "n_words").agg(F.collect_list(F.struct("at", "side", "reach")).alias("hits"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[dict]] = []
            total: list[int] = []
            for hits in batch.column(2):
                hits = hits.values
                at, side, reach = (hits.field(k).to_numpy() for k in range(3))
                places, where = np.unique(at, return_inverse=True)
                sides = np.full((2, len(places)), -1)
                for k in (0, 1):
                    np.maximum.at(sides[k], where[side == k], reach[side == k])
                l, r = np.maximum(sides[0], 0), np.where((sides[0] >= 0) | (sides[1] >= 0), gram + np.maximum(sides[1], 0), 0)
                good = l + r >= least
                start, end = passages.merged((places - l)[good], (places + r)[good])
                rows.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)])
                total.append(int((end - start).sum()))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(rows, kind)], ["doc_id", "n_words", "n_duplicate_words", "spans"])

    return per_doc.select("doc_id", "n_words", "hits").mapInArrow(textkit.tidy(spans), SCHEMA).where("n_duplicate_words > 0")


def _two_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without the third and later ones of a run of equal rows (the merge join gives rows in the order of rid): two stand for any
    number, since each finds its repeats in the other."""
    before = np.full(2, -1, np.int64)
    seen = 0
    for batch in batches:
        rid = batch.column(0).to_numpy()
        last = np.concatenate([before, rid])
        more = (rid == last[1:-1]) & (rid == last[:-2]) & (np.arange(seen, seen + len(rid)) >= 2)
        seen += len(rid)
        before = last[-2:]
        yield batch.filter(pa.array(~more)) if more.any() else batch


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each suffix of a sorted run the words it shares with a neighbour (``reach``; -1 if
    not even the gram); the run's first and last suffix also keep their key."""
    last: pa.RecordBatch | None = None
    carried = -1
    first = True

    def out(rows: pa.RecordBatch, reach: np.ndarray, ends: list[int]) -> pa.RecordBatch:
        side = np.fromiter((k[0] for k in rows.column(0).to_pylist()), np.int32, rows.num_rows)
        keys = [None] * rows.num_rows
        for i in ends:
            keys[i] = rows.column(0)[i].as_py()
        return pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), rows.column(3), rows.column(4), pa.array(side), pa.array(reach.astype(np.int32)), pa.array(keys, pa.binary())], ["rid", "doc_id", "n_words", "at", "side", "reach", "key"])

    def shared(keys: list[bytes]) -> np.ndarray:
        """Words shared by each two consecutive keys after side and gram, or -1."""
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        wide = int(size.max())
        flat = np.frombuffer(b"".join(k.ljust(wide, b"\0") for k in keys), np.uint8).reshape(len(keys), wide)
        same = np.ones((len(keys) - 1, wide + 1), bool)
        same[:, :wide] = flat[1:] == flat[:-1]
        same[:, wide] = False
        n = np.minimum(same.argmin(1), np.minimum(size[1:], size[:-1]))
        return np.where(n >= 9, (n - 9) // 4, -1)

    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            rows = batch.slice(at, 20_000)
            if last is not None:
                rows = pa.Table.from_batches([last, rows.select(last.schema.names)]).combine_chunks().to_batches()[0]
            keys = rows.column(0).to_pylist()
            reach = np.full(len(keys), -1)
            if len(keys) > 1:
                both = shared(keys)
                reach[1:] = both
                reach[:-1] = np.maximum(reach[:-1], both)
            reach[0] = max(reach[0], carried)
            if len(keys) > 1:
                yield out(rows.slice(0, len(keys) - 1), reach[:-1], [0] if first else [])
                first = False
                carried = reach[-1]
            last = rows.slice(len(keys) - 1, 1)
    if last is not None:
        yield out(last, np.array([carried]), [0])
