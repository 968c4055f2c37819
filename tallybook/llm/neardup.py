"""Near-duplicates by Order MinHash with banded alignment.

Texts are k-mers of ``GRAM`` words, each labelled by its occurrence number in the text.  For
each of ``SKETCHES`` hash orders the ``PICKED`` smallest labelled k-mers are taken *in text
order* and hashed together, so that a sketch agrees when k-mers and their order agree.  Texts
that agree in a sketch form a bucket.  Copies (equal texts) are one node from the start.

Texts of up to ``MIDDLE`` words have ``MORE`` sketches; those of up to ``SHORT`` words also get segment keys: of two texts within ``d`` edits, one has
``d + 1`` segments of which the other holds one at nearly its place, so no link among them is missed.

A pair is a link when its word-level edit distance, from a banded alignment of width
2 * floor(0.2 * longer) + 1, is at most 0.2 times the longer text's words (``SIMILAR`` 0.8).
Every pair that shares a bucket is decided, in two rounds:

1. each member is compared with its bucket's smallest node, and the links become classes;
2. members of a bucket that are still in different classes are compared by counts of their
   words and of their word pairs in ``BINS`` bins each, and the pairs left one by one.  Buckets are cut into blocks of about
   ``BLOCK`` members, and each two blocks are one row of one task, so that no bucket is held as a
   whole; a pair that shares several buckets is looked at in the first of them only.

One edit changes one word and two word pairs at most, so two texts whose words or word pairs differ
by more than that for every edit that a link may have are no link, and need no alignment.
Links become classes by star contraction, a few joins over links only.

Nodes are 64-bit hashes of the text; alignment and sketches run over 20-bit word codes.

Defined results: null and wordless texts are each a class of their own; texts under ``GRAM``
words are one k-mer; class_id is the smallest doc_id of the class; repeated rows are copies;
an empty table has no classes; extra columns, whatever their names, pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import passages, textkit
from tallybook.llm.shared import apart, forget, stored

GRAM, SKETCHES, PICKED, SIMILAR = 5, 80, 2, 0.8
#: Longest text (words) that has segment keys.
SHORT = 30
#: Longest text (words) that has more sketches, and how many more: few k-mers are left between edits there.
MIDDLE, MORE = 100, 100
#: Members of a bucket in one block of the second round; bins that words, and word pairs, are counted in.
BLOCK, BINS = 512, 512
#: Pairs whose counts are compared in one vectorised step.
STEP = 2048


def room(words: int, similar: float = SIMILAR) -> int:
    """Edits that a link may have whose longer text has so many words."""
    return int((1 - similar) * words + 1e-9)


@cache
def segments(n: int, similar: float = SIMILAR) -> np.ndarray:
    """The segment keys of a text of ``n`` words: rows of first word, words, and the length, edits and
    place that name the segment.  As the shorter text of a pair it has its own segments, as the longer
    one every place where a segment of a text of its own length or less may stand within the edits."""
    out = []
    cut = lambda size, d: [(i, size * i // (d + 1), size * (i + 1) // (d + 1)) for i in range(d + 1)]
    for d in sorted({room(m, similar) for m in range(n, SHORT + 1) if m - room(m, similar) <= n} - {0}):
        out += [(a, b - a, n, d, i) for i, a, b in cut(n, d)]
    d = room(n, similar)
    for size in range(n - d, n + 1) if d else []:
        for i, a, b in cut(size, d):
            low, high = max(a - i, a + n - size - (d - i), 0), min(a + i, a + n - size + (d - i), n - (b - a))
            out += [(q, b - a, size, d, i) for q in range(low, high + 1)]
    return np.array(sorted(set(out)), np.int64).reshape(-1, 5)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text, node: equal texts share a node; null for texts without a word."""
    return docs.select("doc_id", "text", F.when(F.col("text").rlike(f"[^{textkit.WHITE}]"), F.xxhash64("text")).alias("node"))


def coded(texts: DataFrame) -> DataFrame:
    """node, n (words), seq: one character for each word, for alignment of words as characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passages.gather(batches):
            words = textkit.Words(part.column(1))
            points = (np.uint64(0x10000) + (words.hash >> np.uint64(44))).astype("<u4")
            whole = points.tobytes().decode("utf-32-le")
            seqs = [whole[a:b] for a, b in zip(words.row_at[:-1].tolist(), words.row_at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.count.astype(np.int32)), pa.array(seqs, pa.string())], ["node", "n", "seq"])

    return texts.select("node", "text").mapInArrow(textkit.tidy(run), "node long, n int, seq string")


def _codes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word codes of all rows one after the other, and each row's first place and length."""
    rows = seqs.to_pylist()
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    codes = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4").astype(np.uint64)
    return codes, np.cumsum(sizes) - sizes, sizes


def _agreeing(keys: np.ndarray, sizes: np.ndarray, orders: range, picked: int) -> np.ndarray:
    """The order-min-hashes of texts with ``sizes`` labelled k-mers each, a column for each hash order."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = np.uint64(max(20, int(len(keys)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(keys)).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    padded = np.append(keys, np.uint64(0))
    bands = np.zeros((len(sizes), len(orders)), np.uint64)
    for column, i in enumerate(orders if len(sizes) else ()):
        odd = textkit.mix64(np.array([i + 1], np.uint64))[0] | np.uint64(1)
        v = ((keys * odd) >> bits << bits) | place
        chosen = np.zeros((picked, len(sizes)), np.int64)
        for j in range(picked):
            spot = (np.minimum.reduceat(v, at) & low).astype(np.int64)
            have = sizes > j
            chosen[j] = np.where(have, spot, len(keys))
            v[spot[have]] = top
        chosen.sort(0)
        out = np.full(len(sizes), i + 1, np.uint64)
        for j in range(picked):
            out = textkit.mix64(out * np.uint64(31) + padded[chosen[j]])
        bands[:, column] = out
    return bands


def sketches(seqs: DataFrame, gram: int = GRAM, count: int = SKETCHES, picked: int = PICKED) -> DataFrame:
    """node, bands: ``count`` order-min-hashes, more and segment keys of shorter texts, of each row of (node, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passages.gather(batches, "seq"):
            codes, first, n = _codes(part.column(1))
            spans = textkit.prefix_hash(textkit.mix64(codes))
            sizes = np.maximum(n - gram + 1, 1)
            start = textkit.ragged(first, sizes)
            row = np.repeat(np.arange(len(n)), sizes)
            grams = textkit.range_hash(spans, start, np.minimum(start + gram, (first + n)[row]))
            # occurrence labels: rank among equal k-mers of the same text
            mark = textkit.mix64(grams + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(mark, kind="stable")
            ranked = mark[order]
            fresh = np.ones(len(ranked), bool)
            fresh[1:] = ranked[1:] != ranked[:-1]
            heads = np.flatnonzero(fresh)
            label = np.empty(len(ranked), np.int64)
            label[order] = np.arange(len(ranked)) - heads[np.cumsum(fresh) - 1]
            keys = textkit.mix64(grams + textkit.mix64(label.astype(np.uint64)))
            rows = list(_agreeing(keys, sizes, range(count), picked))
            some = np.flatnonzero(n <= MIDDLE)
            begin = np.cumsum(sizes) - sizes
            mine = keys[textkit.ragged(begin[some], sizes[some])]
            for k, extra in zip(some.tolist(), _agreeing(mine, sizes[some], range(count, count + MORE), picked), strict=True):
                rows[k] = np.append(rows[k], extra)
            for k in np.flatnonzero(n <= SHORT):
                begin, size, *name = segments(int(n[k])).T
                if len(begin):
                    begin = begin + first[k]
                    named = ((name[0] * 64 + name[1]) * 64 + name[2]).astype(np.uint64)
                    rows[k] = np.append(rows[k], np.unique(textkit.mix64(textkit.range_hash(spans, begin, begin + size) + textkit.mix64(named))))
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "bands"])

    return seqs.select("node", "seq").mapInArrow(textkit.tidy(run), "node long, bands array<long>")


def _surplus(mine: np.ndarray, owner: np.ndarray, others: np.ndarray, their: np.ndarray, pairs: int) -> np.ndarray:
    """For each pair the larger of two counts: items of one side without a match on the other, as multisets."""
    keys, where = np.unique(np.concatenate([owner << np.uint64(44) | mine, their << np.uint64(44) | others]), return_inverse=True)
    differ = np.bincount(where[: len(mine)], minlength=len(keys)) - np.bincount(where[len(mine) :], minlength=len(keys))
    pair = (keys >> np.uint64(44)).astype(np.int64)
    more = np.bincount(pair, np.maximum(differ, 0), pairs)
    return np.maximum(more, np.bincount(pair, np.maximum(-differ, 0), pairs))


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences is at most ``most``.

    What they have in common at both ends is left out; the rest is aligned in a band around the
    diagonal, a narrow one first.  A column of the band is two integers, whose bits say where the
    distance goes up or down by one from a row to the next (bit-parallel, after Myers and Hyyrö)."""
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) < len(b):
        a, b = b, a
    differ = a[: len(b)] != b
    head = int(differ.argmax()) if differ.any() else len(b)
    a, b = a[head:], b[head:]
    differ = a[len(a) - len(b) :][::-1] != b[::-1]
    tail = int(differ.argmax()) if differ.any() else len(b)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(b):
        return len(a) <= most
    spots: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        spots[x] = spots.get(x, 0) | 1 << i
    columns, width = b.tolist(), max(32, len(a) - len(b))
    while True:
        width = min(width, most)
        if _banded(spots, len(a), columns, width) <= width:
            return True
        if width == most:
            return False
        width *= 4


def _banded(spots: dict[int, int], rows: int, columns: list[int], k: int) -> int:
    """The edit distance where it is at most ``k``, else something above.  ``spots`` has the rows of each symbol as
    bits.  Bit i of column j's integers is row j - k + i; the distance is followed down the band's lower
    edge and, from where that leaves the last row, along the last row."""
    k = min(k, max(rows, len(columns)))
    full, low = (1 << (2 * k + 1)) - 1, 1 << 2 * k
    up, down = full ^ ((1 << k) - 1), 0
    distance, edge = k, rows - k
    for j, x in enumerate(columns, 1):
        same = spots.get(x, 0)
        same = (same << k - j + 1 if j <= k else same >> j - k - 1) & full
        flat = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(flat | up)), flat & up & full
        if j <= edge:
            distance += not flat & low
        else:
            at = rows - j + k
            distance += (rise >> at & 1) - (fall >> at & 1)
        if distance > k + len(columns) - j and j >= edge:
            return k + 1
        flat = (flat & full) >> 1
        up, down = fall | (full & ~(flat | rise)), flat & rise
    return distance


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs within ``room`` edits.  Those whose words and word pairs differ by more than that many
    edits can account for are left out first."""
    for batch in batches:
        for part in textkit.steps(batch, "seq_a"):
            rooms = part.column(part.schema.get_field_index("room")).to_numpy()
            sides, texts = [], []
            for name in ("seq_a", "seq_b"):
                codes, first, n = _codes(part.column(part.schema.get_field_index(name)))
                owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                both = np.flatnonzero(owner[1:] == owner[:-1])
                joined = textkit.mix64((codes[both] << np.uint64(24)) | codes[both + 1]) >> np.uint64(20)
                sides.append((codes, owner, joined, owner[both]))
                texts.append(lambda k, codes=codes, first=first, n=n: codes[first[k] : first[k] + n[k]])
            (words_a, of_a, pairs_a, of_pairs_a), (words_b, of_b, pairs_b, of_pairs_b) = sides
            good = _surplus(words_a, of_a, words_b, of_b, len(rooms)) <= rooms
            good &= _surplus(pairs_a, of_pairs_a, pairs_b, of_pairs_b, len(rooms)) <= 2 * rooms
            for k in np.flatnonzero(good):
                good[k] = within(texts[0](k), texts[1](k), int(rooms[k]))
            yield part.select(["a", "b"]).filter(pa.array(good))


def verified(pairs: DataFrame, seqs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) that are links."""
    one = seqs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("seq").alias("seq_a"))
    two = seqs.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("seq").alias("seq_b"))
    room = F.floor((1 - similar) * F.greatest("n_a", "n_b") + 1e-9).cast("int")
    met = pairs.join(one.hint("shuffle_merge"), "a").join(two.hint("shuffle_merge"), "b").withColumn("room", room)
    met = met.where(F.abs(F.col("n_a") - F.col("n_b")) <= F.col("room"))
    return met.select("a", "b", "room", "seq_a", "seq_b").mapInArrow(textkit.tidy(_links), "a long, b long")


def counted(seqs: DataFrame, bins: int = BINS) -> DataFrame:
    """The rows of ``seqs`` with ``counts`` (a byte for each bin of words, then of word pairs) in place of seq."""
    rest = [c for c in seqs.columns if c != "seq"]
    schema = ", ".join(f"{c} {dict(seqs.dtypes)[c]}" for c in rest) + ", counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passages.gather(batches, "seq"):
            codes, first, n = _codes(part.column(part.schema.get_field_index("seq")))
            row = np.repeat(np.arange(len(n)), n)
            words = textkit.mix64(codes)
            out = np.zeros((len(n), 2 * bins), np.uint8)
            own = np.bincount(row * bins + (words % np.uint64(bins)).astype(np.int64), minlength=len(n) * bins).reshape(-1, bins)
            out[:, :bins] = np.minimum(own, 255)
            both = np.flatnonzero(row[1:] == row[:-1])
            pairs = textkit.mix64(words[both] * np.uint64(31) + words[both + 1])
            own = np.bincount(row[both] * bins + (pairs % np.uint64(bins)).astype(np.int64), minlength=len(n) * bins).reshape(-1, bins)
            out[:, bins:] = np.minimum(own, 255)
            columns = [part.column(part.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, textkit.binary_rows(out.reshape(-1), np.full(len(n), 2 * bins))], [*rest, "counts"])

    return seqs.mapInArrow(textkit.tidy(run), schema)


def _possible(members: list[dict], bucket: int, similar: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the members of one block row that may be links, by length and counts, without
    those of one class and those that meet in an earlier bucket."""
    salt = np.array([m["salt"] for m in members])
    root = np.array([m["root"] for m in members])
    n = np.array([m["n"] for m in members])
    counts = np.frombuffer(b"".join(m["counts"] for m in members), np.uint8).reshape(len(members), 2 * bins).astype(np.int16)
    cross = salt.min() != salt.max()
    if cross:
        left, right = np.flatnonzero(salt == salt.min()), np.flatnonzero(salt == salt.max())
    else:
        left = right = np.arange(len(members))
    allowed = ((1 - similar) * np.maximum(n[left, None], n[None, right]) + 1e-9).astype(np.int64)
    fits = (root[left, None] != root[None, right]) & (np.abs(n[left, None] - n[None, right]) <= allowed)
    if not cross:
        fits &= left[:, None] < right[None, :]
    earlier = [[b for b in m["buckets"] if b < bucket] for m in members]
    names, where = np.unique(np.array([b for x in earlier for b in x], np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), [len(x) for x in earlier])
    shared = np.flatnonzero(np.bincount(where, minlength=len(names)) > 1)
    column = np.full(len(names), -1)
    column[shared] = np.arange(len(shared))
    held = np.zeros((len(members), len(shared) // 64 + 1), np.uint64)
    told = column[where] >= 0
    bit = column[where][told]
    np.bitwise_or.at(held, (owner[told], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    for k in np.flatnonzero(fits.any(1)):
        open_ = np.flatnonzero(fits[k])
        fits[k, open_[(held[right[open_]] & held[left[k]]).any(1)]] = False
    i, j = np.nonzero(fits)
    good = np.zeros(len(i), bool)
    for at in range(0, len(i), STEP):
        x, y = left[i[at : at + STEP]], right[j[at : at + STEP]]
        most = allowed[i[at : at + STEP], j[at : at + STEP]]
        ok = np.arange(len(x))
        for low, high, per_edit in ((0, bins, 1), (bins, 2 * bins, 2)):
            differ = counts[x[ok], low:high] - counts[y[ok], low:high]
            more = np.maximum(differ, 0).sum(1, dtype=np.int64)
            less = more - differ.sum(1, dtype=np.int64)
            ok = ok[np.maximum(more, less) <= per_edit * most[ok]]
        good[at + ok] = True
    return left[i[good]], right[j[good]]


def compared(members: DataFrame, seqs: DataFrame, similar: float = SIMILAR, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """a, b: the pairs of different classes within a bucket that counts of words don't rule out.

    ``members`` has bucket, its size, node and root (the node's class)."""
    own = members.groupBy("node", "root").agg(F.collect_list(F.struct("bucket", "size")).alias("met"))
    known = counted(own.join(seqs.hint("shuffle_merge"), "node").select("node", "root", "n", F.col("met.bucket").alias("buckets"), F.col("met.size").alias("sizes"), "seq"), bins)
    rows = known.select("node", "root", "n", "buckets", "counts", F.explode(F.arrays_zip("buckets", "sizes")).alias("in"))
    cuts = F.greatest(F.ceil(F.col("in.sizes") / block), F.lit(1)).cast("int")
    rows = rows.select("node", "root", "n", "buckets", "counts", F.col("in.buckets").alias("bucket"), cuts.alias("cuts"), F.pmod(F.xxhash64("in.buckets", "node"), cuts).cast("int").alias("salt"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    blocks = rows.groupBy("bucket", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high")).agg(F.collect_list(F.struct("salt", "node", "root", "n", "buckets", "counts")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, low, high = (batch.column(c)[k].as_py() for c in range(3))
                members = batch.column(3)[k].as_py()
                if low != high and len({m["salt"] for m in members}) < 2:
                    continue
                i, j = _possible(members, bucket, similar, bins)
                node = np.array([m["node"] for m in members], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["a", "b"])

    return blocks.select("bucket", "low", "high", "members").mapInArrow(textkit.tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for nodes with a link.

    Large-star and small-star steps in turn until every node hangs on one root that hangs on none;
    every two steps are grouped minima and joins, and their result is stored, so neither groups nor
    lineage grow."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty():
            break
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = edges.unionByName(turned).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = turned.join(apart(low, "u").hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least, "u").hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "stars")
        forget(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(docs: DataFrame, similar: float = SIMILAR, count: int = SKETCHES) -> DataFrame:
    """doc_id, node and root (a node of its class; null for wordless texts) of every row."""
    named = nodes(docs)
    texts = named.where("node IS NOT NULL").groupBy("node").agg(F.first("text").alias("text"))
    seqs = stored(coded(texts), "sequences")
    rows = sketches(seqs, count=count).select("node", F.explode("bands").alias("bucket"))
    lowest = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("size")).where("size > 1")
    met = stored(rows.join(apart(lowest, "bucket").hint("shuffle_merge"), "bucket").where("node <> low"), "buckets")
    links = stored(verified(met.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), seqs, similar), "verified")
    roots = components(links)
    members = met.select("bucket", "size", "node").where("size > 2").join(roots.hint("shuffle_merge"), "node", "left").select("bucket", "size", "node", F.coalesce("root", "node").alias("root"))
    mixed = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("top")).where("least <> top").select("bucket")
    left = stored(members.join(apart(mixed, "bucket").hint("shuffle_merge"), "bucket"), "members")
    forget(met)
    more = stored(verified(compared(left, seqs, similar), seqs, similar), "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    for table in (seqs, links, left, more):
        forget(table)
    return named.select("doc_id", "node").join(roots.hint("shuffle_merge"), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, similar: float = SIMILAR, count: int = SKETCHES) -> DataFrame:
    """doc_id, node and class_id of every row of ``docs``."""
    rooted = _rooted(docs, similar, count)
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rooted.join(apart(least, "root").hint("shuffle_merge"), "root", "left").select("doc_id", "node", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id (ties: smallest node).
    Documents without a word are each a class of their own and stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first")
    kept = _rooted(docs).where("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.node")
    node, kept_id, kept_node = textkit.fresh(docs, "node", "kept_id", "kept_node")
    kept = stored(kept.toDF(kept_id, kept_node), "kept")
    hashed = docs.withColumn(node, F.when(F.col("text").rlike(f"[^{textkit.WHITE}]"), F.xxhash64("text")))
    worded = hashed.where(F.col(node).isNotNull()).join(kept.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node)), "left_semi")
    return worded.dropDuplicates(["doc_id", node]).unionByName(hashed.where(F.col(node).isNull())).drop(node)
