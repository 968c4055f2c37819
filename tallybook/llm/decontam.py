"""Benchmark decontamination by template canonicalisation.

Both texts become templates: words lose case and outer punctuation; numbers, names (capitalised
words that don't open a sentence) and units after a number become typed placeholders.  Windows
of ``GRAM`` template words with at least ``LITERALS`` literal words are joined on their hash;
windows with fewer are joined on the plain forms of all their words, slots included.
Matched windows of one document and item are grouped by their offset, and groups that keep the
item's order with at most ``GAP`` words between them are chained, so that each reading of the item
in the document is judged alone; within one, every slot value of the item must map
to one value of the document (the majority's), and windows that contradict it are dropped.  A
document leaks an item when the windows left cover at least ``COVERED`` of the item's words, or that
share, and ``LEAST_WORDS`` at least, of those that lie in windows with enough literal words, or
``PASSAGE`` of its words without a break.

The benchmark's distinct window hashes are broadcast to thin out document windows before the
join while they are at most ``BROADCAST_HASHES`` (counted first); beyond that all windows go
through the shuffle join.  Items under ``GRAM`` words are matched as one window of their length.

Defined results: null texts have no windows; items without literal words match on their values; every
(document, item) pair comes once, whatever rows repeat; clean documents give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import passages, textkit
from tallybook.llm.shared import stored

GRAM, LITERALS, COVERED = 5, 3, 0.8
#: Words that template windows must cover where they are measured without the item's other words.
LEAST_WORDS = 8
#: Words, of item or document, that may lie between chained groups; unbroken words that are a leak by themselves.
GAP, PASSAGE = 12, 13
#: Largest number of benchmark window hashes that is broadcast.
BROADCAST_HASHES = 4_000_000
#: Distinct words that a worker remembers before it starts anew.
MEMO = 200_000
WORD, NUMBER, NAME, UNIT = range(4)
#: Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree degrees".split()
)
_NUMBER = re.compile(r"[+\-−]?[$€£¥]?[+\-−]?\d[\d.,:/%°'’]*[a-z%]{0,3}$", re.I)
_OUTER = re.compile(r"^[^\w$€£¥+\-−]+|[^\w%°]+$")


def canonical(raw: str) -> tuple[str, int, bool, bool]:
    """Plain form, kind by the word alone, capitalised, ends a sentence."""
    core = raw.strip(".,;:!?\"'()")
    ends = raw.rstrip("\"')]»”’")[-1:] in tuple(".!?:;")
    if core.isalpha():
        return core.lower(), WORD, core[0].isupper() and not core[1:2].isupper(), ends
    word = _OUTER.sub("", raw)
    if _NUMBER.match(word):
        return word.lower(), NUMBER, False, ends
    word = word.strip("$€£¥+-−")
    return word.lower(), WORD, word[:1].isupper() and not word[1:2].isupper(), ends


class Templates:
    """Template words of one step of texts: hashes and kinds, row by row.

    A word of plain lower-case letters is its own form and keeps its hash; only the others, with
    capitals, digits, marks or other alphabets, are looked up by distinct form."""

    def __init__(self, texts: pa.Array, memo: dict[int, tuple[str, int, bool, bool]]):
        words = textkit.Words(texts)
        self.raw, self.start, self.end = words.raw.tobytes(), words.start, words.end
        odd_bytes = np.zeros(len(words.raw) + 1, np.int64)
        np.cumsum((words.raw < 97) | (words.raw > 122), out=odd_bytes[1:])
        odd = np.flatnonzero(odd_bytes[words.end] > odd_bytes[words.start])
        kinds, first, back = np.unique(words.hash[odd], return_index=True, return_inverse=True)
        if len(memo) > MEMO:
            memo.clear()
        forms = []
        for h, i in zip(kinds.tolist(), odd[first].tolist(), strict=True):
            known = memo.get(h)
            if known is None:
                known = memo[h] = canonical(self.raw[words.start[i] : words.end[i]].decode("utf-8", "replace"))
            forms.append(known)
        n = len(words)
        kind, value = np.zeros(n, np.int64), words.hash.copy()
        capital, ends, solid = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
        if forms:
            kind[odd] = np.array([f[1] for f in forms])[back]
            capital[odd], ends[odd] = (np.array([f[k] for f in forms], bool)[back] for k in (2, 3))
            solid[odd] = np.array([bool(f[0]) for f in forms], bool)[back]
            value[odd] = hashes_of([f[0] for f in forms])[back]
        opens = np.ones(n, bool)
        lines = np.zeros(len(words.raw) + 1, np.int64)
        np.cumsum(words.raw == 10, out=lines[1:])
        opens[1:] = ends[:-1] | (lines[words.start[1:]] > lines[words.end[:-1]])
        heads = words.row_at[:-1][words.count > 0]
        opens[heads] = True
        kind = np.where(capital & ~opens & (kind == WORD), NAME, kind)
        after_number = np.zeros(n, bool)
        after_number[1:] = kind[:-1] == NUMBER
        after_number[heads] = False
        near = np.flatnonzero(after_number & (kind == WORD))
        kind[near[np.isin(value[near], UNIT_HASHES)]] = UNIT
        keep = np.flatnonzero(solid)
        upto = np.zeros(n + 1, np.int64)
        np.cumsum(solid, out=upto[1:])
        self.row_at = upto[words.row_at]
        self.count = np.diff(self.row_at)
        self.kind, self.at = kind[keep], keep
        self.value = np.where(self.kind == WORD, value[keep], textkit.mix64(self.kind.astype(np.uint64)))
        self.prefix = textkit.prefix_hash(self.value)
        self.plain = textkit.prefix_hash(textkit.mix64(value[keep]))
        self.literal = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(self.kind == WORD, out=self.literal[1:])

    def windows(self, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and hash of every window of ``size`` words, and whether it has ``least``
        literals: others are hashed by plain forms."""
        n = len(self.kind) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        row = np.repeat(np.arange(len(self.count)), self.count)
        at = np.flatnonzero(row[:n] == row[size - 1 :])
        typed = self.literal[at + size] - self.literal[at] >= least
        h = textkit.range_hash(self.prefix, at, at + size)
        bare = at[~typed]
        h[~typed] = textkit.range_hash(self.plain, bare, bare + size)
        return row[at], at, h, typed

    def slots(self, at: np.ndarray, size: int) -> list[str]:
        """The placeholders' values of windows, joined by a separator; literals are left out."""
        plain = lambda j: canonical(self.raw[self.start[j] : self.end[j]].decode("utf-8", "replace"))[0]
        return ["\x1f".join(plain(self.at[j]) for j in range(i, i + size) if self.kind[j] != WORD) for i in at.tolist()]


def hashes_of(forms: list[str]) -> np.ndarray:
    """The hash that textkit.Words gives each of these words."""
    data = [f.encode("utf-8", "replace") for f in forms]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(data), np.uint8)
    return textkit.range_hash(textkit.prefix_hash(raw.astype(np.uint64) + np.uint64(1)), ends - sizes, ends)


UNIT_HASHES = hashes_of(sorted(UNITS))


def item_windows(benchmark: DataFrame, gram: int = GRAM, literals: int = LITERALS) -> DataFrame:
    """item_id, n_words, n_typed (words in windows with enough literals), size, j (window), h, slots and
    whether it is typed of every distinct item row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, tuple[str, int, bool, bool]] = {}
        for part in passages.gather(batches):
            t = Templates(part.column(1), memo)
            for size in range(1, gram + 1):
                row, at, h, typed = t.windows(size, literals if size == gram else min(literals, size))
                if size < gram:
                    mine = t.count[row] == size
                    row, at, h, typed = row[mine], at[mine], h[mine], typed[mine]
                if len(row):
                    inside = np.zeros(len(t.kind) + 1, np.int64)
                    inside[1 + np.unique(at[typed, None] + np.arange(size))] = 1
                    inside = np.cumsum(inside)
                    n_typed = inside[t.row_at[row + 1]] - inside[t.row_at[row]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)).cast(pa.int64()), pa.array(t.count[row]), pa.array(n_typed), pa.array(np.full(len(row), size)), pa.array(at - t.row_at[row]), pa.array(h.view(np.int64)), pa.array(t.slots(at, size)), pa.array(typed)], ["item_id", "n_words", "n_typed", "size", "j", "h", "item_slots", "typed"])

    return benchmark.select("item_id", "text").distinct().mapInArrow(textkit.tidy(run), "item_id long, n_words long, n_typed long, size long, j long, h long, item_slots string, typed boolean")


def document_windows(docs: DataFrame, sizes: list[int], wanted, gram: int = GRAM, literals: int = LITERALS) -> DataFrame:
    """rid, doc_id, i (window), h, slots of document windows; only those in ``wanted`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = None if wanted is None else wanted.value
        memo: dict[int, tuple[str, int, bool, bool]] = {}
        for part in passages.gather(batches):
            t = Templates(part.column(2), memo)
            for size in sizes:
                row, at, h, _ = t.windows(size, literals if size == gram else min(literals, size))
                if hashes is not None and len(h):
                    spot = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                    hit = hashes[spot] == h if len(hashes) else np.zeros(len(h), bool)
                    row, at, h = row[hit], at[hit], h[hit]
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take).cast(pa.int64()), pa.array(at - t.row_at[row]), pa.array(h.view(np.int64)), pa.array(t.slots(at, size))], ["rid", "doc_id", "i", "h", "doc_slots"])

    return passages.keyed(docs).mapInArrow(textkit.tidy(run), "rid long, doc_id long, i long, h long, doc_slots string")


def covered_words(hits: list[tuple[int, int, str, str]], size: int) -> tuple[int, bool]:
    """Most item words covered consistently by one reading, and whether slots differ there.

    ``hits`` are (item window, document window, item slots, document slots)."""
    return max(((len(words), changed) for words, changed, _, _ in readings([(*h, True) for h in hits], size)), default=(0, False))


def readings(hits: list[tuple[int, int, str, str, bool]], size: int) -> Iterator[tuple[set[int], bool, set[int], int]]:
    """Item words covered consistently by each reading, whether slots differ there, the words covered
    by typed windows, and the longest unbroken passage.  ``hits`` are as above, with whether the
    window is typed.  A reading is a group of hits or a chain of groups."""
    hits = sorted(hits, key=lambda x: (x[1] - x[0], x[1]))
    groups = []
    begin = 0
    for k in range(1, len(hits) + 1):
        if k < len(hits) and hits[k][1] - hits[k][0] - (hits[k - 1][1] - hits[k - 1][0]) <= 1:
            continue
        groups.append(hits[begin:k])
        begin = k
    chained = [*groups, *([x for g in chain for x in g] for chain in chains(groups, size))]
    for group in chained:
        kept, changed = consistent(group)
        yield {w for h in kept for w in range(h[0], h[0] + size)}, changed, {w for h in kept if h[4] for w in range(h[0], h[0] + size)}, unbroken(kept, size)


def chains(groups: list[list[tuple[int, int, str, str, bool]]], size: int) -> Iterator[list[list[tuple[int, int, str, str, bool]]]]:
    """For each group that can follow another one, the chain ending in it that has most words."""
    ranked = []
    for g in groups:
        j, i = [h[0] for h in g], [h[1] for h in g]
        ranked.append((min(i), max(i), min(j), max(j), len({w for x in j for w in range(x, x + size)}), g))
    ranked.sort(key=lambda x: x[:4])
    longest = max((x[1] - x[0] for x in ranked), default=0)
    best: list[tuple[int, int | None]] = []
    for k, (i0, _, j0, j1, n, _) in enumerate(ranked):
        mine = (n, None)
        for m in range(k - 1, -1, -1):
            a = ranked[m]
            if i0 - a[0] > longest + size + GAP:
                break
            if a[0] < i0 and a[2] < j0 and a[3] < j1 and i0 - a[1] - size <= GAP and j0 - a[3] - size <= GAP:
                mine = max(mine, (best[m][0] + n - max(0, a[3] + size - j0), m), key=lambda x: x[0])
        best.append(mine)
    for k, (_, before) in enumerate(best):
        if before is not None:
            chain = [k]
            while (before := best[chain[-1]][1]) is not None:
                chain.append(before)
            yield [ranked[m][5] for m in reversed(chain)]


def unbroken(hits: list[tuple[int, int, str, str, bool]], size: int) -> int:
    """Most item words in a row that stand in a row in the document as well."""
    most = first = 0
    last = None
    for offset, j in sorted({(h[1] - h[0], h[0]) for h in hits}):
        if last is None or last[0] != offset or j > last[1] + size:
            first = j
        last = (offset, j)
        most = max(most, j + size - first)
    return most


def consistent(hits: list[tuple[int, int, str, str, bool]]) -> tuple[list[tuple[int, int, str, str, bool]], bool]:
    """The hits that agree with the majority's value of every slot, and whether slots differ in them."""
    votes: dict[str, dict[str, int]] = {}
    pairs = []
    for hit in hits:
        both = list(zip(hit[2].split("\x1f"), hit[3].split("\x1f"), strict=False)) if hit[2] or hit[3] else []
        pairs.append((hit, both))
        for x, y in both:
            votes.setdefault(x, {})[y] = votes.get(x, {}).get(y, 0) + 1
    chosen = {x: max(sorted(v), key=v.get) for x, v in votes.items()}
    kept = [(hit, both) for hit, both in pairs if all(chosen[x] == y for x, y in both)]
    return [hit for hit, _ in kept], any(x != y for _, both in kept for x, y in both)


def judged(hits: list[tuple[int, int, str, str, bool]], size: int, n_words: int, n_typed: int) -> tuple[bool, int, bool]:
    """Whether a reading leaks the item, and its words and change; the best of all readings."""
    best = (False, 0, False)
    for words, changed, typed, passage in readings(hits, size):
        leak = len(words) >= COVERED * n_words or len(typed) >= max(COVERED * n_typed, LEAST_WORDS) or passage >= PASSAGE
        best = max(best, (leak, len(words), changed))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """rid, doc_id, item_id, covered_words, item_words, reparameterised of every leak."""
    items = stored(item_windows(benchmark), "items")
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]
    distinct = items.select("h").distinct()
    wanted = None
    if distinct.count() <= broadcast_hashes:
        column = distinct.toArrow().column(0)
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(column.to_numpy().view(np.uint64)))
    met = document_windows(docs, sizes or [GRAM], wanted).join(items, "h")
    gathered = met.groupBy("rid", "doc_id", "item_id", "n_words", "n_typed", "size").agg(F.collect_set(F.struct("j", "i", "item_slots", "doc_slots", "typed")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged([tuple(h.values()) for h in hits], size, n_words, n_typed) for n_words, n_typed, size, hits in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r[1] for r in rows], pa.int64()), batch.column(3), pa.array([r[2] for r in rows], pa.bool_())], ["rid", "doc_id", "item_id", "covered_words", "item_words", "reparameterised"])
            yield out.filter(pa.array([r[0] for r in rows], pa.bool_()))

    shape = "rid long, doc_id long, item_id long, covered_words long, item_words long, reparameterised boolean"
    return gathered.select("rid", "doc_id", "item_id", "n_words", "n_typed", "size", "hits").mapInArrow(textkit.tidy(run), shape)


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it leaks."""
    best = F.max(F.struct("covered_words", "item_words", "reparameterised")).alias("best")
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    key, rid = textkit.fresh(docs, "key", "rid")
    bad = stored(leaks(docs, benchmark).select(F.col("rid").alias(rid)).distinct(), "leaks")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(bad, F.col(key) == F.col(rid), "left_anti").drop(key)
