"""Fill-in-middle transformation by a table-driven byte automaton.

A unit is a run of ASCII letters or one other character.  The automaton reads UTF-8 bytes; its state says
whether a letter run is open, how many continuation bytes of a character are due, and how much of
a sentinel (``<P>``, ``<S>``, ``<M>``) has been seen.  Each transition emits what it counts: a character
begun, a unit begun, a sentinel ended.

Pass one scans the bytes once and keeps the counts of every ``BLOCK`` bytes.  A state depends on the
last ``WARM`` bytes alone, so all blocks of a step are scanned side by side, each from ``WARM`` bytes before
it; a byte that UTF-8 never has stands between documents and resets the automaton.  Pass two finds
the block of each cut by the counts and scans that block alone for the place.

Every document stays in its task: there is no shuffle.  A task holds one step of texts
(``textkit.steps``: about a megabyte, one document at least) and its output.

Defined results: a null or empty text is ``plain`` with an empty output and n = 0; so is, with its own text, one
that holds a sentinel; a null doc_id draws as an empty number; repeated rows are each a row of their own and
rows of one doc_id draw alike; ties cannot arise; a very long text is cut like any other; an empty table
gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import textkit

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts of which 100 stay plain from this number on, and of the others, those below this become spm.
PLAIN_FROM, SPM_BELOW = 90, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes whose counts are kept together, and bytes after which the state before them no longer matters.
BLOCK, WARM = 256, 4
#: States: nothing open; a letter run; ``<``; ``<`` and a sentinel's letter; 1, 2, 3 continuation bytes due.
CLEAR, RUN, OPEN, NAMED, DUE1, DUE2, DUE3 = range(7)
RESET = 0xFF
#: What a transition counts, each in ``FIELD`` bits of one number.
FIELD = 10
CHAR, UNIT, MARK = 1, 1 << FIELD, 1 << 2 * FIELD


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and counts for each state and byte (``state * 256 + byte``; states come times 256)."""
    after, counts = np.full((7, 256), CLEAR), np.full((7, 256), CHAR | UNIT)
    for state in range(7):
        in_run = state in (RUN, NAMED)
        for byte in (*range(65, 91), *range(97, 123)):
            after[state, byte] = NAMED if state == OPEN and byte in b"PSM" else RUN
            counts[state, byte] = CHAR if in_run else CHAR | UNIT
        after[state, ord("<")] = OPEN
        if state == NAMED:
            counts[state, ord(">")] |= MARK
        after[state, 0x80:0xC0] = state - 1 if state in (DUE2, DUE3) else CLEAR
        counts[state, 0x80:0xC0] = counts[state, RESET] = 0
        after[state, 0xC0:0xE0], after[state, 0xE0:0xF0], after[state, 0xF0:0xF8] = DUE1, DUE2, DUE3
    return (after * 256).astype(np.int32).ravel(), counts.astype(np.int32).ravel()


AFTER, COUNTS = automaton()


def fields(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters, units and sentinels of packed counts."""
    low = (1 << FIELD) - 1
    return (counts & low).astype(np.int64), (counts >> FIELD & low).astype(np.int64), (counts >> 2 * FIELD).astype(np.int64)


class Scan:
    """The counts of a step of texts: by block, and of each text."""

    def __init__(self, texts: pa.Array):
        self.raw, self.at = textkit.bytes_of(texts)
        self.sizes = np.diff(self.at)
        blocks = self.sizes // BLOCK + 1  # room for a reset byte after each text
        self.first = np.append(0, np.cumsum(blocks))
        self.data = np.full(WARM + int(self.first[-1]) * BLOCK, RESET, np.uint8)
        self.data[WARM + textkit.ragged(self.first[:-1] * BLOCK, self.sizes)] = self.raw
        counts = np.zeros(self.first[-1], np.int32)
        for _, step in self._lanes(np.arange(self.first[-1])):
            counts += step
        self.chars, self.units, marks = (np.append(0, np.cumsum(x)) for x in fields(counts))
        self.n = np.diff(self.units[self.first])
        self.marks = np.diff(marks[self.first])

    def _lanes(self, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The counts of the transitions at each byte of ``blocks``, all blocks side by side."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, WARM + BLOCK)[:: BLOCK] if len(self.data) > WARM else np.zeros((0, WARM + BLOCK), np.uint8)
        lanes = np.ascontiguousarray(rows[blocks].T)
        state = np.full(len(blocks), CLEAR * 256, np.int32)
        for k in range(WARM + BLOCK):
            move = state + lanes[k]
            state = AFTER[move]
            if k >= WARM:
                yield k - WARM, COUNTS[move]

    def cuts(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and characters before unit number ``units`` (from 0) of each of ``texts``; the number of all
        units stands for the text's end."""
        place, chars = self.sizes[texts].copy(), self.chars[self.first[texts + 1]] - self.chars[self.first[texts]]
        inner = np.flatnonzero(units < self.n[texts])
        which, unit = texts[inner], self.units[self.first[texts[inner]]] + units[inner]
        block = np.searchsorted(self.units, unit, "right") - 1
        due, seen, before = unit - self.units[block], np.zeros(len(inner), np.int64), np.zeros(len(inner), np.int64)
        for k, step in self._lanes(block):
            char, begun, _ = fields(step)
            here = np.flatnonzero((begun > 0) & (seen == due))
            place[inner[here]] = (block[here] - self.first[which[here]]) * BLOCK + k
            chars[inner[here]] = self.chars[block[here]] - self.chars[self.first[which[here]]] + before[here]
            seen += begun
            before += char
        return place, chars


def draws(doc_ids: list[int | None]) -> np.ndarray:
    """The first four 32-bit numbers of the digest of each id, by row."""
    digests = b"".join(hashlib.sha256(f"1:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def transform(docs: DataFrame, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): its units, form, lengths of prefix and middle, and output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.steps(batch, "text"):
                scan, h = Scan(part.column(1)), draws(part.column(0).to_pylist())
                one, two = h[:, 0] % (scan.n + 1), h[:, 1] % (scan.n + 1)
                moved = (scan.n > 0) & (scan.marks == 0) & (h[:, 2] % 100 < plain_from)
                spm = h[:, 3] % 100 < spm_below
                rows = np.flatnonzero(moved)
                begin, prefix = scan.cuts(rows, np.minimum(one, two)[rows])
                end, upto = scan.cuts(rows, np.maximum(one, two)[rows])
                whole = scan.raw.tobytes()
                outputs = [whole[a:b] for a, b in zip(scan.at[:-1], scan.at[1:], strict=True)]
                for k, a, b in zip(rows.tolist(), begin.tolist(), end.tolist(), strict=True):
                    text = outputs[k]
                    head, tail = PREFIX + text[:a], SUFFIX + text[b:]
                    outputs[k] = b"".join((tail, head, MIDDLE, text[a:b]) if spm[k] else (head, tail, MIDDLE, text[a:b]))
                lengths = np.zeros((2, len(moved)), np.int64)
                lengths[:, rows] = prefix, upto - prefix
                form = np.where(moved, np.where(spm, "spm", "psm"), "plain")
                columns = [part.column(0).cast(pa.int64()), pa.array(scan.n), pa.array(form.tolist(), pa.string()), *(pa.array(x, pa.int64(), mask=~moved) for x in lengths), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(textkit.tidy(run), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(coded: DataFrame) -> DataFrame:
    """The contract's columns of ``transform``."""
    return coded.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = f"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, units, len(units) AS n,
         [ list_sum([ (strpos('0123456789abcdef', substr(h, 8 * k + i, 1)) - 1) * (1::BIGINT << (4 * (8 - i))) for i in range(1, 9) ])::BIGINT for k in range(0, 4) ] AS r
  FROM u),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= {PLAIN_FROM} THEN 'plain'
              WHEN r[4] % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf
  FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
