"""Substring and suffix-array dedup against brute force."""

import hashlib
import re
from collections import Counter

import pytest

from tallybook.llm import chunks, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, m):
    seen = Counter(tuple(w[i : i + m]) for w in words for i in range(len(w) - m + 1))
    out = []
    for w in words:
        flags = [False] * len(w)
        for i in range(len(w) - m + 1):
            if seen[tuple(w[i : i + m])] > 1:
                flags[i : i + m] = [True] * m
        out.append(flags)
    return out


@pytest.fixture(scope="module")
def rows(make_text):
    shared = make_text(1, 60)
    hot = make_text(2, 40)
    base = make_text(3, 300)
    words = base.split()
    rows = [(i, make_text(100 + i, 80) + " " + hot + "\n" + make_text(200 + i, 30)) for i in range(40)]
    rows += [(50, make_text(4, 20) + " " + shared), (51, shared + "\t" + make_text(5, 200)), (52, shared + " " + make_text(6, 10) + " " + shared)]
    rows += [(60, base), (61, base), (62, " ".join([*words[:150], "changed", *words[151:]])), (63, " ".join(words[20:90])), (64, " ".join(words[:35])), (65, " ".join(words[:34]))]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (None, make_text(7, 50)), (74, "a " * 3000), (75, make_text(8, 30000)), (76, make_text(9, 40)), (76, make_text(10, 40)), (60, base)]
    return rows


def test_removed_words(docs_of, rows):
    words = [WORD.findall(t or "") for _, t in rows]
    want = []
    for (i, _), w, flags in zip(rows, words, covered(words, 35), strict=True):
        kept = " ".join(x for x, f in zip(w, flags, strict=True) if not f)
        want.append((i, len(w), sum(flags), hashlib.sha256(kept.encode()).hexdigest()))
    got = substrings.remove_duplicates(docs_of(rows), finish=substrings.digests, schema=substrings.DIGESTS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeated_spans(docs_of, rows):
    words = [WORD.findall(t or "") for _, t in rows]
    got = {}
    for r in suffixes.repeated_spans(docs_of(rows)).collect():
        got.setdefault((r.doc_id, r.n_words), set()).update(x for s in r.spans for x in range(s.start, s.end))
    for (i, _), w, flags in zip(rows, words, covered(words, 50), strict=True):
        want = {k for k, f in enumerate(flags) if f}
        assert want <= got.get((i, len(w)), set()), i
    clean = {i for (i, _), flags in zip(rows, covered(words, 25), strict=True) if not any(flags)}
    assert not clean & {i for i, _ in got}


def test_many_equal_rows(docs_of, make_text):
    """Equal rows are each other's repeats, whatever their number, and cost what two do."""
    text = make_text(21, 300)
    rows = [(1, text)] * 600 + [(2, make_text(22, 100)), (3, " ".join(text.split()[100:180]))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.repeated_spans(docs_of(rows)).collect()}
    assert got == {1: [(0, 300)], 3: [(0, 80)]}


def test_empty(docs_of):
    assert substrings.remove_duplicates(docs_of([])).count() == 0
    assert suffixes.repeated_spans(docs_of([])).count() == 0


def test_factors_are_copies(docs_of, rows):
    docs = docs_of(rows)
    words = {r.rid: (r.doc_id, WORD.findall(r.text or "")) for r in chunks.chunked(docs).collect()}
    got = substrings.remove_duplicates(docs).collect()
    assert any(r.factors for r in got)
    for r in got:
        own = WORD.findall(next(t or "" for i, t in rows if i == r.doc_id)) if [i for i, _ in rows].count(r.doc_id) == 1 else None
        assert r.n_removed == len({w for f in r.factors for w in range(f.start, f.start + f.length)})
        for f in r.factors if own is not None else []:
            there = words[f.source][1]
            assert f.length >= substrings.WINDOW and own[f.start : f.start + f.length] == there[f.source_start : f.source_start + f.length]
            assert (words[f.source][0], f.source_start) != (r.doc_id, f.start)
