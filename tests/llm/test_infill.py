"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import infill

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_version(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def random_texts():
    r = random.Random(3)
    letters = [*"aaabZ  .,<>PSM19\n\t\x00é日😀Ωß", "<P", "<S>", "word", " the", "<" * 5]
    sizes = [*range(40), 250, 251, 255, 256, 257, 511, 512, 513, 1023, 1024, 5000]
    for size in sizes * 3:
        yield "".join(r.choice(letters[:-5] if r.random() < 0.8 else letters) for _ in range(size))[:size]
    for wide in ("é", "日", "😀", "a", "<"):
        for size in (63, 64, 84, 85, 86, 127, 128, 255, 256, 257, 700):
            yield wide * size


def test_equal_to_the_plain_version(docs_of):
    rows = [(k, t) for k, t in enumerate(random_texts())] + [(-5, None), (-6, ""), (None, "no id here"), (7, "twice"), (7, "twice"), (-8, "long text, " * 40_000)] + [(1000 + k, "equal text of many rows") for k in range(500)]
    got = infill.transform(docs_of(rows))
    back = got.select("output", infill.restored(got.output, got.form).alias("text")).collect()
    want = [plain_version(i, t) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in rows)
    assert infill.transform(docs_of([])).count() == 0


def test_state_depends_on_few_bytes():
    """Any state before WARM bytes of valid text ends in the same state, and a reset ends in one state at once."""
    tails = [x.encode() for x in ("abcd", "  <P", "a<Sx", "<<<M", "x日", "😀", "é<P", "..\n.", "éé")]
    for tail in tails:
        assert len(tail[-infill.WARM :]) == infill.WARM
        ends = set()
        for state in range(7):
            for byte in tail[-infill.WARM :]:
                state = infill.AFTER[state * 256 + byte] // 256
            ends.add(state)
        assert len(ends) == 1
    assert set(infill.AFTER.reshape(7, 256)[:, infill.RESET].tolist()) == {infill.CLEAR}


def test_every_cut():
    texts = ["ab, c<P d日😀e" * 60, "", "x", None, "." * 256]
    scan = infill.Scan(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        units = UNITS.findall(text or "")
        assert scan.n[k] == len(units)
        which = np.full(len(units) + 1, k)
        place, chars = scan.cuts(which, np.arange(len(units) + 1))
        assert chars.tolist() == [len("".join(units[:u])) for u in range(len(units) + 1)]
        assert place.tolist() == [len("".join(units[:u]).encode()) for u in range(len(units) + 1)]


def test_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(infill.ORACLE)
    got = infill.digests(infill.transform(spark.read.parquet(f"{sf}/documents.parquet"))).select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
