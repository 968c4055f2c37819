"""Near-duplicates against alignment of all pairs."""

import random

import numpy as np
import pytest

from tallybook.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_alignment_against_the_whole_table():
    r = random.Random(3)
    for _ in range(1500):
        a = [r.randrange(r.choice([2, 5, 50])) for _ in range(r.randrange(60))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randrange(8)):
            b.insert(r.randrange(len(b) + 1), r.randrange(50))
        d = distance(a, b)
        for most in {0, d - 1, d, d + 1, int(0.2 * max(len(a), len(b)))} - {-1}:
            assert neardup.within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (d <= most)


@pytest.fixture(scope="module")
def rows(make_text):
    rows, n = [], 0
    for g in range(6):
        base = make_text(g, 60 + 20 * g).split()
        for c in range(5):
            w = list(base)
            for k in range(c):
                w[(7 * k + 3 * c + g) % len(w)] = f"edit{g}{c}{k}"
            rows.append((n := n + 1, " ".join(w)))
        rows.append((n := n + 1, " ".join(base)))
    rows += [(100 + i, make_text(500 + i, 50)) for i in range(15)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "two words"), (204, "two words"), (205, "two wordz"), (206, None)]
    return rows


def test_classes(docs_of, rows):
    got = {r.doc_id: r.class_id for r in neardup.classes(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    cut = [(i, t.split()) for i, t in rows if t and t.strip()]
    for k, (i, a) in enumerate(cut):
        for j, b in cut[:k]:
            if a == b or (len(a) >= 5 and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(set(a) & set(b)) > 0.5 * len(set(a)) and distance(a, b) <= 0.2 * max(len(a), len(b))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == {i: find(i) for i in root}


def test_one_stays(docs_of, rows):
    docs = docs_of([*rows, rows[0]])
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == sorted({r.class_id for r in neardup.classes(docs).collect()})


def test_empty(docs_of):
    assert neardup.classes(docs_of([])).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_star_of_copies_is_one_class(docs_of, make_text):
    base = make_text(900, 200).split()
    rows = [(1000, " ".join(base))]
    for c in range(150):
        w, r = list(base), random.Random(c)
        for k in r.sample(range(200), 24):
            w[k] = f"star{c}x{k}"
        rows.append((c, " ".join(w)))
    assert all(sum(x != y for x, y in zip(base, t.split(), strict=True)) <= 40 for _, t in rows)
    far = [(2000 + i, make_text(950 + i, 200)) for i in range(5)]
    got = {r.doc_id: r.class_id for r in neardup.classes(docs_of(rows + far)).collect()}
    assert {got[i] for i, _ in rows} == {0} and all(got[i] == i for i, _ in far)


def test_short_texts_within_the_edits(docs_of, make_text):
    rows, want, r = [], {}, random.Random(4)
    for g in range(60):
        n = r.randrange(5, 31)
        base = make_text(3000 + g, n).split()
        w = list(base)
        for k in r.sample(range(n), neardup.room(n)):
            w[k] = f"short{g}x{k}"
        if g % 3 == 0:
            w = base[:2] + base[2 + neardup.room(n) :]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
        assert distance(base, w) <= 0.2 * n
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g}
    ten = make_text(4000, 10).split()
    rows += [(500, " ".join(ten)), (501, " ".join([*ten[:5], "other", *ten[6:]]))]
    assert {x.doc_id: x.class_id for x in neardup.classes(docs_of(rows)).collect()} == want | {500: 500, 501: 500}
