"""The filter audit against a plain version."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallybook.llm import audit


def plain_version(docs, labels):
    good, toxic = ({i for i, *says in labels if says[k] == 1 and i is not None} for k in (0, 1))
    out = Counter()
    parts = {source or "" for _, _, source in docs}
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        failed["E"] = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs)
        fails.append((source or "", i, failed))
    for order in map("".join, permutations("ABCDE")):
        for part, i, failed in fails:
            gone = False
            for step, name in enumerate(order, 1):
                key = (part, order, step)
                if failed[name]:
                    out[*key, "redundant" if gone else "removed"] += 1
                    if not gone:
                        out[*key, "good_lost"] += i in good
                        out[*key, "toxic_lost"] += i in toxic
                        out[part, name, "shapley"] += 1
                    out[*key, "unique_fails"] += sum(failed.values()) == 1
                gone |= failed[name]
                out[*key, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, s, *(out[p, o, s, n] for n in names), out[p, o[s - 1], "shapley"]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6))


def some_documents():
    r = random.Random(4)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice((3, 49, 50, 60, 120)))) + r.choice(("", " $", "\n|", " ABCDEFGHIJKLMNOP", "\x0bX\xa0Y")) for _ in range(25)]
    rows = [(k, r.choice(texts), r.choice(("a", "b", "", None))) for k in range(-60, 60)]
    rows += [(None, texts[0], "a"), (None, texts[0], "a"), (5, rows[65][1], "a"), (5, rows[65][1], "a"), (999, None, "a"), (998, "", "c"), (997, " \n", "c")]
    rows += [(2000 + k, "one text in many rows " * 20, "hot") for k in range(300)] + [(3000, "one row many times", "hot")] * 200 + [(4000, "word " * 100_000, "long")]
    labels = [(k, r.randrange(2), r.randrange(2)) for k in range(-60, 60, 2)] + [(3, 0, None), (3, 1, 0), (None, 1, 1), (2001, 1, 1), (123456, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_equal_to_the_plain_version(spark, partitions):
    rows, labels = some_documents()
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, mask int, `head` string")
    says = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.report(audit.counters(docs, says, partitions))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_version(rows, labels)


def test_different_texts_of_one_fingerprint(spark, monkeypatch):
    """Texts that share a fingerprint, over many partitions."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    r = random.Random(5)
    rows = [(k, r.choice("xyz"), "a") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {i for i, mask in audit.masks(docs, 9).select("doc_id", "mask").collect() if mask & audit.COPY}
    firsts = {min(i for i, t, _ in rows if t == x) for x in "xyz"}
    assert copies == set(range(200)) - firsts


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.report(audit.counters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(audit.ORACLE)
    got = audit.report(audit.counters(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))).select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
