"""Price options and subset recovery over all lines, against brute force."""

import itertools

from pyspark.sql import functions as F

from tallybook.plans import evidence, views


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def few_lines(spark, sf, monkeypatch):
    lines = views.lines(spark, sf)
    ids = [r[0] for r in lines.select("receipt_id").distinct().orderBy("receipt_id").limit(25).collect()]
    few = lines.where(F.col("receipt_id").isin(ids))
    monkeypatch.setattr(evidence.v, "lines", lambda s, d: few)
    return few.collect()


def test_options_of_all_lines(spark, sf, monkeypatch):
    want = set()
    for r in few_lines(spark, sf, monkeypatch):
        seen = f"{r.price % 100:02d}".translate(str.maketrans("0158", "OISB")) + ("1" if r.l_partkey % 3 == 0 else "")
        want |= {(r.receipt_id * 100 + r.line_no, r.price // 100 * 100 + x, n) for x in range(100) if (n := edits(f"{x:02d}", seen)) <= 2}
    assert {tuple(r) for r in evidence.malformed_options(spark, sf).select("id", "cents", "score").collect()} == want


def test_recovery_of_all_lines(spark, sf, monkeypatch):
    receipts = {}
    for r in few_lines(spark, sf, monkeypatch):
        receipts.setdefault(r.receipt_id, {})[r.line_no] = r.price
    want = set()
    for receipt, prices in receipts.items():
        tries = [[(p // 100 * 100 + x, abs(x - p % 100)) for x in {0, 25, 50, 75, p % 100}] for _, p in sorted(prices.items())]
        fit = [(sum(s for _, s in c), tuple(x for x, _ in c)) for c in itertools.product(*tries) if sum(x for x, _ in c) == sum(prices.values())]
        least = [c for s, c in fit if s == min(fit)[0]]
        if len(least) == 1:
            want |= {(receipt, n, x) for n, x in zip(sorted(prices), least[0], strict=True)}
    assert max(map(len, receipts.values())) > 2
    assert {tuple(r) for r in evidence.subset_recovery(spark, sf).collect()} == want
