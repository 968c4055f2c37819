"""Operators on hand-made relations: ties, empties, ambiguity."""

import pytest
from pyspark.sql import functions as F

from tallybook.operators import balance, classify, geometry, giftcards, ledger, lines, merchant, page, recover, report


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def boxes(spark, data):
    return spark.createDataFrame(data, "receipt_id long, det_idx int, x0 int, x1 int, y0 int, y1 int, text string, confidence int")


def test_match_rank_and_subtraction(spark):
    rules = spark.createDataFrame(
        [("a", 0, ["MILK"], 10, False, "food", ["b"]), ("b", 1, ["CHOC MILK"], 10, False, "sweets", []), ("c", 2, ["OAT"], 10, True, "food/oat", [])],
        "rule_id string, rule_index int, keywords array<string>, priority int, exact_only boolean, path string, disables array<string>",
    )
    items = spark.createDataFrame([(1, "CHOC MILK"), (2, "OATMILK"), (3, "OAT"), (4, "")], "item_id long, description string")
    found = classify.matches(items, rules)
    assert rows(classify.rank(found).select("item_id", "rule_id", "match_rank")) == [(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 1)]
    assert rows(classify.subtract(found, rules).select("item_id", "rule_id")) == [(1, "a"), (2, "a"), (3, "c")]
    accounts = spark.createDataFrame([("food", "Food")], "path string, account string")
    assert rows(classify.winners(found, accounts)) == [(1, "sweets", None), (2, "food", "Food"), (3, "food/oat", None)]
    assert rows(classify.nearest_account(spark.createDataFrame([("food/oat",), ("toys",)], "path string"), accounts)) == [("food/oat", "Food"), ("toys", None)]
    assert classify.matches(items.limit(0), rules).count() == 0


def test_prefix_fallback_abstains(spark):
    rules = spark.createDataFrame([("a", 0, ["CHICKEN"], 1, False, "meat", []), ("b", 1, ["CHICORY"], 1, False, "veg", [])], "rule_id string, rule_index int, keywords array<string>, priority int, exact_only boolean, path string, disables array<string>")
    accounts = spark.createDataFrame([("meat", "M"), ("veg", "V")], "path string, account string")
    items = spark.createDataFrame([(1, "ROAST CHICK"), (2, "ROAST CHIC"), (3, "CHICK")], "item_id long, description string")
    assert rows(classify.prefix_fallback(items, rules, accounts, line_length=8)) == [(1, "M")]


def test_balance(spark):
    receipts = spark.createDataFrame([(1, 110, 10, 100), (2, 50, None, None), (3, 0, None, None)], "receipt_id long, total long, tax long, subtotal long")
    items = spark.createDataFrame([(1, 60), (1, 40), (2, 30)], "receipt_id long, price long")
    assert rows(balance.balance_warnings(receipts, items)) == [(2, "items_total", -20), (3, "no_items", 0)]
    amounts = spark.createDataFrame([(1, 100), (1, 10), (1, 110), (2, 60), (2, 50)], "receipt_id long, amount long")
    totals = spark.createDataFrame([(1, 110), (2, 110)], "receipt_id long, total long")
    assert rows(balance.summary_shift(amounts, totals)) == [(1, 100, 10)]
    paid = spark.createDataFrame([(1, 100), (2, 10)], "receipt_id long, amount long")
    back = spark.createDataFrame([(1, 30), (2, 50)], "receipt_id long, amount long")
    assert rows(balance.tendered_net(paid, back)) == [(1, 70), (2, 10)]


def test_slip_echoes_are_a_multiset(spark):
    data = [(1, 1, "card", 5, False), (1, 2, "card", 5, True), (1, 3, "card", 5, True), (1, 4, "cash", 5, True)]
    df = spark.createDataFrame(data, "receipt_id long, line_no int, kind string, amount long, is_slip boolean")
    assert rows(balance.slip_echoes_dropped(df).select("line_no")) == [(1,), (3,), (4,)]


def test_line_walks(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(["x", "A", "x", "reset", "x", "B", "x"])], "k long, o int, t string")
    banner = F.when(F.col("t") == "reset", "").when(F.col("t") != "x", F.col("t"))
    assert [r.department for r in lines.carried(df, "k", "o", banner).orderBy("o").collect()] == [None, "A", "A", None, None, "B", "B"]
    runs = spark.createDataFrame([(1, k, t) for k, t in enumerate("aab-ba")], "k long, o int, t string")
    assert rows(lines.collapsed_runs(runs, "k", "o", "t", "-")) == [(1, "a|b|b|a")]


def test_geometry(spark):
    b = boxes(spark, [(1, 0, 0, 50, 0, 20, "MILK", 99), (1, 1, 400, 450, 4, 24, "4.99", 99), (1, 2, 0, 50, 40, 60, "BREAD", 40), (1, 3, 400, 450, 41, 61, "2.00", 99), (2, 0, 0, 50, 0, 20, "ALONE", 40)])
    assert rows(geometry.quality_filtered(b, 70).select("receipt_id", "det_idx")) == [(1, 0), (1, 1), (1, 2), (1, 3)]
    clustered = geometry.row_clusters(b, 12)
    assert rows(geometry.lowered(clustered).select("receipt_id", "line")) == [(1, "BREAD 2.00"), (1, "MILK 4.99"), (2, "ALONE")]
    assert rows(geometry.upper_median(b, F.col("y1"), "m")) == [(1, 60), (2, 20)]
    near = geometry.nearest_row(b.where("det_idx % 2 = 1"), b.where("det_idx % 2 = 0"), 50)
    assert rows(near.select("target_idx", "row_idx")) == [(1, 0), (3, 2)]


@pytest.mark.parametrize("n", [0, 3, 6])
def test_tilted_lines(spark, n):
    """Rows that drop by a twentieth of their run are levelled before they are paired."""
    rows = []
    for k in range(n):
        for x0, text in ((50.0, f"ITEM {k}"), (400.0, f"{k}.00")):
            top = 90 + 30 * k + 0.05 * (x0 + 25)
            rows.append(("r", len(rows), x0, x0 + 50, top, top + 20, top + 10, text, 0.9, 500, 500))
    df = spark.createDataFrame(rows, "receipt_id string, det_idx int, x0 double, x1 double, y0 double, y1 double, cy double, text string, confidence double, page_w int, page_h int")
    got = page.printed_lines(df).orderBy("line_no").collect()
    assert [(r.text, r.amount) for r in got] == [(f"ITEM {k}", f"{k}.00") for k in range(n)]


def test_recovery_and_matching():
    assert recover.fitting([[(100, 0), (150, 1)], [(200, 0)]], 350) == [150, 200]
    assert recover.fitting([[(100, 0), (200, 0)], [(200, 0), (100, 0)]], 300) is None
    assert recover.fitting([[(100, 0)]], 50) is None
    assert recover.largest_matching([[0], [0, 1], [1, 2]]) == [0, 1, 2]
    assert recover.largest_matching([[0], [0]]).count(None) == 1


def test_gift_cards(spark):
    tenders = spark.createDataFrame([(1, 1), (1, 4)], "receipt_id long, line_no int")
    data = [(1, 1, None, None), (1, 2, "*12", "A"), (1, 3, "*12", None), (1, 4, None, None), (1, 5, "*7", None), (1, 6, "*8", "B")]
    evidence = spark.createDataFrame(data, "receipt_id long, line_no int, card string, approval string")
    assert rows(giftcards.redemptions(tenders, evidence, 9)) == [(1, 1, "*12", "A", ""), (1, 4, None, "B", "card")]


def test_ledger(spark):
    df = spark.createDataFrame([('say "hi"\\\nnow',)], "t string")
    assert df.select(ledger.escaped(F.col("t"))).first()[0] == "say 'hi'\\\\ now"
    old = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id long, name string, total long")
    edit = spark.createDataFrame([(1, "b", None), (2, None, 6)], "id long, name string, total long")
    assert rows(ledger.corrected(old, edit, "id", ["name", "total"])) == [(1, "b", 5, "name"), (2, None, 6, "")]


def test_merchants(spark):
    heads = spark.createDataFrame([(1, "C0STCO"), (2, "ZZZ")], "header_id long, header string")
    names = spark.createDataFrame([("COSTCO",), ("FRESHCO",)], "canonical string")
    from tallybook.functions import fuzzy

    got = {r.header_id: r for r in merchant.resolve_fuzzy(heads, names, fuzzy.similarity).collect()}
    assert got[1].canonical == "COSTCO" and got[1].status == "corrected" and got[2].status == "unknown"


def test_reports(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert report.exact_sample(df, "k", 7, 1).count() == 7 and rows(report.exact_sample(df, "k", 7, 1)) == rows(report.exact_sample(df, "k", 7, 1))
    a = boxes(spark, [(1, 0, 0, 10, 0, 10, "a", 1), (1, 1, 50, 60, 0, 10, "b", 1)])
    assert rows(report.box_recall(a, a.where("det_idx = 0"))) == [(1, 2, 1)]
