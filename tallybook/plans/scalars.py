"""Catalog, third part: label predicates, report comparators, ledger text and number scalars, over texts
printed from every line.  Importing it registers its queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import dates, labels, matching, money
from tallybook.functions import text as texts
from tallybook.operators import geometry, ledger
from tallybook.operators import lines as walks
from tallybook.plans import views as v
from tallybook.plans.catalog import query

#: Rows as printed, by k; p is the part's number in nine digits.  The text is the same for both engines.
_PRINTED = """CASE k WHEN 0 THEN concat('hst # ', p, ' RT0001') WHEN 1 THEN concat('GST', p) WHEN 2 THEN 'Approval  Code:' WHEN 3 THEN 'TOTAL POINTS EARNED 12' WHEN 4 THEN concat('PC ', p, ' ACTIVATED')
 WHEN 5 THEN concat('AB', p, '-', right(p, 2)) WHEN 6 THEN concat('Transaction #: ', p) WHEN 7 THEN concat('XY Member ', p) WHEN 8 THEN concat(right(p, 2), ' - Frozen Foods') WHEN 9 THEN 'SCO CheckOut'
 WHEN 10 THEN 'SUB TCTAL :' WHEN 11 THEN concat('Cashier ', right(p, 3)) WHEN 12 THEN concat(right(p, 3), ' PTS') WHEN 13 THEN concat('$', right(p, 3), ' points') WHEN 14 THEN concat('1 8 $', right(p, 1), '.59')
 WHEN 15 THEN concat('1 0 3', right(p, 1), '.59') WHEN 16 THEN concat(p, ' / ', right(p, 4), 'B') WHEN 17 THEN concat('Meat ', right(p, 2), '.99 H') WHEN 18 THEN concat('E ', p, ' KS ', description)
 WHEN 19 THEN concat(description, ' (l-pcs) Var ', right(p, 2)) ELSE description END"""
_ROWS_SQL = f"{v.LINES_SQL}, n AS (SELECT receipt_id, line_no, description, price, (receipt_id * 7 + line_no) % 22 AS k, lpad(l_partkey::VARCHAR, 9, '1') AS p FROM rl), t AS (SELECT *, {_PRINTED} AS t FROM n)"


def _rows(s, d):
    rows = v.lines(s, d).select("receipt_id", "line_no", "description", "price", ((F.col("receipt_id") * 7 + F.col("line_no")) % 22).alias("k"), F.lpad(F.col("l_partkey").cast("string"), 9, "1").alias("p"))
    return rows.withColumn("t", F.expr(_PRINTED))


_FORMATS_SQL = ", ".join(f"regexp_matches(t, '{pattern}') AS {name}" for name, pattern in labels.FORMATS.items())


@query(f"""WITH {_ROWS_SQL} SELECT receipt_id, line_no, {_FORMATS_SQL}, regexp_matches(t, '[0-9]') AS amount_shaped, regexp_matches(t, '{labels.POINTS}') AND NOT contains(t, '$') AS points_amount,
 regexp_matches(t, '{labels.LOST_RATE}') OR regexp_matches(t, '{labels.LOST_SIGNS}') AS incomplete_quantity, regexp_matches(t, '{labels.COUPON}') AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) <= 1 AS coupon_reference,
 regexp_matches(t, '{labels.TRAILING_PRICE}') AND upper(trim(split_part(t, ' ', 1))) IN ('MEAT', 'BAKERY') AS counter_label FROM t""")
def label_types(s, d):
    t = F.col("t")
    known = [labels.label(name, t).alias(name) for name in labels.FORMATS]
    more = {"amount_shaped": labels.amount_shaped(t), "points_amount": labels.points_amount(t), "incomplete_quantity": labels.incomplete_quantity(t), "coupon_reference": labels.coupon_reference(t), "counter_label": labels.counter_label(F.substring_index(t, " ", 1), t)}
    return _rows(s, d).select("receipt_id", "line_no", *known, *[c.alias(name) for name, c in more.items()])


@query(f"""WITH {_ROWS_SQL} SELECT receipt_id, line_no, CASE WHEN k = 18 THEN p WHEN k = 8 THEN right(p, 2) WHEN k = 12 THEN right(p, 3) WHEN k = 16 THEN p END AS item_number, k = 19 AS says_variable,
 CASE WHEN k = 19 THEN replace(t, '(l-pcs)', '(1-pcs)') ELSE t END AS pieces, CASE WHEN k IN (8, 12) THEN regexp_extract(t, '^[0-9]+')::BIGINT * 100 END AS dollars FROM t""")
def label_numbers(s, d):
    t = F.col("t")
    dollars = F.when(F.col("k").isin(8, 12), money.whole_dollars(F.regexp_extract(t, "^[0-9]+", 0)))
    return _rows(s, d).select("receipt_id", "line_no", labels.leading_item_number(t).alias("item_number"), labels.says_variable(t).alias("says_variable"), labels.piece_counts(t).alias("pieces"), dollars.alias("dollars"))


#: What a live run reads of a description, by k.
_READ = """CASE k % 6 WHEN 0 THEN lower(description) WHEN 1 THEN concat('12345 ', replace(description, 'O', '0')) WHEN 2 THEN replace(description, 'E', 'F') WHEN 3 THEN '' WHEN 4 THEN concat(left(description, 4), '-', substr(description, 5)) ELSE 'SOMETHING ELSE' END"""
_SHOWN = "CASE WHEN k % 2 = 0 THEN concat((price // 100)::VARCHAR, '.', lpad((price % 100)::VARCHAR, 2, '0')) ELSE (price // 100)::VARCHAR END"
_NAME = "upper(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_ITEM = "regexp_replace(regexp_replace(replace(upper({}), 'O', '0'), '^[0-9]+\\s+', ''), '\\s+', '', 'g')"
_HOLDS = "(contains({0}, {1}) OR contains({1}, {0}))"
_CATEGORY = {"GEAR": "home/tools", "BOLT": "home/hardware", "ROD": "home/hardware"}
_ACCOUNT_SQL = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in _CATEGORY.items()) + " ELSE {} END"


@query(f"""WITH {_ROWS_SQL}, r AS (SELECT *, {_READ} AS got, {_SHOWN} AS shown, split_part(description, ' ', 2) AS want_c, CASE WHEN k % 3 = 0 THEN 'BOLT' ELSE split_part(description, ' ', 1) END AS got_c FROM t),
q AS (SELECT *, {_NAME.format('description')} AS en, {_NAME.format('got')} AS an, {_ITEM.format('description')} AS ei, {_ITEM.format('got')} AS ai FROM r)
SELECT receipt_id, line_no, en <> '' AND an <> '' AND ({_HOLDS.format('en', 'an')} OR (greatest(length(en), length(an)) - levenshtein(en, an)) / greatest(length(en), length(an), 1) >= 0.85) AS merchant,
 ei <> '' AND {_HOLDS.format('ai', 'ei')} AS item, description <> '' AND {_HOLDS.format('upper(got)', 'upper(description)')} AS description, CASE WHEN k % 2 = 0 THEN true ELSE price % 100 = 0 END AS price,
 {_HOLDS.format('want_c', 'got_c')} OR {_ACCOUNT_SQL.format('want_c', 'want_c')} = {_ACCOUNT_SQL.format('got_c', 'got_c')} AS category, regexp_replace(shown, '[^0-9]', '', 'g') AS digits,
 CASE WHEN length(description) <= 9 THEN description ELSE left(description, 8) || '…' END AS short FROM q""")
def report_matches(s, d):
    read = F.expr(_READ)
    shown = F.expr(_SHOWN.replace("//", "div").replace("::VARCHAR", "::STRING"))
    want, got = F.split_part("description", F.lit(" "), F.lit(2)), F.when(F.col("k") % 3 == 0, "BOLT").otherwise(F.split_part("description", F.lit(" "), F.lit(1)))
    rows = _rows(s, d).select("receipt_id", "line_no", "description", "price", read.alias("got"), shown.alias("shown"), want.alias("want_c"), got.alias("got_c"))
    e, a = F.col("description"), F.col("got")
    return rows.select(
        "receipt_id", "line_no", matching.names_match(e, a).alias("merchant"), matching.items_match(e, a).alias("item"), matching.descriptions_match(e, a).alias("description"), matching.prices_match(F.col("shown"), F.col("price")).alias("price"),
        matching.categories_match(F.col("want_c"), F.col("got_c"), _CATEGORY).alias("category"), matching.digits(F.col("shown")).alias("digits"), matching.shortened(e, 9).alias("short"),
    )


_STORE = "CASE o_custkey % 6 WHEN 0 THEN 'Costco Wholesale' WHEN 1 THEN ' Fresh ' WHEN 2 THEN 'No Frills #3' WHEN 3 THEN '' WHEN 4 THEN 'rcss 12' ELSE merchant END"
_PLACE = "CASE o_custkey % 4 WHEN 0 THEN 'British Columbia' WHEN 1 THEN 'b.c.' WHEN 2 THEN 'Ontario' ELSE 'ON' END"
_KIND = "CASE o_custkey % 5 WHEN 0 THEN 'gift_card' WHEN 1 THEN 'cash' WHEN 2 THEN 'store_credit' WHEN 3 THEN 'credit_card' ELSE 'other' END"


@query(f"""WITH {v.HEADERS_SQL}, r AS (SELECT *, {_STORE} AS store, {_PLACE} AS place, {_KIND} AS kind FROM rh)
SELECT receipt_id, CASE o_custkey % 6 WHEN 0 THEN 'Costco' WHEN 1 THEN 'Bestco Fresh' WHEN 2 THEN 'No Frills' WHEN 3 THEN '(unknown)' WHEN 4 THEN 'Real Canadian' ELSE merchant END AS chain,
 o_custkey % 4 IN (0, 1) AS region, o_custkey % 4 = 1 AS city, CASE kind WHEN 'gift_card' THEN 'Assets:GiftCards:PENDING' WHEN 'cash' THEN 'Assets:Cash:PENDING' WHEN 'store_credit' THEN 'Assets:StoreCredit:PENDING' ELSE 'Liabilities:CreditCard:PENDING' END AS account,
 replace(replace(merchant || chr(10) || kind, chr(10), ' '), chr(13), ' ') AS comment, o_custkey % 3 <> 0 AS in_ledger, left(trim('  ' || repeat(merchant || ' ', 9)), 80) AS context, CASE WHEN o_custkey % 3 = 0 THEN lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS card,
 CASE WHEN total % 7 = 0 THEN 100.0 ELSE 100.0 * (total % 5) / (total % 7) END AS share FROM r""")
def ledger_scalars(s, d):
    rows = v.headers(s, d).select("*", F.expr(_STORE).alias("store"), F.expr(_PLACE).alias("place"), F.expr(_KIND).alias("kind"))
    comment = F.concat("merchant", F.lit("\n"), "kind")
    warning = F.when(F.col("o_custkey") % 3 == 0, "uncategorized_item").otherwise("total_mismatch")
    number = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    slip = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("CARD *******"), F.lit(" "), number, F.lit(" VISA"))).otherwise(F.concat(F.lit("PAN *"), number, F.lit(" ** 12345")))
    return rows.select(
        "receipt_id", matching.chain(F.col("store")).alias("chain"), matching.details_match(F.lit("region"), F.lit("BC"), F.col("place")).alias("region"), matching.details_match(F.lit("city"), F.lit("BC"), F.col("place")).alias("city"),
        ledger.pending_account(F.col("kind")).alias("account"), ledger.comment_text(comment).alias("comment"), ledger.in_ledger_text(warning).alias("in_ledger"), texts.context(F.concat(F.lit("  "), F.repeat(F.concat("merchant", F.lit(" ")), F.lit(9)))).alias("context"),
        ledger.card_digits(slip).alias("card"), matching.percent(F.col("total") % 5, F.col("total") % 7).alias("share"),
    )


_SCALED = "concat(CASE WHEN k % 2 = 0 THEN '-' ELSE '' END, right(p, 3), CASE WHEN k % 3 = 0 THEN '' ELSE concat('.', right(p, 1 + CAST(k % 7 AS INT))) END)"


@query(f"""WITH {_ROWS_SQL}, r AS (SELECT *, {_SCALED} AS num, right(p, 3)::BIGINT AS whole, CASE WHEN k % 3 = 0 THEN '' ELSE right(p, 1 + CAST(k % 7 AS INT)) END AS part FROM t)
SELECT receipt_id, line_no, (CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) * (whole * 10000 + left(rpad(part, 5, '0'), 4)::BIGINT + CASE WHEN substr(rpad(part, 5, '0'), 5, 1) >= '5' THEN 1 ELSE 0 END) AS scaled,
 price - whole AS less, CASE WHEN k % 2 = 1 THEN NULL ELSE 9223372036854775807 - price END AS edge, (whole % 4 = 0 AND whole % 100 <> 0) OR whole % 400 = 0 AS leap, 2000 + whole AS year, 1 + k % 12 AS month, 28::BIGINT AS day, regexp_replace(upper(t), '[^A-Z0-9]', '', 'g') AS letters FROM r""")
def number_scalars(s, d):
    rows = _rows(s, d).withColumn("num", F.expr(_SCALED)).withColumn("whole", F.expr("right(p, 3)").cast("bigint"))
    top, day = F.lit(9223372036854775807), F.make_date((2000 + F.col("whole")).cast("int"), (1 + F.col("k") % 12).cast("int"), F.lit(28))
    edge = F.when(F.col("k") % 2 == 1, money.less(-top, F.col("price") + 1)).otherwise(money.less(top, F.col("price")))
    rows = rows.withColumn("ymd", dates.ymd(day))
    return rows.select("receipt_id", "line_no", money.scaled(F.col("num"), 4).alias("scaled"), money.less(F.col("price"), F.col("whole")).alias("less"), edge.alias("edge"), dates.is_leap_year(F.col("whole")).alias("leap"), *[F.get("ymd", F.lit(i)).alias(name) for i, name in enumerate(("year", "month", "day"))], texts.letters(F.col("t")).alias("letters"))


#: Lines with dates and what they are for, by (receipt_id + line_no) % 9; the text is the same for both engines.
_DATED = """CASE k WHEN 0 THEN 'Return by date' WHEN 1 THEN concat('20', right(p, 2), '-0', CAST(line_no AS {0}), '-15') WHEN 2 THEN concat('Contest  closes ', 'Feb ', right(p, 1), '1, 2026') WHEN 3 THEN concat(right(p, 1), ' September 2025')
 WHEN 4 THEN concat('2026-03-0', right(p, 1), ' 2', right(p, 1), ':05') WHEN 5 THEN concat('no 2025', right(p, 2), '31 end') WHEN 6 THEN '2026/03/07 23:59:01' WHEN 7 THEN concat(description, ' 12. 50 ', right(p, 2), '.99') ELSE description END"""
_DATED_SQL = f"{v.LINES_SQL}, n AS (SELECT receipt_id, line_no, description, (receipt_id + line_no) % 9 AS k, lpad(l_partkey::VARCHAR, 9, '1') AS p FROM rl), t AS (SELECT *, {_DATED.format('VARCHAR')} AS t FROM n)"
_HAS_DATE = "(" + " OR ".join(f"regexp_matches(?, '{x}')" for x in (dates.SEPARATED, dates.COMPACT, dates.MONTH_FIRST, dates.DAY_FIRST)) + ")"


def _dated(s, d):
    rows = v.lines(s, d).select("receipt_id", "line_no", "description", ((F.col("receipt_id") + F.col("line_no")) % 9).alias("k"), F.lpad(F.col("l_partkey").cast("string"), 9, "1").alias("p"))
    return rows.withColumn("t", F.expr(_DATED.format("STRING")))


@query(f"""WITH {_DATED_SQL}, a AS (SELECT *, coalesce(lag(t) OVER w, '') AS t1, coalesce(lag(t, 2) OVER w, '') AS t2 FROM t WINDOW w AS (PARTITION BY receipt_id ORDER BY line_no)),
b AS (SELECT *, {_HAS_DATE.replace('(?,', '(t1,')} AS d1, {_HAS_DATE.replace('(?,', '(t2,')} AS d2, upper(t2 || ' ' || t1 || ' ' || t) AS near FROM a)
SELECT receipt_id, line_no, contains(near, 'DATE') AND (contains(near, 'RETURN') OR contains(near, 'RETOUR')) AND NOT d1 AND NOT d2 AS return_by,
 regexp_matches(t, '{dates.CONTEST}') OR (NOT d1 AND regexp_matches(t1, '{dates.CONTEST}')) OR (NOT d1 AND NOT d2 AND regexp_matches(t2, '{dates.CONTEST}')) AS contest_end FROM b""")
def deadline_lines(s, d):
    return walks.deadline_context(_dated(s, d), "receipt_id", "line_no", "t").select("receipt_id", "line_no", "return_by", "contest_end")


@query(f"""WITH {_DATED_SQL}, w AS (SELECT receipt_id, line_no, t, k, p, CASE k WHEN 2 THEN try_strptime('2026-02-' || right(p, 1) || '1', '%Y-%m-%d') WHEN 3 THEN try_strptime('2025-09-0' || right(p, 1), '%Y-%m-%d')
 WHEN 5 THEN CASE WHEN right(p, 2) IN ('01', '03', '05', '07', '08', '10', '12') THEN try_strptime('2025-' || right(p, 2) || '-31', '%Y-%m-%d') END END AS day FROM t)
SELECT receipt_id, line_no, strftime(day, '%Y-%m-%d') AS written, CASE WHEN k = 7 THEN greatest(1250, right(p, 2)::BIGINT * 100 + 99) END AS largest FROM w""")
def written_dates(s, d):
    t = F.col("t")
    return _dated(s, d).select("receipt_id", "line_no", F.date_format(dates.written_date(t), "yyyy-MM-dd").alias("written"), F.when(F.col("k") == 7, texts.largest_price(t)).alias("largest"))


@query(f"""WITH {_DATED_SQL}, c AS (SELECT receipt_id, line_no, (line_no * 37) % 100 AS confidence, CASE k WHEN 4 THEN try_strptime('2026-03-0' || right(p, 1), '%Y-%m-%d') WHEN 6 THEN strptime('2026-03-07', '%Y-%m-%d') END AS day FROM t WHERE k = 6 OR (k = 4 AND right(p, 1) IN ('0', '1', '2', '3'))),
g AS (SELECT receipt_id FROM c WHERE day IS NOT NULL GROUP BY 1 HAVING min(day) = max(day))
SELECT receipt_id, line_no AS det_idx, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY confidence DESC, line_no DESC) AS n FROM c JOIN g USING (receipt_id) WHERE day IS NOT NULL) WHERE n = 1""")
def header_timestamps(s, d):
    rows = _dated(s, d).select("receipt_id", F.col("line_no").alias("det_idx"), F.col("t").alias("text"), ((F.col("line_no") * 37) % 100).alias("confidence"))
    return walks.agreed_timestamp(rows).select("receipt_id", "det_idx", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {v.BOXES_SQL}, o AS (SELECT *, y0 + y1 AS c2 FROM det WHERE det_idx % 2 = 0), g AS (SELECT *, c2 - lag(c2) OVER w AS gap FROM o WINDOW w AS (PARTITION BY receipt_id ORDER BY c2, det_idx)),
r AS (SELECT *, CAST(sum(CASE WHEN gap > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY receipt_id ORDER BY c2, det_idx) AS BIGINT) AS row_no FROM g), s AS (SELECT receipt_id, row_no, min(y0) AS top, max(y1) AS bottom, avg(y0 + y1) AS middle2 FROM r GROUP BY 1, 2),
b AS (SELECT * FROM det WHERE det_idx % 2 = 1)
SELECT b.receipt_id, b.det_idx, s.row_no, round(greatest(least(y1, bottom) - greatest(y0, top), 0) / greatest(least(y1 - y0, bottom - top), 0.000001), 6)::DOUBLE AS overlap, (y0 + y1 BETWEEN 2 * top AND 2 * bottom) OR (middle2 BETWEEN 2 * y0 AND 2 * y1) AS centres_agree,
 greatest(2 * top - y0 - y1, y0 + y1 - 2 * bottom, 0) / 2 AS away FROM b JOIN s ON b.receipt_id = s.receipt_id WHERE y0 <= bottom + 20 AND y1 >= top - 20""")
def line_distance(s, d):
    x = v.boxes(s, d)
    return geometry.to_lines(x.where("det_idx % 2 = 1"), geometry.line_spans(geometry.row_clusters(x.where("det_idx % 2 = 0"), 12)), 20)


_SCORE = "(l_partkey * 7 + step * 13 + class * class * 29 + step * class * 3) % 101"


@query(f"""WITH {v.LINES_SQL}, c AS (SELECT receipt_id * 100 + line_no AS id, step, class, {_SCORE} AS score FROM rl, (SELECT unnest(range(1, 9)) AS step), (SELECT unnest(range(0, 4)) AS class)),
b AS (SELECT id, step, class, score FROM (SELECT *, row_number() OVER (PARTITION BY id, step ORDER BY score DESC, class DESC) AS n FROM c) WHERE n = 1), l AS (SELECT *, lag(class) OVER (PARTITION BY id ORDER BY step) AS before FROM b)
SELECT id, coalesce(string_agg(class::VARCHAR, '|' ORDER BY step) FILTER (class <> 0 AND (before IS NULL OR before <> class)), '') AS classes, round(coalesce(avg(score) FILTER (class <> 0 AND (before IS NULL OR before <> class)), 0), 6) AS confidence FROM l GROUP BY id""")
def ctc_best_path(s, d):
    score = lambda step, c: F.expr(_SCORE.replace("step", str(step)).replace("class", str(c)))
    matrix = F.array(*[F.array(*[score(step, c) for c in range(4)]) for step in range(1, 9)])
    rows = v.lines(s, d).select((F.col("receipt_id") * 100 + F.col("line_no")).alias("id"), matrix.alias("scores"))
    return walks.best_path(rows, "id")
