"""Catalog, second part: quantities, recovery, gift-card evidence, store details, image geometry,
ledger extras.  Importing it registers its queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import details, quantity, shapes
from tallybook.functions import text as texts
from tallybook.operators import giftcards, ledger, merchant, recover
from tallybook.plans import views as v
from tallybook.plans.catalog import query
from tallybook.session import table

_Q = "CAST(l_quantity AS BIGINT)"
_QTY_SQL = f"""q AS (SELECT receipt_id, line_no, price, l_partkey, CASE l_partkey % 4
 WHEN 0 THEN {_Q} || ' @ $' || (price // {_Q} // 100) || '.' || lpad((price // {_Q} % 100)::VARCHAR, 2, '0')
 WHEN 1 THEN '(' || {_Q} || ' FOR ' || (price // 100) || '.' || lpad((price % 100)::VARCHAR, 2, '0')
 WHEN 2 THEN {_Q} || '.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || ' k9 @ $6.59 / kg' ELSE description END AS t FROM rl)"""


def _quantities(s, d):
    q, p = F.col("l_quantity").cast("bigint"), F.col("price")
    each = F.floor(p / q)
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    k = F.col("l_partkey") % 4
    printed = (
        F.when(k == 0, F.concat(q.cast("string"), F.lit(" @ $"), F.floor(each / 100).cast("string"), F.lit("."), two(each)))
        .when(k == 1, F.concat(F.lit("("), q.cast("string"), F.lit(" FOR "), F.floor(p / 100).cast("string"), F.lit("."), two(p)))
        .when(k == 2, F.concat(q.cast("string"), F.lit("."), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(" k9 @ $6.59 / kg")))
        .otherwise(F.col("description"))
    )
    return v.lines(s, d).select("receipt_id", "line_no", "price", "l_partkey", printed.alias("t"))


@query(f"""WITH {v.LINES_SQL}, {_QTY_SQL}, p AS (SELECT *, CASE WHEN regexp_matches(lower(t), '{quantity.WEIGHT}') THEN 'weight' WHEN regexp_matches(lower(t), '{quantity.COUNT}') THEN 'count' WHEN regexp_matches(lower(t), '{quantity.OFFER}') THEN 'offer' END AS pattern FROM q),
x AS (SELECT *, CASE pattern WHEN 'count' THEN regexp_extract(lower(t), '{quantity.COUNT}', 1)::BIGINT WHEN 'offer' THEN regexp_extract(lower(t), '{quantity.OFFER}', 1)::BIGINT END AS n,
 CASE WHEN pattern = 'weight' THEN (regexp_extract(lower(t), '{quantity.WEIGHT}', 1) || regexp_extract(lower(t), '{quantity.WEIGHT}', 2))::BIGINT END AS milli,
 CASE pattern WHEN 'weight' THEN (regexp_extract(lower(t), '{quantity.WEIGHT}', 3) || regexp_extract(lower(t), '{quantity.WEIGHT}', 4))::BIGINT WHEN 'count' THEN (regexp_extract(lower(t), '{quantity.COUNT}', 2) || regexp_extract(lower(t), '{quantity.COUNT}', 3))::BIGINT WHEN 'offer' THEN (regexp_extract(lower(t), '{quantity.OFFER}', 2) || regexp_extract(lower(t), '{quantity.OFFER}', 3))::BIGINT END AS cents FROM p)
SELECT receipt_id, line_no, pattern, n AS count, milli, cents, CASE pattern WHEN 'weight' THEN abs((milli * cents + 500) // 1000 - price) <= 3 WHEN 'count' THEN abs(n * cents - price) <= 2 WHEN 'offer' THEN abs(cents - price) <= 2 END AS extends FROM x""")
def quantity_parse(s, d):
    rows = _quantities(s, d).withColumn("q", quantity.parsed(F.col("t")))
    return rows.select("receipt_id", "line_no", "q.*", quantity.extends_to(F.col("q"), F.col("price")).alias("extends"))


@query(f"WITH {v.LINES_SQL}, {_QTY_SQL}, e AS (SELECT receipt_id, count(*) FILTER (l_partkey % 4 = 0 AND price % 3 <> 0) AS unreconciled, bool_or(l_partkey % 50 = 1) AS priced_header FROM q GROUP BY 1) SELECT receipt_id, unreconciled, priced_header, priced_header OR unreconciled >= 3 AS drifts FROM e")
def drift_evidence(s, d):
    rows = v.lines(s, d).groupBy("receipt_id").agg(F.count_if((F.col("l_partkey") % 4 == 0) & (F.col("price") % 3 != 0)).alias("unreconciled"), F.bool_or(F.col("l_partkey") % 50 == 1).alias("priced_header"))
    return rows.withColumn("drifts", F.col("priced_header") | (F.col("unreconciled") >= 3))


@query(f"""WITH {v.LINES_SQL}, c AS (SELECT receipt_id * 100 + line_no AS id, price // 100 AS whole, translate(lpad((price % 100)::VARCHAR, 2, '0'), '0158', 'OISB') || CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '' END AS observed FROM rl),
e AS (SELECT observed, dd, levenshtein(lpad(dd::VARCHAR, 2, '0'), observed) AS score FROM (SELECT observed, unnest(range(100)) AS dd FROM (SELECT DISTINCT observed FROM c)))
SELECT id, whole * 100 + dd AS cents, score FROM c JOIN e USING (observed) WHERE score <= 2""")
def malformed_options(s, d):
    """Every price within two edits of a damaged fraction, for all lines."""
    p = F.col("price")
    seen = F.concat(F.translate(F.lpad((p % 100).cast("string"), 2, "0"), "0158", "OISB"), F.when(F.col("l_partkey") % 3 == 0, "1").otherwise(""))
    return recover.price_options(v.lines(s, d).select((F.col("receipt_id") * 100 + F.col("line_no")).alias("id"), F.floor(p / 100).alias("whole"), seen.alias("observed")))


@query()
def subset_recovery(s, d):
    """The only cheapest choice of prices that adds up to the printed sum, over all lines of all receipts.  SQL would have to list all
    choices; the tests do so on a few receipts."""
    f = v.lines(s, d).select("receipt_id", "line_no", (F.floor(F.col("price") / 100) * 100).alias("low"), (F.col("price") % 100).alias("dd"))
    t = f.groupBy("receipt_id").agg(F.sum(F.col("low") + F.col("dd")).alias("target"))
    tries = F.array_union(F.array(*[F.lit(x).cast("bigint") for x in (0, 25, 50, 75)]), F.array("dd"))
    o = f.withColumn("x", F.explode(tries)).select("receipt_id", "line_no", (F.col("low") + F.col("x")).alias("cents"), F.abs(F.col("x") - F.col("dd")).cast("int").alias("score"))
    return recover.recovered(o, t)


@query()
def line_matching(s, d):
    a = v.lines(s, d).select("receipt_id", F.col("line_no").alias("wanted"), (F.col("price") % 3).alias("k"))
    b = a.select(F.col("receipt_id").alias("r"), F.col("wanted").alias("parsed"), F.col("k").alias("k2"))
    return recover.matched(a.join(b, (F.col("receipt_id") == F.col("r")) & (F.abs(F.col("k") - F.col("k2")) <= 1)))


_GIFT = f"WITH {v.LINES_SQL}, r AS (SELECT receipt_id, line_no, CASE WHEN l_suppkey % 4 = 0 THEN 'x' || (l_partkey % 50) END AS card, CASE WHEN l_suppkey % 5 = 0 THEN 'A' || (l_partkey % 30) END AS approval, l_returnflag FROM rl)"


def _gift_rows(s, d):
    k = lambda c, m: F.when(F.col("l_suppkey") % m == 0, F.concat(F.lit(c[0]), (F.col("l_partkey") % c[1]).cast("string")))
    return v.lines(s, d).select("receipt_id", "line_no", k(("x", 50), 4).alias("card"), k(("A", 30), 5).alias("approval"), "l_returnflag", "description")


@query(f"{_GIFT}, t AS (SELECT receipt_id, line_no AS start, least(coalesce(lead(line_no) OVER (PARTITION BY receipt_id ORDER BY line_no), line_no + 4), line_no + 4) AS stop FROM r WHERE l_returnflag = 'R'), g AS (SELECT t.receipt_id, start, min(translate(card, 'xX', '**')) AS c, max(translate(card, 'xX', '**')) AS c2, min(approval) AS a, max(approval) AS a2 FROM t LEFT JOIN r ON r.receipt_id = t.receipt_id AND line_no >= start AND line_no < stop GROUP BY 1, 2) SELECT receipt_id, start, CASE WHEN c = c2 THEN c END AS card, CASE WHEN a = a2 THEN a END AS approval, concat_ws(',', CASE WHEN c IS NULL OR c <> c2 THEN 'card' END, CASE WHEN a IS NULL OR a <> a2 THEN 'approval' END) AS unresolved FROM g")
def gift_redemptions(s, d):
    rows = _gift_rows(s, d).withColumn("card", giftcards.identifier(F.col("card")))
    return giftcards.redemptions(rows.where("l_returnflag = 'R'").select("receipt_id", "line_no"), rows, 4)


@query(f"WITH {v.LINES_SQL}, n AS (SELECT receipt_id, line_no, split_part(description, ' ', 2) AS product, l_linestatus = 'O' AS slip, row_number() OVER w AS nth, count(*) OVER (PARTITION BY receipt_id, split_part(description, ' ', 2), l_linestatus = 'O') AS n FROM rl WINDOW w AS (PARTITION BY receipt_id, split_part(description, ' ', 2), l_linestatus = 'O' ORDER BY line_no)) SELECT a.receipt_id, a.product, a.line_no AS item_line, b.line_no AS slip_line FROM n a JOIN n b ON a.receipt_id = b.receipt_id AND a.product = b.product AND a.nth = b.nth AND a.n = b.n AND NOT a.slip AND b.slip")
def gift_attach(s, d):
    rows = v.lines(s, d).withColumn("product", F.split_part("description", F.lit(" "), F.lit(2)))
    return giftcards.attached_by_rank(rows.where("l_linestatus <> 'O'"), rows.where("l_linestatus = 'O'"), "product")


@query(f"WITH {v.LINES_SQL}, b AS (SELECT receipt_id, line_no, coalesce(sum(CASE WHEN contains(description, 'ROD') THEN 1 ELSE 0 END) OVER (PARTITION BY receipt_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM rl) SELECT receipt_id, block, count(*) AS n, min(line_no) AS first_line FROM b GROUP BY 1, 2")
def gift_blocks(s, d):
    b = giftcards.blocks(v.lines(s, d), F.contains("description", F.lit("ROD")))
    return b.groupBy("receipt_id", "block").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query(f"WITH {v.HEADERS_SQL} SELECT receipt_id, concat_ws(',', CASE WHEN merchant IS DISTINCT FROM CASE WHEN receipt_id % 5 = 0 THEN NULL ELSE merchant END THEN 'merchant' END, CASE WHEN total IS DISTINCT FROM total + receipt_id % 2 THEN 'total' END) AS changed FROM rh")
def corrected_fields(s, d):
    h = v.headers(s, d)
    new = F.struct(F.when(F.col("receipt_id") % 5 != 0, F.col("merchant")).alias("merchant"), (F.col("total") + F.col("receipt_id") % 2).alias("total"))
    rows = h.select("receipt_id", F.struct("merchant", "total").alias("old"), new.alias("new"))
    return rows.select("receipt_id", giftcards.corrected_fields("old", "new", ["merchant", "total"]).alias("changed"))


_ADDR = "a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey + 10) || ' Main Street, Toronto ON M' || (s_suppkey % 10) || 'B 4k' || (s_suppkey % 7) WHEN 1 THEN 'TEL (416) 555-' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') WHEN 2 THEN 'STORE # 00' || (s_suppkey + 20) || ' NY ' || lpad((s_suppkey % 100000)::VARCHAR, 5, '0') ELSE s_name END AS line FROM supplier)"


@query(f"WITH {_ADDR} SELECT s_suppkey, coalesce(CASE WHEN regexp_matches(upper(line), '{details.POSTAL}') THEN regexp_extract(upper(line), '{details.POSTAL}', 1) || ' ' || regexp_extract(upper(line), '{details.POSTAL}', 2) END, nullif(regexp_extract(upper(line), '{details.ZIP}', 1), '')) AS postal, CASE WHEN regexp_matches(line, '{details.PHONE}') THEN regexp_extract(line, '{details.PHONE}', 1) || '-' || regexp_extract(line, '{details.PHONE}', 2) || '-' || regexp_extract(line, '{details.PHONE}', 3) END AS phone, nullif(regexp_extract(line, '{details.STREET.replace(chr(39), chr(39) * 2)}', 1), '') AS street, nullif(ltrim(regexp_extract(line, '{details.STORE}', 1), '0'), '') AS store FROM a")
def store_details(s, d):
    k = F.col("s_suppkey")
    line = (
        F.when(k % 4 == 0, F.concat((k + 10).cast("string"), F.lit(" Main Street, Toronto ON M"), (k % 10).cast("string"), F.lit("B 4k"), (k % 7).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("TEL (416) 555-"), F.lpad((k % 10000).cast("string"), 4, "0")))
        .when(k % 4 == 2, F.concat(F.lit("STORE # 00"), (k + 20).cast("string"), F.lit(" NY "), F.lpad((k % 100000).cast("string"), 5, "0")))
        .otherwise(F.col("s_name"))
    )
    rows = table(s, d, "supplier").withColumn("line", line)
    x = F.col("line")
    return rows.select("s_suppkey", details.postal_code(x).alias("postal"), details.phone_number(x).alias("phone"), details.street(x).alias("street"), details.store_number(x).alias("store"))


@query("WITH a AS (SELECT p_partkey, 400 + p_partkey % 2000 AS w, 600 + p_partkey * 7 % 3000 AS h FROM part) SELECT p_partkey, CAST(ceil(round(w * 1536.0 / greatest(w, h)) / 32) * 32 AS INT) AS canvas_w, CAST(ceil(round(h * 1536.0 / greatest(w, h)) / 32) * 32 AS INT) AS canvas_h, CAST(CASE WHEN greatest(w, h) <= 1000 THEN w WHEN w = greatest(w, h) THEN 1000 ELSE floor(w * 1000.0 / greatest(w, h)) END AS INT) AS capped_w, CAST(CASE WHEN greatest(w, h) <= 1000 THEN h WHEN h = greatest(w, h) THEN 1000 ELSE floor(h * 1000.0 / greatest(w, h)) END AS INT) AS capped_h FROM a")
def image_canvas(s, d):
    k = F.col("p_partkey")
    w, h = 400 + k % 2000, 600 + k * 7 % 3000
    (cw, ch), (lw, lh) = shapes.canvas(w, h), shapes.capped(w, h, 1000)
    return table(s, d, "part").select("p_partkey", cw.alias("canvas_w"), ch.alias("canvas_h"), lw.alias("capped_w"), lh.alias("capped_h"))


@query(f"WITH {v.BOXES_SQL} SELECT receipt_id, det_idx, round(greatest(0.0, least(1.0, x0 / 1000)), 6) AS left_edge, round(greatest(0.0, least(1.0, y1 / 200)), 6) AS bottom_edge, (x0 + 20 >= x0 AND x0 + 20 <= x1 AND 50 >= y0 AND 50 <= y1) AS holds FROM det")
def unit_boxes(s, d):
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    quad = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))
    return v.boxes(s, d).select("receipt_id", "det_idx", F.round(shapes.unit(F.col("x0") / 1000), 6).alias("left_edge"), F.round(shapes.unit(F.col("y1") / 200), 6).alias("bottom_edge"), shapes.inside(F.col("x0") + 20, F.lit(50), quad).alias("holds"))


@query(f"WITH {v.LINES_SQL}, x AS (SELECT receipt_id, line_no AS seq, 0 AS k, '  ' || description AS line FROM rl UNION ALL SELECT receipt_id, line_no, 1, '  ; check ' || price FROM rl WHERE price % 10 = 0) SELECT receipt_id, string_agg(line, chr(10) ORDER BY seq, k, line) AS body FROM x GROUP BY 1")
def posting_warnings(s, d):
    rows = v.lines(s, d)
    postings = rows.select("receipt_id", F.col("line_no").alias("seq"), F.concat(F.lit("  "), "description").alias("line"))
    notes = rows.where("price % 10 = 0").select("receipt_id", F.col("line_no").alias("seq"), F.concat(F.lit("check "), F.col("price").cast("string")).alias("message"))
    return ledger.with_warnings(postings, notes)


@query(f"WITH {v.HEADERS_SQL}, s AS (SELECT *, trim(regexp_replace(lower(merchant), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM rh) SELECT receipt_id, CASE WHEN receipt_id % 9 = 0 THEN 'unknown-date' ELSE strftime(day, '%Y-%m-%d') END || '-' || slug || '.txt' AS file_name, strftime(day, '%Y') || '/' || strftime(day, '%Y-%m-%d') || '-' || slug || '-' || left(sha256(receipt_id::VARCHAR), 8) AS path FROM s")
def ledger_paths(s, d):
    h = v.headers(s, d)
    token = ledger.sha_token(F.sha2(F.col("receipt_id").cast("string"), 256))
    return h.select("receipt_id", ledger.file_name(F.col("day"), F.col("receipt_id") % 9 == 0, F.col("merchant")).alias("file_name"), ledger.document_path(F.col("day"), F.col("merchant"), token).alias("path"))


@query(f"WITH {v.LINES_SQL}, o AS (SELECT receipt_id, CASE line_no % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'balance' ELSE 'uncategorized' END AS kind, price % 7 AS note FROM rl), n AS (SELECT receipt_id, CASE line_no % 2 WHEN 0 THEN 'ocr' ELSE 'balance' END AS kind, price % 5 AS note FROM rl) SELECT DISTINCT * FROM (SELECT * FROM o WHERE kind = 'ocr' UNION ALL SELECT * FROM n WHERE kind <> 'ocr')")
def refreshed_warnings(s, d):
    r = v.lines(s, d)
    k, m = F.col("line_no") % 3, F.col("line_no") % 2
    old = r.select("receipt_id", F.when(k == 0, "ocr").when(k == 1, "balance").otherwise("uncategorized").alias("kind"), (F.col("price") % 7).alias("note"))
    new = r.select("receipt_id", F.when(m == 0, "ocr").otherwise("balance").alias("kind"), (F.col("price") % 5).alias("note"))
    return ledger.refreshed(old, new, ["ocr"])


_TALL = f"WITH {v.LINES_SQL}, l AS (SELECT receipt_id, line_no, description AS text, CASE WHEN l_partkey % 6 = 0 THEN 60 + l_suppkey % 9 ELSE 18 + l_suppkey % 5 END AS height, line_no / 12.0 AS top FROM rl)"


@query(f"{_TALL}, m AS (SELECT receipt_id, median(height) AS mid FROM l GROUP BY 1) SELECT receipt_id, line_no, text FROM (SELECT l.*, row_number() OVER (PARTITION BY l.receipt_id ORDER BY height DESC, line_no) AS n FROM l JOIN m USING (receipt_id) WHERE top <= 0.25 AND height >= 1.8 * mid) WHERE n = 1")
def merchant_banner(s, d):
    rows = v.lines(s, d).select("receipt_id", "line_no", F.col("description").alias("text"), F.when(F.col("l_partkey") % 6 == 0, 60 + F.col("l_suppkey") % 9).otherwise(18 + F.col("l_suppkey") % 5).alias("height"), (F.col("line_no") / 12).alias("top"))
    return merchant.banner(rows)


@query("WITH l AS (SELECT doc_id AS receipt_id, i AS line_no, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))) SELECT receipt_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) AS n FROM l WHERE line_no <= 10 AND regexp_matches(text, '[A-Za-z].*[A-Za-z].*[A-Za-z].*[A-Za-z]') AND NOT regexp_matches(text, '[0-9]{2}[/.-][0-9]{2}|[0-9]\\.[0-9]{2}')) WHERE n = 1")
def merchant_header(s, d):
    rows = v.document_lines(s, d).select(F.col("doc_id").alias("receipt_id"), (F.col("line_no") + 1).alias("line_no"), F.col("line").alias("text"))
    return merchant.first_plausible(rows)


@query(f"WITH {v.LINES_SQL} SELECT receipt_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(l_partkey || '00000 ' || description || '  ' || (price // 100) || '.' || lpad((price % 100)::VARCHAR, 2, '0') || ' H', '^[0-9]{{4,}}\\s+', ''), '\\s+\\$?[0-9]+[.][0-9]{{2}}-?(\\s+[A-Z]{{1,3}})?$', ''), '\\s+', ' ', 'g')) AS cleaned, price AS last_price FROM rl")
def clean_lines(s, d):
    p = F.col("price")
    raw = F.concat(F.col("l_partkey").cast("string"), F.lit("00000 "), "description", F.lit("  "), F.floor(p / 100).cast("string"), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0"), F.lit(" H"))
    rows = v.lines(s, d).withColumn("raw", raw)
    return rows.select("receipt_id", "line_no", texts.clean_description(F.col("raw")).alias("cleaned"), texts.last_price(F.col("raw")).alias("last_price"))
