"""Queries of the detector's score maps, tilted pages and damaged tokens over the order lines.  Importing it registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import money, repairs
from tallybook.operators import level, scoremaps
from tallybook.plans import views as v
from tallybook.plans.catalog import query

#: Width of a score map and pixels of height for each line.
WIDE, PITCH = 32, 12


def score_maps(spark: SparkSession, d: str) -> DataFrame:
    """A score map for each order: a bar for each line, whose place, size and score come from its part and supplier."""
    rows = v.lines(spark, d)
    bar, at, tall = (8 + F.col("l_partkey") % 16).cast("int"), (F.col("l_suppkey") % 6).cast("int"), (4 + F.col("l_suppkey") % 3).cast("int")
    score = ((505 + F.col("l_partkey") % 40 * 10) / 1000).cast("float")
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    # a map is drawn after its lines met: they are smaller than their pixels
    pages = rows.select("receipt_id", F.struct("line_no", bar.alias("bar"), at.alias("at"), tall.alias("tall"), score.alias("score")).alias("b")).groupBy("receipt_id").agg(F.sort_array(F.collect_list("b")).alias("x"))

    def block(b: Column) -> Column:
        on = F.concat(zeros(b["at"] + 1), F.array_repeat(b["score"], b["bar"]), zeros(WIDE - 1 - b["at"] - b["bar"]))
        return F.concat(zeros(F.lit(3 * WIDE)), F.flatten(F.array_repeat(on, b["tall"])), zeros((PITCH - 3 - b["tall"]) * WIDE))

    return pages.select(F.col("receipt_id").alias("map_id"), F.flatten(F.transform("x", block)).alias("scores"), F.lit(WIDE).alias("columns"), F.lit(2 * WIDE).alias("width"), (F.size("x") * PITCH).alias("height"))


@query(f"""WITH {v.LINES_SQL}, b AS (SELECT receipt_id, line_no, 1 + l_suppkey % 6 AS x, (line_no - 1) * {PITCH} + 3 AS y, 7 + l_partkey % 16 AS w, 3 + l_suppkey % 3 AS h, (505 + l_partkey % 40 * 10) / 1000.0 AS score FROM rl),
k AS (SELECT *, w * h * {scoremaps.WIDEN} / (2.0 * (w + h)) AS o, count(*) OVER (PARTITION BY receipt_id) * {PITCH} AS tall, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no) - 1 AS box FROM b WHERE score >= {scoremaps.REGION} AND least(w, h) >= {scoremaps.SIDE}),
n AS (SELECT receipt_id, count(*) * {PITCH} AS tall FROM rl GROUP BY 1)
SELECT k.receipt_id AS map_id, box::INT AS box, round(greatest(2 * (x - o), 0), 4) AS left_, round(greatest(y - o, 0), 4) AS top, round(least(2 * (x + w + o), {2 * WIDE}), 4) AS right_, round(least(y + h + o, n.tall), 4) AS bottom, round(score, 4)::DOUBLE AS score FROM k JOIN n ON n.receipt_id = k.receipt_id""")
def detector_quads(s, d):
    p = lambda i, k: F.round(F.col("points")[i][k], 4)
    found = scoremaps.detected(score_maps(s, d))
    return found.select("map_id", "box", p(0, 0).alias("left_"), p(0, 1).alias("top"), p(2, 0).alias("right_"), p(2, 1).alias("bottom"), F.round("score", 4).alias("score"))


_SLANT = "(receipt_id % 13 - 6) * 8"


def tilted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Names on the left and amounts on the right, lower or higher by the order's slant, a pixel or two off."""
    rows = v.lines(spark, d)
    y = F.col("line_no") * 40
    slant = F.expr(_SLANT)
    box = lambda k, x0, x1, top, text: F.struct((F.col("line_no") * 2 + k).alias("det_idx"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), top.alias("y0"), (top + 20).alias("y1"), text.alias("text"))
    boxes = rows.select("receipt_id", F.inline(F.array(box(0, 60, 260, y + F.col("l_partkey") % 3, F.col("description")), box(1, 760, 820, y + F.col("l_suppkey") % 3 + slant, money.text(F.col("price"))))))
    return boxes.select("receipt_id", "det_idx", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")], ((F.col("y0") + F.col("y1")) / 2.0).alias("cy"), "text", F.lit(0.99).alias("confidence"), F.lit(1000.0).alias("page_w"))


def _cost(angle: str) -> str:
    """Rows' height at an angle, as an aggregate over ``z`` (receipt_id, key, y: the boxes turned back)."""
    return f"SELECT receipt_id, sum(CASE WHEN g IS NULL OR g > 10 THEN 10 ELSE g END) AS cost FROM (SELECT receipt_id, y - lag(y) OVER (PARTITION BY receipt_id ORDER BY y) AS g FROM (SELECT b.receipt_id, b.cy - (b.cx - 500) * tan(radians({angle})) AS y FROM b JOIN m ON m.receipt_id = b.receipt_id)) GROUP BY 1"


@query(f"""WITH {v.LINES_SQL},
i AS (SELECT receipt_id, line_no, 160.0 AS cx, line_no * 40 + l_partkey % 3 + 10.0 AS cy FROM rl),
p AS (SELECT receipt_id, line_no, 790.0 AS cx, line_no * 40 + l_suppkey % 3 + {_SLANT} + 10.0 AS cy FROM rl),
b AS (SELECT receipt_id, cx, cy FROM i UNION ALL SELECT receipt_id, cx, cy FROM p),
c AS (SELECT i.receipt_id, i.line_no AS item, row_number() OVER (PARTITION BY i.receipt_id ORDER BY i.line_no, p.line_no) AS k, degrees(atan2(p.cy - i.cy, p.cx - i.cx)) AS a FROM i JOIN p ON p.receipt_id = i.receipt_id AND abs(p.cy - i.cy) <= {level.REACH}),
s AS (SELECT x.receipt_id, x.k, x.a, avg(y.a) AS mean, count(*) AS n, count(DISTINCT y.item) AS rows_ FROM c x JOIN c y ON y.receipt_id = x.receipt_id AND abs(y.a - x.a) <= {level.AGREES} + 1e-12 WHERE abs(x.a) <= {level.MOST} GROUP BY 1, 2, 3),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY rows_ DESC, n DESC, k) AS nth FROM s) WHERE nth = 1),
t AS (SELECT receipt_id, count(*) AS pairs, count(DISTINCT item) AS items FROM c GROUP BY 1),
m AS (
  SELECT t.receipt_id, pairs, items, CASE WHEN pairs >= 3 THEN coalesce(mean, 0) ELSE 0 END AS mean, CASE WHEN pairs >= 3 THEN coalesce(w.n, 0) ELSE 0 END AS agreeing, CASE WHEN pairs >= 3 THEN coalesce(w.rows_, 0) ELSE 0 END AS rows_,
         coalesce((SELECT max(rows_) FROM s WHERE s.receipt_id = t.receipt_id AND abs(s.a - w.mean) > {level.RIVAL}), 0) AS rivals FROM t LEFT JOIN w ON w.receipt_id = t.receipt_id),
f0 AS ({_cost('0.0')}), f1 AS ({_cost('m.mean')}),
r AS (SELECT m.*, (SELECT count(*) FROM b WHERE b.receipt_id = m.receipt_id) AS boxes, greatest((f0.cost - f1.cost) / f0.cost, 0) AS gain FROM m JOIN f0 ON f0.receipt_id = m.receipt_id JOIN f1 ON f1.receipt_id = m.receipt_id),
q AS (SELECT *, CASE WHEN agreeing < {level.PAIRS} THEN 'too_few_inliers' WHEN abs(mean) > {level.MOST} THEN 'angle_too_large' WHEN rows_ * 1.0 / items < {level.CONSENSUS} THEN 'weak_consensus' WHEN rows_ <= rivals THEN 'ambiguous_angle' WHEN abs(mean) < {level.LEAST} THEN 'angle_too_small' WHEN gain < {level.TIGHTER} THEN 'rows_not_tightened' END AS reason FROM r)
SELECT receipt_id, round(mean, 6) + 0.0 AS angle, reason IS NULL AS accepted, reason, pairs, agreeing FROM q""")
def page_tilt(s, d):
    """The consensus of pairs and its doubts; the sweep that follows a doubt on larger pages is tested on its own."""
    return level.tilts(tilted_pages(s, d), sweep=False).select("receipt_id", (F.round("angle", 6) + 0.0).alias("angle"), "accepted", "reason", "pairs", "agreeing")


def damaged_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A damaged quantity row or amount for each order line; every other total is a cent off."""
    p, q = F.col("price"), F.col("l_quantity").cast("bigint")
    n, off, k = q % 9 + 1, F.col("l_suppkey") % 2, F.col("l_partkey") % 6
    unit = F.floor(p / 100)
    c, text = F.lit, lambda x: money.text(x)
    s = lambda x: x.cast("string")
    milli = q * 1000 + F.col("l_partkey") % 1000
    row = (
        F.when(k == 0, F.concat(s(q), c(" @ 8"), text(unit), c("  "), text(q * unit + off), c("H")))
        .when(k == 1, F.concat(s(n), c("0 8"), text(unit), c(" "), text(n * unit + off)))
        .when(k == 2, F.concat(s(n), c(" 9 $"), text(unit), c(" "), text(n * unit + off)))
        .when(k == 3, F.concat(s(q), c("."), F.lpad(s(F.col("l_partkey") % 1000), 3, "0"), c(" lb e $"), text(unit), c("/lb "), text(F.floor((milli * unit + 500) / 1000) + off)))
        .when(k == 4, F.concat(s(F.floor(p / 100)), c(", "), F.lpad(s(p % 100), 2, "0"), F.when(off == 1, "H").otherwise("x1")))
        .otherwise(F.concat(s(n), c(" e $"), text(unit)))
    )
    return v.lines(spark, d).select("receipt_id", "line_no", k.alias("k"), row.alias("damaged"))


_U = "(p // 100 // 100) || '.' || lpad((p // 100 % 100)::VARCHAR, 2, '0')"
_M = lambda x: f"(({x}) // 100) || '.' || lpad((({x}) % 100)::VARCHAR, 2, '0')"


@query(f"""WITH {v.LINES_SQL}, x AS (SELECT receipt_id, line_no, l_partkey % 6 AS k, price AS p, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) % 9 + 1 AS n, l_suppkey % 2 AS off, l_partkey % 1000 AS m FROM rl),
y AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN off = 0 AND q >= 2 AND p >= 100 THEN '$' ELSE '8' END WHEN 1 THEN CASE WHEN off = 0 AND n >= 2 AND p >= 100 THEN ' @ $' ELSE '0 8' END WHEN 2 THEN CASE WHEN off = 0 AND n >= 2 AND p >= 100 THEN ' @ $' ELSE ' 9 $' END WHEN 3 THEN CASE WHEN off = 0 AND p >= 100 THEN '@' ELSE 'e' END END AS sign FROM x)
SELECT receipt_id, line_no, CASE k WHEN 0 THEN q || ' @ ' || sign || {_U} || '  ' || {_M('q * (p // 100) + off')} || 'H' WHEN 1 THEN n || sign || {_U} || ' ' || {_M('n * (p // 100) + off')} WHEN 2 THEN n || sign || {_U} || ' ' || {_M('n * (p // 100) + off')}
  WHEN 3 THEN q || '.' || lpad(m::VARCHAR, 3, '0') || ' lb ' || sign || ' $' || {_U} || '/lb ' || {_M('((q * 1000 + m) * (p // 100) + 500) // 1000 + off')}
  WHEN 4 THEN (p // 100) || CASE WHEN off = 1 THEN '.' ELSE ', ' END || lpad((p % 100)::VARCHAR, 2, '0') || CASE WHEN off = 1 THEN 'H' ELSE 'x1' END ELSE n || ' @ $' || {_U} END AS mended FROM y""")
def proved_repairs(s, d):
    t = F.col("damaged")
    return damaged_tokens(s, d).select("receipt_id", "line_no", F.when(F.col("k") == 4, repairs.amount(t)).otherwise(repairs.quantity_row(t)).alias("mended"))
