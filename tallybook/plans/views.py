"""Receipt relations over the star-schema tables, for Spark and, as common table expressions,
for an independent SQL engine.

Lines number a receipt's rows by all columns, since (order, line number) is not unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions import money
from tallybook.session import table

ACCOUNTS = [("home", "Expenses:Home"), ("home/hardware", "Expenses:Home:Hardware"), ("home/tools", "Expenses:Home:Tools"), ("toys", "Expenses:Toys"), ("kitchen/plates", "Expenses:Kitchen")]
TAGS = ["home", "home/hardware", "home/tools", "toys", "kitchen", "kitchen/plates", "sale"]
#: rule_id, keywords, priority, exact_only, path, disables
RULES = [
    ("r_ring", ["RING"], 10, False, "toys", []),
    ("r_bolt", ["BOLT", "ROD"], 10, True, "home/hardware", []),
    ("r_gear", ["GEAR", "GIZMO"], 20, False, "home/tools", []),
    ("r_widget", ["WIDGET", "RED WIDGET"], 15, False, "home/tools/widgets", ["r_red"]),
    ("r_red", ["RED"], 30, True, "toys", []),
    ("r_plate", ["PLATE", "COLD PLATE"], 5, False, "kitchen/plates", ["r_cold"]),
    ("r_cold", ["COLD", "HOT"], 25, True, None, []),
    ("r_anvil", ["ANVIL"], 10, False, "home/forge", ["r_gone"]),
    ("r_old", ["OLD"], 12, False, "home", []),
    ("r_large", ["LARGE", "LARG"], 8, False, "home", ["r_ring"]),
]


def rules(spark: SparkSession, rows: list[tuple] = RULES) -> DataFrame:
    data = [(r[0], i, r[1], r[2], r[3], r[4], r[5]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "rule_id string, rule_index int, keywords array<string>, priority int, exact_only boolean, path string, disables array<string>")


def accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACCOUNTS, "path string, account string")


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TAGS], "path string")


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Receipt lines: order lines with their part's name in capitals and the price in cents."""
    part = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("description"))
    rows = table(spark, d, "lineitem").withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)))
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("receipt_id"), "line_no", "description", money.cents(F.col("l_extendedprice")).alias("price"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def headers(spark: SparkSession, d: str) -> DataFrame:
    """Receipt headers: orders with their customer."""
    who = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("merchant"), "c_mktsegment")
    rows = table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("receipt_id"), "merchant", F.col("c_mktsegment").alias("segment"), money.cents(F.col("o_totalprice")).alias("total"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority", "o_custkey")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Two boxes a line, description and price, by whole-number arithmetic."""
    rows = lines(spark, d)
    price = F.concat(F.floor(F.col("price") / 100).cast("string"), F.lit("."), F.lpad((F.col("price") % 100).cast("string"), 2, "0"))
    conf = (50 + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 50).cast("int")
    tall = (18 + F.col("l_suppkey") % 5).cast("int")
    at = lambda k: (F.col("line_no") * 30 + F.col(k) % 7).cast("int")
    left = F.struct((F.col("line_no") * 2).alias("det_idx"), (40 + F.col("l_partkey") % 90).cast("int").alias("x0"), (240 + F.col("l_partkey") % 90).cast("int").alias("x1"), at("l_partkey").alias("y0"), (at("l_partkey") + tall).alias("y1"), F.col("description").alias("text"), conf.alias("confidence"))
    right = F.struct((F.col("line_no") * 2 + 1).alias("det_idx"), (700 + F.col("l_quantity")).cast("int").alias("x0"), (780 + F.col("l_quantity")).cast("int").alias("x1"), at("l_suppkey").alias("y0"), (at("l_suppkey") + tall).alias("y1"), price.alias("text"), (140 - conf).alias("confidence"))
    return rows.select("receipt_id", F.inline(F.array(left, right)))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return docs


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") t({names})"


RULES_SQL = f"rules AS ({_values([(r[0], i, *r[1:]) for i, r in enumerate(RULES)], 'rule_id, rule_index, keywords, priority, exact_only, path, disables')})"
ACCOUNTS_SQL = f"accounts AS ({_values(ACCOUNTS, 'path, account')})"
TAGS_SQL = f"tags AS ({_values([(t,) for t in TAGS], 'path')})"
LINES_SQL = f"""rl AS (SELECT l_orderkey AS receipt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) AS line_no,
  upper(p_name) AS description, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
HEADERS_SQL = """rh AS (SELECT o_orderkey AS receipt_id, c_name AS merchant, c_mktsegment AS segment, CAST(round(o_totalprice * 100) AS BIGINT) AS total,
  CAST(o_orderdate AS DATE) AS day, o_orderstatus, o_orderpriority, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"""
BOXES_SQL = f"""{LINES_SQL}, det AS (
  SELECT receipt_id, line_no * 2 AS det_idx, 40 + l_partkey % 90 AS x0, 240 + l_partkey % 90 AS x1, line_no * 30 + l_partkey % 7 AS y0, line_no * 30 + l_partkey % 7 + 18 + l_suppkey % 5 AS y1,
         description AS text, 50 + (l_partkey * 7 + l_suppkey) % 50 AS confidence FROM rl
  UNION ALL
  SELECT receipt_id, line_no * 2 + 1, CAST(700 + l_quantity AS INT), CAST(780 + l_quantity AS INT), line_no * 30 + l_suppkey % 7, line_no * 30 + l_suppkey % 7 + 18 + l_suppkey % 5,
         (price // 100) || '.' || lpad(CAST(price % 100 AS VARCHAR), 2, '0'), 140 - (50 + (l_partkey * 7 + l_suppkey) % 50) FROM rl)"""
OVERLAP_SQL = "10 * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 3 * least(a.y1 - a.y0, b.y1 - b.y0)"
DOCLINES_SQL = "dl AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"
MATCHES_SQL = f"""{LINES_SQL}, {RULES_SQL}, {ACCOUNTS_SQL}, items AS (SELECT receipt_id * 100 + line_no AS item_id, receipt_id, line_no, description, price FROM rl),
kw AS (SELECT rule_id, rule_index, priority, exact_only, path, keywords[i] AS keyword, i - 1 AS keyword_index FROM (SELECT *, unnest(range(1, len(keywords) + 1)) AS i FROM rules)),
m0 AS (SELECT items.*, kw.*, contains(' ' || description || ' ', ' ' || keyword || ' ') AS is_exact, length(keyword) AS keyword_length FROM items JOIN kw ON contains(description, keyword)),
m AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY item_id, rule_id ORDER BY is_exact DESC, keyword_length DESC, keyword_index) AS n FROM m0
      WHERE is_exact OR (length(keyword) > 3 AND NOT exact_only)) WHERE n = 1)"""
