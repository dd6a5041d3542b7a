"""Property graphs out of relational tables.

Every adapter gives nodes (id, label, kind, file, line, loc, exports, domain,
role) and edges (src, dst, kind, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import Stored, spread, table

NODE_SCHEMA = "id string, label string, kind string, file string, line int, loc int, exports boolean, domain string, role string"
EDGE_SCHEMA = "src string, dst string, kind string, weight int"


def normalize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill what a minimal graph leaves out; edges may dangle."""
    from loomgraph.functions.paths import role_of

    have = set(nodes.columns)
    col = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    file = col("file", F.lit(""))
    out = nodes.select(
        "id", col("label", F.col("id")).alias("label"), col("kind", F.lit("function")).alias("kind"), file.alias("file"),
        col("line", F.lit(1)).cast("int").alias("line"), col("loc", F.lit(0)).cast("int").alias("loc"), col("exports", F.lit(False)).alias("exports"),
        col("domain", F.lit("unassigned")).alias("domain"), col("role", role_of(file)).alias("role"),
        *[c for c in nodes.columns if c not in ("id", "label", "kind", "file", "line", "loc", "exports", "domain", "role")],
    )
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in edges.columns else F.lit(1)
    return out, edges.select("src", "dst", "kind", weight.cast("int").alias("weight"))


def _ref(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def commerce(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers, orders, parts, suppliers, nations and regions; acyclic. Urgent orders play the tests."""
    t = lambda n: table(spark, d, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")

    def node(df, prefix, key, label, file, loc, domain, role=None):
        return df.select(
            _ref(prefix, key).alias("id"), label.alias("label"), F.lit("function").alias("kind"), file.alias("file"), F.lit(1).alias("line"), loc.cast("int").alias("loc"),
            (F.col(key) % 5 == 0).alias("exports"), domain.alias("domain"), (F.lit("product") if role is None else role).alias("role"),
        )

    bucket = lambda name, key, n: F.concat(F.lit(f"{name}/"), (F.col(key) % n).cast("string"))
    loc = lambda key: 1 + F.col(key) % 40
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "test").otherwise("product")
    nodes = (
        node(t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")), "c:", "c_custkey", F.col("c_mktsegment"), bucket("customer", "c_custkey", 50), loc("c_custkey"), F.col("r_name"))
        .union(node(t("orders"), "o:", "o_orderkey", F.col("o_orderstatus"), bucket("orders", "o_orderkey", 100), loc("o_orderkey"), F.lit("orders"), urgent))
        .union(node(t("part"), "p:", "p_partkey", F.col("p_brand"), bucket("part", "p_partkey", 20), F.col("p_size"), F.lit("part")))
        .union(node(t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")), "s:", "s_suppkey", F.col("s_name"), bucket("supplier", "s_suppkey", 10), loc("s_suppkey"), F.col("r_name")))
        .union(node(t("nation"), "n:", "n_nationkey", F.col("n_name"), bucket("nation", "n_nationkey", 25), F.lit(10), F.lit("geography")))
        .union(node(t("region"), "r:", "r_regionkey", F.col("r_name"), F.lit("region/all"), F.lit(10), F.lit("geography")))
    )
    call = F.when(F.col("o_orderpriority") == "1-URGENT", "test").otherwise("call")
    kinds = t("orders").select("o_orderkey", "o_custkey", call.alias("kind"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), kind.alias("kind"), F.lit(1).alias("weight"))
    lines = t("lineitem")
    rows = lines.count()
    parts = spread(lines.select("l_orderkey", "l_partkey"), rows, "l_orderkey").distinct()
    sources = spread(lines.select("l_partkey", "l_suppkey"), rows, "l_partkey").distinct()
    edges = (
        edge(kinds, _ref("o:", "o_orderkey"), _ref("c:", "o_custkey"), F.col("kind"))
        .union(edge(parts.join(kinds, F.col("l_orderkey") == F.col("o_orderkey")), _ref("o:", "l_orderkey"), _ref("p:", "l_partkey"), F.col("kind")))
        .union(edge(sources, _ref("p:", "l_partkey"), _ref("s:", "l_suppkey"), F.lit("import")))
        .union(edge(t("supplier"), _ref("s:", "s_suppkey"), _ref("n:", "s_nationkey"), F.lit("inherit")))
        .union(edge(t("customer"), _ref("c:", "c_custkey"), _ref("n:", "c_nationkey"), F.lit("inherit")))
        .union(edge(t("nation"), _ref("n:", "n_nationkey"), _ref("r:", "n_regionkey"), F.lit("inherit")))
        .union(edge(t("supplier").join(place.join(t("region"), "r_name"), F.col("s_nationkey") == F.col("n_nationkey")), _ref("s:", "s_suppkey"), _ref("r:", "r_regionkey"), F.lit("ref")))
    )
    return nodes, edges


COMMERCE_SQL = """
place AS (SELECT n_nationkey, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
N AS (
  SELECT 'c:' || c_custkey AS id, c_mktsegment AS label, 'function' AS kind, 'customer/' || (c_custkey % 50) AS file, 1 AS line, CAST(1 + c_custkey % 40 AS INTEGER) AS loc, c_custkey % 5 = 0 AS exports, r_name AS domain, 'product' AS role FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'o:' || o_orderkey, o_orderstatus, 'function', 'orders/' || (o_orderkey % 100), 1, CAST(1 + o_orderkey % 40 AS INTEGER), o_orderkey % 5 = 0, 'orders', CASE WHEN o_orderpriority = '1-URGENT' THEN 'test' ELSE 'product' END FROM orders
  UNION ALL SELECT 'p:' || p_partkey, p_brand, 'function', 'part/' || (p_partkey % 20), 1, CAST(p_size AS INTEGER), p_partkey % 5 = 0, 'part', 'product' FROM part
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'function', 'supplier/' || (s_suppkey % 10), 1, CAST(1 + s_suppkey % 40 AS INTEGER), s_suppkey % 5 = 0, r_name, 'product' FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'function', 'nation/' || (n_nationkey % 25), 1, 10, n_nationkey % 5 = 0, 'geography', 'product' FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, r_name, 'function', 'region/all', 1, 10, r_regionkey % 5 = 0, 'geography', 'product' FROM region),
K AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'test' ELSE 'call' END AS kind FROM orders),
E AS (
  SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, kind, 1 AS weight FROM K
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, kind, 1 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN K ON l_orderkey = o_orderkey
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'import', 1 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'inherit', 1 FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'inherit', 1 FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'inherit', 1 FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'r:' || r_regionkey, 'ref', 1 FROM supplier JOIN place ON s_nationkey = n_nationkey)"""


def trade(spark: SparkSession, d: str, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nations, each calling the `top` nations whose suppliers its customers buy from most; cyclic."""
    t = lambda n: table(spark, d, n)
    flow = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n")).where("c_nationkey <> s_nationkey")
    )
    best = flow.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey"))).where(F.col("r") <= top)
    edges = best.select(_ref("n:", "c_nationkey").alias("src"), _ref("n:", "s_nationkey").alias("dst"), F.lit("call").alias("kind"), F.col("n").cast("int").alias("weight"))
    nodes = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        _ref("n:", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("function").alias("kind"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("file"),
        F.lit(1).alias("line"), (F.col("n_nationkey") + 1).cast("int").alias("loc"), (F.col("n_nationkey") % 5 == 0).alias("exports"), F.col("r_name").alias("domain"), F.lit("product").alias("role"),
    )
    return nodes, edges


def trade_sql(top: int = 3) -> str:
    return f"""
F AS (SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
E AS (SELECT 'n:' || c_nationkey AS src, 'n:' || s_nationkey AS dst, 'call' AS kind, CAST(n AS INTEGER) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s_nationkey) AS r FROM F) WHERE r <= {top}),
N AS (SELECT 'n:' || n_nationkey AS id, n_name AS label, 'function' AS kind, 'nation/' || n_nationkey AS file, 1 AS line, CAST(n_nationkey + 1 AS INTEGER) AS loc, n_nationkey % 5 = 0 AS exports, r_name AS domain, 'product' AS role FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def market(spark: SparkSession, d: str, top: int = 2) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers, each with edges to the `top` of the others that it trades with most; cyclic, and as large as the tables. Some suppliers inherit from their customers, some customers are tests."""
    t = lambda n: table(spark, d, n)
    trades = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("int").alias("n"))

    def best(by: str, other: str) -> DataFrame:
        return trades.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), other))).where(F.col("r") <= top)

    buys = best("o_custkey", "l_suppkey").select(_ref("c:", "o_custkey").alias("src"), _ref("s:", "l_suppkey").alias("dst"), F.lit("call").alias("kind"), F.col("n").alias("weight"))
    kind = F.when(F.col("l_suppkey") % 10 == 0, "inherit").otherwise("call")
    sells = best("l_suppkey", "o_custkey").select(_ref("s:", "l_suppkey").alias("src"), _ref("c:", "o_custkey").alias("dst"), kind.alias("kind"), F.col("n").alias("weight"))

    def node(name: str, key: str, prefix: str, files: int, label: Column, role: Column) -> DataFrame:
        k = F.col(key)
        return t(name).select(
            _ref(prefix, key).alias("id"), label.alias("label"), F.lit("function").alias("kind"), F.concat(F.lit(f"{name}/"), (k % files).cast("string")).alias("file"), F.lit(1).alias("line"),
            (1 + k % 40).cast("int").alias("loc"), (k % 5 == 0).alias("exports"), F.concat(F.lit(f"{name}-"), (k % 4).cast("string")).alias("domain"), role.alias("role"),
        )

    role = F.when(F.col("c_custkey") % 11 == 0, "test").otherwise("product")
    edges = Stored(buys.union(sells), "market").read()  # made once: those who use it read it many times
    return node("customer", "c_custkey", "c:", 50, F.col("c_mktsegment"), role).union(node("supplier", "s_suppkey", "s:", 10, F.col("s_name"), F.lit("product"))), edges


def market_sql(top: int = 2) -> str:
    best = lambda by, other: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {other}) AS r FROM V) WHERE r <= {top})"
    return f"""
V AS (SELECT o_custkey AS c, l_suppkey AS s, CAST(count(*) AS INTEGER) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
E AS (SELECT 'c:' || c AS src, 's:' || s AS dst, 'call' AS kind, n AS weight FROM {best("c", "s")} UNION ALL SELECT 's:' || s, 'c:' || c, CASE WHEN s % 10 = 0 THEN 'inherit' ELSE 'call' END, n FROM {best("s", "c")}),
N AS (SELECT 'c:' || c_custkey AS id, c_mktsegment AS label, 'function' AS kind, 'customer/' || c_custkey % 50 AS file, 1 AS line, CAST(1 + c_custkey % 40 AS INTEGER) AS loc, c_custkey % 5 = 0 AS exports, 'customer-' || c_custkey % 4 AS domain, CASE WHEN c_custkey % 11 = 0 THEN 'test' ELSE 'product' END AS role FROM customer
UNION ALL SELECT 's:' || s_suppkey, s_name, 'function', 'supplier/' || s_suppkey % 10, 1, CAST(1 + s_suppkey % 40 AS INTEGER), s_suppkey % 5 = 0, 'supplier-' || s_suppkey % 4, 'product' FROM supplier)"""


def flow(spark: SparkSession, d: str) -> DataFrame:
    """Transitions between a user's consecutive events: (src, dst, kind, weight)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").select("event_type", F.lead("event_type").over(w).alias("next")).where("next is not null and next <> event_type")
    return steps.groupBy(F.col("event_type").alias("src"), F.col("next").alias("dst")).agg(F.count("*").cast("int").alias("weight")).select("src", "dst", F.lit("call").alias("kind"), "weight")


FLOW_SQL = """
E AS (SELECT event_type AS src, nxt AS dst, 'call' AS kind, CAST(count(*) AS INTEGER) AS weight FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> event_type GROUP BY 1, 2)"""
