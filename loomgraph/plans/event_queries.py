"""Queries over ordered tables: windows, ledgers, keyed state, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import series
from loomgraph.session import ROWS_A_TASK, table


def w5_cumulative(spark, d):
    daily = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("y"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.count("*").alias("n"))
    return series.cumulative(daily, ["y"], ["m"], "n", "total")


def w7_trend(spark, d):
    """First, last and change of each event type's daily count."""
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy("event_type").agg(F.min_by("n", "day").alias("first"), F.max_by("n", "day").alias("last"), F.count("*").alias("days")).withColumn("change", F.col("last") - F.col("first"))


def w8_delta(spark, d):
    daily = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return daily.select("day", "n", (F.col("n") - F.lag("n").over(Window.orderBy("day"))).alias("delta"))


def w9_capped_groups(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("r")).where("r <= 12")


def w10_windows(spark, d):
    """Turns whose length is a multiple of five, two turns around each, merged."""
    hits = table(spark, d, "conversations").where("length(text) % 5 = 0").select("conv_id", (F.col("turn") - 2).alias("s"), (F.col("turn") + 2).alias("e"))
    return series.islands(hits, ["conv_id"], "s", "e")


def w10_sessions(spark, d):
    out = series.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return out.select("user_id", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


def t5_dedup(spark, d):
    return series.first_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def t6_ttl(spark, d):
    e = table(spark, d, "events")
    cards = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), "ts")
    edits = e.where("event_type IN ('click', 'purchase')").select("user_id", F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"))
    return series.followed(cards, edits, "user_id", 300).drop("ts")


def t7_buckets(spark, d):
    return series.buckets(table(spark, d, "events"), "ts")


def t8_ledger(spark, d):
    """The last ten rows of a daily ledger."""
    daily = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("at")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return daily.orderBy(F.desc("at")).limit(10)


def a9_spread(spark, d):
    """Least, most, mean and relative spread of line quantities by flag."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag")
    out = g.agg(F.min("l_quantity").alias("least"), F.avg("l_quantity").alias("mean"), (F.stddev_pop("l_quantity") / F.avg("l_quantity")).alias("cv"), F.max("l_quantity").alias("most"))
    return out.select("l_returnflag", "least", "most", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


def a10_buckets(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(v >= 75).alias("actionable"), F.count_if((v >= 25) & (v < 75)).alias("review"), F.count_if(v < 25).alias("dismissed"))


def a11_shared(spark, d):
    """Shared quantity of the parts that two suppliers of a pair both deliver. Summed among parts of near numbers first, which have many pairs in common, so that a task holds and sends few."""
    lines = table(spark, d, "lineitem")
    size = lines.agg(F.count("*").alias("rows"), F.approx_count_distinct("l_partkey").alias("parts")).first()
    tasks = max(-(-size.rows // ROWS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = F.floor(F.col("l_partkey") / max(1, size.parts // (2 * tasks)))
    q = lines.select(near.alias("near"), "l_suppkey", "l_partkey").where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL").repartitionByRange(tasks, "near").groupBy("near", "l_partkey", "l_suppkey").agg(F.count("*").alias("c"))
    later = F.collect_list(F.struct("l_suppkey", "c")).over(Window.partitionBy("near", "l_partkey").orderBy("l_suppkey").rowsBetween(1, Window.unboundedFollowing))
    pairs = q.select("near", F.col("l_suppkey").alias("a"), "c", later.alias("later")).select("near", "a", "c", F.explode("later").alias("y"))
    some = pairs.groupBy("near", "a", F.col("y.l_suppkey").alias("b")).agg(F.sum(F.least("c", "y.c")).alias("some"))
    return some.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("some").alias("shared"))


def a15_coverage(spark, d):
    """Peak and any label of a source; no label stays null."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.max("quality").alias("peak"), F.count("quality").alias("seen"), F.count_if(F.col("quality").isNull()).alias("unseen"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"))


def labels_tristate(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality") == 1, "covered").when(F.col("quality") == 0, "idle").otherwise("unknown").alias("state"), "toxic")


def a16_lifetime(spark, d):
    """Counters of all months added up from a map per month."""
    m = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("m"), "event_type").agg(F.count("*").alias("n"))
    maps = m.groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("c"))
    return maps.select(F.explode("c").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("n"))


def a17_statistics(spark, d):
    """Share of late lines by mode of return with its interval, and the log-log slope of price on quantity."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("hits"), F.count("*").alias("n"), F.regr_slope(F.log("l_extendedprice"), F.log("l_quantity")).alias("slope"), F.regr_r2(F.log("l_extendedprice"), F.log("l_quantity")).alias("r2"), F.percentile("l_quantity", 0.95).alias("p95"))
    lo, hi = series.confidence_interval(F.col("hits"), F.col("n"))
    return g.select("l_returnflag", "hits", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("p95", 6).alias("p95"))


def a18_scores(spark, d):
    """Suppliers found in a part's discounted lines against those in all its lines of the year."""
    li = table(spark, d, "lineitem")
    return series.scored(li.where("l_discount >= 0.05"), li.where("l_quantity >= 20"), "l_partkey", "l_suppkey").withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


def j2_j3_semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000")
    semi = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", F.lit("semi").alias("how"))
    return semi.union(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("anti").alias("how")))


def j13_suffix(spark, d):
    """Page paths mapped to the one known path that ends like them; what fits several is left out."""
    p = table(spark, d, "pages").select("page_id", F.split(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/").alias("parts"))
    known = p.select(F.array_join("parts", "/").alias("path")).distinct()
    tails = known.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), i, 99), "/"))).alias("tail")).where("tail <> ''")
    wanted = p.select("page_id", F.array_join(F.slice("parts", 2, 99), "/").alias("tail")).where("tail <> ''")
    hit = wanted.join(tails, "tail").groupBy("page_id").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    return hit.where("n = 1").select("page_id", "path")


QUERIES = {f.__name__: f for f in (w5_cumulative, w7_trend, w8_delta, w9_capped_groups, w10_windows, w10_sessions, t5_dedup, t6_ttl, t7_buckets, t8_ledger, a9_spread, a10_buckets, a11_shared, a15_coverage, labels_tristate, a16_lifetime, a17_statistics, a18_scores, j2_j3_semi_anti, j13_suffix)}

_Z = "1.959963984540054"
ORACLE_SQL = {
    "w5_cumulative": "SELECT y, m, n, CAST(sum(n) OVER (PARTITION BY y ORDER BY m) AS BIGINT) AS total FROM (SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1, 2)",
    "w7_trend": "SELECT event_type, arg_min(n, d) AS first, arg_max(n, d) AS last, count(*) AS days, arg_max(n, d) - arg_min(n, d) AS change FROM (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "w8_delta": "SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)",
    "w9_capped_groups": "SELECT * FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS r FROM documents) WHERE r <= 12",
    "w10_windows": "WITH H AS (SELECT conv_id, turn - 2 AS s, turn + 2 AS e FROM conversations WHERE length(text) % 5 = 0), L AS (SELECT *, max(e) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM H), I AS (SELECT *, sum(CASE WHEN last IS NULL OR s > last + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM L) SELECT conv_id, min(s) AS s, max(e) AS e, count(*) AS n FROM I GROUP BY conv_id, isle",
    "w10_sessions": "WITH L AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), I AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM L) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM I GROUP BY user_id, k",
    "t5_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "t6_ttl": "WITH X AS (SELECT user_id, ts, event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS card, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS t FROM events WHERE event_type IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), F AS (SELECT *, row_number() OVER (PARTITION BY card, event_type ORDER BY ts, event_id) AS r FROM X WHERE event_type <> 'view' AND card IS NOT NULL AND ts <= t + INTERVAL 300 MINUTE) SELECT user_id, card, event_id AS edit, event_type AS kind FROM F WHERE r = 1",
    "t7_buckets": "SELECT strftime(ts, '%Y-%m') AS bucket, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT strftime(ts, '%G-W%V'), count(*) FROM events GROUP BY 1",
    "t8_ledger": "SELECT strftime(ts, '%Y-%m-%d') AS at, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "a9_spread": "SELECT l_returnflag, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY 1",
    "a10_buckets": "SELECT event_type, count(*) FILTER (WHERE value >= 75) AS actionable, count(*) FILTER (WHERE value >= 25 AND value < 75) AS review, count(*) FILTER (WHERE value < 25) AS dismissed FROM events GROUP BY 1",
    "a11_shared": "WITH Q AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT x.s AS a, y.s AS b, CAST(sum(least(x.c, y.c)) AS BIGINT) AS shared FROM Q x JOIN Q y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2",
    "a15_coverage": "SELECT source, max(quality) AS peak, count(quality) AS seen, count(*) FILTER (WHERE quality IS NULL) AS unseen, bool_or(toxic = 1) AS any_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "labels_tristate": "SELECT doc_id, CASE quality WHEN 1 THEN 'covered' WHEN 0 THEN 'idle' ELSE 'unknown' END AS state, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "a16_lifetime": "SELECT event_type AS counter, count(*) AS n FROM events GROUP BY 1",
    "a17_statistics": f"WITH G AS (SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS hits, count(*) AS n, regr_slope(ln(l_extendedprice), ln(l_quantity)) AS slope, regr_r2(ln(l_extendedprice), ln(l_quantity)) AS r2, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1), P AS (SELECT *, hits / n AS p FROM G) SELECT l_returnflag, hits, n, round((p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 6) AS lo, round((p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 6) AS hi, round(slope, 6) AS slope, round(r2, 6) AS r2, round(p95, 6) AS p95 FROM P",
    "a18_scores": "WITH F AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount >= 0.05), T AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 20), B AS (SELECT coalesce(F.l_partkey, T.l_partkey) AS l_partkey, count(F.l_suppkey) AS found, count(T.l_suppkey) AS true_n, count(*) FILTER (WHERE F.l_suppkey IS NOT NULL AND T.l_suppkey IS NOT NULL) AS hit FROM F FULL JOIN T ON F.l_partkey = T.l_partkey AND F.l_suppkey = T.l_suppkey GROUP BY 1) SELECT l_partkey, found, true_n AS \"true\", hit, round(CASE WHEN found > 0 THEN hit / found ELSE 0 END, 9) AS precision, round(CASE WHEN true_n > 0 THEN hit / true_n ELSE 0 END, 9) AS recall FROM B",
    "j2_j3_semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'semi' ELSE 'anti' END AS how FROM customer",
    "j13_suffix": "WITH P AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages), W AS (SELECT page_id, array_to_string(list_slice(string_split(path, '/'), 2, 100), '/') AS tail FROM P) SELECT page_id, min(K.path) AS path FROM W JOIN (SELECT DISTINCT path FROM P) K ON (K.path = tail OR K.path LIKE '%/' || tail) WHERE tail <> '' GROUP BY page_id HAVING count(DISTINCT K.path) = 1",
}
