import datetime as dt

from pyspark.sql import functions as F

from loomgraph.operators import series
from loomgraph.streaming import incremental

T0 = dt.datetime(2024, 1, 31, 23, 0)


def rows():
    at = lambda m: T0 + dt.timedelta(minutes=m)
    return [(1, 1, "card", at(0)), (1, 2, "click", at(5)), (1, 3, "click", at(6)), (1, 4, "buy", at(29)), (1, 5, "buy", at(90)), (2, 6, "click", at(1)), (2, 7, "card", at(2)), (2, 8, "card", at(10)), (2, 9, "click", at(35)), (1, 10, "card", at(100)), (1, 11, "buy", at(131))]


def stream(spark, tmp_path, data, schema):
    for i, part in enumerate((data[: len(data) // 2], data[len(data) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


SCHEMA = "user long, id long, kind string, ts timestamp"


def test_followed_stream_equals_batch(spark, tmp_path):
    data = sorted(rows(), key=lambda r: r[3])
    s = stream(spark, tmp_path, data, SCHEMA)
    got = {tuple(r) for r in run(incremental.followed(s.withWatermark("ts", "1 day"), "user"), tmp_path, "followed").collect()}
    b = spark.createDataFrame(data, SCHEMA)
    batch = series.followed(b.where("kind = 'card'"), b.where("kind <> 'card'"), "user")
    assert got == {(r.user, r.card, r.edit, r.kind) for r in batch.collect()} == {(1, 1, 2, "click"), (1, 1, 4, "buy"), (2, 8, 9, "click")}


def test_dedup_and_counts(spark, tmp_path):
    s = stream(spark, tmp_path, rows(), SCHEMA)
    once = run(incremental.flag_once(s, ["user", "kind"]), tmp_path, "once")
    assert once.count() == len({(r[0], r[2]) for r in rows()})
    months = run(incremental.month_counts(s), tmp_path, "months", "complete")
    assert {(r.bucket, r.kind, r.n) for r in months.where("kind = 'card'").collect()} == {("2024-01", "card", 3), ("2024-02", "card", 1)}


def test_upsert(spark, tmp_path):
    w = incremental.upsert(str(tmp_path / "t"), ["k"], "v")
    w(spark.createDataFrame([(1, 1), (2, 5)], "k int, v int"), 0)
    for _ in range(2):
        w(spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "k int, v int"), 1)
    assert {tuple(r) for r in incremental.current(spark, str(tmp_path / "t")).collect()} == {(1, 2), (2, 5), (3, 1)}
    known = spark.createDataFrame([("a", 1), ("b", 2)], "file string, size int")
    assert [r.file for r in incremental.stale(spark.createDataFrame([("a", 1), ("b", 3)], "file string, size int"), known).collect()] == ["b"]
    c = spark.createDataFrame([("a", "x"), ("b", "y")], "file string, label string")
    assert [r.file for r in incremental.recompute(c, c.where("label = 'y'")).collect()] == ["b"]
    assert series.islands(spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 8, 9)], "g int, s int, e int"), ["g"], "s", "e").count() == 2
    assert F is not None
