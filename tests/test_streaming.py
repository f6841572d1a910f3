import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tempora.streaming import ingest


def cursor_source():
    """A provider for tests: (id, value) rows behind a numeric cursor. Made here, so that workers get its code and not a module's name."""

    class CursorReader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.size, self.total = int(options.get("fetch", 3)), int(options.get("total", 6))

        def initialOffset(self) -> dict:
            return {"cursor": 0}

        def read(self, start: dict):
            end = min(start["cursor"] + self.size, self.total)
            return iter([(i, f"item {i}") for i in range(start["cursor"], end)]), {"cursor": end}

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter([(i, f"item {i}") for i in range(start["cursor"], end["cursor"])])

    class CursorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "cursor_source"

        def schema(self) -> str:
            return "id int, value string"

        def simpleStreamReader(self, schema) -> CursorReader:
            return CursorReader(self.options)

    return CursorSource


def test_a_restart_resumes_from_the_cursor(spark, tmp_path):
    spark.dataSource.register(cursor_source())
    target, check = str(tmp_path / "t"), str(tmp_path / "c")
    counts = []
    for _ in range(3):
        stream = spark.readStream.format("cursor_source").option("total", 6).load()
        ingest.ingest_new(stream, target, check, ["id"], ["value"])
        counts.append(spark.read.parquet(target).select("id").count())
    assert counts[-1] == 6 and counts == sorted(counts)


def test_stored_keys_are_not_added_again(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    rows = spark.range(5).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    rows.write.mode("append").parquet(source)
    ingest.ingest_new(spark.readStream.schema(rows.schema).parquet(source), target, str(tmp_path / "c"), ["id"], ["value"])
    rows.unionByName(spark.range(5, 7).select("id", F.lit("new").alias("value"))).write.mode("append").parquet(source)
    ingest.ingest_new(spark.readStream.schema(rows.schema).parquet(source), target, str(tmp_path / "c"), ["id"], ["value"])
    assert sorted(r["id"] for r in spark.read.parquet(target).select("id").collect()) == list(range(7))


ITEM = "ext string, url string, at long, text string"


def test_layers_ties_nulls_and_late_rows(spark, tmp_path):
    source, target, check = str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c")

    def take(*rows):
        spark.createDataFrame(list(rows), ITEM).write.mode("append").parquet(source)
        ingest.ingest_new(spark.readStream.schema(ITEM).parquet(source), target, check, ["ext", "url"], ["at", "text"])
        return sorted((r["ext"], r["url"], r["text"]) for r in spark.read.schema(ITEM).parquet(target).fillna("-").collect())

    # Of equal keys in a batch the first by time, then text; rows without a key are all kept.
    first = take(("a", "u1", 5, "y"), ("a", "u1", 5, "x"), ("b", "u1", 9, "later, same address"), (None, None, 1, "n"), (None, None, 1, "n"), ("c", None, None, "null time"), ("c", None, 3, "timed"))
    assert first == [("-", "-", "n"), ("-", "-", "n"), ("a", "u1", "x"), ("c", "-", "null time")]
    # Older than all before, with new keys: it is ingested. Known keys are not, in whatever layer.
    second = take(("d", "u2", -100, "late"), ("e", "u1", 10, "known address"), ("a", "u9", 10, "known id"), ("e", "u7", 11, "its id was met"))
    assert second == sorted([*first, ("d", "u2", "late")])
    assert take(("d", "u2", -100, "late"), ("a", "u1", 5, "x")) == second


def test_the_work_of_a_batch_follows_the_batch(spark, tmp_path):
    read = []
    for name, history in (("small", 200), ("large", 5000)):
        source, target, check = (str(tmp_path / name / x) for x in "stc")
        make = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
        make(0, history).write.mode("append").parquet(source)
        schema = make(0, 1).schema
        ingest.ingest_new(spark.readStream.schema(schema).parquet(source), target, check, ["id", "url"], ["id"])
        make(history - 20, history + 30).write.mode("append").parquet(source)
        last = ingest.ingest_new(spark.readStream.schema(schema).parquet(source), target, check, ["id", "url"], ["id"])
        assert spark.read.parquet(target).count() == history + 30
        work = [p for p in last if p["numInputRows"]]
        read.append((sum(p["numInputRows"] for p in work), sum(s["numRowsUpdated"] for p in work for s in p["stateOperators"])))
        assert sum(s["numRowsTotal"] for s in work[-1]["stateOperators"]) == 2 * (history + 30)
    assert read[0] == read[1] == (50, 60)


def test_a_batch_that_runs_again_adds_nothing_twice(spark, tmp_path):
    source, target, check = str(tmp_path / "s"), str(tmp_path / "t"), tmp_path / "c"
    spark.range(10).selectExpr("id", "'x' AS v").write.parquet(source)
    read = lambda: spark.readStream.schema("id long, v string").parquet(source)
    ingest.ingest_new(read(), target, str(check), ["id"], ["id"])
    # As if the driver had died behind the write: the batch was not marked as done.
    for f in (check / "commits").iterdir():
        f.unlink()
    ingest.ingest_new(read(), target, str(check), ["id"], ["id"])
    assert spark.read.parquet(target).count() == 10


def test_ingest_keeps_the_sessions_caches_and_settings(spark, tmp_path):
    held = spark.range(7).cache()
    held.count()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.range(3).selectExpr("id", "'x' AS v").write.parquet(str(tmp_path / "s"))
    ingest.ingest_new(spark.readStream.schema("id long, v string").parquet(str(tmp_path / "s")), str(tmp_path / "t"), str(tmp_path / "c"), ["id"], ["id"])
    assert held.storageLevel.useMemory and spark._jsparkSession.sharedState().cacheManager().lookupCachedData(held._jdf).isDefined()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    held.unpersist()


def test_windows_close_behind_the_watermark(spark, tmp_path):
    spark.sql("SELECT explode(sequence(0, 9)) AS id").select("id", F.timestamp_seconds(F.col("id") * 43200 + 864000).alias("ts"), F.lit("a").alias("kind")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id int, ts timestamp, kind string").parquet(str(tmp_path / "s"))
    out = ingest.event_counts(stream, "ts", "1 day", "1 day", ["kind"], "id")
    q = out.writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counts").collect()
    assert {r["n"] for r in got} == {2}, got


def test_silent_sources_by_timers(spark, tmp_path):
    source, target, check = str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c")
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def hear(*rows):
        made = [(s, start + dt.timedelta(minutes=m), 60) for s, m in rows]
        spark.createDataFrame(made, "id string, ts timestamp, every int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id string, ts timestamp, every int").parquet(source)
        ingest.write_stream(ingest.silences(stream, "id", "ts", "every", "10 minutes"), target, check)
        found = spark.read.schema("source string, last_seen timestamp, silent_from timestamp").parquet(target).collect()
        return sorted((r["source"], int((r["silent_from"].astimezone(dt.timezone.utc) - start).total_seconds() // 60)) for r in found)

    assert hear(("a", 0), ("b", 0), ("b", 30), (None, 1)) == []
    assert hear(("c", 71)) == [("a", 60)]  # b spoke at 30, so it is due at 90
    assert hear(("b", 80), ("c", 120)) == [("a", 60)]  # b moved its timer to 140
    assert hear(("a", 125), ("c", 300)) == [("a", 60), ("a", 185), ("b", 140)]
