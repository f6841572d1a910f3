"""Incremental ingest with Structured Streaming (S1, D7), and silent sources by timers.

What has been ingested is remembered as keyed state: each identity layer (such as
external id, canonical address, content hash) is one ``transformWithState`` over
its keys, so a batch looks up its own keys in the state store and never reads
what is stored. A restart goes on from the checkpoint; a batch that is run again
starts from the state before it and replaces its own folder, so nothing is added
twice. State has no watermark: a row that comes late, by whatever time, is
ingested if its keys are new.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Rows without a key in a layer are dealt out over so many groups; they have no state.
_NO_KEY_GROUPS = 4096
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through, by a total order within its batch; later batches bring it no more."""

    def __init__(self, columns: Sequence[str], order: Sequence[str]):
        self.columns, self.order = list(columns), list(order)

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "once boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        plain = lambda r: Row(**{c: r[c] for c in self.columns})
        if key[0] is None:
            yield from map(plain, rows)
        elif not self.seen.exists():
            self.seen.update((True,))
            # Nulls first, as Spark sorts them.
            yield plain(min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]))

    def close(self) -> None:
        pass


def new_items(stream: DataFrame, layers: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a stream that no layer has met (D7), layer after layer; a null key in a layer says nothing.

    A key counts as met as soon as a row with it has reached its layer, also if a
    later layer then knew the row.
    """
    columns, out = stream.columns, stream
    for key in layers:
        spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*columns), F.lit(_NO_KEY_GROUPS)))
        dealt = out.withColumns({"__key": F.col(key).cast("string"), "__spread": spread})
        out = dealt.groupBy("__key", "__spread").transformWithState(_FirstOfKey(columns, order), stream.schema, "Append", "None")
    return out


def _started(writer, spark):
    """Start a query whose state lies in RocksDB, which only this query is told."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def ingest_new(stream: DataFrame, target: str, checkpoint: str, layers: Sequence[str], order: Sequence[str]) -> list[dict]:
    """Read what is there, append the rows that no layer knows to ``target``/batch=n, and stop. Returns the progress of each batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    writer = new_items(stream, layers, order).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = _started(writer, stream.sparkSession)
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]


def event_counts(stream: DataFrame, time_col: str, late: str, window: str, keys: Sequence[str], id_col: str) -> DataFrame:
    """Counts for each window of different events; rows later than the watermark are left out."""
    once = stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])
    return once.groupBy(F.window(time_col, window), *keys).agg(F.count(F.lit(1)).alias("n"))


class _Silence(StatefulProcessor):
    """One timer for each source, at its last item plus its interval; an item moves it, and if it fires the source is silent."""

    def __init__(self, time_col: str, minutes_col: str):
        self.time_col, self.minutes_col = time_col, minutes_col

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_ms long, due_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get() if self.last.exists() else None
        seen = due = None
        for r in rows:
            at = int(r[self.time_col].timestamp() * 1000)
            if seen is None or at > seen:
                seen, due = at, at + int(r[self.minutes_col]) * 60_000
        if known is None or seen > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[1])
            self.last.update((seen, due))
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, due = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() == due:
            yield Row(source=key[0], seen_ms=seen, due_ms=due)

    def close(self) -> None:
        pass


def silences(stream: DataFrame, source: str, time_col: str, minutes_col: str, late: str) -> DataFrame:
    """(source, last_seen, silent_from) whenever the stream's time passes a source's last item plus its expected interval.

    Time is that of the items, ``late`` behind the newest; no clock is read. A
    source that speaks again can fall silent again.
    """
    timed = stream.select(F.col(source).cast("string").alias("source"), F.col(time_col).alias("__at"), F.col(minutes_col).cast("long").alias("__minutes")).filter("source IS NOT NULL AND __at IS NOT NULL AND __minutes IS NOT NULL")
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("seen_ms", T.LongType()), T.StructField("due_ms", T.LongType())])
    out = timed.withWatermark("__at", late).groupBy("source").transformWithState(_Silence("__at", "__minutes"), schema, "Append", "EventTime")
    return out.select("source", F.timestamp_millis("seen_ms").alias("last_seen"), F.timestamp_millis("due_ms").alias("silent_from"))


def write_stream(out: DataFrame, target: str, checkpoint: str) -> list[dict]:
    """Append a stream's rows to the Parquet folder ``target``, as far as there is input, and stop."""
    writer = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    query = _started(writer, out.sparkSession)
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]
