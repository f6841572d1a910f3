"""Episodes in long histories, and "the last three times X while Y, what happened" (J6).

X is a sequence of rows of one key, told by a small automaton. Histories are cut
into time buckets, so a key that holds a third of all rows is matched by many
tasks. An automaton's step over a bucket is a map from the state at its begin to
the state at its end, whatever came before; so the buckets' maps are worked out
first, each on its own, then strung together (one row for each key and bucket),
and a second pass over the buckets, whose first states are now known, reports the
episodes. Episodes may reach over any number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tempora.operators.temporal import asof_join, disjoint_interval_join

#: Rows that a task hands over at once.
_ROWS = 10_000


@dataclass(frozen=True)
class Automaton:
    """States 0, 1, ...; 0 waits. ``moves[state]`` gives the next state of a symbol; of others that of None, or 0.

    An episode begins with the row that leaves state 0, ends with the one that
    reaches ``accept``, and then the automaton waits again. One that falls back
    to 0 is none.
    """

    moves: tuple[dict[str | None, int], ...]
    accept: int

    def step(self, symbol: str | None, place: tuple, state: int, start: tuple | None) -> tuple[int, tuple | None, tuple | None]:
        """(state, place at which the open episode began, episode as its two places) after one more row."""
        table = self.moves[state]
        now = table.get(symbol, table.get(None, 0))
        if state == 0 and now != 0:
            start = place
        if now == self.accept:
            return 0, None, (start, place)
        return now, start if now else None, None


def _rows(batches, names: Sequence[str]):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in names], strict=True)


def _batch(rows: list[tuple], schema: pa.Schema):
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def match(df: DataFrame, keys: Sequence[str], time_col: str, tie: str, symbol: str, automaton: Automaton, bucket: str = "day") -> DataFrame:
    """keys, started, ended, and the ``tie`` of both rows (first, last), of every episode. Rows are ordered by time, then ``tie``, an integer.

    Rows without a time are left out; a null symbol is one that the automaton does not name; null keys are one key.
    Sorted partitions are streamed through the automaton, so no task holds the rows of a key or bucket.
    """
    rows = df.filter(F.col(time_col).isNotNull()).select(
        *keys, F.unix_micros(F.date_trunc(bucket, time_col)).alias("__bucket"), F.unix_micros(time_col).alias("__at"), F.col(tie).cast("long").alias("__tie"), F.col(symbol).cast("string").alias("__symbol")
    )
    n, by = len(keys), [*keys, "__bucket"]
    key_fields = list(to_arrow_schema(rows.select(*keys).schema))
    key_ddl = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    long, place = pa.int64(), pa.list_(pa.int64())
    map_schema = pa.schema([*key_fields, ("__bucket", long), ("ends", pa.list_(pa.int32())), ("starts", pa.list_(place))])
    entry_schema = pa.schema([*key_fields, ("__bucket", long), ("state", pa.int32()), ("begun", place)])
    found_schema = pa.schema([*key_fields, *[(c, long) for c in ("started", "first", "ended", "last")]])
    names = [*by, "__at", "__tie", "__symbol"]

    def mapped(batches):
        """For every key and bucket, and every state at its begin: the state at its end, and where the then open episode began."""
        group, at, out = None, [], []
        for row in _rows(batches, names):
            if row[: n + 1] != group:
                if group is not None:
                    out.append((*group, [s for s, _ in at], [x for _, x in at]))
                group, at = row[: n + 1], [(s, None) for s in range(len(automaton.moves))]
            at = [automaton.step(row[-1], row[-3:-1], s, x)[:2] for s, x in at]
            if len(out) >= _ROWS:
                yield _batch(out, map_schema)
                out = []
        if group is not None:
            out.append((*group, [s for s, _ in at], [x for _, x in at]))
        yield _batch(out, map_schema)

    def strung(batches):
        """For every key and bucket the state at its begin."""
        key, state, begun, out = None, 0, None, []
        for *head, ends, starts in _rows(batches, map_schema.names):
            if head[:n] != key:
                key, state, begun = head[:n], 0, None
            out.append((*head, state, begun))
            inside, state = starts[state], ends[state]
            begun = (begun if inside is None else inside) if state else None
            if len(out) >= _ROWS:
                yield _batch(out, entry_schema)
                out = []
        yield _batch(out, entry_schema)

    def reported(batches):
        group, state, begun, out = None, 0, None, []
        for row in _rows(batches, [*names, "state", "begun"]):
            if row[: n + 1] != group:
                group, state, begun = row[: n + 1], row[-2], row[-1]
            state, begun, episode = automaton.step(row[-3], row[-5:-3], state, begun)
            if episode:
                out.append((*row[:n], *episode[0], *episode[1]))
            if len(out) >= _ROWS:
                yield _batch(out, found_schema)
                out = []
        yield _batch(out, found_schema)

    maps = rows.repartition(*by).sortWithinPartitions(*by, "__at", "__tie").mapInArrow(mapped, f"{key_ddl}__bucket long, ends array<int>, starts array<array<long>>")
    entries = maps.repartition(*(keys or [F.lit(0)])).sortWithinPartitions(*by).mapInArrow(strung, f"{key_ddl}__bucket long, state int, begun array<long>")
    known = entries.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), "state", "begun")
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    told = rows.join(known, same).select(*names, "state", "begun").repartition(*by).sortWithinPartitions(*by, "__at", "__tie")
    episodes = told.mapInArrow(reported, f"{key_ddl}started long, first long, ended long, last long")
    return episodes.select(*keys, F.timestamp_micros("started").alias("started"), "first", F.timestamp_micros("ended").alias("ended"), "last")


def next_after(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], ties: Sequence[str], within: str, bucket: str = "day") -> DataFrame:
    """Every left row with the values of the first right row of its key that is later, and at most ``within`` (an interval) later, else nulls.

    An as-of join with time reversed. Of rows at the same instant that with the smallest ties comes first; ties are numbers.
    """
    back = lambda c: F.timestamp_micros(-F.unix_micros(c))
    # One microsecond before the mirrored instant: rows at the same instant are not later.
    asked = left.withColumn("__then", F.timestamp_micros(-F.unix_micros(left_time) - 1))
    given = right.select(*on, back(right_time).alias("__then_r"), F.col(right_time).alias("__real"), *values, *[(-F.col(c)).alias(f"__t{i}") for i, c in enumerate(ties)])
    met = asof_join(asked, given, on, "__then", "__then_r", ["__real", *values], [f"__t{i}" for i in range(len(ties))], bucket)
    near = F.col("__real") <= F.col(left_time) + F.expr(f"INTERVAL {within}")
    return met.select(*left.columns, F.when(near, F.col("__real")).alias("outcome_at"), *[F.when(near, F.col(v)).alias(v) for v in values])


def last_times(
    episodes: DataFrame, history: DataFrame, while_: Column, outcomes: DataFrame, keys: Sequence[str], outcome_time: str, values: Sequence[str], ties: Sequence[str],
    within: str, k: int = 3, history_ties: Sequence[str] = (),
) -> DataFrame:
    """The last ``k`` episodes of each key that ended while a state held, with what happened next (J6); nth 1 is the latest.

    ``history`` has disjoint intervals (valid_from, valid_to) of the keys' state, of which ``while_`` speaks.
    """
    held = disjoint_interval_join(episodes, history, keys, "ended", history_ties).filter(while_)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ended"), F.desc("last")))
    latest = held.withColumn("nth", rank).filter(F.col("nth") <= k)
    return next_after(latest, outcomes, keys, "ended", outcome_time, values, ties, within)
