"""Run records, metrics, data tiers, lifecycles and memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tempora.operators.identity import cosine
from tempora.operators.temporal import preceding

#: The tiers in rising order, and the legal steps of an artefact.
TIERS = ("L0", "L1", "L2", "L3")
STAGES = ("candidate", "validated", "owner_approved", "shadow", "active")
TWELVE = (
    "ingest_due_sources", "materialize_events", "update_narratives", "build_world_state", "load_personal_state", "calculate_exposures",
    "calculate_impacts", "update_scenarios", "evaluate_policies", "derive_decision_candidates", "persist_run_record", "route_alerts",
)


class TierViolation(Exception):
    """A release above the receiver's clearance."""


def tier_of(schema: StructType, column: str) -> str:
    """The tier a field declares (L1); a field without one is an error."""
    tier = schema[column].metadata.get("tier")
    if tier not in TIERS:
        raise TierViolation(f"{column} declares no tier")
    return tier


def max_tier(schema: StructType, columns: Sequence[str]) -> str:
    """The tier of what is made from these columns: the highest of theirs (L2)."""
    return max((tier_of(schema, c) for c in columns), key=TIERS.index)


def assert_clearance(schema: StructType, columns: Sequence[str], clearance: str) -> None:
    """Fail before anything is released above the clearance (L3)."""
    if TIERS.index(tier := max_tier(schema, columns)) > TIERS.index(clearance):
        raise TierViolation(f"columns of tier {tier} need more than clearance {clearance}")


def _rank(tier: Column) -> Column:
    """The place of a tier in their order, from 1; 0 for what is no tier, null for null."""
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def highest_tier(inputs: DataFrame, keys: Sequence[str], tier: str) -> DataFrame:
    """The tier of each output made from rows of inputs (L2): the highest of theirs. An input without a known tier makes the output's null."""
    known = F.when(F.col(tier).isin(*TIERS), _rank(F.col(tier)))
    best = F.when(F.count(F.lit(1)) == F.count(known), F.max(known))
    return inputs.groupBy(*keys).agg(best.alias("__rank")).select(*keys, F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("__rank").cast("int") - 1).alias(tier))


def over_clearance(calls: DataFrame, tier: str, clearance: str) -> DataFrame:
    """The calls that must not be made (L3): their tier is above the receiver's clearance, or one of the two is not known."""
    fits = (_rank(F.col(tier)) > 0) & (_rank(F.col(tier)) <= _rank(F.col(clearance)))
    return calls.filter(~F.coalesce(fits, F.lit(False)))


def lowered_tiers(old: StructType, new: StructType) -> list[str]:
    """Fields whose tier went down between two schemas."""
    return [f.name for f in new.fields if f.name in old.names and TIERS.index(tier_of(new, f.name)) < TIERS.index(tier_of(old, f.name))]


def transform_l2(df: DataFrame, owner: str, amount: str, institution: str, country: Column, keep: Sequence[str], cuts: Sequence[tuple[float, str]]) -> DataFrame:
    """Release form (L4): amounts as buckets, institutions as numbered roles, places as countries; the rest is dropped."""
    bucket = F.lit("top")
    for at, name in reversed(list(cuts)):
        bucket = F.when(F.col(amount) < at, name).otherwise(bucket)
    pairs = df.select(F.col(owner).alias("__owner"), F.col(institution).alias("__institution")).distinct()
    rank = F.row_number().over(Window.partitionBy("__owner").orderBy("__institution"))  # one row for each institution
    roles = pairs.withColumn("__role", F.concat(F.lit("institution_"), rank.cast("string")))
    same = F.col(owner).eqNullSafe(F.col("__owner")) & F.col(institution).eqNullSafe(F.col("__institution"))
    released = [F.col(k) for k in keep] + [bucket.alias("amount_bucket"), F.col("__role").alias("institution_role"), country.alias("country")]
    return df.join(roles, same).select(*released)


def release(tier: Column, clearance: Column, transform_required: Column, transformed: Column) -> Column:
    """What may be sent to a provider (L8): refused above its clearance or without one; from L2 on transformed first where that is required."""
    above = clearance.isNull() | (_rank(tier) == 0) | (_rank(tier) > _rank(clearance))
    return F.when(F.coalesce(above, F.lit(True)), "refused").when((_rank(tier) >= _rank(F.lit("L2"))) & transform_required & ~transformed, "transform_first").otherwise("allowed")


def stage_counts(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row for each stage with its number of rows (R2)."""
    out = None
    for name, frame in frames:
        row = frame.agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit(name)).select("stage", "rows")
        out = row if out is None else out.unionByName(row)
    return out


#: Statuses and results that stand for data a run did not have.
MISSING = ("incomplete", "unknown", "UNKNOWN_DATA", "no_total", "stale")


def run_cycle(
    stages: dict[str, Callable[[dict[str, DataFrame], str], DataFrame]],
    tables: dict[str, DataFrame],
    as_of: str,
    run_id: str,
    save: Callable[[DataFrame], DataFrame],
    seconds: Callable[[], float] | None = None,
) -> tuple[dict[str, DataFrame], list[dict]]:
    """The twelve stages in order (R1), each on what stands before it. A failure degrades the run and is recorded.

    ``save`` writes and rereads a stage, so that what fails while it is worked
    out fails here, and no stage is worked out twice. The record has for each
    stage its rows, the rows that stand for missing data, and its time by the
    clock ``seconds``, if one is given (R2); rows are counted while they are written.
    """
    state, record = dict(tables), []
    for name in TWELVE:
        row = {"run_id": run_id, "as_of": as_of, "stage": name, "status": "skipped", "rows": None, "missing": None, "seconds": None, "error": None}
        record.append(row)
        if name not in stages:
            continue
        start = seconds() if seconds else None
        try:
            todo = stages[name](state | {"run": record}, as_of)
            lacks = F.lit(False)
            for c in ("status", "result"):
                if c in todo.columns:
                    lacks = lacks | F.coalesce(F.col(c).cast("string").isin(*MISSING), F.lit(True))
            seen = Observation(f"{run_id}-{name}")
            state[name] = save(todo.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(lacks).alias("missing")))
            row |= {"status": "ok", "rows": seen.get.get("rows", 0), "missing": seen.get.get("missing", 0)}
        except Exception as e:  # noqa: BLE001 - any provider or engine error is recorded
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        row["seconds"] = seconds() - start if seconds else None
    return state, record


def call_totals(calls: DataFrame, cost: str) -> tuple[int, float]:
    """The number of model calls of a run and what they cost (R2, R3); a call without a price costs nothing."""
    n = calls.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(cost).cast("double")), F.lit(0.0)).alias("cost")).first()
    return n["n"], n["cost"]


def run_record(record: Sequence[dict], sources: Sequence[tuple[str, str, str | None]] = (), calls: tuple[int, float] = (0, 0.0)) -> dict:
    """One row for a run (R2): stages and sources that answered or failed, model calls and their cost, time, missing data, status."""
    failed = sum(r["status"] == "failed" for r in record)
    silent = sum(s[1] != "ok" for s in sources)
    times = [r["seconds"] for r in record if r["seconds"] is not None]
    return {
        "run_id": record[0]["run_id"], "as_of": record[0]["as_of"], "stages_ok": sum(r["status"] == "ok" for r in record), "stages_failed": failed,
        "sources_ok": len(sources) - silent, "sources_failed": silent, "model_calls": calls[0], "cost": float(calls[1]),
        "seconds": sum(times) if times else None, "missing": sum(r["missing"] or 0 for r in record), "status": "degraded" if failed or silent else "ok",
    }


def streaks(days: DataFrame, day: str, ok: str) -> DataFrame:
    """Runs of consecutive good days (R5): start, end, length."""
    good = days.filter(ok).select(F.col(day).cast("date").alias("d")).distinct()
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d"))  # one row for each day
    return good.withColumn("island", F.date_sub("d", n)).groupBy("island").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("length")).drop("island")


def extraction_scores(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Precision and recall against a golden set (Q1)."""
    both = expected.select(*key).distinct().withColumn("e", F.lit(1)).join(actual.select(*key).distinct().withColumn("a", F.lit(1)), list(key), "full_outer")
    n = both.agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    return n.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


def purity(items: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of items with the most frequent label of their cluster (Q2)."""
    n = items.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(cluster).agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return best.agg((F.sum("best") / F.sum("size")).alias("purity"), F.count(F.lit(1)).alias("clusters"))


def illegal_steps(transitions: DataFrame, artefact: str, order: Sequence[str], state: str) -> DataFrame:
    """Steps of an artefact that its lifecycle does not allow (G1). The first of ``order`` is a time."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col(state))
    before = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("previous"))
    legal = F.when(F.col("previous").isNull(), F.col(state) == "candidate").when(F.col(state).isin("demoted", "superseded"), F.col("previous") == "active").otherwise((before > 0) & (rank == before + 1))
    return preceding(transitions, [artefact], order[0], order[1:], state, "previous").withColumn("legal", legal).filter(~F.col("legal"))


def promotable(confirmations: DataFrame, rule: str, least: int, approved: DataFrame) -> DataFrame:
    """Rules confirmed often enough, and whether the owner approved them."""
    n = confirmations.groupBy(rule).agg(F.count(F.lit(1)).alias("confirmations")).filter(F.col("confirmations") >= least)
    return n.join(approved.select(rule, F.lit(True).alias("approved")), rule, "left").withColumn("approved", F.coalesce("approved", F.lit(False)))


#: The distribution function of Poisson(1) at 0, 1, 2, ...
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)


def bootstrap_weight(row: Column, draw: Column) -> Column:
    """How often a row is drawn in a resample: Poisson(1) by a digest of the row's key and the resample's number, the same in every run."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", draw.cast("string"), row.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    out = F.lit(len(_POISSON))
    for k in reversed(range(len(_POISSON))):
        out = F.when(u < _POISSON[k], k).otherwise(out)
    return out


def validate_candidate(replayed: DataFrame, groups: Sequence[str], key: str, old: str, new: str, outcome: str, draws: int = 200, share: float = 0.95) -> DataFrame:
    """Whether a candidate would have improved past outcomes (G5): Brier scores under both versions, the interval of their difference, a verdict.

    ``replayed`` has what both versions would have said of each past case, from
    what was known then. All resamples are drawn in one pass: each is a sum for
    each task, so only ``draws`` rows a group and task are shuffled. ``improves``
    needs the whole interval above zero; cases without an outcome do not count.
    """
    loss = lambda c: F.pow(F.col(c).cast("double") - F.col(outcome).cast("double"), F.lit(2.0))
    cases = replayed.filter(F.col(outcome).isNotNull() & F.col(old).isNotNull() & F.col(new).isNotNull()).select(*groups, F.col(key).alias("__key"), loss(old).alias("__old"), loss(new).alias("__new"))
    plain = cases.groupBy(*groups).agg(F.count(F.lit(1)).alias("cases"), F.avg("__old").alias("old_brier"), F.avg("__new").alias("new_brier"))
    drawn = cases.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__w", bootstrap_weight(F.col("__key"), F.col("__draw")))
    gains = drawn.groupBy(*groups, "__draw").agg(F.try_divide(F.sum(F.col("__w") * (F.col("__old") - F.col("__new"))), F.sum("__w")).alias("__gain"))
    tail = int(draws * (1 - share) / 2)
    ordered = gains.groupBy(*groups).agg(F.array_sort(F.collect_list("__gain")).alias("__g"))
    # A resample that drew no case has no gain and is not in the list.
    ends = ordered.select(*groups, F.get("__g", F.lit(tail)).alias("low"), F.get("__g", F.size("__g") - 1 - tail).alias("high"))
    verdict = F.when(F.col("low") > 0, "improves").when(F.col("high") < 0, "worse").otherwise("undecided")
    return plain.join(ends, list(groups)).withColumn("verdict", verdict)


def latest_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each topic and the number it supersedes (M3)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m"), (F.count(F.lit(1)) - 1).alias("superseded")).select(*keys, "m.*", "superseded")


#: The kinds of qualitative material that memory holds.
MEMORY_KINDS = ("reasoning", "preference", "lesson", "concern", "explanation")


class SemanticMemoryPort(Protocol):
    """Qualitative memory (M1). What it recalls is never an authority for a quantity, status, probability, threshold or date."""

    def remember(self, rows: DataFrame) -> DataFrame:
        """The rows that may be stored."""

    def recall(self, topic: str, query: Sequence[float], k: int) -> DataFrame:
        """The k nearest memories of a topic, marked as not authoritative."""


class TableMemory:
    """Memory over a table of id, topic, kind, text and embedding."""

    def __init__(self, table: DataFrame):
        self.table = table

    def remember(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("kind").isin(*MEMORY_KINDS)).join(self.table.select("id"), "id", "left_anti")

    def recall(self, topic: str, query: Sequence[float], k: int) -> DataFrame:
        near = nearest(self.table.filter(F.col("topic") == topic), "id", "embedding", query, k)
        return near.withColumn("authoritative", F.lit(False))


def nearest(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """The k vectors of highest cosine with a query vector (M2); ties by key. Exact."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def embedding_field(schema: StructType, text: str, name: str) -> StructField:
    """The field of a text's embedding, which has the tier of the text."""
    return StructField(name, ArrayType(FloatType()), True, {"tier": tier_of(schema, text)})
