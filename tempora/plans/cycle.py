"""The daily cycle (R1): all twelve stages over the test tables, as of one instant.

Every stage is a pure function of the tables, of what stands before it, and of
``as_of``; a replay is the same call with another instant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import decisions as J
from tempora.operators import governance as G
from tempora.operators import identity as I
from tempora.operators import impact as M
from tempora.operators import portfolio as P
from tempora.operators import scenarios as C
from tempora.operators import temporal as T
from tempora.operators import world as W
from tempora.plans.registry import Tables, day, query
from tempora.sources import tables

Frames = dict[str, DataFrame]
AS_OF = "2024-01-15 00:00:00"


def ingest(s: Frames, as_of: str) -> DataFrame:
    """Items of the sources that are due, known at the instant."""
    due = T.due_sources(s["sources"], as_of).select("event_type")
    return I.first_of(T.known_at(s["events"], "ts", as_of).join(due, "event_type", "left_semi"), ["event_type", "event_id"], ["ts"])


def events(s: Frames, as_of: str) -> DataFrame:
    items = s["ingest_due_sources"].select(F.concat_ws(":", F.col("user_id").cast("string"), day("ts")).alias("event"), "ts", "event_type")
    return I.materialize_events(items, "event", "ts", ["event_type"])


def narratives(s: Frames, as_of: str) -> DataFrame:
    e = s["ingest_due_sources"]
    rows = e.select(F.col("event_type").alias("narrative"), F.concat_ws(":", F.col("user_id").cast("string"), day("ts")).alias("event"), F.when(F.col("value") >= 25, 1).otherwise(-1).alias("sign"), F.lit(1.0).alias("weight"))
    return W.strength(rows, "narrative", "event", "sign", "weight", 500.0)


def world(s: Frames, as_of: str) -> DataFrame:
    e = s["ingest_due_sources"]
    before = F.expr("INTERVAL 1 DAY")
    mean = lambda df: df.groupBy("event_type").agg(F.avg("value").alias("score"))
    previous = mean(e.filter(F.col("ts") <= T.instant(as_of) - before))
    return W.next_snapshot(previous, mean(e.filter(F.col("ts") > T.instant(as_of) - before)), "event_type", "score")


def personal(s: Frames, as_of: str) -> DataFrame:
    return P.total(s["customer"], ["c_nationkey"], "c_acctbal", name="net_worth")


def exposures(s: Frames, as_of: str) -> DataFrame:
    return P.weights(s["customer"].filter("c_acctbal > 0"), ["c_nationkey"], ["c_mktsegment"], "c_acctbal")


def impacts(s: Frames, as_of: str) -> DataFrame:
    deltas = W.material_deltas(s["build_world_state"], 0.0).select("event_type", "materiality")
    regions = s["calculate_exposures"].filter("c_mktsegment = 'BUILDING'").withColumn("event_type", F.lit("purchase"))
    return M.resolve_exposures(deltas, s["rules"], regions, "event_type", "event_type").withColumn("priority", M.priority_geometric(F.least(F.col("materiality"), F.lit(1.0)), F.col("weight"), F.lit(0.5), F.lit(0.0)))


def scenarios(s: Frames, as_of: str) -> DataFrame:
    e = s["ingest_due_sources"]
    old = F.col("ts") <= T.instant(as_of) - F.expr("INTERVAL 7 DAYS")
    n = e.groupBy("event_type").agg(F.count_if(old).cast("double").alias("a"), F.count_if(~old).cast("double").alias("b")).withColumn("set_id", F.lit(1))
    shares = n.select("set_id", "event_type", C.renormalised(F.col("a"), ["set_id"]).alias("prior"), C.renormalised(F.col("b"), ["set_id"]).alias("target"))
    return C.bounded_update(shares, ["set_id"], "prior", "target", 0.02)


def policies(s: Frames, as_of: str) -> DataFrame:
    metrics = s["load_personal_state"].select(F.lit("net_worth").alias("metric"), F.col("c_nationkey").alias("owner_id"), F.col("net_worth").alias("value"))
    return J.evaluate_policies(metrics, s["policies"])


def decisions(s: Frames, as_of: str) -> DataFrame:
    joined = s["evaluate_policies"].join(s["calculate_impacts"].select(F.col("c_nationkey").alias("owner_id"), "priority").distinct(), "owner_id", "left")
    a = M.attention(F.coalesce("priority", F.lit(0.0)), F.lit(1.0), 0.3, 0.5)
    return joined.select("owner_id", "policy_id", J.candidates(a, F.col("result"), F.lit("portfolio"), F.lit(0.5)).alias("decision_type"))


def record(s: Frames, as_of: str) -> DataFrame:
    """The log of the stages so far; the whole log is appended to its table when the cycle has ended."""
    done = [tuple(r[c] for c in LOG) for r in s["run"] if r["status"] != "skipped"]
    return next(iter(s.values())).sparkSession.createDataFrame(done, tables.SCHEMAS["job_run"])


def alerts(s: Frames, as_of: str) -> DataFrame:
    open_ = s["derive_decision_candidates"].filter("decision_type <> 'NO_ACTION'")
    return M.unsent(open_, s["sent"], ["owner_id"], [F.col("policy_id")])


STAGES = dict(zip(G.TWELVE, (ingest, events, narratives, world, personal, exposures, impacts, scenarios, policies, decisions, record, alerts), strict=True))


LOG = tables.SCHEMAS["job_run"].names


def run(spark, sf_dir: str, as_of: str, run_id: str, root: str | None = None, clock: Callable[[], float] | None = None) -> tuple[Frames, list[dict]]:
    """One cycle. With ``root`` its stage log and its run record are appended to their tables there."""
    t = Tables(spark, sf_dir)
    hour = "2024-01-14 23:00:00"
    # Owners of one region have been told before.
    given = {
        "sent": t.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").cast("int").alias("owner_id")),
        "events": t.events, "customer": t.customer,
        "sources": t.rows("event_type string, interval_minutes int, enabled boolean, last_fetch timestamp", ("click", 60, True, hour), ("view", 15, True, hour), ("purchase", 30, True, None), ("error", 60, True, hour), ("signup", 1440, True, hour)),
        "rules": t.rows("event_type string, how string", ("purchase", "DIRECT_RULE")),
        "policies": t.rows("policy_id string, metric string, operator string, threshold double, margin double, severity string, enabled boolean", ("p1", "net_worth", ">=", 200000.0, 50000.0, "high", True)),
    }
    state, log = G.run_cycle(STAGES, given, as_of, run_id, tables.save, clock)
    if root:
        tables.append(spark.createDataFrame([tuple(r[c] for c in LOG) for r in log], tables.SCHEMAS["job_run"]), root, "job_run", run_id)
        names = tables.SCHEMAS["run_record"].names
        total = G.run_record(log, [("events", "ok", None), ("customer", "ok", None)])
        tables.append(spark.createDataFrame([tuple(total[c] for c in names)], tables.SCHEMAS["run_record"]), root, "run_record", run_id)
    return state, log


_WORK = f"""e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND event_type <> 'signup'), n AS (SELECT c_nationkey FROM customer GROUP BY 1),
    r(stage, rows) AS (SELECT 'ingest_due_sources', (SELECT count(*) FROM e) UNION ALL SELECT 'materialize_events', (SELECT count(DISTINCT (user_id, ts::DATE)) FROM e) UNION ALL SELECT 'update_narratives', (SELECT count(DISTINCT event_type) FROM e)
    UNION ALL SELECT 'build_world_state', (SELECT count(DISTINCT event_type) FROM e) UNION ALL SELECT 'load_personal_state', (SELECT count(*) FROM n) UNION ALL SELECT 'calculate_exposures', (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'calculate_impacts', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') UNION ALL SELECT 'update_scenarios', (SELECT count(DISTINCT event_type) FROM e) UNION ALL SELECT 'evaluate_policies', (SELECT count(*) FROM n) UNION ALL SELECT 'derive_decision_candidates', (SELECT count(*) FROM n))"""


@query(f"WITH {_WORK} SELECT 'run-1' AS run_id, '{AS_OF}' AS as_of, stage, 'ok' AS status, rows, 0::BIGINT AS missing FROM r")
def cycle_record(spark, d):
    return run(spark, d, AS_OF, "run-1")[0]["persist_run_record"].select("run_id", "as_of", "stage", "status", "rows", "missing")


@query(f"""SELECT '{AS_OF}' AS as_of, 12::BIGINT AS stages_ok, 0::BIGINT AS stages_failed, 2::BIGINT AS sources_ok, 1::BIGINT AS sources_failed, count(*) AS model_calls, round(sum(value) / 1000, 6) AS cost, 0::BIGINT AS missing, 'degraded' AS status
    FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND event_type = 'purchase'""")
def cycle_total(spark, d):
    """The run record of a cycle in which one of three sources did not answer; its model calls and their prices are rows of a table."""
    _, log = run(spark, d, AS_OF, "run-1")
    t = Tables(spark, d)
    adapters = [tables.FileAdapter(n, f"{d}/{n}.parquet", spark.read.parquet(f"{d}/{n}.parquet").schema, c) for n, c in (("events", "event_id"), ("customer", "c_custkey"))]
    adapters.append(tables.FileAdapter("prices", f"{d}/no_such_table.parquet", t.labels.schema, "doc_id"))
    _, _, sources = tables.ingest(spark, adapters, {})
    calls = T.known_at(t.events, "ts", AS_OF).filter("event_type = 'purchase'").withColumn("cost", F.col("value") / 1000)
    total = G.run_record(log, sources, G.call_totals(calls, "cost"))
    schema = tables.SCHEMAS["run_record"]
    out = spark.createDataFrame([tuple(total[c] for c in schema.names)], schema)
    return out.select("as_of", "stages_ok", "stages_failed", "sources_ok", "sources_failed", "model_calls", F.round("cost", 6).alias("cost"), "missing", "status")
