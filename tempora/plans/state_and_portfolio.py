"""Queries of the portfolio, world-state and narrative operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import portfolio as P
from tempora.operators import scans
from tempora.operators import temporal as T
from tempora.operators import world as W
from tempora.plans.registry import Tables, day, query, r6, us

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_D = "strftime(date_trunc('day', ts), '%Y-%m-%d')"


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS net_worth, count(*) FILTER (c_acctbal IS NULL) AS missing_count, 'complete' AS status, round(coalesce(sum(c_acctbal) FILTER (c_acctbal > 0), 0), 2) AS liquid FROM customer GROUP BY 1")
def net_worth(spark, d):
    c = Tables(spark, d).customer
    all_ = P.total(c, ["c_nationkey"], "c_acctbal", name="net_worth")
    liquid = P.total(c, ["c_nationkey"], "c_acctbal", F.col("c_acctbal") > 0, name="liquid").select("c_nationkey", "liquid")
    return all_.join(liquid, "c_nationkey").select("c_nationkey", r6("net_worth", 2).alias("net_worth"), "missing_count", "status", r6(F.coalesce("liquid", F.lit(0.0)), 2).alias("liquid"))


def _positive(t: Tables):
    return t.customer.filter("c_acctbal > 0")


@query("WITH s AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, round(v / sum(v) OVER (PARTITION BY c_nationkey), 6) AS weight FROM s")
def weights_by_segment(spark, d):
    return P.weights(_positive(Tables(spark, d)), ["c_nationkey"], ["c_mktsegment"], "c_acctbal").select("c_nationkey", "c_mktsegment", r6("weight").alias("weight"))


@query("WITH s AS (SELECT n_name, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1) SELECT n_name, round(v / sum(v) OVER (), 6) AS weight FROM s")
def weights_by_nation(spark, d):
    t = Tables(spark, d)
    return P.weights(_positive(t).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), [], ["n_name"], "c_acctbal").select("n_name", r6("weight").alias("weight"))


@query("WITH s AS (SELECT n_regionkey, c_nationkey, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2), w AS (SELECT n_regionkey, v / sum(v) OVER (PARTITION BY n_regionkey) AS w FROM s) SELECT n_regionkey, round(sum(w * w), 6) AS hhi, count(*) AS classes FROM w GROUP BY 1")
def concentration_hhi(spark, d):
    t = Tables(spark, d)
    shares = P.weights(_positive(t).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), ["n_regionkey"], ["c_nationkey"], "c_acctbal")
    return P.concentration(shares, ["n_regionkey"]).select("n_regionkey", r6("hhi").alias("hhi"), "classes")


@query("SELECT c_nationkey, round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 0) / nullif(sum(c_acctbal), 0), 6) AS share, CASE WHEN nullif(sum(c_acctbal), 0) IS NULL THEN 'no_total' ELSE 'complete' END AS status FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def filtered_share(spark, d):
    return P.filtered_share(_positive(Tables(spark, d)), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", "c_acctbal").select("c_nationkey", r6("share").alias("share"), "status")


_BURN = "b AS (SELECT o_custkey, sum(o_totalprice) / 84 AS burn FROM orders GROUP BY 1)"


@query(f"WITH {_BURN} SELECT c_custkey, CASE WHEN burn - 3000 > 0 THEN round(c_acctbal / (burn - 3000), 4) END AS runway_months, CASE WHEN burn IS NULL THEN 'UNKNOWN_DATA' WHEN burn - 3000 <= 0 THEN 'INVALID_BURN' ELSE 'OK' END AS status FROM customer LEFT JOIN b ON o_custkey = c_custkey")
def runway_months(spark, d):
    t = Tables(spark, d)
    burn = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") / 84).alias("burn"))
    months, status = P.runway(F.col("c_acctbal"), F.col("burn") - 3000)
    return t.customer.join(burn, "c_custkey", "left").select("c_custkey", r6(months, 4).alias("runway_months"), status.alias("status"))


@query("WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, min(v) AS low, avg(v) AS base, max(v) AS high FROM m GROUP BY 1) SELECT o_custkey AS owner_id, round(CASE WHEN o_custkey % 3 > 0 THEN low ELSE 0 END - 1000, 8) AS net_low, round(CASE WHEN o_custkey % 3 > 0 THEN base ELSE 0 END - 1000, 8) AS net_base, round(CASE WHEN o_custkey % 3 > 0 THEN high ELSE 0 END - 1000, 8) AS net_high FROM s")
def cashflow_range(spark, d):
    months = Tables(spark, d).orders.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    streams = months.groupBy(F.col("o_custkey").alias("owner_id")).agg(F.min("v").alias("low"), F.avg("v").alias("base"), F.max("v").alias("high")).withColumns({"active": F.col("owner_id") % 3 > 0, "burn": F.lit(1000.0)})
    return P.cashflow_range(streams, "owner_id", "burn").select("owner_id", *[r6(f"net_{x}", 8).alias(f"net_{x}") for x in ("low", "base", "high")])


SHOCKS = (("BUILDING", -0.2), ("MACHINERY", 0.1), ("FURNITURE", -0.3))


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS value, round(sum(c_acctbal * (1 + CASE c_mktsegment WHEN 'BUILDING' THEN -0.2 WHEN 'MACHINERY' THEN 0.1 WHEN 'FURNITURE' THEN -0.3 ELSE 0 END)), 2) AS shocked FROM customer GROUP BY 1")
def scenario_mtm(spark, d):
    t = Tables(spark, d)
    out = P.mark_to_market(t.customer, t.rows("c_mktsegment string, shock double", *SHOCKS), "c_mktsegment", "c_acctbal")
    return out.groupBy("c_nationkey").agg(r6(F.sum("c_acctbal"), 2).alias("value"), r6(F.sum("shocked"), 2).alias("shocked"))


def daily(t: Tables, start: str | None = None, end: str | None = None):
    """Mean and number of events for each type and day (of the days from ``start`` up to ``end``), the day as text.

    The days are a range of times, which reaches the scan.
    """
    e = t.events
    if start:
        e = e.filter((F.col("ts") >= T.instant(start)) & (F.col("ts") < T.instant(end)))
    return e.groupBy("event_type", day("ts").alias("day")).agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_DAILY = f"dd AS (SELECT event_type, {_D} AS day, avg(value) AS score, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)"


@query(f"WITH {_DAILY} SELECT event_type, day, round(total / max(total) OVER (PARTITION BY event_type ORDER BY day) - 1, 6) AS drawdown FROM dd")
def drawdown(spark, d):
    return P.drawdown(daily(Tables(spark, d)), "event_type", "day", "total").select("event_type", "day", r6("drawdown").alias("drawdown"))


@query("WITH s AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, round(sum(v) OVER (PARTITION BY c_nationkey) - 0.3 * v, 4) AS stressed_total, round(-0.3 * v / sum(v) OVER (PARTITION BY c_nationkey), 6) AS loss_share FROM s")
def bucket_stress(spark, d):
    b = _positive(Tables(spark, d)).groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    return P.bucket_stress(b, ["c_nationkey"], "c_mktsegment", "v", -0.3).select("c_nationkey", "c_mktsegment", r6("stressed_total", 4).alias("stressed_total"), r6("loss_share").alias("loss_share"))


@query("""WITH s AS (SELECT c_nationkey, c_mktsegment AS a, sum(c_acctbal) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2), r AS (SELECT c_nationkey, arg_max(a, row(v, a)) AS top_asset, max(v) / sum(v) AS t, coalesce(sum(v) FILTER (a IN ('HOUSEHOLD')), 0) / sum(v) AS s FROM s GROUP BY 1)
    SELECT c_nationkey, top_asset, round(t, 6) AS top_share, round(s, 6) AS stable_share, CASE WHEN t > 0.26 AND s > 0.22 THEN 'BOTH' WHEN t > 0.26 THEN 'SINGLE_ASSET' WHEN s > 0.22 THEN 'STABLECOIN' ELSE 'PASS' END AS status FROM r""")
def concentration_checks(spark, d):
    out = P.concentration_checks(_positive(Tables(spark, d)), ["c_nationkey"], "c_mktsegment", "c_acctbal", ["HOUSEHOLD"], 0.26, 0.22)
    return out.select("c_nationkey", "top_asset", r6("top_share").alias("top_share"), r6("stable_share").alias("stable_share"), "status")


@query("""WITH p AS (SELECT p_partkey, p_brand FROM part), m AS (SELECT l_partkey, arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber)) AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-03-01' GROUP BY 1)
    SELECT p_brand, round(sum(price), 2) AS value, count(*) FILTER (price IS NULL) AS missing_count, CASE WHEN count(*) FILTER (price IS NULL) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM p LEFT JOIN m ON l_partkey = p_partkey GROUP BY 1""")
def missing_price_incomplete(spark, d):
    t = Tables(spark, d)
    marks = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    last = T.latest_as_of(marks, ["p_partkey"], "l_shipdate", "1995-03-01 00:00:00", ["l_orderkey", "l_linenumber"]).select("p_partkey", "price")
    return P.total(t.part.join(last, "p_partkey", "left"), ["p_brand"], "price").select("p_brand", r6("value", 2).alias("value"), "missing_count", "status")


@query("SELECT n_name, " + ", ".join(f"max(c_acctbal) FILTER (c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def geo_matrix_pivot(spark, d):
    t = Tables(spark, d)
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = P.pivot_matrix(joined, "n_name", "c_mktsegment", SEGMENTS, "c_acctbal")
    return out.select("n_name", *[F.col(s).alias(s.lower()) for s in SEGMENTS])


@query("WITH l AS (SELECT o_custkey, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS last_order, max(o_orderdate) AS seen FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT c_custkey, c_acctbal, last_order, CASE WHEN seen IS NULL THEN 'unknown' WHEN seen < TIMESTAMP '1997-07-01' THEN 'stale' ELSE 'fresh' END AS freshness FROM customer LEFT JOIN l ON o_custkey = c_custkey")
def personal_snapshot(spark, d):
    t = Tables(spark, d)
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("last_order"))
    last = T.latest_as_of(o, ["c_custkey"], "o_orderdate", "1998-01-01 00:00:00", ["o_orderkey"])
    status = F.when(F.col("o_orderdate").isNull(), "unknown").when(F.col("o_orderdate") < T.instant("1997-07-01 00:00:00"), "stale").otherwise("fresh")
    return t.customer.join(last, "c_custkey", "left").select("c_custkey", "c_acctbal", "last_order", status.alias("freshness"))


@query("WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) SELECT o_custkey, o_orderkey, p AS previous_value, o_orderstatus AS new_value FROM v WHERE p IS NULL OR p <> o_orderstatus")
def mutation_audit(spark, d):
    v = Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return P.mutations(v, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "previous_value", "new_value")


RATES = ((0, "1995-01-01 00:00:00", 1.0), (0, "1997-01-01 00:00:00", 1.1), (1, "1995-01-01 00:00:00", 0.8), (1, "1998-06-01 00:00:00", 0.75), (2, "1996-01-01 00:00:00", 30.0))


@query("""WITH r(cur, since, rate) AS (VALUES (0, TIMESTAMP '1995-01-01', 1.0), (0, TIMESTAMP '1997-01-01', 1.1), (1, TIMESTAMP '1995-01-01', 0.8), (1, TIMESTAMP '1998-06-01', 0.75), (2, TIMESTAMP '1996-01-01', 30.0)), o AS (SELECT *, (o_custkey % 4)::INT AS cur FROM orders)
    SELECT o_orderkey, round(o_totalprice * rate::DOUBLE, 4) AS amount_base, CASE WHEN rate IS NULL THEN 'UNKNOWN_DATA' ELSE 'OK' END AS status FROM o ASOF LEFT JOIN r ON o.cur = r.cur AND o.o_orderdate >= r.since""")
def fx_to_base(spark, d):
    t = Tables(spark, d)
    o = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", (F.col("o_custkey") % 4).cast("int").alias("cur"))
    out = T.asof_join(o, t.rows("cur int, at timestamp, rate double", *RATES), ["cur"], "o_orderdate", "at", ["rate"])
    return out.select("o_orderkey", r6(F.col("o_totalprice") * F.col("rate"), 4).alias("amount_base"), F.when(F.col("rate").isNull(), "UNKNOWN_DATA").otherwise("OK").alias("status"))


# World state

STEP, LOW, HIGH = 1.5, 0.0, 60.0
_PAIR = f"{_DAILY}, prev AS (SELECT event_type, score FROM dd WHERE day = '2024-01-14'), upd AS (SELECT event_type, score FROM dd WHERE day = '2024-01-15' AND event_type <> 'signup')"


def _two_days(t: Tables):
    e = daily(t, "2024-01-14 00:00:00", "2024-01-16 00:00:00").select("event_type", "day", "score")
    previous = e.filter("day = '2024-01-14'").drop("day")
    return previous, e.filter("day = '2024-01-15' AND event_type <> 'signup'").drop("day")


@query(f"WITH {_PAIR} SELECT coalesce(prev.event_type, upd.event_type) AS event_type, round(prev.score, 6) AS old_score, round(coalesce(upd.score, prev.score), 6) AS new_score, upd.score IS NULL AS carried FROM prev FULL JOIN upd ON prev.event_type = upd.event_type")
def world_snapshot(spark, d):
    out = W.next_snapshot(*_two_days(Tables(spark, d)), "event_type", "score")
    return out.select("event_type", r6("old_score").alias("old_score"), r6("new_score").alias("new_score"), "carried")


@query(f"WITH {_PAIR} SELECT prev.event_type, round(abs(upd.score - prev.score), 6) AS materiality FROM prev JOIN upd ON prev.event_type = upd.event_type WHERE abs(upd.score - prev.score) >= 0.5")
def world_delta_material(spark, d):
    out = W.material_deltas(W.next_snapshot(*_two_days(Tables(spark, d)), "event_type", "score"), 0.5)
    return out.select("event_type", r6("materiality").alias("materiality"))


@query(f"WITH {_DAILY}, h AS (SELECT event_type, day, score, lag(score) OVER (PARTITION BY event_type ORDER BY day) AS p FROM dd) SELECT event_type, day, round(greatest(0, least(60, p + greatest(-1.5, least(1.5, score - p)))), 6) AS accepted FROM h WHERE p IS NOT NULL")
def clamped_step(spark, d):
    h = W.history(daily(Tables(spark, d)), "event_type", "day", "score").filter("previous IS NOT NULL")
    return h.select("event_type", "day", r6(W.bounded_step(F.col("previous"), F.col("score"), STEP, LOW, HIGH)).alias("accepted"))


@query(f"WITH {_DAILY}, h AS (SELECT event_type, day, score, score - lag(score) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM dd) SELECT event_type, day, round(score, 6) AS score, round(delta, 6) AS delta FROM h")
def dimension_history(spark, d):
    return W.history(daily(Tables(spark, d)), "event_type", "day", "score").select("event_type", "day", r6("score").alias("score"), r6("delta").alias("delta"))


@query(f"WITH {_DAILY}, h AS (SELECT event_type, day, score - lag(score) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM dd) SELECT event_type, day, CASE WHEN delta IS NULL THEN 'uncertain' WHEN delta > 1 THEN 'rising' WHEN delta < -1 THEN 'falling' ELSE 'stable' END AS direction FROM h")
def dimension_direction(spark, d):
    h = W.history(daily(Tables(spark, d)), "event_type", "day", "score")
    return h.select("event_type", "day", W.direction(F.col("delta"), 1.0).alias("direction"))


@query(f"""WITH {_DAILY}, h AS (SELECT *, total / lag(total) OVER w - 1 AS r, avg(total) OVER n AS m, stddev_samp(total) OVER n AS s FROM dd WINDOW w AS (PARTITION BY event_type ORDER BY day), n AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT event_type, day, round(r, 6) AS step_return, round(m, 4) AS mean_near, round(s, 4) AS stddev_near FROM h""")
def market_features(spark, d):
    out = W.market_features(daily(Tables(spark, d)), "event_type", "day", "total", 7)
    return out.select("event_type", "day", r6("step_return").alias("step_return"), r6("mean_near", 4).alias("mean_near"), r6("stddev_near", 4).alias("stddev_near"))


_REGISTRY = "g(event_type, enabled) AS (VALUES ('click', true), ('view', true), ('purchase', true), ('signup', false), ('geography.tr.fx', true))"
REGISTRY = (("click", True), ("view", True), ("purchase", True), ("signup", False), ("geography.tr.fx", True))


@query(f"WITH {_DAILY}, {_REGISTRY} SELECT g.event_type, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'unknown' ELSE 'scored' END AS status FROM g LEFT JOIN dd ON dd.event_type = g.event_type AND day = '2024-01-14' WHERE enabled")
def registry_driven_snapshot(spark, d):
    t = Tables(spark, d)
    out = W.snapshot_from_registry(t.rows("event_type string, enabled boolean", *REGISTRY), _two_days(t)[0], "event_type", "score")
    return out.select("event_type", r6("score").alias("score"), "status")


@query("SELECT event_type, count(DISTINCT user_id) AS evidence_count, epoch_us(max(ts)) AS freshest_us, round(1 - 1 / (1 + count(DISTINCT user_id)::DOUBLE), 6) AS confidence FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def dimension_evidence(spark, d):
    e = T.known_at(Tables(spark, d).events, "ts", "2024-01-20 00:00:00").groupBy("event_type").agg(F.count_distinct("user_id").alias("evidence_count"), us(F.max("ts")).alias("freshest_us"))
    return e.withColumn("confidence", r6(1 - F.lit(1.0) / (1 + F.col("evidence_count"))))


@query(f"WITH {_DAILY} SELECT round(avg(score), 6) AS mean_score, count(*) AS dimensions, round(count(score) / 5, 6) AS confidence, CASE WHEN avg(score) >= 30 THEN 'expansion' WHEN avg(score) <= 20 THEN 'contraction' ELSE 'neutral' END AS overall_regime FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('geography.tr.fx')) g(event_type) LEFT JOIN dd ON dd.event_type = g.event_type AND day = '2024-01-14'")
def overall_regime(spark, d):
    t = Tables(spark, d)
    dimensions = t.rows("event_type string, enabled boolean", *[(name, True) for name, _ in REGISTRY])
    scored = W.snapshot_from_registry(dimensions, _two_days(t)[0], "event_type", "score")
    return W.regime(scored, "score", 30.0, 20.0).select(r6("mean_score").alias("mean_score"), "dimensions", r6("confidence").alias("confidence"), "overall_regime")


@query("""WITH w AS (SELECT DISTINCT 'geography.' || lower(n_name) || '.' || t AS k FROM nation, (VALUES ('fx'), ('policy')) v(t) WHERE n_regionkey < 3), g AS (SELECT DISTINCT 'geography.' || lower(n_name) || '.fx' AS k FROM nation WHERE n_regionkey > 1)
    SELECT coalesce(w.k, g.k) AS dimension_key, CASE WHEN g.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'retired' ELSE 'kept' END AS status FROM w FULL JOIN g ON w.k = g.k""")
def owner_scoped_dims(spark, d):
    n = Tables(spark, d).nation
    registry = n.filter("n_regionkey > 1").select(F.concat(F.lit("geography."), F.lower("n_name"), F.lit(".fx")).alias("dimension_key")).distinct()
    return W.owner_dimensions(n.filter("n_regionkey < 3"), ["fx", "policy"], registry, "n_name")


# Narratives: a narrative is an event type, an event is a user's day, purchases and signups speak for it.

_SIGN = f"a AS (SELECT (event_id % 4)::INT AS narrative, user_id || ':' || {_D} AS event, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 1 ELSE -1 END AS sign, CASE WHEN event_type = 'purchase' THEN 0.5 ELSE 0.25 END AS weight FROM events)"


def _assigned(t: Tables):
    for_ = F.col("event_type").isin("purchase", "signup", "click")
    return t.events.select((F.col("event_id") % 4).cast("int").alias("narrative"), F.concat_ws(":", F.col("user_id").cast("string"), day("ts")).alias("event"), F.when(for_, 1).otherwise(-1).alias("sign"), F.when(F.col("event_type") == "purchase", F.lit(0.5)).otherwise(F.lit(0.25)).alias("weight"))


@query(f"WITH {_SIGN}, o AS (SELECT narrative, event, max(sign) AS s, max(weight) AS w FROM a GROUP BY 1, 2) SELECT narrative, round(sum(s * w)::DOUBLE, 6) AS raw, count(*) AS events, round(greatest(-100, least(100, sum(s * w)))::DOUBLE, 6) AS strength FROM o GROUP BY 1")
def narrative_strength(spark, d):
    return W.strength(_assigned(Tables(spark, d)), "narrative", "event", "sign", "weight", 100.0).select("narrative", r6("raw").alias("raw"), "events", r6("strength").alias("strength"))


@query(f"""WITH {_DAILY}, h AS (SELECT event_type, day, n::DOUBLE AS n, lag(n) OVER w AS p, (date_diff('day', lag(day::DATE) OVER w, day::DATE))::INT AS gap FROM dd WINDOW w AS (PARTITION BY event_type ORDER BY day))
    SELECT event_type, day, CASE WHEN coalesce(gap, 0) >= 5 THEN 'resolved' WHEN coalesce(gap, 0) >= 2 THEN 'dormant' WHEN n < 20 THEN 'candidate' WHEN p IS NULL THEN 'active' WHEN n > p + 3 THEN 'strengthening' WHEN n < p - 3 THEN 'weakening' ELSE 'active' END AS status FROM h""")
def narrative_lifecycle(spark, d):
    from pyspark.sql import Window

    rows = daily(Tables(spark, d)).withColumn("n", F.col("n").cast("double"))
    back = F.lag("day").over(Window.partitionBy("event_type").orderBy("day"))
    rows = rows.withColumn("days", F.coalesce(F.datediff("day", back), F.lit(0)))
    return W.lifecycle(rows, "event_type", "day", "n", "days", 2, 5, 20.0, 3.0).select("event_type", "day", "status")


#: Items are the embeddings, a third of which is reported again. Narratives begin as the labels of the items divisible by 4; the other
#: even items come in a first run, what is left in a second, under the centroids that the first has moved. What no narrative takes is grouped.
_NEAR_ENOUGH, _ALIKE = 0.25, 0.9


@query("""WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 10000000, label, list_transform(embedding::DOUBLE[], lambda e, i: CASE WHEN i % 2 = 1 THEN e * 1.3::DOUBLE ELSE e END) FROM embeddings WHERE vec_id % 3 = 0
    UNION ALL SELECT vec_id + 20000000, label, list_transform(embedding::DOUBLE[], lambda e, i: CASE WHEN i % 2 = 0 THEN e * 1.3::DOUBLE ELSE e END) FROM embeddings WHERE vec_id % 9 = 0),
    u AS (SELECT vec_id, label, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) AS v FROM x),
    s0 AS (SELECT label::VARCHAR AS narrative, i, sum(v[i]) AS t FROM u, range(1, 65) r(i) WHERE vec_id % 4 = 0 GROUP BY 1, 2), c0 AS (SELECT narrative, list(t ORDER BY i) AS c FROM s0 GROUP BY 1),
    a1 AS (SELECT vec_id, v, max(list_cosine_similarity(v, c)) AS score, arg_max(narrative, list_cosine_similarity(v, c)) AS narrative FROM u, c0 WHERE vec_id % 4 = 2 GROUP BY 1, 2),
    s1 AS (SELECT narrative, i, sum(t) AS t FROM (SELECT * FROM s0 UNION ALL SELECT narrative, i, v[i] FROM a1, range(1, 65) r(i) WHERE score >= 0.25) GROUP BY 1, 2), c1 AS (SELECT narrative, list(t ORDER BY i) AS c FROM s1 GROUP BY 1),
    a2 AS (SELECT vec_id, v, max(list_cosine_similarity(v, c)) AS score, arg_max(narrative, list_cosine_similarity(v, c)) AS narrative FROM u, c1 WHERE vec_id % 2 = 1 GROUP BY 1, 2),
    z AS (SELECT vec_id, v FROM a1 WHERE score < 0.25 UNION ALL SELECT vec_id, v FROM a2 WHERE score < 0.25),
    p AS (SELECT b.vec_id AS id, a.vec_id AS earlier, list_cosine_similarity(a.v, b.v) AS score FROM z a JOIN z b ON (md5(a.vec_id::VARCHAR), a.vec_id) < (md5(b.vec_id::VARCHAR), b.vec_id) AND list_cosine_similarity(a.v, b.v) >= 0.9),
    o AS (SELECT z.vec_id AS id, row_number() OVER (ORDER BY md5(z.vec_id::VARCHAR), z.vec_id) AS k, coalesce(n.earlier, []) AS earlier FROM z LEFT JOIN (SELECT id, list(earlier) AS earlier FROM p GROUP BY 1) n ON n.id = z.vec_id),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS leaders UNION ALL SELECT o.k, CASE WHEN list_has_any(o.earlier, r.leaders) THEN r.leaders ELSE list_append(r.leaders, o.id) END FROM r JOIN o ON o.k = r.k + 1),
    l AS (SELECT unnest(arg_max(leaders, k)) AS id FROM r), f AS (SELECT p.id, arg_max(p.earlier, row(p.score, -p.earlier)) AS leader FROM p JOIN l ON l.id = p.earlier WHERE p.id NOT IN (SELECT id FROM l) GROUP BY 1),
    g AS (SELECT id, id AS leader FROM l UNION ALL SELECT * FROM f), n AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY leader) >= 2 THEN 'candidate:' || leader END AS narrative FROM g)
    SELECT vec_id AS item, narrative FROM a1 WHERE score >= 0.25 UNION ALL SELECT vec_id, narrative FROM a2 WHERE score >= 0.25 UNION ALL SELECT id, narrative FROM n""")
def narrative_assignment(spark, d):
    from tempora.operators import identity as I
    from tempora.operators import narratives as N
    from tempora.plans.time_and_identity import _reported
    from tempora.sources.tables import save

    t = Tables(spark, d)
    labels = t.embeddings.select(F.col("vec_id").alias("of"), F.col("label").cast("string").alias("narrative"))
    items = save(_reported(t).join(labels, F.col("vec_id") % 10_000_000 == F.col("of")).drop("of"), "items")
    centroids = N.sums(items.filter("vec_id % 4 = 0"), "narrative", "vec_id", "embedding", 64)
    taken, left_over = [], []
    for now in ("vec_id % 4 = 2", "vec_id % 2 = 1"):
        centroids = save(centroids, "centroids")
        found = save(N.assign(items.filter(now), centroids, "narrative", "vec_id", "embedding", 64, _NEAR_ENOUGH), "assigned")
        taken.append(found.filter("narrative IS NOT NULL"))
        left_over.append(found.filter("narrative IS NULL").select("id", "v"))
        centroids = N.merged(centroids.unionByName(N.sums(taken[-1], "narrative", "id", "v", 64)), "narrative")
    none = save(left_over[0].unionByName(left_over[1]), "left-over")
    pairs = I.hashed_pairs(none, "id", "v", _ALIKE, 64, recall=0.99999)
    new = N.candidates(none, "id", pairs, save)
    rest = none.select("id").join(new, "id", "left")
    return taken[0].select("id", "narrative").unionByName(taken[1].select("id", "narrative")).unionByName(rest).select(F.col("id").alias("item"), "narrative")


@query(f"SELECT {_D} AS day, round(least(count(*) FILTER (value >= 50), count(*) FILTER (value < 50))::DOUBLE / count(*), 6) AS disagreement FROM events GROUP BY 1")
def contradiction_metric(spark, d):
    e = Tables(spark, d).events.groupBy(day("ts").alias("day")).agg(F.count_if(F.col("value") >= 50).alias("p"), F.count_if(F.col("value") < 50).alias("n"))
    return e.select("day", r6(W.disagreement(F.col("p").cast("double"), F.col("n").cast("double"))).alias("disagreement"))


# Raw rows: the value of every single event against what its type has had before.


@query("SELECT event_id, round(max(value) OVER w, 6) AS peak, round(value / max(value) OVER w - 1, 6) AS drawdown FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def raw_drawdown(spark, d):
    e = Tables(spark, d).events.select("event_id", "event_type", "ts", "value")
    return scans.raw_drawdown(e, ["event_type"], "ts", ["event_id"], "value").select("event_id", r6("peak").alias("peak"), r6("drawdown").alias("drawdown"))


@query("""WITH s AS (SELECT event_id, event_type, ts, sum(value - 55.0::DOUBLE) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)
    SELECT event_id, round(p - least(0, min(p) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 5) AS change_sum FROM s""")
def change_points(spark, d):
    e = Tables(spark, d).events.select("event_id", "event_type", "ts", "value")
    return scans.change_sum(e, ["event_type"], "ts", ["event_id"], "value", 50.0, 5.0).select("event_id", r6("change_sum", 5).alias("change_sum"))


@query("""SELECT a.event_id, round(sum(b.value * exp((epoch_us(b.ts) - epoch_us(a.ts)) / 43200000000.0::DOUBLE)) / sum(exp((epoch_us(b.ts) - epoch_us(a.ts)) / 43200000000.0::DOUBLE)), 5) AS decayed_mean
    FROM events a JOIN events b ON a.event_type = b.event_type AND (b.ts, b.event_id) <= (a.ts, a.event_id) GROUP BY 1""")
def decayed_mean(spark, d):
    e = Tables(spark, d).events.select("event_id", "event_type", "ts", "value")
    return scans.decayed_mean(e, ["event_type"], "ts", ["event_id"], "value", 43_200.0).select("event_id", r6("decayed_mean", 5).alias("decayed_mean"))
