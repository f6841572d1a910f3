"""Queries of the impact, alert, scenario, policy, decision and governance operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import decisions as J
from tempora.operators import governance as G
from tempora.operators import identity as I
from tempora.operators import impact as M
from tempora.operators import scenarios as C
from tempora.operators import temporal as T
from tempora.operators.world import material_deltas
from tempora.plans.registry import Tables, day, query, r6, us
from tempora.plans.state_and_portfolio import _DAILY, _D, _PAIR, _two_days, daily

# Factors of an impact in 0..1, made from an event.

_I = "i AS (SELECT event_id, user_id, event_type, ts, least(value / 100, 1.0::DOUBLE) AS sev, (user_id % 10) / 10.0::DOUBLE AS exp, (event_id % 7) / 6.0::DOUBLE AS urg, (event_id % 5) / 4.0::DOUBLE AS conf, (event_id % 3) / 2.0::DOUBLE AS irr FROM events)"
_GEO = "power(sev * exp * urg, 1.0 / 3.0) * (1 + irr)"


def impacts(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", "ts", "value")
    part = lambda c, n: (F.col(c) % n) / F.lit(float(n - 1))
    i = e.withColumns({"sev": F.least(F.col("value") / 100, F.lit(1.0)), "exp": (F.col("user_id") % 10) / F.lit(10.0), "urg": part("event_id", 7), "conf": part("event_id", 5), "irr": part("event_id", 3)})
    return i.withColumn("priority", M.priority_geometric(F.col("sev"), F.col("exp"), F.col("urg"), F.col("irr")))


@query(f"WITH {_I} SELECT event_id, round(sev * exp * conf * urg * (1 + irr), 9) AS priority FROM i")
def impact_priority_product(spark, d):
    i = impacts(Tables(spark, d))
    return i.select("event_id", r6(M.priority_product(*[F.col(c) for c in ("sev", "exp", "conf", "urg", "irr")]), 9).alias("priority"))


@query(f"WITH {_I} SELECT event_id, round({_GEO}, 9) AS priority FROM i")
def impact_priority_geometric(spark, d):
    return impacts(Tables(spark, d)).select("event_id", r6("priority", 9).alias("priority"))


_ATT = f"CASE WHEN round({_GEO}, 9) >= 0.8 AND conf >= 0.5 THEN 'ACT_OR_REVIEW' WHEN round({_GEO}, 9) >= 0.8 THEN 'VERIFY' WHEN conf >= 0.5 THEN 'NOTE' ELSE 'BACKLOG' END"


def _attention(i):
    return i.withColumn("attention", M.attention(r6("priority", 9), F.col("conf"), 0.8, 0.5))


@query(f"WITH {_I} SELECT event_id, {_ATT} AS attention FROM i")
def attention_class(spark, d):
    return _attention(impacts(Tables(spark, d))).select("event_id", "attention")


@query(f"WITH {_I}, a AS (SELECT {_ATT} AS attention FROM i) SELECT attention, CASE attention WHEN 'ACT_OR_REVIEW' THEN 'CRITICAL' WHEN 'BACKLOG' THEN 'INFO' ELSE 'IMPORTANT' END AS severity, count(*) AS impacts FROM a GROUP BY 1, 2")
def severity_routing(spark, d):
    return _attention(impacts(Tables(spark, d))).withColumn("severity", M.severity_of(F.col("attention"))).groupBy("attention", "severity").agg(F.count(F.lit(1)).alias("impacts"))


RULES = (("click", 0, "DIRECT_RULE"), ("view", 1, "INFERRED_CAUSAL"), ("purchase", 0, "DIRECT_RULE"), ("error", 2, "SPECULATIVE"))
_RULES = "r(event_type, n_regionkey, how) AS (VALUES ('click', 0, 'DIRECT_RULE'), ('view', 1, 'INFERRED_CAUSAL'), ('purchase', 0, 'DIRECT_RULE'), ('error', 2, 'SPECULATIVE'))"
_DELTA = f"{_PAIR}, dl AS (SELECT prev.event_type, upd.score - prev.score AS delta FROM prev JOIN upd ON prev.event_type = upd.event_type), {_RULES}, x AS (SELECT n_regionkey, n_name, sum(c_acctbal) AS exposure FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2)"


def _resolved(t: Tables):
    from tempora.operators.world import next_snapshot

    deltas = material_deltas(next_snapshot(*_two_days(t), "event_type", "score"), 0.0).filter("NOT carried").select("event_type", (F.col("new_score") - F.col("old_score")).alias("delta"))
    x = t.customer.filter("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.sum("c_acctbal").alias("exposure"))
    return M.resolve_exposures(deltas, t.rows("event_type string, n_regionkey int, how string", *RULES), x, "event_type", "n_regionkey")


@query(f"WITH {_DELTA} SELECT event_type, n_name, round(delta * exposure, 2) AS effect FROM dl JOIN r USING (event_type) JOIN x USING (n_regionkey)")
def delta_exposure_join(spark, d):
    return _resolved(Tables(spark, d)).select("event_type", "n_name", r6(F.col("delta") * F.col("exposure"), 2).alias("effect"))


@query(f"WITH {_DELTA} SELECT event_type, how, count(*) AS exposures, round(sum(exposure), 2) AS exposed FROM dl JOIN r USING (event_type) JOIN x USING (n_regionkey) GROUP BY 1, 2")
def exposure_resolver(spark, d):
    return _resolved(Tables(spark, d)).groupBy("event_type", "how").agg(F.count(F.lit(1)).alias("exposures"), r6(F.sum("exposure"), 2).alias("exposed"))


@query(f"WITH {_DELTA}, j AS (SELECT how FROM dl JOIN r USING (event_type) JOIN x USING (n_regionkey)) SELECT impact_class, count(*) AS impacts FROM (SELECT how AS impact_class FROM j UNION ALL SELECT 'DIRECT_CALCULATED' FROM dl) GROUP BY 1")
def impact_classified(spark, d):
    from tempora.operators.world import next_snapshot

    t = Tables(spark, d)
    j = _resolved(t).select("event_type", "how")
    calculated = material_deltas(next_snapshot(*_two_days(t), "event_type", "score"), 0.0).filter("NOT carried").select("event_type")
    parts = [j.filter(F.col("how") == c).select("event_type") for c in ("DIRECT_RULE", "INFERRED_CAUSAL", "SPECULATIVE")]
    return M.classify(calculated, *parts).groupBy("impact_class").agg(F.count(F.lit(1)).alias("impacts"))


EDGES = (("click", "usd", 0.5, False), ("usd", "assets", 0.8, True), ("usd", "expenses", -0.3, True), ("purchase", "inflation", 0.4, False), ("inflation", "cash", -0.9, True), ("inflation", "burn", 0.7, False), ("burn", "runway", -0.6, True), ("view", "rates", 0.2, False), ("rates", "view", 1.0, False))
_EDGES = "g(s, t, w, e) AS (VALUES ('click', 'usd', 0.5, false), ('usd', 'assets', 0.8, true), ('usd', 'expenses', -0.3, true), ('purchase', 'inflation', 0.4, false), ('inflation', 'cash', -0.9, true), ('inflation', 'burn', 0.7, false), ('burn', 'runway', -0.6, true), ('view', 'rates', 0.2, false), ('rates', 'view', 1.0, false))"


@query(f"""WITH RECURSIVE {_PAIR}, dl AS (SELECT prev.event_type, upd.score - prev.score AS delta FROM prev JOIN upd ON prev.event_type = upd.event_type), {_EDGES},
    c AS (SELECT event_type, event_type AS node, [event_type] AS chain, delta AS effect, false AS e, 0 AS hops FROM dl UNION ALL SELECT event_type, t, list_append(chain, t), effect * w::DOUBLE, g.e, hops + 1 FROM c JOIN g ON g.s = c.node WHERE NOT c.e AND hops < 3 AND NOT list_contains(chain, t))
    SELECT event_type, array_to_string(chain, ' > ') AS chain, round(effect, 6) AS effect, 'impact' AS status FROM c WHERE e UNION ALL SELECT event_type, event_type, NULL, 'research' FROM dl WHERE event_type NOT IN (SELECT event_type FROM c WHERE e)""")
def causal_chains(spark, d):
    t = Tables(spark, d)
    from tempora.operators.world import next_snapshot

    moved = material_deltas(next_snapshot(*_two_days(t), "event_type", "score"), 0.0).filter("NOT carried").select("event_type", (F.col("new_score") - F.col("old_score")).alias("delta"))
    out = M.causal_chains(moved, t.rows("source string, target string, weight double, terminal boolean", *EDGES), 3, "event_type")
    return out.select("event_type", F.array_join("chain", " > ").alias("chain"), r6("effect").alias("effect"), "status")


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'inference' ELSE 'speculation' END AS kind, CASE WHEN doc_id % 4 = 0 THEN [] ELSE [doc_id, doc_id * 7 % 1000, doc_id] END AS cited FROM documents), u AS (SELECT doc_id, unnest(list_distinct(cited)) AS x FROM c), k AS (SELECT u.doc_id, count(*) AS n FROM u JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = x GROUP BY 1)
    SELECT kind, CASE WHEN kind = 'fact' AND coalesce(n, 0) = 0 THEN 'unsupported' WHEN coalesce(n, 0) < len(list_distinct(cited)) THEN 'broken_link' ELSE 'ok' END AS verdict, count(*) AS claims FROM c LEFT JOIN k USING (doc_id) GROUP BY 1, 2""")
def brief_citations(spark, d):
    t = Tables(spark, d)
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "fact").when(i % 3 == 1, "inference").otherwise("speculation")
    cited = F.when(i % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i, i * 7 % 1000, i))
    claims = t.documents.select("doc_id", kind.alias("kind"), cited.alias("cited_ids"))
    return M.citations(claims, t.labels, "doc_id", "cited_ids", "doc_id").groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("claims"))


@query(f"WITH {_I} SELECT event_id, user_id FROM i WHERE event_type IN ('purchase', 'signup')")
def opportunity_view(spark, d):
    t = Tables(spark, d)
    objectives = t.rows("event_type string, accepted_at timestamp, status string, authored_by string, from_model boolean", ("purchase", "2024-01-01 00:00:00", "active", "owner", False), ("signup", "2024-01-01 00:00:00", "active", "owner", False), ("view", None, "active", "owner", False), ("click", "2024-01-01 00:00:00", "draft", "owner", False), ("error", "2024-01-01 00:00:00", "active", "owner", True))
    return M.opportunities(impacts(t), I.active_objectives(objectives), "event_type").select("event_id", "user_id")


@query("WITH r AS (SELECT event_id, value, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS recent FROM events) SELECT event_id, recent, value > 20 + 2.5 * recent AS interrupt FROM r")
def interruption_threshold(spark, d):
    return M.interruptions(Tables(spark, d).events, "user_id", "ts", "value", 20.0, 2.5, 7).select("event_id", "recent", "interrupt")


@query(r"WITH e AS (SELECT sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) AS k, count(DISTINCT source) AS n, min(doc_id) AS doc, min(CASE WHEN doc_id % 4 = 0 THEN 'A' WHEN doc_id % 4 = 1 THEN 'C' ELSE 'D' END) AS class FROM documents GROUP BY 1) SELECT k AS event_key, doc % 11 = 0 OR (n >= 2 AND class < 'D') AS critical_allowed FROM e")
def critical_gate(spark, d):
    docs = Tables(spark, d).documents
    cls = F.when(F.col("doc_id") % 4 == 0, "A").when(F.col("doc_id") % 4 == 1, "C").otherwise("D")
    e = docs.select("doc_id", "source", I.content_hash(F.col("text")).alias("event_key"), cls.alias("class")).groupBy("event_key").agg(F.count_distinct("source").alias("n"), F.min("doc_id").alias("doc"), F.min("class").alias("class"))
    return e.select("event_key", M.critical_allowed(F.col("doc") % 11 == 0, F.col("n"), F.col("class")).alias("critical_allowed"))


@query(f"WITH a AS (SELECT event_id, user_id, event_type, {_D} AS day, row_number() OVER (PARTITION BY user_id, event_type, {_D} ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10') SELECT event_id FROM a WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-10' AND s.user_id % 3 > 0 AND s.user_id = a.user_id AND s.event_type = a.event_type)")
def alert_dedup(spark, d):
    """What was sent before the tenth, to a user of a type, is not sent again; of a day's alerts the first is."""
    e = Tables(spark, d).events.withColumn("day", day("ts"))
    at = T.instant("2024-01-10 00:00:00")
    sent, now = e.filter(F.col("ts") < at).filter("user_id % 3 > 0"), e.filter(F.col("ts") >= at)
    return M.unsent(now, sent, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")], ["user_id", "event_type"]).select("event_id")


@query(f"WITH {_I} SELECT event_id, event_type || ' by ' || user_id AS what, {_ATT} IN ('ACT_OR_REVIEW', 'VERIFY') AS needs_action, round(exp, 6) AS exposure, round(conf, 6) AS confidence FROM i WHERE {_ATT} <> 'BACKLOG'")
def alert_payload(spark, d):
    a = _attention(impacts(Tables(spark, d))).filter("attention <> 'BACKLOG'")
    packed = a.select(F.struct("event_id", F.concat_ws(" by ", "event_type", F.col("user_id").cast("string")).alias("what"), F.col("attention").isin("ACT_OR_REVIEW", "VERIFY").alias("needs_action"), r6("exp").alias("exposure"), r6("conf").alias("confidence")).alias("alert"))
    return packed.select("alert.*")


@query(f"WITH {_I} SELECT event_id, round({_GEO}, 9) AS priority FROM i ORDER BY round({_GEO}, 9) DESC, event_id LIMIT 10")
def brief_topk(spark, d):
    i = impacts(Tables(spark, d)).withColumn("priority", r6("priority", 9))
    return M.brief(i, [F.desc("priority"), F.col("event_id")], 10).select("event_id", "priority")


@query(f"WITH {_I} SELECT event_id, round({_GEO}, 9) AS priority FROM i WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02') ORDER BY round({_GEO}, 9) DESC, event_id LIMIT 10")
def brief_no_repeat(spark, d):
    t = Tables(spark, d)
    i = impacts(t).withColumn("priority", r6("priority", 9))
    told = t.events.filter(F.col("ts") < T.instant("2024-01-02 00:00:00"))
    return M.brief(i, [F.desc("priority"), F.col("event_id")], 10, told, ["user_id"]).select("event_id", "priority")


@query(f"WITH {_I}, c AS (SELECT CASE event_type WHEN 'click' THEN 'fact' WHEN 'view' THEN 'inference' ELSE 'speculation' END AS kind, event_id FROM i WHERE conf > 0) SELECT kind, count(*) AS items, min(event_id) AS first_event FROM c GROUP BY 1")
def brief_by_class(spark, d):
    i = impacts(Tables(spark, d)).filter("conf > 0")
    kind = F.when(F.col("event_type") == "click", "fact").when(F.col("event_type") == "view", "inference").otherwise("speculation")
    return i.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("items"), F.min("event_id").alias("first_event"))


@query("SELECT 'NO_ACTION' AS item UNION ALL SELECT DISTINCT event_type FROM events")
def brief_no_action(spark, d):
    e = Tables(spark, d).events.select(F.col("event_type").alias("item")).distinct()
    return M.or_no_action(e.filter("item = 'nothing'"), "item").unionByName(M.or_no_action(e, "item"))


@query(f"WITH b AS (SELECT (user_id % 5)::INT AS grp, {_D} AS day, bool_or(value > 95) AS useful FROM events GROUP BY 1, 2) SELECT grp, count(*) AS briefs, round(avg(useful::INT), 6) AS useful_share FROM b GROUP BY 1")
def usefulness_rate(spark, d):
    e = Tables(spark, d).events.select((F.col("user_id") % 5).cast("int").alias("grp"), day("ts").alias("day"), "value")
    return M.usefulness(e, "grp", "day", F.col("value") > 95).select("grp", "briefs", r6("useful_share").alias("useful_share"))


# Scenarios: a set is a group of users, a scenario an event type.

_SETS = "q AS (SELECT (user_id % 10)::INT AS set_id, event_type AS scenario, count(*) FILTER (ts < TIMESTAMP '2024-01-16')::DOUBLE AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16')::DOUBLE AS b FROM events GROUP BY 1, 2), s AS (SELECT set_id, scenario, a / sum(a) OVER (PARTITION BY set_id) AS prior, b / sum(b) OVER (PARTITION BY set_id) AS target FROM q)"


def sets(t: Tables):
    half = F.col("ts") < T.instant("2024-01-16 00:00:00")
    q = t.events.groupBy((F.col("user_id") % 10).cast("int").alias("set_id"), F.col("event_type").alias("scenario")).agg(F.count_if(half).cast("double").alias("a"), F.count_if(~half).cast("double").alias("b"))
    return q.select("set_id", "scenario", C.renormalised(F.col("a"), ["set_id"]).alias("prior"), C.renormalised(F.col("b"), ["set_id"]).alias("target"))


_UPD = f"{_SETS}, u AS (SELECT *, prior + least(1.0::DOUBLE, coalesce(0.02 / nullif(max(abs(target - prior)) OVER (PARTITION BY set_id), 0), 1.0)) * (target - prior) AS posterior FROM s)"


@query(f"WITH {_UPD} SELECT set_id, scenario, round(prior, 6) AS prior, round(posterior, 6) AS posterior FROM u")
def scenario_update(spark, d):
    return C.bounded_update(sets(Tables(spark, d)), ["set_id"], "prior", "target", 0.02).select("set_id", "scenario", r6("prior").alias("prior"), r6("posterior").alias("posterior"))


@query(f"WITH {_SETS}, n AS (SELECT set_id, CASE WHEN (scenario = 'signup' AND set_id % 2 = 0) OR (scenario IN ('click', 'view', 'error') AND set_id % 5 = 0) THEN NULL ELSE prior END AS p FROM s), k AS (SELECT set_id, 1 - sum(coalesce(p, 0)) AS u, count(*) FILTER (p IS NULL) AS unevaluated FROM n GROUP BY 1) SELECT set_id, round(u, 6) AS unknown_mass, unevaluated, CASE WHEN u <= 0.01 THEN 'COMPLETE' WHEN u <= 0.4 THEN 'DEGRADED' ELSE 'UNRELIABLE' END AS integrity_status FROM k")
def scenario_unknown_mass(spark, d):
    gone = ((F.col("scenario") == "signup") & (F.col("set_id") % 2 == 0)) | (F.col("scenario").isin("click", "view", "error") & (F.col("set_id") % 5 == 0))
    s = sets(Tables(spark, d)).withColumn("p", F.when(~gone, F.col("prior")))
    out = C.integrity(s, ["set_id"], "p", 0.01, 0.4)
    return out.select("set_id", r6("unknown_mass").alias("unknown_mass"), "unevaluated", "integrity_status")


_SHARE = f"c AS (SELECT {_D} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), sh AS (SELECT day, event_type, n::DOUBLE / sum(n) OVER (PARTITION BY day) AS p FROM c)"


@query(f"WITH {_SHARE}, w AS (SELECT day, event_type, floor(p * 20 + 0.5) / 20 AS shown FROM sh) SELECT day, event_type, round(shown, 2) AS shown, coalesce(shown <> lag(shown) OVER (PARTITION BY event_type ORDER BY day), true) AS changed FROM w")
def probability_display(spark, d):
    n = daily(Tables(spark, d)).select("day", "event_type", F.col("n").cast("double").alias("n"))
    shares = n.withColumn("p", C.renormalised(F.col("n"), ["day"]))
    return C.displayed_changes(shares, ["event_type"], "day", "p").select("day", "event_type", r6("shown", 2).alias("shown"), "changed")


@query(f"WITH {_SHARE} SELECT event_type AS scenario, round(arg_max(p, day), 6) AS prior FROM sh WHERE day <= '2024-01-15' GROUP BY 1")
def scenario_prior(spark, d):
    n = daily(Tables(spark, d)).select(F.to_timestamp("day").alias("at"), "day", "event_type", F.col("n").cast("double").alias("n")).withColumn("p", C.renormalised(F.col("n"), ["day"]))
    out = T.latest_as_of(n.select(F.col("event_type").alias("scenario"), "at", "p"), ["scenario"], "at", "2024-01-15 00:00:00")
    return out.select("scenario", r6("p").alias("prior"))


@query(f"WITH {_DAILY}, r AS (SELECT event_type AS scenario, CASE WHEN event_type = 'error' AND day = '2024-01-05' THEN NULL ELSE score END AS sc, CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END AS dir, n / 100.0::DOUBLE AS w FROM dd) SELECT scenario, CASE WHEN count(*) FILTER (sc IS NULL) = 0 THEN round(sum(w * dir * sc), 4) END AS pressure, count(*) FILTER (sc IS NULL) AS missing_drivers FROM r GROUP BY 1")
def scenario_pressure(spark, d):
    r = daily(Tables(spark, d)).select(F.col("event_type").alias("scenario"), F.when(~((F.col("event_type") == "error") & (F.col("day") == "2024-01-05")), F.col("score")).alias("current_score"), F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1).alias("direction"), (F.col("n") / F.lit(100.0)).alias("weight"))
    return C.pressure(r, ["scenario"]).select("scenario", r6("pressure", 4).alias("pressure"), "missing_drivers")


DRIVERS = (("soft", "click", 1, 0.5), ("soft", "error", -1, 0.2), ("reflation", "purchase", 1, 0.7), ("reflation", "view", 1, 0.1), ("shock", "error", 1, 0.9), ("shock", "unheard_of", 1, 0.3))


@query(f"""WITH {_DAILY}, n AS (SELECT event_type AS narrative_id, score FROM dd WHERE day = '2024-01-14'), m(scenario, narrative_id, dir, w) AS (VALUES ('soft', 'click', 1, 0.5), ('soft', 'error', -1, 0.2), ('reflation', 'purchase', 1, 0.7), ('reflation', 'view', 1, 0.1), ('shock', 'error', 1, 0.9), ('shock', 'unheard_of', 1, 0.3))
    SELECT scenario, CASE WHEN count(*) = count(score) THEN round(sum(w::DOUBLE * dir * score), 6) END AS pressure, count(*) FILTER (score IS NULL) AS missing_drivers FROM m LEFT JOIN n USING (narrative_id) GROUP BY 1""")
def scenario_drivers(spark, d):
    t = Tables(spark, d)
    narratives = _two_days(t)[0].withColumnRenamed("event_type", "narrative_id")
    mapped = C.drivers(t.rows("scenario string, narrative_id string, direction int, weight double", *DRIVERS), narratives, "narrative_id", "score")
    return C.pressure(mapped, ["scenario"]).select("scenario", r6("pressure").alias("pressure"), "missing_drivers")


@query(f"WITH {_SHARE} SELECT event_type AS scenario, day, round(p, 6) AS new_value, round(lag(p) OVER (PARTITION BY event_type ORDER BY day), 6) AS previous_value FROM sh")
def scenario_history(spark, d):
    from tempora.operators.world import history

    n = daily(Tables(spark, d)).select("day", F.col("event_type").alias("scenario"), F.col("n").cast("double").alias("n")).withColumn("p", C.renormalised(F.col("n"), ["day"]))
    return history(n, "scenario", "day", "p").select("scenario", "day", r6("p").alias("new_value"), r6("previous").alias("previous_value"))


@query(f"WITH {_SETS} SELECT set_id, count(*) AS scenarios, count(*) BETWEEN 3 AND 5 AS valid FROM s GROUP BY 1")
def scenario_set_size(spark, d):
    return sets(Tables(spark, d)).groupBy("set_id").agg(F.count(F.lit(1)).alias("scenarios")).withColumn("valid", F.col("scenarios").between(3, 5))


@query(f"WITH {_I} SELECT CASE WHEN conf < 0.3 THEN 'low' WHEN conf < 0.7 THEN 'moderate' ELSE 'high' END AS band, count(*) AS impacts FROM i GROUP BY 1")
def confidence_band(spark, d):
    return impacts(Tables(spark, d)).groupBy(C.band(F.col("conf"), 0.3, 0.7).alias("band")).agg(F.count(F.lit(1)).alias("impacts"))


_FC = "f AS (SELECT doc_id, source AS family, lang, quality AS outcome, (doc_id * 37 % 101) / 100.0::DOUBLE AS p, (doc_id * 53 % 97) / 96.0::DOUBLE AS own FROM documents JOIN labels USING (doc_id))"


def forecasts(t: Tables):
    f = t.documents.select("doc_id", F.col("source").alias("family"), "lang").join(t.labels, "doc_id")
    return f.select("doc_id", "family", "lang", F.col("quality").alias("outcome"), ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("p"), ((F.col("doc_id") * 53 % 97) / F.lit(96.0)).alias("own"))


@query(f"WITH {_FC} SELECT family, round(avg(power(p - outcome, 2)), 6) AS brier, count(*) AS n FROM f GROUP BY 1")
def brier_by_family(spark, d):
    return forecasts(Tables(spark, d)).groupBy("family").agg(r6(C.brier("p", "outcome")).alias("brier"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FC} SELECT lang, least(floor(p * 10), 9)::INT AS bin, round(avg(p), 6) AS mean_p, round(avg(outcome), 6) AS frequency, count(*) AS n FROM f GROUP BY 1, 2")
def calibration_bins(spark, d):
    return C.calibration(forecasts(Tables(spark, d)), ["lang"], "p", "outcome").select("lang", "bin", r6("mean_p").alias("mean_p"), r6("frequency").alias("frequency"), "n")


@query(f"WITH {_FC}, b AS (SELECT *, avg(outcome) OVER (PARTITION BY lang) AS base FROM f) SELECT lang, round(avg(power(p - outcome, 2)), 6) AS brier, round(avg(power(base - outcome, 2)), 6) AS base_brier FROM b GROUP BY 1")
def brier_vs_base(spark, d):
    return C.brier_vs_base(forecasts(Tables(spark, d)), ["lang"], "p", "outcome").select("lang", r6("brier").alias("brier"), r6("base_brier").alias("base_brier"))


@query(f"WITH {_FC} SELECT lang, round(avg(power(own - outcome, 2)), 6) AS owner_brier, round(avg(power(p - outcome, 2)), 6) AS system_brier, avg(power(own - outcome, 2)) < avg(power(p - outcome, 2)) AS owner_wins FROM f GROUP BY 1")
def forecast_compare(spark, d):
    out = forecasts(Tables(spark, d)).groupBy("lang").agg(C.brier("own", "outcome").alias("o"), C.brier("p", "outcome").alias("s"))
    return out.select("lang", r6("o").alias("owner_brier"), r6("s").alias("system_brier"), (F.col("o") < F.col("s")).alias("owner_wins"))


# Policies

POLICIES = (("deadline", "days_left", ">=", 90.0, 30.0, "high", True), ("no_trading", "automated_trades", "<=", 0.0, 0.0, "high", True), ("runway", "runway", ">=", 12.0, 2.0, "high", True), ("crypto", "share", "<=", 0.25, 0.05, "low", True), ("off", "share", "<=", 0.01, 0.0, "low", False), ("absent", "nothing", ">=", 1.0, 0.0, "high", True))
_POL = "pol(policy_id, metric, operator, threshold, margin, severity, enabled) AS (VALUES ('deadline', 'days_left', '>=', 90.0, 30.0, 'high', true), ('no_trading', 'automated_trades', '<=', 0.0, 0.0, 'high', true), ('runway', 'runway', '>=', 12.0, 2.0, 'high', true), ('crypto', 'share', '<=', 0.25, 0.05, 'low', true), ('off', 'share', '<=', 0.01, 0.0, 'low', false), ('absent', 'nothing', '>=', 1.0, 0.0, 'high', true))"
_MET = f"met AS (SELECT c_nationkey AS owner_id, 'runway' AS metric, CASE WHEN c_nationkey % 5 > 0 THEN sum(c_acctbal) / 20000 END AS value FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'share', sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING') / sum(c_acctbal) FROM customer WHERE c_acctbal > 0 GROUP BY 1 UNION ALL SELECT DISTINCT c_nationkey, 'days_left', c_nationkey * 10 FROM customer UNION ALL SELECT DISTINCT c_nationkey, 'automated_trades', (c_nationkey % 8 = 3)::INT FROM customer), {_POL}, ev AS (SELECT policy_id, owner_id, severity, CASE WHEN value IS NULL THEN 'UNKNOWN_DATA' WHEN operator = '>=' AND value < threshold THEN 'BREACH' WHEN operator = '<=' AND value > threshold THEN 'BREACH' WHEN operator = '>=' AND value < threshold + margin THEN 'WARN' WHEN operator = '<=' AND value > threshold - margin THEN 'WARN' ELSE 'PASS' END AS result FROM pol LEFT JOIN met USING (metric) WHERE enabled)"


def _evaluated(t: Tables):
    c = t.customer
    runway = c.groupBy(F.col("c_nationkey").alias("owner_id")).agg((F.sum("c_acctbal") / 20000).alias("v")).select("owner_id", F.when(F.col("owner_id") % 5 > 0, F.col("v")).alias("value"))
    share = c.filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("owner_id")).agg((F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))) / F.sum("c_acctbal")).alias("value"))
    owners = c.select(F.col("c_nationkey").alias("owner_id")).distinct()
    days = owners.select("owner_id", (F.col("owner_id") * 10).cast("double").alias("value"), F.lit("days_left").alias("metric"))
    trades = owners.select("owner_id", (F.col("owner_id") % 8 == 3).cast("double").alias("value"), F.lit("automated_trades").alias("metric"))
    metrics = runway.withColumn("metric", F.lit("runway")).unionByName(share.withColumn("metric", F.lit("share"))).unionByName(days).unionByName(trades)
    return J.evaluate_policies(metrics, t.rows("policy_id string, metric string, operator string, threshold double, margin double, severity string, enabled boolean", *POLICIES))


@query(f"WITH {_MET} SELECT policy_id, owner_id, result FROM ev")
def policy_eval(spark, d):
    return _evaluated(Tables(spark, d)).select("policy_id", "owner_id", "result")


@query(f"WITH {_MET} SELECT policy_id, owner_id FROM ev WHERE result = 'BREACH'")
def policy_breaches(spark, d):
    return _evaluated(Tables(spark, d)).filter("result = 'BREACH'").select("policy_id", "owner_id")


@query(f"WITH {_MET} SELECT severity, result, count(*) AS n FROM ev WHERE severity = 'high' GROUP BY 1, 2")
def policy_severity_filter(spark, d):
    return _evaluated(Tables(spark, d)).filter("severity = 'high'").groupBy("severity", "result").agg(F.count(F.lit(1)).alias("n"))


# Decisions


@query(f"""WITH {_I}, c AS (SELECT CASE WHEN user_id % 9 = 0 THEN 'breach' WHEN user_id % 9 = 1 THEN 'no data' ELSE {_ATT} END AS why, event_type IN ('signup', 'view') AS place, urg FROM i)
    SELECT CASE why WHEN 'breach' THEN 'REVIEW_POLICY' WHEN 'no data' THEN 'WAIT' WHEN 'VERIFY' THEN 'VERIFY' WHEN 'NOTE' THEN 'OBSERVE' WHEN 'BACKLOG' THEN 'NO_ACTION' ELSE CASE WHEN urg < 0.9 THEN 'PREPARE' WHEN place THEN 'REVIEW_LOCATION' ELSE 'REVIEW_ALLOCATION' END END AS decision_type, count(*) AS n FROM c GROUP BY 1""")
def decision_candidates(spark, d):
    a = _attention(impacts(Tables(spark, d)))
    policy = F.when(F.col("user_id") % 9 == 0, "BREACH").when(F.col("user_id") % 9 == 1, "UNKNOWN_DATA").otherwise("PASS")
    domain = F.when(F.col("event_type") == "signup", "migration").when(F.col("event_type") == "view", "housing").otherwise("portfolio")
    return a.groupBy(J.candidates(F.col("attention"), policy, domain, F.col("urg"), 0.9).alias("decision_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH dec AS (SELECT event_id, user_id, ts AS decided FROM events WHERE event_type = 'purchase'), k AS (SELECT dec.event_id, e.event_type, arg_max(e.value, row(e.ts, e.value)) AS v FROM dec JOIN events e ON e.user_id = dec.user_id AND e.ts <= dec.decided GROUP BY 1, 2)
    SELECT event_id, string_agg(event_type || '=' || printf('%.2f', v), ',' ORDER BY event_type) AS state FROM k GROUP BY 1""")
def decision_snapshot(spark, d):
    e = Tables(spark, d).events
    dec = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("decided"))
    out = J.snapshot(dec, e.select("user_id", "ts", "event_type", "value"), ["click", "error", "purchase", "signup", "view"], "user_id", "decided", "ts", "event_type", "value")
    return out.select("event_id", F.array_join(F.transform("state", lambda s: F.concat(s["fact"], F.lit("="), F.format_string("%.2f", s["value"]))), ",").alias("state"))


@query("SELECT o_orderkey, o_orderstatus AS decision_status, count(l_orderkey) AS outcomes, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE, 1) AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def outcome_append(spark, d):
    t = Tables(spark, d)
    out = J.with_outcomes(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("decision_status")), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag"), "o_orderkey")
    return out.groupBy("o_orderkey", "decision_status").agg(F.count("l_returnflag").alias("outcomes"), r6(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), 1).alias("returned"))


@query("WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' AS premise_ok, bool_and(l_returnflag <> 'R') AS outcome_ok FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT premise_ok, outcome_ok, count(*) AS decisions FROM r GROUP BY 1, 2")
def premise_vs_outcome(spark, d):
    t = Tables(spark, d)
    good = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("outcome_ok"))
    return J.premise_against_outcome(t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("premise_ok")).join(good, "o_orderkey"), "premise_ok", "outcome_ok")


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS considered_options FROM lineitem GROUP BY 1")
def considered_options(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("considered_options"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS nth FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000) SELECT * FROM o WHERE nth <= 3")
def last_three_times(spark, d):
    o = Tables(spark, d).orders
    return J.last_matches(o, (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice", "nth")


# Runs, metrics, tiers, lifecycles, memory


@query(f"WITH {_PAIR} SELECT 'ingest' AS stage, (SELECT count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-15') AS rows UNION ALL SELECT 'world', (SELECT count(*) FROM prev) UNION ALL SELECT 'exposures', (SELECT count(*) FROM customer WHERE c_acctbal > 0)")
def run_record(spark, d):
    t = Tables(spark, d)
    return G.stage_counts([("ingest", T.known_at(t.events, "ts", "2024-01-15 00:00:00")), ("world", _two_days(t)[0]), ("exposures", t.customer.filter("c_acctbal > 0"))])


@query("WITH g AS (SELECT ts::DATE AS d FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') < 0.22 * count(*)), i AS (SELECT d, d - (row_number() OVER (ORDER BY d))::INT AS island FROM g) SELECT strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day, count(*) AS length FROM i GROUP BY island")
def run_streak(spark, d):
    days = Tables(spark, d).events.groupBy(F.to_date("ts").alias("d")).agg((F.count_if(F.col("event_type") == "error") < 0.22 * F.count(F.lit(1))).alias("ok"))
    out = G.streaks(days, "d", "ok")
    return out.select(F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "length")


@query("SELECT event_type AS provider, (event_id % 3)::INT AS prompt_version, count(*) AS calls, round(sum(value), 2) AS cost, round(max(value), 2) AS worst_latency, count(*) FILTER (value < 1) AS retries FROM events GROUP BY 1, 2")
def call_metrics(spark, d):
    e = Tables(spark, d).events
    return e.groupBy(F.col("event_type").alias("provider"), (F.col("event_id") % 3).cast("int").alias("prompt_version")).agg(F.count(F.lit(1)).alias("calls"), r6(F.sum("value"), 2).alias("cost"), r6(F.max("value"), 2).alias("worst_latency"), F.count_if(F.col("value") < 1).alias("retries"))


@query(f"SELECT {_D} AS day, round(sum(value) / nullif(count(*) FILTER (value > 99), 0), 4) AS cost_per_useful FROM events GROUP BY 1")
def cost_per_useful(spark, d):
    return Tables(spark, d).events.groupBy(day("ts").alias("day")).agg(r6(F.try_divide(F.sum("value"), F.count_if(F.col("value") > 99)), 4).alias("cost_per_useful"))


@query("SELECT strftime(ts, '%Y-%m') AS month, round(count(*) FILTER (value > 80 AND event_type = 'error')::DOUBLE / nullif(count(*) FILTER (value > 80), 0), 6) AS false_critical_rate FROM events GROUP BY 1")
def false_critical_rate(spark, d):
    e = Tables(spark, d).events
    return e.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(r6(F.try_divide(F.count_if((F.col("value") > 80) & (F.col("event_type") == "error")).cast("double"), F.count_if(F.col("value") > 80))).alias("false_critical_rate"))


@query("SELECT (event_id % 4)::INT AS prompt_version, round(avg((event_type = 'error')::INT), 6) AS failure_rate, round(avg((event_id % 7 = user_id % 7)::INT), 6) AS disagreement_rate FROM events GROUP BY 1")
def prompt_version_failures(spark, d):
    e = Tables(spark, d).events
    return e.groupBy((F.col("event_id") % 4).cast("int").alias("prompt_version")).agg(r6(F.avg((F.col("event_type") == "error").cast("int"))).alias("failure_rate"), r6(F.avg((F.col("event_id") % 7 == F.col("user_id") % 7).cast("int"))).alias("disagreement_rate"))


_HD = r"sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))))"


@query(f"WITH n AS (SELECT {_HD} AS c, source, count(*) AS n FROM documents GROUP BY 1, 2), b AS (SELECT c, max(n) AS best, sum(n) AS size FROM n GROUP BY 1) SELECT round(sum(best) / sum(size), 6) AS purity, count(*) AS clusters FROM b")
def cluster_purity(spark, d):
    docs = Tables(spark, d).documents.select("source", I.content_hash(F.col("text")).alias("c"))
    return G.purity(docs, "c", "source").select(r6("purity").alias("purity"), "clusters")


@query("WITH x AS (SELECT doc_id FROM labels WHERE quality = 1), a AS (SELECT doc_id FROM documents WHERE n_chars > 1000), j AS (SELECT x.doc_id AS e, a.doc_id AS f FROM x FULL JOIN a ON x.doc_id = a.doc_id) SELECT count(*) FILTER (e IS NOT NULL AND f IS NOT NULL) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn, round(count(*) FILTER (e IS NOT NULL AND f IS NOT NULL)::DOUBLE / count(f), 6) AS precision, round(count(*) FILTER (e IS NOT NULL AND f IS NOT NULL)::DOUBLE / count(e), 6) AS recall FROM j")
def extraction_pr(spark, d):
    t = Tables(spark, d)
    out = G.extraction_scores(t.labels.filter("quality = 1"), t.documents.filter("n_chars > 1000"), ["doc_id"])
    return out.select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low' ELSE 'top' END AS amount_bucket, 'institution_' || dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS institution_role, 'C' || c_nationkey AS country FROM customer")
def l2_transform(spark, d):
    return G.transform_l2(Tables(spark, d).customer, "c_nationkey", "c_acctbal", "c_mktsegment", F.concat(F.lit("C"), F.col("c_nationkey").cast("string")), ["c_custkey"], [(0.0, "negative"), (5000.0, "low")])


@query("SELECT event_type AS provider, max((event_id % 4)::INT) AS max_tier, count(*) AS calls FROM events WHERE event_type <> 'error' OR event_id % 4 < 2 GROUP BY 1")
def tier_call_audit(spark, d):
    e = Tables(spark, d).events.withColumn("tier", (F.col("event_id") % 4).cast("int")).filter("event_type <> 'error' OR tier < 2")
    return e.groupBy(F.col("event_type").alias("provider")).agg(F.max("tier").alias("max_tier"), F.count(F.lit(1)).alias("calls"))


@query("SELECT event_id, event_type AS provider FROM events JOIN (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('signup', 0)) c(p, clearance) ON p = event_type WHERE event_id % 4 > clearance UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def clearance_check(spark, d):
    t = Tables(spark, d)
    cleared = t.rows("event_type string, clearance string", ("click", "L1"), ("view", "L2"), ("purchase", "L3"), ("signup", "L0"))
    calls = t.events.withColumn("tier", F.concat(F.lit("L"), (F.col("event_id") % 4).cast("string"))).join(cleared, "event_type", "left")
    return G.over_clearance(calls, "tier", "clearance").select("event_id", F.col("event_type").alias("provider"))


PROVIDERS = (("click", "L2", True), ("view", "L3", False), ("purchase", "L1", True), ("signup", "L2", False))


@query("""WITH c(p, clearance, must) AS (VALUES ('click', 2, true), ('view', 3, false), ('purchase', 1, true), ('signup', 2, false)), r AS (SELECT event_type, event_id % 4 AS tier, event_id % 3 = 0 AS done, clearance, must FROM events LEFT JOIN c ON p = event_type)
    SELECT event_type AS provider, CASE WHEN clearance IS NULL OR tier > clearance THEN 'refused' WHEN tier >= 2 AND must AND NOT done THEN 'transform_first' ELSE 'allowed' END AS release, count(*) AS calls FROM r GROUP BY 1, 2""")
def provider_release(spark, d):
    t = Tables(spark, d)
    cleared = t.rows("event_type string, clearance string, transform_required boolean", *PROVIDERS)
    tier = F.concat(F.lit("L"), (F.col("event_id") % 4).cast("string"))
    verdict = G.release(tier, F.col("clearance"), F.col("transform_required"), F.col("event_id") % 3 == 0)
    return t.events.join(cleared, "event_type", "left").groupBy(F.col("event_type").alias("provider"), verdict.alias("release")).agg(F.count(F.lit(1)).alias("calls"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS score, false AS authoritative FROM embeddings WHERE label = 3 AND vec_id % 5 > 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 5")
def semantic_recall(spark, d):
    e = Tables(spark, d).embeddings
    kind = F.element_at(F.array(F.lit("price"), *[F.lit(k) for k in G.MEMORY_KINDS[:4]]), (F.col("vec_id") % 5 + 1).cast("int"))
    rows = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("topic"), kind.alias("kind"), "embedding")
    memory = G.TableMemory(G.TableMemory(rows.filter("false")).remember(rows))
    return memory.recall("t3", e.filter("vec_id = 0").select("embedding").first()[0], 5).select("id", r6("score", 5).alias("score"), "authoritative")


@query("SELECT l_orderkey AS prompt, CASE WHEN count(*) FILTER (l_linenumber > 6) = 0 THEN 'L' || max((l_linenumber * 7 + l_orderkey) % 3 + 1) END AS tier FROM lineitem GROUP BY 1")
def tier_max_of_inputs(spark, d):
    """A prompt is an order, made from its lines, each of a tier; a seventh line declares none."""
    declared = F.when(F.col("l_linenumber") <= 6, F.concat(F.lit("L"), ((F.col("l_linenumber") * 7 + F.col("l_orderkey")) % 3 + 1).cast("string")))
    return G.highest_tier(Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("prompt"), declared.alias("tier")), ["prompt"], "tier")


@query("WITH t AS (SELECT user_id, event_id, ['candidate', 'validated', 'owner_approved', 'shadow', 'active', 'superseded'][(event_id % 6 + 1)::INT] AS state, ts FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM t), r AS (SELECT *, list_position(['candidate', 'validated', 'owner_approved', 'shadow', 'active'], state) AS a, list_position(['candidate', 'validated', 'owner_approved', 'shadow', 'active'], previous) AS b FROM l) SELECT event_id, previous, state FROM r WHERE NOT CASE WHEN previous IS NULL THEN state = 'candidate' WHEN state = 'superseded' THEN previous = 'active' ELSE coalesce(a = b + 1, false) END")
def lifecycle_legality(spark, d):
    names = F.array(*[F.lit(s) for s in (*G.STAGES, "superseded")])
    t = Tables(spark, d).events.select("user_id", "event_id", "ts", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("state"))
    return G.illegal_steps(t, "user_id", ["ts", "event_id"], "state").select("event_id", "previous", "state")


@query("SELECT user_id AS rule, count(*) AS confirmations, user_id % 2 = 0 AS approved FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 12")
def rule_promotion(spark, d):
    e = Tables(spark, d).events.select(F.col("user_id").alias("rule"), "event_type")
    return G.promotable(e.filter("event_type = 'purchase'"), "rule", 12, e.filter("rule % 2 = 0").select("rule").distinct())


ARTEFACTS = (("score", 1, "2024-01-01 00:00:00", "active"), ("score", 2, "2024-01-12 00:00:00", "active"), ("score", 3, "2024-01-18 00:00:00", "shadow"))
_ART = "art(v, f, t) AS (VALUES (1, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-12'), (2, TIMESTAMP '2024-01-12', NULL))"


@query(f"WITH {_ART} SELECT v AS version, count(*) AS events, round(sum(value * v), 2) AS scored FROM events JOIN art ON f <= ts AND (t IS NULL OR ts < t) GROUP BY 1")
def artefact_version_as_of(spark, d):
    t = Tables(spark, d)
    active = t.rows("name string, version int, at timestamp, stage string", *ARTEFACTS).filter("stage = 'active'")
    h = T.intervals(active, ["name"], "at", ["version"], bucket="month")
    out = T.disjoint_interval_join(t.events.withColumn("name", F.lit("score")), h, ["name"], "ts", ["version"], bucket="hour")
    return out.groupBy("version").agg(F.count(F.lit(1)).alias("events"), r6(F.sum(F.col("value") * F.col("version")), 2).alias("scored"))


@query("SELECT 'active' AS stage, count(*) AS outputs FROM events WHERE event_id % 3 <> 2")
def shadow_isolation(spark, d):
    t = Tables(spark, d)
    stages = t.rows("version int, stage string", (0, "active"), (1, "active"), (2, "shadow"))
    out = t.events.withColumn("version", (F.col("event_id") % 3).cast("int")).join(stages, "version").filter("stage = 'active'")
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("outputs"))


#: What the candidate would have said: the mean of the forecast and of how its language turned out in earlier documents, as far as there are any.
_REPLAY = f"""WITH {_FC}, h AS (SELECT *, coalesce(sum(outcome) OVER w, 0) AS good, count(*) OVER w AS seen FROM f WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    q AS (SELECT lang, doc_id, power(p - outcome, 2) AS old, power((p + CASE WHEN seen > 0 THEN good / seen ELSE p END) / 2 - outcome, 2) AS new FROM h)"""
_CUTS = " ".join(f"WHEN u < {x!r}::DOUBLE THEN {k}" for k, x in enumerate(G._POISSON))


@query(f"""{_REPLAY}, u AS (SELECT lang, old - new AS gain, draw, ('0x' || substr(md5(draw || ':' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM q, range(1, 201) r(draw)),
    g AS (SELECT lang, draw, sum(w * gain) / sum(w) AS gain FROM (SELECT *, CASE {_CUTS} ELSE {len(G._POISSON)} END AS w FROM u) GROUP BY 1, 2 HAVING sum(w) > 0),
    e AS (SELECT lang, list_sort(list(gain)) AS l FROM g GROUP BY 1), b AS (SELECT lang, count(*) AS cases, avg(old) AS o, avg(new) AS n FROM q GROUP BY 1)
    SELECT lang, cases, round(o, 6) AS old_brier, round(n, 6) AS new_brier, round(l[6], 6) AS low, round(l[len(l) - 5], 6) AS high, CASE WHEN l[6] > 0 THEN 'improves' WHEN l[len(l) - 5] < 0 THEN 'worse' ELSE 'undecided' END AS verdict FROM b JOIN e USING (lang)""")
def candidate_validation(spark, d):
    from tempora.operators.scans import running_total

    f = forecasts(Tables(spark, d)).withColumns({"at": F.timestamp_seconds("doc_id"), "one": F.lit(1)})
    known = running_total(f, ["lang"], "at", ["doc_id"], ["outcome", "one"], ["good", "seen"], bucket="hour")
    replayed = known.withColumn("candidate", (F.col("p") + F.coalesce(F.try_divide("good", "seen"), "p")) / 2)
    out = G.validate_candidate(replayed, ["lang"], "doc_id", "p", "candidate", "outcome")
    return out.select("lang", "cases", *[r6(c).alias(c) for c in ("old_brier", "new_brier", "low", "high")], "verdict")


@query("SELECT DISTINCT user_id AS artefact FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def unapproved_active(spark, d):
    e = Tables(spark, d).events.select(F.col("user_id").alias("artefact"), "event_type", "value")
    return e.filter("event_type = 'signup'").select("artefact").distinct().join(e.filter("event_type = 'purchase' AND value > 90"), "artefact", "left_anti")


@query("SELECT conv_id, role, arg_max(turn, turn) AS turn, arg_max(length(text), turn) AS chars, count(*) - 1 AS superseded FROM conversations GROUP BY 1, 2")
def memory_supersession(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "role", "turn", F.length("text").cast("long").alias("chars"))
    return G.latest_of(c, ["conv_id", "role"], ["turn"])


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    e = Tables(spark, d).embeddings
    query_vector = e.filter("vec_id = 0").select("embedding").first()[0]
    return G.nearest(e, "vec_id", "embedding", query_vector, 10).select("vec_id", r6("score", 5).alias("score"))


@query("""SELECT 'labels' AS source_id, 'ok' AS status, (SELECT count(*) FROM labels WHERE doc_id > 50) AS items UNION ALL SELECT 'orders', 'ok', (SELECT count(*) FROM orders) UNION ALL SELECT 'prices', 'failed', NULL""")
def ingest_status(spark, d):
    """Two sources answer, one from its cursor on, a third does not: the run goes on without it, and no value stands in its place."""
    from tempora.sources.tables import FileAdapter, ingest

    t = Tables(spark, d)
    adapters = [FileAdapter("labels", f"{d}/labels.parquet", t.labels.schema, "doc_id"), FileAdapter("orders", f"{d}/orders.parquet", spark.read.parquet(f"{d}/orders.parquet").schema, "o_orderkey"), FileAdapter("prices", f"{d}/no_such_table.parquet", t.labels.schema, "doc_id")]
    rows, _, status = ingest(spark, adapters, {"labels": "50"})
    told = spark.createDataFrame([s[:2] for s in status], "source_id string, status string")
    return told.join(rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("items")), "source_id", "left")
