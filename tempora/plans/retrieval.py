"""Queries that look back or up: episodes with their outcomes (J6), the vector index (M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import episodes as E
from tempora.operators import temporal as T
from tempora.operators import vector_index as V
from tempora.plans.registry import Tables, query, r6, us
from tempora.sources.tables import save

#: A view, then a click with no error in between; while the last purchase was of 30 or more; the next signup within five days.
_VIEW_TO_CLICK = E.Automaton(({"view": 1}, {"view": 1, "click": 2, "error": 0, None: 1}), accept=2)


@query("""WITH s AS (SELECT *, count(*) FILTER (event_type IN ('click', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM events),
    e AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS started, max(ts) AS ended, arg_max(event_id, row(ts, event_id)) AS last, arg_max(event_type, row(ts, event_id)) AS closing FROM s GROUP BY user_id, seg),
    x AS (SELECT user_id, started, ended, last FROM e WHERE started IS NOT NULL AND closing = 'click'),
    p AS (SELECT user_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type = 'purchase'),
    h AS (SELECT x.*, p.value AS held, row_number() OVER (PARTITION BY x.user_id ORDER BY ended DESC, last DESC) AS nth FROM x JOIN p ON p.user_id = x.user_id AND valid_from <= ended AND (valid_to IS NULL OR ended < valid_to) WHERE p.value >= 30),
    o AS (SELECT h.user_id, h.last, arg_min(g.value, row(g.ts, g.event_id)) AS outcome, min(g.ts) AS outcome_at FROM h JOIN events g ON g.user_id = h.user_id AND g.event_type = 'signup' AND g.ts > ended AND g.ts <= ended + INTERVAL 5 DAY WHERE nth <= 3 GROUP BY 1, 2)
    SELECT user_id, nth::INT AS nth, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, held, epoch_us(outcome_at) AS outcome_us, outcome FROM h LEFT JOIN o USING (user_id, last) WHERE nth <= 3""")
def last_times_while(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "ts", "event_type", "value")
    found = E.match(e, ["user_id"], "ts", "event_id", "event_type", _VIEW_TO_CLICK)
    purchases = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("held"))
    history = T.intervals(purchases, ["user_id"], "ts", ["event_id"])
    signups = e.filter("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("value").alias("outcome"))
    out = E.last_times(found, history, F.col("held") >= 30, signups, ["user_id"], "ts", ["outcome"], ["event_id"], "5 DAYS", history_ties=["event_id"])
    return out.select("user_id", "nth", us("started").alias("started_us"), us("ended").alias("ended_us"), "held", us("outcome_at").alias("outcome_us"), "outcome")


def _indexed(spark, d):
    e = Tables(spark, d).embeddings
    model = V.fit(e, "vec_id", "embedding", 64)
    return e, model, save(V.build(e, "vec_id", "embedding", model), "postings")


_NEAR = """SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 20 = 0"""


@query(f"WITH s AS ({_NEAR}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) SELECT qid, id, round(score, 5) AS score, rank FROM r WHERE rank <= 10")
def vector_search_exact(spark, d):
    e, model, postings = _indexed(spark, d)
    out = V.search(postings, model, e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, exact=True)
    return out.select("qid", "id", r6("score", 5).alias("score"), "rank")


@query(None)
def vector_search(spark, d):
    """The estimate alone; tests measure its recall."""
    e, model, postings = _indexed(spark, d)
    out = V.search(postings, model, e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return out.select("qid", "id", r6("score", 5).alias("score"), "rank")
