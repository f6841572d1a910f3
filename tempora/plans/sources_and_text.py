"""Queries of source adapters (S2, S3), read surfaces (S10), truth among claims (D18, N4) and full text (M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import truth as C
from tempora.operators.full_text import FullText
from tempora.plans.registry import Tables, query, r6, us
from tempora.sources import adapters as A
from tempora.sources.surfaces import Surface
from tempora.sources.tables import own_folder, save

RUN = "2024-02-01 00:00:00"
_SPACE = r"[\x20\x09-\x0D]"


def _nested(sql: str, steps) -> str:
    for pattern, by in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"
    return sql


def _unescaped(sql: str) -> str:
    for name, char in A.ENTITIES.items():
        sql = f"replace({sql}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql


_SEEN = _nested("html", [(r"(?s)<!--.*?(?:-->|\z)", " "), *[(rf"(?is)<{t}(?:{_SPACE}[^>]*)?>.*?(?:</{t}{_SPACE}*>|\z)", " ") for t in A.HIDDEN]])
_LINES = _unescaped(_nested(_SEEN, [(rf"(?i)</?(?:{'|'.join(A.BLOCKS)})(?:{_SPACE}[^>]*)?/?>", "\n"), (r"<[/!A-Za-z][^>]*>", "")]).replace("'\n'", "chr(10)"))
_PAGE_TEXT = _nested(_LINES, [(r"[\x20\x09\x0B-\x0D]+", " "), (r" ?\n[\n ]*", "\n"), (r"^[\n ]+|[\n ]+\z", "")]).replace("'\n'", "chr(10)")


@query(rf"""WITH t AS (SELECT page_id, html, {_PAGE_TEXT} AS body FROM pages)
    SELECT page_id::VARCHAR AS external_id, {_unescaped(rf"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '{_SPACE}+', ' ', 'g'))")} AS title,
    regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language,
    sha256(lower(trim(regexp_replace(body, '{_SPACE}+', ' ', 'g')))) AS content_hash, length(body)::INT AS chars, length(body) - length(replace(body, chr(10), '')) + 1 AS lines FROM t""")
def web_items(spark, d):
    web = A.KindAdapter("web", "web", f"{d}/pages.parquet", {"id": "page_id", "at": f"timestamp'{RUN}'", "url": "url", "html": "html"}, RUN)
    items, _ = web.fetch(spark, None)
    return items.select("external_id", "title", "language", "content_hash", F.length("raw_text").alias("chars"), F.size(F.split("raw_text", "\n")).cast("long").alias("lines"))


#: Providers of numbers: purchases as a price list, views as a market that writes its pairs in its own way, shipped lines as a wide table of series.
#: The price list has a limit of 60; what is above it is not between low and high.
_PRICE_LIST = {
    "at": "cast(ts AS timestamp)", "instrument": "'k' || get_json_object(props, '$.k')", "close": "if(event_type = 'purchase', value, NULL)",
    "currency": "'usd'", "low": "0D", "high": "60D",
}
_SINCE = "2024-01-10 00:00:00"
_SERIES_SINCE = "1996-01-01 00:00:00"


@query(f"""SELECT 'prices' AS source_id, 'k' || (props->>'$.k') AS series, epoch_us(ts) AS at_us, value, 'USD' AS unit
        FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '{_SINCE}' AND value > 0 AND value <= 60
    UNION ALL SELECT 'crypto', 'desk:U' || user_id || '-EUR', epoch_us(ts), value, 'EUR' FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '{_SINCE}' AND value > 0
    UNION ALL SELECT 'macro', u.s, epoch_us(l_shipdate::TIMESTAMP), u.v, 'n'
        FROM lineitem, unnest([{{'s': 'l_quantity', 'v': l_quantity::DOUBLE}}, {{'s': 'l_discount', 'v': l_discount::DOUBLE}}]) x(u) WHERE l_shipdate > TIMESTAMP '{_SERIES_SINCE}'""")
def market_observations(spark, d):
    events, tape = f"{d}/events.parquet", "cast(ts AS timestamp)"
    prices = A.KindAdapter("prices", "prices", events, _PRICE_LIST, RUN)
    crypto = A.KindAdapter("crypto", "crypto", events, {"at": tape, "venue": "'Desk'", "pair": "'u' || user_id || '/eur'", "price": "if(event_type = 'view', value, NULL)"}, RUN)
    macro = A.KindAdapter("macro", "macro", f"{d}/lineitem.parquet", {"at": "cast(l_shipdate AS timestamp)", "unit": "'n'"}, RUN, wide=("l_quantity", "l_discount"))
    items = A.together([a.fetch(spark, since)[0] for a, since in ((prices, _SINCE), (crypto, _SINCE), (macro, _SERIES_SINCE))])
    return A.observations(items).select("source_id", "series", us("at").alias("at_us"), "value", "unit")


@query(f"""SELECT CASE WHEN event_type <> 'purchase' OR value IS NULL THEN 'no close' WHEN value <= 0 THEN 'price not above zero' ELSE 'close outside low and high' END AS reason, count(*) AS rows_refused
    FROM events WHERE ts > TIMESTAMP '{_SINCE}' AND (event_type <> 'purchase' OR value IS NULL OR value <= 0 OR value > 60) GROUP BY 1""")
def rejected_rows(spark, d):
    prices = A.KindAdapter("prices", "prices", f"{d}/events.parquet", _PRICE_LIST, RUN)
    return prices.rejected(spark, _SINCE).groupBy("reason").agg(F.count(F.lit(1)).alias("rows_refused"))


_ORDERS = Surface("order_state", ["o_custkey"], ["o_orderstatus", "o_totalprice"], "o_orderdate", "o_orderkey")


@query("""WITH i(t) AS (VALUES (TIMESTAMP '1996-07-01'), (TIMESTAMP '1998-01-01')), l AS (SELECT t, o_custkey, max(row(o_orderdate, o_orderkey)) AS m FROM orders JOIN i ON o_orderdate <= t GROUP BY 1, 2)
    SELECT epoch_us(t) AS as_of_us, l.o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS since_us, o_orderkey AS provenance FROM l JOIN orders o ON o.o_custkey = l.o_custkey AND row(o.o_orderdate, o.o_orderkey) = m""")
def surface_at(spark, d):
    at = _ORDERS.register(spark, Tables(spark, d).orders)[0]
    out = spark.sql(f"SELECT q.t, s.* FROM VALUES (TIMESTAMP'1996-07-01 00:00:00'), (TIMESTAMP'1998-01-01 00:00:00') AS q(t), LATERAL {at}(q.t) s")
    return out.select(us("t").alias("as_of_us"), "o_custkey", "o_orderstatus", "o_totalprice", us("known_since").alias("since_us"), F.element_at("provenance_ids", 1).alias("provenance"))


_LAST = "(SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '{}' ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC)"


@query(f"""SELECT n.o_custkey, o.o_orderstatus AS old_o_orderstatus, n.o_orderstatus AS new_o_orderstatus, o.o_totalprice AS old_o_totalprice, n.o_totalprice AS new_o_totalprice, o.o_custkey IS NULL AS appeared,
    concat_ws(',', o.o_orderkey, n.o_orderkey) AS provenance FROM {_LAST.format('1998-01-01')} n LEFT JOIN {_LAST.format('1997-01-01')} o USING (o_custkey)
    WHERE o.o_custkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""")
def surface_changes(spark, d):
    changes = _ORDERS.register(spark, Tables(spark, d).orders)[1]
    out = spark.sql(f"SELECT * FROM {changes}(TIMESTAMP'1997-01-01 00:00:00', TIMESTAMP'1998-01-01 00:00:00')")
    return out.withColumn("provenance", F.array_join("provenance_ids", ",")).drop("provenance_ids", "known_since")


#: Suppliers claim the state of a part; the class of a supplier follows from its nation.
_TURNS, _WRONG, _STRENGTH = 4, 2, 10.0
_CLAIMS = "c AS (SELECT l_partkey AS o, l_suppkey AS s, arg_max(l_returnflag, row(l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY 1, 2)"
_PRIOR = "CASE s_nationkey % 4 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(C.PRIORS.values())) + " END::DOUBLE"


def _turn(i: int) -> str:
    return f"""v{i} AS MATERIALIZED (SELECT o, v, count(*) AS claims, sum(ln({_WRONG}.0::DOUBLE * a / (1 - a))) AS sc FROM c JOIN a{i} USING (s)
        GROUP BY 1, 2), m{i} AS (SELECT o, greatest(max(sc), 0) AS top, greatest({_WRONG + 1} - count(*), 0) AS gone FROM v{i} GROUP BY 1),
    e{i} AS (SELECT o, v, claims, exp(sc - top) AS e, gone * exp(-top) AS rest FROM v{i} JOIN m{i} USING (o)),
    p{i} AS MATERIALIZED (SELECT o, v, claims, e / (sum(e) OVER (PARTITION BY o) + rest) AS p, rest / (sum(e) OVER (PARTITION BY o) + rest) AS unknown FROM e{i}),
    a{i + 1} AS MATERIALIZED (SELECT s, n, least(greatest((prior * {_STRENGTH}::DOUBLE + coalesce(r, 0)) / ({_STRENGTH}::DOUBLE + coalesce(n, 0)), {C.LEAST}), {C.MOST}) AS a
        FROM w LEFT JOIN (SELECT s, sum(p) AS r, count(*) AS n FROM c JOIN p{i} USING (o, v) GROUP BY 1) USING (s))"""


_TRUTH = f"WITH {_CLAIMS}, w AS (SELECT s_suppkey AS s, {_PRIOR} AS prior FROM supplier), a0 AS (SELECT s, prior AS a FROM w), " + ", ".join(_turn(i) for i in range(_TURNS + 1))


def _truth(spark, d):
    t = Tables(spark, d)
    last = t.lineitem.groupBy(F.col("l_partkey").alias("object"), F.col("l_suppkey").alias("source")).agg(F.max_by("l_returnflag", F.struct("l_orderkey", "l_linenumber")).alias("value"))
    classes = F.element_at(F.array(*[F.lit(c) for c in C.PRIORS]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    priors = t.supplier.select(F.col("s_suppkey").alias("source"), C.class_prior(classes).alias("prior"))
    return C.estimate(last, priors, _WRONG, save, _STRENGTH, _TURNS, 0.0)


@query(f"""{_TRUTH}, h AS (SELECT o, (sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) + max(CASE WHEN unknown > 0 THEN -unknown * ln(unknown) ELSE 0 END)) / ln({_WRONG + 1}) AS h FROM p{_TURNS} GROUP BY 1)
    SELECT o AS l_partkey, v AS l_returnflag, claims, round(p, 6) AS probability, round(unknown, 6) AS unknown, round(h, 6) AS disagreement FROM p{_TURNS} JOIN h USING (o)""")
def claim_truth(spark, d):
    out = _truth(spark, d).values
    return out.select(F.col("object").alias("l_partkey"), F.col("value").alias("l_returnflag"), "claims", *[r6(c).alias(c) for c in ("probability", "unknown", "disagreement")])


@query(f"{_TRUTH} SELECT s AS s_suppkey, coalesce(n, 0) AS claims, round(a, 6) AS reliability FROM a{_TURNS}")
def claim_sources(spark, d):
    return _truth(spark, d).sources.select(F.col("source").alias("s_suppkey"), "claims", r6("reliability").alias("reliability"))


def _text_index(spark, d):
    t = Tables(spark, d)
    index = FullText(spark, own_folder(spark, "text"), buckets=16, slices=4)
    index.add(t.documents.select(F.col("doc_id").alias("id"), "text", F.lit(RUN).alias("known_at")), "1")
    return index, t.benchmark.select(F.col("item_id").alias("qid"), "text")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), l AS (SELECT doc_id, coalesce(len(w), 0) AS n FROM d), z AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
    f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY 1, 2),
    g AS (SELECT t, count(*) AS df FROM f GROUP BY 1), q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY 1, 2),
    s AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
        FROM q JOIN f USING (t) JOIN g USING (t) JOIN l USING (doc_id), z GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def text_search(spark, d):
    index, queries = _text_index(spark, d)
    return index.search(queries, 10).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, '  ') || ' ' AS w FROM documents), q AS (SELECT item_id, ' ' || array_to_string({_WORDS}, '  ') || ' ' AS p FROM benchmark)
    SELECT item_id, doc_id, ((length(w) - length(replace(w, p, ''))) / length(p))::BIGINT AS times FROM q JOIN d ON contains(w, p) WHERE length(p) > 2""")
def text_phrases(spark, d):
    """Items that stand in a document word for word. (The SQL counts copies that do not overlap; an item of these tables can't overlap itself.)"""
    index, queries = _text_index(spark, d)
    return index.phrases(queries, save).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "times")
