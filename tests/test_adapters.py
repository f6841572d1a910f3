"""Source adapters by kind, against files of providers."""

import json

import pytest

from tempora.sources import adapters as A
from tempora.sources import tables

NOW = "2024-05-01 00:00:00"


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_page_is_what_its_reader_sees(spark):
    html = (
        "<html lang='EN'><head><title> A &amp;lt; &quot;b&quot;\n</title><style>p{}</style></head><body><nav>menu</nav><!-- <p>no</p> --><h1>Head</h1>"
        "<p>one <b>bold</b>er<br/>two &lt;tag&gt; &amp;amp;</p><pre>x</pre><script>var a='</p>';</script ><p>3 < 4</p><footer>f</footer><script>never closed"
    )
    df = spark.createDataFrame([(html,), ("",), (None,), ("plain",)], "html string").select(A.html_text("html").alias("text"), A.html_title("html").alias("title"))
    got = [tuple(r) for r in df.collect()]
    assert got == [("Head\none bolder\ntwo <tag> &amp;\nx\n3 < 4", 'A &lt; "b"'), ("", None), (None, None), ("plain", None)]


def test_a_long_page(spark):
    html = "<html><title>t</title>" + "<p>word</p>" * 100_000 + "<script>" + "x" * 500_000
    got = spark.createDataFrame([(html,)], "html string").select(A.html_text("html").alias("t")).first().t
    assert got == "\n".join(["word"] * 100_000)


def test_feed_submission_and_register(spark, tmp_path):
    posts = lines(tmp_path / "posts.json", [
        {"key": 1, "when": "2024-04-01 00:00:00", "body": "Title\nrest", "link": "http://www.a.org/x/?utm_source=q", "ja": 0},
        {"key": 2, "when": None, "body": "no time"}, {"key": None, "when": "2024-04-02 00:00:00", "body": "no id"}, {"key": 4, "when": "2024-04-03 00:00:00", "body": ""},
    ])
    feed = A.KindAdapter("chan", "feed", posts, {"id": "key", "at": "`when`", "text": "body", "url": "link"}, NOW, "json")
    items, cursor = feed.fetch(spark, None)
    got = {r.external_id: r for r in items.collect()}
    assert set(got) == {"1", "4"} and cursor == "2024-04-03 00:00:00"
    assert (got["1"].title, got["1"].canonical_url, got["1"].source_id, str(got["1"].ingested_at)) == ("Title", "a.org/x", "chan", NOW)
    assert items.columns == tables.SCHEMAS["raw_item"].names and len({r.id for r in got.values()}) == 2
    assert sorted(r.reason for r in feed.rejected(spark, None).collect()) == ["no at", "no id"]

    manual = A.KindAdapter("owner", "manual", posts, {"id": "key", "at": "`when`", "text": "body", "submitted_by": "if(key = 1, 'me', NULL)"}, NOW, "json")
    assert [r.external_id for r in manual.fetch(spark, None)[0].collect()] == ["1"]
    assert "no submitted_by" in {r.reason for r in manual.rejected(spark, None).collect()}

    xml = tmp_path / "acts.xml"
    xml.write_text("<acts><act><no>7</no><day>2024-04-05T00:00:00Z</day><name>On x</name><body>Text.</body></act><act><no>8</no><day>2024-04-06T00:00:00Z</day><body>More.</body></act></acts>")
    legal = A.KindAdapter("gazette", "legal", str(xml), {"id": "no", "at": "day", "text": "body", "title": "name", "register": "'acts'"}, NOW, "xml", {"rowTag": "act"})
    assert sorted((r.external_id, r.title) for r in legal.fetch(spark, None)[0].collect()) == [("acts/7", "On x"), ("acts/8", None)]


def test_series_keep_what_is_missing_as_null(spark, tmp_path):
    path = tmp_path / "macro.csv"
    path.write_text("DATE,CPI,GDP\n2024-01-01,1.5,.\n2024-02-01,oops,7\n2024-03-01,,8\n")
    macro = A.KindAdapter("fred", "macro", str(path), {"at": "cast(DATE AS timestamp)", "unit": "'index'"}, NOW, "csv", {"header": "true"}, wide=("CPI", "GDP"))
    items, cursor = macro.fetch(spark, None)
    got = sorted(((r.series, str(r["at"])[:10], r.value, r.unit) for r in A.observations(items).collect()), key=str)
    want = [("CPI", "2024-01-01", 1.5, "index"), ("CPI", "2024-03-01", None, "index"), ("GDP", "2024-01-01", None, "index"), ("GDP", "2024-02-01", 7.0, "index"), ("GDP", "2024-03-01", 8.0, "index")]
    assert got == sorted(want, key=str) and cursor == "2024-03-01 00:00:00"
    assert [(r.series, r.reason) for r in macro.rejected(spark, None).collect()] == [("CPI", "not a number")]


def test_markets_refuse_what_no_market_has(spark, tmp_path):
    path = lines(tmp_path / "t.json", [{"p": p, "v": v} for p, v in (("btc/usd", 5.0), ("BTC_USD", -1.0), ("btc", 2.0), ("eth-eur", None))])
    crypto = A.KindAdapter("x", "crypto", path, {"at": f"timestamp'{NOW}'", "venue": "'Kx'", "pair": "p", "price": "v"}, NOW, "json")
    assert [tuple(r) for r in A.observations(crypto.fetch(spark, None)[0]).select("series", "value", "unit").collect()] == [("kx:BTC-USD", 5.0, "USD")]
    assert sorted(r.reason for r in crypto.rejected(spark, None).collect()) == ["no price", "not a pair", "price not above zero"]


def test_cursor_and_columns_reach_the_scan(spark):
    events = "/root/testdata/sf0.001/events.parquet"
    a = A.KindAdapter("e", "prices", events, {"at": "cast(ts AS timestamp)", "instrument": "event_type", "close": "value", "currency": "'usd'"}, NOW)
    first, cursor = a.fetch(spark, None)
    items, same = a.fetch(spark, "2024-01-20 00:00:00")
    text = plan(items)
    assert "user_id" not in text.split("ReadSchema")[1] and "GreaterThan(ts" in text.replace(" ", "")
    assert 0 < items.count() < first.count() and cursor == same
    empty, kept = a.fetch(spark, cursor)
    assert empty.isEmpty() and kept == cursor
    late = A.KindAdapter("e", "prices", events, a.columns, NOW, overlap=3_600_000_000)
    assert late.fetch(spark, cursor)[0].count() > 0


def test_failures_have_types_and_degrade_the_run(spark, tmp_path):
    events = "/root/testdata/sf0.001/events.parquet"
    good = A.KindAdapter("good", "prices", events, {"at": "cast(ts AS timestamp)", "instrument": "event_type", "close": "value", "currency": "'usd'"}, NOW)
    gone = A.KindAdapter("gone", "prices", str(tmp_path / "none.parquet"), good.columns, NOW)
    renamed = A.KindAdapter("renamed", "prices", events, good.columns | {"close": "price_v2"}, NOW)
    unmapped = A.KindAdapter("unmapped", "prices", events, {"at": "ts"}, NOW)
    (tmp_path / "bad.parquet").write_text("no parquet")
    broken = A.KindAdapter("broken", "prices", str(tmp_path / "bad.parquet"), good.columns, NOW)
    for adapter, error in ((gone, A.Unreachable), (renamed, A.SchemaChanged), (unmapped, A.SchemaChanged), (broken, A.Unreachable)):
        with pytest.raises(error):
            adapter.fetch(spark, None)
    out, moved, status = tables.ingest(spark, [gone, good, renamed, broken], {"gone": "2024-01-01 00:00:00"})
    assert [(s, w) for s, w, _ in status] == [("gone", "failed"), ("good", "ok"), ("renamed", "failed"), ("broken", "failed")]
    assert moved["gone"] == "2024-01-01 00:00:00" and "renamed" not in moved and out.count() == good.fetch(spark, None)[0].count()


def test_an_item_read_twice_is_one_item(spark):
    pages = "/root/testdata/sf0.001/pages.parquet"
    a, b = (A.KindAdapter("w", "web", pages, {"id": "page_id", "at": f"timestamp'{NOW}'", "url": "url", "html": "html"}, at) for at in (NOW, "2025-01-01 00:00:00"))
    ids = [{r.id for r in x.fetch(spark, None)[0].select("id").collect()} for x in (a, b)]
    assert ids[0] == ids[1] and len(ids[0]) == spark.read.parquet(pages).count()
