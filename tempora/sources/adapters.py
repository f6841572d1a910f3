"""Source adapters by kind (S2, S3): pages, feeds, submissions, legal texts, macro series, prices, crypto markets.

An adapter reads a provider's files with Spark's own readers, so the cursor
and the columns reach the scan, and gives ``raw_item`` rows. What is special
about a provider is in its ``columns`` (SQL expressions over its columns, by the
canonical input names of its kind); nothing else sees the provider's names.
Numbers travel as JSON in ``raw_text``; ``observations`` reads them back.

A provider that cannot be read is ``Unreachable``, one whose columns are not
those that the adapter knows is ``SchemaChanged``; both are ``ProviderError``.
A row that lacks what its kind needs is no item: ``rejected`` returns it with a
reason, and no value is put in its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.identity import canonical_url, content_hash
from tempora.sources.tables import ProviderError, conform, exists

PARSE_VERSION = "adapter-1"
#: Elements whose content no reader sees.
HIDDEN = ("script", "style", "head", "title", "nav", "footer", "noscript", "template")
#: Elements that start a new line.
BLOCKS = ("p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "tr")
#: Character references by name; that of the ampersand comes last.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "amp": "&"}
#: How providers of series write that there is no value.
NO_VALUE = ("", ".", "NA", "N/A", "null")


class Unreachable(ProviderError):
    """The provider gave nothing that could be read."""


class SchemaChanged(ProviderError):
    """The provider's columns or their types are no longer those that the adapter maps."""


def html_text(html: Column) -> Column:
    """What a reader of a page sees, one block a line. References by number stay as they are."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:[\x20\x09-\x0D][^>]*)?>.*?(?:</{tag}[\x20\x09-\x0D]*>|\z)", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[\x20\x09-\x0D][^>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"<[/!A-Za-z][^>]*>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n[\n ]*", "\n")
    return F.regexp_replace(out, r"^[\n ]+|[\n ]+\z", "")


def html_title(html: Column) -> Column:
    """The title of a page; null if it has none."""
    title = F.regexp_extract(html, r"(?is)<title(?:[\x20\x09-\x0D][^>]*)?>(.*?)</title", 1)
    for name, char in ENTITIES.items():
        title = F.replace(title, F.lit(f"&{name};"), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(title, r"[\x20\x09-\x0D]+", " ")), F.lit(""))


@dataclass(frozen=True)
class Kind:
    """What rows of a kind need, and how they become items: external id, address, title, text, language."""

    needs: dict[str, str]
    items: Callable[[DataFrame], DataFrame]
    optional: dict[str, str] = field(default_factory=dict)
    checks: Callable[[], dict[str, Column]] = dict


def _items(df: DataFrame, text: Column, external: Column, url: Column | None = None, title: Column | None = None, language: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    made = {"external_id": external, "url": url, "title": title, "raw_text": text, "language": language}
    return df.select(F.col("at").alias("published_at"), *[(none if c is None else c.cast("string")).alias(n) for n, c in made.items()])


def _observed(df: DataFrame, series: Column, **values: Column) -> DataFrame:
    # ignoreNullFields would leave a missing value out; it is to be seen as null.
    body = F.to_json(F.struct(series.alias("series"), *[c.alias(n) for n, c in values.items()]), {"ignoreNullFields": "false"})
    return _items(df, body, F.concat_ws("@", series, F.unix_micros("at").cast("string")))


def _pages(df: DataFrame) -> DataFrame:
    language = F.nullif(F.lower(F.regexp_extract("html", r"(?is)<html[^>]*[\x20\x09-\x0D]lang=[\"']?([A-Za-z-]+)", 1)), F.lit(""))
    return _items(df, html_text(F.col("html")), F.col("id"), F.col("url"), html_title(F.col("html")), language)


def _posts(df: DataFrame) -> DataFrame:
    return _items(df, F.col("text"), F.col("id"), F.col("url"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 200), F.col("language"))


def _documents(df: DataFrame) -> DataFrame:
    return _items(df, F.col("text"), F.concat_ws("/", "register", "id"), F.col("url"), F.col("title"), F.col("language"))


def _number(c: str) -> Column:
    return F.when(~F.trim(c).isin(*NO_VALUE), F.expr(f"try_cast(trim(`{c}`) AS double)"))


def _macro(df: DataFrame) -> DataFrame:
    return _observed(df, F.col("series"), value=_number("value"), unit=F.col("unit"))


def _prices(df: DataFrame) -> DataFrame:
    return _observed(df, F.col("instrument"), value=F.col("close"), unit=F.upper("currency"))


def _crypto(df: DataFrame) -> DataFrame:
    # A market is venue and pair, however the venue writes the pair: btc/usd, BTC_USD, btc-usd.
    pair = F.regexp_replace(F.upper("pair"), r"[/_]", "-")
    return _observed(df, F.concat_ws(":", F.lower("venue"), pair), value=F.col("price"), unit=F.split_part(pair, F.lit("-"), F.lit(2)))


_TEXT = {"url": "string", "language": "string"}
KINDS = {
    "web": Kind({"id": "string", "at": "timestamp", "url": "string", "html": "string"}, _pages),
    "feed": Kind({"id": "string", "at": "timestamp", "text": "string"}, _posts, _TEXT),
    "manual": Kind({"id": "string", "at": "timestamp", "text": "string", "submitted_by": "string"}, _posts, _TEXT),
    "legal": Kind({"id": "string", "at": "timestamp", "text": "string", "register": "string"}, _documents, _TEXT | {"title": "string"}),
    "macro": Kind({"at": "timestamp", "series": "string"}, _macro, {"value": "string", "unit": "string"},
                  lambda: {"not a number": F.trim("value").isin(*NO_VALUE) | F.col("value").isNull() | _number("value").isNotNull()}),
    "prices": Kind({"at": "timestamp", "instrument": "string", "close": "double", "currency": "string"}, _prices, {"high": "double", "low": "double"},
                   lambda: {"price not above zero": F.col("close") > 0, "close outside low and high": F.coalesce(F.col("close").between(F.coalesce("low", "close"), F.coalesce("high", "close")), F.lit(False))}),
    "crypto": Kind({"at": "timestamp", "venue": "string", "pair": "string", "price": "double"}, _crypto, {},
                   lambda: {"price not above zero": F.col("price") > 0, "not a pair": F.col("pair").rlike(r"^[A-Za-z0-9]+[-/_][A-Za-z0-9]+$")}),
}


@dataclass(frozen=True)
class KindAdapter:
    """One source of a kind. ``observed_at`` is the instant of the run: nothing here reads a clock.

    ``wide`` names columns that are series of their own (macro tables with one
    column a series); they become rows. ``overlap`` microseconds before the
    cursor are read again, for rows that come late; what is known goes in the
    identity layers (D1-D3, D7).
    """

    source_id: str
    kind: str
    path: str
    columns: dict[str, str]
    observed_at: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    wide: tuple[str, ...] = ()
    overlap: int = 0

    def _rows(self, spark: SparkSession) -> DataFrame:
        kind = KINDS[self.kind]
        if not exists(spark, self.path):
            raise Unreachable(f"{self.source_id}: nothing at its address")
        try:
            df = spark.read.format(self.format).options(**self.options).load(self.path)
        except (PySparkException, Py4JError) as e:
            raise Unreachable(f"{self.source_id}: {e}") from e
        try:
            if self.wide:
                others = [F.expr(e).alias(n) for n, e in self.columns.items() if n not in ("series", "value")]
                kept = df.select(*others, *[F.col(c).cast("string").alias(c) for c in self.wide])
                rest = [c for c in kept.columns if c not in self.wide]
                df = kept.unpivot(rest, list(self.wide), "series", "value")
                given = {c: f"`{c}`" for c in df.columns}
                if "series" in self.columns:
                    given["series"] = self.columns["series"]
            else:
                given = self.columns
            names = kind.needs | kind.optional
            lacking = sorted(set(kind.needs) - set(given))
            if lacking:
                raise SchemaChanged(f"{self.source_id}: nothing mapped to {', '.join(lacking)}")
            df = df.select(*[(F.expr(given[n]) if n in given else F.lit(None)).try_cast(t).alias(n) for n, t in names.items()])
            df.schema  # noqa: B018 - resolves the names now
        except AnalysisException as e:
            raise SchemaChanged(f"{self.source_id}: {e}") from e
        return df.withColumn("reason", self._reason(kind))

    def _after(self, cursor: str | None) -> Column:
        return F.lit(True) if cursor is None else F.col("at") > F.lit(cursor).cast("timestamp") - F.make_dt_interval(secs=F.lit(self.overlap / 1e6))

    @staticmethod
    def _reason(kind: Kind) -> Column:
        checks = {f"no {n}": F.col(n).isNotNull() for n in kind.needs} | kind.checks()
        return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in checks.items()])

    def fetch(self, spark: SparkSession, cursor: str | None) -> tuple[DataFrame, str | None]:
        """Items after the cursor, and the next cursor (the latest time among them)."""
        rows = self._rows(spark).filter(self._after(cursor)).filter("reason IS NULL")
        try:
            last = rows.agg(F.max("at").cast("string")).first()[0]
        except (PySparkException, Py4JError) as e:
            raise Unreachable(f"{self.source_id}: {e}") from e
        made = KINDS[self.kind].items(rows)
        seen = F.lit(self.observed_at).cast("timestamp")
        out = made.withColumns({
            "source_id": F.lit(self.source_id), "canonical_url": canonical_url(F.col("url")), "content_hash": content_hash(F.col("raw_text")),
            "observed_at": seen, "ingested_at": seen, "parse_version": F.lit(PARSE_VERSION),
        })
        # The same content under the same external id is the same item, whenever it is read.
        out = out.withColumn("id", F.sha2(F.concat_ws("\x1f", "source_id", "external_id", "content_hash"), 256))
        return conform(out, "raw_item"), last if last is not None else cursor

    def rejected(self, spark: SparkSession, cursor: str | None) -> DataFrame:
        """Rows after the cursor that are no items, with a reason. A row without a time is among them every time."""
        return self._rows(spark).filter(self._after(cursor) | F.col("at").isNull()).filter("reason IS NOT NULL")


def observations(items: DataFrame) -> DataFrame:
    """The numbers in items of series and markets: source, series, time, value (null if the provider had none), unit."""
    body = F.from_json("raw_text", "series string, value double, unit string")
    return items.select("source_id", F.col("published_at").alias("at"), body.alias("o")).filter("o.series IS NOT NULL").select("source_id", "o.series", "at", "o.value", "o.unit")


def together(fetched: list[DataFrame]) -> DataFrame:
    """Items of several sources as one table."""
    return reduce(DataFrame.unionByName, fetched)
