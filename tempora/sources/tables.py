"""Schemas, readers and append-only sinks (S1-S10). No schema is inferred; nothing is overwritten."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(text: str, tiers: str = "") -> T.StructType:
    """``name type`` pairs, a ? for nullable; every field gets the tier of ``tiers`` or L1."""
    given = dict(p.split("=") for p in tiers.split())
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        nullable = kind.endswith("?")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], nullable, {"tier": given.get(name, "L1")}))
    return T.StructType(fields)


#: The entities and their fields.
SCHEMAS = {
    "source": _schema("id string, reliability string, latency_class string, interval_minutes int, enabled boolean"),
    "raw_item": _schema("id string, source_id string, external_id string?, canonical_url string?, published_at timestamp, observed_at timestamp, ingested_at timestamp, title string?, raw_text string, content_hash string, language string?, parse_version string", "raw_text=L0 title=L0"),
    "evidence": _schema("id string, raw_item_id string, proposition string, evidence_type string, entities array<string>, effective_at timestamp, expires_at timestamp?, source_reliability string, extraction_confidence double, verification_status string"),
    "event": _schema("id string, event_type string, occurred_at timestamp, first_reported_at timestamp, last_updated_at timestamp, geography array<string>, entities array<string>, credibility_score double?, novelty_score double?, urgency_score double?, status string, dedupe_key string"),
    "event_merge_proposal": _schema("id string, run_id string, source_event_id string, target_event_id string, method string, score double, model_version string?, threshold_applied double, decision string, decided_at timestamp, decided_by string"),
    "narrative": _schema("id string, slug string, status string, direction string, strength double, confidence double, first_seen_at timestamp, last_confirmed_at timestamp"),
    "world_state_dimension": _schema("snapshot_id string, dimension_key string, score double?, direction string, confidence double?, evidence_count bigint"),
    "world_state_delta": _schema("from_snapshot_id string?, to_snapshot_id string, dimension_key string, old_score double?, new_score double, materiality double, evidence_ids array<string>"),
    "account": _schema("id string, owner_id string, account_type string, institution string, jurisdiction string, base_currency string", "institution=L3 owner_id=L2"),
    "position": _schema("id string, account_id string, instrument_id string, quantity double, market_value_base double?, currency string, observed_at timestamp", "quantity=L3 market_value_base=L3"),
    "policy": _schema("id string, owner_id string, name string, metric string, operator string, threshold double, margin double, severity string, enabled boolean", "owner_id=L2"),
    "scenario": _schema("id string, set_id string, slug string, horizon string, probability double?, status string, created_at timestamp"),
    "decision": _schema("id string, owner_id string, decision_type string, created_at timestamp, valid_until timestamp?, status string, rationale string", "owner_id=L2 rationale=L2"),
    "outcome": _schema("id string, decision_id string, evaluated_at timestamp, outcome_type string, forecast_score double?"),
    "job_run": _schema("run_id string, as_of string, stage string, status string, rows bigint?, missing bigint?, seconds double?, error string?"),
    "run_record": _schema(
        "run_id string, as_of string, stages_ok bigint, stages_failed bigint, sources_ok bigint, sources_failed bigint, "
        "model_calls bigint, cost double, seconds double?, missing bigint, status string"
    ),
    # What models propose (extraction, classification, entity resolution) is an input, never state.
    "model_proposal": _schema("id string, run_id string, kind string, subject string, proposed string, confidence double, model_version string, created_at timestamp"),
    # Qualitative material only; never an authority for a quantity, status, probability, threshold or date.
    "memory": _schema("id string, topic string, kind string, text string, created_at timestamp", "text=L2"),
}

_RUN = uuid.uuid4().hex
_scratch: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where none is set, a temporary folder serves a local master (tests); on a
    cluster that is an error, as every executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[0-9*, ]+\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="tempora-"))
    return f"file://{_scratch[0]}"


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle on disk; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, given)


def save(df: DataFrame, name: str = "round") -> DataFrame:
    """Write to the shared folder and reread: cuts the lineage of a plan."""
    path = f"{shared_folder(df.sparkSession)}/tempora-{_RUN}/{name}-{uuid.uuid4().hex}"
    with _freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables that a job appends to; ``clean_up`` removes it."""
    return f"{shared_folder(spark)}/tempora-{_RUN}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``own_folder`` gave. Results that read it must have been written or read before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Remove what this application has saved. Results that read it must have been written or read before."""
    remove(spark, f"{shared_folder(spark)}/tempora-{_RUN}")


def conform(df: DataFrame, entity: str) -> DataFrame:
    """The columns of an entity in their order and types; other columns go, a lacking one is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in SCHEMAS[entity].fields])


def create_all(spark: SparkSession, root: str, names: Sequence[str] = tuple(SCHEMAS)) -> list[str]:
    """Every table, or those named, from nothing (S8): empty, with its schema."""
    for name in names:
        spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{root}/{name}/run_id=none")
    return sorted(names)


def append(df: DataFrame, root: str, entity: str, run_id: str) -> None:
    """Append a run's rows (S6, S7). The run is a partition, so later reads can prune, and writing it twice is an error.

    A write that died half-way left no mark of success; a retry replaces what it left.
    """
    target = f"{root}/{entity}/run_id={run_id}"
    if exists(df.sparkSession, f"{target}/_SUCCESS"):
        raise FileExistsError(f"run {run_id} of {entity} already exists")
    with _freeing(df.sparkSession):
        conform(df, entity).write.mode("overwrite").parquet(target)


def read(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """All runs of an entity, with their run_id."""
    schema = T.StructType([*SCHEMAS[entity].fields, T.StructField("run_id", T.StringType())])
    return spark.read.schema(schema).parquet(f"{root}/{entity}")


class SourceAdapter(Protocol):
    """A source (S1, S3): what is special about it stays inside; rows come in the canonical schema."""

    source_id: str

    def fetch(self, spark: SparkSession, cursor: str | None) -> tuple[DataFrame, str]:
        """Rows after the cursor, and the next cursor. Raises ProviderError."""


class ProviderError(Exception):
    """A provider failed; no value is put in its place."""


class FileAdapter:
    """Rows of a file or folder after a cursor in one of its columns (S2): parquet, json, csv or orc."""

    def __init__(self, source_id: str, path: str, schema: T.StructType, cursor_col: str, kind: str = "parquet"):
        self.source_id, self.path, self.schema, self.cursor_col, self.kind = source_id, path, schema, cursor_col, kind

    def fetch(self, spark: SparkSession, cursor: str | None) -> tuple[DataFrame, str]:
        try:
            df = spark.read.schema(self.schema).format(self.kind).load(self.path)
            if cursor is not None:
                df = df.filter(F.col(self.cursor_col) > F.lit(cursor).cast(self.schema[self.cursor_col].dataType))
            last = df.agg(F.max(self.cursor_col).cast("string")).first()[0]
        except Exception as e:
            raise ProviderError(f"{self.source_id}: {e}") from e
        return df, last if last is not None else cursor


def ingest(spark: SparkSession, adapters: Sequence[SourceAdapter], cursors: dict[str, str]) -> tuple[DataFrame | None, dict[str, str], list[tuple[str, str, str | None]]]:
    """What the sources that answered have (S5), the new cursors, and a status of each source. A failure moves no cursor."""
    out, moved, status = None, dict(cursors), []
    for a in adapters:
        try:
            df, cursor = a.fetch(spark, cursors.get(a.source_id))
        except ProviderError as e:
            status.append((a.source_id, "failed", str(e)[:200]))
            continue
        df = df.withColumn("source_id", F.lit(a.source_id))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        moved[a.source_id] = cursor
        status.append((a.source_id, "ok", None))
    return out, moved, status


def confirmed_update(current: DataFrame, proposal: dict, key: str, check: Callable[[dict], str | None]) -> tuple[DataFrame, dict]:
    """A human-confirmed change (S9): the row to append and its audit record. Refused without a confirmer or if the check objects."""
    if not proposal.get("confirmed_by"):
        raise PermissionError("an update needs someone who confirms it")
    if problem := check(proposal):
        raise ValueError(problem)
    found = current.filter(F.col(key) == proposal[key]).orderBy(F.desc("valid_from")).select("value").first()
    row = current.sparkSession.createDataFrame([(proposal[key], proposal["value"], proposal["valid_from"])], current.select(key, "value", "valid_from").schema)
    audit = {"key": proposal[key], "proposed_by": proposal.get("proposed_by"), "confirmed_by": proposal["confirmed_by"], "previous_value": found[0] if found else None, "new_value": proposal["value"]}
    return row, audit
