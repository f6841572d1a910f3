"""Read surfaces (S10): SQL table functions that take an instant and answer with the rows they rest on.

``SELECT * FROM balances_at(TIMESTAMP'2024-01-20') WHERE owner = 7`` reads as
of that instant and cannot write. Spark puts the body of the function into the
caller's plan, so the instant and the caller's filters on keys reach the scan;
``LATERAL`` asks for many instants at once. Every answer has ``provenance_ids``,
the ids of the rows that it rests on, and ``known_since``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Surface:
    """A temporal table as its readers see it: keys, fields, time, id, and what breaks ties of time beside the id."""

    name: str
    keys: Sequence[str]
    fields: Sequence[str]
    time: str
    id: str
    ties: Sequence[str] = ()

    def register(self, spark: SparkSession, table: DataFrame) -> list[str]:
        """Make ``<name>_at(as_of)``, ``<name>_changes(since, until)`` and ``<name>_why(as_of, since)``; their names."""
        for n in (self.name, *self.keys, *self.fields, self.time, self.id, *self.ties):
            if not _NAME.fullmatch(n):
                raise ValueError(f"{n!r} is no plain name")
        view = f"{self.name}_rows"
        table.createOrReplaceTempView(view)
        schema = table.schema
        for sql in (self._at(schema, view), self._changes(schema, view), self._why(schema, view)):
            spark.sql(sql)
        return [f"{self.name}_{w}" for w in ("at", "changes", "why")]

    def _types(self, schema: T.StructType, *names: str) -> list[str]:
        return [f"`{n}` {schema[n].dataType.simpleString()}" for n in names]

    def _order(self) -> str:
        return "struct(" + ", ".join(f"`{c}`" for c in dict.fromkeys((self.time, *self.ties, self.id))) + ")"

    def _last(self, where: str = "") -> str:
        kept = ", ".join(f"`{c}`" for c in dict.fromkeys((*self.fields, self.time, self.id)))
        return f"max_by(struct({kept}), {self._order()}){where}"

    def _at(self, schema: T.StructType, view: str) -> str:
        keys, name = ", ".join(f"`{k}`" for k in self.keys), f"{self.name}_at"
        out = [*self._types(schema, *self.keys, *self.fields), f"known_since {schema[self.time].dataType.simpleString()}", f"provenance_ids array<{schema[self.id].dataType.simpleString()}>"]
        return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(as_of TIMESTAMP) RETURNS TABLE ({', '.join(out)})
            RETURN SELECT {keys}, {', '.join(f'l.`{f}`' for f in self.fields)}, l.`{self.time}`, array(l.`{self.id}`)
            FROM (SELECT {keys}, {self._last()} AS l FROM {view} WHERE `{self.time}` <= {name}.as_of GROUP BY {keys})"""

    def _changes(self, schema: T.StructType, view: str) -> str:
        """One scan for both instants. A key that was not known before has nulls before; one whose fields are equal is not in it."""
        keys, name = ", ".join(f"`{k}`" for k in self.keys), f"{self.name}_changes"
        id_type = schema[self.id].dataType.simpleString()
        out = self._types(schema, *self.keys)
        for f in self.fields:
            kind = schema[f].dataType.simpleString()
            out += [f"`old_{f}` {kind}", f"`new_{f}` {kind}"]
        out += ["appeared boolean", f"known_since {schema[self.time].dataType.simpleString()}", f"provenance_ids array<{id_type}>"]
        shown = ", ".join(f"o.`{f}`, n.`{f}`" for f in self.fields)
        same = " AND ".join(f"o.`{f}` <=> n.`{f}`" for f in self.fields)
        return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(since TIMESTAMP, until TIMESTAMP) RETURNS TABLE ({', '.join(out)})
            RETURN SELECT {keys}, {shown}, o IS NULL, n.`{self.time}`, filter(array(o.`{self.id}`, n.`{self.id}`), x -> x IS NOT NULL)
            FROM (SELECT {keys}, {self._last(' FILTER (WHERE before)')} AS o, {self._last()} AS n
                FROM (SELECT *, `{self.time}` <= {name}.since AS before FROM {view} WHERE `{self.time}` <= {name}.until) GROUP BY {keys})
            WHERE o IS NULL OR NOT ({same})"""

    def _why(self, schema: T.StructType, view: str) -> str:
        """The rows known at the instant and not before ``since``: what an answer of a key could rest on. No sort, no limit."""
        cols, name = list(dict.fromkeys((*self.keys, *self.fields, self.time, self.id))), f"{self.name}_why"
        return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(as_of TIMESTAMP, since TIMESTAMP) RETURNS TABLE ({', '.join(self._types(schema, *cols))})
            RETURN SELECT {', '.join(f'`{c}`' for c in cols)} FROM {view} WHERE `{self.time}` <= {name}.as_of AND `{self.time}` >= {name}.since"""
