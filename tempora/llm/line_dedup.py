"""Line deduplication by content-defined line chunks, in DataFrame expressions only.

Every line of a text is hashed. A buzhash rolls over the hashes of the last
``roll`` lines, and a chunk ends after a line where it is divisible by
``divisor`` (or after the last line). The choice depends on nearby lines only,
so an inserted or lost line shifts no boundary further on. With ``least``, a
chunk does not end before it holds that many lines that are not blank, and a
shorter last chunk joins its predecessor: a copy of a whole text of two lines or
more is then made of searchable chunks only. With a least size of two, boundaries
agree again after the next line that is no candidate. A chunk of two or
more lines that are not blank, found more than once in all documents, is kept
in the document of the smallest id that holds it, at its first place there, and
removed everywhere else.

Chunks are grouped by their own bytes, so two chunks are never taken for each
other because their hashes agree. On the way back to the documents a chunk is
named by two hashes; for the names that stand for two different chunks in the
whole corpus the bytes travel along and are compared again. Work in one text is
linear in its lines (sorting apart).

Defined cases: a null text stays null and an empty one stays empty; a chunk
whose holders all have a null id is kept in each of them at its first place, and
so it is in rows that share the smallest id (rows that repeat an id are one
document); a text that loses all its chunks becomes empty; other columns pass
through whatever they are named (one named like the count is replaced by it); an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize, row_key


def _rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _cuts(least: int) -> str:
    """A chunk of ``least`` or more lines that are not blank, where each line is a letter: 1 or 0, blank b or a, with 1 and b candidates for an end."""
    return rf"(?:[ab]*+[01]){{{least - 1}}}[ab]*+(?:1|0[a0]*+[1b])(?:[ab]*+(?:[01][ab]*+){{0,{least - 1}}}$)?|.+"


def _bound(value: Column, use) -> Column:
    """``use(value)``. An array of one element binds the value, which a lambda would else work out again for every line."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(text: Column, roll: int = 2, divisor: int = 2, least: int = 0) -> Column:
    """The chunks of a text, in order: an array of arrays of lines."""

    def rolled(hashes: Column, i: Column) -> Column:
        out = F.get(hashes, i)
        for k in range(1, roll):
            out = out.bitwiseXOR(F.coalesce(_rotate(F.get(hashes, i - k), k), F.lit(0).cast("long")))
        return out

    def ends(lines: Column, hashes: Column) -> Column:
        last = F.size(hashes) - 1
        candidate = lambda i: F.pmod(rolled(hashes, i), F.lit(divisor)) == 0
        if not least:
            return F.filter(F.sequence(F.lit(0), last), lambda i: candidate(i) | (i == last))
        letters = F.transform(lines, lambda x, i: F.when(_is_blank(x), F.when(candidate(i), "b").otherwise("a")).otherwise(F.when(candidate(i), "1").otherwise("0")))
        marked = F.split(F.regexp_replace(F.array_join(letters, ""), _cuts(least), "$0|"), "")
        # The k-th mark stands behind k marks and all lines up to its chunk's end.
        return _bound(marked, lambda m: F.transform(F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i) == "|"), lambda at, k: at - k - 1))

    def cut(lines: Column, e: Column) -> Column:
        return F.transform(e, lambda end, k: F.slice(lines, F.coalesce(F.get(e, k - 1), F.lit(-1)) + 2, end - F.coalesce(F.get(e, k - 1), F.lit(-1))))

    return _bound(F.split(text, "\n", -1), lambda lines: _bound(F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: _bound(ends(lines, hashes), lambda e: cut(lines, e))))


def _is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def _is_long(chunk: Column) -> Column:
    return F.size(F.filter(chunk, lambda x: ~_is_blank(x))) >= 2


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", roll: int = 2, divisor: int = 2, least: int = 0) -> DataFrame:
    """(h1, h2, bytes, owner, places) of every chunk to remove; ``bytes`` only where the name is ambiguous."""
    listed = docs.select(col(id_col).alias("id"), F.explode(F.filter(chunks(col(text_col), roll, divisor, least), _is_long)).alias("c")).select("id", F.array_join("c", "\n").alias("chunk"))
    exact = listed.groupBy("chunk").agg(F.count(F.lit(1)).alias("places"), F.min("id").alias("owner"))
    named = materialize(exact.select(*_name(F.col("chunk")), "places", "owner", F.when(F.col("places") > 1, F.col("chunk")).alias("bytes")), "line-chunks")
    found = named.filter("places > 1")
    # Names that stand for more than one chunk, unique chunks included.
    alike = named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("places").alias("most")).filter("n > 1 AND most > 1").select("h1", "h2", F.lit(True).alias("ambiguous"))
    return found.join(alike, ["h1", "h2"], "left").select("h1", "h2", F.when(F.col("ambiguous"), F.col("bytes")).alias("bytes"), "owner", "places")


def _name(chunk: Column) -> list[Column]:
    return [F.xxhash64(chunk).alias("h1"), F.xxhash64(F.lit("second"), chunk).alias("h2")]


def _marked(cut: Column) -> Column:
    """(h1, h2, k, first) of the long chunks: name, place, and whether it is the first place of that name."""
    named = F.filter(F.transform(cut, lambda c, k: F.when(_is_long(c), F.struct(*_name(F.array_join(c, "\n")), k.alias("k")))), lambda c: c.isNotNull())

    def flagged(ordered: Column) -> Column:
        def new(c: Column, i: Column) -> Column:
            back = F.get(ordered, i - 1)
            return F.coalesce((back["h1"] != c["h1"]) | (back["h2"] != c["h2"]), F.lit(True))

        return F.transform(ordered, lambda c, i: F.struct(c["h1"].alias("h1"), c["h2"].alias("h2"), c["k"].alias("k"), new(c, i).alias("first")))

    return _bound(F.array_sort(named), flagged)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", roll: int = 2, divisor: int = 2, removed_col: str = "n_removed_chunks", least: int = 0) -> DataFrame:
    """``docs`` with shortened texts, and the number of chunks each lost in ``removed_col``, which replaces a column of that name."""
    found = materialize(repeated_chunks(docs, id_col, text_col, roll, divisor, least), "line-repeated")
    listed = docs.select(row_key(id_col, text_col).alias("rk"), col(id_col).alias("id"), F.explode(_marked(chunks(col(text_col), roll, divisor, least))).alias("c"))
    hits = listed.select("rk", "id", "c.*").join(found, ["h1", "h2"])
    own, sure = F.col("id").eqNullSafe(F.col("owner")), F.col("bytes").isNull()
    gathered = hits.filter(~(sure & own & F.col("first"))).groupBy("rk").agg(
        F.collect_set(F.when(sure, F.col("k"))).alias("gone"),
        F.collect_set(F.when(~sure, F.struct("k", "bytes", own.alias("own")))).alias("unsure"),
    )
    gathered = materialize(gathered, "line-hits")
    kept = [c for c in docs.columns if c.lower() != removed_col.lower()]
    marked = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("rk"))
    text = F.col("row").getField(text_col)
    joined = marked.join(gathered.hint("merge"), "rk", "left")  # the same way at every size
    cut = joined.select("row", "gone", "unsure", F.when(F.col("gone").isNotNull(), F.transform(chunks(text, roll, divisor, least), lambda c: F.array_join(c, "\n"))).alias("cut"))
    all_gone = F.concat("gone", _found_out(F.col("cut"), F.col("unsure")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), all_gone)
    decided = cut.select("row", "cut", F.when(F.col("cut").isNotNull(), stay).alias("stay"))
    new = F.when(F.col("stay").isNotNull(), F.array_join(_bound(F.col("cut"), lambda c: F.transform("stay", lambda k: F.get(c, k))), "\n")).otherwise(text)
    removed = F.coalesce(F.size("cut") - F.size("stay"), F.lit(0)).alias(removed_col)
    return decided.select(*[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in kept], removed)


def _found_out(cut: Column, unsure: Column) -> Column:
    """Places to remove among chunks whose name stands for different chunks, by their bytes; there are hardly ever any."""
    alike = F.filter(unsure, lambda u: F.get(cut, u["k"]) == u["bytes"])
    later = lambda u: F.exists(alike, lambda v: (v["k"] < u["k"]) & (v["bytes"] == u["bytes"]))
    return F.transform(F.filter(alike, lambda u: ~u["own"] | later(u)), lambda u: u["k"])
