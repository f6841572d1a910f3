"""Filter interaction audit: what each filter removes in every order of application.

A document's failures are one bit mask. Documents are counted by *cell*: part,
mask and the two label flags, of which there are at most 128 for a part, so all
that follows works on counts. Every cell is unpivoted against the steps of every
order; a running bit-or over the steps before shows whether the cell had been
removed earlier, and conditional sums over the cells give the metrics of a step.
A filter's Shapley share is the total of its removals over all orders.

The last filter, ``E``, fails a document whose text another document of a smaller
id has. Copies meet as counts: rows of one digest, part, mask and labels are
added up before the shuffle, so a text that a third of all rows share arrives as
one row for each task.

Defined cases: a null text is an empty one, a null part the empty string; ids
that are null are neither smaller nor larger than others, so they never fail
``E`` and fail nobody; rows that repeat an id are rows of their own, and of equal
texts under the smallest id none fails ``E``; labels that repeat an id count as
good (toxic) if one of them says so; documents without labels are neither; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm._common import SPACE, col

#: The letter of the filter on copies; it comes after those that look at a text alone.
COPIES = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """True where a text fails: few words, few different words, many capitals, symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(65).cast("long"),
        "C": capitals * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the text's own failures (bit k: the k-th filter), of every row."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(text_filters(text).values())]
    part = F.coalesce(col(part_col).cast("string"), F.lit(""))
    mask = sum(bits[1:], bits[0])
    return docs.select(col(id_col).alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, good and toxic: one row for each id."""
    one = lambda c: F.max(F.coalesce(col(c) == 1, F.lit(False)))
    return labels.groupBy(col(id_col).alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (copies included), good, toxic, n: the documents of each cell."""
    own = failures(docs, id_col, text_col, part_col)
    # Rows without an id have no labels; they are dealt out by their text, not as one null key.
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.hex("digest")))
    known = flags(labels, id_col).filter("doc_id IS NOT NULL").select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("key"), "good", "toxic")
    told = own.withColumn("key", key).join(known, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["part", "mask", "good", "toxic"]
    # A digest's rows of one kind: all of them, those without an id, the smallest id and how many rows have it.
    by_id = told.groupBy("digest", *kinds, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    same = by_id.groupBy("digest", *kinds).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low")
    )
    first = F.min("low").over(Window.partitionBy("digest"))
    stays = F.col("unnamed") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0)
    copy_bit = 1 << len(text_filters(F.lit("")))
    both = F.array(F.struct("mask", F.col("stays").alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))
    split = same.withColumn("stays", stays).select("part", "good", "toxic", F.explode(both).alias("cell"))
    return split.select("part", "cell.mask", "good", "toxic", "cell.n").filter("n > 0").groupBy(*kinds).agg(F.sum("n").alias("n"))


def evaluate(counted: DataFrame, filters: str = "ABCD" + COPIES) -> DataFrame:
    """The metrics of every part, order and step from the cells; bit k of a mask is the k-th letter of ``filters``."""
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(filters))), " ")
    steps = counted.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "(?!^)(?!$)")).alias("at", "filter"))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), F.col("filter"))
    failing = steps.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    cell = ["part", "mask", "good", "toxic", "filter_order"]
    before = Window.partitionBy(*cell).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = failing.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0
    count = lambda held: F.sum(F.when(held, F.col("n")).otherwise(0))
    step = seen.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "filter").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"),
        count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, filter and the metrics: 600 rows for every part."""
    return evaluate(cells(docs, labels, id_col, text_col, part_col))
