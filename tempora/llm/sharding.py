"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` from a hash of the row's key and the child's name, and the
smallest draw wins (a weighted rendezvous draw). The draw of a child does not
depend on its siblings, so a changed weight moves rows only into or out of the
subtree whose weight changed. A new shard is hung in as a region of its own:
all old weights stay, so it takes rows only into itself.

Slots number the rows of a shard from 0 without gaps in the order of key,
checksum and size. They come from a range sort that every executor takes part
in: each sorted partition counts its rows of a shard, the running sums of those
counts are its offsets, and a window inside the partition does the rest.

Defined cases: a null key is hashed as the empty string and sorts first; a null
text has size 1 and checksum 0; equal rows get neighbouring slots in any order;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm._common import col, materialize


@dataclass(frozen=True)
class Node:
    """A subtree. A leaf has a shard number; an inner node weighs what its children weigh."""

    name: str
    own_weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def uniform_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Node:
    """regions x racks x shards leaves of weight 1, numbered from 0."""
    made, n = [], 0
    for r in range(regions):
        rack_nodes = []
        for k in range(racks):
            leaves = tuple(Node(f"r{r}/k{k}/s{n + i}", shard=n + i) for i in range(shards))
            n += shards
            rack_nodes.append(Node(f"r{r}/k{k}", children=leaves))
        made.append(Node(f"r{r}", children=tuple(rack_nodes)))
    return Node("root", children=tuple(made))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own."""
    leaf = Node(f"g{shard}/k0/s{shard}", own_weight=weight, shard=shard)
    return Node(tree.name, children=(*tree.children, Node(f"g{shard}", children=(Node(f"g{shard}/k0", children=(leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node.name))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + F.lit(1.0)) / F.lit(float(2**48 + 1))) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard of ``key``, as one expression."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
    return _choose(F.least(*draws)["i"], [descend(key, c) for c in node.children])


def _choose(index: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i in range(len(values) - 2, -1, -1):
        out = F.when(index == i, values[i]).otherwise(out)
    return out


def assign_shards(docs: DataFrame, tree: Node, grown_tree: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot for every row."""
    text = F.coalesce(col(text_col), F.lit(""))
    key = F.coalesce(col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        descend(key, tree).cast("int").alias("shard"),
        descend(key, grown_tree).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["shard", "doc_id", "text_crc32", "size", "tie"]
    rows = materialize(rows, "shard-rows")
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-sorted")
    counts = dealt.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "shard").orderBy("doc_id", "text_crc32", "size", "tie")
    return (
        dealt.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["part", "shard"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
