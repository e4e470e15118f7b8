"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight, with u hashed from the key and
the child's name, and the least draw wins; so children get keys in proportion to their weights, and a change of one
weight moves keys only between that child and its siblings, at its own level and along its path. All expressions are
built in; the tree is a constant of the plan, and a key costs one draw for each child of the nodes on its path.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

#: The cluster of op10: regions x racks x shards, and rows of one slot bucket.
REGIONS, RACKS, SHARDS_PER_RACK = 2, 3, 4
ROWS_PER_BUCKET = 20_000


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight; an inner node has children and weighs what they weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def cluster(shards: int, base: tuple[int, int, int] = (REGIONS, RACKS, SHARDS_PER_RACK)) -> Node:
    """A root over `shards` equal shards: full base regions, then a region of its own for every further shard.

    A shard that is added opens a region, so it takes keys into itself only and no subtree that was there is dealt
    anew. Fewer shards than the base holds leave the last racks short.
    """
    regions, racks, per_rack = base
    capacity, found = regions * racks * per_rack, []
    for r in range(regions):
        inner = []
        for k in range(racks):
            first = (r * racks + k) * per_rack
            leaves = tuple(Node(f"shard{n}", shard=n) for n in range(first, min(first + per_rack, shards)))
            if leaves:
                inner.append(Node(f"rack{r}.{k}", leaves))
        if inner:
            found.append(Node(f"region{r}", tuple(inner)))
    for n in range(capacity, shards):
        found.append(Node(f"region+{n}", (Node(f"rack+{n}", (Node(f"shard{n}", shard=n),)),)))
    if not found:
        raise ValueError("a cluster needs a shard")
    return Node("root", tuple(found))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from 53 hashed bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard that a key reaches from a node; equal draws go to the first child."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return descend(key, live[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("at")) for i, c in enumerate(live)])
    choice = F.array_min(draws)["at"]
    out = reduce(lambda w, ic: w.when(choice == ic[0], descend(key, ic[1])), list(enumerate(live))[1:-1], F.when(choice == 0, descend(key, live[0])))
    return out.otherwise(descend(key, live[-1]))


def with_slots(rows: DataFrame, shard: str, order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """A column slot: 0, 1, 2... in each shard, without bringing a shard into one task.

    Rows of a shard are spread over hashed buckets; each bucket is numbered by itself and starts after the buckets
    before it. Buckets grow in number with the rows. Repeated rows get different slots; each row is written with its
    place, which is hashed too, so that they spread like others.
    """
    rows = written(rows.withColumn("__place", F.monotonically_increasing_id()), "shards")
    order = [*order, "__place"]
    total = rows.count()
    buckets = max(1, -(-total // rows_per_bucket))
    spread = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(_w(shard).orderBy("__bucket")) - F.col("__n")
    starts = sizes.select(shard, "__bucket", before.alias("__start"))
    numbered = spread.withColumn("__at", F.row_number().over(_w(shard, "__bucket").orderBy(*order)) - 1)
    return numbered.join(starts, [shard, "__bucket"]).withColumn("slot", (F.col("__start") + F.col("__at")).cast("long")).drop("__bucket", "__start", "__at", "__place")


def _w(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tree: Node | None = None, grown: Node | None = None) -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard in `grown`).

    law is `key`: the doc_id and the tree decide. Null texts have size 8 and the CRC of no bytes, 0; a null doc_id is
    hashed like a key of its own; repeated rows share a shard and get different slots; an empty table gives an empty
    table; extra columns are ignored. Equal texts need not share a shard.
    """
    tree, grown = tree or cluster(shards), grown or cluster(shards + 1)
    text = text_of(docs, text_col)
    key = docs[id_col].cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(F.coalesce(key.cast("string"), F.lit("")), tree).cast("int").alias("shard"),
        descend(F.coalesce(key.cast("string"), F.lit("")), grown).cast("int").alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), REGIONS * RACKS * SHARDS_PER_RACK).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
