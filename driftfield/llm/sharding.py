"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted draws."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slots

#: Hexadecimal digits of an MD5 digest that make one draw; 52 bits fit a double exactly.
DIGITS = 13


@dataclass(frozen=True)
class Node:
    """A shard (no children) or a region or rack, whose weight is its children's sum."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def layout(n_shards: int, base: int = 40, shards_per_rack: int = 4, racks_per_region: int = 2) -> Node:
    """The first `base` shards fill regions of racks; each later shard is a region of its own.

    So growing by one shard adds one subtree and changes no weight but that subtree's:
    rows move only into the new shard. Shard counts below `base` are a layout of their own.
    """
    def leaf(s: int) -> Node:
        return Node(f"shard{s}", 1.0, (), s)

    regions, per_region = [], shards_per_rack * racks_per_region
    planned = min(n_shards, base)
    for r, first in enumerate(range(0, planned, per_region)):
        mine = range(first, min(first + per_region, planned))
        racks = [Node(f"region{r}/rack{k}", 0, tuple(leaf(s) for s in mine[i : i + shards_per_rack])) for k, i in enumerate(range(0, len(mine), shards_per_rack))]
        regions.append(Node(f"region{r}", 0, tuple(racks)))
    for s in range(planned, n_shards):
        regions.append(Node(f"added{s}", 0, (Node(f"added{s}/rack", 0, (leaf(s),)),)))
    return Node("root", 0, tuple(regions))


def draw(node: Node, key: Column) -> Column:
    """An exponential race: the earliest arrival wins, each child with its share of the weight.

    The draw depends on the child's name, weight and the key alone, so a child whose
    weight grows only gains rows, and one that shrinks only loses rows, among siblings.
    """
    digest = F.md5(F.concat(F.lit(f"{node.name}|"), key))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return -F.log(u) / F.lit(float(node.total))


def level(df: DataFrame, nodes: list[Node], at: str, key: Column, out: str) -> DataFrame:
    """One level of the descent for rows that stand at `nodes[at]`: out is the child's place
    among all children of all nodes, in order. Only the children of the row's own node draw."""
    chosen, offset = F.lit(None).cast("int"), 0
    for i, node in enumerate(nodes):
        live = [(offset + j, c) for j, c in enumerate(node.children) if c.total > 0]
        offset += len(node.children)
        if not live:
            continue
        if len(live) == 1:
            pick = F.lit(live[0][0])
        else:
            pick = F.array_min(F.array(*[F.struct(draw(c, key).alias("at"), F.lit(j).alias("child")) for j, c in live]))["child"]
        chosen = F.when(F.col(at) == i, pick).otherwise(chosen)
    return df.withColumn(out, chosen)


def assign(df: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """Adds the shard of each row: region, rack and shard level in turn, in one projection.

    A null key hashes as the text "null". Equal keys always meet.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    levels = [[tree]]
    while levels[-1][0].children:
        levels.append([c for n in levels[-1] for c in n.children])
    names = ["_at0"] + [f"_at{i}" for i in range(1, len(levels))]
    df = df.withColumn(names[0], F.lit(0))
    for i in range(1, len(levels)):
        df = level(df, levels[i - 1], names[i - 1], k, names[i])
    shard_of = F.array(*[F.lit(n.shard) for n in levels[-1]])
    return df.withColumn(out, F.element_at(shard_of, F.col(names[-1]) + 1)).drop(*names)


def shard_documents(docs: DataFrame, n_shards: int = 40, base: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its shard under n_shards and n_shards + 1, and a slot in its shard.

    Null text: size 16 and the CRC of no bytes (0). Null ids are one key. Repeated rows
    all get rows, of distinct slots; further columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = assign(rows, "doc_id", layout(n_shards, base), "shard")
    rows = assign(rows, "doc_id", layout(n_shards + 1, base), "grown_shard")
    return slots(rows.withColumn("law", F.lit("key")), "shard", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
