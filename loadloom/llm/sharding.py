"""Sharding over a tree of regions, racks and shards by weighted hash draws, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import text_of


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, base: int = 24, racks: int = 3, per_rack: int = 4) -> list[Leaf]:
    """The first ``base`` shards fill racks of ``per_rack`` and regions of ``racks``; each later one opens a region.

    A shard that hangs in a region of its own changes only its own subtree's weight, so
    adding it moves rows into it and nowhere else.
    """
    full = racks * per_rack
    return [Leaf(s // full, s // per_rack % racks, s) if s < base else Leaf(-(-base // full) + s - base, 0, s) for s in range(shards)]


def _children(tree: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """Per level, the weights of every node's children: regions of the root, racks of a region, shards of a rack."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for x in tree:
        if x.weight > 0:
            path = ["", f"r{x.region}", f"r{x.region}.{x.rack}", str(x.shard)]
            for level, (parent, child) in zip(levels, zip(path, path[1:])):
                options = level.setdefault(parent, {})
                options[child] = options.get(child, 0.0) + x.weight
    if not levels[0]:
        raise ValueError("the tree has no shard with a weight")
    return levels


def _draw(key: str, parent: Column, level: dict[str, dict[str, float]]) -> Column:
    """The child of ``parent`` with the smallest exponential draw; its chance is its share of the weights."""
    table = F.create_map(*(c for name, options in sorted(level.items()) for c in (
        F.lit(name), F.array(*(F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in sorted(options.items()))))))

    def draw(child: Column) -> Column:
        h = F.xxhash64(F.concat_ws("/", F.col(key), parent, child["n"]))
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / child["w"]).alias("d"), child["n"].alias("n"))

    return F.array_min(F.transform(F.element_at(table, parent), draw))["n"]


def place(df: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """Add column ``out``: draw a region for the text key, then a rack of it, then a shard of that, by summed weights.

    A row costs one draw per child of three nodes, however many shards there are.
    """
    node = F.lit("")
    for depth, level in enumerate(_children(tree)):
        df = df.withColumn(f"_{out}{depth}", _draw(key, node, level))
        node = F.col(f"_{out}{depth}")
    return df.withColumn(out, node.cast("int")).drop(*(f"_{out}{d}" for d in range(3)))


def shard(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text",
          rows_per_bucket: int = 8192) -> DataFrame:
    """One row per document with its shard and its place in the shard.

    Law ``key``: the id and the tree decide. Changing one subtree's weight moves rows
    only into or out of that subtree. ``grown_shard`` is the shard under ``grown``.

    Slots are gapless from 0 in every shard: equal digests are counted before any
    shuffle, digests are spread over hash buckets whose number follows the row count, and
    a slot is the bucket's prefix sum plus the place in the bucket. No task holds a whole
    shard, and a repeated row takes consecutive slots.

    A null id draws as the word "null", a null text has size 8 and checksum 0; extra
    columns are ignored; an empty table gives no rows.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    digest = docs.select(F.col(id_col).alias("doc_id"), ident.alias("_id"),
                         (F.octet_length(text_of(text_col)) + 8).cast("long").alias("size"),
                         F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"))
    buckets = max(1, -(-docs.count() // (rows_per_bucket * len({x.shard for x in tree}))))
    placed = place(digest.groupBy("doc_id", "_id", "size", "text_crc32").agg(F.count("*").alias("_n")), "_id", tree, "shard")
    placed = place(placed, "_id", grown, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_id", "size", "text_crc32"), F.lit(buckets)))
    ahead = F.expr("sum(_rows) OVER (PARTITION BY shard ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    before = (placed.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
              .select("shard", "_bucket", F.coalesce(ahead, F.lit(0)).alias("_base")))
    inside = F.expr("sum(_n) OVER (PARTITION BY shard, _bucket ORDER BY _id, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return (placed.withColumn("_end", inside).join(before, ["shard", "_bucket"])
            .withColumn("slot", F.explode(F.sequence(F.col("_base") + F.col("_end") - F.col("_n"), F.col("_base") + F.col("_end") - 1)))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"))
