"""Near copies under the general rule: word shingles of five words with a Jaccard similarity of 0.8 or more.

At that similarity two SimHash fingerprints differ in about 15 % of their bits, where the covering that ``simhash.near_links`` uses
for two bits sends every fingerprint nearly everywhere. So the fingerprint is wide (512 bits) and each text goes to
anchors of several codes on its bits (``simhash.wide_anchors``). Texts that meet there at a small enough distance
are candidates, and each pair is checked on the whole shingle sets before it is linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm import simhash
from loadloom.llm.common import SPACES, free_name, grams, in_small_batches, partitions, sorted_groups, text_key, text_of, word_bounds, word_hashes
from loadloom.llm.components import components
from loadloom.sources.stage import broadcast_if_small, stage

#: Texts an anchor is meant to hold; one with over twice as many is split.
AT_ANCHOR = 4096


def shingles(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``k`` words (A-Z lowered, cut at ASCII white space); a shorter text is one run."""
    buf = np.frombuffer(text.encode().lower(), np.uint8)
    h = word_hashes(buf, *word_bounds(buf, SPACES))
    return np.unique(grams(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def verified_links(sets: list[np.ndarray], left: np.ndarray, least: float, prints: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of similar sets that connect all similar ones; ``left`` holds one side of the pairs, or is true everywhere for all pairs.

    Pairs that are connected already are not compared, so a group of copies costs about one comparison each; nor are
    those whose wide fingerprints (``prints``, a row each) are too far apart.
    """
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    limit = simhash.farthest(least, size, 64 * simhash.WORDS)
    every = bool(left.all())
    for i in np.flatnonzero(left).tolist():
        near = (size >= least * size[i]) & (size * least <= size[i])
        near &= (np.arange(len(sets)) > i) if every else ~left
        some = np.flatnonzero(near)
        if prints is not None:
            some = some[np.bitwise_count(prints[some] ^ prints[i]).sum(1, dtype=np.int64) <= np.maximum(limit[some], limit[i])]
        for j in some.tolist():
            a, b = top(i), top(j)
            if a != b and _similar(sets[i], sets[j], least):
                root[max(a, b)] = min(a, b)
                yield i, j


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, simhash.WORDS)


def in_parts(members: DataFrame) -> DataFrame:
    """Every pair of rows of ``members(node, parts, ...)`` meets in one block (p, q) of its group: all pairs of it where p = q, else those of ``left`` with the others."""
    return (members.withColumn("part", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other"), "left": F.col("part") <= F.col("other")}).drop("part", "other", "parts"))


def candidates(nodes: DataFrame, least: float, at_anchor: int = AT_ANCHOR) -> DataFrame:
    """Links (u, v) that connect all nodes of ``nodes(node, fp, size)`` that meet at an anchor and are close there.

    A block returns a spanning forest of its links, so never more rows than it read.
    """
    nodes = nodes.where("size > 0").select("node", "fp", "size")
    bits = max(4, int(np.ceil(np.log2(max(nodes.count(), 1) / at_anchor))))
    words = simhash.WORDS // 2

    def sent(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                fp, size = _prints(part.column(1)), part.column(2).to_numpy()
                yield part.column(0).to_numpy(), fp, size, *simhash.wide_anchors(fp, size, least, bits)

    def count(batches):
        for _, _, _, _, anchor in sent(batches):
            a, n = np.unique(anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n)], ["anchor", "n"])

    def send(batches):
        for node, fp, size, row, anchor in sent(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[row], anchor, size[row], *(fp[row, i].view(np.int64) for i in range(words)))],
                                             ["node", "anchor", "size", *(f"w{i}" for i in range(words))])

    crowded = (nodes.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * at_anchor)
               .select("anchor", F.ceil(F.col("n") / at_anchor).cast("int").alias("parts")))
    rows = nodes.mapInArrow(send, "node long, anchor long, size int, " + ", ".join(f"w{i} long" for i in range(words)))
    rows = rows.join(broadcast_if_small(stage(crowded)), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    def compare(batches):
        for g in sorted_groups(batches, ["anchor", "p", "q"]):
            if g.num_rows < 2:
                continue
            node = g["node"].to_numpy()
            fp = np.stack([g[f"w{i}"].to_numpy().view(np.uint64) for i in range(words)], 1)
            u, v = simhash.close_wide(fp, g["size"].to_numpy(), g["left"].to_numpy(zero_copy_only=False), least)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return (in_parts(rows).repartition(partitions(nodes, 0, 1), "anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")
            .mapInArrow(compare, "u long, v long"))


def labelled(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", group: int = 1000) -> DataFrame:
    """(doc_id, key, component) of every row: its text's key and the component of texts linked at ``least`` and above.

    Equal shingle sets are one node. Candidates that hang together are one class; a class of more than ``group``
    nodes is compared in blocks of about that size. Only texts of a class are read again for the
    exact check. Texts without words are copies of each other.
    """
    kind = dict(docs.dtypes)[id_col]

    def mark(batches):
        for b in batches:
            nodes, prints, sizes = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), shingle)
                nodes.append(int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True))
                prints.append(simhash.wide_fingerprint(s).tobytes())
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32())],
                                             ["doc_id", "key", "node", "fp", "size"])

    texts = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), text_of(text_col).alias("text"))
    own = stage(texts.mapInArrow(mark, f"doc_id {kind}, key binary, node long, fp binary, size int"))
    nodes = stage(own.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    classes = stage(components(candidates(nodes, least)).withColumnRenamed("component", "class"))
    parts = stage(classes.groupBy("class").agg(F.ceil(F.count("*") / group).cast("int").alias("parts")))

    def whole(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingles(t.as_py(), shingle).tobytes() for t in b.column(2)], pa.binary())], ["node", "fp", "grams"])

    wanted = stage(nodes.join(classes, "node", "left_semi").select("node", "key", "fp"))
    sets = stage(texts.select("key", "text").join(wanted, "key").groupBy("node").agg(F.first("fp").alias("fp"), F.first("text").alias("text"))
                 .mapInArrow(whole, "node long, fp binary, grams binary"))
    blocks = in_parts(classes.join(parts, "class")).join(sets, "node")

    def compare(batches):
        for g in sorted_groups(batches, ["class", "p", "q"]):
            node = g["node"].to_numpy()
            some = [np.frombuffer(x, np.uint64) for x in g["grams"].to_pylist()]
            prints = _prints(g["fp"])
            links = np.array(list(verified_links(some, g["left"].to_numpy(zero_copy_only=False), least, prints)), np.int64).reshape(-1, 2)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(node[links[:, 0]]), pa.array(node[links[:, 1]])], ["u", "v"])

    links = (blocks.repartition(partitions(docs, 0, 1), "class", "p", "q").sortWithinPartitions("class", "p", "q")
             .select("class", "p", "q", "node", "left", "fp", "grams").mapInArrow(compare, "u long, v long"))
    comp = stage(components(links))
    named = stage(nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    return own.select("doc_id", "key", "node").join(named, "node").select("doc_id", "key", "component")


def keep_winners(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for every component of ``found(doc_id, key, component)``: the smallest id, then the smallest text key.

    A null id comes after all others. Of several rows with the winner's id and text one stays.
    """
    best = (found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"))
            .groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "n")).alias("w")))
    best = stage(best.select(F.col("w.doc_id").alias("_id"), F.col("w.key").alias("_key"), F.col("w.n").alias("_n")))
    own = free_name(docs, "_text_key")
    keyed = docs.withColumn(own, text_key(text_col))
    same = lambda w: (keyed[own] == w["_key"]) & keyed[id_col].eqNullSafe(w["_id"])
    one, several = best.where("_n = 1"), best.where("_n > 1")
    once = keyed.join(one, same(one), "left_semi")
    return once.unionByName(keyed.join(several, same(several), "left_semi").dropDuplicates([id_col, own])).select(docs.columns)


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of every group of near copies does."""
    return keep_winners(docs, stage(labelled(docs, least, shingle, id_col, text_col)), id_col, text_col)
