"""Hard negatives of anchors by the threshold algorithm over per-dimension sorted lists.

Rows are cut into blocks of one label. A block keeps its rows' order in every dimension. For an
anchor, the lists are read from the end that its component's sign makes larger, all dimensions in
step; every row met is scored by random access. Rows not met yet score at most the sum of
the anchor's components times the values last read (the threshold), so a search ends once that sum
is strictly below what each of its windows still admits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadloom.llm.fixed_point import exact_type, extent, held, usable, whole
from loadloom.sources.stage import stage


@dataclass
class Best:
    """The first ``k`` rows within [low, high] so far: higher scores first, ties by smaller id."""

    k: int
    low: int | None = None
    high: int | None = None
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: list = field(default_factory=list)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = np.ones(len(scores), bool)
        if self.low is not None:
            ok &= (scores >= self.low) & (scores <= self.high)
        if len(self.scores) == self.k:
            ok &= scores >= self.scores[-1]
        if ok.any():
            s, i = np.concatenate([self.scores, scores[ok]]), np.concatenate([np.asarray(self.ids, ids.dtype), ids[ok]])
            first = np.argsort(i, kind="stable")
            first = first[np.argsort(-s[first], kind="stable")][:self.k]
            self.scores, self.ids = s[first], i[first]

    def ends_below(self, threshold: int) -> bool:
        """No row that scores at most ``threshold`` can enter."""
        if self.low is not None and threshold < self.low:
            return True
        return len(self.scores) == self.k and threshold < self.scores[-1]


@dataclass
class Block:
    """Rows of one label with their order in every dimension, smallest value first."""

    ids: np.ndarray
    values: np.ndarray
    order: np.ndarray

    def search(self, anchor: np.ndarray, own_id, wanted: list[Best], first_depth: int = 16) -> int:
        """Offer the rows to each of ``wanted`` until the threshold lets none in; returns the rows scored."""
        m = len(self.ids)
        seen = self.ids == own_id
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        depth, step = 0, first_depth
        if not len(up) + len(down):  # every row scores zero
            depth, up = 0, np.arange(min(1, len(anchor)))
            step = m
        scored = 0
        while depth < m:
            end = min(m, depth + step)
            met = np.concatenate([self.order[up, m - end:m - depth].ravel(), self.order[down, depth:end].ravel()]) if len(anchor) else np.arange(m)
            fresh = np.unique(met[~seen[met]])
            seen[fresh] = True
            scored += len(fresh)
            scores = (self.values[fresh] @ anchor).astype(np.int64)
            last = sum((self.values[self.order[dims, at], dims] * anchor[dims]).sum() for dims, at in ((up, m - end), (down, end - 1)))
            for w in wanted:
                w.offer(scores, self.ids[fresh])
            if all(w.ends_below(last) for w in wanted):
                break
            depth, step = end, step * 2
        return scored


def _blocks(rows: DataFrame, scale: int, length: int, most: int) -> DataFrame:
    """(label, ids, values, orders): runs of at most ``most`` rows of one label, cut from partitions sorted by label."""
    bound = held(length)
    kinds = dict(rows.dtypes)

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        label = None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting)
            values = whole(t["vector"].combine_chunks(), scale, length, bound)
            order = np.argsort(values, 0, kind="stable").T.astype(np.int32)
            kinds = pa.schema([t.schema.field("label"), ("ids", pa.list_(t.schema.field("id").type)), ("cells", pa.binary()), ("orders", pa.binary())])
            return pa.RecordBatch.from_pylist([{"label": label, "ids": t["id"].to_pylist(), "cells": values.tobytes(), "orders": order.tobytes()}], kinds)

        for b in batches:
            of = b.column(b.schema.get_field_index("label")).to_pylist()
            at = 0
            while at < b.num_rows:
                if waiting and (of[at] != label or sum(x.num_rows for x in waiting) == most):
                    yield block()
                    waiting = []
                label = of[at]
                end = at
                room = most - sum(x.num_rows for x in waiting)
                while end < b.num_rows and end - at < room and of[end] == label:
                    end += 1
                waiting.append(b.slice(at, end - at))
                at = end
        if waiting:
            yield block()

    return rows.sortWithinPartitions("label").mapInArrow(run, f"label {kinds['label']}, ids array<{kinds['id']}>, cells binary, orders binary")


def _opened(batches, length: int, kind: type):
    for b in batches:
        for i in range(b.num_rows):
            ids = b.column(1)[i].values.to_numpy(zero_copy_only=False)
            values = np.frombuffer(b.column(2)[i].as_py(), np.int64).reshape(-1, length)
            yield b.column(0)[i].as_py(), Block(ids, values.astype(kind), np.frombuffer(b.column(3)[i].as_py(), np.int32).reshape(length, -1))


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group; the tasks before kept ``k`` each."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _tile_negatives(blocks: DataFrame, tile: DataFrame, kind: type, length: int, scale: int, k: int, low: int, high: int, id_type: str) -> DataFrame:
    """Hard negatives of one tile of anchors, whose vectors and windows are sent to every task."""
    rows = tile.collect()
    ids, labels = [r["id"] for r in rows], [r["label"] for r in rows]
    numbers = whole(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), scale, length, held(length)).astype(kind) if rows else np.zeros((0, length), kind)

    def friends(batches):
        best = [Best(k) for _ in ids]
        for label, block in _opened(batches, length, kind):
            for a in range(len(ids)):
                if labels[a] == label:
                    block.search(numbers[a], ids[a], [best[a]])
        yield from told((a, -1, b) for a, b in enumerate(best))

    def told(found):
        out = [(a, p, int(s), i) for a, p, b in found for s, i in zip(b.scores, b.ids)]
        if out:
            a, p, s, i = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(np.asarray(i))], ["anchor", "window", "score", "id"])

    shape = f"anchor int, window int, score long, id {id_type}"
    positives: list[list[tuple]] = [[] for _ in ids]
    for r in _first(blocks.mapInArrow(friends, shape), ["anchor"], k).orderBy("anchor", "place").collect():
        positives[r["anchor"]].append((r["id"], r["score"]))
    windows = [[(w, -(-low * s // 100), high * s // 100) for w, (_, s) in enumerate(of) if low * s <= high * s] for of in positives]

    def foes(batches):
        best = [[Best(k, lo, hi) for _, lo, hi in of] for of in windows]
        for label, block in _opened(batches, length, kind):
            for a in range(len(ids)):
                if labels[a] != label and best[a]:
                    block.search(numbers[a], ids[a], best[a])
        yield from told((a, w, b) for a, of in enumerate(best) for (w, _, _), b in zip(windows[a], of))

    spark = blocks.sparkSession
    known = spark.createDataFrame([(a, w, ids[a], i, s) for a, of in enumerate(positives) for w, (i, s) in enumerate(of)],
                                  f"anchor int, window int, anchor_id {id_type}, positive_id {id_type}, positive_score long")
    return (_first(blocks.mapInArrow(foes, shape), ["anchor", "window"], k).join(F.broadcast(known), ["anchor", "window"])
            .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def mine(vectors: DataFrame, anchor: Column, k: int = 5, low: int = 80, high: int = 100, scale: int = 256, block_rows: int = 4096, tile_rows: int = 4096,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor's hard negatives.

    ``anchor`` marks the rows to search for; it may use ``id``. An anchor's positives are its first ``k``
    other rows of the same label, and for each of them the first ``k`` rows of other labels whose score lies within ``low`` and ``high`` percent
    of the positive's are returned. A score is the inner product of floor(scale * component);
    higher scores come first, ties by smaller id. Anchors are dealt into tiles of about ``tile_rows``, whose
    vectors go to every task; a tile makes two passes over the written blocks, and a task returns at most ``k`` rows per anchor and window.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.
    Rows that share an id count once, as the one of the smallest label and vector. Shorter vectors
    are padded with zeros; components beyond ``held`` of the length stand at that bound. A positive of negative score has an
    empty window. Other columns are ignored; no rows or no anchors give no rows.
    """
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))))
    size = extent(rows, "vector", scale)
    if rows.select("id").distinct().count() < size.rows:
        rows = stage(rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector"))
    length = max(1, size.length)
    kind = exact_type(min(size.largest, held(length)), length)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size.rows // (4 * block_rows)))
    blocks = stage(_blocks(rows.coalesce(tasks), scale, length, block_rows))
    anchors = stage(rows.where(anchor))
    tiles = max(1, -(-anchors.count() // tile_rows))
    id_type = dict(rows.dtypes)["id"]
    found = [_tile_negatives(blocks, anchors.where(F.pmod(F.xxhash64("id"), F.lit(tiles)) == t).orderBy("id"), kind, length, scale, k, low, high, id_type) for t in range(tiles)]
    return reduce(DataFrame.unionByName, [stage(f) for f in found] if tiles > 1 else found)


MINE_SQL = """
    WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM (SELECT * FROM rows_ WHERE vec_id % 100 = 0) a JOIN rows_ b ON a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank,
        s.id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
    QUALIFY rank <= 5
"""
