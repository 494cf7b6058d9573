"""Short codes for vectors: a codebook per part, fitted by k-means over anchors-hierarchy metric trees.

A block of vectors becomes one metric tree per part. A tree is grown from the middle: anchors
steal the points that are nearer to them, are merged pairwise upwards into the tightest balls, and
are split again downwards. Every ball caches its points' sum and count. In a round, a ball
inherits its parent's list of candidate entries and drops those that no point of it can be nearest to;
once one is left, the cached sum and count are added to it and its points are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.fixed_point import exact_type, extent, held, usable, whole
from loadloom.sources.stage import stage

Node = np.ndarray | tuple["Node", "Node"]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def anchor_groups(x: np.ndarray, k: int) -> list[np.ndarray]:
    """Indices of at most ``k`` groups: each new anchor is the point furthest from its own one.

    A point nearer to its anchor than half the distance between the two anchors cannot change
    over, so it is not measured.
    """
    owner, pivots = np.zeros(len(x), np.int64), [0]
    dist = _norms(x - x[0])
    while len(pivots) < k:
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        gap = _norms(x[pivots] - x[far])
        open_ = np.flatnonzero(dist > gap[owner] / 2)
        d = _norms(x[open_] - x[far])
        nearer = d < dist[open_]
        owner[open_[nearer]], dist[open_[nearer]] = len(pivots), d[nearer]
        pivots.append(far)
    return [np.flatnonzero(owner == j) for j in range(len(pivots))]


def _merged(x: np.ndarray, groups: list[np.ndarray], nodes: list[Node]) -> Node:
    """One binary tree over the groups: the pair whose joint ball is smallest is merged first."""
    centre = np.stack([x[g].mean(0) for g in groups])
    radius = np.array([_norms(x[g] - c).max() for g, c in zip(groups, centre)])
    count = np.array([len(g) for g in groups], float)
    nodes = list(nodes)

    def joint(i: int) -> np.ndarray:
        gap = _norms(centre - centre[i])
        out = np.maximum(np.maximum(radius, radius[i]), (gap + radius + radius[i]) / 2)
        out[i] = np.inf
        return out

    ball = np.stack([joint(i) for i in range(len(groups))])
    for _ in range(len(groups) - 1):
        i, j = divmod(int(ball.argmin()), len(nodes))
        nodes[i] = (nodes[i], nodes[j])
        both = count[i] + count[j]
        middle = (centre[i] * count[i] + centre[j] * count[j]) / both
        radius[i] = max(_norms(middle - centre[i]) + radius[i], _norms(middle - centre[j]) + radius[j])
        centre[i], count[i] = middle, both
        centre[j] = np.nan
        fresh = joint(i)
        ball[i], ball[:, i] = np.where(np.isnan(fresh), np.inf, fresh), np.where(np.isnan(fresh), np.inf, fresh)
        ball[j], ball[:, j] = np.inf, np.inf
        last = i
    return nodes[last] if len(groups) > 1 else nodes[0]


def _grow(x: np.ndarray, index: np.ndarray, leaf: int) -> Node:
    if len(index) <= leaf:
        return index
    groups = anchor_groups(x[index], int(np.ceil(np.sqrt(len(index)))))
    if len(groups) == 1:
        return index
    return _merged(x[index], groups, [_grow(x, index[g], leaf) for g in groups])


@dataclass
class Tree:
    """A metric tree over distinct points; a node covers ``points[lo:hi]``, leaves have ``left`` -1."""

    points: np.ndarray
    weights: np.ndarray
    slot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = 32) -> Tree:
        """Equal rows are one weighted point; ``slot`` says at which point a row ended up."""
        points, inverse, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        top = _grow(points.astype(float), np.arange(len(points)), leaf)
        order, lo, hi, left, right = [], [], [], [], []
        size = 0
        todo: list[tuple[Node | None, int]] = [(top, -1)]
        while todo:
            node, at = todo.pop()
            if node is None:
                hi[at] = size
                continue
            lo.append(size)
            hi.append(size)
            left.append(-1)
            right.append(-1)
            if at >= 0:
                (left if left[at] < 0 else right)[at] = len(lo) - 1
            if isinstance(node, tuple):
                here = len(lo) - 1
                todo += [(None, here), (node[1], here), (node[0], here)]
            else:
                order.append(node)
                size += len(node)
                hi[-1] = size
        order = np.concatenate(order)
        points, weights = points[order], weights[order].astype(np.int64)
        lo, hi = np.array(lo), np.array(hi)
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points * weights[:, None], 0)])
        count = np.concatenate([[0], np.cumsum(weights)])
        sums, counts = total[hi] - total[lo], count[hi] - count[lo]
        centre = sums / counts[:, None]
        radius = np.array([_norms(points[a:b] - c).max() for a, b, c in zip(lo, hi, centre)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(points, weights, place[inverse.ravel()], lo, hi, np.array(left), np.array(right), centre, radius, sums, counts)

    def settle(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, candidate entries) such that the nodes part the points: one candidate for a ball wholly owned, more for a leaf."""
        book = entries.astype(float)
        square = (book * book).sum(1)
        level, mask = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        while len(level):
            c = self.centre[level]
            d2 = (c * c).sum(1)[:, None] - 2 * c @ book.T + square
            d = np.sqrt(np.maximum(d2, 0))
            r = self.radius[level][:, None]
            slack = 1e-6 * (1 + np.sqrt(square.max()) + _norms(c)[:, None])  # far above the rounding of the distances
            best = np.where(mask, d + r, np.inf).min(1, keepdims=True)
            mask &= d - r <= best + slack
            done = (mask.sum(1) == 1) | (self.left[level] < 0)
            for i in np.flatnonzero(done):
                yield int(level[i]), np.flatnonzero(mask[i])
            level, mask = level[~done], mask[~done]
            level, mask = np.concatenate([self.left[level], self.right[level]]), np.concatenate([mask, mask])

    def nearest(self, node: int, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every point of a node; ties go to the lower entry."""
        kind = exact_type(max(np.abs(entries).max(), np.abs(self.points).max()), entries.shape[1])
        p, c = self.points[self.lo[node]:self.hi[node]].astype(kind), entries[among].astype(kind)
        d2 = (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)
        at = d2.argmin(1)
        return among[at], d2[np.arange(len(p)), at].astype(np.int64)

    def gather(self, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Add every point to the sum and count of its nearest entry."""
        for node, among in self.settle(entries):
            if len(among) == 1:
                sums[among[0]] += self.sums[node]
                counts[among[0]] += self.counts[node]
            else:
                own, _ = self.nearest(node, entries, among)
                span = slice(self.lo[node], self.hi[node])
                np.add.at(sums, own, self.points[span] * self.weights[span, None])
                np.add.at(counts, own, self.weights[span])

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row that the tree was built from."""
        own, error = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        for node, among in self.settle(entries):
            span = slice(self.lo[node], self.hi[node])
            own[span], error[span] = self.nearest(node, entries, among)
        return own[self.slot], error[self.slot]

    def packed(self) -> dict[str, bytes]:
        kinds = {"centre": np.float64, "radius": np.float64, "slot": np.int32, "lo": np.int32, "hi": np.int32, "left": np.int32, "right": np.int32}
        return {f.name: np.ascontiguousarray(getattr(self, f.name), kinds.get(f.name, np.int64)).tobytes() for f in fields(self)}

    @classmethod
    def unpacked(cls, raw: dict[str, bytes], width: int) -> Tree:
        kinds = {"centre": np.float64, "radius": np.float64, "slot": np.int32, "lo": np.int32, "hi": np.int32, "left": np.int32, "right": np.int32}
        got = {k: np.frombuffer(v, kinds.get(k, np.int64)) for k, v in raw.items()}
        return cls(**{k: v.reshape(-1, width) if k in ("points", "centre", "sums") else v for k, v in got.items()})


_TREE = "struct<" + ", ".join(f"{f.name}: binary" for f in fields(Tree)) + ">"


def _blocks(vectors: DataFrame, scale: int, parts: int, width: int, rows: int) -> DataFrame:
    """(ids, labels, trees): blocks of up to ``rows`` vectors of one scan partition, with a tree per part."""
    bound = held(width)
    kinds = dict(vectors.dtypes)

    def run(batches):
        schema = None
        waiting: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            numbers = whole(table["vector"].combine_chunks(), scale, parts * width, bound)
            trees = [Tree.build(numbers[:, p * width:(p + 1) * width]).packed() for p in range(parts)]
            return pa.RecordBatch.from_pylist([{"ids": table["id"].to_pylist(), "labels": table["label"].to_pylist(), "trees": trees}], schema)

        for b in batches:
            if schema is None:
                tree = pa.struct([(f.name, pa.binary()) for f in fields(Tree)])
                schema = pa.schema([("ids", pa.list_(b.schema.field("id").type)), ("labels", pa.list_(b.schema.field("label").type)), ("trees", pa.list_(tree))])
            at = 0
            while at < b.num_rows:
                take = min(rows - sum(x.num_rows for x in waiting), b.num_rows - at)
                waiting.append(b.slice(at, take))
                at += take
                if sum(x.num_rows for x in waiting) == rows:
                    yield block(pa.Table.from_batches(waiting))
                    waiting = []
        if waiting:
            yield block(pa.Table.from_batches(waiting))

    return vectors.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees array<{_TREE}>")


def _trees(batches, width: int) -> Iterator[tuple[pa.RecordBatch, int, list[Tree]]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, [Tree.unpacked(t, width) for t in b.column(b.schema.get_field_index("trees"))[i].as_py()]


def _first_entries(kept: DataFrame, entries: int, scale: int, parts: int, width: int) -> np.ndarray:
    """Parts of the vectors with the smallest ids, (part, entry, component); only ids are sorted, and only these vectors move."""
    ids = kept.where(F.col("id").isNotNull()).select("id").distinct().orderBy("id").limit(entries)
    rows = kept.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    if not rows:
        return np.zeros((parts, 0, width), np.int64)
    numbers = whole(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), scale, parts * width, held(width))
    return numbers.reshape(len(rows), parts, width).transpose(1, 0, 2).copy()


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = 2048,
           id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    Components become floor(scale * x), parts are assigned to the nearest entry (ties to the lower
    index) and entries move to the floored mean of their parts, ``rounds`` times; then all
    parts are assigned again. The first entries are the parts of the vectors with the smallest ids. A round
    is one pass over the written trees; it returns a sum and a count per entry and partition. The
    codebooks (parts x entries x components) are all that the driver holds.

    Vectors that are null or hold null or non-finite components are left out. Shorter vectors, and lengths
    that ``parts`` does not divide, are padded with zeros. Repeated rows are all coded; of a repeated
    id the smallest vector seeds the codebook; null ids are coded but seed nothing (without any id that
    is not null there is one entry of zeros). Components beyond ``held`` of the part's width stand at that
    bound. Null labels are one label; a label's error beyond a long stays at its largest value. Other columns are ignored; no rows give no rows.
    """
    kept = vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    width = max(1, -(-extent(kept, "vector", scale).length // parts))
    books = _first_entries(kept, entries, scale, parts, width)
    if not books.shape[1]:
        books = np.zeros((parts, 1, width), np.int64)
    blocks = stage(_blocks(kept, scale, parts, width, block_rows))
    columns = [f"s{i}" for i in range(width)]

    for _ in range(rounds):
        now = books

        def gather(batches, now=now):
            sums, counts = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for _, _, trees in _trees(batches, width):
                for p, tree in enumerate(trees):
                    tree.gather(now[p], sums[p], counts[p])
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), *(pa.array(np.ascontiguousarray(sums[p, e, i])) for i in range(width))],
                                             ["part", "entry", "n", *columns])

        moved = (blocks.select("trees").mapInArrow(gather, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in columns))
                 .groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect())
        books = now.copy()
        for r in moved:
            books[r["part"], r["entry"]] = [r[c] // r["n"] for c in columns]

    final = books

    def assign(batches):
        for b, i, trees in _trees(batches, width):
            own, error = zip(*(t.assign(final[p]) for p, t in enumerate(trees)))
            codes = np.stack(own, 1)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, pa.array(text), pa.array(np.sum(error, 0))], ["vec_id", "_label", "code", "error"])

    kinds = dict(kept.dtypes)
    coded = stage(blocks.mapInArrow(assign, f"vec_id {kinds['id']}, _label {kinds['label']}, code string, error long"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = stage(coded.groupBy(F.col("_label").alias("_l")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, final.ravel().tolist())).encode()).hexdigest()
    return (coded.join(by_label, coded["_label"].eqNullSafe(by_label["_l"]))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def encode_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same codes in DuckDB SQL over a table ``embeddings`` of equally long vectors."""
    near = """SELECT vec_id, part, entry, error FROM (SELECT p.vec_id, p.part, b.entry,
        list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS error,
        row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), b.entry) AS place
        FROM pieces p JOIN {book} b USING (part)) WHERE place = 1"""
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""pieces AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x
        FROM kept, range({parts}) AS r(part))""",
             f"b0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id)) - 1 AS entry, x FROM pieces QUALIFY entry < {entries})"]
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({near.format(book=f'b{r}')})",
                  f"""m{r} AS (SELECT part, entry, list(c ORDER BY pos) AS x FROM (SELECT part, entry, pos, floor(sum(c) / count(*)) AS c
            FROM (SELECT a.part, a.entry, unnest(p.x) AS c, generate_subscripts(p.x, 1) AS pos FROM a{r} a JOIN pieces p USING (vec_id, part)) GROUP BY part, entry, pos) GROUP BY part, entry)""",
                  f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"]
    return f"""WITH {', '.join(steps)}, last AS MATERIALIZED ({near.format(book=f'b{rounds}')}),
        coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM last GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
            FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM b{rounds}))
        SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.codebooks_sha256
        FROM coded c JOIN kept k USING (vec_id) CROSS JOIN digest d"""
