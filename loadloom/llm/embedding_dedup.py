"""Links between embeddings of equal label at a cosine threshold, by an epsilon grid order join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import local_roots, partitions
from loadloom.llm.components import components
from loadloom.sources.stage import stage


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that tiny and huge ones stay exact."""
    m = matrix / np.abs(matrix).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def leading_axes(sample: list[list[float]], axes: int) -> np.ndarray:
    """Orthonormal principal directions of a sample of vectors (any orthonormal ones keep the join exact)."""
    x = unit_rows(np.asarray(sample, float))
    x = x - x.mean(0)
    return np.linalg.svd(x, full_matrices=False)[2][:axes].T


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), float)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Block:
    """A run of vectors in grid order: unit vectors, their leading coordinates, weights and class ids."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray, coords: np.ndarray):
        self.ids, self.weights, self.units, self.coords = ids, weights, units, coords

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return self.coords[lo:hi].min(0), self.coords[lo:hi].max(0)


def join_blocks(a: Block, b: Block, same: bool, cosine: float, eps: float, leaf: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's rows, links of b's rows, smallest row reachable inside the two blocks).

    The two sequences are halved recursively; two intervals whose boxes in the leading
    coordinates are further apart than ``eps`` are skipped, since no two of their vectors can be
    nearer than the boxes. Rows of b count from ``len(a.ids)`` on.
    """
    n = len(a.ids)
    la, lb = np.zeros(n, np.int64), np.zeros(len(b.ids), np.int64)
    total = n + (0 if same else len(b.ids))
    shift = 0 if same else n
    root = np.arange(total)
    todo = [(0, n, 0, len(b.ids))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and j1 <= i0:
            continue
        (alo, ahi), (blo, bhi) = a.box(i0, i1), b.box(j0, j1)
        gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
        if (gap * gap).sum() > eps * eps * (1 + 1e-9):
            continue
        if i1 - i0 > leaf or j1 - j0 > leaf:
            if i1 - i0 >= j1 - j0:
                mid = (i0 + i1) // 2
                todo += [(i0, mid, j0, j1), (mid, i1, j0, j1)]
            else:
                mid = (j0 + j1) // 2
                todo += [(i0, i1, j0, mid), (i0, i1, mid, j1)]
            continue
        near = a.units[i0:i1] @ b.units[j0:j1].T >= cosine
        if same:
            near &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
        if not near.any():
            continue
        la[i0:i1] += near @ b.weights[j0:j1]
        lb[j0:j1] += near.T @ a.weights[i0:i1]
        u, v = np.nonzero(near)
        u, v = u + i0, v + j0 + shift
        open_ = root[u] != root[v]
        if open_.any():
            root = local_roots(total, np.concatenate([u[open_], np.arange(total)]), np.concatenate([v[open_], root]))
    return la, lb, root


def linked(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           axes: int = 8, block_rows: int = 2048, sample_rows: int = 5000) -> DataFrame:
    """One row per vector: number of other vectors linked to it, its component, and whether it stays.

    Two vectors are linked if their labels are equal and not null and their cosine is at least
    ``cosine``, which for unit vectors is a distance of at most sqrt(2 - 2 cosine). Equal vectors are one
    class with a weight. Classes are sorted by label and by the cells, as wide as
    that distance, of their leading principal coordinates and cut into blocks of that order; blocks of one label whose
    boxes are near enough are paired through the first coordinate's cells and
    joined recursively. A pair of blocks returns a count per vector and a spanning forest,
    never its pairs. The directions come from a sample of ``sample_rows``; every vector is
    joined, whatever the directions.

    Null, empty and zero vectors, vectors with null or non-finite components and null labels link
    with nothing (0 links, a component of their own). Vectors of different lengths are not
    linked. Repeated rows are links of each other. Other columns are ignored; no rows give no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = (F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.col(label_col).isNotNull()
           & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    eps = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"))
    named = rows.select("vec_id", "label", "fit", F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v"), F.size("v")).alias("h2"))
    classes = stage(rows.where("fit").groupBy("label", F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v"), F.size("v")).alias("h2"))
                    .agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
                    .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    n = classes.count()
    dims = [r[0] for r in classes.select("dim").distinct().collect()]
    basis = {d: leading_axes([r[0] for r in classes.where(F.col("dim") == d).orderBy(F.xxhash64("h1"), "node").limit(sample_rows).select("v").collect()], axes)
             for d in dims}

    width = max(axes, 4)

    def locate(batches):
        for b in batches:
            dim = b.column(2).to_numpy()
            for d in np.unique(dim):
                part = b.filter(pa.array(dim == d))
                units = unit_rows(_matrix(part.column(1)))
                xy = np.zeros((len(units), width))
                xy[:, :basis[int(d)].shape[1]] = units @ basis[int(d)]
                cells = np.floor(xy[:, :4] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(np.ascontiguousarray(cells[:, i])) for i in range(4)), part.column(3), part.column(4),
                     pa.array([u.tobytes() for u in units], pa.binary()), pa.array([c.tobytes() for c in xy], pa.binary())],
                    ["label", "dim", "c0", "c1", "c2", "c3", "node", "weight", "unit", "xy"])

    order = ["label", "dim", "c0", "c1", "c2", "c3", "node"]
    placed = (classes.select("label", "v", "dim", "node", "weight")
              .mapInArrow(locate, "label string, dim int, c0 int, c1 int, c2 int, c3 int, node long, weight long, unit binary, xy binary"))

    def cut(batches):
        held: list[pa.Table] = []
        size = 0

        def rows_of(t: pa.Table):
            xy = np.frombuffer(b"".join(t["xy"].to_pylist())).reshape(-1, width)
            return {"label": t["label"][0].as_py(), "dim": t["dim"][0].as_py(), "lo": xy.min(0).tolist(), "hi": xy.max(0).tolist(),
                    "nodes": t["node"].to_numpy().tobytes(), "weights": t["weight"].to_numpy().tobytes(),
                    "units": b"".join(t["unit"].to_pylist()), "coords": b"".join(t["xy"].to_pylist())}

        kinds = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
                           ("nodes", pa.binary()), ("weights", pa.binary()), ("units", pa.binary()), ("coords", pa.binary())])
        for b in batches:
            t = pa.Table.from_batches([b])
            at = 0
            label, dim = t["label"].to_pylist(), t["dim"].to_pylist()
            while at < t.num_rows:
                if held and (held[0]["label"][0].as_py(), held[0]["dim"][0].as_py()) != (label[at], dim[at]):
                    yield pa.RecordBatch.from_pylist([rows_of(pa.concat_tables(held))], kinds)
                    held, size = [], 0
                end = at
                while end < t.num_rows and end - at < block_rows - size and (label[end], dim[end]) == (label[at], dim[at]):
                    end += 1
                held.append(t.slice(at, end - at))
                size += end - at
                at = end
                if size >= block_rows:
                    yield pa.RecordBatch.from_pylist([rows_of(pa.concat_tables(held))], kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([rows_of(pa.concat_tables(held))], kinds)

    parts = max(1, -(-n // (block_rows * 4)))
    blocks = stage(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .mapInArrow(cut, "label string, dim int, lo array<double>, hi array<double>, nodes binary, weights binary, units binary, coords binary")
                   .withColumn("block", F.monotonically_increasing_id()))
    boxes = blocks.select("block", "label", "dim", "lo", "hi")
    cell = F.floor(F.col("lo")[0] / eps), F.floor(F.col("hi")[0] / eps)
    own = boxes.withColumn("cell", F.explode(F.sequence(*cell)))
    other = boxes.withColumn("cell", F.explode(F.sequence(cell[0] - 1, cell[1] + 1)))
    gaps = F.zip_with(F.zip_with("lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    pairs = (own.join(other.select("label", "dim", "cell", F.col("block").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")), ["label", "dim", "cell"])
             .where("block <= b").where(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps * (1 + 1e-9))
             .select(F.col("block").alias("a"), "b").distinct())
    side = lambda p: blocks.select(F.col("block").alias(p), *(F.col(x).alias(f"{p}_{x}") for x in ("nodes", "weights", "units", "coords")))
    spread = max(1, min(4096, -(-n // block_rows)))
    tasks = (pairs.join(side("a"), "a").join(side("b"), "b")
             .repartition(partitions(pairs, spread, 1), F.xxhash64("a", "b")))

    def block_of(b: pa.RecordBatch, p: str, k: int) -> Block:
        get = lambda x, t: np.frombuffer(b.column(b.schema.get_field_index(f"{p}_{x}"))[k].as_py(), t)
        ids = get("nodes", np.int64)
        return Block(ids, get("weights", np.int64), get("units", np.float64).reshape(len(ids), -1), get("coords", np.float64).reshape(len(ids), -1))

    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                x, y = block_of(b, "a", k), block_of(b, "b", k)
                same = b.column(b.schema.get_field_index("a"))[k].as_py() == b.column(b.schema.get_field_index("b"))[k].as_py()
                lx, ly, root = join_blocks(x, y, same, cosine, eps)
                ids = x.ids if same else np.concatenate([x.ids, y.ids])
                links = lx + ly if same else np.concatenate([lx, ly])
                hit = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root][hit])], ["node", "links", "other"])

    found = stage(tasks.mapInArrow(compare, "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    classed = (classes.select("label", "h1", "h2", "weight", "least", "node").join(links, "node", "left").join(comp, "node", "left")
               .withColumn("component", F.coalesce("component", "node")))
    first = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    result = stage(classed.join(first, "component").select("label", "h1", "h2", "component_id",
                                                           (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")))
    good = named.where("fit").join(result, ["label", "h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    bad = named.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
