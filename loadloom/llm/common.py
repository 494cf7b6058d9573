"""Shared helpers: text keys, sorted groups in Arrow streams, byte-level words and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_M = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

_DEFAULT_BATCH = "67108864b"

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col: str) -> Column:
    """16 bytes that stand for the text; equal texts (null counts as empty) share them."""
    return F.unhex(F.md5(text_of(col)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of the table has (letter case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(df: DataFrame, rows: int, per_partition: int) -> int:
    """Partitions for ``rows`` rows: no less than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def chosen_ids(rows: DataFrame, most: dict) -> DataFrame:
    """(id, cls): at most ``most[cls]`` distinct ids of every class named there, the first ones in hash order.

    ``rows`` has (id, cls). A class's rows are first thinned by a bound on the hash that leaves
    a few more than wanted, so what is sorted or sent does not grow with the table.
    """
    rows = rows.where(F.col("cls").isin(list(most))).distinct().withColumn("h", F.xxhash64("id"))
    spark = rows.sparkSession
    sizes = {r["cls"]: r["n"] for r in rows.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    bounds = [(c, min(2**63 - 1, int((1.2 * most[c] + 200) / n * 2**64) - 2**63)) for c, n in sizes.items()]
    kind = dict(rows.dtypes)
    known = spark.createDataFrame(bounds, f"cls {kind['cls']}, bound long")
    near = rows.join(F.broadcast(known), "cls").where("h <= bound").select("cls", "id", "h").collect()
    picked = []
    for c in sizes:
        picked += [(r["id"], c) for r in sorted((r for r in near if r["cls"] == c), key=lambda r: (r["h"], r["id"]))[:most[c]]]
    return spark.createDataFrame(picked, f"id {kind['id']}, cls {kind['cls']}")


def in_small_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """The table, after bounding the bytes of the Arrow batches that its session sends to Python.

    The default bound suits short rows; with whole texts, a batch is held by the JVM, the pipe
    and Python at once, for every core of an executor. A bound that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) == _DEFAULT_BATCH:
        df.sparkSession.conf.set(name, size)
    return df


def text_parts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of consecutive rows, about ``limit`` bytes at a time; a longer text is alone."""
    at, part, size = 0, [], 0
    for i, x in enumerate(column):
        raw = x.as_py().encode()
        if part and size + len(raw) > limit:
            yield at, part
            at, part, size = i, [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield at, part


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys in a stream that is sorted by them; runs may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t[k].combine_chunks() for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order carries no meaning."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a blank after each, and the offset of each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buf, np.concatenate([[0], np.cumsum(lens)])


def word_bounds(buf: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every maximal run of bytes that are no gap."""
    w = np.concatenate([[False], ~is_gap[buf], [False]])
    edge = np.flatnonzero(w[1:] != w[:-1])
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, equal for equal words wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.full(int(lens.max()), _M | np.uint64(1))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    h = _BYTE[buf[pos + np.repeat(starts, lens)]] * powers[pos]
    return mix(np.add.reduceat(h, first) + lens.astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every ``k`` consecutive values, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, part, size = None, 0, h, 1
    while True:
        if k & size:
            out = part[:n] if out is None else out[:n] * _power(size) + part[have:have + n]
            have += size
        if size * 2 > k:
            return mix(out)
        part = part[:-size] * _power(size) + part[size:]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def window_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the least value in every window of ``w`` values."""
    if len(v) < w:
        return np.zeros(0, np.int64)
    pos, size = np.arange(len(v)), 1
    while size < w:
        step = min(size, w - size)
        b = v[step:] < v[:-step]
        v, pos = np.where(b, v[step:], v[:-step]), np.where(b, pos[step:], pos[:-step])
        size += step
    return pos


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the given links."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        for side in (u, v):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return root
