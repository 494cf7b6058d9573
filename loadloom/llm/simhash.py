"""SimHash fingerprints, their links at a small Hamming distance by anchor-point covering, and wide fingerprints for a large one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import as_long, local_roots, mix, sorted_groups, text_of
from loadloom.llm.components import components
from loadloom.sources.stage import stage

#: 64-bit words of a wide fingerprint; the first half of them travels with a row that looks for its neighbours.
WORDS = 8
_SALT = np.random.default_rng(64).integers(0, 1 << 63, WORDS, dtype=np.uint64)
_BYTES = np.uint64(0x0101010101010101)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of all word shingles; A-Z lowered, words cut at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(flat[a:b], seed) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number; null texts have no words, so 0."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_long(fp))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_lengths(anchor_bits: int) -> list[int]:
    """64 bits in ``anchor_bits`` blocks of odd length (an even number of blocks), as equal as can be."""
    base = 64 // anchor_bits
    base -= 1 - base % 2
    longer = (64 - base * anchor_bits) // 2
    return [base + 2 * (i < longer) for i in range(anchor_bits)] if longer <= anchor_bits else block_lengths(anchor_bits + 2)


def anchors(fp: np.ndarray, anchor_bits: int, distance: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) for every anchor a fingerprint is sent to.

    The covering code is a product of repetition codes of odd length: a block of n bits has
    two code words, all zeros and all ones, which cover it perfectly with radius (n-1)/2.
    The nearest anchor (majority in each block) is the fingerprint's home. It is also sent to every
    anchor whose blockwise distances exceed the covering radii by ``distance``
    in sum at most. A neighbour within ``distance`` bits has its home among those, since a bit
    changes one block's distance by one.
    """
    u = fp.view(np.uint64)
    home = np.zeros(len(u), np.int64)
    over = []
    at = 0
    for i, n in enumerate(block_lengths(anchor_bits)):
        part = (u >> np.uint64(at)) & np.uint64((1 << n) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        home |= (ones > n // 2).astype(np.int64) << i
        over.append(np.maximum(ones, n - ones) - n // 2)
        at += n
    rows, out, own = [np.arange(len(u))], [home], [np.ones(len(u), bool)]

    def more(at_rows, anchor, first, left):
        for i in range(first, len(over)):
            ok = over[i][at_rows] <= left
            r, a, l = at_rows[ok], anchor[ok] ^ (1 << i), left[ok] - over[i][at_rows[ok]]
            if len(r):
                rows.append(r)
                out.append(a)
                own.append(np.zeros(len(r), bool))
                deep = l > 0
                if deep.any():
                    more(r[deep], a[deep], i + 1, l[deep])

    more(np.arange(len(u)), home, 0, np.full(len(u), distance))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(own)


def code_bits(n: int) -> int:
    """Blocks of the code: twice the fingerprints, twice the anchors, so that an anchor's share stays level."""
    bits = max(8, min(20, int(np.ceil(np.log2(max(n, 1)))) - 6))
    return bits + bits % 2


def close_pairs(own: np.ndarray, every: np.ndarray, distance: int, tile: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, smallest node of its local component) among fingerprints compared as ``own`` x ``every``."""
    nodes, inverse = np.unique(np.concatenate([own, every]), return_inverse=True)
    a, b = inverse[:len(own)], inverse[len(own):]
    root = np.arange(len(nodes))
    step = max(1, tile // max(1, len(every)))
    x, y = own.view(np.uint64), every.view(np.uint64)
    for s in range(0, len(own), step):
        i, j = np.nonzero(np.bitwise_count(x[s:s + step, None] ^ y[None, :]) <= distance)
        u, v = a[s + i], b[j]
        keep = root[u] != root[v]
        if keep.any():
            r = local_roots(len(nodes), np.concatenate([root[u[keep]], np.arange(len(nodes))]), np.concatenate([root[v[keep]], root]))
            root = r
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def near_links(fps: DataFrame, distance: int = 2, pair_limit: int = 1 << 24) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fps(fp)`` within ``distance`` bits.

    Every fingerprint is compared at its home anchor with all that were sent
    there. An anchor with more than ``pair_limit`` comparisons is split: its home
    fingerprints are dealt over as many parts as needed and those sent there
    go to every part. A part returns a spanning forest of the links it found, never
    more rows than it read.
    """
    bits = code_bits(fps.count())

    def send(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            for s in range(0, len(fp), 4096):
                part = fp[s:s + 4096]
                r, a, own = anchors(part, bits, distance)
                yield pa.RecordBatch.from_arrays([pa.array(part[r]), pa.array(a), pa.array(own)], ["fp", "anchor", "home"])

    sent = fps.select("fp").mapInArrow(send, "fp long, anchor long, home boolean")
    load = stage(sent.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count("*").alias("n"))
            .select("anchor", F.ceil(F.col("h") * F.col("n") / F.lit(float(pair_limit))).cast("int").alias("parts")).where("parts > 0"))
    dealt = (sent.join(load, "anchor")
             .withColumn("part", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0)))
                                           .when(F.col("home"), F.expr("transform(sequence(0, parts - 1), p -> IF(p = pmod(xxhash64(fp), parts), p, -p - 1))"))
                                           .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
             # where a home fingerprint belongs to another part it is only compared against
             .select("anchor", F.when(F.col("part") < 0, -F.col("part") - 1).otherwise(F.col("part")).alias("part"),
                     "fp", (F.col("home") & (F.col("part") >= 0)).alias("own")))

    def compare(batches):
        held_u, held_v, n = [], [], 0
        for g in sorted_groups(batches, ["anchor", "part"]):
            fp, own = g["fp"].to_numpy(), g["own"].to_numpy()
            if len(fp) > 1 and own.any():
                u, v = close_pairs(fp[own], fp, distance)
                held_u.append(u)
                held_v.append(v)
                n += len(u)
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held_u)), pa.array(np.concatenate(held_v))], ["u", "v"])
                held_u, held_v, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held_u)), pa.array(np.concatenate(held_v))], ["u", "v"])

    return dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(compare, "u long, v long")


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Majority bits, in ``WORDS`` words, of hashes of all elements of the set ``h``; none: zeros."""
    ones = np.zeros((WORDS, 8, 8), np.int64)
    for at in range(0, len(h), 255):
        x = mix(h[at:at + 255] ^ _SALT[:, None])
        for bit in range(8):  # eight sums a word, none above 255
            ones[:, :, bit] += ((x >> np.uint64(bit)) & _BYTES).sum(1).view(np.uint8).reshape(WORDS, 8)
    return np.packbits((ones * 2 > len(h)).ravel(), bitorder="little").view("<u8")


def flips(least: float, size: np.ndarray) -> np.ndarray:
    """Chance that a bit differs between sets of Jaccard ``least``: the angle between them, and a little more for small sets, whose sums tie."""
    return math.acos(2 * least / (1 + least)) / math.pi + 0.15 / np.maximum(size, 1)


def farthest(least: float, size: np.ndarray, bits: int) -> np.ndarray:
    """Distance on ``bits`` bits that sets of Jaccard ``least`` exceed by chance only (five standard deviations)."""
    p = flips(least, size)
    return np.ceil(bits * p + 5 * np.sqrt(bits * p * (1 - p))).astype(np.int64)


def wide_anchors(fp: np.ndarray, size: np.ndarray, least: float, anchor_bits: int, miss: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor that a wide fingerprint (rows x ``WORDS``) is sent to.

    A code's anchors are the values of ``anchor_bits`` bits of the fingerprint. There are as many codes, each on other bits
    until all are used, as it takes for sets of Jaccard ``least`` to share no anchor with probability ``miss`` only.
    """
    codes = np.ceil(math.log(miss) / np.log1p(-(1 - flips(least, size)) ** anchor_bits)).astype(np.int64)
    most, a_round = int(codes.max(initial=0)), 64 * WORDS // anchor_bits
    order = [np.random.default_rng([9, r]).permutation(64 * WORDS)[:a_round * anchor_bits].reshape(a_round, anchor_bits) for r in range(-(-most // a_round))]
    if not order:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate(order)[:most]
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    value = bits[:, at].astype(np.int64) @ (np.int64(1) << np.arange(anchor_bits))
    row, code = np.nonzero(np.arange(most) < codes[:, None])
    return row, code << 32 | value[row, code]


def close_wide(fp: np.ndarray, size: np.ndarray, left: np.ndarray, least: float, tile: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Star links (row, root) among rows of half a wide fingerprint (rows x ``WORDS`` / 2) no farther apart than sets of Jaccard ``least`` are.

    ``left`` holds one side of the pairs, or is true everywhere for all pairs.
    """
    n, words = fp.shape
    first = words // 2
    order = np.argsort(size, kind="stable")
    cols = [np.ascontiguousarray(fp[order, i]) for i in range(words)]
    size = size[order].astype(np.int64)
    left = left[order]
    limit, rough = farthest(least, size, 64 * words), farthest(least, size, 64 * first)
    every = bool(left.all())
    a = np.flatnonzero(left)
    b = a if every else np.flatnonzero(~left)
    x_size, y_size, y_cols = size[a], size[b], [c[b] for c in cols]
    root = np.arange(n)
    s = 0
    while s < len(a):
        # in order of size, the partners of a row are the next ones
        low = s if every else int(np.searchsorted(y_size, least * x_size[s] - 1e-9))
        e = min(len(a), s + 256)
        while True:
            high = int(np.searchsorted(y_size, x_size[e - 1] / least + 1e-9, "right"))
            if e - s == 1 or (e - s) * (high - low) <= tile:
                break
            e = s + (e - s) // 2
        x, s = a[s:e], e
        d = sum(np.bitwise_count(c[x, None] ^ y[low:high]) for c, y in zip(cols[:first], y_cols))
        meets = d <= int(max(rough[x[0]], rough[b[low]] if low < high else 0))
        some = np.flatnonzero(meets.any(1))
        i, j = np.nonzero(meets[some])
        u, v = x[some[i]], b[low + j]
        far = sum(np.bitwise_count(c[u] ^ c[v]).astype(np.int64) for c in cols)
        ok = (u != v) & (far <= np.maximum(limit[u], limit[v])) & (size[u] >= least * size[v]) & (size[v] >= least * size[u])
        u, v = root[u[ok]], root[v[ok]]
        if (u != v).any():
            root = local_roots(n, np.concatenate([u, np.arange(n)]), np.concatenate([v, root]))
    moved = np.flatnonzero(root != np.arange(n))
    return order[moved], order[root[moved]]


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Equal fingerprints are one node, so thousands of copies cost one comparison. The
    component is the smallest id reachable over links of at most ``distance`` bits.
    Texts without words (null, empty, blanks) share fingerprint zero and are linked
    like any other; repeated rows are all returned; a group of null ids only has a null
    component; other columns are ignored; no rows give no rows.
    """
    own = stage(fingerprints(docs, id_col, text_col, shingle))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(near_links(nodes, distance))
    named = nodes.join(comp, nodes["fp"] == comp["node"], "left").select(nodes["fp"], "least", F.coalesce("component", nodes["fp"]).alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = stage(named.join(first, "component").select("fp", "component_id"))
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when one document of every group does: the smallest ``doc_id``.

    A group whose ids are all null keeps its rows. If the smallest id occurs on several rows,
    one of those stays.
    """
    found = near_duplicates(docs, distance)
    winners = stage(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n")))
    once = docs.join(winners.where("_n = 1").select("doc_id"), "doc_id", "left_semi")
    several = docs.join(winners.where("_n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    unnamed = docs.where("doc_id IS NULL")
    return once.unionByName(several).unionByName(unnamed).select(docs.columns)
