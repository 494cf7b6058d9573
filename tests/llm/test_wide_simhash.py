"""The near copies' candidates: wide SimHash fingerprints, anchors on their bits, distances."""

import numpy as np
import pytest

from loadloom.llm import near_copies, simhash
from loadloom.llm.common import local_roots


def pairs_at(rng, size, shared, n):
    """Fingerprints of ``n`` pairs of sets of ``size`` elements of which ``shared`` are common."""
    for _ in range(n):
        x = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        yield [simhash.wide_fingerprint(s) for s in (x[:size], np.concatenate([x[:shared], x[size:2 * size - shared]]))]


def test_bits_are_majorities():
    h = np.random.default_rng(0).integers(0, 1 << 63, 700, dtype=np.uint64)
    ones = np.unpackbits(simhash.mix(h[:, None] ^ simhash._SALT).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=int)
    assert np.unpackbits(simhash.wide_fingerprint(h).view(np.uint8), bitorder="little").tolist() == (ones * 2 > 700).astype(int).tolist()
    assert not simhash.wide_fingerprint(h[:0]).any()


@pytest.mark.parametrize("size, shared", [(9, 8), (18, 16), (180, 160)])  # Jaccard 0.8
def test_near_sets_meet(size, shared):
    a, b = (np.stack(x) for x in zip(*pairs_at(np.random.default_rng(size), size, shared, 400)))
    sizes = np.full(400, size)
    assert (np.bitwise_count(a ^ b).sum(1) <= simhash.farthest(0.8, sizes, 512)).all()
    for bits in (4, 8, 12):
        met = set(zip(*map(np.ndarray.tolist, simhash.wide_anchors(a, sizes, 0.8, bits)))) & set(zip(*map(np.ndarray.tolist, simhash.wide_anchors(b, sizes, 0.8, bits))))
        assert len({row for row, _ in met}) == 400


@pytest.mark.parametrize("one_side", [False, True])
def test_close_rows_equal_brute_force(one_side):
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, (8, 4), dtype=np.uint64)[rng.integers(0, 8, 150)]
    fp ^= ((rng.random((150, 4, 64)) < 0.08).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)
    size = rng.integers(20, 40, 150)
    left = rng.random(150) < 0.5 if one_side else np.ones(150, bool)
    limit = simhash.farthest(0.8, size, 256)
    link = (np.bitwise_count(fp[:, None] ^ fp).sum(2) <= np.maximum(limit[:, None], limit)) & (size[:, None] >= 0.8 * size) & (size >= 0.8 * size[:, None])
    if one_side:
        link &= left[:, None] & ~left
    want = local_roots(150, *np.nonzero(link))
    for tile in (50, 1 << 16):
        got = local_roots(150, *simhash.close_wide(fp, size, left, 0.8, tile))
        assert got.tolist() == want.tolist()
    assert 1 < len(set(want.tolist())) < 100


def test_candidates_come_from_fingerprints(spark):
    """Fingerprints decide who meets, also when anchors are crowded and split."""
    rng = np.random.default_rng(5)
    near = list(pairs_at(rng, 90, 80, 60))
    rows = [(2 * i + k, x.tobytes(), 90) for i, pair in enumerate(near) for k, x in enumerate(pair)] + [(1000, bytes(64), 0), (1001, bytes(64), 0)]
    nodes = spark.createDataFrame(rows, "node long, fp binary, size int").repartition(3)
    for at_anchor in (4096, 3):
        links = {tuple(sorted(r)) for r in near_copies.candidates(nodes, 0.8, at_anchor).collect()}
        assert links == {(2 * i, 2 * i + 1) for i in range(60)}
