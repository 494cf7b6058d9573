"""Best-fit packing of documents into sequences under several capacities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import sorted_groups, text_of
from loadloom.llm.tokens import encoder, parts
from loadloom.sources.stage import stage


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece by vector best fit, longest pieces first.

    A piece needs (tokens, 1 document, tokens squared of attention). It goes to the open
    bin that can take it in every dimension and has, in shares of the capacities, the
    smallest norm of what would be left (``norm``) or the largest dot product of need
    and residual (``dot``); ties go to the oldest bin, no such bin opens a new one.

    Bins with equal residuals are alike, so they are kept as states: the search runs over
    the distinct residuals that exist, not over bins.
    """
    cap = np.asarray(capacity, float)
    n = len(lengths)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1) / cap
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    slots: dict[tuple, int] = {}
    state = np.zeros((256, 3))
    members: list[list[tuple[int, int]]] = []
    count = opened = 0
    free: list[int] = []
    eps = 1e-12
    live = np.zeros(256, bool)
    for i in np.argsort(-lengths, kind="stable"):
        x = need[i]
        if (x > 1 + eps).any():
            raise ValueError("a piece is larger than a sequence")
        left = state[:count] - x
        ok = live[:count] & (left >= -eps).all(1)
        if ok.any():
            at = np.flatnonzero(ok)
            score = (left[at] ** 2).sum(1) if rule == "norm" else -(state[at] @ x)
            s = int(at[np.argmin(score)])
            b, used = members[s].pop()
            rest = state[s] - x
            if not members[s]:
                live[s] = False
                del slots[tuple(np.round(state[s], 12))]
                free.append(s)
        else:
            b, used, rest = opened, 0, 1 - x
            opened += 1
        bins[i], offsets[i] = b, used
        if rest[0] * cap[0] < 1 - eps:
            continue
        key = tuple(np.round(rest, 12))
        if key not in slots:
            if free:
                s = free.pop()
            else:
                s, count = count, count + 1
                members.append([])
                if count > len(state):
                    state, live = np.concatenate([state, np.zeros_like(state)]), np.concatenate([live, np.zeros_like(live)])
            slots[key], state[s], live[s] = s, rest, True
        members[slots[key]].append((b, used + int(lengths[i])))
    return bins, offsets


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first takes what is over."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pack(docs: DataFrame, max_tokens: int = 2048, max_docs: int | None = None, max_attention: float | None = None, rule: str = "norm",
         vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         group_pieces: int = 6_000) -> DataFrame:
    """One row per piece with the sequence and the place it gets there.

    A document is its ids and ``end_id``; only a longer one is cut into pieces of
    ``max_tokens``. Pieces are written once (ids stay in the task that made
    them), dealt evenly over groups of about ``group_pieces`` by their row number,
    and every group is packed by ``best_fit`` on its own: a group is large enough to
    fill its bins and small enough for one task, whatever the table's size.
    ``max_docs`` and ``max_attention`` (sum of squared lengths) default to what
    ``max_tokens`` implies anyway.

    A null text is empty, so it is the end id alone; repeated rows and ids are packed
    each; other columns are ignored; no rows give no rows.
    """
    cap = (max_tokens, max_docs or max_tokens, max_attention or float(max_tokens) ** 2)
    kind = dict(docs.dtypes)[id_col]

    def pieces(batches):
        encode = encoder(vocabulary)
        for b in batches:
            ids, rows = b.column(0), []
            for k, text in enumerate(b.column(1)):
                toks: list[int] = []
                for p in parts(text.as_py(), 1 << 16) if vocabulary == "byte_bpe_50k.json" else (text.as_py(),):
                    toks += encode(p)
                toks.append(end_id)
                raw = np.asarray(toks, "<u4")
                rows += [(k, j, s, n, zlib.crc32(raw[s:s + n].tobytes())) for j, (s, n) in enumerate(cut_pieces(len(raw), max_tokens))]
            if rows:
                k, j, s, n, c = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(j, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, c))],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    made = stage(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
                 .mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
                 .withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, -(-made.count() // group_pieces))
    dealt = made.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def fit(batches):
        for g in sorted_groups(batches, ["_group"]):
            bins, offsets = best_fit(g["length"].to_numpy(), cap, rule)
            seq = (int(g["_group"][0].as_py()) << 32) + bins
            out = g.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets))
            yield from out.to_batches()

    return (dealt.repartition("_group").sortWithinPartitions("_group", "_row")
            .mapInArrow(fit, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
