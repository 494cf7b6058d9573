"""Gradient boosting to convergence: all settings grow their trees in shared scans, or each in a task of its own.

Features are cut into bins once. A level of a tree needs one histogram of the residuals (node x feature x bin) of every
setting that still learns; all of them come from one scan, so the number of scans is that of the slowest setting.
A table of at most ``TASK_ROWS`` rows (a daily series is one) is instead sent to one task per setting, which grows the same trees without scans.
Every setting is grown twice in lockstep, on the training rows (the validation rows tell when to stop) and on
training and validation rows together, so the refit at the chosen number of rounds costs no further scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.operators.many_fits import _matrix, _uniform
from loadloom.sources.stage import stage

# The searched settings, the cap on rounds, the patience and the least number of rounds.
GRID = {"step": (0.03, 0.05), "depth": (3, 5), "least_rows": (3, 6)}
ROUNDS, PATIENCE, LEAST = 1200, 50, 50
ROW_SHARE, COLUMN_SHARE, SHRINK = 0.85, 0.85, 1.0
BINS, SLICE = 32, 8192
# Rows of a table that one task may hold; rows a partition; partitions whose sums the driver adds up itself.
TASK_ROWS, PART_ROWS, FEW = 20_000, 100_000, 4


@dataclass(frozen=True)
class Setting:
    """``columns`` are the positions of the features it may use (None: all)."""

    step: float
    depth: int
    least_rows: int
    columns: tuple[int, ...] | None = None


@dataclass
class Tree:
    """Nodes in heap order: feature (-1: leaf), last bin that goes left, value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n))


def nodes_of(trees: Sequence[Tree], codes: np.ndarray) -> np.ndarray:
    """Node that each row reaches in each tree (rows x trees); the trees are of one depth."""
    feature, cut = np.stack([t.feature for t in trees]), np.stack([t.cut for t in trees])
    own, every = np.arange(len(trees))[None, :], np.arange(len(codes))[:, None]
    at = np.zeros((len(codes), len(trees)), int)
    for _ in range(int(np.log2(feature.shape[1] + 1)) - 1):
        f = feature[own, at]
        at = np.where(f >= 0, 2 * at + 1 + (codes[every, f] > cut[own, at]), at)
    return at


def added(trees: Sequence[Tree], codes: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for every row."""
    if not trees:
        return np.zeros(len(codes))
    value = np.stack([t.value for t in trees])
    return value[np.arange(len(trees))[None, :], nodes_of(trees, codes)].sum(1)


@dataclass
class Member:
    """One model under growth: a setting, and whether the validation rows are training rows too."""

    setting: Setting
    both: bool
    base: float
    trees: list[Tree] = field(default_factory=list)


@dataclass
class Boosted:
    """A fitted model: what turns features into bins, the trees, and the search behind it."""

    features: list[str]
    cuts: list[list[float]]
    medians: list[float]
    base: float
    trees: list[Tree]
    setting: Setting
    board: list[tuple]

    def predict(self, df: DataFrame, out: str = "pred", log: bool = True) -> DataFrame:
        """``df`` with the prediction, never below 0; all columns stay. ``out`` must be a new name."""
        trees, base = self.trees, self.base

        @F.pandas_udf("double")
        def score(codes):
            c = np.stack(codes.to_numpy()) if len(codes) else np.zeros((0, 1), int)
            return codes.__class__(base + added(trees, c))

        p = score(codes_of(self.features, self.cuts, self.medians))
        return df.withColumn(out, F.greatest(F.lit(0.0), F.expm1(p) if log else p))


def cut_points(train: DataFrame, features: Sequence[str], bins: int = BINS) -> tuple[list[list[float]], list[float]]:
    """(cuts, medians) of every feature from one aggregate over the training rows; a feature without values has none."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = train.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), shares, F.lit(10000)).alias(f"c{i}") for i, f in enumerate(features)]).first()
    cuts = [sorted(set(c)) if c else [] for c in row]
    return cuts, [float(c[bins // 2 - 1]) if c else 0.0 for c in row]


def codes_of(features: Sequence[str], cuts: Sequence[Sequence[float]], medians: Sequence[float]):
    """The array of bin numbers: how many cut points lie below the value. Nulls and NaN take the training median."""
    def code(f, c, m):
        x = F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(m))
        return F.size(F.filter(F.array(*[F.lit(v) for v in c]).cast("array<double>"), lambda v: v < x))

    return F.array(*[code(*z) for z in zip(features, cuts, medians)])


def _fold(total: dict[int, np.ndarray], rows: tuple, members: Sequence[Member], written: int, level: int, round_: int, seed: int) -> None:
    """Add a slice of rows (codes, y, h, val, p) to the members' sums, counts, squared validation error and validation rows."""
    codes, y, h, val, state = rows
    nodes, p = 2 ** level, codes.shape[1]
    wide = nodes * p * BINS
    flat = np.arange(p) * BINS + codes
    # The draws of a round are the same for all settings and for a repeated task.
    drawn = _uniform(h, [seed], round_)[:, 0] < ROW_SHARE
    for i, t in total.items():
        x = members[i]
        r = y - state[:, i] - added(x.trees[written:round_], codes)
        if level == 0:
            t[-2] += (r[val] ** 2).sum()
            t[-1] += val.sum()
        take = drawn if x.both else drawn & ~val
        cell = flat
        if level:
            reached = nodes_of([x.trees[round_]], codes)[:, 0] - (nodes - 1)
            take = take & (reached >= 0)
            cell = reached[:, None] * (p * BINS) + flat
        cell = cell[take].ravel()
        t[:wide] += np.bincount(cell, np.repeat(r[take], p), wide)
        t[wide:2 * wide] += np.bincount(cell, minlength=wide)


def _live(members: Sequence[Member], level: int) -> list[int]:
    return [i for i, x in enumerate(members) if level < x.setting.depth]


class Scans:
    """Histograms of a written table (codes, y, h, val, p): tasks fold their rows into one row per member, Spark adds them up.

    ``p`` holds the members' predictions up to the trees in ``written``; it is written anew every ``every`` rounds.
    """

    every = 16

    def __init__(self, table: DataFrame, parts: int, p: int, seed: int):
        self.table, self.parts, self.p, self.seed = table.coalesce(parts), parts, p, seed

    def totals(self, members, written, level, round_):
        wide, seed, live = 2 ** level * self.p * BINS, self.seed, _live(members, level)

        def fold(batches):
            total = {i: np.zeros(2 * wide + 2) for i in live}
            for rows in _rows(batches):
                _fold(total, rows, members, written, level, round_, seed)
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([total[i].tobytes() for i in live], pa.binary())], ["member", "sums"])

        def add(parts):
            total = sum(np.frombuffer(v.as_py()) for v in parts.column("sums"))
            return pa.table({"member": parts.column("member")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        got = self.table.mapInArrow(fold, "member int, sums binary")
        if self.parts > FEW:
            got = got.groupBy("member").applyInArrow(add, "member int, sums binary")
        out = {i: np.zeros(2 * wide + 2) for i in live}
        got = got.toArrow()
        for member, sums in zip(got.column(0).to_pylist(), got.column(1)):
            out[member] += np.frombuffer(sums.as_buffer())
        return out

    def advance(self, members, written, keep):
        new = [(i, m.trees[written:]) for i, m in zip(keep, members)]

        def run(batches):
            for codes, y, h, val, state in _rows(batches):
                out = np.stack([state[:, i] + added(trees, codes) for i, trees in new], 1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (codes.astype(np.int32), out)]
                yield pa.RecordBatch.from_arrays([lists[0], pa.array(y), pa.array(h), pa.array(val), lists[1]], ["codes", "y", "h", "val", "p"])

        self.table = stage(self.table.mapInArrow(run, self.table.schema)).coalesce(self.parts)


class Held:
    """The same on rows that one task holds."""

    every = 1

    def __init__(self, rows: tuple, seed: int):
        self.rows, self.seed = list(rows), seed

    def totals(self, members, written, level, round_):
        out = {i: np.zeros(2 ** (level + 1) * self.rows[0].shape[1] * BINS + 2) for i in _live(members, level)}
        _fold(out, self.rows, members, written, level, round_, self.seed)
        return out

    def advance(self, members, written, keep):
        self.rows[4] = np.stack([self.rows[4][:, i] + added(m.trees[written:], self.rows[0]) for i, m in zip(keep, members)], 1)


def _rows(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            y, h, val = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            yield _matrix(part.column(0), np.int64), y, h, val, _matrix(part.column(4))


def grow(members: Sequence[Member], source: Scans | Held, p: int, seed: int, rounds: int, patience: int) -> dict[Setting, list[float]]:
    """Grow the members' trees; the validation error of every setting before each round."""
    errors: dict[Setting, list[float]] = {m.setting: [] for m in members}
    open_, written = list(members), 0
    for round_ in range(rounds + 1):
        for level in range(max(m.setting.depth for m in open_)):
            totals = source.totals(open_, written, level, round_)
            for i, t in totals.items():
                m = open_[i]
                if level == 0:
                    if not m.both:
                        errors[m.setting].append(float(np.sqrt(t[-2] / t[-1])))
                    if round_ < rounds:
                        m.trees.append(Tree.empty(m.setting.depth))
                if round_ < rounds:
                    sums, counts = t[:-2].reshape(2, 2 ** level, p, BINS)
                    split(m.trees[round_], level, sums, counts, m.setting, _columns(m.setting, p, seed, round_))
            if round_ == rounds:
                return errors
        going = [i for i, m in enumerate(open_) if round_ - int(np.argmin(errors[m.setting])) < patience]
        if not going:
            return errors
        if len(going) < len(open_) or round_ + 1 - written >= source.every:
            source.advance([open_[i] for i in going], written, going)
            open_, written = [open_[i] for i in going], round_ + 1
    return errors


def split(tree: Tree, level: int, sums: np.ndarray, counts: np.ndarray, setting: Setting, columns: np.ndarray) -> None:
    """Best split of every node of a level; leaves take the shrunken mean residual. Ties go to the lower feature and bin."""
    n_nodes = 2 ** level
    left_s, left_n = sums[:, columns].cumsum(2), counts[:, columns].cumsum(2)
    s, n = left_s[:, :1, -1:], left_n[:, :1, -1:]
    if level == 0:
        tree.value[0] = setting.step * s[0, 0, 0] / (n[0, 0, 0] + SHRINK)
    right_s, right_n = s - left_s, n - left_n
    gain = left_s ** 2 / (left_n + SHRINK) + right_s ** 2 / (right_n + SHRINK) - s * s / (n + SHRINK)
    gain[(left_n < setting.least_rows) | (right_n < setting.least_rows)] = -np.inf
    best = gain.reshape(n_nodes, -1).argmax(1)
    for node in range(n_nodes):
        j, b = divmod(int(best[node]), BINS)
        if gain[node, j, b] > 1e-9:
            at = n_nodes - 1 + node
            tree.feature[at], tree.cut[at] = columns[j], b
            tree.value[2 * at + 1] = setting.step * left_s[node, j, b] / (left_n[node, j, b] + SHRINK)
            tree.value[2 * at + 2] = setting.step * right_s[node, j, b] / (right_n[node, j, b] + SHRINK)


def _in_tasks(plain: DataFrame, pairs: Sequence[tuple[Member, Member]], p: int, seed: int, rounds: int, patience: int, least: int) -> list[list[float]]:
    """Every setting in a task of its own that holds the table; the errors per setting, the twins' trees filled in."""

    def one(part):
        mine = pairs[part.column("setting")[0].as_py()]
        (batch,) = part.select(["codes", "y", "h", "val"]).combine_chunks().to_batches()
        order = np.lexsort((batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)))
        y, h, val = (batch.column(i).to_numpy(zero_copy_only=False)[order] for i in (1, 2, 3))
        members = [Member(m.setting, m.both, m.base) for m in mine]
        state = np.repeat([[m.base for m in members]], len(y), 0)
        errors = grow(members, Held((_matrix(batch.column(0), np.int64)[order], y, h, val, state), seed), p, seed, rounds, patience)[mine[0].setting]
        trees = members[1].trees[:max(least, int(np.argmin(errors)))]
        flat = [np.concatenate([getattr(t, n) for t in trees] or [np.zeros(0)]).astype(float).tolist() for n in ("feature", "cut", "value")]
        return pa.table({"setting": part.column("setting")[:1], "errors": [errors], "feature": [flat[0]], "cut": [flat[1]], "value": [flat[2]]}, out)

    out = pa.schema([("setting", pa.int32()), ("errors", pa.list_(pa.float64())), *((n, pa.list_(pa.float64())) for n in ("feature", "cut", "value"))])
    dealt = plain.withColumn("setting", F.explode(F.array(*[F.lit(i) for i in range(len(pairs))])))
    # A stated number of partitions, so that AQE does not put the small groups into one task.
    got = dealt.repartition(len(pairs), "setting").groupBy("setting").applyInArrow(one, "setting int, errors array<double>, feature array<double>, cut array<double>, value array<double>").collect()
    found = {r["setting"]: r for r in got}
    for i, (_, twin) in enumerate(pairs):
        f, c, v = (np.array(found[i][n]).reshape(-1, 2 ** (twin.setting.depth + 1) - 1) for n in ("feature", "cut", "value"))
        twin.trees = [Tree(a.astype(int), b.astype(int), w) for a, b, w in zip(f, c, v)]
    return [found[i]["errors"] for i in range(len(pairs))]


def fit(train: DataFrame, val: DataFrame, features: Sequence[str], y: str, settings: Sequence[Setting] | None = None, log: bool = True,
        seed: int = DEFAULT.seed, rounds: int = ROUNDS, patience: int = PATIENCE, least: int = LEAST, task_rows: int = TASK_ROWS) -> list[Boosted]:
    """One model per set of columns among the settings: the setting and the number of rounds with the smallest validation error,
    grown on training and validation rows.

    A setting stops ``patience`` rounds after its best one, at the latest after ``rounds``. The target is log1p of ``y`` (or ``y``)
    and so is the error. Rows without a target are left out; missing features take the training median; a constant target gives the constant;
    no training or validation rows raise ``ValueError``. Repeated rows are drawn together. Above ``task_rows`` rows the state is written every few rounds,
    so a lost executor costs at most that many. Both ways, shared scans and tasks, grow the same trees but for the order of sums. Superseded tables stay in the staging folder.
    """
    settings = list(settings or [Setting(*v) for v in product(*GRID.values())])
    features = list(features)
    cuts, medians = cut_points(train.where(F.col(y).isNotNull()), features)
    target = F.log1p(F.col(y).cast("double")) if log else F.col(y).cast("double")

    def rows(df, is_val):
        return df.where(F.col(y).isNotNull()).select(codes_of(features, cuts, medians).alias("codes"), target.alias("y"), F.lit(is_val).alias("val"))

    plain = rows(train, False).unionByName(rows(val, True)).select("codes", "y", F.xxhash64("codes", "y").alias("h"), "val")
    plain = stage(plain)
    sizes = plain.agg(F.count_if(~F.col("val")), F.count_if("val"), F.avg(F.when(~F.col("val"), F.col("y"))), F.avg("y")).first()
    if not sizes[0] or not sizes[1]:
        raise ValueError("boosting needs training and validation rows")
    pairs = [(Member(s, False, sizes[2]), Member(s, True, sizes[3])) for s in settings]
    n, p = sizes[0] + sizes[1], len(features)
    if n <= task_rows:
        errors = dict(zip(settings, _in_tasks(plain, pairs, p, seed, rounds, patience, least)))
    else:
        members = [m for pair in pairs for m in pair]
        parts = max(FEW, -(-n // PART_ROWS))
        table = stage(plain.repartition(parts).withColumn("p", F.array(*[F.lit(m.base) for m in members])))
        errors = grow(members, Scans(table, parts, p, seed), p, seed, rounds, patience)

    found = []
    for columns in dict.fromkeys(s.columns for s in settings):
        own = [s for s in settings if s.columns == columns]
        best = min(own, key=lambda s: min(errors[s]))
        board = [(s.step, s.depth, s.least_rows, int(np.argmin(errors[s])), len(errors[s]) - 1, min(errors[s]), s == best) for s in own]
        twin = next(m for _, m in pairs if m.setting == best)
        found.append(Boosted(features, cuts, medians, twin.base, twin.trees[:max(least, int(np.argmin(errors[best])))], best, board))
    return found


def _columns(setting: Setting, p: int, seed: int, round_: int) -> np.ndarray:
    """The features a round may split on: a seeded share of the allowed ones, at least one."""
    own = np.arange(p) if setting.columns is None else np.array(setting.columns, int)
    n = max(1, round(COLUMN_SHARE * len(own)))
    return np.sort(np.random.default_rng([seed, round_]).permutation(own)[:n])


def board(model: Boosted, spark) -> DataFrame:
    """One row per setting: best round, rounds grown, validation error, chosen."""
    return spark.createDataFrame(model.board, "step double, depth int, least_rows int, best_round int, rounds int, val_rmse double, chosen boolean")
