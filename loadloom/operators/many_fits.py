"""Many clusterings of one table at once: k-means starts, subsample draws and mixtures share every scan.

A fit is an iteration over one aggregate. Here the parameters of all fits that still move are sent to the
tasks together (fits x clusters x columns, fixed by the settings), each task folds its rows into one sum per
cluster, and Spark adds the sums up. The number of scans is therefore that of the slowest fit, whatever the number of fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.sources.stage import stage

SLICE, SLICE_CELLS = 2048, 2_000_000
_MIX = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Spec:
    """One fit: clusters, start, and the subsample it sees (None: all rows)."""

    k: int
    start: int = 0
    draw: int | None = None


@dataclass
class Fit:
    """Centres and cost of a k-means fit; a mixture also has weights, variances and a log-likelihood per round."""

    spec: Spec
    centres: np.ndarray
    cost: float = np.inf
    rounds: int = 0
    weights: np.ndarray | None = None
    variances: np.ndarray | None = None
    likelihoods: list[float] = field(default_factory=list)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times diagonal normal density, rows x clusters."""
        v, m = self.variances, self.centres
        far = (x * x) @ (1 / v).T - 2 * x @ (m / v).T + (m * m / v).sum(1)
        return np.log(self.weights) - 0.5 * (far + np.log(v).sum(1) + x.shape[1] * np.log(2 * np.pi))

    def labels(self, x: np.ndarray) -> np.ndarray:
        """1-based cluster of each row: the nearest centre, or the largest posterior of a mixture; ties to the lower number."""
        if self.variances is not None:
            return self.log_density(x).argmax(1) + 1
        return ((self.centres ** 2).sum(1) - 2 * x @ self.centres.T).argmin(1) + 1


def prepared(df: DataFrame, key: str, features: str, draws: int = 0, fraction: float = 0.7, seed: int = DEFAULT.seed, keep: Sequence[str] = ()) -> DataFrame:
    """The written table (key, x, h, drawn, kept columns): h decides random picks, ``drawn`` the membership of every draw.

    Both are hashes of the key, so a repeated task sees the same ones. Rows with a null vector are left out.
    A row is a few hundred bytes and thousands of fits, so rows are dealt over all cores and not by their bytes.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    drawn = F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(seed * 1009 + b)), F.lit(100000)) < int(fraction * 100000) for b in range(draws)]).cast("array<boolean>")
    return stage(df.where(F.col(features).isNotNull()).select(
        key, F.col(features).cast("array<double>").alias("x"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), drawn.alias("drawn"), *keep).repartition(tasks, key))


def _matrix(column: pa.Array, kind: type = float) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind)
    return flat.reshape(len(column), -1) if flat.size else np.zeros((len(column), 0), kind)


def _slices(batches, names: Sequence[str], wide: int = 1):
    """Dicts of numpy columns, of at most ``SLICE`` rows and about ``SLICE_CELLS`` cells where a row needs ``wide`` of them."""
    rows = max(16, min(SLICE, SLICE_CELLS // max(1, wide)))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            cols = {n: part.column(part.schema.get_field_index(n)) for n in names}
            yield {n: _matrix(c, bool if n == "drawn" else float if n == "x" else np.int64) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for n, c in cols.items()}


def summed(table: DataFrame, columns: Sequence[str], slots: int, width: int, add: Callable[[dict, np.ndarray], None], wide: int | None = None) -> np.ndarray:
    """slots x width totals over all rows. ``add(rows, totals)`` folds a slice of rows in; a task returns one row per slot it met.

    ``wide`` is the number of cells that ``add`` needs for a row (by default one per slot).
    """
    names = [f"v{i}" for i in range(width)]

    def run(batches):
        totals = np.zeros((slots, width))
        for rows in _slices(batches, columns, slots if wide is None else wide):
            add(rows, totals)
        met = np.flatnonzero(totals.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(np.ascontiguousarray(totals[met, i])) for i in range(width))], ["slot", *names])

    out = np.zeros((slots, width))
    got = table.select(*columns).mapInArrow(run, "slot int, " + ", ".join(f"{n} double" for n in names))
    sums = got.groupBy("slot").sum(*names).toArrow()
    if sums.num_rows:
        out[sums.column(0).to_numpy()] = np.stack([sums.column(i + 1).to_numpy() for i in range(width)], 1)
    return out


def _uniform(h: np.ndarray, models: Sequence[int], step: int) -> np.ndarray:
    """A number in (0, 1) of every row and fit, rows x fits, fixed by the row's hash, the fit and the step."""
    salt = np.array([(int(m) * 1_000_003 + step + 1) * _MIX % 2**64 for m in models], np.uint64)
    z = h.view(np.uint64)[:, None] ^ salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _draws(specs: Sequence[Spec]) -> np.ndarray:
    return np.array([-1 if s.draw is None else s.draw for s in specs])


def _seen(rows: dict, draws: np.ndarray) -> np.ndarray:
    """Which rows each fit sees, rows x fits."""
    return np.concatenate([rows["drawn"], np.ones((len(rows["x"]), 1), bool)], 1)[:, draws]


def _fold(wide: np.ndarray, square: np.ndarray, seen: np.ndarray, centres: np.ndarray, span: np.ndarray) -> None:
    """Add every row to its nearest centre (ties to the lower number) of each fit that sees it.

    ``wide`` is a one and the row's values, ``centres`` clusters x (columns + 1) x fits, ``span`` the (cluster, fit) totals.
    A few rows at a time, so that the distances of all fits stay in the processor's cache.
    """
    k, _, m = centres.shape
    n = max(16, 40_000 // m)
    near, share = np.empty((k, min(n, len(wide)), m)), np.empty((min(n, len(wide)), m))
    for lo in range(0, len(wide), n):
        w = wide[lo:lo + n]
        d, part = near[:, :len(w)], share[:len(w)]
        for j in range(k):
            np.dot(w, centres[j], out=d[j])
        best = d.min(0)
        taken = ~seen[lo:lo + n]
        for j in range(k):
            own = d[j] == best
            own &= ~taken
            taken |= own
            part[:] = own
            sums = part.T @ w
            span[j * m:(j + 1) * m, 0] += sums[:, 0]
            span[j * m:(j + 1) * m, 2:] += sums[:, 1:]
        best += square[lo:lo + n]
        np.maximum(best, 0, out=best)
        best *= seen[lo:lo + n]
        span[:m, 1] += best.sum(0)


def _inside(rows: dict, spec: Spec) -> np.ndarray | slice:
    return slice(None) if spec.draw is None else rows["drawn"][:, spec.draw]


def first_centres(table: DataFrame, specs: Sequence[Spec]) -> list[np.ndarray]:
    """k-means++ centres of every fit; one scan per centre, for all fits.

    The next centre is the row with the smallest exponential draw divided by its squared distance to the
    centres so far, which picks rows with probability in proportion to that distance.
    """
    centres: list[list] = [[] for _ in specs]
    for step in range(max(s.k for s in specs)):
        open_ = [i for i, s in enumerate(specs) if s.k > step and len(centres[i]) == step]
        if not open_:
            break
        stack = np.stack([centres[i] for i in open_], 1).reshape(step * len(open_), -1) if step else None
        draws = _draws([specs[i] for i in open_])

        def race(batches, open_=np.array(open_), stack=stack, draws=draws, step=step):
            m = len(open_)
            late, least, at = np.full(m, 2), np.full(m, np.inf), [None] * m
            for rows in _slices(batches, ("x", "h", "drawn"), m * max(1, step)):
                x = rows["x"]
                square = (x * x).sum(1)
                e = -np.log(_uniform(rows["h"], open_, step))
                seen = _seen(rows, draws)
                spent = np.zeros(e.shape, bool)
                if step:
                    far = ((stack * stack).sum(1) - 2 * x @ stack.T).reshape(len(x), step, m).min(1)
                    far = np.maximum(0, far + square[:, None])
                    spent = far <= 1e-12 * (1 + square)[:, None]  # a row that is a centre already comes last
                    e = np.where(spent, e, e / np.where(spent, 1, far))
                fresh = np.where(seen & ~spent, e, np.inf)
                rank, value, row = np.zeros(m, int), fresh.min(0), fresh.argmin(0)
                none = np.flatnonzero(np.isinf(value))
                if len(none):
                    again = np.where(seen[:, none], e[:, none], np.inf)
                    rank[none], value[none], row[none] = 1, again.min(0), again.argmin(0)
                better = np.isfinite(value) & ((rank < late) | (rank == late) & (value < least))
                late[better], least[better] = rank[better], value[better]
                for i in np.flatnonzero(better).tolist():
                    at[i] = x[row[i]].tolist()
            some = [i for i in range(m) if at[i] is not None]
            if some:
                yield pa.RecordBatch.from_pylist([{"fit": int(open_[i]), "late": int(late[i]), "e": float(least[i]), "x": at[i]} for i in some],
                                                 pa.schema([("fit", pa.int32()), ("late", pa.int32()), ("e", pa.float64()), ("x", pa.list_(pa.float64()))]))

        picked = (table.select("x", "h", "drawn").mapInArrow(race, "fit int, late int, e double, x array<double>")
                  .groupBy("fit").agg(F.min_by("x", F.struct("late", "e", "x")).alias("x")).collect())
        for r in picked:
            centres[r["fit"]].append(r["x"])
    return [np.array(c, float) for c in centres]


def fit_kmeans(table: DataFrame, specs: Sequence[Spec], max_iter: int = 100, tol: float = 1e-4) -> list[Fit]:
    """Lloyd's iterations of all fits together on a ``prepared`` table, until no centre moves by more than ``tol``.

    An empty cluster keeps its centre; a fit on fewer distinct rows than clusters repeats centres; no rows give no centres.
    """
    fits = [Fit(s, c) for s, c in zip(specs, first_centres(table, specs))]
    moving = [f for f in fits if len(f.centres)]
    for step in range(max_iter):
        if not moving:
            break
        d, blocks, at = moving[0].centres.shape[1], [], 0
        for k in sorted({len(f.centres) for f in moving}):  # fits of equal k are one block of clusters x fits
            same = [f for f in moving if len(f.centres) == k]
            blocks.append((at, k, same))
            at += k * len(same)
        sent = []
        for lo, k, same in blocks:
            c = np.stack([f.centres for f in same], 2)  # clusters x columns x fits
            sent.append((lo, np.concatenate([(c * c).sum(1, keepdims=True), -2 * c], 1), _draws([f.spec for f in same])))

        def add(rows, totals, sent=sent):
            x = rows["x"]
            wide = np.concatenate([np.ones((len(x), 1)), x], 1)
            for lo, centres, draws in sent:
                k, _, m = centres.shape
                _fold(wide, (x * x).sum(1)[:, None], _seen(rows, draws), centres, totals[lo:lo + k * m])

        got = summed(table, ("x", "drawn"), at, d + 2, add, len(moving))
        still = []
        for lo, k, same in blocks:
            for i, f in enumerate(same):
                t = got[lo + i:lo + k * len(same):len(same)]
                f.cost, f.rounds = float(t[:, 1].sum()), step + 1
                moved = np.where(t[:, :1] > 0, t[:, 2:] / np.maximum(t[:, :1], 1), f.centres)
                if ((moved - f.centres) ** 2).sum(1).max() > tol * tol:
                    f.centres = moved
                    still.append(f)
        moving = still
    return fits


def cheapest(fits: Sequence[Fit]) -> dict[tuple[int, int | None], Fit]:
    """The start of least cost of every (k, draw)."""
    best: dict = {}
    for f in fits:
        at = (f.spec.k, f.spec.draw)
        if at not in best or f.cost < best[at].cost:
            best[at] = f
    return best


def fit_mixtures(table: DataFrame, starts: Sequence[Fit], max_iter: int = 60, tol: float = 1e-6, floor: float = 1e-6) -> list[Fit]:
    """Diagonal Gaussian mixtures by expectation-maximisation from k-means fits, one aggregate per round for all of them.

    A start's clusters give the first weights, means and variances. A mixture ends when its log-likelihood grows by
    less than ``tol`` of itself; variances stay above ``floor``. ``cost`` is the Bayesian information criterion (less is better).
    """
    fits = [Fit(f.spec, f.centres) for f in starts]
    moving = [f for f in fits if len(f.centres)]
    rows_of = np.zeros(len(fits))
    at = {id(f): i for i, f in enumerate(fits)}
    for step in range(max_iter + 1):
        if not moving:
            break
        first = np.cumsum([0, *(len(f.centres) for f in moving)])
        d = moving[0].centres.shape[1]

        def add(rows, totals, now=tuple(moving), first=first):
            x = rows["x"]
            for i, f in enumerate(now):
                part = x[_inside(rows, f.spec)]
                if f.variances is None:
                    r, like = np.eye(len(f.centres))[f.labels(part) - 1], 0.0
                else:
                    z = f.log_density(part)
                    top = z.max(1, keepdims=True) if len(z) else z
                    r = np.exp(z - top)
                    each = r.sum(1, keepdims=True)
                    like, r = float((top + np.log(each)).sum()), r / each
                span = totals[first[i]:first[i + 1]]
                span[:, 0] += r.sum(0)
                span[0, 1] += like
                span[:, 2:2 + d] += r.T @ part
                span[:, 2 + d:] += r.T @ (part * part)

        got = summed(table, ("x", "drawn"), int(first[-1]), 2 + 2 * d, add)
        still = []
        for i, f in enumerate(moving):
            t = got[first[i]:first[i + 1]]
            n = t[:, 0].sum()
            rows_of[at[id(f)]] = n
            if f.variances is not None:
                f.likelihoods.append(float(t[0, 1]))
                f.rounds = step
                if step == max_iter or len(f.likelihoods) > 1 and f.likelihoods[-1] - f.likelihoods[-2] <= tol * abs(f.likelihoods[-2]):
                    continue
            some = np.maximum(t[:, :1], 1e-300)
            kept = t[:, :1] > 1e-9
            mean = np.where(kept, t[:, 2:2 + d] / some, f.centres)
            spread = np.where(kept, t[:, 2 + d:] / some - mean * mean, 1.0)
            f.weights, f.centres, f.variances = np.maximum(t[:, 0] / max(n, 1), 1e-12), mean, np.maximum(spread, floor)
            still.append(f)
        moving = still
    for i, f in enumerate(fits):
        if f.likelihoods:
            free = len(f.centres) - 1 + 2 * f.centres.size
            f.cost = -2 * f.likelihoods[-1] + free * np.log(max(rows_of[i], 1))
    return fits


def label_all(table: DataFrame, fits: Sequence[Fit], key: str) -> DataFrame:
    """(key, x, drawn, labels): the 1-based cluster of every row in every fit, as one array per row, written once."""
    kind = dict(table.dtypes)[key]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                x = _matrix(part.column(1))
                labels = np.stack([f.labels(x) for f in fits], 1).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, len(fits), dtype=np.int32)), pa.array(labels.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), flat], [key, "x", "drawn", "labels"])

    return stage(table.select(key, "x", "drawn").mapInArrow(run, f"{key} {kind}, x array<double>, drawn array<boolean>, labels array<int>"))


def posteriors(table: DataFrame, fit: Fit, key: str) -> DataFrame:
    """(key, cluster, posterior): the class of every row in a mixture and its share of the density."""
    kind = dict(table.dtypes)[key]

    def run(batches):
        for b in batches:
            z = fit.log_density(_matrix(b.column(1)))
            p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((z.argmax(1) + 1).astype(np.int32)), pa.array(p.max(1) / p.sum(1))], [key, "cluster", "posterior"])

    return table.select(key, "x").mapInArrow(run, f"{key} {kind}, cluster int, posterior double")


def all_indices(labelled: DataFrame, ks: Sequence[int]) -> list[dict]:
    """Size extremes, balance entropy and internal indices of every labelling, by three scans for all of them.

    The indices are those of ``clusters.internal_indices``: over all rows, from per-cluster moments. Clusters without rows do not count.
    """
    first = np.cumsum([0, *ks])
    slots = int(first[-1])
    width = len((labelled.select("x").first() or [[]])[0])
    if not width:
        return []

    def owners(rows):
        own = first[:-1] + rows["labels"] - 1
        out = np.zeros((len(own), slots))
        out[np.arange(len(own))[:, None], own] = 1
        return out

    def moments(rows, totals):
        o = owners(rows)
        totals[:, 0] += o.sum(0)
        totals[:, 1:] += o.T @ rows["x"]

    got = summed(labelled, ("x", "labels"), slots, width + 1, moments)
    n = got[:, 0]
    centre = got[:, 1:] / np.maximum(n, 1)[:, None]

    def far(rows):
        return np.maximum(0, (rows["x"] ** 2).sum(1)[:, None] - 2 * rows["x"] @ centre.T + (centre ** 2).sum(1))

    def spread(rows, totals):
        own = first[:-1] + rows["labels"] - 1
        for j in range(own.shape[1]):
            d2 = ((rows["x"] - centre[own[:, j]]) ** 2).sum(1)
            totals[:, 0] += np.bincount(own[:, j], np.sqrt(d2), slots)
            totals[:, 1] += np.bincount(own[:, j], d2, slots)

    s, w = summed(labelled, ("x", "labels"), slots, 2, spread).T
    s = s / np.maximum(n, 1)

    def shapes(rows, totals):
        mean = np.where(n > 0, far(rows) + w / np.maximum(n, 1), np.inf)
        for j in range(len(ks)):
            part, own = mean[:, first[j]:first[j + 1]].copy(), rows["labels"][:, j] - 1
            at = np.arange(len(own))
            size = n[first[j] + own]
            inner = part[at, own] * size / np.maximum(size - 1, 1)
            part[at, own] = np.inf
            outer = part.min(1)
            top = np.maximum(inner, outer)
            ok = (size > 1) & np.isfinite(outer) & (top > 0)
            totals[j, 0] += np.where(ok, (outer - inner) / np.where(ok, top, 1), 0.0).sum()
            totals[j, 1] += len(own)

    sums = summed(labelled, ("x", "labels"), len(ks), 2, shapes)
    out = []
    for j in range(len(ks)):
        span = np.flatnonzero(n[first[j]:first[j + 1]]) + first[j]
        total, k = float(n[span].sum()), len(span)
        c = centre[span]
        grand = (c * n[span, None]).sum(0) / total
        between = float((n[span] * ((c - grand) ** 2).sum(1)).sum())
        within = float(w[span].sum())
        gap = np.sqrt(((c[:, None] - c) ** 2).sum(2))
        np.fill_diagonal(gap, np.inf)
        share = n[span] / total
        pct = np.round(100 * share, 2)
        out.append({
            "n_clusters": k, "n_rows": int(total),
            "calinski_harabasz": between / (k - 1) / (within / (total - k)) if k > 1 and total > k and within > 0 else None,
            "davies_bouldin": float(((s[span, None] + s[span]) / gap).max(1).mean()) if k > 1 and (gap > 0).all() else None,
            "silhouette": float(sums[j, 0] / sums[j, 1]), "dunn": float(gap.min() / (2 * s[span].max())) if k > 1 and s[span].max() > 0 else None,
            "min_pct": float(pct.min()), "max_pct": float(pct.max()), "balance_entropy": float(-(share * np.log(share)).sum() / np.log(k)) if k > 1 else 0.0})
    return out


def draw_overlaps(labelled: DataFrame, pairs: Sequence[tuple[int, int, int, int, int]]) -> list[dict]:
    """Best Jaccard overlap of each reference cluster with any cluster of a refit, on the rows of the refit's draw; one scan for all.

    ``pairs`` holds (reference labelling, its k, refit labelling, its k, draw) by position in ``labels`` and ``drawn``.
    """
    first = np.cumsum([0, *(a * b for _, a, _, b, _ in pairs)])

    def count(rows, totals):
        for i, (ref, _, new, k, draw) in enumerate(pairs):
            inside = rows["drawn"][:, draw]
            a, b = rows["labels"][inside, ref] - 1, rows["labels"][inside, new] - 1
            totals[first[i]:first[i + 1], 0] += np.bincount(a * k + b, minlength=first[i + 1] - first[i])

    got = summed(labelled, ("labels", "drawn"), int(first[-1]), 1, count, len(pairs))[:, 0]
    out = []
    for i, (ref, ka, _, kb, draw) in enumerate(pairs):
        table = got[first[i]:first[i + 1]].reshape(ka, kb)
        na, nb = table.sum(1), table.sum(0)
        either = na[:, None] + nb - table
        best = np.where(either > 0, table / np.maximum(either, 1), 0).max(1)
        out += [{"reference": ref, "draw": draw, "cluster": c + 1, "n": int(na[c]), "jaccard": float(best[c])} for c in range(ka) if na[c] >= 2]
    return out


def stability(overlaps: Sequence[dict]) -> dict[int, dict[int, tuple[float, int]]]:
    """Reference labelling -> cluster -> (mean Jaccard over the draws, draws)."""
    seen: dict[int, dict[int, list[float]]] = {}
    for o in overlaps:
        seen.setdefault(o["reference"], {}).setdefault(o["cluster"], []).append(o["jaccard"])
    return {r: {c: (float(np.mean(v)), len(v)) for c, v in of.items()} for r, of in seen.items()}
