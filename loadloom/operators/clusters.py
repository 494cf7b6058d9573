"""Cluster fitting, validation, stability and selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.operators.ranks import percentiles, top_k_per_group
from loadloom.sources.stage import stage


def fit_clusters(df: DataFrame, algo: str, k: int, features="pcs", seed=DEFAULT.seed, starts=3):
    """Labels (1-based column ``cluster``) and the fitted model.

    ``kmeans`` keeps the cheapest of several seeded k-means|| starts,
    ``bisecting`` is the scalable hierarchical method and ``gmm`` labels by the
    largest posterior (full covariance).
    """
    vec = df.withColumn("_x", array_to_vector(F.col(features)))
    common = {"featuresCol": "_x", "predictionCol": "_p", "k": k}
    # Inputs are cached once for all starts and iterations.
    cached = vec.select("_x").persist()
    if algo == "kmeans":
        models = [KMeans(seed=seed + k + 1000 * s, maxIter=100, **common).fit(cached) for s in range(starts)]
        model = min(models, key=lambda m: m.summary.trainingCost)
    elif algo == "bisecting":
        model = BisectingKMeans(seed=seed + 200 + k, **common).fit(cached)
    elif algo == "gmm":
        model = GaussianMixture(seed=seed + 300 + k, maxIter=50, **common).fit(cached)
    else:
        raise ValueError(f"unknown algorithm {algo!r}")
    cached.unpersist()
    labelled = model.transform(vec).withColumn("cluster", (F.col("_p") + 1).cast("int"))
    return labelled.select(*df.columns, "cluster"), model


def centroids(df: DataFrame, features: str, label="cluster") -> DataFrame:
    """Mean vector and size per cluster, from per-dimension partial sums."""
    long = df.select(label, F.posexplode(features).alias("_j", "_v"))
    dims = long.groupBy(label, "_j").agg(F.avg("_v").alias("_m"), F.count("_v").alias("_n"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("_j", "_m"))), lambda x: x["_m"])
    return dims.groupBy(label).agg(arr.alias("centroid"), F.max("_n").alias("size"))


def _sq(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> (double(p) - double(q)) * (double(p) - double(q))), 0D, (s, v) -> s + v)"


def assign_nearest(df: DataFrame, cents: DataFrame, features: str, label="cluster") -> DataFrame:
    """Nearest centroid by distance (smallest label on ties): O(n k), never a distance matrix."""
    packed = cents.agg(F.collect_list(F.struct(F.col(label).alias("id"), "centroid")).alias("_c"))
    best = f"array_min(transform(_c, c -> struct({_sq(features, 'c.centroid')} AS d, c.id AS id)))"
    return (df.crossJoin(F.broadcast(packed)).withColumn("_b", F.expr(best))
            .withColumn(label, F.col("_b.id")).withColumn("distance", F.sqrt("_b.d")).drop("_c", "_b"))


def centroid_distance(df: DataFrame, features: str, label="cluster", out="distance") -> DataFrame:
    """Distance of every row to the centroid of its own cluster (the centroids are one packed row)."""
    packed = centroids(df, features, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "centroid"))).alias("_c"))
    return (df.crossJoin(F.broadcast(packed))
            .withColumn(out, F.expr(f"sqrt({_sq(features, f'_c[{label}]')})")).drop("_c"))


def anomalies(df: DataFrame, label="cluster", distance="distance", p=0.95) -> DataFrame:
    """Rows beyond the exact percentile of distance within their cluster."""
    cut = percentiles(df.select(label, distance), distance, {"limit": p}, by=[label])
    return (df.join(F.broadcast(cut), label).withColumn("is_anomalous", F.col(distance) > F.col("limit")))


def anomaly_share(df: DataFrame, cols: Sequence[str], label="cluster", p=0.95, digits=9) -> DataFrame:
    """Percentage of each cluster's rows that lie beyond the percentile of distance to its centroid; rows with a null take no part."""
    full = df.dropna(subset=[label, *cols]).select(label, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    d = centroid_distance(full, "_x", label).withColumn("distance", F.round("distance", digits)).drop("_x")
    return anomalies(stage(d), label, p=p).groupBy(label).agg((100 * F.avg(F.col("is_anomalous").cast("int"))).alias("anomaly_pct"))


def representatives(df: DataFrame, label="cluster", distance="distance", key="user_id", k=3) -> DataFrame:
    """The ``k`` rows nearest to their centroid; each task first keeps its own best ``k`` per cluster."""
    return top_k_per_group(df, [label], [F.col(distance), F.col(key)], k, "representative_rank")


def internal_indices(df: DataFrame, features: str, label="cluster") -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin, silhouette and Dunn over all rows, O(n k), from per-cluster moments.

    The silhouette uses squared distances, whose mean from a row to a cluster is the squared distance
    to its centroid plus the cluster's mean squared spread; a row alone in its cluster counts 0. Dunn is
    the smallest distance of two centroids over the largest diameter, taken as twice the mean
    distance to the centroid. Only one packed row of cluster moments is broadcast.
    """
    d = centroid_distance(df, features, label, "_d")
    spread = d.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("s"), F.sum(F.col("_d") ** 2).alias("w"))
    packed = spread.join(centroids(df, features, label), label).agg(
        F.collect_list(F.struct(F.col(label).alias("id"), "n", "s", "w", "centroid")).alias("g"))
    grand = ("transform(g[0].centroid, (x, j) -> aggregate(g, 0D, (a, c) -> a + c.n * c.centroid[j]) / "
             "aggregate(g, 0L, (a, c) -> a + c.n))")
    p = packed.selectExpr("g", f"{grand} AS m", "size(g) AS k", "aggregate(g, 0L, (a, c) -> a + c.n) AS n")
    between = f"aggregate(g, 0D, (a, c) -> a + c.n * {_sq('c.centroid', 'm')})"
    within = "aggregate(g, 0D, (a, c) -> a + c.w)"
    apart = f"sqrt({_sq('a.centroid', 'b.centroid')})"
    worst = f"array_max(transform(g, b -> (a.s + b.s) / nullif({apart}, 0D)))"
    nearest = f"array_min(transform(filter(g, b -> b.id <> a.id), b -> {apart}))"
    one = p.selectExpr("k AS n_clusters", "n AS n_rows",
                       f"try_divide({between} / nullif(k - 1, 0), {within} / nullif(n - k, 0)) AS calinski_harabasz",
                       f"aggregate(transform(g, a -> {worst}), 0D, (s, v) -> s + v) / k AS davies_bouldin",
                       f"try_divide(array_min(transform(g, a -> {nearest})), array_max(transform(g, a -> 2 * a.s))) AS dunn")
    means = f"transform(g, c -> struct(c.id AS id, c.n AS n, {_sq(features, 'c.centroid')} + c.w / c.n AS d))"
    per_row = (df.select(label, features).crossJoin(F.broadcast(packed)).select(label, F.expr(means).alias("_m"))
               .selectExpr(f"filter(_m, c -> c.id = {label})[0] AS own", f"array_min(transform(filter(_m, c -> c.id <> {label}), c -> c.d)) AS outer")
               .selectExpr("own.n AS n", "own.d * own.n / nullif(own.n - 1, 0) AS inner", "outer"))
    silhouette = per_row.agg(F.expr(
        "avg(CASE WHEN n > 1 AND outer IS NOT NULL AND greatest(inner, outer) > 0 THEN (outer - inner) / greatest(inner, outer) ELSE 0D END)").alias("silhouette"))
    return one.crossJoin(silhouette)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from contingency counts."""
    c = contingency(df, a, b)
    pairs = "sum(n * (n - 1) / 2D)"
    both = c.agg(F.expr(f"{pairs} AS ij"), F.expr("sum(n) AS t"))
    rows = c.groupBy("a").agg(F.sum("n").alias("n")).agg(F.expr(f"{pairs} AS ra"))
    cols = c.groupBy("b").agg(F.sum("n").alias("n")).agg(F.expr(f"{pairs} AS rb"))
    one = both.crossJoin(rows).crossJoin(cols).selectExpr("ij", "ra", "rb", "try_divide(ra * rb, t * (t - 1) / 2D) AS e", "t")
    return one.selectExpr("t AS n", "try_divide(ij - e, (ra + rb) / 2 - e) AS ari")


def jaccard_by_cluster(df: DataFrame, ref: str, new: str) -> DataFrame:
    """Best Jaccard overlap of each reference cluster with any new cluster."""
    c = contingency(df, ref, new)
    ra = c.groupBy("a").agg(F.sum("n").alias("na"))
    rb = c.groupBy("b").agg(F.sum("n").alias("nb"))
    j = c.join(F.broadcast(ra), "a").join(F.broadcast(rb), "b")
    return j.groupBy(F.col("a").alias(ref)).agg(F.max(F.expr("n / (na + nb - n)")).alias("jaccard"), F.max("na").alias("n"))


def subsample(df: DataFrame, key: str, fraction: float, draw: int, seed: int) -> DataFrame:
    """Repeatable subsample without replacement, decided by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed * 1009 + draw)), F.lit(100000)) < int(fraction * 100000))


def bootstrap_jaccard(df: DataFrame, fit: Callable[[DataFrame], DataFrame], label="cluster", key="user_id", draws=30,
                      fraction=0.7, seed=DEFAULT.seed) -> DataFrame:
    """Mean best Jaccard per reference cluster over refits on subsamples.

    ``fit`` maps a table to the same table with a column ``refit``.
    """
    out = None
    for b in range(draws):
        refit = fit(subsample(df, key, fraction, b, seed))
        j = jaccard_by_cluster(refit, label, "refit").where(F.col("n") >= 2).withColumn("draw", F.lit(b))
        out = j if out is None else out.unionByName(j)
    return out.groupBy(label).agg(F.avg("jaccard").alias("mean_jaccard"), F.count(F.lit(1)).alias("n_draws"))


def cluster_balance(df: DataFrame, label="cluster", by: Sequence[str] = ()) -> DataFrame:
    """Number of clusters, size extremes in percent, small and large counts, and balance entropy."""
    by = list(by)
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # one row per cluster
    p = n.withColumn("share", F.col("n") / total).withColumn("pct", F.round(F.lit(100.0) * F.col("share"), 2))
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"),
        F.count_if(F.col("pct") < 3).alias("n_below_3pct"), F.count_if(F.col("pct") > 60).alias("n_above_60pct"),
        F.when(F.count(F.lit(1)) > 1, F.try_divide(-F.sum(F.col("share") * F.ln("share")), F.ln(F.count(F.lit(1)))))
        .otherwise(F.lit(0.0)).alias("balance_entropy"))


def leaderboard(df: DataFrame, cfg=DEFAULT) -> DataFrame:
    """Balance penalty, pass flags and composite score of candidate solutions, best first."""
    penalty = "greatest(0D, (max_pct - 50) / 50)"
    return df.selectExpr(
        "*", f"{penalty} AS balance_penalty",
        f"coalesce(silhouette >= {cfg.min_silhouette}, false) AS passes_silhouette",
        f"coalesce(mean_jaccard >= {cfg.min_jaccard}, false) AS passes_jaccard",
        f"coalesce(min_pct >= {cfg.min_pct}, false) AS passes_min_pct",
        f"coalesce(max_pct <= {cfg.max_pct}, false) AS passes_max_pct",
        f"""CASE WHEN silhouette IS NOT NULL AND mean_jaccard IS NOT NULL THEN
            round(0.45D * least(silhouette / 0.4D, 1D) + 0.35D * least(mean_jaccard / 0.9D, 1D) + 0.2D * (1 - {penalty}), 3)
            END AS composite_score""").selectExpr(
        "*", "passes_silhouette AND passes_jaccard AND passes_min_pct AND passes_max_pct AS passes_all").orderBy(
        F.desc("passes_all"), F.desc_nulls_last("composite_score"), F.desc_nulls_last("silhouette"), "solution")


def select_solution(board: DataFrame, tiers: Sequence[str] = (
        "passes_all", "passes_jaccard AND passes_max_pct", "true")) -> DataFrame:
    """Best row of the first tier that is not empty."""
    tier = "CASE " + " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(tiers)) + " END"
    return (board.withColumn("tier", F.expr(tier)).where("tier IS NOT NULL")
            .orderBy("tier", F.desc_nulls_last("composite_score"), F.desc_nulls_last("silhouette"), "solution").limit(1))


def weighted_rank_selection(df: DataFrame, min_pct=10.0, max_pct=75.0, weights=None) -> DataFrame:
    """Weighted sum of min-tie ranks over the candidates of the first feasible relaxation.

    Candidates are one row per solution (tens), hence the single-window ranks.
    """
    w = weights or DEFAULT.score_weights
    tests = (f"min_pct >= {min_pct} AND max_pct <= {max_pct}", "max_pct < 50", f"max_pct <= {max_pct}", "true")
    tier = "CASE " + " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(tests)) + " END"
    t = df.withColumn("tier", F.expr(tier))
    best = t.withColumn("_best", F.min("tier").over(Window.partitionBy()))
    # A relaxation takes every row that passes its test, not only those failing the stricter ones.
    passes = "CASE _best " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(tests)) + " END"
    c = best.where(F.expr(passes))
    rank = {n: F.rank().over(Window.orderBy(F.desc_nulls_last(col))) for n, col in (
        ("r_silhouette", "silhouette"), ("r_ch", "calinski_harabasz"), ("r_dunn", "dunn"), ("r_balance", "balance_entropy"))}
    c = c.withColumns(rank)
    score = (w["silhouette"] * F.col("r_silhouette") + w["calinski_harabasz"] * F.col("r_ch")
             + w["dunn"] * F.col("r_dunn") + w["balance"] * F.col("r_balance"))
    return c.withColumn("score", F.round(score, 6)).drop("_best").orderBy("score", "solution")


def label_table(labels: DataFrame, solution: str, algo: str, k: int, rule_rows: DataFrame | None = None,
                key="user_id", keep: Sequence[str] = ()) -> DataFrame:
    """Final label table; rows of the rule segment are appended as cluster -1."""
    a = labels.select(key, *keep, F.col("cluster").cast("int").alias("cluster"), F.lit(solution).alias("solution"),
                      F.lit(algo).alias("algo"), F.lit(k).alias("k"))
    if rule_rows is None:
        return a
    b = rule_rows.select(key, *keep, F.lit(-1).alias("cluster"), F.lit("rule_segment").alias("solution"),
                         F.lit("rule").alias("algo"), F.lit(k).alias("k"))
    return a.unionByName(b)


def cluster_label(col="cluster"):
    return F.expr(f"CASE WHEN {col} = 0 THEN 'noise' WHEN {col} = -1 THEN 'irregular_home' ELSE concat('C', {col}) END")
