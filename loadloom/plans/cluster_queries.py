"""Scaling, components, clusterings, validation, selection and segment descriptions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.functions import columns as C
from loadloom.operators import clusters, features, many_fits, matrix, reports, segments, solutions
from loadloom.operators.ranks import scaled_ranks as rank_columns
from loadloom.plans import roles as R
from loadloom.plans.feature_queries import context
from loadloom.plans.forecast_queries import assessment
from loadloom.plans.registry import query
from loadloom.plans.roles_sql import ROLES
from loadloom.sources.stage import stage

ROLES["r_seg"] = """
    SELECT s.*, d.* EXCLUDE (user_id), l.cluster, u.province, u.p1_kw, coalesce(g.coastal_flag, FALSE) AS coastal_flag,
      CASE WHEN u.activity IS NOT NULL AND CAST(CAST(activity AS DOUBLE) AS INTEGER) >= 100 THEN
        CAST(substr(lpad(CAST(CAST(CAST(activity AS DOUBLE) AS INTEGER) AS VARCHAR), 4, '0'), 1, 1) AS INTEGER) END AS activity_group
    FROM r_f_shape s JOIN r_f_daily d USING (user_id) JOIN r_labels l USING (user_id) JOIN r_user u USING (user_id)
    LEFT JOIN r_context g ON g.province = u.province"""
ROLES["r_vec"] = "SELECT vec_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
ROLES["r_cent"] = """SELECT cluster, list(m ORDER BY j) AS c, max(n) AS size FROM (SELECT cluster, j, avg(v) AS m, count(*) AS n FROM
    (SELECT cluster, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM r_vec) GROUP BY ALL) GROUP BY cluster"""
ROLES["r_near"] = """SELECT vec_id, v.cluster AS given, k.cluster AS cluster, round(list_distance(x, c), 6) AS distance FROM r_vec v, r_cent k
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(x, c), k.cluster) = 1"""
ROLES["r_own"] = "SELECT vec_id, v.cluster, list_distance(x, c) AS distance FROM r_vec v JOIN r_cent k USING (cluster)"

SCALARS = ["mean_daily_kwh", "median_daily_kwh", "cv_daily", "ratio_night_day", "ratio_weekend_weekday", "peak_share", "valley_share",
           "flat_share", "seasonal_amplitude_norm", "low_day_rate", "zero_day_rate", "morning_share", "night_share", "peak_hour"]


def seg(spark, sf):
    shape = features.shape_features(features.hour_cells(R.meter(spark, sf)))
    users = R.user_dimension(spark, sf).select("user_id", "province", "p1_kw", "activity")
    code = C.activity_code("activity")
    users = users.withColumn("activity_group", F.when(code.cast("int") >= 100, F.substring(code, 1, 1).cast("int"))).drop("activity")
    ctx = context(spark, sf).select("province", "coastal_flag")
    # User grain: written once, since profiles, bands and ranks each pass over it.
    return stage(shape.join(features.daily_stats(R.daily(spark, sf), full=1), "user_id").join(R.labels(spark, sf), "user_id")
                 .join(users, "user_id").join(ctx, "province", "left").fillna(False, ["coastal_flag"]))


def vectors(spark, sf):
    return R.table(spark, sf, "embeddings").selectExpr("vec_id", "label AS cluster", "cast(embedding as array<double>) AS x")


def _round(df, digits=8):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_MX = ["mean_daily_kwh", "cv_daily", "peak_share", "valley_share", "ratio_night_day", "summer_winter_ratio", "beta_hdd_norm"]
_MX_BASE = "SELECT user_id, mean_daily_kwh, cv_daily, peak_share, valley_share, ratio_night_day, summer_winter_ratio, CASE WHEN user_id % 5 <> 0 THEN beta_hdd_norm END AS beta_hdd_norm FROM r_f_shape JOIN r_f_daily USING (user_id) JOIN r_f_month USING (user_id) LEFT JOIN r_f_ols USING (user_id)"


def _mx(spark, sf):
    d = stage(R.daily(spark, sf))
    shape = features.shape_features(features.hour_cells(R.meter(spark, sf))).select("user_id", "peak_share", "valley_share", "ratio_night_day")
    betas = features.ols2(R.panel(spark, sf, d), "user_id", "daily_kwh", "hdd", "cdd").select("user_id", "beta_hdd_norm")
    return stage(shape.join(features.daily_stats(d, full=1).select("user_id", "mean_daily_kwh", "cv_daily"), "user_id")
                 .join(features.monthly_behaviour(d, full=1).select("user_id", "summer_winter_ratio"), "user_id").join(betas, "user_id", "left")
                 .withColumn("beta_hdd_norm", F.when(F.col("user_id") % 5 != 0, F.col("beta_hdd_norm"))))


_W = {"mean_daily_kwh": 1.0, "cv_daily": 1.6, "peak_share": 1.6, "valley_share": 1.6, "ratio_night_day": 1.6, "summer_winter_ratio": 1.6,
      "beta_hdd_norm": 2.0}


def _matrix_sql():
    ctes = [f"b AS ({_MX_BASE})", "f AS (SELECT user_id, " + ", ".join(
        f"coalesce({c}, (SELECT coalesce(median({c}), 0) FROM b)) AS {c}" for c in _MX) + " FROM b)"]
    ctes.append("q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _MX) + " FROM f)")
    ctes.append("w AS (SELECT user_id, " + ", ".join(f"least(greatest({c}, {c}_lo), {c}_hi) AS {c}" for c in _MX) + " FROM f, q)")
    ctes.append("s AS (SELECT " + ", ".join(f"median({c}) AS {c}_m, 1.4826 * mad({c}) AS {c}_s, stddev_samp({c}) AS {c}_d" for c in _MX) + " FROM w)")
    cols = ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_s > 0 THEN {c}_s WHEN {c}_d > 0 THEN {c}_d ELSE 1 END * {_W[c]}, 6) AS {c}" for c in _MX)
    return "WITH " + ", ".join(ctes) + f" SELECT user_id, {cols} FROM w, s"


@query("robust_matrix", "I1 I2", _matrix_sql())
def robust_matrix(spark, sf):
    return _round(matrix.robust_matrix(_mx(spark, sf), _MX, weights=_W), 6)


@query("one_hot_context", "I3")
def one_hot_context(spark, sf):
    s = R.user_dimension(spark, sf).select("user_id", "tariff_clean", "province")
    return matrix.one_hot(s, ["tariff_clean", "province"])


def _components(spark, sf):
    base = _mx(spark, sf)
    return matrix.pca(matrix.robust_matrix(base, _MX, weights=_W), _MX, kmin=3, kmax=6)


@query("principal_components", "I4")
def principal_components(spark, sf):
    df, model = _components(spark, sf)
    return df.select("user_id", F.transform("pcs", lambda x: F.round(x, 6)).alias("pcs"))


@query("functional_components", "I5")
def functional_components(spark, sf):
    shape = features.shape_features(features.hour_cells(R.meter(spark, sf))).select("user_id", *features.HOUR_COLUMNS).fillna(0.0)
    df, model = matrix.pca(shape, features.HOUR_COLUMNS, kmin=4, kmax=4, out="fpc")
    return df.select("user_id", "fpc")


def _fit_query(algo, k):
    def build(spark, sf):
        labels, _ = clusters.fit_clusters(vectors(spark, sf).drop("cluster"), algo, k, features="x")
        return labels.select("vec_id", "cluster")
    return build


@query("kmeans", "I6")
def kmeans(spark, sf):
    """Labels at the number of clusters of the configured range with the largest silhouette; 25 starts for each."""
    c = solutions.search(vectors(spark, sf), "vec_id", "x", "raw", algos=("kmeans",))
    best = max(c.rows, key=lambda r: (r["silhouette"], -r["k"]))
    return solutions.labels_of([c], best["solution"], "vec_id")


query("bisecting_kmeans", "I9")(_fit_query("bisecting", 4))


def vector_components(spark, sf):
    """All retained principal components of the vectors."""
    v = vectors(spark, sf)
    cols = [f"x{i}" for i in range(v.agg(F.max(F.size("x"))).first()[0] or 0)]
    base, _ = matrix.pca(v.select("vec_id", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)]), cols)
    return base.select("vec_id", "pcs")


@query("gaussian_mixture", "I7")
def gaussian_mixture(spark, sf):
    """Class and posterior of the diagonal mixture with the least information criterion over the configured range of k."""
    t = many_fits.prepared(vector_components(spark, sf), "vec_id", "pcs")
    starts = many_fits.cheapest(many_fits.fit_kmeans(t, [many_fits.Spec(k, s) for k in DEFAULT.k_range for s in range(solutions.STARTS)]))
    best = min(many_fits.fit_mixtures(t, list(starts.values())), key=lambda f: f.cost)
    return many_fits.posteriors(t, best, "vec_id")


@query("nearest_centroid", "I8", "SELECT vec_id, cluster, distance FROM r_near")
def nearest_centroid(spark, sf):
    v = vectors(spark, sf)
    near = clusters.assign_nearest(v.drop("cluster"), clusters.centroids(v, "x"), "x")
    return near.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("adjusted_rand_index", "I12", """
    WITH c AS (SELECT given AS a, cluster AS b, count(*) AS n FROM r_near GROUP BY ALL),
    t AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS ij, (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM c GROUP BY a)) AS ra,
      (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM c GROUP BY b)) AS rb, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n)
    SELECT n, round((ij - ra * rb / (n * (n - 1) / 2.0)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2.0)), 8) AS ari FROM t""")
def adjusted_rand_index(spark, sf):
    v = vectors(spark, sf)
    near = clusters.assign_nearest(v.withColumnRenamed("cluster", "given"), clusters.centroids(v, "x"), "x")
    return _round(clusters.ari(near, "given", "cluster"))


@query("internal_indices", "I10", """
    WITH own AS (SELECT cluster, count(*) AS n, avg(distance) AS s, sum(distance * distance) AS w FROM r_own GROUP BY cluster),
    m AS (SELECT list(v ORDER BY j) AS g FROM (SELECT j, avg(v) AS v FROM (SELECT unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM r_vec) GROUP BY j)),
    ch AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * list_distance(c, g) ** 2) AS b, sum(w) AS w FROM own JOIN r_cent USING (cluster), m),
    db AS (SELECT avg(r) AS db FROM (SELECT a.cluster, max((oa.s + ob.s) / list_distance(a.c, b.c)) AS r FROM r_cent a JOIN r_cent b ON a.cluster <> b.cluster
       JOIN own oa ON oa.cluster = a.cluster JOIN own ob ON ob.cluster = b.cluster GROUP BY a.cluster)),
    p AS (SELECT a.vec_id, a.cluster AS ca, b.cluster AS cb, list_distance(a.x, b.x) ** 2 AS d, a.vec_id = b.vec_id AS self FROM r_vec a, r_vec b),
    g AS (SELECT vec_id, ca, cb, avg(d) FILTER (WHERE NOT self) AS m FROM p GROUP BY ALL),
    sil AS (SELECT vec_id, max(m) FILTER (WHERE ca = cb) AS i, min(m) FILTER (WHERE ca <> cb) AS o FROM g GROUP BY vec_id),
    du AS (SELECT (SELECT min(list_distance(a.c, b.c)) FROM r_cent a JOIN r_cent b ON a.cluster <> b.cluster) / (SELECT max(2 * s) FROM own) AS dunn)
    SELECT k AS n_clusters, n AS n_rows, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, round(db, 6) AS davies_bouldin,
      (SELECT round(avg(CASE WHEN i IS NULL OR o IS NULL THEN 0 ELSE (o - i) / greatest(o, i) END), 6) FROM sil) AS silhouette, round(dunn, 6) AS dunn
    FROM ch, db, du""")
def internal_indices(spark, sf):
    return _round(clusters.internal_indices(vectors(spark, sf), "x"), 6)


@query("bootstrap_jaccard", "I11")
def bootstrap_jaccard(spark, sf):
    """Mean best overlap of three clusters with refits on 30 subsamples, all fitted together."""
    c = solutions.search(vectors(spark, sf), "vec_id", "x", "raw", ks=(3,), algos=("kmeans",), draws=solutions.DRAWS)
    overlaps = many_fits.draw_overlaps(c.labelled, [(0, 3, 1 + b, 3, b) for b in range(solutions.DRAWS)])
    rows = [(k, j, n) for k, (j, n) in many_fits.stability(overlaps)[0].items()]
    return spark.createDataFrame(rows, "cluster int, mean_jaccard double, n_draws int")


@query("jaccard_overlap", "I11", """
    WITH c AS (SELECT given AS a, cluster AS b, count(*) AS n FROM r_near GROUP BY ALL),
    j AS (SELECT a, b, n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS j, sum(n) OVER (PARTITION BY a) AS na FROM c)
    SELECT a AS given, round(max(j), 8) AS jaccard, CAST(max(na) AS BIGINT) AS n FROM j GROUP BY a""")
def jaccard_overlap(spark, sf):
    v = vectors(spark, sf)
    near = clusters.assign_nearest(v.withColumnRenamed("cluster", "given"), clusters.centroids(v, "x"), "x")
    return _round(clusters.jaccard_by_cluster(near, "given", "cluster"))


@query("cluster_balance", "D39 E15", """
    WITH n AS (SELECT cluster, count(*) AS n FROM r_labels GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS s, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS pct FROM n)
    SELECT count(*) AS n_clusters, min(pct) AS min_pct, max(pct) AS max_pct, count(*) FILTER (WHERE pct < 3) AS n_below_3pct,
           count(*) FILTER (WHERE pct > 60) AS n_above_60pct, round(CASE WHEN count(*) > 1 THEN -sum(s * ln(s)) / ln(count(*)) ELSE 0 END, 8) AS balance_entropy FROM p""")
def cluster_balance(spark, sf):
    return _round(clusters.cluster_balance(R.labels(spark, sf)))


_BOARD = """WITH n AS (SELECT l_returnflag || l_linestatus AS solution, l_linenumber AS cluster, count(*) AS n, avg(l_discount) * 5 AS sil, avg(l_tax) * 22 AS jac,
      avg(l_quantity) AS ch, avg(l_extendedprice) / 100000 AS dn FROM lineitem GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY solution) AS s FROM n),
    b AS (SELECT solution, max(sil) AS silhouette, max(jac) AS mean_jaccard, max(ch) AS calinski_harabasz, max(dn) AS dunn, min(round(100 * s, 2)) AS min_pct,
      max(round(100 * s, 2)) * 2.2::DOUBLE AS max_pct, -sum(s * ln(s)) / ln(count(*)) AS balance_entropy FROM p GROUP BY solution),
    f AS (SELECT *, greatest(0.0, (max_pct - 50) / 50) AS balance_penalty, silhouette >= 0.15 AS passes_silhouette, mean_jaccard >= 0.75 AS passes_jaccard,
      min_pct >= 3 AS passes_min_pct, max_pct <= 55 AS passes_max_pct FROM b),
    board AS (SELECT *, round(0.45 * least(silhouette / 0.4, 1) + 0.35 * least(mean_jaccard / 0.9, 1) + 0.2 * (1 - balance_penalty), 3)::DOUBLE AS composite_score,
      passes_silhouette AND passes_jaccard AND passes_min_pct AND passes_max_pct AS passes_all FROM f)
    """
_BOARD_COLS = ["silhouette", "mean_jaccard", "min_pct", "max_pct", "balance_penalty", "composite_score"]


def _candidates(spark, sf):
    """Candidate solutions scored from line items: one per (flag, status), clusters are line numbers."""
    n = R.table(spark, sf, "lineitem").groupBy(F.expr("l_returnflag || l_linestatus AS solution"), F.col("l_linenumber").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.expr("avg(l_discount) * 5 AS sil"), F.expr("avg(l_tax) * 22 AS jac"), F.avg("l_quantity").alias("ch"),
        F.expr("avg(l_extendedprice) / 100000 AS dn"))
    p = n.selectExpr("*", "n / sum(n) OVER (PARTITION BY solution) AS s")
    return p.groupBy("solution").agg(*[F.expr(e) for e in (
        "max(sil) AS silhouette", "max(jac) AS mean_jaccard", "max(ch) AS calinski_harabasz", "max(dn) AS dunn", "min(round(100 * s, 2)) AS min_pct",
        "max(round(100 * s, 2)) * 2.2D AS max_pct", "-sum(s * ln(s)) / ln(count(*)) AS balance_entropy")])


@query("cluster_leaderboard", "I13", _BOARD + "SELECT solution, passes_silhouette, passes_jaccard, passes_min_pct, passes_max_pct, passes_all, " + ", ".join(
    f"round({c}, 8) AS {c}" for c in _BOARD_COLS) + " FROM board")
def cluster_leaderboard(spark, sf):
    b = _round(clusters.leaderboard(_candidates(spark, sf)))
    return b.select("solution", "passes_silhouette", "passes_jaccard", "passes_min_pct", "passes_max_pct", "passes_all", *_BOARD_COLS)


@query("selected_solution", "F3 I13", _BOARD + """SELECT solution, composite_score, CASE WHEN passes_all THEN 0 WHEN passes_jaccard AND passes_max_pct THEN 1 ELSE 2 END AS tier
    FROM board ORDER BY tier, composite_score DESC, silhouette DESC, solution LIMIT 1""")
def selected_solution(spark, sf):
    return clusters.select_solution(clusters.leaderboard(_candidates(spark, sf))).select("solution", "composite_score", "tier")


@query("weighted_rank_selection", "I14 E18", _BOARD + """, c AS (SELECT * FROM b WHERE min_pct >= 10 AND max_pct <= 75)
    SELECT solution, rank() OVER (ORDER BY silhouette DESC) AS r_silhouette, rank() OVER (ORDER BY calinski_harabasz DESC) AS r_ch,
      rank() OVER (ORDER BY dunn DESC) AS r_dunn, rank() OVER (ORDER BY balance_entropy DESC) AS r_balance,
      round(0.25::DOUBLE * rank() OVER (ORDER BY silhouette DESC) + 0.15::DOUBLE * rank() OVER (ORDER BY calinski_harabasz DESC) + 0.15::DOUBLE * rank() OVER (ORDER BY dunn DESC)
        + 0.45::DOUBLE * rank() OVER (ORDER BY balance_entropy DESC), 6) AS score FROM c""")
def weighted_rank_selection(spark, sf):
    return clusters.weighted_rank_selection(_candidates(spark, sf)).select("solution", "r_silhouette", "r_ch", "r_dunn", "r_balance", "score")


@query("sensitivity_grid", "I15")
def sensitivity_grid(spark, sf):
    """Algorithm x k on three preprocessings of the same vectors, each with its indices."""
    v = vectors(spark, sf).drop("cluster")
    unit = v.withColumn("x", F.expr("transform(x, e -> e / sqrt(aggregate(x, 0D, (s, y) -> s + y * y)))"))
    parts = {"raw": v, "unit": unit, "components": vector_components(spark, sf).withColumnRenamed("pcs", "x")}
    return solutions.board(spark, [solutions.search(d, "vec_id", "x", name) for name, d in parts.items()]).drop("mean_jaccard", "min_jaccard")


# ---- the clustering run on users

_POOL = f"""SELECT m.*, coalesce(s.ratio_night_day > 1.5, FALSE) OR coalesce(s.peak_hour BETWEEN 0 AND 6, FALSE) OR coalesce(s.valley_share >= 0.62, FALSE) AS night
    FROM ({_MX_BASE}) m JOIN (SELECT user_id, ratio_night_day, peak_hour, valley_share FROM r_f_shape) s USING (user_id)"""


def _pool(spark, sf):
    """Users with their matrix columns; ``night`` marks the rule segment, which is not clustered."""
    hours = features.shape_features(features.hour_cells(R.meter(spark, sf))).select("user_id", "peak_hour")
    return stage(_mx(spark, sf).join(hours, "user_id").withColumn("night", C.night_rule("ratio_night_day", "peak_hour", "valley_share")).drop("peak_hour"))


def solution_candidates(spark, sf, pool):
    """Every (preprocessing, algorithm, k) of the users' matrix with indices and the stability of 30 draws."""
    scaled = stage(matrix.robust_matrix(pool.where("NOT night").drop("night"), _MX, weights=_W))
    parts = {"robust": scaled.select("user_id", F.array(*_MX).alias("x")),
             "components": matrix.pca(scaled, _MX, kmin=3, kmax=6)[0].select("user_id", F.col("pcs").alias("x"))}
    return [solutions.search(d, "user_id", "x", name, draws=solutions.DRAWS) for name, d in parts.items()]


def _names():
    return " UNION ALL ".join(f"SELECT '{p}_{a}_k{k}' AS solution, {k} AS k" for p, a, k in product(("robust", "components"), ("kmeans", "mixture"), DEFAULT.k_range))


@query("solution_board", "I13 I15", f"""WITH p AS ({_POOL}) SELECT solution, k, (SELECT count(*) FROM p WHERE NOT night) AS n_rows, TRUE AS shares_fit, TRUE AS indices_fit, TRUE AS stability_fits
    FROM ({_names()})""")
def solution_board(spark, sf):
    """The fitted candidates; the SQL twin knows the candidates, the pool and what must hold of every rating."""
    b = solutions.board(spark, solution_candidates(spark, sf, _pool(spark, sf)))
    return b.selectExpr("solution", "k", "n_rows", "n_clusters BETWEEN 1 AND k AND min_pct * n_clusters <= 100.1D AND max_pct * n_clusters >= 99.9D AS shares_fit",
                        "silhouette BETWEEN -1 AND 1 AND balance_entropy BETWEEN 0 AND 1.000001D AND davies_bouldin > 0 AND dunn > 0 AS indices_fit",
                        "min_jaccard > 0 AND min_jaccard <= mean_jaccard AND mean_jaccard <= 1 AS stability_fits")


@query("chosen_solution", "F3 I13 I14")
def chosen_solution(spark, sf):
    return clusters.select_solution(clusters.leaderboard(solutions.board(spark, solution_candidates(spark, sf, _pool(spark, sf)))))


@query("fitted_labels", "I19 I8 I13", f"""WITH p AS ({_POOL}) SELECT user_id, CASE WHEN night THEN -1 END AS rule_cluster, TRUE AS in_range, CASE WHEN night THEN 'rule' END AS rule_algo
    FROM p""")
def fitted_labels(spark, sf):
    """The label table of the chosen solution with the rule segment as cluster -1."""
    pool = _pool(spark, sf)
    t = chosen_labels(spark, sf, pool)
    return t.selectExpr("user_id", "CASE WHEN cluster = -1 THEN -1 END AS rule_cluster", "cluster = -1 OR cluster BETWEEN 1 AND k AS in_range", "CASE WHEN algo = 'rule' THEN algo END AS rule_algo")


def chosen_labels(spark, sf, pool):
    c = solution_candidates(spark, sf, pool)
    best = clusters.select_solution(clusters.leaderboard(solutions.board(spark, c))).first()
    own = solutions.labels_of(c, best["solution"], "user_id")
    return clusters.label_table(own, best["solution"], best["algo"], best["k"], pool.where("night"))


@query("anomalous_vectors", "I16", """
    WITH q AS (SELECT cluster, quantile_cont(distance, 0.95) AS lim FROM r_own GROUP BY cluster)
    SELECT vec_id, cluster, round(distance, 6) AS distance, distance > lim AS is_anomalous FROM r_own JOIN q USING (cluster)""")
def anomalous_vectors(spark, sf):
    d = clusters.centroid_distance(vectors(spark, sf), "x")
    return clusters.anomalies(d).select("vec_id", "cluster", F.round("distance", 6).alias("distance"), "is_anomalous")


@query("representative_vectors", "I17 E16 B33", """
    SELECT vec_id, cluster, round(distance, 6) AS distance, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS representative_rank,
      'C' || cluster || '-P' || lpad(CAST(row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS VARCHAR), 2, '0') AS profile_id
    FROM r_own QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) <= 3""")
def representative_vectors(spark, sf):
    d = clusters.centroid_distance(vectors(spark, sf), "x")
    return clusters.representatives(d, key="vec_id").select(
        "vec_id", "cluster", F.round("distance", 6).alias("distance"), "representative_rank",
        C.profile_id("cluster", "representative_rank").alias("profile_id"))


_PROFILE_SQL = "SELECT cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct, " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in SCALARS) + " FROM r_seg GROUP BY cluster"


@query("cluster_profiles", "D34 E15", _PROFILE_SQL)
def cluster_profiles(spark, sf):
    return segments.cluster_profiles(seg(spark, sf), SCALARS, digits=6)


@query("cluster_separators", "D35 E16 G6", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM r_seg" for c in SCALARS) + """),
    g AS (SELECT feature, avg(v) AS gm, stddev_samp(v) AS sd FROM l GROUP BY 1), c AS (SELECT cluster, feature, avg(v) AS cm FROM l GROUP BY ALL),
    z AS (SELECT cluster, feature, cm, gm, (cm - gm) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM c JOIN g USING (feature))
    SELECT cluster, feature, round(cm, 8) AS cluster_mean, round(gm, 8) AS global_mean, round(z, 8) AS std_diff,
      row_number() OVER (PARTITION BY cluster ORDER BY abs(round(z, 9)) DESC, feature) AS rank FROM z
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY abs(round(z, 9)) DESC, feature) <= 8""")
def cluster_separators(spark, sf):
    return _round(segments.separators(seg(spark, sf), SCALARS))


@query("hourly_bands", "D36 G6", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT cluster, {h} AS hour, norm_h{h:02d} AS v FROM r_seg" for h in range(24)) + """)
    SELECT cluster, hour, count(v) AS n_users, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd, round(quantile_cont(v, 0.1), 8) AS p10,
      round(quantile_cont(v, 0.25), 8) AS p25, round(quantile_cont(v, 0.5), 8) AS p50, round(quantile_cont(v, 0.75), 8) AS p75, round(quantile_cont(v, 0.9), 8) AS p90
    FROM l GROUP BY ALL""")
def hourly_bands(spark, sf):
    return _round(segments.bands(seg(spark, sf), features.HOUR_COLUMNS))


@query("hourly_curves", "D36", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT cluster, {h} AS hour, norm_h{h:02d} AS v FROM r_seg" for h in range(24)) + ") SELECT cluster, hour, round(avg(v), 8) AS value FROM l GROUP BY ALL")
def hourly_curves(spark, sf):
    return _round(segments.hourly_curves(seg(spark, sf), features.HOUR_COLUMNS))


_CONTEXT = """SELECT cluster, count(*) AS n, round(100 * avg(CAST(coastal_flag AS INTEGER)), 1) AS pct_coastal_flag,
    (SELECT province FROM (SELECT province, count(*) AS k FROM r_seg i WHERE i.cluster = o.cluster GROUP BY 1 ORDER BY k DESC, province LIMIT 1)) AS top_province,
    round(quantile_cont(p1_kw, 0.1), 8) AS p10_power, round(quantile_cont(p1_kw, 0.5), 8) AS median_power, round(quantile_cont(p1_kw, 0.9), 8) AS p90_power
    FROM r_seg o GROUP BY cluster"""


@query("cluster_context", "D37", _CONTEXT)
def cluster_context(spark, sf):
    return _round(segments.context_by_cluster(seg(spark, sf)))


@query("category_coverage", "D38", """SELECT cluster, count(*) AS n_users, count(activity_group) AS n_known, count(*) FILTER (WHERE activity_group IS NULL) AS n_unknown,
    round(100.0::DOUBLE * count(activity_group) / count(*), 2) AS coverage_pct FROM r_seg GROUP BY cluster""")
def category_coverage(spark, sf):
    return segments.coverage_of_category(seg(spark, sf), "activity_group")


_ENRICH = """WITH n AS (SELECT cluster, activity_group, count(*) AS n FROM r_seg WHERE activity_group IS NOT NULL GROUP BY ALL),
    e AS (SELECT cluster, activity_group, n, CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS n_cluster, CAST(sum(n) OVER (PARTITION BY activity_group) AS BIGINT) AS n_global, sum(n) OVER () AS t FROM n),
    r AS (SELECT cluster, activity_group, n, n_cluster, n_global, 100.0::DOUBLE * n / n_cluster AS pct_cluster, 100.0::DOUBLE * n_global / t AS pct_global,
      (n / n_cluster) / (n_global / t) AS enrichment_ratio, n >= 3 AND n_global >= 3 AS is_interpretable FROM e)
    """


@query("category_enrichment", "D38 E18", _ENRICH + """SELECT cluster, activity_group, n, n_cluster, n_global, round(pct_cluster, 8) AS pct_cluster, round(pct_global, 8) AS pct_global,
      round(pct_cluster - pct_global, 8) AS pct_point_diff, round(enrichment_ratio, 8) AS enrichment_ratio, is_interpretable,
      CASE WHEN is_interpretable THEN row_number() OVER (PARTITION BY cluster, is_interpretable ORDER BY round(enrichment_ratio, 9) DESC, activity_group) END AS rank_enrichment FROM r""")
def category_enrichment(spark, sf):
    return _round(segments.enrichment(seg(spark, sf), "activity_group", min_n=3))


@query("top_category", "E16 I23", """WITH n AS (SELECT cluster, activity_group, count(*) AS n FROM r_seg WHERE activity_group IS NOT NULL GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, activity_group) AS rank FROM n
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, activity_group) <= 2""")
def top_category(spark, sf):
    return segments.top_categories(seg(spark, sf), "activity_group", k=2)


@query("flexibility", "I21", """WITH f AS (SELECT cluster, count(*) AS n_users, round(avg(peak_share), 3) AS mean_peak_share, round(avg(flat_share), 3) AS mean_flat_share,
    round(avg(valley_share), 3) AS mean_valley_share, round(median(peak_to_valley_ratio), 8) AS median_peak_to_valley FROM r_seg GROUP BY cluster)
    SELECT *, CASE WHEN mean_valley_share >= 0.5 THEN 'strong valley use' WHEN mean_peak_share >= 0.3 THEN 'peak shifting potential' ELSE 'no clear opportunity' END AS reading FROM f""")
def flexibility(spark, sf):
    return _round(segments.flexibility(seg(spark, sf)))


@query("scaled_ranks", "E17", """
    WITH v AS (SELECT user_id, CASE WHEN tariff IS NOT NULL THEN p1_kw END AS p1_kw FROM r_user),
    k AS (SELECT user_id, p1_kw, CASE WHEN p1_kw IS NOT NULL THEN rank() OVER (PARTITION BY p1_kw IS NULL ORDER BY p1_kw) + (count(*) OVER (PARTITION BY p1_kw) - 1) / 2.0 END AS r FROM v)
    SELECT user_id, round(coalesce(r / max(r) OVER (), 0.5), 8) AS direct, round(coalesce((max(r) OVER () - r + 1) / max(r) OVER (), 0.5), 8) AS inverse FROM k""")
def scaled_ranks(spark, sf):
    v = R.user_dimension(spark, sf).select("user_id", F.expr("CASE WHEN tariff IS NOT NULL THEN p1_kw END AS p1_kw"))
    return _round(rank_columns(v, "user_id", {"direct": ("p1_kw", False), "inverse": ("p1_kw", True)}).drop("p1_kw"))


def _rank_sql(col, inverse):
    r = f"(rank() OVER (ORDER BY round({col}, 9)) + (count(*) OVER (PARTITION BY round({col}, 9)) - 1) / 2.0)"
    return r, inverse


_RISK = "WITH k AS (SELECT user_id, cluster, " + ", ".join(
    f"{_rank_sql(c, i)[0]} AS r{n}" for n, (c, i) in enumerate((("mean_daily_kwh", True), ("seasonal_amplitude_norm", True), ("low_day_rate", False)))) + """ FROM r_seg),
    x AS (SELECT user_id, cluster, round(((max(r0) OVER () - r0 + 1) / max(r0) OVER () + (max(r1) OVER () - r1 + 1) / max(r1) OVER () + r2 / max(r2) OVER ()) / 3, 8)::DOUBLE AS risk_score FROM k)
    """
_PARTS = [("mean_daily_kwh", True), ("seasonal_amplitude_norm", True), ("low_day_rate", False)]


def _risk(users):
    s = users.select("user_id", "cluster", *[F.round(c, 9).alias(c) for c, _ in _PARTS])
    return segments.risk_proxy(s, _PARTS, digits=8)


@query("risk_proxy", "I20 E17", _RISK + "SELECT user_id, cluster, risk_score, risk_score >= 0.7 AS high_risk FROM x")
def risk_proxy(spark, sf):
    return _risk(seg(spark, sf)).select("user_id", "cluster", "risk_score", "high_risk")


@query("risk_by_cluster", "I20", _RISK + """SELECT cluster, count(*) AS n, round(avg(risk_score), 3) AS risk_mean, round(100 * avg(CAST(risk_score >= 0.7 AS INTEGER)), 1) AS pct_high_risk,
    round(quantile_cont(risk_score, 0.75), 8) AS risk_p75 FROM x GROUP BY cluster""")
def risk_by_cluster(spark, sf):
    return _round(segments.risk_summary(_risk(seg(spark, sf))))


_RULE_COLS = ["median_daily_kwh", "mean_daily_kwh", "low_day_rate", "zero_day_rate", "valley_share", "night_share", "peak_share",
              "ratio_weekend_weekday", "seasonal_amplitude_norm"]


def _rule_case(pos):
    whens = []
    for cond, *vals in segments.SEGMENT_RULES:
        whens.append(f"WHEN coalesce({cond}, FALSE) THEN '{vals[pos]}'")
    return "CASE " + " ".join(whens) + " END"


_BUSINESS = """, pr AS (SELECT cluster, CASE WHEN cluster = 0 THEN 'noise' WHEN cluster = -1 THEN 'irregular_home' ELSE 'C' || cluster END AS label, count(*) AS n, """ + ", ".join(
    f"round(avg({c}), 3) AS {c}" for c in _RULE_COLS) + """ FROM r_seg GROUP BY cluster), rk AS (SELECT cluster, round(100 * avg(CAST(risk_score >= 0.7 AS INTEGER)), 1) AS pct_high_risk FROM x GROUP BY cluster),
    j AS (SELECT pr.*, rk.pct_high_risk, 0.0 AS beta_hdd, 0.0 AS r2_joint FROM pr LEFT JOIN rk USING (cluster))
    """


@query("business_segments", "B29 I22 C13", _RISK + _BUSINESS + f"SELECT cluster, label, n, pct_high_risk, {_rule_case(0)} AS segment, {_rule_case(1)} AS action, {_rule_case(2)} AS priority FROM j")
def business_segments(spark, sf):
    users = seg(spark, sf)
    prof = segments.cluster_profiles(users, _RULE_COLS).withColumn("label", clusters.cluster_label())
    joined = prof.join(segments.risk_summary(_risk(users)).select("cluster", "pct_high_risk"), "cluster", "left")
    return segments.classify_segments(joined).select("cluster", "label", "n", "pct_high_risk", "segment", "action", "priority")


@query("segment_evidence", "B29")
def segment_evidence(spark, sf):
    prof = segments.cluster_profiles(seg(spark, sf), _RULE_COLS).withColumn("label", clusters.cluster_label())
    return segments.classify_segments(prof).select("label", "segment", "evidence")


def _behaviour_case(pos):
    return "CASE " + " ".join(f"WHEN coalesce({r[0]}, FALSE) THEN '{r[pos]}'" for r in segments.BEHAVIOUR_RULES) + " END"


_BP = "SELECT cluster, " + ", ".join(f"round(avg({c}), 3) AS {c}" for c in ("ratio_night_day", "zero_day_rate", "low_day_rate", "peak_share", "valley_share")) + " FROM r_seg GROUP BY cluster"


@query("behaviour_rules", "B30", f"SELECT cluster, {_behaviour_case(1)} AS signal, {_behaviour_case(2)} AS question, {_behaviour_case(3)} AS action FROM ({_BP})")
def behaviour_rules(spark, sf):
    prof = segments.cluster_profiles(seg(spark, sf), ["ratio_night_day", "zero_day_rate", "low_day_rate", "peak_share", "valley_share"])
    return segments.apply_rules(prof).select("cluster", "signal", "question", "action")


_Q_SQL = " UNION ALL ".join(
    f"SELECT cluster, '{q}' AS question, CASE WHEN coalesce({h}, FALSE) THEN 'high' WHEN coalesce({m}, FALSE) THEN 'medium' ELSE 'context' END AS strength FROM b"
    for q, h, m in segments.QUESTIONS)


_SHARES = ["peak_share", "valley_share", "flat_share", "zero_day_rate", "low_day_rate"]
ROLES["r_anomaly"] = f"""WITH x AS (SELECT cluster, [{', '.join(_SHARES)}] AS x FROM r_seg WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _SHARES)}),
    c AS (SELECT cluster, [{', '.join(f'avg(x[{i + 1}])' for i in range(len(_SHARES)))}] AS c FROM x GROUP BY cluster),
    d AS (SELECT cluster, round(list_distance(x, c), 9) AS d FROM x JOIN c USING (cluster)), l AS (SELECT cluster, quantile_cont(d, 0.95) AS lim FROM d GROUP BY cluster)
    SELECT cluster, 100 * avg(CAST(d > lim AS INTEGER)) AS anomaly_pct FROM d JOIN l USING (cluster) GROUP BY cluster"""


@query("anomaly_share", "I16 I23", "SELECT cluster, round(anomaly_pct, 6) AS anomaly_pct FROM r_anomaly")
def anomaly_share(spark, sf):
    return _round(clusters.anomaly_share(seg(spark, sf), _SHARES), 6)


@query("question_grid", "B38 I23 C10 C13 F4", _ENRICH + f""", te AS (SELECT cluster, max(enrichment_ratio) FILTER (WHERE is_interpretable) AS top_enrichment FROM r GROUP BY cluster),
    cv AS (SELECT cluster, count(activity_group) AS n_known, 100.0 * count(activity_group) / count(*) AS coverage_pct FROM r_seg GROUP BY cluster),
    b AS (SELECT p.*, te.top_enrichment, cv.n_known, cv.coverage_pct, f.needs_calibration, f.coverage_test, f.n_alerts, an.anomaly_pct
      FROM ({_BP}) p LEFT JOIN te USING (cluster) LEFT JOIN cv USING (cluster) LEFT JOIN r_assess f USING (cluster) LEFT JOIN r_anomaly an USING (cluster)), q AS ({_Q_SQL})
    SELECT cluster, question, strength, strength = 'high' AS is_primary, list_position(['high', 'medium', 'context'], strength) AS strength_order FROM q""")
def question_grid(spark, sf):
    s = seg(spark, sf)
    prof = segments.cluster_profiles(s, ["ratio_night_day", "zero_day_rate", "low_day_rate", "peak_share", "valley_share"])
    rich = segments.enrichment(s, "activity_group", min_n=3).where("is_interpretable").groupBy("cluster").agg(F.max("enrichment_ratio").alias("top_enrichment"))
    cov = segments.coverage_of_category(s, "activity_group").select("cluster", "n_known", "coverage_pct")
    odd = clusters.anomaly_share(s, _SHARES)
    quality = assessment(spark, sf).select("cluster", "needs_calibration", "coverage_test", "n_alerts")
    base = prof
    for part in (rich, cov, odd, quality):  # a row per cluster each
        base = base.join(F.broadcast(part), "cluster", "left")
    return segments.question_grid(base).select("cluster", "question", "strength", "is_primary", "strength_order")


@query("semantic_labels", "I18", """
    WITH p AS (SELECT cluster, avg(zero_day_rate) AS z, avg(peak_share) AS pk, avg(valley_share) AS v FROM r_seg GROUP BY cluster),
    a AS (SELECT cluster FROM p ORDER BY round(z, 9) DESC, cluster LIMIT 1),
    b AS (SELECT cluster FROM p WHERE cluster NOT IN (SELECT cluster FROM a) ORDER BY round(pk, 9) DESC, cluster LIMIT 1),
    c AS (SELECT cluster FROM p WHERE cluster NOT IN (SELECT cluster FROM a UNION ALL SELECT cluster FROM b) ORDER BY round(v, 9) DESC, cluster LIMIT 1)
    SELECT cluster, CASE WHEN cluster IN (SELECT cluster FROM a) THEN 'intermittent' WHEN cluster IN (SELECT cluster FROM b) THEN 'evening peak'
      WHEN cluster IN (SELECT cluster FROM c) THEN 'moderate valley' ELSE 'profile ' || cluster END AS name FROM p""")
def semantic_labels(spark, sf):
    prof = seg(spark, sf).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in ("zero_day_rate", "peak_share", "valley_share")])
    order = [("zero_day_rate", "intermittent"), ("peak_share", "evening peak"), ("valley_share", "moderate valley")]
    return segments.semantic_labels(prof, order).select("cluster", "name")


@query("label_table", "I19 G1 B37", """
    WITH s AS (SELECT user_id, province, cluster, coalesce(ratio_night_day > 1.5, FALSE) OR coalesce(peak_hour BETWEEN 0 AND 6, FALSE) OR coalesce(valley_share >= 0.62, FALSE) AS night FROM r_seg)
    SELECT user_id, province, cluster, 'nation_rule' AS solution, 'rule' AS algo, 4 AS k FROM s WHERE NOT night
    UNION ALL SELECT user_id, province, -1, 'rule_segment', 'rule', 4 FROM s WHERE night""")
def label_table(spark, sf):
    s = seg(spark, sf).withColumn("night", C.night_rule("ratio_night_day", "peak_hour", "valley_share"))
    return clusters.label_table(s.where("NOT night"), "nation_rule", "rule", 4, s.where("night"), keep=["province"])


@query("energy_quartiles", "D42", """
    WITH u AS (SELECT user_id, sum(daily_kwh) AS kwh FROM r_daily GROUP BY 1), q AS (SELECT quantile_cont(kwh, 0.25) AS q1, quantile_cont(kwh, 0.5) AS q2, quantile_cont(kwh, 0.75) AS q3 FROM u),
    b AS (SELECT CASE WHEN kwh <= q1 THEN 'Q1' WHEN kwh <= q2 THEN 'Q2' WHEN kwh <= q3 THEN 'Q3' ELSE 'Q4' END AS segment, count(*) AS n_users, sum(kwh) AS kwh, avg(kwh) AS mean_kwh FROM u, q GROUP BY 1)
    SELECT segment, n_users, kwh, round(mean_kwh, 8) AS mean_kwh, round(100.0::DOUBLE * n_users / sum(n_users) OVER (), 4) AS pct_users, round(100.0::DOUBLE * kwh / sum(kwh) OVER (), 4) AS pct_kwh FROM b""")
def energy_quartiles(spark, sf):
    u = R.daily(spark, sf).groupBy("user_id").agg(F.sum("daily_kwh").alias("kwh"))
    return _round(reports.energy_quartiles(u, "kwh"))
