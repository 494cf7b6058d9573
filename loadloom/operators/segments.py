"""Descriptions of user segments: profiles, contrasts, risk, rules and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.operators.ranks import percentiles, scaled_ranks, top_k_per_group


def expand_refs(df: DataFrame, key: str, refs: str, lookup: DataFrame, sep: str = ";", glue: str = " | ") -> DataFrame:
    """Split a list in text, look every code up, and join the labels again in order.

    ``lookup`` has (code, label). Codes without a label are dropped.
    """
    items = (df.select(key, F.posexplode(F.split(refs, sep)).alias("pos", "code"))
             .select(key, "pos", F.trim("code").alias("code")).where(F.col("code") != ""))
    named = items.join(lookup, "code")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "label")))
    return named.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["label"]), glue).alias("text"))


def cluster_profiles(df: DataFrame, cols: Sequence[str], label="cluster", digits=3) -> DataFrame:
    """Size, share and mean of the scalar columns per cluster."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"round(avg({c}), {digits}) AS {c}") for c in cols])
    t = g.agg(F.sum("n").alias("_t"))
    return g.crossJoin(F.broadcast(t)).selectExpr(label, "n", "round(100D * n / _t, 2) AS pct", *cols)


def separators(df: DataFrame, cols: Sequence[str], label="cluster", k=8) -> DataFrame:
    """The ``k`` columns whose cluster mean is furthest from the global mean, in global deviations."""
    long = df.unpivot([label], [F.col(c).cast("double").alias(c) for c in cols], "feature", "value")
    by_cluster = long.groupBy(label, "feature").agg(F.avg("value").alias("cluster_mean"))
    overall = long.groupBy("feature").agg(F.avg("value").alias("global_mean"), F.stddev_samp("value").alias("_sd"))
    z = by_cluster.join(F.broadcast(overall), "feature").selectExpr(
        label, "feature", "cluster_mean", "global_mean",
        "(cluster_mean - global_mean) / CASE WHEN _sd > 0 THEN _sd ELSE 1D END AS std_diff")
    return top_k_per_group(z, [label], [F.desc(F.abs(F.round("std_diff", 9))), F.col("feature")], k)


def bands(df: DataFrame, hour_cols: Sequence[str], label="cluster") -> DataFrame:
    """Mean, deviation and exact quantile band of the hourly curve per cluster and hour."""
    long = df.unpivot([label], list(hour_cols), "_h", "value").withColumn("hour", F.expr("int(right(_h, 2))")).drop("_h")
    m = long.groupBy(label, "hour").agg(F.count("value").alias("n_users"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    q = percentiles(long, "value", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, by=[label, "hour"])
    return m.join(q, [label, "hour"])


def hourly_curves(df: DataFrame, hour_cols: Sequence[str], label="cluster") -> DataFrame:
    """Mean hourly curve per cluster in long form."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in hour_cols])
    return means.unpivot([label], list(hour_cols), "_h", "value").selectExpr(label, "int(right(_h, 2)) AS hour", "value")


def top_category(df: DataFrame, label: str, category: str, out: str) -> DataFrame:
    """Most frequent category per cluster, alphabetically first on ties."""
    n = df.where(F.col(category).isNotNull()).groupBy(label, category).agg(F.count(F.lit(1)).alias("_n"))
    return (n.groupBy(label).agg(F.max("_n").alias("_n")).join(n, [label, "_n"])
            .groupBy(label).agg(F.min(category).alias(out)))


def context_by_cluster(df: DataFrame, label="cluster", flags: Sequence[str] = ("coastal_flag",), category="province",
                       power="p1_kw") -> DataFrame:
    """Share of each flag, modal category and the power band per cluster."""
    base = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[
        F.expr(f"round(100 * avg(int({f})), 1) AS pct_{f}") for f in flags])
    q = percentiles(df.select(label, power), power, {"p10_power": 0.1, "median_power": 0.5, "p90_power": 0.9}, by=[label])
    return base.join(top_category(df, label, category, f"top_{category}"), label, "left").join(q, label, "left")


def coverage_of_category(df: DataFrame, category: str, label="cluster") -> DataFrame:
    """Known and unknown category counts per cluster."""
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_users"), F.count(category).alias("n_known"),
        F.count_if(F.col(category).isNull()).alias("n_unknown"),
        F.expr(f"round(100D * count({category}) / count(*), 2) AS coverage_pct"))


def enrichment(df: DataFrame, category: str, label="cluster", min_n=20) -> DataFrame:
    """Share of each category inside a cluster against its share overall, with support flags and ranks."""
    n = df.where(F.col(category).isNotNull()).groupBy(label, category).agg(F.count(F.lit(1)).alias("n"))
    inside = n.groupBy(label).agg(F.sum("n").alias("n_cluster"))
    overall = n.groupBy(category).agg(F.sum("n").alias("n_global"))
    total = n.agg(F.sum("n").alias("_t"))
    j = n.join(F.broadcast(inside), label).join(overall, category).crossJoin(F.broadcast(total)).selectExpr(
        label, category, "n", "n_cluster", "n_global", "100D * n / n_cluster AS pct_cluster", "100D * n_global / _t AS pct_global",
        "100D * n / n_cluster - 100D * n_global / _t AS pct_point_diff", "(n / n_cluster) / (n_global / _t) AS enrichment_ratio",
        f"n >= {min_n} AND n_global >= {min_n} AS is_interpretable")
    from pyspark.sql import Window
    # One row per (cluster, category): bounded by the classification.
    w = Window.partitionBy(label, "is_interpretable").orderBy(F.desc(F.round("enrichment_ratio", 9)), category)
    return j.withColumn("rank_enrichment", F.when(F.col("is_interpretable"), F.row_number().over(w)))


def top_categories(df: DataFrame, category: str, label="cluster", k=1) -> DataFrame:
    n = df.where(F.col(category).isNotNull()).groupBy(label, category).agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(n, [label], [F.desc("n"), F.col(category)], k)


def flexibility(df: DataFrame, label="cluster") -> DataFrame:
    """Tariff-period shares per cluster and the reading they allow."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_users"), *[
        F.expr(f"round(avg({p}_share), 3) AS mean_{p}_share") for p in ("peak", "flat", "valley")])
    q = percentiles(df.select(label, "peak_to_valley_ratio"), "peak_to_valley_ratio", {"median_peak_to_valley": 0.5}, by=[label])
    return g.join(q, label, "left").withColumn("reading", F.expr(
        """CASE WHEN mean_valley_share >= 0.5 THEN 'strong valley use' WHEN mean_peak_share >= 0.3 THEN 'peak shifting potential'
           ELSE 'no clear opportunity' END"""))


def risk_proxy(df: DataFrame, parts: Sequence[tuple[str, bool]], cut=0.70, key="user_id", digits=3) -> DataFrame:
    """Mean of scaled ranks (True marks inverse ranks) and the high-risk flag."""
    names = {f"_k{i}": part for i, part in enumerate(parts)}
    ranked = scaled_ranks(df, key, names)
    return ranked.withColumn("risk_score", F.expr(f"round(({' + '.join(names)}) / {len(names)}, {digits})")).withColumn(
        "high_risk", F.col("risk_score") >= cut).drop(*names)


def risk_summary(df: DataFrame, label="cluster") -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.expr("round(avg(risk_score), 3) AS risk_mean"),
                              F.expr("round(100 * avg(int(high_risk)), 1) AS pct_high_risk"))
    q = percentiles(df.select(label, "risk_score"), "risk_score", {"risk_p75": 0.75}, by=[label])
    return g.join(q, label)


# Ordered segment rules over cluster means, first match wins. Each
# rule is (condition, segment, action, priority, evidence format, its columns).
SEGMENT_RULES = (
    ("label IN ('noise', 'anomalies')", "operational_anomaly", "review contract, meter and events one by one",
     "very high", "marked as noise by the model", ()),
    ("label = 'irregular_home' OR (median_daily_kwh < 1.2 AND low_day_rate >= 0.55)", "irregular_home",
     "minimum power and tariff, alert on sudden reactivation", "high",
     "median %.2f kWh/day, low days %.2f, zero days %.2f", ("median_daily_kwh", "low_day_rate", "zero_day_rate")),
    ("median_daily_kwh >= 15 AND valley_share >= 0.60 AND night_share >= 0.35", "intensive_night_use",
     "valley-indexed offer and audit of night loads", "high",
     "median %.1f kWh/day, valley %.2f, night %.2f", ("median_daily_kwh", "valley_share", "night_share")),
    ("beta_hdd >= 1.0 AND r2_joint >= 0.20 AND seasonal_amplitude_norm >= 0.75", "winter_heating",
     "winter campaign on heating, insulation and storage", "high",
     "beta %.2f, R2 %.2f, amplitude %.2f", ("beta_hdd", "r2_joint", "seasonal_amplitude_norm")),
    ("peak_share >= 0.42 AND valley_share <= 0.30 AND ratio_weekend_weekday <= 0.70", "workday_peak_flexibility",
     "demand response and contracted power review", "high",
     "peak %.2f, valley %.2f, weekend ratio %.2f", ("peak_share", "valley_share", "ratio_weekend_weekday")),
    ("seasonal_amplitude_norm >= 0.85 AND low_day_rate >= 0.25 AND median_daily_kwh < 4", "seasonal_low_use",
     "adjusted power and out-of-season alerts", "medium",
     "median %.1f kWh/day, amplitude %.2f, low days %.2f", ("median_daily_kwh", "seasonal_amplitude_norm", "low_day_rate")),
    ("pct_high_risk >= 15 AND median_daily_kwh < 7 AND beta_hdd < 0.2", "social_efficiency",
     "efficiency and bill support for vulnerable homes", "medium",
     "median %.1f kWh/day, high risk %.1f%%, beta %.2f", ("median_daily_kwh", "pct_high_risk", "beta_hdd")),
    ("night_share <= 0.16 AND seasonal_amplitude_norm <= 0.45 AND median_daily_kwh < 7", "base_portfolio",
     "operational forecasting base and general campaigns", "medium",
     "median %.1f kWh/day, night %.2f, amplitude %.2f", ("median_daily_kwh", "night_share", "seasonal_amplitude_norm")),
    ("true", "mixed_portfolio", "standard offer, review sub-segments first", "medium",
     "mean %.1f kWh/day, peak %.2f, valley %.2f", ("mean_daily_kwh", "peak_share", "valley_share")),
)

# Values a missing profile column takes in the rules.
SEGMENT_DEFAULTS = {"ratio_weekend_weekday": 1.0, "peak_share": 0.0, "valley_share": 0.0, "night_share": 0.0,
                    "seasonal_amplitude_norm": 0.0, "low_day_rate": 0.0, "zero_day_rate": 0.0, "beta_hdd": 0.0,
                    "r2_joint": 0.0, "pct_high_risk": 0.0}


def classify_segments(df: DataFrame, rules: Sequence = SEGMENT_RULES, label="label") -> DataFrame:
    """First matching rule per row: segment, action, priority and evidence text."""
    for c in ("median_daily_kwh", "mean_daily_kwh"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumns({c: F.coalesce(F.col(c) if c in df.columns else F.lit(None).cast("double"), F.lit(v))
                         for c, v in SEGMENT_DEFAULTS.items()})

    def chain(pick):
        whens = " ".join(f"WHEN coalesce({r[0].replace('label', label)}, false) THEN {pick(r)}" for r in rules)
        return f"CASE {whens} END"

    def evidence(r):
        args = "".join(f", double({c})" for c in r[5])
        return f"printf('{r[4]}'{args})" if r[5] else f"'{r[4]}'"

    return df.selectExpr("*", f"{chain(lambda r: repr(r[1]))} AS segment", f"{chain(lambda r: repr(r[2]))} AS action",
                         f"{chain(lambda r: repr(r[3]))} AS priority", f"{chain(evidence)} AS evidence")


# Ordered behaviour rules, (condition, signal, question, action).
BEHAVIOUR_RULES = (
    ("cluster = 0 OR ratio_night_day >= 1.4", "load shifted to night or valley", "how to use night load?", "follow valley flexibility"),
    ("zero_day_rate >= 0.10 OR low_day_rate >= 0.35", "intermittent use", "who needs separate follow-up?", "check season, second home or meter"),
    ("peak_share >= 0.30", "evening peak", "what lowers peak exposure?", "shift load out of peak"),
    ("valley_share >= 0.45", "moderate valley use", "who sustains valley plans?", "low-friction efficiency"),
    ("true", "stable profile", "what is prudent without a strong signal?", "use as control group"),
)


def apply_rules(df: DataFrame, rules: Sequence = BEHAVIOUR_RULES, out: Sequence[str] = ("signal", "question", "action")) -> DataFrame:
    """Text columns from an ordered rule table of (condition, value, value, ...)."""
    exprs = []
    for i, name in enumerate(out):
        whens = " ".join(f"WHEN coalesce({r[0]}, false) THEN {r[i + 1]!r}" for r in rules)
        exprs.append(f"CASE {whens} END AS {name}")
    return df.selectExpr("*", *exprs)


# Fixed values: (question, condition of high evidence, condition of medium evidence).
QUESTIONS = (
    ("flexibility", "cluster = 0 OR peak_share >= 0.30 OR valley_share >= 0.45", "false"),
    ("peak_tariff", "peak_share >= 0.30", "false"),
    ("intermittent_quality", "zero_day_rate >= 0.10 OR low_day_rate >= 0.35", "false"),
    ("forecast_segment", "needs_calibration OR coverage_test < 90 OR n_alerts > 0", "false"),
    ("activity_context", "top_enrichment >= 1.20", "n_known >= 20 AND coverage_pct >= 80"),
    ("anomaly_review", "anomaly_pct >= 4", "false"),
    ("reconciliation", "false", "true"),
    ("reproducibility", "false", "false"),
)


def question_grid(clusters: DataFrame, rules: Sequence = QUESTIONS) -> DataFrame:
    """Evidence strength of every business question for every cluster (clusters x questions rows).

    Absent inputs count as no evidence.
    """
    optional = {"needs_calibration": "boolean", "coverage_test": "double", "n_alerts": "bigint", "top_enrichment": "double",
                "n_known": "bigint", "coverage_pct": "double", "anomaly_pct": "double"}
    for c, t in optional.items():
        if c not in clusters.columns:
            clusters = clusters.withColumn(c, F.lit(None).cast(t))
    cells = []
    for q, high, medium in rules:
        strength = (f"CASE WHEN coalesce({high}, false) THEN 'high' WHEN coalesce({medium}, false) THEN 'medium' ELSE 'context' END")
        cells.append(f"named_struct('question', '{q}', 'strength', {strength})")
    grid = clusters.selectExpr("*", f"inline(array({', '.join(cells)}))")
    return grid.selectExpr(
        "*", "strength = 'high' AS is_primary", "array_position(array('high', 'medium', 'context'), strength) AS strength_order",
        """CASE WHEN question IN ('flexibility', 'peak_tariff') THEN printf('peak %.2f, valley %.2f', double(peak_share), double(valley_share))
                WHEN question = 'intermittent_quality' THEN printf('zero days %.2f, low days %.2f', double(zero_day_rate), double(low_day_rate))
                ELSE concat('cluster ', cluster) END AS evidence""")


def semantic_labels(profile: DataFrame, order: Sequence[tuple[str, str]], label="cluster") -> DataFrame:
    """Name clusters one after another: the top cluster by each column, skipping those already named.

    The profile has one row per cluster.
    """
    out = profile.withColumn("name", F.lit(None).cast("string"))
    for col, name in order:
        pick = (out.where("name IS NULL").orderBy(F.desc_nulls_last(F.round(col, 9)), label).limit(1)
                .select(F.col(label).alias("_pick")))
        out = (out.join(F.broadcast(pick), F.col(label) == F.col("_pick"), "left")
               .withColumn("name", F.when(F.col("_pick").isNotNull(), name).otherwise(F.col("name"))).drop("_pick"))
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit("profile "), F.col(label).cast("string"))))
