"""Feature matrices: robust scaling, one-hot context and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.operators.ranks import percentiles
from loadloom.sources.stage import stage

MAD_SCALE = 1.4826


def column_statistics(df: DataFrame, cols: Sequence[str], lo=0.01, hi=0.99) -> dict[str, dict[str, float]]:
    """fill, lo, hi, centre and scale of each column, exact for any number of rows.

    All columns are processed together in long form, so the number of passes
    does not depend on the number of columns; only one row per column reaches
    the driver. The fill is the median; the scale is the MAD of the winsorised
    values, else their standard deviation, else one.
    """
    long = stage(df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column", "value"))

    def per_column(table: DataFrame) -> dict[str, dict]:
        return {r["column"]: r.asDict() for r in table.collect()}

    def pick(stats, name):  # the column's number as an expression of the long table
        return "CASE column " + " ".join(f"WHEN '{c}' THEN {stats[c][name]!r}D" for c in cols) + " END"

    known = per_column(percentiles(long, "value", {"fill": 0.5}, by=["column"]))
    stats = {c: {"fill": (known.get(c) or {}).get("fill") or 0.0} for c in cols}
    filled = long.selectExpr("column", f"coalesce(value, {pick(stats, 'fill')}) AS value")
    for c, r in per_column(percentiles(filled, "value", {"lo": lo, "hi": hi}, by=["column"])).items():
        stats[c].update(lo=r["lo"], hi=r["hi"], centre=min(max(stats[c]["fill"], r["lo"]), r["hi"]))
    clipped = filled.selectExpr("column", f"least(greatest(value, {pick(stats, 'lo')}), {pick(stats, 'hi')}) AS w")
    away = clipped.selectExpr("column", "w", f"abs(w - {pick(stats, 'centre')}) AS away")
    mad = per_column(percentiles(away, "away", {"mad": 0.5}, by=["column"]))
    sd = per_column(clipped.groupBy("column").agg(F.stddev_samp("w").alias("sd")))
    for c in cols:
        m, d = mad[c]["mad"] * MAD_SCALE, sd[c]["sd"] or 0.0
        stats[c]["scale"] = m if m > 0 else d if d > 0 else 1.0
    return stats


def robust_matrix(df: DataFrame, cols: Sequence[str], lo=0.01, hi=0.99, weights: dict[str, float] | None = None) -> DataFrame:
    """Median fill, winsorise, robust scale and weight the columns; other columns are kept."""
    stats, weights = column_statistics(df, cols, lo, hi), weights or {}
    out = []
    for c in cols:
        s = stats[c]
        clipped = f"least(greatest(coalesce(double({c}), {s['fill']!r}D), {s['lo']!r}D), {s['hi']!r}D)"
        out.append(f"({clipped} - {s['centre']!r}D) / {s['scale']!r}D * {float(weights.get(c, 1.0))!r}D AS {c}")
    return df.selectExpr(*[c for c in df.columns if c not in cols], *out)


def assemble_vector(df: DataFrame, cols: Sequence[str], out="features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def one_hot(df: DataFrame, cols: Sequence[str], scale=0.35, out="context") -> DataFrame:
    """Scaled indicator vector of categorical columns."""
    filled = df.fillna("unknown", list(cols))
    indexed = StringIndexer(inputCols=list(cols), outputCols=[f"_i_{c}" for c in cols], handleInvalid="keep").fit(filled).transform(filled)
    enc = OneHotEncoder(inputCols=[f"_i_{c}" for c in cols], outputCols=[f"_o_{c}" for c in cols], dropLast=False).fit(indexed).transform(indexed)
    vec = VectorAssembler(inputCols=[f"_o_{c}" for c in cols], outputCol="_v").transform(enc)
    scaled = F.transform(vector_to_array("_v"), lambda x: x * scale)
    return vec.withColumn(out, scaled).select(*df.columns, out)


def pca(df: DataFrame, cols: Sequence[str], var=0.85, kmin=6, kmax=15, out="pcs"):
    """Centred principal components kept up to ``var`` explained variance, within [kmin, kmax].

    Returns the table with an array column and the fitted model. The fit
    accumulates a d x d matrix on the executors (d is the number of columns).
    """
    k = min(kmax, len(cols))
    vec = assemble_vector(df, cols, "_v")
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vec).transform(vec)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    share, total = model.explainedVariance.toArray(), 0.0
    keep = k
    for i, s in enumerate(share):
        total += s
        if total >= var:
            keep = i + 1
            break
    keep = min(k, max(kmin, keep))
    res = model.transform(centred).withColumn(out, F.slice(vector_to_array("_p"), 1, keep))
    return res.drop("_v", "_c", "_p"), model
