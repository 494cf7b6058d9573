"""Contracts, gates, manifests and audits. All return rows; gates may also raise."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.config import FORBIDDEN_COLUMNS


@dataclass(frozen=True)
class Rule:
    """A range rule: rows that satisfy ``bad`` break it."""

    check_id: str
    column: str
    expected: str
    bad: Column
    severity: str = "fail"


def _struct(**cells) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in cells.items()])


def contracts(df: DataFrame, table: str, required: Sequence[str] = (), rules: Sequence[Rule] = ()) -> DataFrame:
    """Required-column and range checks as rows, from a single scan.

    A rule on an absent column is reported as failed instead of raising.
    """
    usable = [r for r in rules if r.column in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count_if(r.bad).alias(r.check_id) for r in usable])
    rows = []
    for c in required:
        ok = c in df.columns
        rows.append(_struct(check_id=f"{table}_schema_{c}", table_name=table, column_name=c,
                            check_type="required_column", expected="present",
                            observed="present" if ok else "missing", status="pass" if ok else "fail"))
    for r in rules:
        n = F.col(r.check_id) if r in usable else F.lit(None).cast("long")
        status = F.when(F.coalesce(n, F.lit(1)) > 0, r.severity).otherwise("pass")
        rows.append(_struct(check_id=r.check_id, table_name=table, column_name=r.column,
                            check_type="range_or_contract", expected=r.expected,
                            observed=F.coalesce(n.cast("string"), F.lit("missing")), status=status))
    return counts.select(F.inline(F.array(*rows)))


class CheckFailed(ValueError):
    """Raised by a gate whose condition does not hold."""


def expect_no_fail(checks: DataFrame) -> DataFrame:
    failed = checks.where("status = 'fail'").select("check_id").collect()
    if failed:
        raise CheckFailed(", ".join(r.check_id for r in failed))
    return checks


def gate_min_groups(df: DataFrame, key: str, n: int, check_id: str = "min_groups") -> DataFrame:
    """At least ``n`` distinct keys."""
    got = df.select(key).distinct().agg(F.count(F.lit(1)).alias("observed"))
    return got.select(F.lit(check_id).alias("check_id"), F.lit(n).cast("long").alias("expected"), "observed",
                      F.when(F.col("observed") >= n, "pass").otherwise("fail").alias("status"))


def gate_row_count(df: DataFrame, expected: Column | int, check_id: str = "row_count") -> DataFrame:
    e = expected if isinstance(expected, Column) else F.lit(expected)
    got = df.agg(F.count(F.lit(1)).alias("observed"), e.cast("long").alias("expected"))
    return got.select(F.lit(check_id).alias("check_id"), "expected", "observed",
                      F.when(F.col("observed") == F.col("expected"), "pass").otherwise("fail").alias("status"))


def gate_no_nulls(df: DataFrame, cols: Sequence[str], check_id: str = "no_nulls") -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    got = df.agg(F.count_if(bad).alias("observed"))
    return got.select(F.lit(check_id).alias("check_id"), F.lit(0).cast("long").alias("expected"), "observed",
                      F.when(F.col("observed") == 0, "pass").otherwise("fail").alias("status"))


def gate_scope(df: DataFrame, col: str, codes: Iterable[str], check_id: str = "scope") -> DataFrame:
    got = df.agg(F.count_if(~F.coalesce(F.col(col).isin(*codes), F.lit(False))).alias("observed"))
    return got.select(F.lit(check_id).alias("check_id"), F.lit(0).cast("long").alias("expected"), "observed",
                      F.when(F.col("observed") == 0, "pass").otherwise("fail").alias("status"))


def personal_columns(df: DataFrame, forbidden: Iterable[str] = FORBIDDEN_COLUMNS) -> list[str]:
    """Names in the table that are on the list of personal data."""
    names = {c.lower() for c in df.columns}
    return sorted(names & set(forbidden))


def guard_personal_data(df: DataFrame, forbidden: Iterable[str] = FORBIDDEN_COLUMNS) -> DataFrame:
    hit = personal_columns(df, forbidden)
    if hit:
        raise CheckFailed(f"personal columns present: {', '.join(hit)}")
    return df


def manifest_row(df: DataFrame, step: str, artifact: str, user: str | None = None, date: str | None = None,
                 measure: str | None = None) -> DataFrame:
    """Rows, users, date range and null measures of one artifact.

    Rows are grouped by user first, so the distinct count needs no second pass.
    """
    d = F.col(date).cast("string") if date else F.lit(None).cast("string")
    nulls = F.count_if(F.col(measure).isNull()) if measure else F.lit(None).cast("long")
    key = [user] if user else []
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("a"), F.max(d).alias("b"), nulls.alias("k"))
    users = F.count(user) if user else F.lit(None).cast("long")
    return g.agg(F.sum("n").alias("n_rows"), users.alias("n_users"), F.min("a").alias("date_min"),
                 F.max("b").alias("date_max"), F.sum("k").alias("n_null_measure")).select(
        F.lit(step).alias("step"), F.lit(artifact).alias("artifact"), "n_rows", "n_users", "date_min", "date_max",
        "n_null_measure")


def manifest(rows: Sequence[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def column_audit(df: DataFrame, placeholders: Sequence[str] = ()) -> DataFrame:
    """Type, missing count and missing percentage of every column, in one scan."""
    aggs = []
    for f in df.schema.fields:
        missing = F.col(f.name).isNull()
        if placeholders and f.dataType.simpleString() == "string":
            missing = missing | F.col(f.name).isin(*placeholders)
        aggs.append(F.count_if(missing).alias(f.name))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = [_struct(column=f.name, type=f.dataType.simpleString(), n_rows=F.col("_n"), n_missing=F.col(f.name),
                    pct_missing=F.round(F.lit(100.0) * F.try_divide(F.col(f.name), F.col("_n")), 2))
            for f in df.schema.fields]
    return one.select(F.inline(F.array(*rows)))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that pass each cumulative condition, with their percentage of all rows."""
    conds, acc = [], F.lit(True)
    for _, c in steps:
        acc = acc & F.coalesce(c, F.lit(False))
        conds.append(acc)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_s{i}") for i, c in enumerate(conds)])
    rows = [_struct(step_no=0, step="all", n=F.col("_n"), pct=F.lit(100.0))]
    rows += [_struct(step_no=i + 1, step=name, n=F.col(f"_s{i}"),
                     pct=F.round(F.lit(100.0) * F.try_divide(F.col(f"_s{i}"), F.col("_n")), 2))
             for i, (name, _) in enumerate(steps)]
    return one.select(F.inline(F.array(*rows)))


def classify_names(names: DataFrame, rules: Sequence[tuple[str, str]], col="column", out="family",
                   default="unclassified") -> DataFrame:
    """First matching (pattern, label) of an ordered rule list."""
    expr = None
    for pattern, label in rules:
        hit = F.col(col).rlike(pattern)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return names.withColumn(out, expr.otherwise(default))


def family_groups(dictionary: DataFrame, cap: int = 8) -> DataFrame:
    """Columns per family with the first ``cap`` names as text and missingness totals.

    One row per column of a table, so the list is bounded by the schema.
    """
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"])
    g = dictionary.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_columns"), names.alias("_names"),
        F.count_if(F.col("n_missing") > 0).alias("n_with_missing"), F.max("pct_missing").alias("max_pct_missing"))
    text = F.array_join(F.slice("_names", 1, cap), ", ")
    return g.select("family", "n_columns",
                    F.when(F.size("_names") > cap, F.concat(text, F.lit(", ..."))).otherwise(text).alias("examples"),
                    "n_with_missing", "max_pct_missing")
