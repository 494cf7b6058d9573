"""SQL text of the input roles, for the oracle side of every query."""

from __future__ import annotations

import re

ROLES: dict[str, str] = {
    "r_readings": """
        SELECT user_id, event_id, ts, CAST(ts AS DATE) AS date,
               CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN NULL
                    WHEN event_type = 'error' AND event_id % 10 = 1 THEN -floor(value * 64) / 64
                    ELSE floor(value * 64) / 64 END AS kwh
        FROM events""",
    "r_meter": """
        SELECT l_suppkey AS user_id,
               l_shipdate + to_hours(CAST((l_orderkey * 5 + l_linenumber) % 24 AS INTEGER)) AS ts,
               CAST(l_shipdate AS DATE) AS date,
               CAST((l_orderkey * 5 + l_linenumber) % 24 AS INTEGER) AS hour,
               l_quantity / 8 AS kwh
        FROM lineitem""",
    "r_daily": """
        SELECT user_id, date, sum(kwh) AS daily_kwh, avg(kwh) AS mean_hourly_kwh,
               min(kwh) AS min_hourly_kwh, max(kwh) AS max_hourly_kwh,
               stddev_samp(kwh) AS sd_hourly_kwh, count(*) AS hours_recorded
        FROM r_meter GROUP BY user_id, date""",
    "r_short_daily": """
        SELECT user_id, date, sum(kwh) AS daily_kwh, avg(kwh) AS mean_hourly_kwh,
               min(kwh) AS min_hourly_kwh, max(kwh) AS max_hourly_kwh,
               stddev_samp(kwh) AS sd_hourly_kwh, count(*) AS hours_recorded
        FROM r_readings WHERE kwh IS NOT NULL AND kwh >= 0 GROUP BY user_id, date""",
    "r_contracts": """
        SELECT o_custkey AS user_id, o_orderkey AS contract_id,
               CAST(c_nationkey * 1000 + o_custkey % 1000 AS INTEGER) AS postcode,
               CASE o_orderpriority WHEN '1-URGENT' THEN '2.0TD' WHEN '2-HIGH' THEN '2.0DHA'
                    WHEN '3-MEDIUM' THEN '3.0TD' WHEN '5-LOW' THEN '' END AS tariff,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE CAST((o_orderkey * 37) % 9900 AS VARCHAR) || '.0' END AS activity,
               floor(c_acctbal / 8) / 64 AS p1_kw,
               strftime(o_orderdate, '%d/%m/%Y') AS start_text,
               CASE WHEN o_orderstatus = 'F' THEN
                    strftime(o_orderdate + to_days(CAST(o_orderkey % 400 - 20 AS INTEGER)), '%d/%m/%Y') END AS end_text
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "r_user": """
        SELECT user_id, contract_id, postcode, substr(lpad(CAST(postcode AS VARCHAR), 5, '0'), 1, 2) AS province,
               tariff, coalesce(nullif(tariff, ''), 'unknown') AS tariff_clean, activity, p1_kw,
               CAST(strptime(start_text, '%d/%m/%Y') AS DATE) AS start_date
        FROM r_contracts
        QUALIFY row_number() OVER (PARTITION BY user_id
            ORDER BY (tariff IS NOT NULL AND tariff <> '') DESC,
                     strptime(start_text, '%d/%m/%Y') DESC NULLS LAST, contract_id DESC) = 1""",
    "r_weather": """
        SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS province,
               'S' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS station,
               CAST(l_shipdate AS DATE) AS date,
               avg(l_quantity) / 2 AS tmean, max(l_quantity) / 2 + 2 AS tmax,
               min(l_quantity) / 2 - 2 AS tmin,
               CASE WHEN day(l_shipdate) % 7 = 0 THEN NULL ELSE sum(round(l_tax * 100)) / 4 END AS prec,
               avg(round(l_discount * 100)) * 10 AS rh,
               CASE WHEN day(l_shipdate) % 5 = 0 THEN NULL ELSE CAST(max(l_linenumber) * 2 AS DOUBLE) END AS sun,
               CAST(count(*) AS DOUBLE) AS wind
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY s_nationkey, l_shipdate""",
    "r_panel": """
        SELECT d.user_id, d.date, d.daily_kwh, d.hours_recorded,
               lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') AS province,
               w.tmean, w.tmax, w.tmin, w.prec,
               CASE WHEN w.tmean IS NOT NULL THEN greatest(0.0, 15 - w.tmean) END AS hdd,
               CASE WHEN w.tmean IS NOT NULL THEN greatest(0.0, w.tmean - 22) END AS cdd
        FROM r_daily d JOIN supplier s ON d.user_id = s.s_suppkey
        LEFT JOIN r_weather w ON w.province = lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0')
             AND w.date = d.date - 1""",
    "r_portfolio": """
        SELECT date, sum(daily_kwh) AS y, count(DISTINCT user_id) AS n_users
        FROM r_daily GROUP BY date""",
    "r_labels": """
        SELECT u.user_id, CASE WHEN m < 3 THEN -1 ELSE CAST(s_nationkey % 4 AS INTEGER) END AS cluster
        FROM (SELECT user_id, avg(daily_kwh) AS m FROM r_daily GROUP BY user_id) u
        JOIN supplier ON u.user_id = s_suppkey""",
    "r_cluster_daily": """
        SELECT date, cluster, sum(daily_kwh) AS y, count(DISTINCT d.user_id) AS n_users
        FROM r_daily d JOIN r_labels l ON d.user_id = l.user_id GROUP BY date, cluster""",
    "r_cal": """
        SELECT date, isodow(date) AS dow, month(date) AS month, dayofyear(date) AS doy,
               CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring'
                    WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season
        FROM (SELECT DISTINCT date FROM r_daily)""",
    "r_forecast": """
        SELECT date, y, n_users,
               lag(y, 1) OVER (ORDER BY date) AS naive,
               lag(y, 7) OVER (ORDER BY date) AS weekly,
               CASE WHEN row_number() OVER (ORDER BY date) > 7 THEN
                   avg(y) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS rolling
        FROM r_portfolio""",
    "r_cluster_forecast": """
        SELECT date, cluster, y, n_users,
               lag(y, 1) OVER (PARTITION BY cluster ORDER BY date) AS naive,
               CASE WHEN row_number() OVER (PARTITION BY cluster ORDER BY date) > 7 THEN
                   avg(y) OVER (PARTITION BY cluster ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS pred
        FROM r_cluster_daily""",
}


def _needed(text: str) -> list[str]:
    """Roles used by the text, dependencies first."""
    order: list[str] = []

    def visit(t: str) -> None:
        for role in ROLES:
            if re.search(rf"\b{role}\b", t) and role not in order:
                visit(ROLES[role])
                order.append(role)

    visit(text)
    return order


def with_roles(body: str) -> str:
    """Prepend the role definitions the body refers to as common table expressions."""
    body = body.strip()
    ctes = [f"{role} AS ({ROLES[role]})" for role in _needed(body)]
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
