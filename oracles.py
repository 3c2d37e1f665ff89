"""SQL that computes the same results as the registered queries, for an independent engine.

Written against the definitions of the results, not against the Spark plans: plain joins, windows and sorts.
"""

from __future__ import annotations

import math

import numpy as np

# the order-line view, every column
LINES = """
base AS (
  SELECT l.*, o.*, c.c_mktsegment, p.p_brand, p.p_type, p.p_retailprice, s.s_name,
         n.n_name, r.r_name, sn.n_name AS sn_name, sr.r_name AS sr_name,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
              WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END AS shipping_mode,
         CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END AS BIGINT)
           AS days_scheduled,
         CAST(((date_diff('day', o_orderdate, l_shipdate) % 7) + 7) % 7 AS BIGINT) AS days_real,
         CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN 'SUSPECTED_FRAUD'
              WHEN o_orderstatus = 'P' AND l_returnflag = 'A' THEN 'CANCELED'
              WHEN o_orderstatus = 'P' THEN 'PENDING'
              WHEN o_orderstatus = 'O' AND l_returnflag = 'N' THEN 'PROCESSING'
              WHEN o_orderstatus = 'O' THEN 'ON_HOLD'
              WHEN o_orderstatus = 'F' AND l_returnflag = 'N' THEN 'CLOSED'
              WHEN o_orderstatus = 'F' THEN 'COMPLETE' END AS order_status,
         l_extendedprice * (1e0 - l_discount) AS item_total,
         l_quantity * p_retailprice AS cost
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey
),
lines AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d')) AS line_id,
         o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts,
         n_name AS order_region, r_name AS market, sr_name AS source_market, sn_name AS order_country, s_name AS order_city,
         c_mktsegment AS customer_segment, p_brand AS category_name, p_type AS department_name,
         shipping_mode, days_scheduled, days_real, order_status,
         CASE o_orderkey % 4 WHEN 0 THEN 'CASH' WHEN 1 THEN 'DEBIT' WHEN 2 THEN 'PAYMENT' ELSE 'TRANSFER' END AS payment_type,
         l_extendedprice AS sales, l_quantity AS quantity, l_discount AS discount_rate, p_retailprice AS product_price,
         item_total, item_total - cost AS benefit, (item_total - cost) / greatest(item_total, cost) AS profit_ratio,
         CASE WHEN order_status IN ('SUSPECTED_FRAUD', 'CANCELED') THEN 'Shipping canceled'
              WHEN days_real > days_scheduled THEN 'Late delivery'
              WHEN days_real = days_scheduled THEN 'Shipping on time'
              ELSE 'Advance shipping' END AS delivery_status,
         CAST(CASE WHEN days_real > days_scheduled AND order_status NOT IN ('SUSPECTED_FRAUD', 'CANCELED')
              THEN 1 ELSE 0 END AS BIGINT) AS late_risk,
         CAST(month(o_orderdate) AS BIGINT) AS order_month, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS order_weekday,
         CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(hour(o_orderdate) AS BIGINT) AS order_hour,
         CAST(day(o_orderdate) AS BIGINT) AS order_day, CAST(quarter(o_orderdate) AS BIGINT) AS order_quarter
  FROM base
)"""

# the split and the scorer the evaluation queries run on
SCORES = (
    LINES
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY late_risk ORDER BY md5('42|' || line_id), line_id) AS rn,
         count(*) OVER (PARTITION BY late_risk) AS cn FROM lines
),
parts AS (SELECT *, CASE WHEN rn <= floor(0.2e0 * cn + 0.5e0) THEN 'test' ELSE 'train' END AS split FROM ranked),
cell AS (SELECT shipping_mode, order_status, avg(late_risk) AS p FROM parts WHERE split = 'train' GROUP BY ALL),
scores AS (
  SELECT line_id, 'cell_rate' AS model, late_risk AS y, p, profit_ratio
  FROM parts JOIN cell USING (shipping_mode, order_status) WHERE split = 'test'
),
ladder AS (
  SELECT model, p, pos, neg, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp,
         sum(pos) OVER (PARTITION BY model) AS all_pos, sum(neg) OVER (PARTITION BY model) AS all_neg
  FROM (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY model, p)
  WINDOW down AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
)"""
)

NUMBERS = ("days_scheduled", "sales", "quantity", "discount_rate", "product_price", "benefit", "profit_ratio")
DATE_PARTS = ("order_month", "order_weekday", "order_year", "order_hour")
DIMENSIONS = (
    "shipping_mode", "order_region", "market", "customer_segment", "department_name", "category_name", "order_status",
    "days_scheduled", "payment_type",
)
LEVELS = {
    "payment_type": ["CASH", "DEBIT", "PAYMENT", "TRANSFER"],
    "category_name": sorted(f"Brand#{i}" for i in range(1, 26)),
    "customer_segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "department_name": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "market": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "order_region": sorted(f"NATION_{i}" for i in range(25)),
    "order_status": ["CANCELED", "CLOSED", "COMPLETE", "ON_HOLD", "PENDING", "PROCESSING", "SUSPECTED_FRAUD"],
    "shipping_mode": ["First Class", "Same Day", "Second Class", "Standard Class"],
}


def r(expr: str, name: str, places: int = 6) -> str:
    """A rounded column; the nudge settles exact halves, which sums in another order would round either way."""
    return f"round(CAST({expr} AS DOUBLE) + {3.3e-4 * 10.0**-places!r}, {places}) + 0e0 AS {name}"


def on_lines(body: str, extra: str = "") -> str:
    return f"WITH {LINES}{extra} {body}"


def on_scores(body: str, extra: str = "") -> str:
    return f"WITH {SCORES}{extra} {body}"


def rate(dims: str, table: str = "lines") -> str:
    present = " AND ".join(f"{d.strip()} IS NOT NULL" for d in dims.split(","))
    return on_lines(f"SELECT {dims}, count(*) AS n, {r('avg(late_risk)', 'rate')} FROM {table} WHERE {present} GROUP BY {dims}")


def rate_of_top(dim: str, k: int) -> str:
    return on_lines(
        f"SELECT {dim}, count(*) AS n, {r('avg(late_risk)', 'rate')} FROM lines "
        f"WHERE {dim} IN (SELECT {dim} FROM lines GROUP BY {dim} ORDER BY count(*) DESC, {dim} LIMIT {k}) GROUP BY {dim}"
    )


def shares(row: str, column: str, where: str = "TRUE", source: str = "lines") -> str:
    return on_lines(
        f"SELECT {row}, {column}, n, {r(f'n / sum(n) OVER (PARTITION BY {row})', 'share')} FROM full_table",
        f""",
src AS (SELECT {row}, {column} FROM {source} WHERE {where}),
cnt AS (SELECT {row}, {column}, count(*) AS n FROM src GROUP BY {row}, {column}),
full_table AS (
  SELECT a.{row}, b.{column}, coalesce(cnt.n, 0) AS n
  FROM (SELECT DISTINCT {row} FROM src) a CROSS JOIN (SELECT DISTINCT {column} FROM src) b
  LEFT JOIN cnt ON cnt.{row} = a.{row} AND cnt.{column} = b.{column}
)""",
    )


def histogram(
    ctes: str, source: str, column: str, bins: int, low: str, high: str, by: str | None = None, places: int = 6
) -> str:
    """Counts in equal-width bins, the last one closed; low and high are SQL expressions over the source."""
    key = by or "'all'"
    shown = f"{by}, " if by else ""
    return f"""WITH {ctes},
src AS (SELECT {key} AS k, {column} AS x FROM {source} WHERE {column} IS NOT NULL),
ends AS (SELECT {low} AS lo, {high} AS hi FROM src),
cnt AS (
  SELECT k, CAST(least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
  FROM src CROSS JOIN ends WHERE x >= lo AND x <= hi GROUP BY 1, 2
)
SELECT {shown.replace(by or '', f'keys.k AS {by}') if by else ''}g.bin AS bin,
       {r(f'lo + g.bin * (hi - lo) / {bins}', 'bin_low', places)},
       {r(f'lo + (g.bin + 1) * (hi - lo) / {bins}', 'bin_high', places)}, coalesce(n, 0) AS n
FROM (SELECT DISTINCT k FROM cnt) keys
CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range({bins})) g CROSS JOIN ends
LEFT JOIN cnt ON cnt.k = keys.k AND cnt.bin = g.bin"""


def box(column: str, by: str, places: int = 6) -> str:
    def quart(p):
        return f"quantile_cont(CAST({column} AS DOUBLE), {p}) OVER (PARTITION BY {by})"

    inside = "x BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)"
    return on_lines(
        f"SELECT {by}, count(*) AS n, {r('any_value(q1)', 'q1', places)}, {r('any_value(median)', 'median', places)}, "
        f"{r('any_value(q3)', 'q3', places)}, {r(f'min(x) FILTER ({inside})', 'whisker_low', places)}, "
        f"{r(f'max(x) FILTER ({inside})', 'whisker_high', places)}, count(*) FILTER (NOT ({inside})) AS outliers "
        f"FROM q GROUP BY {by}",
        f", q AS (SELECT {by}, CAST({column} AS DOUBLE) AS x, {quart(0.25)} AS q1, {quart(0.5)} AS median, "
        f"{quart(0.75)} AS q3 FROM lines)",
    )


def kde(
    ctes: str, source: str, column: str, by: str | None, grid: int, cut: float, places: dict, scale: int | None = None,
    with_quartiles: bool = False, spacing: float | None = None,
) -> str:
    """Gaussian density on an even grid, from collapsed values, or from nodes that share the values between them."""
    key = by or "'all'"
    values = "val AS (SELECT k, x, count(*) AS w FROM src GROUP BY k, x)"
    if spacing:
        values = f"""placed AS (SELECT k, mn, h, (x - mn) / (h * {spacing}e0) AS z FROM src JOIN st USING (k)),
shared AS (
  SELECT k, mn, h, floor(z) AS node, 1 - (z - floor(z)) AS w FROM placed UNION ALL SELECT k, mn, h, floor(z) + 1, z - floor(z) FROM placed
),
val AS (SELECT k, any_value(mn) + node * any_value(h) * {spacing}e0 AS x, sum(w) AS w FROM shared GROUP BY k, node)"""
    density = "sum(w * exp(-0.5e0 * ((x - (lo + i * step)) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))"
    if scale:
        density += f" * any_value(n) * any_value(mx - mn) / {scale}"
    quarts = ""
    if with_quartiles:
        quarts = "".join(f", {r(f'any_value({c})', c, places.get(c, 6))}" for c in ("q1", "median", "q3"))
    return f"""WITH {ctes},
src AS (SELECT {key} AS k, CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
st AS (
  SELECT k, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2e0) AS h, min(x) AS mn, max(x) AS mx,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
  FROM src GROUP BY k
),
{values},
gr AS (SELECT *, mn - {cut}e0 * h AS lo, (mx - mn + 2e0 * {cut}e0 * h) / {grid - 1} AS step FROM st)
SELECT {f'gr.k AS {by}, ' if by else ''}i AS grid_index, {r('any_value(lo + i * step)', 'x', places.get('x', 6))},
       {r(density, 'density', places.get('density', 6))}{quarts}
FROM gr JOIN val USING (k) CROSS JOIN (SELECT CAST(range AS BIGINT) AS i FROM range({grid})) g
GROUP BY gr.k, i"""


def kde_2d(grid: int = 200, cut: float = 3.0) -> str:
    return f"""WITH {LINES},
smp AS (SELECT * FROM lines ORDER BY md5('42|' || line_id), line_id LIMIT 5000),
st AS (
  SELECT late_risk, count(*) AS n, var_samp(discount_rate) * pow(count(*), -1e0/3) AS vx,
         var_samp(profit_ratio) * pow(count(*), -1e0/3) AS vy,
         covar_samp(discount_rate, profit_ratio) * pow(count(*), -1e0/3) AS vxy,
         min(discount_rate) AS x0, max(discount_rate) AS x1, min(profit_ratio) AS y0, max(profit_ratio) AS y1
  FROM smp GROUP BY late_risk
),
gr AS (
  SELECT min(x0 - {cut}e0 * sqrt(vx)) AS x0, max(x1 + {cut}e0 * sqrt(vx)) AS x1,
         min(y0 - {cut}e0 * sqrt(vy)) AS y0, max(y1 + {cut}e0 * sqrt(vy)) AS y1 FROM st
),
pts AS (
  SELECT CAST(a.range AS BIGINT) AS x_index, CAST(b.range AS BIGINT) AS y_index,
         x0 + a.range * (x1 - x0) / {grid - 1} AS x, y0 + b.range * (y1 - y0) / {grid - 1} AS y
  FROM gr CROSS JOIN range({grid}) a CROSS JOIN range({grid}) b
)
SELECT late_risk, x_index, y_index, {r('any_value(x)', 'x')}, {r('any_value(y)', 'y')},
  {r('''any_value(st.n) / 5000e0 * sum(exp(-0.5e0 * (vy * (discount_rate - x) ** 2
        - 2e0 * vxy * (discount_rate - x) * (profit_ratio - y) + vx * (profit_ratio - y) ** 2) / (vx * vy - vxy * vxy)))
        / (any_value(st.n) * sqrt(any_value(vx * vy - vxy * vxy)) * 2e0 * pi())''', 'density')}
FROM smp JOIN st USING (late_risk) CROSS JOIN pts GROUP BY late_risk, x_index, y_index"""


def describe() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, late_risk, count({c}) AS count, {r(f'avg({c})', 'mean', 3)}, "
        f"{r(f'stddev_samp({c})', 'std', 3)}, {r(f'min({c})', 'min', 3)}, "
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 'p25', 3)}, "
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'p50', 3)}, "
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 'p75', 3)}, {r(f'max({c})', 'max', 3)} "
        f"FROM lines GROUP BY late_risk"
        for c in (*NUMBERS, *DATE_PARTS)
    ]
    return on_lines(" UNION ALL ".join(parts))


def correlations() -> str:
    columns = (*NUMBERS, "late_risk", *DATE_PARTS)
    parts = [
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
        + r(f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)", "corr")
        + " FROM lines"
        for a in columns
        for b in columns
    ]
    return on_lines(" UNION ALL ".join(parts))


def describe_wide() -> str:
    parts = []
    for c in (*NUMBERS, *DATE_PARTS):
        x = f"CAST({c} AS DOUBLE)"
        kinds = {
            "count": f"CAST(count({c}) AS DOUBLE)", "mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})",
            "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)", "p75": f"quantile_cont({x}, 0.75)",
            "max": f"max({x})",
        }
        for name, expr in kinds.items():
            halves = ", ".join(r(f"{expr} FILTER (late_risk = {k})" if name != "count" else f"count({c}) FILTER (late_risk = {k})", f'"{k}"', 3) for k in (0, 1))
            parts.append(f"SELECT '{c}' AS column_name, '{name}' AS statistic, {halves} FROM lines")
    return on_lines(" UNION ALL ".join(parts))


def correlations_wide() -> str:
    columns = (*NUMBERS, "late_risk", *DATE_PARTS)
    parts = [
        f"SELECT '{a}' AS column_name, "
        + ", ".join(r(f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)", b) for b in columns)
        + " FROM lines"
        for a in columns
    ]
    return on_lines(" UNION ALL ".join(parts))


def every_dim() -> str:
    parts = [
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, count(*) AS n, {r('avg(late_risk)', 'rate')} "
        f"FROM lines WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in DIMENSIONS
    ]
    return on_lines(" UNION ALL ".join(parts))


def one_hot() -> str:
    columns = [
        f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS \"{c}_{v}\"" for c, vs in LEVELS.items() for v in vs[1:]
    ]
    return on_lines(f"SELECT line_id, {', '.join(columns)} FROM lines")


def interactions() -> str:
    names = ("days_scheduled", "sales", "discount_rate", "quantity")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    products = [r(f"CAST({a} AS DOUBLE) * {b}", f'"{a} {b}"') for a, b in pairs]
    return on_lines(f"SELECT line_id, {', '.join(products)} FROM lines")


def standardized() -> str:
    columns = [
        r(f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) END", c)
        for c in (*NUMBERS, *DATE_PARTS)
    ]
    return on_lines(f"SELECT line_id, {', '.join(columns)} FROM lines")


def cost_curve_cte() -> str:
    grid = ", ".join(f"({i}, CAST({float(t)!r} AS DOUBLE))" for i, t in enumerate(np.linspace(0.05, 0.95, 50)))
    return f""",
grid(grid_index, threshold) AS (VALUES {grid}),
curve AS (
  SELECT model, CAST(grid_index AS BIGINT) AS grid_index, threshold,
         coalesce(sum(profit_ratio) FILTER (y = 1 AND p < threshold), 0) + 0.15e0 * count(*) FILTER (y = 0 AND p >= threshold)
           AS cost
  FROM scores CROSS JOIN grid GROUP BY ALL
)"""


def survival_cte() -> str:
    return """,
leaving AS (
  SELECT shipping_mode, days_real AS t, count(*) AS d FROM lines
  WHERE shipping_mode IN ('Standard Class', 'First Class') GROUP BY ALL
),
curve AS (
  SELECT shipping_mode, t, d, total - coalesce(sum(d) OVER before, 0) AS at_risk,
         (total - sum(d) OVER upto) / total AS survival
  FROM (SELECT *, sum(d) OVER (PARTITION BY shipping_mode) AS total FROM leaving)
  WINDOW before AS (PARTITION BY shipping_mode ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto AS (PARTITION BY shipping_mode ORDER BY t ROWS UNBOUNDED PRECEDING)
)"""


def silhouette_by_rule() -> str:
    measures = ("late_risk_rate", "avg_scheduled_days", "avg_sales", "vol")
    scaled = ", ".join(f"({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER () AS z{i}" for i, m in enumerate(measures))
    gap = " + ".join(f"(a.z{i} - b.z{i}) ** 2" for i in range(4))
    return on_lines(
        f"""SELECT order_region, category_name, cluster, {r('a', 'a')}, {r('b', 'b')},
       {r('CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END', 'silhouette')} FROM ab""",
        f""",
cells AS (
  SELECT order_region, category_name, avg(late_risk) AS late_risk_rate, avg(days_scheduled) AS avg_scheduled_days,
         avg(sales) AS avg_sales, ln(1 + count(sales)) AS vol
  FROM lines GROUP BY order_region, category_name HAVING count(sales) >= 10
),
pts AS (
  SELECT order_region, category_name, CAST(CASE WHEN late_risk_rate >= avg(late_risk_rate) OVER () THEN 1 ELSE 0 END AS BIGINT) AS cluster, {scaled}
  FROM cells
),
sums AS (
  SELECT a.order_region, a.category_name, a.cluster, b.cluster AS other, sum(sqrt({gap})) AS s, count(*) AS n
  FROM pts a CROSS JOIN pts b GROUP BY ALL
),
ab AS (
  SELECT order_region, category_name, cluster, max(s / nullif(n - 1, 0)) FILTER (other = cluster) AS a,
         min(s / n) FILTER (other <> cluster) AS b, max(n) FILTER (other = cluster) AS own
  FROM sums GROUP BY ALL
)""",
    )


def centrality(rounds: int = 60) -> str:
    """Power iteration on the undirected graph plus the identity, written out round by round."""
    steps = [
        """,
e AS (SELECT source_market AS s, order_region AS d, avg(late_risk) AS w FROM lines GROUP BY ALL),
links AS (SELECT s, d, w FROM e UNION ALL SELECT d, s, w FROM e),
v0 AS (SELECT DISTINCT s AS node, 1e0 AS x FROM links)"""
    ]
    for i in range(rounds):
        steps.append(
            f"""u{i} AS MATERIALIZED (
  SELECT node, sum(x) AS x FROM (
    SELECT d AS node, w * x AS x FROM links JOIN v{i} ON links.s = v{i}.node UNION ALL SELECT node, x FROM v{i}
  ) GROUP BY node
),
v{i + 1} AS MATERIALIZED (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM u{i}) AS x FROM u{i})"""
        )
    return on_lines(
        f"SELECT node, {r('x', 'centrality')} FROM v{rounds} ORDER BY round(x, 9) DESC, node LIMIT 15", ",\n".join(steps)
    )


def oracle_queries() -> dict[str, str]:
    kde_digits = {"density": 10, "x": 4, "q1": 4, "median": 4, "q3": 4}
    money_digits = kde_digits | {"density": 12}
    bits = f"-sum(CASE WHEN n > 0 THEN (n / t) * ln(n / t) END) / {math.log(2)!r}"
    states = """,
st AS (SELECT order_region, delivery_status, count(*) AS n FROM lines GROUP BY ALL),
ent AS (
  SELECT order_region, %s AS entropy_bits
  FROM (SELECT *, sum(n) OVER (PARTITION BY order_region) AS t FROM st) GROUP BY order_region
)""" % bits  # noqa: UP031
    residual = SCORES + ", res AS (SELECT model, y - p AS residual FROM scores)"
    logs = LINES + ", logs AS (SELECT ln(1e0 + sales) AS log_sales FROM lines)"
    ranked = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY late_risk ORDER BY md5('42|' || line_id), line_id) AS rn, count(*) OVER (PARTITION BY late_risk) AS cn, count(*) OVER () AS total FROM lines)"  # noqa: E501
    z95 = "1.959963984540054e0"
    greenwood = f"{z95} * sqrt((1 - survival) / (survival * total)) / abs(ln(survival))"
    return {
        "scan_order_lines": on_lines(
            "SELECT line_id, order_id, customer_id, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts, order_region, market, "
            "source_market, order_country, order_city, customer_segment, category_name, department_name, shipping_mode, "
            f"days_scheduled, days_real, order_status, payment_type, {r('sales', 'sales')}, {r('quantity', 'quantity')}, "
            f"{r('discount_rate', 'discount_rate')}, {r('product_price', 'product_price')}, {r('item_total', 'item_total')}, "
            f"{r('benefit', 'benefit')}, {r('profit_ratio', 'profit_ratio')}, delivery_status, late_risk FROM lines"
        ),
        "leakage_audit": on_lines(
            "SELECT count(*) AS n, "
            + r("avg(CASE WHEN (days_real > days_scheduled) = (late_risk = 1) THEN 1e0 ELSE 0e0 END)", "agreement")
            + " FROM lines"
        ),
        "clean_projection": on_lines(
            "SELECT order_region, market, source_market, order_country, order_city, customer_segment, category_name, "
            f"department_name, shipping_mode, days_scheduled, order_status, payment_type, {r('sales', 'sales')}, "
            f"{r('quantity', 'quantity')}, {r('discount_rate', 'discount_rate')}, {r('product_price', 'product_price')}, "
            f"{r('benefit', 'benefit')}, {r('profit_ratio', 'profit_ratio')}, late_risk, order_month, order_weekday, "
            "order_year, order_hour FROM lines"
        ),
        "date_parts": on_lines(
            "SELECT line_id, order_month, order_weekday, order_year, order_hour, order_day, order_quarter FROM lines"
        ),
        "overall_rate": on_lines(f"SELECT count(*) AS n, {r('avg(late_risk)', 'rate')} FROM lines"),
        "class_balance": on_lines("SELECT late_risk, count(*) AS n FROM lines GROUP BY late_risk"),
        "risk_by_shipping_mode": rate("shipping_mode"),
        "risk_by_region": rate("order_region"),
        "risk_by_region_published": on_lines(f"SELECT order_region, {r('avg(late_risk)', 'late_risk_rate')} FROM lines GROUP BY 1"),
        "risk_by_market": rate("market"),
        "risk_by_segment": rate("customer_segment"),
        "risk_by_department": rate("department_name"),
        "risk_by_top_categories": rate_of_top("category_name", 15),
        "status_volume": on_lines("SELECT order_status, count(*) AS n FROM lines GROUP BY order_status"),
        "risk_by_status": rate("order_status"),
        "risk_by_scheduled_days": rate("days_scheduled"),
        "monthly_volume_risk": rate("order_month"),
        "weekday_risk": on_lines(
            f"SELECT order_weekday, count(*) AS n, {r('avg(late_risk)', 'rate')}, "
            "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][order_weekday + 1] AS label FROM lines GROUP BY order_weekday"
        ),
        "hourly_volume_risk": (
            "SELECT CAST(hour(ts) AS BIGINT) AS order_hour, count(*) AS n, "
            + r("avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END)", "rate")
            + " FROM events GROUP BY 1"
        ),
        "risk_by_top_countries": rate_of_top("order_country", 10),
        "risk_by_payment_type": rate("payment_type"),
        "yearly_risk": rate("order_year"),
        "risk_by_top_cities": rate_of_top("order_city", 20),
        "delay_by_department": on_lines(
            f"SELECT department_name, {r('avg(days_real - days_scheduled)', 'mean_delay')} FROM lines GROUP BY department_name"
        ),
        "delivery_status_share": on_lines(
            f"SELECT delivery_status, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')} "
            "FROM lines GROUP BY delivery_status"
        ),
        "region_category_cells": on_lines(
            f"SELECT order_region, category_name, {r('avg(late_risk)', 'late_risk_rate')}, "
            f"{r('avg(days_scheduled)', 'avg_scheduled_days')}, {r('avg(sales)', 'avg_sales', 4)}, count(sales) AS order_volume "
            "FROM lines GROUP BY order_region, category_name HAVING count(sales) >= 10"
        ),
        "describe_by_class": describe(),
        "correlation_matrix": correlations(),
        "risk_by_all_dims": every_dim(),
        "risk_mode_x_region": rate("shipping_mode, order_region"),
        "risk_mode_x_region_wide": on_lines(
            "SELECT shipping_mode, "
            + ", ".join(r(f"avg(late_risk) FILTER (order_region = '{s}')", s) for s in LEVELS["order_region"])
            + " FROM lines GROUP BY shipping_mode"
        ),
        "describe_by_class_wide": describe_wide(),
        "correlation_matrix_wide": correlations_wide(),
        "risk_mode_x_segment": rate("shipping_mode, customer_segment"),
        "risk_mode_x_segment_wide": on_lines(
            "SELECT shipping_mode, "
            + ", ".join(r(f"avg(late_risk) FILTER (customer_segment = '{s}')", s) for s in LEVELS["customer_segment"])
            + " FROM lines GROUP BY shipping_mode"
        ),
        "status_composition": shares(
            "class", "order_status", source="(SELECT *, CASE late_risk WHEN 0 THEN 'On-time' ELSE 'Late-risk' END AS class FROM lines)"
        ),
        "risk_month_x_day": rate("order_month, order_day"),
        "risk_yoy": rate("order_month, order_year"),
        "risk_market_x_region": rate("market, order_region"),
        "risk_segment_x_payment": rate("customer_segment, payment_type"),
        "category_region_counts": on_lines(
            "SELECT a.order_region, b.category_name, count(l.line_id) AS n FROM (SELECT DISTINCT order_region FROM lines) a "
            "CROSS JOIN (SELECT category_name FROM lines GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) b "
            "LEFT JOIN lines l ON l.order_region = a.order_region AND l.category_name = b.category_name GROUP BY ALL"
        ),
        "risk_department_x_payment": rate("department_name, payment_type"),
        "transition_matrix": shares("days_scheduled", "days_real", "days_scheduled >= 0 AND days_real >= 0"),
        "status_share_by_region": shares("order_region", "delivery_status"),
        "hist_scheduled_days": histogram(LINES, "lines", "days_scheduled", 7, "min(0e0)", "max(7e0)", "late_risk"),
        "hist_sales": histogram(LINES, "lines", "sales", 60, "min(x)", "max(x)", places=4),
        "hist_quantity": histogram(LINES, "lines", "quantity", 5, "min(1e0)", "max(6e0)", "late_risk"),
        "log_sales_histogram": histogram(logs, "logs", "log_sales", 50, "min(x)", "max(x)"),
        "residual_histogram": histogram(residual, "res", "residual", 50, "min(x)", "max(x)", "model"),
        "hist_predicted": histogram(SCORES, "scores", "p", 10, "min(0e0)", "max(1e0)", "model"),
        "box_discount_rate": box("discount_rate", "late_risk"),
        "box_profit_ratio": box("profit_ratio", "late_risk"),
        "box_benefit": box("benefit", "late_risk", 4),
        "box_sched_by_quarter": box("days_scheduled", "order_quarter, late_risk"),
        "violin_sched": kde(LINES, "lines", "days_scheduled", "late_risk", 100, 2, kde_digits, with_quartiles=True),
        "violin_sales": kde(LINES, "lines", "sales", "late_risk", 100, 2, money_digits, with_quartiles=True),
        "violin_sales_binned": kde(LINES, "lines", "sales", "late_risk", 100, 2, money_digits, with_quartiles=True, spacing=0.02),
        "violin_profit": kde(LINES, "lines", "profit_ratio", "late_risk", 100, 2, kde_digits, with_quartiles=True),
        "violin_benefit_segment": kde(
            LINES, "lines", "benefit", "customer_segment", 100, 2, money_digits, with_quartiles=True
        ),
        "kde_log_sales": kde(logs, "logs", "log_sales", None, 200, 0, {"density": 4}, 50),
        "kde_log_sales_binned": kde(logs, "logs", "log_sales", None, 200, 0, {"density": 4}, 50, spacing=0.02),
        "kde_residuals": kde(residual, "res", "residual", "model", 200, 0, {"density": 4}, 50),
        "kde_sched_by_status": kde(LINES, "lines", "days_scheduled", "order_status", 200, 3, {}),
        "kde2d_discount_profit": kde_2d(),
        "sample_scatter": on_lines(
            f"SELECT line_id, days_scheduled, {r('sales', 'sales')}, {r('discount_rate', 'discount_rate')}, "
            f"{r('quantity', 'quantity')}, late_risk FROM lines ORDER BY md5('42|' || line_id), line_id LIMIT 8000"
        ),
        "sample_price_quantity": on_lines(
            f"SELECT line_id, {r('product_price', 'product_price')}, {r('quantity', 'quantity')}, late_risk FROM lines "
            "ORDER BY md5('42|' || line_id), line_id LIMIT 5000"
        ),
        "daily_risk_rolling": on_lines(
            f"SELECT strftime(day, '%Y-%m-%d') AS day, {r('daily_rate', 'daily_rate')}, "
            + r("CASE WHEN count(daily_rate) OVER w = 7 THEN avg(daily_rate) OVER w END", "rolling_rate")
            + " FROM cal LEFT JOIN daily USING (day) WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
            """,
daily AS (SELECT CAST(order_ts AS DATE) AS day, avg(late_risk) AS daily_rate FROM lines GROUP BY 1),
cal AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi FROM daily)
)""",
        ),
        "bullwhip_variance": on_lines(
            f"SELECT strftime(day, '%Y-%m-%d') AS day, {r('daily_total', 'daily_total', 3)}, "
            + r("CASE WHEN count(*) OVER w = 7 THEN var_samp(daily_total) OVER w END", "rolling_variance", -4)
            + " FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
            ", daily AS (SELECT CAST(order_ts AS DATE) AS day, sum(sales) AS daily_total FROM lines GROUP BY 1)",
        ),
        "fraud_monthly": on_lines(
            "SELECT strftime(last_day(month), '%Y-%m-%d') AS month_end, coalesce(n, 0) AS n FROM cal LEFT JOIN cnt USING (month)",
            """,
cnt AS (
  SELECT CAST(date_trunc('month', order_ts) AS DATE) AS month, count(*) AS n FROM lines
  WHERE order_status = 'SUSPECTED_FRAUD' GROUP BY 1
),
cal AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM (SELECT CAST(min(month) AS TIMESTAMP) AS lo, CAST(max(month) AS TIMESTAMP) AS hi FROM cnt)
)""",
        ),
        "pareto_profit": on_lines(
            f"SELECT k AS position, {r('(k - 1) / (n - 1)', 'rows_share')}, "
            + r("sum(v) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / pos", "share")
            + " FROM ord",
            """,
ord AS (
  SELECT profit_ratio AS v, row_number() OVER (ORDER BY profit_ratio DESC, line_id) AS k, count(*) OVER () AS n,
         sum(profit_ratio) FILTER (profit_ratio > 0) OVER () AS pos FROM lines
)""",
        ),
        "one_hot": one_hot(),
        "interactions": interactions(),
        "standardize": standardized(),
        "stratified_split": on_scores("SELECT line_id, late_risk, split FROM parts"),
        "stratified_subsample": on_lines(
            "SELECT line_id, late_risk FROM ranked WHERE rn <= floor(least(1e0, 40000e0 / total) * cn + 0.5e0)", ranked
        ),
        "stratified_folds": on_lines(
            "SELECT line_id, late_risk, CAST(floor((rn - 1) * 5 / cn) AS BIGINT) AS fold FROM ranked", ranked
        ),
        "cell_rate_scores": on_scores(
            f"SELECT line_id, model, y, {r('p', 'p')}, {r('profit_ratio', 'profit_ratio')} FROM scores"
        ),
        "confusion_matrix": on_scores(
            "SELECT 'cell_rate' AS model, CAST(a.range AS BIGINT) AS y, CAST(b.range AS BIGINT) AS predicted, "
            "(SELECT count(*) FROM scores WHERE y = a.range AND (p > 0.5e0) = (b.range = 1)) AS n "
            "FROM range(2) a CROSS JOIN range(2) b"
        ),
        "classification_metrics": on_scores(
            f"SELECT model, {r('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {r('tp / (tp + fp)', '\"precision\"')}, "
            f"{r('tp / (tp + fn)', 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM t",
            """,
t AS (
  SELECT model, count(*) FILTER (y = 1 AND p > 0.5e0) AS tp, count(*) FILTER (y = 0 AND p > 0.5e0) AS fp,
         count(*) FILTER (y = 1 AND p <= 0.5e0) AS fn, count(*) FILTER (y = 0 AND p <= 0.5e0) AS tn
  FROM scores GROUP BY model
)""",
        ),
        "roc_curve": on_scores(
            f"SELECT model, {r('p', 'threshold')}, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp, "
            f"{r('fp / all_neg', 'fpr')}, {r('tp / all_pos', 'tpr')} FROM ladder "
            "UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0e0, 0e0 FROM ladder"
        ),
        "roc_auc": on_scores(
            "SELECT 'cell_rate' AS model, "
            + r("sum(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0e0 END * a.pos * b.neg) "
                "/ any_value(a.all_pos * a.all_neg)", "roc_auc")
            + " FROM ladder a CROSS JOIN ladder b"
        ),
        "pr_curve": on_scores(
            f"SELECT model, {r('p', 'threshold')}, {r('tp / all_pos', 'recall')}, {r('tp / (tp + fp)', '\"precision\"')} "
            "FROM ladder UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0e0, 1e0 FROM ladder"
        ),
        "average_precision": on_scores(
            f"SELECT model, {r('sum(pos / all_pos * (tp / (tp + fp)))', 'average_precision')} FROM ladder GROUP BY model"
        ),
        "cost_curve": on_scores(
            f"SELECT model, grid_index, {r('threshold', 'threshold')}, {r('cost', 'cost')} FROM curve", cost_curve_cte()
        ),
        "cost_optimal_threshold": on_scores(
            f"SELECT model, {r('threshold', 'threshold')}, {r('cost', 'cost')} FROM curve "
            "ORDER BY round(cost, 9), threshold LIMIT 1",
            cost_curve_cte(),
        ),
        "calibration_curve": on_scores(
            "SELECT model, CAST(least(greatest(ceil(p * 10) - 1, 0), 9) AS BIGINT) AS bin, count(*) AS n, "
            f"{r('avg(p)', 'mean_predicted')}, {r('avg(y)', 'fraction_positive')} FROM scores GROUP BY 1, 2"
        ),
        "silhouette_by_rule": silhouette_by_rule(),
        "entropy_by_region": on_lines(f"SELECT order_region, {r('entropy_bits', 'entropy_bits')} FROM ent", states),
        "entropy_mean": on_lines(f"SELECT {r('avg(entropy_bits)', 'mean_entropy_bits')} FROM ent", states),
        "risk_edges": on_lines(
            f"SELECT source_market AS src, order_region AS dst, {r('avg(late_risk)', 'weight')} FROM lines "
            "GROUP BY source_market, order_region"
        ),
        "eigenvector_centrality": centrality(),
        "kaplan_meier": on_lines(
            f"""SELECT shipping_mode, t, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events,
  {r('survival', 'survival')},
  {r(f'CASE WHEN survival > 0 THEN pow(survival, exp({greenwood})) END', 'ci_low')},
  {r(f'CASE WHEN survival > 0 THEN pow(survival, exp(-{greenwood})) END', 'ci_high')}
FROM (SELECT *, sum(d) OVER (PARTITION BY shipping_mode) AS total FROM curve)""",
            survival_cte(),
        ),
        "survival_median": on_lines(
            "SELECT shipping_mode, min(t) FILTER (survival <= 0.5e0) AS median_days FROM curve GROUP BY shipping_mode",
            survival_cte(),
        ),
    }
