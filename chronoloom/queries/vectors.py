"""Queries of vector autoregressions on log differences."""

from __future__ import annotations

from chronoloom.plans import vectors
from chronoloom.queries.base import BY, SHIPPED, query, shipped
from chronoloom.queries.fitted_sql import column, dot, doubles, solve

MOST = 4

_x = doubles(["1", *[f"lag({c}, {s}) OVER o" for s in range(1, MOST + 1) for c in ("dq", "dr")]])
_left = [f"(y[{j}] - {dot(column('w', j), 'x')})" for j in (1, 2)]


def _order(p: int) -> str:
    """Weights of order p, padded, and its criterion."""
    m = 1 + 2 * p
    return f"""r{p} AS (SELECT sid AS k, x[1:{m}] AS x, y FROM t), {solve(f"s{p}", f"r{p}", m, 2)},
e{p} AS (SELECT k, w, avg({_left[0]} ** 2) AS a, avg({_left[0]} * {_left[1]}) AS b, avg({_left[1]} ** 2) AS c, count(*) AS n FROM r{p} JOIN s{p} USING (k) GROUP BY k, w),
a{p} AS (SELECT k, {p} AS p, ln(a * c - b * b) + 2.0::DOUBLE * {2 * m} / n AS aic, list_concat(w, list_transform(range({2 * (MOST - p)}), lambda i: [0.0::DOUBLE, 0.0])) AS w FROM e{p})"""


SQL = f"""WITH RECURSIVE {SHIPPED}, g AS (SELECT sid, time, qty, rev, ln(qty) - lag(ln(qty)) OVER o AS dq, ln(rev) - lag(ln(rev)) OVER o AS dr FROM s WINDOW o AS (PARTITION BY sid ORDER BY time)),
t AS (SELECT * FROM (SELECT sid, {_x} AS x, [dq, dr] AS y, row_number() OVER o AS i FROM g WINDOW o AS (PARTITION BY sid ORDER BY time)) WHERE i > {MOST + 1}),
{", ".join(_order(p) for p in range(1, MOST + 1))},
best AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM a{p}" for p in range(1, MOST + 1))}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY aic, p) = 1),
z AS (SELECT sid, 0 AS step, last(qty ORDER BY time) AS q, last(rev ORDER BY time) AS v, flatten(list_reverse(list([dq, dr] ORDER BY time))[1:{MOST}]) AS h FROM g GROUP BY sid
  UNION ALL SELECT sid, step + 1, q * exp(a), v * exp(b), list_concat([a, b], h[1:{2 * MOST - 2}]) FROM (SELECT z.*, {dot(column("best.w"), "list_concat([1.0::DOUBLE], h)")} AS a, {dot(column("best.w", 2), "list_concat([1.0::DOUBLE], h)")} AS b FROM z JOIN best ON best.k = z.sid WHERE step < 5))
---
SELECT sid, p AS "order", aic, step, q AS qty, v AS rev FROM z JOIN best ON best.k = z.sid WHERE step > 0"""


@query("var_log", "sid order:i aic:d step:i qty:d rev:d", SQL)
def var_log(spark, d):
    return vectors.var_log(shipped(spark, d), BY, ["qty", "rev"], MOST)
