"""SQL of the queries that fit a model: least squares by elimination inside a recursive table, recursions step by step."""

from __future__ import annotations

from collections.abc import Sequence

from chronoloom.queries.base import HOURLY, SHIPPED, SUPPLIED, TYPED, W
from chronoloom.queries.preparation import INTERPOLATE

# Forecasts: the last day of the hourly series is the future.
CUT = "2024-01-30 00:00:00"
PAST = f"{HOURLY}, x AS (SELECT *, sin(2 * pi() * hour(time) / 24) AS x FROM h), p AS (SELECT * FROM x WHERE time < TIMESTAMP '{CUT}'), f AS (SELECT time, x, row_number() OVER (ORDER BY time) AS step FROM x WHERE time >= TIMESTAMP '{CUT}')"


def solve(name: str, rows: str, p: int, q: int, penalty: str = "0") -> str:
    """Tables ending in ``name`` (k, w): weights w[i][j] of the ridge regression of each key's y[j] on x[1..p]; ``penalty`` may use i.

    ``rows`` names a table (k, x, y). The sums of products are eliminated column by column.
    """
    return f"""{name}_g AS (SELECT k, i, list(v ORDER BY j) AS r FROM (SELECT k, i, j, sum(x[i] * z[j]) + CASE WHEN i = j THEN {penalty} ELSE 0 END AS v
  FROM (SELECT k, x, list_concat(x, y) AS z FROM {rows}), (SELECT unnest(range(1, {p + 1})) AS i), (SELECT unnest(range(1, {p + q + 1})) AS j) GROUP BY k, i, j) GROUP BY k, i),
{name}_e AS (SELECT k, 1 AS s, list(r ORDER BY i) AS m FROM {name}_g GROUP BY k
  UNION ALL SELECT k, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda v: v / r[s]) ELSE list_transform(r, lambda v, j: v - m[s][j] * r[s] / m[s][s]) END) FROM {name}_e WHERE s <= {p}),
{name} AS (SELECT k, list_transform(m, lambda r: r[{p + 1}:]) AS w FROM {name}_e WHERE s = {p + 1})"""


def column(w: str, j: int = 1) -> str:
    return f"list_transform({w}, lambda r: r[{j}])"


def dot(w: str, x: str) -> str:
    return f"list_dot_product({w}, {x})"


def doubles(items: Sequence[str]) -> str:
    return f"[{', '.join(items)}]::DOUBLE[]"


LAGS = (1, 2, 24)
FILLED = f"{INTERPOLATE.partition('---')[0].strip()}, u AS ({INTERPOLATE.partition('---')[2].strip()})".replace("WITH ", "WITH RECURSIVE ", 1)
SQL: dict[str, str] = {}

_lagged = doubles(["1", *[f"lag({c}, {k}) OVER o" for c in ("y", "n") for k in LAGS], "x"])
_held = doubles(["1", *[f"z.{c}[{25 - k}]" for c in ("ys", "ns") for k in LAGS], "f.x"])
_tail = "(SELECT list(y ORDER BY time)[-24:] AS ys, list(n::DOUBLE ORDER BY time)[-24:] AS ns FROM p)"


def _leads(n: int) -> str:
    return doubles([f"lead(y, {h}) OVER o" for h in range(n)])


SQL["msmd_ridge"] = f"""WITH RECURSIVE {PAST}, l AS (SELECT {_lagged} AS x, {_leads(24)} AS y, row_number() OVER o AS i, count(*) OVER () AS m FROM p WINDOW o AS (ORDER BY time)),
r AS (SELECT 0 AS k, x, y FROM l WHERE i BETWEEN 25 AND m - 23), {solve("s", "r", 8, 24)},
a AS (SELECT {_held} AS x FROM {_tail} z, f WHERE f.step = 1)
---
SELECT f.time, f.step, list_dot_product(list_transform(s.w, lambda v: v[f.step]), a.x) AS predict_value FROM f, s, a WHERE f.step <= 24"""


def _several(targets: Sequence[str]) -> str:
    n = dot(column("s.w", 2), _held) if len(targets) > 1 else "z.ns[24]"
    return f"""WITH RECURSIVE {PAST}, l AS (SELECT {_lagged} AS x, {doubles(targets)} AS y, row_number() OVER o AS i FROM p WINDOW o AS (ORDER BY time)),
r AS (SELECT 0 AS k, x, y FROM l WHERE i >= 25), {solve("s", "r", 8, len(targets))},
z AS (SELECT 0::BIGINT AS step, ys, ns FROM {_tail} UNION ALL SELECT f.step, list_append(z.ys[2:], {dot(column("s.w"), _held)}), list_append(z.ns[2:], {n}) FROM z JOIN f ON f.step = z.step + 1, s WHERE f.step <= 24)
---
SELECT f.time, f.step, z.ys[24] AS predict_value FROM z JOIN f ON z.step = f.step"""


SQL["msmr_var"] = _several(["y", "n"])
SQL["msmdr_persist"] = _several(["y"])

_own = doubles(["1", *[f"lag(y, {k}) OVER o" for k in LAGS]])
_own_held = doubles(["1", *[f"z.ys[{25 - k}]" for k in LAGS]])
SQL["panel_usmr"] = f"""{FILLED}, t AS (SELECT * FROM u WHERE time < TIMESTAMP '{CUT}'), n AS (SELECT sid, time, row_number() OVER ({W}) AS step FROM u WHERE time >= TIMESTAMP '{CUT}'),
l AS (SELECT {_own} AS x, [y] AS y, row_number() OVER o AS i FROM t WINDOW o AS ({W})), r AS (SELECT 0 AS k, x, y FROM l WHERE i >= 25), {solve("s", "r", 4, 1)},
z AS (SELECT sid, 0::BIGINT AS step, list(y ORDER BY time)[-24:] AS ys FROM t GROUP BY sid UNION ALL SELECT z.sid, z.step + 1, list_append(z.ys[2:], {dot(column("s.w"), _own_held)}) FROM z, s WHERE z.step < 24)
---
SELECT n.sid, n.time, n.step, z.ys[24] AS predict_value FROM z JOIN n ON n.sid = z.sid AND n.step = z.step"""

_now = doubles(["1", *[f"lag({c}, {k}) OVER o" for c in ("qty", "rev") for k in (0, 1, 2)]])
SQL["linear_var"] = f"""WITH RECURSIVE {SHIPPED}, l AS (SELECT sid, {_now} AS x, [lead(qty) OVER o, lead(rev) OVER o]::DOUBLE[] AS y, row_number() OVER o AS i, count(*) OVER (PARTITION BY sid) AS m FROM s WINDOW o AS ({W})),
r AS (SELECT 0 AS k, x, y FROM l WHERE i BETWEEN 3 AND m - 1), {solve("c", "r", 7, 2)}
---
SELECT sid, {dot(column("w"), "x")} AS qty_next_1, {dot(column("w", 2), "x")} AS rev_next_1 FROM l, c WHERE i = m"""

SQL["stacking"] = f"""WITH RECURSIVE {HOURLY}, p AS (SELECT time, y, {doubles(["1", f"lag(y, 1) OVER ({W})", f"lag(y, 24) OVER ({W})"])} AS x, row_number() OVER ({W}) AS i FROM h),
r AS (SELECT 0 AS k, x, [y] AS y FROM p WHERE i > 24), {solve("s", "r", 3, 1, "CASE WHEN i > 1 THEN 1e-6 ELSE 0 END")}
---
SELECT time, {dot(column("w"), "x")} AS y_hat FROM p, s WHERE i > 24"""

_scaled = doubles(["1", *[f"(b.a[{j}] - m[{j}]) / d[{j}]" for j in (1, 2, 3)]])
SQL["backtest_ridge"] = f"""WITH RECURSIVE {HOURLY}, l AS (SELECT time, y, [lag(y, 24) OVER ({W}), lag(y, 25) OVER ({W}), lag(y, 48) OVER ({W})] AS a, row_number() OVER ({W}) AS i FROM h),
p AS (SELECT time, y, a, i - 49 AS i, count(*) OVER () AS n FROM l WHERE i > 48),
w AS (SELECT w, n - 24 * w AS t, greatest(n - 24 * w - 312, 0) AS f FROM (SELECT n, unnest(range(1, 1 + greatest((n - 312) // 24, 0))) AS w FROM (SELECT max(n) AS n FROM p))),
b AS (SELECT w.w, p.i >= w.t AS test, p.a, p.y FROM p JOIN w ON p.i >= w.f AND p.i < w.t + 24),
e AS (SELECT w, [avg(a[1]), avg(a[2]), avg(a[3])] AS m, [stddev_pop(a[1]), stddev_pop(a[2]), stddev_pop(a[3])] AS d FROM b WHERE NOT test GROUP BY w),
g AS (SELECT b.w AS k, test, {_scaled} AS x, [b.y] AS y FROM b JOIN e ON b.w = e.w), r AS (SELECT k, x, y FROM g WHERE NOT test), {solve("s", "r", 4, 1, "1e-6")},
o AS (SELECT g.k AS w, g.y[1] AS y, {dot(column("s.w"), "g.x")} AS p FROM g JOIN s ON g.k = s.k WHERE test)
---
SELECT w AS "window", avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM o GROUP BY w"""

SQL["walk_forward_refit"] = f"""WITH RECURSIVE {SUPPLIED}, p AS (SELECT sid, time, {doubles(["1", f"lag(y, 1) OVER ({W})", f"lag(y, 2) OVER ({W})"])} AS x, y, row_number() OVER ({W}) AS i FROM h),
g AS (SELECT sid, i, a, b, sum(x[a] * list_append(x, y)[b]) OVER (PARTITION BY sid, a, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + CASE WHEN a = b THEN 1e-6 ELSE 0 END AS v FROM p, (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([1, 2, 3, 4]) AS b) WHERE i > 2),
e AS (SELECT sid, i, 1 AS s, list(r ORDER BY a) AS m FROM (SELECT sid, i, a, list(v ORDER BY b) AS r FROM g WHERE i > 100 GROUP BY sid, i, a) GROUP BY sid, i
  UNION ALL SELECT sid, i, s + 1, list_transform(m, lambda r, k: CASE WHEN k = s THEN list_transform(r, lambda v: v / r[s]) ELSE list_transform(r, lambda v, j: v - m[s][j] * r[s] / m[s][s]) END) FROM e WHERE s <= 3)
---
SELECT p.sid, p.time, {dot("list_transform(m, lambda r: r[4])", "x")} AS predict_value FROM p LEFT JOIN e ON e.sid = p.sid AND e.i = p.i AND e.s = 4"""

SQL["windowed_forecast"] = f"""WITH RECURSIVE {SUPPLIED}, p AS (SELECT sid, time, y, list_concat([1.0::DOUBLE], list(y) OVER ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) AS x, row_number() OVER ({W}) AS i FROM h),
r AS (SELECT sid AS k, x, [y] AS y FROM p WHERE i > 24), {solve("s", "r", 25, 1)},
z AS (SELECT sid, i, 0 AS step, x[2:] AS ys, NULL::DOUBLE AS v FROM p WHERE i > 24 AND (i - 25) % 12 = 0
  UNION ALL SELECT sid, i, step + 1, list_append(ys[2:], {dot(column("s.w"), "list_concat([1.0::DOUBLE], ys)")}), {dot(column("s.w"), "list_concat([1.0::DOUBLE], ys)")} FROM z JOIN s ON s.k = z.sid WHERE step < 12)
---
SELECT p.sid, p.time, z.v AS predict_value FROM p LEFT JOIN z ON z.sid = p.sid AND z.step > 0 AND z.i + z.step - 1 = p.i"""

SQL["ses_best"] = f"""WITH RECURSIVE {TYPED}, p AS (SELECT sid, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY sid) AS m, y FROM ty WHERE y IS NOT NULL),
z AS (SELECT sid, 1::BIGINT AS i, a / 20::DOUBLE AS alpha, y AS l, 0.0::DOUBLE AS e, m FROM p, (SELECT unnest(range(1, 20)) AS a) WHERE i = 1
  UNION ALL SELECT p.sid, p.i, z.alpha, z.l + z.alpha * (p.y - z.l), z.e + abs(p.y - z.l), p.m FROM z JOIN p ON p.sid = z.sid AND p.i = z.i + 1)
---
SELECT sid, arg_min(alpha, e) AS alpha, min(e) / (m - 1) AS mae FROM z WHERE i = m GROUP BY sid, m"""


def _panel(model: str, tables: str, value: str) -> str:
    """A panel model's 24 steps: ``tables`` use v (sid, i from 1, m, y) and end in fc (sid and what ``value`` takes)."""
    return f"""{FILLED}, v AS (SELECT sid, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY sid) AS m, y FROM u),
d AS (SELECT sid, 1.645 * stddev_pop(y - q) AS d FROM (SELECT sid, y, lag(y, 24) OVER (PARTITION BY sid ORDER BY i) AS q FROM v) GROUP BY sid), t AS (SELECT unnest(range(1, 25)) AS step), {tables}
---
SELECT sid, '{model}' AS model, step, p AS predict_value, p - d AS low, p + d AS high FROM (SELECT fc.sid, t.step, d.d, {value} AS p FROM fc JOIN d ON d.sid = fc.sid, t)"""


SQL["croston"] = _panel(
    "croston",
    """z AS (SELECT sid, 0::BIGINT AS i, NULL::DOUBLE AS s, NULL::DOUBLE AS g, 0::BIGINT AS n FROM v WHERE i = 1
  UNION ALL SELECT v.sid, v.i, CASE WHEN v.y > 0 THEN coalesce(z.s + 0.1::DOUBLE * (v.y - z.s), v.y) ELSE z.s END, CASE WHEN v.y > 0 THEN coalesce(z.g + 0.1::DOUBLE * (z.n + 1 - z.g), z.n + 1) ELSE z.g END, CASE WHEN v.y > 0 THEN 0 ELSE z.n + 1 END
  FROM z JOIN v ON v.sid = z.sid AND v.i = z.i + 1), fc AS (SELECT sid, coalesce(arg_max(s / g, i), 0) AS c FROM z GROUP BY sid)""",
    "fc.c",
)
SQL["theta"] = _panel(
    "theta",
    """c AS (SELECT sid, regr_slope(y, i - 1) AS b, regr_intercept(y, i - 1) AS a FROM v GROUP BY sid), l AS (SELECT v.sid, i, m, a, b, 2 * y - (a + b * (i - 1)) AS x FROM v JOIN c ON c.sid = v.sid),
z AS (SELECT sid, i, m, a, b, 0.05::DOUBLE * k AS alpha, x AS l, 0.0::DOUBLE AS e FROM l, (SELECT unnest(range(1, 20)) AS k) WHERE i = 1
  UNION ALL SELECT l.sid, l.i, l.m, l.a, l.b, z.alpha, z.l + z.alpha * (l.x - z.l), z.e + (l.x - z.l) ** 2 FROM z JOIN l ON l.sid = z.sid AND l.i = z.i + 1),
fc AS (SELECT sid, a, b, m, arg_min(l, e) AS c FROM z WHERE i = m GROUP BY sid, a, b, m)""",
    "(fc.a + fc.b * (fc.m - 1 + t.step) + fc.c) / 2",
)
SQL["holt_winters"] = _panel(
    "holt_winters",
    """c AS (SELECT sid, m, list(y ORDER BY i) AS ys FROM v GROUP BY sid, m),
z AS (SELECT sid, 24::BIGINT AS i, m, a, b, g, list_avg(ys[1:24]) AS l, (list_avg(ys[25:48]) - list_avg(ys[1:24])) / 24 AS r, list_transform(ys[1:24], lambda q: q - list_avg(ys[1:24])) AS s, 0.0::DOUBLE AS e
  FROM c, (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS a), (SELECT unnest([0.05::DOUBLE, 0.2::DOUBLE]) AS b), (SELECT unnest([0.1::DOUBLE, 0.4::DOUBLE]) AS g)
  UNION ALL SELECT sid, i, m, a, b, g, n, b * (n - l) + (1 - b) * r, list_append(s[2:], g * (y - n) + (1 - g) * s[1]), e + abs(y - l - r - s[1])
  FROM (SELECT z.* EXCLUDE (i), v.i, v.y, z.a * (v.y - z.s[1]) + (1 - z.a) * (z.l + z.r) AS n FROM z JOIN v ON v.sid = z.sid AND v.i = z.i + 1)),
fc AS (SELECT sid, arg_min({'l': l, 'r': r, 's': s}, e) AS c FROM z WHERE i = m GROUP BY sid)""",
    "fc.c.l + t.step * fc.c.r + fc.c.s[(t.step - 1) % 24 + 1]",
)


def _orders(orders: Sequence[int]) -> str:
    parts = []
    for p in orders:
        x = doubles(["1", *[f"lag(y, {k}) OVER (PARTITION BY sid ORDER BY i)" for k in range(1, p + 1)]])
        parts.append(f"l{p} AS (SELECT sid AS k, {x} AS x, [y] AS y, i FROM v), r{p} AS (SELECT k, x, y FROM l{p} WHERE i > {max(orders)}), {solve(f's{p}', f'r{p}', p + 1, 1)}")
        parts.append(f"c{p} AS (SELECT r{p}.k AS sid, {p} AS p, count(*) * ln(avg((y[1] - {dot(column('w'), 'x')}) ** 2)) + {2 * (p + 1)} AS c, any_value({column('w')}) AS w FROM r{p} JOIN s{p} ON s{p}.k = r{p}.k GROUP BY r{p}.k)")
    every = " UNION ALL ".join(f"SELECT * FROM c{p}" for p in orders)
    return ", ".join(parts) + f", b AS (SELECT sid, arg_min(p, c) AS p, arg_min(w, c) AS w FROM ({every}) GROUP BY sid)"


SQL["ar"] = _panel(
    "ar",
    _orders((1, 2, 3, 4, 5)) + f""", z AS (SELECT v.sid, 0 AS step, b.p, b.w, list(v.y ORDER BY v.i DESC)[1:b.p] AS ys, []::DOUBLE[] AS o FROM v JOIN b ON b.sid = v.sid GROUP BY v.sid, b.p, b.w
  UNION ALL SELECT sid, step + 1, p, w, list_concat([n], ys)[1:p], list_append(o, n) FROM (SELECT *, {dot('w', 'list_concat([1.0::DOUBLE], ys)')} AS n FROM z WHERE step < 24)), fc AS (SELECT sid, o FROM z WHERE step = 24)""",
    "fc.o[t.step]",
)
_knots = [f"greatest(0, (i - 1) / (m - 1)::DOUBLE - {k} * 0.8::DOUBLE / 11)" for k in range(1, 11)]
_waves = [f"{f}(2 * pi() * {k} * (i - 1) / 24)" for k in (1, 2, 3) for f in ("sin", "cos")]
_terms = doubles(["1", "(i - 1) / (m - 1)::DOUBLE", *_knots, *_waves])
SQL["prophet"] = _panel(
    "prophet",
    f"r AS (SELECT sid AS k, {_terms} AS x, [y] AS y FROM v), {solve('s', 'r', 18, 1, 'CASE WHEN i > 2 THEN 1 ELSE 1e-8 END')}, a AS (SELECT sid, m, m + unnest(range(1, 25)) AS i FROM v WHERE i = 1), fc AS (SELECT a.sid, list({dot(column('s.w'), 'x')} ORDER BY i) AS o FROM (SELECT sid, i, {_terms} AS x FROM a) a JOIN s ON s.k = a.sid GROUP BY a.sid)",
    "fc.o[t.step]",
)

SQL["panel_cv_best_model"] = f"""{FILLED}, v AS (SELECT sid, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY sid) AS m, y FROM u),
b AS (SELECT sid, m - 24 * w AS t FROM (SELECT DISTINCT sid, m FROM v), (SELECT unnest([1, 2]) AS w) WHERE w <= (m - 24) // 24),
c AS (SELECT b.sid, b.t, avg(y) AS c, arg_max(y, i) AS a FROM b JOIN v ON v.sid = b.sid AND v.i < b.t GROUP BY b.sid, b.t),
e AS (SELECT c.sid, avg(abs(v.y - c.a)) AS naive, avg(abs(v.y - q.y)) AS seasonal_naive, avg(abs(v.y - c.c)) AS historic_mean FROM c JOIN v ON v.sid = c.sid AND v.i BETWEEN c.t AND c.t + 23 JOIN v q ON q.sid = c.sid AND q.i = v.i - 24 GROUP BY c.sid)
---
SELECT sid, naive, seasonal_naive, CASE WHEN historic_mean <= least(naive, seasonal_naive) THEN 'historic_mean' WHEN naive <= seasonal_naive THEN 'naive' ELSE 'seasonal_naive' END AS best_model FROM e"""

SQL["shifting_band"] = f"""WITH RECURSIVE {SUPPLIED}, p AS (SELECT sid, time, y, row_number() OVER ({W}) AS i FROM h),
z AS (SELECT sid, 48::BIGINT AS i, list(y ORDER BY i) AS ys, NULL::DOUBLE AS s, false AS odd FROM p WHERE i <= 48 GROUP BY sid
  UNION ALL SELECT sid, i, list_append(ys[2:], CASE WHEN odd THEN s ELSE y END), s, odd FROM (SELECT *, abs(y - s) > 2 * list_stddev_pop(ys) AS odd
  FROM (SELECT p.sid, p.i, p.y, ys, list_avg(ys[25:]) + (ys[25] + ys[1] - list_avg(ys[1:24]) - list_avg(ys[25:])) / 2 AS s FROM z JOIN p ON p.sid = z.sid AND p.i = z.i + 1)))
---
SELECT p.sid, p.time, z.s AS smooth, coalesce(z.odd, false) AS is_anomaly FROM p LEFT JOIN z ON z.sid = p.sid AND z.i = p.i"""

ACF = f"{HOURLY}, m AS (SELECT *, avg(y) OVER () AS m FROM h), l AS (SELECT y, m, k, lag(y, k) OVER (PARTITION BY k ORDER BY time) AS l FROM m, (SELECT unnest(range(1, 7)) AS k)), a AS (SELECT list(a ORDER BY k) AS a FROM (SELECT k, sum((y - m) * (l - m)) / sum((y - m) * (y - m)) AS a FROM l GROUP BY k))"
SQL["pacf"] = f"""WITH RECURSIVE {ACF}, z AS (SELECT 0 AS k, []::DOUBLE[] AS f FROM a
  UNION ALL SELECT k + 1, list_append(list_transform(f, lambda v, j: v - n * f[k + 1 - j]), n) FROM (SELECT k, f, (a[k + 1] - coalesce(list_sum(list_transform(f, lambda v, j: v * a[k + 1 - j])), 0)) / (1 - coalesce(list_sum(list_transform(f, lambda v, j: v * a[j])), 0)) AS n FROM z, a WHERE k < 6))
---
SELECT k AS lag, f[k] AS pacf FROM z WHERE k > 0"""

SQL["forecast_interval"] = f"""WITH RECURSIVE {PAST}, q AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS m FROM h),
w AS (SELECT w, m - 24 * w AS a FROM (SELECT m, unnest(range(1, 1 + greatest((m - 312) // 24, 0))) AS w FROM (SELECT max(m) AS m FROM q))),
e AS (SELECT w.w, avg(abs(q.y - b.y)) AS mae FROM w JOIN q ON q.i BETWEEN w.a AND w.a + 23 JOIN q b ON b.i = w.a - 1 GROUP BY w.w), d AS (SELECT 1.96 * sqrt(stddev_pop(mae)) AS d FROM e),
l AS (SELECT y, lag(y) OVER (ORDER BY time) AS l FROM p), r AS (SELECT regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM l),
z AS (SELECT 0 AS step, arg_max(y, time) AS v FROM p UNION ALL SELECT step + 1, a + b * v FROM z, r WHERE step < 24)
---
SELECT f.time, f.step, z.v AS predict_value, z.v - d.d AS low, z.v + d.d AS high FROM z JOIN f ON z.step = f.step, d"""

SQL["lowess"] = f"""WITH {SUPPLIED}, p AS (SELECT sid, time, y, row_number() OVER ({W}) AS t, count(*) OVER (PARTITION BY sid) AS n FROM h),
k AS (SELECT sid, t, n, least(greatest(3, ceil(0.1::DOUBLE * n)), n)::BIGINT AS m FROM p),
q AS (SELECT sid, t, greatest((m - 1 + (m - 1) % 2) // 2, m - t, m - 1 - (n - t)) AS h FROM k),
w AS (SELECT a.sid, a.t, b.t - a.t AS x, b.y, greatest(0, 1 - (abs(b.t - a.t) / q.h / 1.0001::DOUBLE) ** 3) ** 3 AS w FROM p a JOIN q ON q.sid = a.sid AND q.t = a.t JOIN p b ON b.sid = a.sid AND b.t BETWEEN a.t - q.h AND a.t + q.h),
m AS (SELECT sid, t, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY sid, t),
f AS (SELECT w.sid, w.t, any_value(my) - any_value(mx) * sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2) AS s FROM w JOIN m ON m.sid = w.sid AND m.t = w.t GROUP BY w.sid, w.t),
o AS (SELECT p.sid, time, s, 1.96 * stddev_pop(y - s) OVER (PARTITION BY p.sid) AS d FROM p JOIN f ON f.sid = p.sid AND f.t = p.t)
---
SELECT sid, time, s AS smooth, s - d AS low, s + d AS high FROM o"""

# State: level and trend with their covariances before (x, p) and after (u, s) each observation; the smoother runs back over them.
SQL["kalman"] = f"""WITH RECURSIVE {TYPED}, v AS (SELECT sid, time, y, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY sid) AS n, first_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y0 FROM ty),
g AS (SELECT sid, i, n, x1, x2, p11, p12, p22, CASE WHEN y IS NULL THEN 0 ELSE (y - x1) / (p11 + 1) END AS q, CASE WHEN y IS NULL THEN 0 ELSE 1 / (p11 + 1) END AS c FROM (SELECT sid, i, n, y, coalesce(y0, 0) AS x1, 0.0::DOUBLE AS x2, 1e3::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1e3::DOUBLE AS p22 FROM v WHERE i = 1)
  UNION ALL SELECT sid, i, n, x1, x2, p11, p12, p22, CASE WHEN y IS NULL THEN 0 ELSE (y - x1) / (p11 + 1) END, CASE WHEN y IS NULL THEN 0 ELSE 1 / (p11 + 1) END
  FROM (SELECT v.sid, v.i, v.n, v.y, u1 + u2 AS x1, u2 AS x2, s11 + 2 * s12 + s22 + 0.1::DOUBLE AS p11, s12 + s22 AS p12, s22 + 0.01::DOUBLE AS p22
    FROM (SELECT sid, i, x1 + p11 * q AS u1, x2 + p12 * q AS u2, p11 - p11 * p11 * c AS s11, p12 - p11 * p12 * c AS s12, p22 - p12 * p12 * c AS s22 FROM g) t JOIN v ON v.sid = t.sid AND v.i = t.i + 1)),
f AS (SELECT sid, i, n, x1, x2, p11, p12, p22, p11 * p22 - p12 * p12 AS d, x1 + p11 * q AS u1, x2 + p12 * q AS u2, p11 - p11 * p11 * c AS s11, p12 - p11 * p12 * c AS s12, p22 - p12 * p12 * c AS s22 FROM g),
b AS (SELECT sid, i, u1 AS z1, u2 AS z2 FROM f WHERE i = n
  UNION ALL SELECT a.sid, a.i, u1 + ((s11 + s12) * e.p22 - s12 * e.p12) / e.d * (z1 - e.x1) + (s12 * e.p11 - (s11 + s12) * e.p12) / e.d * (z2 - e.x2),
    u2 + ((s12 + s22) * e.p22 - s22 * e.p12) / e.d * (z1 - e.x1) + (s22 * e.p11 - (s12 + s22) * e.p12) / e.d * (z2 - e.x2)
  FROM b JOIN (SELECT sid, i, u1, u2, s11, s12, s22 FROM f) a ON a.sid = b.sid AND a.i = b.i - 1 JOIN (SELECT sid, i, x1, x2, p11, p12, p22, d FROM f) e ON e.sid = b.sid AND e.i = b.i)
---
SELECT v.sid, v.time, b.z1 AS smooth, b.z2 AS slope FROM b JOIN v ON v.sid = b.sid AND v.i = b.i"""

SQL["lof"] = f"""WITH {TYPED}, p AS (SELECT sid, time, y, count(*) OVER (PARTITION BY sid) AS n FROM ty WHERE y IS NOT NULL),
e AS (SELECT a.sid, a.time, b.time AS near, abs(a.y - b.y) AS d, row_number() OVER (PARTITION BY a.sid, a.time ORDER BY abs(a.y - b.y), b.time) AS k FROM p a JOIN p b ON a.sid = b.sid AND a.time <> b.time),
k AS (SELECT * FROM e WHERE k <= 50), r AS (SELECT sid, time, max(d) AS r FROM k GROUP BY sid, time),
l AS (SELECT k.sid, k.time, 1 / greatest(avg(greatest(k.d, r.r)), 1e-10) AS l FROM k JOIN r ON r.sid = k.sid AND r.time = k.near GROUP BY k.sid, k.time)
---
SELECT k.sid, k.time, avg(b.l) / any_value(a.l) AS score FROM k JOIN l a ON a.sid = k.sid AND a.time = k.time JOIN l b ON b.sid = k.sid AND b.time = k.near GROUP BY k.sid, k.time"""

_dev = [f"({c} - avg({c}) OVER ())" for c in ("qty", "rev", "disc")]
SQL["pca_score"] = f"""WITH RECURSIVE {SHIPPED}, x AS (SELECT sid, time, {doubles(_dev)} AS x FROM s),
c AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, sum(x[i] * x[j]) / (count(*) - 1) AS v FROM x, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([1, 2, 3]) AS j) GROUP BY i, j) GROUP BY i)),
z AS (SELECT 0 AS k, [1, 1, 1]::DOUBLE[] AS v UNION ALL SELECT k + 1, list_transform(n, lambda q: q / sqrt(list_dot_product(n, n))) FROM (SELECT k, list_transform(c.c, lambda r: list_dot_product(r, z.v)) AS n FROM z, c WHERE k < 200)),
a AS (SELECT v, list_dot_product(v, list_transform(c.c, lambda r: list_dot_product(r, v))) AS e FROM z, c WHERE k = 200),
t AS (SELECT x.*, a.e, list_dot_product(x.x, a.v) AS m, list_transform(x.x, lambda q, i: q - list_dot_product(x.x, a.v) * a.v[i]) AS o FROM x, a),
i AS (SELECT c.c[2][2] * c.c[3][3] - c.c[2][3] ** 2 AS a11, c.c[1][3] * c.c[2][3] - c.c[1][2] * c.c[3][3] AS a12, c.c[1][2] * c.c[2][3] - c.c[1][3] * c.c[2][2] AS a13, c.c[1][1] * c.c[3][3] - c.c[1][3] ** 2 AS a22, c.c[1][2] * c.c[1][3] - c.c[1][1] * c.c[2][3] AS a23, c.c[1][1] * c.c[2][2] - c.c[1][2] ** 2 AS a33, c.c FROM c),
u AS (SELECT sid, time, m * m / e AS major_score, (a11 * o[1] ** 2 + a22 * o[2] ** 2 + a33 * o[3] ** 2 + 2 * (a12 * o[1] * o[2] + a13 * o[1] * o[3] + a23 * o[2] * o[3])) / (c[1][1] * a11 + c[1][2] * a12 + c[1][3] * a13) AS minor_score, list_dot_product(o, o) AS reconstruction FROM t, i)
---
SELECT * REPLACE (round(reconstruction, 4) AS reconstruction), major_score > (SELECT quantile_cont(major_score, 0.99) FROM u) OR minor_score > (SELECT quantile_cont(minor_score, 0.99) FROM u) AS is_anomaly FROM u"""


def share(key: str, seed: int = 42) -> str:
    """The number in [0, 1) that decides the part of a row."""
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {key})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


SQL["oof_stacking"] = f"""WITH RECURSIVE {HOURLY}, p AS (SELECT time, y, {doubles(["1", f"lag(y, 1) OVER ({W})", f"lag(y, 24) OVER ({W})"])} AS x, row_number() OVER ({W}) AS i FROM h),
e AS (SELECT time, x, y, time < TIMESTAMP '{CUT}' AS train, floor({share("CAST(time AS VARCHAR)")} * 3)::BIGINT AS fold FROM p WHERE i > 24),
r AS (SELECT k, x, [y] AS y FROM e, (SELECT unnest(range(3)) AS k) WHERE train AND fold <> k), {solve("a", "r", 3, 1, "CASE WHEN i > 1 THEN 1 ELSE 0 END")}, {solve("b", "r", 3, 1)}
---
SELECT time, train, avg({dot(column("a.w"), "x")}) AS a_oof, avg({dot(column("b.w"), "x")}) AS b_oof FROM e JOIN a ON NOT train OR a.k = fold JOIN b ON b.k = a.k GROUP BY time, train"""

_two = doubles(["1", *[f"(b.a[{j}] - m[{j}]) / d[{j}]" for j in (1, 2)]])


def searched(picks: Sequence[float]) -> str:
    every = ", ".join(f"({k}, {p}::DOUBLE)" for k, p in enumerate(picks))
    return f"""WITH RECURSIVE {HOURLY}, l AS (SELECT time, y, [lag(y, 24) OVER ({W}), lag(y, 48) OVER ({W})] AS a, row_number() OVER ({W}) AS i FROM h),
p AS (SELECT time, y, a, i - 49 AS i, count(*) OVER () AS n FROM l WHERE i > 48),
w AS (SELECT w, n // 4 AS c, n - n // 4 * (4 - w) AS t FROM (SELECT max(n) AS n FROM p), (SELECT unnest([1, 2, 3]) AS w)),
b AS (SELECT w.w, p.i >= w.t AS test, p.a, p.y FROM p JOIN w ON p.i < w.t + w.c),
e AS (SELECT w, [avg(a[1]), avg(a[2])] AS m, [stddev_pop(a[1]), stddev_pop(a[2])] AS d FROM b WHERE NOT test GROUP BY w), v AS (SELECT * FROM (VALUES {every}) AS v(trial, penalty)),
g AS (SELECT b.w, v.trial * 10 + b.w AS k, v.trial, v.penalty, test, {_two} AS x, [b.y] AS y FROM b JOIN e ON b.w = e.w, v),
r AS (SELECT k, x, y FROM g WHERE NOT test UNION ALL SELECT DISTINCT k, list_transform([1, 2, 3], lambda q: CASE WHEN q = c THEN sqrt(penalty) ELSE 0 END), [0.0::DOUBLE] FROM g, (SELECT unnest([1, 2, 3]) AS c)), {solve("s", "r", 3, 1)},
o AS (SELECT trial, penalty, g.w, avg(abs(g.y[1] - {dot(column("s.w"), "g.x")})) AS mae FROM g JOIN s ON s.k = g.k WHERE test GROUP BY trial, penalty, g.w)
---
SELECT trial, '{{''penalty'': ' || CAST(penalty AS VARCHAR) || '}}' AS params, avg(mae) AS mae FROM o GROUP BY trial, penalty"""


EVENTS = f"""ev AS (SELECT event_type AS sid, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, avg(value) AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
eg AS (SELECT sid, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS time FROM (SELECT sid, min(time) AS a, max(time) AS b FROM ev GROUP BY sid)),
ep AS (SELECT eg.sid, eg.time, ev.y, ev.n, row_number() OVER (PARTITION BY eg.sid ORDER BY eg.time) AS p FROM eg LEFT JOIN ev ON ev.sid = eg.sid AND ev.time = eg.time),
ef AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN {{'y': y, 'n': n, 'p': p}} END IGNORE NULLS) OVER a AS l, first_value(CASE WHEN y IS NOT NULL THEN {{'y': y, 'n': n, 'p': p}} END IGNORE NULLS) OVER b AS r
  FROM ep WINDOW a AS (PARTITION BY sid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY sid ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT sid, time, p AS i, coalesce(y, l.y + (r.y - l.y) * (p - l.p) / (r.p - l.p)) AS y, coalesce(n, l.n + (r.n - l.n) * (p - l.p) / (r.p - l.p)) AS n, hour(time) AS x1, (dayofweek(time) + 6) % 7 AS x2, count(*) OVER (PARTITION BY sid) AS m FROM ef)"""

_both = [f"lag({c}, {k}) OVER o" for c in ("y", "n") for k in LAGS]


def _scales(features: int, keys: str = "k") -> str:
    """m and d of each key's a[1..features]."""
    return f"{doubles([f'avg(a[{j}])' for j in range(1, features + 1)])} AS m, list_transform({doubles([f'stddev_pop(a[{j}])' for j in range(1, features + 1)])}, lambda e: CASE WHEN e > 0 THEN e ELSE 1 END) AS d FROM b GROUP BY {keys}"


def _scaled(items: Sequence[str]) -> str:
    return doubles(["1", *[f"({x} - q.m[{j}]) / q.d[{j}]" for j, x in enumerate(items, 1)]])


_exo_held = _scaled([*[f"z.{c}[{25 - k}]" for c in ("ys", "ns") for k in LAGS], "hour(z.t)", "((dayofweek(z.t) + 6) % 7)"])
SQL["run_forecast"] = f"""WITH RECURSIVE {EVENTS}, b AS (SELECT * FROM (SELECT sid AS k, {doubles([*_both, "x1", "x2"])} AS a, [y, n] AS y, i FROM v WINDOW o AS (PARTITION BY sid ORDER BY i)) WHERE i > 24), q AS (SELECT k, {_scales(8)}),
r AS (SELECT b.k, {_scaled([f"a[{j}]" for j in range(1, 9)])} AS x, b.y FROM b JOIN q ON q.k = b.k), {solve("s", "r", 9, 2, "1e-6")},
z AS (SELECT sid, 0 AS step, max(time) AS t, list(y ORDER BY i)[-24:] AS ys, list(n ORDER BY i)[-24:] AS ns FROM v GROUP BY sid
  UNION ALL SELECT sid, step, t, list_append(ys[2:], {dot("wy", "x")}), list_append(ns[2:], {dot("wn", "x")}) FROM (SELECT z.sid, z.step, z.t, z.ys, z.ns, {column("s.w")} AS wy, {column("s.w", 2)} AS wn, {_exo_held} AS x
    FROM (SELECT sid, step + 1 AS step, t + INTERVAL 1 HOUR AS t, ys, ns FROM z WHERE step < 24) z JOIN s ON s.k = z.sid JOIN q ON q.k = z.sid))
---
SELECT sid, t AS time, step, ys[24] AS predict_value FROM z WHERE step > 0"""

_windows = """w AS (SELECT sid, w, m - 24 * w AS t, greatest(m - 24 * w - 312, 0) AS f FROM (SELECT sid, m, unnest(range(1, 1 + greatest((m - 312) // 24, 0))) AS w FROM (SELECT DISTINCT sid, m FROM v)))"""
_scored = """o AS (SELECT z.sid, CAST(z.w AS VARCHAR) AS "window", avg(abs(v.y - z.p)) AS mae, sqrt(avg((v.y - z.p) ** 2)) AS rmse, 1 - avg((v.y - z.p) ** 2) / var_pop(v.y) AS r2 FROM e z JOIN v ON v.sid = z.sid AND v.i = z.i GROUP BY z.sid, z.w)
---
SELECT * FROM o UNION ALL SELECT sid, 'mean', avg(mae), avg(rmse), avg(r2) FROM o GROUP BY sid"""
_msmr = _scaled([*[f"z.{c}[{25 - k}]" for c in ("ys", "ns") for k in LAGS], "v.x1", "v.x2"])
SQL["run_scores_msmr"] = f"""WITH RECURSIVE {EVENTS}, {_windows},
c AS (SELECT w.sid || '/' || w.w AS k, w.sid, w.w, w.f, w.t, v.i, v.y, v.n, {doubles([*_both, "x1", "x2"])} AS a FROM w JOIN v ON v.sid = w.sid AND v.i > w.f AND v.i <= w.t WINDOW o AS (PARTITION BY w.sid, w.w ORDER BY v.i)),
b AS (SELECT * FROM c WHERE i > f + 24), q AS (SELECT k, {_scales(8)}),
r AS (SELECT b.k, {_scaled([f"a[{j}]" for j in range(1, 9)])} AS x, [b.y, b.n] AS y FROM b JOIN q ON q.k = b.k), {solve("s", "r", 9, 2, "1e-6")},
z AS (SELECT k, sid, w, t AS i, list(y ORDER BY i)[-24:] AS ys, list(n ORDER BY i)[-24:] AS ns, t + 24 AS e FROM c GROUP BY k, sid, w, t
  UNION ALL SELECT z.k, z.sid, z.w, v.i, list_append(z.ys[2:], {dot(column("s.w"), _msmr)}), list_append(z.ns[2:], {dot(column("s.w", 2), _msmr)}), z.e FROM z JOIN v ON v.sid = z.sid AND v.i = z.i + 1 JOIN s ON s.k = z.k JOIN q ON q.k = z.k WHERE z.i < z.e),
e AS (SELECT sid, w, i, ys[24] AS p FROM z WHERE i > e - 24), {_scored}"""

SQL["run_scores_usmd"] = f"""WITH RECURSIVE {EVENTS}, {_windows},
c AS (SELECT w.sid || '/' || w.w AS k, w.sid, w.w, w.f, w.t, v.i, {doubles([*[f"lag(y, {k}) OVER o" for k in LAGS], "x1", "x2"])} AS a, {_leads(24)} AS y FROM w JOIN v ON v.sid = w.sid AND v.i > w.f AND v.i <= w.t + 1 WINDOW o AS (PARTITION BY w.sid, w.w ORDER BY v.i)),
b AS (SELECT * FROM c WHERE i > f + 24 AND i <= t - 23), q AS (SELECT k, {_scales(5)}),
r AS (SELECT b.k, {_scaled([f"a[{j}]" for j in range(1, 6)])} AS x, b.y FROM b JOIN q ON q.k = b.k), {solve("s", "r", 6, 24, "1e-6")},
e AS (SELECT sid, w, t + h AS i, {dot("list_transform(sw, lambda r: r[h])", "x")} AS p FROM (SELECT c.sid, c.w, c.t, s.w AS sw, {_scaled([f"c.a[{j}]" for j in range(1, 6)])} AS x, unnest(range(1, 25)) AS h FROM c JOIN s ON s.k = c.k JOIN q ON q.k = c.k WHERE c.i = c.t + 1)), {_scored}"""

_train = [f"lag(y, {k}) OVER o" for k in LAGS]
_std = doubles(["1", *[f"(a[{j}] - q.m[{j}]) / q.d[{j}]" for j in range(1, 6)]])
_step = doubles(["1", *[f"(z.ys[{25 - k}] - q.m[{j}]) / q.d[{j}]" for j, k in enumerate(LAGS, 1)], "(v.x1 - q.m[4]) / q.d[4]", "(v.x2 - q.m[5]) / q.d[5]"])
SQL["run_scores"] = f"""WITH RECURSIVE {EVENTS}, w AS (SELECT sid, w, m - 24 * w AS t, greatest(m - 24 * w - 312, 0) AS f FROM (SELECT sid, m, unnest(range(1, 1 + greatest((m - 312) // 24, 0))) AS w FROM (SELECT DISTINCT sid, m FROM v))),
c AS (SELECT w.sid || '/' || w.w AS k, w.sid, w.w, w.f, w.t, v.i, v.y, {doubles([*_train, "x1", "x2"])} AS a FROM w JOIN v ON v.sid = w.sid AND v.i > w.f AND v.i <= w.t WINDOW o AS (PARTITION BY w.sid, w.w ORDER BY v.i)),
b AS (SELECT * FROM c WHERE i > f + 24),
q AS (SELECT k, {doubles([f"avg(a[{j}])" for j in range(1, 6)])} AS m, list_transform({doubles([f"stddev_pop(a[{j}])" for j in range(1, 6)])}, lambda e: CASE WHEN e > 0 THEN e ELSE 1 END) AS d FROM b GROUP BY k),
r AS (SELECT b.k, {_std} AS x, [b.y] AS y FROM b JOIN q ON q.k = b.k), {solve("s", "r", 6, 1, "1e-6")},
z AS (SELECT k, sid, w, t AS i, list(y ORDER BY i)[-24:] AS ys, t + 24 AS e FROM c GROUP BY k, sid, w, t
  UNION ALL SELECT z.k, z.sid, z.w, v.i, list_append(z.ys[2:], {dot(column("s.w"), _step)}), z.e FROM z JOIN v ON v.sid = z.sid AND v.i = z.i + 1 JOIN s ON s.k = z.k JOIN q ON q.k = z.k WHERE z.i < z.e),
o AS (SELECT z.sid, CAST(z.w AS VARCHAR) AS "window", avg(abs(v.y - z.ys[24])) AS mae, sqrt(avg((v.y - z.ys[24]) ** 2)) AS rmse, 1 - avg((v.y - z.ys[24]) ** 2) / var_pop(v.y) AS r2 FROM z JOIN v ON v.sid = z.sid AND v.i = z.i WHERE z.i > z.e - 24 GROUP BY z.sid, z.w)
---
SELECT * FROM o UNION ALL SELECT sid, 'mean', avg(mae), avg(rmse), avg(r2) FROM o GROUP BY sid"""
