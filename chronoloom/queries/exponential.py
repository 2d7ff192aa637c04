"""Queries of smoothing grids: ten by ten for level and trend of every supplier, eight cubed with a season of twelve by return flag."""

from __future__ import annotations

from chronoloom.plans import exponential as ex
from chronoloom.queries.base import BY, SHIPPED, SUPPLIED, W, query, shipped, supplied

TENS = [k / 10 + 0.01 for k in range(10)]
EIGHTS = [k / 10 for k in range(2, 10)]
HOLDOUT = 48


def _values(name: str, items: list[float]) -> str:
    return f"(SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in items)}]) AS {name})"


HOLT = f"""WITH RECURSIVE {SUPPLIED}, p AS (SELECT sid, y, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY sid) AS n, lead(y) OVER ({W}) AS y2 FROM h),
z AS (SELECT sid, 1::BIGINT AS i, n, a, b, y AS l, y2 - y AS r FROM p, {_values("a", TENS)}, {_values("b", TENS)} WHERE i = 1 AND n >= {HOLDOUT + 2}
  UNION ALL SELECT sid, i, n, a, b, v, b * (v - l) + (1 - b) * r FROM (SELECT z.sid, p.i, z.n, a, b, l, r, a * p.y + (1 - a) * (l + r) AS v FROM z JOIN p ON p.sid = z.sid AND p.i = z.i + 1 WHERE z.i < z.n - {HOLDOUT})),
e AS (SELECT z.sid, a, b, avg(abs(p.y - l - (p.i - z.i) * r)) AS mae FROM z JOIN p ON p.sid = z.sid AND p.i > z.i WHERE z.i = z.n - {HOLDOUT} GROUP BY z.sid, a, b)
---
SELECT sid, a AS alpha, b AS beta, mae FROM e QUALIFY row_number() OVER (PARTITION BY sid ORDER BY round(mae, 12), a, b) = 1"""

WINTERS = f"""WITH RECURSIVE {SHIPPED}, p AS (SELECT sid, rev AS y, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY sid) AS n FROM s),
c AS (SELECT sid, n, list(y ORDER BY i) AS ys FROM p WHERE i <= 24 GROUP BY sid, n),
z AS (SELECT sid, 12::BIGINT AS i, n, a, b, g, list_avg(ys[1:12]) AS l, (list_avg(ys[13:24]) - list_avg(ys[1:12])) / 12 AS r, list_transform(ys[1:12], lambda q: q - list_avg(ys[1:12])) AS s FROM c, {_values("a", EIGHTS)}, {_values("b", EIGHTS)}, {_values("g", EIGHTS)} WHERE n >= {HOLDOUT + 24}
  UNION ALL SELECT sid, i, n, a, b, g, v, b * (v - l) + (1 - b) * r, list_append(s[2:], g * (y - v) + (1 - g) * s[1]) FROM (SELECT z.sid, p.i, p.y, z.n, a, b, g, l, r, s, a * (p.y - s[1]) + (1 - a) * (l + r) AS v FROM z JOIN p ON p.sid = z.sid AND p.i = z.i + 1 WHERE z.i < z.n - {HOLDOUT})),
e AS (SELECT z.sid, a, b, g, avg(abs(p.y - l - (p.i - z.i) * r - s[(p.i - z.i - 1) % 12 + 1])) AS mae FROM z JOIN p ON p.sid = z.sid AND p.i > z.i WHERE z.i = z.n - {HOLDOUT} GROUP BY z.sid, a, b, g)
---
SELECT sid, a AS alpha, b AS beta, g AS gamma, mae FROM e QUALIFY row_number() OVER (PARTITION BY sid ORDER BY round(mae, 12), a, b, g) = 1"""


@query("holt_grid", "sid:l alpha:d beta:d mae:d", HOLT)
def holt_grid(spark, d):
    return ex.grid_search(supplied(spark, d), BY, "y", TENS, TENS, holdout=HOLDOUT)


@query("holt_winters_grid", "sid alpha:d beta:d gamma:d mae:d", WINTERS)
def holt_winters_grid(spark, d):
    return ex.grid_search(shipped(spark, d), BY, "rev", EIGHTS, EIGHTS, EIGHTS, 12, HOLDOUT)
