"""Queries of parameter searches: trials of boosted trees over expanding folds of daily series by return flag."""

from __future__ import annotations

from chronoloom.operators import windows
from chronoloom.plans import backtest as bt
from chronoloom.plans import tuning
from chronoloom.queries.base import BY, ORDER, query, shipped

SPEC = "trial:i params rung:i rounds:i mae:d best"
LAGGED = [f"{c}_lag_{k}" for c in ("qty", "disc") for k in (1, 7, 14)]


def _daily(spark, d):
    return windows.lags(shipped(spark, d), BY, ORDER, ["qty", "disc"], [1, 7, 14])


@query("halving_search", SPEC)
def halving_search(spark, d):
    s = _daily(spark, d)
    return tuning.halving_search(s, bt.fold_bounds(s, BY, 3), BY, "qty", LAGGED, trials=9, rungs=(2, 4, 8))


@query("parzen_search", SPEC)
def parzen_search(spark, d):
    s = _daily(spark, d)
    return tuning.parzen_search(s, bt.fold_bounds(s, BY, 3), BY, "qty", LAGGED, trials=8, batch=4, rounds=4)
