"""Queries of the histogram trees over whole tables: boosting, several targets at once, early stopping, extra trees, boosted stumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import windows
from chronoloom.plans import learners
from chronoloom.queries.base import BY, ORDER, query, shipped, table

ITEM = ["l_quantity", "l_discount", "l_tax", "p_retailprice", "month"]


def _items(spark, d):
    """Every line item with its part's price and its month, all numbers."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return table(spark, d, "lineitem").join(part, "l_partkey", "left").withColumn("month", F.month("l_shipdate").cast("double"))


@query("boosting_l1", "l_orderkey:l l_linenumber:i l_extendedprice:d l_extendedprice_hat:d")
def boosting_l1(spark, d):
    """The learner's own 1000 rounds at a rate of 0.05."""
    items = _items(spark, d)
    return learners.create("lgb").fit(items, ITEM, ["l_extendedprice"]).predict(items)


@query("boosting_history", "round:i train:d valid:d kept:i")
def boosting_history(spark, d):
    """The loss of every round on both parts, and the number of trees kept; every fifth order, by a hash of its key, is held out."""
    held = F.pmod(F.xxhash64("l_orderkey"), F.lit(5)) == 0
    model = learners.create("xgb", rounds=8, rate=0.5, depth=3, patience=3).fit(_items(spark, d), ITEM, ["l_extendedprice"], held)
    return spark.createDataFrame([(h["round"], h["train"], h["valid"], len(model.trees)) for h in model.history], "round int, train double, valid double, kept int")


HORIZON = 24


@query("boosting_horizon", "sid time step:i y_hat:d")
def boosting_horizon(spark, d):
    """One model for all steps of the horizon: a day's quantity by return flag, 24 days ahead from every day."""
    s = windows.lags(shipped(spark, d), BY, ORDER, ["qty", "rev"], [1, 7, 14])
    wide = windows.targets(s, BY, ORDER, "qty", HORIZON)
    steps = [f"qty_shift_{h}" for h in range(HORIZON)]
    got = learners.create("cat", rounds=3, rate=0.3, depth=3).fit(wide, [f"{c}_lag_{k}" for c in ("qty", "rev") for k in (1, 7, 14)], steps).predict(wide)
    return got.select("sid", "time", F.posexplode(F.array(*[f"{c}_hat" for c in steps])).alias("step", "y_hat"))


@query("extra_trees", "l_orderkey:l l_linenumber:i l_extendedprice_hat:d")
def extra_trees(spark, d):
    items = _items(spark, d)
    return learners.create("extra", trees=8, depth=5, rows=20).fit(items, ITEM, ["l_extendedprice"]).predict(items)


@query("adaboost_stumps", "l_orderkey:l l_linenumber:i prediction:i probability:d")
def adaboost_stumps(spark, d):
    items = _items(spark, d).withColumn("label", (F.col("l_extendedprice") > 30_000).cast("int"))
    return learners.classifier("adaboost", rounds=6).fit(items, ITEM, "label").predict(items)
