"""The robust envelope against one on all rows in memory, and against planted outliers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import envelope as en

SCHEMA = "id long, a double, b double, c double"


def test_quantiles_of_chi_square():
    assert en.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2)) and en.chi2_quantile(0.975, 2) == pytest.approx(-2 * math.log(0.025))
    assert en.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694124) and en.chi2_quantile(0.975, 10) == pytest.approx(20.483177350807388)


def cloud(n, bad, seed):
    r = np.random.default_rng(seed)
    good = r.normal(size=(n, 3)) @ np.array([[2.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 0.7]]) + [5, -3, 100]
    return np.vstack((good, r.normal(size=(bad, 3)) * 0.2 + [30, 20, 90]))


def plain(x, share, seed):
    """The same estimate with all rows in memory, and every one of many starts carried to its end."""
    n, p = x.shape
    best = None
    for k in range(200):
        r = np.random.default_rng([seed, k])
        own = x[r.choice(n, p + 1, replace=False)]
        m, c = own.mean(0), np.cov(own.T, ddof=0)
        for _ in range(30):
            d = en._distances(x, m, c)
            at = d <= np.sort(d)[math.ceil(share * n) - 1]
            m, c = x[at].mean(0), np.cov(x[at].T, ddof=0)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], m, c)
    _, m, c = best
    middle = lambda m, c: np.sort(en._distances(x, m, c))[math.ceil(n / 2) - 1] / en.chi2_quantile(0.5, p)
    at = en._distances(x, m, c * middle(m, c)) <= en.chi2_quantile(0.975, p)
    m, c = x[at].mean(0), np.cov(x[at].T, ddof=0)
    return m, c * middle(m, c), int(at.sum())


@pytest.mark.parametrize("parts", [1, 6])
def test_the_estimate(spark, parts):
    x = cloud(300, 120, 1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], SCHEMA).repartition(parts)
    got = en.fit_envelope(df, ["a", "b", "c"])
    m, c, support = plain(x, (len(x) + 4) / 2 / len(x), 0)
    assert np.allclose(got.location, m) and np.allclose(got.covariance, c) and got.support == support
    assert np.abs(got.location - [5, -3, 100]).max() < 0.5 < np.abs(x.mean(0) - [5, -3, 100]).max()


def test_outliers_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(en, "SAMPLE", 100)
    x = cloud(2000, 400, 2)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    rows += [(-1, None, 1.0, 1.0), (-2, float("nan"), 1.0, 1.0), (-3, float("inf"), 1.0, 1.0), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("distance", F.lit("mine"))
    got = en.elliptic_envelope(df, ["a", "b", "c"], contamination=400 / 2401)
    assert got.columns == ["id", "a", "b", "c", "distance", "is_anomaly"] and got.count() == len(rows)
    odd = {r.id for r in got.filter("is_anomaly").collect()}
    assert len(odd & set(range(2000, 2400))) == 400 and len(odd) <= 401
    assert {r.id for r in got.filter("distance IS NULL").collect()} == {-1, -2, -3}


def test_odd_tables(spark):
    assert en.fit_envelope(spark.createDataFrame([], SCHEMA), ["a"]) is None
    assert en.elliptic_envelope(spark.createDataFrame([], SCHEMA), ["a"]).count() == 0
    flat = en.elliptic_envelope(spark.createDataFrame([(i, 1.0, float(i % 5), 0.0) for i in range(20)], SCHEMA), ["a", "b"])
    assert flat.filter("distance IS NOT NULL").count() == 20
    one = en.elliptic_envelope(spark.createDataFrame([(1, 1.0, 2.0, 3.0)], SCHEMA), ["a", "b"])
    assert one.count() == 1 and one.filter("is_anomaly").count() == 0


@pytest.mark.parametrize("guess", [0.0, 1e-9, 0.999, 1.0, 1.3, 1e12])
def test_limits_whatever_is_expected(spark, guess):
    x = cloud(900, 300, 3)
    x[::7] = x[0]  # many equal distances
    m, c = x.mean(0), np.cov(x.T, ddof=0)
    d = en._distances(x, m, c)
    blocks = en._blocks(spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double").repartition(3))
    for share in (0.01, 0.5, 1.0):
        limit = np.sort(d)[math.ceil(share * len(d)) - 1]
        ((got, (n, mean, cov)),) = en._nearest(blocks, len(x), 3, [(m, c)], share, [limit * guess])
        at = d <= limit * (1 + 1e-11)
        assert got == pytest.approx(limit, rel=1e-11) and n == at.sum()
        assert np.allclose(mean, x[at].mean(0)) and np.allclose(cov, np.cov(x[at].T, ddof=0), atol=1e-9)


def test_steps_do_not_read_the_table_again(spark):
    x = cloud(3000, 700, 4)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], SCHEMA).mapInArrow(count, SCHEMA)
    assert en.fit_envelope(df, ["a", "b", "c"]).support > 0
    assert len(x) <= read.value <= 5 * len(x)  # counted, sampled, made blocks of, and two medians
