import datetime as dt

import pytest

from tallywork.operators import anomaly
from tallywork.plans import dashboard
from tests.conftest import rows


def series(spark, values):
    start = dt.date(2024, 1, 1)
    data = [(start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "day date, v double")


def test_constant_series_has_no_anomaly(spark):
    assert anomaly.zscore_anomalies(series(spark, [5] * 20), "v", "day", "V").count() == 0


def test_short_series_has_no_anomaly(spark):
    assert anomaly.zscore_anomalies(series(spark, [1] * 8 + [100]), "v", "day", "V").count() == 0


def test_spike(spark):
    found = anomaly.zscore_anomalies(series(spark, [10] * 19 + [100]), "v", "day", "Sales").collect()
    assert len(found) == 1
    hit = found[0]
    assert hit.severity == "high" and hit.value == 100.0
    assert hit.description == "Sales of 100.00 is 4.4σ from mean"
    # sample deviation for the range: mean 14.5, sd 20.12
    assert hit.expected_range.lo == pytest.approx(14.5 - 2 * 20.1246, abs=0.01)


def test_threshold_is_strict(spark):
    # two values at ±1 and population deviation 0.5: both are exactly 2 deviations off
    values = [1, -1] + [0] * 6
    scored = anomaly.with_zscore(series(spark, values), "v", min_rows=8)
    assert max(abs(r.zscore) for r in scored.collect()) == 2.0
    assert anomaly.zscore_anomalies(series(spark, values), "v", "day", "V", 2.0, 8).count() == 0


def test_alerts_and_summary(spark):
    found = anomaly.all_anomalies(
        anomaly.zscore_anomalies(series(spark, [10] * 19 + [100]), "v", "day", "Sales"),
        anomaly.zscore_anomalies(series(spark, [1, 3] * 10 + [6]), "v", "day", "Orders"),
    )
    assert [r.severity for r in found.collect()] == ["high", "high"] or found.first().severity == "high"
    alerts = anomaly.alerts(found, dt.datetime(2024, 2, 1)).collect()
    assert alerts[0].action.startswith("Immediate investigation required for")
    summary = anomaly.alert_summary(found).first()
    assert summary.total == summary.high + summary.medium + summary.low == len(alerts)


def test_summary_of_nothing_is_zero(spark):
    none = anomaly.zscore_anomalies(series(spark, []), "v", "day", "V")
    assert tuple(anomaly.alert_summary(none).first()) == (0, 0, 0, 0)


def test_column_outliers_skip_constant_and_date_columns(spark):
    df = spark.createDataFrame([(float(i == 0) * 100, 7, i) for i in range(20)], "a double, b int, some_date int")
    assert rows(anomaly.column_outliers(df), "column_name", "outliers") == [("a", 1)]


def test_period_change_guards_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "p int, v double")
    out = [(r.p, r.growth_pct) for r in dashboard.period_change(df, "p", "v").orderBy("p").collect()]
    assert out == [(1, None), (2, None), (3, 100.0)]


def test_growth_needs_two_months(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 5.0)], "order_month date, revenue double")
    assert dashboard.mom_growth(df).count() == 0


def test_rolling_scores_of_a_hot_group(spark, monkeypatch):
    """Blocks shorter than the groups, a null group, null values; each score from the rows right before, by plain loops."""
    import random
    from statistics import mean, stdev

    from tallywork.operators import globalorder

    monkeypatch.setattr(globalorder, "BLOCK_ROWS", 16)
    random.seed(4)
    data = [(random.choice(["hot", "hot", "hot", "x", None]), i, random.choice([None, 5, 5, random.randint(-10**12, 10**12)])) for i in range(600)]
    out = anomaly.rolling_zscores(spark.createDataFrame(data, "g string, i int, v long").repartition(5), "v", "i", ["g"], rows=7, min_rows=3)
    got = {r.i: r for r in out.collect()}
    before = {}
    for g, i, v in data:
        held = [x for x in before.get(g, [])[-7:] if x is not None]
        before.setdefault(g, []).append(v)
        r = got[i]
        assert r.g == g and r.v == v
        assert r.mean == (pytest.approx(mean(held)) if held else None)
        assert r.spread == (pytest.approx(stdev(held)) if len(held) > 1 else None)
        scored = len(held) >= 3 and len(set(held)) > 1 and v is not None
        assert r.zscore == (pytest.approx((v - mean(held)) / stdev(held)) if scored else None)
    assert len(got) == 600


def test_rolling_scores_of_nothing(spark):
    assert anomaly.rolling_zscores(spark.createDataFrame([], "g string, i int, v long"), "v", "i", ["g"]).count() == 0
