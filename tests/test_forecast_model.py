"""The forecaster survives a save and a load."""

import datetime as dt

from pyspark.sql import functions as F

from hotzone.operators import aggregates as AG
from hotzone.operators import forecast as FC
from hotzone.plans.catalog import fresh_feats
from hotzone.session import scratch_path
from tests.conftest import SMALL


def test_saved_model_forecasts_alike(spark):
    f = fresh_feats(spark, SMALL)
    fm = FC.train_forecast(f, max_iter=3)
    path = scratch_path(spark, "model")
    fm.save(path)
    back = FC.ForecastModel.load(spark, path)
    now, active = dt.datetime(2024, 1, 31), AG.active_clusters(f)
    rows = lambda m: sorted(map(tuple, FC.forecast(m, active, now).collect()))
    assert rows(back) == rows(fm) and len(rows(fm)) == 6 * active.count()
    assert [round(v, 9) for v in FC.forecast_quality(back).first()] == [round(v, 9) for v in FC.forecast_quality(fm).first()]
    got = {r.cluster: r.mae for r in AG.mae(back.train, "violation_count", "model_pred", ["cluster"]).collect()}
    assert {r.cluster: r.pred_mae for r in back.residuals.collect()} == got
    assert back.train.filter(F.col("model_pred").isNull()).count() == 0
