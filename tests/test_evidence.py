"""``model_evidence`` rolls the readings up once, however many parts it has."""

from loadloom.plans import forecast_queries as Q
from loadloom.plans import roles as R
from loadloom.plans import load_all

SF = "/root/testdata/sf0.001"


def test_model_evidence_rolls_readings_up_once(spark, monkeypatch):
    load_all()
    calls, tables = [], []
    daily, model_table = R.daily, Q.model_table
    monkeypatch.setattr(R, "daily", lambda *a: calls.append(a) or daily(*a))
    modes = [("elastic", m, float(w)) for m, w in (("none", 3), ("operational", 2), ("ex_post", 1))]

    def metrics(spark, sf, days=None):
        tables.append(model_table(spark, sf, days).count())
        return spark.createDataFrame(modes, "model string, mode string, wape double")

    monkeypatch.setattr(Q, "mode_metrics", metrics)  # the fits are not the matter here
    got = {(r.finding, r.subject): r.value for r in Q.model_evidence(spark, SF).collect()}
    assert len(calls) == 1 and tables[0] > 0
    assert got["weather_ablation", "elastic"] == 2 and got["operational_weather_cost", "elastic"] == 1
    monkeypatch.undo()
    assert {(r.finding, r.subject): r.value for r in Q.evidence_summary(spark, SF).collect()}.items() <= got.items()
