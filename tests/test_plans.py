"""Every registered analytics query against its SQL, and those without SQL for rows."""

import duckdb
import pandas as pd
import pytest

from aerograin.plans import cases, evaluation, hourly, learning, sensor, streams, studies

PLANS = (hourly, studies, sensor, cases, evaluation, streams, learning)
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
SQL = {k: v for p in PLANS for k, v in p.SQL.items()}
TABLES = ("events", "orders", "lineitem")


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        x = df[c]
        if str(x.dtype).startswith("datetime"):
            x = x.astype("datetime64[us]").astype(str)
        elif x.dtype == object or str(x.dtype) in ("boolean", "bool", "string"):
            x = x.map(lambda v: "" if v is None or v is pd.NA or v is pd.NaT else str(v))
        else:
            x = x.astype(float)
        out[c] = x
    return pd.DataFrame(out).sort_values(list(out), ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, atol=2e-6)


def rows(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def test_models_beat_carrying_on(spark, sf):
    got = {r["model"]: r for r in rows(spark, sf, "forecast_regression")}
    assert set(got) == {"ridge", "tree", "forest", "boosted", "persistence"} and len({r["n"] for r in got.values()}) == 1
    assert min(r["mae"] for k, r in got.items() if k != "persistence") < got["persistence"]["mae"]


def test_classifiers_tell_bad_hours(spark, sf):
    got = {r["model"]: r for r in rows(spark, sf, "forecast_classes")}
    assert set(got) == {"logistic", "tree", "forest", "perceptron"}
    assert max(r["accuracy"] for r in got.values()) > 0.6 and all(0 <= r["tp"] + r["fp"] + r["fn"] <= r["n"] for r in got.values())


def test_importance_lists_every_feature(spark, sf):
    assert sorted(r["feature"] for r in rows(spark, sf, "forecast_importance")) == sorted(learning.COLS)


def test_tuning_takes_the_first_of_the_best(spark, sf):
    got = rows(spark, sf, "forecast_tuned")
    assert len(got) == 5 and sum(r["chosen"] for r in got) == 1
    assert min(r["cv_mae"] for r in got if r["cv_mae"] is not None) == next(r["cv_mae"] for r in got if r["chosen"])


def test_forecasts_of_unseen_homes_and_by_indicators(spark, sf):
    got = rows(spark, sf, "forecast_unseen_homes")
    assert len(got) == 4 and sum(r["mae"] for r in got) < sum(r["mae_persistence"] for r in got)
    got = rows(spark, sf, "forecast_by_indicators")
    assert len(got) == 4 and all(r["n"] > 0 and r["mae_a"] > 0 and r["mae_b"] > 0 for r in got)


def test_fault_study(spark, sf):
    got = {r["fault"]: r for r in rows(spark, sf, "fault_study_rules")}
    assert "none" in got and len(got) > 1 and all(r["n_robust"] <= r["n"] for r in got.values())
    assert {r["model"] for r in rows(spark, sf, "fault_study_models")} == {"logistic", "tree", "forest", "perceptron"}


def test_continuity(spark, sf):
    got = rows(spark, sf, "continuity_summary")
    assert len(got) == 33 * 3 * len({r["method"] for r in got})
    steps = lambda m: sum(r["max_jump"] for r in got if r["method"] == m)
    assert steps("TWO_LEVEL") < steps("CRISP_MAX")  # the fuzzy index crosses a boundary without a jump
    assert all(0 <= r["max_jump"] and r["mean_jump"] <= r["max_jump"] + 1e-9 for r in got)
    assert rows(spark, sf, "continuity_smoothness")


def test_stale_outdoor_rounds_seconds_as_its_sql(spark, tmp_path):
    """Ages of 7200 s and a part of a second: the only reading of each home is at 00:00, the events come at 02:00."""
    con = duckdb.connect()
    con.execute(f"""copy (select i::bigint as event_id, timestamp '2024-01-01 02:00:00' + to_milliseconds([0, 600, 499, 501][i + 1]) as ts, i::bigint as user_id,
        'view' as event_type, 1.0::double as value, '' as props from range(4) t(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(SQL["stream_stale_outdoor"]).df()
    assert sorted(want["n_stale"]) == [0, 0, 1, 1]
    pd.testing.assert_frame_equal(normal(QUERIES["stream_stale_outdoor"](spark, str(tmp_path)).toPandas()), normal(want), check_dtype=False)


def test_what_has_no_sql_is_tested_here():
    assert set(QUERIES) - set(SQL) == {"forecast_regression", "forecast_classes", "forecast_tuned", "forecast_unseen_homes", "forecast_by_indicators", "forecast_importance", "fault_study_rules", "fault_study_models", "continuity_summary", "continuity_smoothness"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
