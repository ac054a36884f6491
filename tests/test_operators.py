"""Behaviour of the operators on small frames: round trips, unseen and missing values, limits, awkward input."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import metrics, util
from granary.operators import dates, impute, select, split, thresholds, tuner
from granary.operators.encoders import Factorizer, FrequencyEncoder, MeanTargetEncoder, OneHotEncoder, WeightOfEvidenceEncoder
from granary.operators.parallel import Multicore
from granary.operators.stack import Stacker, parameter_grid
from granary.sources import narrow, sinks
from granary.streaming.apply import apply_to_stream


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(42)
    rows = [(k, str(rng.choice(list("abcd"))) if k != 2 else None, float(rng.random()), int(rng.integers(0, 2))) for k in range(100)]
    return spark.createDataFrame(rows, "id long, x string, y double, z int").cache()


def _by_id(df, c="x"):
    return {r["id"]: r[c] for r in df.select("id", c).collect()}


def test_factorizer(spark, frame):
    e = Factorizer()
    out = _by_id(e.fit_transform(frame, "x", "id"))
    seen = []
    for k, v in sorted(_by_id(frame).items()):
        if v is not None and v not in seen:
            seen.append(v)
        assert out[k] == (-1 if v is None else seen.index(v))
    new = spark.createDataFrame([(1, "a"), (2, "new"), (3, None)], "id long, x string")
    assert _by_id(e.transform(new)) == {1: seen.index("a"), 2: -1, 3: -1}
    assert _by_id(e.inverse_transform(e.transform(frame))) == _by_id(frame)
    assert _by_id(Factorizer(na_sentinel=float("nan")).fit_transform(frame, "x", "id"))[2] is None
    text = Factorizer(na_sentinel="none")
    text.fit_transform(frame, "x", "id")
    assert _by_id(text.transform(new))[2] == "none"
    with pytest.raises(TypeError):
        e.fit_transform(pd.DataFrame(), "x")
    with pytest.raises(KeyError):
        e.fit_transform(frame, "nothing")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abäß \n", max_size=3)), min_size=1, max_size=20))
def test_encode_decode(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, x string")
    e = Factorizer()
    assert _by_id(e.inverse_transform(e.fit_transform(df, "x", "id"))) == dict(enumerate(values))
    if any(v is not None for v in values):
        e = OneHotEncoder()
        assert _by_id(e.inverse_transform(e.fit_transform(df, "x"))) == dict(enumerate(values))


def test_onehot(spark, frame):
    e = OneHotEncoder()
    out = e.fit_transform(frame, "x", "p")
    assert out.columns == ["id", "y", "z", "p_a", "p_b", "p_c", "p_d", "p_nan"]
    new = e.transform(spark.createDataFrame([(1, "new", 0.0, 1)], frame.schema)).first()
    assert sum(new[c] for c in e.indicators) == 0
    back = e.inverse_transform(out)
    assert back.columns == frame.columns and _by_id(back) == _by_id(frame)
    assert e.inverse_transform(frame.drop("x")).columns == ["id", "y", "z"]


def test_frequency(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["b", "b", "a", "a", "c", None, None])], "id long, x string")
    e = FrequencyEncoder()
    out = _by_id(e.fit_transform(df, "x"))
    assert out[2] == 2 / 7 and out[0] == out[5] == 2.1 / 7 and out[4] == 1 / 7
    assert _by_id(e.transform(spark.createDataFrame([(9, "new")], df.schema)))[9] == 2.1 / 7
    assert _by_id(e.inverse_transform(e.transform(df)))[2] == "a"
    off = FrequencyEncoder(na_sentinel=False)
    assert _by_id(off.fit_transform(df, "x"))[5] is None


def test_target_mean(spark, frame):
    e = MeanTargetEncoder(save_inverse_transform=True)
    out = _by_id(e.fit_transform(frame, "x", "y", "id"))
    rows = frame.withColumn("f", __import__("granary.core", fromlist=["x"]).hash_fold("id", 5, 5)).collect()
    for r in rows:
        other = [q.y for q in rows if q.x == r.x and q.f != r.f]
        assert out[r.id] == pytest.approx(np.mean(other) if r.x else np.mean([q.y for q in rows]))
    assert _by_id(e.inverse_transform(e.transform(frame)))[0] == _by_id(frame)[0]
    back = _by_id(e.inverse_transform(e.fit_transform(frame, "x", "y", "id")))
    assert all(back[k] == v for k, v in _by_id(frame).items())


def test_weight_of_evidence(frame):
    e = WeightOfEvidenceEncoder()
    noisy = e.fit_transform(frame, "x", "z", "id")
    plain = e.transform(frame)
    assert _by_id(plain)[2] == 0 and _by_id(noisy)[0] != _by_id(plain)[0]
    for back in (e.inverse_transform(plain), e.inverse_transform(noisy, noisy=True)):
        assert all(v == _by_id(frame)[k] for k, v in _by_id(back).items())
    with pytest.raises(ValueError):
        e.fit_transform(frame, "x", "y")


FORMATS = ["2023-01-25", "2023/1/25", "2023.01.25 4:05", "25-01-2023", "25/01/2023 13:00:59", "01-25-2023", "1/25/2023 1:02", "2023-01-25T13:00:00Z", "2023-01-25 13:00 UTC", "2023-01-25 13:00:00+0400", "2023-01-25 13:00:00 +04:00", "2023-01-25T13:00+04"]


@pytest.mark.parametrize("text", FORMATS)
def test_date_formats(spark, text):
    other = text.replace("25", "24", 1)
    df = spark.createDataFrame([(text, "a"), (other, "b"), (None, "c")], "d string, t string")
    assert dates.find_datetime_cols(df) == ["d"]
    out = dates.DateParser().fit(df)
    row = df.select(out._value("d").alias("v")).first().v
    assert (row.year, row.month, row.day) == (2023, 1, 25)


def test_no_dates(spark):
    df = spark.createDataFrame([("1.25", "2023-01-25 10:00:00.123", "x", "2020-01-01"), ("7.5", "2023-01-26 10:00:00.123", "y", "2020-01-01")], "a string, b string, c string, same string")
    assert dates.find_datetime_cols(df) == []
    assert dates.DateParser().fit_transform(df).columns == df.columns


def test_date_features_replay(spark):
    train = spark.createDataFrame([("2023-01-25 05:00:00",), ("2024-02-26 13:30:00",)], "t string")
    test = spark.createDataFrame([("2024-03-01 23:00:00",)], "t string")
    p = dates.DateParser()
    out = p.fit_transform(train)
    assert out.columns == [f"t_{f}" for f in ("year", "month", "day", "hour", "minute", "weekday", "quarter", "week", "part_of_day") if f != "quarter"]
    row = p.transform(test).first()
    assert p.transform(test).columns == out.columns and row.t_part_of_day == 4 and row.t_weekday == 4
    assert train.select(dates.part_of_day(F.lit(23), strict=True)).first()[0] is None


def test_narrowing(spark, tmp_path):
    for low, high, kind in ((0, 126, "tinyint"), (0, 127, "smallint"), (-128, 0, "smallint"), (0, 32767, "int"), (0, 2**31, "bigint"), (None, None, "bigint")):
        assert narrow.narrowest(low, high, narrow.INTEGERS) == kind
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("a;b;c\n" + "".join(f"{k};{k * 1.5};t{k}\n" for k in range(100)))
    o = narrow.TypeOptimizer(spark, sep=";")
    assert o.get_shape(path) == (100, 3)
    out = o.optimize_memory_usage(path)
    assert dict(out.dtypes) == {"a": "tinyint", "b": "float", "c": "string"} and o.ratio < 1 and o.report().count() == 1


def test_split_rules():
    assert split.sizes(None, None) == (0.3, 0.7) and split.sizes(0.2, None) == (0.2, 0.8) and split.sizes(0.5, 0.7) == (0.5, 0.5)
    assert [split.estimate_nbins(n) for n in (5, 15, 999, 5000)] == [0, 1, 99, 100]
    assert split.combine_single_bins({1: 5, 2: 3}) == {}
    assert split.combine_single_bins({1: 1, 2: 1, 9: 4}) == {2: 1}
    assert split.combine_single_bins({1: 9, 7: 1}) == {7: 1}
    to = split.combine_single_bins({1: 9, 2: 1, 3: 4, 8: 1})
    assert 8 in to and (to.get(2) == 1 or to.get(3) == 2)


def test_split(spark, frame):
    train, test = split.scsplit(frame, "y", key="id", random_state=0)
    a, b = set(_by_id(train)), set(_by_id(test))
    assert not a & b and len(a | b) == 100 and 25 <= len(b) <= 35
    again = split.scsplit(frame.repartition(7), "y", key="id", random_state=0)[1]
    assert set(_by_id(again)) == b
    x1, x2, y1, y2 = split.scsplit(frame.filter("x is not null"), "x", 0.5, continuous=False, key="id", target="z")
    assert "z" not in x1.columns and y1.columns == ["z"] and x1.count() + x2.count() == 99
    gap = abs(train.agg(F.avg("y")).first()[0] - test.agg(F.avg("y")).first()[0])
    assert gap < 0.1


def _holes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        a = float(rng.normal())
        rows.append((k, a, 2 * a + 1 if k % 7 else None, ("u" if a > 0 else "v") if k % 5 else None, k % 3 if k % 11 else None, None, "only" if k % 4 else None, f"text{k}" if k % 9 else None, 1.0 if k % 3 == 0 else None))
    return spark.createDataFrame(rows, "id long, a double, b double, c string, d int, e double, f string, g string, h double")


def test_imputer(spark):
    df = _holes(spark)
    i = impute.NaNImputer(trees=5, depth=3)
    out = i.impute(df, key="id")
    assert i.to_drop == ["e", "f", "h"] and i.text == ["g"]
    assert out.columns == ["id", "a", "b", "c", "d", "g"] and out.count() == 300
    assert all(out.filter(F.col(c).isNull()).count() == 0 for c in out.columns)
    assert out.filter("g = 'Missing_data'").count() == 34
    rows = {r.id: r for r in out.collect()}
    assert {r.c for r in rows.values()} == {"u", "v"} and {r.d for r in rows.values()} == {0, 1, 2}
    missed = [r for r in df.collect() if r.b is None]
    assert np.mean([abs(rows[r.id].b - 2 * r.a - 1) for r in missed]) < 0.8
    known_c = [(rows[r.id].c == ("u" if r.a > 0 else "v")) for r in df.collect() if r.c is None]
    assert np.mean(known_c) > 0.85
    other = i.impute(df.limit(50), drop_hopeless=False, key="id")
    assert other.columns == out.columns
    assert i.impute(out, key="id") is out


def test_imputer_rules(spark):
    t = _holes(spark).schema
    assert impute.objective(t["a"].dataType, 29, True) == "regression" and impute.objective(t["d"].dataType, 29, False) == "multiclass"
    assert impute.objective(t["d"].dataType, 30, False) == "regression" and impute.objective(t["c"].dataType, 2, False) == "binary"
    assert impute.hopeless({"nulls": 51, "distinct": 9, "rows": 100}) and not impute.hopeless({"nulls": 50, "distinct": 9, "rows": 100})
    fixed = impute.fix_text_nulls(spark.createDataFrame([("1.5", "x"), ("NA", "y"), (None, "1")], "a string, b string"))
    assert fixed.dtypes == [("a", "double"), ("b", "string")]


def test_metrics(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    row = metrics.evaluate(df, "y", "p", ["auc", "gini", "mae", "rmse", "r2"]).first()
    assert row.auc == pytest.approx(np.mean(pairs)) and row.gini == pytest.approx(2 * np.mean(pairs) - 1)
    assert row.mae == pytest.approx(abs(y - p).mean()) and row.rmse == pytest.approx(math.sqrt(((y - p) ** 2).mean()))
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert len(metrics.NAMES) == 23 and metrics.optimization_metric("r2") == "mse" and metrics.pruning_metric("auc", 2) == "binary_logloss" and metrics.direction("auc") == "greater-better"
    three = spark.createDataFrame([(2, [0.1, 0.2, 0.7]), (0, [0.5, 0.4, 0.1]), (1, [0.6, 0.3, 0.1])], "y int, p array<double>")
    assert metrics.eval_score(three, "y", "p", "accuracy", "multiclass") == pytest.approx(2 / 3)
    assert metrics.eval_score(three, "y", "p", "log_loss", "multiclass") == pytest.approx(-np.mean(np.log([0.7, 0.5, 0.3])))
    with pytest.raises(ValueError):
        metrics.evaluate(df, "y", "p", ["nothing"])


def test_thresholds(spark):
    p = np.linspace(0, 1, 500)
    df = spark.createDataFrame([(1.0 if k < 200 else 0.0, float(v)) for k, v in enumerate(p)], "y double, p double")
    t = thresholds.ThreshTuner(100)
    t.fit(df, "y", "p")
    best = t.best_predict_ratio().first()
    assert best.threshold == pytest.approx(0.6, abs=0.01) and best.fraction_of_1 == pytest.approx(0.4, abs=0.01)
    assert t.best_score().count() >= 1
    one = thresholds.ThreshTuner().fit(df.withColumn("y", F.lit(0.0)), "y", "p", "accuracy").collect()
    assert len(one) == 1 and one[0].threshold == 0.5 and one[0].fraction_of_1 == 0
    with pytest.raises(ValueError):
        t.fit(df.withColumn("y", F.lit(3.0)), "y", "p")


def test_selection(spark):
    r = {"linear": {"score": 0.9, "features": [1, 2, 3]}, "forest": {"score": 0.89, "features": [1, 2]}}
    assert select.choose(r) == "linear" and select.choose(r, 0.05) == "forest" and select.choose(r, 0.001) == "linear"
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, v), float(3 * v[0] - 2 * v[1])) for k, v in enumerate(rng.normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, t double")
    s = select.FeatureSelector(min_features_to_select=2)
    assert {"a", "b"} <= set(s.fit_transform(df, "t", "id").columns)
    assert s.transform(df).columns == s.selected_features
    auto = select.FeatureSelector(auto=True, min_features_to_select=3, step=1)
    assert {"a", "b"} <= set(auto.fit_transform(df, "t", "id").columns) and set(auto.results) == {"linear", "forest"}


def test_tuner(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, v), int(v[0] + v[1] > 0)) for k, v in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, t int")
    t = tuner.BoostingTuner("auc", trials=2, max_iterations=3, verbosity=0)
    t.grid = {"num_leaves": (4, 8), "learning_rate": [0.05, 0.1], "feature_fraction": {"low": 0.6, "high": 1.0}, "lambda_l1": None}
    t.fit(df, "t", "id")
    assert t.predict(df).filter("prediction = t").count() > 150
    assert 0 <= t.predict_proba(df).agg(F.min("probability_of_1")).first()[0] <= 1
    assert abs(sum(t.feature_importances.values()) - 1) < 1e-3 and t.importances(2).count() == 2
    assert t.optimization_history().count() == 2 and t.intermediate_values().count() >= 2 and t.param_importances().count() >= 2
    for bad in ({"nothing": [1]}, {"num_leaves": {"lo": 1}}):
        with pytest.raises(ValueError):
            tuner.aligned_space(bad)
    with pytest.raises(ValueError):
        t.predict(df, threshold=1)
    sinks.save_model(t.fitted_model, str(tmp_path / "model"))
    assert sinks.load_model(str(tmp_path / "model")).getNumTrees == t.fitted_model.getNumTrees
    sinks.save_report(t.importances(), str(tmp_path / "report"), "json")
    assert spark.read.json(str(tmp_path / "report")).count() == 3
    assert set(tuner.default_space(200)) == {"feature_fraction", "num_leaves", "bagging_fraction", "min_sum_hessian_in_leaf", "lambda_l1", "lambda_l2"}


def test_stacking(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, *map(float, v), float(v[0])) for k, v in enumerate(rng.normal(size=(80, 2)))], "id long, a double, b double, t double")
    from pyspark.ml.regression import LinearRegression

    lr = LinearRegression(featuresCol="x", labelCol="y", predictionCol="p")
    s = Stacker("regression", layers=[[lr, lr.copy({lr.regParam: 0.5})]], folds=2, depth=2)
    out = s.fit_transform(df, "t", "id")
    assert out.count() == 80 and "layer0_0" in out.columns and "row_mean" in out.columns
    applied = s.transform(df.drop("t")).collect()
    assert max(abs(r.layer0_0 - q.t) for r, q in zip(sorted(applied, key=lambda r: r.id), df.orderBy("id").collect())) < 0.1
    assert len(parameter_grid(lr, regParam=[0.0, 1.0], maxIter=[5, 10])) == 4


def test_multicore(spark):
    m, x = Multicore(2, spark), list(range(101))
    assert m.execute(lambda c: [v * 2 for v in c], x) == [v * 2 for v in x]
    assert (m.execute(lambda c: c + 1, np.arange(9)) == np.arange(9) + 1).all()
    assert m.execute(lambda c, d: [a + b for a, b in zip(c, d)], x, x) == [2 * v for v in x]
    assert m.execute(lambda c: {k: v + 1 for k, v in c.items()}, {"a": 1, "b": 2, "c": 3}) == {"a": 2, "b": 3, "c": 4}
    assert m.execute(lambda c: c * 2, pd.Series([1, 2, 3])).tolist() == [2, 4, 6]
    assert m.execute(lambda c: (len(c), sum(c)), [1, 2, 3]) == [[2, 3], [1, 3]]
    with pytest.raises(TypeError):
        m.execute(lambda c: 5, x)
    with pytest.raises(ValueError):
        Multicore(10_000, spark)


def test_messages(capsys):
    assert [util.spelled(s)[-7:] for s in (1, 61, 3661)] == ["seconds"] * 3 and util.spelled(3661).startswith("1 hours 1 minutes")

    @util.timer
    def f():
        return 5

    assert f() == 5 and "f: " in capsys.readouterr().out
    p = util.Printer(1)
    p.print("shown", 1)
    p.print("hidden", 2)
    p.print("bad", "error")
    out = capsys.readouterr().out
    assert "shown" in out and "hidden" not in out and "bad" in out


def test_fitted_lookup_on_a_stream(spark, frame, tmp_path):
    e = FrequencyEncoder()
    e.fit_transform(frame, "x")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    apply_to_stream(e, stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_entry_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "granary", tmp_path / "granary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'frequency_event_type' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_dates_are_read_without_a_failing_parser(spark, monkeypatch):
    """One pass for all columns; a value that is no date in some order isn't given to a parser, which would raise an error for it."""
    from granary.plans import catalog

    texts = ["2024-02-29", "29/02/2000 23:59", "29.02.1900", "31-04-2023", "12/31/99T1:2:3Z", "2023-01-25 10:00 +02:00", "2023-01-25 24:00", "2020-01-01\n", "0000-01-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    read = df.select("t", *(dates.parsed(F.col("t"), o).cast("string").alias(o) for o in dates.ORDERS))
    assert "gettimestamp" not in read._jdf.queryExecution().toString().lower()
    found = {r.t: (r.ymd, r.mdy, r.dmy) for r in read.collect()}
    assert [found[t] for t in texts] == [
        ("2024-02-29 00:00:00", None, None), (None, None, "2000-02-29 23:59:00"), (None, None, None), (None, None, None), (None, "2099-12-31 01:02:03", None),
        ("2023-01-25 10:00:00", None, None), (None, None, None), (None, None, None), ("0000-01-01 00:00:00", None, None),
    ]
    calls, detect = [], dates.detect
    monkeypatch.setattr(dates, "detect", lambda *a: calls.append(1) or detect(*a))
    assert catalog.date_detect(spark, "/root/testdata/sf0.001").count() == 6 and len(calls) == 1


def test_tuner_trains_on_even_tasks(spark, monkeypatch):
    """Training rows in one file with one row group are dealt to several tasks, none of which has most of them."""
    df = spark.range(40_000).coalesce(1).selectExpr("id", "double(id % 97) AS a", "double(id % 89) AS b", "double(id % 97 + id % 7) AS t")
    seen, estimator = [], tuner.BoostingTuner._estimator

    def watched(self, p, trees):
        e = estimator(self, p, trees)
        fit = e.fit
        e.fit = lambda d: seen.append([r[1] for r in d.groupBy(F.spark_partition_id()).count().collect()]) or fit(d)
        return e

    monkeypatch.setattr(tuner.BoostingTuner, "_estimator", watched)
    t = tuner.BoostingTuner("rmse", trials=1, max_iterations=1, verbosity=0, custom_lgbm_params={"max_depth": 2}).fit(df, "t", "id")
    assert t.fitted_model and len(seen) == 2 and all(len(x) == 4 and max(x) < 0.3 * sum(x) for x in seen)
    assert sum(seen[1]) == 40_000


def test_stacker_trains_on_even_tasks(spark):
    from pyspark.ml.regression import LinearRegression

    seen = []

    class Watched(LinearRegression):
        def _fit(self, dataset):
            seen.append([r[1] for r in dataset.groupBy(F.spark_partition_id()).count().collect()])
            return super()._fit(dataset)

    df = spark.range(40_000).coalesce(1).selectExpr("id", "double(id % 97) AS a", "double(id % 97 + id % 7) AS t")
    out = Stacker("regression", layers=[[Watched(featuresCol="x", labelCol="y", predictionCol="p")]], folds=2).fit_transform(df, "t", "id")
    assert out.filter("layer0_0 is not null").count() == 40_000
    assert len(seen) == 2 and all(len(x) == 4 and max(x) < 0.3 * sum(x) for x in seen)
