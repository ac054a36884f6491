"""Further registered queries: inverses, replays on a second frame, readers, rules and invariants of learned models.

Where a result follows from a rule alone, the SQL lists it; where a model is trained, the query returns what must hold for
any right model, such as known values left as they are and no missing value after filling.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import shared_path
from ..functions import metrics
from ..operators import dates, encoders, impute, parallel, select, split, stack, thresholds, tuner
from ..sources import narrow, sinks
from .catalog import _HOLES, _LABELLED, _PRIORITY, _frequency, _holes, _labelled, _orders, _t, _woe, query


def _text(x) -> str:
    return f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)


def _values(rows: list[tuple], columns: str) -> str:
    """SQL of a table of rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({columns})"


# --- encoders --------------------------------------------------------------------------------------------------------
@query(f"WITH s AS ({_frequency('events', 'event_id', 'event_type')}) SELECT event_id, min(event_type) OVER (PARTITION BY share) AS event_type FROM s JOIN events USING (event_id)")
def frequency_inverse(spark, d):
    e = encoders.FrequencyEncoder()
    return e.inverse_transform(e.fit_transform(_t(spark, d, "events").select("event_id", "event_type"), "event_type"))


@query(f"SELECT o_orderkey, {_PRIORITY} AS pr FROM orders")
def target_mean_inverse(spark, d):
    """Plain means back to categories."""
    o, e = _orders(spark, d, "o_totalprice"), encoders.MeanTargetEncoder(na_sentinel=False)
    e.fit_transform(o, "pr", "o_totalprice", "o_orderkey")
    return e.inverse_transform(e.transform(o)).select("o_orderkey", "pr")


@query(f"SELECT o_orderkey, {_PRIORITY} AS pr FROM orders")
def target_mean_oof_inverse(spark, d):
    """Means of training rows, each of its fold, back to categories."""
    e = encoders.MeanTargetEncoder(save_inverse_transform=True)
    return e.inverse_transform(e.fit_transform(_orders(spark, d, "o_totalprice"), "pr", "o_totalprice", "o_orderkey")).select("o_orderkey", "pr")


_OVER = "CAST(o_totalprice > 150000 AS INT) AS y"


@query(f"SELECT o_orderkey, {_PRIORITY} AS pr FROM orders")
def woe_inverse(spark, d):
    e = encoders.WeightOfEvidenceEncoder()
    return e.inverse_transform(e.fit_transform(_orders(spark, d, _OVER), "pr", "y", "o_orderkey"), noisy=True).select("o_orderkey", "pr")


@query(_woe("a.o_orderkey", f"SELECT o_orderkey, {_PRIORITY} AS c, CAST(o_totalprice > 150000 AS DOUBLE) AS y FROM orders WHERE o_orderkey % 22 <> 0", "coalesce(woe, 0)").replace("FROM o LEFT JOIN t ON o.c = t.c", f"FROM (SELECT o_orderkey, {_PRIORITY} AS c FROM orders) a LEFT JOIN t ON a.c = t.c"))
def woe_unseen(spark, d):
    o, e = _orders(spark, d, _OVER), encoders.WeightOfEvidenceEncoder(randomized=False)
    e.fit_transform(o.filter("o_orderkey % 22 <> 0"), "pr", "y", "o_orderkey")
    return e.transform(o).select("o_orderkey", F.round("pr", 6).alias("woe"))


@query(f"WITH o AS (SELECT o_orderkey, {_PRIORITY} AS pr FROM orders), c AS (SELECT c, row_number() OVER (ORDER BY k, c) - 1 AS code FROM (SELECT pr AS c, min(o_orderkey) AS k FROM o WHERE pr IS NOT NULL GROUP BY 1)) SELECT o_orderkey, coalesce(CAST(code AS VARCHAR), 'none') AS pr FROM o LEFT JOIN c ON pr = c")
def factorize_text_sentinel(spark, d):
    return encoders.Factorizer(na_sentinel="none").fit_transform(_orders(spark, d), "pr", "o_orderkey")


_WRONG = ("no frame", "no such column", "no column name", "apply before fit", "target of one class", "flag that is none")


@query(_values([(k, n) for k, n in zip(_WRONG, ("TypeError", "KeyError", "TypeError", "ValueError", "ValueError", "True is used"))], "wrong, answer"))
def encoder_validation(spark, d):
    """What is answered to wrong arguments."""
    o = _orders(spark, d)
    calls = (
        lambda: encoders.Factorizer().fit_transform([1, 2], "pr"),
        lambda: encoders.OneHotEncoder().fit_transform(o, "missing"),
        lambda: encoders.FrequencyEncoder().fit_transform(o, 3),
        lambda: encoders.FrequencyEncoder().transform(o),
        lambda: encoders.WeightOfEvidenceEncoder().fit_transform(o.withColumn("y", F.lit(1)), "pr", "y"),
        lambda: f"{encoders.FrequencyEncoder(na_sentinel='yes').na_sentinel} is used",
    )
    answers = []
    for call in calls:
        try:
            answers.append(call())
        except (TypeError, KeyError, ValueError) as e:
            answers.append(type(e).__name__)
    return spark.createDataFrame(list(zip(_WRONG, answers)), "wrong string, answer string")


# --- dates -----------------------------------------------------------------------------------------------------------
_FIELDS = {"year": "year({c})", "month": "month({c})", "day": "day({c})", "hour": "hour({c})", "minute": "minute({c})", "second": "second({c})", "weekday": "isodow({c}) - 1", "quarter": "quarter({c})", "week": "weekofyear({c})", "part_of_day": "CASE WHEN hour({c}) BETWEEN 6 AND 11 THEN 1 WHEN hour({c}) BETWEEN 12 AND 17 THEN 2 WHEN hour({c}) BETWEEN 18 AND 22 THEN 3 ELSE 4 END"}


def _varying(t: str, k: str, c: str, fitted: str = "TRUE", shown: str = "TRUE") -> str:
    """Features of t.c that vary among the rows `fitted`, as rows, for the rows `shown`."""
    rows = " UNION ALL ".join(f"SELECT {k}, '{n}' AS feature, CAST({e.format(c=c)} AS INTEGER) AS value, {fitted} AS fitted, {shown} AS shown FROM {t}" for n, e in _FIELDS.items())
    return f"WITH f AS ({rows}), kept AS (SELECT feature FROM f WHERE fitted GROUP BY 1 HAVING min(value) <> max(value)) SELECT {k}, feature, value FROM f WHERE shown AND feature IN (SELECT feature FROM kept)"


def _as_rows(df: DataFrame, key: str, prefix: str, names: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"{prefix}_{n}").cast("int").alias("value")) for n in names))
    return df.select(key, F.explode(pairs).alias("x")).select(key, "x.*")


@query(_varying("events", "event_id", "ts"))
def date_extract(spark, d):
    """The varying features of one timestamp column."""
    p = dates.DateParser()
    out = p.extract_date_features(_t(spark, d, "events").select("event_id", "ts"), "ts")
    return _as_rows(out, "event_id", "ts", p.kept["ts"])


@query(_varying("orders", "o_orderkey", "o_orderdate", "o_orderkey % 2 = 0", "o_orderkey % 2 <> 0"))
def date_replay(spark, d):
    """Learned on one half, applied to the other: the same columns."""
    rows = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss").alias("t"))
    p = dates.DateParser()
    p.fit_transform(rows.filter("o_orderkey % 2 = 0"))
    return _as_rows(p.transform(rows.filter("o_orderkey % 2 <> 0")), "o_orderkey", "t", p.kept["t"])


@query("SELECT 'o_orderdate' AS col, typeof(any_value(o_orderdate)) LIKE 'TIMESTAMP%' AS is_datetime, FALSE AS dayfirst, TRUE AS four_digits FROM orders UNION ALL SELECT 'a', FALSE, max(day(o_orderdate)) > 12 AND FALSE, bool_and(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '\\d{4}')) FROM orders UNION ALL SELECT 'b', FALSE, max(day(o_orderdate)) > 12, bool_and(regexp_matches(strftime(o_orderdate, '%d/%m/%y'), '\\d{4}')) FROM orders")
def date_kinds(spark, d):
    rows = _t(spark, d, "orders").select("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format("o_orderdate", "dd/MM/yy").alias("b"))
    found = [(c, dates.is_any_datetime(rows, c), c != "o_orderdate" and dates.infer_dayfirst(rows, c), c == "o_orderdate" or dates.is_year_four_digits(rows, c)) for c in rows.columns]
    return spark.createDataFrame(found, "col string, is_datetime boolean, dayfirst boolean, four_digits boolean")


@query("SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS epoch, CAST(day(o_orderdate) IN (1, 15) AS INTEGER) AS payday, CAST(day(o_orderdate) = 1 AND month(o_orderdate) = 1 AS INTEGER) AS holiday, CAST(o_orderkey % 9 AS INTEGER) AS apart FROM orders")
def date_legacy(spark, d):
    """The extra features, paydays, holidays and the days between two date columns."""
    o = _t(spark, d, "orders")
    year = F.year("o_orderdate")
    days = o.select(F.make_date(year, F.lit(1), F.lit(1)).alias("day")).distinct()
    rows = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 9).cast("int")), "yyyy-MM-dd").alias("b"))
    out = dates.DateParser(extra=True, payday=(1, 15), holidays=days).fit_transform(rows)
    return out.select("o_orderkey", F.col("a_dayofyear").alias("doy"), F.col("a_days_from_epoch").alias("epoch"), F.col("a_is_payday").alias("payday"), F.col("a_is_holiday").alias("holiday"), F.col("timediff").alias("apart"))


@query("SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday FROM orders")
def date_weeks(spark, d):
    iso = F.concat_ws(" ", F.weekofyear("o_orderdate"), F.lit("WK"), F.extract(F.lit("YEAROFWEEK"), "o_orderdate"))
    return _t(spark, d, "orders").select("o_orderkey", dates.parse_period(iso).cast("string").alias("monday"))


# --- readers and sinks -----------------------------------------------------------------------------------------------
def _csv(spark, d, sep: str = ",") -> str:
    path = shared_path(_t(spark, d, "part"))
    _t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").coalesce(1).write.option("header", True).option("sep", sep).csv(path)
    return path


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand, CAST(p_size AS TINYINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part")
def csv_narrowed(spark, d):
    out = narrow.TypeOptimizer(spark).optimize_memory_usage(_csv(spark, d))
    return out.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS TINYINT) AS p_size FROM part")
def csv_options(spark, d):
    """Another separator, and some of the columns."""
    out = narrow.TypeOptimizer(spark, sep=";", usecols=["p_partkey", "p_size"], encoding="UTF-8").optimize_memory_usage(_csv(spark, d, ";"))
    return out.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("SELECT 'file' AS source, count(*) AS n_rows, 4 AS n_columns FROM part UNION ALL SELECT 'frame', count(*), 6 FROM part")
def csv_shape(spark, d):
    t, part = narrow.TypeOptimizer(spark), _t(spark, d, "part")
    return spark.createDataFrame([("file", *t.get_shape(_csv(spark, d))), ("frame", *t.get_shape(part))], "source string, n_rows long, n_columns int")


@query("SELECT round(n * 20 / 1e6, 8) AS original_mb, round(n * (4 + 1 + CASE WHEN hi < 32767 THEN 2 ELSE 4 END) / 1e6, 8) AS optimized_mb, round((4 + 1 + CASE WHEN hi < 32767 THEN 2 ELSE 4 END) / 20, 8) AS ratio FROM (SELECT count(*) AS n, max(p_partkey) AS hi FROM part)")
def narrow_report(spark, d):
    t = narrow.TypeOptimizer(spark)
    t.optimize_memory_usage(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"))
    return t.report().select(*(F.round(c, 8).alias(c) for c in ("original_mb", "optimized_mb", "ratio")))


@query("SELECT kind, o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (VALUES ('parquet'), ('json'), ('csv'), ('orc')) k(kind)")
def sink_reports(spark, d):
    """What a plot shows, written in each format and read again."""
    report, out = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), None
    for kind in ("parquet", "json", "csv", "orc"):
        path = shared_path(report)
        sinks.save_report(report, path, kind)
        back = spark.read.schema("o_orderpriority string, n long" if kind != "json" else "n long, o_orderpriority string").option("header", True).format(kind).load(path)
        back = back.select(F.lit(kind).alias("kind"), "o_orderpriority", "n")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT p_partkey, round(p_retailprice * 2, 2) AS twice FROM part")
def model_store(spark, d):
    """A fitted model saved and loaded predicts as before."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=["p_retailprice"], outputCol="x").transform(_t(spark, d, "part").withColumn("y", F.col("p_retailprice") * 2))
    path = shared_path(rows)
    sinks.save_model(LinearRegression(featuresCol="x", labelCol="y", predictionCol="p").fit(rows), path)
    return sinks.load_model(path).transform(rows).select("p_partkey", F.round("p", 2).alias("twice"))


# --- splits ----------------------------------------------------------------------------------------------------------
_BINNED = "SELECT o_orderkey, CAST(1 + floor((o_totalprice - lo) / ((hi - lo) / (least(100, n // 10) - 1))) AS INTEGER) AS b FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders)"


@query(f"""WITH b AS ({_BINNED}), c AS (SELECT b, count(*) AS n FROM b GROUP BY 1), m AS (SELECT o_orderkey, CASE WHEN b = (SELECT max(b) FROM c) AND (SELECT n FROM c ORDER BY b DESC LIMIT 1) = 1 THEN b - 1 ELSE b END AS b FROM b),
    r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY b ORDER BY md5('0:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER (PARTITION BY b) AS n FROM m)
    SELECT o_orderkey, CASE WHEN r <= round(n * CAST(0.3 AS DOUBLE)) THEN 'test' ELSE 'train' END AS side FROM r WHERE r <= round(n * CAST(0.3 AS DOUBLE)) + round(n * CAST(0.7 AS DOUBLE))""")
def continuous_split_sides(spark, d):
    """The split of a continuous target: the greatest value, alone in its bin, joins the bin beside it."""
    train, test = split.scsplit(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", key="o_orderkey", random_state=0)
    return train.select("o_orderkey", F.lit("train").alias("side")).unionByName(test.select("o_orderkey", F.lit("test").alias("side")))


_SINGLE = ({1: 1, 2: 1, 3: 5, 7: 1, 9: 4}, {1: 4, 2: 1, 3: 6}, {1: 1, 5: 3, 6: 1, 8: 1}, {1: 2, 2: 3})


@query(_values([(0, 2, 1), (0, 7, 9), (1, 2, 1), (1, 3, 1), (2, 6, 5), (2, 1, 5), (2, 8, 5)], "number, bin, joins"))
def merge_single_bins(spark, d):
    return spark.createDataFrame([(k, b, to) for k, c in enumerate(_SINGLE) for b, to in split.combine_single_bins(c).items()], "number int, bin int, joins int")


@query(_values([(1, 30, 70), (2, 25, 75), (3, 40, 60), (4, 50, 50), (5, 20, 30)], "number, test_percent, train_percent"))
def split_sizes(spark, d):
    asked = ((None, None), (0.25, None), (None, 0.6), (0.5, 0.9), (0.2, 0.3))
    return spark.createDataFrame([(k, *(round(100 * x) for x in split.sizes(*a))) for k, a in enumerate(asked, 1)], "number int, test_percent int, train_percent int")


# --- imputation ------------------------------------------------------------------------------------------------------
@query("SELECT * FROM part")
def impute_nothing_missing(spark, d):
    return impute.NaNImputer().impute(_t(spark, d, "part"), key="p_partkey")


_NAMED = "o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('k', o_orderkey) END AS name"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Missing_data' ELSE 'k' || o_orderkey END AS name FROM orders")
def impute_text_fill(spark, d):
    """Text of more than 200 values has no model."""
    return impute.NaNImputer().impute(_t(spark, d, "orders").selectExpr(*_NAMED.split(", ", 1)), key="o_orderkey")


@query(f"WITH h AS (SELECT {_HOLES}, CAST(o_orderkey % 10 AS DOUBLE) AS f FROM orders) SELECT o_orderkey, a, b, e, f, TRUE AS full_row FROM h")
def impute_known_kept(spark, d):
    """After learning and filling: known values as they were (null where one was filled), and none missing. Hopeless columns go."""
    rows = _holes(spark, d).selectExpr("o_orderkey", "a", "b", "c", "d", "e", "CAST(o_orderkey % 10 AS double) AS f")
    out = impute.NaNImputer(train_sample_size=1000, trees=3, depth=3).impute(rows, key="o_orderkey")
    if {"c", "d"} & set(out.columns):
        raise ValueError("hopeless columns stayed")
    full = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("e").isNotNull() & F.col("f").isNotNull()
    known = lambda c, n: F.when(F.col("o_orderkey") % n != 0, F.col(c)).alias(c)
    return out.select("o_orderkey", known("a", 7), known("b", 5), "e", "f", full.alias("full_row"))


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) WHERE r <= 60")
def impute_class_sample(spark, d):
    return impute.sample(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 60, True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200")
def impute_sample(spark, d):
    return impute.sample(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 200, False)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey::DOUBLE END AS v, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE 'x' || o_custkey END AS w FROM orders")
def text_nulls(spark, d):
    """Numbers written as text with words for nothing become numbers; other text stays."""
    v = F.when(F.col("o_orderkey") % 10 == 0, "n/a").when(F.col("o_orderkey") % 5 == 0, " None ").otherwise(F.col("o_custkey").cast("string"))
    w = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
    return impute.fix_text_nulls(_t(spark, d, "orders").select("o_orderkey", v.alias("v"), w.alias("w")))


@query(f"WITH h AS (SELECT {_HOLES} FROM orders) SELECT 'mean' AS kind, round(avg(b), 4) AS value FROM h")
def fill_mean(spark, d):
    h = _holes(spark, d).select("a", "b")
    return spark.createDataFrame([("mean", impute.constants(h, impute.profile(h))["b"])], "kind string, value double").select("kind", F.round("value", 4).alias("value"))


# --- thresholds ------------------------------------------------------------------------------------------------------
@query(f"WITH r AS ({_LABELLED}) SELECT CAST(0.5 AS DOUBLE) AS threshold, round(avg(CAST(s <= 0.5 AS DOUBLE)), 8) AS score, CAST(0 AS DOUBLE) AS fraction_of_1 FROM r")
def threshold_one_class(spark, d):
    rows = _labelled(spark, d).withColumn("y", F.lit(0.0))
    return thresholds.ThreshTuner(100).fit(rows, "y", "s").withColumn("score", F.round("score", 8))


_BOUNDED = f"""WITH r AS ({_LABELLED}), b AS (SELECT greatest(0, avg(y) * CAST(0.8 AS DOUBLE)) AS lo, least(1, avg(y) * CAST(1.2 AS DOUBLE)) AS hi FROM r), g AS (SELECT lo + range * ((hi - lo) / 49) AS t FROM range(50), b),
    c AS (SELECT t, sum(CAST(s > t AS INTEGER)) AS n, sum(CASE WHEN s > t THEN y ELSE 0 END) AS tp, sum(y) AS pos, count(*) AS al FROM g CROSS JOIN r GROUP BY 1)"""


@query(_BOUNDED + " SELECT round(t, 8) AS threshold, round(2 * tp / (n + pos), 8) AS score, round(n / al, 8) AS fraction_of_1 FROM c WHERE n > 0")
def threshold_auto_bounds(spark, d):
    """Bounds about the labels' share of ones, and another score."""
    out = thresholds.ThreshTuner(50, auto_bounds=True).fit(_labelled(spark, d), "y", "s", "f1")
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


@query(_BOUNDED + " SELECT round(t, 8) AS threshold, round((tp - 3 * (n - tp)) / al, 8) AS score, round(n / al, 8) AS fraction_of_1 FROM c WHERE n > 0")
def threshold_own_score(spark, d):
    """A score of one's own: any aggregate of labels and predictions."""
    gain = lambda y, said: F.sum(F.when(said == 1, F.when(y == 1, 1.0).otherwise(-3.0)).otherwise(0.0)) / F.count(F.lit(1))
    out = thresholds.ThreshTuner(50, auto_bounds=True).fit(_labelled(spark, d), "y", "s", gain)
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


# --- selection, tuning, stacking -------------------------------------------------------------------------------------
@query(_values([(1, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "a")], "number, chosen"))
def choice_rule(spark, d):
    r = lambda score, n: {"score": score, "features": list(range(n))}
    cases = (({"a": r(0.9, 5), "b": r(0.8, 3)}, 0.0), ({"a": r(0.9, 5), "b": r(0.89, 3)}, 0.05), ({"a": r(0.9, 5), "b": r(0.9, 3)}, 0.0), ({"a": r(0.9, 3), "b": r(0.89, 5)}, 0.05), ({"a": r(-1.0, 4), "b": r(-2.0, 2)}, 0.1))
    return spark.createDataFrame([(k, select.choose(*c)) for k, c in enumerate(cases, 1)], "number int, chosen string")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey % 3 > 0 AND l_orderkey % 5 > 0 GROUP BY 1, 2")
def clean_rows(spark, d):
    """Rows with a missing or infinite value go."""
    q = F.when(F.col("l_orderkey") % 3 == 0, F.lit(float("inf"))).when(F.col("l_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_quantity"))
    out = select.cleaned(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), "l_tax"), ["q", "l_tax"])
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(_values([("regression", 2, "neg_root_mean_squared_error"), ("classification", 2, "roc_auc"), ("classification", 3, "neg_log_loss")], "objective, classes, scoring"))
def selector_scoring(spark, d):
    asked = (("regression", 2), ("classification", 2), ("classification", 3))
    return spark.createDataFrame([(o, c, select.FeatureSelector(o).scoring(c)) for o, c in asked], "objective string, classes int, scoring string")


def _explained(spark, d) -> DataFrame:
    """A target of two columns, and others that say nothing of it."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_linenumber").alias("last"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"))
    return li.withColumn("target", F.col("quantity") * 3 + F.col("last") * 40.0)


@query(_values([("linear", "last"), ("linear", "quantity")], "model, feature"))
def rfe_finds_causes(spark, d):
    """Elimination keeps the two columns that the target is made of."""
    s = select.FeatureSelector("regression", min_features_to_select=2, default_model="linear")
    s.fit_transform(_explained(spark, d), "target", "l_orderkey")
    return spark.createDataFrame([("linear", f) for f in s.selected_features if f in ("last", "quantity")], "model string, feature string")


@query("SELECT l_orderkey, sum(l_quantity) AS quantity, max(l_linenumber) AS last FROM lineitem GROUP BY 1")
def rfe_projection(spark, d):
    """transform() gives the kept columns of any frame."""
    s = select.FeatureSelector("regression")
    s.selected_features = ["l_orderkey", "quantity", "last"]
    return s.transform(_explained(spark, d))


_SPACES = [(20, "feature_fraction", "uniform"), (20, "num_leaves", "int"), *((50, n, k) for n, k in (("feature_fraction", "uniform"), ("num_leaves", "int"), ("bagging_fraction", "uniform"), ("min_sum_hessian_in_leaf", "log"))), *((150, n, k) for n, k in (("feature_fraction", "uniform"), ("num_leaves", "int"), ("bagging_fraction", "uniform"), ("min_sum_hessian_in_leaf", "log"), ("lambda_l1", "log"), ("lambda_l2", "log")))]


@query(_values(_SPACES, "trials, name, kind"))
def search_spaces(spark, d):
    return spark.createDataFrame([(n, name, kind) for n in (20, 50, 150) for name, (kind, *_) in tuner.default_space(n).items()], "trials int, name string, kind string")


@query(_values([("learning_rate", "uniform"), ("max_depth", "int"), ("num_leaves", "choice"), ("lambda_l1", "choice"), ("drop_rate", "uniform")], "name, kind"))
def aligned_spaces(spark, d):
    grid = {"learning_rate": (0.01, 0.3), "max_depth": (3, 9), "num_leaves": [15, 31], "lambda_l1": {"choices": [0.0, 1.0]}, "drop_rate": {"low": 0.1, "high": 0.5}, "top_rate": None}
    return spark.createDataFrame([(n, k) for n, (k, *_) in tuner.aligned_space(grid).items()], "name string, kind string")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 25.5 THEN CAST(2.5 AS DOUBLE) ELSE l_quantity - 25.5 END AS regression, CAST(l_discount > CAST(0.05 AS DOUBLE) AS INTEGER) AS binary, CASE WHEN l_tax >= l_discount THEN 0 ELSE 1 END AS multiclass FROM lineitem")
def decided_predictions(spark, d):
    raw = F.col("l_quantity") - 25.5  # exact in binary, so both engines see the same sign
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        tuner.decided(raw, "regression", least=2.5).alias("regression"), tuner.decided(F.col("l_discount"), "binary", 0.05).alias("binary"), tuner.decided(F.array("l_tax", "l_discount"), "multiclass").alias("multiclass"),
    )


_REPORTS = [("importances", True), ("history", True), ("intermediate", True), ("params", True), ("best never worsens", True), ("predictions in range", True), ("refit has best trees", True)]


@query(_values(_REPORTS, "report, holds"))
def tuner_reports(spark, d):
    """What must hold for any search: its reports have their rows, the best value never worsens, predictions lie within the target."""
    rows = _explained(spark, d)
    t = tuner.BoostingTuner("rmse", trials=2, max_iterations=2, verbosity=0, custom_lgbm_params={"max_depth": 2}).fit(rows, "target", "l_orderkey")
    best = [r.best for r in t.optimization_history().orderBy("trial").collect()]
    low, high = rows.agg(F.min("target"), F.max("target")).first()
    odd = t.predict(rows).filter(~F.col("prediction").between(low - 1e-6, high + 1e-6)).count()
    found = [t.importances().count() == 4, len(best) == 2, t.intermediate_values().count() >= 2, t.param_importances().count() == 2, best == sorted(best, reverse=True), odd == 0, t.fitted_model.getNumTrees <= 2]
    return spark.createDataFrame([(n, bool(x)) for (n, _), x in zip(_REPORTS, found)], "report string, holds boolean")


@query("SELECT l_orderkey, round(sum(l_quantity) * 3 + max(l_linenumber) * 40, 4) AS y, TRUE AS predicted, TRUE AS close FROM lineitem GROUP BY 1")
def stack_out_of_fold(spark, d):
    """Every row has a prediction of each model that hasn't seen it; the linear one finds the target, which is linear."""
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    common = {"featuresCol": "x", "labelCol": "y", "predictionCol": "p"}
    layer = [LinearRegression(**common), DecisionTreeRegressor(maxDepth=2, **common)]
    out = stack.Stacker("regression", layers=[layer], folds=2).fit_transform(_explained(spark, d), "target", "l_orderkey")
    return out.select("l_orderkey", F.round("y", 4).alias("y"), (F.col("layer0_0").isNotNull() & F.col("layer0_1").isNotNull()).alias("predicted"), (F.abs(F.col("layer0_0") - F.col("y")) < 0.01).alias("close"))


@query(_values([(k, a, b) for k, (a, b) in enumerate([(x, y) for x in (2, 3) for y in ("a", "b")])], "number, trees, depth").replace("'a'", "2").replace("'b'", "3"))
def stack_parameter_grid(spark, d):
    from pyspark.ml.regression import GBTRegressor

    e = GBTRegressor()
    grid = stack.parameter_grid(e, maxIter=[2, 3], maxDepth=[2, 3])
    rows = sorted((g[e.maxIter], g[e.maxDepth]) for g in grid)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "number int, trees int, depth int")


# --- metrics, parallel map -------------------------------------------------------------------------------------------
_ROUTES = [(m, "regression", p, "mse" if m == "r2" else m, "greater-better" if m == "r2" else "lower-better") for m, p in (("mae", "l1"), ("mse", "l2"), ("rmse", "rmse"), ("rmsle", "l2"), ("mape", "mape"), ("smape", "l2"), ("rmspe", "l2"), ("r2", "l2"))] + [(m, "binary", "binary_logloss", "log_loss", "lower-better" if m == "log_loss" else "greater-better") for m in ("auc", "gini", "log_loss", "accuracy", "precision", "recall", "f1", "lift", "balanced_accuracy")]


@query(_values(_ROUTES, "metric, task, pruning, goal, direction"))
def metric_routing(spark, d):
    return spark.createDataFrame([(m, metrics.objective(m, 2), metrics.pruning_metric(m, 2), metrics.optimization_metric(m), metrics.direction(m)) for m, *_ in _ROUTES], "metric string, task string, pruning string, goal string, direction string")


@query(f"WITH r AS ({_LABELLED}) SELECT round(avg(CAST((s > 0.5) = (y = 1) AS DOUBLE)), 8) AS accuracy, round(-avg(ln(greatest(CASE WHEN y = 1 THEN s ELSE 1 - s END, 1e-15))), 8) AS log_loss FROM r")
def metric_eval_score(spark, d):
    """Raw predictions: cut at a half for accuracy; of an array of probabilities that of the label for log_loss."""
    rows = _labelled(spark, d)
    accuracy = metrics.eval_score(rows, "y", "s", "accuracy", "binary")
    loss = metrics.eval_score(rows.withColumn("both", F.array(1 - F.col("s"), F.col("s"))), "y", "both", "log_loss", "multiclass")
    return spark.createDataFrame([(round(accuracy, 8), round(loss, 8))], "accuracy double, log_loss double")


@query("SELECT CAST(range AS BIGINT) AS place, CAST(range * 3 + 1 AS BIGINT) AS total FROM range(1000)")
def parallel_zip(spark, d):
    """Two collections cut alike; the function gets the chunks of one place."""
    total = parallel.Multicore(spark=spark).execute(lambda a, b: [x + y for x, y in zip(a, b)], list(range(1000)), [2 * x + 1 for x in range(1000)])
    return spark.createDataFrame(list(enumerate(total)), "place long, total long")


@query("SELECT CAST(range AS BIGINT) AS place, CAST(range * range AS BIGINT) AS square FROM range(500)")
def parallel_arrays(spark, d):
    found = parallel.Multicore(spark=spark).execute(np.square, np.arange(500))
    return spark.createDataFrame([(int(k), int(v)) for k, v in enumerate(found)], "place long, square long")


@query("SELECT o_orderkey, o_totalprice + c AS total FROM orders JOIN (SELECT c_custkey, max(c_acctbal) AS c FROM customer GROUP BY 1) ON o_custkey = c_custkey")
def parallel_zip_frames(spark, d):
    """Two frames, cut alike by a key."""
    a = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    b = _t(spark, d, "customer").groupBy(F.col("c_custkey").alias("k")).agg(F.max("c_acctbal").alias("c"))
    joined = lambda x, y: x.merge(y, on="k").assign(total=lambda m: m.o_totalprice + m.c)[["o_orderkey", "total"]]
    return parallel.Multicore(spark=spark).execute(joined, a, b, schema="o_orderkey long, total double", key="k")
