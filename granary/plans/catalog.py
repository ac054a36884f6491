"""The registered queries of the library and the same in SQL for DuckDB.

Text that both engines share is written once; where a row identity matters, it is the table's unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import hash_fold
from ..functions import metrics
from ..operators import dates, encoders, impute, parallel, select, split, stack, thresholds, tuner
from ..sources import narrow

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- encoders --------------------------------------------------------------------------------------------------------
_CODES = """codes AS (SELECT c, row_number() OVER (ORDER BY k, c) - 1 AS code FROM (SELECT {c} AS c, min({k}) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY 1))"""


@query("WITH " + _CODES.format(c="p_brand", k="p_partkey", t="part") + " SELECT p_partkey, code AS p_brand FROM part JOIN codes ON p_brand = c")
def factorize_brand(spark, d):
    return encoders.Factorizer().fit_transform(_t(spark, d, "part"), "p_brand", "p_partkey").select("p_partkey", "p_brand")


_PRIORITY = "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'X' || o_orderpriority ELSE o_orderpriority END"


def _orders(spark, d, *columns: str) -> DataFrame:
    """orders with injected nulls and rare categories in `pr`."""
    return _t(spark, d, "orders").selectExpr("o_orderkey", f"{_PRIORITY} AS pr", *columns)


@query(f"WITH o AS (SELECT o_orderkey, {_PRIORITY} AS pr FROM orders), " + _CODES.format(c="pr", k="o_orderkey", t="o WHERE o_orderkey % 22 <> 0 AND TRUE").replace("WHERE o_orderkey % 22 <> 0 AND TRUE WHERE", "WHERE o_orderkey % 22 <> 0 AND") + " SELECT o_orderkey, coalesce(code, -1) AS pr FROM o LEFT JOIN codes ON pr = c")
def factorize_unseen(spark, d):
    o = _orders(spark, d)
    e = encoders.Factorizer()
    e.fit_transform(o.filter("o_orderkey % 22 <> 0"), "pr", "o_orderkey")
    return e.transform(o)


@query(f"WITH o AS (SELECT o_orderkey, {_PRIORITY} AS pr FROM orders) SELECT o_orderkey, pr FROM o")
def factorize_inverse(spark, d):
    e = encoders.Factorizer()
    return e.inverse_transform(e.fit_transform(_orders(spark, d), "pr", "o_orderkey"))


_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _long(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Indicator columns as rows, so that the result's columns don't depend on the data."""
    pairs = F.array(*(F.struct(F.lit(n).alias("category"), F.col(f"`{n}`").alias("indicator")) for n in names))
    return df.select(key, F.explode(pairs).alias("x")).select(key, "x.category", "x.indicator")


@query("SELECT o_orderkey, 'p_' || c AS category, CAST(o_orderpriority = c AS INTEGER) AS indicator FROM orders CROSS JOIN (SELECT DISTINCT o_orderpriority AS c FROM orders)")
def onehot_priority(spark, d):
    e = encoders.OneHotEncoder()
    out = e.fit_transform(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "p")
    return _long(out, "o_orderkey", list(e.indicators))


@query(f"WITH o AS (SELECT o_orderkey, {_PRIORITY} AS pr FROM orders) SELECT o_orderkey, coalesce(c, 'nan') AS category, CAST(pr IS NOT DISTINCT FROM c AS INTEGER) AS indicator FROM o CROSS JOIN (SELECT DISTINCT pr AS c FROM o WHERE o_orderkey % 11 <> 0)")
def onehot_unseen(spark, d):
    o, e = _orders(spark, d), encoders.OneHotEncoder()
    e.fit_transform(o.filter("o_orderkey % 11 <> 0"), "pr")
    return _long(e.transform(o), "o_orderkey", list(e.indicators))


@query(f"SELECT o_orderkey, {_PRIORITY} AS pr FROM orders")
def onehot_inverse(spark, d):
    e = encoders.OneHotEncoder()
    return e.inverse_transform(e.fit_transform(_orders(spark, d), "pr")).select("o_orderkey", "pr")


def _frequency(t: str, k: str, c: str) -> str:
    return f"""WITH n AS (SELECT {c} AS c, count(*) AS n FROM {t} GROUP BY 1),
        s AS (SELECT c, (n + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY c NULLS LAST) > 1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) / (SELECT count(*) FROM {t}) AS share FROM n)
        SELECT {k}, round(share, 8) AS share FROM {t} JOIN s ON {c} IS NOT DISTINCT FROM s.c"""


@query(_frequency("events", "event_id", "event_type"))
def frequency_event_type(spark, d):
    out = encoders.FrequencyEncoder().fit_transform(_t(spark, d, "events").select("event_id", "event_type"), "event_type")
    return out.select("event_id", F.round("event_type", 8).alias("share"))


@query(_frequency("nation", "n_nationkey", "n_regionkey"))
def frequency_tie(spark, d):
    out = encoders.FrequencyEncoder().fit_transform(_t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey")
    return out.select("n_nationkey", F.round("n_regionkey", 8).alias("share"))


@query(f"WITH o AS (SELECT o_orderkey, {_PRIORITY} AS pr FROM orders), n AS (SELECT pr AS c, count(*) AS n FROM o WHERE o_orderkey % 22 <> 0 GROUP BY 1), s AS (SELECT c, (n + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY c NULLS LAST) > 1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) / (SELECT count(*) FROM o WHERE o_orderkey % 22 <> 0) AS share FROM n) SELECT o_orderkey, round(coalesce(share, (SELECT max(share) FROM s)), 8) AS share FROM o LEFT JOIN s ON pr IS NOT DISTINCT FROM c")
def frequency_unseen(spark, d):
    o, e = _orders(spark, d), encoders.FrequencyEncoder()
    e.fit_transform(o.filter("o_orderkey % 22 <> 0"), "pr")
    return e.transform(o).select("o_orderkey", F.round("pr", 8).alias("share"))


_FOLD = "CAST(('0x' || substr(md5('5:' || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 5"


@query(f"""WITH o AS (SELECT o_orderkey, {_PRIORITY} AS pr, o_totalprice AS y, {_FOLD} AS f FROM orders),
    t AS (SELECT pr, sum(y) AS s, count(*) AS n FROM o GROUP BY 1), p AS (SELECT pr, f, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2)
    SELECT o_orderkey, round(coalesce(CASE WHEN o.pr IS NOT NULL AND t.n > p.n THEN (t.s - p.s) / (t.n - p.n) END, (SELECT avg(y) FROM o)), 4) AS pr
    FROM o JOIN t ON o.pr IS NOT DISTINCT FROM t.pr JOIN p ON o.pr IS NOT DISTINCT FROM p.pr AND o.f = p.f""")
def target_mean_oof(spark, d):
    out = encoders.MeanTargetEncoder().fit_transform(_orders(spark, d, "o_totalprice"), "pr", "o_totalprice", "o_orderkey")
    return out.select("o_orderkey", F.round("pr", 4).alias("pr"))


@query(f"""WITH o AS (SELECT o_orderkey, {_PRIORITY} AS pr, o_totalprice AS y FROM orders), f AS (SELECT * FROM o WHERE o_orderkey % 22 <> 0), t AS (SELECT pr, avg(y) AS m FROM f GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o.pr IS NOT NULL THEN round(coalesce(m, (SELECT avg(y) FROM f)), 4) END AS pr FROM o LEFT JOIN t ON o.pr = t.pr""")
def target_mean_apply(spark, d):
    o, e = _orders(spark, d, "o_totalprice"), encoders.MeanTargetEncoder(na_sentinel=False)
    e.fit_transform(o.filter("o_orderkey % 22 <> 0"), "pr", "o_totalprice", "o_orderkey")
    return e.transform(o).select("o_orderkey", F.round("pr", 4).alias("pr"))


def _woe(keys: str, rows: str, value: str) -> str:
    return f"""WITH o AS ({rows}), w AS (SELECT sum(y) AS pos, count(*) - sum(y) AS neg FROM o),
        t AS (SELECT c, ln(((sum(y) + 1) / ((SELECT pos FROM w) + 2)) / ((count(*) - sum(y) + 1) / ((SELECT neg FROM w) + 2))) AS woe FROM o WHERE c IS NOT NULL GROUP BY 1)
        SELECT {keys}, round({value}, 6) AS woe FROM o LEFT JOIN t ON o.c = t.c"""


@query(_woe("o.c AS l_returnflag, count(*) AS n", "SELECT l_returnflag AS c, CAST(l_discount > 0.05 AS DOUBLE) AS y FROM lineitem", "coalesce(woe, 0)") + " GROUP BY o.c, woe")
def woe_flag(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("c"), F.col("l_returnflag"), (F.col("l_discount") > 0.05).cast("int").alias("y"))
    e = encoders.WeightOfEvidenceEncoder(randomized=False)
    return e.fit_transform(rows, "c", "y").groupBy("l_returnflag", F.round("c", 6).alias("woe")).agg(F.count(F.lit(1)).alias("n"))


_NORMAL = " * (1 + 0.05 * sqrt(-2 * ln((CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) + 1) / 4294967297.0)) * cos(2 * pi() * ((CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 8)) AS BIGINT) + 1) / 4294967297.0)))"


@query(_woe("o_orderkey", f"SELECT o_orderkey, {_PRIORITY} AS c, CAST(o_totalprice > 150000 AS DOUBLE) AS y FROM orders", "coalesce(woe, 0)" + _NORMAL))
def woe_noise(spark, d):
    rows = _orders(spark, d, "CAST(o_totalprice > 150000 AS INT) AS y")
    out = encoders.WeightOfEvidenceEncoder().fit_transform(rows, "pr", "y", "o_orderkey")
    return out.select("o_orderkey", F.round("pr", 6).alias("woe"))


# --- dates -----------------------------------------------------------------------------------------------------------
_PARTS = "CAST(year({c}) AS INTEGER) AS y, CAST(month({c}) AS INTEGER) AS mo, CAST(day({c}) AS INTEGER) AS d, CAST(hour({c}) AS INTEGER) AS h, CAST(minute({c}) AS INTEGER) AS mi, CAST(second({c}) AS INTEGER) AS s, CAST(isodow({c}) - 1 AS INTEGER) AS wd, CAST(quarter({c}) AS INTEGER) AS q, CAST(weekofyear({c}) AS INTEGER) AS w"


@query(f"SELECT event_id, {_PARTS.format(c='ts')}, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 1 WHEN hour(ts) BETWEEN 12 AND 17 THEN 2 WHEN hour(ts) BETWEEN 18 AND 22 THEN 3 ELSE 4 END AS part FROM events")
def date_features(spark, d):
    names = dict(zip(dates.FEATURES, ("y", "mo", "d", "h", "mi", "s", "wd", "q", "w", "part")))
    return _t(spark, d, "events").select("event_id", *(dates.feature(F.col("ts"), f).cast("int").alias(n) for f, n in names.items()))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS t_year, CAST(month(o_orderdate) AS INTEGER) AS t_month, CAST(day(o_orderdate) AS INTEGER) AS t_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS t_weekday, CAST(quarter(o_orderdate) AS INTEGER) AS t_quarter, CAST(weekofyear(o_orderdate) AS INTEGER) AS t_week FROM orders")
def date_parse_text(spark, d):
    """Dates written day first, found, read and expanded."""
    rows = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("t"), "o_orderstatus")
    out = dates.DateParser().fit_transform(rows)
    return out.select("o_orderkey", *(F.col(f"t_{f}").cast("int") for f in ("year", "month", "day", "weekday", "quarter", "week")))


@query(r"""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, CASE WHEN o_orderkey % 12 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, CAST(o_totalprice AS VARCHAR) AS e, o_orderstatus AS f FROM orders),
    l AS (UNPIVOT o ON a, b, c, d, e, f INTO NAME col VALUE v)
    SELECT col, round(avg(CAST(regexp_matches(v, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2})?)?(?:Z|(?: ?(?:[A-Z]{1,5}(?:[+-]\d{1,2})?|[+-]\d{2}(?::?\d{2})?)))?$') AND NOT regexp_matches(v, '^\d+\.\d+$') AS DOUBLE)), 8) AS share, avg(CAST(regexp_matches(v, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2})?)?(?:Z|(?: ?(?:[A-Z]{1,5}(?:[+-]\d{1,2})?|[+-]\d{2}(?::?\d{2})?)))?$') AND NOT regexp_matches(v, '^\d+\.\d+$') AS DOUBLE)) >= CAST(0.9 AS DOUBLE) AS is_date FROM l GROUP BY col""")
def date_detect(spark, d):
    fmt = lambda p: F.date_format("o_orderdate", p)
    bad = lambda n, p: F.when(F.col("o_orderkey") % n == 0, "bad").otherwise(fmt(p))
    rows = _t(spark, d, "orders").select(fmt("yyyy-MM-dd").alias("a"), fmt("dd/MM/yyyy").alias("b"), bad(12, "yyyy-MM-dd HH:mm").alias("c"), bad(7, "yyyy-MM-dd").alias("d"), F.col("o_totalprice").cast("string").alias("e"), F.col("o_orderstatus").alias("f"))
    found = dates.detect(rows, rows.columns)
    chosen = dates.dated(found)
    return spark.createDataFrame([(c, round(f.share, 8), c in chosen) for c, f in found.items()], "col string, share double, is_date boolean")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m FROM orders")
def date_periods(spark, d):
    rows = _t(spark, d, "orders")
    quarter = F.concat_ws(" ", F.quarter("o_orderdate"), F.lit("Q"), F.year("o_orderdate"))
    month = F.upper(F.date_format("o_orderdate", "MMM yyyy"))
    return rows.select("o_orderkey", dates.parse_period(quarter).cast("string").alias("q"), dates.parse_period(month).cast("string").alias("m"))


# --- types -----------------------------------------------------------------------------------------------------------
_INT = "CASE WHEN lo > -128 AND hi < 127 THEN 'tinyint' WHEN lo > -32768 AND hi < 32767 THEN 'smallint' WHEN lo > -2147483648 AND hi < 2147483647 THEN 'int' ELSE 'bigint' END"


def _ranges(t: str, ints: list[str], floats: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, {_INT if c in ints else chr(39) + 'float' + chr(39)} AS dtype FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {t})" for c in ints + floats)


@query(_ranges("part", ["p_partkey", "p_size"], ["p_retailprice"]) + " UNION ALL " + _ranges("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def narrow_types(spark, d):
    rows = [(t, c, k) for t in ("part", "lineitem") for c, k in narrow.TypeOptimizer(spark).discover_dtypes(_t(spark, d, t)).items()]
    return spark.createDataFrame(rows, "tab string, col string, dtype string")


@query("SELECT p_partkey, CAST(p_size AS TINYINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_size, p_retailprice FROM part)")
def narrow_cast(spark, d):
    out = narrow.TypeOptimizer(spark, usecols=["p_partkey", "p_size", "p_retailprice"]).optimize_memory_usage(_t(spark, d, "part"))
    return out.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


# --- splits ----------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, CAST(1 + floor((o_totalprice - lo) / ((hi - lo) / (least(100, n // 10) - 1))) AS INTEGER) AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders)")
def bins_totalprice(spark, d):
    o = _t(spark, d, "orders")
    n, low, high = o.agg(F.count("o_totalprice"), F.min("o_totalprice"), F.max("o_totalprice")).first()
    return o.select("o_orderkey", split.bin_column(F.col("o_totalprice"), low, high, split.estimate_nbins(n)).alias("bin"))


@query("""SELECT o_orderkey, CASE WHEN r <= round(n * CAST(0.3 AS DOUBLE)) THEN 'test' ELSE 'train' END AS side FROM
    (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""")
def stratified_split(spark, d):
    train, test = split.scsplit(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", continuous=False, key="o_orderkey")
    return train.select("o_orderkey", F.lit("train").alias("side")).unionByName(test.select("o_orderkey", F.lit("test").alias("side")))


@query()
def continuous_split(spark, d):
    train, test = split.scsplit(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", key="o_orderkey", random_state=0)
    return train.select("o_orderkey", F.lit("train").alias("side")).unionByName(test.select("o_orderkey", F.lit("test").alias("side")))


# --- imputation ------------------------------------------------------------------------------------------------------
_HOLES = "o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS b, CASE WHEN o_orderkey % 3 > 0 THEN NULL ELSE o_custkey END AS c, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'one' END AS d, o_orderstatus AS e"


def _holes(spark, d) -> DataFrame:
    return _t(spark, d, "orders").selectExpr(*_HOLES.split(", "))


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, count(*) > count({c}) AND (count(DISTINCT {c}) <= 1 OR count(*) - count({c}) > count(*) // 2) AS hopeless FROM h" for c in "abcde")


@query(f"WITH h AS (SELECT {_HOLES} FROM orders) SELECT col, nulls, CASE WHEN n_distinct <= 1000 THEN n_distinct ELSE -1 END AS n_distinct, hopeless FROM ({_PROFILE})")
def hopeless_profile(spark, d):
    p = impute.profile(_holes(spark, d).select("a", "b", "c", "d", "e"))
    return spark.createDataFrame([(c, v["nulls"], v["distinct"] if v["distinct"] <= 1000 else -1, impute.hopeless(v)) for c, v in p.items()], "col string, nulls long, n_distinct long, hopeless boolean")


@query("SELECT 'p_size' AS col, CASE WHEN n = 2 THEN 'binary' WHEN n < 30 THEN 'multiclass' ELSE 'regression' END AS objective FROM (SELECT count(DISTINCT p_size) AS n FROM part) UNION ALL SELECT 'p_brand', CASE WHEN n = 2 THEN 'binary' ELSE 'multiclass' END FROM (SELECT count(DISTINCT p_brand) AS n FROM part) UNION ALL SELECT 'p_retailprice', CASE WHEN n = 2 THEN 'binary' WHEN f > 0 OR n >= 30 THEN 'regression' ELSE 'multiclass' END FROM (SELECT count(DISTINCT p_retailprice) AS n, max(CAST(p_retailprice % 1 <> 0 AS INTEGER)) AS f FROM part)")
def objective_profile(spark, d):
    part = _t(spark, d, "part").select("p_size", "p_brand", "p_retailprice")
    p = impute.profile(part)
    return spark.createDataFrame([(c, impute.objective(part.schema[c].dataType, v["distinct"], v["fractions"])) for c, v in p.items()], "col string, objective string")


@query(f"WITH h AS (SELECT {_HOLES} FROM orders) SELECT 'a' AS col, (SELECT a FROM h WHERE a IS NOT NULL GROUP BY a ORDER BY count(*) DESC, a LIMIT 1) AS fill UNION ALL SELECT 'b', CAST(round(avg(b)) AS VARCHAR) FROM h".replace("CAST(round(avg(b)) AS VARCHAR)", "CAST(CAST(round(avg(b)) AS BIGINT) AS VARCHAR)"))
def fill_constants(spark, d):
    h = _holes(spark, d).select("a", "b")
    c = impute.constants(h, impute.profile(h))
    return spark.createDataFrame([("a", c["a"]), ("b", str(round(c["b"])))], "col string, fill string")


_CORR = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("SELECT row_number() OVER (ORDER BY v DESC, c)::INTEGER AS place, c AS col FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, abs(corr(l_extendedprice, {c})) AS v FROM lineitem" for c in _CORR) + ") ORDER BY v DESC, c LIMIT 3")
def corr_topk(spark, d):
    found = impute.correlated(_t(spark, d, "lineitem"), "l_extendedprice", list(_CORR), 3)
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(found)], "place int, col string")


@query()
def impute_model(spark, d):
    rows = _holes(spark, d).selectExpr("o_orderkey", "a", "b", "d", "e", "CAST(o_orderkey % 10 AS double) AS f")
    return impute.NaNImputer().impute(rows, key="o_orderkey")


# --- metrics ---------------------------------------------------------------------------------------------------------
_REAL = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem"


@query(f"""SELECT round(avg(abs(y - p)), 4) AS mae, round(avg(pow(y - p, 2)), 0) AS mse, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))), 6) AS rmsle,
    round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 6) AS mape, round(avg(CASE WHEN y <> 0 THEN 2 * abs(y - p) / (abs(y) + abs(p) + 1e-10) END), 6) AS smape, round(sqrt(avg(CASE WHEN y <> 0 THEN pow((y - p) / (y + 1e-10), 2) END)), 6) AS rmspe,
    round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM ({_REAL})""")
def metrics_regression(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_extendedprice AS y", "l_quantity * 1500 AS p")
    digits = {"mae": 4, "mse": 0, "rmse": 4}
    return metrics.evaluate(rows, "y", "p", metrics.REGRESSION).select(*(F.round(m, digits.get(m, 6)).alias(m) for m in metrics.REGRESSION))


_LABELLED = "SELECT CAST(quality AS DOUBLE) AS y, least(1.0, greatest(0.0, n_chars / 5000.0))::DOUBLE AS s FROM labels JOIN documents USING (doc_id)"


def _labelled(spark, d) -> DataFrame:
    both = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.selectExpr("CAST(quality AS DOUBLE) AS y", "CAST(least(1.0, greatest(0.0, n_chars / CAST(5000 AS DOUBLE))) AS DOUBLE) AS s").withColumn("p", (F.col("s") > 0.2).cast("double"))


@query(f"""WITH r AS ({_LABELLED}), x AS (SELECT y, CAST(s > CAST(0.2 AS DOUBLE) AS DOUBLE) AS p FROM r), n AS (SELECT sum(y * p) AS tp, sum(p) AS sp, sum(y) AS sy, count(*) AS n, avg(CAST(y = p AS DOUBLE)) AS accuracy FROM x)
    SELECT round(accuracy, 8) AS accuracy, round(tp / sp, 8) AS "precision", round(tp / sy, 8) AS recall, round(2 * tp / (sp + sy), 8) AS f1, round((tp / sp) / (sy / n), 8) AS lift FROM n""")
def metrics_binary(spark, d):
    names = ["accuracy", "precision", "recall", "f1", "lift"]
    return metrics.evaluate(_labelled(spark, d), "y", "p", names).select(*(F.round(n, 8).alias(n) for n in names))


@query(f"""WITH r AS ({_LABELLED}) SELECT round(a, 8) AS auc, round(2 * a - 1, 8) AS gini, round(-(SELECT avg(y * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15))) FROM r), 8) AS log_loss
    FROM (SELECT (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS a FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM r))""")
def auc_gini(spark, d):
    return metrics.evaluate(_labelled(spark, d), "y", "s", ["auc", "gini", "log_loss"]).select(*(F.round(n, 8).alias(n) for n in ("auc", "gini", "log_loss")))


_PER_CLASS = "WITH x AS (SELECT l_linenumber AS y, CAST(l_quantity / 8 AS INTEGER) + 1 AS p FROM lineitem), k AS (SELECT DISTINCT y AS k FROM x UNION SELECT DISTINCT p FROM x), e AS (SELECT k, (SELECT count(*) FROM x WHERE y = k) AS r, (SELECT count(*) FROM x WHERE p = k) AS s, (SELECT count(*) FROM x WHERE y = k AND p = k) AS h FROM k), v AS (SELECT r, CASE WHEN s > 0 THEN h / s ELSE 0 END AS pr, CASE WHEN r > 0 THEN h / r ELSE 0 END AS re, 2 * h / (r + s) AS f FROM e)"


@query(_PER_CLASS.replace("CAST(l_quantity / 8 AS INTEGER)", "CAST(floor(l_quantity / 8) AS INTEGER)") + " SELECT round(avg(CASE WHEN r > 0 THEN re END), 8) AS balanced_accuracy, " + ", ".join(f"round(sum({v} * r) / sum(r), 8) AS {m}_weighted, round(avg({v}), 8) AS {m}_macro" for m, v in (("precision", "pr"), ("recall", "re"), ("f1", "f"))) + " FROM v")
def metrics_multiclass(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_linenumber AS y", "CAST(floor(l_quantity / 8) AS INT) + 1 AS p")
    names = ["balanced_accuracy", *(f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("weighted", "macro"))]
    return metrics.evaluate(rows, "y", "p", names).select(*(F.round(n, 8).alias(n) for n in names))


# --- thresholds ------------------------------------------------------------------------------------------------------
def _sweep(n: int) -> str:
    return f"""WITH r AS ({_LABELLED}), b AS (SELECT min(s) AS lo, max(s) AS hi FROM r), g AS (SELECT range AS k, lo + range * ((hi - lo) / {n - 1}) AS t FROM range({n}), b),
        c AS (SELECT k, t, sum(CAST(s > t AS INTEGER)) AS n, sum(CASE WHEN s > t THEN y ELSE 0 END) AS tp, sum(y) AS pos, count(*) AS al FROM g CROSS JOIN r GROUP BY 1, 2),
        v AS (SELECT k, t, n / al AS fraction_of_1, (tp / pos + ((al - pos) - (n - tp)) / (al - pos)) / 2 AS score, pos / al AS rate FROM c WHERE n > 0)"""


@query(_sweep(100) + " SELECT round(t, 8) AS threshold, round(score, 8) AS score, round(fraction_of_1, 8) AS fraction_of_1 FROM v")
def threshold_sweep(spark, d):
    out = thresholds.ThreshTuner(100).fit(_labelled(spark, d), "y", "s")
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


@query(_sweep(100) + " SELECT * FROM (SELECT 'ratio' AS kind, round(t, 8) AS threshold, round(fraction_of_1, 8) AS fraction_of_1 FROM v ORDER BY abs(fraction_of_1 - rate), t LIMIT 1) UNION ALL SELECT 'score', round(t, 8), round(fraction_of_1, 8) FROM v WHERE score = (SELECT max(score) FROM v)")
def threshold_best(spark, d):
    tuner_ = thresholds.ThreshTuner(100)
    tuner_.fit(_labelled(spark, d), "y", "s")
    both = tuner_.best_predict_ratio().withColumn("kind", F.lit("ratio")).unionByName(tuner_.best_score().withColumn("kind", F.lit("score")))
    return both.select("kind", F.round("threshold", 8).alias("threshold"), F.round("fraction_of_1", 8).alias("fraction_of_1"))


# --- selection, tuning, stacking -------------------------------------------------------------------------------------
@query("SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 8) AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 8) AS p_retailprice FROM part")
def scale_standard(spark, d):
    out = select.standardized(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("p_size", 8).alias("p_size"), F.round("p_retailprice", 8).alias("p_retailprice"))


def _priced(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.count(F.lit(1)).alias("lines"), F.max("l_linenumber").alias("last"))
    return li.withColumn("noise", hash_fold("l_orderkey", 97, 3).cast("double"))


@query()
def feature_rfe(spark, d):
    s = select.FeatureSelector("regression", min_features_to_select=3, step=2)
    s.fit_transform(_priced(spark, d), "price", "l_orderkey")
    return spark.createDataFrame([(f,) for f in s.selected_features], "feature string")


@query()
def tune_params(spark, d):
    t = tuner.BoostingTuner("rmse", trials=2, max_iterations=3, verbosity=0, custom_lgbm_params={"max_depth": 3})
    t.fit(_priced(spark, d), "price", "l_orderkey")
    return t.predict(_priced(spark, d)).select("l_orderkey", "prediction")


@query("SELECT * FROM (VALUES (5000, 'rmse', 0.01::DOUBLE, 3000, 200, 16), (10000, 'auc', 0.01, 3000, 200, 32), (20000, 'rmse', 0.02, 3000, 200, 32), (50000, 'auc', 0.03, 1200, 200, 32), (100000, 'rmse', 0.03, 1200, 200, 32), (300000, 'auc', 0.04, 2000, 100, 128), (300001, 'auc', 0.05, 2000, 100, 244)) t(n, metric, rate, trees, stop, leaves)")
def init_params_table(spark, d):
    rows = []
    for n, m in ((5000, "rmse"), (10000, "auc"), (20000, "rmse"), (50000, "auc"), (100000, "rmse"), (300000, "auc"), (300001, "auc")):
        p = tuner.init_params(n, m, 2)
        rows.append((n, m, p["learning_rate"], p["num_iterations"], p["early_stopping_rounds"], p["num_leaves"]))
    return spark.createDataFrame(rows, "n int, metric string, rate double, trees int, stop int, leaves int")


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS square FROM lineitem")
def parallel_square(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return parallel.Multicore(spark=spark).execute(lambda p: p.assign(square=p.l_quantity**2).drop(columns="l_quantity"), rows, schema="l_orderkey long, l_linenumber int, square double")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - l_discount, 6) AS a_minus_b, round(l_quantity - l_tax, 6) AS a_minus_c, round(l_discount - l_tax, 6) AS b_minus_c, round(sqrt((pow(l_quantity - m, 2) + pow(l_discount - m, 2) + pow(l_tax - m, 2)) / 2), 6) AS row_std, round(m, 6) AS row_mean FROM (SELECT *, (l_quantity + l_discount + l_tax) / 3 AS m FROM lineitem)")
def stack_metafeats(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS a", "l_discount AS b", "l_tax AS c")
    out = stack.meta_features(rows, ["a", "b", "c"])
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("a_minus_b", "a_minus_c", "b_minus_c", "row_std", "row_mean")))


@query()
def stack_layers(spark, d):
    s = stack.Stacker("regression")
    return s.fit_transform(_priced(spark, d), "price", "l_orderkey")
