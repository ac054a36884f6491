"""Detection of date columns in text, and features of dates: two aggregations to fit, a projection to apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import require_columns, require_frame, type_of

# What a date looks like, optional time and zone included, and what merely looks like one.
DATE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2})?)?(?:Z|(?: ?(?:[A-Z]{1,5}(?:[+-]\d{1,2})?|[+-]\d{2}(?::?\d{2})?)))?$"
DECIMAL = r"^\d+\.\d+$"
FEATURES = ("year", "month", "day", "hour", "minute", "second", "weekday", "quarter", "week", "part_of_day")
#: Orders of the date's parts, best first on ties. Years have two digits or four.
ORDERS = ("ymd", "mdy", "dmy")


def matches(c: Column) -> Column:
    return c.rlike(DATE) & ~c.rlike(DECIMAL)


# Fixed value: a DATE whose parts can be read, which has a zone only after a time and no line end; a zone is dropped, not applied.
PARTS = r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:Z|(?: ?(?:[A-Z]{1,5}(?:[+-]\d{1,2})?|[+-]\d{2}(?::?\d{2})?)))?)?\z"


def parts(c: Column) -> Column:
    """The six parts of a date text, in their order there, those of the time after a 0; null where it is none. One match for all orders."""
    return F.when(c.rlike(PARTS), F.split(F.regexp_replace(c, PARTS, "$1-$2-$3-0$4-0$5-0$6"), "-", -1))


def numbers(p: Column) -> list[Column]:
    """The six parts as numbers, and how many digits the first and the third have."""
    return [*(p[k].cast("int") for k in range(6)), F.length(p[0]), F.length(p[2])]


def timed(n: list[Column], order: str) -> Column:
    """numbers(), read in that order, as wall-clock time; null where there is no such date. They are tested before a date is
    made of them: a parser that fails raises an error for each value, which costs far more than reading it."""
    year, month, day = (n[order.index(x)] for x in "ymd")
    at = order.index("y")
    digits, other = (n[6], n[7]) if at == 0 else (n[7], n[6])
    year = F.when(digits == 2, year + 2000).otherwise(year)
    hour, minute, second = n[3:6]
    short = (month == 2) & (day > 28) & ~((day == 29) & (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)))
    good = digits.isin(2, 4) & (other <= 2) & month.between(1, 12) & day.between(1, 31) & ~(month.isin(4, 6, 9, 11) & (day == 31)) & ~short & (hour <= 23) & (minute <= 59) & (second <= 59)
    return F.when(good, F.make_timestamp_ntz(year, month, day, hour, minute, second))


def parsed(c: Column, order: str) -> Column:
    """A date text as wall-clock time, null where it is none."""
    # The lambda binds the parts, which would else be found again for each use.
    return F.element_at(F.transform(F.array(parts(c)), lambda p: timed(numbers(p), order)), 1)


def part_of_day(hour: Column, strict: bool = False) -> Column:
    """Morning 1 (6-11), day 2 (12-17), evening 3 (18-22), night 4; strict leaves night null."""
    out = F.when(hour.between(6, 11), 1).when(hour.between(12, 17), 2).when(hour.between(18, 22), 3)
    return out if strict else out.when(hour.isNotNull(), 4)


def feature(c: Column, name: str, strict: bool = False) -> Column:
    return {
        "year": lambda: F.year(c), "month": lambda: F.month(c), "day": lambda: F.dayofmonth(c), "hour": lambda: F.hour(c), "minute": lambda: F.minute(c), "second": lambda: F.second(c).cast("int"),
        "weekday": lambda: F.weekday(c), "quarter": lambda: F.quarter(c), "week": lambda: F.weekofyear(c), "part_of_day": lambda: part_of_day(F.hour(c), strict),
        "dayofyear": lambda: F.dayofyear(c), "days_from_epoch": lambda: F.datediff(c, F.lit("1970-01-01").cast("date")),
    }[name]()


def is_any_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.TimestampType | T.TimestampNTZType | T.DateType)


def col_contains_dates(df: DataFrame, name: str, error_tolerance: float = 0.1) -> bool:
    return detect(df, [name], error_tolerance)[name].share >= 1 - error_tolerance if df.select(name).filter(F.col(name).isNotNull()).limit(1).count() else False


def is_year_four_digits(df: DataFrame, name: str) -> bool:
    """Whether every known value holds four digits in a row."""
    return bool(df.agg(F.min(F.col(name).rlike(r"\d{4}"))).first()[0])


@dataclass
class Found:
    known: int
    share: float
    order: str
    distinct: bool


def detect(df: DataFrame, names: list[str], error_tolerance: float = 0.1) -> dict[str, Found]:
    """For each text column how much of it looks like dates, the order of parts that reads most values, and whether it holds
    more than one date. One pass for all columns."""
    if not names:
        return {}
    # A row for each value, so that the code that reads it is made once and not for every column: Java doesn't compile long
    # methods. What several expressions use has a projection of its own.
    values = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{n}`").alias("v")) for k, n in enumerate(names)))).alias("x")).select("x.k", "x.v").filter("v is not null")
    staged = values.select("k", matches(F.col("v")).cast("int").alias("y"), parts(F.col("v")).alias("p"))
    staged = staged.select("k", "y", *(c.alias(f"n{j}") for j, c in enumerate(numbers(F.col("p")))))
    read = staged.select("k", "y", *(timed([F.col(f"n{j}") for j in range(8)], o).alias(o) for o in ORDERS))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("m"), *(F.count(o).alias(o) for o in ORDERS), *((F.min(o) != F.max(o)).alias(f"{o}_differ") for o in ORDERS)]
    rows = {r.k: r for r in read.groupBy("k").agg(*aggs).collect()}
    out = {}
    for k, n in enumerate(names):
        row = rows.get(k)
        best = max(ORDERS, key=lambda o: row[o] if row else 0)
        out[n] = Found(row.n, row.m / row.n, best, bool(row[f"{best}_differ"])) if row else Found(0, 0.0, best, False)
    return out


def dated(found: dict[str, Found], error_tolerance: float = 0.1) -> list[str]:
    """The columns that what detect() found makes dates."""
    return [n for n, f in found.items() if f.known and f.share >= 1 - error_tolerance and f.distinct]


def find_datetime_cols(df: DataFrame, error_tolerance: float = 0.1) -> list[str]:
    return dated(detect(df, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)], error_tolerance), error_tolerance)


def infer_dayfirst(df: DataFrame, name: str) -> bool:
    return detect(df, [name])[name].order == "dmy"


class DateParser:
    """Finds date columns, keeps the features that vary, and replaces the columns by them, named `{column}_{feature}`.

    transform() makes the same columns from any frame. include_timestamps takes real timestamp columns too. extra adds
    dayofyear and days_from_epoch, payday a flag for the listed days of a month, and holidays a table of dates to join.
    """

    def __init__(self, include_timestamps: bool = False, strict: bool = False, extra: bool = False, payday: tuple[int, ...] = (), holidays: DataFrame | None = None):
        self.include, self.strict, self.payday, self.holidays = include_timestamps, strict, payday, holidays
        self.names = [*FEATURES, *(("dayofyear", "days_from_epoch") if extra else ())]
        self.kept: dict[str, list[str]] | None = None

    def _value(self, name: str) -> Column:
        return F.col(f"`{name}`").cast("timestamp_ntz") if self.orders[name] == "" else parsed(F.col(f"`{name}`"), self.orders[name])

    def fit(self, df: DataFrame, error_tolerance: float = 0.1) -> DateParser:
        require_frame(df)
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        found = detect(df, texts, error_tolerance)
        self.orders = {n: found[n].order for n in dated(found, error_tolerance)}
        if self.include:
            self.orders |= {n: "" for n in df.columns if is_any_datetime(df, n)}
        self.kept = self._varying(df, list(self.orders))
        return self

    def _varying(self, df: DataFrame, names: list[str]) -> dict[str, list[str]]:
        """Features with more than one value, for all columns in one pass: least and greatest differ."""
        if not names:
            return {}
        values = df.select(*(self._value(n).alias(f"v{k}") for k, n in enumerate(names)))
        row = values.agg(*((F.min(v) != F.max(v)).alias(f"{k}_{f}") for k in range(len(names)) for f in self.names for v in [feature(F.col(f"v{k}"), f, self.strict)])).first()
        out = {}
        for k, n in enumerate(names):
            out[n] = [f for f in self.names if row[f"{k}_{f}"] and (f != "part_of_day" or row[f"{k}_hour"])]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kept is None:
            raise ValueError("fit() comes first")
        require_frame(df)
        require_columns(df, *self.kept)
        rest = [c for c in df.columns if c not in self.kept]
        # Values are read once; features and the rest refer to them.
        staged = df.select(*(F.col(f"`{c}`") for c in rest), *(self._value(n).alias(f"__v_{n}") for n in self.kept))
        made = []
        for n, fs in self.kept.items():
            v = F.col(f"`__v_{n}`")
            made += [feature(v, f, self.strict).alias(f"{n}_{f}") for f in fs]
            if self.payday:
                made.append(F.dayofmonth(v).isin(*self.payday).cast("int").alias(f"{n}_is_payday"))
        if len(self.kept) == 2 and "days_from_epoch" in self.names:
            a, b = (F.col(f"`__v_{n}`") for n in self.kept)
            made.append(F.datediff(b, a).alias("timediff"))
        dated = [F.col(f"`__v_{n}`").cast("date").alias(f"__{n}_date") for n in self.kept] if self.holidays is not None else []
        out = staged.select(*(F.col(f"`{c}`") for c in rest), *made, *dated)
        if self.holidays is not None:
            # Left joins with distinct dates add no rows; Spark broadcasts a calendar, which is small, by its own size check.
            for n in self.kept:
                days = self.holidays.select(F.col(self.holidays.columns[0]).cast("date").alias(f"__{n}_date")).distinct().withColumn(f"{n}_is_holiday", F.lit(1))
                out = out.join(days, f"__{n}_date", "left").withColumn(f"{n}_is_holiday", F.coalesce(f"{n}_is_holiday", F.lit(0))).drop(f"__{n}_date")
        return out

    def fit_transform(self, df: DataFrame, error_tolerance: float = 0.1) -> DataFrame:
        """The frame with its dates as features; the frame as it is, with a message, where Spark can't read its columns so."""
        require_frame(df)
        try:
            return self.fit(df, error_tolerance).transform(df)
        except PySparkException as e:
            print(f"dates can't be parsed, nothing is changed: {e}")
            self.kept = None
            return df

    def extract_date_features(self, df: DataFrame, name: str) -> DataFrame:
        """The varying features of one column, in its place at the end of the frame."""
        require_columns(df, name)
        self.orders = {name: "" if is_any_datetime(df, name) else detect(df, [name])[name].order}
        self.kept = self._varying(df, [name])
        return self.transform(df)


_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def parse_period(c: Column) -> Column:
    """The first day of "1 Q 1990", "12 WK 1990" or "JAN 1990" (a month alone: of 1900); null for anything else."""
    text = F.upper(F.trim(c))
    quarter, week = r"^([1-4])\s*Q\s*(\d{4})$", r"^(\d{1,2})\s*WK\s*(\d{4})$"
    month = rf"^({'|'.join(_MONTHS)})[A-Z]*\s*(\d{{4}})?$"
    number = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).cast("int")
    of = F.element_at(F.create_map(*[F.lit(x) for k, m in enumerate(_MONTHS, 1) for x in (m, k)]), F.regexp_extract(text, month, 1))
    return (
        F.when(text.rlike(quarter), F.make_date(number(quarter, 2), (number(quarter, 1) - 1) * 3 + 1, F.lit(1)))
        .when(text.rlike(week) & number(week, 1).between(1, 53), F.date_add(F.trunc(F.make_date(number(week, 2), F.lit(1), F.lit(4)), "week"), (number(week, 1) - 1) * 7))
        .when(text.rlike(month), F.make_date(F.coalesce(number(month, 2), F.lit(1900)), of, F.lit(1)))
    )
