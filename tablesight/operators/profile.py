"""Profiling and quality aggregates.

Every statistic over many columns is one ``agg`` (one scan, partial
aggregation on the map side), then turned long with ``unpivot`` / ``stack`` on
the one-row result.
"""

from __future__ import annotations

import functools
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.functions.scalars import nan_to_null
from tablesight.operators.gram import block_correlations
from tablesight.operators.quantiles import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


# Column names that mark time columns (name test), and the task
# engine's variant, which also knows created_at.
TS_NAME_RE = re.compile(r"(^|_)(ts|time|timestamp|date|datetime|dt)($|_)", re.I)
TS_NAME_RE_WIDE = re.compile(r"(^|_)(ts|time|timestamp|date|datetime|dt|created_at)($|_)", re.I)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Number / categorical (string, like pandas object) / datetime columns."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if kind == "numeric" and isinstance(t, NUMERIC):
            out.append(f.name)
        elif kind == "categorical" and isinstance(t, T.StringType):
            out.append(f.name)
        elif kind == "datetime" and isinstance(t, TIMES):
            out.append(f.name)
    return out


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _missing(c: str, dtype: T.DataType):
    col = F.col(_q(c))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def shape(df: DataFrame) -> DataFrame:
    """A1: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def type_counts(df: DataFrame) -> DataFrame:
    """Numeric / categorical / datetime column counts (schema only)."""
    spark = df.sparkSession
    return spark.createDataFrame(
        [(len(columns_of_type(df, "numeric")), len(columns_of_type(df, "categorical")),
          len(columns_of_type(df, "datetime")))],
        "numeric_columns int, categorical_columns int, datetime_columns int")


def missing_rate(df: DataFrame, top: int | None = None) -> DataFrame:
    """A2: NULL (and NaN) fraction per column, descending, optional top-k.
    One aggregate over all columns, unpivoted on the one-row result."""
    aggs = [F.avg(_missing(f.name, f.dataType).cast("double")).alias(f"m{i}")
            for i, f in enumerate(df.schema.fields)]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{f.name.replace(chr(39), chr(39) * 2)}', m{i}"
                      for i, f in enumerate(df.schema.fields))
    long = one.selectExpr(f"stack({len(df.columns)}, {stack}) as (column, missing_rate)")
    if top is not None:
        # column position breaks ties in a stable way
        pos = {f.name: i for i, f in enumerate(df.schema.fields)}
        order_map = F.create_map(*[x for n, i in pos.items() for x in (F.lit(n), F.lit(i))])
        long = (long.withColumn("_pos", order_map[F.col("column")])
                    .orderBy(F.desc("missing_rate"), "_pos").limit(top).drop("_pos"))
    return long


def missing_overall(df: DataFrame) -> DataFrame:
    """A3: mean of the per-column missing rates."""
    return missing_rate(df).agg(F.avg("missing_rate").alias("missing_fraction_overall"))


def describe_numeric(df: DataFrame, columns: list[str] | None = None,
                     exact: bool = True) -> DataFrame:
    """A4: count, mean, std (n-1), min, 25/50/75 % (linear), max per numeric
    column.  Quantiles are exact by default (see ``quantiles``), or
    ``approx_percentile`` with ``exact=False``."""
    cols = columns if columns is not None else columns_of_type(df, "numeric")
    if not cols:
        return df.sparkSession.createDataFrame([], _DESCRIBE_SCHEMA)
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(F.col(_q(c)).cast("double"))
        aggs += [F.count(v).alias(f"cnt{i}"), F.avg(v).alias(f"mean{i}"),
                 F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
                 F.max(v).alias(f"max{i}")]
    spark = df.sparkSession
    if exact:
        # moments ride along in the quantiles' first pass: one scan fewer
        num = df.select([nan_to_null(F.col(_q(c)).cast("double")).alias(c) for c in cols])
        qs = exact_quantiles(num, cols, [0.25, 0.5, 0.75],
                             extra=[a for a in aggs])
        row = qs["extra"]
        rows = [(c, row[f"cnt{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"],
                 qs[(c, 0.25)], qs[(c, 0.5)], qs[(c, 0.75)], row[f"max{i}"]) for i, c in enumerate(cols)]
        return spark.createDataFrame(rows, _DESCRIBE_SCHEMA)
    for i, c in enumerate(cols):
        v = nan_to_null(F.col(_q(c)).cast("double"))
        aggs.append(F.approx_percentile(v, F.array(F.lit(.25), F.lit(.5), F.lit(.75))).alias(f"q{i}"))
    one = df.agg(*aggs)
    return _long(one, [F.struct(
        F.lit(c).alias("column"), F.col(f"cnt{i}").cast("long").alias("count"),
        F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
        F.col(f"min{i}").alias("min"), F.col(f"q{i}")[0].alias("p25"),
        F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"),
        F.col(f"max{i}").alias("max")) for i, c in enumerate(cols)])


def _long(one: DataFrame, rows: list) -> DataFrame:
    """One-row aggregate -> one row per struct, in a single projection (a
    union of per-column selects would let column pruning split the
    aggregate into one scan per column)."""
    return one.select(F.explode(F.array(*rows)).alias("_x")).select("_x.*")


_DESCRIBE_SCHEMA = ("column string, count long, mean double, std double, min double, "
                    "p25 double, p50 double, p75 double, max double")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10,
               max_columns: int | None = None) -> DataFrame:
    """A5: the k most frequent values per categorical column, as strings, with
    NULL counted as its own value.  One unpivot and one grouped count for all
    columns (partial aggregation absorbs a hot value)."""
    cols = columns if columns is not None else columns_of_type(df, "categorical")
    if max_columns is not None:
        cols = cols[:max_columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count long")
    stack = ", ".join(f"'{c}', cast({_q(c)} as string)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {stack}) as (column, value)")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def datetime_range(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Min, max and non-NULL count per datetime column."""
    cols = columns if columns is not None else columns_of_type(df, "datetime")
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, min timestamp, max timestamp, count long")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(_q(c)).alias(f"a{i}"), F.max(_q(c)).alias(f"b{i}"), F.count(_q(c)).alias(f"n{i}")]
    one = df.agg(*aggs)
    return _long(one, [F.struct(F.lit(c).alias("column"), F.col(f"a{i}").cast("timestamp_ntz").alias("min"),
                                F.col(f"b{i}").cast("timestamp_ntz").alias("max"),
                                F.col(f"n{i}").alias("count")) for i, c in enumerate(cols)])


def row_hashes(df: DataFrame) -> list:
    """Three independent 64-bit hashes of a whole row (NULLs told apart from
    missing parts by a flag per column)."""
    parts = []
    for f in df.schema.fields:
        c = F.col(_q(f.name))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)   # -0.0 equals 0.0
        parts += [F.to_json(c) if isinstance(f.dataType, T.MapType) else c, c.isNull()]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2, 3)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (NULLs equal), i.e. rows minus distinct
    rows.  Rows are counted by 128 bits of hash, not by their columns; a third
    hash that differs inside a group would show a collision, and the query
    raises rather than miscount.  Map-side combine keeps a heavily repeated row
    from landing whole in one task."""
    a, b, check = (h.alias(n) for h, n in zip(row_hashes(df), ("a", "b", "c")))
    g = df.select(a, b, check).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    extra = F.when(F.col("lo") == F.col("hi"), F.col("n") - 1).otherwise(
        F.raise_error(F.lit("row hash collision")).cast("long"))
    return g.agg(F.coalesce(F.sum(extra), F.lit(0)).cast("long").alias("duplicate_rows"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Distinct values per column without and with NULL.

    Exact counts unpivot the rows to (column, hash, value) and group twice, so
    the first group's partial aggregation, not an expanded copy of each row, is
    what is shuffled."""
    cols = columns if columns is not None else df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}

    if approx:
        one = df.agg(*[x for i, c in enumerate(cols) for x in (
            F.approx_count_distinct(_q(c)).alias(f"d{i}"), F.max(F.col(_q(c)).isNull().cast("int")).alias(f"z{i}"))])
        return _long(one, [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").cast("long").alias("distinct"),
                                    (F.col(f"d{i}") + F.coalesce(F.col(f"z{i}"), F.lit(0))).cast("long")
                                    .alias("distinct_with_null")) for i, c in enumerate(cols)])
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _as_text(F.col(_q(c)), fields[c]).alias("v"))
                                         for i, c in enumerate(cols)])).alias("x")).select("x.i", "x.v")
    per = (long.groupBy("i", "v").agg(F.lit(1).alias("one"))
           .groupBy("i").agg(F.count("v").alias("distinct"), F.sum("one").alias("distinct_with_null")))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, column string")
    none = F.lit(0).cast("long")
    return (names.join(per, "i", "left").select(
        "column", F.coalesce("distinct", none).alias("distinct"),
        F.coalesce("distinct_with_null", none).alias("distinct_with_null")))


def capped_distinct(df: DataFrame, columns: list[str], limit: int) -> dict[str, int]:
    """Distinct non-NULL values per column, exact up to ``limit`` and
    ``limit + 1`` for any more.

    A task keeps a set per column that stops growing beyond the limit, so no more
    than ``limit + 1`` values of a column leave a task, whatever the column holds;
    the sets are united by one grouped count."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    source = df.select(*[_as_text(F.col(_q(c)), fields[c]).alias(f"v{i}") for i, c in enumerate(columns)])

    def run(batches):
        seen: list[set] = [set() for _ in columns]
        for batch in batches:
            for i, held in enumerate(seen):
                if len(held) <= limit:
                    held.update(pa.compute.unique(batch.column(i)).drop_null().to_pylist())
        for i, held in enumerate(seen):
            kept = list(itertools.islice(held, limit + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(kept), pa.int32()), pa.array(kept, pa.string())], names=["i", "v"])

    values = source.mapInArrow(run, "i int, v string").distinct()
    counts = dict(values.groupBy("i").count().collect())   # one row a column
    return {c: min(counts.get(i, 0), limit + 1) for i, c in enumerate(columns)}


def _as_text(x, dtype: T.DataType):
    """A value as text that tells values apart."""
    if isinstance(dtype, T.BinaryType):
        return F.hex(x)
    return F.to_json(x) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else x.cast("string")


def _comparable(f: T.StructField):
    """A column as something min and max can order."""
    c = F.col(_q(f.name))
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    return F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c


def _is_constant(i: int):
    """All NULL, or no NULL and min = max, over the aggregates n, a, b of column i."""
    return (F.col(f"n{i}") == 0) | ((F.col(f"n{i}") == F.col("rows")) & (F.col(f"a{i}") == F.col(f"b{i}")))


def _extremes(fields: list[T.StructField]) -> list:
    return [x for i, f in enumerate(fields) for x in (
        F.count(_comparable(f)).alias(f"n{i}"), F.min(_comparable(f)).alias(f"a{i}"), F.max(_comparable(f)).alias(f"b{i}"))]


def constant_columns(df: DataFrame) -> list[str]:
    """A9 / P3 decision: a column is constant when it has at most one distinct
    value counting NULL.  One aggregate, no distinct."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("rows"), *_extremes(fields))
    row = one.select(*[F.coalesce(_is_constant(i), F.lit(False)) for i in range(len(fields))]).first()
    return [f.name for f, constant in zip(fields, row) if constant]


def overview(df: DataFrame) -> DataFrame:
    """A1, A3 and the number of A9 together, from one aggregate."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("rows"), *_extremes(fields),
                 *[F.avg(_missing(f.name, f.dataType).cast("double")).alias(f"m{i}") for i, f in enumerate(fields)])
    total = lambda parts: functools.reduce(lambda a, b: a + b, parts, F.lit(0))
    return one.select(
        "rows", F.lit(len(fields)).alias("cols"),
        (total([F.col(f"m{i}") for i in range(len(fields))]) / max(1, len(fields))).alias("missing_fraction_overall"),
        total([F.coalesce(_is_constant(i), F.lit(False)).cast("int") for i in range(len(fields))]).alias("constant_columns"))


def constant_columns_df(df: DataFrame) -> DataFrame:
    names = constant_columns(df)
    return df.sparkSession.createDataFrame([(n,) for n in names], "column string")


#: Pairs whose moments are columns of one aggregate; wider tables add up blocks of
#: all pairs' moments in Arrow batches (``gram``).  Both scan the table once.
WIDE_PAIRS = 512


def correlation_pairs(df: DataFrame, columns: list[str] | None = None,
                      with_self: bool = False) -> DataFrame:
    """A10: pairwise-complete Pearson correlation for each pair i < j, long
    form (col_a, col_b, corr), in one pass.  ``corr`` raises on a constant
    column under ANSI, so it is covar_pop / (stddev_pop * stddev_pop) over the
    complete pairs with ``try_divide``: a constant column gives NULL."""
    cols = columns if columns is not None else columns_of_type(df, "numeric")
    pairs = [(a, b) for a in range(len(cols)) for b in range(a + (not with_self), len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    numbers = [nan_to_null(F.col(_q(c)).cast("double")) for c in cols]

    def correlation(x, y):
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("corr")

    if len(pairs) <= WIDE_PAIRS:
        num = df.select(*[v.alias(f"v{i}") for i, v in enumerate(numbers)])
        one = num.agg(*[correlation(F.col(f"v{a}"), F.col(f"v{b}")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
        return _long(one, [F.struct(F.lit(cols[a]).alias("col_a"), F.lit(cols[b]).alias("col_b"),
                                    F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    return block_correlations(numbers, df, cols, with_self)


def top_correlations(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Strongest absolute correlations, unique pairs."""
    c = correlation_pairs(df, columns)
    return (c.filter(F.col("corr").isNotNull())
             .select("col_a", "col_b", F.abs("corr").alias("abs_corr"))
             .orderBy(F.desc("abs_corr"), "col_a", "col_b").limit(k))


def skewness_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A12 helper: adjusted sample skewness per numeric column (pandas'
    ``skew``), NULL with fewer than 3 values."""
    cols = columns if columns is not None else columns_of_type(df, "numeric")
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, skew double")
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(F.col(_q(c)).cast("double"))
        aggs += [F.skewness(v).alias(f"s{i}"), F.count(v).alias(f"n{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}").cast("double")
        adj = F.when(n >= 3, F.col(f"s{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        rows.append(F.struct(F.lit(c).alias("column"), adj.cast("double").alias("skew")))
    return _long(one, rows)


def top_skewed(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """The k columns with the largest absolute skew."""
    s = skewness_table(df, columns).filter(F.col("skew").isNotNull() & ~F.isnan("skew"))
    return s.orderBy(F.desc(F.abs("skew")), "column").limit(k)


def quality_checks(df: DataFrame) -> DataFrame:
    """Warnings (code, column, detail).  Fewer than 10 rows; duplicate
    column names; columns more than 95 % NULL; a single column with a comma in
    more than 5 % of its rows, and in more than 5 (wrong delimiter); error when
    there are no rows."""
    spark = df.sparkSession
    rows = df.count()
    out = []
    if rows == 0:
        out.append(("empty_table", None, "table has no rows"))
    if 0 < rows < 10:
        out.append(("few_rows", None, f"only {rows} rows"))
    seen, dups = set(), []
    for c in df.columns:
        if c in seen and c not in dups:
            dups.append(c)
        seen.add(c)
    for c in dups:
        out.append(("duplicate_column", c, "column name appears more than once"))
    if rows:
        mr = missing_rate(df).filter(F.col("missing_rate") > 0.95).collect()
        order = {c: i for i, c in enumerate(df.columns)}
        for r in sorted(mr, key=lambda r: order[r["column"]]):
            out.append(("mostly_null", r["column"], f"{r['missing_rate']:.3f} missing"))
    if len(df.columns) == 1 and rows:
        c = df.columns[0]
        commas = df.agg(F.count_if(F.col(_q(c)).cast("string").contains(","))).first()[0]
        if commas > max(5, 0.05 * rows):
            out.append(("possible_wrong_delimiter", c, f"{commas} of {rows} rows hold a comma"))
    return spark.createDataFrame(out, "code string, column string, detail string")


# Name fragments of vital-sign columns.
VITAL_KEYS = ["bp", "blood_pressure", "systolic", "diastolic", "hr", "heart_rate", "spo2", "weight"]


def vitals_summary(df: DataFrame) -> DataFrame:
    """Describe the columns whose lower-cased name holds a vital key."""
    cols = [c for c in df.columns if any(k in c.lower() for k in VITAL_KEYS)]
    return describe_numeric(df, cols)


def missing_bars(df: DataFrame, k: int = 30) -> DataFrame:
    """Columns with a missing rate above 0, top k."""
    return missing_rate(df, top=None).filter(F.col("missing_rate") > 0) \
        .orderBy(F.desc("missing_rate"), "column").limit(k)

