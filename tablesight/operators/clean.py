"""Column cleaning (P1-P18) and the cleaning pass Q15.

Decisions about *which* columns to touch come from one-row aggregates; the
row work itself is a single projection, so cleaning is one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.functions.naming import NORMALIZED, SANITIZED, clean_names
from tablesight.functions.scalars import (EPOCH_NANOS, LAST_NANOSECOND, day_month_votes, epoch_to_ts,
                                          nan_to_null, number_of, parse_ts)
from tablesight.operators.profile import (NUMERIC, TS_NAME_RE, _q, capped_distinct, columns_of_type,
                                          constant_columns)
from tablesight.operators.quantiles import exact_quantiles



def normalize_columns(df: DataFrame) -> DataFrame:
    """Normalised, de-duplicated names (``a``, ``a__2``)."""
    return df.toDF(*clean_names(df.columns, NORMALIZED))


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Sanitised, de-duplicated names."""
    return df.toDF(*clean_names(df.columns, SANITIZED))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop columns with at most one distinct value counting NULL."""
    const = constant_columns(df)
    return df.drop(*const) if const else df


def _median_fill_values(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    med = exact_quantiles(df.select([nan_to_null(F.col(_q(c)).cast("double")).alias(c) for c in cols]),
                          cols, [0.5])
    return {c: med[(c, 0.5)] for c in cols}


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P4 + P5 (net behaviour of the reference): in every numeric column NaN,
    NULL, +inf and -inf become the column median taken over its non-missing
    values (infinities included, as pandas does).  Integer columns that had
    NULLs become double; others keep their type."""
    cols = columns if columns is not None else columns_of_type(df, "numeric")
    if not cols:
        return df
    fields = {f.name: f.dataType for f in df.schema.fields}
    stats = df.agg(*[F.count_if(F.col(_q(c)).isNull()
                                | (F.isnan(F.col(_q(c))) if isinstance(fields[c], (T.FloatType, T.DoubleType))
                                   else F.lit(False))
                                | (F.abs(F.col(_q(c))) == float("inf")
                                   if isinstance(fields[c], (T.FloatType, T.DoubleType)) else F.lit(False)))
                       .alias(f"m{i}") for i, c in enumerate(cols)]).first()
    todo = [c for i, c in enumerate(cols) if stats[f"m{i}"] > 0]
    if not todo:
        return df
    med = _median_fill_values(df, todo)
    out = []
    for c in df.columns:
        if c in todo:
            v = F.col(_q(c)).cast("double")
            bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
            out.append(F.when(bad, F.lit(med[c]).cast("double")).otherwise(v).alias(c))
        else:
            out.append(F.col(_q(c)))
    return df.select(*out)


def replace_infinite(df: DataFrame) -> DataFrame:
    """P5: +-inf -> NULL -> median (same pass as :func:`impute_median`)."""
    return impute_median(df)


def fill_categorical(df: DataFrame, value: str = "missing") -> DataFrame:
    """NULL in string columns -> 'missing'."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna(value, subset=cols) if cols else df


def clean_table(df: DataFrame) -> DataFrame:
    """Q15: normalise names -> drop constant columns -> median / 'missing'
    fill."""
    d = normalize_columns(df)
    d = drop_constant_columns(d)
    d = impute_median(d)
    return fill_categorical(d)


def model_frame(df: DataFrame, types: dict[str, list[str]], max_missing: float = 0.5,
                max_columns: int | None = None) -> DataFrame:
    """Numeric columns that are not id / datetime / text, at least
    (1 - max_missing) present, with more than one distinct value; the first
    ``max_columns`` where a number is given.  One aggregate decides."""
    excl = set(types.get("id", [])) | set(types.get("datetime", [])) | set(types.get("text", []))
    cand = [c for c in types.get("numeric", []) if c not in excl and c in df.columns]
    if not cand:
        return df.select()
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cand):
        v = nan_to_null(F.col(_q(c)).cast("double"))
        aggs += [F.count(v).alias(f"c{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    keep = []
    for i, c in enumerate(cand):
        present = r[f"c{i}"] / max(1, r["_n"])
        if present >= 1 - max_missing and r[f"c{i}"] > 0 and r[f"a{i}"] != r[f"b{i}"]:
            keep.append(c)
    return df.select(*[F.col(_q(c)) for c in keep[:max_columns]])


def parse_datetimes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """String columns whose name looks like time and that parse at least
    once become timestamps (bad values NULL).  One aggregate decides for all
    columns, and takes a vote in each on whether its numeric dates are day-first:
    they are where more values can only be read so than can only be read
    month-first.  A value that the vote makes impossible is read the other way."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cand = columns if columns is not None else [c for c in strs if TS_NAME_RE.search(c)]
    if not cand:
        return df
    aggs = []
    for i, c in enumerate(cand):
        day, month = day_month_votes(_q(c))
        aggs += [F.count(parse_ts(_q(c))).alias(f"p{i}"), F.count_if(day).alias(f"d{i}"), F.count_if(month).alias(f"m{i}")]
    r = df.agg(*aggs).first()
    conv = {c: r[f"d{i}"] > r[f"m{i}"] for i, c in enumerate(cand) if r[f"p{i}"] > 0}
    return df.select(*[parse_ts(_q(c), day_first=conv[c]).alias(c) if c in conv else F.col(_q(c)) for c in df.columns])


def epoch_unit(vmin: float | None, vmax: float | None, fine: bool = False) -> str | None:
    """Epoch scale rule: s when min > 1e9 and max < 1e11; ms when min > 1e12
    (and max < 1e15 with ``fine``); us / ns only with ``fine``."""
    if vmin is None or vmax is None:
        return None
    if vmin > 1e9 and vmax < 1e11:
        return "s"
    if fine:
        if vmin > 1e12 and vmax < 1e15:
            return "ms"
        if vmin > 1e15 and vmax < 1e18:
            return "us"
        if vmin > 1e18:
            return "ns"
        return None
    if vmin > 1e12:
        return "ms"
    return None


def parse_epoch(df: DataFrame, columns: list[str] | None = None, fine: bool = False) -> DataFrame:
    """Numeric columns on an epoch scale become timestamps (values out of
    range NULL); a column without any value in range stays as it is."""
    cand = columns if columns is not None else [f.name for f in df.schema.fields
                                                 if isinstance(f.dataType, NUMERIC)]
    if not cand:
        return df
    r = df.agg(*[x for i, c in enumerate(cand)
                 for x in (F.min(_q(c)).alias(f"a{i}"), F.max(_q(c)).alias(f"b{i}"))]).first()
    unit = {}
    for i, c in enumerate(cand):
        u = epoch_unit(r[f"a{i}"], r[f"b{i}"], fine)
        # the scales start above zero: if the least value is out of range, all are
        if u and r[f"a{i}"] <= LAST_NANOSECOND // EPOCH_NANOS[u]:
            unit[c] = u
    return df.select(*[epoch_to_ts(_q(c), unit[c], df.schema[c].dataType).alias(c) if c in unit else F.col(_q(c))
                       for c in df.columns])


def clip_quantiles(df: DataFrame, columns: list[str] | None = None,
                   lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Winsorise numeric columns to their [lo, hi] quantiles (exact,
    linear); the bounds are literals in the plan."""
    cols = columns if columns is not None else columns_of_type(df, "numeric")
    if not cols:
        return df
    q = exact_quantiles(df.select([nan_to_null(F.col(_q(c)).cast("double")).alias(c) for c in cols]),
                        cols, [lo, hi])
    out = []
    for c in df.columns:
        if c in cols and q[(c, lo)] is not None:
            v = nan_to_null(F.col(_q(c)).cast("double"))
            out.append(F.least(F.greatest(v, F.lit(q[(c, lo)])), F.lit(q[(c, hi)])).alias(c))
        else:
            out.append(F.col(_q(c)))
    return df.select(*out)


def drop_high_cardinality(df: DataFrame, columns: list[str] | None = None,
                          limit: int = 200) -> DataFrame:
    """Drop categorical columns with more than ``limit`` distinct values
    (NULL not counted), from one pass that stops collecting a column's values at
    the limit (``profile.capped_distinct``)."""
    cols = columns if columns is not None else columns_of_type(df, "categorical")
    if not cols:
        return df
    found = capped_distinct(df, cols, limit)
    drop = [c for c in cols if found[c] > limit]
    return df.drop(*drop) if drop else df


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns under their canonical keys, in the mapping's
    order; entries without a column, or with one the table lacks, are left out."""
    return df.select(*[F.col(_q(c)).alias(key) for key, c in mapping.items() if c in df.columns])


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows with a NULL (or NaN) in any of ``subset`` removed."""
    return df.dropna(subset=subset)


def without(df: DataFrame, target: str) -> DataFrame:
    """Every column but the target."""
    return df.drop(target)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """P10 applied to columns: text to double, bad values NULL."""
    return df.select(*[number_of(df, c).alias(c) if c in cols else F.col(_q(c)) for c in df.columns])
