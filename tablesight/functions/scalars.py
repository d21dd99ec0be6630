"""Column-expression helpers (F1-F23).  All return ``Column`` objects built from
built-in Spark functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal number with optional sign, fraction and exponent,
# padded by blanks.  ``try_cast`` alone accepts "12f" and "12d" (Java suffixes).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# The shapes of date text and how each is read.  ISO text goes
# through Spark's own cast; a row is parsed once, by the way of its shape.
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?$"
ZONED_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)? ?(Z|[+-]\d{2}(:?\d{2})?)$"
COMPACT_SHAPE = r"^(\d{4})(\d{2})(\d{2})$"
CLOCK = r"(?:(?:,? |T)(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?"
HALF_DAY = r"(?i)\d ?[ap]m$"
WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? )?"
MONTH = (r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?"
         r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?")
DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
YEAR_FIRST = rf"^(\d{{4}})([/.])(\d{{1,2}})\2(\d{{1,2}}){CLOCK}$"
YEAR_LAST = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){CLOCK}$"
MONTH_DAY = rf"(?i)^{WEEKDAY}{MONTH} {DAY},? (\d{{4}}){CLOCK}$"
DAY_MONTH = rf"(?i)^{WEEKDAY}{DAY}[ -]{MONTH}[ -](\d{{4}}|\d{{2}}){CLOCK}$"
# First or second number that is no month, and a year of two digits (those from 69
# on are of the last century, as in POSIX).
FIRST_NO_MONTH = r"^(?:1[3-9]|[2-9]\d)[/.-]"
SECOND_NO_MONTH = r"^\d{1,2}[/.-](?:1[3-9]|[2-9]\d)[/.-]"
LAST_CENTURY, THIS_CENTURY = r"^(69|[7-9]\d)-", r"^(\d\d)-"
MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Spellings of infinity in number text.
INFINITY = ("inf", "+inf", "infinity", "+infinity")
MINUS_INFINITY = ("-inf", "-infinity")

# Units per epoch unit in microseconds and nanoseconds, and the
# last nanosecond of a 64-bit timestamp (in the year 2262).
EPOCH_MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1}
EPOCH_NANOS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
LAST_NANOSECOND = 2 ** 63 - 1


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c, dtype: T.DataType | None = None) -> Column:
    """Parse to double, bad values to NULL (F14 / P10).  Numbers and booleans
    are cast, other types go through their text; NaN becomes NULL so that NULL
    is the one missing marker.  Without a type the column is read as text."""
    c = col_(c)
    if isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    s = F.trim(c.cast("string"))
    word = F.lower(s)
    return nan_to_null(F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
                       .when(word.isin(*INFINITY), F.lit(float("inf")))
                       .when(word.isin(*MINUS_INFINITY), F.lit(float("-inf"))))


def number_of(df, name: str) -> Column:
    """``to_number`` of a column of ``df``, by its type."""
    return to_number(F.col("`" + name.replace("`", "``") + "`"), df.schema[name].dataType)


def nan_to_null(c) -> Column:
    """NaN -> NULL (the boundary rule between pandas-style and SQL missing)."""
    c = col_(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_ratio(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col_(num), col_(den))


def ratio_max1(num, den) -> Column:
    """num / max(1, den): the reference's guard against empty groups."""
    return col_(num) / F.greatest(F.lit(1), col_(den))


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def day_month_votes(c) -> tuple[Column, Column]:
    """For a vote over a column's numeric dates: whether a text can only be
    day-first (its first number is no month), and only month-first."""
    s = F.trim(col_(c).cast("string"))
    numeric = s.rlike(YEAR_LAST) & ~s.contains(".")
    first, second = s.rlike(FIRST_NO_MONTH), s.rlike(SECOND_NO_MONTH)
    return numeric & first & ~second, numeric & second & ~first


def _iso_text(s: Column, day_first: bool) -> Column:
    """Date text of the known shapes as ``year-month-day clock``; others NULL."""
    def named(shape: str, name: int, year: int, day: int, clock: int) -> Column:
        start = F.lower(F.substring(F.regexp_extract(s, shape, name), 1, 3))
        month = ((F.instr(F.lit(MONTH_STARTS), start) + 2) / 3).cast("int").cast("string")
        return F.concat(F.regexp_replace(s, shape, f"${year}-"), month, F.regexp_replace(s, shape, f"-${day} ${clock}"))

    by_day, by_month = (F.regexp_replace(s, YEAR_LAST, order) for order in ("$4-$3-$1 $5", "$4-$1-$3 $5"))
    dotted, first_no_month = s.contains("."), s.rlike(FIRST_NO_MONTH)
    as_day = (dotted | first_no_month | ~s.rlike(SECOND_NO_MONTH)) if day_first else (s.rlike(r"^\d{1,2}\.") | first_no_month)
    text = (F.when(s.rlike(ISO_SHAPE), s)
            .when(s.rlike(YEAR_LAST), F.when(as_day, by_day).otherwise(by_month))
            .when(s.rlike(YEAR_FIRST), F.regexp_replace(s, YEAR_FIRST, "$1-$3-$4 $5"))
            .when(s.rlike(MONTH_DAY), named(MONTH_DAY, 1, 3, 2, 4))
            .when(s.rlike(DAY_MONTH), named(DAY_MONTH, 2, 3, 1, 4))
            .when(s.rlike(COMPACT_SHAPE), F.regexp_replace(s, COMPACT_SHAPE, "$1-$2-$3")))
    return F.regexp_replace(F.regexp_replace(text, LAST_CENTURY, "19$1-"), THIS_CENTURY, "20$1-")


def _half_day(text: Column, half: Column) -> Column:
    """A clock with AM or PM; none is beyond 12, nor 0."""
    hour = F.regexp_extract(text, r" (\d{1,2}):", 1).try_cast("int")
    shift = F.when((half == "pm") & (hour < 12), 12).when((half == "am") & (hour == 12), -12).otherwise(0)
    return F.when(hour.between(1, 12), F.timestamp_add("HOUR", shift, text.try_cast("timestamp_ntz")))


def parse_ts(c, dtype: T.DataType | None = None, day_first: bool = False) -> Column:
    """Parse text to a timestamp (F10); bad values become NULL.  Timestamp and
    date input pass through.

    Read are ISO text (a zone is brought to UTC), ``2024/1/2``, ``1/2/2024`` and
    ``1-2-24`` (the month first, unless ``day_first`` or no month can be), always
    day-first ``2.1.2024``, ``20240102``, and month names as in ``Jan 5, 2024`` and
    ``5 January 2024``; all but the compact form with an optional clock, with AM or
    PM.
    """
    c = col_(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")

    # wall-clock timestamps without zone, like the driver tables; text with a
    # zone is brought to UTC
    def parsed(s: Column) -> Column:
        utc = F.timestamp_add("MICROSECOND", F.unix_micros(s.try_cast("timestamp")), epoch_ntz())
        bare = F.rtrim(F.substring(s, F.lit(1), F.length(s) - 2))
        half = F.lower(F.right(s, F.lit(2)))
        return (F.when(s.rlike(ZONED_SHAPE), utc)
                .when(s.rlike(HALF_DAY), _bound(_iso_text(bare, day_first), lambda t: _half_day(t, half)))
                .otherwise(_iso_text(s, day_first).try_cast("timestamp_ntz")))

    return _bound(F.trim(c.cast("string")), parsed)


def epoch_in_range(c, unit: str) -> Column:
    """Whether a numeric epoch lies in the years a 64-bit nanosecond timestamp
    can say."""
    return F.abs(col_(c)) <= LAST_NANOSECOND // EPOCH_NANOS[unit]


def epoch_to_ts(c, unit: str, dtype: T.DataType | None = None) -> Column:
    """Numeric epoch to a zone-less timestamp (F12); unit in s, ms, us, ns;
    values out of range become NULL.  Zone-less arithmetic from 1970-01-01, so
    the session time zone does not matter, and whole numbers stay whole."""
    if unit not in EPOCH_NANOS:
        raise ValueError(f"unknown epoch unit {unit!r}")
    c = col_(c)
    value = F.when(epoch_in_range(c, unit), c)
    if isinstance(dtype, T.IntegralType):
        value = value.cast("long")
        micros = (value * EPOCH_MICROS[unit] if unit in EPOCH_MICROS
                  else F.call_function("div", value - F.pmod(value, F.lit(1000).cast("long")), F.lit(1000).cast("long")))
    else:
        value = value.cast("double")
        micros = F.floor(value * EPOCH_MICROS[unit] if unit in EPOCH_MICROS else value / 1000)
    return F.timestamp_add("MICROSECOND", micros.cast("long"), epoch_ntz())


def epoch_ntz() -> Column:
    """1970-01-01 00:00:00 as a zone-less timestamp."""
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))


def epoch_seconds(c) -> Column:
    """Zone-less timestamp to whole epoch seconds (floor)."""
    return F.floor(F.timestamp_diff("MICROSECOND", epoch_ntz(), col_(c)) / 1_000_000).cast("long")


def period_start(c, period: str) -> Column:
    """First day of the day / week (Monday) / month containing ``c``."""
    unit = {"day": "DAY", "week": "WEEK", "month": "MONTH"}[period]
    return F.to_date(F.date_trunc(unit, col_(c)))


def yes_flag(c) -> Column:
    """Lower-cased text in {1, true, yes, y, abnormal}."""
    # Tokens that mark an abnormal lab result.
    return F.lower(col_(c).cast("string")).isin("1", "true", "yes", "y", "abnormal")


def status_class(c) -> Column:
    """Normalise free text, then no_show / cancelled / completed / other
    (first match wins, tested as substrings)."""
    s = F.trim(F.regexp_replace(F.lower(col_(c).cast("string")), r"[^a-z0-9_-]", " "))
    # Substrings per visit status class, in the order tested.
    no_show = ["no show", "no-show", "noshow", "no_show"]
    cancel = ["cancel", "cancelled", "canceled", "cxl"]
    completed = ["completed", "done", "attended"]

    def any_of(keys):
        cond = F.lit(False)
        for k in keys:
            cond = cond | s.contains(k)
        return cond

    return (F.when(s.isNull(), F.lit("other"))
            .when(any_of(no_show), F.lit("no_show"))
            .when(any_of(cancel), F.lit("cancelled"))
            .when(any_of(completed), F.lit("completed"))
            .otherwise(F.lit("other")))


def currency(c, symbol: str = "") -> Column:
    """symbol + thousands-separated two-decimal amount, NULL -> 'N/A'."""
    return F.coalesce(F.concat(F.lit(symbol), F.format_number(col_(c), 2)), F.lit("N/A"))


def drawdown_label(c) -> Column:
    """severity label of a drawdown fraction."""
    c = col_(c)
    return (F.when(c < -0.20, "severe").when(c < -0.10, "significant").otherwise("moderate"))


def trend_label(first, last) -> Column:
    """Decreasing, increasing or stable from first and last values."""
    first, last = col_(first), col_(last)
    return F.when(last < first, "decreasing").when(last > first, "increasing").otherwise("stable")


def literal_replace(c, old: str, new: str) -> Column:
    """every occurrence of a piece of text replaced by another."""
    return F.replace(col_(c), F.lit(old), F.lit(new))


def strip_left(c, characters: str) -> Column:
    """the given leading characters removed."""
    return F.ltrim(col_(c), F.lit(characters))


def word_count(c) -> Column:
    """Number of ``\\w+`` runs as Python counts them: letters, digits of any
    kind (Java's ``(?U)\\w`` misses e.g. superscripts) and underscore."""
    return F.regexp_count(col_(c), F.lit(r"[\p{L}\p{N}_]+"))


# The line boundaries of Python's str.splitlines, as a Java regex.
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def line_count(c) -> Column:
    """Lines as Python's ``splitlines`` counts them: a trailing break does not
    open a new line and empty text has no lines."""
    c = col_(c)
    breaks = F.regexp_count(c, F.lit(LINE_BREAK))
    trailing = c.rlike("(" + LINE_BREAK + ")$")
    return F.when(F.length(c) == 0, 0).otherwise(breaks + F.when(trailing, 0).otherwise(1))


def sentences(c) -> Column:
    """F8: split after . ! ? followed by blanks; pieces trimmed, empties dropped."""
    def strip(x):   # Python's str.strip: every kind of blank, not just spaces
        return F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.split(strip(col_(c)), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) > 0)
