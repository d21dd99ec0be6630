"""Audit of how filters act on one another in every order (operator 11).

Each filter leaves one table of the ids that fail it.  What a filter removes
depends on the set of filters before it only, so all orders are answered from
the prefix sets: a chain of left-anti joins, one a filter, carries every row
with every set of filters that it survives (a row stands once for the set
without the filter and, if the filter's id table lacks it, once for the set
with it).  The same chain over the rows that fail one filter (a left-semi join
with its id table) gives what that filter removes after every set of the others.

All joins have one key, the row number.  The rows are exchanged by it once, the
id tables once each, and the whole chain runs in that one stage; beyond it travel
counts per part and set.

Rows are numbered here, because doc_id may be null or repeated: the number is
written with the row's verdicts and is the id of the id tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.operators.skew import hot_split_join
from tablesight.session import scratch_table

SEPARATORS = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SIGNS = r"[#$%&*|]"
#: Filters audited at once: 2^k prefix sets and k! orders a part.
MAX_FILTERS = 7
COUNTS = ("n", "good", "toxic")


def prefix_counts(rows: DataFrame, fails: dict[str, DataFrame], row_col: str = "row") -> DataFrame:
    """(part, tested, prefix, n, good, toxic): with ``tested`` empty, the rows
    that survive the filters of ``prefix`` (bits, the first filter the lowest);
    otherwise the rows that survive them and fail the filter ``tested``."""
    def surviving(df: DataFrame, names: list[str]) -> DataFrame:
        df = df.withColumn("prefix", F.lit(0))
        for name in names:
            bit = F.lit(1 << list(fails).index(name))
            ids = fails[name].select(F.col(row_col).alias("__failing"))
            both = df.withColumn("__bit", F.explode(F.array(F.lit(0), bit)))
            df = (both.join(ids, (F.col(row_col) == F.col("__failing")) & (F.col("__bit") == bit), "left_anti")
                  .withColumn("prefix", F.col("prefix") + F.col("__bit")).drop("__bit"))
        return df

    out = None
    for tested in ["", *fails]:
        some = rows.join(fails[tested], row_col, "left_semi") if tested else rows
        counted = (surviving(some, [f for f in fails if f != tested]).groupBy("part", "prefix")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"),
                        F.sum(F.col("toxic").cast("long")).alias("toxic"))
                   .withColumn("tested", F.lit(tested)))
        out = counted if out is None else out.unionByName(counted)
    return out


def audit(rows: DataFrame, fails: dict[str, DataFrame], row_col: str = "row") -> DataFrame:
    """One row per part, order of the filters and step.

    ``rows`` has ``row_col`` (unique, not null), ``part``, ``good`` and ``toxic``
    (booleans); ``fails`` has a table of failing row numbers for each filter, by
    its letter.  Parts without rows do not appear; no rows, no result.
    """
    letters = list(fails)
    k = len(letters)
    if not 0 < k <= MAX_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"1 to {MAX_FILTERS} filters with names of one letter, not {letters}")
    cells = prefix_counts(rows, fails, row_col)
    # orders in which a prefix of b filters comes before the filter: b! * (k - 1 - b)!
    times = F.array(*[F.lit(math.factorial(b) * math.factorial(k - 1 - b)).cast("long") for b in range(k)])
    weighted = F.col("n") * F.try_element_at(times, F.bit_count("prefix") + 1)
    # at most (k + 2) * 2^(k-1) cells a part: a row of its own
    by_part = cells.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.concat("tested", F.col("prefix").cast("string")), F.struct(*COUNTS)))).alias("cells"),
        *[F.coalesce(F.sum(F.when(F.col("tested") == x, weighted)), F.lit(0).cast("long")).alias(f"shapley_{x}")
          for x in letters])

    def bits(text: Column) -> Column:
        total = F.lit(0)
        for i, x in enumerate(letters):
            total = total + F.when(F.instr(text, x) > 0, 1 << i).otherwise(0)
        return total

    def cell(tested, prefix, field: str) -> Column:
        key = F.concat(tested, prefix.cast("string"))
        return F.coalesce(F.try_element_at("cells", key)[field], F.lit(0).cast("long"))

    orders = F.lit("")
    orders = F.array(orders)
    for _ in letters:
        orders = F.flatten(F.transform(orders, lambda o: F.transform(
            F.filter(F.array(*[F.lit(x) for x in letters]), lambda x: ~F.contains(o, x)),
            lambda x: F.concat(o, x))))
    tested = F.col("__filter")
    everything = (1 << k) - 1
    own = F.lit(0)
    shapley = F.lit(0).cast("long")
    for i, x in enumerate(letters):
        own = F.when(tested == x, 1 << i).otherwise(own)
        shapley = F.when(tested == x, F.col(f"shapley_{x}")).otherwise(shapley)
    filters = (by_part.withColumn("__filter", F.explode(F.array(*[F.lit(x) for x in letters])))
               .withColumn("shapley", shapley)
               .withColumn("unique_fails", cell(tested, F.lit(everything) - own, "n"))
               .withColumn("failing", cell(tested, F.lit(0), "n")))
    steps = (filters.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.instr("filter_order", tested))
             .withColumn("prefix", bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1))))
    removed = cell(tested, F.col("prefix"), "n")
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        cell(F.lit(""), F.col("prefix") + own, "n").alias("kept"), removed.alias("removed"),
        (F.col("failing") - removed).alias("redundant"), "unique_fails",
        cell(tested, F.col("prefix"), "good").alias("good_lost"),
        cell(tested, F.col("prefix"), "toxic").alias("toxic_lost"), "shapley")


def text_verdicts(body: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that read it alone."""
    words = F.array_remove(F.split(body, SEPARATORS), "")
    capitals = F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT_PERCENT,
        "C": capitals * 100 > F.length(body) * MAX_CAPITALS_PERCENT,
        "D": body.rlike(SIGNS),
    }


def repeated_texts(facts: DataFrame) -> DataFrame:
    """Rows (``row``) whose text some smaller doc_id has.  Equal texts are equal
    SHA-256 digests; a text in many rows is one row of partial minima a task, and
    the hot ones join by broadcast."""
    texts = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    return (hot_split_join(facts.select("row", "doc_id", "digest"), texts.filter("n_rows > 1"), ["digest"], "n_rows")
            .filter("doc_id > least").select("row"))


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        part_col: str = "source") -> DataFrame:
    """The five text filters (A short, B repetitive, C capitals, D signs, E repeated)
    audited for each source, with label losses.

    Null texts are empty and fail A; null and empty sources are one part.  A null
    doc_id is smaller than none, so it neither fails E nor makes others fail, and
    has no labels.  Repeated rows count each; rows of one doc_id do not fail E by
    each other.  A document with several label rows has quality or toxic 1 if one
    of them says so.  Texts are read whole; other columns of either table are not
    read.  An empty table gives no rows.
    """
    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    scanned = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                          body.alias("body"))
    verdicts = text_verdicts(F.col("body"))
    facts = scratch_table(scanned.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part",
        F.unhex(F.sha2("body", 256)).alias("digest"), *[v.alias(f"fails_{x}") for x, v in verdicts.items()]), "facts")
    known = (labels.select(labels[id_col].alias("doc_id"), *[
        F.coalesce(labels[c] == 1, F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
        .filter("doc_id is not null and (good or toxic)")
        .groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    named = facts.select("row", "doc_id", "part")
    marks = named.filter("doc_id is not null").join(known, "doc_id").select("row", "good", "toxic")
    rows = scratch_table(named.select("row", "part").join(marks, "row", "left").select(
        "row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "rows")
    fails = {x: scratch_table(facts.filter(f"fails_{x}").select("row"), f"fails_{x}") for x in verdicts}
    fails["E"] = scratch_table(repeated_texts(facts), "fails_E")
    return audit(rows, fails)
