"""Secret scans with character Markov models (operator 4).

Base kinds come from fixed patterns.  The method adds kind ``random``: every
other run of 16 or more key-like characters is scored by two character bigram
models, one of random strings and one of ordinary identifiers, and is a secret
if the log-likelihood ratio reaches THRESHOLD, and PER_CHARACTER times its length.

Labelled samples: random strings are the values that base patterns found in the
corpus and GENERATED digest strings in base64 and in hexadecimal.  Ordinary
identifiers are the words of the corpus's prose, which are too short to be part
of a run, written together, as camelCase, snake_case and CONSTANT_CASE.  A model
of these alone relabels the key-like runs that no base pattern covers: those it
finds likelier ordinary than random join the ordinary class, in the same four
forms, and the models are trained again.  So a key is never a sample of what
is ordinary, however many there are.  Each source of a class has the same weight,
so that a corpus full of one sort does not hide the others.  A model is at most
68 x 67 numbers.

DataFrame functions only.  Positions are code points: a text split at a pattern
gives the gaps between its matches, and running sums of the lengths give starts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.llm.common import packed, passed_columns
from tablesight.session import scratch_table

# The base patterns, their kinds in order, and their least lengths.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # shorter runs would be dropped
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]{16,}"
STATES = len(SYMBOLS) + 1  # the last state is the start
#: A word of prose, between characters that are neither letters nor of a run.
WORD, BETWEEN_WORDS = "^[A-Za-z][a-z]{0,14}$", r"[^\p{L}\p{M}\p{N}+/_=-]+"
FORMS = ("ordinary", "camel", "snake", "constant")
ORDINARY = (*FORMS, *(f"words {f}" for f in FORMS))
THRESHOLD, PER_CHARACTER = 10.0, 1.5
GENERATED = 4096
#: Weight of a sample source, in bigrams, and the smoothing added to each bigram.
MASS, SMOOTHING = 1e6, 0.5
#: Running sums are taken in blocks of this many matches.
BLOCK = 64


def either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


ASSIGN = f"({'|'.join(either_case(k) for k in KEYWORDS)}){ASSIGN_TAIL}"


def running_sums(lengths: Column) -> Column:
    """Sums of an array's elements up to each one."""
    def sums(total: Column) -> Column:
        return F.aggregate(total, F.lit(0), lambda a, x: a + x)

    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda v: F.struct(v.alias("v"), sums(v).alias("t")))
    before = F.transform(F.array(totals), lambda bs: F.transform(bs, lambda b, i: F.struct(
        b["v"].alias("v"), sums(F.transform(F.slice(bs, F.lit(1), i), lambda x: x["t"])).alias("t"))))[0]
    return F.flatten(F.transform(before, lambda b: F.transform(
        b["v"], lambda _, j: b["t"] + sums(F.slice(b["v"], F.lit(1), j + 1)))))


def matched(text: Column, pattern: str, guard: Column, group: int | None = None) -> Column:
    """One struct of parallel arrays, or none: the matches, the gaps before them,
    and the asked group."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
             F.split(text, pattern, -1).alias("g")]
    if group:
        found.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    some = F.array(F.struct(*found))
    return F.when(guard, some).otherwise(F.array().cast(
        "array<struct<m:array<string>,g:array<string>" + (",value:array<string>" if group else "") + ">>"))


def spans(found: Column, kind: int, least: int, part: str = "m") -> Column:
    """Spans (start, kind, end, text) of the matches whose ``part`` is long enough."""
    def one(f: Column) -> Column:
        sums = running_sums(F.transform(f["m"], lambda m, i: F.length(F.get(f["g"], i)) + F.length(m)))
        rows = F.transform(F.array(sums), lambda ends: F.transform(f["m"], lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).cast("long").alias("start"), F.lit(kind).alias("kind"),
            F.get(ends, i).cast("long").alias("end"), F.get(f[part], i).alias("text"))))[0]
        return F.filter(rows, lambda r: F.length(r["text"]) >= least)

    return F.flatten(F.transform(found, one))


def with_spans(df: DataFrame, text: Column) -> DataFrame:
    """Add __base, the base spans, and __runs, the key-like runs no base span touches."""
    df = df.withColumns({
        "__a": matched(text, ASSIGN, text.rlike(ASSIGN), 2),
        "__k": matched(text, ACCESS, text.contains("AKIA")),
        "__h": matched(text, HEX, text.rlike(HEX)),
        "__r": matched(text, RUN, text.rlike(RUN))})
    df = df.withColumns({
        "__base": F.concat(spans(F.col("__a"), 0, LEAST["assign"], "value"), spans(F.col("__k"), 1, LEAST["access"]),
                           spans(F.col("__h"), 2, LEAST["hex"])),
        "__all": spans(F.col("__r"), 3, 16)}).drop("__a", "__k", "__h", "__r")
    return df.withColumn("__runs", F.filter("__all", lambda r: ~F.exists(
        "__base", lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"])))).drop("__all")


def code(character: Column) -> Column:
    """Model state of a character; characters outside SYMBOLS count as the last."""
    by_ascii = [SYMBOLS.index(chr(i)) if chr(i) in SYMBOLS else STATES - 2 for i in range(128)]
    table = F.lit(",".join(map(str, by_ascii)))
    return F.coalesce(F.get(F.split(table, ",").cast("array<int>"), F.ascii(character)), F.lit(STATES - 2))


def bigrams(samples: DataFrame) -> DataFrame:
    """(source, state, next, n) over samples of (source, sample), which count n
    times if they have a column n."""
    walk = F.transform(F.split("sample", ""), code)
    times = F.col("n") if "n" in samples.columns else F.lit(1)
    return (samples.filter(F.length("sample") > 0).select("source", times.alias("n"), walk.alias("c"))
            .select("source", "n", F.explode(F.transform(F.array(F.col("c")), lambda c: F.transform(c, lambda x, i: F.struct(
                F.coalesce(F.get(c, i - 1), F.lit(STATES - 1)).alias("state"), x.alias("next"))))[0]).alias("b"))
            .groupBy("source", "b.state", "b.next").agg(F.sum("n").alias("n")))


def generated_samples(spark) -> DataFrame:
    """Strings that are random by construction: digests of numbers, in base64 and hexadecimal."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(GENERATED).select(F.explode(F.array(
        F.struct(F.lit("base64").alias("source"), F.base64(F.unhex(digest)).alias("sample")),
        F.struct(F.lit("digits").alias("source"), digest.alias("sample")))).alias("s")).select("s.*")


def in_forms(prefix: str, whole: Column, parts: list[Column]) -> Column:
    """Samples of an identifier as it stands and written in the other FORMS."""
    forms = {
        "ordinary": whole,
        "camel": F.concat(*[p if i == 0 else F.initcap(p) for i, p in enumerate(parts)]),
        "snake": F.concat_ws("_", *parts),
        "constant": F.upper(F.concat_ws("_", *parts))}
    return F.array(*[F.struct(F.lit(prefix + f).alias("source"), forms[f].alias("sample")) for f in FORMS])


def word_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(source, sample, n): each distinct word of the prose, written twice in each form."""
    words = (docs.select(F.explode(F.split(text_col, BETWEEN_WORDS)).alias("w")).filter(F.col("w").rlike(WORD))
             .groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    w = F.lower("w")
    return words.select("n", F.explode(in_forms("words ", F.concat(w, w), [w, w])).alias("s")).select("s.*", "n")


def key_like(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(base, text): the values of base spans, and the runs that no base span touches."""
    found = with_spans(docs.select(F.col(text_col).alias("__t")), F.coalesce(F.col("__t"), F.lit("")))

    def of(column: str, base: bool) -> Column:
        return F.transform(column, lambda r: F.struct(F.lit(base).alias("base"), r["text"].alias("text")))

    return found.select(F.explode(F.concat(of("__base", True), of("__runs", False))).alias("k")).select("k.*")


def run_samples(runs: DataFrame) -> DataFrame:
    t = F.col("text")
    parts = [F.substring(t, 1, 5), F.substring(t, 6, 6), F.substring(t, 12, 1 << 30)]
    return runs.select(F.explode(in_forms("", t, parts)).alias("s")).select("s.*")


def counted(samples: DataFrame) -> dict[str, list[float]]:
    """Counts of each (state, next), row by row, of every source."""
    counts: dict[str, list[float]] = {}
    for r in bigrams(samples).collect():  # at most STATES * (STATES - 1) rows a source
        held = counts.setdefault(r["source"], [0.0] * (STATES * (STATES - 1)))
        held[r["state"] * (STATES - 1) + r["next"]] = float(r["n"])
    return counts


def ratios(counts: dict[str, list[float]]) -> list[float]:
    """Log-likelihood ratio of each (state, next), row by row: the sources in
    ORDINARY against all others.  Without ordinary samples the ordinary model is
    uniform."""
    size = STATES * (STATES - 1)

    def log_model(sources: list[str]) -> list[float]:
        mixed = [SMOOTHING] * size
        for s in sources:
            total = sum(counts[s])
            mixed = [m + x * MASS / total for m, x in zip(mixed, counts[s])]
        rows = [mixed[i:i + STATES - 1] for i in range(0, size, STATES - 1)]
        return [math.log(x / sum(row)) for row in rows for x in row]

    random = log_model(sorted(s for s in counts if s not in ORDINARY))
    ordinary = log_model(sorted(s for s in counts if s in ORDINARY))
    return [a - b for a, b in zip(random, ordinary)]


def train(samples: DataFrame) -> list[float]:
    """The ratio table of labelled samples."""
    return ratios(counted(samples))


def likelihood_ratio(sample: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(STATES - 1).alias("state"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(sample, ""), start, lambda a, ch: F.struct(
        code(ch).alias("state"),
        (a["sum"] + F.get(table, a["state"] * (STATES - 1) + code(ch))).alias("sum")), lambda a: a["sum"])


def with_secrets(df: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``spans`` (base and random), arrays of (start,
    kind, end, text) in order of start, then kind; ends are exclusive.

    Null text counts as empty and has no spans.  Rows pass through; input
    columns of these two names are replaced.
    """
    kept = passed_columns(df, ["base_spans", "spans"])
    found = _spans_of(packed(df, text_col), model, text_col)
    return found.select(*[F.col("__doc").getField(c).alias(c) for c in kept], "base_spans", "spans")


def _spans_of(rows: DataFrame, model: list[float], text_col: str) -> DataFrame:
    held = rows.select("__doc", F.coalesce(rows[text_col], F.lit("")).alias("__t"))
    found = with_spans(held, F.col("__t"))
    random = F.filter("__runs", lambda r: likelihood_ratio(r["text"], model) >= F.greatest(
        F.lit(THRESHOLD), F.length(r["text"]) * PER_CHARACTER))
    return found.select("__doc", F.array_sort("__base").alias("base_spans"),
                        F.array_sort(F.concat(F.col("__base"), random)).alias("spans"))


def written(spans_col: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_sha256, spans and n_random."""
    found = with_secrets(docs.select("doc_id", "text"), train_on(docs))
    of_kind = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of_kind("base_spans", 0).alias("n_assign"), of_kind("base_spans", 1).alias("n_access"),
        of_kind("base_spans", 2).alias("n_hex"), F.sha2(written("base_spans").cast("binary"), 256).alias("base_sha256"),
        written("spans").alias("spans"), of_kind("spans", 3).alias("n_random"))


def train_on(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The models' ratio table, from the corpus and generated samples, in two passes."""
    keys = scratch_table(key_like(docs, text_col), "key_like")
    found = keys.filter("base").select(F.lit("found").alias("source"), F.col("text").alias("sample"))
    counts = counted(found.union(generated_samples(docs.sparkSession))) | counted(word_samples(docs, text_col))
    first = ratios(counts)
    ordinary = keys.filter(~F.col("base") & (likelihood_ratio(F.col("text"), first) < 0))
    return ratios(counts | counted(run_samples(ordinary)))


def redacted(df: DataFrame, model: list[float], text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """The rows with every stretch of secret spans in the text replaced by
    ``mark`` (overlapping spans by one mark); other texts stay as they are."""
    text = F.col("__doc").getField(text_col)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        before = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        fresh = F.struct(F.concat(a["parts"], F.array(before, F.lit(mark))).alias("parts"), s["end"].alias("at"))
        wider = F.struct(a["parts"].alias("parts"), F.greatest(a["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(wider)

    rest = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(
        text, (a["at"] + 1).cast("int"), F.length(text)))
    found = _spans_of(packed(df, text_col), model, text_col)
    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", start, step, rest))
    return found.select(*[clean.alias(c) if c == text_col else F.col("__doc").getField(c).alias(c) for c in df.columns])
