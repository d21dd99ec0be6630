"""Personal data by bootstrapped contextual extraction (operator 9).

Seeds are the entities that the base patterns find (email, ip, card, phone).
Every identifier-like run of a text (an ``@``, or MIN_DIGITS digits), seed or
not, is an instance; the words around it are its lexical patterns: the word
before, the two words before, the word after.  Spark counts the graph of
patterns and instances over all documents and scores it in ROUNDS rounds, for
each kind by itself:

* a pattern's share of a kind is the summed score of its distinct instances over
  their number plus SMOOTHING.  Its confidence is what the share has over the
  kind's base rate (the kind's part of all distinct instances), as a part of what
  it could have, times its support: the logarithm of its seeds of that kind, 1
  from FULL_SUPPORT seeds on, 0 below MIN_SEEDS.  So a word that stands before
  anything tells nothing, however many seeds it has;
* an instance's score is 1 for a seed of the kind, 0 for a seed of other kinds,
  else the confidence of its best pattern on the other side (words before, word
  after), so that no pattern raises itself.

An occurrence that no base span covers is added as ``context_<kind>`` where its
own best pattern on either side, as independent evidence (1 - (1 - b)(1 - a)),
reaches ACCEPT; of several kinds the surest, then the first listed.

The texts are read once; the graph has one row per distinct (pattern, instance).
"""

from __future__ import annotations

import hashlib
import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.llm.common import map_texts, passed_columns
from tablesight.session import scratch_table

# The base kinds in order, their patterns and their limits.  An
# email is searched from its ``@`` outward and an ip from the start of a run of
# digits, so that long runs cost no more than their length.
KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, *(f"context_{k}" for k in KINDS))
LOCAL, DOMAIN = frozenset(string.ascii_letters + string.digits + "._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

#: Identifier-like runs: key-like characters with digits, and digit groups after them.
RUN = r"(?<![A-Za-z0-9._%+()@-])[A-Za-z._%+()-]*+[0-9@][A-Za-z0-9._%+()@-]*+(?:\x20[(0-9][0-9().-]*+)*+"
MIN_DIGITS = 6
#: Characters on either side in which context words are looked for; a word that
#: reaches beyond them is no pattern.
CONTEXT = 64
ROUNDS, SMOOTHING, MIN_SEEDS, FULL_SUPPORT = 3, 2.0, 5, 32
ACCEPT = 0.6

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
                     T.StructField("end", T.LongType())])
INSTANCE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("instance", T.LongType()), T.StructField("kinds", T.IntegerType()),
                         T.StructField("patterns", T.ArrayType(T.StringType()))])


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping spans of local@domain with a dotted domain."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        for m in re.finditer(IP, text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in re.finditer(CARD, text):
            d = digits_of(m[0])
            if CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in re.finditer(PHONE, text):
                if PHONE_DIGITS[0] <= len(digits_of(m[0])) <= PHONE_DIGITS[1]:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def plain(word: str) -> str:
    """A context word in lower case without its outer punctuation, digits as 0."""
    return re.sub("[0-9]", "0", re.sub(r"^\W+(?=\w)|(?<=\w)\W+$", "", word.lower()))


def patterns_of(text: str, start: int, end: int) -> list[str]:
    first, last = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    before, after = text[first:start].split(), text[end:last].split()
    if before and first and not (text[first - 1].isspace() or text[first].isspace()):
        before = before[1:]  # its beginning lies outside
    if len(after) == 1 and last < len(text) and not (text[last - 1].isspace() or text[last].isspace()):
        after = []
    before = [plain(w) for w in before[-2:]]
    out = []
    if before:
        out.append(f"{before[-1]} _")
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if after:
        out.append(f"_ {plain(after[0])}")
    return out


def instance_key(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.lower().encode(), digest_size=8).digest(), "little", signed=True)


def analyse(text: str | None) -> tuple[list, list]:
    """The base spans of a text, and all its instances (start, end, key, bit of
    the seed's kind, patterns)."""
    if not text or not re.search("[0-9@]", text):
        return [], []
    base = base_spans(text)
    found = [(a, b, 1 << k) for a, k, b in base]
    covered = 0
    ends = sorted((a, b) for a, _, b in base)
    for m in re.finditer(RUN, text):
        a, b = m.span()
        while a < b and text[a] in ".%-)":
            a += 1
        while a < b and text[b - 1] in ".%+(-":
            b -= 1
        body = text[a:b]
        if len(digits_of(body)) < MIN_DIGITS and not re.search(r"\w@\w", body):
            continue
        while covered < len(ends) and ends[covered][1] <= a:
            covered += 1
        if any(x < b and y > a for x, y in ends[covered:covered + 8]):
            continue
        found.append((a, b, 0))
    return base, [(a, b, instance_key(text[a:b]), kinds, patterns_of(text, a, b)) for a, b, kinds in found]


def with_instances(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def make():
        def work(texts):
            rows = [analyse(t) for t in texts]
            return [[[dict(zip(("start", "kind", "end"), s)) for s in base] for base, _ in rows],
                    [[dict(zip(("start", "end", "instance", "kinds", "patterns"), o)) for o in found] for _, found in rows]]
        return work

    fields = T.StructType([T.StructField("base_spans", T.ArrayType(SPAN)),
                           T.StructField("instances", T.ArrayType(INSTANCE))])
    return map_texts(df, text_col, fields, make, keep)


def each_kind(make) -> list[F.Column]:
    return [make(k) for k in range(len(KINDS))]


def sides() -> list[F.Column]:
    """A group's best confidence of each kind among patterns before (b) and after (a)."""
    before = F.col("pattern").endswith(" _")
    best = lambda side, k: F.max(F.when(side, F.col(f"c{k}")).otherwise(0.0))
    return each_kind(lambda k: best(before, k).alias(f"b{k}")) + each_kind(lambda k: best(~before, k).alias(f"a{k}"))


def pattern_scores(occurrences: DataFrame) -> DataFrame:
    """(pattern, c0, c1, ...): each pattern's confidence of each kind, from
    occurrences with columns instance, kinds (bits; 0 for no seed) and patterns."""
    edges = scratch_table(
        occurrences.select("instance", "kinds", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance").agg(F.bit_or("kinds").alias("kinds")), "graph")
    instances = scratch_table(edges.groupBy("instance").agg(F.bit_or("kinds").alias("kinds")), "seeds")
    edges = edges.drop("kinds")
    is_kind = lambda k: F.col("kinds").bitwiseAND(1 << k) != 0
    counts = instances.agg(F.count(F.lit(1)).alias("n"), *each_kind(lambda k: F.count_if(is_kind(k)).alias(f"n{k}"))).first()
    base = [counts[f"n{k}"] / max(1, counts["n"]) for k in range(len(KINDS))]
    scores = instances.select("*", *[F.lit(0.0).alias(f"{side}{k}") for side in "ba" for k in range(len(KINDS))])

    def confidence(k):
        other_side = F.when(F.col("pattern").endswith(" _"), F.col(f"a{k}")).otherwise(F.col(f"b{k}"))
        score = F.when(is_kind(k), 1.0).when(F.col("kinds") != 0, 0.0).otherwise(other_side)
        share = F.sum(score) / (F.count(F.lit(1)) + SMOOTHING)
        lift = (share - base[k]) / max(1 - base[k], 1e-9)
        seeds = F.count_if(is_kind(k))
        support = F.least(F.lit(1.0), F.log2(seeds + F.lit(1.0)) / F.log2(F.lit(FULL_SUPPORT + 1.0)))
        return F.when(seeds >= MIN_SEEDS, F.greatest(F.lit(0.0), lift) * support).otherwise(0.0).alias(f"c{k}")

    for i in range(ROUNDS):
        patterns = scratch_table(edges.join(scores, "instance").groupBy("pattern").agg(*each_kind(confidence)), "patterns")
        if i < ROUNDS - 1:
            scores = scratch_table(
                edges.join(patterns, "pattern").groupBy("instance").agg(*sides()).join(instances, "instance"), "scores")
    return patterns


def discovered(seen: DataFrame, patterns: DataFrame, row: str) -> DataFrame:
    """(row, start, end, kind): the unseen occurrences whose patterns show a kind."""
    telling = patterns.filter(F.greatest(*each_kind(lambda k: F.col(f"c{k}"))) > 0)
    evidence = lambda k: 1 - (1 - F.col(f"b{k}")) * (1 - F.col(f"a{k}"))
    found = (seen.filter("kinds = 0").select(row, "start", "end", F.explode("patterns").alias("pattern"))
             .join(telling, "pattern").groupBy(row, "start", "end").agg(*sides())
             .select(row, "start", "end", F.array(*each_kind(evidence)).alias("evidence"))
             .withColumn("best", F.array_max("evidence")))
    return found.filter(F.col("best") >= ACCEPT).select(
        row, "start", "end", (F.array_position("evidence", F.col("best")) - 1 + len(KINDS)).cast("int").alias("kind"))


def with_personal_data(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (base and context), arrays of (start,
    kind, end) in order of start, then kind; ends are exclusive.

    Null text counts as empty and has no spans.  Rows pass through, repeated or
    not; without seeds there are no patterns and no context spans.
    """
    kept = passed_columns(df.select(*(df.columns if keep is None else keep)), ["base_spans", "spans"])
    row = "__row"
    whole = F.struct(F.lit(0).alias("__none"), *[df[c] for c in kept]).alias("__doc")  # without the text, unless kept
    rows = df.select(whole, df[text_col])
    found = with_instances(rows, text_col, ["__doc"]).withColumn(row, F.monotonically_increasing_id())
    found = scratch_table(found, "instances")  # fixes the row numbers
    seen = found.select(row, F.explode("instances").alias("o")).select(row, "o.*")
    new = (discovered(seen, pattern_scores(seen), row)
           .groupBy(row).agg(F.collect_list(F.struct("start", "kind", "end")).alias("__new")))  # at most the runs of one text
    none = F.array().cast(T.ArrayType(SPAN))
    return found.join(new, row, "left").select(
        *[F.col("__doc").getField(c).alias(c) for c in kept], "base_spans", F.array_sort(F.concat("base_spans", F.coalesce("__new", none))).alias("spans"))


def written(spans_col: str) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_sha256, spans and n_context."""
    found = with_personal_data(docs.select("doc_id", "text"), keep=["doc_id"])
    of_kind = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[of_kind("base_spans", i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written("base_spans").cast("binary"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] >= len(KINDS))).cast("long").alias("n_context"))
