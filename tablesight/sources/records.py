"""Records of text files whose records span lines, read by many tasks.

Spark's own splittable readers cut a file into byte ranges at line ends (or at
another separator).  Whether a range starts inside a quoted field, or how deep in
a JSON document, depends on all ranges before it.  Both readers here find out by a
prefix scan: a first pass reads every range under each possible start state and
keeps one row a range (the end states); a scan over those rows gives the state at
every range's start; a second pass cuts the range into records.  What a record
has in a range where it does not both start and end is a piece, and the few
pieces (at most two a range, but for records longer than a range) are joined by
file and order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesight.session import scratch_table

#: Kinds of output rows: a whole record, the piece that starts one, a piece of one
#: that started in an earlier range.
WHOLE, STARTS, GOES_ON = 0, 1, 2
PIECE_CHARS = 1 << 20


def ranges(spark: SparkSession, files: list[str], separator: str) -> DataFrame:
    """(file, blk, raw): the texts between separators, in file order within the
    byte range that starts at ``blk``."""
    return spark.read.text(files, lineSep=separator).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.col("value").cast("binary").alias("raw"))


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Consecutive rows of one range: ((every column but raw), its texts)."""
    def rows():
        for batch in batches:
            names = [c for c in batch.schema.names if c != "raw"]
            yield from zip(zip(*(batch.column(c).to_pylist() for c in names)), batch.column("raw").to_pylist())

    todo = rows()
    ahead = next(todo, None)
    while ahead is not None:
        key = ahead[0]
        more = [ahead]   # the row read beyond the range, if any

        def texts():
            while more and more[0] is not None and more[0][0] == key:
                text = more[0][1]
                more[0] = next(todo, None)
                yield text

        yield key, texts()
        for _ in texts():   # what the caller left
            pass
        ahead = more[0]


def with_carry(states: DataFrame) -> DataFrame:
    """``states`` (file, blk, end_0, end_1: the end state after starting in 0 and
    in 1) with the state ``inside`` at the start of each range.  A range either
    ends in one state whatever its start, or keeps or flips it: the state is the
    last fixed one with the flips since.  One row a range, that is a
    hundred-millionth of the data."""
    rows = W.partitionBy("file").orderBy("blk")
    before = rows.rowsBetween(W.unboundedPreceding, -1)
    flip = F.when((F.col("end_0") == 1) & (F.col("end_1") == 0), 1).otherwise(0)
    counted = states.withColumn("__flips", F.sum(flip).over(rows.rowsBetween(W.unboundedPreceding, 0)))
    fixed = F.last(F.when(F.col("end_0") == F.col("end_1"), F.struct(F.col("end_0").alias("state"), F.col("__flips").alias("flips"))),
                   ignorenulls=True).over(before)
    since = F.coalesce(F.max("__flips").over(before), F.lit(0)) - F.coalesce(fixed["flips"], F.lit(0))
    return counted.withColumn("inside", F.pmod(F.coalesce(fixed["state"], F.lit(0)) + since, F.lit(2))).drop("__flips")


def joined_records(found: DataFrame, glue: str) -> DataFrame:
    """Whole records from the rows (file, blk, n, kind, first, text) of the
    second pass."""
    whole = found.filter(F.col("kind") == WHOLE).select("file", "blk", "n", "first", "text")
    order = W.partitionBy("file").orderBy("blk", "n")
    pieces = found.filter(F.col("kind") != WHOLE).withColumn(
        "run", F.sum(F.when(F.col("kind") == STARTS, 1).otherwise(0)).over(order))
    parts = F.sort_array(F.collect_list(F.struct("blk", "n", "text", "first")))
    spanning = pieces.groupBy("file", "run").agg(parts.alias("p")).select(
        "file", F.col("p")[0]["blk"].alias("blk"), F.col("p")[0]["n"].alias("n"), F.col("p")[0]["first"].alias("first"),
        F.array_join(F.transform("p", lambda x: x["text"]), glue).alias("text"))
    return whole.unionByName(spanning)


# ---------------------------------------------------------------------------
# Delimited text with quoted line breaks
# ---------------------------------------------------------------------------

def inside_quotes(line: str, sep: str, inside: bool) -> bool:
    """Whether the end of a line lies in a quoted field.  A quote opens a field at
    its start only; inside, a doubled one is a quote."""
    at = 0
    while True:
        if inside:
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line[at + 1:at + 2] != '"':
                    break
                at += 2
            at = line.find(sep, at + 1)
            if at < 0:
                return False
            at += len(sep)
        if line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(sep + '"', at)
        if at < 0:
            return False
        inside, at = True, at + len(sep) + 1


def header_record(lines: list[str], sep: str) -> str:
    """The first record of a file's first lines."""
    inside, out = False, []
    for line in lines:
        out.append(line.removesuffix("\r"))
        inside = inside_quotes(line, sep, inside)
        if not inside:
            break
    return "\n".join(out)


def _decoder(encoding: str | None):
    def decode(raw: bytes) -> str:
        return raw.decode(encoding or "utf-8", "ignore")
    return decode


def delimited_records(spark: SparkSession, files: list[str], sep: str, encoding: str | None = None) -> DataFrame:
    """(file, first, text): the records of delimited files whose quoted fields may
    hold line breaks; ``first`` marks a file's first record.  Blank records are
    left out.  The encoding has to extend ASCII."""
    decode = _decoder(encoding)
    lines = ranges(spark, files, "\n")

    def ends(batches):
        for (file, blk), texts in by_range(batches):
            state = [False, True]
            for raw in texts:
                if b'"' in raw:
                    line = decode(raw)
                    state = [inside_quotes(line, sep, s) for s in state]
            yield pa.RecordBatch.from_pylist([{"file": file, "blk": blk, "end_0": int(state[0]), "end_1": int(state[1])}])

    states = scratch_table(lines.mapInArrow(ends, "file string, blk long, end_0 long, end_1 long"), "ranges")
    starts = with_carry(states).select("file", "blk", "inside")
    # broadcast, so that the lines stay in order
    known = lines.join(F.broadcast(starts), ["file", "blk"], "left").select(
        "file", "blk", F.coalesce("inside", F.raise_error(F.lit("the files were cut up anew between two passes")).cast("long"))
        .alias("inside"), "raw")

    def cut(batches):
        for (file, blk, inside), texts in by_range(batches):
            out, n, opened, held = [], 0, not inside, []
            inside = bool(inside)
            first = blk == 0

            def put(kind, text):
                nonlocal n, first
                if kind != WHOLE or text.strip():
                    out.append({"file": file, "blk": blk, "n": n, "kind": kind, "first": first, "text": text})
                    n, first = n + 1, False

            size = 0
            for raw in texts:
                line = decode(raw).removeprefix("﻿" if blk == 0 and not n and not held else "")
                if b'"' in raw:
                    inside = inside_quotes(line, sep, inside)
                held.append(line)
                if not inside:
                    put(WHOLE if opened else GOES_ON, "\n".join([*held[:-1], held[-1].removesuffix("\r")]))
                    size += sum(map(len, held))
                    held, opened = [], True
                if size > PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, _CUT)
                    out, size = [], 0
            if held:
                put(STARTS if opened else GOES_ON, "\n".join(held))
            yield pa.RecordBatch.from_pylist(out, _CUT)

    found = scratch_table(known.mapInArrow(cut, "file string, blk long, n long, kind int, first boolean, text string"), "records")
    return joined_records(found, "\n")


_CUT = pa.schema([("file", pa.string()), ("blk", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()),
                  ("first", pa.bool_()), ("text", pa.string())])


# ---------------------------------------------------------------------------
# JSON documents
# ---------------------------------------------------------------------------

# What structures JSON text.  Texts are cut at closing braces, so
# that a document without line breaks is cut up too.
BRACE = "}"
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|"|[\[\]{}]', re.S)
STRING_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


def json_tokens(text: str, inside: bool) -> tuple[list[tuple[int, str]], bool]:
    """(position, bracket or whole string) of a text outside strings, and whether
    it ends inside one."""
    at = 0
    if inside:
        rest = STRING_REST.match(text)
        if rest is None:
            return [], True
        at = rest.end()
    tokens = []
    for m in TOKEN.finditer(text, at):
        if m[0] == '"':   # a string that the text does not end
            return tokens, True
        tokens.append((m.start(), m[0]))
    return tokens, False


def _depth_change(tokens: list[tuple[int, str]]) -> int:
    return sum(1 if t in "[{" else -1 for _, t in tokens if len(t) == 1)


class JsonPlace:
    """Where a document is at some text: string, depth, and whether inside the
    top object's ``data`` list."""

    def __init__(self, inside: bool, depth: int, in_data: bool):
        self.inside, self.depth, self.in_data = inside, depth, in_data
        self.event: str | None = None   # what became of the data list last
        self.opened = False
        self.key_end: tuple[str, str] | None = None   # last string at depth 1, and the text since

    def steps(self, text: str) -> Iterator[tuple[int, str, int]]:
        """(position, bracket, depth after it); keeps ``in_data`` up to date.  The
        name before a list is sought in this text and what the last one left."""
        tokens, self.inside = json_tokens(text, self.inside)
        since = 0
        for at, token in tokens:
            if len(token) > 1:
                if self.depth == 1:
                    self.key_end, since = (token, ""), at + len(token)
                continue
            if token in "[{":
                if self.depth == 1 and self.key_end is not None:
                    name, gap = self.key_end
                    if token == "[" and (gap + text[since:at]).strip() == ":" and json.loads(name) == "data":
                        self.in_data = self.opened = True
                        self.event = "open"
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 1:
                    self.in_data = False
                    self.event = "close"
                if self.depth < 0:
                    raise ValueError("a JSON document closes more than it opens")
            self.key_end = None if self.depth != 1 else self.key_end
            yield at, token, self.depth
        if self.key_end is not None:
            name, gap = self.key_end
            self.key_end = (name, gap + text[since:])


def json_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): one JSON object per row of the documents' tables.

    A document is a file: a list of objects gives its elements; an object with a
    list ``data`` the elements of that; another object itself; a scalar
    ``{"value": <its text>}``.  List elements that are no objects, and documents
    that are not whole, are errors.  Undecodable bytes are ignored.
    """
    decode = _decoder(None)
    pieces = ranges(spark, path, BRACE)
    sized = spark.read.text(path, lineSep=BRACE).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("raw"))

    def ends(batches):
        for (file, blk, size), texts in by_range(batches):
            state, change, lead, read = [False, True], [0, 0], "", 0
            for raw in texts:
                read += len(raw) + 1
                text = decode(raw) + BRACE
                for s in (0, 1):
                    tokens, state[s] = json_tokens(text, state[s])
                    change[s] += _depth_change(tokens)
                lead = lead or text.lstrip("﻿").strip()[:1]
            yield pa.RecordBatch.from_pylist([{
                "file": file, "blk": blk, "size": size, "read": read, "end_0": int(state[0]), "end_1": int(state[1]),
                "change_0": change[0], "change_1": change[1], "lead": lead}])

    states = scratch_table(sized.mapInArrow(ends, "file string, blk long, size long, read long, end_0 long, end_1 long, "
                                                  "change_0 long, change_1 long, lead string"), "ranges")
    carried = with_carry(states)
    before = W.partitionBy("file").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    change = F.when(F.col("inside") == 0, F.col("change_0")).otherwise(F.col("change_1"))
    placed = scratch_table(
        carried.withColumn("change", change)
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        .withColumn("last", F.col("blk") == F.max("blk").over(whole))
        # a file whose bytes are all read but one has no brace after its last text
        # (the reader leaves out a byte order mark)
        .withColumn("closed", (F.col("size") - F.sum("read").over(whole)).isin(0, 3))
        .withColumn("left", F.sum("change").over(whole) + F.when(F.col("closed"), 0).otherwise(1))
        .withColumn("lead", F.min_by("lead", F.when(F.col("lead") != "", F.col("blk"))).over(whole))
        .select("file", "blk", "inside", "depth", "last", "closed", "left", "lead"), "ranges")
    cut_anew = F.raise_error(F.lit("the files were cut up anew between two passes")).cast("long")

    def known(table: DataFrame, *more: str) -> DataFrame:
        return pieces.join(F.broadcast(table), ["file", "blk"], "left").select(
            "file", "blk", F.coalesce("inside", cut_anew).alias("inside"), "depth", "last", "closed", "left", "lead", *more, "raw")

    def ended(texts, last, closed):
        """Texts of a range, each with its closing brace where it has one."""
        ahead = next(texts, None)
        while ahead is not None:
            after = next(texts, None)
            text = decode(ahead)
            yield text if after is None and last and not closed else text + BRACE
            ahead = after

    def mark(batches):
        for (file, blk, inside, depth, last, closed, left, lead), texts in by_range(batches):
            if left and lead in ("[", "{"):
                raise ValueError(f"{file}: a JSON document that is not whole")
            place = JsonPlace(bool(inside), depth, False)
            for text in ended(texts, last, closed):
                for _ in place.steps(text):
                    pass
            yield pa.RecordBatch.from_pylist([{"file": file, "blk": blk, "event": place.event, "opened": place.opened}], pa.schema(
                [("file", pa.string()), ("blk", pa.int64()), ("event", pa.string()), ("opened", pa.bool_())]))

    marks = known(placed).mapInArrow(mark, "file string, blk long, event string, opened boolean")
    marked = scratch_table(
        marks.withColumn("in_data", F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit("")) == "open")
        .withColumn("has_data", F.max("opened").over(whole)).join(placed, ["file", "blk"])
        .select("file", "blk", "inside", "depth", "last", "closed", "left", "lead", "in_data", "has_data"), "ranges")

    def cut(batches):
        for (file, blk, inside, depth, last, closed, _, lead, in_data, has_data), texts in by_range(batches):
            top = lead == "{" and not has_data
            level = 0 if top else 1 if lead == "[" else 2
            place = JsonPlace(bool(inside), depth, bool(in_data))
            out, n, size, held = [], 0, 0, []
            opened = False   # whether the held text starts a record
            going = depth > level and (level < 2 or bool(in_data))   # inside a record at the start

            def put(kind, text):
                nonlocal n, size
                out.append({"file": file, "blk": blk, "n": n, "kind": kind, "first": False, "text": text})
                n, size = n + 1, size + len(text)

            def between(text):
                bad = text.strip(" \t\r\n,[]{}:﻿") if level < 2 else text.strip(" \t\r\n,[]")
                if bad and (level < 2 or place.in_data):
                    raise ValueError(f"{file}: a list element that is no object, or text beside the document: {bad[:40]!r}")

            if lead not in ("[", "{"):
                text = "".join(ended(texts, last, closed))
                put(GOES_ON if blk else STARTS, text)
                yield pa.RecordBatch.from_pylist(out, _CUT)
                continue
            for text in ended(texts, last, closed):
                start = 0   # of the record, or of what lies between records
                was_data = place.in_data
                for at, token, deep in place.steps(text):
                    counts = level < 2 or place.in_data
                    if token in "[{" and deep == level + 1 and counts and not going:
                        if token == "[" and level:
                            raise ValueError(f"{file}: a list in place of an object")
                        if level and (level < 2 or was_data):
                            between(text[start:at])
                        start, going, opened = at, True, True
                    elif token in "]}" and deep == level and counts and going:
                        held.append(text[start:at + 1])
                        put(WHOLE if opened else GOES_ON, "".join(held))
                        held, start, going, opened = [], at + 1, False, False
                    elif level == 2 and token == "[" and deep == 2 and place.in_data:
                        start, was_data = at + 1, True
                    elif level == 2 and token == "]" and deep == 1 and was_data:
                        if text[start:at].strip(" \t\r\n,"):
                            raise ValueError(f"{file}: a list element that is no object: {text[start:at].strip()[:40]!r}")
                        was_data = False
                if going:
                    held.append(text[start:])
                elif level == 1 or (level == 2 and place.in_data):
                    between(text[start:])
                if size > PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, _CUT)
                    out, size = [], 0
            if held:
                put(STARTS if opened else GOES_ON, "".join(held))
            yield pa.RecordBatch.from_pylist(out, _CUT)

    found = scratch_table(known(marked, "in_data", "has_data").mapInArrow(
        cut, "file string, blk long, n long, kind int, first boolean, text string"), "records")
    rows = joined_records(found, "").join(
        F.broadcast(placed.groupBy("file").agg(F.first("lead").alias("lead"))), "file")

    def lines(batches):
        for batch in batches:
            out = []
            for text, lead in zip(batch.column("text").to_pylist(), batch.column("lead").to_pylist()):
                if lead not in ("[", "{"):
                    text = text.strip("﻿ \t\r\n")
                    value = json.loads(text)
                    text = json.dumps({"value": value if isinstance(value, str) or value is None else text})
                out.append(re.sub(r"[\r\n]+", " ", text.replace("﻿", "")))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(out, pa.string())], names=["file", "text"])

    return rows.select("file", "text", "lead").mapInArrow(lines, "file string, text string")
