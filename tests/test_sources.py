import json
import os
import tempfile

from tablesight.sources import readers as R


def _tmp(name, content):
    d = tempfile.mkdtemp(prefix="tablesight-src-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return d, p


def test_delimited_semicolon_bom_odd_headers_and_bad_rows(spark):
    text = "﻿Order Id;Net Price ($);Net Price ($);note\n1;2.5;3;a\n2;4;5\n3;1;1;x;EXTRA\n4;\"7;5\";1;q\n"
    _, p = _tmp("t.csv", text)
    df = R.read_delimited(spark, p)
    assert df.columns == ["Order Id", "Net Price ___", "Net Price _____2", "note"]
    rows = sorted(tuple(r) for r in df.collect())
    assert [r[0] for r in rows] == [1, 2, 4]          # the long row is dropped
    assert rows[1][3] is None                          # the short row is padded


def test_detect_delimiters_per_file(spark):
    d = tempfile.mkdtemp(prefix="tablesight-delim-")
    for name, sep in (("a.csv", ","), ("b.csv", "\t"), ("c.csv", "|")):
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(sep.join(["x", "y", "z"]) for _ in range(30)) + "\n")
    got = {os.path.basename(r.file): r.delimiter for r in R.detect_delimiters(spark, d).collect()}
    assert got == {"a.csv": ",", "b.csv": "\t", "c.csv": "|"}


def test_jsonl_blank_and_bad_lines(spark):
    _, p = _tmp("t.jsonl", '{"a": 1, "b": {"c": 2}}\n\n   \nnot json\n{"a": 3, "b": {"c": 4}}\n')
    df = R.read_jsonl(spark, p)
    rows = sorted([(r["a"], r["b.c"], r["raw"]) for r in df.collect()], key=str)
    assert len(rows) == 3
    assert (None, None, "not json") in rows and (1, 2, None) in rows


def test_json_document_forms(spark):
    _, p1 = _tmp("list.json", json.dumps([{"a": 1, "n": {"x": 2}}, {"a": 2, "n": {"x": 3}}]))
    _, p2 = _tmp("data.json", json.dumps({"meta": 1, "data": [{"a": 5}, {"a": 6}]}))
    _, p3 = _tmp("one.json", json.dumps({"a": 9, "n": {"x": 1}}))
    assert sorted(r["n.x"] for r in R.read_json_table(spark, p1).collect()) == [2, 3]
    assert sorted(r["a"] for r in R.read_json_table(spark, p2).collect()) == [5, 6]
    assert R.read_json_table(spark, p3).count() == 1


def test_documents_whole_files(spark):
    d, _ = _tmp("a.txt", "line one\nline two\n")
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write("other")
    got = sorted(r.text for r in R.read_documents(spark, d).collect())
    assert got == ["line one\nline two\n", "other"]


def test_repair_header():
    from tablesight.functions.naming import HEADER, NORMALIZED, SANITIZED, clean_names
    assert clean_names(["\ufeffa", "a", "x\ny", "", "é!"], HEADER) == ["a", "a__2", "x y", "col", "é_"]
    assert clean_names(["a", "a__2", "a"], HEADER) == ["a", "a__2", "a__3"]
    assert clean_names([" Net\t Price ($) ", "É"], NORMALIZED) == ["net_price_", "col"]
    assert clean_names([" Net\t Price ($) ", "Qty-x"], SANITIZED) == ["Net_Price_", "Qty-x"]


def test_quotes_breaks_and_long_rows(spark):
    _, p = _tmp("q.csv", 'a,b\n1,"two\nlines"\n2,"say ""hi"", now"\n3,x,\n4,x,y\n5\n6,"p,q"\n')
    rows = {r.a: r.b for r in R.read_delimited(spark, p).collect()}
    assert rows == {1: "two\nlines", 2: 'say "hi", now', 5: None, 6: "p,q"}


def test_each_file_by_its_own_delimiter(spark):
    d, _ = _tmp("a.csv", "x,y\n1,2\n3,4\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("x;y\n5;6\n7;8\n")
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write("y;z\n9;w\n")
    rows = sorted((tuple(r) for r in R.read_delimited(spark, d).select("x", "y", "z").collect()), key=str)
    assert rows == [(1, 2, None), (3, 4, None), (5, 6, None), (7, 8, None), (None, 9, "w")]


def test_json_scalars(spark):
    d, _ = _tmp("a.json", "42")
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write('"text"')
    assert sorted(r.value for r in R.read_json_table(spark, d).collect()) == ["42", "text"]
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write('{"k": 1}')
    assert sorted((r.k, r.value) for r in R.read_json_table(spark, d).collect() if r.k) == [(1, None)]


def test_cap_needs_an_order(spark):
    import pytest
    with pytest.raises(ValueError):
        R.cap_rows(spark.range(5), 2)
    assert [r.id for r in R.cap_rows(spark.range(5), 2, ["id"]).collect()] == [0, 1]


def test_cleaned_csv_round_trip(spark, tmp_path):
    from tablesight.sources.sinks import write_cleaned
    rows = [(1, 'a "b" c'), (2, "x\ny"), (3, "back\\slash"), (4, None)]
    write_cleaned(spark.createDataFrame(rows, "k int, t string"), f"{tmp_path}/out")
    assert sorted(tuple(r) for r in R.read_delimited(spark, f"{tmp_path}/out", sep=",").collect()) == rows


def test_no_scratch_folder_of_one_machine_on_a_cluster():
    import pytest

    from tablesight import session

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Spark())


def _in_small_ranges(spark, size, run):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return run()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inside_quotes():
    from tablesight.sources.records import inside_quotes
    assert inside_quotes('a,"b', ",", False) and not inside_quotes('a,"b"', ",", False)
    assert not inside_quotes('5" pipe,x', ",", False) and inside_quotes('x,"say ""hi""', ",", False)
    assert inside_quotes("no quote", ",", True) and not inside_quotes('end",b', ",", True)
    assert inside_quotes('end","b', ",", True) and not inside_quotes('"",""', ",", False)


def test_one_file_with_breaks_is_read_by_many_tasks(spark):
    import csv
    import io
    import random

    from tablesight.sources import records
    rnd = random.Random(4)
    pieces = ["plain", 'a "quoted" word', "two\nlines", '"', "x,y", "\n\n", "5\" pipe, \"", "", "é\n\"\"\n"]
    rows = [(str(i), "".join(rnd.choices(pieces, k=rnd.randrange(4))), "z" * rnd.randrange(30)) for i in range(400)]
    rows[200] = ("200", "long\n" * 2000, "")   # longer than several ranges
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "na\nme", "z"])
    w.writerows(rows)
    out.write('400,5" pipe,q\n')
    _, p = _tmp("big.csv", out.getvalue())
    want = sorted([(i, n or None, z or None) for i, n, z in rows] + [("400", '5" pipe', "q")])
    for size in (700, 5000, 10 ** 8):
        def read():
            tasks = records.ranges(spark, [p], "\n").rdd.getNumPartitions()
            df = R.read_delimited(spark, p, sep=",", infer_types=False)
            return tasks, df.columns, sorted(tuple(r) for r in df.collect())
        tasks, columns, got = _in_small_ranges(spark, size, read)
        assert columns == ["id", "na me", "z"] and got == want
        assert tasks > 1 or size > 5000


def test_types_of_a_file_with_breaks(spark):
    _, p = _tmp("t.csv", 'a,b,c,d,e,t\n1,3000000000,1.5,2024-01-02,true,"x\ny"\n2,4,,2024-01-03,FALSE,2024-01-01 10:00:00\n')
    df = R.read_delimited(spark, p)
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "bigint", "double", "date", "boolean", "string"]


def test_json_folder_of_mixed_documents(spark):
    d, _ = _tmp("a.json", json.dumps({"meta": {"data": [9]}, "data": [{"a": 1, "s": "}] {\"data\": ["}, {"a": 2}], "z": [[{}]]}))
    for name, text in (("b.json", '{"a": 7}'), ("c.json", ' [ {"a": 8, "n": {"x": "}"}} ,\n{"a": 9} ]\n'), ("d.json", "[]"),
                       ("e.json", '{"data": []}'), ("f.json", '{"data": {"a": 1}, "a": 10}\n')):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    rows = R.read_json_table(spark, d)
    assert sorted(r["a"] for r in rows.collect()) == [1, 2, 7, 8, 9, 10]
    assert {r["s"] for r in rows.collect()} == {None, '}] {"data": ['}


def test_one_large_document_is_read_by_many_tasks(spark):
    import random

    from tablesight.sources import records
    rnd = random.Random(2)
    texts = ["}", "{", "]", "[", '"', "\\", "data", ": [", "\n", "é", "plain words", ""]
    items = [{"k": i, "t": "".join(rnd.choices(texts, k=6)), "n": {"l": [1, {"m": rnd.choice(texts)}]}} for i in range(300)]
    items[100]["t"] = "}{" * 3000
    for doc in (items, {"before": {"x": "}"}, "data": items, "after": [{"y": [1]}]}):
        for indent in (None, 1):
            _, p = _tmp("big.json", json.dumps(doc, indent=indent))
            for size in (900, 10 ** 8):
                def read():
                    tasks = records.ranges(spark, [p], "}").rdd.getNumPartitions()
                    return tasks, {r["k"]: r["t"] for r in R.read_json_table(spark, p).select("k", "t").collect()}
                tasks, got = _in_small_ranges(spark, size, read)
                assert got == {x["k"]: x["t"] for x in items} and (tasks > 1) == (size == 900)


def test_json_that_is_no_table_is_an_error(spark):
    import pytest
    for text in ("[1, 2]", '[{"a": 1}, 2]', '[{"a": 1}, null]', '{"data": [{"a": 1}, 5]}', '{"a": 1', '[{"a": 1}', '[[{"a": 1}]]',
                 '{"a": 1}]', '{"a": }'):
        _, p = _tmp("bad.json", text)
        with pytest.raises(Exception):
            R.read_json_table(spark, p).collect()


def test_undecodable_bytes_and_unknown_kinds(spark):
    d = tempfile.mkdtemp(prefix="tablesight-src-")
    with open(os.path.join(d, "a.txt"), "wb") as f:
        f.write(b"caf\xe9 \xef\xbf\xbd ok\xff")
    assert [r.text for r in R.read_documents(spark, d).collect()] == ["caf � ok"]
    _, table = _tmp("t.dat", "a;b\n1;2\n3;4\n")
    assert R.open_source(spark, table).columns == ["a", "b"]
    _, prose = _tmp("t.note", "some words\nand more\n")
    assert R.open_source(spark, prose).columns == ["path", "text"]
