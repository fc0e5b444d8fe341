"""CSV values with line breaks and JSON arrays, cut into records by many tasks, against plain parsers."""

from __future__ import annotations

import csv
import gzip
import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dataproof import read_dataset
from dataproof.sources import records
from dataproof.sources.records import ArrayItems, QuotedLines


@pytest.fixture()
def tiny_splits(spark, monkeypatch):
    """Splits of some dozen bytes."""
    monkeypatch.setattr(records, "LEAST_SPLIT", 48)
    spark.conf.set("spark.sql.files.minPartitionNum", 100000)
    yield
    spark.conf.unset("spark.sql.files.minPartitionNum")


def open_after(line, separator):
    """Whether a value is open at the end of a line, character by character."""
    state = "start"
    for c in line:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c == separator else "plain"
        elif state == "quoted":
            state = "quote" if c == '"' else "quoted"
        elif state == "quote" and c == '"':
            state = "quoted"
        else:
            state = "start" if c == separator else "plain"
    return int(state == "quoted")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a",b \r', max_size=14), st.sampled_from([",", "b"]))
def test_lines_as_functions(line, separator):
    cutter = QuotedLines(separator)
    assert cutter.step(line, 0)[0] == open_after(line, separator)
    assert cutter.step(line, 1)[0] == open_after('"' + line, separator)


def write(folder, name, text, compress=False):
    path = f"{folder}/{name}"
    data = text.encode()
    with open(path, "wb") as file:
        file.write(gzip.compress(data) if compress else data)
    return path


def random_table(rng, n):
    def value():
        parts = ["x", "né", '"', ",", "\n", "\r\n", ";", "\n\n", " ", '","', '"\n"', "", "1"]
        return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 9, 60])))

    return [[str(i), value(), value() or "-", f"{i}.5"] for i in range(n)]


def as_csv(rows, header=("id", "a b", "b.c", "x"), ends="\n"):
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=ends)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def found(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_one_csv_file_in_many_tasks(spark, folder, tiny_splits, ends):
    rng = random.Random(5)
    rows = random_table(rng, 120)
    path = write(folder, "a.csv", as_csv(rows, ends=ends))
    cut = records.cut_records(spark, path, QuotedLines(","))
    assert cut.splits > 50
    plain = sorted(as_csv([row]).split("\n", 1)[1].removesuffix("\n") for row in rows)
    assert sorted(r.value for r in cut.rows.where("NOT first").collect()) == plain
    df = read_dataset(spark, path, "csv")
    assert df.dtypes == [("id", "bigint"), ("a b", "string"), ("b.c", "string"), ("x", "double")]
    expected = [(int(a), b or None, c, float(d)) for a, b, c, d in rows]
    assert found(df) == sorted(expected, key=repr)
    assert found(df.select("x").where("x < 9")) == [(i + 0.5,) for i in range(9)]


def test_several_files_and_blank_lines(spark, folder, tiny_splits):
    rng = random.Random(6)
    tables = [random_table(rng, n) for n in (1, 40, 7)]
    for i, rows in enumerate(tables):
        text = as_csv(rows)
        text = "﻿\n\n" + text + "\n\n" if i == 1 else text.removesuffix("\n")
        write(folder, f"{i}.csv", text)
    write(folder, "3.csv.gz", as_csv([["900", "packed\n", "y", "1"]]), compress=True)
    write(folder, "4.csv", as_csv([]))
    df = read_dataset(spark, folder, "csv")
    expected = [(int(a), b or None, c, float(d)) for rows in tables for a, b, c, d in rows] + [(900, "packed\n", "y", 1.0)]
    assert found(df) == sorted(expected, key=repr)


def test_one_value_over_many_splits(spark, folder, tiny_splits):
    long = "\n".join(f"line {i} with \"quotes\", and more" for i in range(200))
    path = write(folder, "a.csv", as_csv([["1", long, "a", "1"], ["2", "b", long, "2"], ["3", "c", "d", "3"]]))
    assert found(read_dataset(spark, path, "csv")) == [(1, long, "a", 1.0), (2, "b", long, 2.0), (3, "c", "d", 3.0)]


def test_csv_that_ends_within_a_value(spark, folder):
    path = write(folder, "a.csv", 'id,a\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="ends within"):
        read_dataset(spark, path, "csv")


def test_quotes_inside_of_plain_values(spark, folder):
    """A quote that does not begin a value opens nothing, and such files keep the scan that columns are pruned in."""
    path = write(folder, "a.csv", 'id,a\n1,3" pipe\n2,5" pipe\n')
    df = read_dataset(spark, path, "csv")
    assert found(df) == [(1, '3" pipe'), (2, '5" pipe')]
    assert "csv" in df._jdf.queryExecution().executedPlan().toString()


def random_json(rng, depth=3):
    if depth == 0 or rng.random() < 0.4:
        return rng.choice([None, True, 7, -0.5, "", "}", "{", "]}", '"', "\\", '\\"}', "é}\n", "[{", ", "])
    if rng.random() < 0.5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("uvw{}\"]"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("indent", [None, 2])
def test_one_json_array_in_many_tasks(spark, folder, tiny_splits, indent):
    rng = random.Random(7)
    items = [{"z": i, "text": rng.choice(["}", "a\"}", "\\", "{[", "é\n"]) * rng.choice([1, 40]), "deep": json.dumps(random_json(rng))} for i in range(80)]
    for item in items[::2]:
        item["nested"] = {"list": [{"k": "}"}] * rng.randrange(3)}
    path = write(folder, "a.json", json.dumps(items, indent=indent, ensure_ascii=False))
    cut = records.cut_records(spark, path, ArrayItems())
    assert cut.splits > 50
    assert sorted((json.loads(r.value) for r in cut.rows.collect()), key=lambda x: x["z"]) == items
    df = read_dataset(spark, path, "json")
    assert df.columns == ["z", "text", "deep", "nested"]
    assert [(r.z, r.text, r.deep) for r in df.orderBy("z").collect()] == [(x["z"], x["text"], x["deep"]) for x in items]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "}", '"']), st.sampled_from([1, "}", '"', "\\", "{", [], [{"b": "]"}], None]), max_size=3), max_size=5), st.sampled_from([None, 1]))
def test_items_end_where_their_brace_is(items, indent):
    """Stepping through the pieces of an array finds its items, and the state tells where a string is open."""
    cutter, held, out, state = ArrayItems(), [], [], (0, None)
    text = json.dumps(items, indent=indent)
    pieces = text.split("}")
    inside, depth = 0, cutter.start_depth(pieces[0])
    for piece in pieces:
        held.append(piece)
        inside, delta = cutter.step(piece, inside)
        depth += delta
        if not inside and depth == 0:
            out.append(json.loads(cutter.record("}".join(held))))
            held = []
    assert out == items and cutter.leftover("}".join(held)) == "" and depth == -2


@pytest.mark.parametrize(
    ("text", "rows"),
    [('{"a": 1}', [(1,)]), (' {"a": 1}\n', [(1,)]), ('[{"a": 1}]\n\n', [(1,)]), ('﻿[{"a":1},\n{"a":2}]', [(1,), (2,)]), ("[]", []), ("[ ]\n", [])],
)
def test_short_json_files(spark, folder, text, rows):
    path = write(folder, "a.json", text)
    assert found(read_dataset(spark, path, "json")) == rows


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1', '{"a": 1', '[{"a": "x}]', '[{"a": 1}}]', '[{"a": {"b": 1}]'])
def test_broken_json_is_an_error(spark, folder, text):
    path = write(folder, "a.json", text)
    with pytest.raises(Exception, match="ends within|Malformed|MALFORMED|FAILFAST"):
        read_dataset(spark, path, "json").collect()


def test_json_files_side_by_side(spark, folder, tiny_splits):
    write(folder, "a.json", json.dumps([{"a": i, "t": "}" * i} for i in range(20)]))
    write(folder, "b.json", json.dumps({"a": 100, "t": "one"}, indent=1))
    write(folder, "c.json", "[]")
    write(folder, "d.json.gz", json.dumps([{"a": 200, "t": "packed"}]), compress=True)
    df = read_dataset(spark, folder, "json")
    assert found(df) == sorted([(i, "}" * i) for i in range(20)] + [(100, "one"), (200, "packed")], key=repr)
