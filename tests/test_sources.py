import csv as pycsv
import json
import random

import pytest
from pyspark.sql import functions as F

from accountscope.operators import prep
from accountscope.plans import stages
from accountscope.sources import arff, csv, sinks

SCHEMA = "a STRING, b STRING, c STRING"


def test_short_long_and_quoted_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,2,3\n1,2,3,4\n1,2\n"x ""q"" y",5,6\n1,2,3,4,5\n7,8,9,\n')
    rows = {tuple(r) for r in csv.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect()}
    assert rows == {("1", "2", "3"), ("1", "2", None), ('x "q" y', "5", "6")}
    with pytest.raises(Exception, match="too many fields"):
        csv.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA, surplus="fail").collect()


PROBE = "user STRING, tweet STRING, n STRING"


@pytest.mark.parametrize("multi_line", [None, True, False])
def test_quotes_inside_bare_fields_are_text(spark, tmp_path, multi_line):
    path = tmp_path / "x.csv"
    path.write_text('user,tweet,n\n1,5" tall,1\n2,ok,2\n3,fine,3\n4,"q ""x"" y",4\n')
    rows = {tuple(r) for r in csv.read_csv(spark, str(path), PROBE, multi_line).collect()}
    assert rows == {("1", '5" tall', "1"), ("2", "ok", "2"), ("3", "fine", "3"), ("4", 'q "x" y', "4")}
    path.write_text("user,tweet,n\n" + "".join(f"{i},{'5\" tall' if i == 500 else 'x'},1\n" for i in range(1_000)))
    assert csv.read_csv(spark, str(path), PROBE, multi_line).count() == 1_000


def test_bare_quotes_beside_records_over_lines(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = [(f"{i}", ('say "it' if i % 3 else 'two\nlines "here"'), f"{i % 7}") for i in range(200)]
    quoted = lambda t: t if "\n" not in t else '"' + t.replace('"', '""') + '"'
    (tmp_path / "x.csv").write_text("user,tweet,n\n" + "".join(f"{a},{quoted(b)},{c}\n" for a, b, c in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        found = [tuple(r) for r in csv.read_csv(spark, str(tmp_path), PROBE).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found) == sorted(rows)


def test_open_quote_at_the_end_names_the_file(spark, tmp_path):
    (tmp_path / "broken.csv").write_text('user,tweet,n\n1,"open,2\n3,4,5\n')
    with pytest.raises(Exception, match="open at the end of .*broken.csv"):
        csv.read_csv(spark, str(tmp_path), PROBE).collect()


def test_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tweet,user,n\nhello,7,1\n")
    (tmp_path / "b.csv").write_text("user,tweet,n\nuser,tweet,n\n8,,2\n")
    rows = {tuple(r) for r in csv.read_csv(spark, str(tmp_path), PROBE).collect()}
    assert rows == {("7", "hello", "1"), ("user", "tweet", "n"), ("8", None, "2")}
    for header in ("UserID,Text,n", "user,tweet", "user,tweet,n,more", "user,user,n"):
        (tmp_path / "b.csv").write_text(header + "\n1,2,3\n")
        with pytest.raises(Exception, match="columns of .*b.csv"):
            csv.read_csv(spark, str(tmp_path), PROBE).collect()
    (tmp_path / "b.csv").write_text("")
    assert csv.read_csv(spark, str(tmp_path), PROBE).count() == 1
    bare = csv.read_csv(spark, str(tmp_path / "a.csv"), PROBE, header=False)
    assert bare.count() == 2


def test_first_row_in_file_order(spark, tmp_path):
    (tmp_path / "x.csv").write_text("user,tweet,n\n7,z,9\n7,a,1\n8,b,2\n")
    rows = prep.dedup_key(csv.read_csv(spark, str(tmp_path), PROBE, position="at"), "user", "at").collect()
    assert {(r.user, r.n) for r in rows} == {("7", "9"), ("8", "2")}
    (tmp_path / "x.arff").write_text("@relation t\n@attribute UserID numeric\n@attribute UserType {0,1}\n@attribute n REAL\n@data\n7,1,9\n7,0,1\n")
    static = stages.preprocess_static(arff.read_arff(spark, str(tmp_path / "x.arff"), position="at"), "at")
    assert [(r.user_id, r.user_type, r.n) for r in static.collect()] == [(7, 1, 9.0)] and "at" not in static.columns


def test_default_settings_keep_the_first_row_of_the_file(spark, tmp_path):
    declared = "@relation t\n@attribute UserID numeric\n@attribute UserType {0,1}\n@attribute n REAL\n@data\n"
    (tmp_path / "x.arff").write_text(declared + "7,1,9\n8,0,5\n7,1,1\n8,0,2\n9,1,3\n")
    for name, user in (("p", 7), ("l", 8)):
        (tmp_path / f"{name}.csv").write_text(f"UserID,TweetID,Tweet,CreatedAt\n{user},1,hello,2010-01-01 00:00:00\n")
    raw = stages.read_raw(spark, *(str(tmp_path / n) for n in ("x.arff", "p.csv", "l.csv")))
    static, documents = stages.preprocess(*raw)
    assert sorted((r.user_id, r.n) for r in static.collect()) == [(7, 9.0), (8, 5.0)]
    assert static.columns == ["user_id", "user_type", "n"] and documents.count() == 2
    unordered = stages.preprocess_static(raw[0].drop("file_position"))
    assert sorted((r.user_id, r.n) for r in unordered.collect()) == [(7, 1.0), (8, 2.0), (9, 3.0)]


def test_typed_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n1,2.5\nx,\n")
    rows = csv.read_csv(spark, str(tmp_path), "k BIGINT, v DOUBLE").collect()
    assert {tuple(r) for r in rows} == {(1, 2.5), (None, None)}


@pytest.mark.parametrize("multi_line", [None, True])
def test_records_over_lines_and_blocks(spark, tmp_path, multi_line):
    """Quoted line breaks are joined although files are read in pieces of a few bytes."""
    rng = random.Random(3)
    want = []
    for f in range(3):
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            writer = pycsv.writer(out, lineterminator="\n")
            writer.writerow(["a", "b", "c"])
            for i in range(60):
                text = "".join(rng.choice(['"', "\n", ",", "word ", "é"]) for _ in range(rng.randint(1, 12)))
                row = (f"{f}-{i}", text, rng.choice(["", "z"]))
                writer.writerow(row)
                want.append(row)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = [tuple(r) for r in csv.read_csv(spark, str(tmp_path), SCHEMA, multi_line).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((a, b, c or "") for a, b, c in rows) == sorted(want)


def test_many_files_keep_their_name(spark, tmp_path):
    for name in ("cluster0", "cluster1"):
        (tmp_path / f"{name}.csv").write_text(f"a,b,c\n{name},1,2\n")
    rows = csv.read_csv_many(spark, str(tmp_path), SCHEMA, "frame").collect()
    assert {(r["frame"], r["a"]) for r in rows} == {("cluster0", "cluster0"), ("cluster1", "cluster1")}


def test_arff(spark, tmp_path):
    (tmp_path / "x.arff").write_text(
        "% note\n@RELATION t\n\n@attribute UserID numeric\n@attribute 'User Type' {0,1}\n@attribute n REAL\n"
        "@attribute s string\n@data\n9007199254740993,1,2.5,'a, b'\n% note\n2, 0, ?, plain\n"
    )
    rows = sorted(tuple(r) for r in arff.read_arff(spark, str(tmp_path / "x.arff")).collect())
    assert rows == [("2", "0", None, "plain"), ("9007199254740993", "1", 2.5, "a, b")]
    (tmp_path / "bad.arff").write_text("@relation t\n1,2\n")
    with pytest.raises(ValueError, match="no @data line"):
        arff.read_arff(spark, str(tmp_path / "bad.arff"))


def test_partitioned_write_replaces(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_partitioned(spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "k INT, cluster INT"), path)
    sinks.write_partitioned(spark.createDataFrame([(1, 0), (2, 1)], "k INT, cluster INT"), path, file_format="csv")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["cluster=0", "cluster=1"]


def test_nested_report(spark, tmp_path):
    rows = [(0, "m", "f1", 1, 0.215), (0, "m", "mean", None, 0.5), (0, "n", "f1", 0, 1.0)]
    report = spark.createDataFrame(rows, "cluster INT, model STRING, metric STRING, class INT, value DOUBLE")
    sinks.write_json(report, str(tmp_path / "j"))
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert json.loads(line) == {"cluster0": {"m": {"f1_1": "0.21", "mean": "0.50"}, "n": {"f1_0": "1.00"}}}


def test_line_breaks_inside_quoted_fields_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,t\r\n1,"a\r\nb"\r\n2,"c\nd"\r\n3,plain\r\n\r\n4,"e\rf"\r\n5,"end\r\n"\r\n')
    for multi_line in (None, True):
        got = {r["id"]: r["t"] for r in csv.read_csv(spark, str(tmp_path / "a.csv"), "id INT, t STRING", multi_line).collect()}
        assert got == {1: "a\r\nb", 2: "c\nd", 3: "plain", 4: "e\rf", 5: "end\r\n"}
