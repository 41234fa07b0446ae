"""One JSON array read by many tasks equals Spark's one-task reader, and what is
written reads back."""
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from rivulet.sources import io, json_array

FIELDS = "id BIGINT, text STRING, nested STRUCT<a: ARRAY<STRUCT<x: STRING>>, b: DOUBLE>"


def records(n, seed=5):
    rng = random.Random(seed)
    signs = ['"', "\\", "{", "}", "[", "]", "\\\"", ",", ":", "\n", "é", "😀", "\\\\", "}{", "word ", "]}", '\\"}']
    say = lambda k: "".join(rng.choice(signs) for _ in range(rng.randrange(0, k)))
    return [{"id": i, "text": say(30) if i % 50 else say(2000), "nested": None if i % 7 == 0 else
             {"a": [{"x": say(4)} for _ in range(rng.randrange(0, 3))], "b": i / 3}} for i in range(n)]


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(rows):
    return sorted((r["id"], r["text"], None if r["nested"] is None else ([x["x"] for x in r["nested"]["a"]], r["nested"]["b"])) for r in rows)


@pytest.mark.parametrize("indent", [None, 2])
def test_array_read_in_many_splits(spark, tmp_path, small_splits, indent):
    rows = records(1200)
    for i, name in enumerate(("a.json", "b.json")):
        with open(tmp_path / name, "w") as f:
            json.dump(rows[i * 600:(i + 1) * 600], f, indent=indent, ensure_ascii=bool(i))
    got = json_array.read_records(spark, str(tmp_path), FIELDS)
    assert plain(got.collect()) == plain(rows)
    assert json_array._pieces(spark, str(tmp_path)).select("file", "split").distinct().count() > 40
    whole = spark.read.schema(FIELDS).option("multiLine", True).json(str(tmp_path))
    assert plain(whole.collect()) == plain(got.collect())
    first = got.where(F.col("file").endswith("a.json")).orderBy("place").select("id").collect()
    assert [r.id for r in first] == list(range(600))  # place gives the order of the file


def test_records_longer_than_splits(spark, tmp_path, small_splits):
    rows = [{"id": i, "text": "}{" * 4000 + str(i), "nested": None} for i in range(6)]
    (tmp_path / "long.json").write_text(json.dumps(rows))
    assert plain(json_array.read_records(spark, str(tmp_path), FIELDS).collect()) == plain(rows)


def test_deeper_records_gzip_and_empty_arrays(spark, tmp_path, small_splits):
    data = [{"question": f"q{i % 40}", "title": f"t{i}", "context": "c } " * i, "example_id": str(i), "question_tokens": ""} for i in range(90)]
    (tmp_path / "gold.json").write_text(json.dumps({"data": data}) + "\n")
    got = {r.question: r.title for r in io.read_gold_file(spark, str(tmp_path / "gold.json")).collect()}
    assert got == {f"q{q}": f"t{max(i for i in range(90) if i % 40 == q)}" for q in range(40)}
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        json.dump(records(30), f)
    assert plain(json_array.read_records(spark, str(tmp_path / "z.json.gz"), FIELDS).collect()) == plain(records(30))
    for name, text in (("e1.json", "[]"), ("e2.json", " [ ] \n")):
        (tmp_path / name).write_text(text)
        assert json_array.read_records(spark, str(tmp_path / name), FIELDS).collect() == []


@pytest.mark.parametrize("text", ['[{"id": 1}', '[{"id": 1},', '[{"id": 1, "text": "a', '{"data": [{"id": 1}'])
def test_files_that_end_too_soon_raise(spark, tmp_path, text):
    (tmp_path / "cut.json").write_text(text)
    with pytest.raises(ValueError, match="not one whole JSON value"):
        json_array.read_records(spark, str(tmp_path), FIELDS)


def test_a_record_that_is_no_json_raises(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id": oops}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        json_array.read_records(spark, str(tmp_path), FIELDS).collect()


def test_arrays_are_written_whole(spark, tmp_path):
    rows = records(300)
    df = spark.createDataFrame([(r["id"], r["text"], r["nested"]) for r in rows], FIELDS)
    for parts in (None, 1):
        json_array.write_array(df.repartition(4), str(tmp_path / "out"), parts=parts)
        files = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
        assert len(files) >= 4 if parts is None else len(files) == 1
        assert plain(r for f in files for r in json.loads(f.read_text())) == plain(rows)
        assert plain(json_array.read_records(spark, str(tmp_path / "out"), FIELDS).collect()) == plain(rows)
    json_array.write_array(df.limit(0), str(tmp_path / "none"), parts=1)
    assert json_array.read_records(spark, str(tmp_path / "none"), FIELDS).collect() == []


def test_a_task_that_fails_leaves_no_array(spark, tmp_path):
    df = spark.range(100).selectExpr("if(id = 77, cast(raise_error('no') as string), cast(id as string)) text")
    with pytest.raises(Exception, match="no"):
        json_array.write_array(df.repartition(3), str(tmp_path / "out"))
    assert not any(f.name.startswith("part-") for f in (tmp_path / "out").glob("*"))
    json_array.write_array(spark.range(100).selectExpr("cast(id as string) text").repartition(3), str(tmp_path / "out"))
    assert json_array.read_records(spark, str(tmp_path / "out"), "text string").count() == 100


def test_readers_of_all_forms(spark, tmp_path):
    rows = [{"id": "1", "text": 'a "b", c', "title": "T"}, {"id": "2", "text": "line\nbreak }", "title": None}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "p.csv").write_text('title,id,text\nT,1,"a ""b"", c"\n,2,"line\nbreak }"\n')
    for kind in ("json", "jsonl", "csv"):
        got = io.read_passages(spark, str(tmp_path / f"p.{kind}"), kind).collect()
        assert sorted((r.id, r.text, r.title) for r in got) == [("1", 'a "b", c', "T"), ("2", "line\nbreak }", None)]
    with pytest.raises(ValueError):
        io.read_passages(spark, str(tmp_path), "xml")
    sample = [{"qid": "1", "question": "q", "answers": ["a"], "positive_ctxs": [{"id": "p", "title": "t", "text": "x"}], "negative_ctxs": [], "hard_negative_ctxs": []}]
    (tmp_path / "train.json").write_text(json.dumps(sample * 3))
    got = io.read_training_files(spark, [str(tmp_path / "train.json")])
    assert got.count() == 3 and got.first().positive_ctxs[0].id == "p" and got.first().source.endswith("train.json")
