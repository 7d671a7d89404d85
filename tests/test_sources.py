import json

from labelmill.operators import scoring
from labelmill.sources import readers, writers
from labelmill.streaming.incremental import prepare_stream


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_splits_and_tag_map(spark, tmp_path):
    (tmp_path / "splits").mkdir()
    (tmp_path / "splits" / "train.txt").write_text("1\n 2 \n\n")
    (tmp_path / "splits" / "test.set.txt").write_text("2\n")
    got = sorted(tuple(r) for r in readers.read_splits(spark, str(tmp_path / "splits")).collect())
    assert got == [("1", "train"), ("2", "test.set"), ("2", "train")]
    (tmp_path / "tags.csv").write_text("t1, abuse\nt1,death\na,b,c\n")
    good, bad = readers.read_tag_map(spark, str(tmp_path / "tags.csv"))
    assert sorted(tuple(r) for r in good.collect()) == [("t1", "abuse"), ("t1", "death")]
    assert [r["line"] for r in bad.collect()] == ["a,b,c"]


def test_prediction_folder_is_one_scan(spark, tmp_path):
    lines(tmp_path / "svm-fine.jsonl", [{"work_id": "1", "truth": [1, 0], "predictions": [1, 1]}])
    lines(tmp_path / "net-coarse.jsonl", [{"work_id": "1", "labels": [1.0, 0.0], "prediction": [0, 0]}])
    got = scoring.unify(readers.read_predictions(spark, str(tmp_path))).collect()
    assert {r["model"]: (r["truth"], r["pred"]) for r in got} == {
        "svm-fine": ([1, 0], [1, 1]), "net-coarse": ([1, 0], [0, 0])}


def test_label_set_and_prepared_splits(spark, tmp_path):
    (tmp_path / "labels.json").write_text('["a",\n "b"]')
    assert readers.read_label_set(spark, str(tmp_path / "labels.json")) == ["a", "b"]
    for name in ("train", "test"):
        lines(tmp_path / f"{name}.jsonl", [{"work_id": name, "text": "x", "labels": [1]}, {"work_id": "n", "text": "y"}])
    df = readers.read_prepared(spark, train=str(tmp_path / "train.jsonl"), test=str(tmp_path / "test.jsonl"))
    assert df.filter("split = 'train'").count() == 2 and df.filter("labels is null").count() == 2


def test_hydrated_sink(spark, tmp_path):
    works = spark.createDataFrame([("1", ["x"]), ("2", ["y"]), ("3", ["z"])], "work_id string, text array<string>")
    splits = spark.createDataFrame([("1", "train"), ("1", "small"), ("2", "test")], "work_id string, split string")
    writers.write_hydrated(works, splits, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "corpus")).count() == 3
    got = spark.read.json(str(tmp_path / "out" / "splits"))
    assert sorted((r["work_id"], r["split"]) for r in got.collect()) == [("1", "small"), ("1", "train"), ("2", "test")]


def test_json_sinks(spark, tmp_path):
    writers.write_labels(spark.createDataFrame([("1", ["a"])], "work_id string, labels array<string>"),
                         str(tmp_path / "labels"))
    assert spark.read.json(str(tmp_path / "labels")).first()["labels"] == ["a"]
    writers.write_scores(spark.createDataFrame([("m", 0.5)], "model string, mac_f1 double"), str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores")).count() == 1


def test_prepare_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", [{"work_id": "1", "text": ["<p>Hi</p>"], "warnings_coarse_open": ["abuse"]}])

    def run():
        prepare_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"),
                       "warnings_coarse_open").awaitTermination()
        return sorted(r["work_id"] for r in spark.read.schema("work_id string, text string").json(
            str(tmp_path / "out")).collect())

    assert run() == ["1"]
    lines(tmp_path / "in" / "b.jsonl", [{"work_id": "2", "text": ["x"], "warnings_coarse_open": []}])
    assert run() == ["1", "2"]
