import pytest
from pyspark.sql import functions as F

from tonewright.sources import lexicons, metrics_store, texts


def test_labelled_text(spark, tmp_path):
    lines = "Profit rose @ Nokia@positive\n  Résultat plat@neutral \nno label here\n"
    (tmp_path / "Sentences_AllAgree.txt").write_bytes(lines.encode("latin-1"))
    got = texts.read_labelled_text(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.sentence, r.label) for r in got] == [
        ("Profit rose @ Nokia", "positive"), ("Résultat plat", "neutral")]
    with pytest.raises(ValueError):
        texts.read_labelled_text(spark, str(tmp_path), "NoneAgree")


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_splits_round_trip(spark, tmp_path, kind):
    rows = [('He said "no", twice', 0, "train"), ("two\nlines", 1, "val"), ("x", 2, "train")]
    df = spark.createDataFrame(rows, "sentence string, label int, split string")
    texts.write_splits(df, str(tmp_path / kind), kind)
    got = texts.read_split(spark, str(tmp_path / kind), "train", kind).collect()
    assert sorted((r.sentence, r.label) for r in got) == [('He said "no", twice', 0), ("x", 2)]
    assert texts.read_split(spark, str(tmp_path / kind), "val", kind).first().sentence == "two\nlines"


def test_texts_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("  café  \n\n x\n".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("café\nplain\n".encode("latin-1"))
    assert [r.text for r in texts.read_texts(spark, str(tmp_path / "a.txt")).collect()] == ["café", "x"]
    got = texts.read_texts_any_encoding(spark, f"{tmp_path}/*.txt").collect()
    assert sorted(r.text for r in got) == ["café", "café", "plain", "x"]
    (tmp_path / "c.csv").write_bytes("id,text\n1,naïve\n2,\n".encode("latin-1"))
    df = texts.read_csv_any_encoding(spark, str(tmp_path / "c.csv"), "text")
    assert [r.text for r in df.collect()] == ["naïve"]
    with pytest.raises(ValueError):
        (tmp_path / "x.pdf").write_text("x")
        texts.read_texts(spark, f"{tmp_path}/x.pdf")


def test_folders_and_globs(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\n\n")
    (tmp_path / "t" / "b.txt").write_text("two\n")
    for where in (tmp_path / "t", f"{tmp_path}/t/*.txt", f"{tmp_path}/t/*"):
        assert sorted(r.text for r in texts.read_texts(spark, str(where)).collect()) == ["one", "two"]
    df = spark.createDataFrame([("a\nb", 1)], "text string, predicted_class int")
    texts.write_predictions(df, str(tmp_path / "out"))
    assert texts.read_texts(spark, str(tmp_path / "out")).first().text == "a\nb"
    (tmp_path / "t" / "c.csv").write_text("text\nx\n")
    with pytest.raises(ValueError):
        texts.read_texts(spark, str(tmp_path / "t"))


def test_csv_encoding_is_found_for_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,text\n1,café\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,text\n2,naïve\n3,\n".encode("latin-1"))
    got = texts.read_csv_any_encoding(spark, f"{tmp_path}/*.csv", "text")
    assert sorted((r.id, r.text) for r in got.collect()) == [("1", "café"), ("2", "naïve")]
    assert got.columns == ["id", "text"]


def test_line_numbers_follow_files_and_lines(spark, tmp_path):
    (tmp_path / "b.txt").write_text("b0@neutral\n" + "x" * 300 + "\n" + "b2@positive\n")
    (tmp_path / "a.txt").write_text("\n".join(f"a{i} {'y' * i}@negative" for i in range(40)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("128m", "97b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = texts.read_labelled_text(spark, f"{tmp_path}/*.txt", None).orderBy("doc_id").collect()
            seen.append([(r.doc_id, r.sentence.split(" ")[0]) for r in got])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == [(i, f"a{i}") for i in range(40)] + [(40, "b0"), (42, "b2")]
    assert seen[1] == seen[0]


def test_predictions_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a,b", "positive", 2, 0.9)],
                               "text string, predicted_label string, predicted_class int, confidence double")
    texts.write_predictions(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first().text == "a,b"
    row = spark.createDataFrame([("baseline_svm", *[0.5] * 7)], metrics_store.METRIC_SCHEMA)
    metrics_store.write_metrics(row, str(tmp_path / "m"))
    stored = metrics_store.read_metrics(spark, str(tmp_path / "m"))
    names = spark.createDataFrame([("baseline_svm",), ("baseline_mlp",), ("mine",)], "model string")
    info = {r.model: r for r in metrics_store.model_info(names, stored).collect()}
    assert info["baseline_svm"].accuracy == "50.0%" and info["baseline_svm"].type == "linear"
    assert info["baseline_mlp"].accuracy == "N/A" and info["mine"].type == "Unknown"


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("category,term\npositive,Gain\npositive,gain\nother,x\n")
    assert [tuple(r) for r in lexicons.read_lexicon(spark, str(tmp_path / "l.csv")).collect()] == [
        ("positive", "gain")]
    (tmp_path / "m.csv").write_text(
        "Word,Negative,Positive,Uncertainty,Litigious\nLOSS,2009,0,0,0\nMAY,0,0,2009,-2020\n")
    got = lexicons.read_master_dictionary(spark, str(tmp_path / "m.csv")).collect()
    assert sorted(map(tuple, got)) == [("negative", "loss"), ("uncertainty", "may")]


@pytest.mark.parametrize("split_bytes", [16, 1 << 20])
def test_csv_with_quoted_breaks_is_read_in_splits(spark, tmp_path, split_bytes):
    first = ('id,text\r\n1,"one\r\ntwo, ""so"" he said\n\n"\r\n2,plain\r\n\r\n3,"a ""b"" c"\r\n'
             '4,"\n\n\n"\r\n5,"' + "long line\n" * 40 + '"\r\n6,\r\n7,"x,y"')
    second = 'id,text\n8,"na\u00efve\nend"\n9,z\n'
    (tmp_path / "a.csv").write_bytes(first.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(second.encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        got = {r.id: r.text for r in texts.read_csv_any_encoding(spark, f"{tmp_path}/*.csv", "text").collect()}
        plain = spark.read.options(**texts.csv_options(True)).csv(str(tmp_path / "a.csv"))
        # Spark's own whole-file parser turns quoted CR LF into LF; the bytes are kept here
        same = texts.read_texts(spark, str(tmp_path / "a.csv"))
        same = same.select("id", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"))
        assert sorted(map(str, same.collect())) == sorted(map(str, plain.collect()))
        parts = spark.read.text(str(tmp_path / "a.csv"), lineSep="\n").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {
        "1": 'one\r\ntwo, "so" he said\n\n', "2": "plain", "3": 'a "b" c', "4": "\n\n\n",
        "5": "long line\n" * 40, "7": "x,y", "8": "na\u00efve\nend", "9": "z"}
    assert (parts > 8) == (split_bytes < 100)


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    assert texts.read_texts(spark, str(tmp_path / "a.csv")).collect() == []
