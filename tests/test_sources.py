import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import plan, rows
from quillwave.sources import files, folders, sinks


def test_tsv_keeps_null_like_words(spark, folder):
    path = f"{folder}/train.tsv"
    with open(path, "w") as out:
        out.write('PhraseId\tPhrase\tSentiment\n1\tNone\t2\n2\tNA\t1\n3\t"a ""quoted""\ttab"\t0\n4\tnull\t4\n')
    got = rows(files.read_tsv(spark, path, files.PHRASES))
    assert got == [(1, "None", 2), (2, "NA", 1), (3, 'a "quoted"\ttab', 0), (4, "null", 4)]


def test_csv_quoted_newline_and_comma(spark, folder):
    path = f"{folder}/train.csv"
    with open(path, "w") as out:
        out.write('id,text,target\n1,"line one\nline two, ""x""",1\n2,plain,0\n')
    assert rows(files.read_csv(spark, path, files.TWEETS)) == [(1, 'line one\nline two, "x"', 1), (2, "plain", 0)]


def test_delimited_round_trip(spark, folder):
    texts = [' spaced ', 'a "b" c', 'tab\there', 'new\nline', 'back\\slash', '\\"', 'None', '#x', "'", ',', 'é']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sinks.write_delimited(df, f"{folder}/out")
    assert rows(files.read_csv(spark, f"{folder}/out", "id int, text string")) == sorted(enumerate(texts), key=lambda r: str(r[0]))


def test_last_vector_line_wins(spark, folder):
    os.makedirs(f"{folder}/v")
    with open(f"{folder}/v/part-0", "w") as out:
        out.write("cat 1 2\ndog 3 4\ncat 5.5 6\n\n")
    with open(f"{folder}/v/part-1", "w") as out:
        out.write("dog 7 8\n" + "filler 0 0\n" * 2000)
    got = {r.word: list(r.vector) for r in files.read_word_vectors(spark, f"{folder}/v").collect()}
    assert got == {"cat": [5.5, 6.0], "dog": [7.0, 8.0], "filler": [0.0, 0.0]}


def test_word_vectors_round_trip(spark, folder):
    df = spark.createDataFrame([("a", [0.1, -3.0e-8]), ("b", [1.5, 2.0])], "word string, vector array<float>")
    sinks.write_word_vectors(df, f"{folder}/v")
    assert rows(files.read_word_vectors(spark, f"{folder}/v")) == rows(df)


def test_submission_single_file_and_alignment(spark, folder):
    template = spark.createDataFrame([(3, 0), (1, 0), (2, 0)], "id int, target int")
    predicted = spark.createDataFrame([(2, 1), (1, 0), (9, 1)], "id int, target int")
    out = sinks.align_submission(template, predicted, "id", "target")
    sinks.write_submission(out, f"{folder}/s", "id", "target", single_file=True)
    parts = [p for p in os.listdir(f"{folder}/s") if p.startswith("part-")]
    assert len(parts) == 1
    assert open(f"{folder}/s/{parts[0]}").read().splitlines() == ["id,target", "1,0", "2,1", "3,"]


def test_recordings_prune_runs_and_names(spark, folder):
    df = spark.createDataFrame(
        [(0.0, "T1", [1.0], 1, 3), (0.0, "T0", [2.0], 1, 2)], files.RECORDING
    )
    df.write.partitionBy("subject", "run").parquet(f"{folder}/r")
    read = files.read_recordings(spark, f"{folder}/r")
    assert rows(files.recording_name(read), "run", "path") == [(3, "S001/S001R03.edf")]
    assert "PartitionFilters: [run" in plan(read)


def test_a_recording_is_one_file(spark, folder):
    views = spark.range(0, 400, 1, 8).selectExpr("id / 10D AS t", "'T0' AS marker", "array(1D) AS values", "CAST(id % 20 AS int) AS subject", "3 AS run")
    sinks.write_recordings(views, f"{folder}/r")
    found = [f for _, _, names in os.walk(f"{folder}/r") for f in names if f.endswith(".parquet")]
    assert len(found) == 20
    assert files.read_recordings(spark, f"{folder}/r").count() == 400


def _recordings(spark):
    """Forty recordings of ten rows, four without a subject."""
    return spark.range(0, 400, 1, 8).selectExpr(
        "id / 10D AS t", "IF(id % 7 = 0, NULL, 'T0') AS marker", "IF(id % 9 = 0, NULL, array(1D, id, NULL)) AS values",
        "CAST(IF(id % 20 = 19, NULL, id % 20) AS int) AS subject", "CAST(3 + id % 2 + 4 * (id DIV 200) AS int) AS run",
    )


def test_the_driver_does_not_hold_the_files_of_recordings(spark, folder):
    written = _recordings(spark)
    sinks.write_recordings(written, f"{folder}/r")
    read = files.read_recordings(spark, f"{folder}/r")
    assert rows(read) == rows(written.select(*read.columns))
    # 40 files; what the driver knows are the lists of the four tasks.
    assert 0 < len(read.inputFiles()) <= 4
    assert not [f for f in read.inputFiles() if f.endswith(".parquet")]
    # The tree is one that Spark takes, too.
    plain = spark.read.schema(files.RECORDING).parquet(f"{folder}/r")
    assert plain.schema == read.schema and rows(plain) == rows(read)


def test_recordings_that_are_not_wanted_are_not_opened(spark, folder):
    sinks.write_recordings(_recordings(spark), f"{folder}/r")
    for spoilt in ("subject=2/run=3", "subject=2/run=7", "subject=1/run=8"):
        for name in os.listdir(f"{folder}/r/{spoilt}"):
            os.remove(f"{folder}/r/{spoilt}/{name}")
    read = files.read_recordings(spark, f"{folder}/r", (3, 4, 7), lambda found: found.where("subject <> 2"))
    want = _recordings(spark).where("run IN (3, 4, 7) AND subject <> 2")
    assert rows(read) == rows(want.select(*read.columns))


def test_a_long_recording_is_read_in_parts(spark, folder):
    written = spark.range(0, 60_000, 1, 3).selectExpr("id / 10D AS t", "'T0' AS marker", "array(1D, id) AS values", "CAST(id % 2 AS int) AS subject", "3 AS run")
    folders.write(written, f"{folder}/r", group_bytes=100_000)
    listed = spark.read.schema(folders.LISTED).json(f"{folder}/r/_files")
    assert [r.parts > 1 for r in listed.collect()] == [True, True]
    read = files.read_recordings(spark, f"{folder}/r")
    assert rows(read) == rows(written.select(*read.columns))


def test_recordings_without_rows_and_where_some_are(spark, folder):
    sinks.write_recordings(_recordings(spark).where("t < 0"), f"{folder}/r")
    assert files.read_recordings(spark, f"{folder}/r").count() == 0
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        sinks.write_recordings(_recordings(spark), f"{folder}/r")


def test_names_of_folders_are_those_of_spark(spark, folder):
    values = ["a b", "a/b:c", "50%", "[x]='y'", "", None, "é"]
    named = spark.createDataFrame([(1.0, v, 3) for v in values], "t double, subject string, run int")
    sinks.write_recordings(named, f"{folder}/own")
    named.write.partitionBy("subject", "run").parquet(f"{folder}/plain")
    names = [sorted(n for n in os.listdir(f"{folder}/{k}") if "=" in n) for k in ("own", "plain")]
    assert names[0] == names[1] and len(names[0]) == 6


def test_recordings_where_only_spark_can_write(spark, folder, monkeypatch):
    monkeypatch.setattr(folders, "reached", lambda spark, path: False)
    sinks.write_recordings(_recordings(spark), f"{folder}/r")
    read = files.read_recordings(spark, f"{folder}/r", (3,), lambda found: found.where("subject <> 2"))
    assert rows(read) == rows(_recordings(spark).where("run = 3 AND subject <> 2").select(*read.columns))


def test_single_text(spark):
    assert rows(files.single_text(spark, "One short text")) == [(0, "One short text")]


def test_scratch_is_removed(spark):
    from pathlib import Path

    from quillwave import session

    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = Path(path.removeprefix("file:"))
    assert local.exists()
    assert session.remove_scratch(spark) >= 1
    assert not local.exists() and session.remove_scratch(spark) == 0
