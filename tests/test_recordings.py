import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from quillwave.sources import recordings
from quillwave.sources.recordings import Header, RecordingReader, notes_of

RATE = 4
# Values on the 65,536 steps between the two ends.
LOW, HIGH = -327.68, 327.67


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grid"))
    data = [(s, r, p, [((s * 7 + r * 5 + p * c) % 3000) / 100.0 for c in (1, -2, 3)]) for s, n in ((1, 30), (2, 9), (12, 41)) for r in (3, 4, 14) for p in range(n)]
    data += [(5, 3, 0, [1.0, 2.0, 3.0]), (5, 3, 13, [4.0, 5.0, 6.0])]
    samples = spark.createDataFrame(data, "subject int, run int, place long, values array<double>").repartition(5)
    notes = [(s, r, o, 1.5, c) for s in (1, 12) for r in (3, 14) for o, c in ((0.0, "T0"), (2.25, "T1"), (2.5, "naïve"), (5.0, "T2"))]
    annotations = spark.createDataFrame(notes, "subject int, run int, onset double, duration double, code string")
    done = recordings.write_recordings(samples, annotations, path, RATE, LOW, HIGH)
    return path, data, notes, rows(done.drop("path"))


def padded(data):
    """Whole seconds, zeros where nothing was written."""
    out = {}
    for s, r, p, v in data:
        out.setdefault((s, r), {})[p] = v
    for (s, r), own in out.items():
        for p in range(-(-(max(own) + 1) // RATE) * RATE):
            yield (s, r, round(p / RATE, 5), *own.get(p, [0.0, 0.0, 0.0]))


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_grid_read_back(spark, grid, size):
    path, data, notes, done = grid
    got = recordings.scan(spark, path, partition_bytes=size)
    assert (got.rdd.getNumPartitions() > 10) == (size == 700)
    flat = [(r.subject, r.run, r.t, *(round(v, 6) for v in r["values"])) for r in got.collect()]
    assert sorted(flat) == sorted(padded(data))
    assert (1, 3, 8) in done and (5, 3, 4) in done
    assert rows(recordings.scan(spark, path, partition_bytes=size, content="annotations")) == sorted(notes, key=lambda r: tuple((False, str(v)) for v in r))


def test_filters_prune_files(spark, grid):
    path, data, *_ = grid
    picked = recordings.scan(spark, path).where("subject = 12 AND run IN (3, 14) AND t < 1")
    assert picked.rdd.getNumPartitions() == 2
    assert sorted({(r.subject, r.run) for r in picked.collect()}) == [(12, 3), (12, 14)]
    assert recordings.scan(spark, path).where("subject = 12 AND subject = 1").count() == 0
    reader = RecordingReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("subject",), 1), In(("run",), (4, 14)), GreaterThan(("t",), 1.0)]))
    assert left == [GreaterThan(("t",), 1.0)]
    assert [(p.subject, p.run) for p in reader.partitions()] == [(1, 4), (1, 14)]


def test_headers_and_annotations():
    header = Header(3, 1.0, ("C0", recordings.NOTES_LABEL), (LOW, -1.0), (HIGH, 1.0), (4, 20))
    raw = header.packed()
    assert len(raw) == header.bytes == 768
    assert Header.parsed(raw[:256], raw[256:]) == header
    data = bytes(8) + b"+0\x14\x14\x00+1.5\x152\x14T1\x14T2\x14\x00".ljust(40, b"\x00")
    assert list(notes_of(header, data)) == [(1.5, 2.0, "T1"), (1.5, 2.0, "T2")]


def test_broken_files(spark, grid, folder):
    path, *_ = grid
    whole = open(f"{path}/S001/S001R03.edf", "rb").read()
    for number, cut in enumerate((100, len(whole) - 5)):
        with open(f"{folder}/S00{number + 1}R03.edf", "wb") as file:
            file.write(whole[:cut])
    for subject in (1, 2):
        with pytest.raises(Exception, match="cut off"):
            recordings.scan(spark, folder).where(F.col("subject") == subject).collect()


def test_too_many_annotations(spark, folder):
    samples = spark.createDataFrame([(1, 3, 0, [0.0])], "subject int, run int, place long, values array<double>")
    notes = spark.createDataFrame([(1, 3, 0.5, 1.0, "x" * 300)], "subject int, run int, onset double, duration double, code string")
    with pytest.raises(Exception, match="more than 240"):
        recordings.write_recordings(samples, notes, folder, 4, -1.0, 1.0)


def test_a_recording_stays_in_one_task(spark, folder, monkeypatch):
    """A join to the lengths may be turned into a broadcast, and then a recording was left to several tasks."""
    places = spark.range(0, 6000, 1, 6).selectExpr("CAST(id % 300 AS int) AS subject", "3 AS run", "id DIV 300 AS place", "array(CAST(id % 7 AS double)) AS values")
    nobody = spark.sql("SELECT CAST(NULL AS int) AS subject, 3 AS run, 0L AS place, array(1D) AS values")
    notes = spark.createDataFrame([], "subject int, run int, onset double, duration double, code string")
    settled, settle = [], recordings.settle
    monkeypatch.setattr(recordings, "settle", lambda df: settled.append(df) or settle(df))
    done = recordings.write_recordings(places.union(nobody), notes, folder, 1, LOW, HIGH)
    assert rows(done, "subject", "seconds") == sorted(((s, 20) for s in range(300)), key=lambda r: tuple((False, str(v)) for v in r))
    assert recordings.scan(spark, folder).count() == 6000
    above = plan(settled[-1]).split("MapInArrow")[1].split("Exchange")[0]
    assert "Window" in above and "Join" not in above
