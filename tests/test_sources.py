import gzip
import io
import tarfile
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from axisfold.operators.resolve import Catalog
from axisfold.plans.score import compute_scores
from axisfold.plans.spec import ScoreFile, ScorePart, Step
from axisfold.sources import archives, tables
from axisfold.sources.headers import first_cells, header_index
from axisfold.streaming.incremental import current, final, late_rows, score_stream

HEAD = "InBatchEpoch,Board,Chip,Block,Measure,WL,FBC"


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    """Two epochs with different column orders, one gzipped, and one without the second table."""
    root = tmp_path_factory.mktemp("data") / "exp" / "Step1" / "Loop01" / "result_history"
    for no, head in ((1, HEAD), (2, "FBC,WL,Measure,Block,Chip,Board,InBatchEpoch")):
        d = root / f"result.{no:04d}"
        d.mkdir(parents=True)
        names = head.split(",")
        rows = [dict(zip(HEAD.split(","), (0, b, 0, 0, m, w, 100 * no + 10 * b + w), strict=True)) for b in (0, 1) for m in (0, 1) for w in (0, 1)]
        text = "\n".join([head, *[",".join(str(r[c]) for c in names) for r in rows]]) + "\n"
        if no == 2:
            (d / "FBC.csv.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (d / "FBC.csv").write_text(text)
            (d / "KLD.csv").write_text("InBatchEpoch,Board,Chip,SGWLD,KLD\n0,0,0,0,-3\n")
        (d / "parameterLabel_FBC.csv").write_text("InBatchEpoch,Board,Chip,Block,Measure,Read_Label,Read_Override\n0,0,0,0,0,1,0\n0,1,0,0,0,1,0\n0,0,0,0,1,2,1\n0,1,0,0,1,2,1\n,,,,,,\n")
        (d / "map_Label.csv").write_text("1,upper\n2,lower")
        (d / "map_Override.csv").write_text("0,FALSE\n1,TRUE")
        (d / "initial_temperature.csv").write_text("0,25\n1,30.8333\n" if no == 1 else "InBatchEpoch,Temp,Board\n0,25,0\n0,26,0\n0,30,1\n")
    return f"file://{root}"


def test_measurement_columns_are_found_by_name(spark, history):
    df = tables.read_measurement(spark, f"{history}/result.*/FBC.csv*", "FBC")
    assert dict(df.dtypes)["WL"] == "bigint" and dict(df.dtypes)["value"] == "double"
    got = {(r["Epoch"], r["Board"], r["WL"]): r["value"] for r in df.collect()}
    assert got["exp/Step1/Loop01#0002", 1, 1] == 211.0 and got["exp/Step1/Loop01#0001", 1, 0] == 110.0 and df.count() == 16


def test_listing_and_validation(spark, history):
    files = tables.list_files(spark, history)
    epochs = tables.enumerate_epochs(files)
    assert {tuple(r) for r in epochs.collect()} == {(f"exp/Step1/Loop01#000{i}", "exp/Step1/Loop01", i) for i in (1, 2)}
    tables.check_histories(epochs, ["exp/Step1/Loop01"])
    with pytest.raises(ValueError):
        tables.check_histories(epochs, ["exp/Step1/Loop01", "other"])
    lost = {r["Epoch"]: r["reason"] for r in tables.missing_files(epochs, files, ["FBC", "KLD"], temperatures=True).collect()}
    assert lost == {"exp/Step1/Loop01#0002": "missing: KLD"}
    heads = header_index(spark, f"{history}/result.*/*.csv*")
    assert {r["type"] for r in tables.detect_types(heads).collect()} == {"FBC", "KLD"}


def bytes_read(spark, job) -> int:
    """Input bytes of all stages that a job ran, by Spark's own count."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def total() -> int:
        none = jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    before = total()
    job()
    return total() - before


def test_quoted_cells_in_several_layouts_and_one_pass(spark, tmp_path):
    base = tmp_path / "exp" / "Step1" / "Loop01" / "result_history"
    size = 0
    for no, head in ((1, '"Board","WL",X'), (2, 'X,"WL",Board'), (3, "\n\nBoard,X")):
        (base / f"result.{no:04d}").mkdir(parents=True)
        rows = "".join({1: f'"{i}","{i % 7}",0.5\r\n', 2: f'"1.5",{i % 7},{i}\r\n', 3: f"{i},2\n"}[no] for i in range(20_000))
        (base / f"result.{no:04d}" / "X.csv").write_text(head + "\n" + rows, newline="")
        size += (base / f"result.{no:04d}" / "X.csv").stat().st_size
    (base / "result.0003" / "X.csv.gz").write_bytes(b"")
    (base / "result.0003" / "X.csv.gz").unlink()
    read = lambda: tables.read_measurement(spark, f"file://{base}/result.*/X.csv", "X").groupBy("Epoch").agg(F.sum("value").alias("v"), F.sum("Board").alias("b"), F.sum("WL").alias("w"))
    n, b, w = 20_000, 20_000 * 19_999 / 2, sum(i % 7 for i in range(20_000))
    assert {tuple(r)[1:] for r in read().collect()} == {(0.5 * n, b, w), (1.5 * n, b, w), (2.0 * n, b, None)}
    assert bytes_read(spark, lambda: read().collect()) < 1.2 * size


@pytest.mark.parametrize("second", ["Board,WL,X", "X,WL,Board"])
def test_epochs_and_headers_are_worked_out_by_file(spark, tmp_path, second):
    """Rows meet what is known of their file where they lie: no shuffle by path, and no pattern of a path for each row."""
    base = tmp_path / "exp" / "Step1" / "Loop01" / "result_history"
    for no, head in ((1, "Board,WL,X"), (2, second)):
        (base / f"result.{no:04d}").mkdir(parents=True)
        rows = [dict(zip("Board WL X".split(), (i, 7, 0.5 * no), strict=True)) for i in range(10)]
        text = "\n".join([head, *[",".join(str(r[c]) for c in head.split(",")) for r in rows], ""])
        (base / f"result.{no:04d}" / "X.csv").write_text(text)
    df = tables.read_measurement(spark, f"file://{base}/result.*/X.csv", "X")
    assert df.columns == ["Epoch", "Board", "WL", "value"]
    assert {tuple(r) for r in df.collect()} == {(f"exp/Step1/Loop01#000{no}", i, 7, 0.5 * no) for no in (1, 2) for i in range(10)}
    of_rows, *of_files = df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")  # the rows come first
    assert of_files and "hashpartitioning" not in of_rows and "regexp" not in of_rows.lower()


def test_first_cells_of_awkward_files():
    assert first_cells(iter([b"\xef\xbb\xbf\r\n  \n a ,", b'"b,\nc"', b",d\r\n1,2,3\n"])) == ["a", "b,\nc", "d"]
    assert first_cells(iter([])) == [] and first_cells(iter([b"a,b"])) == ["a", "b"]


def test_temperatures(spark, history):
    t = tables.read_temperatures(spark, f"{history}/result.*/initial_temperature.csv")
    got = {(r["Epoch"][-1], r["Board"], r["temp"]) for r in t.collect()}
    assert got == {("1", 0, 25.0), ("1", 1, 30.8333), ("2", 0, 25.0), ("2", 0, 26.0), ("2", 1, 30.0)}
    assert [tuple(r) for r in tables.temperature_conflicts(t).collect()] == [("exp/Step1/Loop01#0002", 0)]


def catalog(spark, history) -> Catalog:
    maps = tables.read_maps(spark, f"{history}/result.*/map_*.csv")
    named = {n: maps.where(F.col("map_name") == n).select("code", "text") for n in ("Label", "Override")}
    return Catalog({"FBC": tables.read_measurement(spark, f"{history}/result.*/FBC.csv*", "FBC")}, {"FBC": tables.read_side(spark, f"{history}/result.*/parameterLabel_FBC.csv")}, {}, named)


def test_scores_from_files_and_sinks(spark, history, tmp_path):
    cat = catalog(spark, history)
    df = cat.resolve("FBC", ["Read_Label", "Read_Override"])
    assert {tuple(r) for r in df.select("Read_Label", "Read_Override").distinct().collect()} == {("upper", False), ("lower", True)}
    p = ScorePart("a", "FBC", ("Read_Label", "WL", "Board"), {"Read_Label": Step("filter", "upper"), "WL": Step("mean"), "Board": Step("max")})
    got = compute_scores(cat, ScoreFile((p,), "a"))
    assert {r["Epoch"][-1]: r["Score"] for r in got.scores.collect()} == {"1": 110.5, "2": 210.5}
    tables.write_scores(got.scores, str(tmp_path / "scores"))
    tables.write_failed(got.failed, str(tmp_path / "failed"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).count() == 2
    assert '"Score":110.5' in tables.json_results(got.scores).orderBy("json").first()["json"]
    tables.write_bundle({"FBC": cat.measurements["FBC"]}, str(tmp_path / "bundle"))
    assert "FBC" in spark.read.option("header", True).csv(str(tmp_path / "bundle" / "FBC.csv")).columns


def test_calibration_file(spark, tmp_path):
    (tmp_path / "coef.json").write_text('{"G":\n {"85": {"R2A": {"a": 1, "b": -2.5}}, "-30": {"R2A": {"a": 0, "b": -4}}}}')
    got = [tuple(r) for r in tables.read_calibration(spark, str(tmp_path / "coef.json")).orderBy("ord").collect()]
    assert got == [("G", 85.0, 0, "R2A", 1.0, -2.5), ("G", -30.0, 1, "R2A", 0.0, -4.0)]


def test_archives(spark, tmp_path):
    text = (HEAD + "\n0,0,0,0,0,3,7\n").encode()
    d = tmp_path / "exp" / "Step1" / "Loop01" / "result_history"
    for no in (1, 2):
        (d / f"result.{no:04d}").mkdir(parents=True)
    with zipfile.ZipFile(d / "result.0001" / "all.zip", "w") as z:
        z.writestr("wrapped/FBC.csv", text)
    with tarfile.open(d / "result.0002" / "all.tgz", "w:gz") as t:
        for name in ("FBC.csv", "../evil.csv"):
            m = tarfile.TarInfo(name)
            m.size = len(text)
            t.addfile(m, io.BytesIO(text))
    lines = tables.archive_lines(spark, f"file://{d}/result.*/all.*")
    assert {r["file"] for r in lines.collect()} == {"FBC.csv"}
    got = {tuple(r) for r in tables.measurement_of_lines(lines, "FBC", ["Board", "WL"]).collect()}
    assert got == {(f"exp/Step1/Loop01#000{i}", 0, 3, 7.0) for i in (1, 2)}
    (d / "result.0001" / "FBC.csv").write_text("Board,FBC\n5,5\n")
    (d / "result.0001" / "KLD.csv").write_text("Board,KLD\n1,\n\n2,4\n")
    both = tables.merged_lines(lines, tables.loose_lines(spark, f"file://{d}/result.*/*.csv"))
    assert {tuple(r)[1:] for r in tables.measurement_of_lines(both, "KLD", ["Board"]).collect()} == {(1, None), (2, 4.0)}
    assert tables.measurement_of_lines(both, "FBC", ["Board"]).where("value = 5").count() == 0


def test_archives_of_any_size_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """A tar beyond 2 GB, most of it a hole in a member that is no table; members behind it are found by seeking."""
    d = tmp_path / "exp" / "Step1" / "Loop01" / "result_history" / "result.0001"
    d.mkdir(parents=True)
    text = ("Board,X\n" + "".join(f"{i},{i}\n" for i in range(50_000))).encode()
    with open(d / "all.tar", "wb") as f:
        hole = tarfile.TarInfo("wrapped/raw.bin")
        hole.size = 5 << 29
        f.write(hole.tobuf())
        f.seek(hole.size, 1)
        for name, data in (("wrapped/X.csv", text), ("wrapped/Y.csv.gz", gzip.compress(text))):
            m = tarfile.TarInfo(name)
            m.size = len(data)
            f.write(m.tobuf())
            f.write(data + bytes(-len(data) % 512))
        f.write(bytes(1024))
    monkeypatch.setattr(archives, "PIECE", 10_000)
    lines = tables.archive_lines(spark, f"file://{d}/all.tar")
    got = {r["file"]: tuple(r)[1:] for r in lines.groupBy("file").agg(F.count("*"), F.max("pos"), F.count_distinct("pos"), F.min_by("line", "pos"), F.max_by("line", "pos")).collect()}
    assert got == {n: (50_001, 50_000, 50_001, "Board,X", "49999,49999") for n in ("X.csv", "Y.csv")}
    assert tables.measurement_of_lines(lines, "X", ["Board"]).agg(F.sum("value")).first()[0] == sum(range(50_000))


def test_members_and_their_names():
    assert archives.safe_names(["./w/a.csv", "w/b.csv.gz", "w/c.txt"]) == {"./w/a.csv": "a.csv", "w/b.csv.gz": "b.csv"}
    assert archives.safe_names(["a.csv", "w/b.csv", "/c.csv", "w/../../d.csv"]) == {"a.csv": "a.csv", "w/b.csv": "w/b.csv"}


def test_epochs_close_and_leave_the_state(spark, tmp_path):
    """A closes complete, B without a table, C stays open; rows for A and an unseen early epoch come late."""
    at = lambda day: datetime(2024, 1, day)
    batches = [
        [("a", "A", 0, 1.0, at(1)), ("a", "B", 0, 2.0, at(1)), ("b", "A", 0, 5.0, at(2))],
        [("c", "A", 0, 3.0, at(9)), ("a", "A", 1, 3.0, at(2))],
        [("a", "A", 0, 100.0, at(1)), ("z", "A", 0, 1.0, at(3)), ("c", "B", 0, 4.0, at(5)), ("d", "B", 0, 4.0, at(9))],
        [("d", "A", 0, 6.0, at(9))],
    ]
    schema = "Epoch string, type string, Board long, value double, day timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    file = ScoreFile(tuple(ScorePart(t, t, ("Board",), {"Board": Step("sum")}) for t in ("A", "B")), "A + B")
    split = lambda df: Catalog({t: df.where(F.col("type") == t).select("Epoch", "Board", "value") for t in ("A", "B")})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    score_stream(stream, split, file, out, str(tmp_path / "ck"), ("A", "B"), "day", timedelta(days=3)).awaitTermination()
    scores, failed = current(spark, out)
    assert {r["Epoch"]: r["Score"] for r in scores.collect()} == {"a": 6.0, "c": 7.0, "d": 10.0}
    assert {r["Epoch"]: r["reason"] for r in failed.collect()} == {"b": "closed without B"}
    assert {r["Epoch"]: r["rows"] for r in late_rows(spark, out).collect()} == {"a": 1, "z": 1}
    assert [r["Epoch"] for r in final(spark, out)[0].collect()] == ["a"] and final(spark, out)[1].count() == 1
    states = [{r["Epoch"]: r["batches"] for r in spark.read.parquet(f"{out}/state/batch={i}").collect()} for i in range(4)]
    assert states == [{"a": [0], "b": [0]}, {"c": [1]}, {"c": [1, 2], "d": [2]}, {"c": [1, 2], "d": [2, 3]}]


def test_stream_gives_the_batch_scores(spark, tmp_path):
    rows = [(f"e{e}", t, b, float(10 * e + b + (t == "B"))) for e in range(4) for t in ("A", "B") for b in (0, 1) if (e, t) != (3, "B")]
    schema = "Epoch string, type string, Board long, value double"
    for i, (e, t) in enumerate([(0, "A"), (1, "A"), (1, "B"), (0, "B"), (2, "B"), (2, "A"), (3, "A")]):
        spark.createDataFrame([r for r in rows if r[:2] == (f"e{e}", t)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    file = ScoreFile(tuple(ScorePart(t, t, ("Board",), {"Board": Step("mean")}) for t in ("A", "B")), "A + B")
    split = lambda df: Catalog({t: df.where(F.col("type") == t).drop("type") for t in ("A", "B")})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    score_stream(stream, split, file, str(tmp_path / "out"), str(tmp_path / "ck"), ("A", "B")).awaitTermination()
    got = {r["Epoch"]: r["Score"] for r in current(spark, str(tmp_path / "out"))[0].collect()}
    want = {r["Epoch"]: r["Score"] for r in compute_scores(split(spark.createDataFrame(rows, schema)), file).scores.collect()}
    assert got == want and set(got) == {"e0", "e1", "e2"}
