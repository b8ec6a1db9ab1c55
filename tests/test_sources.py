"""Files: WAV trees, strict CSV and JSON, publishing, the package job."""

from __future__ import annotations

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonara.plans import package
from sonara.sources import tables, wav


def write_wav(path, n=48000, rate=16000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.arange(n) % 100).astype("<i2").tobytes())


@pytest.fixture
def tree(tmp_path):
    for s in range(1, 6):
        for k in range(2):
            write_wav(tmp_path / "wavs" / str(s) / f"{k}.wav")
    return tmp_path


def test_discover_headers_samples(spark, tree):
    write_wav(tree / "wavs" / "9" / "LOUD.WAV", 100, 8000)
    (tree / "wavs" / "9" / "bad.wav").write_bytes(b"RIFF")
    (tree / "wavs" / "9" / "notes.txt").write_text("x")
    files = wav.discover(spark, f"file://{tree}/wavs")
    heads = {r["path"]: r for r in wav.headers(files).collect()}
    assert len(heads) == 12 and heads["1/0.wav"]["num_samples"] == 48000 and heads["9/LOUD.WAV"]["sample_rate"] == 8000 and heads["9/bad.wav"]["sample_rate"] is None
    values = files.where("path = '1/0.wav'").select(wav.samples("content")).first()[0]
    assert len(values) == 48000 and values[1] == pytest.approx(1 / 32768)
    with pytest.raises(ValueError):
        wav.discover(spark, f"file://{tree}/wavs", expected=3)


def test_headers_of_every_layout(spark, tmp_path):
    """Plain files go to Python by their first bytes; those with chunks before or within the format go whole."""
    write_wav(tmp_path / "w" / "1" / "plain.wav", 5000)
    plain = (tmp_path / "w" / "1" / "plain.wav").read_bytes()
    note = b"LIST" + (6000).to_bytes(4, "little") + bytes(6000)
    for name, body in {"noted": plain[:12] + note + plain[12:], "late": plain[:36] + note + plain[36:], "longer": plain[:16] + (18).to_bytes(4, "little") + plain[20:36] + b"\0\0" + plain[36:], "cut": plain[:40]}.items():
        (tmp_path / "w" / "1" / f"{name}.wav").write_bytes(body)
    files = wav.discover(spark, f"file://{tmp_path}/w")
    got = {r["path"]: r["num_samples"] for r in wav.headers(files).collect()}
    assert got == {"1/plain.wav": 5000, "1/noted.wav": 5000, "1/late.wav": 5000, "1/longer.wav": 5000, "1/cut.wav": None}


def test_samples_that_do_not_fit_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("1/a.wav", 16000, [1, -2, 32767])], "path string, rate int, samples array<int>")
    assert [r["size"] for r in wav.write(rows, f"file://{tmp_path}/w").collect()] == [50]
    assert wav.discover(spark, f"file://{tmp_path}/w").select(wav.sample_totals(wav.samples("content")).alias("t")).select("t.*").collect() == [(3, 32766)]
    for bad in (32768, -32769, None):
        with pytest.raises(Exception, match="16-bit"):
            wav.write(rows.withColumn("samples", F.array(F.lit(bad).cast("int"))), f"file://{tmp_path}/x")


def test_package_is_published_once_and_verified_after(spark, tree):
    job = lambda: package.create_package(spark, f"file://{tree}/wavs", f"file://{tree}/out", 10, (3, 1, 1))
    assert job() == "created" and job() == "verified_existing"
    write_wav(tree / "wavs" / "1" / "2.wav", 10)
    with pytest.raises(Exception, match="audio_contract"):
        package.create_package(spark, f"file://{tree}/wavs", f"file://{tree}/out", 11, (3, 1, 1))


def test_listing_is_a_table_and_no_list_in_the_driver(spark, tmp_path):
    """Names, levels and odd entries as Spark's file source takes them, without its index; headers and contents are the files'."""
    root = tmp_path / "a b%41"
    names = ["1/0.wav", "1/deep/er/x.WaV", "é ü/100%.wav", "2/_no/0.wav", "2/_a=1/0.wav", "2/.no/0.wav", "2/_0.wav", "2/.wav", "2/0.wav.txt", "3/0.wav._COPYING_", "4.wav/0.wav", "top.wav"]
    for k, name in enumerate(names):
        write_wav(root / name, 3000 + k)
    (root / "1" / "empty.wav").touch()
    (root / "1" / "bad.wav").write_bytes(b"RIFF")
    (root / "none").mkdir()
    files = wav.discover(spark, f"file://{root}")
    assert not [f for f in files.inputFiles() if f.lower().endswith(".wav")]
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(f"file://{root}").collect()
    expected = {(r["length"], bytes(r["content"]), r["modificationTime"].replace(microsecond=0)) for r in plain}
    got = files.collect()
    assert len(got) == len(plain) == 7 and {(r["size"], bytes(r["content"]), r["modified"].replace(microsecond=0)) for r in got} == expected
    assert {(r["path"], r["speaker_id"]) for r in got} == {("1/0.wav", "1"), ("1/deep/er/x.WaV", "er"), ("é ü/100%.wav", "é ü"), ("2/_a=1/0.wav", "_a=1"), ("4.wav/0.wav", "4.wav"), ("top.wav", ""), ("1/bad.wav", "1")}
    assert sorted(wav.headers(files).collect(), key=str) == sorted(wav.headers(files.where("size > 0")).collect(), key=str)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        wav.discover(spark, f"file://{root}/missing")
    (root / "none" / "deeper").mkdir()
    assert wav.discover(spark, f"file://{root}/none", 0).collect() == []


def test_small_files_make_few_tasks(spark, tmp_path):
    for k in range(200):
        write_wav(tmp_path / "wavs" / str(k) / "0.wav", 10)
    heads = wav.headers(wav.discover(spark, f"file://{tmp_path}/wavs"))
    assert heads.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert heads.where("num_samples = 10").count() == 200


def test_package_reads_headers_once(spark, tree, monkeypatch):
    calls, headers = [], wav.headers
    monkeypatch.setattr(wav, "headers", lambda files: calls.append(1) or headers(files))
    package.create_package(spark, f"file://{tree}/wavs", f"file://{tree}/out", 10, (3, 1, 1))
    assert len(calls) == 1


def test_changes_are_seen(spark, tree):
    before = spark.createDataFrame(wav.discover(spark, f"file://{tree}/wavs").select("path", "size", "modified").collect())
    write_wav(tree / "wavs" / "1" / "0.wav", 10)
    (tree / "wavs" / "2" / "0.wav").unlink()
    got = {(r["path"], r["change"]) for r in wav.changed(before, wav.discover(spark, f"file://{tree}/wavs")).collect()}
    assert got == {("1/0.wav", "modified"), ("2/0.wav", "removed")}


def test_csv_is_strict(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes(b"\xef\xbb\xbfspeaker_id,split,ranking_sha256\n1,train,ab\n")
    assert tables.read_csv(spark, str(good), tables.SPLIT).collect()[0]["speaker_id"] == "1"
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("split,speaker_id,ranking_sha256\ntrain,1,ab\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(swapped), tables.SPLIT).collect()
    with pytest.raises(ValueError):
        tables.read_superset_csv(spark, str(swapped), ["relative_path"])
    bad = tmp_path / "bad.csv"
    bad.write_text("trial_id,target,score\na,one,0.5\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(bad), tables.SCORES).collect()


def test_round_trips(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("b", 1, 0.25), ('a "q", x', 0, -0.5)], tables.SCORES)
    tables.write_csv(rows, f"{tmp_path}/scores", F.col("trial_id"))
    assert sorted(tables.read_csv(spark, f"{tmp_path}/scores", tables.SCORES).collect()) == sorted(rows.collect())
    tables.write_json_lines(rows, f"{tmp_path}/lines")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/lines").collect())[1] == '{"score":0.25,"target":1,"trial_id":"b"}'


def test_plans_and_exact_writes(spark, tmp_path):
    a, b = spark.range(3).toDF("x"), spark.range(4).toDF("x")
    root = f"{tmp_path}/cache"
    assert tables.prepare_plan({"config": a, "index": b}, root) == "new"
    assert tables.prepare_plan({"config": a, "index": b}, root) == "resume"
    with pytest.raises(ValueError, match="differs"):
        tables.prepare_plan({"config": b, "index": b}, root)
    assert tables.write_exact(a, f"{root}/identity") == "created" and tables.write_exact(a, f"{root}/identity") == "unchanged"
    with pytest.raises(ValueError, match="other rows"):
        tables.write_exact(b, f"{root}/identity")
    assert tables.prepare_plan({"config": a, "index": b}, root) == "complete"
    tables.write_exact(a, f"{root}/stray")
    with pytest.raises(ValueError, match="unexpected"):
        tables.prepare_plan({"config": a, "index": b}, root)
    tables.claim(spark, f"{tmp_path}/once", "x")
    with pytest.raises(ValueError, match="taken"):
        tables.claim(spark, f"{tmp_path}/once", "x")


def test_json_objects(spark, tmp_path):
    (tmp_path / "good.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    (tmp_path / "bad.json").write_text('{"a": ')
    assert tables.read_json(spark, str(tmp_path / "good.json"), "a int, b string").first() == (1, "x")
    with pytest.raises(Exception):
        tables.read_json(spark, str(tmp_path / "bad.json"), "a int, b string").collect()
