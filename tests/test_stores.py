"""Versioned roots that are cut off between any two steps, and packed shard stores."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sonara.sources import packs, versions

STEPS = ("create", "rename_over", "write_table", "delete")


def rows_of(spark, root):
    return {name: sorted(r[0] for r in rows.collect()) for name, rows in versions.open_tables(spark, root, check=True).items()}


class CutOff(Exception):
    pass


def cut_off_after(monkeypatch, steps):
    """From the step of that number on nothing happens to the file system any more."""
    left = [steps]
    for name in STEPS:
        def step(self, *args, _own=getattr(versions.Store, name)):
            if not left[0]:
                raise CutOff
            left[0] -= 1
            return _own(self, *args)

        monkeypatch.setattr(versions.Store, name, step)
    return left


def test_publication_is_whole_wherever_it_breaks_off(spark, tmp_path):
    old = {"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}
    new = {"a": spark.range(4).toDF("x"), "b": spark.range(5).toDF("x")}
    before, after = {"a": [0, 1, 2], "b": [0, 1]}, {"a": [0, 1, 2, 3], "b": [0, 1, 2, 3, 4]}
    seen = []
    for steps in range(30):
        root = f"{tmp_path}/r{steps}"
        assert versions.publish(old, root) == "created"
        with pytest.MonkeyPatch.context() as patch:
            left = cut_off_after(patch, steps)
            try:
                state = versions.publish(new, root, replace=True)
            except CutOff:
                state = "cut off"
        found = rows_of(spark, root)
        assert found in (before, after)
        seen.append((state, found == after))
        # The next run clears up and gets through.
        assert versions.publish(new, root, replace=True) == ("verified_existing" if found == after else "replaced")
        assert rows_of(spark, root) == after and os.listdir(f"{root}/journal") == [] or not os.path.exists(f"{root}/journal")
        assert sorted(os.listdir(f"{root}/versions")) == sorted(versions.history(spark, root))
        if state != "cut off":
            assert left[0] == 0
            break
    assert seen[0] == ("cut off", False) and ("cut off", True) in seen and seen[-1] == ("replaced", True) and len(seen) == 8


def test_nothing_or_all_of_a_first_version(spark, tmp_path):
    for steps in range(6):
        with pytest.MonkeyPatch.context() as patch:
            cut_off_after(patch, steps)
            with pytest.raises(CutOff):
                versions.publish({"a": spark.range(3).toDF("x"), "b": spark.range(1).toDF("x")}, f"{tmp_path}/{steps}")
        if versions.manifest(spark, f"{tmp_path}/{steps}"):
            assert rows_of(spark, f"{tmp_path}/{steps}") == {"a": [0, 1, 2], "b": [0]}
        else:
            with pytest.raises(ValueError, match="no version"):
                versions.open_tables(spark, f"{tmp_path}/{steps}")


def test_equal_and_different_versions(spark, tmp_path):
    a, b, root = spark.range(3).toDF("x"), spark.range(4).toDF("x"), f"{tmp_path}/p"
    assert [versions.publish({"a": a}, root) for _ in range(2)] == ["created", "verified_existing"]
    for other in ({"a": a, "b": b}, {"a": b}):
        with pytest.raises(ValueError, match="differs"):
            versions.publish(other, root)
    assert versions.publish({"a": b}, root, replace=True) == "replaced" and rows_of(spark, root) == {"a": [0, 1, 2, 3]}
    assert versions.rollback(spark, root) == versions.history(spark, root)[0] and rows_of(spark, root) == {"a": [0, 1, 2]}
    with pytest.raises(ValueError, match="no version before"):
        versions.rollback(spark, root)
    for k in (5, 6, 7):
        versions.publish({"a": spark.range(k).toDF("x")}, root, replace=True)
    assert len(versions.prune(spark, root)) == 3 and len(versions.history(spark, root)) == 2
    versions.rollback(spark, root)
    assert len(rows_of(spark, root)["a"]) == 6


def test_changed_files_are_seen(spark, tmp_path):
    root = f"{tmp_path}/p"
    versions.publish({"a": spark.range(3).toDF("x")}, root)
    version = versions.manifest(spark, root)["version"]
    spark.range(4).toDF("x").write.mode("append").parquet(f"{root}/versions/{version}/a")
    with pytest.raises(ValueError, match="a is not what was published"):
        versions.open_tables(spark, root, check=True)
    versions.Store(spark, root).delete(f"versions/{version}/MANIFEST")
    versions.Store(spark, root).create(f"versions/{version}/MANIFEST", '{"previous":null,"tables":{}}')
    with pytest.raises(ValueError, match="manifest"):
        versions.open_tables(spark, root)


SHARDS = "shard_path string, within_shard_index int, x long"


def shards(spark, n, size=5, name="t/s{:03d}"):
    return spark.createDataFrame([(name.format(k), i, 100 * k + i) for k in range(n) for i in range(size)], SHARDS)


def test_packs_resume_and_read(spark, tmp_path):
    root = f"{tmp_path}/s"
    assert packs.write(shards(spark, 10), root, shards_per_pack=4) == {"total": 10, "reused": 0, "written": 10}
    assert packs.write(shards(spark, 23), root, shards_per_pack=4, packs_per_commit=2) == {"total": 23, "reused": 10, "written": 13}
    assert packs.write(shards(spark, 23), root) == {"total": 23, "reused": 23, "written": 0}
    assert sorted(tuple(r) for r in packs.read(spark, root).collect()) == sorted(tuple(r) for r in shards(spark, 23).collect())
    assert sorted(r["x"] for r in packs.read(spark, root, ["t/s003", "t/s021"]).collect()) == [300, 301, 302, 303, 304, 2100, 2101, 2102, 2103, 2104]
    changed = shards(spark, 23).withColumn("x", F.when(F.col("x") == 301, 7).otherwise(F.col("x")))
    assert packs.write(changed, root) == {"total": 23, "reused": 22, "written": 1}
    assert sorted(r["x"] for r in packs.read(spark, root, ["t/s003"]).collect()) == [7, 300, 302, 303, 304]
    assert packs.read(spark, root).count() == 23 * 5
    for names in (["../s0"], ["/s0"], ["t/s999"], [""], ["a\\b"]):
        with pytest.raises(ValueError):
            packs.read(spark, root, names)
    with pytest.raises(ValueError, match="not planned"):
        packs.write(shards(spark, 3), root)
    placed = sorted(tuple(r) for r in packs.index(spark, root).where("shard < 't/s003'").select("shard", "pack", "first_row", "n_rows").collect())
    assert placed == [("t/s000", 0, 0, 5), ("t/s001", 0, 5, 5), ("t/s002", 0, 10, 5)]
    totals = packs.totals(spark, root).first()
    named = {r["path"].split("file:")[-1].replace("//", "/") for r in packs.files(spark, root).collect()}
    assert totals["n_files"] == len(named) == 3 + 2 + 2 + 1 and totals["n_shards"] == 23 and totals["n_rows"] == 115
    assert totals["bytes"] == sum(os.path.getsize(p) for p in named)
    assert packs.file_violations(spark, root).count() == 0


def test_packs_keep_what_was_published(spark, tmp_path, monkeypatch):
    """Cut off in the second commit, the first one stays and is reused; what the cut left is no part of the store."""
    root = f"{tmp_path}/s"
    with pytest.MonkeyPatch.context() as patch:
        own, runs = versions.publish, []

        def publish(*args, **more):
            runs.append(1)
            if len(runs) == 2:
                raise CutOff
            return own(*args, **more)

        patch.setattr(versions, "publish", publish)
        with pytest.raises(CutOff):
            packs.write(shards(spark, 6), root, shards_per_pack=2, packs_per_commit=1)
    assert packs.read(spark, root).count() == 10
    assert packs.write(shards(spark, 6), root, shards_per_pack=2, packs_per_commit=1) == {"total": 6, "reused": 2, "written": 4}
    assert packs.read(spark, root).count() == 30 and len(os.listdir(f"{root}/data")) >= 4


def test_packs_see_changed_and_lost_files(spark, tmp_path):
    root = f"{tmp_path}/s"
    packs.write(shards(spark, 6), root, shards_per_pack=3)
    place = packs.index(spark, root).where("shard = 't/s004'").first()
    folder = f"{root}/data/generation={place['generation']}/pack={place['pack']}"
    (name,) = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    table = pq.read_table(f"{folder}/{name}")
    os.remove(f"{folder}/.{name}.crc")
    pq.write_table(table.slice(0, table.num_rows - 1), f"{folder}/{name}")
    assert packs.read(spark, root, ["t/s000"]).count() == 5
    with pytest.raises(ValueError, match="not what was published"):
        packs.read(spark, root, ["t/s005"])
    assert [r["rule"] for r in packs.file_violations(spark, root).collect()] == ["pack_rows"]
    os.remove(f"{folder}/{name}")
    assert [r["rule"] for r in packs.file_violations(spark, root).collect()] == ["pack_file"]


def test_a_million_shards_need_few_files_and_a_point_read_few_row_groups(spark, tmp_path, monkeypatch):
    assert -(-1_000_000 // packs.SHARDS_PER_PACK) < 300
    monkeypatch.setattr(packs, "ROW_GROUP_BYTES", 1 << 14)
    root = f"{tmp_path}/s"
    wide = shards(spark, 40, 50).withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.rand(3) + k))
    packs.write(wide.withColumn("features", F.array(*[F.xxhash64("x", F.lit(k)) for k in range(64)])), root)
    (path,) = [r["path"] for r in packs.files(spark, root).collect()]
    groups = pq.ParquetFile(path.split("file:")[-1]).metadata
    assert groups.num_row_groups > 5
    spans = [(s.min, s.max) for s in (groups.row_group(k).column(0).statistics for k in range(groups.num_row_groups))]
    assert sum(lo <= "t/s021" <= hi for lo, hi in spans) <= 2 and [lo for lo, _ in spans] == sorted(lo for lo, _ in spans)


def test_an_empty_store(spark, tmp_path):
    assert packs.write(shards(spark, 1).limit(0), f"{tmp_path}/s") == {"total": 0, "reused": 0, "written": 0}
    assert tuple(packs.totals(spark, f"{tmp_path}/s").first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError, match="no shards"):
        packs.read(spark, f"{tmp_path}/s")
