"""Order-dependent and mergeable identities, and canonical CSV."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sonara.functions import digests
from sonara.sources import canonical, tables, wav

SCHEMA = "k int, a string, b string"


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}", [None, "", 'q"x', "é,\x0b"][k % 4]) for k in range(300)], SCHEMA).repartition(4)
    tables.write_csv(rows.repartitionByRange(3, "k").sortWithinPartitions("k"), f"{tmp_path}/t")
    return rows, f"{tmp_path}/t"


def rules(rows, path):
    return {r["rule"] for r in canonical.csv_violations(rows, path, F.col("k")).collect()}


def edit(path, change):
    """Change the bytes of the first part and drop its checksum."""
    name = sorted(f for f in os.listdir(path) if f.startswith("part-"))[0]
    body = open(f"{path}/{name}", "rb").read()
    if os.path.exists(f"{path}/.{name}.crc"):
        os.remove(f"{path}/.{name}.crc")
    with open(f"{path}/{name}", "wb") as f:
        f.write(change(body))
    return body


def test_canonical_files_are_proven_equal(spark, stored):
    rows, path = stored
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) > 1
    assert rules(rows, path) == set()
    assert rules(rows.withColumn("a", F.when(F.col("k") == 7, "x").otherwise(F.col("a"))), path) == {"bytes", "content_or_order"}
    assert rules(rows.where("k > 0"), path) == {"lines", "bytes", "content_or_order"}


def test_lines_that_were_read_are_not_read_again(spark, stored):
    rows, path = stored
    lines = canonical.stored_lines(spark, path)
    assert canonical.csv_violations(rows, f"{path}-gone", F.col("k"), stored=lines).collect() == []
    assert {r["rule"] for r in canonical.csv_violations(rows, f"{path}-gone", F.col("k").desc(), stored=lines).collect()} == {"content_or_order"}


@pytest.mark.parametrize("change,found", [
    (lambda b: b"".join([*(ls := b.splitlines(True))[:1], ls[2], ls[1], *ls[3:]]), {"content_or_order"}),
    (lambda b: b.replace(b"text 3", b"text 4", 1), {"content_or_order"}),
    (lambda b: b.replace(b"\n", b"\r\n"), {"header", "bytes", "content_or_order"}),
    (lambda b: b[:-1], {"bytes"}),
    (lambda b: b.replace(b"k,a,b", b"k,b,a"), {"header"}),
    (lambda b: b"\xef\xbb\xbf" + b, {"bytes"}),
    (lambda b: b + b"9,x,y\n", {"lines", "bytes", "content_or_order"}),
])
def test_any_change_of_bytes_is_seen(spark, stored, change, found):
    rows, path = stored
    before = edit(path, change)
    assert rules(rows, path) == found
    edit(path, lambda _: before)
    assert rules(rows, path) == set()


def test_blocks_of_one_file_are_put_in_order(spark, stored, monkeypatch):
    rows, path = stored
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        assert rules(rows, path) == set()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_breaks_within_values_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", "c")], SCHEMA)
    with pytest.raises(Exception, match="line break"):
        canonical.rendered_lines(rows, F.col("k")).collect()


def test_ordered_identity_is_a_tree(spark, monkeypatch):
    monkeypatch.setattr(digests, "FANOUT", 3)
    lines = [f"line {k}" for k in range(20)]
    level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    for _ in range(4):
        level = [hashlib.sha256("\n".join(level[k : k + 3]).encode()).hexdigest() for k in range(0, len(level), 3)]
    frame = spark.createDataFrame(list(enumerate(lines)), "place int, line string").repartition(5)
    want = (20, sum(len(x) + 1 for x in lines), hashlib.sha256("\n".join(level).encode()).hexdigest())
    assert tuple(digests.ordered_identity(frame).first()) == want
    swapped = frame.withColumn("place", F.when(F.col("place") == 4, 5).when(F.col("place") == 5, 4).otherwise(F.col("place")))
    assert digests.ordered_identity(swapped).first()[2] != want[2]
    assert tuple(digests.ordered_identity(frame.limit(0)).first())[:2] == (0, 0)


def test_multiset_states_merge(spark):
    rows = spark.range(500).selectExpr("id", "cast(id * id as string) as v", "id % 3 as g")
    same = lambda a, b: sorted(a.collect()) == sorted(b.collect())
    whole = digests.multiset_state(rows)
    a, b, c = (digests.multiset_state(rows.where(w)) for w in ("id < 100", "id between 100 and 350", "id > 350"))
    assert same(digests.merged_state(a, b, c), whole) and same(digests.multiset_state(rows.repartition(9)), whole)
    assert same(digests.merged_state(whole, removed=(b,)), digests.merged_state(a, c))
    assert same(digests.merged_state(whole, removed=(whole,)), digests.multiset_state(rows.limit(0)))
    twice = digests.multiset_state(rows.unionByName(rows.limit(1)))
    assert not same(twice, whole), "a repeated row counts"
    grouped = digests.multiset_state(rows, by=("g",))
    assert same(digests.merged_state(grouped, grouped, removed=(grouped,), by=("g",)), grouped) and grouped.count() == 3
    lanes = [0] * 4
    for r in rows.collect():
        d = hashlib.sha256(f'{{"g":{r["g"]},"id":{r["id"]},"v":"{r["v"]}"}}'.encode()).hexdigest()
        lanes = [(x + int(d[16 * k : 16 * k + 16], 16)) % 2**64 for k, x in enumerate(lanes)]
    assert [int(x) for x in whole.first()] == [500, *lanes]
    assert digests.state_identity(whole).first()["identity"] == hashlib.sha256("|".join(map(str, [500, *lanes])).encode()).hexdigest()


def test_snapshots_are_updated(spark):
    files = spark.range(60).selectExpr("concat('s/', id) as path", "id as size", "timestamp_seconds(id) as modified")
    before = wav.snapshot(files.where("size < 40"))
    after = wav.updated_snapshot(before, added=files.where("size >= 40"))
    assert after.first() == wav.snapshot(files).first() != before.first()
    assert wav.updated_snapshot(after, removed=files.where("size = 3")).first() == wav.snapshot(files.where("size != 3")).first()
    touched = files.withColumn("modified", F.when(F.col("size") == 3, F.timestamp_seconds(F.lit(999))).otherwise(F.col("modified")))
    assert wav.snapshot(touched).first() != wav.snapshot(files).first()
