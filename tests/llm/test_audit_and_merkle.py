"""Filter audit and Merkle manifest against plain replays."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from sonara.llm import filter_audit, merkle

from . import brute


def plain_audit(rows, labels):
    """Every order replayed on the documents."""
    smaller = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            smaller[t or ""].append(i)
    fails, part_of = [], []
    for i, t, source in rows:
        w = brute.words(t)
        t = t or ""
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(smaller[t]) < i}
        fails.append({k for k, v in f.items() if v})
        part_of.append(source or "")
    out = {}
    for part in set(part_of):
        own = [k for k, p in enumerate(part_of) if p == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order):
                gone = [k for k in left if f in fails[k]]
                good, toxic = (sum(labels.get(rows[k][0], (0, 0))[c] for k in gone) for c in (0, 1))
                failing = sum(f in fails[k] for k in own)
                left = [k for k in left if f not in fails[k]]
                out[part, order, step + 1] = [len(left), len(gone), failing - len(gone), sum(fails[k] == {f} for k in own), good, toxic]
                total[f] += len(gone)
        for p, order, step in out:
            if p == part:
                out[p, order, step].append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def plain_merkle(rows):
    """Levels as lists; (doc_id, leaf, subroot, root, proof digest, folded root) of each row."""
    digest = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, source, n: digest(*map(field, (i, source, lang, n, t)))
    trees = defaultdict(list)
    for i, t, lang, source, n in rows:
        hit = i is not None and t is not None and zlib.crc32(str(i).encode()) % 3 == 0
        trees[lang].append((i is not None, i or 0, leaf(i, t, lang, source, n), leaf(i, t.translate(brute.FOLD) if hit else t, lang, source, n)))

    def climb(level):
        """The root, and of each node (siblings before, siblings after) level by level."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[k : k + 8] for k in range(0, len(level), 8)]
            for path, k in zip(paths, at):
                path.append((runs[k // 8][: k % 8], runs[k // 8][k % 8 + 1 :]))
            at, level = [k // 8 for k in at], [digest(*run) for run in runs]
        return level[0], paths

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = [(sorted(trees[x]), *climb([leaf for *_, leaf, _ in sorted(trees[x])])) for x in order]
    root, tops = climb([subroot for _, subroot, _ in built])
    out = []
    for (leaves, subroot, paths), top in zip(built, tops):
        for (known, i, own, altered), path in zip(leaves, paths):
            fold, all_of = altered, ""
            for before, after in [*path, *top]:
                fold, all_of = digest(*before, fold, *after), all_of + "".join(before + after)
            out.append((i if known else None, own, subroot, root, digest(all_of), fold, fold == root))
    return out


@pytest.fixture(scope="module")
def labelled(spark, texts):
    rng = random.Random(8)
    rows = {i: (rng.randrange(2), rng.randrange(2)) for i, _ in texts if i is not None and rng.random() < 0.7}
    more = [(None, 1, 1), (-999, 1, 1), (5, 0, 0), (7, None, None)]
    frame = spark.createDataFrame([(i, *y, "clash") for i, y in rows.items()] + [(*x, "clash") for x in more], "doc_id long, quality int, toxic int, part string")
    return frame, rows


def test_audit_against_replayed_orders(docs, labelled):
    frame, labels = labelled
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, frame).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_of_nothing_and_of_one_row(spark, nothing, labelled):
    assert filter_audit.audit(nothing, labelled[0]).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    got = filter_audit.audit(one, labelled[0].limit(0)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and {r["shapley"] for r in got if r["filter_order"][r["step"] - 1] == "A"} == {120}
    assert {r["shapley"] for r in got if r["filter_order"][r["step"] - 1] != "A"} == {0}


def test_potential_is_that_of_its_definition(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    worth = [0] + [rng.randrange(1000) for _ in range(31)]
    got = spark.createDataFrame([(worth,)], "w array<long>").select(filter_audit.potentials(F.col("w"))).first()[0]
    known = [0] * 32
    for s in range(1, 32):
        parts = [k for k in range(5) if s >> k & 1]
        known[s] = (worth[s] + sum(known[s ^ 1 << k] for k in parts)) / len(parts)
    assert got == [round(120 * x) for x in known]


@pytest.mark.parametrize("block_levels", [1, 4])
def test_merkle_against_plain_levels(docs, block_levels, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**block_levels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(map(tuple, merkle.verification(docs).collect())) == Counter(plain_merkle(rows))


@pytest.mark.parametrize("size", [1, 9, 65])
def test_merkle_of_one_and_of_many_languages(spark, size):
    rows = [(k, f"Text {k}", None if k % size == 0 else f"l{k % size}é", "s", k) for k in range(size)] + [(k, f"Text {k}", None, None, None) for k in range(1000, 1000 + size // 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, merkle.verification(frame).collect())) == Counter(plain_merkle(rows))


def test_merkle_of_nothing(nothing):
    assert merkle.verification(nothing).collect() == []


def test_any_change_is_seen(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"Text {k}", "en", "s", k) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    altered = F.when(F.col("doc_id") == 17, F.lit("Text 17.")).otherwise(F.col("text"))
    got = merkle.manifest(frame, altered).withColumn("back", merkle.folded(F.col("altered_leaf"), F.col("proof")))
    assert [r["doc_id"] for r in got.where("back != root").collect()] == [17]


@pytest.mark.parametrize("limit", [2, 5, 10_000])
def test_queue_spills_and_merges(limit):
    rng = random.Random(4)
    labels = rng.sample(range(10_000), 300)
    queue, taken = merkle.MessageQueue(limit), []
    for k, x in enumerate(labels):
        queue.push((1, x), [str(x)])
        if k % 3 == 2:
            taken.append(queue.pop())
            assert queue.peek() is None or queue.peek() > taken[-1][0]
            queue.push((2, taken[-1][0][1]), [taken[-1][1][0]])
    while queue.peek() is not None:
        assert queue.peek() == (least := queue.pop())[0]
        taken.append(least)
    assert sorted(label for label, _ in taken) == sorted([(1, x) for x in labels] + [(2, x) for _, x in [label for label, _ in taken if label[0] == 2]])
    assert all(content == [str(label[1])] for label, content in taken)


def test_sweeps_with_a_full_queue():
    leaves = [(k, merkle.hashed(str(k))) for k in range(700)]
    levels = merkle.levels_above(len(leaves))
    assert list(merkle.sweep_up(leaves, levels, 3)) == list(merkle.sweep_up(leaves, levels))
    plain = lambda found: {k: [tuple(x) for x in proof] for k, proof in found}
    assert plain(merkle.sweep_down(leaves, levels, [("a", "b")], 3)) == plain(merkle.sweep_down(leaves, levels, [("a", "b")]))
