"""Token ids, sorted-string-table shards and packing."""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonara.llm import kernels as K
from sonara.llm import packing, sstable, tokens

from . import brute


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


AWKWARD = ["", None, "a.b. c,, d.,", "İstanbul É. it's we'll <|endoftext|> x<|startoftext|>. 12,5. ①. é. ́a á,", "\x1c a\x85b c A². ﬁ. 中文. ", ".,", ". , a. A, É, ß.", "'s 't'll. x's.", "a" * 300 + ".", "  　", "👍🏽. é."]


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_ids_are_the_tokenizers(texts, encode, limit):
    own = tokens.WordTokenizer(tokens.vocabulary_path())
    rows = AWKWARD + [t for _, t in texts] + AWKWARD
    got = []
    for chunk in K.chunks(pa.array(rows, pa.string()), limit):
        ids, at = own.encode(chunk)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [encode(t) for t in rows]


def _changed_vocabulary(folder, change):
    spec = json.load(open(tokens.vocabulary_path(), encoding="utf-8"))
    change(spec)
    path = folder / "changed.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "change",
    [
        lambda spec: spec["normalizer"]["normalizers"].pop(),  # case is told apart
        lambda spec: spec["normalizer"]["normalizers"].pop(1),
        lambda spec: spec["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated", invert=False),  # white space is kept
        lambda spec: spec.update(truncation={"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}),
    ],
)
def test_other_front_ends_get_whole_texts(tmp_path, texts, change):
    path = _changed_vocabulary(tmp_path, change)
    own, library = tokens.WordTokenizer(path), Tokenizer.from_file(path)
    assert not own.by_words
    rows = AWKWARD + ["One  TWO\n\nthree", *[t for _, t in texts][:20]]
    got = []
    for chunk in K.chunks(pa.array(rows, pa.string()), 1 << 12):
        ids, at = own.encode(chunk)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in rows]


def test_a_byte_vocabulary_gets_whole_texts(texts):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    own, library = tokens.WordTokenizer(path), Tokenizer.from_file(path)
    assert not own.by_words and tokens.WordTokenizer(tokens.vocabulary_path()).by_words
    (chunk,) = K.chunks(pa.array(["A  b\tc", "", "x. y"]))
    ids, at = own.encode(chunk)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in ("A  b\tc", "", "x. y")]


def test_known_words_are_bounded(encode, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 5)
    own = tokens.WordTokenizer(tokens.vocabulary_path())
    for text in ("one two three four five six seven", "eight nine ten one", "one two eleven"):
        (chunk,) = K.chunks(pa.array([text]))
        assert own.encode(chunk)[0].tolist() == encode(text)
    assert own.size <= 12


def test_idle_tokenizers_go(encode, monkeypatch):
    path = tokens.vocabulary_path()
    own = tokens.WordTokenizer.of(path)
    list(K.chunks(pa.array(["x"])))
    assert tokens.WordTokenizer.of(path) is own
    monkeypatch.setattr(tokens, "IDLE_SECONDS", -1.0)
    list(K.chunks(pa.array(["x"])))
    assert path not in tokens.WordTokenizer._known
    (chunk,) = K.chunks(pa.array(["still usable, twice"]))
    assert own.encode(chunk)[0].tolist() == encode("still usable, twice")


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_round_trip(docs, texts, encode, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 500)
    manifest = sstable.write_shards(docs, tokens.vocabulary_path(), end_id=2)
    rows = sstable.read_shards(manifest).collect()
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(encode(t) + [2])
    assert brute.multiset((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == brute.multiset((i, len(x), _crc(x)) for i, xs in want.items() for x in xs)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    readers = [sstable.ShardReader(r["path"]) for r in manifest.collect()]
    for i, xs in want.items():
        found = [ids.tolist() for reader in readers for ids in reader.get(i)]
        assert sorted(found) == sorted(xs)
    assert not any(reader.get(k) for reader in readers for k in (-1, 10**12, 999))


def test_empty_tables(nothing):
    assert sstable.read_shards(sstable.write_shards(nothing, tokens.vocabulary_path())).collect() == []
    assert packing.pack(nothing, tokens.vocabulary_path()).collect() == []


def _check_packing(rows, texts, encode, capacity):
    want = []
    for i, t in texts:
        ids = encode(t) + [1]
        want += [(i, k, k * capacity, len(ids[k * capacity : (k + 1) * capacity]), _crc(ids[k * capacity : (k + 1) * capacity])) for k in range(-(-len(ids) // capacity))]
    assert brute.multiset((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == brute.multiset(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


@pytest.mark.parametrize("capacity,group", [(4096, 20_000), (256, 20_000), (256, 16)])
def test_packing(docs, texts, encode, monkeypatch, capacity, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    rows = packing.pack(docs, tokens.vocabulary_path(), capacity=capacity, end_id=1).collect()
    used, least = _check_packing(rows, texts, encode, capacity)
    assert used <= 1.1 * least + 2


def _placed_plainly(lengths, capacity):
    """Try every open sequence and a new one, and count the squares each time."""
    bins, out = [], []
    squares = lambda: sum(n * n for n in Counter(capacity - sum(b) for b in bins if sum(b) < capacity).values())
    for n in lengths:
        choices = []
        for k in range(len(bins) + 1):
            if k == len(bins) or sum(bins[k]) + n <= capacity:
                if k == len(bins):
                    bins.append([])
                bins[k].append(n)
                choices.append((squares(), len(bins[k]) == 1, capacity - sum(bins[k]), k))
                bins[k].pop()
                if not bins[k]:
                    bins.pop()
        least = min(choices)[:3]
        out.append((least, [c[3] for c in choices if c[:3] == least]))
        yield out[-1], bins


def test_each_piece_goes_where_the_squares_are_least():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.5:
            lengths.sort(reverse=True)
        sequence, offset = packing.sum_of_squares(np.array(lengths), capacity)
        for n, at, place, ((_, allowed), bins) in zip(lengths, sequence.tolist(), offset.tolist(), _placed_plainly(lengths, capacity)):
            assert at in allowed
            if at == len(bins):
                bins.append([])
            assert place == sum(bins[at])
            bins[at].append(n)
