"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

#: Names that the operators use for columns of their own.
CLASHING = ("_row", "_id", "_doc", "_h1", "_bad", "_gone", "_first", "_judged", "kept_text", "spans", "component_id", "token", "score", "weight", "y", "item", "bin")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, size int, node string, " + ", ".join(f"{c} string" for c in CLASHING)
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "éa", "ßo") for b in ("n", "ra", "st", "x", ".", "o,", "ing", "D")]


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, chains, shared passages, short, empty, null and long texts, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows: list[tuple[int | None, str | None]] = [(0, " ".join(base)), (1, " ".join(base)), (2, "  ".join(base).upper())]
    for k in range(3, 40):  # near copies of one text, some beyond the threshold
        words = list(base)
        for _ in range(k % 13):
            words[rng.randrange(len(words))] = f"w{k}{rng.randrange(99)}"
        rows.append((k, "\n".join(words)))
    passage = prose(rng, 60)
    for k in range(40, 60):
        rows.append((k, " ".join(prose(rng, rng.randrange(5, 90)) + passage + prose(rng, rng.randrange(50)))))
    rows += [(60, ""), (61, None), (62, " \t\n"), (63, "one two"), (64, "One two"), (65, "one two three four"), (66, "one two three four five"), (None, "one two three four five six"), (None, None)]
    rows += [(67, "a " * 400), (68, "a " * 300), (69, " ".join(prose(rng, 20_000))), (70, "ab cd 　 ef\x0bgh\x0cij\x1ckl ퟿ é"), (5, rows[5][1]), (5, rows[5][1]), (69, "short text under an id that is taken")]
    rows += [(-7, "negative id here"), (2**62, "big id here")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), None if t is None else len(t), "clash", 1, "x", *CLASHING) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
