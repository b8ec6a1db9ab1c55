"""The registered corpus queries against SQL, and the pipeline against brute force, on the smallest tables."""

from __future__ import annotations

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sonara.llm import queries
from sonara.llm.common import Scratch, table
from sonara.llm.tokens import vocabulary_path

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op2_tiling"}))
def test_a_row_for_each_document(spark, name):
    assert queries.QUERIES[name](spark, SF).select("doc_id").distinct().count() == table(spark, SF, "documents").count()


def pairs_of(frame):
    return sorted((r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in frame.collect())


def test_decontamination_against_plain_tiling(spark):
    """The query's pairs, and the documents that the pipeline's stage leaves, are those of tiling every pair plainly."""
    docs, items = ([tuple(r) for r in table(spark, SF, name).select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute.contaminated(docs, items)
    assert want and pairs_of(queries.QUERIES["op2_tiling"](spark, SF)) == sorted((d, k, round(c, 9)) for d, k, c in want)
    left = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, table(spark, SF, "documents"), SF)
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == sorted({d for d, _ in docs} - {d for d, _, _ in want})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name,column,least", [("op7_pu_quality", "quality", 0.85), ("op8_mil_toxicity", "toxic", 0.88)])
def test_accuracy_of_the_queries_on_held_out_rows(spark, name, column, least):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[column] for r in table(spark, sf, "labels").collect() if r[column] is not None}
    own = [r for r in queries.QUERIES[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(own) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in own) >= least * len(own)


def test_packed_stage_holds_all_tokens(spark):
    """Pieces of the pipeline's last stage: the library's ids, cut only at 4096, gapless in sequences of 4096 at most."""
    tokenizers = pytest.importorskip("tokenizers")
    encode = tokenizers.Tokenizer.from_file(vocabulary_path()).encode
    docs = table(spark, SF, "documents")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = []
    for r in docs.collect():
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, lo, len(ids[lo : lo + 4096]), zlib.crc32(np.array(ids[lo : lo + 4096], "<u4").tobytes())) for k, lo in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == sorted(want)
    sequences = {}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 4096


def test_pipeline_stages(spark):
    docs, scratch = table(spark, SF, "documents"), Scratch(spark, "test-pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = scratch.keep(stage(spark, docs, SF), name)
        assert docs.columns == table(spark, SF, "documents").columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        seen[name] = before, after
    before, after = seen["ngram_jaccard_join"]
    assert set(after) == {c for _, _, c in brute.components(list(before.items()))}
    before, after = seen["substring_dedup"]
    assert {i: len(brute.words(t)) for i, t in after.items()} == {i: n - gone for i, n, gone, _ in brute.removal(list(before.items()))}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a text without an id"), (3, ""), (3, None), (4, " \t\n"), (5, "word " * 3000), (6, "word " * 3000), (6, "another text of this id"), (2**62, "x")]])
def test_pipeline_stages_on_awkward_documents(spark, rows):
    schema = table(spark, SF, "documents").schema
    docs, scratch = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema), Scratch(spark, "test-awkward")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = scratch.keep(stage(spark, docs, SF), name)
        assert docs.columns == schema.names and docs.count() <= before
    left = {(r["doc_id"], bool((r["text"] or "").strip())) for r in docs.collect()}
    # 6 has a copy of 5's text, so both of its rows go; 5's copies were all there were of a repeated text, and it alone is left.
    assert left == ({(None, False), (None, True), (3, False), (4, False), (5, False), (2**62, True)} if rows else set())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(packed) == docs.count()


def test_stages_against_their_operators(spark):
    """What toxicity and decontamination take away is what the operators' own queries report."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())
    toxic = {r["doc_id"] for r in queries.QUERIES["op8_mil_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert toxic and ids(stages["toxicity"](spark, docs, SF)) == [i for i in ids(docs) if i not in toxic]
    leaked = {r["doc_id"] for r in queries.QUERIES["op2_tiling"](spark, SF).collect()}
    assert leaked and ids(stages["benchmark_decontamination"](spark, docs, SF)) == [i for i in ids(docs) if i not in leaked]
