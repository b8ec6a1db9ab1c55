"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a probability from hashed weights of its words and of their first
letters (which inflected forms share), and the document's is their noisy-or: it is toxic unless every sentence is clean.  The weights are trained from document labels alone, and the
sentences that carry a document's score are the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import Scratch, packed_rows
from .samples import held_out, sampled_texts, training_labels
from .tiling import fold

#: Most labelled documents that a model is fitted on, half of them of each class.
SAMPLE_BOUND = 5_000
#: Hashed weights.
BITS = 20
#: Features in at least so many sampled documents get a weight.
MIN_DOCUMENTS = 4
#: Least log odds ratio between toxic and other sampled documents for a feature to be trained.
MIN_LOG_ODDS = 1.0
#: Bytes of a word's beginnings that are features beside the word.
PREFIXES = (4, 5, 6)

_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def sentences(chunk: K.Chunk) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Folded words; first word of each sentence with a word; its document; and a row of places in the weights for the
    words and for each of their beginnings.

    A sentence ends with ``.``, ``!``, ``?`` or a line break that is followed by white space or the text's end.
    """
    data, folded = chunk.data, fold(chunk.data)
    w = K.words(K.Chunk(chunk.first, folded, chunk.offsets))
    after = np.r_[K._SPACE[data[1:]], True] if len(data) else np.zeros(0, bool)
    stops = np.r_[0, np.cumsum(_STOP[data] & (after | (data == 10)))]
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    number = stops[w.start]
    first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
    hashes = [w.hash, *K.span_hashes(folded, w.start, [np.minimum(w.end, w.start + n) for n in PREFIXES])]
    places = [K.mix(h + np.uint64(k)) >> np.uint64(64 - BITS) for k, h in enumerate(hashes)]
    return w, first, doc[first], np.stack(places).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentence_scores(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probability, document, first byte and end byte of each sentence."""
        w, first, doc, place = sentences(chunk)
        if not len(first):
            return np.zeros(0), doc, np.zeros(0, np.int64), np.zeros(0, np.int64)
        z = np.add.reduceat(self.weights[place].sum(0, dtype=np.float64), first) + self.bias
        last = np.r_[first[1:], len(w.start)] - 1
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), doc, w.start[first], w.end[last]

    def scores(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: the noisy-or, its most toxic sentence's number (-1: none) and that one's probability."""
        p, doc, _, _ = self.sentence_scores(chunk)
        n = len(chunk.offsets) - 1
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        worst, most = np.full(n, -1), np.zeros(n)
        if len(p):
            order = np.lexsort((-np.arange(len(p)), p, doc))
            last = np.flatnonzero(np.r_[doc[order][1:] != doc[order][:-1], True])
            begin = np.searchsorted(doc, np.arange(n))
            top = order[last]
            worst[doc[top]], most[doc[top]] = top - begin[doc[top]], p[top]
        return 1 - np.exp(clean), worst, most


class Bag(NamedTuple):
    """A training document: its number of sentences, and the features that occur in them with the sentence of each.

    ``sentence`` numbers only the sentences that have a feature, from 0.
    """

    sentences: int
    feature: np.ndarray
    sentence: np.ndarray


class _Joined:
    """Bags laid end to end."""

    def __init__(self, bags: list[Bag]) -> None:
        counts = np.array([int(b.sentence.max()) + 1 if len(b.sentence) else 0 for b in bags])
        self.plain = np.array([b.sentences for b in bags]) - counts
        self.feature = np.concatenate([b.feature for b in bags]).astype(np.int64)
        self.sentence = np.concatenate([b.sentence + n for b, n in zip(bags, np.cumsum(counts) - counts)]).astype(np.int64)
        self.doc, self.n = np.repeat(np.arange(len(bags)), counts), int(counts.sum())


def noisy_or_step(w: np.ndarray, bias: float, bags: _Joined, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Weighted log loss of the documents' noisy-or, and its gradient by the features' weights and by the bias.

    Sentences without a feature all have the probability of the bias, so their number is enough.
    """
    p = 1 / (1 + np.exp(-np.clip(np.bincount(bags.sentence, w[bags.feature], bags.n) + bias, -30, 30)))
    p0 = 1 / (1 + np.exp(-np.clip(bias, -30, 30)))
    log_clean = np.bincount(bags.doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + bags.plain * np.log1p(-min(p0, 1 - 1e-9))
    clean = np.exp(log_clean)
    toxic = np.maximum(1 - clean, 1e-9)
    by_doc = weight * np.where(y == 1, -clean / toxic, 1.0)
    g = p * by_doc[bags.doc]
    loss = float((weight * np.where(y == 1, -np.log(toxic), -log_clean)).sum())
    return loss, np.bincount(bags.feature, g[bags.sentence], len(w)), float(g.sum() + p0 * (bags.plain * by_doc).sum())


def fit_noisy_or(bags: list[Bag], y: np.ndarray, weight: np.ndarray, odds: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias that gradient descent finds.

    ``odds``: log odds ratio of each feature, from which its weight starts.
    """
    joined, weight = _Joined(bags), weight / weight.sum()
    w, bias = odds.clip(0, 6) / (1 + len(PREFIXES)), np.array([-6.0])
    moments = [np.zeros(len(w)), np.zeros(len(w)), np.zeros(1), np.zeros(1)]
    for t in range(1, steps + 1):
        _, by_weight, by_bias = noisy_or_step(w, bias[0], joined, y, weight)
        for k, (value, d) in enumerate(((w, by_weight + decay * w), (bias, np.array([by_bias])))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * d
            moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * d * d
            value -= rate * (1 - t / (steps + 1)) * (moments[2 * k] / (1 - 0.9**t)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.999**t)) + 1e-8)
    return w, float(bias[0])


def _places(sample: DataFrame) -> DataFrame:
    """Rows (place, y) of the distinct features of each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for chunk in K.chunks(batch.column(1)):
                w, _, _, place = sentences(chunk)
                doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
                own = np.unique(place + (doc << BITS))  # a feature counts once for a document
                yield pa.RecordBatch.from_arrays([pa.array((own & ((1 << BITS) - 1)).astype(np.int32)), pa.array(y[chunk.first + (own >> BITS)].astype(np.int32))], names=["place", "y"])

    return sample.select("y", "_text").mapInArrow(run, "place int, y int")


def _bags(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """Rows (y, weight, sentences, feature, sentence) of the sampled documents; ``known``: sorted places of the features."""
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            for chunk in K.chunks(batch.column(2)):
                w, first, doc, place = sentences(chunk)
                at = np.minimum(np.searchsorted(places, place), max(0, len(places) - 1))
                hit = places[at] == place if len(places) else np.zeros(place.shape, bool)
                number = np.zeros(len(w.start), np.int64)
                number[first] = 1
                number, n_docs = np.cumsum(number), len(chunk.offsets) - 1
                n_sentences, feature, sentence = np.bincount(doc, minlength=n_docs), [], []
                for d in range(n_docs):
                    own = slice(w.bounds[d], w.bounds[d + 1])
                    mine = hit[:, own]
                    feature.append(at[:, own][mine].astype("<i4").tobytes())
                    sentence.append(np.unique(np.tile(number[own], (len(mine), 1))[mine], return_inverse=True)[1].astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(chunk.first, n_docs) for c in batch.columns[:2]), pa.array(n_sentences.astype(np.int64)), pa.array(feature, pa.binary()), pa.array(sentence, pa.binary())],
                    names=["y", "weight", "sentences", "feature", "sentence"],
                )

    return sample.select("y", "weight", "_text").mapInArrow(run, "y int, weight double, sentences long, feature binary, sentence binary")


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = SAMPLE_BOUND, text: str = "text") -> Model:
    """Fit on the texts of at most about ``bound`` labelled documents.

    Features are counted and chosen by Spark (at most as many as there are hashed weights); only the occurrences of
    chosen ones in the sample come to the driver.  Rows without an id or a label are not learnt from, an id with several
    labels is toxic if one says so, and of several texts of an id one is learnt from; with labels of one class, or none, all documents get
    that class (none: clean).  Extra columns of either table are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mil-toxicity")
    chosen = training_labels(labels, column, bound, seed=3).select(F.col("doc_id").alias("_id"), "y", "weight")
    sample = sampled_texts(docs, chosen, bound, scratch, text)
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or toxic in (0, n):
        return Model(np.zeros(1 << BITS), 30.0 if toxic else -30.0)
    counted = _places(sample).groupBy("place").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    ratio = F.log((F.col("t") + 1) / (toxic + 1) * (n - toxic + 1) / (F.col("n") - F.col("t") + 1))
    used = counted.where(F.col("n") >= min(MIN_DOCUMENTS, max(1, n // 50))).select("place", ratio.alias("odds")).where(F.col("odds") >= MIN_LOG_ODDS)
    found = sorted((r["place"], r["odds"]) for r in used.toLocalIterator())
    known, odds = np.array([p for p, _ in found], np.int64), np.array([o for _, o in found], np.float64)
    y, weight, bags = [], [], []
    for r in _bags(sample, known).toLocalIterator():
        bags.append(Bag(r["sentences"], np.frombuffer(r["feature"], "<i4"), np.frombuffer(r["sentence"], "<i4")))
        y.append(r["y"])
        weight.append(r["weight"])
    weights = np.zeros(1 << BITS)
    weights[known], bias = fit_noisy_or(bags, np.array(y), np.array(weight), odds)
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, worst_sentence, worst_score) of all documents.

    ``worst_sentence`` counts a document's sentences from 0.  Null, empty and wordless texts score 0 and have no worst
    sentence (-1); repeated rows score alike; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                s, worst, most = shared.value.scores(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(s)), pa.array(s), pa.array(worst.astype(np.int32)), pa.array(most)], names=["doc_id", "score", "worst_sentence", "worst_score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", F.col(text).cast("string").alias("_text")).mapInArrow(run, f"doc_id {kind}, score double, worst_sentence int, worst_score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_sentence", "worst_score")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows (doc_id, sentence, score) with the text of every sentence that scores ``threshold`` or more.

    Null, empty and wordless texts have no sentences; repeated rows give theirs again; an empty table gives an empty
    result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                p, doc, start, end = shared.value.sentence_scores(chunk)
                hit, body = np.flatnonzero(p >= threshold), chunk.data.tobytes()
                found = [body[start[k] : end[k]].decode("utf-8", "replace") for k in hit.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[hit] + chunk.first)), pa.array(found, pa.string()), pa.array(p[hit])], names=["doc_id", "sentence", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(text).cast("string").alias("_text")).mapInArrow(run, f"doc_id {kind}, sentence string, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents that score below the threshold, all columns unchanged, whatever their names.

    Null, empty and wordless texts score 0 and stay; repeated rows go or stay together; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(c)[0] for c in K.chunks(batch.column(1).cast(pa.string()))]
            keep = np.concatenate(parts) < threshold if parts else np.zeros(0, bool)
            yield batch.select([0]).filter(pa.array(keep))

    rows = packed_rows(docs, _text=F.col(text).cast("string"))
    return rows.mapInArrow(run, T.StructType([rows.schema["_row"]])).select("_row.*")
