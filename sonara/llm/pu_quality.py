"""Quality classifier by positive-unlabelled learning.

A text becomes a few dozen numbers that describe its form (lengths, character classes, repetition, line shapes).  A
small network is trained by the non-negative unbiased risk on trusted positives and unlabelled web text with an
estimated class prior: no negative label enters the risk or the prior.  Training takes bounded samples of the rows that
have labels, with the labels of those taken as unlabelled put aside; scoring goes over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch
from .quality_rules import text_statistics
from .samples import hashed_sample, held_out, sampled_texts, training_labels

#: Most positives, and most rows taken as unlabelled, that a model is fitted on.
SAMPLE_BOUND = 10_000
#: Steps of the discriminator behind the prior: stopped early, it ranks rows by what sets positives apart in general.
PRIOR_STEPS = 30

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#*$%&",
    "angle": b"<>{}[]=/\\_",
    "quote": b"\"'()-",
    "at": b"@",
}
_CLASS_OF = np.zeros((len(_CLASSES), 256), bool)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[_k, list(_members)] = True


def form_features(chunk: K.Chunk) -> np.ndarray:
    """One row of numbers for each document of a chunk; an empty text has them too."""
    data, offsets = chunk.data, chunk.offsets
    stats, w = text_statistics(chunk), K.words(chunk)
    n_docs = len(offsets) - 1
    doc_of_word = np.repeat(np.arange(n_docs), np.diff(w.bounds))
    n_bytes, n_words = np.diff(offsets), stats["n_words"]
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
    number = np.zeros(256, np.int64)
    for k in range(len(_CLASSES)):
        number[_CLASS_OF[k]] = k + 1
    number[128:] = len(_CLASSES) + 1
    kinds = len(_CLASSES) + 2
    doc_of_byte = np.repeat(np.arange(n_docs) * kinds, n_bytes)
    shares = np.bincount(doc_of_byte + number[data], minlength=n_docs * kinds).reshape(n_docs, kinds) * per_byte[:, None]

    size = (w.end - w.start).astype(np.float64)
    mean = np.bincount(doc_of_word, size, n_docs) * per_word
    spread = np.sqrt(np.maximum(np.bincount(doc_of_word, size * size, n_docs) * per_word - mean**2, 0))
    long_share = np.bincount(doc_of_word, size > 20, n_docs) * per_word
    short_share = np.bincount(doc_of_word, size <= 2, n_docs) * per_word
    last = np.zeros(256, bool)
    last[list(b".!?")] = True
    ends = np.bincount(doc_of_word, last[data[w.end - 1]] if len(w.end) else np.zeros(0), n_docs) * per_word
    key = np.sort(K.mix(w.hash + doc_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | (doc_of_word.astype(np.uint64) << np.uint64(44)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    variety = np.bincount((key >> np.uint64(44)).astype(np.int64), new, n_docs) * per_word
    breaks = np.bincount(np.repeat(np.arange(n_docs), n_bytes), data == 10, n_docs)
    columns = [
        np.log1p(n_words), np.minimum(n_words, 100) / 100, mean / 10, np.log1p(mean), spread / 10, long_share, short_share, ends, np.minimum(ends, 0.3),
        variety, variety * np.log1p(n_words) / 10, breaks * per_word, np.log1p(breaks),
        stats["n_dup_lines"] * per_word, np.log1p(stats["n_dup_lines"]), stats["n_dup_lines"] / (breaks + 1), stats["n_repeat_words"] * per_word, np.log1p(stats["n_repeat_words"]),
        np.log1p(100 * stats["n_symbols"] * per_word), stats["word_chars"] * per_word / 10, *shares.T, *np.sqrt(shares[:, 1:]).T,
    ]
    return np.stack(columns, 1).astype(np.float32)


def _with_features(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                x = form_features(chunk)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(x)), rows], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("_text")).mapInArrow(run, "doc_id long, x array<float>")


class Model(NamedTuple):
    """Standardisation and the weights of one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list

    def score(self, x: np.ndarray) -> np.ndarray:
        _, z = _scores(self.weights, np.clip((x - self.mean) / self.scale, -8, 8))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scores(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden units and outputs before the sigmoid."""
    hid = np.maximum(x @ w[0] + w[1], 0)
    return hid, hid @ w[2] + w[3]


def nnpu_step(w: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """Non-negative unbiased risk ``prior R_p+ + max(0, R_u- - prior R_p-)`` with the logistic loss on a batch, and the
    direction to step against: the risk's gradient, or, where the bracket is below zero, the bracket's turned round."""
    x, n = np.concatenate([positive, unlabelled]), len(positive)
    hid, z = _scores(w, x)
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_negative, as_positive = np.logaddexp(0, z), np.logaddexp(0, -z)
    bracket = as_negative[n:].mean() - prior * as_negative[:n].mean()
    g_neg = np.concatenate([-prior * s[:n] / n, s[n:] / len(unlabelled)])
    g_pos = np.concatenate([prior * (s[:n] - 1) / n, np.zeros(len(unlabelled))])
    g = -g_neg if bracket < 0 else g_pos + g_neg
    gh = np.outer(g, w[2]) * (hid > 0)
    return prior * as_positive[:n].mean() + max(0.0, bracket), [x.T @ gh, gh.sum(0), hid.T @ g, np.array([g.sum()])]


def discriminator_step(w: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean logistic loss of telling positives from unlabelled rows, both counted alike, and its gradient."""
    x, n = np.concatenate([positive, unlabelled]), len(positive)
    hid, z = _scores(w, x)
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    g = np.concatenate([(s[:n] - 1) / n, s[n:] / len(unlabelled)]) / 2
    gh = np.outer(g, w[2]) * (hid > 0)
    return (np.logaddexp(0, -z[:n]).mean() + np.logaddexp(0, z[n:]).mean()) / 2, [x.T @ gh, gh.sum(0), hid.T @ g, np.array([g.sum()])]


def _descend(step: Callable, positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 32, steps: int = 600, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise what ``step`` measures over batches, with weight decay and adaptive moments, in about ``steps`` steps."""
    rng = np.random.default_rng(seed)
    width = unlabelled.shape[1]
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    norm = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = norm(positive), norm(unlabelled)
    w = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    first, second, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    while t < steps:
        order_u, order_p = rng.permutation(len(u)), rng.permutation(len(p))
        for k in range(max(1, len(u) // batch)):
            xu, xp = u[order_u[k * batch : (k + 1) * batch]], p[np.take(order_p, range(k * batch, (k + 1) * batch), mode="wrap")]
            _, grads = step(w, xp, xu)
            t += 1
            lr = rate * max(0.0, 1 - t / steps)
            for i, d in enumerate(grads):
                d = d + decay * w[i] if i in (0, 2) else d
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                w[i] = w[i] - lr * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, **more) -> Model:
    """Minimise the non-negative unbiased risk."""
    return _descend(lambda w, p, u: nnpu_step(w, p, u, prior), positive, unlabelled if len(unlabelled) else positive, **more)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2, seed: int = 11) -> float:
    """Share of positives among unlabelled rows, without a negative label.

    Any set of rows holds at least the prior times its share of positives: prior <= U(A) / P(A).  The sets are those that a
    discriminator between positives and unlabelled rows scores highest, cut where they hold 50 to 95 % of the positives;
    rows are scored by the fold that did not see them.  The least ratio is the estimate, from 0.01 to 0.99.
    """
    rng = np.random.default_rng(seed)
    of_p, of_u = rng.permutation(len(positive)) % folds, rng.permutation(len(unlabelled)) % folds
    least = []
    for k in range(folds):
        seen_p, seen_u, own_p, own_u = positive[of_p != k], unlabelled[of_u != k], positive[of_p == k], unlabelled[of_u == k]
        if not min(map(len, (seen_p, seen_u, own_p, own_u))):
            return 0.5
        model = _descend(discriminator_step, seen_p, seen_u, steps=PRIOR_STEPS)
        p, u = model.score(own_p), model.score(own_u)
        cuts = np.quantile(p, 1 - np.arange(0.5, 0.96, 0.05))
        least.append([(u >= t).mean() / (p >= t).mean() for t in cuts])
    return float(np.clip(np.mean(least, 0).min(), 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", prior: float | None = None, bound: int = SAMPLE_BOUND, text: str = "text") -> Model:
    """Fit on the texts of at most about ``bound`` trusted positives and of as many labelled rows whose labels are not
    looked at.

    The prior, unless given, is estimated from these two (``estimate_prior``).  Rows without an id are not learnt from; of
    several texts of an id one is; without positives or texts the model scores the prior, or 0.5 if none is given; extra
    columns of either table are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pu-quality")
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    positives = training_labels(labels.where(F.col(column) == 1), column, 2 * bound, seed=1)
    ids = usable.select("doc_id").distinct()
    gather = lambda chosen: np.array([r["x"] for r in _with_features(sampled_texts(docs, chosen.select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("doc_id")), bound, scratch, text), "_text").select("x").toLocalIterator()], np.float64)
    p, u = gather(positives), gather(hashed_sample(ids, bound, ids.count(), seed=2))
    if not len(p) or not len(u):
        prior = 0.5 if prior is None else min(max(prior, 0.01), 0.99)
        return Model(np.zeros(1), np.ones(1), [np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.array([np.log(prior / (1 - prior))])])
    return fit_nnpu(p, u, estimate_prior(p, u) if prior is None else min(max(prior, 0.01), 0.99))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of all documents.

    Null and empty texts are scored alike; repeated rows get equal scores; an empty table gives an empty result; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                x = form_features(chunk)
                s = shared.value.score(x if x.shape[1] == len(shared.value.mean) else np.zeros((len(x), len(shared.value.mean))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(x)), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", F.col(text).cast("string").alias("_text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
