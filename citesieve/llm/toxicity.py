"""Toxicity scores by weak supervision.

Words that mark toxic rows among the labelled training rows become a lexicon. Each lexicon word, and some
patterns over the whole text, is a voter that says toxic, clean, or nothing. A generative label model
estimates, without labels, how often each voter is right for either class, and how far voters repeat one
another beyond that; its posterior labels train a linear classifier, whose scores are then put on the scale
of the labels. Fitting takes a bounded sample of labelled rows; scoring takes every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import hashed_share
from .text import LOWER, NO_ALNUM, slices, span_hashes, utf8, word_spans

#: Fitting takes at most about this many labelled rows, chosen by a hash of doc_id.
MOST_TRAINING = 12_000
#: A lexicon word stands in at least so many toxic rows of the sample, and is so much likelier there than elsewhere.
LEAST_ROWS, LEAST_LIFT = 5, 8.0
#: A lexicon of more words is refused; none is cut.
MOST_WORDS = 1024
#: Rounds of expectation maximisation, and of the classifier's fitting.
ROUNDS = 50
TOXIC, CLEAN, SILENT = 1, 0, -1


@dataclass
class Model:
    """Lexicon hashes (ascending) and the classifier: feature weights, bias, and the scale of the labels."""

    lexicon: np.ndarray
    weights: np.ndarray
    bias: float
    scale: tuple[float, float]


def _word_hashes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets, NO_ALNUM)
    return span_hashes(LOWER[data], starts, ends), first, data, offsets


def features(column, lexicon: np.ndarray) -> np.ndarray:
    """For each text: the count of each lexicon word, then words, upper-case letters, exclamation marks and bytes."""
    words, first, data, offsets = _word_hashes(column)
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    out = np.zeros((texts, len(lexicon) + 4))
    if len(lexicon) and len(words):
        at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
        hit = lexicon[at] == words
        out[:, :-4] = np.bincount(owner[hit] * len(lexicon) + at[hit], minlength=texts * len(lexicon)).reshape(texts, -1)
    out[:, -4] = np.diff(first)
    for k, which in ((-3, (data >= 65) & (data <= 90)), (-2, data == 33)):
        sums = np.concatenate([[0], np.cumsum(which)])
        out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    out[:, -1] = np.diff(offsets)
    return out


def votes(x: np.ndarray) -> np.ndarray:
    """One column a voter: each lexicon word, then patterns of the lexicon's use and of the text's form."""
    counts, (words, upper, marks, size) = x[:, :-4], x[:, -4:].T
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    share = total / np.maximum(words, 1)
    patterns = [
        np.where(total >= 2, TOXIC, SILENT), np.where(kinds >= 2, TOXIC, SILENT), np.where(share >= 0.01, TOXIC, SILENT), np.where(share >= 0.003, TOXIC, SILENT),
        np.where(total == 0, CLEAN, SILENT), np.where((total == 0) & (words >= 50), CLEAN, SILENT), np.where((total == 0) & (words < 50), CLEAN, SILENT),
        np.where((upper > 0.5 * size) & (marks > 0.02 * size) & (total > 0), TOXIC, SILENT), np.where((marks == 0) & (total == 0), CLEAN, SILENT),
    ]
    return np.column_stack([np.where(counts > 0, TOXIC, SILENT), *patterns])


def inputs(x: np.ndarray) -> np.ndarray:
    """What the linear classifier sees."""
    counts, words = x[:, :-4], x[:, -4]
    total = counts.sum(1)
    return np.column_stack([np.minimum(counts, 3), np.log1p(total), total > 0, (counts > 0).sum(1), np.minimum(1, total / np.maximum(words, 1) * 20)])


def label_model(v: np.ndarray, prior: float, n: np.ndarray | None = None) -> np.ndarray:
    """Posterior probability of toxic for each row of votes; ``n`` tells how often each row comes.

    Expectation maximisation gives each voter's rate of each vote in either class. Voters whose votes still
    move together within a class (correlation of what the model leaves over) share their weight. What is left
    over is never laid out: its sums follow from those of the votes and of the expected votes.
    """
    n = np.ones(len(v)) if n is None else n.astype(float)
    toxic, clean = ((v == k).astype(np.float32) for k in (TOXIC, CLEAN))
    signed = toxic - clean
    total, sums = n.sum(), n @ signed
    gram = (signed * n[:, None].astype(np.float32)).T @ signed
    posterior = np.clip(0.02 + 0.96 * (toxic.sum(1) > clean.sum(1)), 0.02, 0.98)
    for _ in range(ROUNDS):
        classes = np.column_stack([posterior, 1 - posterior])
        mass = n @ classes
        said = [(n[:, None] * classes).T @ s for s in (toxic, clean)]
        said.append(mass[:, None] - said[0] - said[1])
        rates = [(s + 1.0) / (mass[:, None] + 3.0) for s in said]
        expected = rates[0] - rates[1]
        met = (said[0] - said[1]).T @ expected
        own = (n[:, None] * classes).T @ classes
        left = gram - met - met.T + expected.T @ own @ expected
        mean = (sums - mass @ expected) / total
        spread = np.sqrt(np.maximum(np.diag(left) / total - mean**2, 0))
        spread = np.maximum(spread, 1e-9)
        correlation = np.abs(left) / (total * np.outer(spread, spread))
        np.fill_diagonal(correlation, 0)
        share = 1 / (1 + np.where(correlation > 0.2, correlation, 0).sum(0))
        gain = [share * np.log(r[0] / r[1]) for r in rates]
        log_odds = np.log(prior / (1 - prior)) + gain[2].sum() + toxic @ (gain[0] - gain[2]) + clean @ (gain[1] - gain[2])
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    return posterior


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels of rows that come ``n`` times, by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        weighted = x1 * (n * p * (1 - p))[:, None]
        step = np.linalg.solve(weighted.T @ x1 + np.diag(penalty + 1e-9), x1.T @ (n * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _lexicon(rows: DataFrame) -> np.ndarray:
    """Hashes of the words that mark toxic rows. A row counts a word once."""

    def count(batches):
        for part in slices(batches):
            words, first, _, _ = _word_hashes(part.column("text"))
            toxic = np.repeat(np.array(part.column("toxic").to_pylist(), np.int64), np.diff(first))
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            order = np.lexsort((words, owner))
            words, owner, toxic = words[order], owner[order], toxic[order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
            kinds, back = np.unique(words[new], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(np.bincount(back, toxic[new], len(kinds)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(kinds)).astype(np.int64))], ["word", "toxic", "n"]
            )

    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    toxic, clean = totals.toxic or 0, totals.n - (totals.toxic or 0)
    if not toxic or not clean:
        return np.zeros(0, np.uint64)
    words = rows.select("text", "toxic").mapInArrow(count, "word bigint, toxic bigint, n bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    lift = (F.col("toxic") / toxic) / ((F.col("n") - F.col("toxic") + 0.5) / clean)
    top = words.filter(F.col("toxic") >= LEAST_ROWS).filter(lift >= LEAST_LIFT).select("word").limit(MOST_WORDS + 1).collect()
    if len(top) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words are typical of toxic rows")
    return np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))


def trained(documents: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model:
    """Fit on the rows of ``documents`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1, at most about ``most``.

    Rows without doc_id, text or label are left out of fitting. Without both classes the model scores all
    rows by the share of toxic ones.
    """
    marked = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = marked.count()
    if total > most:
        marked = marked.filter(hashed_share("doc_id") < most / total)
    rows = documents.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(marked), "doc_id")
    lexicon = _lexicon(rows)

    def read(batches):
        for part in slices(batches):
            x = features(part.column("text"), lexicon)
            laid = zip(votes(x).astype(np.int8), inputs(x), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([v.tobytes() + i.tobytes() for v, i in laid], pa.binary())], ["toxic", "row"])

    # Rows with the same votes and inputs are one row that comes so often; Spark counts them.
    counted = rows.select("toxic", "text").mapInArrow(read, "toxic int, row binary").groupBy("row").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    sample = counted.toArrow().sort_by("row")
    n, toxic = (sample.column(c).to_numpy().astype(float) for c in ("n", "toxic"))
    share = float(np.clip(toxic.sum() / n.sum(), 1e-3, 1 - 1e-3)) if len(n) else 0.1
    if not len(lexicon):
        return Model(lexicon, np.zeros(4), 0.0, (0.0, float(np.log(share / (1 - share)))))
    voters = votes(np.zeros((1, len(lexicon) + 4))).shape[1]
    laid = np.frombuffer(b"".join(sample.column("row").to_pylist()), np.uint8).reshape(len(n), -1)
    v, x = laid[:, :voters].view(np.int8), np.ascontiguousarray(laid[:, voters:]).view(np.float64)
    weights, bias = logistic(x, label_model(v, share, n), n)
    raw = x @ weights + bias
    (slope,), shift = logistic(raw[:, None], toxic / n, n, ridge=1e-3)
    return Model(lexicon, weights, bias, (float(max(slope, 0.0)), shift))


def _probabilities(model: Model, column) -> np.ndarray:
    slope, shift = model.scale
    raw = inputs(features(column, model.lexicon)) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``documents`` (doc_id, text); null and empty texts score as texts without words.

    Repeated rows stay; other columns are ignored. The model is a few kilobytes and goes with the tasks.
    """

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_probabilities(model, part.column("text")))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def kept(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that score under the threshold, with all their columns."""

    def run(batches):
        for part in slices(batches):
            yield part.filter(pa.array(_probabilities(model, part.column("text")) < threshold))

    return documents.mapInArrow(run, documents.schema)
