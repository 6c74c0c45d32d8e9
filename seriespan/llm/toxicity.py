"""Operator 1: toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features are the character n-grams (code points, lower case) of 3 to 5 characters that a text has,
hashed to ``BITS`` bits. Each is scaled by its naive Bayes log-count ratio. The ``FEATURES`` features
whose ratio is furthest from 0 in standard errors get a coefficient of their own in a logistic
regression; all others share one, for the sum of their ratios, each drawn towards 0 by
``DRAWN`` of its standard errors so that chance counts for nothing. So every n-gram of the sample has
a weight, and a score is the sum of the weights of a text's own n-grams, whatever texts lie beside it.

``fit`` learns from at most ``FIT_ROWS`` labelled rows. A first job counts, per class, the texts that
have a feature, combined per task and then by feature. A second job returns what each sample text has
of them, and the regression (Newton steps on at most FIT_ROWS x (FEATURES + 2) values) is solved from
these. ``score`` reads every whole text once and moves no row; broadcast are ``2**BITS`` weights (4 MB).

Defined results: null and empty texts get the score of a text without features; without labelled rows
of both classes every score is the share of class 1 (0 without any labelled row); repeated rows are
scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .labelled import held_out, training_texts
from .text import code_points, gram_codes, text_blocks

BITS = 20
GRAMS = (3, 4, 5)
FIT_ROWS = 16_000
FEATURES = 768
SMOOTHING = 1.0
PENALTY = 1.0
THRESHOLD = 0.5
#: Standard errors by which the ratios without an own coefficient are drawn towards 0.
DRAWN = 3.0
#: The drawn ratios' sum is divided by this beside the features' own ratios, so that the penalty is alike.
REST_SCALE = 16.0
COUNT_BLOCK = 1 << 19


@dataclass(frozen=True)
class Model:
    """The weight of every feature code and the intercept."""

    weights: np.ndarray
    intercept: float


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, feature) pairs; with ``wanted``, only features it marks.

    The zeros between texts begin no n-gram, and a text's own n-grams end before the next text, so a
    text has the same features alone and among others.
    """
    flat, begins = code_points(texts, max(GRAMS) - 1, lower=True)
    ends = begins[1:] - (max(GRAMS) - 1)
    found = []
    for _, codes in gram_codes(flat, GRAMS, BITS):
        at = np.arange(len(codes)) if wanted is None else np.flatnonzero(wanted[codes])
        text = np.searchsorted(begins, at, "right") - 1
        own = at < ends[text]
        found.append((text[own] << BITS) + codes[at[own]])
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def class_counts(sample: DataFrame) -> DataFrame:
    """``code, ones, zeros``: texts of each class that have the feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            labels, at = batch.column("label").to_numpy(), 0
            for texts in text_blocks(batch.column("text"), COUNT_BLOCK):
                text, code = features(texts)
                mine = labels[at : at + len(texts)][text]
                at += len(texts)
                for side in (0, 1):
                    totals[side] += np.bincount(code[mine == side], minlength=1 << BITS).astype(np.int32)
        seen = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(totals[1][seen].astype(np.int64)), pa.array(totals[0][seen].astype(np.int64))],
            ["code", "ones", "zeros"],
        )

    counts = sample.mapInArrow(count, "code int, ones long, zeros long")
    return counts.groupBy("code").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def ratios_of(counts: pa.Table, ones: int, zeros: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every code's log-count ratio, its distance from 0 in standard errors, and the ratio drawn towards 0."""
    seen = counts.column("code").to_numpy()
    p, q = (counts.column(c).to_numpy() + SMOOTHING for c in ("ones", "zeros"))
    ratio, z, drawn = (np.zeros(1 << BITS) for _ in range(3))
    room = SMOOTHING * (1 << BITS)
    ratio[seen] = np.log(p / (p.sum() - SMOOTHING * len(p) + room)) - np.log(q / (q.sum() - SMOOTHING * len(q) + room))
    # against the classes' sizes, so that the standard error is that of a difference of shares
    gap, error = np.log(p / ones) - np.log(q / zeros), np.sqrt(1 / p + 1 / q)
    z[seen] = np.abs(gap) / error
    drawn[seen] = np.sign(gap) * np.maximum(np.abs(gap) - DRAWN * error, 0)
    return ratio, z, drawn


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, keep: int = FEATURES) -> Model:
    sample = settle(training_texts(docs, labels, label, rows).where("label IN (0, 1)"))
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.inf if sizes.get(1) else -np.inf)
    ratio, z, drawn = ratios_of(class_counts(sample).toArrow(), sizes[1], sizes[0])
    best = np.lexsort((np.arange(len(z)), -z))[:keep]
    best = best[z[best] > 0]
    number = np.zeros(1 << BITS, np.int32)
    number[best] = np.arange(1, len(best) + 1)
    others = np.where(number > 0, 0, drawn).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((number, others))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, others = shared.value
        wanted = (number > 0) | (others != 0)
        for batch in batches:
            out, sums = [], [np.empty(0)]
            for texts in text_blocks(batch.column("text")):
                text, code = features(texts, wanted)
                sums.append(np.bincount(text, others[code], len(texts)))
                own = number[code] > 0
                text, has = text[own], (number[code[own]] - 1).astype(np.int16)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                out += [has[cut[i] : cut[i + 1]].tobytes() for i in range(len(texts))]
            cells = [batch.column("label"), pa.array(out, pa.binary()), pa.array(np.concatenate(sums))]
            yield pa.RecordBatch.from_arrays(cells, ["label", "has", "rest"])

    got = sample.mapInArrow(rows_of, "label int, has binary, rest double").collect()
    got.sort(key=lambda r: (r["label"], r["has"], r["rest"]))  # the solver adds up rows in one order
    x = np.zeros((len(got), len(best) + 2), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(got):
        has = np.frombuffer(r["has"], np.int16)
        x[i, has] = ratio[best[has]]
        x[i, -2] = r["rest"] / REST_SCALE
    solved = logistic(x, np.array([r["label"] for r in got], np.float32))
    weights = others.astype(np.float64) * max(solved[-2], 0.0) / REST_SCALE
    weights[best] = solved[:-2] * ratio[best]
    return Model(weights.astype(np.float32), float(solved[-1]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    loss = lambda v: float(np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + 0.5 * (ridge * v * v).sum())
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x.T * (p * (1 - p)).astype(np.float32)) @ x + np.diag(ridge + 1e-9)
        step, size = np.linalg.solve(hessian.astype(np.float64), gradient), 1.0
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        after = loss(w - size * step)
        if now - after < 1e-6 * abs(now):
            break
        w, now = w - size * step, after
    return w


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    shared, intercept = docs.sparkSession.sparkContext.broadcast(model.weights), model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        wanted = weights != 0
        for batch in batches:
            out = [np.empty(0)]
            for texts in text_blocks(batch.column("_t")):
                at, code = features(texts, wanted)
                total = np.bincount(at, weights=weights[code], minlength=len(texts)) + intercept
                out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(np.concatenate(out))], ["_k", "score"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    scored = rows.mapInArrow(run, f"_k {rows.schema['_k'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("_k").alias(key), held_out("_k").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
