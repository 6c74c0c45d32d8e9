"""Operator 2: quality by votes of the nearest labelled texts in a latent-semantic space.

A text's terms are its character trigrams (code points, case kept) and a mark for each word equal to
the one before it, hashed to ``TERMS`` dimensions. Root frequencies times inverse document
frequencies, less the sample's mean, are projected on the ``LATENT`` leading singular directions and
normalised.

``fit`` takes the directions from at most ``BASIS_ROWS`` labelled texts, in one task, and keeps the vectors of at
most ``FIT_ROWS`` of them: FIT_ROWS x LATENT numbers, the proven bound of what is broadcast. ``score``
multiplies each block of texts with all of these vectors at once (exact cosines, no index), takes the
``NEIGHBOURS`` most similar and weighs their labels by similarity. It reads every whole text once and
moves no row.

Defined results: a text without trigrams has no direction and gets the labelled share of class 1; so
does every text if only one neighbour class exists in part; without labelled rows every score is 0;
ties among equally similar neighbours beyond the last place go by the neighbours' order in the
sample; repeated rows are scored each; other columns are not read.
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

BITS = 12
TERMS = (1 << BITS) + 1
LATENT = 64
BASIS_ROWS = 3_000
FIT_ROWS = 8_000
NEIGHBOURS = 15
SHARPNESS = 4
REPEAT_WEIGHT = 12.0
THRESHOLD = 0.3
BLOCK = 1 << 20


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the hashed terms, a row per text."""
    flat, begins = code_points(texts, 3)
    ((_, codes),) = gram_codes(flat, (3,), BITS)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))[: len(codes)]
    whole = (flat[: len(codes)] != 0) & (flat[2:] != 0) if len(codes) else np.empty(0, bool)
    counts = np.bincount((owner * TERMS + codes)[whole], minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32)
    for i, text in enumerate(texts):
        words = (text or "").split()
        counts[i, -1] = sum(map(str.__eq__, words, words[1:])) * REPEAT_WEIGHT
    return counts


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # TERMS
    mean: np.ndarray  # TERMS
    basis: np.ndarray  # TERMS x LATENT
    vectors: np.ndarray  # labelled texts x LATENT, unit length
    labels: np.ndarray

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of unit length; a text without terms gets zeros."""
        at = (weighted(counts, self.idf) - self.mean) @ self.basis
        at[counts.sum(axis=1) == 0] = 0
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * idf


def leading_directions(x: np.ndarray, k: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    k = min(k, *x.shape)
    start = np.random.Generator(np.random.PCG64(5)).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        start = np.linalg.qr(x.T @ (x @ start))[0]
    _, _, right = np.linalg.svd(x @ start, full_matrices=False)
    return (start @ right.T)[:, :k].astype(np.float32)


def learn_space(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverse document frequencies, mean and directions of a bounded sample of texts, in one task."""
    parts = [term_counts(texts) for batch in batches for texts in text_blocks(batch.column("text"), BLOCK)]
    if not parts:
        return
    counts = np.concatenate(parts)
    parts.clear()
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(counts, idf)
    mean = x.mean(axis=0)
    x -= mean
    basis = leading_directions(x, LATENT)
    blobs = [pa.array([np.ascontiguousarray(v, np.float32).tobytes()], pa.binary()) for v in (idf, mean, basis)]
    yield pa.RecordBatch.from_arrays(blobs, ["idf", "mean", "basis"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, basis_rows: int = BASIS_ROWS) -> Model:
    sample = settle(training_texts(docs, labels, label, rows).where("label IN (0, 1)"))
    some = sample.orderBy(F.xxhash64("text"), "label").limit(basis_rows).repartition(1)
    got = some.mapInArrow(learn_space, "idf binary, mean binary, basis binary").first()
    if got is None:
        empty = np.zeros((0, LATENT), np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros(TERMS, np.float32), np.zeros((TERMS, LATENT), np.float32), empty, np.empty(0))
    idf, mean = (np.frombuffer(got[c], np.float32) for c in ("idf", "mean"))
    space = Model(idf, mean, np.frombuffer(got["basis"], np.float32).reshape(TERMS, -1), np.empty(0), np.empty(0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [v.tobytes() for texts in text_blocks(batch.column("text"), BLOCK) for v in space.vectors_of(term_counts(texts)).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], ["label", "vector"])

    known = sorted((bytes(r["vector"]), r["label"]) for r in sample.mapInArrow(project, "label int, vector binary").collect())
    vectors = np.stack([np.frombuffer(v, np.float32) for v, _ in known])
    return Model(idf, mean, space.basis, vectors, np.array([y for _, y in known], np.float32))


def votes(model: Model, vectors: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The similarity-weighted mean label of each vector's ``k`` nearest labelled vectors."""
    share = float(model.labels.mean()) if len(model.labels) else 0.0
    if not len(model.labels):
        return np.zeros(len(vectors))
    k = min(k, len(model.labels))
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), 256):
        near = vectors[at : at + 256] @ model.vectors.T
        best = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.clip(np.take_along_axis(near, best, axis=1), 0, None).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * model.labels[best]).sum(axis=1)
        out[at : at + 256] = np.where(total > 0, vote / np.maximum(total, 1e-300), share)
    return np.clip(out, 0, 1)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of every text of a column, in blocks."""
    out = [np.empty(0)]
    for block in text_blocks(texts, BLOCK):
        for at in range(0, len(block), 512):
            out.append(votes(model, model.vectors_of(term_counts(block[at : at + 512]))))
    return np.concatenate(out)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(scores(model, batch.column("_t")))], ["_k", "score"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    scored = rows.mapInArrow(run, f"_k {rows.schema['_k'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("_k").alias(key), held_out("_k").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score`` would predict 1, without moving any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
