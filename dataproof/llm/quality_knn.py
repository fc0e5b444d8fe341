"""Quality scores by nearest-neighbour voting in a latent-semantic space (operator 1).

Terms are words, word shapes and a few measures of the whole text, hashed into a fixed number of
columns. A bounded sample of labelled texts gives the term weights and, by a truncated singular value
decomposition, the latent space. The labelled vectors go to all tasks. Every document is projected, its
cosines to all labelled vectors are computed exactly, block by block, and its nearest neighbours vote
with weights that grow with the cosine.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.llm.common import crc_remainder, share, shared, text_batches, whole_text

WORD_COLUMNS, SHAPE_COLUMNS, MEASURE_COLUMNS = 4096, 512, 64
COLUMNS = WORD_COLUMNS + SHAPE_COLUMNS + MEASURE_COLUMNS
#: At most so many labelled texts are learnt from, chosen by a hash of their ids; the broadcast is under 3 MB.
MAX_LABELLED = 4096
DIMENSIONS, NEIGHBOURS, POWER = 48, 15, 8.0
#: Documents of one cosine block.
BLOCK = 512


@dataclass
class Model:
    """``weights`` of the columns, the latent ``basis``, labelled unit ``vectors``, their ``labels`` and the ``prior``."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


class Terms(dict):
    """The columns of a word and of its shape, packed into one number."""

    limit = 1 << 17

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        shape = re.sub(r"\d+", "0", word)
        shape = re.sub(r"[A-Z]{2,}", "B", shape)
        shape = re.sub(r"[^\W\d_A-Z]+", "a", shape)
        column = zlib.crc32(word.lower().encode()) % WORD_COLUMNS
        self[word] = packed = column * SHAPE_COLUMNS + zlib.crc32(shape.encode()) % SHAPE_COLUMNS
        return packed


def _measures(text: str, words: list[str]) -> list[int]:
    """One column for each of four measures of a text, in sixteen steps."""
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    again = len(lines) - len(set(lines))
    few = len(set(words)) / max(1, len(words))
    marks = sum(map(text.count, "#*$%&|<>!")) / max(1, len(text))
    steps = (len(words).bit_length(), 15 * again / max(1, len(lines)), 15 * few, 60 * marks)
    return [16 * i + min(15, int(step)) for i, step in enumerate(steps)]


def term_counts(texts: list[str], terms: Terms) -> np.ndarray:
    """One row of damped term counts for each text."""
    out = np.zeros((len(texts), COLUMNS), dtype=np.float32)
    for row, text in zip(out, texts):
        words = text.split()
        packed = np.fromiter(map(terms.__getitem__, words), dtype=np.int64, count=len(words))
        row[:WORD_COLUMNS] = np.bincount(packed // SHAPE_COLUMNS, minlength=WORD_COLUMNS)
        row[WORD_COLUMNS : WORD_COLUMNS + SHAPE_COLUMNS] = np.bincount(packed % SHAPE_COLUMNS, minlength=SHAPE_COLUMNS)
        row[[WORD_COLUMNS + SHAPE_COLUMNS + i for i in _measures(text, words)]] = 1
    return np.log1p(out, out=out)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted rows; words, shapes and measures count alike whatever the length of the text."""
    counts *= weights
    start = 0
    for width in (WORD_COLUMNS, SHAPE_COLUMNS, MEASURE_COLUMNS):
        part = counts[:, start : start + width]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        start += width
    return counts


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", most: int = MAX_LABELLED) -> Model:
    """A model of at most ``most`` labelled rows of ``df``.

    ``labels`` has the id and a label of 0 or 1; null ids and labels are passed over, several labels of
    an id are averaged and rounded, of several texts of an id one is used. Without labelled texts every
    score is one half.
    """
    chosen = labels.where(labels[id_column].isNotNull() & labels[label].isNotNull())
    chosen = chosen.groupBy(F.col(id_column).alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = df.select(df[id_column].alias("doc_id"), whole_text(df).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")

    def count(batches):
        terms = Terms()
        for part, texts in text_batches(batches, max_rows=BLOCK):
            counts = term_counts(texts, terms)
            yield pa.RecordBatch.from_pydict(
                {
                    "label": part.column(0),
                    "columns": pa.array([np.flatnonzero(row).astype(np.int32) for row in counts], pa.list_(pa.int32())),
                    "counts": pa.array([row[row > 0] for row in counts], pa.list_(pa.float32())),
                }
            )

    found = rows.mapInArrow(count, "label int, columns array<int>, counts array<float>").toArrow()
    matrix = np.zeros((found.num_rows, COLUMNS), dtype=np.float32)
    for row, columns, counts in zip(matrix, found["columns"], found["counts"]):
        row[columns.values.to_numpy()] = counts.values.to_numpy()
    wanted = np.asarray(found["label"].to_numpy(), dtype=np.float32)
    # Rows come in any order; a fixed order makes the decomposition the same every time.
    order = np.lexsort((wanted, *matrix[:, ::97].T, matrix.sum(axis=1)))
    return decompose(matrix[order], wanted[order])


def decompose(matrix: np.ndarray, labels: np.ndarray) -> Model:
    """The model of damped term counts and their labels (a randomised truncated decomposition)."""
    rows = len(matrix)
    weights = np.log((1 + rows) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 1
    matrix = _weighted(matrix, weights)
    sketch = matrix @ np.random.default_rng(1).standard_normal((COLUMNS, DIMENSIONS + 16)).astype(np.float32)
    for _ in range(3):
        sketch, _ = np.linalg.qr(sketch)
        sketch = matrix @ (matrix.T @ sketch)
    sketch, _ = np.linalg.qr(sketch)
    _, _, right = np.linalg.svd(sketch.T @ matrix, full_matrices=False)
    basis = np.ascontiguousarray(right[:DIMENSIONS].T) if rows else np.zeros((COLUMNS, 1), dtype=np.float32)
    prior = float(labels.mean()) if rows else 0.5
    return Model(weights, basis, _unit(matrix @ basis), labels.astype(np.float32), prior)


def vote(counts: np.ndarray, model: Model) -> np.ndarray:
    """Scores of damped term counts, between 0 and 1; the prior where no neighbour is similar at all."""
    vectors = _unit(_weighted(counts, model.weights) @ model.basis)
    near = min(NEIGHBOURS, len(model.labels))
    if not near:
        return np.full(len(counts), model.prior)
    cosines = vectors @ model.vectors.T
    best = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
    cosine = np.maximum(np.take_along_axis(cosines, best, axis=1), 0).astype(np.float64)
    weight = cosine**POWER
    total = weight.sum(axis=1)
    scores = (weight * model.labels[best]).sum(axis=1) + 1e-9 * model.prior
    return np.clip(scores / (total + 1e-9), 0, 1)


def scores(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (double, higher: label 1 likelier) and ``predicted`` (1 from one half on).

    A null text counts as the empty text and is scored by its measures alone; equal texts have equal
    scores; an empty table gives an empty result. Columns of the new names are replaced.
    """
    df = df.drop("score", "predicted")
    sent = share(df.sparkSession, model)

    def run(batches):
        model, terms = shared(sent), Terms()
        for part, texts in text_batches(batches, text, max_rows=BLOCK):
            found = pa.array(vote(term_counts(texts, terms), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "score"])

    scored = df.mapInArrow(run, df.withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(df: DataFrame, id_column: str = "doc_id"):
    """True for rows that no label is learnt from."""
    return crc_remainder(df[id_column], 3) == 1


def quality_scores(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``df``, learnt from labels that are not held out."""
    model = fit(df, labels.where(~held_out(labels)))
    rows = df.select("doc_id", held_out(df).alias("held_out"), df["text"].alias("text"))
    return scores(rows, model).drop("text")
