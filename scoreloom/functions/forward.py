"""Vectorised forward pass over Arrow batches; Spark decides which rows come in a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from scoreloom.model import Model


# Values converted to float64 at a time (32 MB), so wide vectors need no smaller Arrow batches.
CHUNK_VALUES = 4_000_000


def feature_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a (rows, width) float64 matrix; unequal widths are an error."""
    if column.null_count:
        raise ValueError("null feature vector: reject malformed rows before scoring")
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if lengths.size and (lengths != width).any():
        bad = int(lengths[lengths != width][0])
        raise ValueError(f"feature vector of width {bad}, model expects {width}")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), width)


def feature_chunks(column: pa.Array, width: int):
    """``(start, matrix)`` pieces of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    step = max(1, CHUNK_VALUES // max(1, width))
    for start in range(0, len(column), step):
        yield start, feature_matrix(column.slice(start, step), width)


def hidden_state(model: Model, x: np.ndarray):
    """Projection, update-gate complement, candidate and hidden state of every row."""
    w_p, w_z, w_n, _ = model.used_blocks()
    p = x @ w_p.T
    keep = 0.5 * (1.0 - np.tanh(0.5 * (p @ w_z.T)))  # 1 - sigmoid, without overflow
    cand = np.tanh(p @ w_n.T)
    return p, keep, cand, keep * cand


def logits_of(model: Model, x: np.ndarray) -> np.ndarray:
    return hidden_state(model, x)[3] @ model.used_blocks()[3].T


def check_labels(label: np.ndarray, num_classes: int) -> None:
    if label.size and (label.min() < 0 or label.max() >= num_classes):
        raise ValueError(f"label outside 0..{num_classes - 1}")


def logits_of_column(models: list[Model], column: pa.Array, width: int) -> list[np.ndarray]:
    """Logits of every row for each of the models, the features converted once."""
    pieces = [[np.empty((0, m.shape.num_classes))] for m in models]
    for _, x in feature_chunks(column, width):
        for model, piece in zip(models, pieces):
            piece.append(logits_of(model, x))
    return [np.concatenate(piece) for piece in pieces]


def loss_and_softmax(logits: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy and class probabilities of every row, from one exponential."""
    top = logits.max(axis=1)
    e = np.exp(logits - top[:, None])
    total = e.sum(axis=1)
    return np.log(total) + top - logits[np.arange(len(label)), label], e / total[:, None]


def tally_pairs(label: np.ndarray, pred: np.ndarray, loss: np.ndarray, classes: int):
    """Distinct (label, pred) pairs of a batch with their row counts and loss sums."""
    code = label * classes + pred
    if classes * classes <= max(len(code), 1024):
        n = np.bincount(code, minlength=classes * classes)
        found = np.flatnonzero(n)
        return found // classes, found % classes, n[found], np.bincount(code, loss, classes * classes)[found]
    found, where, n = np.unique(code, return_inverse=True, return_counts=True)
    return found // classes, found % classes, n, np.bincount(where, loss)


def list_column(matrix: np.ndarray) -> pa.ListArray:
    rows, cols = matrix.shape
    offsets = pa.array(np.arange(0, (rows + 1) * cols, cols, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
