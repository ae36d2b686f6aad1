"""Gradient and optimizer arithmetic of one mini-batch, on float64 matrices.

Gradients are derived by hand for the closed form in ``scoreloom.model``; the
blocks that never reach the output get a zero gradient and only decay.
"""

from __future__ import annotations

import dataclasses

import numpy as np

from scoreloom.functions import forward
from scoreloom.model import Model, ModelShape

# Clipping bound and AdamW constants.
CLIP_NORM = 1.0
CLIP_EPSILON = 1e-6
BETA1 = 0.9
BETA2 = 0.999
EPSILON = 1e-8
WEIGHT_DECAY = 0.01


@dataclasses.dataclass
class TrainState:
    """Flat parameters with AdamW moments and step count."""

    params: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    steps: int = 0

    @staticmethod
    def start(model: Model) -> "TrainState":
        params = model.flatten()
        return TrainState(params, np.zeros_like(params), np.zeros_like(params))

    def copy(self) -> "TrainState":
        return TrainState(self.params.copy(), self.mean.copy(), self.var.copy(), self.steps)

    def model(self, shape: ModelShape) -> Model:
        return Model.unflatten(shape, self.params)


def dropout_mask(rate: float, row_ids: np.ndarray, hidden: int, key: tuple[int, ...]) -> np.ndarray | None:
    """Zero with probability ``rate``, else ``1 / (1 - rate)``; by a hash of ``key``, row number and unit.

    A row's mask is the same in whatever task it is read.
    """
    if rate <= 0.0:
        return None
    salt = np.random.SeedSequence(list(key)).generate_state(1, dtype=np.uint64)
    bits = row_ids.astype(np.uint64)[:, None] * np.uint64(hidden) + np.arange(hidden, dtype=np.uint64)
    # The finishing multipliers of a 64-bit mix.
    bits = (bits + salt) * np.uint64(0x9E3779B97F4A7C15)
    bits = (bits ^ (bits >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = (bits ^ (bits >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((bits >> np.uint64(11)) >= int(rate * 2**53)) * (1.0 / (1.0 - rate))


def loss_and_gradient(model: Model, x: np.ndarray, label: np.ndarray, scale: np.ndarray, mask=None):
    """Row losses, predictions, and the flat gradient of ``sum(scale * loss)``."""
    _, w_z, w_n, w_c = model.used_blocks()
    p, keep, cand, h = forward.hidden_state(model, x)
    seen = h if mask is None else h * mask
    logits = seen @ w_c.T
    losses, d_logits = forward.loss_and_softmax(logits, label)

    d_logits[np.arange(len(label)), label] -= 1.0
    d_logits *= scale[:, None]
    d_h = d_logits @ w_c
    if mask is not None:
        d_h = d_h * mask
    d_update = -d_h * cand * keep * (1.0 - keep)
    d_cand = d_h * keep * (1.0 - cand * cand)
    d_p = d_update @ w_z + d_cand @ w_n
    unused = np.zeros(h.shape[1] ** 2)
    # Storage order of the weights: projection, reset, update, candidate, hidden-to-hidden, classifier.
    gradient = np.concatenate(
        [
            (d_p.T @ x).ravel(),
            unused,
            (d_update.T @ p).ravel(),
            (d_cand.T @ p).ravel(),
            unused,
            unused,
            unused,
            (d_logits.T @ seen).ravel(),
        ]
    )
    return losses, logits.argmax(axis=1), gradient


def adamw_step(state: TrainState, gradient: np.ndarray, learning_rate: float) -> None:
    """Clip by global norm, decay, and update in place."""
    norm = float(np.sqrt((gradient * gradient).sum()))
    g = gradient * min(1.0, CLIP_NORM / (norm + CLIP_EPSILON))
    state.steps += 1
    state.params *= 1.0 - learning_rate * WEIGHT_DECAY
    state.mean = BETA1 * state.mean + (1.0 - BETA1) * g
    state.var = BETA2 * state.var + (1.0 - BETA2) * g * g
    corrected = state.mean / (1.0 - BETA1**state.steps)
    spread = np.sqrt(state.var / (1.0 - BETA2**state.steps)) + EPSILON
    state.params -= learning_rate * corrected / spread
