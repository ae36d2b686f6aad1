"""The classifier's weights: linear projection, one GRU step, linear classifier, no biases.

Every row is a sequence of length one scored from a zero state, so a GRU step
reduces to ``h = (1 - sigmoid(W_z p)) * tanh(W_n p)``: the reset gate and the
hidden-to-hidden matrices never reach the output. They are still stored, counted
and decayed by the optimizer, as they belong to the model.
"""

from __future__ import annotations

import dataclasses

import numpy as np

# Matrix names in storage order. The GRU matrices stack the
# reset, update and candidate blocks, in that order.
WEIGHT_NAMES = ("input_projection", "gru_input", "gru_hidden", "classifier")


@dataclasses.dataclass(frozen=True)
class ModelShape:
    num_features: int
    num_classes: int
    hidden_size: int = 64
    dropout: float = 0.2

    def matrix_shapes(self) -> dict[str, tuple[int, int]]:
        f, h, c = self.num_features, self.hidden_size, self.num_classes
        return dict(zip(WEIGHT_NAMES, ((h, f), (3 * h, h), (3 * h, h), (c, h))))

    def num_parameters(self) -> int:
        return sum(rows * cols for rows, cols in self.matrix_shapes().values())


@dataclasses.dataclass(frozen=True)
class Model:
    """Weights as float64 matrices. Size is fixed by the shape, never by the number of rows."""

    shape: ModelShape
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        for name, expected in self.shape.matrix_shapes().items():
            got = self.weights[name].shape
            if got != expected:
                raise ValueError(f"weight {name!r} has shape {got}, expected {expected}")

    def used_blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The four matrices that reach the output: projection, update, candidate, classifier."""
        h = self.shape.hidden_size
        gates = self.weights["gru_input"]
        return (
            self.weights["input_projection"],
            gates[h : 2 * h],
            gates[2 * h :],
            self.weights["classifier"],
        )

    def flatten(self) -> np.ndarray:
        return np.concatenate([self.weights[name].ravel() for name in WEIGHT_NAMES])

    @staticmethod
    def unflatten(shape: ModelShape, vector: np.ndarray) -> "Model":
        weights, start = {}, 0
        for name, (rows, cols) in shape.matrix_shapes().items():
            weights[name] = np.asarray(vector[start : start + rows * cols], dtype=np.float64).reshape(rows, cols)
            start += rows * cols
        if start != len(vector):
            raise ValueError(f"{len(vector)} values given, model has {start}")
        return Model(shape, weights)


def init_model(shape: ModelShape, seed: int = 0) -> Model:
    """Uniform start values: +-1/sqrt(fan in) for linear layers, +-1/sqrt(hidden) for the GRU."""
    rng = np.random.default_rng([seed, 0])
    weights = {}
    for name, (rows, cols) in shape.matrix_shapes().items():
        fan = shape.hidden_size if name.startswith("gru") else cols
        bound = 1.0 / np.sqrt(fan)
        weights[name] = rng.uniform(-bound, bound, size=(rows, cols))
    return Model(shape, weights)
