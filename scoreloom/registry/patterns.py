"""Fixed weights for checks, stated by formula so that SQL can state them too."""

from __future__ import annotations

import numpy as np

from scoreloom.model import Model, ModelShape


def pattern_matrix(rows: int, cols: int, offset: int) -> np.ndarray:
    """``((7 i + 3 j + offset) mod 11 - 5) / 10``."""
    i, j = np.indices((rows, cols))
    return ((7 * i + 3 * j + offset) % 11 - 5) / 10.0


def pattern_model(shape: ModelShape, shift: int = 0) -> Model:
    f, h, c = shape.num_features, shape.hidden_size, shape.num_classes
    gates = [pattern_matrix(h, h, shift + offset) for offset in (4, 1, 2)]  # reset, update, candidate
    return Model(
        shape,
        {
            "input_projection": pattern_matrix(h, f, shift),
            "gru_input": np.concatenate(gates),
            "gru_hidden": np.concatenate([pattern_matrix(h, h, shift + 5)] * 3),
            "classifier": pattern_matrix(c, h, shift + 3),
        },
    )
