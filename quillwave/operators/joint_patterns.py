"""Spatial patterns for two or more classes by joint approximate diagonalisation.

The covariance of each class is summed on Spark. What reaches the driver is one
channels x channels matrix per class. Their sum is whitened, and one rotation
makes all class matrices as diagonal as they can be together (Jacobi angles,
Cardoso and Souloumiac, 1996). For two classes the whitened matrices share
their axes, and the result is the usual pair of pattern sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.operators.trials import centre_channels, class_covariance


def repaired(variances: np.ndarray, least: float = 1e-18) -> np.ndarray:
    """Variances below ``least`` replaced by the mean of all."""
    return np.where(variances < least, variances.mean(), variances)


def whitening(total: np.ndarray, repair: float | None = None) -> np.ndarray:
    """Rows that scale the variance of ``total`` to 1.

    Directions without variance (relative to the largest) are left out. With
    ``repair``, those below it are kept and get the mean variance instead.
    """
    variances, axes = np.linalg.eigh(total)
    if repair is not None:
        return (axes / np.sqrt(repaired(variances, repair))).T
    spanned = variances > variances.max() * len(total) * np.finfo(float).eps
    return (axes[:, spanned] / np.sqrt(variances[spanned])).T


def off_diagonal(matrices: np.ndarray) -> float:
    """Sum of squares beside the diagonals."""
    beside = ~np.eye(matrices.shape[1], dtype=bool)
    return float((matrices[:, beside] ** 2).sum())


def joint_axes(matrices: np.ndarray, most_sweeps: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, list[float]]:
    """Orthogonal columns that make all symmetric matrices (k x n x n) as diagonal as possible together.

    Also returns the energy beside the diagonals before the first and after
    each sweep. A sweep turns each pair of axes by the angle that leaves the
    least energy beside the diagonals in that plane; sweeps end when no angle
    is larger than ``tolerance``.
    """
    held = np.array(matrices, float)
    n = held.shape[1]
    axes, energies = np.eye(n), [off_diagonal(held)]
    for _ in range(most_sweeps):
        largest = 0.0
        for p in range(n - 1):
            for q in range(p + 1, n):
                spread = np.stack([held[:, p, p] - held[:, q, q], held[:, p, q] + held[:, q, p]])
                across = spread @ spread.T
                along, mixed = across[0, 0] - across[1, 1], 2 * across[0, 1]
                angle = 0.5 * np.arctan2(mixed, along + np.hypot(along, mixed))
                if abs(angle) <= tolerance:
                    continue
                largest = max(largest, abs(angle))
                turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                held[:, :, [p, q]] = held[:, :, [p, q]] @ turn
                held[:, [p, q], :] = turn.T @ held[:, [p, q], :]
                axes[:, [p, q]] = axes[:, [p, q]] @ turn
        energies.append(off_diagonal(held))
        if largest <= tolerance:
            break
    return axes, energies


def patterns_of(covariances: np.ndarray, num: int, repair: float | None = None) -> np.ndarray:
    """For each class in turn the ``num`` patterns (rows) of its largest share of variance, none twice."""
    white = whitening(covariances.sum(axis=0), repair)
    matrices = white @ covariances @ white.T
    axes, _ = joint_axes(matrices)
    shares = np.einsum("ji,kjl,li->ki", axes, matrices, axes)
    chosen: list[int] = []
    for share in shares:
        best = [i for i in np.argsort(-share, kind="stable").tolist() if i not in chosen]
        chosen += best[:num]
    return axes[:, chosen].T @ white


def joint_patterns(
    trials: DataFrame, trial_keys: list[str], class_col: str, classes: tuple, num: int, repair: float | None = None
) -> list[list[float]]:
    """Channel weights of ``num`` patterns per class, from trials of two or more classes."""
    own = trials.where(F.col(class_col).isin(*classes))
    centred = centre_channels(own, trial_keys, class_col)
    cells = class_covariance(centred, class_col).collect()
    n_channels = 1 + max((cell["i"] for cell in cells), default=0)
    covariances = np.zeros((len(classes), n_channels, n_channels))
    for cell in cells:
        covariances[classes.index(cell[class_col]), cell["i"], cell["j"]] = cell["value"]
    absent = [name for name, matrix in zip(classes, covariances) if not matrix.any()]
    if absent:
        raise ValueError(f"no variance in the trials of {absent}")
    return patterns_of(covariances, num, repair).tolist()
