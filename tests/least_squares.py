"""Penalised least squares by the normal equations of centred columns."""

import numpy as np
import pandas as pd


def lag_columns(table, lags):
    """The earlier frames beside each frame, oldest first; rows without all are left out."""
    shifted = pd.concat([table.shift(k) for k in range(lags, 0, -1)], axis=1)
    return shifted.iloc[lags:].to_numpy(), table.iloc[lags:].to_numpy()


def slope_and_level(x, y, ridge):
    """Weights of centred columns and the level that makes residuals sum to zero."""
    dx, dy = x - x.mean(axis=0), y - y.mean(axis=0)
    slope = np.linalg.pinv(dx.T @ dx + ridge * np.eye(x.shape[1]), hermitian=True) @ (dx.T @ dy)
    return slope, y.mean(axis=0) - x.mean(axis=0) @ slope


def continued(table, lags, ridge, steps):
    """Frames that the fitted recursion adds to a table of channels."""
    slope, level = slope_and_level(*lag_columns(table, lags), ridge)
    rows = table.to_numpy()
    for _ in range(steps):
        rows = np.vstack([rows, rows[-lags:].reshape(1, -1) @ slope + level])
    return rows[len(table):]
