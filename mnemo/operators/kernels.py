"""Score functions for ``probe.best_k``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mnemo.operators.probe import UNSCORED, Kernel


def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(float64 matrix, mask of rows that hold a vector of this length)."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy())
    fits = sizes == dim
    if lists.null_count:
        fits &= ~lists.is_null().to_numpy(zero_copy_only=False)
    if not fits.all():
        lists = lists.filter(pa.array(fits))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(fits), dim))
    if fits.any():
        out[fits] = np.asarray(values, dtype=np.float64).reshape(-1, dim)
    return out, fits


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def cosine_kernel(dim: int, min_score: float | None, keep_unscored: bool = False) -> Kernel:
    """Cosine of ``embedding``; a probe that is all zero matches nothing.

    ``min_score`` is compared before rounding. With ``keep_unscored`` the rows
    whose ``comparable`` is false stay, ranked after every scored row, and a
    zero probe ranks all rows so.
    """

    def prepare(probes: pa.Table):
        m, _ = _matrix(probes.column("embedding"), dim)
        return _unit(m), (m != 0).any(axis=1)

    def score(state, rows: pa.Table):
        unit, usable = state
        m, _ = _matrix(rows.column("embedding"), dim)
        s = unit @ _unit(m).T
        if min_score is not None:
            s = np.where(s >= min_score, s, -np.inf)
        if keep_unscored:
            comparable = rows.column("comparable").to_numpy()
            s[:, ~comparable] = UNSCORED
            s[~usable, :] = UNSCORED
        else:
            s[~usable, :] = -np.inf
        return rows, s

    return Kernel(prepare, score)


def every_row_kernel() -> Kernel:
    """Every row qualifies without a score, so the tie-breakers alone rank."""
    return Kernel(
        lambda probes: probes.num_rows,
        lambda n, rows: (rows, np.full((n, rows.num_rows), UNSCORED)),
    )
