"""Vector similarity joins (J4, V1, V4) on the blocked pairwise primitive.

Distances are rounded to 9 decimals before any ``<=`` comparison so that
threshold decisions do not depend on the summation order of an engine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.cells import UNIT, Block, extent, on_block_pairs, paired, strip_columns, whole_distances, whole_radius
from sextant.operators.blocks import (DEFAULT_BLOCK_ROWS, cosine_distance_matrix, euclidean_matrix,
                                      pairwise_apply, stack)

DIST_DECIMALS = 9
#: Rows of the tiles that are compared at once.
TILE_ROWS = 1024


def _pairs_within(left: Block, right: Block, same: bool, limit: int) -> dict:
    left, right, may = paired(left, right, same, limit)
    i, j, w = [], [], []
    for rows, cols in strip_columns(may, 0, len(left.ids), len(right.ids), above=same):
        d = whole_distances(left.x[rows], right.x[cols])
        r, c = np.nonzero(d <= limit)
        a, b = left.ids[rows][r], right.ids[cols[c]]
        keep = (cols[c] > rows.start + r) & (a != b) if same else a != b
        i.append(np.minimum(a, b)[keep])
        j.append(np.maximum(a, b)[keep])
        w.append(d[r, c][keep])
    i, j, w = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (i, j, w))
    return {"i": i, "j": j, "dist": w / UNIT}


def cosine_range_join(df: DataFrame, eps: float, id_col: str = "id", vec_col: str = "embedding",
                      key_cols: list[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """All pairs ``(i < j)`` with cosine distance ``<= eps`` -> ``(key.., i, j, dist)``.

    Exact.  Output is only the pairs under the radius; strips of rows that
    the triangle inequality keeps further apart are not compared.  With
    ``key_cols`` only rows of the same key are paired, all of them compared.
    """
    if not key_cols:
        limit = whole_radius(eps)
        return on_block_pairs(df.select(id_col, vec_col), id_col, vec_col, [], "i long, j long, dist double",
                              lambda a, b, same: _pairs_within(a, b, same, limit), extent(df, vec_col, block_rows))

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        ia, ib = left[id_col].to_numpy(), right[id_col].to_numpy()
        if len(ia) == 0 or len(ib) == 0:
            return pd.DataFrame({"i": [], "j": [], "dist": []})
        d = np.round(cosine_distance_matrix(stack(left[vec_col]), stack(right[vec_col])), DIST_DECIMALS)
        mask = d <= eps
        mask &= (ia[:, None] < ib[None, :]) if same else (ia[:, None] != ib[None, :])
        r, c = np.nonzero(mask)
        x, y = ia[r], ib[c]
        return pd.DataFrame({"i": np.minimum(x, y), "j": np.maximum(x, y), "dist": d[r, c]})

    return pairwise_apply(df.select(*key_cols, id_col, vec_col), id_col, key_cols, kernel,
                          "i long, j long, dist double", block_rows or DEFAULT_BLOCK_ROWS)


def _stats(left: Block, right: Block, same: bool, limit: int) -> dict:
    """Per row of both blocks its neighbours within ``limit`` in the other and its nearest row there."""
    n, nn = ([np.zeros(len(b.ids), dtype=np.int64) for b in (left, right)], [np.full(len(b.ids), 4 * UNIT) for b in (left, right)])
    for rows in left.tiles(TILE_ROWS):
        for cols in right.tiles(TILE_ROWS):
            d = whole_distances(left.x[rows], right.x[cols])
            d[left.ids[rows][:, None] == right.ids[cols][None, :]] = 4 * UNIT
            n[0][rows] += (d <= limit).sum(axis=1)
            nn[0][rows] = np.minimum(nn[0][rows], d.min(axis=1))
            if not same:
                n[1][cols] += (d <= limit).sum(axis=0)
                nn[1][cols] = np.minimum(nn[1][cols], d.min(axis=0))
    sides = (0,) if same else (0, 1)
    ids = np.concatenate([(left, right)[s].ids for s in sides])
    nearest = np.concatenate([nn[s] for s in sides])
    return {"id": ids, "n": np.concatenate([n[s] for s in sides]), "nn": np.where(nearest < 4 * UNIT, nearest / UNIT, np.inf)}


def cosine_neighbor_stats(df: DataFrame, eps: float, id_col: str = "id", vec_col: str = "embedding",
                          block_rows: int | None = None) -> DataFrame:
    """V1 reduced per row: neighbours within ``eps`` (self excluded) and nearest-neighbour distance.

    Each block pair emits one partial per row; a group-by combines them.  The
    nearest row may be at any distance, so all pairs are compared.
    """
    limit = whole_radius(eps)
    partial = on_block_pairs(df.select(id_col, vec_col), id_col, vec_col, [], "id long, n long, nn double",
                             lambda a, b, same: _stats(a, b, same, limit), extent(df, vec_col, block_rows))
    return partial.groupBy(F.col("id").alias(id_col)).agg(
        F.sum("n").alias("n_within"), F.min("nn").alias("nn_dist"))


def euclidean_neighbor_stats(df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                             block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """V4 reduced per row: nearest Euclidean neighbour distance and mean distance to all others."""
    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        ia, ib = left[id_col].to_numpy(), right[id_col].to_numpy()
        d = euclidean_matrix(stack(left[vec_col]), stack(right[vec_col]))
        self_mask = ia[:, None] == ib[None, :]
        s = np.where(self_mask, 0.0, d)
        m = np.where(self_mask, np.inf, d)
        cnt_a = (~self_mask).sum(1)
        parts = [pd.DataFrame({"id": ia, "s": s.sum(1), "c": cnt_a, "nn": m.min(1)})]
        if not same:
            parts.append(pd.DataFrame({"id": ib, "s": s.sum(0), "c": (~self_mask).sum(0), "nn": m.min(0)}))
        return pd.concat(parts, ignore_index=True)

    partial = pairwise_apply(df.select(id_col, vec_col), id_col, [], kernel,
                             "id long, s double, c long, nn double", block_rows)
    return partial.groupBy(F.col("id").alias(id_col)).agg(
        F.min("nn").alias("nn_dist"), (F.sum("s") / F.sum("c")).alias("mean_dist"))
