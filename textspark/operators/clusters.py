"""Average-link clustering of units within one group (a document, a conversation, a corpus)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPSILON = 1.1920929e-07
#: Rows of a block of similarities that is looked at at a time.
BLOCK = 2_048


def average_link(vectors: np.ndarray, threshold: float = 0.6) -> np.ndarray:
    """Cluster numbers in order of first members: the most similar two clusters merge while their mean
    similarity is at least threshold; of equal ones (in nine digits) those with the lowest first members.

    The mean cosine of two clusters is the product of their members' unit vectors' sums over both sizes, so
    memory is that of the vectors: every cluster keeps its best partner behind it, and a merge looks again only
    where that partner was one of the two, or the merged cluster is better. Groups of any size cluster; the work
    grows with the square of the group."""
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    total = np.divide(vectors, norms, out=np.zeros_like(vectors, float), where=norms > EPSILON)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    best, partner = np.full(n, -np.inf), np.full(n, n)

    def look(rows: np.ndarray) -> None:
        """The best partner behind each of rows: highest mean, then lowest place."""
        for lo in range(0, len(rows), BLOCK):
            part = rows[lo : lo + BLOCK]
            first = int(part.min()) + 1
            columns = first + np.flatnonzero(alive[first:])
            if not len(columns):
                best[part], partner[part] = -np.inf, n
                continue
            mean = np.round(total[part] @ total[columns].T / (size[part][:, None] * size[columns]), 9)
            mean[columns[None, :] <= part[:, None]] = -np.inf
            at = mean.argmax(1)
            best[part] = mean[np.arange(len(part)), at]
            partner[part] = np.where(best[part] > -np.inf, columns[at], n)

    look(np.arange(n))
    while n and alive.sum() > 1:
        a = int(np.argmax(np.where(alive, best, -np.inf)))  # the first of equal ones: lowest left, then right
        if best[a] < threshold:
            break
        b = int(partner[a])
        total[a] += total[b]
        size[a] += size[b]
        alive[b], best[b] = False, -np.inf
        label[label == b] = a
        stale = np.flatnonzero(alive & ((partner == a) | (partner == b)))
        look(np.union1d(stale, [a]))
        before = np.flatnonzero(alive[:a])
        before = before[~np.isin(before, stale)]
        if len(before):
            mean = np.round(total[before] @ total[a] / (size[before] * size[a]), 9)
            wins = (mean > best[before]) | ((mean == best[before]) & (a < partner[before]))
            best[before[wins]], partner[before[wins]] = mean[wins], a
    return pd.factorize(label)[0]


def cluster_units(units: DataFrame, by: str, seq: str, vector: str, threshold: float = 0.6) -> DataFrame:
    """(by, seq, cluster) for each group of units, clustered on its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq)
        found = average_link(np.array(rows[vector].tolist(), float), threshold)
        return pd.DataFrame({by: rows[by], seq: rows[seq], "cluster": found})

    kinds = {c: units.schema[c].dataType.simpleString() for c in (by, seq)}
    return units.select(by, seq, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {seq} {kinds[seq]}, cluster bigint")
