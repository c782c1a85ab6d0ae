"""Pixels: connected components, runs, dilation and what an image is made of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COMPONENTS = "component int, pixels int, x int, y int, w int, h int"


def runs(mask: np.ndarray) -> np.ndarray:
    """Row, first and last column (exclusive) of every horizontal run of set pixels."""
    pad = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    pad[:, 1:-1] = mask
    edge = np.diff(pad, axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    return np.stack([row, first, last], axis=1)


def components(mask: np.ndarray) -> np.ndarray:
    """Label of each run's component (8 neighbours), and the runs themselves, in columns row, first, last, label.

    Runs of neighbouring rows that touch are joined, so the work follows the number of runs.
    """
    r = runs(mask.astype(bool))
    parent = np.arange(len(r))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = np.searchsorted(r[:, 0], np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = at[y - 1], at[y]
        while i < at[y] and j < at[y + 1]:
            if r[i, 1] <= r[j, 2] and r[j, 1] <= r[i, 2]:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
            if r[i, 2] < r[j, 2]:
                i += 1
            else:
                j += 1
    root = np.array([top(i) for i in range(len(r))], dtype=np.int64)
    _, label = np.unique(root, return_inverse=True)
    return np.column_stack([r, label]) if len(r) else np.zeros((0, 4), np.int64)


def boxes(mask: np.ndarray) -> pd.DataFrame:
    """Pixels and box of each component."""
    c = pd.DataFrame(components(mask), columns=["row", "first", "last", "component"])
    c["n"] = c["last"] - c["first"]
    g = c.groupby("component").agg(pixels=("n", "sum"), x=("first", "min"), r=("last", "max"), y=("row", "min"), b=("row", "max")).reset_index()
    g["w"], g["h"] = g["r"] - g["x"], g["b"] - g["y"] + 1
    return g[["component", "pixels", "x", "y", "w", "h"]]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Grown by so many steps to four sides."""
    out = mask.astype(bool).copy()
    for _ in range(radius):
        up = np.pad(out, 1)
        out = up[1:-1, 1:-1] | up[:-2, 1:-1] | up[2:, 1:-1] | up[1:-1, :-2] | up[1:-1, 2:]
    return out


def layer_scores(truth: np.ndarray, found: np.ndarray) -> tuple[float, float]:
    """Recall and precision of a mask; 1 where there is nothing to find or nothing found."""
    both = np.logical_and(truth, found).sum()
    return float(both / truth.sum()) if truth.any() else 1.0, float(both / found.sum()) if found.any() else 1.0


def component_table(pages: DataFrame, key: str) -> DataFrame:
    """Components of every page; ``pages`` has the key, ``width`` and ``pixels`` (BINARY, one byte each, set if not 0)."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, width, data in zip(batch[key], batch["width"], batch["pixels"]):
                if data is None or not width:
                    continue
                px = np.frombuffer(data, np.uint8)
                out = boxes(px[: len(px) // width * width].reshape(-1, width) != 0)
                out.insert(0, key, k)
                yield out

    return pages.select(key, "width", "pixels").mapInPandas(run, f"{key} {kind}, {COMPONENTS}")


def ruled(mask: np.ndarray, rows: int = 12, columns: int = 3, least: float = 0.55) -> bool:
    """Whether a page is a ruled sheet: so many rows and columns whose longest run covers most of it."""

    def lines(m: np.ndarray) -> int:
        r = runs(m)
        longest = np.zeros(m.shape[0], np.int64)
        np.maximum.at(longest, r[:, 0], r[:, 2] - r[:, 1])
        on = longest >= least * m.shape[1]
        # neighbouring rows are one rule
        return int((on[1:] & ~on[:-1]).sum() + (on[0] if len(on) else 0))

    m = mask.astype(bool)
    return lines(m) >= rows and lines(m.T) >= columns


def isolated(batches: Iterator[pd.DataFrame], work, key: str) -> Iterator[pd.DataFrame]:
    """Runs ``work`` on each row; what fails becomes a row with an error, the others go on."""
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            try:
                out.append((row[key], work(row), None))
            except Exception as x:  # noqa: BLE001 - an error is a result
                out.append((row[key], None, f"{type(x).__name__}: {x}"[:200]))
        yield pd.DataFrame(out, columns=[key, "result", "error"])
