"""Edge tables as packed arrays, for kernels in Python workers: a few bytes an edge instead of an object each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many edges go into one packed row.
EDGES_A_ROW = 100_000
#: A step of a walk over neighbours looks at so many edges at a time.
EDGES_A_STEP = 1_000_000
SCHEMA = "task long, n long, src binary, dst binary, weight binary"


def _blob(ids: np.ndarray) -> bytes:
    """Four bytes an id where they do, else eight."""
    return ids.astype("int32").tobytes() if not len(ids) or max(-int(ids.min()), int(ids.max())) < 1 << 31 else ids.tobytes()


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="int32" if len(blob) == 4 * n else "int64")


def packed(edges: DataFrame, tasks: Callable[[np.ndarray, np.ndarray], Iterable[np.ndarray]] | None = None) -> DataFrame:
    """Rows of many edges of ``src, dst`` and, if there, ``weight``; edges with a null end are left out.

    ``tasks`` gives arrays of task numbers, and an edge is packed once for each array; without it all go to task 0.
    """
    weighted = "weight" in edges.columns
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *([F.col("weight").cast("double").alias("weight")] if weighted else []))

    def pack(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, dst = (np.concatenate([b[c].to_numpy(dtype="int64") for b in held]) for c in ("src", "dst"))
        weight = np.concatenate([b["weight"].to_numpy(dtype="float64") for b in held]) if weighted else None
        order = np.argsort(src)
        out = []
        for task in tasks(src, dst) if tasks else [np.zeros(len(src), dtype="int64")]:
            by_task = order[np.argsort(task[order], kind="stable")]
            numbers, first = np.unique(task[by_task], return_index=True)
            for number, mine in zip(numbers.tolist(), np.split(by_task, first[1:])):
                out.append((number, len(mine), _blob(src[mine]), _blob(dst[mine]), weight[mine].tobytes() if weighted else None))
        yield pd.DataFrame(out, columns=["task", "n", "src", "dst", "weight"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= EDGES_A_ROW:
                yield from pack(held)
                held, n = [], 0
        if n:
            yield from pack(held)

    return rows.filter("src is not null and dst is not null").mapInPandas(run, SCHEMA)


def chunks(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    for n, src, dst, weight in zip(rows["n"].tolist(), rows["src"], rows["dst"], rows["weight"]):
        yield _ids(src, n), _ids(dst, n), None if weight is None else np.frombuffer(weight, dtype="float64")


def ranked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct node ids in order, and the edges by their places among them."""
    ids = np.unique(np.concatenate([np.unique(end) for part in parts for end in part[:2]])) if parts else np.zeros(0, dtype="int64")
    out = []
    while parts:
        a, b = parts.pop(0)
        out.append((np.searchsorted(ids, a).astype("int32"), np.searchsorted(ids, b).astype("int32")))
    return ids.astype("int64"), out


def neighbours(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``start, others``: the neighbours of node ``u`` are ``others[start[u]:start[u + 1]]``. ``parts`` is emptied."""
    start = np.zeros(n + 1, dtype="int64")
    for part in parts:
        for end in part:
            start[1:] += np.bincount(end, minlength=n)
    np.cumsum(start, out=start)
    others, at = np.empty(start[-1], dtype="int32"), start[:-1].copy()
    while parts:
        a, b = parts.pop()
        for u, v in ((a, b), (b, a)):
            order = np.argsort(u, kind="stable")
            nodes, first, count = np.unique(u[order], return_index=True, return_counts=True)
            others[np.repeat(at[nodes] - first, count) + np.arange(len(u))] = v[order]
            at[nodes] += count
    return start, others


def spokes(front: np.ndarray, start: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a node of ``front`` and a neighbour, a bounded number at a time."""
    size = start[front + 1] - start[front]
    cuts = np.searchsorted(np.cumsum(size), np.arange(EDGES_A_STEP, int(size.sum()) + EDGES_A_STEP, EDGES_A_STEP), side="right")
    for nodes, many in zip(np.split(front, cuts), np.split(size, cuts)):
        if many.sum():
            where = np.repeat(start[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield np.repeat(nodes, many), others[where]


def in_one_task(edges: DataFrame, solve: Callable[[list[tuple]], pd.DataFrame], schema: str) -> DataFrame:
    """``solve`` over the whole graph in one worker, which reads it as arrays, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [part for batch in batches for part in chunks(batch)]
        if parts:
            yield solve(parts)

    return packed(edges).repartition(1).mapInPandas(run, schema)
