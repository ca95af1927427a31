"""Helpers of the operators on vectors: rows that take part, blocks of rows, best entries by key.

A block holds some thousand rows of one partition as packed arrays, in the order of their ids: int64 ids and labels, and the
components as 32-bit floats where these hold them exactly, else as 64-bit ones. Vectors of different lengths are compared over the
components that both have, as if the shorter went on with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 2048
#: Entries that wait before the best of each key are kept.
PENDING = 1 << 20
BLOCK_SCHEMA = "n bigint, width bigint, wide boolean, ids binary, labels binary, cells binary"


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.expr(f"`{column}` IS NOT NULL AND forall(`{column}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) != double('Infinity'))"), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as 64-bit floats, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices of different widths below one another."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def packed(cells: np.ndarray) -> tuple[bytes, bool]:
    narrow = cells.astype(np.float32)
    return (narrow.tobytes(), False) if np.array_equal(narrow, cells) else (cells.tobytes(), True)


def unpacked(data: bytes, width: int, wide: bool, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.float32).astype(np.float64).reshape(n, width)


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices over the components that both have."""
    w = min(a.shape[1], b.shape[1])
    return a[:, :w], b[:, :w]


class Block:
    """A block's arrays, from a row of a batch."""

    def __init__(self, row: dict, prefix: str = ""):
        n = row[f"{prefix}n"]
        self.ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
        self.labels = np.frombuffer(row[f"{prefix}labels"], np.int64)
        self.cells = unpacked(row[f"{prefix}cells"], row[f"{prefix}width"], row[f"{prefix}wide"], n)


def block_row(ids: np.ndarray, cells: np.ndarray, labels: np.ndarray | None = None) -> dict:
    order = np.argsort(ids, kind="stable")
    data, wide = packed(cells[order])
    return {"n": len(ids), "width": cells.shape[1], "wide": wide, "ids": ids[order].tobytes(), "labels": b"" if labels is None else labels[order].tobytes(), "cells": data}


def runs(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.Table]:
    """The rows of a task in tables of `most` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, most - size)
            held.append(take)
            size += take.num_rows
            batch = batch.slice(take.num_rows)
            if size == most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


class Best:
    """The first `k` entries of each key by score, highest first, then by smaller id; entries come in any order."""

    def __init__(self, k: int):
        self.k, self.parts, self.waiting = k, [], 0

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((keys, scores, ids))
        self.waiting += len(keys)
        if self.waiting > PENDING:
            self.settle()
            self.waiting = 0

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, scores, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        place = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
        kept = place < self.k
        self.parts = [(keys[kept], scores[kept], ids[kept])]
        return self.parts[0]


def spread(df: DataFrame, rows: int, each: int) -> DataFrame:
    """Fewer partitions, of about `each` rows, but at least as many as there are cores."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))
