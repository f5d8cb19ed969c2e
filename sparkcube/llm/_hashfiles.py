"""Sorted hash arrays in the shared folder that workers memory-map: look-ups without a broadcast or a shuffle of texts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcube.llm._shared import posix_dir

ROWS_PER_FILE = 1 << 20


def save(path: str, array: np.ndarray) -> None:
    """Whole or not at all: a task that is run again, or twice at once, leaves the same file."""
    temporary = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}.tmp"
    with open(temporary, "wb") as f:
        np.save(f, array)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def load(path: str) -> np.ndarray:
    if os.path.getsize(path) <= 128:  # nothing to map
        return np.load(path)
    return np.load(path, mmap_mode="r")


def write_sorted(df: DataFrame, key: str, value: str, label: str, check: str) -> tuple[str, int]:
    """Files of (key, check, value) by the key's leading bits, sorted by key as unsigned; the folder and the number of bits.

    check tells keys that are equal by chance apart: key and check together are one 128-bit key.

    The number of files follows the number of rows, so that a task holds about ROWS_PER_FILE of them.
    """
    rows = df.count()
    bits = max(0, (max(1, rows) // ROWS_PER_FILE).bit_length())
    folder = posix_dir(df.sparkSession, label)
    os.makedirs(folder, exist_ok=True)

    def store(table: pa.Table) -> pa.Table:
        k, v, c = (table.column(x).to_numpy() for x in ("k", "v", "c"))
        order = np.argsort(k.view(np.uint64), kind="stable")
        part = int(table.column("part")[0].as_py())
        save(f"{folder}/{part}.value.npy", v[order])
        save(f"{folder}/{part}.check.npy", c[order])
        save(f"{folder}/{part}.key.npy", k[order].view(np.uint64))
        return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([len(k)], pa.int64())})

    part = F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0)
    parted = df.select(F.col(key).cast("long").alias("k"), F.col(value).cast("long").alias("v"), F.col(check).cast("long").alias("c"), part.cast("long").alias("part"))
    parted.groupBy("part").applyInArrow(store, "part long, n long").agg(F.sum("n")).collect()
    return folder, bits


class SortedFiles:
    """Look-ups in the files of write_sorted(), opened as they are needed."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.open = folder, bits, {}

    def _part(self, part: int):
        if part not in self.open:
            path = f"{self.folder}/{part}.key.npy"
            if os.path.exists(path):
                self.open[part] = load(path), load(f"{self.folder}/{part}.value.npy"), load(f"{self.folder}/{part}.check.npy")
            else:
                self.open[part] = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
        return self.open[part]

    def get(self, keys: np.ndarray, default: int, checks: np.ndarray) -> np.ndarray:
        """The values of the keys with these checks; `default` for those that are absent."""
        out = np.full(len(keys), default, np.int64)
        if not len(keys):
            return out
        order = np.argsort(keys)
        keys, checks = keys[order], checks[order].view(np.int64)
        parts = keys >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(keys), np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(keys)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            have, values, known = self._part(int(parts[lo]))
            at, asked = np.searchsorted(have, keys[lo:hi]), np.arange(lo, hi)
            while len(asked):  # more than once only where keys are equal and checks aren't
                fits = at < len(have)
                at, asked = at[fits], asked[fits]
                fits = have[at] == keys[asked]
                at, asked = at[fits], asked[fits]
                hit = known[at] == checks[asked]
                out[order[asked[hit]]] = values[at[hit]]
                at, asked = at[~hit] + 1, asked[~hit]
        return out
