"""Sorted arrays as files in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import SparkSession

from ledgerloom.session import scratch_path


def mapped_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder as workers see it.

    Mapping needs a shared folder that is mounted, such as file:/mnt/shared.
    """
    where = urlparse(scratch_path(spark, name))
    if where.scheme not in ("", "file"):
        raise ValueError("memory-mapped arrays need spark.checkpoint.dir on a mounted path")
    return unquote(where.path)


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array; a repeated task replaces it with the same content in one step."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(part, values)
    os.replace(part, f"{folder}/{name}.npy")


class Arrays:
    """Opens mapped arrays of a folder once per worker task."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.open: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.open[name]


def find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of sorted ``wanted`` values in a sorted table, -1 where missing."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)
