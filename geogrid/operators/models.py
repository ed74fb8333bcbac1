"""Batch inference by a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def embed(df: DataFrame, array: str, fn: Callable[[np.ndarray], np.ndarray], batch: int = 1200, key: str = "id", kind: str = "float") -> DataFrame:
    """(key, embedding): a user's batch function over all rows, a batch of the partition at a time; arrays of ``kind``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "embedding": list(fn(np.stack(part[array].map(np.asarray).tolist())).astype({"float": "float32", "double": "float64"}[kind]))})

    return df.select(key, array).mapInPandas(run, f"{key} long, embedding array<{kind}>")
