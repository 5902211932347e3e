"""Distributed sums of dense vectors, and training by averaged local gradient steps.

A model is one flat float32 vector of documented size. Each task returns its vector cut into small blocks, which are added up as a
stream wherever their numbers send them, so no task holds more than its blocks' sums and one batch; only the one summed vector reaches
the driver, whatever the number of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .store import short_batches

_BLOCK = 32_768


def sum_vectors(data: DataFrame, partial: Callable[[Iterable[pd.DataFrame]], np.ndarray], size: int) -> np.ndarray:
    """Add up the float32 vectors of length ``size`` that ``partial`` makes of each partition's pandas batches."""

    def cut(batches):
        vector = np.asarray(partial(batches), np.float32)
        assert len(vector) == size
        for start in range(0, size, 32 * _BLOCK):
            blocks = [(at // _BLOCK, vector[at : at + _BLOCK]) for at in range(start, min(size, start + 32 * _BLOCK), _BLOCK)]
            yield pd.DataFrame([(b, zlib.compress(part.tobytes(), 1)) for b, part in blocks if part.any()], columns=["block", "part"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, part in zip(pdf["block"], pdf["part"], strict=True):
                values = np.frombuffer(zlib.decompress(part), np.float32)
                totals[block] = totals[block] + values if block in totals else values.astype(np.float64)
        for block, total in totals.items():
            yield pd.DataFrame({"block": [block], "part": [total.astype(np.float32).tobytes()]})

    short_batches(data.sparkSession)
    parts = data.mapInPandas(cut, "block int, part binary").repartition("block").mapInPandas(add, "block int, part binary")
    out = np.zeros(size, np.float32)
    for block, part in parts.toLocalIterator():
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(part, np.float32)
    return out


def average_rounds(data: DataFrame, start: np.ndarray, local: Callable, rounds: int) -> np.ndarray:
    """Iterative parameter mixing: in each round every partition takes gradient steps from the shared parameters, and their
    changes are averaged by the number of examples.

    ``local(params, batches, round)`` returns the changed parameters and the number of examples. A round without examples keeps
    the parameters.
    """
    params = np.asarray(start, np.float32)
    context = data.sparkSession.sparkContext
    for r in range(rounds):
        shared = context.broadcast(params)

        def partial(batches, shared=shared, r=r):
            before = shared.value
            after, n = local(before.copy(), batches, r)
            return np.append((after - before) * np.float32(n), np.float32(n))

        total = sum_vectors(data, partial, len(params) + 1)
        if total[-1] > 0:
            params = params + total[:-1] / total[-1]
        shared.destroy()
    return params
