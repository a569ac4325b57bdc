"""Models for executors: one broadcast, built once in each Python process."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable

from pyspark.sql import SparkSession

_built: dict[tuple[str, str], object] = {}


def as_it_is(model):
    return model


class Shipped:
    """A picklable model of bounded size, known by the digest of its content.

    get() unpickles it, and builds what the tasks use from it, once in each process;
    the last few models are kept.
    """

    def __init__(self, spark: SparkSession, model: object):
        raw = pickle.dumps(model)
        self.key, self.raw = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    def get(self, build: Callable = as_it_is):
        key = (self.key, build.__qualname__)
        if key not in _built:
            while len(_built) > 1:
                _built.pop(next(iter(_built)))
            _built[key] = build(pickle.loads(self.raw.value))
        return _built[key]
