"""Values sent to every task; tables in the folder that all executors share come from the library's sources."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession

from ..sources.tables import dropped, shared_dir, written

__all__ = ["dropped", "sent", "shared_dir", "written"]


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """``value`` in every task: sent once to each executor, classes by value, arrays as they are. Only for values of bounded size.

    In a task its arrays stand on the bytes received, so there is one copy of
    them, which cannot be written to. On the driver they are written from where
    they stand, one at a time.
    """
    parts: list = []
    head = cloudpickle.dumps(value, protocol=5, buffer_callback=lambda p: parts.append(np.frombuffer(p.raw(), np.uint8)))
    for p in parts:
        p.flags.writeable = False  # so that they are sent as bytes
    packed, own = spark.sparkContext.broadcast((head, parts)), []
    del parts

    def get() -> Any:
        if not own:
            head, arrays = packed.value
            own.append(pickle.loads(head, buffers=arrays))
        return own[0]

    return get
