"""Digest columns of the queries, and Arrow lists from flat arrays."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Arrow lists of the given lengths from their values, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def ids_sha256(ids: str) -> Column:
    """Hex digest of the decimal ids joined by commas."""
    return F.sha2(F.coalesce(F.array_join(ids, ","), F.lit("")).cast("binary"), 256)
