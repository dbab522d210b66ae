"""Embedding models behind one seam: a function from a text column to a vector column."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


#: Rows whose tokens are counted at once.
ROWS = 500


@F.arrow_udf(ArrayType(FloatType()))
def _hashed(tokens: pa.Array) -> pa.Array:
    parts = [_counted(tokens.slice(k, ROWS)) for k in range(0, len(tokens), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))


def _counted(tokens: pa.Array) -> pa.Array:
    words = tokens.flatten().dictionary_encode()
    place = np.array([zlib.crc32(w.encode()) % 256 for w in words.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = np.bincount(row * 256 + place[words.indices.to_numpy()], minlength=256 * len(tokens)).reshape(-1, 256).astype(np.float32)
    for v in out:
        n = np.linalg.norm(v)
        if n:
            v /= n
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * 256), pa.array(out.ravel()))


def hashed_bag_of_words(text: Column) -> Column:
    """The offline default: token counts in 256 hashed places, over their length. Deterministic."""
    from ..functions import text as T

    return _hashed(T.tokens(text))
