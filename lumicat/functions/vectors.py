"""Vectors as little-endian 32-bit float bytes and back, in Arrow batches, with validation."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat import config as C


def checked(v: np.ndarray) -> np.ndarray | None:
    """The vector if it isn't empty and its norm is finite and near one."""
    n = float(np.linalg.norm(v.astype(np.float64))) if len(v) else float("nan")
    return v if np.isfinite(n) and C.NORM_MIN <= n <= C.NORM_MAX else None


def decode_bytes(data: bytes | None, dim: int | None) -> np.ndarray | None:
    """None for bytes that aren't ``dim`` floats or no valid vector."""
    if data is None or dim is None or not 1 <= dim <= C.DIM_MAX or len(data) != 4 * dim:
        return None
    return checked(np.frombuffer(data, "<f4"))


def _decode(data: pd.Series, dim: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(None if b is None else bytes(b), None if pd.isna(n) else int(n)) for b, n in zip(data, dim)])


def _encode(vectors: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors])


def vector_from_bytes(data: Column, dim: Column) -> Column:
    return F.pandas_udf(_decode, T.ArrayType(T.FloatType()))(data, dim)


def vector_bytes(vector: Column) -> Column:
    return F.pandas_udf(_encode, T.BinaryType())(vector)
