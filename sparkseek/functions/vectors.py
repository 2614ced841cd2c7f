"""Vector expressions and the hashing embedder."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine; a zero vector counts as having length one."""
    length = lambda v: F.coalesce(F.nullif(l2_norm(v), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (length(a) * length(b))


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(x)))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def _slots(tokens: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of each token: the first seven hexadecimal digits of its md5, and the eighth's lowest bit."""
    digests = b"".join([hashlib.md5(token.encode("utf-8")).digest()[:4] for token in tokens])
    leading = np.frombuffer(digests, dtype=">u4").astype(np.int64)
    return (leading >> 4) % dim, 1.0 - 2.0 * (leading & 1)


def hashing_vector(text: str | None, dim: int) -> np.ndarray:
    """Signed token counts in `dim` slots; slot and sign come from the token's md5."""
    slot, sign = _slots(_TOKENS.findall((text or "").lower()), dim)
    return np.bincount(slot, sign, dim)


_TOKENS = re.compile(fv.TOKEN_PATTERN)


def hashing_embedder(dim: int = 64):
    """Column function text -> array<double>: a stand-in encoder that needs no model files.

    It is a feature-hashing vector, not a neural embedding, and is named so in every manifest it is written to.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        flat = np.array([hashing_vector(t.as_py(), dim) for t in texts]).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(flat, pa.float64()))

    return embed


def term_vectors(terms: pa.DictionaryArray, counts: np.ndarray, row: np.ndarray, rows: int, dim: int = 64) -> np.ndarray:
    """The same vectors, a row each, from counted terms: `row` names the text of each term. A distinct term is hashed once."""
    slot, sign = _slots(terms.dictionary.to_pylist(), dim)
    code = terms.indices.to_numpy()
    return np.bincount(row * dim + slot[code], sign[code] * counts, rows * dim).reshape(rows, dim)
