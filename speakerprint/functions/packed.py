"""numpy helpers run inside Arrow tasks: sign matrix, bit packing, Hamming counts.

Hypervectors travel as ``ARRAY<BIGINT>`` of packed bits (bit = 1 stands for +1), 64
dimensions per word, lowest dimension in the lowest bit. Unused bits of the last word are 0.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from speakerprint.functions.mixing import mix_array

#: Vectors are quantised to multiples of 1/SCALE so that every later sum is exact.
SCALE = 1_000_000
#: Integers up to this size are exact in float64.
EXACT = 1 << 53


def words(dim: int) -> int:
    return (dim + 63) // 64


@lru_cache(maxsize=4)
def sign_matrix(d: int, dim: int, seed: int, projection: str) -> np.ndarray:
    """(d, dim) projection, built once per Python worker.

    ``sign``: +-1 from the mixer (Achlioptas 2003), exact integer sums. ``gaussian``: seeded
    normal draws, row-filled so the first rows do not depend on d.
    """
    if projection == "gaussian":
        return np.random.RandomState(seed).randn(d, dim).astype(np.float32).astype(np.float64)
    j = np.arange(d, dtype=np.int64)[:, None]
    m = np.arange(dim, dtype=np.int64)[None, :] + np.int64(seed) * 1_000_000
    z = mix_array(j, m)
    return np.where((z // 65536) % 2 == 0, 1.0, -1.0)


def quantise(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Round half away from zero to an integer grid, as SQL ``round`` does."""
    v = x.astype(np.float64) * scale
    return np.trunc(v + np.copysign(0.5, v)).astype(np.int64)


def project_exact(q: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Exact int64 product of integer rows with a +-1 matrix, on the float64 BLAS."""
    peak = int(np.abs(q).max()) if q.size else 0
    if peak * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ sign).astype(np.int64)
    low = q & ((1 << 26) - 1)
    high = q >> 26
    return ((high.astype(np.float64) @ sign).astype(np.int64) << 26) + (low.astype(np.float64) @ sign).astype(np.int64)


def pack(bits: np.ndarray) -> np.ndarray:
    """(n, dim) 0/1 -> (n, words) int64."""
    n, dim = bits.shape
    out = np.zeros((n, words(dim) * 8), dtype=np.uint8)
    packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<i8")


def unpack(packed: np.ndarray, dim: int) -> np.ndarray:
    """(n, words) int64 -> (n, dim) 0/1 uint8."""
    raw = np.ascontiguousarray(packed).view(np.uint8)
    return np.unpackbits(raw, axis=1, bitorder="little", count=dim)


def hamming(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """(q, words) x (c, words) -> (q, c) differing bits, a slice of queries at a time."""
    q = queries.view(np.uint64)
    c = candidates.view(np.uint64)
    out = np.empty((len(q), len(c)), dtype=np.int32)
    step = max(1, (1 << 22) // max(1, c.size))
    for lo in range(0, len(q), step):
        x = q[lo : lo + step, None, :] ^ c[None, :, :]
        out[lo : lo + step] = np.bitwise_count(x).sum(axis=2, dtype=np.int32)
    return out


def list_matrix(column: pa.Array, dtype) -> np.ndarray:
    """Arrow list column with equal lengths -> 2-D numpy array."""
    n = len(column)
    if n == 0:
        return np.zeros((0, 0), dtype=dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors in one column must all have the same length")
    return flat.astype(dtype, copy=False).reshape(n, -1)


def matrix_list(m: np.ndarray, typ: pa.DataType) -> pa.Array:
    """2-D numpy array -> Arrow list column."""
    n, k = m.shape
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).reshape(-1), type=typ))
