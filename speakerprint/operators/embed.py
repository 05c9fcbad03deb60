"""Message embedding: vectors already in the table, hashed n-grams, or a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speakerprint.functions.mixing import MODULUS, mix_array
from speakerprint.functions.packed import list_matrix, matrix_list
from speakerprint.session import materialised, ship

# Fixed value: width of the sentence vectors.
EMBED_DIM = 384
#: One more than the largest code point: n-grams are numbers to this base, modulo the mixer's modulus.
BASE = 0x110000
#: Texts whose n-grams are counted at once.
STEP = 512
#: Decimal places of a weight, so that it does not depend on an engine's logarithm.
PLACES = 6


def gram_buckets(codes: np.ndarray, ngram: int, dim: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point: the mixer of its first n - 1 code points, as a number, and the last."""
    n = len(codes) - ngram + 1
    head = np.zeros(max(n, 0), dtype=np.int64)
    for j in range(ngram - 1):
        head = (head * BASE + codes[j : j + n]) % MODULUS
    return mix_array(head, codes[ngram - 1 :]) % dim


def gram_counts(texts: list[str], dim: int, ngram: int) -> np.ndarray:
    """(texts, dim) counts of hashed n-grams; a shorter text is one n-gram, padded with zeros, an empty one has none."""
    padded = [t if len(t) >= ngram or not t else t.ljust(ngram, "\0") for t in texts]
    sizes = np.array([len(t) for t in padded], dtype=np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if len(codes) < ngram:
        return np.zeros((len(texts), dim), dtype=np.int32)
    buckets = gram_buckets(codes, ngram, dim)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(buckets)] == owner[ngram - 1 :]
    return np.bincount((owner[: len(buckets)] * dim + buckets)[inside], minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.int32)


def _hashed(df: DataFrame, text: str, out: str, dim: int, ngram: int) -> DataFrame:
    """Counts once, then document frequencies from the stored counts, then a weighting pass over them."""
    ship(df.sparkSession)
    lower = df.withColumn("__t", F.lower(F.coalesce(F.col(text), F.lit(""))))
    fields = [*df.schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                batch = whole.slice(lo, STEP)
                counts = gram_counts(batch.column("__t").to_pylist(), dim, ngram)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], matrix_list(counts, pa.int32())], names=[*[f.name for f in fields], "__tf"])

    counted = materialised(lower.mapInArrow(count, T.StructType([*fields, T.StructField("__tf", T.ArrayType(T.IntegerType()))])), "gram-counts")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total += (list_matrix(batch.column(0), np.int32) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array(np.concatenate([[n], total]))], names=["j", "c"])

    sums = {r["j"]: r["c"] for r in counted.select("__tf").mapInArrow(frequencies, "j bigint, c bigint").groupBy("j").agg(F.sum("c").alias("c")).collect()}
    seen = np.array([sums.get(j, 0) for j in range(dim)], dtype=np.float64)
    weights = np.round(np.log((sums.get(-1, 0) + 1) / (seen + 1)), PLACES)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = (list_matrix(batch.column("__tf"), np.float64) * weights).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], matrix_list(vectors, pa.float32())], names=[*[f.name for f in fields], out])

    return counted.mapInArrow(weigh, T.StructType([*fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def embed(
    df: DataFrame,
    method: str | Callable[[], Callable[[list[str]], np.ndarray]] = "hash",
    text: str = "text",
    out: str = "embedding",
    column: str | None = None,
    dim: int = EMBED_DIM,
    ngram: int = 3,
) -> DataFrame:
    """Add an ``ARRAY<FLOAT>`` vector per message (not normalised).

    ``column``: take the vectors of column ``column``. ``hash``: character n-grams of the lower-cased text hashed to
    ``dim`` counts and weighted by inverse document frequency; each text is read once, its counts are stored. A callable: a factory called once
    per partition that returns ``encode(texts) -> (n, dim) array``, the hook for a model.
    """
    if method == "column":
        return df.withColumn(out, F.col(column).cast("array<float>"))
    if method == "hash":
        return _hashed(df, text, out, dim, ngram)
    factory = method
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = factory()
        for batch in batches:
            if batch.num_rows:
                vectors = np.asarray(encode([t or "" for t in batch.column(text).to_pylist()]), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([*batch.columns, matrix_list(vectors, pa.float32())], names=[*batch.schema.names, out])

    return df.mapInArrow(apply, schema)
