"""Character n-grams of documents, dealt to blocks, for the operators that join them with count tables.

An n-gram key packs the characters of the n-gram, the last one lowest, so that its context is the key
shifted right and its suffix the key's low part: plain integer expressions relate the orders. A document
begins with ``order - 1`` marks; every character is predicted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import pieces, ship

#: Bytes of text in a block, and characters that Python holds keys of at a time.
BLOCK_BYTES = 32 << 20
PIECE_CHARS = 1 << 20
#: Distinct n-grams that a task counts before it hands them on.
HELD_KEYS = 1 << 20
MARK = 2


class Grams:
    """Order and width of packed characters."""

    def __init__(self, order: int, bits: int):
        if order * bits > 64:
            raise ValueError("an n-gram key has 64 bits")
        self.order, self.bits = order, bits

    def symbols(self, text: str) -> np.ndarray:
        """Characters as integers of ``bits`` bits: those that fit as they are, others by a hash; digits alike."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
        beyond = c >= np.uint64(1 << self.bits)
        if beyond.any():
            c[beyond] = (c[beyond] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return c

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        """Key of the n-gram that ends at each symbol but the first ``order - 1``."""
        n = len(symbols) - self.order + 1
        out = np.zeros(max(n, 0), dtype=np.uint64)
        for i in range(self.order):
            out = (out << np.uint64(self.bits)) | symbols[i : i + len(out)]
        return out

    def pieces(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, number of the text) of many texts, ``PIECE_CHARS`` or so at a time; long texts in several."""
        marks = np.full(self.order - 1, MARK, dtype=np.uint64)
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            s = np.concatenate([marks, self.symbols(text)])
            for at in range(0, len(s) - self.order + 1, PIECE_CHARS):
                k = self.keys(s[at : at + PIECE_CHARS + self.order - 1])
                held.append(k)
                owners.append(np.full(len(k), i, dtype=np.int64))
                size += len(k)
                if size >= PIECE_CHARS:
                    yield np.concatenate(held), np.concatenate(owners)
                    held, owners, size = [], [], 0
        if held:
            yield np.concatenate(held), np.concatenate(owners)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the texts and how often each occurs."""
        total = pd.Series(dtype=np.int64)
        for keys, _ in self.pieces(texts):
            codes, distinct = pd.factorize(keys.view(np.int64))
            new = pd.Series(np.bincount(codes, minlength=len(distinct)), index=distinct)
            total = new if total.empty else total.add(new, fill_value=0)
        return total.index.to_numpy().astype(np.int64), total.to_numpy().astype(np.int64)

    def sums(self, texts: list[str | None], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: sum of the values of its n-grams, and their number. ``keys`` are sorted and hold all n-grams."""
        total, number = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for k, owner in self.pieces(texts):
            codes, distinct = pd.factorize(k.view(np.int64))
            at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
            total += np.bincount(owner, weights=values[at][codes], minlength=len(texts))
            number += np.bincount(owner, minlength=len(texts))
        return total, number


def counted(docs: DataFrame, grams: Grams, group: str) -> DataFrame:
    """(group, key, n): occurrences of each n-gram in texts of each group, as far as one task holds them.

    ``docs`` has the columns ``group`` (int or string) and text. Whoever needs totals sums them up.
    """
    kind = dict(docs.dtypes)[group]

    arrow = pa.string() if kind == "string" else pa.int32()

    def row_batch(held: dict) -> pa.RecordBatch:
        names = [pa.array([name] * len(c), arrow) for name, c in held.items()]
        keys = [pa.array(c.index.to_numpy().astype(np.int64)) for c in held.values()]
        counts = [pa.array(c.to_numpy().astype(np.int64)) for c in held.values()]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (names, keys, counts)], names=[group, "key", "n"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            for part in pieces(batch):
                groups, texts = part.column(group).to_pylist(), part.column("text").to_pylist()
                for name in dict.fromkeys(groups):
                    k, c = grams.counts([t for g, t in zip(groups, texts) if g == name])
                    new = pd.Series(c, index=k)
                    held[name] = held[name].add(new, fill_value=0) if name in held else new
                if sum(map(len, held.values())) > HELD_KEYS:
                    yield row_batch(held)
                    held = {}
        if held:
            yield row_batch(held)

    ship(docs.sparkSession)
    return docs.select(group, "text").mapInArrow(run, f"{group} {kind}, key bigint, n bigint")


def scored(blocks: DataFrame, values: DataFrame, grams: Grams) -> DataFrame:
    """(doc_id, lang, total, n_grams) of documents whose block meets the values of its n-grams.

    ``blocks`` has (doc_id, lang, text, block), ``values`` (block, key, value) for every n-gram of a block.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = right.column("key").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        parts = [pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "total": pa.array([], pa.float64()), "n_grams": pa.array([], pa.int64())})]
        for batch in left.to_batches(max_chunksize=512):
            total, number = grams.sums(batch.column("text").to_pylist(), keys, values)
            parts.append(pa.table({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "total": total, "n_grams": number}))
        return pa.concat_tables(parts)

    schema = "doc_id bigint, lang string, total double, n_grams bigint"
    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)


def low(key: str, order: int, bits: int):
    """Last ``order`` characters of a key."""
    return F.col(key).bitwiseAND(F.lit((1 << order * bits) - 1).cast("bigint")) if order * bits < 64 else F.col(key)


def context(key: str, bits: int):
    """All characters of a key but the last."""
    return F.shiftrightunsigned(F.col(key), bits)
