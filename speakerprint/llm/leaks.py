"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may lose, gain or change up to ``budget`` of them in a document. It is cut
into budget + 1 pieces, of which at least one then stands in the document unchanged. Documents are
searched for exact pieces by hashes of word windows; the surroundings of each hit are verified with
Myers' bit-parallel distance over words.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Items and documents
without words, null or empty, match nothing. Items are taken in blocks of bounded size that go to the
tasks; each block is one pass over the documents, so that any number of items is searched. Equal items
are searched once and reported under each id; repeated rows of documents are reported once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import as_bytes, map_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Share of an item's words that may differ.
TOLERANCE = 0.2
#: Bytes of items that are searched in one pass.
BLOCK_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def budget(n_words: int, tolerance: float = TOLERANCE) -> int:
    """Word edits that an item of ``n_words`` may have."""
    return int(n_words * tolerance + 1e-9)


def cut(words: list[bytes], k: int) -> list[tuple[int, int]]:
    """(start, stop) of k + 1 pieces of nearly equal length."""
    n = len(words)
    edges = [n * i // (k + 1) for i in range(k + 2)]
    return list(zip(edges, edges[1:]))


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of the text, and the first end with it."""
    m = len(pattern)
    peq: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Searcher:
    """Pieces of a block of items, by length, with their hashes in order."""

    def __init__(self, items: list[tuple[int, bytes]], tolerance: float):
        same: dict[tuple[bytes, ...], list[int]] = {}
        for item, text in items:
            words = WORD.findall(text.lower())
            if words:
                same.setdefault(tuple(words), []).append(item)
        self.items = [(list(w), budget(len(w), tolerance), ids) for w, ids in same.items()]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({x for words, _, _ in self.items for x in words}))}
        by_length: dict[int, list[tuple[tuple[bytes, ...], int, int]]] = {}
        for n, (words, k, _) in enumerate(self.items):
            for start, stop in cut(words, k):
                by_length.setdefault(stop - start, []).append((tuple(words[start:stop]), n, start))
        self.pieces = {}
        for length, found in by_length.items():
            where: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
            for piece, n, start in found:
                where.setdefault(piece, []).append((n, start))
            ids = np.array([[self.vocabulary[w] for w in piece] for piece in where], dtype=np.uint64)
            self.pieces[length] = (np.unique(self._hashes(ids.T)), where)

    @staticmethod
    def _hashes(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def hits(self, words: list[bytes], ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place of its first word, had nothing moved) for every exact piece in the words."""
        for length, (hashes, where) in self.pieces.items():
            n = len(ids) - length + 1
            if n < 1:
                continue
            known = np.flatnonzero(ids[:n])
            for i in range(1, length):
                known = known[ids[known + i] != 0]
            if not len(known):
                continue
            h = self._hashes([ids[known + i] for i in range(length)])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for p in known[hashes[at] == h].tolist():
                for item, start in where.get(tuple(words[p : p + length]), ()):
                    yield item, p - start

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, distance, first word, n_words) of every item found in a text."""
        words = WORD.findall(text.lower())
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, set[int]] = {}
        for item, place in self.hits(words, ids):
            if place in seen.setdefault(item, set()):
                continue
            seen[item].add(place)
            pattern, k, _ = self.items[item]
            lo = max(0, place - k)
            distance, _ = myers(pattern, words[lo : place + len(pattern) + k])
            if distance <= k:
                best[item] = min(best.get(item, (k + 1, 0)), (distance, max(0, place)))
        return [(i, d, p, len(self.items[n][0])) for n, (d, p) in best.items() for i in self.items[n][2]]


def _blocks(items: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of bounded size, one block at a time on the driver."""
    rows = items.select(F.col(id).cast("bigint"), as_bytes(F.col(text))).where(F.col(id).isNotNull())
    block, size = [], 0
    for item, value in rows.toLocalIterator():
        block.append((item, bytes(value)))
        size += len(value) + 16
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


SCHEMA = "item_id bigint, distance int, first_word bigint, item_words int"
_FOUND = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int64()), ("item_words", pa.int32())])


def find_leaks(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(doc_id, item_id, distance, first_word, item_words) for every item found in every document."""
    chosen = docs.select(F.col(id).cast("bigint").alias("doc_id"), as_bytes(F.col(text)).alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text):
        found = map_batches(chosen, _search_step(docs, block, tolerance), f"doc_id bigint, {SCHEMA}")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else chosen.sparkSession.createDataFrame([], f"doc_id bigint, {SCHEMA}")


def _search_step(docs: DataFrame, block: list[tuple[int, bytes]], tolerance: float):
    shared = docs.sparkSession.sparkContext.broadcast(block)
    made: list[Searcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not made:
            made.append(Searcher(shared.value, tolerance))
        rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in made[0].search(t)]
        if not rows:
            return None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        names = ["doc_id", "item_id", "distance", "first_word", "item_words"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """The documents in which no item is found, with their own columns.

    The search runs where the rows are; no row moves.
    """
    schema, columns = docs.schema, docs.columns
    out = docs
    for block in _blocks(items, item_id, item_text):
        at = columns.index(text)
        out = map_batches(out, _keep_step(docs, block, tolerance, at), schema)
    return out


def _keep_step(docs: DataFrame, block: list[tuple[int, bytes]], tolerance: float, at: int):
    shared = docs.sparkSession.sparkContext.broadcast(block)
    made: list[Searcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not made:
            made.append(Searcher(shared.value, tolerance))
        ok = [not made[0].search((t or "").encode()) for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(ok, pa.bool_()))

    return run


