"""Byte-level BPE as a monoid: texts are encoded in halves that are joined at their boundary.

Two levels use the same idea. A text is cut into matches of the split pattern, and a match into
bytes that merge by rank. In both, the result of a half is kept except near the boundary:

* matches: every match of the left half that ends two characters before the half does was decided by
  characters inside it (the pattern looks that far ahead at most, for 'll and 're). Matching goes on
  from the start of the first other match, one match at a time, until a match ends where one of the right half starts; from
  there on the right half's matches stand, since matching only depends on what follows.
* bytes: a sequence of tokens is the encoding of its bytes if and only if every two neighbours are the
  encoding of their joint bytes. So a window around the boundary is encoded again and grows,
  twice as far each time, on a side whose neighbours don't fit, until both fit.

Decoding is the concatenation up the same tree. A null or empty text has no tokens. Repeated rows are
encoded one by one. Rank files are a parameter; special tokens are never produced.

Spark keeps a Python worker for the tasks that follow, of whatever stage. So a worker forgets at the end of a task
what it remembered of the texts, and texts that are both encoded and decoded take one worker a task (``round_trip``).
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import pieces, ship

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a match, and characters up to which a text, is a leaf of its tree.
LEAF_BYTES = 6
LEAF_CHARS = 1 << 16
#: Characters behind a match that can decide where it ends.
LOOK_AHEAD = 2
#: Bytes from which pairs are kept in a heap.
LONG_BYTES = 96
#: Matches, and pairs of tokens, that a worker remembers; the memory is started anew beyond it.
REMEMBER = 400_000
#: Characters of a match that is remembered.
SHORT = 32
#: Larger than any rank.
NEVER = 1 << 62

#: Fixed: the characters with Unicode's White_Space property.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: The last code point of the basic plane. ``re`` looks up classes of it in a bitmap.
BASIC = 0xFFFF
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _ranges(property_pattern: str, last: int) -> str:
    """A character class, without brackets, of the code points up to ``last`` that have a property."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, last + 1)]))
    runs = ([ord(c) for c in run[0]] for run in regex.finditer(property_pattern, everything))
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for run in runs for r in _unbroken(run))


def _unbroken(run: list[int]) -> list[list[int]]:
    """A run of code points cut where it skips the surrogates."""
    cut = [i for i in range(1, len(run)) if run[i] != run[i - 1] + 1]
    return [run[a:b] for a, b in zip([0, *cut], [*cut, len(run)])]


@lru_cache(maxsize=4)
def splitter(pattern: str, last: int) -> re.Pattern:
    """The split pattern for ``re`` with listed ranges, several times as fast as by properties."""
    letters, numbers = _ranges(r"\p{L}+", last), _ranges(r"\p{N}+", last)
    listed = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE_SPACE}{letters}{numbers}]").replace(r"\S", f"[^{WHITE_SPACE}]")
    listed = listed.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{WHITE_SPACE}]")
    return re.compile(listed)


class Known(dict):
    """Matches and their tokens as little-endian 32-bit integers, encoded when first asked for."""

    def __init__(self, enc: Encoder):
        super().__init__()
        self.enc = enc

    def __missing__(self, match: str) -> bytes:
        packed = array("I", self.enc.encode_match(match.encode())).tobytes()
        if sys.byteorder == "big":
            packed = np.frombuffer(packed, "u4").astype("<u4").tobytes()
        if len(match) <= SHORT:
            if len(self) >= REMEMBER:
                self.clear()
            self[match] = packed
        return packed


class Encoder:
    """Encoder of one rank file, with the joins of both levels."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = pattern
        self.pairs: dict[int, list[int]] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.known = Known(self)

    def forget(self) -> None:
        """Start anew; only the ranks stay."""
        self.known.clear()
        self.pairs.clear()
        self.leaves.clear()

    def merged(self, data: bytes) -> list[int]:
        """Encoding of some bytes: the leftmost pair of lowest rank merges first."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > LONG_BYTES:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        return [ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """Encoding of the joint bytes of two tokens, remembered."""
        key = a << 32 | b
        ids = self.pairs.get(key)
        if ids is None:
            if len(self.pairs) >= REMEMBER:
                self.pairs.clear()
            ids = self.pairs[key] = self.merged(self.tokens[a] + self.tokens[b])
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their joint bytes."""
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joint bytes of two encodings."""
        i, j, back, ahead = len(left) - 1, 1, 1, 1
        window = self.pair(left[-1], right[0])
        while True:
            left_fits = not i or self.fits(left[i - 1], window[0])
            right_fits = j >= len(right) or self.fits(window[-1], right[j])
            if left_fits and right_fits:
                return left[:i] + window + right[j:]
            if not left_fits:
                i, back = max(0, i - back), 2 * back
            if not right_fits:
                j, ahead = min(len(right), j + ahead), 2 * ahead
            window = self.merged(b"".join(map(self.tokens.__getitem__, [*left[i:], *right[:j]])))

    def encode_match(self, data: bytes) -> list[int]:
        """Encoding of one match of the split pattern."""
        if len(data) <= LEAF_BYTES:
            ids = self.leaves.get(data)
            if ids is None:
                if len(self.leaves) >= REMEMBER:
                    self.leaves.clear()
                ids = self.leaves[data] = self.merged(data)
            return ids
        if data in self.ranks:
            return [self.ranks[data]]
        half = len(data) // 2
        return self.join(self.encode_match(data[:half]), self.encode_match(data[half:]))

    def splitter(self, text: str) -> re.Pattern:
        return splitter(self.pattern, 0x10FFFF if BEYOND.search(text) else BASIC)

    def starts(self, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF_CHARS) -> list[int]:
        """Start of every match in text[lo:hi], as if the text ended at ``hi``."""
        hi = len(text) if hi is None else hi
        split = self.splitter(text)
        if hi - lo <= leaf:
            return [m.start() for m in split.finditer(text, lo, hi)]
        half = (lo + hi) // 2
        left, right = self.starts(text, lo, half, leaf), self.starts(text, half, hi, leaf)
        while len(left) > 1 and left[-1] > half - LOOK_AHEAD:
            left.pop()
        at = left.pop()
        while at < hi:
            k = bisect_left(right, at)
            if k < len(right) and right[k] == at:
                return left + right[k:]
            left.append(at)
            at = split.match(text, at, hi).end()
        return left

    def encode(self, text: str) -> bytes:
        """Tokens of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= LEAF_CHARS:
            matches = self.splitter(text).findall(text)
        else:
            cuts = self.starts(text)
            matches = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
        return b"".join(map(self.known.__getitem__, matches))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, halves first."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and rank file."""
    return Encoder(path)


def _task(path: str, step: Callable[[Encoder, pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its batches; its worker keeps the ranks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        try:
            for batch in batches:
                for part in pieces(batch):
                    yield step(enc, part)
        finally:
            enc.forget()

    return run


def _mapped(df: DataFrame, ranks: str | None, step: Callable[[Encoder, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(_task(ranks or public_tokenizers.path(RANKS), step), schema)


def _encoded(enc: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    packed = [enc.encode(t) for t in batch.column("text").to_pylist()]
    columns = [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "tokens"])


def _decoded(enc: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    out = [enc.decode(np.frombuffer(t, dtype="<u4").tolist()) for t in batch.column("tokens").to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "tokens", "bytes"])


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens): token ids as little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file that every executor can open.
    """
    return _mapped(_texts(docs, id, text), ranks, _encoded, "doc_id bigint, n_tokens bigint, tokens binary")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens, bytes) of the rows of ``encode``."""
    return _mapped(encoded.select("doc_id", "n_tokens", "tokens"), ranks, _decoded, "doc_id bigint, n_tokens bigint, tokens binary, bytes binary")


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """The rows of ``decode(encode(docs))``, by one Python worker a task instead of two."""

    def both(enc: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        return _decoded(enc, _encoded(enc, batch))

    return _mapped(_texts(docs, id, text), ranks, both, "doc_id bigint, n_tokens bigint, tokens binary, bytes binary")
