"""Repeated passages by longest-previous-factor arrays over suffixes cut at the wanted length.

Whether a position's longest previous factor reaches ``min_len`` bytes only depends on suffixes with the
same first ``min_len`` bytes: in suffix order, with equal ones by position, the previous smaller position
is the neighbour before. So suffixes are sharded such that equal ones meet, and each shard is sorted.

* Sharding. Every window of ``min_len`` bytes has one anchor, the least hash of its ``GRAM``-byte grams
  (the last of equal ones). Equal windows have equal anchors at equal offsets. Anchors that occur once in
  the corpus end the search for their windows; they are most of the text.
* Windows with one anchor lie side by side and make one run, which a hash stands for. Where an anchor only
  has equal runs, all its windows are repeated and no bytes move. Otherwise the bytes of one of each equal
  runs are fetched, so that a passage in a third of all documents is one row, and the different runs of an
  anchor meet in one array of suffixes; anchors with more than ``MANY`` runs, such as the end of a frequent
  passage, are resolved by grouping the hashes of single windows instead.
* Texts are taken by content: copies of a document take part once and are repeated as a whole.

Bytes are those of UTF-8. A null or empty text has none. Matches never cross documents; overlapping
copies count. Equal texts are ordered by doc_id; repeated rows are repeats of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import as_bytes, content_key, map_batches, materialised

MIN_LEN = 200
GRAM = 40
#: Different runs of an anchor that are sorted together: some 350 bytes each.
MANY = 16_384
#: Bytes of a text that are looked at together; positions within take 24 bits.
CHUNK = 1 << 22
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` bytes, put together from runs of powers of two."""
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h, width = _BYTES[data], 1
    out, done = None, 0
    while True:
        if length & width:
            part = h[done : done + n]
            out = part if out is None else out * np.uint64(pow(_BASE, width, 1 << 64)) + part
            done += width
        if done == length:
            return _mixed(out)
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2


def _window_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    m, w = v, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - w : len(v) - w + 1]) if width > w else m


def runs_of(text: bytes, min_len: int = MIN_LEN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, past the last window, offset of the anchor in the first window) per piece of text."""
    for at in range(0, max(1, len(text) - min_len + 1), CHUNK):
        data = np.frombuffer(text, dtype=np.uint8, count=min(CHUNK + min_len - 1, len(text) - at), offset=at)
        if len(data) < min_len:
            return
        h = gram_hashes(data, GRAM)
        place = np.arange(len(h), dtype=np.uint64)
        least = _window_least((h & ~_LOW) | (_LOW - place), min_len - GRAM + 1)
        anchor = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        stop = np.concatenate([first[1:], [len(anchor)]])
        where = anchor[first]
        yield h[where].view(np.int64), first + at, stop + at, where - first


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, packed): texts compressed where they are read, before they are shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [zstandard.compress(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])

    return map_batches(docs.select("doc_id", "key", "text"), run, "doc_id bigint, key binary, packed binary")


def _unpacked(packed: bytes) -> bytes:
    return zstandard.decompress(packed) if packed else b""


def _digests(text: bytes, first: np.ndarray, stop: np.ndarray, offset: np.ndarray, min_len: int) -> list[int]:
    """64 bits that stand for each run: its bytes and the place of its anchor."""
    ends = (stop + (min_len - 1)).tolist()
    runs = zip(first.tolist(), ends, offset.tolist())
    return [xxhash.xxh3_64_intdigest(text[s:e], o) - (1 << 63) for s, e, o in runs]


def anchors(docs: DataFrame, min_len: int) -> DataFrame:
    """(anchor, run, key, first, windows): the runs of every text, without their bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key, digest, parts = [], [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            for h, first, stop, offset in runs_of(text, min_len):
                parts.append((h, first, (stop - first).astype(np.int32)))
                digest += _digests(text, first, stop, offset, min_len)
                key += [k] * len(h)
        if not key:
            return None
        h, first, windows = (pa.array(np.concatenate(c)) for c in zip(*parts))
        columns = [h, pa.array(digest, pa.int64()), pa.array(key, pa.binary()), first, windows]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "run", "key", "first", "windows"])

    return map_batches(docs.select("key", "text"), run, "anchor bigint, run bigint, key binary, first bigint, windows int")


def _payloads(joined: DataFrame, min_len: int) -> DataFrame:
    """(anchor, run, key, first, payload) of the wanted runs of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for k, packed, wanted in zip(*[batch.column(c).to_pylist() for c in ("key", "packed", "wanted")]):
            text = _unpacked(packed)
            for w in wanted:
                rows.append((w["anchor"], w["run"], k, w["first"], text[w["first"] : w["first"] + w["windows"] + min_len - 1]))
        if not rows:
            return None
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        names = ["anchor", "run", "key", "first", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return map_batches(joined.select("key", "packed", "wanted"), run, "anchor bigint, run bigint, key binary, first bigint, payload binary")


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _spans(flags: np.ndarray) -> list[dict]:
    """Runs of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [dict(start=int(s), stop=int(e)) for s, e in zip(edge[::2], edge[1::2])]


def _suffixes(payloads: list[bytes], min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every suffix, cut at ``min_len``, of every run, and the number of the run."""
    hashes = [gram_hashes(np.frombuffer(p, dtype=np.uint8), min_len) for p in payloads]
    return np.concatenate(hashes), np.repeat(np.arange(len(payloads)), [len(h) for h in hashes])


def _resolve_small(groups: DataFrame, min_len: int) -> DataFrame:
    """Suffix order within each anchor: windows that occur in another run, and in one whose first place is earlier."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for anchor, members in zip(batch.column("anchor").to_pylist(), batch.column("members").to_pylist()):
            members.sort(key=lambda m: (m["place"]["key"], m["place"]["first"]))
            suffix, owner = _suffixes([m["payload"] for m in members], min_len)
            order = np.lexsort((owner, suffix))
            previous = np.concatenate([[False], suffix[order][1:] == suffix[order][:-1]])
            following = np.concatenate([previous[1:], [False]])
            earlier, shared = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
            earlier[order], shared[order] = previous, previous | following
            edges = np.searchsorted(owner, np.arange(len(members) + 1))
            for m, s, e in zip(members, edges, edges[1:]):
                if shared[s:e].any() or m["n"] > 1:
                    rows.append((anchor, m["run"], _spans(shared[s:e] | (m["n"] > 1)), _spans(earlier[s:e])))
        if not rows:
            return None
        kinds = [pa.int64(), pa.int64(), _SPAN, _SPAN]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["anchor", "run", "shared", "earlier"])

    return map_batches(groups.select("anchor", "members"), run, RESOLVED)


RESOLVED = "anchor bigint, run bigint, shared array<struct<start:int,stop:int>>, earlier array<struct<start:int,stop:int>>"


def _resolve_large(runs: DataFrame, min_len: int) -> DataFrame:
    """The same by grouping single windows, for anchors with too many runs to sort together."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        suffix, owner = _suffixes(batch.column("payload").to_pylist(), min_len)
        at = np.arange(len(owner)) - np.searchsorted(owner, owner)
        taken = [batch.column(c).take(pa.array(owner)) for c in ("anchor", "run", "place", "n")]
        return pa.RecordBatch.from_arrays(
            [pa.array(suffix.view(np.int64)), pa.array(at.astype(np.int32)), *taken], names=["suffix", "at", "anchor", "run", "place", "n"]
        )

    place = "place struct<key:binary,first:bigint>"
    rows = map_batches(runs.select("anchor", "run", "place", "n", "payload"), each, f"suffix bigint, at int, anchor bigint, run bigint, {place}, n bigint")
    found = rows.groupBy("anchor", "suffix").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("least"))
    both = rows.join(found, ["anchor", "suffix"]).where("c > 1 OR n > 1")
    window = F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("stop"))
    grouped = both.groupBy("anchor", "run").agg(
        F.collect_list(window).alias("shared"), F.collect_list(F.when(F.col("place") > F.col("least"), window)).alias("earlier")
    )
    return grouped


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """(key, shared, earlier) by text: bytes in a string that starts anywhere else, and in one that starts earlier.

    ``docs`` has (doc_id, key, text), with the content key of each text.
    """
    found = anchors(docs.where(F.octet_length("text") >= min_len), min_len)
    # Copies of a text have equal rows; counted as one, for a copied text is removed as a whole anyway.
    facts = found.groupBy("anchor").agg(
        F.min(F.struct("key", "first")).alias("lo"), F.max(F.struct("key", "first")).alias("hi"), F.min("run").alias("lo_run"), F.max("run").alias("hi_run")
    )
    facts = facts.where("lo <> hi").select(F.col("anchor"), "lo", (F.col("lo_run") != F.col("hi_run")).alias("mixed"))
    repeated = materialised(found.join(facts, "anchor").distinct(), "repeat-runs")
    # Anchors with equal runs only: every window is shared, and new in the least place alone.
    at = F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("windows") + (min_len - 1)).alias("stop")))
    no_span = F.expr("array()").cast("array<struct<start:bigint,stop:bigint>>")
    place = F.struct("key", "first")
    plain = repeated.where("NOT mixed").select("key", at.alias("shared"), F.when(place == F.col("lo"), no_span).otherwise(at).alias("earlier"))
    mixed = repeated.where("mixed").select("anchor", "run", "key", "first", "windows")
    resolved = _resolved(mixed, docs, min_len)
    back = mixed.join(resolved, ["anchor", "run"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("windows").alias("stop")))

    def moved(spans):
        return F.transform(spans, lambda x: F.struct((x.start + F.col("first")).alias("start"), (x.stop + F.col("first") + (min_len - 1)).alias("stop")))

    others = back.select("key", moved(F.col("shared")).alias("shared"), moved(F.when(place == F.col("place"), F.col("earlier")).otherwise(whole)).alias("earlier"))
    spans = plain.unionByName(others)
    return spans.groupBy("key").agg(F.flatten(F.collect_list("shared")).alias("shared"), F.flatten(F.collect_list("earlier")).alias("earlier"))


def _resolved(mixed: DataFrame, docs: DataFrame, min_len: int) -> DataFrame:
    """(anchor, run, shared, earlier, place) of runs whose anchors have others; places of the text are in the first of equal runs."""
    kinds = mixed.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first")).alias("place"), F.first("windows").alias("windows"))
    kinds = materialised(kinds, "repeat-kinds")
    wanted = kinds.select("anchor", "run", F.col("place.key").alias("key"), F.col("place.first").alias("first"), "windows")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "run", "first", "windows")).alias("wanted"))
    keepers = docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    joined = _packed(docs).join(wanted.join(keepers, "key"), ["key", "doc_id"]).dropDuplicates(["key", "doc_id"])
    payloads = _payloads(joined, min_len).select("anchor", "run", "payload")
    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    runs = kinds.select("anchor", "run", "n", "place").join(sizes, "anchor").join(payloads, ["anchor", "run"])
    runs = materialised(runs, "repeat-payloads")
    members = F.collect_list(F.struct("run", "n", "place", "payload")).alias("members")
    small = _resolve_small(runs.where(F.col("kinds") <= MANY).groupBy("anchor").agg(members), min_len)
    large = _resolve_large(runs.where(F.col("kinds") > MANY), min_len)
    return materialised(small.unionByName(large), "repeat-resolved").join(kinds.select("anchor", "run", "place"), ["anchor", "run"])


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


SCHEMA = (
    "doc_id bigint, n_bytes bigint, shared array<struct<start:bigint,stop:bigint>>, without_shared binary,"
    " earlier array<struct<start:bigint,stop:bigint>>, without_earlier binary"
)
_OUT = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """Spans and remaining bytes per document, for two rules.

    ``shared``: bytes in a ``min_len``-byte string that starts anywhere else are removed, every copy.
    ``earlier``: bytes in one that starts earlier are removed, so that the first copy stays. Texts come
    in the order of their content keys, and equal texts in the order of doc_id.
    """
    if min_len < 2 * GRAM:
        raise ValueError(f"min_len is {2 * GRAM} at least")
    rows = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), as_bytes(F.col(text)).alias("text"), content_key(F.col(text)).alias("key"))
    copies = rows.where(F.octet_length("text") >= min_len).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keeper"))
    spans = repeated_spans(rows, min_len)
    facts = copies.join(spans, "key", "left").where("copies > 1 OR shared IS NOT NULL")
    joined = _packed(rows).join(facts, "key", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, packed, n, keeper, shared, earlier in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "packed", "copies", "keeper", "shared", "earlier")]):
            t = _unpacked(packed)
            whole = [(0, len(t))]
            every = whole if (n or 0) > 1 else _merged(shared)
            later = whole if (n or 0) > 1 and doc != keeper else _merged(earlier)
            out.append((len(t), [dict(start=s, stop=e) for s, e in every], _without(t, every), [dict(start=s, stop=e) for s, e in later], _without(t, later)))
        kinds = [pa.int64(), _OUT, pa.binary(), _OUT, pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "shared", "without_shared", "earlier", "without_earlier"])

    out = map_batches(joined.select("doc_id", "packed", "copies", "keeper", "shared", "earlier"), run, SCHEMA)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
