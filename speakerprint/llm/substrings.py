"""Repeated passages by suffix automata of reference shards.

The corpus is its own reference. Words of documents are streamed through automata that tell, at each word, how long the
text before it also occurs elsewhere (matching statistics up to the window's length): windows of ``WINDOW`` words that
stand in two places at least are removed, as maximal spans.

An automaton of the whole corpus cannot be broadcast, and broadcasting all shards in turn would read the documents once
per shard. So shards follow the words: every window has an anchor, the least hash among its runs of ``GRAM`` words (the last
of equal ones), and equal windows have equal anchors at equal places.

* Windows with one anchor lie side by side and make one run. Anchors that stand in one place end the search for their windows: most of
  the text. A run that stands in several places is repeated as a whole; a hash of its words stands for it.
* What remains are anchors with different runs. One text of each of these runs is the reference; the anchors are dealt to shards of about ``SHARD_WORDS`` words,
  whatever the corpus has. A task builds the automaton of a shard, with the places of every substring, and streams through it those runs of
  the documents that only a part may be repeated of.
* Anchors with more than ``MANY`` different runs, such as the end of a frequent passage that goes on differently each time, fit no shard: their
  windows are dealt by their own hashes instead, where equal windows meet and no others do.

Words are runs of bytes other than ASCII white space, unchanged. Hashes of 128 bits (anchor and run) stand for runs; within a shard words
are compared themselves. Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; equal texts and repeated
rows are repeats of each other; a null doc_id is a document like any other; an empty table gives no rows. Texts of any length are taken whole. Other columns of the
input do not reach the result, whatever their names.
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

WINDOW = 35
GRAM = 8
#: Words of the runs of a shard, and different runs of an anchor that are kept together.
SHARD_WORDS = 1 << 16
MANY = 2048
#: Windows of a text that are looked at together.
CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scattered(h: np.ndarray) -> np.ndarray:
    """Hashes in an order that tells nothing of their making."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``seen`` remembers them."""
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def runs_of(hashes: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, past the last window, place of the anchor) of a text's runs, chunk by chunk."""
    for at in range(0, len(hashes) - window + 1, CHUNK):
        part = hashes[at : at + CHUNK + window - 1]
        n = len(part) - GRAM + 1
        grams = np.zeros(n, dtype=np.uint64)
        for i in range(GRAM):
            grams = grams * _ODD + part[i : i + n]
        grams = _scattered(grams)
        width = window - GRAM + 1
        views = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
        place = np.arange(len(views)) + width - 1 - views.argmin(axis=1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        stop = np.concatenate([first[1:], [len(place)]])
        yield grams[place[first]].view(np.int64), first + at, stop + at, place[first] + at


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, run, key, first, windows): the runs of every text; ``run`` stands for their words and the anchor's place among them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        seen: dict[bytes, int] = {}
        anchors, digests, keys, firsts, sizes = [], [], [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            hashes = word_hashes(text.split(), seen)
            raw = hashes.tobytes()
            for anchor, first, stop, place in runs_of(hashes, window):
                ends = (8 * (stop + window - 1)).tolist()
                digests += [xxhash.xxh3_64_intdigest(raw[8 * s : e], p) - (1 << 63) for s, e, p in zip(first.tolist(), ends, (place - first).tolist())]
                anchors.append(anchor)
                firsts.append(first)
                sizes.append(stop - first)
                keys += [key] * len(anchor)
        if not keys:
            return None
        columns = [pa.array(np.concatenate(anchors)), pa.array(digests, pa.int64()), pa.array(keys, pa.binary())]
        columns += [pa.array(np.concatenate(firsts)), pa.array(np.concatenate(sizes).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "run", "key", "first", "windows"])

    return map_batches(docs.select("key", "text"), run, "anchor bigint, run bigint, key binary, first bigint, windows int")


def _packed(docs: DataFrame) -> DataFrame:
    """(id, key, packed): texts compressed where they are read, before they are shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor()
        packed = [packer.compress(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(packed, pa.binary())], names=["id", "key", "packed"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", "key", "text"), run, f"id {kind}, key binary, packed binary")


def _run_texts(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """(anchor, run, words, n_words) of each kind of run, from the text that is its first place."""
    wanted = kinds.select("anchor", "run", F.col("place.key").alias("key"), F.col("place.first").alias("first"), "windows")
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "run", "first", "windows")).alias("wanted"))
    keepers = docs.groupBy("key").agg(F.min(F.struct("id")).alias("keeper"))
    named = wanted.join(keepers, "key").select(F.col("key").alias("key_"), F.col("keeper.id").alias("id_"), "wanted")
    joined = _packed(docs).join(named, (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for packed, runs in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
            words = zstandard.decompress(packed).split()
            for r in runs:
                part = words[r["first"] : r["first"] + r["windows"] + window - 1]
                rows.append((r["anchor"], r["run"], b" ".join(part), len(part)))
        if not rows:
            return None
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["anchor", "run", "words", "n_words"])

    found = map_batches(joined.select("packed", "wanted"), run, "anchor bigint, run bigint, words binary, n_words bigint")
    return found.dropDuplicates(["anchor", "run"])  # repeated rows with equal ids


class Automaton:
    """Suffix automaton of several texts over integer symbols; ``places`` counts where a state's substrings end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.places: list[int] = [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The part of state q that is p's longest substring and the symbol, as a state of its own."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list[int], places: int = 1) -> None:
        """Add a text that stands in so many places."""
        last = 0
        for symbol in symbols:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p != -1 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][symbol]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
                last = new
            self.places[last] += places

    def close(self) -> None:
        """Hand the places of each state on to those of its suffixes, longest first."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[v]] += self.places[v]

    def statistics(self, symbols: list[int], most: int) -> Iterator[tuple[int, int]]:
        """At each symbol: the length, up to ``most``, of the longest match that ends there, and its places."""
        v = length = 0
        for symbol in symbols:
            while v and symbol not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            if symbol in self.next[v]:
                v, length = self.next[v][symbol], length + 1
            while length >= most and self.length[self.link[v]] >= most:
                v = self.link[v]
            length = min(length, most)
            yield length, self.places[v]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
RESOLVED = "anchor bigint, run bigint, spans array<struct<start:int,stop:int>>"


def _flagged(flags: np.ndarray) -> list[dict]:
    """Runs of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [dict(start=int(s), stop=int(e)) for s, e in zip(edge[::2], edge[1::2])]


def _by_automata(runs: DataFrame, window: int) -> DataFrame:
    """(anchor, run, spans of windows) of the runs with one place, by the automaton of their shard."""

    def run(table: pa.Table) -> pa.Table:
        symbols: dict[bytes, int] = {}
        rows = table.select(["anchor", "run", "n", "words"]).sort_by([("anchor", "ascending"), ("run", "ascending")])
        texts = [[symbols.setdefault(w, len(symbols)) for w in words.split()] for words in rows.column("words").to_pylist()]
        places = rows.column("n").to_pylist()
        automaton = Automaton()
        for text, n in zip(texts, places):
            automaton.add(text, n)
        automaton.close()
        out = []
        for anchor, name, n, text in zip(rows.column("anchor").to_pylist(), rows.column("run").to_pylist(), places, texts):
            if n == 1:
                found = automaton.statistics(text, window)
                flags = np.array([length == window and c > 1 for length, c in found][window - 1 :], dtype=bool)
                if flags.any():
                    out.append((anchor, name, _flagged(flags)))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), _SPANS))], names=["anchor", "run", "spans"])

    return runs.groupBy("shard").applyInArrow(run, RESOLVED)


def _by_windows(runs: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many runs for a shard: windows meet by their own hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        rows = []
        for anchor, name, n, words in zip(*[batch.column(c).to_pylist() for c in ("anchor", "run", "n", "words")]):
            raw = word_hashes(words.split(), seen).tobytes()
            for at in range(len(raw) // 8 - window + 1):
                rows.append((anchor, name, n, at, xxhash.xxh3_64_intdigest(raw[8 * at : 8 * (at + window)]) - (1 << 63)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["anchor", "run", "n", "at", "digest"])

    windows = map_batches(runs.select("anchor", "run", "n", "words"), run, "anchor bigint, run bigint, n bigint, at int, digest bigint")
    windows = materialised(windows, "substring-windows")
    twice = windows.groupBy("anchor", "digest").agg(F.sum("n").alias("places")).where("places > 1").select("anchor", "digest")
    held = windows.where("n = 1").join(twice, ["anchor", "digest"])
    span = F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("stop"))
    return held.groupBy("anchor", "run").agg(F.collect_list(span).alias("spans"))


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, spans) by text: words covered by a window that also starts anywhere else; spans may overlap.

    ``docs`` has (id, key, text), with the content key of each text.
    """
    found = materialised(_anchored(docs, window), "substring-runs")
    facts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("lo"), F.max("run").alias("hi"))
    # Stored, so that the join has plain shuffles on both sides and Spark can split an anchor of very many rows.
    facts = materialised(facts.where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "substring-facts")
    several = materialised(found.join(facts, "anchor"), "substring-several")
    mixed = several.where("mixed")
    kinds = mixed.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first")).alias("place"), F.first("windows").alias("windows"))
    kinds = materialised(kinds, "substring-kinds")
    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    sizes = sizes.where("least = 1").select("anchor", "kinds")
    open_kinds = materialised(kinds.join(sizes, "anchor"), "substring-open")
    texts = _run_texts(docs, open_kinds, window)
    runs = materialised(open_kinds.select("anchor", "run", "n", "kinds").join(texts, ["anchor", "run"]), "substring-texts")
    total = runs.where(F.col("kinds") <= MANY).agg(F.sum("n_words").alias("w")).first()["w"] or 0
    shards = int(total // SHARD_WORDS) + 1
    sharded = runs.where(F.col("kinds") <= MANY).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    resolved = _by_automata(sharded, window).unionByName(_by_windows(runs.where(F.col("kinds") > MANY), window))
    # Runs with one place are where their kind has its first place.
    alone = kinds.where("n = 1").select("anchor", "run", "place").join(resolved, ["anchor", "run"])
    at = F.col("place.first")
    parts = alone.select(F.col("place.key").alias("key"), F.explode(F.transform("spans", lambda x: F.struct((x.start + at).alias("start"), (x.stop + at + (window - 1)).alias("stop")))).alias("span"))
    plural = kinds.where("n > 1").select("anchor", "run")
    whole = several.where("NOT mixed").select("key", "first", "windows").unionByName(mixed.join(plural, ["anchor", "run"]).select("key", "first", "windows"))
    whole = whole.distinct().select("key", F.struct(F.col("first").alias("start"), (F.col("first") + F.col("windows") + (window - 1)).alias("stop")).alias("span"))
    return materialised(whole.unionByName(parts).groupBy("key").agg(F.collect_list("span").alias("spans")), "substring-spans")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def remove_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, kept): the maximal spans of repeated words, and the other words joined by one space."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    rows = docs.select(F.col(id).alias("id"), as_bytes(F.col(text)).alias("text"), content_key(F.col(text)).alias("key"))
    spans = repeated_words(rows, window)
    joined = _packed(rows).join(spans, "key", "left")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, kept = [], [], []
        for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
            words = zstandard.decompress(packed).split()
            merged = _merged(found)
            edges = [0, *[x for s in merged for x in s], len(words)]
            sizes.append(len(words))
            gone.append([dict(start=s, stop=e) for s, e in merged])
            kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, span_type), pa.array(kept, pa.binary())], names=["id", "n_words", "spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    out = map_batches(joined.select("id", "packed", "spans"), run, f"id {kind}, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return out.withColumnRenamed("id", id)
