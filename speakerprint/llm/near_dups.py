"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its distinct 5-word shingles. Equal sets are one class from the start, and
only one document of each takes part in the join. Every independent tree branches documents down
chosen paths: at a node, ``BRANCHES`` of the minwise tokens are drawn by a hash of the node, and a
document goes on to the child named by its own values there. Nodes with one document end, and so do nodes whose
documents have one label, a label naming documents known to be of one class. Nodes of
up to ``SMALL`` documents compare all their pairs by minwise tokens and propose every one that agrees
enough. Larger ones end as cells, in which each document meets each of another label:

* a node whose documents have one label but for ``SMALL`` at most (a group of copies and what shares its tokens)
  gives each cell a block of documents of that label and all the others, so that its rows follow its documents;
* in a node of up to ``WHOLE`` documents, blocks of up to ``BLOCK`` meet two by two; so they do in a node that keeps more than half of its
  parent's documents ``LEVELS`` times in a row, which tokens do not separate.

Other large nodes compare every document with one pivot, the one that agrees most with the node's frequent tokens. Those
whose full sets are similar to it take its label; then the node ends as above or is branched further. Two roots of each document
are compared with pivots before all others, so that large groups of copies have one label in all trees.

Cells hold tokens, and the full sets of those documents that agree with another one enough. Pairs of different labels that agree enough, and that bitmaps of the sets do not rule out, are confirmed there, the best agreeing first; a
link merges its labels for the pairs that follow. So a cell gives fewer links than it has documents, whatever the number of its similar pairs. Blocks
are smaller where sets are large (``BLOCK_SHINGLES``). No pair that agrees enough is left out but those within one label. A node that tokens do not separate
takes time, and copies of its rows, by the square of its blocks.

Two documents at the threshold (0.75) share a child with probability 1 - 0.25^2 per level and meet in a given
tree, of any depth, with probability 8/9. All trees draw from the same ``MINHASHES`` tokens. Over the binomial
number of tokens that agree, ``TREES`` trees miss 2.5e-5 of such pairs and ``CANDIDATE`` another 1.2e-6, before
what other links of their classes join.
Other candidate pairs are confirmed on the full sets as well, and connected components of the confirmed links are
the classes.

Words are runs of bytes other than ASCII white space, A-Z lowered. A text with fewer than five words is
one shingle of all its words; a null or empty text has no shingles and is a class of its own. Rows that
repeat a doc_id are kept. A null doc_id never names a class; such a row is linked to what a row with an
id and the same shingles is linked to. Other columns of the input do not reach the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import as_bytes, map_batches, materialised, pieces, ship
from speakerprint.operators.scale import bit_filter, may_hold

SHINGLE = 5
#: Similarity in hundredths.
THRESHOLD = 75
MINHASHES = 128
TREES = 6
BRANCHES = 2
#: Documents of a node whose pairs are all proposed at once, levels in a row that a node may keep over half of its
#: parent's documents before its blocks meet, documents of a block, and tokens that vote for a pivot.
SMALL = 64
LEVELS = 2
BLOCK = 1024
VOTES = 16
#: Documents of a node whose blocks meet at once, shingles of a block, and the roots that are compared with pivots first.
WHOLE = 8192
BLOCK_SHINGLES = 1 << 21
FIRST_ROOTS = (0, 2)
#: Agreeing tokens for a candidate.
CANDIDATE = 72
#: Bits of a bitmap for each value, and of all at most.
VALUE_BITS = 16
MOST_BITS = 1 << 26
#: Rows about large nodes that are broadcast at most; more are joined by a shuffle.
FEW_NODES = 1 << 17
_PRIME = np.uint64((1 << 61) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the order of hashes tells nothing of their making."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, MINHASHES + 1, dtype=np.uint64) * _STEP)


def shingles(text: bytes, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text. ``words`` remembers word hashes."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], dtype=np.uint64)
    ids = []
    for w in found:
        h = words.get(w)
        if h is None:
            h = words[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    hashes = np.array(ids, dtype=np.uint64)
    n = len(hashes) - SHINGLE + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        out = _mixed(out * _STEP + hashes[i : i + n])
    return np.unique(out)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """``MINHASHES`` minwise tokens of 32 bits."""
    out = np.full(MINHASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 2048):
        h = hashes[start : start + 2048]
        x = (h[None, :] ^ _SEEDS[:, None]) * _STEP
        x ^= x >> np.uint64(32)
        np.minimum(out, x.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    words: dict[bytes, int] = {}
    size, name, tokens = [], [], []
    for text in batch.column("text").to_pylist():
        s = shingles(text, words)
        size.append(len(s))
        name.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        tokens.append(minwise(s).tobytes() if len(s) else None)
    columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(tokens, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "name", "tokens"])


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, name, tokens): size and name of the shingle set, and its minwise tokens."""
    chosen = docs.select(F.col(id).cast("bigint").alias("doc_id"), as_bytes(F.col(text)).alias("text"))
    return map_batches(chosen, _signed, "doc_id bigint, n_shingles bigint, name binary, tokens binary")


def _children(rows: DataFrame, level: int) -> DataFrame:
    """Rows (node, name, label, tokens, c, stuck) dealt to the children of their nodes; ``up`` is the parent's c."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column("node").to_numpy().astype(np.uint64)
        tokens = _tokens(batch)
        every = np.arange(len(node))
        nodes = []
        for b in range(BRANCHES):
            drawn = _mixed(node + np.uint64(0x51 + 2 * level + 1009 * b) * _STEP)
            value = tokens[every, (drawn % np.uint64(MINHASHES)).astype(np.int64)].view(np.uint32).astype(np.uint64)
            nodes.append(_mixed(drawn ^ (value * _STEP)))
        out = np.concatenate(nodes).astype(np.int64)
        rest = [pa.concat_arrays([batch.column(c)] * BRANCHES) for c in ("name", "label", "tokens", "c", "stuck")]
        return pa.RecordBatch.from_arrays([pa.array(out), *rest], names=["node", "name", "label", "tokens", "up", "stuck"])

    schema = "node bigint, name binary, label binary, tokens binary, up bigint, stuck int"
    return map_batches(rows.select("node", "name", "label", "tokens", "c", "stuck"), run, schema)


def _tokens(batch: pa.RecordBatch, column: str = "tokens") -> np.ndarray:
    values = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.int32).reshape(len(values), MINHASHES)


def _roots(names: DataFrame, which: Sequence[int] = range(TREES * BRANCHES)) -> DataFrame:
    """Nodes of the first level: every row (name, label, tokens) in ``TREES`` times ``BRANCHES`` nodes, or in some of them."""
    which = list(which)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = _tokens(batch).view(np.uint32).astype(np.uint64)
        nodes = []
        for i in which:
            drawn = _mixed(np.array([i // BRANCHES * 7919 + i], dtype=np.uint64) * _STEP)[0]
            nodes.append(_mixed(drawn ^ (tokens[:, (i * 11 + 3) % MINHASHES] * _STEP)))
        out = np.concatenate(nodes).astype(np.int64)
        rest = [pa.concat_arrays([batch.column(c)] * len(which)) for c in ("name", "label")]
        return pa.RecordBatch.from_arrays([pa.array(out), *rest], names=["node", "name", "label"])

    return map_batches(names.select("name", "label", "tokens"), run, "node bigint, name binary, label binary")


def _marked(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``may``: false where a bitmap tells that ``column`` is none of the (stored) values."""
    bits = min(MOST_BITS, 1 << max(10, (VALUE_BITS * values.count()).bit_length()))
    hashed = F.xxhash64(column).alias("__h")
    words = bit_filter(values.select(hashed), "__h", bits)
    return rows.select("*", hashed).withColumn("may", may_hold(words, "__h", bits)).drop("__h")


def _held(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The rows that a join with ``values`` can keep, and few others: a join that follows shuffles those alone."""
    return _marked(rows, values, column).where("may").drop("may")


def _few(stored: DataFrame) -> DataFrame:
    """A stored side of a join, broadcast where it has few rows."""
    return F.broadcast(stored) if stored.count() <= FEW_NODES else stored


def _leaf_pairs(small: DataFrame) -> DataFrame:
    """Pairs of small nodes: every pair of different labels that agrees in ``CANDIDATE`` tokens, by their lowest bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        pairs = set()
        for members in batch.column("members").to_pylist():
            members.sort(key=lambda m: m["name"])
            names = [m["name"] for m in members]
            classes = np.unique([m["label"] for m in members], return_inverse=True)[1]
            tokens = np.frombuffer(b"".join(m["tokens"] for m in members), dtype=np.uint8).reshape(len(members), MINHASHES)
            same = np.stack([(tokens == t).sum(axis=1) for t in tokens])
            i, j = np.nonzero(np.triu((same >= CANDIDATE) & (classes[:, None] != classes[None, :])))
            pairs |= {(names[x], names[y]) for x, y in zip(i.tolist(), j.tolist())}
        if not pairs:
            return None
        a, b = zip(*sorted(pairs))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    nodes = small.groupBy("node").agg(F.collect_list(F.struct("name", "label", "tokens")).alias("members")).select("members")
    return map_batches(nodes, run, "a binary, b binary")


def _pivots(large: DataFrame) -> DataFrame:
    """(node, pivot, pivot_tokens): the document that agrees most with the most frequent tokens of its node.

    Near copies of one text agree with it more than with each other, so that the text itself is found.
    Rows are sorted by node within their partitions, and each batch hands on one vote per node and
    place: votes follow the batches, not the documents. They only choose the pivot; no document is
    left out by them.
    """

    def votes(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The most frequent token of each place among the rows of one node in the batch, with its count."""
        node, tokens = batch.column("node").to_numpy(), _tokens(batch)[:, :VOTES]
        order = np.argsort(node, kind="stable")
        ids, starts = np.unique(node[order], return_index=True)
        top = np.zeros((len(ids), VOTES), dtype=np.int32)
        times = np.zeros((len(ids), VOTES), dtype=np.int64)
        for i, rows in enumerate(np.split(tokens[order], starts[1:])):
            for place in range(VOTES):
                values, c = np.unique(rows[:, place], return_counts=True)
                best = c.argmax()
                top[i, place], times[i, place] = values[best], c[best]
        place = np.tile(np.arange(VOTES, dtype=np.int32), len(ids))
        columns = [np.repeat(ids, VOTES), place, top.reshape(-1), times.reshape(-1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "place", "value", "c"])

    together = large.select("node", "tokens").sortWithinPartitions("node")
    counted = map_batches(together, votes, "node bigint, place int, value int, c bigint").groupBy("node", "place", "value").agg(F.sum("c").alias("c"))
    frequent = counted.groupBy("node", "place").agg(F.max(F.struct("c", "value")).alias("top"))
    frequent = frequent.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "top.value"))).alias("votes"))

    def agree(batch: pa.RecordBatch) -> pa.RecordBatch:
        top = np.array([[v["value"] for v in x] for x in batch.column("votes").to_pylist()], dtype=np.int32)
        same = (_tokens(batch)[:, :VOTES] == top).sum(axis=1)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "name", "label", "tokens")], pa.array(same, pa.int64())], names=["node", "name", "label", "tokens", "same"])

    rated = map_batches(large.join(frequent, "node").select("node", "name", "label", "tokens", "votes"), agree, "node bigint, name binary, label binary, tokens binary, same bigint")
    best = rated.groupBy("node").agg(F.max(F.struct("same", F.xxhash64("node", "name").alias("o"), "name", "label", "tokens")).alias("p"))
    return best.select("node", F.col("p.name").alias("pivot"), F.col("p.label").alias("pivot_label"), F.col("p.tokens").alias("pivot_tokens"))


def _agreement(rows: DataFrame) -> DataFrame:
    """Agreeing tokens of each document and the pivot of its node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same = (_tokens(batch) == _tokens(batch, "pivot_tokens")).sum(axis=1)
        columns = [batch.column(c) for c in ("node", "name", "label", "tokens", "stuck", "pivot", "pivot_label")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(same, pa.int64())], names=["node", "name", "label", "tokens", "stuck", "pivot", "pivot_label", "same"])

    return map_batches(
        rows.select("node", "name", "label", "tokens", "stuck", "pivot", "pivot_label", "pivot_tokens"), run,
        "node bigint, name binary, label binary, tokens binary, stuck int, pivot binary, pivot_label binary, same bigint",
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out.distinct()


_COUNTS = (F.count, "c"), (F.min, "lo"), (F.max, "hi")


def _sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, c) of nodes or cells that hold several labels."""
    return rows.groupBy(*keys).agg(*[f("label").alias(n) for f, n in _COUNTS]).where("lo <> hi").select(*keys, "c")


def _sorted_out(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node, name, label, tokens, c, stuck) of large nodes with what is known of their node's end.

    ``kind`` is ``lopsided``, ``dense`` or ``open``; ``top`` names the most frequent label, with its documents and shingles, ``w``
    counts the shingles of all.
    """
    sized = rows.join(sets.select("name", "size"), "name")
    tops = sized.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    tops = tops.groupBy("node").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("w").alias("w"))
    lopsided = F.col("c") - F.col("top.n") <= SMALL
    dense = (F.col("c") <= WHOLE) | (F.col("stuck") >= LEVELS)
    return rows.join(_few(materialised(tops, "near-tops")), "node").withColumn("kind", F.when(lopsided, "lopsided").when(dense, "dense").otherwise("open"))


def _cells(rows: DataFrame) -> DataFrame:
    """(node, i, j, side, own, name, label) of rows that end: their cells.

    A cell (node, i, j) has two sides; ``own`` is the side, counted from 1, whose documents meet each other as well.
    """

    def blocks(count, shingles):
        return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")

    def part(n):
        return F.pmod(F.xxhash64("name", "node"), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    n = blocks(F.col("c"), F.col("w"))
    whole = rows.where("kind = 'dense'").withColumn("part", part(n)).withColumn("other", every(n))
    whole = whole.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    whole = whole.withColumn("side", F.when(F.col("part") == F.col("i"), 0).otherwise(1)).withColumn("own", F.when(F.col("i") == F.col("j"), 1).otherwise(0))
    n = blocks(F.col("top.n"), F.col("top.w"))
    uneven = rows.where("kind = 'lopsided'").withColumn("j", F.lit(-1))
    most = uneven.where(F.col("label") == F.col("top.label")).withColumn("i", part(n)).withColumn("side", F.lit(0))
    few = uneven.where(F.col("label") != F.col("top.label")).withColumn("i", every(n)).withColumn("side", F.lit(1))
    uneven = most.unionByName(few).withColumn("own", F.when(F.col("i") == 0, 2).otherwise(0))
    columns = ["node", "i", "j", "side", "own", "name", "label"]
    return whole.select(*columns).unionByName(uneven.select(*columns))


def _to_pivots(large: DataFrame, sets: DataFrame, texts: DataFrame, asked: list[DataFrame], sure: list[DataFrame]) -> DataFrame:
    """Rows (node, name, label, tokens, stuck) of large nodes, with the pivot's label where a link to it is confirmed."""
    compared = materialised(_agreement(large.join(_pivots(large), "node")), "near-large")
    near = compared.where((F.col("same") >= CANDIDATE) & (F.col("label") != F.col("pivot_label")))
    near = near.select(F.least("name", "pivot").alias("a"), F.greatest("name", "pivot").alias("b")).distinct()
    _ask(near, sets, texts, asked, sure)
    linked = _union(sure).select("a", "b", F.lit(True).alias("linked"))
    both = compared.withColumn("a", F.least("name", "pivot")).withColumn("b", F.greatest("name", "pivot")).join(linked, ["a", "b"], "left")
    label = F.when(F.col("linked"), F.col("pivot_label")).otherwise(F.col("label")).alias("label")
    return materialised(both.select("node", "name", label, "tokens", "stuck"), "near-labels")


def _ask(pairs: DataFrame, sets: DataFrame, texts: DataFrame, asked: list[DataFrame], sure: list[DataFrame]) -> None:
    """Confirm pairs that were not asked before."""
    if asked:
        pairs = pairs.join(_union(asked), ["a", "b"], "left_anti")
    asked.append(materialised(pairs, "near-asked"))
    sure.append(materialised(confirmed(asked[-1], sets, texts), "near-links"))


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed pairs (a, b), a < b, of names that the trees bring together.

    ``sets`` has name, key and tokens, one row each; ``texts`` (key, text). Documents take the label of a
    pivot only where their link to it is confirmed, so that documents of one label are of one class.
    """
    asked, sure, found, cells = [], [], [], []
    named = sets.select("name", F.col("name").alias("label"), "tokens")
    early = _roots(named, FIRST_ROOTS)
    # One node of every ``BLOCK`` sets and root at most, so that they are broadcast.
    crowded = materialised(early.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("node"), "near-crowded")
    early = materialised(early.join(F.broadcast(crowded), "node"), "near-early")
    if not early.isEmpty():
        early = materialised(_with_tokens(early, sets).withColumn("stuck", F.lit(0)), "near-early")
        # Every set is in two of these nodes at most, and takes the smaller one of the pivots that it is linked to.
        linked = _to_pivots(early, sets, texts, asked, sure).where("label <> name").groupBy("name").agg(F.min("label").alias("pivot"))
        linked = materialised(linked, "near-linked")
        parts = _marked(named, linked, "name")
        moved = parts.where("may").join(linked, "name", "left").select("name", F.coalesce("pivot", "label").alias("label"), "tokens")
        named = parts.where("NOT may").drop("may").unionByName(materialised(moved, "near-named"))
    first = _roots(named)
    shared = materialised(_sizes(first, "node").select("node"), "near-nodes")
    rows = materialised(_held(first, shared, "node").join(shared, "node"), "near-roots")
    rows = _with_tokens(rows, sets)
    rows = materialised(rows.withColumn("up", F.lit(None).cast("bigint")).withColumn("stuck", F.lit(0)), "near-level")
    for level in count(1):
        stats = rows.groupBy("node").agg(*[f("label").alias(n) for f, n in _COUNTS], F.first("up").alias("up"), F.first("stuck").alias("stuck")).where("lo <> hi")
        stats = stats.select("node", "c", F.when(2 * F.col("c") > F.col("up"), F.col("stuck") + 1).otherwise(F.lit(0)).alias("stuck"))
        stats = materialised(stats, "near-nodes")
        few, many = stats.where(F.col("c") <= SMALL).select("node"), stats.where(F.col("c") > SMALL)
        small = _held(rows, few, "node")
        small = small.select("node", "name", "label", _low_bytes(small).alias("tokens")).join(few, "node")
        found.append(materialised(_leaf_pairs(small).distinct(), "near-pairs"))
        if many.isEmpty():
            break
        known = _sorted_out(rows.select("node", "name", "label", "tokens").join(_few(many), "node"), sets)
        cells.append(materialised(_cells(known), "near-cells"))
        large = materialised(known.where("kind = 'open'").drop("top", "w", "kind"), "near-wide")
        if large.isEmpty():
            break
        rows = _to_pivots(large, sets, texts, asked, sure)
        known = materialised(_sorted_out(rows.join(_sizes(rows, "node"), "node"), sets), "near-known")
        cells.append(materialised(_cells(known), "near-cells"))
        rows = materialised(_children(known.where("kind = 'open'"), level), "near-level")
    _ask(_union(found), sets, texts, asked, sure)
    if cells:
        sure.append(_cell_links(reduce(DataFrame.unionAll, cells), sets, texts))
    return _union(sure)


def _with_tokens(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored rows (node, name, label) with the tokens of their sets."""
    return _held(sets.select("name", "tokens"), rows, "name").join(rows, "name").select("node", "name", "label", "tokens")


def _cell_links(cells: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that cells find between different labels."""
    open_cells = materialised(_once(cells), "near-open")
    held = _held(sets.select("name", "tokens"), open_cells, "name")
    tokens = held.select("name", _low_bytes(held).alias("tokens"))
    rows = materialised(_with_partners(open_cells.join(tokens, "name")), "near-partners")
    names = materialised(rows.select("name").distinct(), "near-names")
    full = materialised(_full_sets(names, sets, texts), "near-full")
    return materialised(_linked_in_cells(rows.join(full, "name")), "near-links")


def _low_bytes(sets: DataFrame) -> Column:
    """The lowest byte of each minwise token: what agrees in tokens agrees in these."""

    @F.pandas_udf("binary")
    def low(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: np.frombuffer(t, dtype="<u4").astype(np.uint8).tobytes())

    return low("tokens")


def _once(rows: DataFrame) -> DataFrame:
    """Rows of cells that hold several labels, one cell of those with the same documents and labels on the same sides."""
    cell = ["node", "i", "j"]
    held = [F.xxhash64("name", "label", "side", "own", F.lit(k)) for k in range(2)]
    what = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), *[F.bit_xor(h).alias(f"x{k}") for k, h in enumerate(held)])
    what = what.where("lo <> hi")
    return rows.join(what.groupBy("n", "x0", "x1").agg(F.min(F.struct(*cell)).alias("cell")).select("cell.*"), cell)


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets of distinct hashes have the similarity that links them."""
    if 100 * min(len(s), len(t)) < THRESHOLD * max(len(s), len(t)):
        return False
    both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
    return 100 * both >= THRESHOLD * (len(s) + len(t) - both)


def _bitmaps(members: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set: an element sets the bit that its hash names. Rows are some sixteen times as wide as an average set."""
    average = sum(map(len, members)) // max(1, len(members))
    width = min(1 << 16, max(1 << 9, 1 << (16 * average).bit_length()))
    bits = np.zeros((len(members), width), dtype=bool)
    for row, s in zip(bits, members):
        row[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _may_link(sizes: np.ndarray, bits: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Which sets the bitmaps do not rule out: a bit that only one of two sets has stands for an element that the other lacks."""
    both = np.bitwise_count(bits[others] & bits[x]).sum(axis=1, dtype=np.int64)
    ones = np.bitwise_count(bits[x]).sum(dtype=np.int64)
    most = np.minimum(sizes[x] - (ones - both), sizes[others] - (np.bitwise_count(bits[others]).sum(axis=1, dtype=np.int64) - both))
    return 100 * most >= THRESHOLD * (sizes[x] + sizes[others] - most)


def _partners(table: pa.Table, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each document of a cell those that it meets, of other labels, and that agree in ``CANDIDATE`` tokens, with the number of these."""
    tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), dtype=np.uint8).reshape(-1, MINHASHES)
    side, own = table.column("side").to_numpy(), table.column("own")[0].as_py()
    sides = [np.flatnonzero(side == s) for s in (0, 1)]
    todo = [(x, sides[0]) for x in sides[1]] + ([(x, sides[own - 1][n + 1 :]) for n, x in enumerate(sides[own - 1])] if own else [])
    for x, others in todo:
        others = others[labels[others] != labels[x]]
        agree = np.count_nonzero(tokens[others] == tokens[x], axis=1)
        yield x, others[agree >= CANDIDATE], agree[agree >= CANDIDATE]


def _numbered(table: pa.Table) -> np.ndarray:
    return np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)[1]


def _with_partners(rows: DataFrame) -> DataFrame:
    """The rows of cells that agree with another one enough: only their full sets are needed."""
    columns = ["node", "i", "j", "side", "own", "name", "label", "tokens"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        needed = np.zeros(table.num_rows, dtype=bool)
        for x, others, _ in _partners(table, _numbered(table)):
            needed[others] = True
            needed[x] |= len(others) > 0
        return table.filter(pa.array(needed))

    schema = "node bigint, i int, j int, side int, own int, name binary, label binary, tokens binary"
    return rows.select(*columns).groupBy("node", "i", "j").applyInArrow(run, schema)


def _linked_in_cells(rows: DataFrame) -> DataFrame:
    """Links between different labels of each cell, confirmed on the full sets: a spanning forest of the labels."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("name").combine_chunks()
        names, labels = table.column("name").to_pylist(), _numbered(table)
        members = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in table.column("members")]
        sizes, bits = np.array([len(m) for m in members]), _bitmaps(members)
        left, right, same = [], [], []
        for x, others, agree in _partners(table, labels):
            enough = _may_link(sizes, bits, x, others)
            left.append(np.full(int(enough.sum()), x))
            right.append(others[enough])
            same.append(agree[enough])
        left, right, same = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (left, right, same))
        order = np.argsort(-same, kind="stable")
        parent = list(range(int(labels.max()) + 1))

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        links = []
        for x, y in zip(left[order].tolist(), right[order].tolist()):
            u, v = root(labels[x]), root(labels[y])
            if u != v and similar(members[x], members[y]):
                parent[u] = v
                links.append((min(names[x], names[y]), max(names[x], names[y])))
        a, b = zip(*sorted(links)) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.select("node", "i", "j", "side", "own", "name", "label", "tokens", "members").groupBy("node", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def _overlap(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    a, b = [], []
    for x, y, s, t in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b")]):
        s, t = np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64)
        both = len(np.intersect1d(s, t, assume_unique=True))
        if 100 * both >= THRESHOLD * (len(s) + len(t) - both):
            a.append(x)
            b.append(y)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]) if a else None


def _set(batch: pa.RecordBatch) -> pa.RecordBatch:
    words: dict[bytes, int] = {}
    sets = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
    own = pa.array([xxhash.xxh3_128_digest(s) == n for s, n in zip(sets, batch.column("name").to_pylist())], pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sets, pa.binary())], names=["name", "members"]).filter(own)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts that are sorted by name, each name once."""
    last = None
    for batch in batches:
        for part in pieces(batch):
            found = _set(part)
            names = found.column("name").to_pylist()
            yield found.filter(pa.array([n != before for before, n in zip([last, *names], names)], pa.bool_()))
            last = names[-1] if names else last


def _full_sets(names: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, members) of stored names: their sets, made again from whole texts; no other text is shuffled.

    The rows of a name have one key and lie in one partition, where all but one are left out. A join that Spark splits may
    leave a name twice, which gives no other links.
    """
    ship(names.sparkSession)
    needed = materialised(_held(sets.select("name", "key"), names, "name").join(names, "name"), "near-keys")
    asked = needed.join(_held(texts, needed, "key"), "key").select("name", "text")
    return asked.sortWithinPartitions("name").mapInArrow(_sets_of, "name binary, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough.

    ``sets`` names one text (key) per set and ``texts`` has (key, text). Only sets that are in a
    pair are made again, from their whole texts.
    """
    asked = materialised(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "near-names")
    full = materialised(_full_sets(asked, sets, texts), "near-sets")
    both = pairs.join(full.select(F.col("name").alias("a"), F.col("members").alias("set_a")), "a")
    both = both.join(full.select(F.col("name").alias("b"), F.col("members").alias("set_b")), "b")
    return map_batches(both.select("a", "b", "set_a", "set_b"), _overlap, "a binary, b binary")


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable over undirected edges (a, b).

    Large and small stars alternate until nothing changes; each round is written to the shared
    folder. The number of rounds follows the logarithm of the component size.
    """
    e = materialised(edges.select("a", "b").where("a <> b").distinct(), "near-edges")
    before = _fingerprint(e)
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("x"), F.col("a").alias("y"))
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x").select(F.col("m").alias("a"), F.explode(F.array("x", "y")).alias("b")).where("a <> b").distinct()
        e = materialised(small, "near-edges")
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, plus ``class_key`` naming its class."""
    chosen = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = materialised(signatures(chosen), "near-signatures")
    sets = signed.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("doc_id").alias("key"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("size"))
    sets = materialised(sets, "near-sets")
    texts = chosen.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), as_bytes(F.col("text")).alias("text"))
    roots = components(links(sets, texts))
    named = signed.select("doc_id", "n_shingles", "name")
    classes = named.join(roots, named["name"] == roots["node"], "left").withColumn("class_key", F.coalesce("root", "name"))
    smallest = classes.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min("doc_id").alias("component_id"))
    out = classes.select("doc_id", "n_shingles", "class_key").join(smallest, "class_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_key")
