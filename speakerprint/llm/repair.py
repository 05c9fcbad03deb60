"""Repair of conversation structure by an auction algorithm for shortest paths.

A conversation's rows span a lattice: a node is (rows read, state), the states being those of the role pattern
``(s?(ua)+)?`` over role initials, and an arc is one edit with its integer cost. Node prices start as what the rows
still to be read cost at least, which no arc undercuts. From the origin a path grows along an arc whose cost equals the fall of
price; where there is none, the price of the path's end rises to the least cost plus price among its arcs and
the path shrinks by one arc. When the sink is reached, prices are dual optimal: the shortest paths are exactly the paths
of tight arcs, and the one with the ASCII-least edits is traced along them.

Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4, the only one of blank and duplicate rows); rows
that end without ``. ! ?`` and are not deleted cost 3 more. Insert adds an empty user or assistant text (3) anywhere. The
state before an edit fixes the role it gives, so that edits' initials name one repaired conversation.

Conversations of up to ``BLOCK`` rows are repaired as one lattice. Longer ones are cut into blocks by position: each
block's auctions give the least costs between its entry and exit states, one backward and one forward walk over
those (one row per block, no texts) settle the states between blocks, and each block is traced with the prices of
its end. Duplicates are then found by the first position of each (role, text), so that no task holds a conversation.
Only the final hash, which is sequential by nature, streams a conversation through one task.

Defined cases. Nulls count as one space in keys, roles and texts; a null conv_id is a conversation of its own and null turns
come first; equal turns are ordered by role and text. Repeated rows are duplicates like any other. A conversation
whose rows are all dropped has zeros, empty edits and the hash of an empty string. An empty table gives no rows. Texts
of any length are taken whole. Other columns of the input do not reach the result, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import materialised, ship
from speakerprint.operators.scale import ranked

# Costs of edits, and what a row's own fault is called.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: Rows of a lattice. Roles and texts of a block are held by one task.
BLOCK = 512
#: States: nothing yet, after a leading s, after u, after a.
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one role that an inserted or reroled row can have in a state.
_GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: What ends a conversation properly.
ENDS = (0, None, None, 0)


def _drawn(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, draw): rows with nulls of role and text filled in, and what is to befall them."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), (F.crc32(name.cast("binary")) % 20).alias("draw"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    )


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy) with faults planted by crc32 of ``conv:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``. ! ?``, 3 repeats it with the same turn, 4 makes its role user.
    """
    emptied = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role_now = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = _drawn(conversations, conv, turn, role, text).where("draw <> 0")
    return rows.select("conv", "turn", role_now.alias("role"), emptied.alias("text"), F.explode(copies).alias("copy"))


def _facts(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, rows, gaps) of every conversation: its rows after damage, and the turns missing between them."""
    left = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1)
    turns = _drawn(conversations, conv, turn, role, text).groupBy("conv", "turn").agg(F.sum(left).alias("n"))
    there = F.when(F.col("n") > 0, F.col("turn").cast("decimal(20,0)"))
    gaps = F.least(F.coalesce(F.max(there) - F.min(there) + 1 - F.count(there), F.lit(0)), F.lit((1 << 63) - 1)).cast("bigint")
    return turns.groupBy("conv").agg(F.sum("n").alias("rows"), gaps.alias("gaps"))


_SPACE = " \t\n\x0b\x0c\r"


def own_fault(text: str) -> int:
    """Fault of a text by itself."""
    last = text.rstrip(_SPACE)
    return BLANK if not last else FINE if last[-1] in ".!?" else TRUNCATED


def legal(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


def arcs_of(roles: list[str], faults: list[int], exits: tuple[int | None, ...]) -> list[list[tuple[int, int, str]]]:
    """Arcs (cost, node, edit) of every node ``STATES * rows read + state``; the last node is the sink.

    ``exits`` holds the price of leaving in each state, None where that is not possible. Arcs to nodes that
    cannot reach the sink are left out.
    """
    n = len(roles)
    sink = STATES * (n + 1)
    arcs: list[list[tuple[int, int, str]]] = [[] for _ in range(sink + 1)]
    useful = [False] * sink + [True]
    for at in range(n, -1, -1):
        here = STATES * at
        for state in (ASSISTANT, USER, SYSTEM, START):
            out = arcs[here + state]
            if at == n:
                if exits[state] is not None:
                    out.append((exits[state], sink, ""))
            else:
                fault, initial, then = faults[at], roles[at][:1], here + STATES
                out.append((DELETE, then + state, "D"))
                if fault in (FINE, TRUNCATED):
                    more = CUT if fault == TRUNCATED else 0
                    kept = _NEXT.get((state, initial))
                    if kept is not None:
                        out.append((more, then + kept, "K"))
                    out.append((REROLE + more, then + _NEXT[state, _GIVEN[state][0]], "R"))
            out.append((INSERT, here + _NEXT[state, _GIVEN[state][0]], "I"))
        # Inserts stay among the states of a column: any that reaches a useful one is useful too.
        for _ in range(STATES):
            for state in range(STATES):
                useful[here + state] |= any(useful[j] for _, j, _ in arcs[here + state])
        for state in range(STATES):
            arcs[here + state] = [a for a in arcs[here + state] if useful[a[1]]]
    return arcs


def first_prices(faults: list[int], exits: tuple[int | None, ...]) -> list[int]:
    """Prices that no arc undercuts: what the rows still to be read and the end cost at least."""
    price = min(e for e in exits if e is not None)
    column = [price]
    for fault in reversed(faults):
        price += DELETE if fault in (BLANK, DUPLICATE) else CUT if fault == TRUNCATED else 0
        column.append(price)
    return [p for p in reversed(column) for _ in range(STATES)] + [0]


def auction(arcs: list[list[tuple[int, int, str]]], prices: list[int], origin: int) -> int | None:
    """Length of the shortest path from ``origin`` to the last node; ``prices`` become dual optimal for it.

    None where no path leads there. Every cycle of a lattice costs something, so that paths stay simple.
    """
    if not arcs[origin]:
        return None
    sink = len(arcs) - 1
    path = [origin]
    while path[-1] != sink:
        i = path[-1]
        least, to = None, None
        for cost, j, _ in arcs[i]:
            if least is None or cost + prices[j] < least:
                least, to = cost + prices[j], j
        if prices[i] < least:
            prices[i] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[origin] - prices[sink]


def tight_path(arcs: list[list[tuple[int, int, str]]], prices: list[int], origin: int) -> list[tuple[int, str]]:
    """(node, edit) along the path of tight arcs whose edits are ASCII-least."""
    sink = len(arcs) - 1
    dead = set()
    nodes, edits = [origin], []
    while nodes[-1] != sink:
        i = nodes[-1]
        open_arcs = [(e, j) for cost, j, e in arcs[i] if j not in dead and prices[i] == cost + prices[j]]
        if open_arcs:
            edit, j = min(open_arcs)
            nodes.append(j)
            edits.append((i, edit))
        else:
            dead.add(nodes.pop())
            edits.pop()
    return edits


def applied(edits: list[tuple[int, str]], roles: list[str], texts: list[str]) -> tuple[str, list[str], int]:
    """Initials of the edits, repaired ``role:text`` lines, and the state at the end."""
    audit, lines, state = [], [], START
    for node, edit in edits:
        at, state = divmod(node, STATES)
        if not edit:
            break
        audit.append(edit)
        if edit == "K":
            lines.append(f"{roles[at]}:{texts[at]}")
        elif edit == "R":
            lines.append(f"{_GIVEN[state]}:{texts[at]}")
        elif edit == "I":
            lines.append(f"{_GIVEN[state]}:")
    return "".join(audit), lines, state


def repaired(roles: list[str], texts: list[str], faults: list[int], exits: tuple[int | None, ...] = ENDS, entry: int = START) -> tuple[int, str, list[str], int] | None:
    """(cost, edits, repaired lines, exit state) of rows entered in a state; None where no edits lead out."""
    arcs = arcs_of(roles, faults, exits)
    prices = first_prices(faults, exits)
    cost = auction(arcs, prices, entry)
    if cost is None:
        return None
    return (cost, *applied(tight_path(arcs, prices, entry), roles, texts))


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key values, columns) of every run of rows with equal keys, across batches."""
    current, held = None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i in range(batch.num_rows):
            k = tuple(columns[n][i] for n in key)
            if k != current or held is None:
                if held is not None:
                    yield current, held
                current, held = k, {n: [] for n in columns if n not in key}
            for n, v in held.items():
                v.append(columns[n][i])
    if held is not None:
        yield current, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _schema(text: str, df: DataFrame) -> tuple[str, pa.Schema]:
    """A DDL schema, with the type of ``conv`` filled in, in Spark's and in Arrow's terms."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = text.replace("{conv}", df.schema["conv"].dataType.simpleString())
    return ddl, to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _together(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions(*key, *order)


def _duplicates_in(roles: list[str], texts: list[str]) -> list[int]:
    seen, faults = set(), []
    for what in zip(roles, texts):
        fault = own_fault(what[1])
        if fault != BLANK and what in seen:
            fault = DUPLICATE
        seen.add(what)
        faults.append(fault)
    return faults


def _short(rows: DataFrame) -> DataFrame:
    """Results of conversations of up to ``BLOCK`` rows, each of which one task holds."""
    ddl, schema = _schema("conv {conv}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (conv,), c in _runs(batches, ["conv"]):
                roles, texts = c["role"], c["text"]
                faults = _duplicates_in(roles, texts)
                cost, audit, lines, _ = repaired(roles, texts, faults)
                illegal = sum(not legal(a, b) for a, b in zip(roles, roles[1:]))
                digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
                yield (conv, *[faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)], illegal, cost, audit, digest)

        yield from _batches(each(), schema)

    return _together(rows.select("conv", "turn", "role", "text", "copy"), ["conv"], ["turn", "role", "text", "copy"]).mapInArrow(run, ddl)


def _with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, pos, block, role, text) of long conversations with ``fault``: duplicates by the first position of each (role, text)."""
    what = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256)
    named = rows.withColumn("what", what)
    first = named.groupBy("conv", "what").agg(F.min("pos").alias("first"))
    joined = named.join(first.withColumnRenamed("conv", "conv_"), F.col("conv").eqNullSafe(F.col("conv_")) & (named["what"] == first["what"]))
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE)
    fault = fault.when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    return joined.select("conv", "pos", "block", "role", "text", fault.alias("fault"))


def _block_costs(rows: DataFrame) -> DataFrame:
    """(conv, block, costs): least costs from each entry state to each exit state of a block, -1 where there is none."""
    ddl, schema = _schema("conv {conv}, block bigint, costs array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (conv, block), c in _runs(batches, ["conv", "block"]):
                costs = [-1] * STATES * STATES
                for out in range(STATES):
                    exits = tuple(0 if s == out else None for s in range(STATES))
                    arcs, prices = arcs_of(c["role"], c["fault"], exits), first_prices(c["fault"], exits)
                    for entry in range(STATES):
                        cost = auction(arcs, prices, entry)
                        costs[STATES * entry + out] = -1 if cost is None else cost
                counts = [c["fault"].count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
                illegal = sum(not legal(a, b) for a, b in zip(c["role"], c["role"][1:]))
                yield (conv, block, costs, *counts, illegal, c["role"][0][:1], c["role"][-1][:1])

        yield from _batches(each(), schema)

    return _together(rows.select("conv", "block", "pos", "role", "fault"), ["conv", "block"], ["pos"]).mapInArrow(run, ddl)


def _settled(costs: DataFrame) -> DataFrame:
    """(conv, block, exits, ...): for every block the least cost of all that follows it, by exit state.

    Blocks of a conversation are walked from the last to the first, one row each; nothing but four numbers is held.
    """
    ddl, schema = _schema("conv {conv}, block bigint, exits array<bigint>, cost bigint", costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            current, ahead = None, None
            for batch in batches:
                for conv, back, costs in zip(*[batch.column(n).to_pylist() for n in ("conv", "back", "costs")]):
                    if ahead is None or conv != current:
                        current, ahead = conv, list(ENDS)
                    before = []
                    for entry in range(STATES):
                        ways = [c + a for c, a in zip(costs[STATES * entry : STATES * entry + STATES], ahead) if c >= 0 and a is not None]
                        before.append(min(ways, default=None))
                    yield conv, -back, [-1 if a is None else a for a in ahead], before[START]
                    ahead = before

        yield from _batches(each(), schema)

    rows = costs.select("conv", (-F.col("block")).alias("back"), "costs")
    return _together(rows, ["conv"], ["back"]).mapInArrow(run, ddl)


def _traced(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """(conv, block, entry, out, audit, lines): each block's edits for every state it may be entered in."""
    ddl, schema = _schema("conv {conv}, block bigint, entry int, out int, audit string, lines array<string>", rows)
    side = settled.select(F.col("conv").alias("conv_"), F.col("block").alias("block_"), "exits")
    joined = rows.join(side, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))).drop("conv_", "block_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (conv, block), c in _runs(batches, ["conv", "block"]):
                exits = tuple(None if e < 0 else e for e in c["exits"][0])
                for entry in range(STATES):
                    found = repaired(c["role"], c["text"], c["fault"], exits, entry)
                    if found is not None:
                        yield conv, block, entry, found[3], found[1], found[2]

        yield from _batches(each(), schema, 16)

    return _together(joined.select("conv", "block", "pos", "role", "text", "fault", "exits"), ["conv", "block"], ["pos"]).mapInArrow(run, ddl)


def _joined(traced: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): blocks walked in order from the start state; one block is held at a time."""
    ddl, schema = _schema("conv {conv}, audit string, repaired_sha256 string", traced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            current, state, block, audit, digest, some = None, None, None, None, None, False
            for batch in batches:
                for conv, b, entry, out, edits, lines in zip(*[batch.column(n).to_pylist() for n in ("conv", "block", "entry", "out", "audit", "lines")]):
                    if audit is None or conv != current:
                        if audit is not None:
                            yield current, "".join(audit), digest.hexdigest()
                        current, state, block, audit, digest, some = conv, START, None, [], hashlib.sha256(), False
                    if b == block or entry != state:
                        continue
                    block, state = b, out
                    audit.append(edits)
                    for line in lines:
                        digest.update((b"\n" if some else b"") + line.encode())
                        some = True
            if audit is not None:
                yield current, "".join(audit), digest.hexdigest()

        yield from _batches(each(), schema, 16)

    return _together(traced, ["conv"], ["block", "entry"]).mapInArrow(run, ddl)


def _long(rows: DataFrame) -> DataFrame:
    """The same results as :func:`_short`, for conversations of any length."""
    placed = ranked(rows, ["conv"], ["turn", "role", "text", "copy"], pos="pos", total=None, block_rows=BLOCK)
    placed = placed.withColumn("block", F.expr(f"pos div {BLOCK}"))
    rows = materialised(_with_faults(placed), "repair-rows")
    costs = materialised(_block_costs(rows), "repair-costs")
    settled = materialised(_settled(costs), "repair-prices")
    texts = _joined(materialised(_traced(rows, settled), "repair-edits"))
    ends = costs.select(F.col("conv").alias("c1"), (F.col("block") + 1).alias("b1"), "last")
    seams = costs.select("conv", "block", "first").join(ends, F.col("conv").eqNullSafe(F.col("c1")) & (F.col("block") == F.col("b1")))
    broken = ~F.concat("last", "first").isin("su", "ua", "au")
    parts = costs.select("conv", "blank", "duplicate", "truncated", "illegal", F.lit(None).cast("bigint").alias("cost"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")]
    parts = parts.unionByName(seams.select("conv", *none, broken.cast("bigint").alias("illegal"), F.lit(None).cast("bigint").alias("cost")))
    parts = parts.unionByName(settled.where("block = 0").select("conv", *none, F.lit(0).cast("bigint").alias("illegal"), "cost"))
    sums = parts.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.max("cost").alias("cost"))
    texts = texts.withColumnRenamed("conv", "c2")
    return sums.join(texts, F.col("conv").eqNullSafe(F.col("c2"))).drop("c2")


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, after damage."""
    ship(conversations.sparkSession)
    rows = damaged(conversations, conv, turn, role, text)
    facts = materialised(_facts(conversations, conv, turn, role, text), "repair-facts")
    long_ones = facts.where(F.col("rows") > BLOCK).select(F.col("conv").alias("c0"))
    if long_ones.isEmpty():
        out = _short(rows)
    else:
        same = F.col("conv").eqNullSafe(F.col("c0"))
        out = _short(rows.join(long_ones, same, "left_anti")).unionByName(_long(rows.join(long_ones, same, "left_semi")))
    out = out.withColumnRenamed("conv", "c4")
    full = facts.join(out, F.col("conv").eqNullSafe(F.col("c4")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select(F.col("conv").alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
