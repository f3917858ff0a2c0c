"""Conversation structure repair: the cheapest edits that make roles alternate, and of equally cheap ones the least audit.

Rows of a conversation, by turn, are kept (0), given the role user or assistant (3) or deleted (4; blank and duplicate rows must be), and empty rows
of either role are inserted anywhere (3), so that the initials of the roles read ``(s?(ua)+)?``. A truncated row that stays adds 3. The audit has the
initials of the edits in order; of all cheapest edits the one of the ASCII-least audit is taken.

A cost dynamic programme from the end over (row, state of the pattern) leaves the optimal arcs. These are ranked by prefix doubling: the rank of the
first letter, then of the first 2, 4, 8, ... letters of the least audit that begins with the arc, each from the ranks of the half before and the
pointer over it; the ranks choose an arc and the doubled pointers read the path. A letter and a state determine the next state, so arcs of one
node differ in their letter.

A conversation may be any part of the table. Equal rows are counted before anything else; rows are put in one global order by a range shuffle and cut
into blocks of at most ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` of text; only conversations of several blocks meet by conversation, with a 4 x 4 table of
costs and four end states for each block and no text (about 200 bytes a block). ``repairs`` returns blocks; only the digest of the report needs a
conversation's whole text in one value, as a digest of one string does.

Defined cases: a null role or text is one space; rows of equal turn are ordered by role and text, null turns come first; rows equal in all are one
row and its duplicates; a role that is empty or begins with another letter cannot be kept; a null conv_id is a conversation; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import landed, shuffle_width

REROLE, DELETE, INSERT, TRUNCATED_STAYS = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
"""States: what the rows so far end with."""
EXPECTED = (USER, USER, ASSISTANT, USER)
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)
"""Cost of ending in each state: what is missing is inserted."""
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
SMALL, TOGETHER = 64, 512
_FAR = 1 << 60


def fault(text: str) -> int:
    body = text.strip(WHITE)
    return BLANK if not body else SOUND if body[-1] in ".!?" else TRUNCATED


def _kept(state: int, role: str) -> int | None:
    """The state after keeping a row of this role, or None."""
    initial = role[:1]
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u" or initial == "a":
        target = USER if initial == "u" else ASSISTANT
        return target if EXPECTED[state] == target else None
    return None


def costs(roles: list[str], faults: list[int], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each row and the end: the least cost of the rest from each state."""
    after, out = tuple(end), [tuple(end)]
    for role, kind in zip(reversed(roles), reversed(faults)):
        base = [x + DELETE for x in after]
        if kind in (SOUND, TRUNCATED):
            extra = TRUNCATED_STAYS if kind == TRUNCATED else 0
            for q in range(4):
                kept = _kept(q, role)
                base[q] = min(base[q], after[EXPECTED[q]] + REROLE + extra, _FAR if kept is None else after[kept] + extra)
        user, assistant = min(base[USER], base[ASSISTANT] + INSERT), min(base[ASSISTANT], base[USER] + INSERT)
        after = (min(base[START], user + INSERT), min(base[SYSTEM], user + INSERT), user, assistant)
        out.append(after)
    return out[::-1]


_LETTERS = "\0DIKR"


def _arcs(roles: list[str], faults: list[int], cost: list[tuple[int, ...]]) -> list[tuple[int, int, int]]:
    """(node, letter, next node) of the optimal arcs, by node and letter; nodes are 4 x row + state, and the ends loop with letter 0."""
    arcs = []
    for i, (role, kind) in enumerate(zip(roles, faults)):
        here, after, base = cost[i], cost[i + 1], 4 * i
        stays = kind in (SOUND, TRUNCATED)
        extra = TRUNCATED_STAYS if kind == TRUNCATED else 0
        for q in range(4):
            target, rest = EXPECTED[q], here[q]
            if after[q] + DELETE == rest:
                arcs.append((base + q, 1, base + 4 + q))
            if here[target] + INSERT == rest:
                arcs.append((base + q, 2, base + target))
            if stays:
                kept = _kept(q, role)
                if kept is not None and after[kept] + extra == rest:
                    arcs.append((base + q, 3, base + 4 + kept))
                if after[target] + REROLE + extra == rest:
                    arcs.append((base + q, 4, base + 4 + target))
    arcs += [(4 * len(roles) + q, 0, 4 * len(roles) + q) for q in range(4)]
    return arcs


def least_paths(arcs: np.ndarray, starts: np.ndarray, nodes: int, longest: int) -> np.ndarray:
    """The arcs (tail, letter, head; by tail and letter, every node has one, ends loop with letter 0) of the least path from each node of ``starts``,
    as rows of arc numbers; ``longest`` bounds the length of a path."""
    tail, letter, head = arcs[:, 0], arcs[:, 1], arcs[:, 2]
    first = np.searchsorted(tail, np.arange(nodes))
    rank, jump = letter, first[head]
    jumps = [jump]
    while 1 << (len(jumps) - 1) < longest:
        _, rank = np.unique(rank * (len(rank) + 5) + rank[jump], return_inverse=True)
        jump = jump[jump]
        jumps.append(jump)
    order = np.lexsort((rank, tail))
    path = order[np.searchsorted(tail[order], starts)][:, None]
    for over in jumps:
        path = np.concatenate([path, over[path]], axis=1)
    return path


def audits(blocks: list[tuple[list[str], list[int], tuple[int, ...], list[int]]]) -> list[list[tuple[str, int, int]]]:
    """Per block (roles, faults, end costs, entry states) and entry state: the least audit of its rows, the state it leaves and the cost of the rest."""
    arcs, starts, costs_at, offset, longest = [], [], [], 0, 1
    for roles, faults, end, entries in blocks:
        cost = costs(roles, faults, end)
        arcs += [(offset + t, c, offset + h) for t, c, h in _arcs(roles, faults, cost)]
        starts += [offset + q for q in entries]
        costs_at += [cost[0][q] for q in entries]
        offset += 4 * (len(roles) + 1)
        longest = max(longest, 3 * len(roles) + 1)
    table = np.array(arcs, np.int64)
    paths = least_paths(table, np.array(starts), offset, longest)
    letters, heads = table[paths, 1].astype(np.uint8), table[paths[:, -1], 2]
    text = [np.frombuffer(_LETTERS.encode(), np.uint8)[row[row > 0]].tobytes().decode() for row in letters]
    found = iter(zip(text, (heads % 4).tolist(), costs_at))
    return [[next(found) for _ in entries] for *_, entries in blocks]


def applied(roles: list[str], texts: list[str | None], audit: str, state: int) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of ``audit``, from ``state``; letters behind the last row are insertions."""
    out_roles, out_texts, i = [], [], 0
    for letter in audit:
        if letter == "I":
            state = EXPECTED[state]
            out_roles.append(ROLE_NAMES[state])
            out_texts.append("")
            continue
        if letter != "D":
            state = EXPECTED[state] if letter == "R" else _kept(state, roles[i])
            out_roles.append(ROLE_NAMES[state] if letter == "R" else roles[i])
            out_texts.append(texts[i])
        i += 1
    return out_roles, out_texts


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, least_turn long, first_role string, last_role string"
_MARKS = [c.split()[0] for c in _COUNTS.split(", ")]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come in order (c, t, r, x, n, later, part): one row each, with roles, faults, texts (none for rows that must go) and counts."""
    state: dict = {"c": None, "seq": 0, "roles": [], "faults": [], "texts": [], "turns": [], "bytes": 0}
    out: list[dict] = []

    def close() -> None:
        roles, faults, turns = state["roles"], state["faults"], state["turns"]
        if roles:
            known = [t for t in turns if t is not None]
            initials = [r[:1] for r in roles]
            out.append(
                {"c": state["c"], "part": state["part"], "seq": state["seq"], "roles": roles, "faults": faults, "texts": state["texts"],
                 "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                 "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "turns": len(set(known)), "first_turn": turns[0],
                 "last_turn": turns[-1], "least_turn": known[0] if known else None, "first_role": initials[0], "last_role": initials[-1]}
            )
            state.update(seq=state["seq"] + 1, roles=[], faults=[], texts=[], turns=[], bytes=0)

    schema = None
    for batch in batches:
        if schema is None:
            fields = [pa.field("c", batch.schema.field("c").type), pa.field("part", pa.int32()), pa.field("seq", pa.int64())]
            lists = [pa.field("roles", pa.list_(pa.string())), pa.field("faults", pa.list_(pa.int32())), pa.field("texts", pa.list_(pa.string()))]
            schema = pa.schema(fields + lists + [pa.field(m, pa.string() if m.endswith("role") else pa.int64()) for m in _MARKS])
        columns = [batch.column(k).to_pylist() for k in ("c", "t", "r", "x", "n", "later", "part")]
        for c, t, r, x, n, later, part in zip(*columns):
            if c != state["c"]:
                close()
                state["c"] = c
            state["part"] = part
            kind = fault(x)
            for again in range(n):
                mark = BLANK if kind == BLANK else DUPLICATE if later or again else kind
                state["roles"].append(r)
                state["faults"].append(mark)
                state["texts"].append(x if mark in (SOUND, TRUNCATED) else None)
                state["turns"].append(t)
                state["bytes"] += 16 + len(r) + (len(x) if mark in (SOUND, TRUNCATED) else 0)
                if len(state["roles"]) >= BLOCK_ROWS or state["bytes"] >= BLOCK_BYTES:
                    close()
            if len(out) >= 2 * TOGETHER or sum(len(b["texts"]) for b in out[-1:]) >= BLOCK_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def blocks_of(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) as blocks in the order of conversation and turn; ``part`` and ``seq`` number a conversation's blocks."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["conv_id"]
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"), one("role").alias("r"), one("text").alias("x"))
    counted = named.groupBy("c", "t", "r", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.md5("x"))
    first = counted.groupBy("c", "r", "k").agg(F.min(F.struct("t")).alias("f")).select(F.col("c").alias("fc"), F.col("r").alias("fr"), F.col("k").alias("fk"), F.col("f.t").alias("ft"))
    same = F.col("c").eqNullSafe(F.col("fc")) & (F.col("r") == F.col("fr")) & (F.col("k") == F.col("fk"))
    marked = counted.join(first, same).select("c", "t", "r", "k", "x", "n", (~F.col("t").eqNullSafe(F.col("ft"))).alias("later"))
    ordered = marked.repartitionByRange(shuffle_width(spark), "c", "t", "r", "k").sortWithinPartitions("c", "t", "r", "x")
    schema = f"c {kind}, part int, seq long, roles array<string>, faults array<int>, texts array<string>, {_COUNTS}"
    return ordered.select("c", "t", "r", "x", "n", "later", F.spark_partition_id().alias("part")).mapInArrow(_cut, schema)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 4 x 4 costs from each state before a block to each state behind it."""
    for batch in batches:
        ends = [tuple(0 if i == q else _FAR for i in range(4)) for q in range(4)]
        tables = [[x for end in ends for x in costs(r, f, end)[0]] for r, f in zip(batch.column("roles").to_pylist(), batch.column("faults").to_pylist())]
        keep = [i for i, name in enumerate(batch.schema.names) if name not in ("roles", "faults")]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(tables, pa.list_(pa.int64()))], [*[batch.schema.names[i] for i in keep], "costs"])


def _ends(table: pa.Table) -> pa.Table:
    """For each block of one conversation: the costs of what follows, whether it is the first and the last, and what counts change at its border."""
    rows = table.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    end, out = END, []
    for i in range(len(rows) - 1, -1, -1):
        row, ahead = rows[i], rows[i - 1] if i else None
        border = ahead is not None and ahead["last_role"] + row["first_role"] not in ("su", "ua", "au")
        same = ahead is not None and row["first_turn"] is not None and row["first_turn"] == ahead["last_turn"]
        out.append({"ep": row["part"], "es": row["seq"], "end": list(end), "head": i == 0, "tail": i == len(rows) - 1, "border": int(border), "same": int(same)})
        end = tuple(min(row["costs"][4 * to + q] + end[to] for to in range(4)) for q in range(4))
    return pa.Table.from_pylist(out, pa.schema([("ep", pa.int32()), ("es", pa.int64()), ("end", pa.list_(pa.int64())), ("head", pa.bool_()), ("tail", pa.bool_()), ("border", pa.int64()), ("same", pa.int64())]))


def _entries(table: pa.Table) -> pa.Table:
    """The state in which each block of one conversation is entered."""
    rows = table.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    state, out = START, []
    for row in rows:
        out.append({"np": row["part"], "ns": row["seq"], "entry": state})
        state = row["exits"][0 if len(row["exits"]) == 1 else state]
    return pa.Table.from_pylist(out, pa.schema([("np", pa.int32()), ("ns", pa.int64()), ("entry", pa.int32())]))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``audits``, ``exits`` and ``costs`` of every block for the states it may be entered in (only the start for the first)."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("roles", "faults", "end", "head", "tail")]
        blocks = [(r, f, tuple(e), [START] if h else [0, 1, 2, 3]) for r, f, e, h, _ in zip(*columns)]
        small = [i for i, b in enumerate(blocks) if len(b[0]) <= SMALL]
        groups = [small[i : i + TOGETHER] for i in range(0, len(small), TOGETHER)] + [[i] for i, b in enumerate(blocks) if len(b[0]) > SMALL]
        found: list = [None] * len(blocks)
        for group in groups:
            for i, each in zip(group, audits([blocks[i] for i in group])):
                found[i] = [(a + "I" * (END[q] // INSERT) if columns[4][i] else a, q, c) for a, q, c in each]
        new = [pa.array([[x[k] for x in f] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "audits", "exits", "costs"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {k: batch.column(k).to_pylist() for k in ("roles", "texts", "audits", "costs", "entry")}
        audit, cost, roles, texts = [], [], [], []
        for r, x, a, c, q in zip(*columns.values()):
            k = 0 if len(a) == 1 else q
            audit.append(a[k])
            cost.append(c[k])
            done = applied(r, x, a[k], q)
            roles.append(done[0])
            texts.append(done[1])
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
        keep = [i for i, name in enumerate(batch.schema.names) if name not in ("roles", "texts", "audits", "costs", "entry", "exits", "faults", "end")]
        new = [pa.array(v, t) for v, t in zip((audit, cost, roles, texts), kinds)]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *new], [*[batch.schema.names[i] for i in keep], "audit", "cost", "roles", "texts"])


def repairs(rows: DataFrame) -> DataFrame:
    """One row per block: c (the conv_id), part and seq (its order in the conversation), whether the conversation is that block alone, ``audit``, the
    roles and texts after repair, counts of faults and turns, and on the conversation's first block (``head``) the cost of the whole."""
    kind = dict(rows.dtypes)["conv_id"]
    blocks = landed(blocks_of(rows))
    several = blocks.groupBy("c").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select(F.col("c").alias("mc"))
    is_several = F.col("c").eqNullSafe(F.col("mc"))
    key = f"c {kind}, part int, seq long"
    marks = f"{_COUNTS}, head boolean, tail boolean, border long, same long"
    whole = f"{key}, roles array<string>, faults array<int>, texts array<string>, {marks}, end array<long>, audits array<string>, exits array<int>, costs array<long>"
    done = f"{key}, {marks}, audit string, cost long, roles array<string>, texts array<string>"
    names = ["c", "part", "seq", "roles", "faults", "texts", *_MARKS, "head", "tail", "border", "same", "end"]

    alone = blocks.join(several, is_several, "left_anti").select(
        "*", F.lit(True).alias("head"), F.lit(True).alias("tail"), F.lit(0).cast("long").alias("border"), F.lit(0).cast("long").alias("same"), F.array(*[F.lit(x).cast("long") for x in END]).alias("end")
    ).select(*names)
    whole_alone = alone.mapInArrow(_audited, whole).withColumn("entry", F.lit(START))

    parts = blocks.join(several, is_several).drop("mc")
    costed = parts.select("c", "part", "seq", "first_turn", "last_turn", "first_role", "last_role", "roles", "faults").mapInArrow(
        _tables, f"{key}, first_turn long, last_turn long, first_role string, last_role string, costs array<long>"
    )
    ends = costed.groupBy("c").applyInArrow(_ends, "ep int, es long, end array<long>, head boolean, tail boolean, border long, same long")
    at_end = parts.join(ends, (F.col("part") == F.col("ep")) & (F.col("seq") == F.col("es"))).select(*names)
    audited = landed(at_end.mapInArrow(_audited, whole))
    entered = audited.select("c", "part", "seq", "exits").groupBy("c").applyInArrow(_entries, "np int, ns long, entry int")
    whole_parts = audited.join(entered, (F.col("part") == F.col("np")) & (F.col("seq") == F.col("ns"))).drop("np", "ns")
    return whole_alone.union(whole_parts.select(*whole_alone.columns)).mapInArrow(_applied, done)


def _digest(roles: Column, texts: Column) -> Column:
    lines = F.zip_with(roles, texts, lambda r, x: F.concat(r, F.lit(":"), x))
    return F.sha2(F.array_join(lines, "\n"), 256)


def repair_report(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Per conv_id of ``originals``: gaps between turns, counts of faults, cost, audit and the digest of the repaired conversation of ``rows``."""
    found = repairs(rows)
    is_alone = F.col("head") & F.col("tail")
    gaps = lambda high, low, turns: F.coalesce(high - low + 1 - turns, F.lit(0)).cast("long")
    counts = ["blank", "duplicate", "truncated"]
    single = found.filter(is_alone).select(
        F.col("c").alias("of"), gaps(F.col("last_turn"), F.col("least_turn"), F.col("turns")).alias("gaps"), *counts, "illegal", "cost", "audit", _digest(F.col("roles"), F.col("texts")).alias("repaired_sha256")
    )
    parts = found.filter(~is_alone).groupBy("c").agg(
        gaps(F.max("last_turn"), F.min("least_turn"), F.sum(F.col("turns") - F.col("same"))).alias("gaps"),
        *[F.sum(c).alias(c) for c in counts],
        F.sum(F.col("illegal") + F.col("border")).alias("illegal"),
        F.max(F.when(F.col("head"), F.col("cost"))).alias("cost"),
        F.sort_array(F.collect_list(F.struct("part", "seq", "audit", "roles", "texts"))).alias("p"),
    )
    joined = parts.select(F.col("c").alias("of"), "gaps", *counts, "illegal", "cost", F.array_join("p.audit", "").alias("audit"), _digest(F.flatten("p.roles"), F.flatten("p.texts")).alias("repaired_sha256"))
    ids = originals.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.join(single.union(joined), F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", *counts, "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted damage by the digest of conversation and turn: dropped, emptied, without closing marks, repeated or of role user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    g = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(g == 1, F.lit("")).when(g == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    rows = conversations.filter(g != 0).select("conv_id", "turn", F.when(g == 4, F.lit("user")).otherwise(one("role")).alias("role"), text.alias("text"), F.when(g == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
