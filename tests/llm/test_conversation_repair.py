import hashlib
import heapq
import random
import zlib

import pytest

from stopfield.llm import conversation_repair as repair
from stopfield.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def after_damage(rows):
    """(conv, turn, role, text) after the planted damage, nulls as one space."""
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        g = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if g == 1 else "".join(ch for ch in x if ch not in ".!?") if g == 2 else x
        out += [(c, t, "user" if g == 4 else r, x)] * (0 if g == 0 else 2 if g == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, r, x in rows:
        body = x.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, faults):
    """Uniform-cost search over (cost, audit): the first end taken from the queue is the cheapest of the least audit."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, made = heapq.heappop(queue)
        if (i, state, audit) in done:
            continue
        done.add((i, state, audit))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        if len(audit) > 3 * len(rows) + 3:
            continue
        n = NEXT[state]
        heapq.heappush(queue, (cost + 3, audit + "I", i, n, made + ((NAMES[n], ""),)))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if r[:1] == n or (r[:1] == "s" and not state):
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, r[:1], made + ((r, x),)))
                heapq.heappush(queue, (cost + 3 + extra, audit + "R", i + 1, n, made + ((NAMES[n], x),)))
    raise AssertionError


def least_by_tables(rows, faults):
    """The same from the end, with whole audits as table entries: fit for longer conversations."""
    best = {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for (_, r, _), kind in zip(reversed(rows), reversed(faults)):
        base = {}
        for q in NEXT:
            options = [(best[q][0] + 4, "D" + best[q][1])]
            if kind not in ("blank", "duplicate"):
                extra = 3 if kind == "truncated" else 0
                options.append((best[NEXT[q]][0] + 3 + extra, "R" + best[NEXT[q]][1]))
                if r[:1] == NEXT[q] or (r[:1] == "s" and not q):
                    options.append((best[r[:1]][0] + extra, "K" + best[r[:1]][1]))
            base[q] = min(options)
        for _ in range(3):
            base = {q: min(base[q], (base[NEXT[q]][0] + 3, "I" + base[NEXT[q]][1])) for q in NEXT}
        best = base
    return best[""]


def made_by(rows, audit):
    out, state, i = [], "", 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        if letter == "R":
            state = NEXT[state]
            out.append((NAMES[state], rows[i][2]))
        elif letter == "K":
            state = rows[i][1][:1]
            out.append(rows[i][1:])
        i += 1
    return out


def wanted(original, search):
    convs, out = {}, {}
    for c, t, r, x in after_damage(original):
        convs.setdefault(c, []).append((t, r, x))
    for c in {r[0] for r in original}:
        rows = sorted(convs.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, turns = faults_of(rows), [t for t, _, _ in rows if t is not None]
        if search:
            cost, audit, made = cheapest(rows, faults)
        else:
            cost, audit = least_by_tables(rows, faults)
            made = made_by(rows, audit)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def report(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.repair_report(repair.damaged(frame), frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    collected = got.collect()
    assert len(collected) == len({r.conv_id for r in collected})
    return {r.conv_id: tuple(r)[1:] for r in collected}


def random_rows(n, most, seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", None]
    rows = []
    for c in range(n):
        size = rng.randint(1, most)
        rows += [(c, i + rng.choice([0, 0, 0, 3]), rng.choice(roles), rng.choice([f"Text {c} {i}.", f"open {i}", rng.choice(texts), None])) for i in range(size)]
    return rows


def test_random_conversations_against_search(spark):
    rows = random_rows(250, 5)
    want = wanted(rows, True)
    assert report(spark, rows) == want == wanted(rows, False)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert got == wanted(rows, False)


@pytest.mark.parametrize("block", [1, 7])
def test_conversations_of_many_blocks(spark, monkeypatch, block):
    rows = random_rows(6, 60, 5) + [(99, i // 3, "user" if i % 5 else "assistant", "Same." if i % 2 else f"No {i}") for i in range(150)]
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    assert report(spark, rows) == wanted(rows, False)


def test_blocks_across_partitions(spark):
    frame = spark.createDataFrame([(1, i, "ua"[i % 2].replace("u", "user"), f"Row {i}.") for i in range(600)], "conv_id long, turn long, role string, text string")
    blocks = repair.blocks_of(frame).collect()
    assert len(blocks) > 1 and sum(len(b.roles) for b in blocks) == 600
    whole = repair.repairs(frame).collect()
    joined = "".join(r.audit for r in sorted(whole, key=lambda r: (r.part, r.seq)))
    rows = [(i, "ua"[i % 2].replace("u", "user"), f"Row {i}.") for i in range(600)]
    assert joined == least_by_tables(rows, faults_of(rows))[1]
    assert [r.cost for r in whole if r.head] == [least_by_tables(rows, faults_of(rows))[0]]


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hello."), (None, 3, "user", "Hello."), (1, None, "user", "Hi."), (1, None, "user", "Hi."),
        (2, 5, "", "Empty role."), (3, 0, "system", "Only."), (4, 0, "assistant", "x" * 300_000 + "."), (4, 1, "user", "y" * 300_000), (5, 7, "user", "\x0b\x0c"),
    ]
    assert report(spark, rows) == wanted(rows, False)
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, c int, part int, audit int")
    assert repair.repair_report(repair.damaged(frame), frame).count() == 6
    empty = frame.limit(0)
    assert repair.repair_report(repair.damaged(empty), empty).collect() == []


def test_hot_rows_are_counted_first(spark):
    rows = [(1, 1, "user", "Again.")] * 9000 + [(1, 2, "assistant", "Good.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = repair.repair_report(frame, frame).first()
    assert row.audit == "K" + "D" * 8999 + "K" and row.cost == 4 * 8999 and row.duplicate == 8999
