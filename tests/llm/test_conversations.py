"""Conversation repair: tables against all edit sequences, rows against a plain loop."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pairloom.llm import conversations as C
from pairloom.llm.turn_tables import NEXT, ROLE, TurnTables, repaired

PATTERN = re.compile(r"(s?(ua)+)?")


def all_edits(kinds, inserts=3):
    """The cheapest edits by trying all of them: kinds are (initial, must go, truncated)."""
    best = None
    options = []
    for initial, gone, truncated in kinds:
        own = [("D", 2, "")]
        if not gone:
            own += [("K", 5 * truncated, initial)] + [("R", 1 + 5 * truncated, to) for to in "ua"]
        options.append(own)
    gaps = [p for k in range(inserts + 1) for p in itertools.combinations_with_replacement(range(len(kinds) + 1), k)]
    for taken in itertools.product(*options):
        for where in gaps:
            for roles in itertools.product("ua", repeat=len(where)):
                letters, out, cost = "", "", 5 * len(where)
                for at in range(len(kinds) + 1):
                    for place, role in zip(where, roles):
                        if place == at:
                            letters, out = letters + "I", out + role
                    if at < len(kinds):
                        letter, price, role = taken[at]
                        letters, out, cost = letters + letter, out + role, cost + price
                if PATTERN.fullmatch(out) and (best is None or (cost, letters) < best):
                    best = (cost, letters)
    return best


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_tables_give_the_least_of_all_edits(length):
    tables, r = TurnTables(), random.Random(length)
    kinds = [("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("x", 0, 0), ("u", 1, 0), ("s", 0, 1), ("u", 0, 1), ("a", 0, 1), ("x", 0, 1)]
    cases = list(itertools.product(kinds, repeat=length))
    for case in cases if length < 3 else r.sample(cases, 60):
        assert run_tables(tables, case) == all_edits(case)


def run_tables(tables, case):
    symbols = bytes(0 if gone else 1 + 2 * ("sua".find(i) if i in "sua" else 3) + t for i, gone, t in case)
    letters, states, state = tables.trace(symbols)
    more, after = tables.closing(state)
    lines = list(repaired(letters + more, states + after, [({"s": "system", "u": "user", "a": "assistant"}.get(i, i), "t") for i, _, _ in case]))
    assert PATTERN.fullmatch("".join(x[0] for x in lines))
    return tables.back(symbols)[1], letters + more


def plain_edits(case):
    """The cheapest edits by a dynamic program over suffixes, strings and all."""
    best = {0: (0, ""), 3: (0, "")}
    closed = lambda b: {q: min(x for x in (b.get(q), *((b[n][0] + 5 * k, "I" * k + b[n][1]) for k, n in chain(q) if n in b)) if x) for q in range(4)}
    chain = lambda q: [(1, NEXT[q]), (2, NEXT[NEXT[q]]), (3, NEXT[NEXT[NEXT[q]]])]
    best = closed(best)
    for initial, gone, truncated in reversed(case):
        now = {}
        for q in range(4):
            own = [(2 + best[q][0], "D" + best[q][1])]
            if not gone:
                extra = 5 * truncated
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, q))
                if to:
                    own.append((extra + best[to][0], "K" + best[to][1]))
                own.append((1 + extra + best[NEXT[q]][0], "R" + best[NEXT[q]][1]))
            now[q] = min(own)
        best = closed(now)
    return best[0]


def test_long_sequences_and_segments():
    tables, r = TurnTables(), random.Random(3)
    for n in (4, 5, 11, 64, 203):
        case = [(r.choice("suuaaax"), r.random() < 0.15, int(r.random() < 0.2)) for _ in range(n)]
        assert run_tables(tables, case) == plain_edits(case)
    symbols = bytes(r.randrange(9) for _ in range(57))
    cut = 23
    to, paid = tables.function(symbols[cut:])
    end = int(to[0])
    front = tables.back(symbols[:cut], end)[1]
    assert int(paid[0]) + front == tables.back(symbols)[1]
    a, _, state = tables.trace(symbols[:cut], end)
    b, _, _ = tables.trace(symbols[cut:], 0, state)
    assert a + b == tables.trace(symbols)[0]
    assert (tables.block_to.shape, len(tables.vectors) < 60) == ((len(tables.vectors), 9**4), True)


def plain(rows, order):
    """The contract over Python lists; ``order`` sorts rows of one conversation."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        convs[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        convs[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = collections.Counter()
    for conv, own in convs.items():
        own.sort(key=order)
        seen, n, case = set(), collections.Counter(), []
        for _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            case.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {t for t, _, _ in own if t is not None}
        cost, letters = plain_edits(case)
        pairs = [a[0] + b[0] for a, b in zip(case, case[1:])]
        left, lines, at = iter(own), [], 0
        length = sum(x != "D" for x in letters)
        roles = ["system"] * (length % 2) + ["user", "assistant"] * (length // 2)
        for x in letters:
            _, role, text = (None, None, "") if x == "I" else next(left)
            if x != "D":
                lines.append(f"{role if x == 'K' else roles[at]}:{text}")
                at += 1
        out[conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def odd_rows(r, n):
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"])
            text = r.choice(["Hello there.", "What now?", "It is", "", "  \n", None, "same.", "same.", "Ends so!  ", "漢字。", " ", f"unique {r.random()}."])
            rows.append((conv if r.random() < 0.95 else None, r.choice([turn, turn * 3, None, -turn]), role, text))
    return rows


def order_of(spark, rows):
    from pyspark.sql import functions as F

    texts = {t for _, _, _, t in rows if t is not None} | {" ", ""} | {re.sub("[.!?]", "", t) for _, _, _, t in rows if t}
    h = dict(map(tuple, spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t")).collect()))
    return lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:32].encode(), h[x[2]])


@pytest.mark.parametrize("parts,segment", [(1, 4096), (16, 3)])
def test_rows_against_a_plain_loop(spark, monkeypatch, parts, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    r = random.Random(parts)
    rows = odd_rows(r, 120)
    rows += [(7_000, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "No", f"t{t}."])) for t in range(300)]  # spans ranges
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = collections.Counter(map(tuple, C.audit(C.damaged(df)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain(rows, order_of(spark, rows))


def test_edge_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.audit(C.damaged(spark.createDataFrame([], schema))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = C.audit(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    nulls = C.audit(C.damaged(spark.createDataFrame([(None, None, None, None)] * 3, schema))).collect()
    assert len(nulls) == 1 and nulls[0]["audit"].strip("D") == ""
    long = "word " * 200_000 + "end."
    keeps = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    row = C.audit(C.damaged(spark.createDataFrame([(keeps, 0, "user", long), (keeps, 1, "assistant", long)], schema))).first()
    assert row["audit"] == "KK" and row["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()


def test_whole_table(spark):
    from tests.conftest import SF001

    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collections.Counter(map(tuple, C.op13_conversation_repair(spark, SF001).collect()))
    assert got == plain(rows, order_of(spark, rows)) and len(got) == len({r[0] for r in rows})
