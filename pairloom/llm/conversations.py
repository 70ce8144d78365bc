"""Conversation structure repair (13), by the block tables of ``turn_tables``.

Rows are dealt out once, by ranges of (conversation, turn, role, start and
hash of the text): a range holds whole conversations but for its first and its
last, which may go on beyond it.  Inner ones are settled in the task.  The
others, at most two a range however long they are, become segments of up to
SEGMENT rows and are joined exactly:
* a row repeats an earlier segment's if that holds its 128-bit hash;
* each segment gives the function from the cost vector behind it to that in
  front of it, so the vectors at all its borders follow from short tables;
* its edits are traced in order, segment by segment, because the SHA-256 of a
  conversation can only be taken in order; a task holds one segment and the
  edits so far.

Defined results: null roles and texts are one space (so is a null id or turn
in the damage's key); a null conv_id is a conversation of its own; equal turns
are ordered by role, the text's first 32 characters and its hash, equal rows
follow each other and all but the first are duplicates; an empty role has no
initial and is neither legal nor kept; an empty table gives no rows.  Extra
columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm.common import ROWS_AT_ONCE, stored
from pairloom.llm.turn_tables import START, TurnTables, repaired

#: rows of a segment at most
SEGMENT = 4096

#: fixed values of the faults (of twenty) that the damage deals out
DROPPED, EMPTIED, UNSTOPPED, REPEATED, AS_USER = range(5)

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE = 0, 1

_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SEGMENT = ("part int, seq int, roles array<string>, texts array<string>, kinds binary, hashes array<binary>, "
            "first_turn long, last_turn long, turns long")


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults; a dropped row keeps its
    place with a null role, so its conversation is not forgotten."""
    space = F.lit(" ")
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.col("fault")
    rows = rows.withColumn("fault", (F.crc32(key) % 20).cast("int"))
    text = F.when(fault == EMPTIED, "").when(fault == UNSTOPPED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == DROPPED, None).when(fault == AS_USER, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(fault == REPEATED, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def kind_of(role: str, text: str, again: bool) -> int:
    """BLANK, DUPLICATE, or 2 + 2 * role class, plus 1 if truncated."""
    end = text.rstrip(BLANKS)
    if not end:
        return BLANK
    if again:
        return DUPLICATE
    return 2 + 2 * ("sua".find(role[0]) if role[:1] in ("s", "u", "a") else 3) + (end[-1] not in STOPS)


def known_by(role: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(b"%d:" % len(role) + role.encode() + text.encode())


def symbols_of(kinds: bytes) -> bytes:
    """Blank and duplicate rows are one symbol to the tables."""
    return bytes(max(k - 1, 0) for k in kinds)


def illegal_pairs(initials: str | list) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


class Turns:
    """The rows of one conversation in one task."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.kinds, self.hashes, self.turns = conv_id, [], bytearray(), [], []
        self.seen = set()

    def add(self, turn, role, text) -> None:
        if role is None:  # dropped
            return
        h = known_by(role, text)
        self.kinds.append(kind_of(role, text, h in self.seen))
        self.seen.add(h)
        self.rows.append((role, text))
        self.hashes.append(h)
        self.turns.append(turn)

    def result(self, tables: TurnTables) -> tuple:
        symbols = symbols_of(self.kinds)
        cost = tables.back(symbols)[1]
        letters, states, state = tables.trace(symbols)
        more, after = tables.closing(state)
        text = "\n".join(repaired(letters + more, states + after, self.rows))
        turns = {t for t in self.turns if t is not None}
        return (self.conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts(self.kinds),
                illegal_pairs([r[:1] for r, _ in self.rows]), cost, letters + more, hashlib.sha256(text.encode()).hexdigest())

    def segments(self, part: int):
        """Records of up to SEGMENT rows; one without rows if all are dropped."""
        for seq, at in enumerate(range(0, max(len(self.rows), 1), SEGMENT)):
            to = at + SEGMENT
            rows, turns = self.rows[at:to], [t for t in self.turns[at:to] if t is not None]
            yield (self.conv_id, *[None] * 8, part, seq, [r for r, _ in rows], [t for _, t in rows], bytes(self.kinds[at:to]), self.hashes[at:to],
                   turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))


def counts(kinds) -> tuple[int, int, int]:
    """Blank, duplicate and truncated rows."""
    k = np.frombuffer(bytes(kinds), np.uint8)
    return int((k == BLANK).sum()), int((k == DUPLICATE).sum()), int(((k >= 2) & (k % 2 == 1)).sum())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def audit(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation of
    ``damaged`` rows (role null: the row is gone)."""
    schema = _arrow(f"{_RESULT}, {_SEGMENT}")
    keyed = rows.select("conv_id", "turn", "role", "text", F.substring("text", 1, 32).alias("s"), F.xxhash64("text").alias("h"),
                        F.monotonically_increasing_id().alias("m"))
    keys = ["conv_id", "turn", "role", "s", "h", "m"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text")

    def run(batches):
        from pyspark import TaskContext

        part, tables, now, first, out = TaskContext.get().partitionId(), TurnTables(), None, True, []
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now.conv_id != conv:
                    if first:
                        out += now.segments(part)
                        first = False
                    else:
                        out.append((*now.result(tables), *[None] * 9))
                    now = None
                if now is None:
                    now = Turns(conv)
                now.add(turn, role, text)
                if len(out) >= ROWS_AT_ONCE:
                    yield _batch(out, schema)
                    out = []
        if now is not None:
            out += now.segments(part)
            yield _batch(out, schema)

    found = stored(dealt.mapInArrow(run, f"{_RESULT}, {_SEGMENT}"), "conversations")
    names = [f.name for f in T.StructType.fromDDL(_RESULT)]
    done = found.where(F.col("part").isNull()).select(names)
    open_ = found.where(F.col("part").isNotNull()).select("conv_id", *[f.name for f in T.StructType.fromDDL(_SEGMENT)])
    return done.unionByName(_joined(open_))


def _joined(segments: DataFrame) -> DataFrame:
    """The conversations whose rows lie in several segments (or may)."""
    place = F.struct("part", "seq")
    # hashes that an earlier segment of the conversation holds
    each = segments.select("conv_id", "part", "seq", F.explode(F.array_distinct("hashes")).alias("h"))
    first = each.groupBy("conv_id", "h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = each.alias("e").join(first.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.h") == F.col("f.h")))
    later = later.where(F.struct("e.part", "e.seq") > F.col("f.first")).groupBy("e.conv_id", "e.part", "e.seq").agg(F.collect_set("e.h").alias("again"))
    # part and seq name a segment, with conv_id where a range ends one and begins another
    marked = segments.alias("s").join(later.alias("l"), (F.col("s.part") == F.col("l.part")) & (F.col("s.seq") == F.col("l.seq")) & F.col("s.conv_id").eqNullSafe(F.col("l.conv_id")), "left")
    marked = marked.select("s.*", F.coalesce("l.again", F.array().cast("array<binary>")).alias("again"))
    heads = ("conv_id long, part int, seq int, n long, turns long, first_turn long, last_turn long, blank long, duplicate long, "
             "truncated long, illegal long, head string, tail string, to binary, paid binary")
    schema = _arrow(heads)

    def kinds_of(row) -> bytes:
        again = set(row["again"])
        if not again:
            return row["kinds"]
        return bytes(k if k == BLANK or h not in again else DUPLICATE for k, h in zip(row["kinds"], row["hashes"]))

    def summed(batches):
        tables = TurnTables()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                kinds = kinds_of(row)
                to, paid = tables.function(symbols_of(kinds))
                initials = [r[:1] for r in row["roles"]]
                out.append((row["conv_id"], row["part"], row["seq"], len(kinds), row["turns"], row["first_turn"] or 0, row["last_turn"] or 0, *counts(kinds),
                            illegal_pairs(initials), *((initials[0], initials[-1]) if initials else (None, None)),
                            to.astype("<i8").tobytes(), paid.astype("<i8").tobytes()))
            yield _batch(out, schema)

    def bordered(group: pd.DataFrame) -> pd.DataFrame:
        """The vector behind each segment, from the last to the first, and the conversation's counts."""
        tables, end, cost = TurnTables(), 0, 0
        group = group.sort_values(["part", "seq"])
        ends = []
        for to, paid in zip(group["to"][::-1], group["paid"][::-1]):
            ends.append(end)
            cost += int(np.frombuffer(paid, "<i8")[end])
            end = int(np.frombuffer(to, "<i8")[end])
        cost += tables.vectors[end][START]
        turns = group[group["turns"] > 0]
        shared = int((turns["first_turn"].to_numpy()[1:] == turns["last_turn"].to_numpy()[:-1]).sum())
        gaps = int(turns["last_turn"].iloc[-1]) - int(turns["first_turn"].iloc[0]) + 1 - int(turns["turns"].sum()) + shared if len(turns) else 0
        full = group[group["n"] > 0]
        illegal = int(group["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(full["tail"][:-1], full["head"][1:]))
        out = group[["conv_id", "part", "seq"]].assign(end=ends[::-1], gaps=gaps, illegal=illegal, cost=cost)
        return out.assign(**{c: int(group[c].sum()) for c in ("blank", "duplicate", "truncated")})

    rest = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    borders = marked.mapInArrow(summed, heads).groupBy("conv_id").applyInPandas(bordered, f"conv_id long, part int, seq int, end int, {rest}")
    ready = marked.alias("m").join(borders.alias("b"), (F.col("m.part") == F.col("b.part")) & (F.col("m.seq") == F.col("b.seq")) & F.col("m.conv_id").eqNullSafe(F.col("b.conv_id")))
    ready = ready.select("m.*", "b.end", *[f"b.{c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    result = _arrow(_RESULT)

    def traced(batches):
        tables, now = TurnTables(), None
        for batch in batches:
            out = []
            for at in range(batch.num_rows):  # one segment at a time
                row = batch.slice(at, 1).to_pylist()[0]
                if now is None or now[0]["conv_id"] != row["conv_id"]:
                    if now is not None:
                        out.append(ended(tables, *now))
                    now = [row, [], START, hashlib.sha256(), False]
                letters, states, now[2] = tables.trace(symbols_of(kinds_of(row)), row["end"], now[2])
                now[1].append(letters)
                now[4] = _fed(now[3], now[4], repaired(letters, states, zip(row["roles"], row["texts"])))
                now[0] = {k: v for k, v in row.items() if k not in ("roles", "texts", "kinds", "hashes", "again")}
            if out:
                yield _batch(out, result)
        if now is not None:
            yield _batch([ended(tables, *now)], result)

    def ended(tables, row, letters, state, digest, begun):
        more, states = tables.closing(state)
        _fed(digest, begun, repaired(more, states, []))
        return (row["conv_id"], *(row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "".join(letters) + more, digest.hexdigest())

    return ready.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(traced, _RESULT)


def _fed(digest, begun: bool, lines) -> bool:
    """Lines joined by line ends into the digest; whether it has any now."""
    for line in lines:
        digest.update(("\n" * begun + line).encode())
        begun = True
    return begun


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damaged(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")))
