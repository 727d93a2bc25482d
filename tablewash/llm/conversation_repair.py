"""Conversation structure repair by weighted CYK interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its rows may
be kept (0), given the role user or assistant (2) or deleted (3), and an empty user or
assistant row may be inserted anywhere (2); a truncated row that stays adds 1, blank
and duplicate rows must go. The cheapest edits win, and among them those whose audit,
the initials K, R, D, I in order, is least by ASCII.

The repair grammar in Chomsky normal form has a nonterminal N(p, q) for each two
states of the pattern: what leads from p to q. Its rules are N(p, q) -> N(p, r) N(r, q)
and, for one row, its edits; insertions are closed once (``INSERTED``) and enter the
cells of single rows, and once more behind the last row. A cell of a span holds the
minimum (cost, audit) of each N(p, q); cells are combined bottom-up by span length,
1, 2, 4 and so on. Audits of one cell that cost the same are never prefixes of one
another (a longer one would hold more insertions), so least parts make least wholes,
and every cut of a span gives the same cell: one cut per span is enough.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is
cut among tasks; each task parses its segments, and the segments of conversations that
cross a border are combined in rounds of at most ``FAN_IN``. Only the repaired rows
of one conversation pass one task in their order, as a stream: its hash is sequential.

Defined cases: rows of one conversation are taken by turn, nulls first; rows that share
a turn by the hash of role and text. A null role or text counts as one space, and so is
blank or has no legal initial. Rows without conv_id form one conversation. Equal 128-bit
hashes of role and text count as equal. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch

FAN_IN = 32
SHORT = 8  # rows of the spans whose cells are remembered

# States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a; 0 and 3 may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

Cells = list  # by state p: {state q: (cost, audit)}


def _least(found) -> dict:
    best: dict = {}
    for q, cell in found:
        if q not in best or cell < best[q]:
            best[q] = cell
    return best


def combine(x: Cells, y: Cells) -> Cells:
    """Cells of a span from those of its two halves."""
    return [_least((q, (c + d, a + b)) for r, (c, a) in row.items() for q, (d, b) in y[r].items()) for row in x]


def _closure() -> Cells:
    now = [_least([(p, (0, ""))] + [(STEPS[p][i], (INSERT, "I")) for i in "ua" if i in STEPS[p]]) for p in range(4)]
    while (after := combine(now, now)) != now:
        now = after
    return now


INSERTED = _closure()


def _row(symbol: str) -> Cells:
    """Cells of a row: its initial (x: none of s, u, a), upper case if it is
    truncated, d if it must go."""
    kind, late = symbol.lower(), TRUNCATED * symbol.isupper()
    edits = []
    for p, step in enumerate(STEPS):
        found = [(p, (DELETE, "D"))]
        if kind != "d":
            found += [(step[i], (REROLE + late, "R")) for i in "ua" if i in step]
            found += [(step[kind], (late, "K"))] if kind in step else []
        edits.append(_least(found))
    return combine(INSERTED, edits)


def _by_length(level: list[Cells]) -> Cells:
    while len(level) > 1:
        level = [combine(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=1 << 14)
def _short(symbols: str) -> Cells:
    return _by_length([_row(s) for s in symbols])


def parse(symbols: str) -> Cells:
    """Cells of the rows that the symbols stand for."""
    if not symbols:
        return [{p: (0, "")} for p in range(4)]
    return _by_length([_short(symbols[i:i + SHORT]) for i in range(0, len(symbols), SHORT)])


def cheapest(cells: Cells) -> tuple[int, str]:
    """Cost and audit of the whole conversation."""
    whole = combine(cells, INSERTED)[0]
    return min(whole[q] for q in ENDS if q in whole)


class Replay:
    """Applies an audit to the rows it was made for, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._role(), ""

    def _role(self) -> str:
        initial = "a" if self.state == 2 else "u"
        self.state = STEPS[self.state][initial]
        return "assistant" if initial == "a" else "user"

    def row(self, role: str, text: str):
        """The (edit, role, text) before the row's place, and its own unless deleted."""
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state][role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._role(), text

    def end(self):
        yield from self._inserts()


# --- Faults and segments ----------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def _rows(rows: DataFrame, here: Column) -> DataFrame:
    """``conv, turn, role, text, digest, here``."""
    one = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                      *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), here.alias("here"))
    return one.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _symbols(rows: DataFrame) -> DataFrame:
    """Without texts: ``conv, turn, digest, here, initial``, ``last`` (last character
    that is not blank, '' if none) and ``first`` (the first turn with this role and text)."""
    own = rows.select("conv", "turn", "digest", "here", F.substring("role", 1, 1).alias("initial"),
                      F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).alias("last"))
    again = (own.where("here").groupBy("conv", "digest")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first"), F.count("*").alias("m"))
             .where("m > 1").select(F.col("conv").alias("c"), F.col("digest").alias("g"), F.col("first.turn").alias("first"),
                                    F.lit(True).alias("several")))
    return own.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left").select(
        "conv", "turn", "digest", "here", "initial", "last",
        (F.col("several") & ~F.col("turn").eqNullSafe(F.col("first"))).alias("later"))


_COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
_SEGMENT = ["conv", "part", "edge", *_COUNTS, "low", "high", "head", "tail", "cost", "audit"]


def _segment_type(conv: str) -> str:
    return (f"conv {conv}, part int, edge boolean, " + ", ".join(f"{c} long" for c in _COUNTS)
            + ", low long, high long, head string, tail string, cost array<long>, audit array<string>")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Segment:
    """The rows of a conversation in one task, taken in order."""

    def __init__(self, conv):
        self.conv, self.symbols, self.low, self.high, self.head, self.tail = conv, [], None, None, None, None
        self.n = dict.fromkeys(_COUNTS, 0)
        self.before = None

    def add(self, turn, digest, initial, last, later):
        n = self.n
        n["rows"] += 1
        if turn is not None:
            n["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.tail is None:
            self.head = initial
        else:
            n["illegal"] += not _legal(self.tail, initial)
        self.tail = initial
        fault = "blank" if not last else "duplicate" if later or (turn, digest) == self.before else \
            "truncated" if last not in ".!?" else None
        self.before = (turn, digest)
        kind = initial if initial in ("s", "u", "a") else "x"
        if fault:
            n[fault] += 1
            kind = kind.upper() if fault == "truncated" else "d"
        self.symbols.append(kind)

    def out(self, part, edge) -> dict:
        return {"conv": self.conv, "part": part, "edge": edge, **self.n, "low": self.low, "high": self.high,
                "head": self.head, "tail": self.tail, **_flat(parse("".join(self.symbols)))}


def _flat(cells: Cells) -> dict:
    at = [row.get(q) for row in cells for q in range(4)]
    return {"cost": [x and x[0] for x in at], "audit": [x and x[1] for x in at]}


def _cells(segment: dict) -> Cells:
    at = list(zip(segment["cost"], segment["audit"]))
    return [{q: at[4 * p + q] for q in range(4) if at[4 * p + q][0] is not None} for p in range(4)]


def _merge(segments: list[dict]) -> dict:
    """Neighbouring segments of a conversation as one."""
    out = dict(segments[0])
    for s in segments[1:]:
        for c in _COUNTS:
            out[c] += s[c]
        if s["low"] is not None:
            out["turns"] -= s["low"] == out["high"]
            out["low"], out["high"] = s["low"] if out["low"] is None else out["low"], s["high"]
        if s["tail"] is not None:
            out["illegal"] += out["tail"] is not None and not _legal(out["tail"], s["head"])
            out["head"], out["tail"] = s["head"] if out["tail"] is None else out["head"], s["tail"]
    return out | _flat(_by_length([_cells(s) for s in segments]))


def _cut(schema: pa.Schema):
    def run(batches):
        part, now, edge, done = TaskContext.get().partitionId(), None, True, []
        for b in batches:
            for conv, turn, digest, here, initial, last, later in zip(*(b.column(i).to_pylist() for i in range(7))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.out(part, edge))
                        edge = False
                    now = _Segment(conv)
                if here:
                    now.add(turn, digest, initial, last, later)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.out(part, True)], schema=schema)

    return run


def _arrow(conv: pa.DataType) -> pa.Schema:
    kinds = {"conv": conv, "part": pa.int32(), "edge": pa.bool_(), "head": pa.string(), "tail": pa.string(),
             "cost": pa.list_(pa.int64()), "audit": pa.list_(pa.string())}
    return pa.schema([(c, kinds.get(c, pa.int64())) for c in _SEGMENT])


def _segments(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One segment for each conversation."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv"]
    schema, ddl = _arrow(pa.int64() if kind == "bigint" else pa.string()), _segment_type(kind)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.keep(_symbols(rows).repartitionByRange(parts, "conv", "turn", "digest")
                       .sortWithinPartitions("conv", "turn", "digest").mapInArrow(_cut(schema), ddl), "cut")
    last = cut.agg(F.max("part")).first()[0] or 0

    def merge(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda s: s["part"])
        return pa.Table.from_pylist([_merge(own)], schema=schema)

    # a conversation crosses a border only as the first or the last of a task
    now, step, size = cut.where("edge"), 0, 1
    while size <= last or not step:
        size *= FAN_IN
        step += 1
        now = scratch.keep(now.groupBy("conv", F.floor(F.col("part") / size)).applyInArrow(merge, ddl), f"edge-{step}")
    return cut.where("NOT edge").union(now)


# --- Results ----------------------------------------------------------------


def _streamed(rows: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` over the conversations: each comes as its segment and then its rows in order."""
    scratch = Scratch(rows.sparkSession, "conversations")
    found = _segments(rows, scratch)
    head = found.select("conv", F.struct(*_SEGMENT[3:]).alias("segment"), F.lit(0).alias("kind"))
    tail = rows.where("here").select("conv", "turn", "digest", "role", "text", F.lit(1).alias("kind"))
    both = head.unionByName(tail, allowMissingColumns=True).select("conv", "kind", "turn", "digest", "segment", "role", "text")
    return (both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "digest")
            .select("conv", "segment", "role", "text").mapInArrow(run, ddl))


def _replayed(batches):
    """(conv, segment, cost, audit) and then (edit, role, text) of each repaired row; per batch, None."""
    replay = None
    for b in batches:
        for conv, segment, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if segment is not None:
                if replay is not None:
                    yield from replay.end()
                cost, audit = cheapest(_cells(segment))
                replay = Replay(audit)
                yield conv, segment, cost, audit
            else:
                yield from replay.row(role, text)
        yield None
    if replay is not None:
        yield from replay.end()


def repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows of the repaired conversations,
    numbered from 0; edit is K, R or I."""
    rows = _rows(conversations, F.lit(True))
    kind = dict(rows.dtypes)["conv"]
    schema = pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.string()), ("place", pa.int64()),
                        ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        out, conv, place = [], None, 0
        for x in _replayed(batches):
            if x is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)],
                                                 schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)
                out = []
            elif len(x) == 4:
                conv, place = x[0], 0
            else:
                out.append((conv, place, *x))
                place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return _streamed(rows, run, f"conv_id {kind}, place long, edit string, role string, text string")


def _report(rows: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes)["conv"]
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.string()),
                        *((c, pa.int64()) for c in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        out, now, digest, first = [], None, None, True

        def close():
            if now is not None:
                out.append({**now, "repaired_sha256": digest.hexdigest()})

        for x in _replayed(batches):
            if x is None:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
            elif len(x) == 4:
                close()
                conv, s, cost, audit = x
                gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
                now = {"conv_id": conv, "gaps": gaps, **{c: s[c] for c in numbers[1:5]}, "cost": cost, "audit": audit}
                digest, first = hashlib.sha256(), True
            else:
                digest.update(f"{'' if first else chr(10)}{x[1]}:{x[2]}".encode())
                first = False
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _streamed(rows, run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in numbers)
                     + ", audit string, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation."""
    return _report(_rows(conversations, F.lit(True)))


def damage_report(conversations: DataFrame) -> DataFrame:
    """``report`` of the rows after a damage that crc32 of ``conv_id:turn`` modulo 20
    decides: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it,
    4 makes it the user's. A conversation that loses all rows is still reported."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    hit = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return _report(_rows(hit, F.col("kind") != 0))
