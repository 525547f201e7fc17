"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A conversation is in order when the initials of its roles spell ``(s?(ua)+)?``: for every feasible
length there is exactly one such string. Turns are aligned to these strings by Wagner-Fischer tables
filled from the end, so that one table holds all lengths of one ending; a table is a band of
diagonals, and the band follows Ukkonen: its width is what the cheapest alignment found so far still
allows, and it widens until that bound is met. Alignments of equal cost, of one length or several, are
traced back and the ASCII-least audit wins.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty turn 5; a truncated turn that
stays costs 5 more; blank and duplicate turns must go.

How it is dealt: flags and first occurrences are aggregations of short keys (16-byte digests), so
neither copies of a turn nor a long conversation meet in one task; turns are put in order by ranges of
(conversation, turn), which cut a long conversation over many tasks, and leave them as one byte a turn.
Alignment holds these bytes of one conversation, which are as many as the letters of its audit; it
works through segments of ``segment_rows`` turns, so a table stays small however long the conversation:
costs between the four states of the grammar are joined over segments, then each segment is traced.
The digest of the repaired text is a SHA-256 over one whole text, which cannot be put together from
parts: that last step streams a conversation's sorted rows through one task, holding one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import small_batches
from archspark.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: white space of the contract
SPACE = " \t\n\x0b\x0c\r"
#: a code is 4 * role + fault; roles by their initial, faults in the order in which they count
ROLES = ("s", "u", "a", "")
FINE, BLANK, DUPLICATE, BROKEN = range(4)
S, U, A = range(3)
#: states of the grammar: nothing yet, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FAR = 1 << 29
ADJACENT = {(S, U), (U, A), (A, U)}


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` (nulls: one space): rows with ``times`` they stand."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("__fault"))
    return rows.filter("__fault <> 0").select(
        "conv_id", "turn", F.when(F.col("__fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("__fault") == 3, 2).otherwise(1).cast("long").alias("times"))


def _reads(end: int, left: int) -> int:
    """First role of the alternating string of ``left`` roles that ends in state ``end``."""
    last = A if end == AFTER_A else U
    return last if left % 2 else U + A - last


class _Table:
    """Costs of aligning turns i.. of a segment with the last ``left`` roles of the string ending in ``end``.

    Row i holds diagonals -lo..hi of (left - free turns from i on); ``tail``: turns may be inserted
    after the last one (else they belong to the next segment).
    """

    def __init__(self, codes: bytes, end: int, lo: int, hi: int, tail: bool):
        self.codes, self.end, self.lo, self.width = codes, end, lo, lo + hi + 1
        k = np.arange(self.width)
        steps = INSERT * k
        row = np.full(self.width, FAR)
        row[lo] = 0
        if tail:
            row[lo:] = INSERT * np.arange(hi + 1)
        self.free = free = [0] * (len(codes) + 1)
        self.rows = rows = [row] * (len(codes) + 1)
        for i in range(len(codes) - 1, -1, -1):
            role, fault = divmod(codes[i], 4)
            below, forced = rows[i + 1], fault in (BLANK, DUPLICATE)
            free[i] = free[i + 1] + (not forced)
            if forced:
                row = below + DELETE
            else:
                left = k + (free[i] - lo)
                stay = np.where(left % 2 == 1, *(((KEEP if role == r else REROLE) for r in (_reads(end, 1), _reads(end, 2)))))
                match = np.where(left >= 1, below + stay + (TRUNCATED if fault == BROKEN else 0), FAR)
                row = np.minimum(match, DELETE + np.append(below[1:], FAR))
            row = np.minimum.accumulate(row - steps) + steps
            rows[i] = np.minimum(row, FAR)

    def at(self, i: int, left: int) -> int:
        k = left - self.free[i] + self.lo
        return int(self.rows[i][k]) if left >= 0 and 0 <= k < self.width else FAR

    def lefts(self, i: int, reads: int | None, none: bool) -> list[int]:
        """Lengths in row i whose string begins with role ``reads``; also none at all, if ``none``."""
        first = self.free[i] - self.lo
        return [x for x in range(max(first, 0), first + self.width) if (none if x == 0 else _reads(self.end, x) == reads)]

    def trace(self, i: int, left: int) -> str:
        """The ASCII-least audit of a cheapest alignment from (i, left)."""
        out, codes, n = [], self.codes, len(self.codes)
        while i < n or left:
            cost = self.at(i, left)
            if i < n and self.at(i + 1, left) + DELETE == cost:
                out.append("D")
                i += 1
            elif left and self.at(i, left - 1) + INSERT == cost:
                out.append("I")
                left -= 1
            else:
                out.append("K" if codes[i] // 4 == _reads(self.end, left) else "R")
                i, left = i + 1, left - 1
        return "".join(out)


class _Segment:
    """Cheapest alignments of a segment between all states of the grammar it may start and end in."""

    def __init__(self, codes: bytes, first: bool, last: bool):
        self.codes = codes
        self.starts = (START,) if first else (START, AFTER_S, AFTER_U, AFTER_A)
        ends = (AFTER_A,) if last else (AFTER_U, AFTER_A)
        forced = sum(c % 4 in (BLANK, DUPLICATE) for c in codes)
        free, lo, hi = len(codes) - forced, 4, 4
        while True:
            self.tables = {e: _Table(codes, e, lo, hi, last) for e in ends}
            self.cost = {(x, e): self._least(x, e) for x in self.starts for e in ends}
            spare = max(self.cost.values()) - DELETE * forced  # what the incumbents leave for leaving the diagonal
            need_lo, need_hi = min(free, spare // DELETE), spare // INSERT
            if lo >= need_lo and hi >= need_hi:
                break
            lo, hi = max(lo, min(need_lo, 4 * lo)), max(hi, min(need_hi, 4 * hi))
        gone = DELETE * len(codes)
        self.cost[START, START] = gone
        if not last:
            for x in self.starts:
                if x != START:
                    self.cost[x, x] = min(self.cost.get((x, x), FAR), gone)
            only = [DELETE * (len(codes) - 1) + (c % 4 == BROKEN) * TRUNCATED for _, c in self._systems()]
            if only:
                self.cost[START, AFTER_S] = min(only)

    def _systems(self):
        return [(i, c) for i, c in enumerate(self.codes) if c // 4 == S and c % 4 in (FINE, BROKEN)]

    def _lefts(self, table: _Table, start: int) -> list[int]:
        return table.lefts(0, A if start == AFTER_U else U, start == table.end)

    def _least(self, start: int, end: int) -> int:
        table = self.tables[end]
        best = min((table.at(0, x) for x in self._lefts(table, start)), default=FAR)
        if start == START:
            for i, c in self._systems():
                before = DELETE * i + (c % 4 == BROKEN) * TRUNCATED
                if before < best:
                    best = min([best, *(before + table.at(i + 1, x) for x in table.lefts(i + 1, U, False))])
        return best

    def audit(self, start: int, end: int) -> str:
        """ASCII-least of the audits that reach ``cost[start, end]``, over all lengths."""
        best, n, found = self.cost[start, end], len(self.codes), []
        if start == end and end in (START, AFTER_S):
            return "D" * n
        if end == AFTER_S:
            return min("D" * i + "K" + "D" * (n - 1 - i) for i, c in self._systems()
                       if DELETE * (n - 1) + (c % 4 == BROKEN) * TRUNCATED == best)
        if start == end and best == DELETE * n:
            found.append("D" * n)
        table = self.tables[end]
        found += [table.trace(0, x) for x in self._lefts(table, start) if table.at(0, x) == best]
        if start == START:
            for i, c in self._systems():
                before = DELETE * i + (c % 4 == BROKEN) * TRUNCATED
                if before <= best:
                    found += ["D" * i + "K" + table.trace(i + 1, x) for x in table.lefts(i + 1, U, False) if before + table.at(i + 1, x) == best]
        return min(found)


def align(codes: bytes, segment_rows: int = 256) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation given as one code a turn."""
    return _short(codes, segment_rows) if len(codes) <= 24 else _align(codes, segment_rows)


def _align(codes: bytes, segment_rows: int) -> tuple[int, str]:
    if not codes:
        return 0, ""
    cuts = range(0, len(codes), segment_rows)

    def segment(k: int) -> _Segment:
        return _Segment(codes[cuts[k]: cuts[k] + segment_rows], k == 0, k == len(cuts) - 1)

    togo = [{} for _ in cuts] + [{START: 0, AFTER_A: 0}]
    for k in range(len(cuts) - 1, -1, -1):
        now = segment(k)
        for (x, y), cost in now.cost.items():
            if y in togo[k + 1]:
                togo[k][x] = min(togo[k].get(x, FAR), cost + togo[k + 1][y])
    at, audit = {START}, []
    for k in range(len(cuts)):
        now = segment(k) if len(cuts) > 1 else now
        found = {(x, y): now.audit(x, y) for (x, y), cost in now.cost.items()
                 if x in at and y in togo[k + 1] and cost + togo[k + 1][y] == togo[k][x]}
        least = min(found.values())
        at = {y for (_, y), s in found.items() if s == least}
        audit.append(least)
    return togo[0][START], "".join(audit)


#: short conversations repeat; at most 20,000 of at most 24 bytes
_short = lru_cache(20_000)(_align)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> for each conversation and task, its codes and what counting distinct turns needs."""
    from pyspark import TaskContext

    names = ["conv_id", "part", "seq", "first_turn", "last_turn", "n_turns", "codes"]
    part, held, out, seq = TaskContext.get().partitionId(), None, [], 0

    def close():
        nonlocal held, seq
        if held:
            out.append((held[0], part, seq, held[1], held[2], held[3], bytes(held[4])))
            seq += 1
        held = None

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        turn_kind = batch.schema.field("turn").type
        for conv, turn, code, first, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "first", "n"))):
            if held is None or held[0] != conv or len(held[4]) > 1 << 20:
                close()
                held = [conv, None, None, 0, bytearray()]
            if turn is not None and turn != held[2]:
                held[1:4] = [turn if held[1] is None else held[1], turn, held[3] + 1]
            same = bytes([code]) if code % 4 == BLANK else bytes([code - code % 4 + DUPLICATE])
            held[4] += (bytes([code]) + same * (n - 1)) if first else same * n
        yield from _rows(out, names, kind, turn_kind)
    close()
    if kind is not None:
        yield from _rows(out, names, kind, turn_kind)


def _rows(out: list, names: list[str], kind, turn_kind) -> Iterator[pa.RecordBatch]:
    kinds = {"conv_id": kind, "part": pa.int32(), "seq": pa.int32(), "n_turns": pa.int64(), "codes": pa.binary()}
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=kinds.get(n, turn_kind)) for n, c in zip(names, zip(*out))], names=names)
        out.clear()


def _audits(segment_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column("pieces").to_pylist():
                codes, turns, first, last = b"".join(p["codes"] for p in pieces), 0, None, None
                for p in pieces:
                    if p["n_turns"]:
                        turns += p["n_turns"] - (last is not None and p["first_turn"] == last)
                        first, last = p["first_turn"] if first is None else first, p["last_turn"]
                faults = [sum(codes.count(4 * r + f) for r in range(4)) for f in (BLANK, DUPLICATE, BROKEN)]
                beside = np.frombuffer(codes, np.uint8) // 4
                pairs = np.bincount(4 * beside[:-1] + beside[1:], minlength=16) if len(codes) > 1 else np.zeros(16, int)
                legal = sum(int(pairs[4 * a + b]) for a, b in ADJACENT)
                cost, audit = align(codes, segment_rows)
                out.append((last - first + 1 - turns if turns else 0, *faults, int(pairs.sum()) - legal, cost, audit))
            cols = list(zip(*out)) if out else [()] * 7
            arrays = [pa.array(c, type=pa.int64()) for c in cols[:6]] + [pa.array(cols[6], type=pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names=["conv_id", *COUNTS, "audit"])
    return run


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit first, then a conversation's sorted turns -> SHA-256 of the repaired text, row by row."""
    names, kind, out, now = ["conv_id", *COUNTS, "audit", "repaired_sha256"], None, [], None

    class Repair:
        def __init__(self, conv, head):
            self.conv, self.head, self.audit = conv, head, head["audit"]
            self.at, self.last, self.sha, self.any = 0, None, hashlib.sha256(), False

        def emit(self, role, text):
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any, self.last = True, role[:1]

        def next_role(self):
            return "assistant" if self.last == "u" else "user"

        def inserts(self):
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                self.emit(self.next_role(), "")
                self.at += 1

        def turn(self, role, text):
            self.inserts()
            step, self.at = self.audit[self.at], self.at + 1
            if step != "D":
                self.emit(self.next_role() if step == "R" else role, text)

        def close(self):
            self.inserts()
            return (self.conv, *(self.head[c] for c in COUNTS), self.audit, self.sha.hexdigest())

    def done():
        kinds = {"conv_id": kind, "audit": pa.string(), "repaired_sha256": pa.string()}
        made = pa.RecordBatch.from_arrays([pa.array(c, type=kinds.get(n, pa.int64())) for n, c in zip(names, zip(*out))], names=names)
        out.clear()
        return made

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, head, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text", "times"))):
            if head is not None:
                if now:
                    out.append(now.close())
                now = Repair(conv, head)
            else:
                for _ in range(times):
                    now.turn(role, text)
        if out:
            yield done()
    if now:
        out.append(now.close())
        yield done()


def repair(turns: DataFrame, segment_rows: int = 256) -> DataFrame:
    """One row per ``conv_id`` of ``turns`` (conv_id, turn, role, text), after the contract's damage:
    gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of the repaired text.

    Turns stand in order of ``turn``, nulls first; rows of one turn in order of a digest of role and
    text, so equal rows are adjacent and the result does not depend on how the table is split.
    Nulls: a null id is a conversation of its own; null roles and texts are one space. A role whose
    initial is not s, u or a, an empty one too, can only be reroled or deleted. A conversation of which
    no row is left has zeros, an empty audit and the empty text's digest. Repeated rows are duplicates.
    Long texts are hashed whole, one at a time; long conversations: see the module's text. An empty
    table gives an empty result; other columns are not read.
    """
    spark = turns.sparkSession
    small_batches(spark)
    rows = damage(turns)
    bare = F.rtrim("text", F.lit(SPACE))
    role = F.position(F.substring("role", 1, 1), F.lit("sua"))
    code = F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1) * 4
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), BROKEN).otherwise(FINE)
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    keyed = rows.withColumn("same", same)
    slim = cut_lineage(keyed.select("conv_id", "turn", "same", (code + fault).alias("code"), "times"))
    firsts = slim.groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))).alias("m"))
    marked = (slim.select("conv_id", "turn", "same", "code", F.col("times").alias("n"), F.lit(0).alias("first"))
              .unionAll(firsts.select("conv_id", "m.turn", "same", F.lit(-1), F.lit(0).cast("long"), F.lit(1)))
              .groupBy("conv_id", "turn", "same").agg(F.max("code").alias("code"), F.sum("n").alias("n"), F.max("first").alias("first")))
    order = ["conv_id", "turn", "same"]
    kind, turn_kind = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    pieces = (marked.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
              .mapInArrow(_pieces, f"conv_id {kind}, part int, seq int, first_turn {turn_kind}, last_turn {turn_kind}, n_turns long, codes binary"))
    piece = F.struct("part", "seq", "first_turn", "last_turn", "n_turns", "codes")
    none = F.lit(None).cast(f"struct<part:int,seq:int,first_turn:{turn_kind},last_turn:{turn_kind},n_turns:bigint,codes:binary>")
    # every conversation, also one that lost all its rows; null structs are not collected
    heads = (pieces.select("conv_id", piece.alias("p")).unionAll(turns.select("conv_id").distinct().select("conv_id", none))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
             .mapInArrow(_audits(segment_rows), f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string"))
    head = F.struct(*COUNTS, "audit")
    empty = F.lit(None).cast(f"struct<{','.join(f'{c}:bigint' for c in COUNTS)},audit:string>")
    both = (heads.select("conv_id", head.alias("head"), F.lit(None).cast(turn_kind).alias("turn"), F.lit(None).cast("binary").alias("same"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("times"))
            .unionAll(keyed.select("conv_id", empty, "turn", "same", "role", "text", "times")))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "same")
            .select("conv_id", "head", "role", "text", "times")
            .mapInArrow(_digests, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"))
