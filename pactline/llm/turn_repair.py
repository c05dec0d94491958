"""Repair of conversations: the cheapest edits that make their roles a sentence of a grammar."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import Batches, attached, batch, mapped, partitions, slices, stored

# Cells: the cheapest (cost, audit) of a span for each nonterminal, a pair of states. States: 0 in
# front of everything, 1 after a system turn, 2 after a user turn, 3 after an assistant turn. A
# sentence `(s?(ua)+)?` leads from 0 to 0 or 3.
Cells = dict[tuple[int, int], tuple[int, str]]

_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_STATES = (0, 1, 2, 3)
_NAMES = {"u": "user", "a": "assistant"}
_FINAL = (0, 3)
_ENDS = ".!?"
_WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class EditCosts:
    """What an edit costs; `truncated` is added to turns that stay without an end of sentence.
    `segment`: how many turns are parsed at once before their cells meet those of the next ones."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    segment: int = 512


def _least(cells: Cells, key: tuple[int, int], found: tuple[int, str]) -> None:
    if key not in cells or found < cells[key]:
        cells[key] = found


def joined(left: Cells, right: Cells) -> Cells:
    """The rule A(p, q) -> A(p, r) A(r, q): cells of two neighbouring spans as one."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for (start, q), (more, rest) in right.items():
            if start == r:
                _least(out, (p, q), (cost + more, audit + rest))
    return out


class RepairGrammar:
    """The cells of spans of turns, from those of single turns up."""

    def __init__(self, costs: EditCosts):
        # Insertion closure: what inserted turns alone can do, the empty span included.
        closure: Cells = {(p, p): (0, "") for p in _STATES}
        for _ in _STATES:
            closure = joined(closure, {(p, p): (0, "") for p in _STATES} | {
                (p, q): (costs.insert, "I") for moves in map(_MOVES.get, "ua") for p, q in moves.items()})
        self.closure = closure
        self.known: dict[str, Cells] = {}
        for code in "suaoSUAOx":
            own: Cells = {(p, p): (costs.delete, "D") for p in _STATES}
            if code != "x":  # x: blank and repeated turns can only go
                more = costs.truncated if code.isupper() else 0
                for p, q in _MOVES.get(code.lower(), {}).items():
                    _least(own, (p, q), (more, "K"))
                for p, q in (move for role in "ua" for move in _MOVES[role].items()):
                    _least(own, (p, q), (more + costs.rerole, "R"))
            self.known[code] = joined(joined(closure, own), closure)

    def cells(self, codes: str) -> Cells:
        """The cells of a span, bottom-up by span length: 1, 2, 4, ...

        A chart keeps, for each span and nonterminal, the least (cost, audit) over all splits. As
        nonterminals are pairs of states, every split of a span gives the same cells, so one
        split a span is enough and n - 1 spans are built instead of n^2. (Among equal costs no
        audit is a prefix of another, so the least one of a span is made of least ones.)
        """
        if not codes:
            return self.closure
        found = self.known.get(codes)
        if found is None:
            spans = [self.known[c] for c in codes]
            while len(spans) > 1:
                pairs = zip(spans[::2], spans[1::2])
                spans = [joined(*pair) for pair in pairs] + (spans[-1:] if len(spans) % 2 else [])
            found = spans[0]
            if len(codes) <= 16 and len(self.known) < 100_000:
                self.known[codes] = found
        return found


def steps(state: int, audit: str, codes: str):
    """(place of the turn or None, edit, new role or None) for each edit of a span that begins in
    `state`. The edits decide the roles: a kept turn has its own, the others follow the state."""
    place = 0
    for edit in audit:
        role = None
        if edit in "RI":
            role = "a" if state == 2 else "u"
            state = _MOVES[role][state]
        elif edit == "K":
            state = _MOVES[codes[place].lower()][state]
        yield (None if edit == "I" else place), edit, _NAMES.get(role)
        place += edit != "I"


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 the turn is lost, 1 its
    text is empty, 2 it has no `.!?`, 3 it comes twice, 4 it is a user's. Nulls count as a space."""
    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(F.col("code") == 1, "").when(
        F.col("code") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text"))
    return (turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"),
                         code.alias("code")).where("code <> 0")
            .withColumn("text", text)
            .withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(
                F.col("code") == 3, 2).otherwise(1)))).drop("code", "copy"))


def _turn_rows(turns: DataFrame) -> DataFrame:
    """The columns that are read, with a digest of the text and one of the whole row."""
    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        name("role").alias("role"), name("text").alias("text"))
    rows = rows.withColumn("text_key", F.sha2("text", 256))
    whole = F.concat(name("conv_id"), F.lit(":"), name("turn"), F.lit(":"), "text_key", F.lit(":"), "role")
    return rows.withColumn("text_key", F.unhex("text_key")).withColumn("row_key", F.unhex(F.sha2(whole, 256)))


def turn_faults(turns: DataFrame) -> DataFrame:
    """One row per turn, without its text: conv_id, turn, role, text_key, row_key, copy (1, 2, ... for
    equal turns of the same number) and fault (blank, duplicate, truncated or null, the first)."""
    rows = _turn_rows(turns)
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    equal = stored(rows.select(
        "conv_id", "turn", "role", "text_key", "row_key", (last == "").alias("blank"),
        (~last.isin(*_ENDS)).alias("truncated")).groupBy(
        "conv_id", "turn", "role", "text_key", "row_key", "blank", "truncated").agg(
        F.count("*").alias("copies")), "turns")
    # The earliest turn with the same role and text; a turn without number is the earliest.
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    first = equal.groupBy(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias(
        "unnamed"), "role", "text_key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(
        "n > 1").drop("n")
    keyed = equal.withColumn("conv", F.coalesce("conv_id", F.lit(0))).withColumn(
        "unnamed", F.col("conv_id").isNull()).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    found = attached(keyed, first, ["conv", "unnamed", "role", "text_key"], ["turn", "copy"], "left")
    seen = (F.col("copy") > 1) | F.coalesce(F.col("first") < place, F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("truncated"), "truncated")
    return found.select("conv_id", "turn", "role", "text_key", "row_key", "copy", fault.alias("fault"))


_SEGMENTS = ("conv_id long, segment long, blank long, duplicate long, truncated long, illegal long, "
             "first string, last string, codes string, turns array<long>, keys array<binary>, "
             "roles array<string>, cells array<struct<p int, q int, cost long, audit string>>")
_PAIRS = ("su", "ua", "au")


def _segment_task(costs: EditCosts):
    """Segments of neighbouring turns of one conversation, from rows in order."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
        ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
        ("codes", pa.string()), ("turns", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary())),
        ("roles", pa.list_(pa.string())), ("cells", pa.list_(pa.struct([
            ("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

    def task(batches: Batches) -> Batches:
        grammar = RepairGrammar(costs)
        number = TaskContext.get().partitionId() << 32

        def segment(rows: list[tuple]) -> tuple:
            faults = [r[4] for r in rows]
            initials = [r[2][:1] for r in rows]
            codes = "".join(
                "x" if f in ("blank", "duplicate") else c.upper() if f == "truncated" else c
                for f, c in zip(faults, (i if i in _MOVES else "o" for i in initials)))
            cells = [{"p": p, "q": q, "cost": c, "audit": a}
                     for (p, q), (c, a) in grammar.cells(codes).items()]
            return (rows[0][0], number, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"),
                    sum(a + b not in _PAIRS for a, b in zip(initials, initials[1:])),
                    initials[0], initials[-1], codes, [r[1] for r in rows], [r[3] for r in rows],
                    [r[2] for r in rows], cells)

        held: list[tuple] = []
        for some in slices(batches, 1 << 20):
            out = []
            for row in zip(*(c.to_pylist() for c in some.columns)):
                if held and (held[0][0] != row[0] or len(held) == costs.segment):
                    out.append(segment(held))
                    number, held = number + 1, []
                held.append(row)
            if out:
                yield batch(schema, *(list(c) for c in zip(*out)))
        if held:
            yield batch(schema, *([c] for c in segment(held)))

    return task


def segments(faults: DataFrame, costs: EditCosts) -> DataFrame:
    """The turns in order of conversation, number, role and text, in segments with their cells.

    The order is one of ranges, so a conversation of any length is dealt over tasks.
    """
    order = ["conv_id", "turn", "role", "text_key", "copy"]
    ranged = faults.repartitionByRange(partitions(faults.sparkSession), *order).sortWithinPartitions(*order)
    return mapped(ranged.select("conv_id", "turn", "role", "row_key", "fault"), _segment_task(costs), _SEGMENTS)


_CONVERSATIONS = ("conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, "
                  "picks array<struct<segment long, state int, audit string>>")


def _parse_task(batches: Batches) -> Batches:
    """The segments of a conversation, in order: the way through their cells from the first state."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64()), ("cost", pa.int64()), ("picks", pa.list_(pa.struct([
            ("segment", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])))])
    conv, totals, last, best = None, None, "", {}

    def parsed() -> pa.RecordBatch:
        cost, _, way = min((v for q, v in best.items() if q in _FINAL), key=lambda v: v[:2])
        picks = []
        while way is not None:
            way, (segment, state, audit) = way
            picks.append({"segment": segment, "state": state, "audit": audit})
        return batch(schema, [conv], *([t] for t in totals), [cost], [picks[::-1]])

    for some in slices(batches, 1 << 20):
        for row in some.to_pylist():
            if totals is None or row["conv_id"] != conv:
                if totals is not None:
                    yield parsed()
                conv, totals, last, best = row["conv_id"], [0, 0, 0, 0], None, {0: (0, "", None)}
            for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
                totals[i] += row[name]
            totals[3] += last is not None and last + row["first"] not in _PAIRS
            last, after = row["last"], {}
            for cell in row["cells"]:
                if cell["p"] in best:
                    cost, audit, way = best[cell["p"]]
                    found = (cost + cell["cost"], audit + cell["audit"])
                    if cell["q"] not in after or found < after[cell["q"]][:2]:
                        after[cell["q"]] = (*found, (way, (row["segment"], cell["p"], cell["audit"])))
            best = after
    if totals is not None:
        yield parsed()


def _step_task(batches: Batches) -> Batches:
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("place", pa.int64()),
                        ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()),
                        ("row_key", pa.binary())])
    for some in slices(batches, 1 << 20):
        out = []
        for row in some.to_pylist():
            for at, (place, edit, role) in enumerate(steps(row["state"], row["audit"], row["codes"])):
                if place is None:
                    out.append((row["conv_id"], row["segment"], at, edit, None, role, None))
                else:
                    out.append((row["conv_id"], row["segment"], at, edit, row["turns"][place],
                                role or row["roles"][place], row["keys"][place]))
        if out:
            yield batch(schema, *(list(c) for c in zip(*out)))


def repair_conversations(turns: DataFrame, costs: EditCosts | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations and edits: what is wrong with each conversation, and what makes it right.

    `turns` has conv_id, turn, role and text; a conversation's turns count in the order of turn
    (nulls first), then role, then the text's digest. A turn's first fault counts: blank, duplicate
    (role and text seen earlier), truncated (no end of sentence). Blank and duplicate turns are
    deleted; others are kept, deleted or given another role, and empty turns may be inserted, so
    that the initials of the roles are `(s?(ua)+)?` at the least cost; of equally cheap repairs that
    whose edits' initials come first.

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal (neighbouring roles that
    are not su, ua or au), cost, audit. Edits: conv_id, segment, place (order of a conversation),
    edit (K, R, D, I), turn, role (after the edit), text (null for a deleted turn).

    Texts do not take part in the parse: it reads digests, in segments of neighbouring turns, whose
    cells are joined in order for each conversation. Texts meet the edits at the end. A
    conversation's audit is one value, so it must fit a row; its turns need not fit a task.

    Null roles and texts count as one space, a null conv_id is a conversation, null turns come
    first. Equal rows are repeated turns. Roles other than system, user and assistant count by their
    first character. Other columns are not read; empty tables give empty ones.
    """
    costs = costs or EditCosts()
    faults = stored(turn_faults(turns), "turn-faults")
    parts = stored(segments(faults, costs), "turn-segments")
    cells = parts.select("conv_id", "segment", "blank", "duplicate", "truncated", "illegal", "first", "last", "cells")
    ordered = cells.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "segment")
    parsed = stored(mapped(ordered, _parse_task, _CONVERSATIONS), "turn-parses")
    numbered = faults.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    conversations = parsed.alias("p").join(
        numbered.alias("n"), F.expr("p.conv_id <=> n.conv_id")).select(
        "p.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("picks", lambda x: x["audit"]), "").alias("audit"))
    picks = parsed.select(F.inline("picks"))
    known = parts.select("conv_id", "segment", "codes", "turns", "keys", "roles")
    edits = mapped(known.join(picks, "segment").select(
        "conv_id", "segment", "codes", "turns", "keys", "roles", "state", "audit"), _step_task,
        "conv_id long, segment long, place long, edit string, turn long, role string, row_key binary")
    texts = _turn_rows(turns).groupBy("row_key").agg(F.first("text").alias("text"))
    edits = edits.withColumn("row_key", F.when(F.col("edit") != "D", F.col("row_key")))
    there = edits.where(F.col("row_key").isNotNull()).join(texts, "row_key").drop("row_key")
    gone = edits.where(F.col("row_key").isNull()).drop("row_key").withColumn(
        "text", F.when(F.col("edit") == "I", ""))
    return conversations, there.unionByName(gone)


def _digest_task(batches: Batches) -> Batches:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, digest = None, None
    for some in slices(batches):
        done = []
        for row in zip(*(c.to_pylist() for c in some.columns)):
            if digest is None or row[0] != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = row[0], hashlib.sha256(row[1].encode())
            else:
                digest.update(b"\n" + row[1].encode())
        if done:
            yield batch(schema, *(list(c) for c in zip(*done)))
    if digest is not None:
        yield batch(schema, [conv], [digest.hexdigest()])


def repaired_digests(edits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the hash of each conversation's lines `role:text` after the
    repair. A conversation's hash is one sequence, read in order and not held."""
    lines = edits.where("edit <> 'D'").select(
        "conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "segment", "place")
    ordered = lines.repartition(partitions(edits.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "segment", "place")
    return mapped(ordered.select("conv_id", "line"), _digest_task, "conv_id long, repaired_sha256 string")
