"""Cheapest repair of a conversation's structure, by weighted CYK parsing over intervals of its rows.

The language of good conversations is ``(s?(ua)+)?`` over the initials of roles.
Its grammar in Chomsky normal form has a nonterminal ``<p,q>`` for what leads from state
``p`` to state ``q``: ``<p,q>`` becomes ``<p,r> <r,q>``, or one row's edit. A cell of an interval holds, for each
nonterminal, the least ``(cost, audit)``: what the cheapest edits cost, and their initials. Insertions need no row;
their closure, cheapest ways from state to state by insertions only, is joined to the cell of every row.

Cells are combined bottom-up by interval length, all splits of every interval, within blocks of up to ``BLOCK``
neighbours. The cells of blocks are the rows of the next round, in blocks again, so that
a long conversation is spread over tasks and takes one round for each factor of ``BLOCK`` in its length.
Taking the least is safe in any cell: of two audits of one cell and cost neither begins the other, since both have
one letter per row besides insertions and each insertion costs; so what follows cannot turn their order.

An audit tells the repaired rows: after a kept ``s``, if any, the roles take turns, whatever they were.

Defined cases: null roles and texts are one space, and so are null ids and turns in the checksum. Rows of one turn are ordered by role and
text. A role without a first letter has an initial that is never legal. A null ``conv_id`` is a conversation like others. Rows that repeat
are duplicates. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scoreloom.llm.common import stored, whole_groups

BLOCK = 16
# Costs of the edits, and of a truncated row that is not deleted.
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# The states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GOOD = (START, ASSISTANT)
_WHITE = r"[\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copy)``: rows dropped, emptied, stripped of ends, repeated or given to the user by a checksum of id and turn."""
    spell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spell("conv_id"), F.lit(":"), spell("turn")), "UTF-8")) % 20
    text, copies = spell("text"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(spell("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` in order: place ``i`` from 0, first ``fault`` or null, and whether the row may not follow the one before (``illegal``)."""
    rows = rows.withColumns(
        {
            "initial": F.substring("role", 1, 1),
            "_said": F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256),
            "_end": F.right(F.regexp_replace("text", f"{_WHITE}+\\z", ""), F.lit(1)),
        }
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "_said").orderBy("i")
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    placed = rows.select("*", (F.row_number().over(order) - 1).cast("long").alias("i"), pair.alias("_pair"))
    fault = (
        F.when(F.col("_end") == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.col("_end").isin(".", "!", "?"), "truncated")
    )
    illegal = (F.col("i") > 0) & ~F.col("_pair").isin("su", "ua", "au")
    return placed.select("conv_id", "turn", "role", "text", "initial", "i", fault.alias("fault"), illegal.alias("illegal"))


def _join(left: dict, right: dict, best: dict) -> None:
    """Take the rule ``<p,q>`` to ``<p,r> <r,q>`` on the cells of two intervals that meet, keeping the least in ``best``."""
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                total = cost + more
                now = best.get((p, q))
                if now is None or total < now[0] or (total == now[0] and audit + rest < now[1]):
                    best[p, q] = total, audit + rest


@functools.cache
def insertions() -> dict:
    """The closure over insertions: the fewest that lead from one state to another, none included."""
    cell = {(p, p): (0, "") for p in range(4)}
    step = {(p, q): (INSERT, "I") for (p, letter), q in MOVES.items() if letter != "s"}
    for _ in range(4):
        _join(dict(cell), step, cell)
    return cell


@functools.cache
def row_cell(initial: str, fault: str | None) -> dict:
    """The cell of one row: it is kept, given the role that comes next, or deleted, with insertions before and after."""
    edits = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault else 0
        for (p, letter), q in MOVES.items():
            if letter != "s":
                edits[p, q] = RELABEL + more, "R"
            if letter == initial:
                edits[p, q] = more, "K"
    before, cell = {}, {}
    _join(insertions(), edits, before)
    _join(before, insertions(), cell)
    return cell


def parse(cells: list[dict]) -> dict:
    """The cell of all of ``cells``, by CYK: intervals by length, each from all its splits."""
    count = len(cells)
    chart = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, count + 1):
        for i in range(count - length + 1):
            best = chart[i, i + length] = {}
            for k in range(i + 1, i + length):
                _join(chart[i, k], chart[k, i + length], best)
    return chart[0, count]


def _row_cells(batch, start, end):
    initials, faults = batch.column("initial"), batch.column("fault")
    pairs = zip(initials.slice(start, end - start).to_pylist(), faults.slice(start, end - start).to_pylist())
    # Other initials than these are never legal, so all of them share a cell.
    return [row_cell(a if a in ("s", "u", "a") else "", fault) for a, fault in pairs]


def _block_cells(batch, start, end):
    return [{(e["p"], e["q"]): (e["cost"], e["audit"]) for e in cell} for cell in batch.column("cell").slice(start, end - start).to_pylist()]


def _parsed(read, conv_type: pa.DataType):
    kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("conv_id", conv_type), ("i", pa.int64()), ("cell", kind)])

    def body(batches):
        for batch, bounds in whole_groups(batches, ["none", "conv", "block"]):
            cells = []
            for start, end, _ in bounds:
                cell = parse(read(batch, start, end))
                cells.append([{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in sorted(cell.items())])
            firsts = pa.array([start for start, _, _ in bounds])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(firsts), batch.column("block").take(firsts), pa.array(cells, kind)], schema=schema
            )

    return body


def _named(rows: DataFrame) -> DataFrame:
    """Adds the id as text, and whether it is null: ids may be of any kind."""
    return rows.withColumns({"none": F.col("conv_id").isNull(), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows dealt out and sorted by block."""
    dealt = _named(rows).withColumn("block", F.floor(F.col("i") / block))
    return dealt.repartition("conv", "block").sortWithinPartitions("none", "conv", "block", "i")


def cheapest_edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, cost, audit)`` for each conversation of ``rows(conv_id, i, initial, fault)``."""
    conv = rows.schema["conv_id"].dataType
    schema = f"conv_id {conv.simpleString()}, i long, cell array<struct<p:int,q:int,cost:bigint,audit:string>>"
    last = rows.agg(F.max("i")).first()[0]
    now = _blocks(rows.select("conv_id", "i", "initial", "fault"), block).mapInArrow(_parsed(_row_cells, to_arrow_type(conv)), schema)
    last = (last or 0) // block
    while last:
        now = _blocks(stored(now, "cells"), block).mapInArrow(_parsed(_block_cells, to_arrow_type(conv)), schema)
        last //= block
    ends = F.filter("cell", lambda e: (e["p"] == START) & e["q"].isin(*GOOD))
    best = F.array_min(F.transform(ends, lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"))))
    return now.select("conv_id", best.alias("best")).select("conv_id", "best.cost", "best.audit")


def _repaired(conv_type: pa.DataType):
    """Hash of the repaired rows: reads a conversation's audit, then its rows one after the other."""
    schema = pa.schema([("conv_id", conv_type), ("repaired_sha256", pa.string())])

    def body(batches):
        digest = audit = None
        key, at, first, user, of = None, 0, True, True, []

        def say(role, text):
            nonlocal first
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False

        def edits(row):
            """Insertions up to the next row, and with ``row`` its own edit."""
            nonlocal at, user
            while at < len(audit) and (audit[at] == "I" or row is not None):
                letter, at = audit[at], at + 1
                if letter == "K" and row[0][:1] == "s":
                    say(*row)
                elif letter != "D":
                    role = "user" if user else "assistant"
                    user = not user
                    say(row[0] if letter == "K" else role, "" if letter == "I" else row[1])
                if letter != "I":
                    return

        def given():
            edits(None)
            return pa.RecordBatch.from_arrays([pa.array([of], conv_type), pa.array([digest.hexdigest()])], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("none", "conv", "conv_id", "audit", "role", "text")]
            for none, conv, conv_id, found, role, text in zip(*columns):
                if key != (none, conv):
                    if key is not None:
                        yield given()
                    key, of, audit, digest, at, first, user = (none, conv), conv_id, found, hashlib.sha256(), 0, True, True
                else:
                    edits((role, text))
        if key is not None:
            yield given()

    return body


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["conv_id"].eqNullSafe(right["_conv"])


def repair_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of ``conversations(conv_id, turn, role, text)``: its faults after damage and its cheapest repair."""
    slim = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = stored(with_faults(damaged(slim)), "rows")
    found = stored(cheapest_edits(rows, block), "edits")
    kind = rows.schema["conv_id"].dataType
    said = found.select("conv_id", F.lit(-1).cast("long").alias("i"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = said.unionByName(rows.select("conv_id", "i", F.lit(None).cast("string").alias("audit"), "role", "text"))
    hashed = (
        _named(lines).repartition("conv").sortWithinPartitions("none", "conv", "i")
        .mapInArrow(_repaired(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, repaired_sha256 string")
    )
    count = lambda condition: F.count_if(condition).alias
    turn = F.col("turn")
    faults = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == name)(name) for name in ("blank", "duplicate", "truncated")],
        count(F.col("illegal"))("illegal"),
    )
    out = slim.select("conv_id").distinct()
    for part in (faults, found, hashed):
        named = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(named, _same(out, named), "left").drop("_conv")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select(
        "conv_id",
        *[column.alias(c) for c, column in zeros.items()],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
