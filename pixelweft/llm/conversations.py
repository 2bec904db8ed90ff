"""Repair of the structure of conversations by iterative-deepening A*.

A conversation, in the order of its turns, is to become the roles ``(system)? (user assistant)+``, or nothing, by the
cheapest edits: each row is kept, given another role or deleted, and rows may be inserted. The search goes depth first through the edits in
the order of their initials (D, I, K, R) under a bound on the cost; the first path that it accepts is the
answer, the cheapest and among those the least in ASCII order. If a bound fails, the next is the least cost that it has shown to be possible. What is
left of a conversation is known by how many rows are done and the last role, and each such state remembers how much it has been found to need at least, so it isn't entered again with less.

Conversations of up to ``SPAN`` rows are searched at once. A longer one, whatever its length, is cut into stretches, which are searched
apart for each pair of roles before and after them, and put together again, sixteen at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.llm.common import durable, scratch, small_batches
from pixelweft.operators.ranking import ranked

#: Rows of a stretch that is searched at once, and stretches that are put together at once.
SPAN, FAN = 64, 16
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: The last role so far, and a role's class by its initial: system, user, assistant, any other.
NONE, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
OTHER = 4
DELETE, INSERT, REROLE, SHORT = 4, 3, 3, 3
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEVER = 1 << 60
SPACE = " \t\n\x0b\f\r"


def moves(rows: list[int], i: int, last: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits from here in the order of their initials: (initial, cost, rows done, last role). ``rows`` holds ``class * 4 + fault``."""
    more = ASSISTANT if last == USER else USER
    if i < len(rows):
        yield "D", DELETE, i + 1, last
    yield "I", INSERT, i, more
    if i < len(rows):
        kind, fault = divmod(rows[i], 4)
        if fault not in (BLANK, DUPLICATE):
            short = SHORT * (fault == TRUNCATED)
            if kind in NEXT[last]:
                yield "K", short, i + 1, kind
            yield "R", REROLE + short, i + 1, more


def repair(rows: list[int], first: int = NONE, goals: tuple[int, ...] = (NONE, ASSISTANT), needs: dict | None = None) -> tuple[int, str] | None:
    """The least cost and the audit of the edits that lead from the role ``first`` to one of ``goals``, None if there is no way.

    ``needs`` may be shared by searches of the same rows and goals.
    """
    if goals == (NONE,) and first != NONE or goals == (SYSTEM,) and first != SYSTEM and (first != NONE or not any(r // 4 == SYSTEM and r % 4 in (0, TRUNCATED) for r in rows)):
        return None
    least = [0]
    for r in reversed(rows):  # what each row costs at least, whatever its neighbours
        kind, fault = divmod(r, 4)
        least.append(least[-1] + (DELETE if fault in (BLANK, DUPLICATE) else SHORT if fault == TRUNCATED else REROLE if kind == OTHER else 0))
    least.reverse()
    needs = {} if needs is None else needs
    need = lambda i, last: needs.get((i, last), least[i])
    bound = need(0, first)
    while bound < NEVER:
        # of each state on the path: rows done, last role, what may still be spent, edits to come, least need of those that failed
        path = [[0, first, bound, moves(rows, 0, first), NEVER]]
        edits: list[str] = []
        while path:
            i, last, left, ways, _ = path[-1]
            if i == len(rows) and last in goals:
                return bound - left, "".join(edits)
            for edit, cost, j, now in ways:
                if cost + need(j, now) <= left:
                    edits.append(edit)
                    path.append([j, now, left - cost, moves(rows, j, now), NEVER])
                    break
                path[-1][4] = min(path[-1][4], cost + need(j, now))
            else:
                needs[i, last] = max(need(i, last), path.pop()[4])
                if path:
                    edits.pop()
                    spent = path[-1][2] - left
                    path[-1][4] = min(path[-1][4], spent + needs[i, last])
        bound = need(0, first)
    return None


def ways_through(rows: list[int]) -> tuple[list[int], list[str]]:
    """Of each pair of roles before and after a stretch: the least cost (-1: no way) and its audit."""
    costs, audits = [-1] * 16, [""] * 16
    for goal in range(4):
        needs: dict = {}
        for first in range(4):
            found = repair(rows, first, (goal,), needs)
            if found:
                costs[first * 4 + goal], audits[first * 4 + goal] = found
    return costs, audits


def joined(a: tuple[list[int], list[str]], b: tuple[list[int], list[str]]) -> tuple[list[int], list[str]]:
    costs, audits = [-1] * 16, [""] * 16
    for first in range(4):
        for goal in range(4):
            ways = [(a[0][first * 4 + mid] + b[0][mid * 4 + goal], a[1][first * 4 + mid] + b[1][mid * 4 + goal]) for mid in range(4) if a[0][first * 4 + mid] >= 0 and b[0][mid * 4 + goal] >= 0]
            if ways:
                costs[first * 4 + goal], audits[first * 4 + goal] = min(ways)
    return costs, audits


def _illegal(a: int, b: int) -> bool:
    return (a, b) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _search(span: int):
    """Stretches of role classes and faults to (illegal neighbours, first and last class, costs, audits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, codes in zip(batch.column("part").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                kinds = [c // 4 for c in codes]
                illegal = sum(_illegal(a, b) for a, b in zip(kinds, kinds[1:], strict=False))
                if part == 0 and len(codes) < span:  # the whole conversation
                    cost, audit = repair(codes)
                    costs, audits = [cost], [audit]
                else:
                    costs, audits = ways_through(codes)
                out.append((illegal, kinds[0], kinds[-1], costs, audits))
            columns = [pa.array([o[n] for o in out], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), *columns], ["conv", "part", "illegal", "first", "last", "costs", "audits"])

    return run


def _put_together(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    illegal, last, way = 0, None, None
    for r in rows.itertuples():
        illegal += r.illegal + (last is not None and _illegal(last, r.first))
        last = r.last
        one = (list(r.costs), list(r.audits))
        way = one if way is None else joined(way, one)
    out = rows.iloc[:1].copy()
    out["part"] //= FAN
    out["illegal"], out["last"] = illegal, last
    out["costs"], out["audits"] = [way[0]], [way[1]]
    return out


def faults(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, at, turn, role, text, kind, fault): place in the conversation from 1, class of the role's initial, and the first fault: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    x = rows.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    x = x.withColumn("_n", F.monotonically_increasing_id())  # so that equal rows are dealt to several tasks too
    x = ranked(x, ["conv"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("_n")], "at").drop("_n")
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    x = x.withColumns({"kind": kind, "same": F.sha2("text", 256), "blank": stripped == "", "whole": F.substring(stripped, -1, 1).isin(".", "!", "?")})
    seen = x.groupBy("conv", "role", "same").agg(F.min("at").alias("seen_at"))
    a, b = x.alias("a"), seen.alias("b")
    met = a.join(b.hint("merge"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.same") == F.col("b.same")))
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("seen_at"), DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(0)
    return met.select("a.conv", "at", "turn", "a.role", "text", "kind", fault.alias("fault"))


def audits(faulty: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each conversation of ``faults``: conv, illegal, cost, audit."""
    small_batches(faulty.sparkSession)
    key = faulty.schema["conv"].dataType.simpleString()
    # few bytes and much to do: a number of partitions, so that they aren't put together by size
    n = int(faulty.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = faulty.select("conv", "at", "kind", "fault", F.expr(f"(at - 1) div {span}").alias("part")).repartition(n, "conv", "part").groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("kind") * 4 + F.col("fault")).alias("code")))).alias("c"))
    schema = f"conv {key}, part long, illegal long, first int, last int, costs array<long>, audits array<string>"
    x = durable(parts.select("conv", "part", F.col("c.code").alias("codes")).mapInArrow(_search(span), schema), "stretches")
    done = x.where("size(costs) = 1").select("conv", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    long = x.where("size(costs) > 1")
    while (long.agg(F.max("part")).first()[0] or 0) > 0:
        long = durable(long.groupBy("conv", F.expr(f"part div {FAN}").alias("group")).applyInPandas(lambda k, rows: _put_together(rows), schema), "stretches")
    way = F.expr("case when costs[0] < 0 or (costs[3] >= 0 and (costs[3] < costs[0] or (costs[3] = costs[0] and audits[3] < audits[0]))) then 3 else 0 end")
    return done.unionByName(long.select("conv", "illegal", F.get("costs", way).alias("cost"), F.get("audits", way).alias("audit")))


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv, at, role, text), each conversation's audit (at 0) before its own, to (conv, role, text, edit); and (conv, None, None, "") when one is done."""
    conv, audit, at, last, open_ = None, "", 0, NONE, False

    def inserted():
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            at, last = at + 1, ASSISTANT if last == USER else USER
            yield conv, "assistant" if last == ASSISTANT else "user", "", "I"

    for c, n, role, text in rows:
        if n == 0:
            if open_:
                yield from inserted()
                yield conv, None, None, ""
            conv, audit, at, last, open_ = c, text, 0, NONE, True
            continue
        yield from inserted()
        edit = audit[at]
        at += 1
        if edit == "K":
            last = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield conv, role, text, edit
        elif edit == "R":
            last = ASSISTANT if last == USER else USER
            yield conv, "assistant" if last == ASSISTANT else "user", text, edit
    if open_:
        yield from inserted()
        yield conv, None, None, ""


def _in_order(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit and then its rows in order, in one partition: the text of a repaired conversation is a sequence. A row is held at a time, and the audit."""
    heads = found.select("conv", F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return faulty.select("conv", F.col("at").cast("long").alias("at"), "role", "text").unionByName(heads).repartition("conv").sortWithinPartitions("conv", "at")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv", "at", "role", "text")), strict=True)


def repaired_rows(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: rows (conv, place from 1, role, text, edit)."""
    kind = faulty.schema["conv"].dataType
    schema = f"conv {kind.simpleString()}, place long, role string, text string, edit string"

    def run(batches):
        out, size, place = [], 0, 0
        for conv, role, text, edit in _edited(_stream(batches)):
            if role is None:
                place = 0
                continue
            place += 1
            out.append((conv, place, role, text, edit))
            size += len(text) + 64
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], arrow)

    names = ["conv", "place", "role", "text", "edit"]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([("conv", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return _in_order(faulty, found).mapInArrow(run, schema)


def digests(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (conv, repaired_sha256): of ``role:text``, joined by newlines. Texts are hashed as they come."""
    kind = faulty.schema["conv"].dataType

    def run(batches):
        convs, hashes, h, some = [], [], hashlib.sha256(), False
        for conv, role, text, _ in _edited(_stream(batches)):
            if role is not None:
                h.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True
                continue
            convs.append(conv), hashes.append(h.hexdigest())
            h, some = hashlib.sha256(), False
            if len(convs) == 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(convs, to), pa.array(hashes)], ["conv", "repaired_sha256"])
                convs, hashes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(convs, to), pa.array(hashes, pa.string())], ["conv", "repaired_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    to = to_arrow_type(kind)
    return _in_order(faulty, found).mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A report for each conversation, its audits, and its rows with their faults.

    The report: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit. ``repaired_rows`` and ``digests`` take the other two.

    Rows go by turn, missing turns first; rows of one turn by role and text. Null roles and texts count as one space, so that a null text is blank and
    a null role is no role; rows without a conversation's id are a conversation of their own. Roles are told by their first letter. A row that equals an
    earlier one in role and text is a duplicate, whatever their turns. Conversations may have any number of rows. An empty table gives empty results. Other columns are ignored.
    """
    with scratch() as keep:
        faulty = keep(durable(faults(rows, conv_id, turn, role, text), "faults"))
        found = keep(durable(audits(faulty, span), "audits"))
    turns = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
    n = lambda f: F.count_if(F.col("fault") == f)
    sums = faulty.groupBy("conv").agg(F.coalesce(turns, F.lit(0)).try_cast("long").alias("gaps"), n(BLANK).alias("blank"), n(DUPLICATE).alias("duplicate"), n(TRUNCATED).alias("truncated"))
    report = sums.alias("a").join(found.alias("b").hint("merge"), F.col("a.conv").eqNullSafe(F.col("b.conv"))).select("a.*", "illegal", "cost", "audit")
    return report, found, faulty
