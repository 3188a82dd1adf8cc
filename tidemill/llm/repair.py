r"""Conversation repair: the cheapest edits that bring a damaged conversation back to user and assistant in turn.

A conversation is walked row by row. A macro edit is a run of insertions and what happens to the row
after it: ``I*`` then keep (K), rerole (R) or delete (D). These codes are free of prefixes, so the edit
strings of one layer are ordered by the rank of what they continue and then by their code: a layer holds,
for each state of the grammar, a cost and a rank instead of a string, and each row a pointer to its parent
and a code, from which the string is rebuilt at the end. Layers are kept relative to their least cost, so few
differ and each step is worked out once.

A conversation of over LONG_ROWS rows is cut into blocks of sorted rows. A block is summed up as the cost and
rank of each way through it, for each state in which it can be entered; the summaries, a row for each
conversation and block, are combined by the same rule, and each block then writes its own edits. So
no task reads a whole long conversation but the one that hashes its text, which it reads as a stream.

Defined cases: null role and text are one space; rows of one turn are ordered by role, then text, null turns first;
rows with a null conv_id make one conversation; a role whose first letter is none of s, u and a fits nowhere and is
reroled or deleted; an empty table gives no rows; other columns are ignored, whatever their names. Repeated rows
are duplicates. A text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE, by_key, frequent, stable, table

#: Rows from which a conversation is worked on in blocks; the result is the same.
LONG_ROWS = 50_000
#: Long conversations whose ids are broadcast at most; above, Spark joins them by shuffle.
BROADCAST_IDS = 10_000
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: state -> initial of the next role -> state
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What an insertion or a new role is in a state, and what ends a conversation there.
NEEDED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _after(state: int, inserted: int) -> int:
    for _ in range(inserted):
        state = GRAMMAR[state][NEEDED[state][0]]
    return state


@lru_cache(maxsize=None)
def macros(state: int, kind: tuple[str, bool, bool]) -> tuple[tuple[str, int, int], ...]:
    """(code, cost, next state) of the macro edits at a row; three insertions in a run hold two that can be left out."""
    initial, must_go, cut = kind
    out = []
    for run in range(3):
        at, paid = _after(state, run), INSERT * run
        out.append(("I" * run + "D", paid + DELETE, at))
        if not must_go:
            paid += TRUNCATED * cut
            if initial in GRAMMAR[at]:
                out.append(("I" * run + "K", paid, GRAMMAR[at][initial]))
            out.append(("I" * run + "R", paid + REROLE, GRAMMAR[at][NEEDED[at][0]]))
    return tuple(out)


def _settle(found: list[tuple[int, int, object, int, int]]) -> tuple[int, tuple, tuple]:
    """Of candidates (cost, rank of the parent, code, parent, next state) the best for each state:
    least cost, the layer (cost above it, rank) and the pointers (parent, code)."""
    best: dict[int, tuple] = {}
    for c in found:
        if c[4] not in best or c < best[c[4]]:
            best[c[4]] = c
    least = min(c[0] for c in best.values())
    rank = {state: i for i, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    layer = tuple((best[s][0] - least, rank[s]) if s in best else None for s in STATES)
    return least, layer, tuple((best[s][3], best[s][2]) if s in best else None for s in STATES)


@lru_cache(maxsize=100_000)
def step(layer: tuple, kind: tuple[str, bool, bool]) -> tuple[int, tuple, tuple]:
    return _settle([(at[0] + paid, at[1], code, s, to) for s, at in enumerate(layer) if at for code, paid, to in macros(s, kind)])


def entered(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in STATES)


def closed(layer: tuple) -> tuple[int, int]:
    """Cost above the layer's least and state of the best ending."""
    cost, _, state = min((at[0] + INSERT * len(CLOSING[s]), at[1], s) for s, at in enumerate(layer) if at)
    return cost, state


def forward(kinds: list, state: int) -> tuple[int, tuple, list]:
    """Least cost, last layer and the pointers of each row."""
    total, layer, back = 0, entered(state), []
    for kind in kinds:
        least, layer, pointers = step(layer, kind)
        total += least
        back.append(pointers)
    return total, layer, back


def codes(back: list, state: int) -> list[str]:
    out = []
    for pointers in reversed(back):
        state, code = pointers[state]
        out.append(code)
    return out[::-1]


def applied(rows: list[tuple[str, str]], edits: list[str], state: int) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) of rows edited from a state on; the last code may be without a row."""
    for i, code in enumerate(edits):
        for e in code:
            if e == "D":
                continue
            role, text = ("", "") if e == "I" else rows[i]
            role = role if e == "K" else NEEDED[state]
            state = GRAMMAR[state][role[0]]
            yield role, text


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def fault(text: str, seen_before: bool) -> str:
    bare = text.rstrip(SPACE)
    return "blank" if not bare else "duplicate" if seen_before else "truncated" if bare[-1] not in ".!?" else ""


def kinds_of(rows: list[tuple[str, str]], faults: list[str]) -> list[tuple[str, bool, bool]]:
    return [(_initial(r), f in ("blank", "duplicate"), f == "truncated") for (r, _), f in zip(rows, faults)]


def mended(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple[dict, list[tuple[str, str]]]:
    """The report of one conversation, rows in order, and its repaired rows."""
    seen: set = set()
    faults = []
    for row in rows:
        faults.append(fault(row[1], row in seen))
        seen.add(row)
    kinds = kinds_of(rows, faults)
    total, layer, back = forward(kinds, START)
    more, state = closed(layer)
    edits = codes(back, state) + [CLOSING[state]]
    known = {t for t in turns if t is not None}
    initials = [r[:1] for r, _ in rows]
    report = {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])),
        "cost": total + more, "audit": "".join(edits),
    }
    return report, list(applied(rows, edits, START))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, role string, text string"
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list, list]]:
    """(conv_id, turns, rows) of conversations that stand together; a row of n copies is n rows, of none only names its conversation."""
    key, turns, rows, begun = None, [], [], False
    for b in batches:
        for conv, turn, role, text, copies in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
            if begun and conv != key:
                yield key, turns, rows
                turns, rows = [], []
            key, begun = conv, True
            turns += [turn] * copies
            rows += [(role, text)] * copies
    if begun:
        yield key, turns, rows


def _digest(lines: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, turns, rows in _conversations(batches):
        report, lines = mended(turns, rows)
        out.append((conv, *(report[c] for c in COUNTS), report["audit"], _digest(lines)))
        if len(out) >= 1000:
            yield _batch(REPORT, out)
            out = []
    yield _batch(REPORT, out)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, turns, rows in _conversations(batches):
        out += [(conv, i, r, t) for i, (r, t) in enumerate(mended(turns, rows)[1])]
        if len(out) >= 1000:
            yield _batch(TURNS, out)
            out = []
    yield _batch(TURNS, out)


# ---- long conversations, in blocks ------------------------------------------------------------------

SUMMARY = "conv string, block long, ways string, blank long, duplicate long, truncated long, illegal long, first string, last string, n long"
PLAN = "conv string, block long, entry long, exit long, closing string, illegal long, cost long"
PIECE = "conv string, block long, audit string, lines string"
BLOCK_TURNS = "conv string, block long, k long, role string, text string"


def _frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return pd.DataFrame(rows, columns=names)


def _parts(g: pd.DataFrame) -> Iterator[tuple[str, int, list[tuple[str, str]], list[str]]]:
    """(conv, block, rows, faults) of the conversations in a block, which is a partition of sorted rows."""
    for conv, c in g.sort_values("pos").groupby("conv", sort=False):
        rows, faults = [], []
        for role, text, copies, again in zip(c["role"], c["text"], c["copies"], c["again"]):
            rows += [(role, text)] * copies
            faults += [fault(text, bool(again) or i > 0) for i in range(copies)]
        if rows:
            yield conv, int(c["block"].iloc[0]), rows, faults


def _summary(g: pd.DataFrame) -> pd.DataFrame:
    """For each conversation of a block: cost and rank of every way from a state to a state, and its counts."""
    out = []
    for conv, block, rows, faults in _parts(g):
        ways = []
        for s in STATES:
            total, layer, _ = forward(kinds_of(rows, faults), s)
            ways.append([at and (total + at[0], at[1]) for at in layer])
        initials = [r[:1] for r, _ in rows]
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, block, json.dumps(ways), *counts, sum(p not in LEGAL for p in zip(initials, initials[1:])), initials[0], initials[-1], len(rows)))
    return _frame(SUMMARY, out)


def _combined(g: pd.DataFrame) -> pd.DataFrame:
    """The way through the blocks of one conversation: a row for each block, however long the conversation."""
    g = g.sort_values("block")
    total, layer, back = 0, entered(START), []
    for ways in map(json.loads, g["ways"]):
        found = [(at[0] + way[0], at[1], way[1], s, to) for s, at in enumerate(layer) if at for to, way in enumerate(ways[s]) if way]
        least, layer, pointers = _settle(found)
        total += least
        back.append(pointers)
    more, state = closed(layer)
    closing, path = CLOSING[state], []
    for pointers in reversed(back):
        path.append((pointers[state][0], state))
        state = pointers[state][0]
    between = sum((a, b) not in LEGAL for a, b in zip(g["last"], g["first"].iloc[1:]))
    rows = [(c, b, *p, "", 0, 0) for c, b, p in zip(g["conv"], g["block"], reversed(path))]
    rows[0] = (*rows[0][:5], between, total + more)
    rows[-1] = (*rows[-1][:4], closing, *rows[-1][5:])
    return _frame(PLAN, rows)


def _edited(g: pd.DataFrame, plan: pd.DataFrame) -> Iterator[tuple[str, int, list[str], list[tuple[str, str]]]]:
    ways = {c: (e, x, z) for c, e, x, z in zip(plan["conv"], plan["entry"], plan["exit"], plan["closing"])}
    for conv, block, rows, faults in _parts(g):
        entry, leave, closing = ways[conv]
        edits = codes(forward(kinds_of(rows, faults), entry)[2], leave) + [closing]
        yield conv, block, edits, list(applied(rows, edits, entry))


def _pieces(g: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    return _frame(PIECE, [(c, b, "".join(e), "".join(f"{r}:{t}\n" for r, t in lines)) for c, b, e, lines in _edited(g, plan)])


def _block_turns(g: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    return _frame(BLOCK_TURNS, [(c, b, k, r, t) for c, b, _, lines in _edited(g, plan) for k, (r, t) in enumerate(lines)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each conversation over its pieces, which come in order; the last line's end does not count."""
    key, sha, held = None, hashlib.sha256(), ""

    def done() -> pa.RecordBatch:
        sha.update(held.removesuffix("\n").encode())
        return pa.RecordBatch.from_pydict({"conv": [key], "repaired_sha256": [sha.hexdigest()]})

    for b in batches:
        for conv, lines in zip(b.column("conv").to_pylist(), b.column("lines").to_pylist()):
            if conv != key and key is not None:
                yield done()
                sha, held = hashlib.sha256(), ""
            key = conv
            if lines:
                sha.update(held.encode())
                held = lines
    if key is not None:
        yield done()


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Sorted rows with block, position and whether the role and text stand earlier in the conversation."""
    blocks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).filter("copies > 0")
    merged = named.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies"))
    turn = F.asc_nulls_first("turn")
    cut = merged.repartitionByRange(blocks, "conv", turn, "role", F.substring("text", 1, 256)).sortWithinPartitions("conv", turn, "role", "text")
    same = F.sha2(F.concat_ws("\n", "conv", "role", "text"), 256)
    cut = stable(cut.select("*", F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("pos"), same.alias("same")))
    seen = stable(cut.groupBy("same").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")))
    joined = by_key(cut, seen.select("same", "first_pos"), "same", frequent(seen.select("same", "n"), "same"))
    return stable(joined.select("conv", "turn", "role", "text", "copies", "block", "pos", (F.col("pos") > F.col("first_pos")).alias("again")))


def _planned(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries and plan: a group is a block, or the summaries of one conversation."""
    summary = stable(cut.groupBy("block").applyInPandas(_summary, SUMMARY))
    return summary, stable(summary.groupBy("conv").applyInPandas(_combined, PLAN))


def _conv_id() -> Column:
    return F.when(F.col("conv") != "null", F.col("conv").try_cast("long")).alias("conv_id")


def _long_reports(rows: DataFrame) -> DataFrame:
    cut = _in_blocks(rows)
    summary, plan = _planned(cut)
    pieces = stable(cut.groupBy("block").cogroup(plan.groupBy("block")).applyInPandas(_pieces, PIECE))
    gaps = cut.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    counts = summary.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("illegal").alias("within"))
    planned = plan.groupBy("conv").agg(F.sum("illegal").alias("between"), F.sum("cost").alias("cost"))
    audits = pieces.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    hashes = pieces.repartition("conv").sortWithinPartitions("conv", "block").select("conv", "lines").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    known = gaps.join(counts, "conv").join(planned, "conv").join(audits, "conv").join(hashes, "conv")
    known = known.select(_conv_id().alias("known_id"), *[F.col(c) for c in ("gaps", "blank", "duplicate", "truncated", "cost", "audit", "repaired_sha256")], (F.col("within") + F.col("between")).alias("illegal"))
    # a conversation of which the damage left nothing
    ids = rows.select("conv_id").distinct()
    out = ids.join(known, F.col("conv_id").eqNullSafe(F.col("known_id")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# ---- the operator -----------------------------------------------------------------------------------


def plain(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text of rows with nulls of role and text as one space, and how often each row stands."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))


def _split(rows: DataFrame, long_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations up to long_rows, in order, and those of longer ones if there are any."""
    ids = stable(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).filter(F.col("n") > long_rows).select(F.col("conv_id").alias("long_id")))
    n = ids.count()  # also the size check of the broadcast below
    in_order = lambda d: d.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    if not n:
        return in_order(rows), None
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    hit = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return in_order(rows.join(ids, hit, "left_anti")), rows.join(ids, hit, "left_semi")


def repair(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """The report of each conversation of ``plain`` rows: counts of faults, least cost, edits and digest of its repaired text."""
    short, long = _split(rows, long_rows)
    out = short.mapInArrow(_reports, REPORT)
    return out if long is None else out.unionByName(_long_reports(long))


def repaired_turns(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """conv_id, position, role, text after repair; positions rise in order, and in a long conversation each block begins at a number of its own."""
    short, long = _split(rows, long_rows)
    out = short.mapInArrow(_turns, TURNS)
    if long is None:
        return out
    cut = _in_blocks(long)
    turns = cut.groupBy("block").cogroup(_planned(cut)[1].groupBy("block")).applyInPandas(_block_turns, BLOCK_TURNS)
    return out.unionByName(turns.select(_conv_id(), (F.shiftleft("block", 40) + F.col("k")).alias("position"), "role", "text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``plain`` rows after the damage of op13, which follows from each row's conversation and turn."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    role, text = named("role"), named("text")
    hit = rows.select(
        "conv_id", "turn", F.when(harm == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(harm.isin(0, 1), F.lit("")).when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"),
    )
    return plain(hit, F.col("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: One row of the recursion is one conversation after its first i rows: for each state the least (cost, edits, repaired text).
ORACLE_OP13 = r"""
WITH RECURSIVE polynomial AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(b)
), crc_table AS (SELECT list(v ORDER BY b) AS t FROM polynomial
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), harmed AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS copies
  FROM (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 20 AS h FROM named, crc_table)
), rows_of AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed, range(2) r(k) WHERE k < copies
), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM rows_of
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY conv_id
), states(s, closing, due) AS (VALUES (0, '', 'user'), (1, 'II', 'user'), (2, 'I', 'assistant'), (3, '', 'user')
), runs(s, run, code, inserted, goal) AS (VALUES
  (0, 0, '', '', 0), (0, 1, 'I', chr(10) || 'user:', 2), (0, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (1, 0, '', '', 1), (1, 1, 'I', chr(10) || 'user:', 2), (1, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (2, 0, '', '', 2), (2, 1, 'I', chr(10) || 'assistant:', 3), (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 2), (3, 0, '', '', 3), (3, 1, 'I', chr(10) || 'user:', 2), (3, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0, 'audit': '', 'text': ''} AS best FROM (SELECT DISTINCT conv_id FROM harmed)
  UNION ALL
  SELECT conv_id, i, s, min(best) FROM (
    SELECT w.conv_id, m.i, CASE e.edit WHEN 'D' THEN r.goal WHEN 'K' THEN CASE WHEN m.role[1] = 's' THEN 1 WHEN m.role[1] = 'u' THEN 2 ELSE 3 END ELSE CASE d.due WHEN 'user' THEN 2 ELSE 3 END END AS s,
      {'cost': w.best.cost + 3 * r.run + CASE e.edit WHEN 'D' THEN 4 ELSE (CASE e.edit WHEN 'R' THEN 3 ELSE 0 END) + (CASE m.fault WHEN 'truncated' THEN 3 ELSE 0 END) END,
       'audit': w.best.audit || r.code || e.edit,
       'text': w.best.text || r.inserted || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text ELSE chr(10) || d.due || ':' || m.text END} AS best
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN runs r ON r.s = w.s JOIN states d ON d.s = r.goal, (VALUES ('D'), ('K'), ('R')) e(edit)
    WHERE e.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR m.role[1] = d.due[1] OR m.role[1] = 's' AND r.goal = 0)
  ) GROUP BY conv_id, i, s
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + 3 * length(d.closing), 'audit': w.best.audit || d.closing,
    'text': w.best.text || CASE w.s WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS best
  FROM walk w JOIN states d USING (s) LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost::BIGINT AS cost, best.audit AS audit, sha256(best.text[2:]) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
