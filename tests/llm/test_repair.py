"""Conversation repair against a search over all edits, in blocks and whole, and its defined cases."""

import hashlib
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from tidemill.llm import repair

FORM = re.compile(r"(s?(ua)+)?")


def _cheapest(rows, faults):
    """Least (cost, edits, repaired text), from the last row back, whole strings compared."""
    step, name = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def then(cost, edit, line, *at):
            if rest := best(*at):
                found.append((cost + rest[0], edit + rest[1], line + rest[2]))

        for r in "ua":
            if r in step[last] and inserted < 4:
                then(3, "I", (name[r] + ":",), i, r, inserted + 1)
        if i < len(rows):
            (role, text), f = rows[i], faults[i]
            then(4, "D", (), i + 1, last, 0)
            if f not in ("blank", "duplicate"):
                more = 3 * (f == "truncated")
                if role and role[0] in step[last]:
                    then(more, "K", (f"{role}:{text}",), i + 1, role[0], 0)
                for r in "ua":
                    if r in step[last]:
                        then(3 + more, "R", (f"{name[r]}:{text}",), i + 1, r, 0)
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    return cost, audit, "\n".join(lines)


def _expected(rows):
    seen, faults = set(), []
    for row in rows:
        bare = row[1].rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add(row)
    return faults, _cheapest(rows, faults)


ROWS = [("user", "a."), ("assistant", "b."), ("system", "c."), ("user", ""), ("tool", "d."), ("assistant", "no end"), ("user", "a.")]


@pytest.mark.parametrize("n", range(4))
def test_every_short_conversation(n):
    from itertools import product

    for rows in product(ROWS, repeat=n):
        rows = list(rows)
        faults, (cost, audit, text) = _expected(rows)
        report, lines = repair.mended(list(range(n)), rows)
        assert (report["cost"], report["audit"]) == (cost, audit), rows
        assert "\n".join(f"{r}:{t}" for r, t in lines) == text
        assert [report[x] for x in ("blank", "duplicate", "truncated")] == [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        assert FORM.fullmatch("".join(r[0] for r, _ in lines))


def _table(spark):
    import random

    rng, rows = random.Random(7), []
    for conv in (0, 1, None, 5, -3):
        for turn in range(rng.randrange(3, 30)):
            role, text = rng.choice(ROWS)
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice([role, None]), rng.choice([text, f"{turn}?\nuser:x.", None, "same."])))
    rows += [(9, None, "user", ""), (8, 3, "user", "x" * 200_000 + "."), (8, 4, "assistant", "y.")] + [(7, 1, "user", "again.")] * 12
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, copies int").repartition(5), rows


COLUMNS = ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]


def test_whole_and_in_blocks(spark):
    df, rows = _table(spark)
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role or " " if role is None else role, " " if text is None else text))
    want = {}
    for conv, x in by_conv.items():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, (cost, audit, text) = _expected([r[1:] for r in x])
        turns = {r[0] for r in x} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(x, x[1:]))
        want[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    for long_rows in (repair.LONG_ROWS, 4, 0):
        got = {r[0]: tuple(r[1:]) for r in repair.repair(repair.plain(df), long_rows).select(*COLUMNS).collect()}
        assert got == want, long_rows
    for long_rows in (repair.LONG_ROWS, 4):
        lines = {}
        for r in sorted(repair.repaired_turns(repair.plain(df), long_rows).collect(), key=lambda r: (str(r[0]), r[1])):
            lines.setdefault(r[0], []).append(f"{r[2]}:{r[3]}")
        assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: w[-1] for c, w in want.items() if w[5] is not None and c in lines}


def test_damage(spark):
    df, rows = _table(spark)
    got = sorted(map(str, ((r.conv_id, r.turn, r.role, r.text, r.copies) for r in repair.damaged(df).collect())))
    want = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h < 2 else re.sub("[.!?]", "", text) if h == 2 else text
        want.append((conv, turn, "user" if h == 4 else role, text, {0: 0, 3: 2}.get(h, 1)))
    assert got == sorted(map(str, want))


def test_nothing_left_and_empty(spark):
    gone = spark.createDataFrame([(4, 0, "user", "a.", 0), (None, 1, "user", "", 0)], "conv_id long, turn long, role string, text string, copies int")
    for long_rows in (10, -1):
        got = repair.repair(gone, long_rows).select(*COLUMNS).collect()
        assert sorted(map(str, (r[0] for r in got))) == ["4", "None"]
        assert {tuple(r[1:]) for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(gone.limit(0)).count() == 0


def test_query_gives_the_sql(spark):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = con.execute(repair.ORACLE_OP13)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, repair.op13_conversation_repair(spark, d).select(*names).collect())) == sorted(want.fetchall())
