"""A2's draft and rewrite, checker calls at once, and runs that end and go on."""

import json
import os
import pathlib
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemill.operators import generation, prompts, scoring
from tidemill.sources import checkers, files
from tidemill.streaming import records

TASKS = "id string, kind string, prompt string, technical_terms array<string>, gold_number double, gold_text string, arm string, sample int"


def _tasks(spark, n=4):
    rows = [(f"t{i}", "math", f"Say {i}. Answer: n", ["x"], float(i), None, arm, s) for i in range(n) for arm in ("A0", "A1", "A2") for s in (0, 1)]
    return spark.createDataFrame(rows, TASKS)


def answers(told):
    """Counts its calls by saying something new each time: a random number stands in each text."""
    last = F.element_at("messages", -1)["content"]
    rewrite = last.startswith(prompts.REWRITE)
    number = F.regexp_extract(last, r"(?:Say |Answer: )(\d+)", 1)
    text = F.concat(F.lit("<think>a b c</think> "), F.when(rewrite, F.concat(F.lit("Short. draft ["), F.substring(last, len(prompts.REWRITE) + 1, 99), F.lit("]\nAnswer: "), number)).otherwise(F.concat(F.lit("Long "), F.rand().cast("string"), F.lit("\nAnswer: "), number)))
    return told.withColumns({"text": text, "truncated": rewrite & (F.col("id") == "t1"), "latency_s": F.when(rewrite, 2.0).otherwise(1.0)})


def test_a2_rewrites_its_own_draft(spark):
    made = generation.generated(_tasks(spark), answers)
    rows = made.withColumns({"task_id": F.col("id"), "compliance": F.lit(None).cast("double"), "nonconforming": F.lit(None).cast("array<string>")})
    got = {(r.task_id, r.arm, r.sample): r for r in scoring.arm_records(rows).collect()}
    assert len(got) == 24
    for (task, arm, _), r in got.items():
        assert r.correct is True and (r.rewrite is None) == (arm != "A2")
        if arm == "A2":
            w = r.rewrite
            assert w.draft_text.startswith("Long 0.") and f"draft [{w.draft_text}]" in r.text and w.draft_correct is True
            assert (w.draft_reasoning_tokens, w.rewrite_reasoning_tokens, r.reasoning_tokens, r.latency_s) == (3, 3, 6, 3.0)
            assert r.generated_tokens == w.draft_generated_tokens + w.rewrite_generated_tokens and r.truncated == (task == "t1")


def test_a2_without_a_draft_is_an_error(spark):
    for tasks in (_tasks(spark, 1), _tasks(spark, 1).withColumn("draft", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="no draft"):
            prompts.assembled(tasks).collect()
        assert prompts.assembled(tasks.filter("arm <> 'A2'")).count() == 4


def test_calls_at_once_keep_order_and_bound():
    under_way, most, begun, lock = [0], [0], [0], threading.Lock()

    def call(x):
        with lock:
            begun[0] += 1
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.01)
        with lock:
            under_way[0] -= 1
        return 2 * x

    assert list(checkers.in_order(call, range(200), 8)) == list(range(0, 400, 2)) and most[0] == 8
    begun[0], answers_ = 0, checkers.in_order(call, iter(range(1000)), 4)
    assert [next(answers_) for _ in range(3)] == [0, 2, 4]
    time.sleep(0.2)
    assert begun[0] <= 3 + 8
    answers_.close()
    assert list(checkers.in_order(call, [], 3)) == []


def test_checker_calls_in_a_task(spark):
    rows = spark.createDataFrame([(i, f"text {i}", []) for i in range(160)], "id long, text string, terms array<string>").coalesce(1)

    def check(text, _):
        time.sleep(0.05)
        if text.endswith("7"):
            raise ValueError(text)
        return "checked", None, json.dumps({"t": text})

    took, got = {}, {}
    for calls in (1, 8):
        start = time.time()
        got[calls] = sorted(tuple(r)[:4] for r in checkers.outcomes(rows, "id", check, calls).collect())
        took[calls] = time.time() - start
    assert got[1] == got[8] and len(got[1]) == 160 and took[8] < took[1] / 3
    with pytest.raises(ValueError):
        checkers.outcomes(rows, "id", check, 0)


def test_a_late_command_goes_with_what_it_started(tmp_path):
    script = f"import subprocess,sys,time; p = subprocess.Popen([sys.executable, '-c', 'import time; time.sleep(60)']); open({str(tmp_path / 'pid')!r}, 'w').write(str(p.pid)); time.sleep(60)"
    start = time.time()
    assert checkers.command([sys.executable, "-c", script], seconds=2)("x", []) == ("skipped", "error: no answer in 2 s", None)
    assert time.time() - start < 20
    pid = int((tmp_path / "pid").read_text())
    for _ in range(50):
        state = pathlib.Path(f"/proc/{pid}/stat")
        if not state.exists() or state.read_text().split(") ")[1][0] == "Z":
            return
        time.sleep(0.1)
    os.kill(pid, 9)
    raise AssertionError("the command's child lives on")


class Crash(Exception):
    pass


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    work, out = spark.createDataFrame([(i, f"k{i}") for i in range(40)], "at int, task_id string"), str(tmp_path / "run")
    records.laid_out(work, ["at"], 5, out)
    records.laid_out(work.limit(1), ["at"], 1, out)  # what is laid out stays
    made, fail_at = [], [2]

    def make(part):
        if len(made) == fail_at[0]:
            raise Crash("gone")
        made.append(part.count())
        return part.select("task_id", F.lit("A0").alias("arm"), F.lit(0).alias("sample"), F.lit(len(made)).alias("generated_tokens"))

    with pytest.raises(Exception, match="gone"):
        records.resumed(spark, out, make)
    assert len(made) == 2 and files.read_records(spark, f"{out}/records").count() == sum(made)
    # as if the run had ended after the second part was written and before that was noted
    for log, batch in (("commits", 1), ("offsets", 2)):
        for name in (f"{batch}", f".{batch}.crc"):
            pathlib.Path(f"{out}/progress/{log}/{name}").unlink(missing_ok=True)
    fail_at[0] = 4
    with pytest.raises(Exception, match="gone"):
        records.resumed(spark, out, make)
    fail_at[0] = None
    records.resumed(spark, out, make)
    got = files.read_records(spark, f"{out}/records").collect()
    assert sorted(r.task_id for r in got) == sorted(f"k{i}" for i in range(40))
    n = len(made)  # five parts, one made again and, as two share a batch by the lost log, at most one more
    assert n in (6, 7)
    records.resumed(spark, out, make)
    assert len(made) == n


def test_run_command_resumes(spark, tmp_path, capsys):
    from tidemill.__main__ import main

    row = {"id": "t1", "kind": "math", "prompt": "Two and two? Answer: n", "answer": 4, "technical_terms": [], "source": "s", "split": "t", "license": "l"}
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(row | {"id": f"t{i}"}) + "\n" for i in range(3)))
    (tmp_path / "unsteady.py").write_text("import pathlib\nfrom tidemill.sources.files import mock_answers\ndef answer(d):\n    if pathlib.Path(__file__).with_name('down').exists():\n        raise RuntimeError('model is down')\n    return mock_answers(d)\n")
    sys.path.insert(0, str(tmp_path))
    line = ["run", "--tasks", f"{tmp_path}/a.jsonl", "--results", str(tmp_path), "--run-id", "r", "--backend", "unsteady:answer", "--part", "5"]
    (tmp_path / "down").write_text("")
    with pytest.raises(Exception, match="model is down"):
        main(line)
    (tmp_path / "down").unlink()
    assert main(line) == 1 and "there already" in capsys.readouterr().err
    assert main([*line, "--resume"]) == 0
    got = files.read_records(spark, f"{tmp_path}/r/records").collect()
    assert len({(r.task_id, r.arm, r.sample) for r in got}) == len(got) == 9
    assert all((r.rewrite is not None) == (r.arm == "A2") for r in got)
    assert {r.rewrite.draft_text for r in got if r.arm == "A2"} == {"Work.\nAnswer: 4"}
    assert main(["run", "--tasks", f"{tmp_path}/a.jsonl", "--results", str(tmp_path), "--run-id", "other", "--resume"]) == 1


START, END = 90, 91


def _split(ids, opened):
    if END in ids:
        j = ids.index(END)
        if START in ids[:j]:
            i = ids.index(START)
            return ids[i + 1 : j], ids[:i] + ids[j + 1 :]
        return ids[:j], ids[j + 1 :]
    if START in ids:
        i = ids.index(START)
        return ids[i + 1 :], ids[:i]
    return (ids, []) if opened else ([], ids)


def test_split_of_ids(spark):
    from itertools import product

    from tidemill.functions import text as X

    rows = [(list(ids), opened) for n in range(5) for ids in product((1, 2, START, END), repeat=n) for opened in (False, True)]
    got = spark.createDataFrame(rows, "ids array<bigint>, opened boolean").withColumn("s", X.split_think_ids(F.col("ids"), START, END, F.col("opened"))).collect()
    for r in got:
        assert (r.s.reasoning, r.s.final) == _split(r.ids, r.opened)
        marks = (END in r.ids) + (START in (r.ids[: r.ids.index(END)] if END in r.ids else r.ids))
        assert len(r.s.reasoning) + len(r.s.final) + marks == len(r.ids)


def test_measures_by_ids(spark):
    tokens = checkers.tokenizer(lambda texts: [[int(w) for w in t.split()] for t in texts], lambda ids: [" ".join(map(str, i)) + " " for i in ids], START, END)
    rows = [("ignored", [START, 1, 2, END, 7, 8], False), ("ignored", [3, 3], True), ("<think>a b</think> 5 6 7", None, False), ("x", [], False)]
    got = scoring.measured(spark.createDataFrame(rows, "text string, token_ids array<int>, think_open boolean"), tokens).collect()
    assert [(r.reasoning_tokens, r.generated_tokens, r.output_tokens, r.final) for r in got] == [(2, 6, 2, "7 8 "), (2, 2, 0, " "), (2, 5, 3, "5 6 7"), (0, 0, 0, " ")]
