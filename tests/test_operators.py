"""Small cases of the operators, written from their semantics."""

import json
import random
import sys
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import compliance, layout, lexicon, rescoring, rules, scoring, stats, validation, watermark
from tidemill.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("Answer: 4", "4"), ("Answer:\n 4 \nAnswer: 5\r", "5"), ("answer: 4", None), ("Answer: a Answer: b", "a Answer: b"), ("", None)])
def test_answer_line(spark, text, want):
    assert one(spark, X.answer_line(F.col("t")), t=text) == want


@pytest.mark.parametrize("kind,text,want", [
    ("math", "Answer: 1,000", (True, None)), ("math", "Answer: none", (False, None)), ("math", "so 3 or 1000", (False, True)), ("math", "nothing", (False, False)),
    ("qa", "Answer: The red cat!", (True, None)), ("qa", "the redcat", (False, False)), ("writing", "Answer: 1000", (None, None)),
])
def test_score(spark, kind, text, want):
    s = one(spark, scoring.score(F.col("k"), F.lit(1000.0), F.lit("red cat"), F.col("t")), k=kind, t=text)
    assert (s.correct, s.fallback) == want


@pytest.mark.parametrize("text,opened,want", [("a<think>b</think>c", False, ("b", "ac")), ("b</think>c</think>d", False, ("b", "c</think>d")), ("a<think>b", False, ("b", "a")), ("b", True, ("b", "")), ("b", False, ("", "b"))])
def test_split_think(spark, text, opened, want):
    s = one(spark, X.split_think(F.col("t"), F.col("o")), t=text, o=opened)
    assert (s.reasoning, s.final) == want


@pytest.mark.parametrize("text,want", [("I can’t do it", True), ("  I'm sorry, no", True), ("one", True), ("two words", False), ("", True)])
def test_degenerate(spark, text, want):
    assert one(spark, X.degenerate(F.col("t")), t=text) is want


def test_stems_and_plurals(spark):
    assert one(spark, X.stems(F.col("t")), t="Parties") == ["parties", "party", "parte", "parti", "partie"]
    assert [one(spark, X.plural(F.col("t")), t=w) for w in ("box", "key", "body", "pump")] == ["boxes", "keys", "bodies", "pumps"]
    assert one(spark, X.term_phrases(F.array("t")), t="test body") == ["TEST BODY", "TEST BODYS", "TEST BODYES", "TEST BODIES"]
    assert one(spark, X.sentence_case(F.col("t")), t="THE PUMP IS ON. OPEN IT: (A) NOW") == "The pump is on. Open it: (a) Now"


def test_greedy_match_takes_the_longest():
    phrases = frozenset({"A", "A B", "A B C", "D"})
    assert compliance.longest_match("A B A B C D E".split(), phrases, 3) == (["A B", "A B C", "D"], ["E"])


def test_naive_rate_joins_what_is_left(spark):
    rate = compliance.naive(spark, frozenset({"SET UP", "IT"}))
    df = spark.createDataFrame([("set 5 pump up it x", ["pump"]), ("12", []), ("", ["a"]), (None, [])], "t string, terms array<string>")
    got = [r.c for r in df.select(rate(F.col("t"), F.col("terms")).alias("c")).collect()]
    assert got[0].rate == pytest.approx(3 / 4) and got[0].words == ["X"]
    assert [g.rate for g in got[1:]] == [None, None, None]


def test_gate(spark):
    df = spark.createDataFrame([("ing_form", "x", None), ("passive", None, None), ("not_approved", "H", "head"), ("not_approved", "z", "head"), ("not_approved", "Known", None), ("not_approved", "z", None)], "kind string, token string, headword string")
    keep = compliance.gate_keeps(F.struct("kind", "token", "headword"), F.array(F.lit("known")), F.array(F.lit("h")))
    assert [r.k for r in df.select(keep.alias("k")).collect()] == [False, True, False, True, True, False]


def test_spread_and_tax(spark):
    rows = [("A0", s, c, 10 * (s + 1)) for s in range(3) for c in (s > 0, s == 1)] + [("A1", 0, True, 40)]
    df = spark.createDataFrame(rows, "arm string, sample int, correct boolean, output_tokens int").selectExpr("*", "false truncated", "cast(null as boolean) fallback_correct", "false degenerate", "output_tokens generated_tokens", "output_tokens reasoning_tokens", "1.0D latency_s", "cast('nan' as double) compliance")
    arms = stats.spread(stats.per_sample(df))
    got = {r.arm: r for r in arms.collect()}
    assert got["A0"].accuracy == pytest.approx(0.5) and got["A0"].accuracy_sd == pytest.approx(0.5) and got["A0"].k == 3
    assert got["A1"].accuracy_sd == 0 and got["A1"].compliance is None
    t = stats.tax(arms).collect()
    assert [(r.arm, r.output_ratio) for r in t] == [("A1", 2.0)]
    assert stats.tax(arms.filter("arm <> 'A0'")).count() == 0
    assert len(stats.summary_lines(arms, stats.tax(arms))) == 3


def test_power():
    assert stats.pairs_needed(0.95, 0.5, 0.10, 0.05 / 4, 0.8) == 1108
    assert round(stats.discordance_power(200, 0.08, 0.03, 0.05 / 4), 2) == 0.36


def test_green_lists_and_detection(spark):
    scheme = watermark.Scheme(40, 0.25, 3)
    rng = random.Random(5)
    seqs = {k: [rng.randrange(40) for _ in range(n)] for k, n in enumerate((0, 1, 2, 60))}
    df = spark.createDataFrame(list(seqs.items()), "seq int, tokens array<int>")
    for unique in (False, True):
        for r in watermark.detect(df, scheme, unique).collect():
            p = list(zip(seqs[r.seq], seqs[r.seq][1:], strict=False))
            p = list(dict.fromkeys(p)) if unique else p
            assert (r.scored, r.greens) == (len(p), sum(b in watermark.green_list(scheme, a) for a, b in p))
            assert r.z == pytest.approx((r.greens - 0.25 * len(p)) / (len(p) * 0.1875) ** 0.5 if p else 0.0)
    assert [len(r.tokens) for r in watermark.matched(df.filter("seq > 1").withColumn("task", F.lit(1)), "task").collect()] == [2, 2]
    with pytest.raises(ValueError):
        watermark.Scheme(True)


def test_null_distribution_of_z():
    z, rng = [], random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(60) for _ in range(81)]
        s = watermark.Scheme(60)
        g = sum(b in watermark.green_list(s, a) for a, b in zip(ids, ids[1:], strict=False))
        z.append((g - 20) / 15**0.5)
    assert abs(mean(z)) < 0.3 and 0.75 < pstdev(z) < 1.25


TASK = {"id": "a", "kind": "math", "prompt": "p", "answer": 1, "technical_terms": ["x"], "source": "s", "split": "t", "license": "l"}


@pytest.mark.parametrize("change,n", [({}, 0), ({"id": " "}, 1), ({"kind": "x"}, 1), ({"kind": ["math"]}, 1), ({"answer": True}, 1), ({"answer": "1"}, 1), ({"kind": "qa", "answer": ""}, 1), ({"kind": "qa", "answer": "y"}, 0), ({"kind": "writing", "answer": None}, 0), ({"technical_terms": "x"}, 1), ({"technical_terms": []}, 0), ({"source": None}, 1), ({"extra": 1}, 1), ({"meta": []}, 1), ({"meta": {"a": 1}}, 0)])
def test_task_errors(spark, change, n):
    assert len(one(spark, validation.task_errors(F.col("t")), t=json.dumps(TASK | change))) == n


def test_load_tasks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(TASK) + "\n\n" + json.dumps(TASK | {"id": "b", "kind": "qa", "answer": "w"}) + "\n")
    got = files.load_tasks(spark, [str(tmp_path / "*.jsonl")]).orderBy("line_no").collect()
    assert [(r.id, r.line_no, r.answer_num, r.answer_str) for r in got] == [("a", 1, 1.0, None), ("b", 3, None, "w")]
    (tmp_path / "b.jsonl").write_text("{bad\n" + json.dumps(TASK) + "\n")
    with pytest.raises(files.TaskError) as e:
        files.load_tasks(spark, [str(tmp_path / "*.jsonl")])
    assert "b.jsonl:1: not JSON" in str(e.value) and "first at" in str(e.value)
    with pytest.raises(FileNotFoundError):
        files.expand(spark, [str(tmp_path / "*.none")])


def test_lines_of_many_splits(spark, tmp_path):
    """Numbers run over the splits of a file, over blank lines, line ends of two characters and a last line without one."""
    texts = {"a b+c%20.jsonl": "".join(f"line {k} ä\r\n" if k % 3 else "\n" for k in range(400)), "empty.jsonl": "", "one.jsonl": "  \nlast"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        paths = [str(tmp_path / name) for name in texts]
        got = sorted((r.file_pos, r.line_no, r.file, r.value) for r in files.lines(spark, paths).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(n, k, p, x.rstrip("\r")) for n, (p, t) in enumerate(zip(paths, texts.values(), strict=True), 1) for k, x in enumerate(t.split("\n"), 1) if x.strip()]


def test_records_round_trip(spark, tmp_path):
    row = spark.createDataFrame([("t", None)], "task_id string, sample int").withColumn("by", F.lit(1)).drop("by")
    files.write_records(row, str(tmp_path / "run"))
    assert files.read_records(spark, str(tmp_path / "run")).first().sample == 0
    with pytest.raises(Exception, match="exist"):
        files.write_records(row, str(tmp_path / "run"))


def test_seeded_sample(spark):
    df = spark.range(30)
    assert [r.id for r in files.seeded_sample(df, ["id"], 5, 3).orderBy("id").collect()] == sorted(random.Random(3).sample(range(30), 5))
    assert files.seeded_sample(df, ["id"], 99, 3).count() == 30


def test_layout(spark):
    rows = spark.createDataFrame([("p", 0.0), ("p", 2.0), ("p", 4.4), ("p", 8.0)], "page string, y double")
    assert [r.group_no for r in layout.gap_groups(rows, "page", F.col("y"), 2.5, ["y"]).orderBy("y").collect()] == [1, 1, 1, 2]
    text = spark.createDataFrame([("p", 1, "soft-"), ("p", 2, "ware-"), ("p", 3, "shop"), ("p", 4, "x"), ("p", 5, "a-"), ("p", 6, "1")], "page string, n int, text string")
    assert [r.text for r in layout.soft_hyphens(text, "page", "n").orderBy("n").collect()] == ["softwareshop", "x", "a-", "1"]


def test_resolved_alternatives(spark):
    approved = spark.createDataFrame([(1, "a1", "cut", "v", ["cut", "cutting"]), (2, "a2", "cut", "v", ["cut"]), (3, "a3", "pump", "n", ["pump", "pumps"]), (4, "a4", "pump", "v", ["pump"])], "seq int, id string, word string, pos string, forms array<string>")
    alts = spark.createDataFrame([("cut", "v"), ("pumps", "n"), ("cutting", "adj"), ("cut pump", None), ("pump", "x"), ("none", "n")], "word string, pos string")
    got = {(r.word, r.pos): (r.ref, r.how) for r in lexicon.resolved(alts, approved).collect()}
    assert got == {("cut", "v"): ("a2", "word"), ("pumps", "n"): ("a3", "form"), ("cutting", "adj"): ("a1", "participle"), ("cut pump", None): (None, "phrase"), ("pump", "x"): ("a3", "any"), ("none", "n"): (None, "unresolved")}


def test_rule_findings(spark):
    f = one(spark, rules.findings(F.col("t")), t="Don't stop; it's running. " + "word " * 26 + ".")
    assert (f.long_sentences, f.semicolons, f.contractions, f.ing_words) == (1, 1, 2, 1)


def _heads(*rows):
    import re

    from tidemill.operators import headwords

    return [h[:4] for h in headwords.parse([(re.findall(headwords.TOKEN, t), ruled) for t, ruled in rows])]


def test_headword_grammar():
    assert _heads(("OPEN (v),", True), ("OPENS, OPENED", False), ("", False), ("oil (n)", True)) == [("OPEN", None, "v", ["OPENS", "OPENED"]), ("oil", None, "n", [])]
    assert _heads(("MATT (or MATTE) (adj)", True), ("SET UP", True), ("(a thing) (v)", False)) == [("MATT", None, "adj", ["MATTE"]), ("SET UP", "a thing", "v", [])]
    assert _heads(("BE (v), IS, WAS,", True), ("(also ARE, WERE)", False)) == [("BE", None, "v", ["IS", "WAS", "ARE", "WERE"])]
    assert _heads(("TOUCH (v)", True), ("TOUCHES,", False), ("TOUCHED", False)) == [("TOUCH", None, "v", ["TOUCHES", "TOUCHED"])]
    assert _heads(("A (n),", True), ("B (n)", True)) == [("A", None, "n", []), ("B", None, "n", [])]
    stream = [("PUSH (v)", True), ("", False), ("PUSHES", False), ("PUSHED OUT", False), ("", False), ("FOR EXAMPLE", True), ("", False)]
    assert _heads(*stream) == [("PUSH", None, "v", ["PUSHES", "PUSHED OUT"]), ("FOR EXAMPLE", None, None, [])]
    assert _heads() == _heads(("", False)) == []


@pytest.mark.parametrize("rows", [["(n)"], ["A (b) C"], ["A (n), , B"], ["A (b"], ["A (or B)"]])
def test_headword_errors(rows):
    from tidemill.operators import headwords

    with pytest.raises(headwords.HeadwordError):
        _heads(*[(r, True) for r in rows])


def test_alternatives(spark):
    from tidemill.operators import headwords

    cases = [["STOP (v)", "MAKE SURE", "(WITH A", "CLIP)", "and CAN (CANNOT) (v);", "PUMP", "(TN)"], ["(first) see Note, X"], [], ["no reference here."]]
    df = spark.createDataFrame([(c,) for c in cases], "l array<string>")
    got = [(r.a.alternatives, r.a.note) for r in df.select(headwords.alternatives(F.col("l")).alias("a")).collect()]
    assert [tuple(a) for a in got[0][0]] == [("word", "STOP", "v", None), ("phrase", "MAKE SURE", None, "WITH A CLIP"), ("word", "CAN", "v", "CANNOT"), ("technical", "PUMP", "TN", None)]
    assert got[0][1] == "and"
    assert [tuple(a) for a in got[1][0]] == [("phrase", "X", None, None)] and got[1][1] == "first) see Note"
    assert got[2:] == [([], None), ([], "no reference here")]


def test_entries(spark):
    from tidemill.operators import headwords

    rows = [
        ("p1", "OPEN (v),", True, "Not closed", "", "Open it.", ""), ("p1", "OPENS", False, "STOP (v)", "Use with care", "", ""), ("p2", "", False, "CLEAR (adj)", "", "Open the valve.", "x"),
        ("p2", "big (adj)", True, "LARGE (adj)", "", "", "A big pump"),
    ]
    df = spark.createDataFrame([("b", k, *r) for k, r in enumerate(rows)], "book string, seq int, page string, head string, ruled boolean, main string, help string, ste string, nonste string")
    a, b = headwords.entries(df).orderBy("entry").collect()
    assert (a.word, a.pos, a.forms, a.kind, a.meaning, a.help, a.ste, a.nonste, a.page, a.note) == ("OPEN", "v", ["OPENS"], "approved", "Not closed", "Use with care", "Open it. Open the valve.", "x", "p1", None)
    assert [x.word for x in a.alternatives] == ["STOP", "CLEAR"]
    assert (b.word, b.kind, b.meaning, b.help, [x.word for x in b.alternatives], b.nonste) == ("big", "unapproved", None, None, ["LARGE"], "A big pump")


def test_listed_rules(spark):
    from tidemill.operators import headwords

    lines = [(16.0, True, "Page head"), (14.0, True, "Section 1 – Words"), (13.0, True, "Summary of the rules"), (11.0, True, "Nouns"), (11.0, False, "Rule 1.1"), (11.0, False, "Use short"), (11.0, False, "words."), (11.0, True, "Verbs"), (11.0, False, "Rule 1.2"), (14.0, True, "General"), (11.0, False, "Rule 9.9")]
    df = spark.createDataFrame([("b", 1, k, *x) for k, x in enumerate(lines)], "book string, page int, seq int, size double, bold boolean, text string")
    got = [tuple(r) for r in headwords.listed_rules(df).select("id", "section", "section_title", "title", "statement").orderBy("id").collect()]
    assert got == [("1.1", 1, "Words", "Nouns", "Use short words."), ("1.2", 1, "Words", "Verbs", "")]


def test_report_forms(spark):
    from tidemill.operators import report

    df = spark.createDataFrame([(1, 3), (0, 0)], "n long, t long")
    assert [r.x for r in df.select(report.share(F.col("n"), F.col("t")).alias("x")).collect()] == ["33.3%", "n/a"]
    assert report.table_head("a", "b") == "| a | b |\n| --- | --- |"
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    assert spark.range(1).select(report.run_id(F.lit("hf"), F.lit("x/My model!"), at)).first()[0] == "hf-My-model-20240102T030405Z"


def test_preflight_problems():
    from tidemill.sources import environment

    facts = {"rocm": "Name: gfx950", "gpus": 8, "pkg.vllm": "0.29.1"}
    assert environment.problems(facts, "vllm") == [] == environment.problems({}, "mock")
    assert environment.problems(facts | {"rocm": None, "gpus": None}, "hf") == ["rocminfo gives nothing", "torch is not installed"]
    assert environment.problems(facts | {"gpus": 0, "pkg.vllm": "0.9", "rocm": "gfx908"}, "vllm") == ["torch sees no GPU", "vllm 0.9 is too old", "gfx908 is served by hf only"]
    assert environment.problems(facts | {"pkg.vllm": None}, "vllm") == ["vllm is not installed"]
    assert environment.heard("no-such-command") is None and environment.heard("echo hi") == "hi"
    found = environment.facts()
    assert found["pkg.pyspark"] and found["host"] and "pkg.torch" in found


CHECKER = """
import json
def check(batches):
    for b in batches:
        said = [{"version": f"{i}/{len(t)}", "mode": "description", "ok": False, "findings": [{"kind": "ing_form", "token": "x"}]} for i, t in zip(b.task_id, b.terms)]
        yield b[["task_id", "arm", "sample"]].assign(report=[json.dumps(r) for r in said])
"""


def test_rescoring_leaves_what_does_not_wait(spark):
    said = "task_id string, arm string, sample int, text string, checker struct<status: string, ok: boolean, findings: int, by_kind: map<string,int>, words: array<string>, version: string, mode: string, gate_ok: boolean, gate_findings: int, reason: string>"
    outcome = lambda status, reason: (status, None, None, None, None, None, None, None, None, reason)
    rows = [("a", "A0", 0, "x", outcome("skipped", "off")), ("b", "A0", 0, "", outcome("skipped", "empty")), ("c", "A0", 0, "x", outcome("checked", None)), ("d", "A0", 0, None, outcome("skipped", None)), ("e", "A0", 0, "x", None)]
    tasks = spark.createDataFrame([("a", "qa", ["t"]), ("d", "writing", None)], "id string, kind string, technical_terms array<string>")

    def check(batches):
        for b in batches:
            report = [json.dumps({"version": "/".join(t), "ok": True, "findings": []}) if x else "not a report" for x, t in zip(b.text, b.terms, strict=True)]
            yield b[["task_id", "arm", "sample"]].assign(report=report)

    got = {r.task_id: r.checker for r in rescoring.rescored(spark.createDataFrame(rows, said), tasks, check).collect()}
    assert (got["a"].status, got["a"].version, got["a"].findings) == ("checked", "t/Answer", 0)
    assert got["b"].reason == "empty" and got["c"].status == "checked" and got["d"].status == "skipped" and got["e"] is None


def test_changed_files(spark):
    of = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    got = rescoring.changed_files(of([("a", "1"), ("b", "2"), ("c", "3")]), of([("a", "1"), ("b", "9"), ("d", "4")]))
    assert {r.path for r in got.collect()} == {"b", "c", "d"}


def test_commands(spark, tmp_path, capsys):
    from tidemill.__main__ import main

    row = {"id": "t1", "kind": "math", "prompt": "Two and two? Answer: n", "answer": 4, "technical_terms": [], "source": "s", "split": "t", "license": "l"}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"id": "t2", "kind": "writing", "answer": None}) + "\n")
    assert main(["tasks", "--tasks", f"{tmp_path}/a.jsonl"]) == 0 and capsys.readouterr().out == "math s t: 1\nwriting s t: 1\n"
    assert main(["run", "--tasks", f"{tmp_path}/*.jsonl", "--samples", "2", "--results", str(tmp_path / "out"), "--run-id", "r"]) == 0
    capsys.readouterr()
    assert main(["summarize", f"{tmp_path}/out/r"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 5 and said[0].startswith("A0: k=2 n=4 accuracy=1.000±0.000")
    (tmp_path / "said_checker.py").write_text(CHECKER)
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "said_checker.py"))
    again = ["rescore", f"{tmp_path}/out/r", "--checker", "said_checker:check"]
    for _ in range(2):
        assert main(again) == 0 and [x.split(" ")[:3] for x in capsys.readouterr().out.splitlines()] == [x.split(" ")[:3] for x in said]
        got = spark.read.json(f"{tmp_path}/out/r/rescored").select("task_id", "checker.*").collect()
        assert len(got) == 12 and {(r.status, r.ok, r.findings, r.version) for r in got} == {("checked", False, 1, "t1/1"), ("checked", False, 1, "t2/0")}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n")
    assert main(again) == 1 and "changed" in capsys.readouterr().err
    (tmp_path / "b.jsonl").write_text(json.dumps(row))
    assert main(["tasks", "--tasks", f"{tmp_path}/*.jsonl"]) == 1 and "task error" in capsys.readouterr().err
