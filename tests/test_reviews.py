"""Checkers, validation of a checker, checks of artifacts, prompts, files and commands beyond the queries."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from tidemill.operators import compliance, headwords, lexicon, prompts, reviews, rules, stats, validation, verification, watermark
from tidemill.sources import checkers, files

TASK = {"id": "a", "kind": "math", "prompt": "p", "answer": 1, "technical_terms": ["x"], "source": "s", "split": "t", "license": "l"}
ENTRY = "word string, pos string, qualifier string, forms array<string>, approved boolean, ste_example string, nonste_example string"


def test_checker_outcomes(spark):
    """Empty texts, failures, silence and nonsense are rows; a plug-in that raises is one as well."""
    report = json.dumps({"version": "1", "mode": "description", "ok": False, "findings": [{"kind": "not_approved", "token": "x"}, {"kind": "ing_form", "token": "y"}]})
    good = checkers.command([sys.executable, "-c", f"import sys; sys.stdin.read(); assert 'term' in open(sys.argv[-1]).read(); print('''{report}''')"])
    rows = spark.createDataFrame([(1, "text", ["term"]), (2, "  ", ["term"]), (3, None, None)], "id long, text string, terms array<string>")
    got = {r.id: r for r in checkers.outcomes(rows, "id", good).collect()}
    assert (got[1].status, got[1].reason, json.loads(got[1].report)["version"]) == ("checked", None, "1") and got[1].seconds > 0
    assert (got[2].status, got[2].reason) == (got[3].status, got[3].reason) == ("skipped", "empty")
    fail = {
        "exit 3: bad": checkers.command([sys.executable, "-c", "import sys; sys.stderr.write('so\\nbad\\n'); sys.exit(3)"]),
        "no answer in 0.2 s": checkers.command([sys.executable, "-c", "import time; time.sleep(9)"], seconds=0.2),
        "no JSON": checkers.command([sys.executable, "-c", "print('x')"]),
        "No such file": checkers.command(["no-such-checker"]),
        "ZeroDivisionError": lambda text, terms: 1 // 0,
    }
    one = rows.filter("id = 1")
    for said, check in fail.items():
        r = checkers.outcomes(one, "id", check).first()
        assert r.status == "skipped" and r.reason.startswith("error: ") and said in r.reason and r.report is None
    assert checkers.outcomes(one, "id", checkers.off).first().reason == "off"
    struct = {r.id: r.checker for r in checkers.checker_column(checkers.outcomes(rows, "id", good), F.array(F.lit("x")), F.array().cast("array<string>")).collect()}
    assert (struct[1].status, struct[1].ok, struct[1].findings, struct[1].by_kind, struct[1].words, struct[1].gate_ok, struct[1].gate_findings) == ("checked", False, 2, {"not_approved": 1, "ing_form": 1}, ["x"], False, 1)
    assert (struct[2].status, struct[2].ok, struct[2].findings, struct[2].reason) == ("skipped", None, None, "empty")


def test_strict_checker_raises(spark):
    rows = spark.createDataFrame([("r1", "text", [])], "run_id string, text string, terms array<string>")
    said = json.dumps({"ok": True, "findings": [{"kind": "passive", "token": "b"}], "signals": [{"kind": "part_of_speech", "token": "c"}]})
    got = checkers.strict_reports(rows, lambda t, x: ("checked", None, said)).first()
    assert got.findings[0].token == "b" and got.signals[0].token == "c"
    with pytest.raises(Exception, match="error: no"):
        checkers.strict_reports(rows, lambda t, x: ("skipped", "error: no", None)).collect()


def test_reports_are_kept_by_their_input(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make(rows):
        calls.add(1)
        return rows.withColumn("n", F.length("t"))

    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    for d, n in ((rows, 1), (rows.repartition(3), 1), (rows.filter("k = 1"), 2)):
        assert checkers.cached(d, "make", str(tmp_path), make).count() == d.count() and calls.value == n
    checkers.cached(rows, "another", str(tmp_path), make)
    assert calls.value == 3


def test_backends_and_tokens(spark):
    assert checkers.backend("mock") is files.mock_answers and checkers.backend("os.path:join").__name__ == "join"
    with pytest.raises(ValueError, match="known: mock"):
        checkers.backend("none")
    rows = spark.createDataFrame([("a b",), ("8 x 9 y z",), ("x 9 y",), ("8 x",), (None,)], "t string")
    codes = {"8": 8, "9": 9}
    out = checkers.token_counts(rows, "t", lambda ts: [[codes.get(w, ord(w)) for w in t.split()] for t in ts], 8, 9).collect()
    assert [(r.n_tokens, r.reasoning_ids, r.final_ids) for r in out] == [(2, 0, 2), (5, 1, 2), (3, 1, 1), (2, 1, 0), (0, 0, 0)]


def test_review_of_entries(spark):
    """From entries over jobs and reports to runs; a signal alone is a hit of its own; a missing report stops the job."""
    rows = [("OPEN", "v", None, ["OPENS"], True, "OPEN THE DOOR", None), ("open", "v", None, [], False, "OPEN", "unopen it"), ("few", "adj", "a few", [], False, "SOME", "few men"), ("re-", "prefix", None, [], False, None, None)]
    e = reviews.parsed(spark.createDataFrame(rows, ENTRY))
    assert {(r.key, r.meaning_only) for r in e.collect()} == {("OPEN (v)", False), ("open (v)", True), ("few (adj) [a few]", False)}
    job = reviews.jobs(e, spark.createDataFrame([("OPEN (v)",)], "key string"))
    assert {(r.side, r.text) for r in job.collect()} == {("ste", "OPEN THE DOOR"), ("ste", "OPEN"), ("ste", "SOME"), ("nonste", "unopen it"), ("nonste", "few men"), ("probe", "Open the door")}
    kind = "run_id string, seconds double, findings array<struct<kind:string,token:string,mark:string,headword:string>>, signals array<struct<kind:string,token:string,mark:string,headword:string>>"
    said = [(r.run_id, 0.5, [("punctuation", None, ";", None)] if r.side == "ste" else [], [("part_of_speech", "fews", None, None)] if r.text == "few men" else []) for r in job.collect()]
    senses = spark.createDataFrame([], "token string, approved boolean, names_term boolean, noun boolean")
    run = reviews.runs(job, spark.createDataFrame(said, kind), senses)
    assert [(r.key, r.hit) for r in reviews.hits(run).collect()] == [("few (adj) [a few]", "signal")]
    assert tuple(reviews.false_positives(run).first()) == (3, 3, 0, 3) and reviews.misses(run).count() == 0 and reviews.timing(run).first().runs == 6
    assert [(r.key, r.only_in, r.token) for r in reviews.probe_gaps(run).collect()] == [("OPEN (v)", "capitals", ";")]
    with pytest.raises(Exception, match="no report of"):
        reviews.runs(job, spark.createDataFrame(said[1:], kind), senses).collect()


def test_items_keep_signals(spark):
    report = spark.createDataFrame([(1, [("not_approved", "Cut", None, "CUT")], [("quotation", None, "“", None)])], "id int, findings array<struct<kind:string,token:string,mark:string,headword:string>>, signals array<struct<kind:string,token:string,mark:string,headword:string>>")
    senses = spark.createDataFrame([("cut", False, False, True)], "token string, approved boolean, names_term boolean, noun boolean")
    got = [(r.group, r.kind, r.token, r.headword, r.origin) for r in compliance.items(report, senses).orderBy("place").collect()]
    assert got == [("finding", "not_approved", "cut", "cut", "dictionary"), ("signal", "quotation", "“", "", "")]


def test_parameter_faults(spark):
    """Every listed check against rules that state what they hold, then with one number changed."""
    said = {
        "5.1": ("Use a maximum of 20 words.", {"max_words_per_sentence": 20, "notes_max_words_per_sentence": 25}), "6.3": ("a maximum of 25 words", {"max_words_per_sentence": 25}), "6.6": ("not more than six sentences", {"max_sentences_per_paragraph": 6}),
        "2.1": ("no more than three words", {"max_words_in_multi_word_noun": 3}), "2.2": ("more than three words", {"max_words_in_multi_word_noun": 3}), "8.5": ("It counts as one word in that sentence", {"parenthetical_counts_as_words": 1}),
        "8.7": ("they count as one word", {"hyphenated_counts_as_words": 1}), "1.5": ("", {"technical_noun_categories": list("abcdefghijklmnopqrstuv")}), "1.12": ("", {"technical_verb_categories": list("abcd")}),
    }
    text = "Rule 1.5 x Rule 1.12 x Rule 1.5 one or more of these twenty-two categories Rule 1.12 one or more of these four categories. A sentence in a note is 25 words"
    of = lambda d: spark.createDataFrame([(k, s, json.dumps(p)) for k, (s, p) in d.items()], "id string, statement string, parameters string")
    whole = spark.createDataFrame([(text,)], "text string")
    assert verification.parameter_faults(of(said), whole).count() == 0
    wrong = of(said | {"1.5": ("", {"technical_noun_categories": ["a"]}), "6.6": ("more than one of these six sentences", {"max_sentences_per_paragraph": 6})})
    assert {tuple(r) for r in verification.parameter_faults(wrong, whole).collect()} == {("1.5", "technical_noun_categories", 1, 22), ("6.6", "max_sentences_per_paragraph", 6, None)}


def test_text_of_pages_and_report(spark):
    lines = spark.createDataFrame([("p1", 1, "Page 1-2-3"), ("p1", 2, "a  b\n"), ("p2", 1, "Page 2-0-1"), ("p2", 2, "no")], "page string, seq int, text string")
    assert verification.text_of_pages(lines).first().text == "Page 1-2-3 a b"
    ends = verification.dead_ends(spark.createDataFrame([("w", "n", [], None), ("x", "n", [], "help"), ("y", "n", ["a"], "")], "word string, pos string, alternatives array<string>, help string"))
    assert [(r.check, json.loads(r.fault)) for r in verification.report(dead_end=ends).collect()] == [("dead_end", {"word": "w", "pos": "n"})]


@pytest.mark.parametrize("line,n", [(json.dumps(TASK), 0), (json.dumps(TASK).replace(": 1,", ": NaN,"), 0), (json.dumps(TASK).replace(": 1,", ": -Infinity,"), 0), (json.dumps(TASK | {"meta": {}}), 1), (json.dumps(dict(reversed(TASK.items()))), 1), (json.dumps({k: v for k, v in TASK.items() if k != "id"}), 2), (json.dumps(TASK | {"answer": True}), 1), ("", 1), ("[1]", 1)])
def test_strict_errors(spark, line, n):
    assert len(spark.createDataFrame([(line,)], "t string").select(validation.strict_errors(F.col("t"))).first()[0]) == n


def test_task_line_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(validation.task_errors(F.col("t")).alias("e"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 1 or plan.count("ParseJson") <= 1


def test_all_violations_are_told(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{bad\n" * 1001)
    with pytest.raises(files.TaskError, match="and 1 more") as e:
        files.load_tasks(spark, [str(tmp_path / "a.jsonl")], root=str(tmp_path))
    assert e.value.violations.count() == 1001 and str(e.value).startswith("a.jsonl:1: not JSON")


def test_default_tasks_and_shown_paths(spark, tmp_path):
    (tmp_path / "tasks").mkdir()
    for name in ("tasks/b.jsonl", "tasks/a.jsonl", "tasks.jsonl"):
        (tmp_path / name).write_text(json.dumps(TASK))
    assert [p.removeprefix(str(tmp_path)) for p in files.default_tasks(spark, str(tmp_path))] == ["/tasks.jsonl", "/tasks/a.jsonl", "/tasks/b.jsonl"]
    (tmp_path / "tasks.jsonl").unlink()
    assert len(files.default_tasks(spark, str(tmp_path))) == 2 and files.default_tasks(spark, str(tmp_path / "none")) == []
    got = spark.createDataFrame([("/r/a/b",), ("/s/a",)], "p string").select(files.shown(F.col("p"), "/r")).collect()
    assert [r[0] for r in got] == ["a/b", "/s/a"]


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    assert {r.k: r.at for r in files.positions(df, ["k"], "at").collect()} == {k: k for k in range(1000)}
    assert sorted(r.k for r in files.stride_sample(df, ["k"], 100, 3).collect()) == [0, 100, 200]
    assert files.positions(df.limit(0), ["k"], "at").count() == 0


LEXICON = {
    "approved": [{"id": "pump (n)", "word": "pump", "pos": "n", "forms": ["pump"], "plural": "pumps"}, {"id": "cut (v)", "word": "cut", "pos": "v", "forms": ["cut", "cuts"], "plural": None}],
    "unapproved": [
        {"word": "slice", "pos": "v", "qualifier": None, "forms": [], "alternatives": [{"ref": "cut (v)", "stated_pos": "n"}, {"phrase": "cut far"}], "note": None, "help": None},
        {"word": "dice", "pos": "v", "qualifier": None, "forms": ["dices"], "alternatives": [{"ref": "none (v)"}], "note": None, "help": None},
        {"word": "lost", "pos": "v", "qualifier": None, "forms": [], "alternatives": [], "note": None, "help": None},
    ],
}


def test_lexicon_commands(spark, tmp_path, capsys):
    from tidemill.__main__ import main

    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps(LEXICON))
    approved, unapproved = files.read_lexicon(spark, str(path))
    assert approved.count() == 2 and {r.word for r in compliance.dictionary_words(approved, unapproved).collect()} == {"pump", "pumps", "cut", "cuts", "slice", "dice", "dices", "lost"}
    assert main(["validate", "--lexicon", str(path), "cut", "pumps"]) == 0 and capsys.readouterr().out == "tokens 2, conforming phrases 2, other words 0\n"
    (tmp_path / "t.txt").write_text("slice\nthe pump")
    assert main(["validate", "--lexicon", str(path), "-f", str(tmp_path / "t.txt")]) == 1 and capsys.readouterr().out.splitlines()[1:] == ["  SLICE", "  THE"]
    assert main(["verify", "--lexicon", str(path)]) == 1
    said = capsys.readouterr().out
    assert "note outside:  far" in said and "note stated_pos: slice n" in said and said.endswith("2 faults\n") and "none (v)" in said and "lost" in said
    (tmp_path / "h.json").write_text('{"h": ["a", "b"]}')
    assert {r.token for r in files.read_attested(spark, str(tmp_path / "h.json")).collect()} == {"a", "b"}


def test_watermark_command(spark, tmp_path, capsys):
    from tidemill.__main__ import main

    scheme, lines, seqs = watermark.Scheme(50), [], {("t", "A0"): [1, 2, 3, 4, 5, 6], ("t", "A1"): [7, 8, 9], ("u", "A0"): [4]}
    for (task, arm), ids in seqs.items():
        lines += [json.dumps({"task": task, "arm": arm, "pos": k, "token": i}) for k, i in enumerate(ids)]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    assert main(["watermark", str(tmp_path / "t.jsonl"), "--vocab-size", "50", "--results", str(tmp_path), "--run-id", "w"]) == 0
    got = {(r.task, r.arm): r for r in spark.read.schema(files.WATERMARK).json(f"{tmp_path}/w/records").collect()}
    for key, ids in seqs.items():
        cut = ids[: min(len(x) for (t, _), x in seqs.items() if t == key[0])]
        for part, z in ((ids, got[key].z_full), (cut, got[key].z_matched)):
            n = len(part) - 1
            g = sum(b in watermark.green_list(scheme, a) for a, b in zip(part, part[1:], strict=False))
            assert z == (round((g - 0.25 * n) / (n * 0.25 * 0.75) ** 0.5, 3) if n else 0.0)
        assert (got[key].tokens, got[key].matched_len) == (len(ids), len(cut))
    capsys.readouterr()
    assert main(["summarize", f"{tmp_path}/w"]) == 0 and len(capsys.readouterr().out.splitlines()) == 3


def test_run_with_checker_and_presets(spark, tmp_path, capsys):
    from tidemill import __main__ as cli

    (tmp_path / "a.jsonl").write_text(json.dumps(TASK) + "\n" + json.dumps(TASK | {"id": "b"}))
    (tmp_path / "lexicon.json").write_text(json.dumps(LEXICON))
    (tmp_path / "own_checker.py").write_text("import json\ndef check(text, terms):\n    return ('checked', None, json.dumps({'version': '1', 'mode': 'm', 'ok': True, 'findings': []}))\n")
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_checker.py"))
    args = ["run", "--tasks", f"{tmp_path}/a.jsonl", "--decoding", "thinking", "--samples", "2", "--arms", "A1", "A0", "--lexicon", f"{tmp_path}/lexicon.json", "--word-list", "--checker", "own_checker:check", "--results", str(tmp_path), "--run-id", "r"]
    assert cli.main(args) == 0
    manifest = files.read_manifest(spark, f"{tmp_path}/r")
    assert manifest["decoding"] == {"temperature": 1.0, "top_p": 0.95, "top_k": 20, "max_new_tokens": 16384, "samples": 2}
    rows = spark.read.json(f"{tmp_path}/r/records").collect()
    assert len(rows) == 8 and {r.checker.status for r in rows} == {"checked"} and all(r.compliance is not None for r in rows)
    ordered = [(r.task_id, r["sample"], r.arm) for r in files.read_records(spark, f"{tmp_path}/r/records").coalesce(1).collect()]
    assert sorted(ordered) == sorted((t, s, a) for t in "ab" for s in (0, 1) for a in ("A1", "A0"))
    capsys.readouterr()
    assert cli.main(["summarize", f"{tmp_path}/r"]) == 0 and "checker_ok=1.000±0.000" in capsys.readouterr().out
    assert cli.main(["preflight", "--backend", "hf", "--out", f"{tmp_path}/p.json"]) in (0, 1)
    assert json.loads((tmp_path / "p.json").read_text()).keys() == {"at", "backend", "problems", "environment"}


def test_artifacts(spark, tmp_path):
    source = files.source_block("T", 9, "2024-01-01", "u", "d")
    rows = spark.createDataFrame([("b", 2), ("a", None)], "id string, n int")
    m = {r.name: r for r in files.write_artifacts(spark, str(tmp_path / "out"), 1, source, rules=rows, none=rows.limit(0)).collect()}
    text = spark.read.text(str(tmp_path / "out" / "rules")).first()[0]
    doc = json.loads(text)
    assert doc["schema_version"] == 1 and doc["source"]["issue"] == "9" and doc["rules"] == [{"id": "a", "n": None}, {"id": "b", "n": 2}]
    assert m["rules"].bytes == len(text.encode()) and files.read_manifest(spark, str(tmp_path / "out"))["artifacts"][0]["name"] == "none"


def test_built_tasks(spark):
    grade = spark.createDataFrame([(k, f"q{k} ", f"so #### 1,{k}00") for k in range(5)], "row int, question string, answer string")
    plain = spark.createDataFrame([(0, "p", "1,234"), (1, "p", "1,-2"), (2, "p", "2.5")], "row int, problem string, answer string")
    open_ = spark.createDataFrame([(0, "who", ["a\"b"]), (1, "who is the newest", ["a"]), (2, "who", ["a", "b"])], "row int, question string, answer array<string>")
    got = {r.id: (r.kind, r.prompt, json.loads(r.answer_json)) for r in files.built_tasks({"grade": grade, "plain": plain, "open": open_}, 1, 4, dict.fromkeys(("grade", "plain", "open"), "L")).collect()}
    assert sum(k.startswith("grade") for k in got) == 4 and got["plain-0000"] == ("math", "p", 1234) and got["plain-0002"][2] == 2.5 and "plain-0001" not in got
    assert [k for k in got if k.startswith("open")] == ["open-0000"] and got["open-0000"] == ("qa", "who", 'a"b')


def test_prompts(spark):
    t = spark.createDataFrame([("A0", "p", ["x"]), ("A1", "p", []), ("A1", "p", None), ("A2", "p", ["x", "y"])], "arm string, prompt string, technical_terms array<string>")
    got = [[(m.role, m.content) for m in r.messages] for r in prompts.assembled(t.withColumn("draft", F.lit("d"))).collect()]
    assert got[0] == [("user", "p")] and got[1] == got[2] and "none" in got[1][0][1] and got[1][1] == ("user", "p")
    assert "x, y" in got[3][0][1] and got[3][1][1].endswith("d") and prompts.INSTRUCTION[2] not in got[3][0][1]


def test_rules_of_a_table(spark):
    table = spark.createDataFrame([("3.5", json.dumps({"ing_approved": ["bling (n)"]}))], "id string, parameters string")
    df = spark.createDataFrame([("bling zing lighting",)], "t string")
    assert df.select(rules.findings(F.col("t")).alias("f")).first().f.ing_words == 2
    assert df.select(rules.findings(F.col("t"), ing_allowed=rules.ing_allowed(table)).alias("f")).first().f.ing_words == 2
    assert df.select(rules.findings(F.col("t"), kind="note").alias("f")).first().f.long_paragraphs == 0


def test_summary_has_the_checker(spark):
    row = "arm string, sample int, correct boolean, truncated boolean, fallback_correct boolean, degenerate boolean, reasoning_tokens int, generated_tokens int, output_tokens int, latency_s double, compliance double, checker struct<status:string,ok:boolean,findings:int,gate_ok:boolean>"
    rows = [("A0", 0, True, False, None, False, 1, 2, 1, 0.5, 0.5, ("checked", True, 0, True)), ("A0", 0, True, False, None, False, 1, 2, 1, 0.5, 0.5, ("checked", False, 4, None)), ("A1", 0, True, False, None, False, 1, 2, 1, 0.5, 0.5, ("skipped", None, None, None)), ("A1", 0, True, False, None, False, 1, 2, 1, 0.5, 0.5, None)]
    a = stats.spread(stats.per_sample(spark.createDataFrame(rows, row)))
    got = {r.arm: (r.n_checked, r.checker_ok, r.gate_ok, r.findings) for r in a.collect()}
    assert got == {"A0": (2, 0.5, 1.0, 2.0), "A1": (0, None, None, None)}
    lines = stats.summary_lines(a, stats.tax(a))
    assert "checked=2" in lines[0] and "checker_ok n/a" in lines[2]


def test_details_are_whole_json(spark):
    """p13 against the rows it is made of."""
    from tidemill.operators import report

    rows = [("ste", "a (n)", 'say "no"\nnow', 0.12345, [("finding", "not_approved", "a\\b", None)]), ("nonste", "b (v)", None, 2.0, [])]
    made = spark.createDataFrame(rows, "side string, entry string, text string, seconds double, items array<struct<group: string, kind: string, token: string, origin: string>>")
    got = [json.loads(r.detail) for r in made.select(report.detail_json().alias("detail")).collect()]
    names = ("group", "kind", "token", "origin")
    assert got == [{"side": s, "entry": e, "text": t, "seconds": round(n, 3), "items": [dict(zip(names, i, strict=True)) for i in items]} for s, e, t, n, items in rows]


def test_contractions_and_sentence_case(spark):
    """r4 and c9 against Python on ASCII texts."""
    import re

    from tidemill.functions import text as X

    cases = ["It's what she's said; don't, we've I'll THEY'RE", "that’s not its", "", "x'd 'd can't", "no contraction's here"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(rules.findings(F.col("t")).alias("f"), X.sentence_case(F.upper("t")).alias("s")).collect()
    pattern = re.compile(r"\b[a-z]+(n['’]t|['’](re|ve|ll|d|m))\b|\b(it|that|there|he|she|what|let)['’]s\b", re.I)
    assert [r.f.contractions for r in got] == [len(pattern.findall(c)) for c in cases]
    assert [r.s for r in got] == [re.sub(r"(^|[.!?:]\s+|\(\w\)\s+)([a-z])", lambda m: m[1] + m[2].upper(), c.upper().lower()) for c in cases]


def test_soft_hyphens_of_page_rows(spark):
    rows = spark.createDataFrame([("b", "p", k, h) for k, h in enumerate(["COUNTER-", "CLOCK-", "WISE (adj)", "A-", "1", "X-"])], "book string, page string, group_no int, head string")
    assert [r.head for r in headwords.from_rows(rows).orderBy("seq").collect()] == ["COUNTERCLOCK-", "", "WISE (adj)", "A-", "1", "X-"]


def test_targets(spark):
    df = spark.createDataFrame([("Few", ["Fewer Ones"], "a few")], "w string, f array<string>, q string")
    assert set(df.select(lexicon.targets(F.col("w"), F.col("f"), F.col("q"))).first()[0]) == {"few", "fewer ones", "fewer", "ones", "a few", "a"}


def test_verify_with_all_files(spark, tmp_path, capsys):
    import hashlib

    from tidemill.__main__ import main

    (tmp_path / "lexicon.json").write_text(json.dumps(LEXICON))
    entry = {"word": "CUT", "pos": "v", "qualifier": None, "status": {"kind": "approved"}, "forms": ["CUTS"], "ste_example": "CUT THE WIRE (5 mm).", "nonste_example": "Slice it."}
    entries = [entry, entry | {"word": "pump"}, entry | {"word": "SEAL", "ste_example": "SEAL the box."}, entry | {"word": "X", "pos": "zzz"}, entry | {"word": "OPEN", "nonste_example": "Blank Page"}, entry]
    (tmp_path / "dictionary.json").write_text(json.dumps({"entries": entries}))
    row = {"id": "5.1", "section": {"number": 5, "title": "t"}, "title": "t", "paraphrase": "Write a maximum of 20 words.", "check": "c", "parameters": {"max_words_per_sentence": 25, "approved_ing": ["cut (v)", "going (n)"]}}
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [row, row | {"id": "6.3", "parameters": {"max_words_per_sentence": 20}}]}))
    (tmp_path / "text.txt").write_text("Approved words that have an \u201c-ing\u201d form: cut, going. A sentence in a note is 20 words.")
    (tmp_path / "verbs.txt").write_text("CUT\nSEAL\n\nOPEN\nTURN\n")
    kept = {p: (tmp_path / p).read_bytes() for p in ("lexicon.json", "dictionary.json", "rules.json")}
    artifacts = [{"path": p, "bytes": len(x), "digest": hashlib.sha256(x).hexdigest()} for p, x in kept.items()]
    (tmp_path / "manifest.json").write_text(json.dumps({"artifacts": artifacts[:2] + [artifacts[2] | {"digest": "0"}, {"path": "gone.json", "bytes": 1, "digest": "1"}]}))
    line = ["verify", "--lexicon", str(tmp_path / "lexicon.json")]
    for name, file in (("dictionary", "dictionary.json"), ("rules", "rules.json"), ("text", "text.txt"), ("verbs", "verbs.txt"), ("manifest", "manifest.json")):
        line += [f"--{name}", str(tmp_path / file)]
    assert main(line) == 1
    said = capsys.readouterr().out.splitlines()
    faults = [x.removeprefix("fault ") for x in said if x.startswith("fault ")]
    of = lambda check: [json.loads(x.split(": ", 1)[1]) for x in faults if x.startswith(f"{check}: ")]
    assert {(x["word"], x["fault"]) for x in of("entry")} == {("pump", "case"), ("X", "pos")}
    assert {x["word"] for x in of("case")} == {"pump"}
    assert {x["word"]: x["blank"] for x in of("example")} == {"SEAL": False, "OPEN": True}
    assert [(x["word"], x["n"]) for x in of("key")] == [("CUT", 2)]
    assert {(x["word"], x["side"]) for x in of("verbs")} == {("TURN", "listed"), ("pump", "parsed")}
    assert {(x["rule"], x["parameter"], x.get("value"), x.get("stated")) for x in of("parameter")} >= {("5.1", "max_words_per_sentence", 25, 20)}
    assert not [x for x in of("parameter") if x["rule"] == "6.3"]
    assert {x["id"] for x in of("ing")} == {"going (n)"}
    assert {(x["path"], x["gap"]) for x in of("artifact")} == {("gone.json", "missing"), ("rules.json", "digest")}
    assert "count entries: 6, keys: 5, words: 5" in said
