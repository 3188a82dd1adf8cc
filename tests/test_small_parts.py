"""Parts that no query shows: pinned downloads, task files, biased scores, records of whole sequences, dictionary lines."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import compliance, lexicon, watermark
from tidemill.sources import checkers, files


def test_pinned_file(spark, tmp_path):
    (tmp_path / "up.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    digest = hashlib.sha256((tmp_path / "up.jsonl").read_bytes()).hexdigest()
    assert sorted(r.a for r in files.pinned(spark, str(tmp_path / "up.jsonl"), digest).collect()) == [1, 2]
    with pytest.raises(ValueError, match="instead of 0"):
        files.pinned(spark, str(tmp_path / "up.jsonl"), "0")


def test_written_tasks_are_one_file_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i:03}", "math", f"é {i}", None) for i in (5, 1, 3, 2, 4)], "id string, kind string, prompt string, answer string").repartition(4)
    files.write_tasks(rows, str(tmp_path / "tasks"))
    (part,) = (tmp_path / "tasks").glob("part-*")
    lines = [json.loads(x) for x in part.read_text().splitlines()]
    assert [x["id"] for x in lines] == ["t001", "t002", "t003", "t004", "t005"] and lines[0]["prompt"] == "é 1"
    with pytest.raises(Exception, match="exist"):
        files.write_tasks(rows, str(tmp_path / "tasks"))


def test_biased_scores(spark):
    df = spark.createDataFrame([([0.5, 1.0, -1.0], [0, 2]), ([], []), (None, None)], "s array<double>, g array<int>")
    assert [r.b for r in df.select(watermark.biased(F.col("s"), F.col("g"), 2.0).alias("b")).collect()] == [[2.5, 1.0, 1.0], [], None]
    scheme = watermark.Scheme(40)
    green = watermark.green_list(scheme, 7)
    (r,) = spark.createDataFrame([([0.0] * 40, sorted(green))], "s array<double>, g array<int>").select(watermark.biased(F.col("s"), F.col("g"), 1.0).alias("b")).collect()
    assert {i for i, x in enumerate(r.b) if x} == green and len(green) == 10


def test_green_lists_of_a_large_vocabulary(spark):
    scheme, prevs = watermark.Scheme(151_936), [0, 7, 151_935, 7]
    table = watermark.green_table(spark.createDataFrame([(p,) for p in prevs] + [(None,)], "prev long"), scheme)
    assert sorted(r.prev for r in table.select("prev").collect()) == [0, 7, 151_935]
    tokens = [0, 1, 63, 64, 65, 4095, 151_935, 151_936, -1, *range(1000, 1400)]
    pairs = spark.createDataFrame([(p, t) for p in set(prevs) for t in tokens], "prev long, cur long")
    lists = {p: watermark.green_list(scheme, p) for p in set(prevs)}
    for r in watermark.membership(pairs, scheme, table).collect():
        assert r.green == (r.cur in lists[r.prev])
    assert {len(x) for x in lists.values()} == {37_984}


def test_records_of_sequences_and_of_rows_agree(spark):
    seqs = [("t", "A0", [1, 2, 3, 4, 5, 6]), ("t", "A1", [7, 8, 9]), ("u", "A0", [4]), (None, "A0", [1, 2])]
    scheme = watermark.Scheme(50)
    arrays = spark.createDataFrame(seqs, "task string, arm string, tokens array<long>")
    rows = spark.createDataFrame([(t, a, k, x) for t, a, ids in seqs[:3] for k, x in enumerate(ids)], "task string, arm string, pos long, token long")
    columns = ["task", "arm", "tokens", "z_full", "matched_len", "z_matched"]
    known = watermark.watermark_records(arrays.filter("task IS NOT NULL"), scheme).select(*columns).collect()
    assert sorted(map(tuple, known)) == sorted(map(tuple, watermark.row_records(rows, scheme, "pos").select(*columns).collect()))


def test_lines_of_entries(spark):
    lines = [(1, 0, "a thing", False, False), (1, 1, "of two parts", False, False), (1, 2, "help here", False, True), (1, 3, "CUT (v)", True, False), (1, 4, "more help", False, False), (2, 0, "word", False, False)]
    got = {r.entry: tuple(r)[1:] for r in lexicon.entry_lines(spark.createDataFrame(lines, "entry int, seq int, text string, is_reference boolean, is_help boolean")).collect()}
    assert got == {1: ("a thing of two parts", "CUT (v)", "help here more help"), 2: ("word", "", "")}


def test_plurals_of_nouns_and_senses(spark):
    nouns = spark.createDataFrame([("valve", "n"), ("cut", "v")], "word string, pos string")
    assert {r.word: r.plural for r in compliance.with_plural(nouns).collect()} == {"valve": "valves", "cut": None}
    senses = spark.createDataFrame([("valve", True), ("x", False)], "token string, approved boolean")
    assert [r.token for r in checkers.lookup(spark.createDataFrame([("VALVE",), ("valve",), ("y",)], "token string"), senses).collect()] == ["valve"]


def test_phrases_of_known_words(spark):
    approved = spark.createDataFrame([(1, "set (v)", "set", "v", ["sets"]), (2, "up (adv)", "up", "adv", [])], "seq int, id string, word string, pos string, forms array<string>")
    asked = spark.createDataFrame([("set up", None), ("set up", "v"), ("set down", None), ("sets", "v"), ("up", "n")], "word string, pos string")
    got = sorted((r.word, str(r.pos), r.how) for r in lexicon.resolved(asked, approved).collect())
    assert got == [("set down", "None", "unresolved"), ("set up", "None", "phrase"), ("set up", "v", "phrase"), ("sets", "v", "form"), ("up", "n", "any")]
