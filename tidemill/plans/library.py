r"""Queries of the operators over the driver's tables, each with the SQL that states its result.

The tables hold no arm records, lexicons or checker reports, so queries derive them: records from
documents (nine to a task), a lexicon from the words and word pairs of benchmark, reports from
events, entries and alternatives from part names.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import exact
from tidemill.functions import text as X
from tidemill.operators import compliance, headwords, layout, lexicon, report, reviews, rules, scoring, stats, validation, verification, watermark
from tidemill.plans.registry import query
from tidemill.sources import files

#: DuckDB's upper() leaves the German sharp s, which Spark's makes SS.
UP = "upper(replace({}, 'ß', 'ss'))"
TOKENS = f"regexp_extract_all({UP.format('text')}, '[A-Z0-9][A-Z0-9\\-'']*')"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text -------------------------------------------------------------------------------------


@query("c1_tokenize", f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def c1_tokenize(spark, d):
    t = X.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


LEXICON_SQL = f"""
w AS (SELECT item_id, {TOKENS} AS t FROM benchmark),
u AS (SELECT item_id, i, t[i] AS a, t[i + 1] AS b FROM w, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
lex AS (
  SELECT a AS phrase FROM u GROUP BY a HAVING count(*) >= 3
  UNION SELECT a || ' ' || b FROM u WHERE b IS NOT NULL GROUP BY a || ' ' || b HAVING count(*) >= 2
)"""


def _lexicon(spark, d) -> DataFrame:
    t = _t(spark, d, "benchmark").select(X.tokens(F.col("text")).alias("t"))
    u = t.select(F.explode(F.transform("t", lambda a, i: F.struct(a.alias("a"), F.get("t", i + 1).alias("b")))).alias("p")).select("p.*")
    one = u.groupBy(F.col("a").alias("phrase")).agg(F.count("*").alias("n")).filter("n >= 3")
    two = u.filter("b IS NOT NULL").groupBy(F.concat_ws(" ", "a", "b").alias("phrase")).agg(F.count("*").alias("n")).filter("n >= 2")
    return one.union(two).select("phrase").distinct()


@query("c3_phrase_set", f"WITH {LEXICON_SQL} SELECT phrase, len(string_split(phrase, ' '))::INT AS n_words FROM lex")
def c3_phrase_set(spark, d):
    return _lexicon(spark, d).select("phrase", F.size(F.split("phrase", " ")).alias("n_words"))


def _walk_sql(tokens: str) -> str:
    """Greedy matches of a lexicon of at most two words: of neighbouring places whose pair is in it, every second is
    taken. tokens: a query of k1, k2, t."""
    return f"""u2 AS (SELECT k1, k2, i, t[i] AS a, t[i + 1] AS b FROM ({tokens}), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
pr AS (SELECT u2.*, l2.phrase IS NOT NULL AS pair, l1.phrase IS NOT NULL AS one FROM u2 LEFT JOIN lex l2 ON l2.phrase = a || ' ' || b LEFT JOIN lex l1 ON l1.phrase = a),
rn AS (SELECT *, pair AND (i - max(CASE WHEN pair THEN 0 ELSE i END) OVER (PARTITION BY k1, k2 ORDER BY i)) % 2 = 1 AS taken FROM pr),
tk AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY k1, k2 ORDER BY i), false) AS second FROM rn)"""


_BOTH_TEXTS = "SELECT 'conversation' AS kind, conv_id AS k1, turn AS k2, text FROM conversations UNION ALL SELECT 'document', -1 - doc_id, 0, text FROM documents"


def _both_texts(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    return c.unionByName(_t(spark, d, "documents").select((-1 - F.col("doc_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text"))


@query("c4_greedy_match", f"""
WITH {LEXICON_SQL}, src AS ({_BOTH_TEXTS}), {_walk_sql(f"SELECT k1, k2, {TOKENS} AS t FROM src")},
r AS (SELECT k1, k2, count(*) FILTER (taken OR (one AND NOT second)) AS good, count(*) FILTER (NOT taken AND NOT second AND NOT one) AS bad,
  md5(coalesce(string_agg(a, ' ' ORDER BY i) FILTER (NOT taken AND NOT second AND NOT one), '')) AS bad_md5 FROM tk GROUP BY k1, k2)
SELECT src.k1 AS conv_id, src.k2 AS turn, coalesce(good, 0)::INT AS n_conforming, coalesce(bad, 0)::INT AS n_nonconforming, coalesce(bad_md5, md5('')) AS nonconforming_md5 FROM src LEFT JOIN r ON src.k1 = r.k1 AND src.k2 = r.k2
""")  # fmt: skip
def c4_greedy_match(spark, d):
    """Conversations, and documents under negative ids."""
    match = compliance.match(spark, compliance.lexicon_of(_lexicon(spark, d)))
    m = _both_texts(spark, d).select("conv_id", "turn", match(X.tokens(F.col("text"))).alias("m"))
    return m.select("conv_id", "turn", F.size("m.conforming").alias("n_conforming"), F.size("m.nonconforming").alias("n_nonconforming"), F.md5(F.array_join("m.nonconforming", " ")).alias("nonconforming_md5"))


@query("c5_naive_compliance", f"""
WITH {LEXICON_SQL}, src AS ({_BOTH_TEXTS}),
{_walk_sql(f"SELECT k1, k2, list_filter({TOKENS}, lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('THE', 'THES', 'THEES', 'ANSWER', 'ANSWERS', 'ANSWERES')) AS t FROM src")},
r AS (SELECT k1, k2, count(*) FILTER (taken OR second OR one) AS good, count(*) AS every, count(DISTINCT a) FILTER (NOT taken AND NOT second AND NOT one) AS flagged,
  md5(coalesce(string_agg(DISTINCT a, ' ' ORDER BY a) FILTER (NOT taken AND NOT second AND NOT one), '')) AS flagged_md5 FROM tk GROUP BY k1, k2)
SELECT src.k1 AS conv_id, src.k2 AS turn, round(good / every, 6) AS rate, coalesce(flagged, 0)::INT AS n_flagged, coalesce(flagged_md5, md5('')) AS flagged_md5 FROM src LEFT JOIN r ON src.k1 = r.k1 AND src.k2 = r.k2
""")  # fmt: skip
def c5_naive_compliance(spark, d):
    """The same texts with two declared terms of one word each, which go before the lexicon is matched."""
    rate = compliance.naive(spark, compliance.lexicon_of(_lexicon(spark, d)))
    c = _both_texts(spark, d).select("conv_id", "turn", rate(F.col("text"), F.array(F.lit("the"), F.lit("answer"))).alias("c"))
    return c.select("conv_id", "turn", F.round("c.rate", 6).alias("rate"), F.size("c.words").alias("n_flagged"), F.md5(F.array_join("c.words", " ")).alias("flagged_md5"))


_PART_WORDS = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"


def _part_words(spark, d):
    return _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()


@query("c6_term_phrases", rf"""
SELECT w, unnest(list_filter([upper(w), upper(w) || 'S', upper(w) || 'ES',
  CASE WHEN regexp_matches(upper(w), '[^AEIOU]Y$') THEN upper(w)[:-2] || 'IES' END], lambda x: x IS NOT NULL)) AS phrase FROM {_PART_WORDS}
WHERE regexp_full_match(w, '[a-z]+')
""")  # fmt: skip
def c6_term_phrases(spark, d):
    return _part_words(spark, d).filter("w rlike '^[a-z]+$'").select("w", F.explode(X.term_phrases(F.array("w"))).alias("phrase"))


@query("c7_plural", rf"""
SELECT w, CASE WHEN regexp_matches(lower(w), '(s|x|z|ch|sh)$') THEN w || 'es'
  WHEN regexp_matches(lower(w), '[^aeiou]y$') THEN w[:-2] || 'ies' ELSE w || 's' END AS plural FROM {_PART_WORDS}
""")  # fmt: skip
def c7_plural(spark, d):
    return _part_words(spark, d).select("w", X.plural(F.col("w")).alias("plural"))


def _cut(end, add):
    n = len(end)
    return ", ".join(f"CASE WHEN w LIKE '%{end}' AND length(w) > {n + 2} THEN w[:-{n + 1}] || '{a}' END" for a in (add, "e"))


@query("c8_stems", f"""
WITH b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents))
SELECT w, array_to_string(list_sort(list_distinct(list_filter([w, {_cut('ies', 'y')}, {_cut('ied', 'y')}, {_cut('es', '')}, {_cut('ed', '')}, {_cut('ing', '')},
  CASE WHEN w LIKE '%s' OR w LIKE '%d' THEN w[:-2] END], lambda x: x IS NOT NULL))), ' ') AS stems FROM b
""")  # fmt: skip
def c8_stems(spark, d):
    both = _t(spark, d, "benchmark").select("text").union(_t(spark, d, "documents").select("text"))
    b = both.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return b.select("w", F.array_join(F.array_sort(X.stems(F.col("w"))), " ").alias("stems"))


@query("c9_sentence_case", r"""WITH s AS (SELECT doc_id, lower(text) AS t FROM documents),
p AS (SELECT doc_id, regexp_extract_all(t, '[.!?:]\s+[a-z]|\(\w\)\s+[a-z]|(?s:.)') AS x FROM s)
SELECT doc_id, md5(coalesce(array_to_string(list_transform(x, lambda y, i: CASE WHEN length(y) > 1 OR (i = 1 AND y BETWEEN 'a' AND 'z') THEN y[:-2] || upper(y[-1]) ELSE y END), ''), '')) AS text_md5 FROM p
""")  # fmt: skip
def c9_sentence_case(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(X.sentence_case(F.col("text"))).alias("text_md5"))


@query("c10_words", "SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*[A-Za-z]|[A-Za-z]') AS w FROM documents)")
def c10_words(spark, d):
    w = X.words_of(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, " ")).alias("words_md5"))


# ---- scores -----------------------------------------------------------------------------------


@query("t6_score", """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 3 AS g FROM orders)
SELECT o_orderkey, CASE WHEN k = 4 THEN 'writing' WHEN g = 0 THEN 'qa' ELSE 'math' END AS kind,
  CASE WHEN k = 4 THEN NULL WHEN k IN (0, 1) THEN k = 0 ELSE false END AS correct,
  CASE WHEN k = 4 OR k IN (0, 1) THEN NULL WHEN k = 2 THEN true ELSE false END AS fallback
FROM o
""")  # fmt: skip
def t6_score(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    k, g, n = F.col("o_orderkey") % 5, F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    kind = F.when(k == 4, "writing").when(g == 0, "qa").otherwise("math")
    gold = F.when(g == 0, F.concat(F.lit("part "), n)).otherwise(n)
    wrong = F.when(g == 0, F.lit("another")).otherwise(F.concat(n, F.lit("9")))
    text = F.when(k == 0, F.concat(F.lit("Answer: "), wrong, F.lit("\nso\nAnswer:\n "), gold, F.lit(" it is"))).when(k == 1, F.concat(gold, F.lit("\nAnswer: "), wrong)).when(k == 2, F.concat(F.lit("it is "), gold)).otherwise(F.concat(F.lit("it is "), wrong))
    s = scoring.score(F.col("kind"), F.col("o_orderkey").cast("double"), F.concat(F.lit("Part "), n), F.col("text"))
    return o.select("o_orderkey", kind.alias("kind"), text.alias("text")).withColumn("s", s).select("o_orderkey", "kind", "s.correct", "s.fallback")


@query("t7_degenerate", rf"SELECT doc_id, len({TOKENS}) < 2 OR regexp_matches(ltrim(text), '^(I cannot|I can''t|I''m sorry|I am sorry|I’m sorry|I can’t)') AS degenerate FROM documents")
def t7_degenerate(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.degenerate(F.col("text")).alias("degenerate"))


#: The letters of a text as ids; T opens and the first full stop ends the reasoning.
@query("t8_split_ids", """WITH c AS (SELECT conv_id, turn, turn % 2 = 1 AS opened, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda x: x <> ''), lambda x: ord(x)::BIGINT) AS ids FROM conversations),
e AS (SELECT *, coalesce(list_position(ids, 46), 0) AS pos FROM c), h AS (SELECT *, CASE WHEN pos > 0 THEN ids[1:pos - 1] ELSE ids END AS head FROM e), s AS (SELECT *, coalesce(list_position(head, 84), 0) AS start FROM h),
r AS (SELECT conv_id, turn, ids, CASE WHEN pos > 0 AND start > 0 THEN head[start + 1:] WHEN pos > 0 THEN head WHEN start > 0 THEN head[start + 1:] WHEN opened THEN ids ELSE [] END AS reasoning,
  CASE WHEN pos > 0 AND start > 0 THEN list_concat(head[1:start - 1], ids[pos + 1:]) WHEN pos > 0 THEN ids[pos + 1:] WHEN start > 0 THEN head[1:start - 1] WHEN opened THEN [] ELSE ids END AS final FROM s)
SELECT conv_id, turn, len(reasoning)::INT AS reasoning_tokens, len(final)::INT AS final_tokens, md5(array_to_string(reasoning, ',')) AS reasoning_md5, md5(array_to_string(final, ',')) AS final_md5 FROM r""")  # fmt: skip
def t8_split_ids(spark, d):
    letters = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: x != "")
    c = _t(spark, d, "conversations").withColumn("ids", F.transform(letters, lambda x: F.ascii(x).cast("long")))
    s = c.withColumn("s", X.split_think_ids(F.col("ids"), ord("T"), ord("."), F.col("turn") % 2 == 1))
    joined = lambda a: F.md5(F.array_join(F.transform(a, lambda i: i.cast("string")), ","))
    return s.select("conv_id", "turn", F.size("s.reasoning").alias("reasoning_tokens"), F.size("s.final").alias("final_tokens"), joined(F.col("s.reasoning")).alias("reasoning_md5"), joined(F.col("s.final")).alias("final_md5"))


@query("t9_think_split", """
WITH c AS (SELECT conv_id, turn, text AS x, (conv_id + turn) % 4 AS k FROM conversations)
SELECT conv_id, turn,
  md5(CASE k WHEN 0 THEN x WHEN 1 THEN x WHEN 2 THEN '' ELSE x END) AS reasoning_md5,
  md5(CASE k WHEN 0 THEN 'a' || 'b' WHEN 1 THEN 'b' WHEN 2 THEN x ELSE 'a' END) AS final_md5 FROM c
""")  # fmt: skip
def t9_think_split(spark, d):
    c = _t(spark, d, "conversations")
    k, x = (F.col("conv_id") + F.col("turn")) % 4, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("a<think>"), x, F.lit("</think>b"))).when(k == 1, F.concat(x, F.lit("</think>b"))).when(k == 2, x).otherwise(F.concat(F.lit("a<think>"), x))
    s = X.split_think(F.col("made"), F.lit(False))
    return c.withColumn("made", made).withColumn("s", s).select("conv_id", "turn", F.md5("s.reasoning").alias("reasoning_md5"), F.md5("s.final").alias("final_md5"))


# ---- records and statistics -------------------------------------------------------------------

RECORDS_SQL = f"""
rec AS (
  SELECT d.doc_id // 9 AS task_id, 'A' || (d.doc_id % 3) AS arm, (d.doc_id // 3) % 3 AS sample, l.quality = 1 AS correct,
    (d.doc_id % 10) = 7 AS truncated, d.doc_id % 4 <> 0 AS checked, d.doc_id % 5 = 0 AS ok, d.doc_id % 6 AS findings, CASE WHEN d.doc_id % 7 <> 0 THEN d.doc_id % 2 = 0 END AS gate_ok, len({TOKENS}) AS output_tokens, len({TOKENS}) * 2 AS generated_tokens
  FROM documents d LEFT JOIN labels l USING (doc_id)
), smp AS (
  SELECT arm, sample, count(*) AS n, avg(correct::INT) FILTER (NOT truncated) AS accuracy, avg(output_tokens) AS output, avg(generated_tokens) AS generated,
    count(*) FILTER (checked) AS n_checked, avg(ok::INT) FILTER (checked) AS checker_ok, avg(gate_ok::INT) FILTER (checked) AS gate_ok, avg(findings) FILTER (checked) AS findings
  FROM rec GROUP BY arm, sample
), arms AS (
  SELECT arm, count(DISTINCT sample) AS k, sum(n)::BIGINT AS n, list_sum(list_sort(list(accuracy))) / count(accuracy) AS accuracy, CASE WHEN count(accuracy) = 1 THEN 0.0 ELSE stddev_samp(accuracy) END AS accuracy_sd,
    list_sum(list_sort(list(output))) / count(output) AS output, CASE WHEN count(output) = 1 THEN 0.0 ELSE stddev_samp(output) END AS output_sd, list_sum(list_sort(list(generated))) / count(generated) AS generated,
    sum(n_checked)::BIGINT AS n_checked, list_sum(list_sort(list(checker_ok))) / count(checker_ok) AS checker_ok, CASE WHEN count(checker_ok) = 1 THEN 0.0 ELSE stddev_samp(checker_ok) END AS checker_ok_sd, list_sum(list_sort(list(gate_ok))) / count(gate_ok) AS gate_ok, list_sum(list_sort(list(findings))) / count(findings) AS findings
  FROM smp GROUP BY arm
)"""


def _records(spark, d) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels").select("doc_id", "quality")
    i, n = F.col("doc_id"), F.size(X.tokens(F.col("text")))
    nothing = lambda kind: F.lit(None).cast(kind)
    return docs.join(labels, "doc_id", "left").select(
        F.expr("doc_id div 9").alias("task_id"), F.concat(F.lit("A"), i % 3).alias("arm"), (F.expr("doc_id div 3") % 3).alias("sample"), (F.col("quality") == 1).alias("correct"),
        nothing("boolean").alias("fallback_correct"), (i % 10 == 7).alias("truncated"), F.lit(False).alias("degenerate"), n.alias("output_tokens"), (n * 2).alias("generated_tokens"), n.alias("reasoning_tokens"),
        nothing("double").alias("latency_s"), nothing("double").alias("compliance"),
        F.struct(F.when(i % 4 != 0, "checked").otherwise("skipped").alias("status"), (i % 5 == 0).alias("ok"), (i % 6).cast("int").alias("findings"), F.when(i % 7 != 0, i % 2 == 0).alias("gate_ok")).alias("checker"), F.lit("qa").alias("kind"), (i % 3 == 2).alias("has_rewrite"),
    )


@query("g2_per_sample", f"WITH {RECORDS_SQL} SELECT arm, sample, n, n_checked, round(accuracy, 6) AS accuracy, round(output, 6) AS output, round(checker_ok, 6) AS checker_ok, round(gate_ok, 6) AS gate_ok, round(findings, 6) AS findings FROM smp")
def g2_per_sample(spark, d):
    return stats.per_sample(_records(spark, d)).select("arm", "sample", "n", "n_checked", *[F.round(c, 6).alias(c) for c in ("accuracy", "output", "checker_ok", "gate_ok", "findings")])


@query("g3_arm_summary", f"WITH {RECORDS_SQL} SELECT arm, k, n, n_checked, round(accuracy, 6) AS accuracy, round(accuracy_sd, 6) AS accuracy_sd, round(output, 6) AS output, round(output_sd, 6) AS output_sd, round(checker_ok, 6) AS checker_ok, round(checker_ok_sd, 6) AS checker_ok_sd, round(gate_ok, 6) AS gate_ok, round(findings, 6) AS findings FROM arms")
def g3_arm_summary(spark, d):
    a = stats.spread(stats.per_sample(_records(spark, d)))
    return a.select("arm", "k", "n", "n_checked", *[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_sd", "output", "output_sd", "checker_ok", "checker_ok_sd", "gate_ok", "findings")])


@query("j12_tax", f"""WITH {RECORDS_SQL} SELECT a.arm, round(a.accuracy - z.accuracy, 6) + 0.0 AS accuracy_diff, round(a.output / z.output, 6) AS output_ratio,
  round(a.generated / z.generated, 6) AS generated_ratio, round(a.checker_ok - z.checker_ok, 6) + 0.0 AS checker_ok_diff, round(a.gate_ok - z.gate_ok, 6) + 0.0 AS gate_ok_diff FROM arms a, arms z WHERE z.arm = 'A0' AND a.arm <> 'A0'""")  # fmt: skip
def j12_tax(spark, d):
    t = stats.tax(stats.spread(stats.per_sample(_records(spark, d))))
    # a difference of nothing has no sign
    return t.select("arm", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("accuracy_diff", "output_ratio", "generated_ratio", "checker_ok_diff", "gate_ok_diff")])


@query("v3_record_violations", """SELECT doc_id // 9 AS task_id, 'A' || (doc_id % 3) AS arm, (doc_id // 3) % 3 AS sample, 'correct_null_iff_writing' AS broken
  FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL""")  # fmt: skip
def v3_record_violations(spark, d):
    return validation.record_violations(_records(spark, d)).select("task_id", "arm", "sample", F.array_join("broken", ",").alias("broken"))


@query("g6_task_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def g6_task_counts(spark, d):
    return stats.task_counts(_t(spark, d, "documents"), "lang", "source")


# ---- reports ----------------------------------------------------------------------------------

#: Reports from events: one for each user, a finding for each event; the token is the value's whole part.
KINDS_SQL = "CASE event_id % 4 WHEN 0 THEN 'not_approved' WHEN 1 THEN 'ing_form' WHEN 2 THEN 'passive' ELSE 'not_approved' END"


def _findings(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_id") % 4 == 1, "ing_form").when(F.col("event_id") % 4 == 2, "passive").otherwise("not_approved")
    return e.select(F.col("user_id").alias("id"), "event_id", kind.alias("kind"), F.concat(F.lit("t"), F.floor("value") % 20).alias("token"), F.when(F.col("event_id") % 7 == 0, "head").alias("headword"))


FINDINGS_SQL = f"f AS (SELECT user_id AS id, event_id, {KINDS_SQL} AS kind, 't' || (floor(value)::BIGINT % 20) AS token, CASE WHEN event_id % 7 = 0 THEN 'head' END AS headword FROM events)"
KEPT_SQL = "kind = 'passive' OR (kind = 'not_approved' AND token NOT IN ('t1', 't2') AND (headword IS NOT NULL OR token IN ('t3', 't4', 't5')))"


@query("v6_gate", f"WITH {FINDINGS_SQL} SELECT id, count(*) AS n_findings, count(*) FILTER ({KEPT_SQL}) AS gate_findings, count(*) FILTER ({KEPT_SQL}) = 0 AS gate_ok FROM f GROUP BY id")
def v6_gate(spark, d):
    known, h = F.array(*map(F.lit, ("t3", "t4", "t5"))), F.array(F.lit("t1"), F.lit("t2"))
    f = _findings(spark, d).withColumn("keep", compliance.gate_keeps(F.struct("kind", "token", "headword"), known, h))
    return f.groupBy("id").agg(F.count("*").alias("n_findings"), F.count_if("keep").alias("gate_findings"), (F.count_if("keep") == 0).alias("gate_ok"))


@query("p5_checked", f"WITH {FINDINGS_SQL} SELECT id, count(*)::INT AS n_findings, concat_ws(',', 'ing_form:' || nullif(count(*) FILTER (kind = 'ing_form'), 0), 'not_approved:' || nullif(count(*) FILTER (kind = 'not_approved'), 0), 'passive:' || nullif(count(*) FILTER (kind = 'passive'), 0)) AS by_kind, coalesce(string_agg(token, ' ' ORDER BY token) FILTER (kind = 'not_approved'), '') AS words FROM f GROUP BY id")
def p5_checked(spark, d):
    r = _findings(spark, d).groupBy("id").agg(F.collect_list(F.struct("kind", "token", "headword")).alias("findings")).withColumn("ok", F.size("findings") == 0)
    c = compliance.checked(r)
    kinds = F.array_sort(F.transform(F.map_entries("by_kind"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return c.select("id", "n_findings", F.array_join(kinds, ",").alias("by_kind"), F.array_join(F.array_sort("words"), " ").alias("words"))


@query("g7_findings_by_kind", f"WITH {FINDINGS_SQL} SELECT kind, count(*) AS n_items, count(DISTINCT id) AS n_examples FROM f GROUP BY kind")
def g7_findings_by_kind(spark, d):
    return compliance.findings_by_kind(_findings(spark, d))


@query("g8_document_frequency", f"WITH w AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS w FROM documents) SELECT w, count(*) AS n FROM w GROUP BY w HAVING count(*) >= 2")
def g8_document_frequency(spark, d):
    return reviews.document_frequency(_t(spark, d, "documents"), X.tokens(F.col("text"))).withColumnRenamed("word", "w")


@query("g11_gate_table", f"""WITH {FINDINGS_SQL}, r AS (SELECT id, count(*) AS every, count(*) FILTER (kind <> 'ing_form') AS no_ing, count(*) FILTER ({KEPT_SQL}) AS gated FROM f GROUP BY id)
SELECT gate, count(*) FILTER (n > 0) AS rejects, round(100.0 * count(*) FILTER (n > 0) / count(*), 4) AS percent
FROM (SELECT id, unnest(['every', 'no_ing', 'gated']) AS gate, unnest([every, no_ing, gated]) AS n FROM r) GROUP BY gate""")  # fmt: skip
def g11_gate_table(spark, d):
    known, h = F.array(*map(F.lit, ("t3", "t4", "t5"))), F.array(F.lit("t1"), F.lit("t2"))
    f = _findings(spark, d).withColumn("keep", compliance.gate_keeps(F.struct("kind", "token", "headword"), known, h))
    r = f.groupBy("id").agg(F.count("*").alias("every"), F.count_if(F.col("kind") != "ing_form").alias("no_ing"), F.count_if("keep").alias("gated"))
    return reviews.gate_table(r, "every", "no_ing", "gated").withColumn("percent", F.round("percent", 4))


@query("j8_origin", f"""WITH {FINDINGS_SQL}, s AS (SELECT 't' || (p_partkey % 12) AS token, p_partkey % 12 = 3 AND p_size > 40 AS approved, p_partkey % 12 = 5 AND p_size % 3 = 0 AS names_term, p_partkey % 12 < 9 AS noun FROM part),
o AS (SELECT token, CASE WHEN bool_or(approved) THEN 'dictionary' WHEN bool_or(names_term) OR NOT bool_or(noun) THEN 'homograph' ELSE 'dictionary' END AS origin FROM s GROUP BY token)
SELECT coalesce(origin, 'unknown') AS origin, count(*) AS n FROM f LEFT JOIN o USING (token) WHERE kind = 'not_approved' GROUP BY 1""")  # fmt: skip
def j8_origin(spark, d):
    s = _t(spark, d, "part").selectExpr("concat('t', p_partkey % 12) AS token", "p_partkey % 12 = 3 AND p_size > 40 AS approved", "p_partkey % 12 = 5 AND p_size % 3 = 0 AS names_term", "p_partkey % 12 < 9 AS noun")
    f = _findings(spark, d).filter("kind = 'not_approved'").join(compliance.origins(s), "token", "left")
    return f.groupBy(F.coalesce("origin", F.lit("unknown")).alias("origin")).agg(F.count("*").alias("n"))


@query("g12_recall", f"""WITH {FINDINGS_SQL}, e AS (SELECT id, max(CASE WHEN kind = 'not_approved' AND token = 't3' THEN 2 WHEN kind IN ('not_approved', 'ing_form') AND token LIKE 't3%' THEN 1 ELSE 0 END) AS h FROM f GROUP BY id)
SELECT CASE h WHEN 2 THEN 'finding' WHEN 1 THEN 'inflected' ELSE 'miss' END AS hit, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY h""")  # fmt: skip
def g12_recall(spark, d):
    i = _findings(spark, d).groupBy("id").agg(F.collect_list(F.struct(F.lit("finding").alias("group"), "kind", "token", F.coalesce("headword", F.lit("")).alias("headword"))).alias("items"))
    told = i.select(compliance.hit(F.col("items"), F.array(F.lit("t3")), F.lit("t3")).alias("hit"))
    return reviews.recall(told).withColumn("share", F.round("share", 6))


#: The sum of a column of doubles as whole numbers of 2**-60, which holds them all; DuckDB's own sum depends on its threads.
EXACT_SUM = "(sum(({} * 1152921504606846976.0)::HUGEINT)::DOUBLE / 1152921504606846976.0)"


@query("g1_exact_mean", f"SELECT l_returnflag, l_linestatus, count(*) AS n, round({EXACT_SUM.format('l_extendedprice')}, 4) AS total, round({EXACT_SUM.format('l_extendedprice')} / count(*), 6) AS mean, round({EXACT_SUM.format('l_discount')} / count(*), 9) AS discount FROM lineitem GROUP BY ALL")
def g1_exact_mean(spark, d):
    found = exact.moments(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"price": F.col("l_extendedprice"), "discount": F.col("l_discount")})
    return found.select("l_returnflag", "l_linestatus", F.col("price_n").alias("n"), F.round("price_sum", 4).alias("total"), F.round("price_mean", 6).alias("mean"), F.round("discount_mean", 9).alias("discount"))


#: Designs from the line items: their number, discount and tax stand for tasks, spread and rates. The quantiles of the fixed levels stand in the SQL.
_Z_ALPHA, _Z_POWER = NormalDist().inv_cdf(1 - 0.0125 / 2), NormalDist().inv_cdf(0.8)


@query("g19_pairs_needed", f"""SELECT l_quantity, l_discount, ceil(power(({_Z_ALPHA!r} + {_Z_POWER!r}) * (0.5 + l_discount) * sqrt(2 * (1 - l_tax)) / ln(1 + l_quantity / 100.0), 2))::BIGINT AS pairs, count(*) AS n
FROM lineitem GROUP BY l_quantity, l_discount, pairs""")  # fmt: skip
def g19_pairs_needed(spark, d):
    designs = _t(spark, d, "lineitem").groupBy("l_quantity", "l_discount", "l_tax").agg(F.count("*").alias("n"))
    pairs = stats.pairs_needed_column(F.lit(0.5) + F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100.0, 0.0125, 0.8)
    return designs.groupBy("l_quantity", "l_discount", pairs.alias("pairs")).agg(F.sum("n").alias("n"))


@query("g20_discordance_power", f"""WITH d AS (SELECT DISTINCT l_quantity, l_discount, l_tax, (abs(l_discount - l_tax) * sqrt(l_quantity * 20) - {_Z_ALPHA!r} * sqrt(l_discount + l_tax)) / sqrt(l_discount + l_tax - (l_discount - l_tax) * (l_discount - l_tax)) AS x
  FROM lineitem WHERE l_discount + l_tax > 0)
SELECT l_quantity, l_discount, l_tax, round(0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: sign(x) * exp((2 * k + 1) * ln(abs(x)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))), 6) AS power FROM d""")  # fmt: skip
def g20_discordance_power(spark, d):
    line = _t(spark, d, "lineitem").filter("l_discount + l_tax > 0").select("l_quantity", "l_discount", "l_tax").distinct()
    power = stats.discordance_power_column(F.col("l_quantity") * 20, F.col("l_discount"), F.col("l_tax"), 0.0125)
    return line.select("l_quantity", "l_discount", "l_tax", F.round(power, 6).alias("power"))


@query("g15_timing", f"SELECT event_type, count(*) AS runs, round({EXACT_SUM.format('value')} / count(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1")
def g15_timing(spark, d):
    return reviews.timing(_t(spark, d, "events").withColumnRenamed("value", "seconds"), "event_type").withColumn("mean", F.round("mean", 6))


@query("o7_top_ties", f"WITH {FINDINGS_SQL} SELECT token, count(*) AS n, min(event_id) AS first_seen FROM f GROUP BY token ORDER BY n DESC, first_seen LIMIT 10")
def o7_top_ties(spark, d):
    counted = _findings(spark, d).groupBy("token").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))
    return reviews.ranked(counted, 10, "first_seen")


# ---- tasks ------------------------------------------------------------------------------------


_V1 = ["", "kind: not math, qa or writing", "license: not a filled string|answer: does not fit the kind", "technical_terms: not a list of filled strings", "meta: not an object", "missing: source", "unknown: extra", "not an object", "not JSON"]


@query("v1_task_errors", f"SELECT o_orderkey, {_V1}[o_orderkey % 9 + 1] AS errors FROM orders")
def v1_task_errors(spark, d):
    good = {"id": "'t{}'", "kind": "'math'", "prompt": "'p'", "answer": "{}", "technical_terms": "['a']", "source": "'s'", "split": "'x'", "license": "'l'"}

    def line(**change):
        body = ", ".join(f'"{k}": {v}' for k, v in (good | change).items() if v is not None).replace("'", '"')
        left, *rest = ("{" + body + "}").split("{}")
        out = F.lit(left)
        for r in rest:
            out = F.concat(out, F.col("o_orderkey").cast("string"), F.lit(r))
        return out

    made = [line(), line(kind="'essay'"), line(answer="true", license="' '"), line(technical_terms="['a', '']"), line(meta="3"), line(source=None), line(extra="1"), F.lit("[1]"), F.lit("{broken")]
    text = F.element_at(F.array(*made), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(validation.task_errors(text), "|").alias("errors"))


@query("v2_duplicate_ids", """WITH v AS (SELECT o_custkey AS id, o_orderkey % 4 AS file_pos, o_orderkey AS line_no FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_pos, line_no) AS k, first_value(line_no) OVER (PARTITION BY id ORDER BY file_pos, line_no) AS fl FROM v)
SELECT id, line_no::VARCHAR AS "where", fl::VARCHAR AS first_where FROM f WHERE k > 1""")  # fmt: skip
def v2_duplicate_ids(spark, d):
    v = _t(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 4).alias("file_pos"), F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").cast("string").alias("where"))
    return validation.duplicates(v)


@query("v10_plain_numbers", r"SELECT o_orderkey, regexp_full_match(x, '-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?') AS plain FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN '-1,' || o_orderkey WHEN 2 THEN o_orderkey || '.5' ELSE 'x' || o_orderkey END AS x FROM orders)")
def v10_plain_numbers(spark, d):
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    x = F.when(k == 0, n).when(k == 1, F.concat(F.lit("-1,"), n)).when(k == 2, F.concat(n, F.lit(".5"))).otherwise(F.concat(F.lit("x"), n))
    return _t(spark, d, "orders").select("o_orderkey", x.rlike(X.PLAIN_NUMBER).alias("plain"))


@query("v11_gold_number", "SELECT o_orderkey, (o_orderkey * 1000)::DOUBLE AS gold FROM orders")
def v11_gold_number(spark, d):
    answer = F.concat(F.lit("steps #### "), F.format_number(F.col("o_orderkey") * 1000, 0))
    return _t(spark, d, "orders").select("o_orderkey", validation.gold_number(answer).alias("gold"))


_DATED = "last|latest|current|currently|now|recent|recently|this year|today|newest"
_SAID = ["the last one", "the latest", "a current one", "currently", "is it now", "a recent one", "recently", "of this year", "of today", "the newest king", "who is next", "lasting", "Last", "no news"]


@query("v9_undated", rf"SELECT p_partkey, p_size % 3 = 1 AND NOT regexp_matches(q, '\b({_DATED})\b') AS kept FROM (SELECT p_partkey, p_size, {_SAID}[p_partkey % {len(_SAID)} + 1] || ' ' || p_type AS q FROM part)")
def v9_undated(spark, d):
    answers = F.array_repeat(F.lit("a"), F.col("p_size") % 3)
    question = F.concat(F.element_at(F.array(*map(F.lit, _SAID)), (F.col("p_partkey") % len(_SAID) + 1).cast("int")), F.lit(" "), "p_type")
    return _t(spark, d, "part").select("p_partkey", validation.undated_single(answers, question).alias("kept"))


@query("v14_repeated_keys", "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def v14_repeated_keys(spark, d):
    return validation.repeated_keys(_t(spark, d, "part"), "p_brand", "p_type", "p_size")


@query("o1_seeded_sample")
def o1_seeded_sample(spark, d):
    """No SQL form: positions come from CPython's generator."""
    return files.seeded_sample(_t(spark, d, "benchmark").select("item_id"), ["item_id"], 20, 7)


@query("o2_stride_sample", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) WHERE r % 7 = 0")
def o2_stride_sample(spark, d):
    return files.stride_sample(_t(spark, d, "part").select("p_partkey"), ["p_partkey"], 7)


# ---- watermark --------------------------------------------------------------------------------


def _token_rows(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("seq"), "ts", "event_id", (F.col("event_id") * 7 % 50).alias("token"))


PAIRS_SQL = "p AS (SELECT user_id AS seq, event_id * 7 % 50 AS prev, lead(event_id * 7 % 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cur, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at FROM events)"


@query("w2_pairs", f"WITH {PAIRS_SQL} SELECT seq, prev, cur, count(*) AS n FROM p WHERE cur IS NOT NULL GROUP BY ALL")
def w2_pairs(spark, d):
    return watermark.row_pairs(_token_rows(spark, d), "ts", "event_id").groupBy("seq", "prev", "cur").agg(F.count("*").alias("n"))


_GREEN = ", ".join(f"({p}, {c})" for p in range(50) for c in sorted(watermark.green_list(watermark.Scheme(50), p)))


@query("w5_detect", f"""WITH {PAIRS_SQL}, g(prev, cur) AS (VALUES {_GREEN}), s AS (SELECT p.seq, count(p.cur) AS scored, count(g.cur) AS greens FROM p LEFT JOIN g ON p.prev = g.prev AND p.cur = g.cur GROUP BY p.seq)
SELECT seq, greens, scored, round(CASE WHEN scored = 0 THEN 0.0 ELSE (greens - 0.25 * scored) / sqrt(scored * 0.25 * 0.75) END, 6) AS z FROM s""")  # fmt: skip
def w5_detect(spark, d):
    r = watermark.detect_rows(_token_rows(spark, d), watermark.Scheme(50), "ts", "event_id")
    return r.select("seq", "greens", "scored", F.round("z", 6).alias("z"))


@query("w3_unique_detect", f"""WITH {PAIRS_SQL}, u AS (SELECT DISTINCT seq, prev, cur FROM p WHERE cur IS NOT NULL), g(prev, cur) AS (VALUES {_GREEN}),
s AS (SELECT e.seq, count(u.cur) AS scored, count(g.cur) AS greens FROM (SELECT DISTINCT seq FROM p) e LEFT JOIN u ON e.seq = u.seq LEFT JOIN g ON u.prev = g.prev AND u.cur = g.cur GROUP BY e.seq)
SELECT seq, greens, scored, round(CASE WHEN scored = 0 THEN 0.0 ELSE (greens - 0.25 * scored) / sqrt(scored * 0.25 * 0.75) END, 6) AS z FROM s""")  # fmt: skip
def w3_unique_detect(spark, d):
    r = watermark.detect_rows(_token_rows(spark, d), watermark.Scheme(50), "ts", "event_id", unique=True)
    return r.select("seq", "greens", "scored", F.round("z", 6).alias("z"))


@query("w4_matched", f"""WITH {PAIRS_SQL}, n AS (SELECT seq, count(*) AS n, min(count(*)) OVER (PARTITION BY seq // 2) AS m FROM p GROUP BY seq), g(prev, cur) AS (VALUES {_GREEN}),
s AS (SELECT n.seq, any_value(n) AS tokens, any_value(m) AS matched_len, count(p.cur) AS scored, count(g.cur) AS greens, count(p.cur) FILTER (p.at < m) AS scored_m, count(g.cur) FILTER (p.at < m) AS greens_m FROM n JOIN p ON n.seq = p.seq LEFT JOIN g ON p.prev = g.prev AND p.cur = g.cur GROUP BY n.seq)
SELECT 't' || (seq // 2) AS task, 'A' || (seq % 2) AS arm, tokens, greens, matched_len, round(CASE WHEN scored = 0 THEN 0.0 ELSE (greens - 0.25 * scored) / sqrt(scored * 0.25 * 0.75) END, 3) AS z_full,
  round(CASE WHEN scored_m = 0 THEN 0.0 ELSE (greens_m - 0.25 * scored_m) / sqrt(scored_m * 0.25 * 0.75) END, 3) AS z_matched FROM s""")  # fmt: skip
def w4_matched(spark, d):
    rows = _token_rows(spark, d).select(F.expr("concat('t', seq div 2)").alias("task"), F.concat(F.lit("A"), (F.col("seq") % 2).cast("string")).alias("arm"), "ts", "event_id", "token")
    return watermark.row_records(rows, watermark.Scheme(50), "ts", "event_id")


# ---- lexicon ----------------------------------------------------------------------------------


def _approved(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("e"), "p_partkey").alias("id"), F.split("p_name", " ")[0].alias("word"), F.when(F.col("p_size") % 2 == 0, "n").otherwise("v").alias("pos"), F.array(F.split("p_name", " ")[0], F.split("p_name", " ")[1]).alias("forms"))


@query("j2_resolve", """
WITH a AS (SELECT p_partkey AS seq, 'e' || p_partkey AS id, string_split(p_name, ' ')[1] AS word, CASE WHEN p_size % 2 = 0 THEN 'n' ELSE 'v' END AS pos, string_split(p_name, ' ')[2] AS form FROM part),
f AS (SELECT seq, id, pos, word AS form FROM a UNION ALL SELECT seq, id, pos, form FROM a WHERE form IS NOT NULL),
k AS (SELECT word, pos, arg_max(id, seq) AS by_key FROM a GROUP BY 1, 2), bf AS (SELECT form, pos, arg_min(id, seq) AS by_form FROM f GROUP BY 1, 2),
bv AS (SELECT form, arg_min(id, seq) AS by_verb FROM f WHERE pos = 'v' GROUP BY 1), ba AS (SELECT word, arg_min(id, seq) AS by_any FROM a GROUP BY 1),
t AS (SELECT p_partkey, string_split(p_name, ' ')[2] AS word, CASE p_partkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'v' ELSE 'adj' END AS pos FROM part)
SELECT t.word, t.pos, coalesce(by_key, by_form, by_verb, by_any) AS ref, CASE WHEN by_key IS NOT NULL THEN 'word' WHEN by_form IS NOT NULL THEN 'form' WHEN by_verb IS NOT NULL THEN 'participle' WHEN by_any IS NOT NULL THEN 'any' ELSE 'unresolved' END AS how
FROM t LEFT JOIN k ON t.word = k.word AND t.pos = k.pos LEFT JOIN bf ON t.word = bf.form AND t.pos = bf.pos LEFT JOIN bv ON t.word = bv.form AND t.pos = 'adj' LEFT JOIN ba ON t.word = ba.word
""")  # fmt: skip
def j2_resolve(spark, d):
    p = F.col("p_partkey") % 3
    t = _t(spark, d, "part").select(F.split("p_name", " ")[1].alias("word"), F.when(p == 0, "n").when(p == 1, "v").otherwise("adj").alias("pos"))
    return lexicon.resolved(t, _approved(spark, d))


@query("p9_lexicon", r"""SELECT word || ' (' || pos || ')' AS id, word, pos, CASE WHEN pos = 'n' THEN CASE WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' WHEN regexp_matches(word, '[^aeiou]y$') THEN word[:-2] || 'ies' ELSE word || 's' END END AS plural
FROM (SELECT lower(string_split(p_name, ' ')[1]) AS word, CASE WHEN p_size % 2 = 0 THEN 'n' ELSE 'v' END AS pos FROM part)""")  # fmt: skip
def p9_lexicon(spark, d):
    return lexicon.built(_approved(spark, d)).select("id", "word", "pos", "plural")


@query("j4_dangling", "SELECT l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def j4_dangling(spark, d):
    refs = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("ref"))
    return lexicon.dangling(refs, _t(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("id")))


@query("j5_multiset_gaps", """WITH l AS (SELECT l_returnflag AS a, l_linenumber AS b FROM lineitem WHERE l_orderkey % 2 = 0), r AS (SELECT l_returnflag AS a, l_linenumber AS b FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT side, a, b, count(*) AS n FROM ((SELECT 'left' AS side, * FROM (FROM l EXCEPT ALL FROM r)) UNION ALL (SELECT 'right' AS side, * FROM (FROM r EXCEPT ALL FROM l))) GROUP BY ALL""")  # fmt: skip
def j5_multiset_gaps(spark, d):
    li = _t(spark, d, "lineitem")
    side = lambda k: li.filter(F.col("l_orderkey") % 2 == k).select(F.col("l_returnflag").alias("a"), F.col("l_linenumber").alias("b"))
    return lexicon.multiset_gaps(side(0), side(1)).groupBy("side", "a", "b").agg(F.count("*").alias("n"))


@query("j6_manifest_gaps", """WITH m AS (SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS bytes, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0),
f AS (SELECT doc_id AS path, n_chars AS bytes, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN f.bytes <> m.bytes THEN 'size' ELSE 'digest' END AS gap
FROM f FULL JOIN m ON f.path = m.path WHERE f.path IS NULL OR m.path IS NULL OR f.bytes <> m.bytes OR f.digest <> m.digest""")  # fmt: skip
def j6_manifest_gaps(spark, d):
    docs, i = _t(spark, d, "documents"), F.col("doc_id")
    m = docs.filter(i % 7 != 0).select(i.alias("path"), F.when(i % 11 == 0, 0).otherwise(F.col("n_chars")).alias("bytes"), F.md5("text").alias("digest"))
    f = docs.filter(i % 5 != 0).select(i.alias("path"), F.col("n_chars").alias("bytes"), F.when(i % 13 == 0, "x").otherwise(F.md5("text")).alias("digest"))
    return validation.file_gaps(m, f)


@query("g14_dictionary_counts", "SELECT count(*) AS entries, count(DISTINCT (p_name, p_type)) AS keys, count(DISTINCT lower(p_name)) AS words FROM part")
def g14_dictionary_counts(spark, d):
    return verification.dictionary_counts(_t(spark, d, "part").select(F.col("p_name").alias("word"), F.col("p_type").alias("pos")))


@query("g18_dictionary_words", "SELECT DISTINCT lower(unnest(string_split(p_name, ' ')[1:2] || [p_brand || 's'])) AS word FROM part UNION SELECT lower(p_type) FROM part UNION SELECT lower(p_brand) FROM part")
def g18_dictionary_words(spark, d):
    a = _approved(spark, d).join(_t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat("p_brand", F.lit("s")).alias("plural")), "seq")
    u = _t(spark, d, "part").select(F.col("p_type").alias("word"), F.array("p_brand").alias("forms"))
    return compliance.dictionary_words(a, u)


# ---- layout -----------------------------------------------------------------------------------


@query("o3_gap_groups", """SELECT user_id, max(g)::BIGINT AS n_groups FROM (SELECT user_id, sum(CASE WHEN gap > 3600 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
FROM (SELECT user_id, ts, event_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id""")  # fmt: skip
def o3_gap_groups(spark, d):
    e = _t(spark, d, "events").withColumn("at", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long"))
    return layout.gap_groups(e, "user_id", F.col("at"), 3600, ["ts", "event_id"]).groupBy("user_id").agg(F.max("group_no").alias("n_groups"))


@query("o6_carry", "SELECT event_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN event_type END AS h FROM events)")
def o6_carry(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("head"))
    return layout.carried(e, "user_id", "event_id", "head").select("event_id", "head")


#: The same scans with all events under one key, which then lies in many blocks.
@query("o3_one_key", """SELECT g AS group_no, count(*) AS n FROM (SELECT sum(CASE WHEN gap > 60 OR gap IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id)::BIGINT AS g
FROM (SELECT ts, event_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (ORDER BY ts, event_id) AS gap FROM events)) GROUP BY g""")  # fmt: skip
def o3_one_key(spark, d):
    e = _t(spark, d, "events").select(F.lit("all").alias("stream"), "ts", "event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("at"))
    return layout.gap_groups(e, "stream", F.col("at"), 60, ["ts", "event_id"], large=0).groupBy("group_no").agg(F.count("*").alias("n"))


@query("o6_one_key", "SELECT event_id, last_value(h IGNORE NULLS) OVER (ORDER BY event_id) AS head FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN event_type END AS h FROM events)")
def o6_one_key(spark, d):
    e = _t(spark, d, "events").select(F.lit(1).alias("book"), "event_id", F.when(F.col("event_id") % 50 == 0, F.col("event_type")).alias("head"))
    return layout.carried(e, "book", "event_id", "head", large=0).select("event_id", "head")


@query("j14_one_row", """WITH s AS (SELECT event_id::DOUBLE AS "right", 's' || event_id AS span FROM events WHERE event_id % 30 = 0), w AS (SELECT event_id AS word, event_id + 0.5 AS mid FROM events WHERE event_id % 30 <> 0)
SELECT w.word, coalesce(s.span, (SELECT arg_max(span, "right") FROM s)) AS hit FROM w ASOF LEFT JOIN s ON s."right" >= w.mid""")  # fmt: skip
def j14_one_row(spark, d):
    e = _t(spark, d, "events")
    s = e.filter("event_id % 30 = 0").select(F.lit(0).alias("row"), F.col("event_id").cast("double").alias("right"), F.concat(F.lit("s"), "event_id").alias("span"))
    w = e.filter("event_id % 30 <> 0").select(F.lit(0).alias("row"), F.col("event_id").alias("word"), (F.col("event_id") + 0.5).alias("mid"))
    return layout.asof_spans(w, s, large=0).select("word", "hit")


@query("w2_one_sequence", "SELECT prev, cur, count(*) AS n FROM (SELECT event_id * 7 % 50 AS prev, lead(event_id * 7 % 50) OVER (ORDER BY ts, event_id) AS cur FROM events) WHERE cur IS NOT NULL GROUP BY ALL")
def w2_one_sequence(spark, d):
    rows = _token_rows(spark, d).withColumn("seq", F.lit(0))
    return watermark.row_pairs(rows, "ts", "event_id", large=0).groupBy("prev", "cur").agg(F.count("*").alias("n"))


@query("j13_band_join", """WITH w AS (SELECT event_id % 20 AS page, event_id::DOUBLE AS y FROM events), r AS (SELECT (event_id * 3) % 20 AS page, (event_id * 3)::DOUBLE AS y FROM events)
SELECT w.page, w.y, min(r.y) AS rule FROM w LEFT JOIN r ON w.page = r.page AND r.y >= w.y - 7.0 AND r.y <= w.y + 2.0 GROUP BY 1, 2""")  # fmt: skip
def j13_band_join(spark, d):
    e = _t(spark, d, "events")
    w = e.select((F.col("event_id") % 20).alias("page"), F.col("event_id").cast("double").alias("y"))
    r = e.select((F.col("event_id") * 3 % 20).alias("page"), (F.col("event_id") * 3.0).alias("y"))
    return layout.band_join(w, r, 7.0, 2.0)


@query("j14_asof_span", """WITH s AS (SELECT user_id AS row, event_id::DOUBLE AS "right", 's' || event_id AS span FROM events WHERE event_id % 3 = 0), w AS (SELECT user_id AS row, event_id AS word, event_id + 0.5 AS mid FROM events WHERE event_id % 3 <> 0)
SELECT w.row, w.word, coalesce((SELECT arg_min(span, "right") FROM s WHERE s.row = w.row AND s."right" >= w.mid), (SELECT arg_max(span, "right") FROM s WHERE s.row = w.row)) AS hit FROM w""")  # fmt: skip
def j14_asof_span(spark, d):
    e = _t(spark, d, "events")
    s = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("row"), F.col("event_id").cast("double").alias("right"), F.concat(F.lit("s"), "event_id").alias("span"))
    w = e.filter("event_id % 3 <> 0").select(F.col("user_id").alias("row"), F.col("event_id").alias("word"), (F.col("event_id") + 0.5).alias("mid"))
    return layout.asof_spans(w, s)


# ---- rules ------------------------------------------------------------------------------------


@query("r3_r5_rule_findings", r"SELECT doc_id, len(regexp_extract_all(text, ';'))::INT AS semicolons, len(list_filter(regexp_extract_all(lower(text), '\b[a-z]+ing\b'), lambda w: w NOT IN ('lighting', 'opening', 'routing', 'servicing', 'mating', 'missing', 'remaining', 'something', 'during')))::INT AS ing_words FROM documents")
def r3_r5_rule_findings(spark, d):
    f = rules.findings(F.col("text"))
    return _t(spark, d, "documents").withColumn("f", f).select("doc_id", "f.semicolons", "f.ing_words")


def _sentences_sql(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?:])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"


_WORDS_SQL = r"len(regexp_extract_all(regexp_replace(regexp_replace({}, '\([^()]*\)', ' p ', 'g'), '\b(\d+(?:\.\d+)?)\s+(mm|cm|m|km|g|kg|s|min|h|V|A|W|psi|bar)\b', '\1\2', 'g'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}.''’/-]*'))"


@query("r1_long_sentences", rf"""SELECT doc_id, len(list_filter({_sentences_sql("text")}, lambda s: {_WORDS_SQL.format("s")} > 25))::INT AS long_sentences,
  len(list_filter(string_split(regexp_replace(text, '\n[ \t\n\x0B\f\r]*\n', chr(2), 'g'), chr(2)), lambda p: len({_sentences_sql("p")}) > 6))::INT AS long_paragraphs FROM documents""")  # fmt: skip
def r1_long_sentences(spark, d):
    f = rules.findings(F.col("text"))
    return _t(spark, d, "documents").withColumn("f", f).select("doc_id", "f.long_sentences", "f.long_paragraphs")


#: DuckDB has no look-around: every character beside words is doubled, so that neighbours each have their own border.
_CONTRACTION = r"(?i)(^|[^\p{L}\p{N}_])([a-z]+(n[''’]{2}t|[''’]{2}(re|ve|ll|d|m))|(it|that|there|he|she|what|let)[''’]{2}s)($|[^\p{L}\p{N}_])"


@query("r4_contractions", rf"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '{_CONTRACTION}'))::INT AS contractions FROM documents")
def r4_contractions(spark, d):
    return _t(spark, d, "documents").withColumn("f", rules.findings(F.col("text"))).select("doc_id", "f.contractions")


@query("u2_set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3")
def u2_set_difference(spark, d):
    taken = _t(spark, d, "lineitem").filter("l_quantity < 3").select(F.col("l_partkey").alias("k"))
    return lexicon.absent(_t(spark, d, "part").select(F.col("p_partkey").alias("k")), taken, "k")


# ---- dictionary text --------------------------------------------------------------------------


@query("x1_head_tokens", r"SELECT item_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT item_id, regexp_extract_all('(' || text || ') (adj), B (c', '\((?:n|v|adj|adv|prep|pron|art|conj|prefix)\)|[(),]|[^\s(),]+') AS t FROM benchmark)")
def x1_head_tokens(spark, d):
    t = headwords.head_tokens(F.concat(F.lit("("), "text", F.lit(") (adj), B (c")))
    return _t(spark, d, "benchmark").select("item_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def _dictionary(spark, d):
    """A row of a dictionary for each part: fifty books, a qualifier for each fifth size, the form on the same row."""
    k, tag = F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, ("n", "v", "adj"))), F.col("p_size") % 3 + 1)
    head = F.concat(F.lit("W"), k, F.when(F.col("p_size") % 5 == 0, " (of a part)").otherwise(""), F.lit(" ("), tag, F.lit("), W"), k, F.lit("S"))
    main = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("R"), k, F.lit(" (v)"))).otherwise(F.concat(F.lit("a part of "), F.col("p_size").cast("string")))
    return _t(spark, d, "part").select(
        (F.col("p_partkey") % 50).alias("book"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("page"), head.alias("head"), F.lit(True).alias("ruled"), main.alias("main"),
        F.when(F.col("p_size") % 2 == 0, "help").otherwise("").alias("help"), F.lit("").alias("ste"), F.col("p_name").alias("nonste"),
    )


HEADS_SQL = "SELECT p_partkey AS seq, 'W' || p_partkey AS word, CASE WHEN p_size % 5 = 0 THEN 'of a part' END AS qualifier, ['n', 'v', 'adj'][p_size % 3 + 1] AS tag, 'W' || p_partkey || 'S' AS forms FROM part"


@query("x2_headwords", HEADS_SQL)
def x2_headwords(spark, d):
    return headwords.headwords(_dictionary(spark, d)).select("seq", "word", "qualifier", "tag", F.array_join("forms", ",").alias("forms"))


@query("x3_alternatives", "SELECT p_partkey, 1 AS n, 'R' || p_partkey AS word, 'v' AS tag, 'with ' || p_brand AS context, 'note of ' || p_size AS note FROM part")
def x3_alternatives(spark, d):
    k = F.col("p_partkey").cast("string")
    lines = F.array(F.concat(F.lit("R"), k), F.lit("(v)"), F.concat(F.lit("(with  "), "p_brand", F.lit(")")), F.concat(F.lit("- note of "), F.col("p_size").cast("string")))
    a = _t(spark, d, "part").withColumn("a", headwords.alternatives(lines))
    first = F.get("a.alternatives", 0)
    return a.select("p_partkey", F.size("a.alternatives").alias("n"), first["word"].alias("word"), first["tag"].alias("tag"), first["context"].alias("context"), F.col("a.note").alias("note"))


@query("x4_entries", f"SELECT h.seq AS entry, word, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'a part of ' || p_size END AS meaning, CASE WHEN p_size % 2 = 0 THEN 'R' || p_partkey END AS alternative, p_name AS nonste, p_brand AS page FROM ({HEADS_SQL}) h JOIN part ON p_partkey = h.seq")
def x4_entries(spark, d):
    return headwords.entries(_dictionary(spark, d)).select("entry", "word", "meaning", F.get("alternatives", 0)["word"].alias("alternative"), "nonste", "page")


@query("x5_listed_rules", "SELECT '1.' || item_id AS id, 1 AS section, 'Words' AS section_title, 'Nouns' AS title, text AS statement FROM benchmark")
def x5_listed_rules(spark, d):
    said = ((16.0, True, F.lit("Page head")), (14.0, True, F.lit("Section 1 – Words")), (13.0, True, F.lit(headwords.SUMMARY)), (11.0, True, F.lit("Nouns")), (11.0, False, F.concat(F.lit("Rule 1."), F.col("item_id").cast("string"))), (11.0, False, F.col("text")), (14.0, True, F.lit("Body")), (11.0, False, F.lit("Rule 9.9")))
    lines = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(b).alias("bold"), t.alias("text")) for s, b, t in said])
    rows = _t(spark, d, "benchmark").select((F.col("item_id") % 10).alias("book"), F.col("item_id").alias("page"), F.posexplode(lines).alias("seq", "l")).select("book", "page", "seq", "l.*")
    return headwords.listed_rules(rows).select("id", "section", "section_title", "title", "statement")


@query("p12_text_table", "SELECT '| ' || event_type || ' | ' || coalesce((round(100.0 * count(*) FILTER (value > 90) / nullif(count(value), 0) * 10) / 10)::DECIMAL(5, 1)::VARCHAR || '%', 'n/a') || ' |' AS line FROM events GROUP BY event_type")
def p12_text_table(spark, d):
    g = _t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("hit"), F.count("value").alias("n"))
    return g.select(report.table_line("event_type", report.share(F.col("hit"), F.col("n"))).alias("line"))


@query("p13_detail", """SELECT user_id AS entry, 'ste' AS side, round(sum(value), 3) AS seconds, count(*)::INT AS n_items,
  md5(string_agg('finding ' || event_type || ' ' || event_id, ',' ORDER BY event_type, event_id::VARCHAR)) AS items_md5, count(*)::INT AS n_null_origins FROM events GROUP BY user_id""")  # fmt: skip
def p13_detail(spark, d):
    """Read back from the JSON text, whose layout is the engine's."""
    runs = _t(spark, d, "events").groupBy(F.col("user_id").alias("entry")).agg(
        F.lit("ste").alias("side"), F.lit("").alias("text"), F.sum("value").alias("seconds"), F.array_sort(F.collect_list(F.struct(F.lit("finding").alias("group"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("token"), F.lit(None).cast("string").alias("origin")))).alias("items")
    )
    kind = "side string, entry long, text string, seconds double, items array<struct<group: string, kind: string, token: string, origin: string>>"
    back = runs.select(F.from_json(report.detail_json(), kind).alias("r")).select("r.*")
    said = F.transform("items", lambda i: F.concat_ws(" ", i["group"], i["kind"], i["token"]))
    return back.select("entry", "side", F.round("seconds", 3).alias("seconds"), F.size("items").alias("n_items"), F.md5(F.array_join(said, ",")).alias("items_md5"), F.size(F.filter("items", lambda i: i["origin"].isNull())).alias("n_null_origins"))
