r"""Further queries: validation of a checker, checks of artifacts, prompts, vocabulary, layout, each with its SQL.

Runs of a checker are derived from events: each user is one run, three users share an entry, and an event is a finding
or a signal. Letters a to t stand for twenty headwords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import headwords, layout, lexicon, prompts, reviews, rules, scoring, validation, verification
from tidemill.plans.library import LEXICON_SQL, _lexicon, _t
from tidemill.plans.registry import query

_KIND = "CASE event_id % 4 WHEN 1 THEN 'ing_form' WHEN 2 THEN 'passive' ELSE 'not_approved' END"
_LETTER = "chr((97 + floor(value)::BIGINT % 20)::INT)"
RUNS_SQL = f"""e AS (SELECT user_id AS u, 'k' || (user_id // 3) AS key, CASE user_id % 3 WHEN 0 THEN 'ste' WHEN 1 THEN 'nonste' ELSE 'probe' END AS side,
  repeat(chr((97 + (user_id // 3) % 20)::INT), 3) || 'xy' AS word, ['n', 'v', 'adj'][((user_id // 3) % 3 + 1)::INT] AS pos, (user_id // 3) % 4 <> 0 AS scored, event_id,
  CASE WHEN event_id % 5 = 0 THEN 'signal' ELSE 'finding' END AS grp, {_KIND} AS kind, floor(value)::BIGINT % 20 AS letter,
  repeat({_LETTER}, 3) || CASE WHEN event_id % 5 = 0 THEN 'xys' WHEN event_id % 2 = 0 THEN 'zz' ELSE 'xy' END AS token FROM events),
i AS (SELECT *, CASE WHEN kind <> 'not_approved' THEN '' WHEN letter % 3 = 0 THEN 'dictionary' WHEN letter % 3 = 1 THEN 'homograph' ELSE 'unknown' END AS origin FROM e),
b AS (SELECT *, CASE WHEN kind = 'not_approved' THEN 'not_approved (' || origin || ')' ELSE kind END AS label, grp = 'finding' AND (kind <> 'not_approved' OR origin = 'dictionary') AS owned FROM i),
h AS (SELECT u, any_value(key) AS key, any_value(pos) AS pos, CASE WHEN bool_or(grp = 'finding' AND kind = 'not_approved' AND token = word) THEN 'finding'
  WHEN bool_or(grp = 'finding' AND kind IN ('not_approved', 'ing_form') AND starts_with(token, word[:3])) THEN 'inflected' WHEN bool_or(grp = 'signal' AND token = word || 's') THEN 'signal' ELSE 'miss' END AS hit
  FROM b WHERE side = 'nonste' AND scored GROUP BY u)"""


def _runs(spark, d) -> DataFrame:
    u, k, letter = F.col("user_id"), F.expr("user_id div 3"), F.floor("value") % 20
    kind = F.when(F.col("event_id") % 4 == 1, "ing_form").when(F.col("event_id") % 4 == 2, "passive").otherwise("not_approved")
    tail = F.when(F.col("event_id") % 5 == 0, "xys").when(F.col("event_id") % 2 == 0, "zz").otherwise("xy")
    token = F.concat(F.repeat(F.char(97 + letter), F.lit(3)), tail)
    e = _t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, "signal").otherwise("finding").alias("g"), F.struct(kind.alias("kind"), F.upper(token).alias("token"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("headword")).alias("x"))
    reports = e.groupBy(F.concat_ws("/", F.element_at(F.array(*map(F.lit, ("ste", "nonste", "probe"))), (u % 3 + 1).cast("int")), F.concat(F.lit("k"), k)).alias("run_id"), "user_id").agg(
        F.collect_list(F.when(F.col("g") == "finding", F.col("x"))).alias("findings"), F.collect_list(F.when(F.col("g") == "signal", F.col("x"))).alias("signals"), F.lit(0.5).alias("seconds")
    )
    word = F.concat(F.repeat(F.char(97 + k % 20), F.lit(3)), F.lit("xy"))
    side = F.element_at(F.array(*map(F.lit, ("ste", "nonste", "probe"))), (u % 3 + 1).cast("int"))
    job = reports.select("run_id", side.alias("side"), F.concat(F.lit("k"), k).alias("key"), word.alias("word"), F.element_at(F.array(*map(F.lit, ("n", "v", "adj"))), (k % 3 + 1).cast("int")).alias("pos"), F.array(word).alias("targets"), (k % 4 != 0).alias("scored"), F.lit("").alias("text"))
    low = [chr(97 + n) * 3 + t for n in range(20) for t in ("zz", "xy", "xys")]
    senses = spark.createDataFrame([(t, (ord(t[0]) - 97) % 3 == 0, (ord(t[0]) - 97) % 3 == 1, True) for t in low if (ord(t[0]) - 97) % 3 < 2], "token string, approved boolean, names_term boolean, noun boolean")
    return reviews.runs(job, reports.drop("user_id"), senses)


@query("g16_false_positives", f"WITH {RUNS_SQL}, r AS (SELECT u, bool_or(grp = 'finding') AS f, bool_or(origin = 'homograph') AS h, bool_or(owned) AS o FROM b WHERE side = 'ste' GROUP BY u) SELECT count(*) AS examples, count(*) FILTER (f) AS any_finding, count(*) FILTER (h) AS homograph, count(*) FILTER (o) AS checker_owned FROM r")
def g16_false_positives(spark, d):
    return reviews.false_positives(_runs(spark, d))


@query("c12_kind_labels", f"""WITH {RUNS_SQL} SELECT grp AS "group", label AS kind, count(*) AS items, count(DISTINCT u) AS examples FROM b WHERE side = 'ste' GROUP BY ALL""")
def c12_kind_labels(spark, d):
    return reviews.kinds(_runs(spark, d))


@query("g13_by_pos", f"""WITH {RUNS_SQL}, s AS (SELECT pos, count(*) AS examples, count(*) FILTER (o) AS owned FROM (SELECT u, any_value(pos) AS pos, bool_or(owned) AS o FROM b WHERE side = 'ste' GROUP BY u) GROUP BY pos),
n AS (SELECT pos, count(*) AS scored, count(*) FILTER (hit = 'finding') AS finding, count(*) FILTER (hit = 'inflected') AS inflected, count(*) FILTER (hit = 'signal') AS signal, count(*) FILTER (hit = 'miss') AS miss FROM h GROUP BY pos)
SELECT s.pos, examples, owned, coalesce(scored, 0) AS scored, coalesce(finding, 0) AS finding, coalesce(inflected, 0) AS inflected, coalesce(signal, 0) AS signal, coalesce(miss, 0) AS miss FROM s LEFT JOIN n ON s.pos = n.pos""")  # fmt: skip
def g13_by_pos(spark, d):
    return reviews.by_pos(_runs(spark, d))


@query("g13_by_kind", f"WITH {RUNS_SQL} SELECT label AS kind, count(DISTINCT u) FILTER (side = 'ste') AS ste, count(DISTINCT u) FILTER (side = 'nonste') AS nonste FROM b WHERE side <> 'probe' GROUP BY label")
def g13_by_kind(spark, d):
    return reviews.by_kind(_runs(spark, d))


@query("j9_hits", f"WITH {RUNS_SQL} SELECT key, hit FROM h")
def j9_hits(spark, d):
    return reviews.hits(_runs(spark, d)).select("key", "hit")


@query("o10_misses", f"WITH {RUNS_SQL} SELECT b.key, array_to_string(list_sort(list(DISTINCT token) FILTER (grp = 'finding')), ' ') AS flagged FROM b JOIN h ON b.u = h.u WHERE hit = 'miss' GROUP BY b.key")
def o10_misses(spark, d):
    return reviews.misses(_runs(spark, d)).select("key", F.array_join("flagged", " ").alias("flagged"))


@query("o7_worst", f"WITH {RUNS_SQL} SELECT key, count(*) FILTER (owned)::INT AS n FROM b WHERE side = 'ste' GROUP BY key ORDER BY n DESC, key LIMIT 20")
def o7_worst(spark, d):
    return reviews.worst(_runs(spark, d)).select("key", "n")


@query("j10_probe_gaps", f"""WITH {RUNS_SQL}, c AS (SELECT key, grp AS "group", kind, token, count(*) FILTER (side = 'ste') - count(*) FILTER (side = 'probe') AS gap FROM b WHERE side <> 'nonste' AND key IN (SELECT key FROM b WHERE side = 'probe') GROUP BY ALL)
SELECT key, CASE WHEN gap > 0 THEN 'capitals' ELSE 'sentence case' END AS only_in, "group", kind, token, abs(gap) AS n FROM c WHERE gap <> 0""")  # fmt: skip
def j10_probe_gaps(spark, d):
    return reviews.probe_gaps(_runs(spark, d))


@query("g10_attested", f"WITH {RUNS_SQL} SELECT token FROM b WHERE side = 'ste' AND origin = 'homograph' GROUP BY token HAVING count(DISTINCT u) >= 2")
def g10_attested(spark, d):
    return reviews.attested(_runs(spark, d))


@query("p6_items", f"""WITH {RUNS_SQL} SELECT side, key, grp AS "group", kind, token, origin, count(*) AS n FROM b GROUP BY ALL""")
def p6_items(spark, d):
    i = _runs(spark, d).select("side", "key", F.explode("items").alias("i"))
    return i.groupBy("side", "key", F.col("i.group").alias("group"), F.col("i.kind").alias("kind"), F.col("i.token").alias("token"), F.col("i.origin").alias("origin")).agg(F.count("*").alias("n"))


_W = "[A-Za-z][A-Za-z''’-]*[A-Za-z]|[A-Za-z]"


@query("g9_allow_list", rf"""WITH {LEXICON_SQL}, hw AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark),
x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '{_W}')) AS w FROM documents),
o AS (SELECT w, lower(w) AS l FROM x GROUP BY w HAVING count(*) >= 2),
k AS (SELECT * FROM o WHERE l NOT IN (SELECT lower(phrase) FROM lex)),
s AS (SELECT w, unnest([l, CASE WHEN regexp_matches(l, '.{{3}}ies$') THEN l[:-4] || 'y' END, CASE WHEN regexp_matches(l, '.{{3}}ies$') THEN l[:-4] || 'e' END, CASE WHEN regexp_matches(l, '.{{3}}ied$') THEN l[:-4] || 'y' END, CASE WHEN regexp_matches(l, '.{{3}}ied$') THEN l[:-4] || 'e' END,
  CASE WHEN regexp_matches(l, '.{{3}}es$') THEN l[:-3] END, CASE WHEN regexp_matches(l, '.{{3}}es$') THEN l[:-3] || 'e' END, CASE WHEN regexp_matches(l, '.{{3}}ed$') THEN l[:-3] END, CASE WHEN regexp_matches(l, '.{{3}}ed$') THEN l[:-3] || 'e' END, CASE WHEN regexp_matches(l, '[sd]$') THEN l[:-2] END]) AS base FROM k)
SELECT w AS word FROM k WHERE w NOT IN (SELECT w FROM s WHERE base IN (SELECT w FROM hw))""")  # fmt: skip
def g9_allow_list(spark, d):
    """Words in two or more documents that the lexicon lacks and that are no -s or -ed form of a word of benchmark."""
    heads = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).select(F.lower("word").alias("word"))
    senses = _lexicon(spark, d).select(F.lower("phrase").alias("token"))
    return reviews.allow_list(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), senses, heads)


@query("j17_fresh_tokens", r"""WITH s AS (SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)),
t AS (SELECT DISTINCT lower(token) AS token FROM (SELECT string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS token FROM documents UNION ALL SELECT string_split(p_name, ' ')[1] FROM part UNION ALL SELECT p_type FROM part))
SELECT token FROM t WHERE token <> '' AND token NOT IN (SELECT token FROM s) AND len(list_filter(regexp_split_to_array(token, '[ \t\n\x0B\f\r]+'), lambda w: NOT regexp_full_match(w, '[A-Za-z][A-Za-z''’-]*[A-Za-z]|[A-Za-z]'))) = 0""")  # fmt: skip
def j17_fresh_tokens(spark, d):
    two = F.split("text", " ")
    one = lambda c: F.array(F.struct(c.alias("token")))
    none = F.array().cast("array<struct<token:string>>")
    docs = _t(spark, d, "documents").select(one(F.concat(F.get(two, 0), F.lit(" "), F.get(two, 1))).alias("findings"), none.alias("signals"))
    part = _t(spark, d, "part").select(one(F.split("p_name", " ")[0]).alias("findings"), one(F.col("p_type")).alias("signals"))
    senses = _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("t")).select(F.lower("t").alias("token"))
    return reviews.fresh_tokens(docs.unionByName(part), senses)


#: Entries from parts: a third are approved, so some words are both.
ENTRIES_SQL = """en AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN upper(string_split(p_name, ' ')[1]) ELSE string_split(p_name, ' ')[1] END AS word, ['n', 'v', NULL][p_size % 3 + 1] AS pos, CASE WHEN p_size % 7 = 0 THEN 'of ' || p_brand END AS qualifier,
  p_partkey % 3 = 0 AS approved, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE upper(p_type) || ' 5 mm (a) ' || p_name END AS ste_example, CASE WHEN p_partkey % 11 = 0 THEN 'see Blank Page' END AS nonste_example FROM part)"""


def _entries(spark, d) -> DataFrame:
    k, name = F.col("p_partkey"), F.split("p_name", " ")
    return _t(spark, d, "part").select(
        k.alias("seq"), F.when(k % 3 == 0, F.upper(name[0])).otherwise(name[0]).alias("word"), F.get(F.array(F.lit("n"), F.lit("v"), F.lit(None)), F.col("p_size") % 3).alias("pos"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("of "), "p_brand")).alias("qualifier"),
        (k % 3 == 0).alias("approved"), F.array(name[1]).alias("forms"), F.when(k % 5 == 0, None).otherwise(F.concat(F.upper("p_type"), F.lit(" 5 mm (a) "), "p_name")).alias("ste_example"), F.when(k % 11 == 0, "see Blank Page").alias("nonste_example"),
    )


@query("x6_parsed_entries", f"""WITH {ENTRIES_SQL}, y AS (SELECT DISTINCT lower(word) AS w, pos FROM en WHERE approved)
SELECT seq, word || ' (' || coalesce(en.pos, 'None') || ')' || CASE WHEN qualifier IS NULL THEN '' ELSE ' [' || qualifier || ']' END AS key, NOT approved AND y.w IS NOT NULL AS meaning_only
FROM en LEFT JOIN y ON lower(word) = y.w AND en.pos IS NOT DISTINCT FROM y.pos WHERE coalesce(ste_example, '') <> ''""")  # fmt: skip
def x6_parsed_entries(spark, d):
    return reviews.parsed(_entries(spark, d)).select("seq", "key", "meaning_only")


@query("p14_targets", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([lower(string_split(p_name, ' ')[1]), lower(p_type), lower('of ' || p_brand), 'of', lower(p_brand)] || list_transform(string_split(p_type, ' '), lambda x: lower(x)), lambda x: x IS NOT NULL))), '|') AS targets FROM part""")
def p14_targets(spark, d):
    t = lexicon.targets(F.split("p_name", " ")[0], F.array("p_type"), F.concat(F.lit("of "), "p_brand"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(t), "|").alias("targets"))


@query("v15_scored_split", f"WITH {ENTRIES_SQL}, y AS (SELECT DISTINCT lower(word) AS w, pos FROM en WHERE approved) SELECT seq, y.w IS NOT NULL AS meaning_only FROM en LEFT JOIN y ON lower(word) = y.w AND en.pos IS NOT DISTINCT FROM y.pos WHERE NOT approved")
def v15_scored_split(spark, d):
    e = _entries(spark, d)
    return validation.scored_split(e.filter("NOT approved"), e.filter("approved")).select("seq", "meaning_only")


@query("v12_example_faults", rf"""WITH {ENTRIES_SQL}, w AS (SELECT seq, coalesce(list_filter(regexp_split_to_array(ste_example, ' +'), lambda x: regexp_matches(x, '[a-z]') AND NOT regexp_full_match(x, '\(?(?:mm|ml|kPa|bar|mbar|psi|MHz|Hz|kg|Nm|lb|in|µm|No|[a-z])[).,]*')), []) AS stray, coalesce(nonste_example LIKE '%Blank Page%', false) AS blank, word FROM en)
SELECT word, array_to_string(stray, ' ') AS stray, blank FROM w WHERE len(stray) > 0 OR blank""")  # fmt: skip
def v12_example_faults(spark, d):
    return validation.example_faults(_entries(spark, d)).select("word", F.array_join("stray", " ").alias("stray"), "blank")


@query("v13_case_violations", "SELECT p_partkey FROM part WHERE (p_size % 2 = 0) <> (p_size % 3 = 0) OR (p_size % 3 = 0) <> (p_size % 5 = 0)")
def v13_case_violations(spark, d):
    cased = lambda c, up: F.when(up, F.upper(c)).otherwise(F.lower(c))
    k, size = _t(spark, d, "part"), F.col("p_size")
    e = k.select("p_partkey", cased(F.concat(F.lit("w"), "p_name"), size % 3 == 0).alias("word"), (size % 2 == 0).alias("approved"), F.array(cased(F.concat(F.lit("w"), "p_name"), size % 5 == 0)).alias("forms"))
    return validation.case_violations(e).select("p_partkey")


@query("v4_outcome_errors", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'findings missing' WHEN 3 THEN 'reason missing' WHEN 4 THEN 'unknown status' END AS error FROM events")
def v4_outcome_errors(spark, d):
    k = F.col("event_id") % 5
    status = F.when(k <= 1, "checked").when(k <= 3, "skipped").otherwise("other")
    return _t(spark, d, "events").select("event_id", validation.outcome_errors(status, F.when(k == 2, "off"), F.when(k == 0, 1)).alias("error"))


_V5 = ["", "fields or their order", "", "", "answer: does not fit the kind", "fields or their order|source: not a filled string", "not JSON", "blank line", "answer: does not fit the kind"]


@query("v5_strict_errors", f"SELECT o_orderkey, {_V5}[o_orderkey % 9 + 1] AS errors FROM orders")
def v5_strict_errors(spark, d):
    """Valid; another order; NaN; infinite; a boolean; a field missing; no JSON; blank; a number as the answer of a question."""
    n = F.col("o_orderkey").cast("string")
    tail = F.concat(F.lit(', "technical_terms": [], "source": "s", "split": "x", "license": "l"}'))
    line = lambda answer, kind="math", head='{"id": "t', end=tail: F.concat(F.lit(head), n, F.lit(f'", "kind": "{kind}", "prompt": "p", "answer": {answer}'), end)
    made = [line("1"), F.concat(F.lit('{"kind": "math", "id": "t'), n, F.lit('", "prompt": "p", "answer": 1'), tail), line("NaN"), line("-Infinity"), line("true"), line("1", end=F.lit(', "technical_terms": [], "split": "x", "license": "l"}')), F.concat(F.lit("{bad"), n), F.lit("  "), line("3", "qa")]
    text = F.element_at(F.array(*made), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(validation.strict_errors(text), "|").alias("errors"))


# ---- artifacts --------------------------------------------------------------------------------

_NUMBERS = ["one", "three", "four", "six", "twenty-two", "7", "12"]
_MEANT = [1, 3, 4, 6, 22, 7, 12]


@query("v18_parameters", f"SELECT id AS rule, value, stated FROM (SELECT 'r' || p_partkey AS id, p_size % 23 AS value, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE {_MEANT}[p_partkey % 7 + 1] END AS stated FROM part) WHERE value IS DISTINCT FROM stated")
def v18_parameters(spark, d):
    word = F.element_at(F.array(*map(F.lit, _NUMBERS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    said = F.when(F.col("p_partkey") % 4 == 0, F.lit("It states no number, not even 5.")).otherwise(F.concat(F.lit("Use one of the 9 kinds; no more than "), word, F.lit(" words.")))
    p = _t(spark, d, "part").select(F.concat(F.lit("r"), "p_partkey").alias("rule"), (F.col("p_size") % 23).alias("value"), verification.stated(said, F.lit(r"no more than ([\w-]+) words")).alias("stated"))
    return p.filter(~F.col("value").eqNullSafe(F.col("stated")))


@query("v19_ing_faults", """WITH t AS (SELECT 'x Approved words that have an “-ing” form ' || string_agg(string_split(p_name, ' ')[1], ' ' ORDER BY p_partkey) AS x FROM part), s AS (SELECT x[3:602] AS part FROM t),
w AS (SELECT DISTINCT string_split(p_name, ' ')[1] || 'ing (n)' AS id FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] || ' (n)' FROM part),
a AS (SELECT DISTINCT string_split(p_name, ' ')[1] || ' (n)' AS id FROM part WHERE p_size % 2 = 0)
SELECT id, 'not an entry' AS fault FROM w WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'not named' FROM w, s WHERE NOT contains(part, string_split(id, ' ')[1])""")  # fmt: skip
def v19_ing_faults(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size", F.split("p_name", " ")[0].alias("w"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "w"))), lambda x: x["w"]), " ")
    text = p.agg(F.concat(F.lit("x Approved words that have an “-ing” form "), listed).alias("text"))
    ing = p.select(F.explode(F.array(F.concat("w", F.lit("ing (n)")), F.concat("w", F.lit(" (n)")))).alias("id")).distinct()
    return verification.ing_faults(ing, p.filter("p_size % 2 = 0").select(F.concat("w", F.lit(" (n)")).alias("id")), text)


@query("v20_header_faults", "SELECT name, fault FROM (SELECT p_partkey::VARCHAR AS name, unnest([CASE WHEN p_size % 2 = 0 THEN 'schema_version' END, CASE WHEN p_size % 3 = 0 THEN 'source' END]) AS fault FROM part) WHERE fault IS NOT NULL")
def v20_header_faults(spark, d):
    size = F.col("p_size")
    block = F.create_map(F.lit("title"), F.lit("T"), F.lit("issue"), F.when(size % 3 == 0, "8").otherwise("9"))
    a = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.when(size % 2 == 0, 2).otherwise(1).alias("schema_version"), block.alias("source"))
    return verification.header_faults(a, 1, {"issue": 9, "title": "T"})


@query("j7_verb_gaps", "WITH l AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS word FROM part WHERE p_size < 30), p AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS word FROM part WHERE p_size > 20) SELECT word, 'listed' AS side FROM (FROM l EXCEPT FROM p) UNION ALL SELECT word, 'parsed' FROM (FROM p EXCEPT FROM l)")
def j7_verb_gaps(spark, d):
    p = _t(spark, d, "part")
    return verification.set_gaps(p.filter("p_size < 30").select(F.split("p_name", " ")[0].alias("word")), p.filter("p_size > 20").select(F.split("p_name", " ")[1].alias("word")))


@query("s12_verb_list", "SELECT DISTINCT trim(p_type) AS word FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING bool_or(p_partkey % 50 = 0)) AND p_size % 2 = 0 AND p_size % 3 <> 0")
def s12_verb_list(spark, d):
    size = F.col("p_size")
    heads = F.array(F.lit("List of approved verbs"), F.lit("Page 2-0-V1"))
    spans = _t(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_type").alias("text"), F.when(size % 2 == 0, 10.0).otherwise(12.0).alias("size"), (size % 3 == 0).alias("bold"))
    marks = _t(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_brand").alias("page"), F.explode(heads).alias("text"), F.lit(14.0).alias("size"), F.lit(True).alias("bold"))
    return verification.verb_list(spans.unionByName(marks))


@query("g21_notes", """WITH f AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part WHERE p_size < 20)
SELECT 'stated_pos' AS note, p_brand AS word, 'adj' AS detail FROM part WHERE p_size % 5 = 0
UNION ALL SELECT DISTINCT 'outside', NULL, w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size % 4 = 0) WHERE w NOT IN (SELECT w FROM f)""")  # fmt: skip
def g21_notes(spark, d):
    size, no = F.col("p_size"), F.lit(None).cast("string")
    a = F.array(F.struct(F.lit("r").alias("ref"), F.when(size % 5 == 0, "adj").alias("stated_pos"), no.alias("phrase")), F.struct(no.alias("ref"), no.alias("stated_pos"), F.when(size % 4 == 0, F.col("p_name")).alias("phrase")))
    p = _t(spark, d, "part")
    return verification.notes(p.select(F.col("p_brand").alias("word"), a.alias("alternatives")), p.filter("p_size < 20").select(F.array(F.split("p_name", " ")[0]).alias("forms")))


@query("v13_entry_faults", "SELECT word, fault FROM (SELECT p_name AS word, unnest([CASE WHEN p_size % 2 = 0 THEN 'case' END, CASE WHEN p_size % 4 = 1 THEN 'prefix' END, CASE WHEN p_size % 4 = 2 THEN 'pos' END]) AS fault FROM part) WHERE fault IS NOT NULL")
def v13_entry_faults(spark, d):
    size = F.col("p_size")
    pos = F.when(size % 4 == 1, "prefix").when(size % 4 == 2, "noun").when(size % 4 == 3, "n")
    return verification.entry_faults(_t(spark, d, "part").select(F.col("p_name").alias("word"), pos.alias("pos"), (size % 2 == 0).alias("approved")))


# ---- prompts, vocabulary, tokens --------------------------------------------------------------


@query("p1_messages", f"""WITH w AS (SELECT string_agg(DISTINCT upper(p_brand), ', ' ORDER BY upper(p_brand)) AS ids FROM part),
t AS (SELECT conv_id, turn, 'A' || ((conv_id + turn) % 3) AS arm, text, CASE WHEN turn % 2 = 0 THEN 'pump, Answer' ELSE '{prompts.NO_TERMS}' END AS terms FROM conversations),
s AS (SELECT t.*, '{prompts.INSTRUCTION[0]}' || chr(10) || '{prompts.INSTRUCTION[1]}' || terms || chr(10) || '{prompts.INSTRUCTION[2]}' || ids AS sys FROM t, w)
SELECT conv_id, turn, CASE arm WHEN 'A0' THEN 'user' ELSE 'system,user' END AS roles,
  md5(CASE arm WHEN 'A0' THEN text WHEN 'A1' THEN sys || '|' || text ELSE sys || '|' || '{prompts.REWRITE.rstrip()}' || chr(10) || chr(10) || upper(replace(text, 'ß', 'ss')) END) AS content_md5 FROM s""")  # fmt: skip
def p1_messages(spark, d):
    words = lexicon.id_list(_t(spark, d, "part").select(F.col("p_brand").alias("id")).distinct())
    terms = F.when(F.col("turn") % 2 == 0, F.array(F.lit("pump"), F.lit("Answer"))).otherwise(F.array().cast("array<string>"))
    tasks = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("A"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string")).alias("arm"), F.col("text").alias("prompt"), terms.alias("technical_terms"), F.upper("text").alias("draft"))
    m = prompts.assembled(tasks, words)
    part = lambda f, by: F.array_join(F.transform("messages", lambda x: x[f]), by)
    return m.select("conv_id", "turn", part("role", ",").alias("roles"), F.md5(part("content", "|")).alias("content_md5"))


@query("p2_id_list", "SELECT string_agg(upper(id), ', ' ORDER BY upper(id)) AS ids FROM (SELECT DISTINCT p_brand || ' (n)' AS id FROM part)")
def p2_id_list(spark, d):
    return lexicon.id_list(_t(spark, d, "part").select(F.concat("p_brand", F.lit(" (n)")).alias("id")).distinct())


@query("p3_allowed_terms", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || ',Answer' END AS terms FROM part")
def p3_allowed_terms(spark, d):
    t = scoring.allowed_terms(F.when(F.col("p_size") % 2 == 0, "writing").otherwise("qa"), F.array("p_brand"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(t, ",").alias("terms"))


@query("p4_arm_records", """SELECT o_orderkey::VARCHAR AS task_id, 'A' || (o_orderkey % 3) AS arm, CASE WHEN o_orderkey % 3 = 2 THEN 17 ELSE 2 END AS reasoning_tokens, CASE WHEN o_orderkey % 3 = 2 THEN 24 ELSE 4 END AS generated_tokens, 2 AS output_tokens,
  o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 OR o_orderkey % 7 = 0 AS truncated, CASE WHEN o_orderkey % 3 = 2 THEN 1.75 ELSE 0.5 END::DOUBLE AS latency_s, o_orderkey % 5 = 0 AS correct FROM orders""")  # fmt: skip
def p4_arm_records(spark, d):
    k, none = F.col("o_orderkey"), lambda t: F.lit(None).cast(t)
    text = F.concat(F.lit("<think>so then</think>Answer: "), F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit("9"), k.cast("string"))))
    g = _t(spark, d, "orders").select(
        k.cast("string").alias("task_id"), F.lit("math").alias("kind"), F.concat(F.lit("A"), (k % 3).cast("string")).alias("arm"), F.lit(0).alias("sample"), text.alias("text"), F.lit(False).alias("think_open"), (k % 7 == 0).alias("truncated"), F.lit(0.5).alias("latency_s"),
        (k % 2 == 0).alias("draft_truncated"), F.lit(15).alias("draft_reasoning_tokens"), F.lit(20).alias("draft_generated_tokens"), F.lit(1.25).alias("draft_latency_s"), k.cast("double").alias("gold_number"), none("string").alias("gold_text"), none("double").alias("compliance"), none("array<string>").alias("nonconforming"),
    )
    return scoring.arm_records(scoring.measured(g)).select("task_id", "arm", "reasoning_tokens", "generated_tokens", "output_tokens", "truncated", "latency_s", "correct")


@query("t10_opens_think", "SELECT conv_id, turn, turn % 2 = 0 AS opens FROM conversations")
def t10_opens_think(spark, d):
    prompt = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit("<think>  ")).otherwise(F.lit("<think>.")))
    return _t(spark, d, "conversations").select("conv_id", "turn", X.opens_think(prompt).alias("opens"))


@query("r7_vocabulary", """WITH a AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS word, CASE WHEN p_size % 2 = 0 THEN 'n' ELSE 'v' END AS pos FROM part WHERE p_size < 25),
w AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN string_split(p_name, ' ')[1] || 's' ELSE string_split(p_name, ' ')[2] END AS word, CASE p_size % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN 'adj' END AS pos FROM part),
j AS (SELECT w.*, (SELECT list(pos) FROM a WHERE a.word = lower(w.word)) AS kinds, lower(w.word) IN (SELECT word || 's' FROM a WHERE pos = 'n') AS pl, lower(w.word) IN (SELECT lower(string_split(p_type, ' ')[1]) FROM part) OR lower(w.word) IN (SELECT lower(string_split(p_name, ' ')[2]) FROM part WHERE p_size = 7) AS term FROM w)
SELECT id, word, pos, CASE WHEN (pos IS NULL AND kinds IS NOT NULL) OR coalesce(list_contains(kinds, pos), false) THEN 'listed' WHEN pl AND (pos IS NULL OR pos = 'n') THEN 'plural' WHEN term THEN 'term' WHEN kinds IS NOT NULL OR pl THEN 'form' ELSE 'unknown' END AS verdict FROM j""")  # fmt: skip
def r7_vocabulary(spark, d):
    p, size, name = _t(spark, d, "part"), F.col("p_size"), F.split("p_name", " ")
    a = p.filter("p_size < 25").select(F.lower(name[0]).alias("word"), F.when(size % 2 == 0, "n").otherwise("v").alias("pos")).distinct()
    approved = a.withColumns({"forms": F.array().cast("array<string>"), "plural": F.when(F.col("pos") == "n", F.concat("word", F.lit("s")))})
    words = p.select(F.col("p_partkey").alias("id"), F.when(size % 3 == 0, name[0]).when(size % 3 == 1, F.concat(name[0], F.lit("s"))).otherwise(name[1]).alias("word"), F.when(size % 4 == 0, "n").when(size % 4 == 1, "v").when(size % 4 == 2, "adj").alias("pos"))
    terms = p.select(F.split("p_type", " ")[0].alias("term")).union(p.filter("p_size = 7").select(name[1]))
    return rules.vocabulary(words, approved, terms)


@query("p10_assembled_rules", "SELECT coalesce(l.id, a.id) AS id, CASE WHEN l.id IS NULL THEN 'not listed' WHEN a.id IS NULL THEN 'not authored' END AS gap, said FROM (SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0) l FULL JOIN (SELECT p_partkey AS id, p_brand AS said FROM part WHERE p_size % 5 <> 0) a ON l.id = a.id")
def p10_assembled_rules(spark, d):
    p = _t(spark, d, "part")
    return rules.assembled(p.filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("id")), p.filter("p_size % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("said"))).select("id", "gap", "said")


@query("o9_run_order", "SELECT task, sample, arm, row_number() OVER (ORDER BY task, sample, arm_pos) - 1 AS place FROM (SELECT p_partkey AS task FROM part), (SELECT unnest([0, 1]) AS sample), (SELECT unnest(['A0', 'A2', 'A1']) AS arm, unnest([0, 1, 2]) AS arm_pos)")
def o9_run_order(spark, d):
    """Task by task, then by sample, then by arm as given, numbered without a global window."""
    from tidemill.sources import files

    each = _t(spark, d, "part").select(F.col("p_partkey").alias("task"), F.explode(F.array(F.lit(0), F.lit(1))).alias("sample"))
    each = each.select("task", "sample", F.posexplode(F.array(*map(F.lit, ("A0", "A2", "A1")))).alias("arm_pos", "arm"))
    return files.positions(each, ["task", "sample", "arm_pos"], "place").select("task", "sample", "arm", "place")


@query("o4_page_rows", """WITH e AS (SELECT p_brand AS page, p_partkey AS k, p_size, p_name, p_type FROM part)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY k))::BIGINT AS group_no, 'W' || k AS head, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS main, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS help, p_type AS ste, CASE WHEN p_size % 3 = 0 THEN 'no' ELSE '' END AS nonste, p_size % 5 = 0 AS ruled FROM e""")  # fmt: skip
def o4_page_rows(spark, d):
    """Words of a page for each brand, a row for each part, ten points apart."""
    y, size = F.col("p_partkey") * 10.0, F.col("p_size")
    word = lambda x, text, bold, dy=0.0: F.struct(F.lit(x).alias("x") if not hasattr(x, "alias") else x.alias("x"), (y + dy).alias("y"), text.alias("text"), F.lit(bold).alias("bold"))
    cells = F.array(
        word(50.0, F.concat(F.lit("W"), F.col("p_partkey").cast("string")), True), word(90.0, F.lit("plain"), False, 1.5), word(F.when(size % 2 == 0, 180.0).otherwise(150.0), F.col("p_name"), False, 0.5),
        word(300.0, F.col("p_type"), False, 2.0), word(450.0, F.when(size % 3 == 0, "no"), False),
    )
    p = _t(spark, d, "part")
    words = p.select(F.col("p_brand").alias("page"), F.explode(cells).alias("w")).select("page", "w.*").filter("text IS NOT NULL")
    pages = p.select(F.col("p_brand").alias("page")).distinct().withColumn("starts", F.array(*[F.lit(x) for x in (50.0, 150.0, 300.0, 450.0)]))
    lines = p.filter("p_size % 5 = 0").select(F.col("p_brand").alias("page"), (F.col("p_partkey") * 10.0 - 3).alias("y"))
    return layout.page_rows(words, pages, lines).select("page", "group_no", "head", "main", "help", "ste", "nonste", "ruled")


@query("x4_pages_to_entries", "SELECT p_partkey AS k, 'WX' || p_partkey AS word, ['n', 'v', 'adj'][p_size % 3 + 1] AS tag, 'a part of ' || p_size AS meaning FROM part")
def x4_pages_to_entries(spark, d):
    """Positioned words through rows, soft hyphens and headwords to entries; a headword is broken by a hyphen on each page."""
    k, tag = F.col("p_partkey"), F.element_at(F.array(*map(F.lit, ("n", "v", "adj"))), F.col("p_size") % 3 + 1)
    word = lambda x, dy, text, bold: F.struct(F.lit(x).alias("x"), (k * 20.0 + dy).alias("y"), text.alias("text"), F.lit(bold).alias("bold"))
    cells = F.array(word(50.0, 0.0, F.lit("W-"), True), word(150.0, 0.0, F.concat(F.lit("a part of "), F.col("p_size").cast("string")), False), word(50.0, 10.0, F.concat(F.lit("X"), k.cast("string"), F.lit(" ("), tag, F.lit(")")), True))
    p = _t(spark, d, "part").withColumn("page", F.lpad((k % 50).cast("string"), 2, "0"))
    words = p.select("page", F.explode(cells).alias("w")).select("page", "w.*")
    pages = p.select("page").distinct().withColumn("starts", F.array(*[F.lit(x) for x in (50.0, 150.0, 300.0, 450.0)]))
    rows = layout.page_rows(words, pages, p.select("page", (k * 20.0 - 3).alias("y")))
    made = headwords.from_rows(rows.withColumn("book", F.col("page")))
    return headwords.entries(made).select(F.substring("word", F.lit(3), F.length("word")).cast("long").alias("k"), "word", F.col("pos").alias("tag"), "meaning")


