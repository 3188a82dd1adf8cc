r"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions alone.

The template gives each role the mark before and after its text and whether the text is learned
(loss). Control strings inside texts and roles are escaped reversibly: each backslash is doubled
and a backslash follows the first character of each control string. The machine walks the roles
and marks a conversation valid where every step and the end are allowed; invalid ones are formatted
too, with ``valid`` false.

Defined cases: null text and null role are empty; a role the template does not name gets the
generic marks and no loss; rows with one turn number are ordered by role, then text, and repeated
rows are repeated turns; rows with a null conv_id make one conversation; an empty table gives no rows; other
columns are ignored. A conversation is one string, so its size is bounded by what a string can
hold (2 GB); its digest over all turns in order cannot be split.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("<s> ", " </s>\n", True),
        }
    )
    other: tuple[str, str, str] = ("<role>", "</role>", "</turn>\n")
    #: state -> role -> next state; what is not listed leads to "bad".
    steps: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: tuple[str, ...] = ("asked", "answered")

    @property
    def controls(self) -> list[str]:
        marks = [m.strip() for t in self.turns.values() for m in (t.before, t.after)]
        return marks + [m.strip() for m in self.other]


def escape(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(c[0] + "\\" + c[1:])), template.controls, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(x: str) -> str:
    return "\\Q" + x + "\\E"


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid: one row for each conversation."""
    t = template or Template()
    turns = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )

    def by_role(x: Column, pick, other: Column) -> Column:
        return reduce(lambda c, r: c.when(x["role"] == r, F.lit(pick(t.turns[r]))), list(t.turns)[1:], F.when(x["role"] == list(t.turns)[0], F.lit(pick(t.turns[list(t.turns)[0]])))).otherwise(other)

    def pieces(x: Column) -> Column:
        name = F.concat(F.lit(t.other[0]), escape(x["role"], t), F.lit(t.other[1]))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(by_role(x, lambda m: m.before, name), F.lit(False)),
            seg(escape(x["text"], t), by_role(x, lambda m: m.loss, F.lit(False))),
            seg(by_role(x, lambda m: m.after, F.lit(t.other[2])), F.lit(False)),
        )

    steps = F.create_map(*[F.lit(v) for s, to in t.steps.items() for r, n in to.items() for v in (f"{s}>{r}", n)])
    end = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.element_at(steps, F.concat(s, F.lit(">"), x["role"])), F.lit("bad")))
    return (
        turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), end.isin(*t.ends).alias("valid"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Turns (role, text) of a formatted conversation."""
    t = template or Template()
    opens = "|".join(_quoted(m.before) for m in t.turns.values()) + f"|{_quoted(t.other[0])}.*?{_quoted(t.other[1])}"
    closes = "|".join(_quoted(m.after) for m in t.turns.values()) + f"|{_quoted(t.other[2])}"
    pattern = f"(?s)({opens})(.*?)({closes})"
    marks, bodies = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1)), F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    names = F.create_map(*[F.lit(v) for r, m in t.turns.items() for v in (m.before, r)])
    skip, drop = len(t.other[0]), len(t.other[0]) + len(t.other[1])
    role = lambda m: F.coalesce(F.element_at(names, m), unescape(F.substring(m, F.lit(skip + 1), F.length(m) - drop)))
    return F.zip_with(marks, bodies, lambda m, b: F.struct(role(m).alias("role"), unescape(b).alias("text")))


def digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What reading the formatted conversations back gives."""
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (
        chats.withColumn("turns", read_back(F.col("formatted"), template))
        .withColumn("learned", learned)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    return digests(format_chats(rows.unionByName(probe)))


_T = Template()
_ESCAPED = reduce(lambda x, c: f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')", _T.controls, "replace({}, '\\', '\\\\')")
ORACLE_OP3 = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(t)
), m AS (
  SELECT *, length({_ESCAPED.format("text")}) + CASE role {" ".join(f"WHEN '{r}' THEN {len(x.before + x.after)}" for r, x in _T.turns.items())}
    ELSE {len("".join(_T.other))} + length({_ESCAPED.format("role")}) END AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN p = 'system' THEN role = 'user' AND k = 2 WHEN p = 'user' THEN role = 'assistant' WHEN p = 'assistant' THEN role = 'user' ELSE false END)
    AND arg_max(role, k) IN ('user', 'assistant') AS valid
FROM m GROUP BY conv_id
"""
