"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.chat import ORACLE_OP3, op3_chat_formatting
from tidemill.llm.collocations import ORACLE_OP12, op12_collocations
from tidemill.llm.fingerprints import op7_fingerprints
from tidemill.llm.fixity import op6_fixity_audit
from tidemill.llm.html import op5_html_extraction
from tidemill.llm.mixing import ORACLE_OP4, op4_mixing
from tidemill.llm.near_dedup import op9_near_dedup
from tidemill.llm.packing import op1_packing
from tidemill.llm.pii import op11_pii
from tidemill.llm.quality import ORACLE_OP8, op8_quality_rules
from tidemill.llm.repair import ORACLE_OP13, op13_conversation_repair
from tidemill.llm.suffix_dedup import op2_suffix_dedup
from tidemill.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_suffix_dedup, op3_chat_formatting, op4_mixing, op5_html_extraction, op6_fixity_audit, op7_fingerprints, op8_quality_rules, op9_near_dedup, op10_toxicity, op11_pii, op12_collocations, op13_conversation_repair)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": ORACLE_OP3, "op4_mixing": ORACLE_OP4, "op8_quality_rules": ORACLE_OP8, "op12_collocations": ORACLE_OP12, "op13_conversation_repair": ORACLE_OP13}
