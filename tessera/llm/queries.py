"""The queries of this subpackage and, where SQL expresses them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.audit import SQL as AUDIT_SQL
from tessera.llm.audit import op13_audit
from tessera.llm.bpe import op10_bpe
from tessera.llm.forest import op9_forest
from tessera.llm.licenses import op4_licenses
from tessera.llm.lines import op5_lines
from tessera.llm.mixing import op6_mixing
from tessera.llm.packing import op11_packing
from tessera.llm.periods import op12_periods
from tessera.llm.pii import op2_pii
from tessera.llm.quality import SQL as QUALITY_SQL
from tessera.llm.quality import op3_quality
from tessera.llm.simhash import op8_simhash
from tessera.llm.toxicity import op7_toxicity
from tessera.llm.warc import SQL as WARC_SQL
from tessera.llm.warc import op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_lines": op5_lines,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_forest": op9_forest,
    "op10_bpe": op10_bpe,
    "op11_packing": op11_packing,
    "op12_periods": op12_periods,
    "op13_audit": op13_audit,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": WARC_SQL, "op3_quality": QUALITY_SQL, "op13_audit": AUDIT_SQL}
