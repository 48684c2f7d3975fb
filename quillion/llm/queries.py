"""Queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from quillion.llm.audit import AUDIT_SQL, audit_query
from quillion.llm.classifier import classify_query
from quillion.llm.crosstok import align_query
from quillion.llm.decontaminate import decontaminate_query
from quillion.llm.extract import extract_query
from quillion.llm.linededup import LINE_DEDUP_SQL, line_dedup_query
from quillion.llm.mixing import mix_query
from quillion.llm.pii import pii_query
from quillion.llm.quality import QUALITY_SQL, quality_query
from quillion.llm.simhash import simhash_query
from quillion.llm.substring import substring_query
from quillion.llm.toxicity import toxicity_query
from quillion.llm.warc import warc_query

QUERIES = {
    "op1_warc": warc_query,
    "op2_substring": substring_query,
    "op3_quality": quality_query,
    "op4_extract": extract_query,
    "op5_decontaminate": decontaminate_query,
    "op6_mixing": mix_query,
    "op7_simhash": simhash_query,
    "op8_toxicity": toxicity_query,
    "op9_pii": pii_query,
    "op10_linededup": line_dedup_query,
    "op11_audit": audit_query,
    "op12_classifier": classify_query,
    "op13_crosstok": align_query,
}
ORACLES: dict[str, str] = {
    "op3_quality": QUALITY_SQL,
    "op10_linededup": LINE_DEDUP_SQL,
    "op11_audit": AUDIT_SQL,
}
