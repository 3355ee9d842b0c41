"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from ridgeline.llm.centroids import OP13_SQL, op13_centroids
from ridgeline.llm.chat import OP5_SQL, op5_chat
from ridgeline.llm.decontaminate import OP9_SQL, op9_decontamination
from ridgeline.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from ridgeline.llm.language_id import op3_language_id
from ridgeline.llm.license_scan import op1_license_scan
from ridgeline.llm.near_dedup import OP7_SQL, op7_near_dedup
from ridgeline.llm.packing import op6_packing
from ridgeline.llm.quality_rules import op12_quality_rules
from ridgeline.llm.secrets import op10_secrets
from ridgeline.llm.toxicity import op2_toxicity
from ridgeline.llm.vector_codes import OP11_SQL, op11_vector_codes
from ridgeline.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_rules": op12_quality_rules,
    "op13_centroids": op13_centroids,
    "op10_secrets": op10_secrets,
    "op5_chat": op5_chat,
    "op4_warc": op4_warc,
    "op6_packing": op6_packing,
    "op7_near_dedup": op7_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op1_license_scan": op1_license_scan,
    "op3_language_id": op3_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontamination": op9_decontamination,
}
ORACLE: dict[str, str] = {
    "op11_vector_codes": OP11_SQL,
    "op13_centroids": OP13_SQL,
    "op5_chat": OP5_SQL,
    "op4_warc": OP4_SQL,
    "op7_near_dedup": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_decontamination": OP9_SQL,
}
