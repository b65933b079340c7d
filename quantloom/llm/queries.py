"""Queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from quantloom.llm.bpe import op11_bpe
from quantloom.llm.edits import op9_fingerprints
from quantloom.llm.jaccard import op1_jaccard
from quantloom.llm.mixing import OP4_SQL, op4_mix
from quantloom.llm.packing import op2_pack
from quantloom.llm.quality import op6_quality
from quantloom.llm.repeats import op3_repeats
from quantloom.llm.runs import op13_runs
from quantloom.llm.suffixes import op7_suffixes
from quantloom.llm.toxicity import op8_toxicity
from quantloom.llm.url_rules import op10_url_rules
from quantloom.llm.vector_codes import op12_vector_codes
from quantloom.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_pack": op2_pack,
    "op3_repeats": op3_repeats,
    "op4_mix": op4_mix,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_suffixes": op7_suffixes,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_url_rules": op10_url_rules,
    "op11_bpe": op11_bpe,
    "op12_vector_codes": op12_vector_codes,
    "op13_runs": op13_runs,
}
ORACLES = {"op4_mix": OP4_SQL, "op5_warc": OP5_SQL}
