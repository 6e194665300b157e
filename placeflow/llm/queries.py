"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from placeflow.llm import codes, decontaminate, fim, linededup, lm, merkle, ogg, packing, pii, quality, simhash, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_pii": pii.query,
    "op3_toxicity": toxicity.query,
    "op4_ogg": ogg.query,
    "op5_warc": warc.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality": quality.query,
    "op8_ctw": lm.query,
    "op9_packing": packing.query,
    "op10_line_dedup": linededup.query,
    "op11_fill_in_middle": fim.query,
    "op12_token_codes": codes.query,
    "op13_merkle": merkle.query,
}
ORACLE_SQL = {"op5_warc": warc.ORACLE, "op10_line_dedup": linededup.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op13_merkle": merkle.ORACLE}
