"""Queries of this package and their SQL, for the entry file."""

from __future__ import annotations

from . import decontamination, jaccard, language, licenses, mixing, periods, phrases, quality, secrets, token_store, toxicity, transcripts, warc

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_token_store": token_store.op3_token_store,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_chat_turns": transcripts.op5_chat_turns,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_language": language.op9_language,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_collocations": phrases.op12_collocations,
    "op13_warc": warc.op13_warc,
}
ORACLES = {
    "op2_license_scan": licenses.OP2_SQL,
    "op7_secret_scan": secrets.OP7_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op12_collocations": phrases.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
