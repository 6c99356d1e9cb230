"""The operators applied to their whole tables, and their SQL where it can be written."""

import corpus_pipeline

from . import decontamination, langid, packing, quality, rangecoder, simhash, suffixes, syncmers, toxicity, transcripts

QUERIES = {
    "op1_syncmers": syncmers.query,
    "op2_toxicity": toxicity.query,
    "op3_suffixes": suffixes.query,
    "op4_simhash": simhash.query,
    "op5_quality": quality.query,
    "op6_transcripts": transcripts.query,
    "op7_decontamination": decontamination.query,
    "op8_langid": langid.query,
    "op9_rangecoder": rangecoder.query,
    "op10_packing": packing.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_syncmers": syncmers.sql(),
    "op3_suffixes": suffixes.sql(),
    "op6_transcripts": transcripts.sql(),
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
