"""Queries of this subpackage, and their DuckDB SQL where there is any."""

from __future__ import annotations

from arbor.llm.additive_ann import op3_additive_ann
from arbor.llm.bpe_codec import op4_bpe_codec
from arbor.llm.langid import op10_language_id
from arbor.llm.licenses import op8_license_scan
from arbor.llm.media import op9_media_columns
from arbor.llm.ngram_jaccard import op1_ngram_jaccard
from arbor.llm.packing import op6_packing
from arbor.llm.token_counts import op2_token_counts
from arbor.llm.toxicity import op7_toxicity
from arbor.llm.warc import op5_warc


def queries():
    return {q.__name__: q for q in (op1_ngram_jaccard, op2_token_counts, op3_additive_ann, op4_bpe_codec, op5_warc, op6_packing, op7_toxicity, op8_license_scan, op9_media_columns, op10_language_id)}


def oracle_sql():
    return {}
