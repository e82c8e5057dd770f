"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, classlm, fingerprints, langid, mixing, ngramjoin, pieces, prefixtrie, quality, simhash, tokenfiles, urlrules, warc


def queries() -> dict:
    made = [mixing.op1_mix_sources, warc.op2_warc, tokenfiles.op3_token_files, ngramjoin.op4_ngram_jaccard, pieces.op5_sentencepiece, urlrules.op6_url_filters, fingerprints.op7_fingerprints, quality.op8_quality_rules, langid.op9_language_id, classlm.op10_class_lm, simhash.op11_simhash, prefixtrie.op12_prefix_trie, alignment.op13_cross_tokenizer]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op2_warc": warc.OP2_SQL, "op6_url_filters": urlrules.OP6_SQL, "op8_quality_rules": quality.OP8_SQL, "op12_prefix_trie": prefixtrie.OP12_SQL}
