"""The subpackage's queries and SQL for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline
from claimweave.llm import oracles
from claimweave.llm.embeddings import op8_embedding_near_dedup
from claimweave.llm.langid import op9_language_id
from claimweave.llm.licences import op4_licence_scan
from claimweave.llm.minhash import op7_minhash_near_dedup
from claimweave.llm.mixing import op2_source_mixing
from claimweave.llm.packing import op5_packing
from claimweave.llm.pii import op1_pii_pseudonyms
from claimweave.llm.quality import op3_quality_classifier
from claimweave.llm.repair import op11_conversation_repair
from claimweave.llm.rules import op6_quality_rules
from claimweave.llm.tokens import op10_token_counts
from claimweave.llm.toxicity import op12_toxicity
from claimweave.llm.trie import op13_prefix_trie


def queries() -> dict:
    named = [op1_pii_pseudonyms, op2_source_mixing, op3_quality_classifier, op4_licence_scan, op5_packing, op6_quality_rules, op7_minhash_near_dedup, op8_embedding_near_dedup, op9_language_id, op10_token_counts, op11_conversation_repair, op12_toxicity, op13_prefix_trie]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL states the rules, the shingle sets' similarity, the cosine, the repair of conversations and their trie. Of the other operators tests compare numbers with plain Python (pseudonyms, scores, language models),
    the mix with its optimum, licences with a scan without an index, and ids and counts with the tokenizers library; classifiers are measured on held-out rows besides."""
    return {op6_quality_rules.__name__: oracles.QUALITY_RULES, op7_minhash_near_dedup.__name__: oracles.MINHASH, op8_embedding_near_dedup.__name__: oracles.EMBEDDINGS, op11_conversation_repair.__name__: oracles.REPAIR, op13_prefix_trie.__name__: oracles.TRIE}
