"""The queries of this subpackage: QUERIES by name, and ORACLE_SQL where SQL can express one."""

from lodestrata.llm.chat import op1_chat_formatting
from lodestrata.llm.decontamination import op5_benchmark_decontamination
from lodestrata.llm.embedding_dedup import op8_embedding_near_dedup
from lodestrata.llm.html_text import op10_html_extraction
from lodestrata.llm.merkle import op12_merkle_manifest
from lodestrata.llm.ngram_jaccard import op2_ngram_jaccard_join
from lodestrata.llm.oracles import ORACLE_SQL  # noqa: F401
from lodestrata.llm.packing import op3_packing
from lodestrata.llm.quality import op13_quality_rules
from lodestrata.llm.repair import op9_repair_tokens
from lodestrata.llm.secrets import op7_secret_scans
from lodestrata.llm.sharding import op4_sharding
from lodestrata.llm.toxicity import op6_toxicity
from lodestrata.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_ngram_jaccard_join, op3_packing, op4_sharding, op5_benchmark_decontamination, op6_toxicity, op7_secret_scans,
        op8_embedding_near_dedup, op9_repair_tokens, op10_html_extraction, op11_embedding_whitening, op12_merkle_manifest, op13_quality_rules,
    )
}
