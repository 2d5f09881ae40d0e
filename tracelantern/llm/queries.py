"""The queries of this subpackage and their SQL."""

from tracelantern.llm.bpe import op5_bpe_round_trip
from tracelantern.llm.collocations import OP11_SQL, op11_collocations
from tracelantern.llm.cotraining import op3_quality_classifier
from tracelantern.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tracelantern.llm.html_text import op2_html_extraction
from tracelantern.llm.lm_scoring import op4_stupid_backoff
from tracelantern.llm.mixing import OP12_SQL, op12_source_mix
from tracelantern.llm.packing import op10_best_fit_packing
from tracelantern.llm.pii import op8_pii
from tracelantern.llm.prefix_trie import op13_prefix_trie
from tracelantern.llm.quality_rules import OP7_SQL, op7_quality_rules
from tracelantern.llm.simhash import op1_simhash_near_dedup
from tracelantern.llm.suffix_dedup import op9_suffix_array_dedup

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_stupid_backoff": op4_stupid_backoff,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_collocations": op11_collocations,
    "op12_source_mix": op12_source_mix,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {"op6_exact_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL, "op11_collocations": OP11_SQL, "op12_source_mix": OP12_SQL}
