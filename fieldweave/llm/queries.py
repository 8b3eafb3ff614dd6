"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from .chat import OP2_SQL, op2_chat_prefix_targets
from .decontaminate import OP6_SQL, op6_decontamination
from .html_text import op4_tag_path_text
from .kneser_ney import op13_lm_scores
from .licenses import OP7_SQL, op7_license_scan
from .mixing import OP10_SQL, op10_source_mix
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op1_compression_bands
from .simhash import op8_simhash
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .toxicity import op5_toxicity
from .whitening import op11_spectrum_whitening

QUERIES = {
    "op1_compression_bands": op1_compression_bands,
    "op2_chat_prefix_targets": op2_chat_prefix_targets,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_tag_path_text": op4_tag_path_text,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_spectrum_whitening": op11_spectrum_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lm_scores": op13_lm_scores,
}
SQL = {
    "op2_chat_prefix_targets": OP2_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_license_scan": OP7_SQL,
    "op10_source_mix": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
}
