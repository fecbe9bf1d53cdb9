"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .automaton import op5_bpe
from .centroids import ORACLE as CENTROIDS
from .centroids import op12_centroids
from .chat import ORACLE as CHATS
from .chat import op13_chat_format
from .embedding_dedup import ORACLE as VECTORS
from .embedding_dedup import op7_embedding_dedup
from .hilbert_search import op8_hilbert_search
from .html_text import op3_html_text
from .line_dedup import ORACLE as LINES
from .line_dedup import op2_line_dedup
from .packing import op4_packing
from .periodic_runs import op11_periodic_runs
from .quality import op1_quality
from .simhash import op10_simhash
from .substring_dedup import ORACLE as WINDOWS
from .substring_dedup import op6_substring_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_hilbert_search": op8_hilbert_search,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroids": op12_centroids,
    "op13_chat_format": op13_chat_format,
}
ORACLES = {
    "op2_line_dedup": LINES,
    "op6_substring_dedup": WINDOWS,
    "op7_embedding_dedup": VECTORS,
    "op12_centroids": CENTROIDS,
    "op13_chat_format": CHATS,
}
