"""The queries of this package and their SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat
from .language import op4_language
from .lines import op7_lines
from .media import op5_media
from .mixing import OP9_SQL, op9_mix
from .pieces import op10_pieces
from .quality import op8_quality
from .secrets import op6_secrets
from .simhash import op3_simhash
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat": op2_chat,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_media": op5_media,
    "op6_secrets": op6_secrets,
    "op7_lines": op7_lines,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_pieces": op10_pieces,
}
ORACLE_SQL = {"op2_chat": OP2_SQL, "op9_mix": OP9_SQL}
