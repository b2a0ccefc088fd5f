"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .alignment import op11_alignment
from .chat import op7_chat
from .credentials import op3_secrets
from .decontaminate import op8_decontaminate
from .lines import OP9_SQL, op9_lines
from .mixing import OP10_SQL, op10_mixing
from .neardup import op4_neardup
from .neighbours import op13_neighbours
from .quality import op6_quality
from .ranking import OP12_SQL, op12_ranking
from .sharding import op1_sharding
from .substrings import op5_substrings
from .topk import OP2_SQL, op2_topk

QUERIES = {"pipeline": corpus_pipeline.run, "op1_sharding": op1_sharding, "op2_topk": op2_topk, "op3_secrets": op3_secrets, "op4_neardup": op4_neardup, "op5_substrings": op5_substrings, "op6_quality": op6_quality,
           "op7_chat": op7_chat, "op8_decontaminate": op8_decontaminate, "op9_lines": op9_lines, "op10_mixing": op10_mixing, "op11_alignment": op11_alignment, "op12_ranking": op12_ranking,
           "op13_neighbours": op13_neighbours}
ORACLE = {"op2_topk": OP2_SQL, "op9_lines": OP9_SQL, "op10_mixing": OP10_SQL, "op12_ranking": OP12_SQL}
