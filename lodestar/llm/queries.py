"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from lodestar.llm.chat import OP10_SQL, op10_chat
from lodestar.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from lodestar.llm.langid import op7_langid
from lodestar.llm.minhash import op9_minhash
from lodestar.llm.packing import op5_packing
from lodestar.llm.pieces import op3_pieces
from lodestar.llm.pii import op8_pii
from lodestar.llm.suffix_dedup import op1_suffix_dedup
from lodestar.llm.topk import OP6_SQL, op6_topk
from lodestar.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pieces": op3_pieces,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_langid": op7_langid,
    "op8_pii": op8_pii,
    "op9_minhash": op9_minhash,
    "op10_chat": op10_chat,
}
ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op6_topk": OP6_SQL, "op10_chat": OP10_SQL}
