"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

from . import chat, oracles, pipeline
from .byte_bpe import op8_byte_bpe
from .chat import op1_chat_parts
from .epsilon_grid import op9_epsilon_grid
from .hyperminhash import op2_hyperminhash
from .licences import op3_licence_model
from .packing import op4_pack
from .paragraphs import op7_paragraph_bands
from .quality import op6_weak_quality
from .secrets import op5_secret_owners
from .toxicity import op10_toxicity_votes


def queries() -> dict:
    ops = [op1_chat_parts, op2_hyperminhash, op3_licence_model, op4_pack, op5_secret_owners, op6_weak_quality, op7_paragraph_bands, op8_byte_bpe, op9_epsilon_grid, op10_toxicity_votes]
    return {op.__name__: op for op in ops} | {"pipeline": pipeline.run}


def oracle_sql() -> dict:
    return {"op1_chat_parts": chat.OP1_SQL, "op2_hyperminhash": oracles.OP2, "op5_secret_owners": oracles.OP5, "op9_epsilon_grid": oracles.OP9}
