"""Queries of the operators and, where SQL can express a whole result, their SQL."""

from __future__ import annotations

from . import chat, warc
from .bpe import op2_bpe
from .chat import op6_chat
from .embeddings import op8_embeddings
from .language import op9_language
from .minhash import op1_minhash
from .mixing import op10_mixing
from .quality import op4_quality
from .secrets import op5_secrets
from .substrings import op7_substrings
from .warc import op3_warc


def queries() -> dict:
    return {
        "op1_minhash": op1_minhash,
        "op2_bpe": op2_bpe,
        "op3_warc": op3_warc,
        "op4_quality": op4_quality,
        "op5_secrets": op5_secrets,
        "op6_chat": op6_chat,
        "op7_substrings": op7_substrings,
        "op8_embeddings": op8_embeddings,
        "op9_language": op9_language,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    """The rest are held against brute force in tests: merges by rank, robust estimates, models, samples and hashing aren't SQL."""
    return {"op3_warc": warc.ORACLE, "op6_chat": chat.ORACLE}
