"""The registered queries of the training-data operators and their oracle SQL."""

from tidemark.llm.bpe import op1_byte_bpe
from tidemark.llm.html import op3_html
from tidemark.llm.jpeg import op8_media
from tidemark.llm.mixing import ORACLE as MIXING_ORACLE
from tidemark.llm.mixing import op6_mixing
from tidemark.llm.pii import op7_pii
from tidemark.llm.pq import op10_embeddings
from tidemark.llm.quality import op2_quality
from tidemark.llm.secrets import op9_secrets
from tidemark.llm.simhash import op4_simhash
from tidemark.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_html": op3_html,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_media": op8_media,
    "op9_secrets": op9_secrets,
    "op10_embeddings": op10_embeddings,
}

ORACLES: dict[str, str] = {
    "op6_mixing": MIXING_ORACLE,
}
