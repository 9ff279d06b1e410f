"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lumenfold.llm.ann import op10_ann
from lumenfold.llm.bpe import op1_bpe
from lumenfold.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from lumenfold.llm.language import op3_language
from lumenfold.llm.line_dedup import op5_line_dedup
from lumenfold.llm.merkle import OP13_SQL, op13_merkle
from lumenfold.llm.minhash_dedup import op6_near_dedup
from lumenfold.llm.mixing import op11_mixing
from lumenfold.llm.negatives import OP12_SQL, op12_hard_negatives
from lumenfold.llm.packing import op8_packing
from lumenfold.llm.sharding import op2_sharding
from lumenfold.llm.toxicity import op7_toxicity
from lumenfold.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ann": op10_ann,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL = {"op4_warc": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle": OP13_SQL}
