"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from weftgraph.llm import bpe, line_dedup, minhash, mixing, pii, sharding, simhash, token_output, topk, toxicity

QUERIES = {
    "op1_kneser_ney_toxicity": toxicity.op1_kneser_ney_toxicity,
    "op2_token_files": token_output.op2_token_files,
    "op3_pivot_top_k": topk.op3_pivot_top_k,
    "op4_vector_shards": sharding.op4_vector_shards,
    "op5_bpe_stream": bpe.op5_bpe_stream,
    "op6_simhash_groups": simhash.op6_simhash_groups,
    "op7_minhash_prints": minhash.op7_minhash_prints,
    "op8_personal_data": pii.op8_personal_data,
    "op9_pareto_mix": mixing.op9_pareto_mix,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLE_SQL = {
    "op3_pivot_top_k": topk.ORACLE,
    "op9_pareto_mix": mixing.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
