"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .op01_language_masks import op1_language_masks
from .op02_token_counts import op2_digest_cache
from .op03_mpeg_media import op3_mpeg_audio
from .op04_multi_bwt import op4_multi_bwt
from .op05_feistel_shards import op5_feistel_shards
from .op06_benchmark_leaks import op6_block_max_wand
from .op07_simhash import op7_multi_index
from .op08_token_records import op8_token_records
from .op09_linear_grouping import op9_linear_grouping
from .op10_chat_format import OP10_SQL, op10_grammar_round_trip
from .op11_byte_bpe import op11_byte_bpe
from .op12_golden_records import OP12_SQL, op12_golden_records
from .op13_fill_in_middle import OP13_SQL, op13_fill_in_middle


def queries():
    return {
        f.__name__: f
        for f in (
            op1_language_masks,
            op2_digest_cache,
            op3_mpeg_audio,
            op4_multi_bwt,
            op5_feistel_shards,
            op6_block_max_wand,
            op7_multi_index,
            op8_token_records,
            op9_linear_grouping,
            op10_grammar_round_trip,
            op11_byte_bpe,
            op12_golden_records,
            op13_fill_in_middle,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_grammar_round_trip": OP10_SQL, "op12_golden_records": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
