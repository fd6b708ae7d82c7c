"""The queries of the training-data operators, by name, and SQL where SQL can express them."""

from __future__ import annotations

from shelfwise.llm.cotraining import op2_cotraining
from shelfwise.llm.fim import op13_fill_in_middle
from shelfwise.llm.gif import op6_gif
from shelfwise.llm.jaccard_join import op11_jaccard_join
from shelfwise.llm.langid import op8_langid
from shelfwise.llm.line_dedup import op9_line_dedup
from shelfwise.llm.oracles import OP11, OP13
from shelfwise.llm.packing import op4_packing
from shelfwise.llm.pieces import op1_sampled_pieces
from shelfwise.llm.quality_rules import op7_quality_rules
from shelfwise.llm.runs import op12_periodic_runs
from shelfwise.llm.simhash import op5_simhash
from shelfwise.llm.sstable import op10_token_shards
from shelfwise.llm.substring_dedup import op3_repeated_passages

QUERIES = {
    "op1_sampled_pieces": op1_sampled_pieces,
    "op2_cotraining": op2_cotraining,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_gif": op6_gif,
    "op7_quality_rules": op7_quality_rules,
    "op8_langid": op8_langid,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_shards": op10_token_shards,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {"op11_jaccard_join": OP11, "op13_fill_in_middle": OP13}
