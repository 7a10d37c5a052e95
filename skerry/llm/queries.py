"""Registered queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from skerry.llm.line_dedup import OP9_SQL, op9_line_dedup
from skerry.llm.decontaminate import op5_decontaminate
from skerry.llm.language_id import op7_language_id
from skerry.llm.lm_score import OP8_SQL, op8_lm_score
from skerry.llm.maxscore import OP6_SQL, op6_maxscore
from skerry.llm.near_dedup import op4_near_dedup
from skerry.llm.periodic import OP12_SQL, op12_periodic_runs
from skerry.llm.resample import OP13_SQL, op13_resample
from skerry.llm.sharding import op10_sharding
from skerry.llm.substring_dedup import OP11_SQL, op11_substring_dedup
from skerry.llm.token_store import op2_token_store
from skerry.llm.unigram import op1_sentencepiece
from skerry.llm.url_filter import OP3_SQL, op3_url_filter

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_token_store, op3_url_filter, op4_near_dedup, op5_decontaminate, op6_maxscore, op7_language_id, op8_lm_score, op9_line_dedup, op10_sharding,
                                op11_substring_dedup, op12_periodic_runs, op13_resample)}
SQL = {"op3_url_filter": OP3_SQL, "op6_maxscore": OP6_SQL, "op8_lm_score": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_substring_dedup": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_resample": OP13_SQL}
