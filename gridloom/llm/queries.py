"""The queries of the training-data operators, and SQL for those that SQL can express."""

from gridloom.llm.decontaminate import op4_benchmark_hits
from gridloom.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from gridloom.llm.html_extract import op7_html_extract
from gridloom.llm.language_id import op6_language_id, op6_pages_language
from gridloom.llm.lm_score import op5_lm_scores
from gridloom.llm.mixing import OP2_SQL, op2_pareto_mix
from gridloom.llm.quality import op9_quality
from gridloom.llm.simhash import op10_simhash_groups
from gridloom.llm.suffix_dedup import op1_suffix_dedup
from gridloom.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pareto_mix": op2_pareto_mix,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_benchmark_hits": op4_benchmark_hits,
    "op5_lm_scores": op5_lm_scores,
    "op6_language_id": op6_language_id,
    "op6_pages_language": op6_pages_language,
    "op7_html_extract": op7_html_extract,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_simhash_groups": op10_simhash_groups,
}

SQL = {"op2_pareto_mix": OP2_SQL, "op3_exact_dedup": OP3_SQL}
