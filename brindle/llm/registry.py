"""Queries of the corpus operators by name, and DuckDB SQL for those that SQL can express."""

from brindle.llm.html import op7_html_extraction
from brindle.llm.langid import op2_language_id
from brindle.llm.mixing import op1_mixing
from brindle.llm.packing import op8_packing
from brindle.llm.quality import ORACLE as QUALITY_SQL
from brindle.llm.quality import op6_quality_rules
from brindle.llm.simhash import op5_simhash
from brindle.llm.suffix import op9_suffix_array
from brindle.llm.topk import ORACLE as TOP_K_SQL
from brindle.llm.topk import op3_exact_top_k
from brindle.llm.warc import ORACLE as WARC_SQL
from brindle.llm.warc import op10_warc
from brindle.llm.windows import op4_compact_windows

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_compact_windows": op4_compact_windows,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_packing": op8_packing,
    "op9_suffix_array": op9_suffix_array,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": TOP_K_SQL,
    "op6_quality_rules": QUALITY_SQL,
    "op10_warc": WARC_SQL,
}
