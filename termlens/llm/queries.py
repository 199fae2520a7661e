"""The registered queries of the subpackage, and the SQL of those that SQL can express."""

from termlens.llm import op01_secret_scan, op12_mixing, op13_phrases
from termlens.llm.op01_secret_scan import op1_secret_scan
from termlens.llm.op02_decontaminate import op2_decontaminate
from termlens.llm.op03_substring_dedup import op3_substring_dedup
from termlens.llm.op04_language_id import op4_language_id
from termlens.llm.op05_url_filter import op5_url_filter
from termlens.llm.op06_toxicity import op6_toxicity
from termlens.llm.op07_minhash import op7_minhash_neardup
from termlens.llm.op08_packing import op8_packing
from termlens.llm.op09_lm_scoring import op9_lm_scoring
from termlens.llm.op10_ann import op10_ann
from termlens.llm.op11_whitening import op11_whitening
from termlens.llm.op12_mixing import op12_curriculum
from termlens.llm.op13_phrases import op13_collocations

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_decontaminate,
        op3_substring_dedup,
        op4_language_id,
        op5_url_filter,
        op6_toxicity,
        op7_minhash_neardup,
        op8_packing,
        op9_lm_scoring,
        op10_ann,
        op11_whitening,
        op12_curriculum,
        op13_collocations,
    )
}

ORACLE_SQL = {
    "op1_secret_scan": op01_secret_scan.ORACLE_SQL,
    "op12_curriculum": op12_mixing.ORACLE_SQL,
    "op13_collocations": op13_phrases.ORACLE_SQL,
}
