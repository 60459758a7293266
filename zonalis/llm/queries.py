"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from zonalis.llm.alignment import op13_align
from zonalis.llm.bpe import op2_bpe
from zonalis.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from zonalis.llm.language import op5_language
from zonalis.llm.mixing import OP10_SQL, op10_mix
from zonalis.llm.pivots import OP7_SQL, op7_pivots
from zonalis.llm.quality import op1_quality
from zonalis.llm.secret_scan import op3_secrets
from zonalis.llm.simhash import op9_simhash
from zonalis.llm.suffixes import op6_suffixes
from zonalis.llm.topk import OP4_SQL, op4_topk
from zonalis.llm.toxicity import op11_toxicity
from zonalis.llm.url_rules import op8_urls

QUERIES = {f.__name__: f for f in (
    op1_quality, op2_bpe, op3_secrets, op4_topk, op5_language, op6_suffixes, op7_pivots, op8_urls, op9_simhash, op10_mix,
    op11_toxicity, op12_hard_negatives, op13_align)}
ORACLES: dict[str, str] = {"op4_topk": OP4_SQL, "op7_pivots": OP7_SQL, "op10_mix": OP10_SQL,
                           "op12_hard_negatives": OP12_SQL}
