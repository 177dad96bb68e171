"""The queries of this subpackage and their SQL."""

from weftline.llm.ann import op7_ann
from weftline.llm.katz import op3_katz
from weftline.llm.langid import op6_langid
from weftline.llm.media import op4_media
from weftline.llm.mixing import OP5_SQL, op5_mixing
from weftline.llm.packing import op2_packing
from weftline.llm.quality import op8_quality
from weftline.llm.secrets import op10_secrets
from weftline.llm.simhash import op1_simhash
from weftline.llm.substrings import OP9_SQL, op9_substrings

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_katz": op3_katz,
    "op4_media": op4_media,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_secrets": op10_secrets,
}
SQL = {"op5_mixing": OP5_SQL, "op9_substrings": OP9_SQL}
