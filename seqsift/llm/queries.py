"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from .decontam import op10
from .exact import OP7_SQL, op7
from .language import op3
from .licenses import op6
from .mixing import OP5_SQL, op5
from .near import OP8_SQL, op8
from .passages import op4
from .pii import op9
from .toxicity import op2
from .url_filter import OP1_SQL, op1

QUERIES = {"op1_url_filter": op1, "op2_toxicity": op2, "op3_language_id": op3, "op4_substring_dedup": op4, "op5_source_mixing": op5, "op6_license_scan": op6, "op7_exact_dedup": op7, "op8_minhash_near_dedup": op8, "op9_pii": op9, "op10_decontamination": op10}
ORACLES = {"op1_url_filter": OP1_SQL, "op5_source_mixing": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL}
