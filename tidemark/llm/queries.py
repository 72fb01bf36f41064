"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op7_decontamination
from .fingerprints import op3_fingerprints
from .middle import OP12_SQL, op12_fill_in_middle
from .mixing import op10_mix
from .neardup import op6_jaccard_join
from .oracles import OP6_SQL
from .packing import op11_packing
from .pages import op8_main_text
from .periods import op13_periodic_runs
from .pii import op5_personal_data
from .quality import op9_quality
from .secrets import op4_secret_scan
from .substrings import op2_substring_dedup
from .tokens import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_secret_scan": op4_secret_scan,
    "op5_personal_data": op5_personal_data,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_main_text": op8_main_text,
    "op9_quality": op9_quality,
    "op10_mix": op10_mix,
    "op11_packing": op11_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op6_jaccard_join": OP6_SQL, "op12_fill_in_middle": OP12_SQL}
