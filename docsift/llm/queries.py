"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from .decontaminate import op2_decontaminate
from .exact import ORACLE as EXACT_SQL
from .exact import op13_exact
from .impact import ORACLE as IMPACT_SQL
from .impact import op11_impact
from .language import op3_language
from .licences import ORACLE as LICENCES_SQL
from .licences import op4_licences
from .minhash import op10_minhash
from .neighbours import op7_neighbours
from .packing import op1_packing
from .pages import op6_pages
from .quality import op9_quality
from .repair import ORACLE as REPAIR_SQL
from .repair import op12_repair
from .substring import op8_substring
from .toxicity import op5_toxicity

QUERIES = {"op1_packing": op1_packing, "op10_minhash": op10_minhash, "op8_substring": op8_substring, "op2_decontaminate": op2_decontaminate, "op5_toxicity": op5_toxicity, "op3_language": op3_language, "op9_quality": op9_quality, "op4_licences": op4_licences, "op6_pages": op6_pages, "op7_neighbours": op7_neighbours, "op11_impact": op11_impact, "op12_repair": op12_repair, "op13_exact": op13_exact}
SQL: dict[str, str] = {"op4_licences": LICENCES_SQL, "op11_impact": IMPACT_SQL, "op12_repair": REPAIR_SQL, "op13_exact": EXACT_SQL}
