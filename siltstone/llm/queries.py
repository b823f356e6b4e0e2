"""The registered queries of the training-data operators, and the SQL they are held against."""

from __future__ import annotations

from .decontaminate import op10_decontamination
from .license_scan import OP6_SQL, known_texts_sql, license_known_texts, op6_license_scan
from .lm_score import op8_lm_score
from .media import op2_media
from .minhash import op4_minhash
from .packing import op1_packing
from .quality import op3_quality
from .token_counts import op7_token_counts
from .url_filter import OP9_SQL, op9_url_filter
from .warc import op5_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_minhash": op4_minhash,
    "op5_warc": op5_warc,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_lm_score": op8_lm_score,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
}
#: Queries beside the operators' own.
MORE = {"license_known_texts": license_known_texts}
ORACLES: dict[str, str] = {"op6_license_scan": OP6_SQL, "op9_url_filter": OP9_SQL, "license_known_texts": known_texts_sql()}
