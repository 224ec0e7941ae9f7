"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from crowdlens.llm.chat import ORACLE_OP3, op3_preference_format
from crowdlens.llm.decontam import ORACLE_OP2, op2_decontamination
from crowdlens.llm.filter_audit import ORACLE_OP13, op13_filter_audit
from crowdlens.llm.fingerprint import op11_fingerprint
from crowdlens.llm.hard_negatives import ORACLE_OP12, op12_hard_negatives
from crowdlens.llm.langid import op4_language_id
from crowdlens.llm.licenses import op5_license_scan
from crowdlens.llm.ngram_join import ORACLE_OP6, op6_ngram_jaccard_join
from crowdlens.llm.packing import op7_packing
from crowdlens.llm.quality import op8_quality_rules
from crowdlens.llm.secrets import ORACLE_OP9, op9_secret_scan
from crowdlens.llm.sharding import op10_sharding
from crowdlens.llm.suffix_dedup import op1_suffix_dedup

QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_decontamination, op3_preference_format, op4_language_id,
    op5_license_scan, op6_ngram_jaccard_join, op7_packing, op8_quality_rules, op9_secret_scan, op10_sharding,
    op11_fingerprint, op12_hard_negatives, op13_filter_audit)}

ORACLE = {"op2_decontamination": ORACLE_OP2, "op3_preference_format": ORACLE_OP3,
          "op6_ngram_jaccard_join": ORACLE_OP6, "op9_secret_scan": ORACLE_OP9,
          "op12_hard_negatives": ORACLE_OP12, "op13_filter_audit": ORACLE_OP13}
