"""The queries of this subpackage, by name, and the SQL that DuckDB can check them with."""

from . import decontamination, exact_dedup, jaccard_join, katz, licenses, packing, pii, quality, substring_dedup, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_pii": pii.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_warc": warc.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_decontamination": decontamination.query,
    "op7_licenses": licenses.query,
    "op8_katz": katz.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_quality": quality.query,
}
ORACLES = {
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_licenses": licenses.oracle(),
    "op9_exact_dedup": exact_dedup.ORACLE,
}
