"""The queries of this subpackage, one an operator, and their DuckDB SQL."""

from __future__ import annotations

from loomline.llm import ann, decontaminate, language_id, licenses, lm_scoring, mixing, near_dedup, secrets, substring_dedup, suffix_dedup
from loomline.llm.oracles import ORACLE_SQL  # noqa: F401  read by the driver's entry
from loomline.session import ship_package


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


QUERIES = {
    name: _shipped(query)
    for name, query in {
        "op1_substring_dedup": substring_dedup.query,
        "op2_lm_score": lm_scoring.query,
        "op3_decontaminate": decontaminate.query,
        "op4_nearest": ann.query,
        "op5_license_scan": licenses.query,
        "op6_near_dedup": near_dedup.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_mixture": mixing.query,
        "op9_language_id": language_id.query,
        "op10_secret_scan": secrets.query,
    }.items()
}
