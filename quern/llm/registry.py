"""The queries of the training-data operators and the SQL that must agree with them."""

from __future__ import annotations

from quern.llm import op1_aq, op10_lines, op2_quality, op3_packing, op4_toxicity, op5_ctw, op6_bpe, op7_simhash, op8_suffix, op9_sharding
from quern.session import configure


def _with_settings(query):
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {
        "op1_aq": op1_aq.query,
        "op2_quality": op2_quality.query,
        "op3_packing": op3_packing.query,
        "op4_toxicity": op4_toxicity.query,
        "op5_ctw": op5_ctw.query,
        "op6_bpe": op6_bpe.query,
        "op7_simhash": op7_simhash.query,
        "op8_suffix": op8_suffix.query,
        "op9_sharding": op9_sharding.query,
        "op10_lines": op10_lines.query,
        "pipeline": _pipeline,
    }
    return {name: _with_settings(query) for name, query in found.items()}


def oracle_sql() -> dict:
    """Queries without an entry can't be said in SQL, or not over whole tables; tests/llm holds them against brute force."""
    return {
        "op1_aq": op1_aq.oracle(),
        "op2_quality": op2_quality.oracle(),
        "op9_sharding": op9_sharding.oracle(),
    }
