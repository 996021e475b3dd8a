"""Registered queries of the subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from riskgrid.llm import (
    bpe,
    byte_bpe,
    collocations,
    fingerprint,
    hard_negatives,
    mixing,
    near_dedup,
    quality,
    sharding,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
)
from riskgrid.llm.common import prepare


def _prepared(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)
    run.__doc__ = fn.__doc__
    return run


REGISTRY = {name: (_prepared(fn), sql) for name, (fn, sql) in {
    "op1_suffix_dedup": (suffix_dedup.query, None),
    "op2_source_mixing": (mixing.query, mixing.SQL),
    "op3_bpe_codec": (bpe.query, None),
    "op4_merkle_fingerprint": (fingerprint.query, None),
    "op5_near_dedup": (near_dedup.query, None),
    "op6_quality_votes": (quality.query, None),
    "op7_url_filter": (url_filter.query, url_filter.SQL),
    "op8_token_files": (token_files.query, None),
    "op9_toxicity_neighbours": (toxicity.query, None),
    "op10_byte_shards": (sharding.query, sharding.SQL),
    "op11_hard_negatives": (hard_negatives.query, hard_negatives.SQL),
    "op12_byte_bpe": (byte_bpe.query, None),
    "op13_collocations": (collocations.query, collocations.SQL),
}.items()}
