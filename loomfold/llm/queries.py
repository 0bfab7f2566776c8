"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, clusters, exact_dedup, host_rules, language, leaks, mixing, shards, simhash, substrings, toxicity, url_filter
from .common import table


def _over(name, operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES = {
    "op1_language_bitmask": _over("documents", language.query),
    "op2_perspective_rotation": _over("conversations", lambda t: chat.digest(chat.rotate(t))),
    "op3_radix_substrings": _over("documents", substrings.query),
    "op4_url_filter": url_filter.query,
    "op5_exact_dedup": _over("documents", exact_dedup.exact_dedup),
    "op6_simhash_pigeonhole": _over("documents", simhash.query),
    "op7_window_leaks": leaks.query,
    "op8_kneser_ney_toxicity": toxicity.query,
    "op9_minimax_shards": _over("documents", shards.shard),
    "op10_source_mix": _over("documents", mixing.mix),
    "op11_host_rules": _over("documents", host_rules.query),
    "op12_block_norm_clusters": clusters.query,
    "op13_event_alignment": alignment.query,
}

ORACLES = {
    "op2_perspective_rotation": chat.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_host_rules": host_rules.ORACLE_SQL,
    "op12_block_norm_clusters": clusters.ORACLE_SQL,
}
