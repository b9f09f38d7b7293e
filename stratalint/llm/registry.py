"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: Module -> its query's name.
MODULES = {"quality": "op5_quality_rules", "bpe": "op6_byte_bpe", "urls": "op9_url_filters", "sharding": "op10_sharding", "pii": "op7_pii", "packing": "op2_best_fit_packing", "warc": "op4_warc_writer", "jaccard": "op8_ngram_jaccard", "ann": "op1_ann_search", "chat": "op3_chat_formatting"}


def queries() -> dict:
    out = {}
    for module, name in MODULES.items():
        out[name] = getattr(importlib.import_module(f"{__package__}.{module}"), name.split("_")[0])
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for module, name in MODULES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
