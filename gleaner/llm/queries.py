"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: (query, module, SQL constant or None)
_ALL = [
    ("op1_packing", "packing", None),
    ("op2_decontamination", "decontaminate", None),
    ("op3_sharding", "sharding", None),
    ("op4_quality", "quality", None),
    ("op5_chat", "chat", None),
    ("op6_maxent", "maxent", None),
    ("op7_warc", "warc", "OP7_SQL"),
    ("op8_order_minhash", "order_minhash", None),
    ("op9_toxicity", "toxicity", None),
    ("op10_jaccard", "jaccard", "OP10_SQL"),
    ("op11_mixing", "mixing", "OP11_SQL"),
    ("op12_prefix_trie", "prefix_trie", "OP12_SQL"),
    ("op13_periodic", "periodic", None),
]


def queries() -> dict[str, Callable]:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module, _ in _ALL}
    return found


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f".{module}", __package__), sql) for name, module, sql in _ALL if sql}
