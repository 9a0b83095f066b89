"""Operators of a training-data pipeline over documents, embeddings, pages and conversations.

Nothing else in the library imports this package. ``queries`` and
``oracle_sql`` list what ``__spark_entry__`` registers from it.
"""

from __future__ import annotations

from importlib import import_module

#: Query name -> module with ``query(spark, sf_dir)`` and, where SQL can say it, ``SQL``.
MODULES = {
    "op1_language_id": "language",
    "op2_secret_scan": "secrets",
    "op3_embedding_dedup": "embeddings",
    "op4_warc": "warc",
    "op5_mixing": "mixing",
    "op6_byte_bpe": "bpe",
    "op7_quality_rules": "quality",
    "op8_toxicity": "toxicity",
    "op9_simhash": "simhash",
    "op10_chat_quotes": "chat",
}


#: Operators once more on derived tables: query name -> module, its query and its SQL.
DERIVED = {"chat_replies": ("chat", "replies_query", "REPLIES_SQL")}


def queries() -> dict:
    found = {name: import_module(f"{__name__}.{module}").query for name, module in MODULES.items()}
    return found | {name: getattr(import_module(f"{__name__}.{module}"), query) for name, (module, query, _) in DERIVED.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    found |= {name: getattr(import_module(f"{__name__}.{module}"), sql) for name, (module, _, sql) in DERIVED.items()}
    return {name: sql for name, sql in found.items() if sql}
