"""Operators for large training corpora, and their queries. Nothing else in the library imports this package."""

from importlib import import_module

MODULES = ("suffix_dedup", "token_output", "spot_signatures", "secrets", "toxicity", "decontamination", "mixing", "chosen_path", "warc", "quality", "merkle", "byte_bpe", "lexical_search")


def load():
    """(queries, sql) of this package."""
    from lakelens.llm import base

    for m in MODULES:
        import_module(f"lakelens.llm.{m}")
    return dict(base.QUERIES), dict(base.SQL)
