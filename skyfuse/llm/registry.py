"""Queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_ctw": "ctw",
    "op2_html": "html",
    "op3_embeddings": "vectors",
    "op4_simhash": "simhash",
    "op5_mixing": "mixing",
    "op6_substring_dedup": "substrings",
    "op7_secrets": "secrets",
    "op8_toxicity": "toxicity",
    "op9_bpe": "bpe",
    "op10_topk": "topk",
}


def _query(name: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"skyfuse.llm.{_MODULES[name]}"), name)(spark, sf_dir)


def queries() -> dict:
    return {name: _query(name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return dict(importlib.import_module("skyfuse.llm.sql").SQL)
