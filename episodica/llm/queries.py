"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, language, linededup, mixing, neardup, pii, quality, repair, sharding, tokens, toxicity, trie

_MODULES = (chat, decontaminate, language, linededup, mixing, neardup, pii, quality, repair, sharding, tokens, toxicity, trie)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
