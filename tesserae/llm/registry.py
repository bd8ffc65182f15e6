"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import conversations, exact_dedup, fuzzy_lines, hard_negatives, lang_id, license_rules, mixing, packing, part_enum, secret_ledger, telephony, token_codes, tokens

_modules = (telephony, lang_id, packing, part_enum, mixing, license_rules, secret_ledger, exact_dedup, fuzzy_lines, tokens, hard_negatives, token_codes, conversations)


def queries():
    return {name: query for m in _modules for name, query in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _modules for name, sql in m.ORACLES.items()}
