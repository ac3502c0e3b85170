"""Statements in the SQL that both engines share, but for a few spellings.

`~/` is whole division, `OLEN[x]` the bytes of a text, and `JOIN[x; separator; order]` an
ordered concatenation.
"""

from __future__ import annotations

import re

_JOIN = re.compile(r"JOIN\[(.*?); (.*?); (.*?)\]", re.S)
_OLEN = re.compile(r"OLEN\[(.*?)\]")


def for_spark(sql: str) -> str:
    sql = _OLEN.sub(r"octet_length(\1)", sql.replace("~/", "div"))
    return _JOIN.sub(r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)", sql)


def for_duckdb(sql: str) -> str:
    sql = _OLEN.sub(r"octet_length(encode(\1))", sql.replace("~/", "//"))
    return _JOIN.sub(r"string_agg(\1, \2 ORDER BY \3)", sql)
