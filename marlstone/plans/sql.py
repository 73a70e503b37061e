"""Pieces of SQL, for the other engine, that say what the column functions say."""

from __future__ import annotations

from marlstone.functions.text import AFTER, BEFORE, WS


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def one_line(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def normal(x: str) -> str:
    return f"lower({one_line(x)})"


def words(x: str) -> str:
    return f"list_filter(string_split({one_line(x)}, ' '), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def whole(x: str, pattern: str) -> str:
    return has(x, f"{BEFORE}(?:{pattern}){AFTER}")


def case(x: str, rules: list[tuple[str, str]], other: str) -> str:
    return "case " + " ".join(f"when {has(x, p)} then {q(n)}" for p, n in rules) + f" else {q(other)} end"


def bare(x: str) -> str:
    ends = "[ .,!?:;\n\t]+"
    return sub(x, f"^{ends}|{ends}$")


def latest(table: str, key: str, order: str) -> str:
    return f"(select * exclude (_r) from (select *, row_number() over (partition by {key} order by {order}) as _r from {table}) where _r = 1)"
