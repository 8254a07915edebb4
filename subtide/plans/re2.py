"""Java patterns of the rule tables in the dialect of the SQL checks (RE2)."""

from __future__ import annotations

import re

from subtide.functions.textrules import Rule

#: Unicode's white space, which RE2 leaves out of its own class.
_WHITE = r"\t-\r \x{85}\p{Z}"


def expressible(rule: Rule) -> bool:
    """Whether RE2 has all that the pattern uses: no look-around, nothing possessive, no POSIX classes."""
    return not re.search(r"\(\?<?[=!]|[*+?]\+|\\p\{Alnum\}", rule.pattern)


def pattern(java: str) -> str:
    flags = re.match(r"\(\?([dmsU]+)\)", java)
    body = java[flags.end() :] if flags else java
    body = body.replace(r"\s", f"[{_WHITE}]").replace(r"\w", r"[\p{L}\p{M}\p{N}_]")
    return f"(?{'m' if flags and 'm' in flags[1] else ''}-s)" + body


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace(sql: str, rule: Rule) -> str:
    """The rewrite as SQL over another expression."""
    to = re.sub(r"\$(\d)", r"\\\1", rule.to)
    return f"regexp_replace({sql}, {literal(pattern(rule.pattern))}, {literal(to)}, 'g')"


def matches(sql: str, java: str) -> str:
    return f"regexp_matches({sql}, {literal(pattern(java))})"


TRIM = Rule("trim", r"(?dU)\A\s+|\s+\z")


def trim(sql: str) -> str:
    return replace(sql, TRIM)
