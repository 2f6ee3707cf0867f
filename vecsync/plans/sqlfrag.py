"""DuckDB SQL fragments mirroring the native Column functions.

Used only to build the independent oracle queries (``oracle.py``); each
helper takes a SQL expression string and returns one.  RE2 flavour:
``(?m)`` instead of ``(?md)``, ``\\1`` instead of ``$1``, flag ``'g'``.
"""
from __future__ import annotations

from ..functions.clean import CTRL, WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def basic_clean(e: str) -> str:
    collapsed = rr(f"coalesce({e}, '')", WS + "+", " ")
    return rr(f"trim({collapsed})", CTRL)


def markdown_strip(e: str) -> str:
    c = f"coalesce({e}, '')"
    c = rr(c, r"(?m)^#{1,6}" + WS + "+")
    c = rr(c, r"\*{1,2}([^*]+)\*{1,2}", r"\1")
    c = rr(c, r"`([^`]+)`", r"\1")
    c = rr(c, r"\[([^\]]+)\]\([^)]+\)", r"\1")
    c = rr(c, r"(?m)^" + WS + r"*[-*+]" + WS + "+")
    c = rr(c, r"(?m)^" + WS + r"*\p{Nd}+\." + WS + "+")
    return c


def markdown_clean(e: str) -> str:
    return basic_clean(markdown_strip(e))


def html_text(e: str) -> str:
    """Written for the markup of the given tables and apart from the Column functions: whole
    elements, comments and tags go one kind after the other, then references are decoded."""
    c = f"coalesce({e}, '')"
    for element in ("script", "style", "nav", "aside", "footer"):
        c = rr(c, rf"(?is)<{element}(\s[^>]*)?>.*?</{element}>")
    c = rr(rr(c, r"(?s)<!--.*?-->"), r"</?[A-Za-z!][^>]*>")
    for name, char in (("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", " "),
                       ("copy", "©"), ("middot", "·"), ("amp", "&")):
        c = f"replace({c}, '&{name};', {q(char)})"
    return c


def html_clean(e: str) -> str:
    return basic_clean(html_text(e))


def code_point_sum(e: str) -> str:
    return (f"(CASE WHEN {e} = '' THEN 0 ELSE list_sum(list_transform("
            f"string_split({e}, ''), lambda ch: unicode(ch))) END)")


def mock_embedding(e: str, dim: int) -> str:
    base = f"({code_point_sum(e)} / (length({e}) + 1))"
    return (f"list_transform(range({dim}), lambda i: "
            f"CAST(round(fmod({base} + i * 0.001, 2.0) - 1.0, 6) AS FLOAT))")


def completion_pct(nulls: str, total: str) -> str:
    """decimal(5,2) half-up, exact: integer arithmetic before the cast."""
    return (f"CAST(CASE WHEN {total} > 0 THEN "
            f"(({total} - {nulls}) * 20000 + {total}) // (2 * {total}) / 100.0 "
            f"ELSE 100 END AS DECIMAL(5,2))")


def vector_status(v: str, dim: str | int) -> str:
    return (f"(CASE WHEN {v} IS NULL THEN 'null_vector' "
            f"WHEN len({v}) <> {dim} THEN 'wrong_dimension' "
            f"WHEN NOT list_bool_and(list_transform({v}, lambda x: x IS NOT NULL AND NOT isnan(x))) "
            f"THEN 'non_numeric' ELSE 'ok' END)")
