"""F1–F8: text cleaning as native Column expressions.

Every cleaner is ``Column -> Column`` built from ``regexp_replace`` / ``trim``
so it stays inside whole-stage codegen and Catalyst can push filters past it.
A cleaning pipeline is an ordered list of step names resolved at plan time
into one composed expression (``functools.reduce``), i.e. one projection.

Regex dialect notes (the semantics follow Python ``re`` on ``str``):

* Python ``\\s`` is wider than Java's; ``WS`` spells it out explicitly.
* Python ``^`` under MULTILINE only follows ``\\n``; Java needs ``(?d)``
  (UNIX_LINES) for the same, hence ``(?md)``.
* Python ``\\d`` is any Unicode decimal digit: ``\\p{Nd}``.
"""
import functools
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference semantics)
# ---------------------------------------------------------------------------
# Characters Python's str.isspace() accepts (what ``\s`` matches in ``re``).
WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Control characters removed by the basic cleaner (after whitespace collapse).
CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# The same for Java, which asks the ranges of a set one after another for every character of a
# text: a look ahead passes most letters by at once.
_WS_RUN = r"(?![!-~\x{a1}-\x{167f}])" + WS + WS + "*"
_CTRL_SHORT = r"[\x00-\x1F\x7F&&[^\t\n\r]]"
# The six markdown removals, in order: headers, bold / italic, inline code, links to their
# text, bullets, numbers.
MARKDOWN = ((r"(?md)^#{1,6}" + WS + "+", ""), (r"\*{1,2}([^*]+)\*{1,2}", "$1"),
            (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
            (r"(?md)^" + WS + r"*[-*+]" + WS + "+", ""),
            (r"(?md)^" + WS + r"*\p{Nd}+\." + WS + "+", ""))
# Elements of the HTML standard that have no content and no end tag.
HTML_VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                  "param", "source", "track", "wbr")
# Subtrees dropped by the HTML cleaner.
HTML_DROPPED_TAGS = ("script", "style", "nav", "footer", "aside")
# Character references that the native path decodes; ``&amp;`` goes last.
HTML_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                 ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
                 ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
# Step-name aliases accepted in a pipeline definition.
STEP_ALIASES = {
    "html_extraction": "html", "html": "html", "html_to_markdown": "html",
    "markdown_conversion": "markdown", "markdown": "markdown",
    "markdown_cleanup": "markdown",
    "text_normalization": "basic", "normalization": "basic", "basic": "basic",
    "basic_cleanup": "basic", "whitespace_cleanup": "basic", "whitespace": "basic",
}
# Names each cleaner reports in provenance strings.
STEP_LABELS = {"basic": "basic_cleanup", "html": "html_to_markdown",
               "markdown": "markdown_cleanup"}


def _nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def basic_clean(c: Column) -> Column:
    """collapse whitespace runs to one space, trim, then drop control chars.

    The delete runs after the collapse, so ``"a \\x00 b"`` becomes ``"a  b"``.
    """
    c = F.regexp_replace(_nz(c), _WS_RUN, " ")
    c = F.trim(c)  # only spaces remain at the ends after the collapse
    return F.regexp_replace(c, _CTRL_SHORT, "")


def markdown_strip(c: Column) -> Column:
    """The six markdown removals of F2, without the trailing basic clean."""
    c = _nz(c)
    for pattern, kept in MARKDOWN:
        c = F.regexp_replace(c, pattern, kept)
    return c


def markdown_clean(c: Column) -> Column:
    """markdown markup removed, then F1."""
    return basic_clean(markdown_strip(c))


HTML_RAW = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
HTML_TAG = r"<[a-zA-Z/!?][^>]*>"
# What the native path leaves to the tokenizer: other references; a quote still open at the
# end of a tag; elements whose extent depends on the tree around them; comments and raw text
# that are unusual; "<" that begins no tag.
HTML_HARD = (
    "(?is)&(?!(?:" + "|".join(e[1:-1] for e, _ in HTML_ENTITIES) + r");)[#a-z0-9]"
    r"|<[a-z/][^>]*=\s*(?:\"[^\">]*|'[^'>]*)>"
    r"|</?(?:" + "|".join(t for t in HTML_DROPPED_TAGS if t not in ("script", "style")) + r")\b"
    r"|<!--(?:-?>|.*?--!>)|<!\[|<\?|<(?:textarea|title|plaintext|xmp|noscript|iframe)\b[^>]*>[^<]*<(?!/)"
    r"|<(?![a-z/!])|</(?![a-z])")


def html_is_easy(c: Column) -> Column:
    """Whether the native path gives exactly what a tree builder sees."""
    bare = F.regexp_replace(c, HTML_RAW, "")
    return ~c.rlike(HTML_HARD) & ~bare.rlike(r"(?is)</?(?:script|style)\b|<!--|<[^>]*\z")


def html_text_native(c: Column) -> Column:
    """Text nodes without a separator, for documents that ``html_is_easy`` names."""
    c = F.regexp_replace(F.regexp_replace(c, HTML_RAW, ""), HTML_TAG, "")
    for ent, ch in HTML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def html_text(c: Column) -> Column:
    """text nodes of an HTML document concatenated with no separator.

    Script, style, nav, footer and aside elements go with all they hold; an
    open element ends where its parent's end tag does; every character
    reference is decoded.  Documents that patterns can handle exactly stay in
    the JVM, the others (only those) go through a tokenizer in Arrow batches.
    A text without "<" and "&" is its own text, and no pattern looks at it.
    """
    c = _nz(c)
    plain = ~F.contains(c, F.lit("<")) & ~F.contains(c, F.lit("&"))
    easy = html_is_easy(c)
    hard = html_text_parser_udf()(F.when(~plain & ~easy, c))
    return F.when(plain, c).when(easy, html_text_native(c)).otherwise(hard)


def html_clean(c: Column) -> Column:
    """HTML to plain text, then F1 (line/phrase trimming is subsumed by
    F1's whitespace collapse)."""
    return basic_clean(html_text(c))


# --- F8: documented extra cleaners ------------------------------------------

def lowercase(c: Column) -> Column:
    return F.lower(_nz(c))


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(_nz(c), r"\p{Punct}", "")


def limit_newlines(c: Column, max_consecutive: int = 2) -> Column:
    n = max_consecutive
    return F.regexp_replace(_nz(c), "\n{%d,}" % (n + 1), "\n" * n)


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(_nz(c), WS + "+", " "))


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "basic": basic_clean, "html": html_clean, "markdown": markdown_clean,
    "lowercase": lowercase, "remove_punctuation": remove_punctuation,
    "limit_newlines": limit_newlines, "normalize_whitespace": normalize_whitespace,
}
for _k in ("lowercase", "remove_punctuation", "limit_newlines", "normalize_whitespace"):
    STEP_LABELS[_k] = _k


# --- F4/F5: pipelines ---------------------------------------------------------

def resolve_steps(steps: list[str], custom: dict[str, Callable] | None = None):
    """Step names -> (functions, labels, skipped names). Unknown steps are
    skipped (reported back), as the reference does."""
    custom = custom or {}
    fns, labels, skipped = [], [], []
    for s in steps:
        key = s.lower()
        if key in custom:
            fns.append(custom[key]); labels.append(key)
            continue
        key = STEP_ALIASES.get(key, key)
        if key in CLEANERS:
            fns.append(CLEANERS[key]); labels.append(STEP_LABELS[key])
        else:
            skipped.append(s)
    return fns, labels, skipped


def pipeline(steps: list[str], custom: dict[str, Callable] | None = None
             ) -> Callable[[Column], Column]:
    """ordered composition of named steps into one Column function."""
    fns, _, _ = resolve_steps(steps, custom)
    return lambda c: functools.reduce(lambda acc, f: f(acc), fns, c)


def pipeline_config_name(name: str, steps: list[str]) -> str:
    """Provenance string ``name:step->step``."""
    _, labels, _ = resolve_steps(steps)
    return f"{name}:{'->'.join(labels)}"


# Preset pipelines (F5): name -> steps.
PRESETS = {
    "basic_text": ["basic"],
    "html_to_text": ["html", "basic"],
    "markdown_to_text": ["markdown", "basic"],
}


def simple_pipeline(name: str) -> Callable[[Column], Column]:
    """One-step pipeline by cleaner name; an unknown name falls back to basic."""
    key = STEP_ALIASES.get(name.lower(), name.lower())
    return CLEANERS.get(key, basic_clean)


def preprocess_text(c: Column, name: str = "basic_cleanup") -> Column:
    return simple_pipeline(name)(c)


# --- F3: the tokenizer path (per-row helper in an Arrow UDF) -----------------

def _html_text_python(doc: str | None) -> str:
    from collections import Counter
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.stack, self.open = [], [], Counter()

        def handle_starttag(self, tag, attrs):
            if tag not in HTML_VOID_TAGS:
                self.stack.append(tag)
                self.open[tag] += 1

        def handle_startendtag(self, tag, attrs):
            pass                                        # opened and closed at once

        def handle_endtag(self, tag):
            # the innermost such element ends, and with it all inside that are still open
            while self.open[tag]:
                last = self.stack.pop()
                self.open[last] -= 1
                if last == tag:
                    break

        def handle_data(self, data):
            if not any(self.open[t] for t in HTML_DROPPED_TAGS):
                self.out.append(data)

    if not doc:
        return ""
    p = Text()
    p.feed(doc)
    p.close()
    return "".join(p.out)


def html_text_parser_udf():
    import pandas as pd

    @F.pandas_udf("string")
    def _html_text(s: pd.Series) -> pd.Series:
        return s.map(_html_text_python)

    return _html_text


def html_clean_parser(c: Column) -> Column:
    """F3 with every document through the tokenizer, then F1."""
    return basic_clean(html_text_parser_udf()(c))
