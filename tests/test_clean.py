"""F1–F8: expected strings stated by hand."""
import pytest
from pyspark.sql import functions as F

from support import SF001, one_col
from vecsync.functions import clean as C


def run(spark, fn, values):
    df = one_col(spark, values)
    rows = df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


BASIC = {
    "": "", " ": "", "\t\n\r": "", "kelp": "kelp", "  two\twords ": "two words",
    "row one\r\n\r\nrow two": "row one row two", "no break": "no break",
    "thin and　wide": "thin and wide", "line para end": "line para end",
    "nel\u0085x": "nel x", "\x1cfs\x1dgs\x1ers\x1fus": "fs gs rs us",
    "zero​width stays": "zero​width stays", "bell\x07 gone": "bell gone",
    "del\x7fete": "delete", "null \x00 between": "null  between", "\x02 lead": " lead",
    "fin \x03": "fin ", "ünïcödé 😀 ok": "ünïcödé 😀 ok", "\x0b\x0cvt ff": "vt ff",
}
MARKDOWN = {
    "": "", "###### Deep sea": "Deep sea", "####### seven": "####### seven", "#tag": "#tag",
    "Tide\n# Ebb\n## Flow\nend": "Tide Ebb Flow end", "a **strong** wind": "a strong wind",
    "an *oblique* ray": "an oblique ray", "run `ls -l` now": "run ls -l now",
    "see [the chart](map.png) here": "see the chart here", "[](x)": "[](x)", "[a]()": "[a]()",
    "- salt\n- sand\n* silt\n+ clay": "salt sand silt clay", "  - deep": "deep",
    "1. first\n23. second": "first second", "3.14 stays": "3.14 stays", "-dash stays": "-dash stays",
    "2 * 3 * 4": "2 3 4", "٣. arabic digit": "arabic digit", "x\r# y": "x # y",
    "**open": "**open", "``": "``",
}
HTML = {
    "": "", "plain words": "plain words", "<p>Sea <b>birds</b></p>": "Sea birds",
    "<p>one</p><p>two</p>": "onetwo", "a<br>b<hr/>c": "abc", "<!-- hush -->loud": "loud",
    "<script>if (a < b) { x('</p>') }</script>calm": "calm",
    "<style>p > a { top: 0 }</style>calm": "calm", "fish &amp; chips &lt;hot&gt;": "fish & chips <hot>",
    "&amp;lt; once": "&lt; once", "&quot;q&quot; &#39;s&#39;": "\"q\" 's'", "a&nbsp;b": "a b",
    # references of every kind
    "caf&eacute; &mdash; it&#8217;s &hellip;": "café — it’s …", "&#x41;&#66;": "AB",
    "&copycat": "©cat", "x &amp y": "x & y", "AT&T &unknown; &": "AT&T &unknown; &",
    # elements that end with their parent, nest, or never end
    "<div><nav>menu</div><p>body</p>": "body", "<nav>a<nav>b</nav>c</nav>d": "d",
    "<aside>x<footer>y</aside>z</footer>w": "zw", "<div><nav>m</div>k</nav>n": "kn",
    "<p>t</p><footer>never closed": "t", "kept<script>lost": "kept", "</nav>stray": "stray",
    "<nav/>after": "after", "<NAV>loud</NAV>quiet": "quiet",
    # quotes in tags, and "<" that begins none
    '<a title="x>y">t</a>': "t", "<a title='p>q' href=\"r\">u</a>": "u", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<!DOCTYPE html><title>Tides</title><body>rise": "Tidesrise",
}


def test_basic(spark):
    assert run(spark, C.basic_clean, list(BASIC)) == list(BASIC.values())
    assert run(spark, C.basic_clean, [None]) == [""]


def test_markdown(spark):
    assert run(spark, C.markdown_clean, list(MARKDOWN)) == list(MARKDOWN.values())
    assert run(spark, C.markdown_clean, [None]) == [""]


@pytest.mark.parametrize("fn", [C.html_clean, C.html_clean_parser])
def test_html(spark, fn):
    got = dict(zip(HTML, run(spark, fn, list(HTML))))
    assert got == HTML


def test_html_native_path_is_exact_where_it_is_taken(spark):
    """Both paths agree on every document that the native path takes, pages included."""
    pages = spark.read.parquet(f"{SF001}/pages.parquet").select(F.col("html").alias("t"))
    odd = one_col(spark, list(HTML)).select("t")
    every = pages.unionByName(odd).filter(C.html_is_easy(F.col("t")))
    both = every.select("t", C.html_text_native(F.col("t")).alias("a"),
                        C.html_text_parser_udf()(F.col("t")).alias("b"))
    # a no-break space is one character on either path, white space in the cleaned text
    bad = both.filter(C.basic_clean(F.col("a")) != C.basic_clean(F.col("b")))
    assert [r.t for r in bad.take(3)] == []
    assert every.join(odd, "t", "left_semi").count() >= 10


def test_pipelines(spark):
    fns, labels, skipped = C.resolve_steps(["html", "spell_check", "MARKDOWN", "whitespace"])
    assert labels == ["html_to_markdown", "markdown_cleanup", "basic_cleanup"]
    assert skipped == ["spell_check"] and len(fns) == 3
    assert C.pipeline_config_name("feed", ["basic"]) == "feed:basic_cleanup"
    assert run(spark, C.pipeline(["html", "markdown", "basic"]),
               ["<p># Not at <b>line</b> start</p>\n- item"]) == ["Not at line start - item"]
    assert run(spark, lambda c: C.preprocess_text(c, "unheard_of"), [" p  q "]) == ["p q"]


def test_extra_cleaners(spark):
    assert run(spark, C.limit_newlines, ["x\n\n\n\n\ny\n\nz"]) == ["x\n\ny\n\nz"]
    assert run(spark, C.remove_punctuation, ["(salt), sea; 5%"]) == ["salt sea 5"]
    assert run(spark, C.lowercase, ["TiDe"]) == ["tide"]
    assert run(spark, C.normalize_whitespace, [" a   b "]) == ["a b"]
