import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.html import html_to_text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalize_takes_unicode_white_space(spark):
    assert one(spark, "  a\r\nb\rc  \n", tx.normalize) == "a\nb\nc"
    assert one(spark, "", tx.normalize) == ""


def test_blank_runs_and_lines(spark):
    assert one(spark, "a\n\n\n\nb\n\nc", tx.collapse_blank_runs) == "a\n\nb\n\nc"
    assert one(spark, " a \n\t b", tx.strip_lines) == "a\nb"
    assert one(spark, " a \n\t b c ", tx.squeeze) == "a b c"


@pytest.mark.parametrize(("path", "doc"), [("a/b.html", "a/b"), ("a.b/c", "a.b/c"), ("x.tar.gz", "x.tar"), (".hidden", ".hidden")])
def test_doc_id(spark, path, doc):
    assert one(spark, path, tx.doc_id_from_path) == doc


def test_doc_id_refuses_number_sign(spark):
    with pytest.raises(Exception, match="'#' in path"):
        one(spark, "a#b.txt", tx.doc_id_from_path)


def test_citations_keep_first_order(spark):
    assert one(spark, "x [b#c2] [a/d#c0][b#c2] [a #c1] [#c1]", tx.citations) == ["b#c2", "a/d#c0"]


def test_abstained(spark):
    assert one(spark, f"\n {tx.ABSTAIN_PREFIX}: sorry", tx.abstained)
    assert not one(spark, f"Well, {tx.ABSTAIN_PREFIX}", tx.abstained)


def test_first_match_counts_code_points(spark):
    t = "😀" * 100 + " NoWait  here " + "x" * 100
    assert one(spark, t, lambda c: tx.first_match(c, "nowait", 5)) == "😀😀😀😀 NoWait her"


def test_invalid_utf8(spark):
    got = spark.createDataFrame([(bytearray(b"a\xffb"),)], "t binary").select(tx.utf8(F.col("t"))).first()[0]
    assert got == "a�b"


def test_html_drops_chrome_and_keeps_inline():
    html = (
        "<html><head><title>t</title><style>x{}</style></head><body><div class='navheader'><table><tr><td>Prev<br></td></tr></table></div>"
        "<h1>LOCK<a class='id_link' href='#x'>#</a></h1><p>Use <code>NOWAIT</code>&nbsp;<em>now</em>.</p><script>var a='<p>';</script>"
        "<pre>  a\n   b</pre><ul><li>one<li>two</ul><div class=\"navfooter\">Next</div></body></html>"
    )
    assert html_to_text(html) == "LOCK\n\nUse NOWAIT now.\n\na\nb\n\none\ntwo"


@pytest.mark.parametrize("html", ["", "<", "</p></p>", "<p", "<div><p>x</div>y", "<script>a", None])
def test_html_never_fails(html):
    html_to_text(html)
