import pytest

from docsift.operators.texttree import with_text_tree
from pyspark.sql import functions as F

GOLDEN = [
    ("<div><p>one</p></div><div><p>two</p></div>", "{\none\ntwo\n}"),
    ("<div>Lead <b>x</b> tail<p>y</p></div>", "Lead tail {\nx\ny\n}"),
    ("<!DOCTYPE html><div><h2>T</h2><p>Body</p></div>", "html {\n{\nT\nBody\n}\n}"),
    ("<div><!-- ad 0 --><p>y</p></div>", "ad 0 {\ny\n}"),
    ("<p><b>x<br><p>y</p><p>z</p>", "x y z"),
    ('<div><pre>a\n  b</pre><p style="display: none">h</p></div>', "a\nb"),
    ("<div>#<p>a &amp; b</p></div>", "a & b"),
    ("<p>a</b>c</p>", "a c"),
    ("<div><svg>v</svg><p>a<!--c--></p><em>.</em></div>", "a c"),
    ("<div><p STYLE='color:red; display:none'>h</p><p style='DISPLAY:none'>v</p></div>", "v"),
    ("<a>x <i>y</i><!-- no --></a>", "x y"),
]


def listed(n, words):
    """A container of n paragraphs and what it renders to."""
    shown = words[:n]
    html = "<div>" + "".join(f"<p>{w}</p>" for w in shown) + "<script>no</script></div>"
    return html, "\n".join(["{", *shown, "}"]) if n > 1 else "".join(shown)


GOLDEN += [listed(n, ["k0 l", "m1", "n2 o p", "q3"]) for n in range(5)]


def trees(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, html string, section string, main_only boolean")
    out = with_text_tree(df, section=F.col("section"), main_only=F.col("main_only"))
    return [(r["text_tree"], r["status"]) for r in out.orderBy("i").collect()]


def test_golden(spark):
    got = trees(spark, [(html, None, False) for html, _ in GOLDEN])
    assert got == [(tree, "ok") for _, tree in GOLDEN]


def test_missing_page(spark):
    assert trees(spark, [(None, None, False), ("", None, False)]) == [(None, "no content")] * 2


SECTIONS = """<div><h1>Top</h1><section id="api"><h2>API Reference</h2><p>Details</p></section>
<dl id="list"><dt id="term">T</dt><dd>D</dd></dl><h3 id="alone">Memory <b>Use</b></h3></div><h4>Orphan</h4>"""


@pytest.mark.parametrize(
    "section, tree",
    [
        ("term", "{\nT\nD\n}"),  # nearest block around the element
        ("API", "{\nAPI Reference\nDetails\n}"),  # ids are case-sensitive, headings are not
        ("api reference", "{\nAPI Reference\nDetails\n}"),
        ("orphan", "Orphan"),
        ("nothing", None),
    ],
)
def test_section(spark, section, tree):
    assert trees(spark, [(SECTIONS, section, False)]) == [(tree, "ok" if tree else "section not found")]


def test_section_by_id_and_by_heading_text(spark):
    whole = trees(spark, [("<div>" + SECTIONS.split("<div>")[1].split("</div>")[0] + "</div>", None, False)])[0][0]
    assert trees(spark, [(SECTIONS, "api", False), (SECTIONS, "memory use", False)]) == [(whole, "ok")] * 2


def test_main_content(spark):
    page = "<p>out</p><div class='x main-content'>by class</div><div id='main-content'>by id</div>"
    rows = [(page + "<main>by tag</main>", None, True), (page, None, True), (page.replace("id=", "k="), None, True), ("<p>all</p>", None, True)]
    assert [t for t, _ in trees(spark, rows)] == ["by tag", "by id", "by class", "all"]
    assert trees(spark, [("<main><h2>In</h2></main><h2 id='o'>Out</h2>", "out", True)]) == [(None, "section not found")]
