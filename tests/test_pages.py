import pytest

from docsift.functions import html as dom
from docsift.plans.gather import gather_symbols
from docsift.schemas import CRAWL_LOG
from docsift.sources import pages as pg
from test_inventory import packed
from test_registry import make
from workloads import queries

#: text after the name of an entry, and the domain and role that it stands for (None: no entry)
KINDS = [(" (C++ function)", "cpp", "function"), (" (C type)", "c", "type"), ("<b>x</b> (C++ class)", None, None), (" (C++ enumerator)", "cpp", "enumerator"),
         ("", None, None), (" (Rust fn)", "rust", "fn"), (" (C++ some attribute)", None, None)]


def index_page():
    """An index page with an item of each kind, some with a list inside, and the rows it should give; lists outside of its table."""
    html, wanted, n = [], [], 0

    def item(kind, domain, role):
        nonlocal n
        n += 1
        if domain is not None:
            wanted.append((f"e{n}", f"http://h/d/p{n}.html#e{n}", role, domain, "genindex"))
        return f'<li><a name="n{n}">no</a><a href="p{n}.html#e{n}"> e{n}{kind}</a><a href="late">late (C type)</a>'

    for i, own in enumerate(KINDS):
        outer = item(*own)
        inner = f"<ul><li>none</li>{item(*own)}</li></ul>" if i % 2 else ""
        html.append(outer + inner + "</li>")
    outside = '<ul><li><a href="o.html">out (C type)</a></li></ul>'
    return f'{outside}<table class="x indextable"><tr><td><ul>{"".join(html)}</ul></td></tr></table><table><tr><td>{outside}</td></tr></table>', wanted


INDEX, ENTRIES = index_page()

#: heading of a section, its class, and the role of its members (None: no heading of members, so the role stays)
SECTIONS = [
    ("Functions", "fake_title member_header", "function"),
    (" Typedefs ", "member_header", "type"),
    ("Enumerations", "member_header", "enum"),
    ("Variables", "other", None),
    ("Defines", "member_header", "macro"),
    ("Variables", "member_header", "data"),
]


def group_page():
    """A page with three members in each section, and the rows it should give; links that are no members between."""
    html, wanted, role = ['<a href="#group__G_1gz">lead</a>'], [("lead", "1gz", "")], ""
    for n, (title, css, own) in enumerate(SECTIONS):
        role = role if own is None else own
        html.append(f'<h3 class="{css}">{title}</h3><a href="#other">no</a><a href="x#group__G_1g{n}x">no</a>')
        html.append(f'<dl><dt><span><a href="#group__G_1g{n}a">k{n}</a> ( int*\n   p{n} )</span></dt></dl>')
        html.append(f'<table><tr><td>ret</td><td><a href="#group__G_1g{n}b">v{n}</a> (x)</td></tr></table>')
        html.append(f'<dl><dt><table><tr><td><a href="#group__G_1g{n}c">w{n}</a></td></tr></table> tail</dt></dl>')
        html.append(f'<a href="#group__G_1g{n}a">again</a><a href="#group__G_1g{n}e"> </a>')
        wanted += [(f"k{n} ( int* p{n} )", f"1g{n}a", role), (f"v{n} (x)", f"1g{n}b", role), (f"w{n} tail", f"1g{n}c", role)]
    return "<html><body>" + "\n".join(html) + "</body></html>", wanted


GROUP, MEMBERS = group_page()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [("http://h/d/genindex.html", INDEX), ("http://h/g/group__G.html", GROUP), ("http://h/none", None)],
        "url string, html string",
    )


def test_index_entries(spark, pages):
    wanted = spark.createDataFrame([("s", 0, "http://h/d/genindex.html"), ("n", 1, "http://h/none")], "source string, source_ord int, index_page_url string")
    rows = pg.index_symbols(pg.scan_pages(wanted, pages, "index_page_url")).orderBy("pos").collect()
    assert [(r["group"], r["url"], r["role"], r["domain"], r["origin"]) for r in rows] == ENTRIES and len(ENTRIES) == 7


def test_members(spark, pages):
    schema = "source string, source_ord int, page_ord int, page_url string, default_domain string, cpp_groups array<string>"
    wanted = spark.createDataFrame([("s", 0, 3, "http://h/g/group__G.html", "c", ["HIGH"])], schema)
    rows = pg.member_symbols(pg.scan_pages(wanted, pages, "page_url")).orderBy("pos").collect()
    at = "http://h/g/group__G.html#group__G_"
    assert [(r["group"], r["url"].removeprefix(at), r["role"], r["domain"]) for r in rows] == [(name, mark, role, "c") for name, mark, role in MEMBERS]


def test_group_links(spark):
    html = """<a href="modules.html#group__x">m</a><a href="group__A.html#one"> A <i>x</i></a><a href="./group__A.html#two">A2</a>
    <a>group__</a><a href="group__B.html">B</a><!-- <a href="group__C.html">C</a> --><a href="http://[bad/modules_group__">D</a>"""
    schema = "source string, source_ord int, index_url string, html string"
    rows = [("s", 0, "http://h/d/modules.html", html), ("t", 1, "http://h/t.html", html.replace("modules_", ""))]
    index = spark.createDataFrame(rows, schema)
    found = pg.group_links(index).orderBy("source", "pos").collect()
    assert [(r["source"], r["pos"], r["group"], r["url"]) for r in found] == [
        ("s", 1, "Ax", "http://h/d/group__A.html#one"),
        ("s", 3, "B", "http://h/d/group__B.html"),
    ]
    assert [r["source"] for r in pg.broken_indexes(index).collect()] == ["t"]
    counted = pg.group_link_count(index.selectExpr("index_url AS url", "html")).collect()
    assert {r["n_links"] for r in counted} == {5}


def test_gather_and_status(spark):
    sources = make(
        spark,
        dict(name="inv", doc_type="sphinx", base_urls=["http://i/"]),
        dict(name="dox", doc_type="doxygen", index_url="http://h/g/modules.html", default_domain="c"),
        dict(name="gen", doc_type="sphinx_noinv", index_url="http://h/d//"),
        dict(name="bad", doc_type="doxygen", index_url="http://h/bad.html"),
        dict(name="pdf", doc_type="pdf", doc_url="http://h/m.pdf"),
    )
    crawl = spark.createDataFrame(
        [("http://i/", 200, "http://i/x/", None, None, None), ("http://i/x/objects.inv", 200, "http://i/x/objects.inv", None, None, None)],
        CRAWL_LOG,
    )
    files = spark.createDataFrame([("http://i/x/objects.inv", packed(["one c:function 1 o.html#$ -"]))], "url string, content binary")
    pages = spark.createDataFrame(
        [
            ("http://h/g/modules.html", '<a href="group__G.html#f">G</a><a href="group__gone.html">gone</a>'),
            ("http://h/g/group__G.html", GROUP),
            ("http://h/d/genindex.html", INDEX),
            ("http://h/bad.html", '<a href="group__ok.html">ok</a><a href="http://[bad/group__D">D</a>'),
        ],
        "url string, html string",
    )
    catalog = gather_symbols(sources, crawl, files, pages)
    rows = catalog.symbols.orderBy("source_ord", "pos").collect()
    assert [r["source"] for r in rows] == ["inv"] + ["dox"] * (2 + len(MEMBERS)) + ["gen"] * len(ENTRIES)
    dox = [(r["kind"], r["group"]) for r in rows if r["source"] == "dox"]
    assert dox[:3] == [("group", "G"), ("group", "gone"), ("member", "lead")]
    assert (rows[1]["role"], rows[1]["domain"]) == (None, None)
    status = {r["source"]: r["skipped_reason"] for r in catalog.status.collect()}
    assert status == {"inv": None, "dox": None, "gen": None, "bad": "fetch error", "pdf": "pdf"}


@pytest.mark.parametrize(
    "markup, shown",
    [
        ("a &amp; b &lt;x&gt; &unknown; &#169;&#x41;&#150;", "a & b <x> &unknown ©A–"),
        ("<p>a</b>c</p>", "ac"),
        ("<div>1<br>2</br>3<img src=x>4</div>", "1234"),
        ("<script>var a='</p>';</script>t", "t"),
        ("<![CDATA[x]]>y", "xy"),
    ],
)
def test_parser_text(markup, shown):
    assert dom.parse(markup).text() == shown


def test_deep_nesting():
    depth = 30_000
    root = dom.parse("<div>" * depth + "x")
    assert dom.brace_tree(root) == "x" and root.text() == "x"
    dom.clean(root)


def test_a_page_is_parsed_once(spark, pages):
    index = pages.selectExpr("'s' AS source", "0 AS source_ord", "url AS index_url", "url AS index_page_url", "html")
    for df in (pg.group_links(index), pg.index_symbols(index), pg.anchors(pages)):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("max_bytes", [None, 0])
def test_an_address_with_several_pages(spark, max_bytes):
    """No wanted row is multiplied, and one that names a page gets that page."""
    rows = [(1, "u", "longer"), (2, "u", "body"), (3, "u", None), (4, "v", "v"), (5, "u", "body"), (6, "x", "x")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    wanted = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u"), (4, "v"), (7, "w"), (8, None)], "page_id int, url string")
    named = pg.scan_pages(wanted, pages, max_bytes=max_bytes, version="page_id")
    assert sorted((r["page_id"], r["html"]) for r in named.collect()) == [(1, "longer"), (2, "body"), (4, "v")]
    least = pg.scan_pages(wanted, pages, max_bytes=max_bytes)
    assert sorted((r["page_id"], r["html"]) for r in least.collect()) == [(1, "body"), (2, "body"), (3, "body"), (4, "v")]


@pytest.mark.parametrize("name", ["page_scan", "page_scan_many"])
def test_page_scan_of_addresses_fetched_twice(spark, tmp_path, name):
    """Rows 2 apart or 3 apart share an address, so that fetched, failed and unwanted pages meet under one."""
    rows = [(i, f"http://h/{i // 6}/{i % (2 + i // 24)}", "x" * (i + 1)) for i in range(48)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r["page_id"], r["size"]) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
    kept = [i for i in range(48) if i % 6 and (i % 4 if name == "page_scan" else i % 4 == 2)]
    assert sorted(got) == [(i, i + 1) for i in kept]
