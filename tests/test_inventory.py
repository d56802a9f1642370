import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docsift.sources import inventory

HEAD = b"# Sphinx inventory version 2\n# Project: x\n# Version: 1\n# zlib below\n"
LINES = [
    "mem_copy cpp:function 1 api.html#$ -",
    "two words here std:label -1 guide.html#two Two words",
    "ns::thing cpp:class 1 ns.html#a$b$ thing",
    "odd py:module 0  -",
    "not an object line",
    "crlf c:macro 1 m.html -\r",
]


def packed(lines):
    return HEAD + zlib.compress("\n".join(lines).encode() + b"\n")


def write(folder, name, data):
    (folder / name).write_bytes(data)


def test_read_files(spark, tmp_path):
    write(tmp_path, "a.inv", packed(LINES))
    write(tmp_path, "cut.inv", packed(LINES)[:-9])
    write(tmp_path, "plain.inv", b"hello")
    write(tmp_path, "old.inv", packed(LINES).replace(b"version 2", b"version 1"))
    write(tmp_path, "latin.inv", HEAD + zlib.compress("naïve py:data 1 x -\n".encode("latin-1")))
    files = inventory.read_inventory_files(spark, str(tmp_path))
    rows = inventory.inventory_objects(files).orderBy("line_no").collect()
    assert {r["url"].rsplit("/", 1)[1] for r in rows} == {"a.inv"}
    assert [(r["line_no"], r["name"], r["domain"], r["role"], r["uri"]) for r in rows] == [
        (0, "mem_copy", "cpp", "function", "api.html#$"),
        (1, "two words here", "std", "label", "guide.html#two"),
        (2, "ns::thing", "cpp", "class", "ns.html#a$b$"),
        (3, "odd", "py", "module", ""),
        (5, "crlf", "c", "macro", "m.html"),
    ]


def test_symbols(spark, tmp_path):
    write(tmp_path, "a.inv", packed(LINES[:3]))
    files = inventory.read_inventory_files(spark, str(tmp_path)).selectExpr("'http://h/d/objects.inv' AS url", "content")
    bad = spark.createDataFrame([("http://h/bad.inv", packed(["a c:x 1 http://[oops -", "b c:x 1 fine.html -"]))], files.schema)
    located = spark.createDataFrame(
        [("lib", 4, "http://h/d/objects.inv"), ("alias", 5, "http://h/d/objects.inv"), ("broken", 6, "http://h/bad.inv")],
        "source string, source_ord int, inventory_url string",
    )
    objects = inventory.inventory_objects(files.union(bad))
    rows = inventory.inventory_symbols(objects, located).orderBy("source", "pos").collect()
    assert [(r["source"], r["group"], r["url"]) for r in rows if r["source"] == "lib"] == [
        ("lib", "mem_copy", "http://h/d/api.html#mem_copy"),
        ("lib", "two words here", "http://h/d/guide.html#two"),
        ("lib", "ns::thing", "http://h/d/ns.html#ans::thingbns::thing"),
    ]
    assert {r["source"] for r in rows} == {"lib", "alias"}
    counts = {r["url"]: (r["total"], r["domains"]) for r in inventory.inventory_counts(objects).collect()}
    assert counts["http://h/d/objects.inv"] == (3, "{'cpp': 2, 'std': 1}")


@pytest.mark.parametrize("size", [1, 20_000, 45_001])
def test_long_inventory_comes_in_batches(spark, size, tmp_path):
    write(tmp_path, "a.inv", packed([f"n{i} c:function 1 f{i}.html -" for i in range(size)]))
    files = inventory.read_inventory_files(spark, str(tmp_path))
    rows = inventory.inventory_objects(files).orderBy("line_no").collect()
    assert [(r["line_no"], r["name"]) for r in rows] == [(i, f"n{i}") for i in range(size)]


def test_domains_inside_the_scan(spark, tmp_path):
    write(tmp_path, "a.inv", packed(LINES))
    files = inventory.read_inventory_files(spark, str(tmp_path))
    rows = inventory.inventory_objects(files, ["cpp", "c"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["domain"]) for r in rows] == [(0, "cpp"), (2, "cpp"), (5, "c")]


def test_data_source_pushes_the_domain(spark, tmp_path):
    write(tmp_path, "a.inv", packed(LINES))
    write(tmp_path, "cut.inv", packed(LINES)[:-9])
    write(tmp_path, "plain.inv", b"hello")
    write(tmp_path, "latin.inv", HEAD + zlib.compress("na\xefve py:data 1 x -\n".encode("latin-1")))
    everything = inventory.read_inventories(spark, str(tmp_path))
    assert [r["line_no"] for r in everything.orderBy("line_no").collect()] == [0, 1, 2, 3, 5]
    some = everything.filter(F.col("domain").isin("cpp", "c")).filter("domain != 'py'")
    plan = some._jdf.queryExecution().explainString(some.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(domain, [c,cpp])]" in plan
    assert "domain#" not in plan.split("Condition :")[1].split("\n")[0].replace("NOT (domain", "").replace("isnotnull(domain", "")
    assert sorted((r["name"], r["domain"]) for r in some.collect()) == [("crlf", "c"), ("mem_copy", "cpp"), ("ns::thing", "cpp")]


def test_written_files_read_back(spark, tmp_path):
    rows = [(f"s{i % 3}/objects.inv", i, f"name {i}", ("cpp", "py")[i % 2], "function", f"a{i}.html#$") for i in range(3000)]
    objects = spark.createDataFrame(rows, inventory.WRITTEN).repartition(7)
    inventory.write_inventories(objects, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s0", "s1", "s2"]
    read = inventory.read_inventories(spark, f"file:{tmp_path}/out").collect()
    name = lambda url: "/".join(url.rsplit("/", 2)[1:])
    got = [(name(r["url"]), r["name"], r["domain"], r["role"], r["uri"]) for r in read]
    assert sorted(got) == sorted((f, n, d, r, u) for f, _, n, d, r, u in rows)
    places = {}
    for r in sorted(read, key=lambda r: r["line_no"]):
        places.setdefault(name(r["url"]), []).append(int(r["name"].split()[1]))
    assert all(own == sorted(own) for own in places.values())


def test_object_lines_as_a_plain_pattern_reads_them(spark, tmp_path):
    plain = re.compile(r"^(.+?)\s+([^\s:]+):(\S+)\s+(-?\d+)\s+?(\S*)\s+(.+?)\r?$")
    draw = random.Random(3)
    parts = ["name", "a:b", "c:d", ":", " ", "  ", "\t", "1", "-2", "-", "x.html", "\u00a0", "\u2003", "\u0661", "\x1c", "\r", "\x0b", "é"]
    lines = ["".join(draw.choices(parts, k=draw.randint(4, 14))) for _ in range(4000)]
    lines += [f"{n} py:f {p} {u} {d}" for n in ("a", "a b", "é") for p in ("1", "-1", "\u0662") for u in ("u", "") for d in ("-", "d e", "d\r")]
    write(tmp_path, "a.inv", HEAD + zlib.compress("\n".join(lines).encode()))
    wanted = [(i, *m.group(1, 2, 3, 5)) for i, line in enumerate(lines) if (m := plain.match(line))]
    rows = inventory.read_inventories(spark, str(tmp_path)).collect()
    assert sorted((r["line_no"], r["name"], r["domain"], r["role"], r["uri"]) for r in rows) == wanted and len(wanted) > 100


def test_a_large_file_waits_outside_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "_HELD", 1000)
    data = packed([f"n{i} c:function 1 f{i}.html -" for i in range(50_000)])
    batches = list(inventory._file_batches("http://h/a", inventory._reader_of(data), None))
    assert sum(b.num_rows for b in batches) == 50_000 and len(batches) > 1
