"""Symbol inventories: compressed object lists published beside a documentation site."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from docsift.functions.urls import is_plain, plain_join, resolve

# --- fixed values -----------------------------------------------------------
# Four header lines, then a zlib stream of lines "name domain:role priority uri dispname", parted by white space.
HEADER = b"# Sphinx inventory version 2"
HEADER_LINES = 4
_BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
OBJECT_LINE = (
    rf"^(?P<name>.+?)[{_BLANK}]+(?P<domain>[^:{_BLANK}]+):(?P<role>[^{_BLANK}]+)[{_BLANK}]+-?\p{{Nd}}+"
    rf"[{_BLANK}]+?(?P<uri>[^{_BLANK}]*)[{_BLANK}]+.+?\r?$"
)
# ----------------------------------------------------------------------------

FORMAT = "symbol_inventory"
_CHUNK = 1 << 20
_HELD = 8 << 20  # bytes of parsed objects of one file that are held in memory; the rest waits in a temporary file
_TASK_BYTES = 16 << 20  # compressed bytes of files in one task
_OBJECT = "url string, line_no long, name string, domain string, role string, uri string, odd_target string, intact boolean"
_NAMES = [c.split()[0] for c in _OBJECT.split(", ")]
_KINDS = dict(zip(_NAMES, (pa.string(), pa.int64(), *[pa.string()] * 5, pa.bool_()), strict=True))
_PARSED = pa.schema([(c, _KINDS[c]) for c in _NAMES[1:-1]])
WRITTEN = "file string, line_no long, name string, domain string, role string, uri string"


def read_inventory_files(spark: SparkSession, path: str) -> DataFrame:
    """Inventory files as (url, content), by Spark's own reader, from any store; ``url`` is the file's path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")


def _blocks(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Whole lines of the compressed part, about a chunk at a time; ValueError or zlib.error if the file is unreadable."""
    head, start = read(_CHUNK), 0
    for _ in range(HEADER_LINES):
        start = head.index(b"\n", start) + 1
    if not head.startswith(HEADER):
        raise ValueError("not an inventory")
    body, rest, data = zlib.decompressobj(), b"", head[start:]
    while not body.eof:
        data = data or read(_CHUNK)
        if not data:
            raise ValueError("truncated inventory")
        piece = rest + body.decompress(data, _CHUNK)
        data = body.unconsumed_tail
        end = piece.rfind(b"\n") + 1
        rest = piece[end:]
        if end:
            yield piece[: end - 1]
    if rest:
        yield rest


def _parsed(url: str, read: Callable[[int], bytes], domains: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Object lines; ``odd_target`` is the address where the JVM would not resolve it, empty if it is malformed."""
    base_ok, n = resolve(url, "x") is not None, 0
    plain_base = is_plain(url, "x")
    for block in _blocks(read):
        lines = pc.split_pattern(pa.array([block.decode()], pa.large_string()), "\n").flatten()
        found = pc.extract_regex(lines, OBJECT_LINE)
        place = pa.array(range(n, n + len(lines)), pa.int64())
        n += len(lines)
        good = found.is_valid()
        if domains is not None:
            good = pc.and_(good, pc.is_in(pc.struct_field(found, "domain"), pa.array(sorted(domains), pa.large_string())))
        found, place = found.filter(good), place.filter(good)
        name, domain, role, uri = (pc.struct_field(found, c).cast(pa.string()) for c in ("name", "domain", "role", "uri"))
        odd: list[str | None] = []
        for u, own in zip(uri.to_pylist(), name.to_pylist(), strict=True):
            href = u.replace("$", own)
            odd.append(None if base_ok and plain_base and is_plain(url, href) else resolve(url, href) or "")
        yield pa.RecordBatch.from_arrays([place, name, domain, role, uri, pa.array(odd, pa.string())], schema=_PARSED)


def _file_batches(url: str, read: Callable[[int], bytes], domains: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """The objects of one file, once it has been read to its end; nothing if it cannot be."""
    with tempfile.SpooledTemporaryFile(max_size=_HELD) as held:
        intact = True
        try:
            with pa.ipc.new_stream(held, _PARSED) as out:
                for batch in _parsed(url, read, domains):
                    intact &= not pc.any(pc.equal(batch.column("odd_target"), "")).as_py()
                    out.write_batch(batch)
        except (ValueError, zlib.error):
            return
        held.seek(0)
        for batch in pa.ipc.open_stream(held):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([url] * n, pa.string()), *batch.columns, pa.array([intact] * n)], names=_NAMES)


def _reader_of(content: bytes | None) -> Callable[[int], bytes]:
    view, at = memoryview(content or b""), 0

    def read(size: int) -> bytes:
        nonlocal at
        at += size
        return bytes(view[at - size : at])

    return read


def _resolved(objects: DataFrame) -> DataFrame:
    """Adds ``target``, the address of each object; ``$`` in a uri stands for the object's name."""
    href = F.replace("uri", F.lit("$"), F.col("name"))
    target = F.coalesce(F.nullif("odd_target", F.lit("")), plain_join(F.col("url"), href))
    return objects.withColumn("target", target).drop("odd_target")


def inventory_objects(files: DataFrame, domains: Iterable[str] | None = None) -> DataFrame:
    """(url, line_no, name, domain, role, uri, intact, target) of the objects of inventory files (url, content).

    Only objects of ``domains`` leave the scan, if given. A file that cannot be read whole has no rows, one with a
    malformed address among them is not ``intact``. Both show only at its end: what was parsed waits in memory up to a
    bound, then in the task's temporary folder.
    """
    wanted = None if domains is None else frozenset(domains)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, content in zip(*(batch.column(c).to_pylist() for c in ("url", "content")), strict=True):
                yield from _file_batches(url, _reader_of(content), wanted)

    return _resolved(files.select("url", "content").mapInArrow(read, _OBJECT))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class InventoryReader(DataSourceReader):
    """Tasks of about ``_TASK_BYTES`` of files. Filters on ``domain`` by equality or a list are evaluated while parsing."""

    def __init__(self, path: str):
        self.path = path
        self.domains: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            values = (one.value,) if isinstance(one, EqualTo) else one.value if isinstance(one, In) else None
            if values is None or one.attribute != ("domain",):
                yield one
            else:
                own = frozenset(v for v in values if v is not None)
                self.domains = own if self.domains is None else self.domains & own

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        groups, held = [], 0
        for path, size in files:
            if not groups or held + size > _TASK_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [_Files(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                yield from _file_batches(prefix + path, stream.read, self.domains)


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class InventoryWriter(DataSourceArrowWriter):
    """One inventory for each ``file``; its rows come together and in order (see ``write_inventories``).

    Files are written beside the target and moved there when all tasks are done; what failed tasks wrote is left out.
    """

    def __init__(self, path: str):
        self.path = path
        self.stage = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/{self.stage}")
        done: list[tuple[str, str]] = []
        stream = body = now = None

        def close() -> None:
            if stream is not None:
                stream.write(body.flush())
                stream.close()

        for batch in iterator:
            for file, name, domain, role, uri in zip(*(batch.column(c).to_pylist() for c in ("file", "name", "domain", "role", "uri")), strict=True):
                if file != now:
                    close()
                    now, body = file, zlib.compressobj()
                    done.append((f"{root}/{self.stage}/{uuid.uuid4().hex}", f"{root}/{file}"))
                    stream = system.open_output_stream(done[-1][0])
                    stream.write(HEADER + b"\n# Project: \n# Version: \n# The rest of this file is compressed.\n")
                stream.write(body.compress(f"{name} {domain}:{role} 1 {uri} -\n".encode()))
        close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for part, target in message.paths if message else []:
                system.create_dir(target.rsplit("/", 1)[0])
                system.move(part, target)
        system.delete_dir(f"{root}/{self.stage}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")


class InventorySource(DataSource):
    """``spark.read.format("symbol_inventory").load(path)``: objects of the inventory files below a path or uri."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _OBJECT

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return InventoryWriter(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(InventorySource)
    return spark


def _uri(path: str) -> str:
    """A uri as Arrow's file systems read it."""
    return re.sub("^(file:)?/+", "file:///", path)


def read_inventories(spark: SparkSession, path: str) -> DataFrame:
    """The objects of inventory files, as ``inventory_objects`` gives them; ``url`` is the file's uri.

    Filters on ``domain`` reach the scan. The path is a local or mounted folder, or a uri that Arrow's file systems know;
    for stores that only Spark reads there is ``read_inventory_files``.
    """
    return _resolved(_registered(spark).read.format(FORMAT).load(_uri(path)))


def write_inventories(objects: DataFrame, path: str) -> None:
    """Writes (file, line_no, name, domain, role, uri) as inventory files below a folder, one file in one task."""
    columns = [c.split()[0] for c in WRITTEN.split(", ")]
    dealt = objects.select(*columns).repartition("file").sortWithinPartitions("file", "line_no")
    _registered(objects.sparkSession)
    dealt.write.format(FORMAT).mode("append").save(_uri(path))


def inventory_symbols(objects: DataFrame, inventories: DataFrame) -> DataFrame:
    """Symbols of the sources in ``inventories`` (source, source_ord, inventory_url).

    An inventory with a malformed address contributes nothing.
    """
    return (
        objects.filter("intact")
        .withColumnRenamed("url", "inventory_url")
        .join(inventories, "inventory_url")
        .select(
            "source",
            "source_ord",
            F.col("line_no").alias("pos"),
            F.lit("inventory").alias("kind"),
            F.col("name").alias("group"),
            F.col("target").alias("url"),
            "role",
            "domain",
            F.lit(None).cast("string").alias("origin"),
        )
    )


def inventory_counts(objects: DataFrame) -> DataFrame:
    """(url, total, domains): objects per inventory and a text of the counts per domain."""
    per_domain = objects.groupBy("url", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first")
    )
    entries = F.array_sort(F.collect_list(F.struct("first", "domain", "n")))
    shown = F.transform(entries, lambda e: F.concat(F.lit("'"), e["domain"], F.lit("': "), e["n"]))
    return per_domain.groupBy("url").agg(
        F.sum("n").alias("total"),
        F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("domains"),
    )
