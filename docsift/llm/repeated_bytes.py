"""Removal of repeated byte strings by suffix arrays (operator 3).

A string of ``LENGTH`` (200) bytes of one document is repeated if the same bytes also start anywhere else, in the same
document too; every byte that a repeated string covers is removed. Strings are judged on the input.

1. Anchors. Of the 32-byte grams in a string, the one with the least hash is its anchor (the first of equal ones). That
   depends on the string alone, so equal strings have equal anchors at the same distance. Neighbouring strings with one
   anchor form a run, about 85 long; the exchange of ``exchange.py`` finds the anchors that occur more than once.
2. Suffix arrays. The runs of such anchors are collected as byte segments; equal segments are counted and sent once.
   Segments with the same anchor meet. Where they differ, each is trimmed to what it can share with another, and a
   suffix array over the parts (``suffix_array.py``: linear grouping by Lyndon prefixes) puts equal strings next to each
   other; bytes are compared. One string occurs as often as the segments that hold it are counted.
3. The strings found go back to the places of their segments, and the bytes that they cover are cut out.

Segments of one anchor lie in one task. So the strings of an anchor with more than ``CROWD`` occurrences are not
gathered as segments: they are counted one by one, by 128-bit digests, in the packed exchange over all tasks.

Results for odd input: a null or short text has nothing removed; rows with a null ``doc_id`` are returned unchanged and
repeat nothing; equal rows count as repeats of each other; of an id with different texts one takes part, and the other rows
are returned unchanged. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.exchange import PACKED, bucket_of, exchange, keyed, known_rows, one_text_each, packed_batches, print_of
from docsift.llm.storage import cut
from docsift.llm.suffix_array import suffix_array
from docsift.llm.words import Hasher, Rolling, Texts, covered, digests, mix, runs_of, signed, slices

LENGTH = 200
GRAM = 32
FEW = 100_000  # crowded anchors that are broadcast (8 bytes each); more are joined by a shuffle
CHUNK = 1 << 17  # bytes of segments under one suffix array
CROWD = 8192  # occurrences of an anchor beyond which its strings are counted one by one
ANCHOR_BYTES = 5
COUNT_BITS = 16
_A, _B = Hasher(0), Hasher(1)
_U64 = np.uint64


class Runs:
    """The runs of strings with one anchor, in all texts of a slice."""

    def __init__(self, texts: Texts, length: int = LENGTH, gram: int = GRAM):
        n = len(texts.data)
        first = np.arange(max(0, n - gram + 1))
        grams = Rolling.windows(texts.data, first, gram) if len(first) else np.zeros(0, _U64)
        least = (grams >> _U64(32) << _U64(32)) | first.astype(_U64)
        wide, span = length - gram + 1, 1  # minimum over `wide` grams, by doubling
        while span * 2 <= wide and len(least) > span:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: -(wide - span)], least[wide - span :]) if len(least) > wide - span else least[:0]
        sizes = np.diff(texts.offsets)
        room = np.maximum(0, sizes - length + 1)
        starts = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(texts.offsets[:-1], room)
        doc = np.repeat(np.arange(texts.n), room)
        anchor = (least[starts] & _U64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        self.start = starts[heads]
        self.count = np.diff(np.append(heads, len(starts)))
        self.anchor = anchor[heads]
        self.doc = doc[heads]
        self.place = self.anchor - texts.offsets[self.doc]
        self.print = grams[self.anchor]


def shared_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """For each document, the places and prints of its anchors that occur more than once."""
    buckets = 2 * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Runs(Texts(batch.column("text")))
            if not len(found.doc):
                continue
            ids = batch.column("doc_id").to_numpy()
            order, heads = runs_of([found.print])
            sizes = np.diff(np.append(heads, len(order)))
            several = order[np.repeat(sizes > 1, sizes)]
            marks = print_of(found.print[several], buckets, ANCHOR_BYTES)
            yield from known_rows(ids, found.doc[several], found.place[several], buckets, marks)
            entries = np.sort(order[heads])
            prints = found.print[entries]
            flags = np.zeros(len(entries), bool)
            yield from packed_batches(
                ids, found.doc[entries], found.place[entries], [prints], bucket_of(prints, buckets), ANCHOR_BYTES, flags
            )

    def decide(hashes: list[np.ndarray], ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
        order, heads = runs_of(hashes)
        sizes = np.diff(np.append(heads, len(order)))
        out = np.zeros(len(order), bool)
        out[order] = np.repeat(sizes > 1, sizes)
        return out

    found = exchange(docs.mapInArrow(run, PACKED), parts, ANCHOR_BYTES, 1, decide, prints=True)
    each = found.select("doc_id", F.explode(F.arrays_zip("places", "prints")).alias("x"))
    return each.select("doc_id", F.col("x.places").alias("place"), F.col("x.prints").alias("print"))


def _wanted_runs(batch: pa.RecordBatch) -> tuple[Texts, Runs, np.ndarray]:
    """The texts of a slice, their runs, and which of these have an anchor in ``places``."""
    texts = Texts(batch.column("text"))
    runs = Runs(texts)
    places = batch.column("places")
    per = np.diff(places.offsets.to_numpy())
    wanted = places.flatten().to_numpy() + np.repeat(texts.offsets[:-1], per)
    return texts, runs, np.flatnonzero(np.isin(runs.anchor, wanted))


def _segments(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows of the anchors: ``print``, ``digest`` of the segment, ``doc_id``, ``start`` (byte), and, once a slice for
    equal segments, the segment's ``bytes``, the anchor's place in them (``lead``) and ``copies`` in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, runs, own = _wanted_runs(batch)
            if not len(own):
                continue
            start, end = runs.start[own], runs.start[own] + runs.count[own] + LENGTH - 1
            lead = runs.anchor[own] - start
            digest = mix(digests(texts.data, start, end)[:, 0] + lead.astype(_U64))
            order, heads = runs_of([runs.print[own], digest])
            copies = np.zeros(len(own), np.int64)
            copies[order[heads]] = np.diff(np.append(heads, len(order)))
            data = texts.data
            segments = [data[s:e].tobytes() if c else None for s, e, c in zip(start, end, copies, strict=True)]
            doc = runs.doc[own]
            columns = [
                pa.array(signed(runs.print[own])),
                pa.array(signed(digest)),
                batch.column("doc_id").take(pa.array(doc)),
                pa.array(start - texts.offsets[doc]),
                pa.array(segments, pa.binary()),
                pa.array(lead),
                pa.array(copies),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["print", "digest", "doc_id", "start", "bytes", "lead", "copies"])

    schema = "print long, digest long, doc_id long, start long, bytes binary, lead long, copies long"
    return docs.join(anchors, "doc_id").mapInArrow(run, schema)


def equal_strings(segments: list[bytes], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the places of its strings that occur more than once in all of them, counting copies."""
    values = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + 2, 1) for s in segments])
    sizes = np.array([len(s) for s in segments])
    bounds = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    order = np.array(suffix_array([*values.tolist(), 0])[1:])
    room = bounds[owner[order]] - 1 - order
    order = order[room >= length]  # suffixes that begin with a whole string; equal strings stay neighbours
    same = np.zeros(max(0, len(order) - 1), bool)
    for low in range(0, len(same), 4096):
        a, b = order[low : low + 4096][: len(same) - low], order[low + 1 : low + 4097]
        span = np.arange(length)
        same[low : low + len(b)] = (values[a[:, None] + span] == values[b[:, None] + span]).all(axis=1)
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    total = np.bincount(group, np.asarray(copies)[owner[order]])[group] if len(order) else np.zeros(0)
    repeated = np.sort(order[total > 1])
    cuts = np.searchsorted(repeated, bounds)
    begin = bounds - sizes - 1
    return [part - b for part, b in zip(np.split(repeated, cuts[:-1]), begin, strict=True)]


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common at their beginning."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def trimmed(group: list[tuple[bytes, int, int]]) -> list[tuple[int, int, int]]:
    """For each different segment (bytes, lead, copies) of an anchor: which part (begin, end) may hold strings that others
    have too, and whether all its strings are repeated since it has copies.

    In order of what follows the anchor, and of what precedes it backwards, the neighbours of a segment are those that
    agree with it the longest; no string can reach beyond that.
    """
    after = [s[lead:] for s, lead, _ in group]
    before = [s[:lead][::-1] for s, lead, _ in group]
    reach = []
    for parts in (before, after):
        order = sorted(range(len(parts)), key=parts.__getitem__)
        most = [0] * len(parts)
        for i, j in zip(order, order[1:], strict=False):
            common = _common(parts[i], parts[j])
            most[i], most[j] = max(most[i], common), max(most[j], common)
        reach.append(most)
    return [(lead - b, lead + a, copies) for (_, lead, copies), b, a in zip(group, *reach, strict=True)]


def _solve(segments: DataFrame, parts: int) -> DataFrame:
    """``print``, ``digest`` and the runs of strings of that segment that occur more than once (place << 16 | number)."""

    def solve(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        """Whole groups of (print, digest, bytes, lead, copies) with one anchor each."""
        out: list[tuple[int, int, np.ndarray]] = []
        strings: list[bytes] = []
        counts: list[int] = []
        members: list[list[tuple[int, int, int]]] = []
        for group in groups:
            whole = [(p, d, np.array([len(s) - LENGTH + 1])) for p, d, s, _, c in group if c > 1]
            out += whole
            if len(group) == 1:
                continue
            same: dict[bytes, int] = {}
            for (p, d, s, _, _), (begin, end, c) in zip(group, trimmed([g[2:] for g in group]), strict=True):
                if end - begin < LENGTH:
                    continue
                part = s[begin:end]
                at = same.setdefault(part, len(strings))
                if at == len(strings):
                    strings.append(part)
                    counts.append(0)
                    members.append([])
                counts[at] += c
                if c == 1:
                    members[at].append((p, d, begin))
        if strings:
            for places, own in zip(equal_strings(strings, counts), members, strict=True):
                heads = np.flatnonzero(np.diff(places, prepend=-2) != 1)
                if len(heads):
                    number = np.diff(np.append(heads, len(places)))
                    out += [(p, d, (places[heads] + begin) << COUNT_BITS | number) for p, d, begin in own]
        if out:
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())]
            lists = pa.array([x[2] for x in out], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["print", "digest", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("print", "digest", "bytes", "lead", "copies")), strict=True):
                if not groups or groups[-1][0][0] != row[0]:
                    if held >= CHUNK:
                        yield from solve(groups)
                        groups, held = [], 0
                    groups.append([])
                group = groups[-1]
                if group and group[-1][1] == row[1]:
                    group[-1] = (*row[:4], group[-1][4] + row[4])
                else:
                    group.append(row)
                    held += len(row[2])
        if groups:
            yield from solve(groups)

    own = segments.filter("bytes is not null").select("print", "digest", "bytes", "lead", "copies")
    dealt = own.repartition(parts, "print").sortWithinPartitions("print", "digest")
    return dealt.mapInArrow(run, "print long, digest long, places array<long>")


def _single_strings(docs: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    """The repeated strings of crowded anchors: ``doc_id`` and runs as in ``_solve``, by 128-bit digests of each string."""
    buckets = 2 * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, runs, own = _wanted_runs(batch)
            if not len(own):
                continue
            count = runs.count[own]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(runs.start[own], count)
            doc = np.repeat(runs.doc[own], count)
            ids = batch.column("doc_id").to_numpy()
            hashes = [h.ranges(texts.byte_prefix(h), at, at + LENGTH) for h in (_A, _B)]
            order, heads = runs_of(hashes)
            sizes = np.diff(np.append(heads, len(order)))
            several = order[np.repeat(sizes > 1, sizes)]
            place = at - texts.offsets[doc]
            yield from known_rows(ids, doc[several], place[several], buckets)
            entries = np.sort(order[heads])
            flags = np.zeros(len(entries), bool)
            sent = [h[entries] for h in hashes]
            yield from packed_batches(ids, doc[entries], place[entries], sent, bucket_of(sent[0], buckets), 8, flags)

    def decide(hashes: list[np.ndarray], ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
        order, heads = runs_of(hashes)
        sizes = np.diff(np.append(heads, len(order)))
        out = np.zeros(len(order), bool)
        out[order] = np.repeat(sizes > 1, sizes)
        return out

    found = exchange(docs.join(anchors, "doc_id").mapInArrow(run, PACKED), parts, 8, 2, decide)
    return found.select("doc_id", F.expr(f"transform(places, p -> shiftleft(p, {COUNT_BITS}) + 1)").alias("places"))


def repeated_strings(docs: DataFrame, parts: int, crowd: int = CROWD) -> DataFrame:
    """``doc_id`` and where runs of repeated strings start: byte place << 16 | number of strings."""
    anchors = cut(shared_anchors(docs, parts))
    crowded = anchors.groupBy("print").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("print")
    crowded = cut(crowded).withColumn("crowded", F.lit(True))
    marked = anchors.join(F.broadcast(crowded) if crowded.count() <= FEW else crowded, "print", "left")
    by_doc = marked.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("crowded").isNull(), F.col("place"))).alias("few"),
        F.collect_list(F.when(F.col("crowded"), F.col("place"))).alias("many"),
    )
    by_doc = cut(by_doc)
    rows = _segments(docs, by_doc.filter("size(few) > 0").select("doc_id", F.col("few").alias("places")))
    found = rows.select("print", "digest", "doc_id", "start").join(_solve(rows, parts), ["print", "digest"])
    moved = F.expr(f"transform(places, p -> p + shiftleft(start, {COUNT_BITS}))").alias("places")
    single = _single_strings(docs, by_doc.filter("size(many) > 0").select("doc_id", F.col("many").alias("places")), parts)
    each = found.select("doc_id", moved).union(single)
    return each.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the remaining bytes)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = keyed(docs)
    named, others = one_text_each(slim.filter("doc_id is not null"))
    marked = named.join(repeated_strings(named, parts), "doc_id", "left")
    nameless = slim.filter("doc_id is null")
    nameless = (nameless if others is None else nameless.unionByName(others)).withColumn("places", F.lit(None).cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places = batch.column("places")
            out: list[tuple] = []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                text = text or b""
                rest, spans = text, 0
                if places[i].is_valid:
                    runs = places[i].values.to_numpy()
                    gone = covered(len(text), runs >> COUNT_BITS, (runs & ((1 << COUNT_BITS) - 1)) + LENGTH - 1)
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any())
                    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return marked.unionByName(nameless).mapInArrow(run, schema)
