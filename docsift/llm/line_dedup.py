"""Line deduplication by pairwise alignment (operator 7).

Lines are the parts of a text between line breaks; lines without a word never match. Lines are known by 128-bit digests.
Documents are paired through shared lines: a rare line (in at most ``RARE`` documents) pairs each of them with every earlier
one; a line that more documents hold pairs each later one with the first, its owner. So a line in a million documents gives
a million pairs, never their square, and no document that holds a line of an earlier one stays without a partner. A text
that an earlier document has as a whole is deleted as a whole, without pairs.

A pair is told only the lines that it shares in this way, with their places in both, so that what is sent grows with the
shared lines. Holders of a line are counted and joined in ``SALTS`` parts of each line.

Each pair is aligned with patience diff on line hashes: the common end and beginning, then the lines that are unique in
both and in the same order, then the same between them. In a range without a line that is unique in both, a longest common
subsequence is aligned (exact, in bit vectors; halved while its table would outgrow ``TABLE_BITS``), so of a passage that
one side holds several times as many are aligned as the other side has. The aligned common blocks are deleted from the
later document; what several partners align is deleted once. Alignments look at the input, not at what is left.

Result (``deduplicate``): ``docs`` with ``n_lines`` (lines with a word), ``n_removed`` and the remaining ``text``. A null
text stays null; nothing is deleted from a row with a null ``doc_id``; equal rows are treated alike; rows with one ``doc_id``
and different texts are versions of a document, each aligned for itself with documents of a smaller id. Other columns,
whatever their names, are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.storage import stored
from docsift.llm.words import Texts, digests, list_array, runs_of, signed, slices

TABLE_BITS = 1 << 28
RARE = 8
SALTS = 16


def _increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before = [0] * len(places)
    for i, place in enumerate(places):
        at = bisect_left(ends, place)
        before[i] = last[at - 1] if at else -1
        if at == len(ends):
            ends.append(place)
            last.append(i)
        else:
            ends[at] = place
            last[at] = i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _rows(old: list[int], new: list[int]) -> Iterator[int]:
    """For each line of ``new``, the common length with all beginnings of ``old``: bit i is 0 if line i lengthens it."""
    masks: dict[int, int] = {}
    for i, line in enumerate(old):
        masks[line] = masks.get(line, 0) | 1 << i
    every = row = (1 << len(old)) - 1
    for line in new:
        same = row & masks.get(line, 0)
        row = (row + same | row - same) & every
        yield row


def _lengths(old: list[int], new: list[int]) -> np.ndarray:
    """Common length of ``new`` with each beginning of ``old``."""
    row = (1 << len(old)) - 1
    for row in _rows(old, new):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(old) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits[: len(old)] == 0)])


def common(old: list[int], new: list[int], table_bits: int = TABLE_BITS) -> list[int]:
    """Places in ``new`` of a longest common subsequence, later places first."""
    out: list[int] = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        kept = set(old[a:a_end]) & set(new[b:b_end])
        own = [line for line in old[a:a_end] if line in kept]
        places = [j for j in range(b, b_end) if new[j] in kept]
        lines = [new[j] for j in places]
        if len(own) * len(lines) > table_bits and len(lines) > 1:
            half = len(lines) // 2
            at = int(np.argmax(_lengths(own, lines[:half]) + _lengths(own[::-1], lines[half:][::-1])[::-1]))
            own_places = [i for i in range(a, a_end) if old[i] in kept]
            middle = own_places[at] if at < len(own) else a_end
            todo += [(a, middle, b, places[half]), (middle, a_end, places[half], b_end)]
            continue
        rows, i, j = list(_rows(own, lines)), len(own), len(lines)
        while i and j:
            if own[i - 1] == lines[j - 1]:
                i, j = i - 1, j - 1
                out.append(places[j])
            elif rows[j - 1] >> i - 1 & 1:
                i -= 1
            else:
                j -= 1
    return out


def patience(old: list[int], new: list[int]) -> list[int]:
    """Places in ``new`` that patience diff aligns with equal lines of ``old``; ranges without unique ones by ``common``."""
    aligned: list[int] = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and old[a_end - 1] == new[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            aligned.append(b_end)
        while a < a_end and b < b_end and old[a] == new[b]:
            aligned.append(b)
            a, b = a + 1, b + 1
        if a == a_end or b == b_end:
            continue
        n_old, n_new = Counter(old[a:a_end]), Counter(new[b:b_end])
        place = {line: i for i, line in enumerate(old[a:a_end], a) if n_old[line] == 1}
        both = [(place[line], j) for j, line in enumerate(new[b:b_end], b) if n_new[line] == 1 and line in place]
        for k in _increasing([i for i, _ in both]):
            i, j = both[k]
            todo.append((a, i, b, j))
            aligned.append(j)
            a, b = i + 1, j + 1
        if both:
            todo.append((a, a_end, b, b_end))
        else:
            aligned += (b + j for j in common(old[a:a_end], new[b:b_end]))
    return sorted(aligned)


NAMES = ["doc_id", "v", "d1", "d2", "h1", "h2", "places"]
SCHEMA = "doc_id long, v long, d1 long, d2 long, h1 array<long>, h2 array<long>, places array<array<int>>"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each version of a document: the digest of its text, and its different lines that have a word, with the
    places of each among those lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column("text"))
            starts, ends, doc = texts.lines()
            words = np.concatenate([[0], np.cumsum(texts.in_word)])
            some = words[ends] > words[starts]
            starts, ends, doc = starts[some], ends[some], doc[some]
            lines = digests(texts.data, starts, ends)
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            order, heads = runs_of([doc, lines[:, 0], lines[:, 1]])
            one = order[heads]
            bounds = np.searchsorted(doc[one], np.arange(texts.n + 1))
            within = list_array(place[order], np.append(heads, len(order)), pa.int32())
            whole = digests(texts.data, texts.offsets[:-1], texts.offsets[1:])
            columns = [
                batch.column("doc_id"),
                batch.column("v"),
                *(pa.array(signed(whole[:, i].copy())) for i in range(2)),
                *(list_array(signed(lines[one, i].copy()), bounds) for i in range(2)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), within),
            ]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return docs.select("doc_id", "v", "text").mapInArrow(run, SCHEMA).dropDuplicates(["doc_id", "v"])


def partners(lines: DataFrame, rare: int = RARE) -> DataFrame:
    """``doc_id``, ``v``, ``pairs``: for each earlier document to align it with, the places of the shared lines in both."""
    each = lines.select("doc_id", "v", F.explode(F.arrays_zip("h1", "h2", "places")).alias("x"))
    each = each.select(F.struct("doc_id", "v").alias("doc"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), F.col("x.places").alias("places"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    some = each.groupBy("h1", "h2", "salt").agg(F.count("*").alias("df"), F.min(F.struct("doc", "places")).alias("owner"))
    shared = some.groupBy("h1", "h2").agg(F.sum("df").alias("df"), F.min("owner").alias("owner"), F.collect_list("salt").alias("salts")).filter("df > 1")
    held = each.join(shared.withColumn("salt", F.explode("salts")).drop("salts"), ["h1", "h2", "salt"])
    earlier = F.col("owner.doc.doc_id") < F.col("doc.doc_id")
    common = held.filter(F.col("df") > rare).filter(earlier).select("doc", F.col("owner.doc").alias("partner"), "places", F.col("owner.places").alias("old"))
    few = held.filter(F.col("df") <= rare).groupBy("h1", "h2").agg(F.collect_list(F.struct("doc", "places")).alias("holders"))
    few = few.select(F.explode("holders").alias("new"), "holders").select("new", F.explode("holders").alias("other"))
    few = few.filter("other.doc.doc_id < new.doc.doc_id").select(F.col("new.doc").alias("doc"), F.col("other.doc").alias("partner"), F.col("new.places").alias("places"), F.col("other.places").alias("old"))
    pairs = common.unionByName(few).groupBy("doc", "partner").agg(F.collect_list(F.struct("places", "old")).alias("lines"))
    return pairs.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.v").alias("v"), "lines")


def align(lines: list[tuple[list[int], list[int]]]) -> list[int]:
    """The places in the new document that are aligned, from the places of each shared line in the new and the old one."""
    new = sorted((place, i) for i, (places, _) in enumerate(lines) for place in places)
    old = sorted((place, i) for i, (_, places) in enumerate(lines) for place in places)
    return [new[j][0] for j in patience([i for _, i in old], [i for _, i in new])]


def aligned_lines(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """``doc_id``, ``v`` and ``gone``: which of its lines with a word are aligned with an earlier document."""
    lines = stored(_lines(docs.filter("doc_id is not null")))
    sizes = F.aggregate("places", F.lit(0), lambda n, x: n + F.size(x))
    firsts = lines.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    marked = lines.join(firsts, ["d1", "d2"], "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    copies = marked.filter("copy and size(places) > 0").select("doc_id", "v", F.sequence(F.lit(0), sizes - 1).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [align([(x["places"], x["old"]) for x in own]) for own in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("v"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "v", "gone"])

    matched = partners(marked.filter("not copy").select(*lines.columns), rare).mapInArrow(run, "doc_id long, v long, gone array<int>")
    return matched.groupBy("doc_id", "v").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")).unionByName(copies)


def deduplicate(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """``docs`` with the remaining ``text``, and ``n_lines`` and ``n_removed`` (replacing columns of these names)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    kept = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("v"))
    gone = aligned_lines(kept.select("doc_id", "v", "text"), rare)
    joined = kept.join(gone, ["doc_id", "v"], "left").drop("doc_id", "v", f"c{own.index('text')}")
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_removed = [], [], []
            gone = batch.column("gone")
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                lines = [] if text is None else text.split(b"\n")
                some = [k for k, line in enumerate(lines) if line.strip()]
                drop = {some[k] for k in gone[i].as_py()} if gone[i].is_valid else set()
                if drop:
                    text = b"\n".join(line for k, line in enumerate(lines) if k not in drop)
                texts.append(text)
                n_lines.append(len(some))
                n_removed.append(len(drop))
            left = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [left if c == "text" else batch.column(f"c{i}") for i, c in enumerate(own)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*own, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)
