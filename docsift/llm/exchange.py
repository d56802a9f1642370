"""An exchange of very many hashed places of documents, packed into few binary rows.

A slice of documents sends one row for each bucket of hashes, not one for each hash: the hashes as byte planes, the
places as gaps, the document ids once. Whatever a slice can decide by itself passes through as plain rows. A bucket is
the unit that is brought together; there are twice as many as shuffle partitions, so their size stays the same as both
grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.storage import cut
from docsift.llm.words import list_array, mix

PACKED = "bucket long, doc_id long, places array<long>, prints array<long>, n_docs int, n int, body binary"
PACKED_NAMES = ["bucket", "doc_id", "places", "prints", "n_docs", "n", "body"]
PLACES_NAMES = ["doc_id", "places", "prints"]
PLACES = "doc_id long, places array<long>, prints array<long>"


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values as ``width`` planes of bytes; planes that hardly change vanish in compression."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(body: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = body[: n * width].reshape(width, n).T
    return out.reshape(-1).view("<u8")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long, and ``text``. Without a cast that is not needed, so that Spark sees equal scans as equal."""
    if docs.schema["doc_id"].dataType == T.LongType():
        return docs.select("doc_id", "text")
    return docs.select(F.col("doc_id").cast("long"), "text")


def one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows to work on, and the rows whose ``doc_id`` another text has too, if there are any.

    Of an id with different texts, the one with the least hash is worked on, so that places never meet another text.
    """
    v = F.xxhash64("text")
    several = docs.groupBy("doc_id").agg(F.min(v).alias("least"), F.max(v).alias("most")).filter("least != most").select("doc_id", "least")
    several = cut(several)
    if several.isEmpty():
        return docs, None
    marked = docs.join(several, "doc_id", "left")
    other = F.coalesce(v != F.col("least"), F.lit(False))
    return marked.filter(~other).select("doc_id", "text"), marked.filter(other).select("doc_id", "text")


def _rows(
    doc_ids: np.ndarray, docs: np.ndarray, places: np.ndarray, prints: np.ndarray | None
) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Places by document: the ids and, for each, the lists of its places and, if given, of their prints."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    heads = np.flatnonzero(np.diff(docs, prepend=-1))
    bounds = np.append(heads, len(docs))
    lists = pa.nulls(len(heads), pa.list_(pa.int64())) if prints is None else list_array(prints[order].astype(np.int64), bounds)
    return pa.array(doc_ids[docs[heads]], pa.int64()), list_array(places, bounds), lists


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def print_of(hashes: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """What the exchange knows of a hash: its bucket and its lowest bytes."""
    return bucket_of(hashes, buckets) << (8 * width) | (hashes & np.uint64((1 << 8 * width) - 1)).astype(np.int64)


def packed_batches(doc_ids, docs, places, hashes, buckets, width, flags) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: the entries' documents, places, hashes (lists of 8-byte parts) and flags."""
    order = np.argsort(buckets, kind="stable")
    bounds = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    out: dict[str, list] = {"bucket": [], "n_docs": [], "n": [], "body": []}
    for begin, end in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
        own = order[begin:end]
        doc = docs[own]
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        gaps = np.diff(places[own], prepend=0)
        gaps[heads] = places[own[heads]]
        out["bucket"].append(int(buckets[own[0]]))
        out["n_docs"].append(len(heads))
        out["n"].append(len(own))
        out["body"].append(
            b"".join(
                [
                    pack(doc_ids[doc[heads]], 8),
                    pack(np.diff(np.append(heads, len(own))), 4),
                    pack(gaps, 4),
                    np.packbits(flags[own]).tobytes(),
                    *(pack(h[own], width) for h in hashes),
                ]
            )
        )
    if out["bucket"]:
        n = len(out["bucket"])
        columns = [
            pa.array(out["bucket"], pa.int64()),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.list_(pa.int64())),
            pa.nulls(n, pa.list_(pa.int64())),
            pa.array(out["n_docs"], pa.int32()),
            pa.array(out["n"], pa.int32()),
            pa.array(out["body"], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, PACKED_NAMES)


def known_rows(
    doc_ids: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int, prints: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """Rows of what a slice has found by itself; they pass through the exchange."""
    if len(docs):
        ids, lists, marks = _rows(doc_ids, docs, places, prints)
        n = len(ids)
        columns = [
            pa.array(-1 - (ids.to_numpy() % buckets), pa.int64()),
            ids,
            lists,
            marks,
            pa.nulls(n, pa.int32()),
            pa.nulls(n, pa.int32()),
            pa.nulls(n, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, PACKED_NAMES)


def _spread(ids: np.ndarray, places: np.ndarray, prints: np.ndarray | None, parts: int) -> Iterator[pa.RecordBatch]:
    """Entries packed for the partitions that their documents go to."""
    target = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((places, ids, target))
    target, ids, places = target[order], ids[order], places[order]
    bounds = np.flatnonzero(np.diff(target, prepend=-1))
    out: dict[str, list] = {"target": [], "n_docs": [], "n": [], "body": []}
    for low, high in zip(bounds, np.append(bounds[1:], len(target)), strict=True):
        doc = ids[low:high]
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        gaps = np.diff(places[low:high], prepend=0)
        gaps[heads] = places[low:high][heads]
        marks = b"" if prints is None else pack(prints[order[low:high]], 8)
        out["target"].append(int(target[low]))
        out["n_docs"].append(len(heads))
        out["n"].append(len(doc))
        out["body"].append(b"".join([pack(doc[heads], 8), pack(np.diff(np.append(heads, len(doc))), 4), pack(gaps, 4), marks]))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _unpacked(n_docs: int, n: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, entries of each, places of all entries, and what follows."""
    ids = unpack(raw, n_docs, 8).view(np.int64)
    per = unpack(raw[n_docs * 8 :], n_docs, 4).astype(np.int64)
    gaps = unpack(raw[n_docs * 12 :], n, 4).astype(np.int64)
    total = np.cumsum(gaps)
    heads = np.cumsum(per) - per
    return ids, per, total - np.repeat(total[heads] - gaps[heads], per), raw[n_docs * 12 + n * 4 :]


def exchange(packed: DataFrame, parts: int, width: int, n_hashes: int, decide: Callable, prints: bool = False) -> DataFrame:
    """Brings each bucket together; ``decide(hashes, doc_ids, flags)`` tells which of its entries are found.

    One row for each document with found entries: ``doc_id``, ``places``, and ``prints`` if asked for (else null).
    """

    def solve(bucket: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        ids, places, flags, hashes = [], [], [], [[] for _ in range(n_hashes)]
        for n_docs, n, body in rows:
            doc_ids, per, place, raw = _unpacked(n_docs, n, np.frombuffer(body, np.uint8))
            ids.append(np.repeat(doc_ids, per))
            places.append(place)
            at = (n + 7) // 8
            flags.append(np.unpackbits(raw[:at], count=n).astype(bool))
            for h in hashes:
                h.append(unpack(raw[at:], n, width))
                at += n * width
        doc, whole = np.concatenate(ids), [np.concatenate(h) for h in hashes]
        found = decide(whole, doc, np.concatenate(flags))
        marks = (bucket << (8 * width) | whole[0][found].astype(np.int64)) if prints else None
        return doc[found], np.concatenate(places)[found], marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, rows = None, []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in held) >= least:
                marks = np.concatenate([x[2] for x in held]) if prints else None
                yield from _spread(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), marks, parts)
                held.clear()

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            known = batch.filter(pa.array(bucket < 0))
            if known.num_rows:
                lists = known.column("places")
                ids = np.repeat(known.column("doc_id").to_numpy(), np.diff(lists.offsets.to_numpy()))
                marks = known.column("prints").flatten().to_numpy() if prints else None
                held.append((ids, lists.flatten().to_numpy(), marks))
            n_docs, n, body = (batch.column(c) for c in ("n_docs", "n", "body"))
            for i in np.flatnonzero(bucket >= 0):
                if bucket[i] != now:
                    if rows:
                        held.append(solve(now, rows))
                        yield from flush(1 << 20)
                    now, rows = bucket[i], []
                rows.append((n_docs[i].as_py(), n[i].as_py(), body[i].as_py()))
            yield from flush(1 << 20)
        if rows:
            held.append(solve(now, rows))
        yield from flush(1)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for n_docs, n, body in zip(*(batch.column(c).to_pylist() for c in ("n_docs", "n", "body")), strict=True):
                doc, per, place, raw = _unpacked(n_docs, n, np.frombuffer(body, np.uint8))
                ids.append(np.repeat(doc, per))
                places.append(place)
                if prints:
                    marks.append(unpack(raw, n, 8).view(np.int64))
        doc, place = np.concatenate(ids), np.concatenate(places)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        mark = np.concatenate(marks)[order][new] if prints else None
        doc, place = doc[new], place[new]
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        for low in range(0, len(heads), 4096):
            own = np.append(heads, len(doc))[low : low + 4097]
            bounds = own - own[0]
            lists = list_array(place[own[0] : own[-1]], bounds)
            other = list_array(mark[own[0] : own[-1]], bounds) if prints else pa.nulls(len(own) - 1, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]], pa.int64()), lists, other], PLACES_NAMES)

    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    spread = dealt.mapInArrow(run, "target int, n_docs int, n int, body binary")
    return spread.repartition(parts, "target").mapInArrow(collect, PLACES)
