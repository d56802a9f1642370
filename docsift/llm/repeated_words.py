"""Removal of repeated word windows, found from fixed-block anchors (operator 2).

A window is 13 consecutive words of one document. It is repeated if the same words also start in a document with a
smaller ``doc_id``; every word that a repeated window covers is removed. Windows are judged on the input.

1. Anchors. Every document is cut into reference blocks of 7 words that do not overlap, and rolling windows of 7 words
   probe them: any window of 13 words holds a whole block, so no repeat is missed. Blocks and probes meet by hash, in
   buckets: one binary row for each slice of documents and bucket, 4 hash bytes and about 1 place byte a window. A slice
   sends each of its anchors once; that two of its own documents share one, it knows itself. So an anchor that a third
   of all documents hold sends one entry for each slice.
2. Extension. Around the hits, the 13-word windows are hashed with 96 bits and the bucket's, and the same exchange finds the smallest
   ``doc_id`` of each; the windows of all others are repeated. Neighbouring repeated windows join to the maximal repeats.

Results for odd input: a null or short text has nothing removed; rows with a null ``doc_id`` are returned unchanged and
serve nobody as reference; equal rows are one document and treated alike; of an id with different texts one takes part, and
the other rows are returned unchanged; equal texts keep the words of the smallest id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.exchange import PACKED, bucket_of, exchange, keyed, known_rows, one_text_each, packed_batches
from docsift.llm.words import Hasher, Rolling, Texts, covered, runs_of, slices

WINDOW = 13
ANCHOR_BYTES = 4  # within a bucket; a false hit only makes more windows be hashed
WINDOW_BYTES = 6  # of each of two hashes, within a bucket
_A, _B = Hasher(0), Hasher(1)


def shared_anchors(docs: DataFrame, block: int, parts: int) -> DataFrame:
    """For each document, the places of its windows of ``block`` words that are also a block of, or in, another one."""
    buckets = 2 * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            begin = texts.windows(block)
            hashes = Rolling.windows(texts.word_hashes(_A), begin, block)
            doc = texts.doc_of_words()[begin]
            place = begin - texts.word_offsets[doc]
            order, heads = runs_of([hashes])
            if not len(order):
                continue
            sizes = np.diff(np.append(heads, len(order)))
            several = np.repeat(doc[order[heads]] != doc[order[heads + sizes - 1]], sizes)
            yield from known_rows(ids, doc[order][several], place[order][several], buckets)
            aligned = place % block == 0
            flag = np.repeat(np.logical_or.reduceat(aligned[order], heads), sizes)
            first = np.zeros(len(order), bool)
            first[heads] = True
            send = first | ~several
            entries = np.sort(order[send])
            flags = np.zeros(len(doc), bool)
            flags[order] = np.where(several, flag, aligned[order])
            h = hashes[entries]
            bucket = bucket_of(h, buckets)
            yield from packed_batches(ids, doc[entries], place[entries], [h], bucket, ANCHOR_BYTES, flags[entries])

    def decide(hashes: list[np.ndarray], ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
        order, heads = runs_of(hashes)
        sizes = np.diff(np.append(heads, len(order)))
        own = ids[order]
        found = (np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)) & np.logical_or.reduceat(flags[order], heads)
        out = np.zeros(len(order), bool)
        out[order] = np.repeat(found, sizes)
        return out

    return exchange(docs.mapInArrow(run, PACKED), parts, ANCHOR_BYTES, 1, decide).drop("prints")


def repeated_windows(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """``doc_id`` and the places where windows start that also start in a document with a smaller id."""
    block = (window + 1) // 2
    buckets = 2 * parts
    joined = docs.join(shared_anchors(docs, block, parts), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            places = batch.column("places")
            per = np.diff(places.offsets.to_numpy())
            hits = places.flatten().to_numpy() + np.repeat(texts.word_offsets[:-1], per)
            doc_of = texts.doc_of_words()
            first = texts.word_offsets[:-1][np.repeat(np.arange(texts.n), per)]
            low = np.maximum(hits - (window - block), first)
            near = covered(len(doc_of), low, hits - low + 1)
            begin = texts.windows(window)
            begin = begin[near[begin]]
            if not len(begin):
                continue
            hashes = [h.ranges(h.prefix(texts.word_hashes(h)), begin, begin + window) for h in (_A, _B)]
            doc = doc_of[begin]
            place = begin - texts.word_offsets[doc]
            order, heads = runs_of(hashes)
            sizes = np.diff(np.append(heads, len(order)))
            least = np.repeat(np.minimum.reduceat(ids[doc[order]], heads), sizes)
            later = ids[doc[order]] > least
            yield from known_rows(ids, doc[order][later], place[order][later], buckets)
            entries = np.sort(order[~later])
            bucket = bucket_of(hashes[0][entries], buckets)
            flags = np.zeros(len(entries), bool)
            yield from packed_batches(ids, doc[entries], place[entries], [h[entries] for h in hashes], bucket, WINDOW_BYTES, flags)

    def decide(hashes: list[np.ndarray], ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
        order, heads = runs_of(hashes)
        sizes = np.diff(np.append(heads, len(order)))
        own = ids[order]
        out = np.zeros(len(order), bool)
        out[order] = own > np.repeat(np.minimum.reduceat(own, heads), sizes)
        return out

    return exchange(joined.mapInArrow(run, PACKED), parts, WINDOW_BYTES, 2, decide).drop("prints")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (the remaining words, one space between)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = keyed(docs)
    named, others = one_text_each(slim.filter("doc_id is not null"))
    marked = named.join(repeated_windows(named, window, parts), "doc_id", "left")
    nameless = slim.filter("doc_id is null")
    nameless = (nameless if others is None else nameless.unionByName(others)).withColumn("places", F.lit(None).cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, sums, kept = [], [], [], []
            places = batch.column("places")
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                n_words.append(len(words))
                if places[i].is_valid:
                    gone = covered(len(words), places[i].values.to_numpy(), window)
                    words = [words[k] for k in np.flatnonzero(~gone)]
                n_removed.append(n_words[-1] - len(words))
                rest = b" ".join(words)
                kept.append(rest)
                sums.append(hashlib.sha256(rest).hexdigest())
            columns = [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(sums, pa.string()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return marked.unionByName(nameless).mapInArrow(run, schema)
