"""Similarity self-join on word n-gram sets by MinHash banding (operator 6).

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. A text of one to
four words has its whole word sequence as its only shingle; a text without words has none and links to nothing.

1. Documents with the same set are one class (128-bit digest of the set); its smallest ``doc_id`` represents it.
2. Bands: ``choose_bands`` takes the fewest MinHash values that find a pair at the threshold with the target recall.
   Representatives are shuffled on band hashes; each bucket gives edges to its smallest member only, and connected
   buckets make a candidate cluster. So a bucket of n members costs n edges, and clusters hold every pair that shares a
   band.
3. Verification: clusters are cut into blocks of ``BLOCK`` representatives, and every pair of blocks of a cluster is a
   task's worth of exact set comparisons on whole shingle sets. A task returns, for each representative, how many
   documents it links to, and edges that connect what is linked: not more than its members, however many pairs there
   are.
4. Connected links give the class that documents are grouped by.

Result (``link``): ``doc_id``, ``class_id`` (smallest id that links reach, itself if none), ``same_id`` (smallest id
with the same set), ``n_links`` (documents linked to, copies included). Rows with a null ``doc_id`` are left out; rows
that repeat an id are one document, of which the text with the least digest counts; columns of any name are kept. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.components import components
from docsift.llm.exchange import keyed
from docsift.llm.storage import cut, stored
from docsift.llm.words import Hasher, Texts, list_array, mix, runs_of, signed, slices

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999999
BLOCK = 256
_A, _B = Hasher(0), Hasher(1)
_U64 = np.uint64


def choose_bands(threshold: float, recall: float, most_rows: int = 8, noise: float = 0.375) -> tuple[int, int]:
    """(bands, rows in a band): the fewest values that reach the recall at the threshold and propose at most a tenth of
    the pairs of similarity ``threshold * noise``."""
    fits = []
    for rows in range(1, most_rows + 1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        false = 1 - (1 - (threshold * noise) ** rows) ** bands
        fits.append((false > 0.1 and rows < most_rows, bands * rows, bands, rows))
    _, _, bands, rows = min(fits)
    return bands, rows


def shingles(texts: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each different shingle, and its document, in order of documents."""
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < k))
    begin = np.concatenate([texts.windows(k), texts.word_offsets[:-1][short]])
    end = np.concatenate([begin[: len(begin) - len(short)] + k, texts.word_offsets[1:][short]])
    doc = texts.doc_of_words()[begin]
    first, second = (h.ranges(h.prefix(texts.word_hashes(h)), begin, end) for h in (_A, _B))
    order, heads = runs_of([doc, first])
    one = order[heads]
    return first[one], second[one], doc[one]


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``v`` (which of its texts), the digest of the shingle set (d1, d2) and the band hashes; only texts with words."""
    seeds = mix(np.arange(bands * rows, dtype=_U64) + _U64(77)) | _U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column("text"))
            first, second, doc = shingles(texts)
            if not len(doc):  # texts without words
                continue
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            d1 = mix(np.add.reduceat(first, heads))
            d2 = mix(np.add.reduceat(second, heads))
            band = np.zeros((len(heads), bands), _U64)
            for i, seed in enumerate(seeds):
                least = np.minimum.reduceat(first * seed, heads)
                band[:, i // rows] = mix(band[:, i // rows] * _U64(31) + (least >> _U64(4)) + _U64(i))
            ids = batch.column("doc_id").to_numpy()[doc[heads]]
            offsets = np.arange(len(heads) + 1) * bands
            v = batch.column("v").take(pa.array(doc[heads]))
            columns = [pa.array(ids), v, pa.array(signed(d1)), pa.array(signed(d2)), list_array(signed(band.reshape(-1)), offsets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "doc_id long, v long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """The rows with their shingle sets in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column("text"))
            first, _, doc = shingles(texts)
            bounds = np.searchsorted(doc, np.arange(texts.n + 1))
            columns = [batch.column(c) for c in ("doc_id", "cluster", "n_copies")]
            yield pa.RecordBatch.from_arrays([*columns, list_array(signed(first), bounds)], ["doc_id", "cluster", "n_copies", "grams"])

    return docs.select("doc_id", "cluster", "n_copies", "text").mapInArrow(
        run, "doc_id long, cluster long, n_copies long, grams array<long>"
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, as a matrix."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order, heads = runs_of([values])
    sizes = np.diff(np.append(heads, len(order)))
    column = np.empty(len(values), np.int64)
    column[order] = np.repeat(np.cumsum(sizes > 1) - 1, sizes)
    shared = np.zeros(len(values), bool)
    shared[order] = np.repeat(sizes > 1, sizes)
    n = int((sizes > 1).sum())
    out = np.zeros((len(left), len(right)), np.float32)
    own, col = owner[shared], column[shared]
    by = np.argsort(col, kind="stable")
    own, col = own[by], col[by]
    for at in range(0, n, 4096):  # bounded columns at once
        lo, hi = np.searchsorted(col, [at, at + 4096])
        part = np.zeros((len(left) + len(right), min(4096, n - at)), np.float32)
        part[own[lo:hi], col[lo:hi] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """``doc_id``, ``other`` (edges of a forest, or null) and ``n`` (documents linked to within the pair of blocks)."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    tiles = placed.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "cluster", F.least("block", "x").alias("ti"), F.greatest("block", "x").alias("tj"), "block", "doc_id", "n_copies", "grams"
    )

    def solve(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        block = table.column("block").to_numpy()
        copies = table.column("n_copies").to_numpy()
        lists = table.column("grams").combine_chunks()
        grams = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
        i, j = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        size = np.array([len(g) for g in grams], np.float64)
        common = overlaps([grams[k] for k in left], [grams[k] for k in right]).astype(np.float64)
        union = size[left][:, None] + size[right][None, :] - common
        linked = (common > 0) & (common >= threshold * union - 1e-9 * union)
        n = np.zeros(len(ids), np.int64)
        if i == j:
            np.fill_diagonal(linked, False)
            n[left] = linked @ copies[right]
        else:
            n[left] += linked @ copies[right]
            n[right] += linked.T @ copies[left]
        parent = list(range(len(ids)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = np.nonzero(linked)
        a, b = left[a], right[b]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.array([find(x) for x in range(len(ids))])
        return pa.table({"doc_id": ids, "other": ids[roots], "n": n})

    return tiles.groupBy("cluster", "ti", "tj").applyInArrow(solve, "doc_id long, other long, n long")


def link(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each document: ``doc_id``, ``class_id``, ``same_id``, ``n_links``."""
    bands, rows = choose_bands(threshold, recall)
    slim = keyed(docs).filter("doc_id is not null").withColumn("v", F.xxhash64("text"))
    signatures = stored(_signatures(slim, bands, rows))
    sets = signatures.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "v")).alias("one")).select("doc_id", "one.*")
    classes = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("same_id"), F.count("*").alias("n_copies"))
    membership = cut(sets.join(classes, ["d1", "d2"]).select("doc_id", "v", "same_id", "n_copies"))
    representatives = membership.filter("doc_id = same_id").select("doc_id", "v", "n_copies")

    probes = signatures.join(representatives.select("doc_id", "v"), ["doc_id", "v"], "left_semi").select(
        "doc_id", F.explode("bands").alias("key")
    )
    buckets = probes.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    edges = probes.join(buckets.filter("least != most"), "key").select("doc_id", "least")
    clusters = components(edges, "doc_id", "least").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))

    members = slim.join(clusters.join(representatives, "doc_id"), ["doc_id", "v"]).dropDuplicates(["doc_id"])
    found = cut(_verify(_sets(members), threshold))
    groups = components(found, "doc_id", "other").select(F.col("node").alias("same_id"), F.col("component").alias("class_id"))
    links = found.groupBy(F.col("doc_id").alias("same_id")).agg(F.sum("n").alias("n"))
    linked = membership.join(links, "same_id", "left").join(groups, "same_id", "left")
    every = slim.select("doc_id").distinct().join(linked, "doc_id", "left")
    return every.select(
        "doc_id",
        F.coalesce("class_id", "same_id", "doc_id").alias("class_id"),
        F.coalesce("same_id", "doc_id").alias("same_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("n_copies", F.lit(1)) - 1).alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without those that belong to the class of a smaller id; rows with a null ``doc_id`` stay."""
    later = link(docs, threshold, recall).filter("class_id != doc_id").select(F.col("doc_id").alias("later"))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))  # so that no name of the caller meets ours
    left = named.join(later, F.col("d.doc_id").cast("long") == F.col("later"), "left_anti")
    return left.select(*(F.col("d").getField(c).alias(c) for c in docs.columns))
