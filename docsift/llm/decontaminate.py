"""Benchmark decontamination with a BM25 index of test items and block-max WAND (operator 9).

Items are indexed by their words (in lower case, ASCII punctuation read as spaces, in items and documents alike, so that
signs glued to a word hide nothing). The impact of a word on an item is its BM25 weight there, divided by the item's
score against itself, so that a passage with all words of an item scores 1 and one threshold serves items of any length.
Items lie in blocks of ``BLOCK``; the index keeps the largest impact of each word overall and in each block that has it, so
it grows with the postings.

Documents are cut into passages that begin every longest item's words and are so long that each occurrence, with the
insertions that verification allows, lies whole in one. Every passage is a query over its different words:

1. The sum of the words' largest impacts bounds every score; passages below the threshold are done (array code). So are
   passages without a single unedited run of any item that verification cannot do without (``_run``).
2. The same sum with the impacts of each block leaves the blocks that can hold a hit.
3. In these, WAND moves through the postings from pivot to pivot and retrieves every item at or above the threshold.

A retrieved item is verified on the passage: of the five-word shingles of its question, and of its answer, a share of
``OVERLAP`` or more must occur (a part of less than five words is one shingle; an empty part needs nothing). One changed
word takes up to five shingles, all of a short part; so an item is also found where question and answer follow each other
with edits (a word changed, left out or put in): at most ``PART_EDITS`` of the words of each part, and of both together
either at most 1 - ``OVERLAP`` of the words are edited or ``OVERLAP`` of the shingles occur. An item with one part missing,
or with another word for a part of one word, is no hit. The overlap of a part is then the larger of its share of shingles and
its share of unedited words. The answer of an item is its last sentence, or the last quarter of its words if it is one
sentence; ``split_items`` makes the parts.

The items are taken in shards of at most ``SHARD_BYTES`` of text, one broadcast index and one pass over the documents
for each, with word frequencies counted over all items: a broadcast never outgrows its bound. Items without words match
nothing; so do null texts. Rows that repeat a document are judged alike; items that repeat are found each; an item with a
null id is found and reported with that id, and rows with a null ``doc_id`` with theirs. Other columns are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.words import Hasher, Texts, runs_of, signed, slices

SHINGLE = 5
OVERLAP = 0.8
PART_EDITS = 0.5
SCORE = 0.5
BLOCK = 64
K1, B = 1.2, 0.75
SHARD_BYTES = 8 << 20
_HASH = Hasher(0)
_SLACK = 1e-9


def split_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``question``, ``answer`` of items that are one text."""
    words = F.expr(f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')")
    n = F.size("words")
    ends = F.expr("filter(transform(words, (w, i) -> if(w rlike '[.?!]$' and i + 1 < size(words), i + 1, 0)), i -> i > 0)")
    cut_at = F.when(F.size("ends") > 0, F.array_max("ends")).otherwise(n - F.floor(n / 4)).cast("int")
    return (
        items.filter(F.col(text).isNotNull())
        .select(F.col(item_id).cast("long").alias("item_id"), words.alias("words"))
        .withColumn("ends", ends)
        .withColumn("cut", cut_at)
        .select(
            "item_id",
            F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("question"),
            F.array_join(F.slice("words", F.col("cut") + 1, n), " ").alias("answer"),
        )
    )


def _shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    k = min(size, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    begin = np.arange(len(hashes) - k + 1)
    return np.unique(_HASH.ranges(_HASH.prefix(hashes), begin, begin + k))


def _edits(n_words: int) -> int:
    """How many edits an item of so many words bears."""
    return int((1 - OVERLAP) * n_words + _SLACK)


def _run(n_words: int, longer: int) -> int:
    """Words of an unedited run that every verified occurrence holds; ``longer`` are the words of the longer part.

    E edits leave n - E words in E + 1 runs; both parts' shingles leave a shingle of the longer part.
    """
    edits = _edits(n_words)
    return min(SHINGLE, longer, -(-(n_words - edits) // (edits + 1)))


def _distances(part: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Edit distance of ``part`` to the nearest range of ``passage`` that ends at each place (0 to its length)."""
    place = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for i, word in enumerate(part, 1):
        new = row + 1
        new[0] = i
        np.minimum(new[1:], row[:-1] + (passage != word), out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return row


@dataclass
class Index:
    item_ids: list  # None for a null
    words: np.ndarray  # sorted hashes
    offsets: np.ndarray  # postings of word i are [offsets[i], offsets[i + 1]), by item
    posting_items: np.ndarray
    impacts: np.ndarray
    most: np.ndarray  # the largest impact of each word
    block_offsets: np.ndarray  # blocks of word i are [block_offsets[i], block_offsets[i + 1])
    blocks: np.ndarray
    block_max: np.ndarray  # the word's largest impact there
    parts: list[list[np.ndarray]]  # for question and answer: the word hashes of each item
    stride: int  # words from one passage's begin to the next's
    passage: int  # words of a passage
    runs: dict[int, np.ndarray]  # by length: the sorted runs of that many words of the items that need one

    @classmethod
    def build(cls, item_ids: list, parts: list[list[np.ndarray]], n_items: int, mean: float, df: dict, longest: int) -> Index:
        lengths = np.array([len(q) + len(a) for q, a in zip(*parts, strict=True)], np.int64)
        tokens = np.concatenate([h for pair in zip(*parts, strict=True) for h in pair] or [np.zeros(0, np.uint64)])
        order, heads = runs_of([tokens, np.repeat(np.arange(len(lengths)), lengths)])
        tf = np.diff(np.append(heads, len(order))).astype(float)
        word = tokens[order[heads]]
        item = np.repeat(np.arange(len(lengths)), lengths)[order[heads]]
        n_with = np.array([df[w] for w in word.tolist()], float)
        idf = np.log1p((n_items - n_with + 0.5) / (n_with + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        impact /= np.bincount(item, impact, minlength=len(lengths))[item]
        words, first = np.unique(word, return_index=True)
        head = np.ones(len(word), bool)  # postings lie by word, then by item
        head[1:] = (word[1:] != word[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)
        heads = np.flatnonzero(head)
        block_max = np.maximum.reduceat(impact, heads) if len(heads) else impact
        block_offsets = np.searchsorted(np.searchsorted(words, word[heads]), np.arange(len(words) + 1))
        most = np.maximum.reduceat(impact, first) if len(first) else impact
        by_length: dict[int, list[np.ndarray]] = {}
        for pair in zip(*parts, strict=True):
            k = _run(sum(map(len, pair)), max(map(len, pair)))
            if k:
                by_length.setdefault(k, []).append(_shingles(np.concatenate(pair), k))
        runs = {k: np.unique(np.concatenate(v)) for k, v in by_length.items()}
        stride = max(longest, SHINGLE)
        passage = 2 * stride + _edits(longest)
        blocks = (most, block_offsets, item[heads] // BLOCK, block_max)
        return cls(item_ids, words, np.append(first, len(word)), item, impact, *blocks, parts, stride, passage, runs)

    def _verifiable(self, texts: Texts, hashes: np.ndarray) -> np.ndarray:
        """How many words before each place begin a run that an item needs."""
        marks = np.zeros(len(hashes), bool)
        prefix = _HASH.prefix(hashes)
        for k, wanted in self.runs.items():
            begin = texts.windows(k)
            own = _HASH.ranges(prefix, begin, begin + k)
            marks[begin] |= wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
        return np.concatenate([[0], np.cumsum(marks)])

    def search(self, texts: Texts, threshold: float = SCORE) -> tuple[np.ndarray, ...]:
        """(document, number of the item, score, question overlap, answer overlap) of every verified hit."""
        hits: list[tuple[int, int, float, float, float]] = []
        if len(self.words) and len(texts.starts):
            hashes = texts.word_hashes(_HASH)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            bound = np.concatenate([[0], np.cumsum(np.where(known, self.most[at], 0))])
            stride = self.stride
            n_passages = np.maximum(1, -(-texts.n_words // stride) - 1) * (texts.n_words > 0)
            doc = np.repeat(np.arange(texts.n), n_passages)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
            begin = texts.word_offsets[doc] + number * stride
            end = np.minimum(begin + self.passage, texts.word_offsets[doc + 1])
            possible = self._verifiable(texts, hashes)
            open_ = np.flatnonzero((bound[end] - bound[begin] >= threshold - _SLACK) & (possible[end] > possible[begin]))
            for low in range(0, len(open_), 4096):
                self._retrieve(open_[low : low + 4096], begin, end, doc, at, known, hashes, threshold, hits)
        found = list(zip(*hits, strict=True)) or [(), (), (), (), ()]
        kinds = (np.int64, np.int64, float, float, float)
        return tuple(np.array(x, k) for x, k in zip(found, kinds, strict=True))

    def _retrieve(self, passages, begin, end, doc, at, known, hashes, threshold, hits) -> None:
        sizes = (end - begin)[passages]
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[passages], sizes)
        owner = np.repeat(np.arange(len(passages)), sizes)[known[place]]
        pairs = np.unique(owner * np.int64(len(self.words)) + at[place[known[place]]])
        owner, word = np.divmod(pairs, len(self.words))
        per = self.block_offsets[word + 1] - self.block_offsets[word]
        entry = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.block_offsets[word], per)
        n_blocks = int(self.blocks.max()) + 1
        key = np.repeat(owner, per) * np.int64(n_blocks) + self.blocks[entry]
        order, heads = runs_of([key])
        ends = np.append(heads[1:], len(order))
        total = np.add.reduceat(self.block_max[entry[order]], heads) if len(heads) else np.zeros(0)
        word = np.repeat(word, per)
        for g in np.flatnonzero(total >= threshold - _SLACK).tolist():
            own_entries = order[heads[g] : ends[g]]
            p, block = divmod(int(key[own_entries[0]]), n_blocks)
            own = hashes[begin[passages[p]] : end[passages[p]]]
            for item, score in self._wand(word[own_entries], self.block_max[entry[own_entries]], block, threshold):
                both = [part[item] for part in self.parts]
                overlaps = [self._overlap(part, own) for part in both]
                if min(overlaps) < OVERLAP:
                    overlaps = self._edited(both, overlaps, own)
                if overlaps:
                    hits.append((int(doc[passages[p]]), item, score, *overlaps))

    def _overlap(self, part: np.ndarray, passage: np.ndarray) -> float:
        wanted = _shingles(part)
        if not len(wanted):
            return 1.0
        k = min(SHINGLE, len(part))
        if len(passage) < k:
            return 0.0
        first = np.arange(len(passage) - k + 1)
        return float(np.isin(wanted, _HASH.ranges(_HASH.prefix(passage), first, first + k)).mean())

    def _edited(self, both: list[np.ndarray], overlaps: list[float], passage: np.ndarray) -> list[float]:
        """The overlaps of an item that occurs with edits, otherwise nothing."""
        whole = np.concatenate(both)
        n_edits = _edits(len(whole))
        by_shingles = self._overlap(whole, passage) >= OVERLAP
        if not by_shingles and np.count_nonzero(~np.isin(whole, passage)) > n_edits:
            return []
        ahead = _distances(both[0], passage)
        after = _distances(both[1][::-1], passage[::-1])[::-1]
        good = (ahead <= PART_EDITS * len(both[0])) & (after <= PART_EDITS * len(both[1]))
        if not by_shingles:
            good &= ahead + after <= n_edits
        if not good.any():
            return []
        at = np.flatnonzero(good)[np.argmin((ahead + after)[good])]
        edits = (int(ahead[at]), int(after[at]))
        return [max(share, 1 - e / len(part)) if len(part) else 1.0 for share, e, part in zip(overlaps, edits, both, strict=True)]

    def _wand(self, terms: np.ndarray, most: np.ndarray, block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """Items of the block whose score reaches the threshold."""
        lists = []
        for t, highest in zip(terms.tolist(), most.tolist(), strict=True):
            lo, hi = self.offsets[t], self.offsets[t + 1]
            a, b = lo + np.searchsorted(self.posting_items[lo:hi], [block * BLOCK, (block + 1) * BLOCK])
            lists.append([self.posting_items[a:b].tolist(), self.impacts[a:b].tolist(), highest, 0])
        while lists:
            lists.sort(key=lambda x: x[0][x[3]])
            reach, pivot = 0.0, -1
            for items, _, most, i in lists:
                reach += most
                if reach >= threshold - _SLACK:
                    pivot = items[i]
                    break
            if pivot < 0:
                return
            if lists[0][0][lists[0][3]] == pivot:
                score = sum(x[1][x[3]] for x in lists if x[0][x[3]] == pivot)
                if score >= threshold - _SLACK:
                    yield pivot, min(score, 1.0)
                target = pivot + 1
            else:
                target = pivot
            for x in lists:
                while x[3] < len(x[0]) and x[0][x[3]] < target:
                    x[3] += 1
            lists = [x for x in lists if x[3] < len(x[0])]


def indexes(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The shards' indexes of ``item_id``, ``question``, ``answer``, one after the other."""
    items = items.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    size = items.agg(F.sum(F.octet_length("question") + F.octet_length("answer") + 64)).first()[0] or 0
    n_shards = -(-size // shard_bytes)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Texts(batch.column(c), plain=True) for c in ("question", "answer")]
            item = np.concatenate([t.doc_of_words() for t in texts])
            hashes = np.concatenate([t.word_hashes(_HASH) for t in texts])
            order, heads = runs_of([item, hashes])
            one = order[heads]
            lengths = sum(t.n_words for t in texts)[item[one]]
            first = np.diff(item[one], prepend=-1) != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(hashes[one])), pa.array(np.where(first, lengths, 0))], ["word", "n_words"]
            )

    counted = items.mapInArrow(tokens, "word long, n_words long")
    totals = counted.agg(F.sum("n_words"), F.max("n_words"), F.sum(F.signum("n_words"))).first()
    frequencies = counted.groupBy("word").agg(F.count("*").alias("df"))
    for shard in range(n_shards):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == shard)
        table = own.orderBy("item_id").toArrow()
        texts = [Texts(table.column(c), plain=True) for c in ("question", "answer")]
        parts = [[h for h in np.split(t.word_hashes(_HASH), t.word_offsets[1:-1])] for t in texts]
        wanted = own.mapInArrow(tokens, "word long, n_words long").select("word").distinct()
        df = frequencies.join(wanted, "word").toArrow()
        frequency = dict(zip(df.column("word").to_numpy().view(np.uint64).tolist(), df.column("df").to_pylist(), strict=True))
        if table.num_rows and totals[0]:
            mean = totals[0] / totals[2]
            yield Index.build(table.column("item_id").to_pylist(), parts, int(totals[2]), mean, frequency, int(totals[1]))


def leaks(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``: each leaked item's best passage."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    found = []
    for index in indexes(items, shard_bytes):
        shared = spark.sparkContext.broadcast(astuple(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Index(*shared.value)
            for batch in slices(batches):
                doc, item, *rest = own.search(Texts(batch.column("text"), plain=True))
                ids = batch.column("doc_id").take(pa.array(doc))
                items = pa.array(own.item_ids, pa.int64()).take(pa.array(item))
                yield pa.RecordBatch.from_arrays(
                    [ids, items, *(pa.array(x) for x in rest)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                )

        found.append(slim.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without a verified item, decided row by row: nothing is shuffled."""
    spark = docs.sparkSession
    for index in indexes(items, shard_bytes):
        shared = spark.sparkContext.broadcast(astuple(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Index(*shared.value)
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[own.search(Texts(batch.column("text"), plain=True))[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
