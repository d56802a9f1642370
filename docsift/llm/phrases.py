"""Phrase collocation mining by sampling and a negative border (operator 11, Toivonen's method).

Texts (A-Z in lower case) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. A phrase is
1 to ``LONGEST`` words of one piece; everything is counted per language, and a phrase is frequent if it occurs ``support``
times or more. As no phrase occurs more often than a part of it, the frequent ones are found so:

1. Sample. The phrases of about one in ``SAMPLE`` documents (by a digest of the row) are counted; those that reach a
   lowered support are proposed. They hold all their own parts.
2. Full pass. Every word, and every phrase whose first and last words but one are both proposed, is counted over all
   documents: that is, the proposed phrases and their whole negative border, as far as it occurs.
3. Expansion. A border phrase that turns out frequent is a failure of the sample: its extensions were not counted. A pass
   over all documents counts every phrase that holds a failed one and whose other parts were proposed, up to the full
   length at once. A frequent phrase that the full pass left out holds a failed one (the shortest of its parts that was not
   proposed is frequent, so it was counted and failed), so nothing is left to expand after it.

So the result does not depend on the sample. Proposed phrases are known to tasks as a Bloom filter of bounded size
(``operators/bloom.py``); a phrase that it lets through by mistake is only counted for nothing. Counting is by the phrases
themselves, as text: a slice of documents sends each of its phrases once, with its count, so no word, however frequent,
brings its places together. (Most border phrases occur once in a task; adding up there a second time only spills.)

``collocations`` scores phrases of two or more words. It cuts a phrase after each of its words, with l and r as the
frequencies of the parts: floor(2000000 * a / (l + r)) in exact decimals, the lowest of the cuts. It drops phrases that lie
in a longer frequent phrase of ``ABSORBED`` percent of their frequency or more (a longer one of one word more tells it,
because it is at least as frequent as any that holds it), and returns the first ``most`` of each language.

Results for odd input: null text is empty; null languages are ``und``, together with rows that say so; rows that repeat
count as often as they stand there; only the named columns are read, so other columns of any name do no harm. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.storage import stored
from docsift.llm.words import Hasher, buffer_of, mix, signed, slices, spans_of
from docsift.operators import bloom

LONGEST = 4
SUPPORT = 30
SAMPLE = 8
ABSORBED = 80
MOST = 2000
UNKNOWN = "und"
SLICE_BYTES = 2 << 20  # text that is counted at once; one longer document is counted alone
OUT_BYTES = 1 << 20  # text of phrases in one batch

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b"\x20\x09")] = True
_HASH = Hasher(5)
_U64 = np.uint64


def _codes(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense numbers of equal values, and the different values."""
    found = (array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


class Pieces:
    """The words of a batch of texts, numbered, with the piece and the language of each."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets = buffer_of(text)
        data = _LOWER[data]
        ends_piece = _BREAK[data]
        inside = ~(ends_piece | _BLANK[data])
        starts, ends = spans_of(inside, offsets)
        self.n = len(starts)
        doc = np.searchsorted(offsets, starts, "right") - 1
        #: equal for words of one piece; neither part ever falls
        self.piece = np.cumsum(ends_piece)[starts] + doc if self.n else doc
        self.lengths = ends - starts
        begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.word, words = _codes(_binary(data[inside], begins))
        #: word i, and one space after it, begins at joined[at[i]]
        self.at = begins + np.arange(self.n + 1)
        self.joined = np.full(int(self.at[-1]), 32, np.uint8)
        letters = np.ones(len(self.joined), bool)
        letters[self.at[1:] - 1] = False
        self.joined[letters] = data[inside]
        code, self.langs = _codes(pc.fill_null(lang.cast(pa.string()), UNKNOWN))
        self.lang = code[doc]
        self.word_hash = self._hashes(words)[self.word]
        self.lang_hash = mix(self._hashes(self.langs.cast(pa.large_binary())))[self.lang]

    @staticmethod
    def _hashes(values: pa.Array) -> np.ndarray:
        data, offsets = np.frombuffer(values.buffers()[2] or b"", np.uint8), np.frombuffer(values.buffers()[1], np.int64)
        return _HASH.words(data, offsets[:-1], offsets[1:]) if len(values) else np.zeros(0, _U64)

    def texts(self, places: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that begin at the places."""
        lengths = self.at[places + k] - 1 - self.at[places]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        index = np.repeat(self.at[places] - bounds[:-1], lengths) + np.arange(bounds[-1])
        return _binary(self.joined[index], bounds).cast(pa.large_string())

    def counted(self, filters: list[np.ndarray] | None, failed: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first place, occurrences) of the phrases to count, by number of words.

        Without ``filters`` all phrases; else those whose parts are in one of them; with ``failed``, only those that hold a
        phrase of that filter, and whose parts hold one too or are in the others.
        """
        if not self.n:
            return
        key = self.word * len(self.langs) + self.lang
        places = np.arange(self.n)
        hashes = self.word_hash ^ self.lang_hash
        keep = np.zeros(self.n, bool)  # places where the phrase to count holds a failed one
        for k in range(1, LONGEST + 1):
            ids, values = _codes(pa.array(key))
            first = np.empty(len(values), np.int64)
            first[ids[::-1]] = places[::-1]
            hashes = mix(hashes[first]) if k == 1 else mix(hashes[number[first]] * _U64(0x9E3779B97F4A7C15) + self.word_hash[first + k - 1])
            n = np.bincount(ids, minlength=len(values))
            sent = np.argsort(values.to_numpy())  # phrases that begin alike lie together, and compress
            good = np.ones(len(values), bool) if filters is None else np.zeros(len(values), bool)
            for table in filters or []:
                good |= bloom.contains(table, hashes)
            new = np.zeros(len(values), bool) if failed is None else bloom.contains(failed, hashes) & ~good
            if failed is None:
                yield k, first[sent], n[sent]
            elif k > 1 and keep.any():
                wanted = np.zeros(len(values), bool)
                wanted[ids[keep]] = True
                sent = sent[wanted[sent]]
                yield k, first[sent], n[sent]
            if k == LONGEST:
                return
            # number of the phrase of k words at each place, -1 where it is not extended
            number = np.full(self.n + 1, -1, np.int64)
            fresh = np.zeros(self.n + 1, bool)
            fresh[places] = new[ids] | keep
            number[places] = np.where(good[ids] | fresh[places], ids, -1)
            both = (number[places] >= 0) & (number[places + 1] >= 0) & (places + k < self.n)
            places = places[both]
            places = places[self.piece[places] == self.piece[places + k]]
            key = number[places] * np.int64(self.n + 1) + self.word[places + k]
            keep = fresh[places] | fresh[places + 1]


def _count(docs: DataFrame, filters: list[np.ndarray] | None = None, failed: np.ndarray | None = None) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``f``; with k = 0 the number of words of the language."""
    shared = docs.sparkSession.sparkContext.broadcast((filters, failed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, failures = shared.value
        for batch in slices(batches, limit=SLICE_BYTES):
            pieces = Pieces(batch.column("text"), batch.column("lang"))

            def rows(lang: np.ndarray, phrases: pa.Array, n: np.ndarray, pieces=pieces) -> pa.RecordBatch:
                columns = [pieces.langs.take(pa.array(lang)), phrases.cast(pa.string()), pa.array(n, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

            if failures is None and pieces.n:
                n = np.bincount(pieces.lang, minlength=len(pieces.langs))
                yield rows(np.arange(len(n)), pa.array([""] * len(n), pa.large_string()), n)
            for k, places, n in pieces.counted(own, failures):
                size = np.cumsum(pieces.at[places + k] - pieces.at[places])
                low = 0
                while low < len(places):
                    done = size[low - 1] if low else 0
                    high = max(low + 1, int(np.searchsorted(size, done + OUT_BYTES, "right")))
                    yield rows(pieces.lang[places[low:high]], pieces.texts(places[low:high], k), n[low:high])
                    low = high
            del pieces, rows
            pa.default_memory_pool().release_unused()

    sent = docs.mapInArrow(run, "lang string, phrase string, f long").repartition("lang", "phrase")
    spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    k = F.when(F.col("phrase") == "", 0).otherwise(spaces + 1)
    return sent.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).select("lang", k.alias("k"), "phrase", "f")


def _hashed(phrases: DataFrame) -> DataFrame:
    """``h``: the hash by which ``Pieces.counted`` looks for each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "phrase"):
            own = Pieces(batch.column("phrase"), batch.column("lang"))
            heads = np.flatnonzero(np.diff(own.piece, prepend=-1))
            n = np.diff(np.append(heads, own.n))
            h = mix(own.word_hash[heads] ^ own.lang_hash[heads])
            for k in range(1, LONGEST):
                more = np.flatnonzero(n > k)
                h[more] = mix(h[more] * _U64(0x9E3779B97F4A7C15) + own.word_hash[heads[more] + k])
            yield pa.RecordBatch.from_arrays([pa.array(signed(h))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def _filter(phrases: DataFrame) -> np.ndarray:
    return bloom.build(_hashed(phrases), "h", phrases.count())


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``f`` of all frequent phrases of 1 to ``LONGEST`` words; k = 0 has the words of a language."""
    every = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if dict(docs.dtypes)[c].split("<")[0] in ("bigint", "int", "string")), F.lit(11))
    drawn = docs.filter(F.pmod(every, F.lit(sample)) == 0).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    slim = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    lowered = max(2, support // (2 * sample)) if sample > 1 else support
    extended = F.col("k").between(1, LONGEST - 1)
    proposed = stored(_count(drawn).filter(extended & (F.col("f") >= lowered)).select("lang", "phrase"))
    filters = [_filter(proposed)]
    frequent = (F.col("f") >= support) | (F.col("k") == 0)
    found = [stored(_count(slim, filters).filter(frequent))]
    failures = stored(_missing(found[0].filter(extended), filters))
    n = failures.count()
    if n:
        found.append(stored(_count(slim, filters, bloom.build(failures, "h", n)).filter(frequent)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _missing(phrases: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """``h`` of the frequent phrases that are in none of the filters."""
    shared = phrases.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            known = np.zeros(len(h), bool)
            for table in shared.value:
                known |= bloom.contains(table, h)
            yield pa.RecordBatch.from_arrays([pa.array(h[~known])], ["h"])

    return _hashed(phrases).mapInArrow(run, "h long")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = MOST, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``most`` phrases of each language."""
    every = frequent_phrases(docs, support, sample, text, lang)
    n = every.filter("k = 0").select("lang", F.col("f").alias("n"))
    long = every.filter("k > 1").select("lang", F.col("phrase"), F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    parts = every.filter(F.col("k").between(1, LONGEST - 1))
    size = F.size("w")
    inner = long.filter(size > 2).select("lang", F.col("a").alias("m"), F.explode(F.array(join(F.lit(1), size - 1), join(F.lit(2), size - 1))).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    left = long.join(held, ["lang", "phrase"], "left").filter(
        "m is null or cast(100 as decimal(20,0)) * m < cast(" + str(ABSORBED) + " as decimal(20,0)) * a"
    )
    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.lit(1), F.col("cut")).alias("head"), join(F.col("cut") + 1, size - F.col("cut")).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = "(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    scored = cuts.withColumn("score", F.expr(exact).cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    best = Window.partitionBy("lang").orderBy(F.col("s.score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score")
