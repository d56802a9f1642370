"""Language identification with bit-sliced Bloom filters over character n-grams (operator 1).

Learning. Labelled rows are sampled by a digest of their text down to about ``SAMPLE_DOCS`` documents a language (the
bound of the training sample; the rate follows from the number of different texts of each language). Equal texts of a
language teach once, so a text with very many copies neither breaks the bound nor outweighs the rest or thins it out. The letter n-grams (3 and 4
characters inside words, with word ends marked, A-Z in lower case, other characters as they are) are counted by language.
An n-gram belongs to a language if it makes up at least ``LEAST`` of the language's n-grams there, so a language has at
most 1/LEAST of them, and if its share is at least ``CONTRAST`` of its largest share in any language.

Filter. All languages share one table of slots. A slot is a bitmask with one bit for each language (64 languages a
word); ``HASHES`` slots are set for each n-gram, and the bitwise AND of the slots of an n-gram gives every language that
may contain it. The table has a fixed number of slots for each n-gram kept, so its size is bounded by the number of
languages, and it is broadcast.

Decision. For every language, the n-grams of a text whose mask has its bit are counted, and the count is corrected by
the filter's false positive rate of that language: (hits - n * fp) / (1 - fp). The largest corrected count wins, ties go
to the smaller name. The score is its lead over the second, as a share of the winner's count.

A null text and a text without a letter (marks alone are none) are ``und`` with score 0, as is every text if nothing was learned. Rows with a
null or empty text teach nothing. Only the text is used for a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.words import Texts, mix, runs_of, signed, slices

UNKNOWN = "und"
SAMPLE_DOCS = 2_000
LEAST = 2e-5
CONTRAST = 0.2
HASHES = 2
SLOTS_FOR_EACH = 12

_U64 = np.uint64


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, whether they are in words (letters and the marks on them), whether they are letters, and where they
    begin, of UTF-8 bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    b0, b1, b2, b3 = (padded[lead + i] for i in range(4))
    code = np.where(
        b0 < 0x80,
        b0,
        np.where(
            b0 < 0xE0,
            (b0 & 0x1F) << 6 | b1 & 0x3F,
            np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F),
        ),
    )
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    far = np.flatnonzero(code >= 0x80)
    points, which = np.unique(code[far], return_inverse=True)
    kind = np.array([unicodedata.category(chr(p))[0] for p in points], "U1")[which]
    inside = letter.copy()
    letter[far], inside[far] = kind == "L", (kind == "L") | (kind == "M")
    return code, inside, letter, lead


def n_grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the document of each, and how many letters each document has."""
    code, inside, letter, lead = _letters(texts.data)
    doc = np.searchsorted(texts.offsets, lead, "right") - 1
    n_letters = np.bincount(doc[letter], minlength=texts.n)
    # letters, and one word end (0) before and after each run of them; other characters and documents part runs
    code = np.where((code >= 65) & (code <= 90), code + 32, code)
    code[~inside] = 0
    inner = np.flatnonzero(np.diff(doc)) + 1
    code, doc = np.insert(code, inner, 0), np.insert(doc, inner, doc[inner])
    code = np.concatenate([[0], code, [0]])
    doc = np.concatenate([doc[:1], doc, doc[-1:]]) if len(doc) else np.zeros(2, np.int64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code, doc = code[keep].astype(_U64), doc[keep]
    found, of = [], []
    if len(code) >= 3:
        part = (code[:-2] << _U64(42)) | (code[1:-1] << _U64(21)) | code[2:]
        solid = np.flatnonzero(code[1:-1])
        found.append(mix(part[solid]))
        of.append(doc[solid + 1])
        solid = np.flatnonzero((code[1:-2] != 0) & (code[2:-1] != 0))
        found.append(mix(part[solid] * _U64(0xFF51AFD7ED558CCD) + code[solid + 3] + _U64(1 << 21)))
        of.append(doc[solid + 1])
    if not found:
        return np.zeros(0, _U64), np.zeros(0, np.int64), n_letters
    return np.concatenate(found), np.concatenate(of), n_letters


def _slots(hashes: np.ndarray, n_slots: int) -> list[np.ndarray]:
    step = (hashes >> _U64(32)) | _U64(1)
    return [((hashes + _U64(i) * step) & _U64(n_slots - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # (n_slots, words) bitmasks

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        hashes, doc, n_letters = n_grams(texts)
        n_languages = len(self.languages)
        if not n_languages:
            return [UNKNOWN] * texts.n, np.zeros(texts.n)
        masks = None
        for slot in _slots(hashes, len(self.slots)):
            masks = self.slots[slot] if masks is None else masks & self.slots[slot]
        order = np.argsort(doc, kind="stable")  # the n-grams of each size come in order of documents
        masks, doc = masks[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(texts.n + 1))
        n = np.diff(bounds).astype(float)
        true = np.zeros((texts.n, n_languages))
        for i in range(n_languages):
            word, bit = divmod(i, 64)
            total = np.concatenate([[0], np.cumsum((masks[:, word] >> _U64(bit)) & _U64(1), dtype=np.int64)])
            hits = total[bounds[1:]] - total[bounds[:-1]]
            fp = np.mean((self.slots[:, word] >> _U64(bit)) & _U64(1)) ** HASHES
            true[:, i] = np.maximum(0, (hits - n * fp) / max(1e-9, 1 - fp))
        best = np.argmax(true, axis=1)
        top = np.sort(true, axis=1)
        second = top[:, -2] if n_languages > 1 else np.zeros(texts.n)
        score = np.where(top[:, -1] > 0, (top[:, -1] - second) / np.maximum(top[:, -1], 1e-9), 0.0)
        some = n_letters > 0
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
        return names, np.where(some, np.clip(score, 0, 1), 0.0)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Filter:
    """The filter of all languages in ``lang``."""
    labelled = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text != ''")
    different = labelled.select("lang", F.xxhash64("text").alias("digest")).distinct()
    n_of = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(n_of)
    if not languages:
        return Filter([], np.zeros((1, 1), _U64))
    table = labelled.sparkSession.createDataFrame(
        [(name, i, min(1.0, sample_docs / n_of[name])) for i, name in enumerate(languages)], "lang string, code int, rate double"
    )
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("rate") * 1_000_003
    sample = labelled.join(F.broadcast(table), "lang").filter(drawn).select("text", "code").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, doc, _ = n_grams(Texts(batch.column("text")))
            code = batch.column("code").to_numpy()[doc].astype(np.int64)
            order, heads = runs_of([code, hashes])
            hashes, code = hashes[order], code[order]
            n = np.diff(np.append(heads, len(code)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[heads]), pa.array(signed(hashes[heads])), pa.array(n, pa.int64())], ["code", "gram", "n"]
            )

    counted = sample.mapInArrow(count, "code long, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    totals = {r["code"]: r["n"] for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filter(languages, np.zeros((1, (len(languages) + 63) // 64), _U64))
    shares = F.col("n") / F.element_at(F.create_map(*(x for c, n in totals.items() for x in (F.lit(c), F.lit(float(n))))), F.col("code"))
    owned = (
        counted.withColumn("share", shares)
        .filter(F.col("share") >= LEAST)
        .groupBy("gram")
        .agg(F.collect_list(F.struct("code", "share")).alias("own"), F.max("share").alias("most"))
        .select("gram", F.expr(f"transform(filter(own, x -> x.share >= {CONTRAST} * most), x -> x.code)").alias("codes"))
        .toArrow()
    )
    grams = owned.column("gram").to_numpy().view(_U64)
    n_slots = 1 << max(6, (SLOTS_FOR_EACH * len(grams)).bit_length())
    slots = np.zeros((n_slots, (len(languages) + 63) // 64), _U64)
    codes = owned.column("codes").combine_chunks()
    member = np.repeat(np.arange(len(grams)), np.diff(codes.offsets.to_numpy()))
    values = codes.flatten().to_numpy().astype(np.int64)
    for slot in _slots(grams, n_slots):
        np.bitwise_or.at(slots, (slot[member], values // 64), _U64(1) << (values % 64).astype(_U64))
    return Filter(languages, slots)


def identify(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replacing columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots))
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*shared.value)
        for batch in slices(batches, text):
            names, score = own.predict(Texts(batch.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"]
            )

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2
