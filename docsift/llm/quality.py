"""Quality rules with thresholds learned from the corpus (operator 5).

``measure`` adds counts to every text, ``thresholds`` sketches the distribution of each rate per language and source
(``percentile_approx``: a mergeable quantile sketch, combined on the map side, so that no group is gathered), and
``judge`` joins the two. A rate is too high when it lies above q75 + reach * (q75 - q25) + slack: the fence moves with
the group, the reach keeps ordinary documents of a wide group, and the slack keeps those of a group without spread.
The mean length of words has a fence on both sides.

Nulls: a null text has no words; null lang and null source are groups like any other. Groups in which every document
failed the base rules have no thresholds and need none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.storage import stored
from docsift.llm.words import Hasher, Texts, covered, digests, runs_of, slices

WINDOW = 8
MIN_WORDS = 20
REACH = 3.0
ACCURACY = 10_000
#: rate -> slack
RATES = {"symbol_rate": 0.05, "dup_line_rate": 0.5, "repeat_rate": 0.25, "word_length": 3.0}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_PREFIX = "_q_"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HASHES = (Hasher(0), Hasher(1))


def counts_of(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of every text of a batch."""

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[texts.offsets[1:]] - total[texts.offsets[:-1]]

    def extra(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted order, and for each sorted place whether the one before or after it is equal in the same document."""
        order, heads = runs_of([docs, *keys])
        before = np.ones(len(order), bool)
        before[heads] = False
        return order, before, np.append(before[1:], np.zeros(min(1, len(order)), bool))

    out = {"n_words": texts.n_words}
    out["word_chars"] = per_doc(texts.in_word & ((texts.data & 0xC0) != 0x80))
    out["n_symbols"] = per_doc(_SYMBOL[texts.data])
    starts, ends, docs = texts.lines()
    words = np.concatenate([[0], np.cumsum(texts.in_word)])
    some = words[ends] > words[starts]
    starts, ends, docs = starts[some], ends[some], docs[some]
    order, before, _ = extra(list(digests(texts.data, starts, ends).T), docs)
    out["n_lines"] = np.bincount(docs, minlength=texts.n)
    out["n_dup_lines"] = np.bincount(docs[order][before], minlength=texts.n)
    begin = texts.windows(WINDOW)
    spans = [h.ranges(h.prefix(texts.word_hashes(h)), begin, begin + WINDOW) for h in _HASHES]
    doc = texts.doc_of_words()
    order, before, after = extra(spans, doc[begin])
    repeated = covered(len(texts.starts), begin[order][before | after], WINDOW)
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=texts.n)
    return out


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs``, and the counts; existing columns of the same names are replaced."""
    names = [prefix + c for c in COUNTS]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = counts_of(Texts(batch.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(found[c], pa.int64()) for c in COUNTS)], [*batch.schema.names, *names]
            )

    return kept.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    n, repeat = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > 30 * n)


def rate(name: str, prefix: str = "") -> Column:
    def ratio(over: str, under: str) -> Column:
        return F.col(prefix + over).cast("double") / F.greatest(F.lit(1), F.col(prefix + under))

    return {
        "symbol_rate": ratio("n_symbols", "word_chars"),
        "dup_line_rate": ratio("n_dup_lines", "n_lines"),
        "repeat_rate": ratio("n_repeat_words", "n_words"),
        "word_length": ratio("word_chars", "n_words"),
    }[name]


def thresholds(measured: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """One row for each group: ``<rate>_low`` and ``<rate>_high``, from documents that pass the base rules."""
    quartiles = [F.percentile_approx(rate(r, prefix), F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(r) for r in RATES]
    groups = measured.filter(~base_failed(prefix)).groupBy(*keys).agg(*quartiles)
    fences = []
    for r, slack in RATES.items():
        low, high = F.col(r)[0], F.col(r)[1]
        fences.append((low - REACH * (high - low) - slack).alias(f"{r}_low"))
        fences.append((high + REACH * (high - low) + slack).alias(f"{r}_high"))
    return groups.select(*keys, *fences)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: bool = True) -> DataFrame:
    """``docs`` with ``_q_`` counts, ``_q_base_failed`` and ``_q_kept``, which replace columns of these names.

    Texts are measured once and the counts stored, with all columns of ``docs``, or without the text if not ``carry``.
    """
    docs = docs.drop(*(c for c in docs.columns if c.startswith(_PREFIX)))
    measured = measure(docs, text, _PREFIX)
    measured = stored(measured if carry else measured.drop(text))
    limits = thresholds(measured, [lang, source], _PREFIX)
    limits = limits.select(*(F.col(f"`{c}`").alias(f"{_PREFIX}t_{c}") for c in limits.columns))
    on = F.col(f"`{lang}`").eqNullSafe(F.col(f"`{_PREFIX}t_{lang}`")) & F.col(f"`{source}`").eqNullSafe(F.col(f"`{_PREFIX}t_{source}`"))
    inside = F.lit(True)
    for r in RATES:
        inside &= rate(r, _PREFIX) <= F.col(f"{_PREFIX}t_{r}_high")
    inside &= rate("word_length", _PREFIX) >= F.col(f"{_PREFIX}t_word_length_low")
    failed = base_failed(_PREFIX)
    joined = measured.join(limits, on, "left").withColumn(f"{_PREFIX}base_failed", failed)
    return joined.withColumn(f"{_PREFIX}kept", ~failed & F.coalesce(inside, F.lit(True))).drop(*limits.columns)


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    own = docs.select(text, lang, source, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    kept = judge(own.select(*(c for c in own.columns if c == "all"), F.col(text).alias("t"), F.col(lang).alias("l"), F.col(source).alias("s")), "t", "l", "s", carry=False)
    return kept.filter(f"{_PREFIX}kept").select(*(F.col("all").getField(c).alias(c) for c in docs.columns))
