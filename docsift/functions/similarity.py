"""Partial-ratio similarity as an Arrow UDF.

The score is the best ``200 * LCS(short, window) / (len(short) + len(window))``
over the windows of the longer string: every substring of the shorter one's
length and every shorter prefix and suffix.  LCS lengths come from the
bit-vector recurrence of Hyyro (2004), evaluated with numpy for all windows of
all pairs of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64
_CELLS = 1 << 19  # pairs x windows held at a time


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Code points plus one as a zero-padded matrix."""
    out = np.zeros((len(strings), width), dtype=np.uint32)
    for row, text in enumerate(strings):
        out[row, : len(text)] = (
            np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        )
    return out


def _match_masks(terms: list[str], texts: list[str], m: int, width: int) -> np.ndarray:
    """Bit k of cell (row, j) says that term character k equals text character j."""
    term_codes = _codes(terms, m)
    text_codes = _codes(texts, width)
    masks = np.zeros(text_codes.shape, dtype=np.uint64)
    for k in range(m):
        masks |= (text_codes == term_codes[:, k : k + 1]).astype(np.uint64) << np.uint64(k)
    masks[text_codes == 0] = 0
    return masks


def _advance(state: np.ndarray, match: np.ndarray) -> np.ndarray:
    return (state + (state & match)) | (state & ~match)


def _term_inside_text(terms: list[str], texts: list[str], m: int) -> np.ndarray:
    """Best window of each text for a term of length m that is not longer than the text."""
    lengths = np.array([len(t) for t in texts])
    width = int(lengths.max())
    masks = _match_masks(terms, texts, m, width)
    # Padding matches nothing, so windows hanging over an edge are the prefixes and suffixes.
    padded = np.pad(masks, ((0, 0), (m - 1, m - 1)))
    starts = np.arange(-(m - 1), width)
    ones = np.uint64((1 << m) - 1)
    state = np.full((len(texts), len(starts)), ~np.uint64(0), dtype=np.uint64)
    for step in range(m):
        state = _advance(state, padded[:, step : step + len(starts)])
    lcs = np.bitwise_count(~state & ones).astype(np.int64)
    size = np.minimum(starts + m, lengths[:, None]) - np.maximum(starts, 0)
    return np.where(size > 0, 200.0 * lcs / (m + np.maximum(size, 1)), 0.0).max(axis=1)


def _text_inside_term(terms: list[str], texts: list[str], m: int, n: int) -> np.ndarray:
    """Best window of each term (length m) for texts of one length n <= m."""
    masks = _match_masks(terms, texts, m, n)
    starts = range(-(n - 1), m)
    bounds = [(max(s, 0), min(s + n, m)) for s in starts]
    window = np.array([((1 << hi) - (1 << lo)) for lo, hi in bounds], dtype=np.uint64)
    size = np.array([hi - lo for lo, hi in bounds])
    state = np.full((len(texts), len(bounds)), ~np.uint64(0), dtype=np.uint64)
    for step in range(n):
        state = _advance(state, masks[:, step : step + 1] & window)
    lcs = np.bitwise_count(~state & window).astype(np.int64)
    return (200.0 * lcs / (n + size)).max(axis=1)


def _lcs(short: str, window: str) -> int:
    state = full = (1 << len(short)) - 1
    position: dict[str, int] = {}
    for k, ch in enumerate(short):
        position[ch] = position.get(ch, 0) | 1 << k
    for ch in window:
        match = position.get(ch, 0)
        state = (state + (state & match)) | (state & ~match)
    return (~state & full).bit_count()


def _long_pair(term: str, text: str) -> float:
    """Same score for terms that do not fit a machine word."""
    short, long = sorted((term, text), key=len)
    m = len(short)

    def best(a: str, b: str) -> float:
        spans = ((max(s, 0), min(s + m, len(b))) for s in range(-(m - 1), len(b)))
        return max(200.0 * _lcs(a, b[lo:hi]) / (m + hi - lo) for lo, hi in spans)

    score = best(short, long)
    return max(score, best(long, short)) if len(long) == m else score


def partial_ratios(terms: list[str], texts: list[str]) -> np.ndarray:
    """Score of each (term, text) pair; 0 where exactly one is empty."""
    m = np.array([len(t) for t in terms], dtype=np.int64)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros(len(terms))
    out[(m == 0) & (n == 0)] = 100.0

    def blocks(rows: np.ndarray, windows: int) -> Iterator[np.ndarray]:
        step = max(1, _CELLS // windows)
        for at in range(0, len(rows), step):
            yield rows[at : at + step]

    for size in np.unique(m[(m > 0) & (m <= _WORD)]):
        size = int(size)
        rows = np.flatnonzero((m == size) & (n >= size))
        rows = rows[np.argsort(n[rows], kind="stable")]
        # Texts of like length share a block, so that padding stays small.
        edges = np.flatnonzero(np.diff(n[rows].astype(np.float64) // 16)) + 1
        for part in np.split(rows, edges):
            if len(part):
                for block in blocks(part, int(n[part].max()) + size):
                    out[block] = _term_inside_text(
                        [terms[i] for i in block], [texts[i] for i in block], size
                    )
        for length in np.unique(n[(m == size) & (n > 0) & (n <= size)]):
            rows = np.flatnonzero((m == size) & (n == length))
            for block in blocks(rows, size + int(length)):
                score = _text_inside_term(
                    [terms[i] for i in block], [texts[i] for i in block], size, int(length)
                )
                out[block] = np.maximum(out[block], score)
    for i in np.flatnonzero((m > _WORD) & (n > 0)):
        out[i] = _long_pair(terms[i], texts[i])
    return out


def _score_batch(term: pd.Series, text: pd.Series) -> pd.Series:
    wanted = np.flatnonzero((term.notna() & text.notna()).to_numpy())
    out = np.full(len(term), np.nan)
    if len(wanted):
        pairs = pd.DataFrame({"term": term.to_numpy()[wanted], "text": text.to_numpy()[wanted]})
        code = pairs.groupby(["term", "text"], sort=False).ngroup().to_numpy()
        distinct = pairs.drop_duplicates()
        out[wanted] = partial_ratios(distinct["term"].tolist(), distinct["text"].tolist())[code]
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def partial_ratio(term: Column, text: Column) -> Column:
    """Similarity 0..100 of two strings; NULL in, NULL out.

    Spark evaluates a UDF for every row, also under ``when``: pass NULL for the
    rows that do not need the score and they cost next to nothing.  Declared
    nondeterministic so that a filter on the score is not pushed below it as a
    second evaluation.
    """
    return F.pandas_udf(_score_batch, T.DoubleType()).asNondeterministic()(term, text)
