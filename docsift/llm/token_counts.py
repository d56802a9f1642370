"""Word-piece counts by a linear longest-match automaton (operator 10).

Greedy longest match takes, again and again, the longest vocabulary entry that the rest of a word begins with. The
automaton is the vocabulary's trie; every node has a failure link (where matching goes on once the pieces that greedy
matching settles are taken off its string) and the number of pieces taken off on the way, both precomputed. One pass
over a word then adds up these numbers and never builds a piece.

Words are ``[^\\x20\\x09-\\x0D]+`` with one space before them, as byte-level vocabularies mark the start of a word. A word
that the vocabulary cannot cover counts as one unknown piece. All different words of a slice walk together, one byte a
step, so that the inner loop is array code. The tables come from a vocabulary file of fixed size, read by the driver and
broadcast. A null or empty text has 0 pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docsift.llm.words import Hasher, Texts, runs_of, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
UNKNOWN = -1
_HASHES = (Hasher(0), Hasher(1))


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The entries of a file with a base64 entry and its rank on each line."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


@dataclass
class Automaton:
    """The trie's edges (node << 8 | byte -> node), failure links and popped counts; ``count`` walks many words at once."""

    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    popped: np.ndarray

    @classmethod
    def build(cls, vocabulary: Iterable[bytes]) -> Automaton:
        children: list[dict[int, int]] = [{}]
        is_entry, parent, via = [False], [0], [0]
        for entry in sorted(set(vocabulary) - {b""}):
            node = 0
            for byte in entry:
                after = children[node].get(byte)
                if after is None:
                    after = children[node][byte] = len(children)
                    children.append({})
                    is_entry.append(False)
                    parent.append(node)
                    via.append(byte)
                node = after
            is_entry[node] = True
        n = len(children)
        link, popped = [UNKNOWN] * n, [0] * n
        level = list(children[0].values())
        while level:
            below: list[int] = []
            for node in level:
                below.extend(children[node].values())
                if is_entry[node]:  # the whole string is one piece
                    link[node], popped[node] = 0, 1
                    continue
                # settle what the parent settles, then whatever is needed before the last byte can follow
                at, taken = link[parent[node]], popped[parent[node]]
                while at != UNKNOWN and via[node] not in children[at]:
                    taken += popped[at]
                    at = link[at]
                if at != UNKNOWN:
                    link[node], popped[node] = children[at][via[node]], taken
            level = below
        edges = sorted((node << 8 | byte, child) for node, own in enumerate(children) for byte, child in own.items())
        return cls(
            np.array([e[0] for e in edges], np.int64),
            np.array([e[1] for e in edges], np.int32),
            np.array(link, np.int32),
            np.array(popped, np.int32),
        )

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of the words data[start : start + length]."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        at = np.zeros(len(starts), np.int64)
        total = np.zeros(len(starts), np.int64)
        live = len(starts)
        for step in range(int(lengths[0]) if live else 0):
            live = int(np.searchsorted(-lengths[:live], -step, "left"))  # words longer than step
            at[:live], total[:live] = self._step(at[:live], total[:live], data[starts[:live] + step])
        self._finish(at, total)
        out = np.empty(len(order), np.int64)
        out[order] = np.where((at == UNKNOWN) & (lengths > 0), 1, total)
        return out

    def _step(self, at: np.ndarray, total: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, total = at.copy(), total.copy()
        open_ = np.flatnonzero(at != UNKNOWN)
        while len(open_):
            key = at[open_] << 8 | byte[open_]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at[open_[hit]] = self.targets[place[hit]]
            open_ = open_[~hit]
            total[open_] += self.popped[at[open_]]
            at[open_] = self.link[at[open_]]
            open_ = open_[at[open_] != UNKNOWN]
        return at, total

    def _finish(self, at: np.ndarray, total: np.ndarray) -> None:
        open_ = np.flatnonzero(at > 0)
        while len(open_):
            total[open_] += self.popped[at[open_]]
            at[open_] = self.link[at[open_]]
            open_ = open_[at[open_] > 0]


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` (replacing columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(Automaton.build(vocabulary)))
    kept = docs.drop("n_words", "n_tokens")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*shared.value)
        for batch in slices(batches, text):
            texts = Texts(batch.column(text))
            pieces = np.zeros(0, np.int64)
            if len(texts.starts):
                # a space stands at the front of the buffer and replaces the byte before each word in its own copy
                order, heads = runs_of([texts.word_hashes(h) for h in _HASHES])
                one = order[heads]
                lengths = (texts.ends - texts.starts)[one]
                begins = np.cumsum(lengths + 1) - lengths - 1
                data = np.full(int(lengths.sum()) + len(one), 32, np.uint8)
                source = np.repeat(texts.starts[one] - begins - 1, lengths + 1) + np.arange(len(data))
                inside = np.ones(len(data), bool)
                inside[begins] = False
                data[inside] = texts.data[source[inside]]
                counts = automaton.count(data, begins, lengths + 1)
                pieces = np.empty(len(order), np.int64)
                pieces[order] = np.repeat(counts, np.diff(np.append(heads, len(order))))
            total = np.concatenate([[0], np.cumsum(pieces)])
            sums = total[texts.word_offsets[1:]] - total[texts.word_offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts.n_words, pa.int64()), pa.array(sums, pa.int64())],
                [*batch.schema.names, "n_words", "n_tokens"],
            )

    return kept.mapInArrow(run, schema)
