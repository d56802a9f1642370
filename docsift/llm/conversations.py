"""Repair of conversations by cheapest edits, with Four-Russians block tables (operator 12).

The roles of a repaired conversation begin with ``(s?(ua)+)?``: nothing, or perhaps the system, then user and assistant in
turns. Edits: keep a row (0), give it the role user or assistant (``REROLE``), delete it (``DELETE``; blank rows and repeats
must go), insert an empty row of user or assistant anywhere (``INSERT``); a truncated row that stays costs ``TRUNCATED``
more. The cheapest edits are returned, and of several the one whose letters (D, I, K, R, in order) are the least.

States are what the roles so far end in: nothing, system, user, assistant. What the rest of a conversation costs from each
state is a vector of four small numbers; less its least value it is one of a few dozen (``Tables``, found by search). For
every block of ``BLOCK`` row symbols and every vector behind it, the vector before it and the difference are computed once.
So a conversation is crossed backward, a block at a time, by lookups. Then each block is expanded backward from the
vector behind it, and read forward: an edit is taken if it costs exactly what the vectors differ by, the least letter
first. What one block with one vector behind it and one state before it gives is computed once per task.

On Spark: rows are reduced to a digest and a symbol; repeats are found by an aggregate; the slim rows are range-partitioned and
sorted by conversation and turn, so that a very long conversation lies in many tasks, and cut into segments, at the ends of
Arrow batches at least. A conversation of one segment is solved where it lies. Of those with more, each segment sends the vector
before it for each one behind it (a few dozen bytes), which are chained; then, for each state before it, the state behind it, which
are chained too. Texts are joined to the rows that stay at the end; no task holds the rows or texts of a conversation.

``repair`` returns ``report`` (one row for each conversation), ``rows`` (the repaired conversations: ``conv_id``, ``segment`` and
``place``, by which they are ordered, ``role``, ``text``). Null roles and texts are read as one space; a null ``conv_id`` is a
conversation like any other; null turns come first, equal turns in order of role and the digest of the text. Rows that repeat are
duplicates. Other columns are not read. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.storage import stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FORCED, PAD = 8, 9  # symbols 0-7: initial (s, u, a, other), and 4 more if truncated
SYMBOLS = 10
#: state after a row of this initial, if it may follow
_AFTER = [{NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {}]
#: what an inserted or changed row becomes
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 20


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of a row, the least letter first."""
    out = [("D", DELETE, state)]
    if symbol < FORCED:
        more = TRUNCATED * (symbol >= 4)
        if state in _AFTER[symbol % 4]:
            out.append(("K", more, _AFTER[symbol % 4][state]))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


def _inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
    for _ in range(3):
        costs = tuple(min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs))
    return costs


def _before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs of the rest before a row, from those behind it."""
    if symbol == PAD:
        return costs
    return _inserted(tuple(min(c + costs[to] for _, c, to in _moves(symbol, q)) for q in range(4)))


#: the end: nothing and assistant may be last
END = _inserted((0, _FAR, _FAR, 0))


class Tables:
    """Normalised vectors, and for each and each block of symbols the vector before it and the difference."""

    def __init__(self) -> None:
        self.vectors = [tuple(c - min(END) for c in END)]
        number = {self.vectors[0]: 0}
        one, more = [], []
        for vector in self.vectors:  # grows while it is read
            one.append([])
            more.append([])
            for symbol in range(SYMBOLS):
                found = _before(symbol, vector)
                low = min(found)
                found = tuple(c - low for c in found)
                if found not in number:
                    number[found] = len(self.vectors)
                    self.vectors.append(found)
                one[-1].append(number[found])
                more[-1].append(low)
        single, low = np.array(one), np.array(more)
        n = len(self.vectors)
        to, cost = np.repeat(np.arange(n)[:, None], 1, axis=1), np.zeros((n, 1), np.int64)
        for _ in range(BLOCK):  # one symbol more at the front
            cost = np.concatenate([cost + low[to, s] for s in range(SYMBOLS)], axis=1)
            to = np.concatenate([single[to, s] for s in range(SYMBOLS)], axis=1)
        self.to, self.cost = to, cost
        self._pieces: dict[tuple[int, int, int], tuple[str, int, tuple]] = {}

    @staticmethod
    def codes(symbols: bytes) -> np.ndarray:
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, PAD, np.int64)
        padded[: len(symbols)] = np.frombuffer(symbols, np.uint8)
        return padded.reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def cross(self, symbols: bytes) -> np.ndarray:
        """For every vector behind the symbols: the vector before them."""
        at = np.arange(len(self.vectors))
        for code in self.codes(symbols)[::-1].tolist():
            at = self.to[at, code]
        return at

    def back(self, symbols: bytes, behind: int) -> tuple[list[int], list[int], int, int]:
        """The blocks, the vector behind each, the one before all, and what they cost besides."""
        codes = self.codes(symbols).tolist()
        vectors, total = [0] * len(codes), 0
        for i in range(len(codes) - 1, -1, -1):
            vectors[i] = behind
            total += int(self.cost[behind, codes[i]])
            behind = int(self.to[behind, codes[i]])
        return codes, vectors, behind, total

    def piece(self, code: int, behind: int, state: int) -> tuple[str, int, tuple]:
        """(letters, state after, rows that stay) of a block; a row is (place in the block or -1, new role or None)."""
        key = (code, behind, state)
        if key not in self._pieces:
            symbols = [code // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
            costs = [self.vectors[behind]]
            for symbol in reversed(symbols):
                costs.append(_before(symbol, costs[-1]))
            costs.reverse()
            letters, kept = "", []
            for i, symbol in enumerate(symbols):
                while symbol != PAD:
                    letter, cost, to = min(
                        m
                        for m in [*_moves(symbol, state), ("I", INSERT, _NEXT[state])]
                        if m[1] + (costs[i] if m[0] == "I" else costs[i + 1])[m[2]] == costs[i][state]
                    )
                    letters, state = letters + letter, to
                    if letter != "D":
                        kept.append((-1 if letter == "I" else i, None if letter == "K" else _ROLES[to]))
                    if letter != "I":
                        break
            self._pieces[key] = letters, state, tuple(kept)
        return self._pieces[key]

    def closing(self, state: int) -> tuple[str, list[str]]:
        """The inserts after the last row."""
        return ("", []) if state in (NOTHING, ASSISTANT) else ("I", ["assistant"]) if state == USER else ("II", ["user", "assistant"])

    def trace(self, symbols: bytes, behind: int, state: int, last: bool) -> tuple[str, int, list[tuple]]:
        """Letters, the state after, and the rows that stay."""
        codes, vectors, _, _ = self.back(symbols, behind)
        letters, kept = [], []
        for i, (code, vector) in enumerate(zip(codes, vectors, strict=True)):
            piece, state, rows = self.piece(code, vector, state)
            letters.append(piece)
            kept += [(place if place < 0 else i * BLOCK + place, role) for place, role in rows]
        if last:
            piece, roles = self.closing(state)
            letters.append(piece)
            kept += [(-1, role) for role in roles]
        return "".join(letters), state, kept


@dataclass
class Repaired:
    report: DataFrame
    rows: DataFrame


def key_of(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _slim(rows: DataFrame) -> DataFrame:
    """``key``, ``turn``, ``role``, ``digest`` of the text, ``initial`` (0 to 3), ``blank``, ``cut`` (truncated), ``again``."""
    found = rows.select(
        key_of(F.col("conv_id")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.sha2("text", 256).alias("digest"),
        (F.instr(F.lit("sua"), F.when(F.col("role") == "", F.lit("?")).otherwise(F.substring("role", 1, 1))) - 1).alias("at"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    ).withColumn("initial", F.when(F.col("at") < 0, 3).otherwise(F.col("at")).cast("int"))
    early = F.coalesce("turn", F.lit(-(1 << 63)))
    seen = found.groupBy("key", "role", "digest").agg(F.min(early).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = found.join(seen, ["key", "role", "digest"], "left")
    return again.select("key", "turn", "role", "digest", "initial", "blank", "cut", F.coalesce(early > F.col("first"), F.lit(False)).alias("again"))


SEGMENTS = """key string, at long, symbols binary, roles array<string>, digests array<string>, blank long, duplicate long,
    truncated long, illegal long, first int, last int, first_turn long, last_turn long, turns long, least long, most long"""


def _segments(slim: DataFrame, parts: int) -> DataFrame:
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest"]
    names = [x.split()[0] for x in SEGMENTS.replace("\n", " ").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {c: batch.column(c).to_pylist() for c in ("key", "turn", "role", "digest")}
            initial = batch.column("initial").to_numpy()
            blank, cut, again = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("blank", "cut", "again"))
            for i, now in enumerate(zip(*columns.values(), strict=True)):  # copies of one turn follow each other
                again[i] |= now == before
                before = now
            again &= ~blank
            cut &= ~blank & ~again
            symbols = np.where(blank | again, FORCED, initial + 4 * cut).astype(np.uint8)
            key, turn = columns["key"], columns["turn"]
            heads = [0, *(i for i in range(1, n) if key[i] != key[i - 1])]
            legal = np.isin(initial[:-1] * 4 + initial[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
            out: list[tuple] = []
            for a, b in zip(heads, [*heads[1:], n], strict=True):
                known = [t for t in turn[a:b] if t is not None]
                out.append(
                    (key[a], at + a, symbols[a:b].tobytes(), columns["role"][a:b], columns["digest"][a:b])
                    + tuple(int(x[a:b].sum()) for x in (blank, again, cut))
                    + (int((~legal[a : b - 1]).sum()), int(initial[a]), int(initial[b - 1]))
                    + ((known[0], turn[b - 1], len(set(known)), known[0], known[-1]) if known else (None, None, 0, None, None))
                )
            at += n
            kinds = ("string", "int64", "binary", "list<string>", "list<string>", *["int64"] * 4, "int32", "int32", *["int64"] * 5)
            kind = lambda k: pa.list_(pa.string()) if k.startswith("list") else pa.type_for_alias(k)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind(k)) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, SEGMENTS)


def _chain(table: pa.Table, name: str, start: int, backward: bool) -> pa.Table:
    """Follows each segment's map from what it is given to what it gives, and returns what each is given."""
    order = np.argsort(table.column("at").to_numpy())
    maps = table.column("map").to_pylist()
    given, now = np.zeros(len(order), np.int32), start
    for i in order[::-1] if backward else order:
        given[i] = now
        now = maps[i][now]
    return pa.table({"key": table.column("key"), "at": table.column("at"), name: pa.array(given)})


def repair(rows: DataFrame, parts: int | None = None) -> Repaired:
    """The report and the repaired rows of ``conv_id``, ``turn``, ``role``, ``text``."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    segments = stored(_segments(_slim(rows), parts))
    several = segments.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("final"))
    split = stored(segments.join(several.filter("n > 1").select("key"), "key", "left_semi").select("key", "at", "symbols"))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            maps = [tables.cross(s).tolist() for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(maps, pa.list_(pa.int32()))], ["key", "at", "map"])

    maps = split.mapInArrow(crossed, "key string, at long, map array<int>")
    behind = stored(maps.groupBy("key").applyInArrow(lambda t: _chain(t, "behind", 0, True), "key string, at long, behind int"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            pairs = zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist(), strict=True)
            maps = [[tables.trace(s, b, q, False)[1] for q in range(4)] for s, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(maps, pa.list_(pa.int32()))], ["key", "at", "map"])

    states = split.join(behind, ["key", "at"]).mapInArrow(passed, "key string, at long, map array<int>")
    entered = states.groupBy("key").applyInArrow(lambda t: _chain(t, "state", NOTHING, False), "key string, at long, state int")
    links = behind.join(entered, ["key", "at"])
    whole = segments.join(several.select("key", "final"), "key").join(links, ["key", "at"], "left")
    whole = whole.withColumns({"behind": F.coalesce("behind", F.lit(0)), "state": F.coalesce("state", F.lit(NOTHING)), "is_last": F.col("at") == F.col("final")})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("audit", "cost", "old_role", "digest", "new_role")}
            taken = ("symbols", "behind", "state", "is_last", "roles", "digests", "is_first")
            for symbols, behind, state, last, roles, digests, first in zip(*(batch.column(c).to_pylist() for c in taken), strict=True):
                letters, _, kept = tables.trace(symbols, behind, state, last)
                _, _, before, cost = tables.back(symbols, behind)
                out["audit"].append(letters)
                out["cost"].append(cost + (tables.vectors[before][NOTHING] if first else 0))
                out["old_role"].append([roles[i] if i >= 0 else None for i, _ in kept])
                out["digest"].append([digests[i] if i >= 0 else None for i, _ in kept])
                out["new_role"].append([role for _, role in kept])
            kinds = (pa.string(), pa.int64(), *[pa.list_(pa.string())] * 3)
            columns = [pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), *columns], ["key", "at", *out])

    first = several.select("key").join(segments.groupBy("key").agg(F.min("at").alias("start")), "key")
    whole = whole.join(first, "key").withColumn("is_first", F.col("at") == F.col("start"))
    solved = stored(
        whole.mapInArrow(traced, "key string, at long, audit string, cost long, old_role array<string>, digest array<string>, new_role array<string>")
    )

    names = rows.groupBy(key_of(F.col("conv_id")).alias("key")).agg(F.first("conv_id").alias("conv_id"))
    by_at = Window.partitionBy("key").orderBy("at")
    joint = segments.select("key", "at", "blank", "duplicate", "truncated", "illegal", "first", "first_turn", "turns", "least", "most",
        F.lag("last").over(by_at).alias("l"), F.lag("last_turn").over(by_at).alias("t"))
    legal = (F.col("l") * 4 + F.col("first")).isin(1, 6, 9)
    counts = joint.groupBy("key").agg(
        (F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - F.coalesce((F.col("t") == F.col("first_turn")).cast("int"), F.lit(0)))).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        F.sum(F.col("illegal") + F.coalesce((~legal).cast("int"), F.lit(0))).alias("illegal"),
    )
    audits = solved.groupBy("key").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    report = names.join(counts, "key").join(audits, "key")
    report = report.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    each = solved.select("key", "at", F.posexplode(F.arrays_zip("old_role", "digest", "new_role")).alias("place", "x"))
    each = each.select("key", F.col("at").alias("segment"), "place", F.col("x.old_role").alias("role"), F.col("x.digest").alias("digest"), F.col("x.new_role").alias("new_role"))
    texts = rows.select(key_of(F.col("conv_id")).alias("key"), "role", F.sha2("text", 256).alias("digest"), "text")
    texts = texts.groupBy("key", "role", "digest").agg(F.min("text").alias("text"))
    old = each.filter("digest is not null").join(texts, ["key", "role", "digest"])
    new = each.filter("digest is null").withColumn("text", F.lit(""))
    repaired = reduce(DataFrame.unionByName, [old, new]).select("key", "segment", "place", F.coalesce("new_role", "role").alias("role"), "text")
    return Repaired(report, repaired)


def digests(repaired: DataFrame) -> DataFrame:
    """``key`` and the SHA-256 of the rows' ``role:text``, joined by line breaks; rows pass by in order, none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if key != now:
                    if total is not None:
                        done.append((now, total.hexdigest()))
                    now, total = key, hashlib.sha256()
                else:
                    total.update(b"\n")
                total.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["key", "sha256"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.hexdigest()])], ["key", "sha256"])

    dealt = repaired.repartition("key").sortWithinPartitions("key", "segment", "place")
    return dealt.mapInArrow(run, "key string, sha256 string")
