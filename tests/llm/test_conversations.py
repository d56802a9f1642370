"""Conversation repair against a plain dynamic program, in one segment and in many."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from docsift.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, digest int, at string"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired rows) of (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                new = "a" if state == "u" else "u"
                found = (cost + 3, audit + "I", [*out, ("user" if new == "u" else "assistant", "")])
                if new not in best or found[:2] < best[new][:2]:
                    best[new] = found
        return best

    best = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        now = {}
        for state, (cost, audit, out) in best.items():
            moves = [(state, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                new = "a" if state == "u" else "u"
                moves.append((new, cost + 3 + more, audit + "R", [*out, ("user" if new == "u" else "assistant", text)]))
                if (state, role[:1]) in after:
                    moves.append((after[state, role[:1]], cost + more, audit + "K", [*out, (role, text)]))
            for to, *found in moves:
                if to not in now or found[:2] < list(now[to][:2]):
                    now[to] = tuple(found)
        best = inserted(now)
    cost, audit, out = min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])
    return [faults.count(x) for x in ("blank", "duplicate", "truncated")] + [illegal, cost, audit, out]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    roles, texts = ["system", "user", "assistant", "tool", "", "ux", None], ["Yes.", "No", "", " \n", None, "Why?", "é!", "Go on. \t", "a\x00b."]
    out = []
    for conv in [None, *range(60)]:
        n = 90 if conv == 7 else draw.randint(1, 14)
        for i in range(n):
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[i % 2]
            text = draw.choice(texts) if draw.random() < 0.5 else f"Part {draw.randint(0, 40)}" + draw.choice([".", "", "?"])
            out.append((conv, draw.choice([None, i, i, i, 3]), role, text, "clash", 0, "clash"))
    out += [(100, t, ("user", "assistant")[t % 2], f"Long {t}" + ".?,"[t % 3], "", 0, "") for t in range(700)] + [(101, 0, "user", "same.", "", 0, "")] * 40
    draw.shuffle(out)
    return out


def ordered(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2]))) for c, own in groups.items()}


@pytest.mark.parametrize(("batch", "parts"), [(10_000, 1), (7, 5), (1, 2)])
def test_repair_against_a_plain_program(spark, rows, batch, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = conversations.repair(spark.createDataFrame(rows, SCHEMA), parts)
        report = {r.conv_id: r for r in found.report.collect()}
        sums = {r.key: r.sha256 for r in conversations.digests(found.rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = ordered(rows)
    assert len(report) == len(groups)
    for conv, own in groups.items():
        turns = {t for t, *_ in own if t is not None}
        *wanted, out = plain([r[1:] for r in own])
        r = report[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *wanted]
        text = "\n".join(f"{role}:{text}" for role, text in out)
        assert sums.get("" if conv is None else f"={conv}", hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()


def test_every_small_conversation():
    tables = conversations.Tables()
    draw = random.Random(1)
    names = ["s", "u", "a", "t"]
    for _ in range(3000):
        symbols = [draw.randrange(9) for _ in range(draw.randint(0, 11))]
        rows = [(names[x % 4] if x < 8 else "u", "" if x == 8 else f"{i}" + "." * (x < 4)) for i, x in enumerate(symbols)]
        *_, cost, audit, out = plain(rows)
        letters, state, kept = tables.trace(bytes(symbols), 0, 0, True)
        _, _, before, total = tables.back(bytes(symbols), 0)
        assert (letters, total + tables.vectors[before][0]) == (audit, cost)
        assert [(role or rows[i][0], rows[i][1] if i >= 0 else "") for i, role in kept] == out


def test_damage_of_the_query(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text. {t}? End!") for c in range(30) for t in range(6)] + [(None, None, None, None), (77, None, "user", "A.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    wanted = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        wanted += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, queries.damaged_conversations(spark, str(tmp_path)).collect()), key=key) == sorted(wanted, key=key)
    assert {r.conv_id for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()} == {*range(30), None, 77}


def test_empty_table(spark):
    found = conversations.repair(spark.createDataFrame([], SCHEMA))
    assert found.report.count() == 0 and found.rows.count() == 0
