"""The operators against plain versions, on small tables with nulls, ties, copies, odd texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from docsift.llm import (
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    repeated_bytes,
    repeated_words,
    token_counts,
    url_rules,
)
from docsift.llm.components import components
from docsift.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdeéß", k=draw.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return "".join(w + draw.choice([" ", " ", " ", "\n", "\t"]) for w in draw.choices(vocabulary, k=n))

    base, passage, line = prose(150), prose(60), prose(9).replace("\n", " ")
    texts = [None, "", " \n\t", "!?", "a", "Mot", base, base, base, prose(4000), "ab " * 500, "x" * 900, passage, "a\n\na\n"]
    texts += [base.replace(vocabulary[i], vocabulary[i + 1]) for i in range(6)]
    texts += [prose(draw.randint(5, 90)) + passage + prose(draw.randint(0, 90)) for _ in range(5)]
    texts += [line + "\n" + prose(draw.randint(1, 120)) for _ in range(20)] + ["# $ % " * 60]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [
        (i * 3, texts[k], draw.choice(["en", "de", None]), draw.choice(["s1", "s2", None]), len(texts[k] or ""))
        for i, k in enumerate(order)
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("mine")).withColumn("places", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_words(docs, rows, empty):
    first = {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc_id)
    got = {r.doc_id: r for r in repeated_words.remove_repeats(docs).collect()}
    removed = 0
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < doc_id for k in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        removed += len(gone)
        r = got[doc_id]
        assert (r.n_words, r.n_removed, r.kept, r.kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert removed and len(got) == len(rows)
    assert repeated_words.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("crowd", [repeated_bytes.CROWD, 2])
def test_repeated_bytes(docs, rows, empty, crowd, monkeypatch):
    monkeypatch.setattr(repeated_bytes.repeated_strings, "__defaults__", (crowd,))
    seen = Counter()
    for _, text, *_ in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + 200] for i in range(len(raw) - 199))
    got = {r.doc_id: r for r in repeated_bytes.remove_repeats(docs).collect()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(raw), sum(gone), spans, kept)
    assert repeated_bytes.remove_repeats(empty).count() == 0


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(500):
        text = [draw.randint(1, draw.choice([1, 2, 5])) for _ in range(draw.randint(0, 40))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    table = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in repeated_words.remove_repeats(table).collect())
    assert got == [("1", 0), ("1", 0), ("2", 80), ("None", 0)]
    assert {(r.doc_id, r.n_removed > 0) for r in repeated_bytes.remove_repeats(table).collect()} == {(None, False), (1, True), (2, True)}
    assert ngram_join.keep_one(table).count() == 3
    assert line_dedup.deduplicate(table).count() == 4


def test_ngram_join(docs, rows, empty):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    links = Counter()

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in ngram_join.link(docs).collect()}
    assert {d: (find(d), links[d]) for d in sets} == {d: (r.class_id, r.n_links) for d, r in got.items()}
    assert sum(links.values()) > 4
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {find(d) for d in sets}
    assert ngram_join.link(empty).count() == 0


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    table = spark.createDataFrame([(i, " ".join(base[: 60 + i] + [f"z{i}"] + base[61 + i :])) for i in range(23)], "doc_id long, text string")
    got = ngram_join.link(table).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {22}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (50, 40), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40}


def _lcs(old, new):
    """Places in ``new`` of a longest common subsequence."""
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def _plain_patience(old, new):
    """How many lines of ``new`` patience diff aligns: common ends, unique lines in the longest order, then between them."""
    n = 0
    while old and new and old[0] == new[0]:
        old, new, n = old[1:], new[1:], n + 1
    while old and new and old[-1] == new[-1]:
        old, new, n = old[:-1], new[:-1], n + 1
    unique = [x for x in new if old.count(x) == 1 == new.count(x)]
    if not unique:
        return n + _lcs(old, new)
    places = [old.index(x) for x in unique]
    chains = [[]]
    for i, p in enumerate(places):
        chains.append(max((c for c in chains if not c or places[c[-1]] < p), key=len) + [i])
    chain = max(chains, key=len)
    at, at_new = 0, 0
    for i in chain:
        p, q = places[i], new.index(unique[i])
        n += 1 + _plain_patience(old[at:p], new[at_new:q])
        at, at_new = p + 1, q + 1
    return n + _plain_patience(old[at:], new[at_new:])


def _plain_dedup(rows, rare):
    """By (id, text): for each partner, how many lines are aligned; and which lines may be deleted."""
    versions = {(d, t) for d, t in rows if d is not None}
    lines = {(d, t): [x for x in (t or "").split("\n") if WORD.search(x)] for d, t in versions}
    first = {}
    for d, t in versions:
        first[t] = min(d, first.get(t, d))
    holders = defaultdict(set)
    for (d, t), own in lines.items():
        if first[t] == d:
            for x in own:
                holders[x].add((d, t))
    out = {}
    for (d, t), own in lines.items():
        if first[t] < d:
            out[d, t] = None
            continue
        shared = defaultdict(set)
        for x in set(own):
            earlier = {h for h in holders[x] if h[0] < d}
            if earlier and len(holders[x]) > rare:
                earlier = {min(holders[x], key=lambda h: h[0])}
            for h in earlier:
                shared[h].add(x)
        out[d, t] = [_plain_patience([x for x in lines[h] if x in both], [x for x in own if x in both]) for h, both in shared.items()]
    return lines, out


@pytest.mark.parametrize("rare", [line_dedup.RARE, 2])
def test_line_dedup(spark, rows, empty, rare):
    draw = random.Random(11)
    texts = [(d, t) for d, t, *_ in rows]
    pool = [f"line {i}" for i in range(12)]
    texts += [(1000 + i, "\n".join(draw.choices(pool, k=draw.randint(1, 9)))) for i in range(40)]
    texts += [(1000, "other\nversion"), (2000, "other\nversion\nline 3"), (2000, None), (None, "line 1"), (1001, texts[-39][1])]
    table = spark.createDataFrame([(d, t, "mine", "mine", 0) for d, t in texts], "doc_id long, text string, v string, c0 string, n_lines int")
    lines, wanted = _plain_dedup(texts, rare)
    got = line_dedup.deduplicate(table, rare).collect()
    assert len(got) == len(texts) and got[0].v == got[0].c0 == "mine"
    left = Counter((r.doc_id, r.n_lines, r.n_removed) for r in got)
    several = total = 0
    for d, t in texts:
        n = len(lines.get((d, t), [x for x in (t or "").split("\n") if WORD.search(x)]))
        if d is None:
            assert left[None, n, 0]
            continue
        found = wanted[d, t]
        counts = {n} if found is None else {sum(found)} if len(found) < 2 else set(range(max(found), min(n, sum(found)) + 1))
        several += found is not None and len(found) > 1
        total += max(counts)
        assert any(left[d, n, k] for k in counts), (d, t, counts)
    assert total > 50 and several > 5
    assert line_dedup.deduplicate(empty).count() == 0


def test_no_copy_loses_its_link(spark):
    assert _without_shared(spark, ["x\ny", "y\nx", "y\nx"])[2] == ""
    assert _without_shared(spark, ["x\ny", "a\ny\nx", "y\nx\nb"])[2] == "b"


def test_patience_aligns_passages_held_twice(spark):
    assert line_dedup.patience([7, 1, 2, 8], [3, 1, 2, 4, 1, 2, 5]) in ([1, 2], [4, 5])
    assert line_dedup.patience([3, 1, 2, 4, 1, 2, 5], [7, 1, 2, 8, 9, 1, 2, 6]) == [1, 2, 5, 6]
    assert _without_shared(spark, ["x\np one\np two\ny", "a\np one\np two\nb\np one\np two\nc"])[1] == "a\np one\np two\nb\nc"
    draw = random.Random(4)
    for _ in range(200):
        old, new = (draw.choices(range(draw.randint(1, 9)), k=draw.randint(0, 25)) for _ in range(2))
        best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, x in enumerate(old):
            for j, y in enumerate(new):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for table_bits in (line_dedup.TABLE_BITS, 6):
            places = sorted(line_dedup.common(old, new, table_bits))
            at = iter(old)
            assert len(set(places)) == len(places) == best[-1][-1] and all(new[j] in at for j in places)


def _without_shared(spark, texts):
    """What is left of the texts, by place."""
    return [r.text for r in line_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_lines_of_many_documents_pair_beside_rare_ones(spark):
    texts = [f"hot one\nown {i}" for i in range(30)] + [f"hot two\nown {i}" for i in range(30, 61)]
    texts += ["rare\nown 61", "x\nhot one\ny\nhot two\nz\nrare"]
    assert _without_shared(spark, texts)[-1] == "x\ny\nz"


def test_first_holder_of_a_rare_line_has_partners(spark):
    texts = [f"hot\nown {i}" for i in range(30)] + ["a\nhot\nb\nnew", "c\nnew\nd"]
    assert _without_shared(spark, texts)[-2:] == ["a\nb\nnew", "c\nd"]


def test_patience_aligns_equal_lines_in_order():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [1, 2, 4]
    assert line_dedup.patience([1, 1, 2], [1, 1, 2]) == [0, 1, 2]
    assert line_dedup.patience([], [1]) == []


def test_quality(docs, rows, empty):
    got = {r.doc_id: r.asDict() for r in quality.judge(docs).collect()}
    for d, text, *_ in rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        wanted = (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeat))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(got[d][f"_q_{c}"] for c in names) == wanted
        assert got[d]["_q_base_failed"] == (len(w) < 20 or 100 * len(repeat) > 30 * len(w))
        assert not (got[d]["_q_base_failed"] and got[d]["_q_kept"])
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.judge(empty).count() == 0


def test_mixing(spark, docs, empty):
    rated = mixing.mix_rates(docs).collect()
    sizes = Counter()
    for r in rated:
        sizes[r.source] += r.mix_size
        assert r.mix_size == len(words(r.text)) and r.mix_copies <= 3
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            break
        target |= {s: 3 * sizes[s] for s in full}
        rest -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    for r in rated:
        assert r.mix_target == pytest.approx(target[r.source]) and r.mix_source_size == sizes[r.source]
    assert mixing.mix(docs).count() == sum(r.mix_copies for r in rated)
    assert mixing.mix(empty).count() == 0


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("b.com", "/x/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://A.b.com/x/1?q", "http://b.com/y", "http://xb.com/x/", "http://b.com", "b.com/x/", None, "://", "http://b.com/x/#a"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [tuple(r) for r in url_rules.judge_urls(pages, rules).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [
        ("a.b.com", "/x/1", "b.com/x/", "block"),
        ("b.com", "/y", "com/", "allow"),
        ("xb.com", "/x/", "com/", "allow"),
        ("b.com", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b.com", "/x/", "b.com/x/", "block"),
    ]
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_decontamination(spark, empty):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(90)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(6, 25))) + ". The answer is " + draw.choice(vocabulary) + f" {i}.") for i in range(70)]
    items += [(70, None), (71, ""), (72, "One two")]
    texts = [" ".join(draw.choices(vocabulary, k=120)) for _ in range(30)] + [None, "", items[3][1]]
    texts += [" ".join(draw.choices(vocabulary, k=k)) + " " + items[k][1].upper() + " and " + items[k + 1][1] for k in range(1, 40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = decontaminate.split_items(spark.createDataFrame(items, "item_id long, text string"))
    parts = {r.item_id: (r.question.lower().split(), r.answer.lower().split()) for r in split.collect()}

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    wanted = set()
    for d, text in enumerate(texts):
        w = (text or "").lower().split()
        for i, both in parts.items():
            shares = [len(grams(p, min(5, len(p))) & grams(w, min(5, len(p)))) / len(grams(p, min(5, len(p)))) for p in both if p]
            if shares and min(shares) >= 0.8:
                wanted.add((d, i))
    for shard in (decontaminate.SHARD_BYTES, 2000):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, split, shard).collect()} == wanted
    clean = {r.doc_id for r in decontaminate.decontaminate(table, split).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in wanted} and len(wanted) > 70
    assert decontaminate.leaks(empty, split).count() == 0
    assert decontaminate.leaks(table, split.limit(0)).count() == 0


def test_leaks_behind_signs_and_capitals(spark):
    item = "Où est né le père de l'auteur du premier roman de la série? Élan vital."
    items = decontaminate.split_items(spark.createDataFrame([(1, item)], "item_id long, text string"))
    texts = [f"un*** deux%%% {item}$$$ trois", item.upper(), item.replace(" ", "&&& "), "Élan vital.", item.split("?")[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {0, 1, 2}


def test_leaks_with_one_word_edited(spark):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    sizes = [(9, 1), (9, 2), (9, 3), (14, 4), (20, 5), (24, 8), (45, 6), (3, 40)]
    items = [(i, " ".join(draw.choices(vocabulary, k=q)) + "? " + " ".join(draw.choices(vocabulary, k=a)) + ".") for i, (q, a) in enumerate(sizes)]
    split = decontaminate.split_items(spark.createDataFrame(items, "item_id long, text string"))
    texts, wanted = [], set()
    around = lambda words: " ".join(draw.choices(vocabulary, k=draw.randint(0, 150)) + words + draw.choices(vocabulary, k=draw.randint(0, 150)))
    for item, text in items:
        own, n_question = text.split(), sizes[item][0]
        for k in range(len(own)):
            edited = [own[:k] + ["other"] + own[k + 1 :], own[:k] + own[k + 1 :], own[:k] + ["other"] + own[k:]]
            for kind, words in enumerate(edited):
                if sizes[item][1] > 1 or k < n_question:  # else the answer is gone
                    wanted.add((len(texts), item))
                if sizes[item][1] > 1 or k < n_question or kind < 2:
                    texts.append(around(words))
        texts.append(around(own[:n_question] if n_question > 3 else own[n_question:]))  # one part alone
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, split).collect()} == wanted
    assert decontaminate.decontaminate(docs, split).count() == len(texts) - len(wanted)


def test_token_counts(docs, rows, empty):
    vocabulary = [b" ", b"a", b"b", b" a", b"ab", b"abc", b"bcd", b"cde", b"e", b"d", "é".encode(), b" ab", b"x", b"xx", b"xxxx"]

    def greedy(word):
        n = 0
        while word:
            k = max((len(v) for v in vocabulary if word.startswith(v)), default=0)
            if not k:
                return 1
            word, n = word[k:], n + 1
        return n

    got = {r.doc_id: r for r in token_counts.count_tokens(docs, vocabulary).collect()}
    for d, text, *_ in rows:
        assert got[d].n_words == len(words(text))
        assert got[d].n_tokens == sum(greedy(b" " + w.encode()) for w in words(text))
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


def test_language_id(spark, docs, empty):
    draw = random.Random(2)
    letters = {"aa": "abcde", "bb": "dexyz"}
    table = [
        (i, " ".join("".join(draw.choices(letters[k], k=5)) for _ in range(30)), k) for i in range(60) for k in letters
    ] + [(99, None, "aa"), (98, "12 !", "bb"), (97, "abc", None)]
    labelled = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = language_id.learn(labelled)
    for r in language_id.identify(labelled, model).collect():
        assert 0 <= r.score <= 1
        if r.text is None or not re.search("[a-z]", r.text):
            assert r.lang_pred == "und"
        elif r.lang:
            assert r.lang_pred == r.lang
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_copies_teach_once(spark):
    texts = [(f"{w} alpha beta {w}{w}", lang) for lang, ws in (("aa", "bcdfg"), ("bb", "klmnp")) for w in ws]
    once = language_id.learn(spark.createDataFrame(texts, "text string, lang string"))
    often = language_id.learn(spark.createDataFrame(texts + texts[:1] * 300, "text string, lang string"))
    assert once.languages == often.languages and (once.slots == often.slots).all()


def test_copies_do_not_thin_out_the_sample(spark):
    texts = [(f"{w}{v} alpha {v}{w}", lang) for lang, ws in (("aa", "bcdfg"), ("bb", "klmnp")) for w in ws for v in "aeiou"]
    rows = spark.createDataFrame(texts, "text string, lang string")
    once = language_id.learn(rows, sample_docs=25)
    often = language_id.learn(rows.crossJoin(spark.range(400)).drop("id"), sample_docs=25)
    assert once.languages == often.languages and once.slots.any() and once.slots.shape == often.slots.shape
    assert (once.slots == often.slots).all()


def test_held_out_accuracy(spark):
    from docsift.llm import queries

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in queries.read(spark, folder, "documents").collect()}
    held = [r for r in queries.op1_language_id(spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def _alike(texts):
    """Two texts that polynomials modulo 2**64 cannot tell apart, whatever their base."""
    order = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = order.translate(str.maketrans("ab", "ba"))
    return [t.format(order) for t in texts] + [t.format(other) for t in texts]


def test_words_that_rings_confuse(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    one, two = _alike(["{0} " + tail])
    table = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.n_removed for r in repeated_words.remove_repeats(table).collect()} == {0}
    seen = Counter(t[i : i + 200] for t in (one, two) for i in range(len(t) - 199))
    for r in repeated_bytes.remove_repeats(table).collect():
        text = {1: one, 2: two}[r.doc_id]
        assert r.n_removed == len({i + k for i in range(len(text) - 199) if seen[text[i : i + 200]] > 1 for k in range(200)})
    short = spark.createDataFrame([(1, one[:4100] + "x"), (2, two[:4100] + "x")], "doc_id long, text string")
    assert {r.n_links for r in ngram_join.link(short).collect()} == {0}
    a, b = _alike(["{0}"])
    lines = spark.createDataFrame([(1, a + "\nx"), (2, b + "\ny"), (3, a + "\n" + b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.deduplicate(lines).collect()) == [(1, 0), (2, 0), (3, 2)]
    counted = quality.judge(lines.selectExpr("doc_id", "text", "'en' as lang", "'s' as source")).collect()
    assert {r._q_n_dup_lines for r in counted} == {0}
    pieces = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame([(1, a), (2, b), (3, a + " " + b)], "doc_id long, text string"), [b" a", b"a", b"b", b"ab"]).collect()}
    assert pieces[3] == pieces[1] + pieces[2] and pieces[1] != pieces[2]
    items = decontaminate.split_items(spark.createDataFrame([(1, f"{a} is a word of many signs. Yes {a} it is.")], "item_id long, text string"))
    docs = spark.createDataFrame([(1, f"{a} is a word of many signs. Yes {a} it is."), (2, f"{b} is {b} a {b}. Yes {b} it is.")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {1}


def test_texts_of_one_id(spark):
    mine, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"z{i}" for i in range(80))
    table = spark.createDataFrame([(1, mine), (1, other), (2, other), (3, mine + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.link(table).collect()}
    assert len(got) == 3 and {got[2].class_id, got[3].class_id} in ({1, 3}, {2, 1})
    unique = spark.createDataFrame([(1, mine), (2, " ".join(f"u{i}" for i in range(20))), (2, mine)], "doc_id long, text string")
    removed = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeated_words.remove_repeats(unique).collect())
    assert removed in [[(1, 80, 0), (2, 20, 0), (2, 80, n)] for n in (0, 80)]
    assert sorted((r.doc_id, r.n_removed > 0) for r in repeated_bytes.remove_repeats(unique).collect())[:2] in ([(1, False), (2, False)], [(1, True), (2, False)])


def test_items_without_an_id(spark):
    text = "What is the name of the river that runs through the old town? It is the Alder."
    items = decontaminate.split_items(spark.createDataFrame([(None, text), (2**60 + 1, text)], "item_id long, text string"))
    docs = spark.createDataFrame([(1, text), (None, text), (3, "river")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(d, i) for d in (1, None) for i in (None, 2**60 + 1)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [3]


def test_postings_bound_the_index():
    """Block maxima are kept where a word has postings: twice the items, twice the size."""
    import numpy as np
    import pyarrow as pa
    from docsift.llm.words import Hasher, Texts

    def size(n):
        texts = Texts(pa.array([f"a{i} b{i} c{i} d{i}" for i in range(n)]))
        hashes = texts.word_hashes(Hasher(0))
        parts = [list(hashes.reshape(-1, 4)), [hashes[:0]] * n]
        index = decontaminate.Index.build(list(range(n)), parts, n, 4.0, dict.fromkeys(hashes.tolist(), 1), 4)
        return sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))

    assert size(4000) < 2.2 * size(2000)


def test_marks_are_no_letters(spark, docs):
    model = language_id.learn(spark.createDataFrame([("abc abd", "aa"), ("xyz xyw", "bb")], "text string, lang string"))
    table = spark.createDataFrame([("\u0301",), ("1 \u0301 2",), ("e\u0301",), ("abc",)], "text string")
    got = {r.text: (r.lang_pred, r.score) for r in language_id.identify(table, model).collect()}
    assert got["\u0301"] == got["1 \u0301 2"] == ("und", 0.0) and got["abc"][0] == "aa" and got["e\u0301"][0] != "und"


def test_languages_against_exact_sets(spark):
    """Without chance hits, the filter's decision is that of exact n-gram sets."""
    import numpy as np
    import pyarrow as pa
    from docsift.llm.words import Texts

    draw = random.Random(12)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijkabcz"}
    texts = [(" ".join("".join(draw.choices(v, k=draw.randint(1, 7))) for _ in range(25)), k) for k, v in letters.items() for _ in range(40)]
    model = language_id.learn(spark.createDataFrame(texts, "text string, lang string"))
    grams = {k: Counter() for k in letters}

    def of(text):
        return [f" {w} "[i : i + n] for n in (3, 4) for w in text.split() for i in range(len(w) + 3 - n)]

    for text, k in texts:
        grams[k].update(of(text))
    total = {k: sum(c.values()) for k, c in grams.items()}
    share = {k: {g: n / total[k] for g, n in c.items() if n / total[k] >= language_id.LEAST} for k, c in grams.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    own = {k: {g for g, x in s.items() if x >= language_id.CONTRAST * most[g]} for k, s in share.items()}
    probe = ["".join(draw.choices("abcdefghijkz ", k=60)) for _ in range(300)]
    names, _ = model.predict(Texts(pa.array(probe)))
    agree = ties = 0
    for text, name in zip(probe, names, strict=True):
        hits = {k: sum(g in s for g in of(text)) for k, s in own.items()}
        best = max(hits.values())
        ties += sum(h >= best - 1 for h in hits.values()) > 1
        agree += hits[name] >= best - 1  # a chance hit of the filter may turn a tie
    assert agree == len(probe) and ties < 150


def test_names_of_the_caller(spark):
    long = " ".join(f"w{i}" for i in range(30))
    names = ["later", "d", "copy", "mix_size", "mix_copies", "all", "_q_kept", "t", "g_source", "places", "v", "n_copies", "cluster"]
    table = spark.createDataFrame([(1, long, "en", "s", *names), (2, long, "en", "s", *names)], ["doc_id", "text", "lang", "source", *names])
    for got in (ngram_join.keep_one(table), quality.quality_filter(table), mixing.mix(table).filter("copy = 1"), mixing.mix_rates(table), line_dedup.deduplicate(table)):
        row = got.filter("doc_id = 1").collect()[0].asDict()
        replaced = {"copy": ("copy",), "mix_source_size": ("mix_size", "mix_copies")}
        new = {n for k, ns in replaced.items() if k in row and len(row) != len(names) + 4 or k == "copy" and row.get("copy") == 1 for n in ns}
        assert all(row[n] == n for n in names if n not in new), got.columns


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    now = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == documents.columns, name
        now = after
    rated = {r.doc_id: r for r in mixing.mix_rates(now).collect()}
    mixed = corpus_pipeline.run(spark, folder)
    wanted = Counter({(d, r.text): r.mix_copies for d, r in rated.items() if r.mix_copies})
    assert len(rated) > 100 and Counter((r.doc_id, r.text) for r in mixed.collect()) == wanted


def test_pipeline_reads_documents_a_bounded_number_of_times(spark):
    """Only the first stage sees ``documents``, in one pass; every later one reads what was written."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    mixed = corpus_pipeline.run(spark, folder)
    assert not any("documents.parquet" in f for f in mixed.inputFiles())
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert not any("documents.parquet" in f for f in first.inputFiles())  # the measured table was stored
