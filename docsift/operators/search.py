"""Boolean and fuzzy keyword search over the symbol relation.

``match_keywords`` runs one query as plain column expressions, ``match_queries``
a table of queries as joins; ``best_per_url`` reduces matches to one row per URL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.functions.similarity import partial_ratio
from docsift.operators.candidates import candidate_pairs, gram_size, may_reach, salts
from docsift.operators.ranking import first_by
from docsift.operators.sizing import MAX_BROADCAST_BYTES, broadcast_if_small
from docsift.operators.storage import stored

# Rows of an address beyond which its matches meet by map-side merging, not in one task.
CROWD = 1000
# (query, source) pairs whose matches of a name may share one packed row.
PACK = 1024

# What a result row needs of its symbol.
_ROW = ["source", "pos", "kind", "group", "url", "role", "domain", "origin"]


def name_forms(df: DataFrame, name: str = "group") -> DataFrame:
    """Add the lower-cased name, its bare form and the segments of the bare form."""
    bare = tx.bare_name(F.col(name))
    return df.withColumns(
        {
            "_lowered": F.lower(F.col(name)),
            "_bare": F.lower(bare),
            "_segments": tx.segment_text(bare),
        }
    )


def tier_of(term: Column) -> Column:
    return tx.tier_score(term, F.col("_lowered"), F.col("_bare"), F.col("_segments"))


def with_similarity(tier: Column, term: Column, wanted: Column) -> Column:
    """Tier score, or the capped similarity where there is no tier and it is wanted."""
    text = F.when(tier.isNull() & wanted, F.col("_lowered"))
    ratio = partial_ratio(term, text)  # NULL for a missing name, which least() would turn into the cap
    return F.coalesce(tier, F.when(ratio.isNotNull(), F.least(F.lit(tx.SIMILARITY_CAP), ratio)))


def split_keywords(spark: SparkSession, keywords: str | None) -> list[list[str]] | None:
    """OR-groups of AND-terms of a literal query, by the rules of a column of queries; None without keywords."""
    text = F.lit(keywords).cast("string")
    some, groups = spark.range(1).select(tx.has_keywords(text), tx.or_groups(text)).first()
    return groups if some else None


def _all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def match_keywords(
    symbols: DataFrame, groups: list[list[str]], fuzzy: bool, threshold: Column, similarity: bool = True
) -> DataFrame:
    """Rows that match a literal query, with ``score``, ``matched_keyword`` and ``g_idx``.

    ``similarity=False`` says that no threshold is low enough for the similarity
    tier, which leaves a plan without Python.
    """
    if not groups:
        groups = [[]]
        symbols = symbols.filter(F.lit(False))
    terms = list(dict.fromkeys(t.lower() for g in groups for t in g))
    if not fuzzy:
        lowered = F.lower("group")
        hit = [_all_of([lowered.contains(t) for t in {t.lower(): None for t in g}] or [F.lit(True)]) for g in groups]
        return (
            symbols.filter(reduce(lambda a, b: a | b, hit))
            .withColumn("g_idx", F.array_position(F.array(*hit), F.lit(True)).cast("int"))
            .withColumns({"score": F.lit(None).cast("double"), "matched_keyword": F.lit(None).cast("string")})
        )

    if not similarity:
        # Without that tier a match contains its terms; this filter reaches the scan.
        lowered = F.lower("group")
        symbols = symbols.filter(
            reduce(lambda a, b: a | b, [_all_of([lowered.contains(t.lower()) for t in g] or [F.lit(True)]) for g in groups])
        )
    rows = name_forms(symbols).withColumns({"_cut": threshold, "_bonus": tx.role_adjust(F.col("role"))})
    wanted = F.col("_cut") <= tx.SIMILARITY_CAP
    rows = rows.withColumns({f"_t{i}": tier_of(F.lit(t)) for i, t in enumerate(terms)})
    if similarity:
        rows = rows.withColumns(
            {f"_t{i}": with_similarity(F.col(f"_t{i}"), F.lit(t), wanted) for i, t in enumerate(terms)}
        )
    score_of = {t: F.col(f"_t{i}") for i, t in enumerate(terms)}
    ranked = []
    for group in groups:
        bases = [score_of[t] for t in dict.fromkeys(t.lower() for t in group)] or [F.lit(0.0)]
        passes = _all_of([b >= F.col("_cut") for b in bases])
        ranked.append(F.when(passes, tx.ranked_score(_least(bases), F.col("_bonus"))))
    labels = F.array(*[F.lit(",".join(g)) for g in groups])
    return (
        rows.withColumn("_ranked", F.array(*ranked))
        .withColumn("score", tx.pinned(F.array_max("_ranked")))
        .filter(F.col("score").isNotNull())
        .withColumn("g_idx", F.array_position(F.col("_ranked"), F.col("score")).cast("int"))
        .withColumn("matched_keyword", F.element_at(labels, F.col("g_idx")))
        .select(*symbols.columns, "score", "g_idx", "matched_keyword")
    )


def best_per_url(rows: DataFrame, by: list[str], fuzzy: Column) -> DataFrame:
    """One row per URL and ``by`` group, with the position ``tie_pos`` it ranks at.

    ``rows`` may hold a symbol once per OR-group it matches.  Fuzzy: the best
    score wins, on ties the earliest row and then the earliest OR-group, and the
    URL ranks at its first matching row even when a later one won.  Boolean: the
    first row by OR-group and position wins.  Rows without URL stand for themselves.
    """
    keyed = rows.withColumns(
        {
            "_alone": F.when(F.col("url").isNull(), F.col("pos")),
            "_order": F.when(fuzzy, -F.col("score")).otherwise(F.col("g_idx").cast("double")),
            "_fuzzy": fuzzy,
        }
    )
    best = first_by(keyed, by + ["url", "_alone"], ["_order", "pos", "g_idx"], _first=F.min("pos"))
    return best.withColumn("tie_pos", F.when(F.col("_fuzzy"), F.col("_first")).otherwise(F.col("pos"))).drop(
        "_alone", "_order", "_fuzzy", "_first"
    )


def score_terms(names: DataFrame, terms: DataFrame, **candidates) -> DataFrame:
    """The different names (``group``) with the terms they match and the text score ``base`` of each match."""
    pairs = name_forms(candidate_pairs(names, "group", F.lower("group"), terms, **candidates))
    tiers = pairs.withColumn("_tier", tx.pinned(tier_of(F.col("term"))))
    # Without a tier nothing passes a threshold above the similarity cap: drop before Python, like what cannot pass.
    similar = (F.col("threshold") <= tx.SIMILARITY_CAP) & may_reach(F.col("term"), F.col("_lowered"), F.col("threshold"))
    open_ = tiers.filter(F.col("_tier").isNotNull() | similar)
    if candidates["lowest"] <= tx.SIMILARITY_CAP:
        base = with_similarity(F.col("_tier"), F.col("term"), F.lit(True))
    else:
        base = F.col("_tier")
    return open_.withColumn("base", base).filter(F.col("base") >= F.col("threshold")).select("group", "term", "base")


def query_targets(queries: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per (query, source) with everything a search of that source needs."""
    return queries.join(resolved, "query_id").select(
        "query_id",
        "source",
        "requested",
        "request_ord",
        "fuzzy",
        "max_results",
        "domains",
        tx.has_keywords(F.col("keywords")).alias("has_keywords"),
        tx.or_groups(F.col("keywords")).alias("groups"),
        tx.domain_set(F.col("domains")).alias("wanted"),
        # Containment scores at least 88, so a boolean query is the cut at that tier.
        F.when(F.col("fuzzy"), F.coalesce("threshold", "match_threshold", F.lit(tx.DEFAULT_THRESHOLD)))
        .otherwise(F.lit(tx.SCORE_CONTAINED))
        .alias("cut"),
    )


def _profile(targets: DataFrame) -> Row:
    """What the plan of a batch depends on, in one row: sizes and thresholds of the query side."""
    terms = F.flatten("groups")
    row = F.octet_length(F.to_json(F.struct("query_id", "source", "requested", "wanted", "groups")))
    return targets.agg(
        F.coalesce(F.sum(F.size(terms) * (row + 64)), F.lit(0)).alias("route_bytes"),
        F.coalesce(F.sum(F.octet_length(F.array_join(terms, "")) * 16 * 8), F.lit(0)).alias("token_bytes"),
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct(F.transform(terms, gram_size))))))
        ).alias("gram_sizes"),
        F.coalesce(F.min("cut"), F.lit(100.0)).alias("lowest"),
        F.coalesce(F.max(~F.col("has_keywords")), F.lit(False)).alias("any_blank"),
        F.ceil(F.count(F.lit(1)) / PACK).alias("packs"),
    ).first()


def number_queries(targets: DataFrame) -> DataFrame:
    """``targets`` with ``q``, a number for each query, by which all matching is keyed; stored, so that it stays the same."""
    numbers = stored(targets.select("query_id").distinct().select("query_id", F.monotonically_increasing_id().alias("q")))
    return targets.join(broadcast_if_small(numbers)[0], "query_id")


#: What matching carries of a match: fixed-width values only. Names, addresses and labels are fetched for what is left (``widen``).
NARROW = ["q", "request_ord", "pos", "fuzzy", "g_idx", "score", "tie_pos"]


def _packed(hits: DataFrame, packs: int) -> DataFrame:
    """What asks for a name (``group``) in a source, in rows of bounded size: ``hits`` (q, request_ord, wanted, g_idx, base).

    ``base`` is null for boolean queries. An OR-group is left out if an earlier one of its query has the name with no lower
    base: whatever the bonus of a row, it cannot win.
    """
    pack = F.pmod(F.xxhash64("q"), F.lit(max(1, packs))).alias("pack")
    groups = hits.groupBy("source", "group", "q", "request_ord").agg(
        F.collect_list(F.struct("g_idx", F.when(F.col("fuzzy"), F.col("_base")).alias("base"))).alias("_gs"), F.any_value("wanted").alias("wanted")
    )
    worse = lambda a, b: (b["g_idx"] < a["g_idx"]) & (F.coalesce(b["base"], F.lit(0.0)) >= F.coalesce(a["base"], F.lit(0.0)))
    kept = F.filter("_gs", lambda a: ~F.exists("_gs", lambda b: worse(a, b)))
    rows = groups.select("source", "group", "q", "request_ord", "wanted", F.inline(kept))
    return rows.groupBy("source", "group", pack).agg(F.collect_list(F.struct("q", "request_ord", "wanted", "g_idx", "base")).alias("hits")).drop("pack")


def match_narrow(symbols: DataFrame, targets: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The best match of each URL for each query of ``number_queries`` and source, in the columns ``NARROW``.

    Queries without keywords match all symbols of their sources, unscored.
    """
    profile = _profile(targets)
    # The query side is broadcast only while its measured size is small; beyond that the joins shuffle.
    small = max(profile["route_bytes"], profile["token_bytes"]) <= max_bytes

    def meet(rows: DataFrame, asked: DataFrame, keys: list[str], salt: list[str]) -> DataFrame:
        """The rows with what asks for them; a source may hold most symbols, so shuffled keys are salted."""
        if small:
            return rows.join(F.broadcast(asked), keys)
        n = salts(rows.sparkSession)
        spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(n)).cast("int"))
        copies = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return spread.join(copies, [*keys, "_salt"]).drop("_salt")

    keyed = targets.filter("has_keywords and size(groups) > 0")
    group = F.array_distinct(F.transform("_g", F.lower))
    routes = keyed.select("*", F.posexplode("groups").alias("g_idx", "_g")).select(
        group.alias("terms"), *["source", "q", "request_ord", "fuzzy", "wanted", "cut", "g_idx"]
    )
    terms = routes.select(F.explode("terms").alias("term"), "cut").groupBy("term").agg(F.min("cut").alias("threshold"))
    # A group of terms is looked for by its longest one only; the others are then looked up among the terms of the name.
    longest = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    routes = routes.withColumns({"term": longest, "others": F.array_remove("terms", longest)}).drop("terms")

    # The list of sources is bounded by the registry and measured by itself.
    asked_sources, _ = broadcast_if_small(keyed.select("source").distinct())
    in_scope = symbols.select("source", "pos", "kind", "group", "url", "role", "domain").join(asked_sources, "source", "left_semi")
    # A name is scored once, however many symbols bear it.  The width is fixed because few names become many pairs:
    # merging partitions by the size of this stage's input would leave them to a few tasks.  No name comes twice here.
    width = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borne = in_scope.select("source", "group").filter("`group` is not null").distinct()
    names = borne.groupBy("group").agg(F.collect_set("source").alias("sources")).repartition(width, "group")
    scored = score_terms(names.select("group"), terms, gram_sizes=profile["gram_sizes"], lowest=profile["lowest"], small=small)
    # All terms of a name in one row: at most the terms that pass their threshold for it.
    known = scored.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("term", "base"))).alias("known"))
    # A name also meets the queries once in each of its sources.
    known = known.join(names, "group").select("group", "known", F.explode("sources").alias("source"))
    known = known.select("*", F.explode("known").alias("term", "base"))
    rest = F.array_min(F.transform("others", lambda t: F.coalesce(F.try_element_at("known", t), F.lit(-1.0))))
    hits = meet(known, routes, ["term", "source"], ["group"]).filter(F.col("base") >= F.col("cut"))
    hits = hits.withColumn("_base", F.when(F.size("others") == 0, F.col("base")).otherwise(F.least("base", rest)))
    packed = stored(_packed(hits.filter(F.col("_base") >= F.col("cut")), profile["packs"]))
    packed_bytes = packed.agg(F.sum(F.size("hits") * 64 + F.octet_length("group") + 64)).first()[0] or 0
    few = packed_bytes <= max_bytes

    wanted_names = broadcast_if_small(packed.select("source", "group").distinct(), max_bytes)[0]
    found = in_scope.join(wanted_names, ["source", "group"], "left_semi")
    # An address is known by the position of its first row here in the source; a row without one by its own.
    firsts = found.filter("url is not null").groupBy("source", "url").agg(F.min("pos").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    placed = found.join(firsts, ["source", "url"], "left").select(
        *["source", "group", "kind", "domain", "pos"],
        tx.role_adjust(F.col("role")).alias("bonus"),
        F.coalesce("_pos", "pos").alias("address"),
        (F.coalesce("_n", F.lit(1)) > CROWD).alias("crowd"),
    )
    placed = stored(placed)

    def matches_of(rows: DataFrame) -> DataFrame:
        """The best match of each address of ``rows`` for each query; the place of its request stands for the source."""
        each = rows.select("address", "pos", "bonus", "kind", "domain", F.explode("hits").alias("_h"))
        each = each.filter(tx.in_domains(F.col("kind"), F.col("domain"), F.col("_h.wanted")))
        score = F.when(F.col("_h.base").isNotNull(), tx.ranked_score(F.col("_h.base"), F.col("bonus")))
        each = each.select("address", "_h.q", "_h.request_ord", "pos", "_h.g_idx", score.alias("score"))
        # Fuzzy: the best score wins, then the earliest row and OR-group, and the address ranks at its first row even when
        # a later one won. Boolean, without a score: the first OR-group wins, then the earliest row.
        order = F.coalesce(-F.col("score"), F.col("g_idx").cast("double"))
        return each.groupBy("address", "q", "request_ord").agg(
            F.min(F.struct(order.alias("order"), "pos", "g_idx", "score")).alias("_b"), F.min("pos").alias("_first")
        )

    # Rows of an address move together before they meet the queries, so that matches, which are many more, need no shuffle.
    calm = placed.filter("not crowd")
    if few:
        # Sorted while they are narrow, the rows leave the aggregate's sort little to do.
        calm = calm.repartition(width, "address").sortWithinPartitions("address")
        best = matches_of(calm.join(F.broadcast(packed), ["source", "group"]))
    else:
        best = matches_of(calm.join(packed, ["source", "group"]).repartition(width, "address"))
    if placed.agg(F.max("crowd")).first()[0]:
        # Of the rows of a crowded address that match alike only the first can win; their matches merge in map tasks.
        alike = placed.filter("crowd").groupBy("source", "address", "group", "bonus", "kind", "domain").agg(F.min("pos").alias("pos"))
        best = best.unionByName(matches_of(alike.join(F.broadcast(packed) if few else packed, ["source", "group"])))
    fuzzy = F.col("_b.score").isNotNull()
    tie = F.when(fuzzy, F.col("_first")).otherwise(F.col("_b.pos"))
    best = best.select("q", "request_ord", F.col("_b.pos").alias("pos"), fuzzy.alias("fuzzy"), F.col("_b.g_idx").alias("g_idx"), F.col("_b.score").alias("score"), tie.alias("tie_pos"))
    if not profile["any_blank"]:
        return best
    blank = targets.filter("not has_keywords").select("q", "source", "request_ord", "wanted")
    listed = meet(symbols.select("source", "pos", "kind", "domain"), blank, ["source"], ["source", "pos"]).filter(
        tx.in_domains(F.col("kind"), F.col("domain"), F.col("wanted"))
    )
    constants = {"fuzzy": F.lit(False), "g_idx": F.lit(0), "score": F.lit(None).cast("double"), "tie_pos": F.col("pos")}
    return best.unionByName(listed.withColumns(constants).select(*NARROW))


def widen(matches: DataFrame, symbols: DataFrame, targets: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Narrow matches with the rest of their symbols and queries, and ``matched_keyword``."""
    labels = F.transform("groups", lambda g: F.array_join(g, ",")).alias("_labels")
    asked = broadcast_if_small(targets.select("q", "request_ord", "query_id", "requested", labels), max_bytes)[0]
    places = broadcast_if_small(targets.select("q", "request_ord", "source"), max_bytes)[0]
    rows = symbols.select(*_ROW)
    # Matches outnumber symbols: few symbols are broadcast, and while those of a task are few, they are hashed and matches
    # are not sorted.
    width = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in _ROW if c != "pos")
    size = rows.agg(F.sum(texts + 100)).first()[0] or 0
    if size <= max_bytes:
        rows = F.broadcast(rows)
    elif size <= width * MAX_BROADCAST_BYTES:
        rows = rows.hint("shuffle_hash")
    # Texts of the query are fetched last, when matches move no more.
    out = matches.join(places, ["q", "request_ord"]).join(rows, ["source", "pos"]).join(asked, ["q", "request_ord"])
    label = F.when(F.col("score").isNotNull(), F.get("_labels", F.col("g_idx")))
    return out.withColumn("matched_keyword", label).drop("_labels", "q")


def match_queries(symbols: DataFrame, targets: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Rows matched by each query of ``query_targets``, one row per query, source and address, with all columns."""
    numbered = number_queries(targets)
    return widen(match_narrow(symbols, numbered, max_bytes), symbols, numbered, max_bytes)
