"""Result exports: TSV lines and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.operators.stats import domain_stats
from docsift.sources.registry import skipped_sources

# --- fixed values -----------------------------------------------------------
PDF_LABEL = "[PDF manual]"
DOCS_LABEL = "[docs (no inventory)]"
PDF_MESSAGE = (
    " is distributed as a PDF manual only. Symbol search is not available. Download the PDF to read the documentation."
)
DOCS_MESSAGE = " has no Sphinx inventory for symbol search. Browse the documentation directly."
NO_INVENTORY_ERROR = "could not resolve Sphinx inventory for --stats"
UNSUPPORTED_ERROR = "--stats is not supported for doc_type "
# ----------------------------------------------------------------------------


def tsv_rows(results: DataFrame) -> DataFrame:
    """Add ``line``: five columns, and score and matched keyword for scored rows. No quoting."""
    columns = ["group", "url", "role", "domain", "source"]
    plain = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in columns])
    scored = F.concat_ws(
        "\t", plain, F.col("score").cast("string"), F.coalesce("matched_keyword", F.lit(""))
    )
    return results.withColumn("line", F.when(F.col("score").isNull(), plain).otherwise(scored))


def _write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """``line`` as text files, one for each range of the order, sorted inside; the files' names follow the ranges."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    dealt.select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of files written by ``write_tsv`` and ``write_json``: the lines and their places, from 1, over all files."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    part = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")
    lines = files.select(part.alias("part"), F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("i", "line"))
    # one row for each file
    offsets = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n_lines"))
    before = F.sum("n_lines").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, "part").select((F.col("before") + F.col("i") + 1).alias("n"), "line")


def write_tsv(results: DataFrame, path: str, order: list[str]) -> None:
    """Lines in the given order, as text files."""
    _write_lines(tsv_rows(results), path, order)


def placeholder_rows(status: DataFrame) -> DataFrame:
    """Result rows for requested sources that can only be read, not searched.

    ``status`` has requested, skipped_reason and doc_url.
    """
    label = F.when(F.col("skipped_reason") == "pdf", PDF_LABEL).otherwise(DOCS_LABEL)
    others = [c for c in ("query_id", "request_ord") if c in status.columns]
    shown = status.filter(F.col("skipped_reason").isNotNull() & (F.coalesce("doc_url", F.lit("")) != ""))
    return shown.select(
        *others,
        label.alias("group"),
        F.col("doc_url").alias("url"),
        F.lit("").alias("role"),
        F.lit("").alias("domain"),
        F.col("requested").alias("source"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("matched_keyword"),
    )


def json_lines(results: DataFrame, counts: DataFrame, queries: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, line): a JSON head per query at rank 0, then one JSON line per candidate at its rank.

    The shape is the same for any number of candidates, and no row holds a whole result.  ``results`` is ranked,
    ``counts`` has total_found per (query_id, requested) and filtered_count, ``status`` has doc_type, skipped_reason and
    doc_url per requested source.  The head of a query for one source that can only be read says so; a head for several
    sources maps the skipped ones to their documentation.
    """
    fields = ["group", "url", "role", "domain", "source", "score", "matched_keyword", "origin"]
    candidates = results.select("query_id", "rank", F.to_json(F.struct(*fields)).alias("line"))
    per_source = F.array_sort(F.collect_list(F.struct("request_ord", "requested", "total_found")))
    heads = counts.groupBy("query_id").agg(
        F.transform(per_source, lambda r: r["requested"]).alias("sources"),
        F.map_from_entries(
            F.transform(per_source, lambda r: F.struct(r["requested"], r["total_found"]))
        ).alias("totals"),
        F.max("filtered_count").alias("filtered_count"),
    )
    heads = heads.join(queries.select("query_id", "domains"), "query_id")
    if status is None:
        empty = "cast(null as map<string,string>) skipped_sources", *[f"cast(null as string) {c}" for c in ("doc_type", "doc_url", "message")]
        heads = heads.selectExpr("*", *empty)
    else:
        readable = status.filter(F.col("skipped_reason").isin("pdf", "no genindex"))
        quoted = F.concat(F.lit("'"), "requested", F.lit("'"))
        text = F.when(F.col("skipped_reason") == "pdf", F.concat(quoted, F.lit(PDF_MESSAGE))).otherwise(F.concat(quoted, F.lit(DOCS_MESSAGE)))
        notes = readable.select("query_id", F.array("requested").alias("sources"), "doc_type", "doc_url", text.alias("message"))
        heads = heads.join(skipped_sources(status), "query_id", "left").join(notes, ["query_id", "sources"], "left")
    first = F.get("sources", F.lit(0))
    tail = ["filtered_count", F.coalesce("domains", F.lit("all")).alias("domains_filter")]
    one = F.struct(first.alias("source"), F.element_at("totals", first).alias("total_found"), *tail, "doc_type", "doc_url", "message")
    many = F.struct("sources", F.col("totals").alias("total_found"), *tail, "skipped_sources")
    head = F.when(F.size("sources") == 1, F.to_json(one)).otherwise(F.to_json(many))
    return heads.select("query_id", F.lit(0).alias("rank"), head.alias("line")).unionByName(candidates)


def stats_envelopes(symbols: DataFrame, sources: DataFrame, status: DataFrame) -> DataFrame:
    """(source, line, error): the statistics of every source as JSON, or why there are none.

    Domains come most frequent first; a searchable source without symbols has a total of 0.  ``status`` has inventory_url
    per source.  A source has few domains: they are a vocabulary, not data.
    """
    counted = domain_stats(symbols, sources)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "domain", "n")))
    per_source = counted.groupBy("source").agg(
        F.max("total").alias("total"),
        F.map_from_entries(F.transform(ordered, lambda r: F.struct(r["domain"], r["n"]))).alias("domains"),
    )
    located = F.col("inventory_url").isNotNull()
    line = F.to_json(
        F.struct(
            "source",
            "inventory_url",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("domains", F.create_map().cast("map<string,bigint>")).alias("domains"),
        )
    )
    kind = F.coalesce("doc_type", F.lit("None"))
    error = F.when((F.col("doc_type") == "sphinx") & ~located, NO_INVENTORY_ERROR).when(
        ~located & (kind != "doxygen"), F.concat(F.lit(UNSUPPORTED_ERROR), F.lit("'"), kind, F.lit("'"))
    )
    known = status.select("source", "doc_type", "inventory_url").join(per_source, "source", "left")
    return known.select("source", F.when(error.isNull(), line).alias("line"), error.alias("error"))


def write_json(lines: DataFrame, path: str) -> None:
    """One JSON line per row, as text files, the head of each query before its candidates."""
    _write_lines(lines, path, ["query_id", "rank"])
