"""Fixed schemas of the relations the operators exchange.

Row order never carries meaning: ``source_ord`` orders sources, ``pos`` orders
the symbols of one source, ``request_ord`` orders the requests of one query.
"""

from pyspark.sql import types as T


def _fields(*specs: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, null) for name, dtype, null in specs])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_LIST = T.ArrayType(_S)

SOURCES = _fields(
    ("name", _S, True),
    ("source_ord", _I, False),
    ("description", _S, True),
    ("doc_type", _S, True),
    ("inventory_urls", _LIST, True),
    ("index_url", _S, True),
    ("doc_url", _S, True),
    ("base_urls", _LIST, True),
    ("match_threshold", _D, True),
    ("tags", _LIST, True),
    ("repo", _S, True),
    ("default_domain", _S, True),
    ("cpp_groups", _LIST, True),
    ("override_url", _S, True),
)

SYMBOLS = _fields(
    ("source", _S, False),
    ("source_ord", _I, False),
    ("pos", _L, False),
    ("kind", _S, False),  # inventory | group | member | index
    ("group", _S, True),
    ("url", _S, True),
    ("role", _S, True),
    ("domain", _S, True),
    ("origin", _S, True),
)

PAGES = _fields(("url", _S, False), ("html", _S, True))

CRAWL_LOG = _fields(
    ("url", _S, False),
    ("status", _I, True),
    ("final_url", _S, True),
    ("content_type", _S, True),
    ("error", _S, True),
    ("fetched_at", T.TimestampType(), True),
)

QUERIES = _fields(
    ("query_id", _S, False),
    ("keywords", _S, True),
    ("domains", _S, True),
    ("fuzzy", _B, False),
    ("threshold", _D, True),
    ("max_results", _I, True),
)

REQUESTS = _fields(("query_id", _S, False), ("request_ord", _I, False), ("requested", _S, False))

SYMBOL_COLUMNS = SYMBOLS.fieldNames()
