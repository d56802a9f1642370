"""Column expressions for names, keyword queries, scores and extracted text.

Everything here stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.html import NOISE_TEXT

# --- fixed values -----------------------------------------------------------
# Boundaries between the segments of an identifier.
SEGMENT_BOUNDARY = r"[_:\-]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

# Score of each way a term can match a name, and the cap of the similarity tier.
SCORE_EXACT = 100.0
SCORE_SEGMENT = 97.0
SCORE_SEGMENT_PREFIX = 94.0
SCORE_CONTAINED = 88.0
SIMILARITY_CAP = 82.0
DEFAULT_THRESHOLD = 60.0

# Ranking bonus of a symbol's role; roles not listed get 0, a missing role counts as "".
ROLE_ADJUST = {
    "function": 4.0,
    "type": 1.0,
    "macro": 0.0,
    "enum": -3.0,
    "data": -3.0,
    "": -5.0,
    "enumerator": -8.0,
    "label": -10.0,
}

# Section heading of a reference page -> role of the members below it.
SECTION_ROLE = {
    "functions": "function",
    "typedefs": "type",
    "enumerations": "enum",
    "defines": "macro",
    "variables": "data",
}

# Language label of an index entry -> domain; other labels are lower-cased.
LANGUAGE_DOMAIN = {"C++": "cpp", "C": "c", "Python": "py"}

# Text of an index entry: name (language role)
INDEX_ENTRY = r"(?U)^(.+?)\s+\((\w+(?:\+\+)?)\s+(\w+)\)$"
# ----------------------------------------------------------------------------

# Whitespace in the sense of str.strip(): Unicode white space and the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"


def pinned(value: Column) -> Column:
    """The same value, computed once where it is written.

    A filter on a plain column is moved below the projection that defines it, with
    the definition copied into it.  For a long definition that costs more than the
    early filter saves; a nondeterministic one stays in place.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def segments(name: Column) -> Column:
    """Lower-cased segments of an identifier, empty ones dropped."""
    lowered = F.transform(F.split(name, SEGMENT_BOUNDARY), lambda s: F.lower(s))
    return F.filter(lowered, lambda s: s != "")


def bare_name(name: Column) -> Column:
    """Name without the parameter list of a signature."""
    return strip(F.substring_index(name, "(", 1))


# Separates segments in one string; str.split() treats it as a space, so no term contains it.
SEGMENT_MARK = "\x1f"


def segment_text(name: Column) -> Column:
    """Segments of an identifier as one marked string, which unlike an array keeps code generation."""
    plain = F.translate(name, SEGMENT_MARK, "\x1e")
    marked = F.lower(F.regexp_replace(plain, SEGMENT_BOUNDARY, SEGMENT_MARK))
    return F.concat(F.lit(SEGMENT_MARK), marked, F.lit(SEGMENT_MARK))


def tier_score(term: Column, lowered: Column, bare: Column, marked: Column) -> Column:
    """Score of a lower-cased term by containment; NULL where only similarity is left.

    ``lowered`` is the lower-cased name, ``bare`` its lower-cased bare form and
    ``marked`` the segment text of the bare form.
    """
    prefix = F.concat(F.lit(SEGMENT_MARK), term)
    return (
        F.when((term == lowered) | (term == bare), SCORE_EXACT)
        .when(marked.contains(F.concat(prefix, F.lit(SEGMENT_MARK))), SCORE_SEGMENT)
        .when(marked.contains(prefix), SCORE_SEGMENT_PREFIX)
        .when(lowered.contains(term) | bare.contains(term), SCORE_CONTAINED)
    )


def role_adjust(role: Column) -> Column:
    bonus = F.lit(0.0)
    for name, value in ROLE_ADJUST.items():
        bonus = F.when(F.coalesce(role, F.lit("")) == name, value).otherwise(bonus)
    return bonus


def ranked_score(base: Column, bonus: Column) -> Column:
    """Match score moved by the role bonus and clipped to 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + bonus))


def or_groups(keywords: Column) -> Column:
    """``a b | c`` -> [[a, b], [c]]: space is AND, a lone ``|`` is OR, empty groups vanish."""
    normal = collapse_spaces(F.coalesce(keywords, F.lit("")))
    parts = F.split(normal, r"(?:^| )\|(?= |$)")
    groups = F.transform(parts, lambda p: F.filter(F.split(p, " "), lambda t: t != ""))
    return F.filter(groups, lambda g: F.size(g) > 0)


def has_keywords(keywords: Column) -> Column:
    """False for a missing or blank query, which keeps every row; a pipe-only one keeps none."""
    return collapse_spaces(F.coalesce(keywords, F.lit(""))) != ""


def domain_set(domains: Column) -> Column:
    """NULL (no filter) for a missing value or ``all``, else the listed domains."""
    listed = F.transform(F.split(domains, ","), lambda d: strip(d))
    return F.when(
        domains.isNotNull() & (F.lower(domains) != "all"),
        F.array_distinct(F.filter(listed, lambda d: d != "")),
    )


def in_domains(kind: Column, domain: Column, wanted: Column) -> Column:
    """Domain filter; group links have no domain and always pass."""
    return wanted.isNull() | (kind == "group") | F.coalesce(F.array_contains(wanted, domain), F.lit(False))


def is_noise(text: Column) -> Column:
    return text.isNull() | strip(text).isin(sorted(NOISE_TEXT))


def normalize_lines(text: Column) -> Column:
    """Runs of blanks become one space, lines are stripped, blank lines dropped."""
    blanks = F.regexp_replace(text, "[ \t]+", " ")
    # White space around a line break belongs to line ends or blank lines.
    return strip(F.regexp_replace(blanks, r"(?U)[\s\x1c-\x1f&&[^\n]]*+\n[\s\x1c-\x1f]*+", "\n"))


def section_role(heading: Column) -> Column:
    """Role of a member from the section heading above it."""
    role = F.lit("")
    for title, value in SECTION_ROLE.items():
        role = F.when(F.lower(heading) == title, value).otherwise(role)
    return role


def language_domain(language: Column) -> Column:
    domain = F.lower(language)
    for label, value in LANGUAGE_DOMAIN.items():
        domain = F.when(language == label, value).otherwise(domain)
    return domain


def page_domain(page_url: Column, cpp_groups: Column, default_domain: Column) -> Column:
    """``cpp`` where a configured pattern occurs in the page URL, else the source's default."""
    is_cpp = F.exists(cpp_groups, lambda p: page_url.contains(p))
    return F.when(F.coalesce(is_cpp, F.lit(False)), "cpp").otherwise(
        F.coalesce(default_domain, F.lit(""))
    )
