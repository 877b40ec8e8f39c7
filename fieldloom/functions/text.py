"""String functions as column expressions: all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning of their own in a label.
STOP_WORDS = ["the", "and", "for", "with", "this", "that", "from"]
#: XML entities, in the order of replacement.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]


def normalise(text: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and white space becomes a space; runs are squeezed. Null is empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def tokens(text: Column, least: int = 3) -> Column:
    """Tokens of a normalised text with at least ``least`` characters."""
    return F.filter(F.split(normalise(text), " "), lambda t: F.length(t) >= least)


def semantic_tokens(text: Column) -> Column:
    """Distinct tokens after splitting camel case, without stop words."""
    return F.array_except(tokens(split_camel(text)), F.array(*map(F.lit, STOP_WORDS)))


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def label_of_code(code: Column) -> Column:
    """A readable label: underscores and camel case become spaces."""
    return F.trim(F.regexp_replace(split_camel(F.regexp_replace(code, "_", " ")), r"\s+", " "))


def strip_digit_commas(text: Column) -> Column:
    return F.regexp_replace(text, r"(\d),(?=\d)", "$1")


def escape_xml(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape_xml(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def xml_tag(text: Column) -> Column:
    """A legal tag name; ``Field`` where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(text, r"[^A-Za-z0-9_.-]|^[^A-Za-z_]+", ""), F.lit("")), F.lit("Field"))


def canonical_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def storage_key(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-")


def quoted_question(text: Column) -> Column:
    """The longest quoted part that ends with a question mark; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(r'"([^"]*\?)"'), F.lit(1))
    longest = F.array_max(F.transform(found, lambda q, i: F.struct(F.length(q).alias("n"), (-i).alias("at"), q.alias("q"))))
    return longest["q"]


def dice(left: Column, right: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of two token arrays' distinct values; 0 if either is empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    value = 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def overlap(left: Column, right: Column) -> Column:
    """|A and B| / min(|A|, |B|); 0 if either is empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def anchor_score(query: Column, label: Column) -> Column:
    """Share of query tokens that hold, or are held by, a label token; both are token arrays."""
    hit = F.filter(query, lambda q: F.exists(label, lambda t: t.contains(q) | q.contains(t)))
    return F.when((F.size(query) == 0) | (F.size(label) == 0), 0.0).otherwise(F.size(hit) / F.size(query))


def windows(items: Column, least: int = 2, most: int = 4) -> Column:
    """All runs of ``least`` to ``most`` neighbouring tokens, joined by spaces."""
    starts = F.transform(items, lambda _, i: i + 1)

    def of(n: int) -> Column:
        fit = F.filter(starts, lambda i: i + (n - 1) <= F.size(items))
        return F.transform(fit, lambda i: F.array_join(F.slice(items, i, n), " "))

    return F.concat(*map(of, range(least, most + 1)))


def neighbourhood(items: Column, radius: int = 2) -> Column:
    """For every token the sorted distinct others within ``radius`` places."""

    def around(token: Column, i: Column) -> Column:
        near = F.slice(items, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1)
        return F.struct(token.alias("token"), F.array_sort(F.array_distinct(F.filter(near, lambda t: t != token))).alias("near"))

    return F.transform(items, around)


#: The collation of sorted names: Unicode's own order, where case and accents tell only otherwise equal words apart.
COLLATION = "UNICODE"


def sorted_distinct(names: Column) -> Column:
    """The distinct names (of an array) in Unicode's collation order, binary order among those that it takes for equal; nulls go."""
    keyed = F.transform(F.array_sort(F.array_distinct(F.array_compact(names))), lambda v, k: F.struct(F.collate(v, COLLATION).alias("c"), k.alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


#: The stamp of hashed artefacts, which depend on no clock (fixed value).
CANONICAL_TIME = "1970-01-01T00:00:00.000Z"


def iso_time(at: Column) -> Column:
    """A time as ISO text with milliseconds in UTC, as sessions here run in UTC; later digits are cut."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def next_attempt(at: Column, wait_s: int = 30) -> Column:
    """When a failed call is tried again."""
    return at + F.make_dt_interval(secs=F.lit(wait_s))
