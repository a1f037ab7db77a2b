"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the reducer drops (fixed values).
FILLER_WORDS = (
    "a an and are as at be been being but by for from had has have he her him his i in into is it its of on or our she that the their "
    "them they this to was we were will with you your over it's"
).split()

#: A token of a text in lower case.
TOKEN = "[a-z0-9]+(?:-[a-z0-9]+)*"


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens, with inner hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(text: Column) -> Column:
    """A query's tokens of two characters or more, each once."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 2))


def reduce_filler(text: Column, dropped: list[str] = FILLER_WORDS) -> Column:
    """The text's words without filler words and without tokens of punctuation only. Applying it twice changes nothing."""
    keep = lambda w: ~F.regexp_replace(F.lower(w), "^[^a-z0-9]+|[^a-z0-9]+$", "").isin(dropped) & w.rlike("[\\p{L}\\p{N}]")
    return F.array_join(F.filter(words(text), keep), " ")


def slices(text: Column, size: int) -> Column:
    """Pieces of `size` characters."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(text, i * size + 1, F.lit(size))))


def first_sentences(text: Column, max_length: int) -> Column:
    """Whole sentences from the front, as long as they fit."""
    zero = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))

    def add(state: Column, s: Column) -> Column:
        longer = F.when(state["out"] == "", s).otherwise(F.concat(state["out"], F.lit(" "), s))
        fits = state["open"] & (F.length(longer) <= max_length)
        return F.struct(F.when(fits, longer).otherwise(state["out"]).alias("out"), fits.alias("open"))

    return F.aggregate(sentences(text), zero, add, lambda state: state["out"])


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, / for an empty path."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    rest = F.substring(bare, F.length(head) + 1, F.lit(2**31 - 1))
    return F.when(head == "", bare).otherwise(F.concat(head, F.when(rest == "", "/").otherwise(rest)))


def node_id(*parts: Column) -> Column:
    """A stable id of a graph node."""
    return F.concat(F.lit("node-"), F.substring(F.sha1(F.concat_ws(":", *parts).cast("binary")), 1, 16))


def qualified_name(path: Column, name: Column) -> Column:
    """The last three parts of a path, without the extension, and a name, joined by dots."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "\\.[^./]*$", ""), "/"), lambda p: p != "")
    return F.array_join(F.concat(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), F.array(name)), ".")
