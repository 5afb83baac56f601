"""Text functions as Column expressions: tokens, slugs, compact numbers, counters, excerpts and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOPWORDS = ("the", "and", "that", "with", "this", "from", "для", "это", "как", "что", "але", "про", "если", "they", "have")
#: Units behind a compact number, longest first.
UNITS = ("views", "view", "followers", "follower", "likes", "like", "reposts", "repost", "replies", "reply", "bookmarks", "bookmark")
MULTIPLIERS = {"K": 1_000, "M": 1_000_000, "B": 1_000_000_000}


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def excerpt(text: Column, n: int = 220) -> Column:
    """The first n characters; empty for null."""
    return F.substring(or_empty(text), 1, n)


def words(text: Column) -> Column:
    """Lower-case runs of word characters and apostrophes, in any script."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"(?U)[\w']+"), F.lit(0))


def keyword_tokens(text: Column) -> Column:
    """Words of over two characters that aren't stop words."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, joined by hyphens; `item` if there are none."""
    made = F.lower(F.regexp_replace(F.regexp_replace(or_empty(text), r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))
    return F.when(made == "", F.lit("item")).otherwise(made)


def compact_number(text: Column) -> Column:
    """`1.2K` as 1200, `3,456 views` as 3456; otherwise the number that the digits make, 0 without any."""
    bare = F.trim(F.regexp_replace(F.trim(or_empty(text)), "[,  ]", ""))
    for unit in UNITS:
        bare = F.replace(bare, F.lit(f" {unit}"), F.lit(""))
    bare = F.trim(bare)
    pattern = r"^(?i)(\d+(?:\.\d+)?)([KMB])?$"
    base, suffix = F.regexp_extract(bare, pattern, 1), F.upper(F.regexp_extract(bare, pattern, 2))
    times = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MULTIPLIERS.items() for x in kv)), suffix), F.lit(1))
    digits = F.regexp_replace(bare, r"[^\d]", "")
    return F.when(base != "", (F.try_to_number(base, F.lit("999999999999999.999999")).cast("double") * times).cast("long")).otherwise(F.coalesce(digits.try_cast("long"), F.lit(0)))


def metric_count(text: Column) -> Column:
    """The first number of a label, with K or M behind it, which also counts as the first letter of the next word; 0 without any."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*([KM]?)"
    bare = F.replace(or_empty(text), F.lit(","), F.lit(""))
    number, suffix = F.regexp_extract(bare, pattern, 1).try_cast("double"), F.upper(F.regexp_extract(bare, pattern, 2))
    times = F.when(suffix == "K", 1_000).when(suffix == "M", 1_000_000).otherwise(1)
    return F.coalesce((number * times).cast("long"), F.lit(0))


def comment_counter(text: Column) -> Column:
    """A number before or behind the word for comments, in English, Ukrainian or Russian; 0 without any."""
    word = "(?:comments?|коментар\\p{L}*|комментари\\p{L}*)"
    before, behind = F.regexp_extract(or_empty(text), rf"(?iu)(\d[\d,.]*\s*[KM]?)\s*{word}", 1), F.regexp_extract(or_empty(text), rf"(?iu){word}\s*[:•-]?\s*(\d[\d,.]*\s*[KM]?)", 1)
    found = F.when(before != "", before).otherwise(behind)
    return F.when(found == "", F.lit(0)).otherwise(compact_number(F.regexp_replace(found, r"\s+", "")))


def stable_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("::", *parts))


def text_hash(text: Column) -> Column:
    return F.sha2(or_empty(text), 256)


def native_id(identifier: Column) -> Column:
    """The last part of an id of the form platform:source:id."""
    return F.element_at(F.split(identifier, ":"), -1)


def username(text: Column) -> Column:
    """A name without @, from itself or from the first part of a URL's path."""
    path = F.regexp_extract(or_empty(text), r"^https?://[^/]+/([^/?#]+)", 1)
    return F.lower(F.regexp_replace(F.when(path != "", path).otherwise(F.trim(or_empty(text))), "^@+", ""))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: bound to a lambda's variable, it isn't copied into each place that reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Fixed value: an expression for icon characters that some pages' texts come with when they were decoded wrongly.
ICONS = "ô(?:¸|¤¦|Œ«)"

#: Blanks of any kind, the characters that Unicode calls White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def clean_mobile_text(text: Column) -> Column:
    """Without private-use characters and icons; runs of spaces and tabs are one space, runs of three line ends and more are two."""
    bare = F.regexp_replace(F.replace(or_empty(text), F.lit("\u00a0"), F.lit(" ")), r"\p{Co}", "")
    bare = F.regexp_replace(bare, ICONS, " ")
    # a single space is no match: it would be replaced by itself, between any two words
    return stripped(F.regexp_replace(F.regexp_replace(bare, r"[ \t](?:[ \t]+|(?<=\t))", " "), r"\n{3,}", "\n\n"))


def canonical_post_text(text: Column) -> Column:
    """Lower-case text without fold marks and lines that begin with a handle, blanks as one space; equal for two views of one post."""
    folded = F.replace(F.lower(clean_mobile_text(text)), F.lit("see more"), F.lit(""))
    return stripped(F.regexp_replace(F.regexp_replace(folded, r"(?md)^@\S.*$", ""), r"(?U)\s+", " "))


def safe_int(text: Column) -> Column:
    """The whole number that a text is; null for anything else."""
    return F.trim(text.cast("string")).try_cast("long")
