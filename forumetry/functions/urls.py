"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The query keys of a permalink that say what it points at, in the order in which they are kept.
POST_KEYS = ("story_fbid", "id", "fbid")
COMMENT_KEYS = ("story_fbid", "id", "comment_id", "fbid")


def part(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))


def query_value(url: Column, key: str) -> Column:
    """The value of a query key, null without it."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


#: Groups: scheme, host with port, path, query.
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def quoted(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _encoded(value: Column) -> Column:
    """A query value decoded and encoded again, so that equal values are written alike."""
    return quoted(F.coalesce(F.try_url_decode(value), value))


def rebuilt(url: Column, query: Column, path: Column | None = None) -> Column:
    """url with another query and path, without fragment."""
    scheme, host = F.lower(F.regexp_extract(url, _PARTS, 1)), F.regexp_extract(url, _PARTS, 2)
    path = F.regexp_extract(url, _PARTS, 3) if path is None else path
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def normal_permalink(url: Column, keys: tuple[str, ...] = COMMENT_KEYS) -> Column:
    """Scheme, host and port, path without last slashes, and of the query only the given keys, each with its last value, even a blank one; no
    fragment. Empty for null."""
    url = F.coalesce(url, F.lit(""))
    pairs = F.split(F.regexp_extract(url, _PARTS, 4), "&")
    last = lambda k: F.try_element_at(F.filter(pairs, lambda x: (x == k) | x.startswith(f"{k}=")), F.lit(-1))
    query = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), _encoded(F.substr(last(k), F.lit(len(k) + 2)))) for k in keys))
    return rebuilt(url, query, F.regexp_replace(F.regexp_extract(url, _PARTS, 3), "/+$", ""))


#: Paths that many posts share.
GENERIC_PATHS = ("/reel", "/videos", "/watch")


def post_permalink(own: Column, candidate: Column, detail: Column) -> Column:
    """The first of a post's normal permalinks whose path isn't generic; the first that isn't empty if all are."""
    made = [normal_permalink(x, POST_KEYS) for x in (own, candidate, detail)]
    special = lambda x: F.when((x != "") & ~F.regexp_extract(x, _PARTS, 3).isin(*GENERIC_PATHS), x)
    return F.coalesce(*map(special, made), *(F.nullif(x, F.lit("")) for x in made), F.lit(""))


def shared_origin(page_id: Column, origin_id: Column, origin_link: Column, source_url: Column) -> Column:
    """The id of what a post re-shares: if its link is below the source's own URL, the id that this source's post has."""
    link, source = normal_permalink(origin_link, POST_KEYS), normal_permalink(source_url, POST_KEYS)
    same = (F.coalesce(origin_link, F.lit("")) != "") & (F.coalesce(source_url, F.lit("")) != "") & F.startswith(link, F.regexp_replace(source, "/+$", ""))
    return F.when(same, F.sha1(F.concat_ws("::", page_id, link))).otherwise(origin_id)


def localised(url: Column) -> Column:
    """url with locale=en_US, in the place of the locale it had, else behind its query."""
    pairs = F.filter(F.split(F.regexp_extract(url, _PARTS, 4), "&"), lambda x: x != "")
    known = F.exists(pairs, lambda x: x.startswith("locale="))
    set_ = F.transform(pairs, lambda x: F.when(x.startswith("locale="), "locale=en_US").otherwise(x))
    return rebuilt(url, F.concat_ws("&", set_, F.when(~known, "locale=en_US")))


def mobile_page(url: Column) -> Column:
    return F.concat(F.lit("https://m.facebook.com"), F.regexp_replace(F.regexp_extract(url, _PARTS, 3), "/+$", ""))


def page_tab(url: Column, tab: str) -> Column:
    return localised(F.concat(F.regexp_replace(url, "/+$", ""), F.lit(f"/{tab}")))


#: What the page plugin is asked for.
PLUGIN = (
    ("tabs", "timeline"), ("width", "500"), ("height", "5000"), ("small_header", "false"), ("adapt_container_width", "true"), ("hide_cover", "false"), ("show_facepile", "false"), ("locale", "en_US"),
)


def page_plugin(url: Column) -> Column:
    rest = "&".join(f"{k}={v}" for k, v in PLUGIN)
    return F.concat(F.lit("https://www.facebook.com/plugins/page.php?href="), quoted(url), F.lit(f"&{rest}"))


def status_origin(external: Column, link: Column) -> Column:
    """The id of a quoted status: with its author's name if the link has one, else as an unknown origin's."""
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(link, F.lit("")), _PARTS, 3), "/"), lambda x: x != "")
    name = F.regexp_replace(F.get(parts, F.lit(0)), "^@+", "")
    named = (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == "status") & (name != "") & (name != "i")
    return F.when(F.coalesce(external, F.lit("")) != "", F.when(named, F.concat(F.lit("x:"), name, F.lit(":"), external)).otherwise(F.concat(F.lit("x:origin:"), external)))


def forward_origin(link: Column, number: Column) -> Column:
    """struct<id, external>: of a forwarded message, by its link's channel and number, else by its number alone."""
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(link, F.lit("")), _PARTS, 3), "/"), lambda x: x != "")
    deep = (F.get(parts, F.lit(0)) == "s") & (F.size(parts) >= 3)
    channel, message = F.get(parts, F.when(deep, 1).otherwise(0)), F.get(parts, F.when(deep, 2).otherwise(1))
    own = F.coalesce(F.nullif(F.trim(number), F.lit("")), message_id(F.coalesce(link, F.lit(""))))
    made = lambda i, e: F.struct(i.alias("id"), e.alias("external"))
    none = F.lit(None).cast("string")
    return (
        F.when(message.isNotNull(), made(F.concat_ws(":", F.lit("telegram"), channel, message), message))
        .when(own.isNotNull(), made(F.concat(F.lit("telegram:origin:"), own), own)).otherwise(made(none, none))
    )


def path_part(url: Column, k: int) -> Column:
    """The k-th part of the path, from 1, or from the end if negative; null without it."""
    parts = F.filter(F.split(part(url, "PATH"), "/"), lambda x: x != "")
    return F.try_element_at(parts, F.lit(k))


def page_reference(url: Column) -> Column:
    """The query's id, or else the last part of the path."""
    return F.coalesce(query_value(url, "id"), path_part(url, -1))


def media_id(url: Column) -> Column:
    """The first number that names a medium: fbid, v, /videos/n, /reel/n."""
    text = F.coalesce(url, F.lit(""))
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"[?&]fbid=(\d+)", r"[?&]v=(\d+)", r"/videos/(?:[^/]+/)?(\d+)", r"/reel/(\d+)")))


def numeric_media_id(url: Column) -> Column:
    """The number of a reel, video, photo or story in a link; null without any."""
    text = F.coalesce(url, F.lit(""))
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"/reel/(\d+)", r"/videos/(\d+)", r"[?&]fbid=(\d+)", r"[?&]story_fbid=(\d+)")))


def message_id(url: Column) -> Column:
    """The number of a message in a channel's path, with or without its preview prefix."""
    return F.nullif(F.regexp_extract(part(url, "PATH"), r"^/(?:s/)?[^/]+/(\d+)", 1), F.lit(""))


def source_name(url: Column) -> Column:
    first = path_part(url, 1)
    return F.when(first == "s", path_part(url, 2)).otherwise(first)
