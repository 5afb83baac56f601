"""Texts of pages as Column expressions: which lines are controls, what a post or comment says without them, who wrote it and when."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumetry.functions.text import clean_mobile_text, comment_counter, compact_number, let, metric_count, or_empty, stripped
from forumetry.functions.times import date_hint, either, posted_in

#: Lines that are a comment's controls, in English, Ukrainian and Russian.
CONTROLS = (
    "Like", "Reply", "Replies", "Most relevant", "All comments", "Newest", "Подобається", "Відповісти", "Відповіді", "Найактуальніші", "Усі коментарі", "Найновіші",
    "Нравится", "Ответить", "Ответы", "Все комментарии", "Новые",
)
#: Other lines that are nobody's name.
NO_NAMES = ("Comment", "Share", "View more comments", "Show more comments", "See more comments", "Коментарі", "Комментарии")
#: Lines of a page around a post, lines that end it, and lines of the mobile page.
AROUND = ("Log In", "Forgot Account?", "More", "Home", "Live", "Reels", "Explore", "Follow", "Comments", "Video", "Public", "Like", "Comment", "Share")
ENDING = (
    "Like", "Comment", "Share", "Comments", "Related Reels", "Related Videos", "Pages", "Privacy", "See more on Facebook", "Email or phone number", "Password", "Create new account",
)
MOBILE = ("Open app", "Log in", "Follow", "Reels", "Photos", "Videos", "See all", "Create new account")
#: Markers of a page that asks to log in, and of texts that are none of a post.
LOGIN = ("Log In", "Forgot password?", "Forgot Account?", "Create new account", "See more on Facebook", "Email or phone number", "Password")
NOISE = ("Log In", "Forgot Account?", "See more on Facebook")
#: Words with which a post's text ends, a separator that was decoded wrongly, and words of lines that count or name answers.
CUTS = (("Most", "relevant"), ("All", "reactions:"), ("Like", "Comment"))
SEPARATOR = "Â·"
ANSWER_COUNTED = ("Reply", "Replies", "відповідь", "відповіді", "відповідей", "ответ", "ответа", "ответов", "ответы")
ANSWERED = ("replied", "відповів", "відповівла", "ответил", "ответила")
#: A line without letters and with one number, and without letters and numbers.
NUMBER, BARE = r"[^\p{L}\p{N}]*\p{Nd}+[^\p{L}\p{N}]*", r"[^\p{L}\p{N}]+"
#: Characters of a text that says something, and of a name at most.
MEANINGFUL, LONGEST_NAME, LONGEST_PART = 20, 80, 40


def lines(text: Column) -> Column:
    """The lines that aren't blank, without blanks around them."""
    return F.filter(F.transform(F.split(F.replace(or_empty(text), F.lit("\u00a0"), F.lit(" ")), r"\R"), stripped), lambda x: x != "")


def first_hint(values: Column) -> Column:
    """The first date in lines; empty without any. Lines behind it are not searched."""
    return F.aggregate(values, F.lit(""), lambda found, x: F.when(found != "", found).otherwise(date_hint(x)))


def while_last(values: Column, gone) -> Column:
    """values without those at the end for which gone holds. Those before the last that stays are not tested; a count below 0 is a final one."""
    step = lambda n, x: F.when(n < 0, n).when(~gone(x), -n - 1).otherwise(n + 1)
    count = lambda v: F.aggregate(F.reverse(v), F.lit(0), step, lambda n: F.when(n < 0, -n - 1).otherwise(n))
    return let(values, lambda v: F.slice(v, F.lit(1), F.size(v) - count(v)))


def whole(pattern: str) -> str:
    return f"(?iu)^(?:{pattern})$"


def reaction_count(title: Column) -> Column:
    return metric_count(F.regexp_extract(or_empty(title), r"(?i)(\d+(?:\.\d+)?\s*[KM]?)\s+reactions", 1))


def discussion_count(text: Column) -> Column:
    """The number before the word for comments or replies on a button; 0 without any."""
    return compact_number(F.regexp_extract(or_empty(text), r"(?iu)(\d+(?:[.,]\d+)?\s*[KMB]?)\s*(?:comments?|repl(?:y|ies)|discussion|комментари(?:й|я|ев)|ответ(?:ов|а|ы)?)", 1))


def visible_comments(*texts: Column) -> Column:
    """The first comment counter above 0 in the lines of the texts, one text after the other; 0 without any."""
    found = F.filter(F.transform(F.flatten(F.array(*map(lines, texts))), comment_counter), lambda n: n > 0)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(0))


def login_wall(body: Column) -> Column:
    """Whether a page asks to log in: two of the markers at least."""
    text = F.replace(or_empty(body), F.lit("\u00a0"), F.lit(" "))
    return sum((text.contains(m).cast("int") for m in LOGIN), F.lit(0)) >= 2


def meaningful(text: Column) -> Column:
    bare, noisy = stripped(or_empty(text)), F.lit(False)
    for token in NOISE:
        noisy = noisy | bare.contains(token)
    return (F.length(bare) >= MEANINGFUL) & ~noisy


def control_line(line: Column) -> Column:
    return clean_control_line(clean_mobile_text(line))


def clean_control_line(line: Column) -> Column:
    """The same of a line that is clean already."""

    def test(bare: Column) -> Column:
        answers = r"\d+\s+" + either(ANSWER_COUNTED) + r"|.{1,80}\s+" + either(ANSWERED)
        return (bare == "") | bare.isin(*CONTROLS) | bare.rlike(whole(f"{BARE}|{answers}")) | (bare == SEPARATOR)

    return let(F.btrim(line, F.lit(" \t.;:|")), test)


def around_line(line: Column, page: Column) -> Column:
    """Whether a line belongs to the page around a post: a button, the page's name, a length of time, a number of views."""
    return line.isin(*AROUND) | (line == page) | line.rlike(r"^\d+:\d+(?:\s*/\s*\d+:\d+)?$") | line.rlike(r"(?i)^\d+(?:\.\d+)?\s*[KM]?(?:\s+views?)?$")


def post_text(raw: Column, hint: Column) -> Column:
    """A post's text, up to the buttons below it, without the label of its time before it."""
    text = stripped(F.replace(or_empty(raw), F.lit("\u00a0"), F.lit(" ")))
    text = let(text, lambda t: F.when(t.contains(SEPARATOR), stripped(F.substr(t, F.locate(SEPARATOR, t) + F.lit(len(SEPARATOR))))).otherwise(t))
    for words in CUTS:
        ends = r"\b" if words[-1][-1].isalnum() else ""
        text = stripped(F.regexp_replace(text, r"(?is)\b" + r"\s+".join(words) + ends + ".*$", ""))
    hint = or_empty(hint)
    return let(text, lambda t: F.when((hint != "") & F.startswith(t, hint), stripped(F.substr(t, F.length(hint) + 1))).otherwise(t))


def body_text(body: Column, description: Column, page: Column) -> Column:
    """The text of a page's body: from the first line of 20 characters that isn't around a post, to a line that ends it; else the description."""
    long_enough = lambda x: ~around_line(x, page) & (F.length(x) >= MEANINGFUL)
    from_first = let(lines(body), lambda v: F.slice(v, F.greatest(F.array_position(F.transform(v, long_enough), True), F.lit(1)).cast("int"), F.when(F.array_contains(F.transform(v, long_enough), True), F.size(v)).otherwise(0)))
    end = lambda v: F.array_position(F.transform(v, lambda x, k: (k > 0) & x.isin(*ENDING)), True).cast("int")
    kept = let(from_first, lambda v: F.array_join(F.slice(v, F.lit(1), F.when(end(v) > 0, end(v) - 1).otherwise(F.size(v))), "\n"))
    return let(stripped(kept), lambda t: F.when(F.length(t) >= MEANINGFUL, t).otherwise(stripped(or_empty(description))))


def comment_text(raw: Column, author: Column, hint: Column, now: Column) -> Column:
    """A comment's text without its author, its time, controls, and numbers or times behind it."""
    author, hint = or_empty(author), or_empty(hint)
    text = stripped(F.replace(or_empty(raw), F.lit("\u00a0"), F.lit(" ")))
    text = let(text, lambda t: F.when((author != "") & F.startswith(t, author), F.ltrim(F.substr(t, F.length(author) + 1), F.lit(" \t:,-"))).otherwise(t))
    is_hint = lambda x: (hint != "") & (F.lower(x) == F.lower(hint))
    without_first = lambda v, test: let(v, lambda w: F.slice(w, F.when(test(F.get(w, F.lit(0))), 2).otherwise(1), F.greatest(F.size(w), F.lit(1))))
    found = F.transform(F.filter(F.split(text, r"\R"), lambda x: x.rlike(r"(?U)\S")), clean_mobile_text)
    found = without_first(without_first(found, lambda x: (author != "") & (x == author)), is_hint)
    found = let(found, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - F.when(is_hint(F.try_element_at(v, F.lit(-1))), 1).otherwise(0), F.lit(0))))
    found = F.filter(found, lambda x: ~clean_control_line(x))
    found = while_last(while_last(found, lambda x: x.rlike(whole(NUMBER))), lambda x: posted_in(x, now).isNotNull())
    return let(stripped(F.array_join(found, "\n")), lambda t: F.when((t == hint) | (t == author), "").otherwise(t))


def plausible_author(name: Column, now: Column) -> Column:
    def test(bare: Column) -> Column:
        short = (bare != "") & (F.length(bare) <= LONGEST_NAME) & ~bare.contains("\n")
        return short & ~clean_control_line(bare) & posted_in(bare, now).isNull() & ~bare.rlike(whole(NUMBER)) & ~bare.isin(*CONTROLS, *NO_NAMES)

    return let(clean_mobile_text(name), test)


def named_author(raw: Column, now: Column) -> Column:
    """The author by a comment's text: its first two words if both are written like names, else the first line that may be a name, else the
    first line if it's neither a control nor a time; null without any."""
    apart = lambda line: F.regexp_replace(line, "(?<=[a-zа-яіїєґ])(?=[A-ZА-ЯІЇЄҐ])", " ")
    parts = lambda line: F.regexp_extract_all(apart(line), F.lit("[A-Za-zЀ-ӿ'’-]+"), F.lit(0))
    upper = lambda x: (F.length(x) <= LONGEST_PART) & (F.left(x, F.lit(1)).rlike(r"^\p{Lu}") | ((F.upper(x) == x) & (F.lower(x) != x)))
    both = lambda p: F.when(upper(F.get(p, F.lit(0))) & upper(F.get(p, F.lit(1))), F.concat_ws(" ", F.slice(p, 1, 2)))

    def choose(v: Column) -> Column:
        first = F.get(v, F.lit(0))
        name = let(parts(first), both)
        known = let(name, lambda n: F.when(n.isNotNull() & plausible_author(n, now), n))
        own = F.when(first.isNotNull() & ~control_line(first) & posted_in(first, now).isNull(), first)
        # lines behind the first that may be a name are not tested
        line = F.aggregate(v, F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).when(plausible_author(x, now), x))
        return F.coalesce(known, line, own)

    return let(lines(clean_mobile_text(raw)), choose)


def comment_author(name: Column, raw: Column, now: Column) -> Column:
    """The author that the page names, if that may be a name, else the one that the text tells."""
    return let(clean_mobile_text(name), lambda n: F.when(plausible_author(n, now), n).otherwise(named_author(raw, now)))


def comment_hint(raw: Column) -> Column:
    """The first date in a comment's lines, from the second on; empty without any."""
    return let(lines(raw), lambda v: first_hint(F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1)))))


def body_hint(body: Column, page: Column) -> Column:
    """The first date in the four lines behind the page's name, else in any line; empty without any."""

    def choose(v: Column) -> Column:
        near = F.flatten(F.transform(v, lambda x, k: F.when(x == page, F.slice(v, k + 2, F.lit(4))).otherwise(F.array().cast("array<string>"))))
        return let(first_hint(near), lambda h: F.when(h != "", h).otherwise(first_hint(v)))

    return let(lines(body), choose)


def mobile_hint(text: Column) -> Column:
    """The age in a mobile page's header; empty without any."""
    return F.regexp_extract(or_empty(text), r"(?iU)\b\d+\s*(?:m(?:in)?s?|h|d|w)\b", 0)


def mobile_header(text: Column, page: Column) -> Column:
    """Whether an item is the header of a post: an age, and the page's name in its first line."""
    return (mobile_hint(text) != "") & F.get(F.split(text, r"\R"), F.lit(0)).contains(page)


def mobile_end(text: Column) -> Column:
    return F.startswith(text, F.lit("There's more to see")) | F.startswith(text, F.lit("See more from "))
