"""Operator 13, quality rules: a cascade that stops at the first rule which rejects a document.

A rule is a condition over features of a text; features are computed when a rule first asks for them, and each once. `estimate` runs every rule on
a sample and measures what each feature costs and which rules reject together. `ordered` then takes, again and again, the rule that rejects most
of the sample's remaining documents for the cost that it adds there: features that were computed before, or that are reported anyway, are free.
`cascade` evaluates the rules in that order inside tasks. The verdict is the same in any order; only `rejected_by`, the first rule that rejects,
depends on it, so give `order` where it must not change between runs.

Cases: a null text is empty, and has no words; a text of any length is read whole; equal texts have equal verdicts; an empty table gives no rows,
and its rules keep their given order; every other column stays, but those named like results are replaced.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumetry.llm.common import add_columns, fresh, table

#: Documents, about, that costs and rejections are estimated on.
SAMPLE = 2_000

#: Frequent words of the languages that the rules know, bullets, and marks of an unfinished line.
STOP_WORDS = (
    "the and that with have for not this are was of to in is it "
    "der die das und ist nicht mit von ein zu den auf "
    "le la les des est une dans que pour et de un "
    "el los las una para con por es en y del"
).split()
BULLETS = ("-", "*", "•", "‣", "▪", "◦")
UNFINISHED = ("...", "…")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

_STOP = [w.encode() for w in dict.fromkeys(STOP_WORDS)]
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_CAPITALS = re.compile(rb"[^a-z]*[A-Z][^a-z]*")


class Features(dict):
    """Features of one text, by name: computed when first asked for. `spent` has the nanoseconds of each, without those of other features."""

    def __init__(self, text: str):
        super().__init__(text=text)
        self.spent: dict[str, int] = {}

    def __missing__(self, name: str):
        needs, f = FEATURES[name]
        found = [self[k] for k in needs]
        began = time.perf_counter_ns()
        self[name] = value = f(*found)
        self.spent[name] = time.perf_counter_ns() - began
        return value


def repeated_words(words: list[bytes], vocabulary: dict[bytes, int]) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(words) < 4:
        return 0
    place = dict(zip(vocabulary, range(len(vocabulary)), strict=True))
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(place) + ids[1:], return_inverse=True)[1]
    _, of, count = np.unique(pairs[:-1] * len(place) + ids[2:], return_inverse=True, return_counts=True)
    again = count[of] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= again
    return int(inside.sum())


#: What each feature needs, and how it is computed from that.
FEATURES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "words": (("text",), lambda text: text.encode("utf-8", "surrogatepass").split()),
    "vocabulary": (("words",), Counter),
    "lines": (("text",), lambda text: [x for x in text.split("\n") if x.strip(BLANKS)]),
    "n_words": (("words",), len),
    "word_chars": (("text",), lambda text: len(text) - sum(map(text.count, BLANKS))),
    "n_symbols": (("text",), lambda text: sum(map(text.count, SYMBOLS))),
    "n_lines": (("lines",), len),
    "n_dup_lines": (("lines",), lambda lines: len(lines) - len(set(lines))),
    "n_repeat_words": (("words", "vocabulary"), repeated_words),
    "n_stop_words": (("vocabulary",), lambda known: sum(known.get(w, 0) for w in _STOP)),
    "n_letter_words": (("vocabulary",), lambda known: sum(n for w, n in known.items() if _LETTER.search(w))),
    "n_capital_words": (("vocabulary",), lambda known: sum(n for w, n in known.items() if _CAPITALS.fullmatch(w))),
    "n_bullet_lines": (("lines",), lambda lines: sum(1 for x in lines if x.lstrip(BLANKS).startswith(BULLETS))),
    "n_unfinished_lines": (("lines",), lambda lines: sum(1 for x in lines if x.rstrip(BLANKS).endswith(UNFINISHED))),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., bool]

    def __call__(self, features: Features) -> bool:
        return bool(self.rejects(*(features[k] for k in self.needs)))


BASE = (
    Rule("few_words", ("n_words",), lambda words: words < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda words, again: 100 * again > 50 * words),
)
RULES = (
    *BASE,
    Rule("word_length", ("n_words", "word_chars"), lambda words, chars: chars < 3 * words or chars > 12 * words),
    Rule("symbols", ("n_words", "n_symbols"), lambda words, symbols: 10 * symbols > words),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda lines, again: 2 * again > lines),
    Rule("stop_words", ("n_stop_words",), lambda stop: stop < 2),
    Rule("letters", ("n_words", "n_letter_words"), lambda words, letters: 10 * letters < 8 * words),
    Rule("capitals", ("n_words", "n_capital_words"), lambda words, capitals: 2 * capitals > words),
    Rule("bullets", ("n_lines", "n_bullet_lines"), lambda lines, bullets: 10 * bullets > 9 * lines),
    Rule("unfinished", ("n_lines", "n_unfinished_lines"), lambda lines, unfinished: 10 * unfinished > 3 * lines),
)


def needed(rule: Rule) -> set[str]:
    """All features that a rule makes compute."""
    found, open_ = set(), list(rule.needs)
    while open_:
        name = open_.pop()
        if name not in found and name != "text":
            found.add(name)
            open_ += FEATURES[name][0]
    return found


@dataclass(frozen=True)
class Group:
    """Documents of the sample that the same rules reject, with the seconds that each feature took over all of them."""

    rejecting: frozenset[str]
    count: int
    seconds: dict[str, float]


def estimate(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", most: int = SAMPLE) -> list[Group]:
    """What rules reject and features cost on about `most` documents, drawn at random. At most one row for each set of rules comes back."""
    rules = tuple(rules)
    names = sorted(set().union(*map(needed, rules)))
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    of_sample = whole.sample(min(1.0, most / max(1, docs.count())), seed=7)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        masks, spent = [], []
        for x in batch["text"].to_pylist():
            features = Features(x)
            masks.append(sum(rule(features) << k for k, rule in enumerate(rules)))
            spent.append([features.spent.get(k, 0) / 1e9 for k in names])
        return {"mask": pa.array(masks, pa.int64()), "spent": pa.array(spent, pa.list_(pa.float64()))}

    measured = add_columns(of_sample, make, {"mask": "long", "spent": "array<double>"}).drop("text")
    sums = [F.sum(F.get("spent", F.lit(k))).alias(f"s{k}") for k in range(len(names))]
    rows = measured.groupBy("mask").agg(F.count("*").alias("n"), *sums).collect()
    return [Group(frozenset(r.name for k, r in enumerate(rules) if row.mask >> k & 1), row.n, {f: row[f"s{k}"] for k, f in enumerate(names)}) for row in rows]


def ordered(rules: Iterable[Rule], groups: list[Group], paid: Iterable[str] = ()) -> list[Rule]:
    """The rules by what they reject of the documents that all rules before leave, for the seconds that their features add on these."""
    left, out = list(rules), []
    done = {f for name in paid for f in needed(Rule("", (name,), bool))}
    while left:

        def worth(rule: Rule) -> float:
            rejected = sum(g.count for g in groups if rule.name in g.rejecting)
            return rejected / (1e-9 + sum(g.seconds.get(f, 0.0) for g in groups for f in needed(rule) - done))

        best = max(left, key=worth)  # of equal ones the first
        left.remove(best)
        out.append(best)
        done |= needed(best)
        groups = [g for g in groups if best.name not in g.rejecting]
    return out


def cascade(docs: DataFrame, order: Iterable[Rule], report: Iterable[str] = (), text: str = "text", out: tuple[str, str] = ("kept", "rejected_by")) -> DataFrame:
    """docs with `kept`, `rejected_by` (null where kept), and the features named in `report` as longs, which are computed for every text."""
    order, report = tuple(order), tuple(report)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        verdicts, reported = [], {k: [] for k in report}
        for x in batch[text].to_pylist():
            features = Features(x or "")
            verdicts.append(next((rule.name for rule in order if rule(features)), None))
            for k in report:
                reported[k].append(features[k])
        kept = pa.array([v is None for v in verdicts], pa.bool_())
        return {out[0]: kept, out[1]: pa.array(verdicts, pa.string()), **{k: pa.array(v, pa.int64()) for k, v in reported.items()}}

    return add_columns(docs, make, {out[0]: "boolean", out[1]: "string", **dict.fromkeys(report, "long")})


def keep_good(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, by a cascade in the order of its estimates, with their columns as they are."""
    rules = tuple(rules)
    own = fresh("_kept", docs.columns), fresh("_rejected_by", docs.columns)
    return cascade(docs, ordered(rules, estimate(docs, rules, text)), text=text, out=own).where(F.col(own[0])).drop(*own)


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = ordered(RULES, estimate(docs), paid=REPORTED)
    judged = cascade(docs, order, REPORTED)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *REPORTED, failed.alias("base_failed"), "kept")


_WORDS = r"[^\x20\x09-\x0D]"
ORACLE_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT k, regexp_extract_all(text, '{_WORDS}+') AS ws FROM d),
l AS (
    SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
by_lines AS (
    SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
           count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•‣▪◦]')) AS bullets,
           count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS unfinished
    FROM l WHERE regexp_matches(line, '{_WORDS}') GROUP BY k),
t AS (
    SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
seen AS (
    SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS n FROM t),
inside AS (
    SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM seen, (VALUES (0), (1), (2)) AS v(j) WHERE n > 1 GROUP BY k),
by_words AS (
    SELECT k, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(list_filter(ws, lambda x: x IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS stop,
           len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letters,
           len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS capitals
    FROM w),
f AS (
    SELECT doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
           stop, letters, capitals, coalesce(n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets, coalesce(unfinished, 0) AS unfinished
    FROM d JOIN by_words USING (k) LEFT JOIN by_lines USING (k) LEFT JOIN inside USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR stop < 2 OR 10 * letters < 8 * n_words OR 2 * capitals > n_words OR 10 * bullets > 9 * n_lines OR 10 * unfinished > 3 * n_lines) AS kept
FROM f
"""
