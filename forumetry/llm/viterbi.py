"""Operator 8, token counts: how many pieces a unigram tokenizer makes of each text, without making them.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at a character; dynamic programming keeps, for each end, the best
score and its number of pieces. Ties go as the tokenizer lets them go: a later candidate must be strictly better, and candidates come with
ascending start. The automaton reports the matches at one end from the longest, which is that order. A character that no piece covers costs
the least score less PENALTY and is written as its UTF-8 bytes, if the vocabulary has byte pieces, else as one unknown piece, which joins a
neighbouring unknown one.

No piece has a blank mark after another character (checked when the vocabulary is read), so blanks cut the text into parts whose best paths add
up. Every distinct part is solved once and remembered. Whole-number scores add up exactly, in any order.

The query has no unigram model and takes the pieces and scores of a BPE model, so its counts are not those of that model's own tokenizer; the README
gives the difference.

Cases: null and empty texts have no pieces, score 0; blanks only are pieces like others; equal texts have equal counts, and repeated rows stay as
many; a text of any length is solved whole, part by part; an empty table gives no rows; every input column stays, but one named like a result is
replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from forumetry.llm.common import add_columns, keyed, table

#: Fixed values of the tokenizer.
BLANK, PENALTY = "▁", 10.0
#: Parts whose result a worker keeps at once; then it forgets them all.
MEMO = 500_000


class UnigramCounter:
    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {x for x in pieces if len(x) == 1}
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.byte_fallback = byte_fallback
        free = not any(BLANK in x.lstrip(BLANK) for x in pieces)
        lines = byte_fallback and not any("\n" in x for x in pieces)
        self.parts = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n" if free and lines else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if free else "(?s).+").findall
        if not byte_fallback:
            self.parts = re.compile("(?s).+").findall  # an unknown piece joins its neighbour across blanks
        self.memo: dict[str, tuple[float, int]] = {}

    def solve(self, part: str) -> tuple[float, int]:
        """(best score, pieces) of one part."""
        n = len(part)
        score, count, known = [0.0] * (n + 1), [0] * (n + 1), [True] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(part):
            found[end].append(match)
        for end, matches in enumerate(found):
            best = None
            matches.sort(reverse=True)
            for size, value in matches:
                total = value + score[end + 1 - size]
                if best is None or total > best:
                    best, pieces, sure = total, count[end + 1 - size] + 1, True
            if part[end] not in self.single:
                total = self.unknown + score[end]
                if best is None or total > best:
                    best, sure = total, False
                    pieces = count[end] + (len(part[end].encode("utf-8", "replace")) if self.byte_fallback else int(known[end]))
            score[end + 1], count[end + 1], known[end + 1] = best, pieces, sure
        return score[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """(best score, pieces) of a text, which gets a blank in front as the tokenizer gives it."""
        if not text:
            return 0.0, 0
        memo, score, pieces = self.memo, 0.0, 0
        if len(memo) > MEMO:
            memo.clear()
        for part in self.parts(BLANK + text.replace(" ", BLANK)):
            got = memo.get(part)
            if got is None:
                got = self.solve(part)
                if len(part) < 64:
                    memo[part] = got
            score += got[0]
            pieces += got[1]
        return score, pieces


def sentencepiece_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a model file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in kept}


_COUNTERS: dict[str, UnigramCounter] = {}


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with n_tokens (long) and best_score (double) by the vocabulary of a model file."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if path not in _COUNTERS:  # one a worker process
            _COUNTERS[path] = UnigramCounter(sentencepiece_vocabulary(path))
        got = [_COUNTERS[path].count(x or "") for x in batch[text].to_pylist()]
        return {"n_tokens": pa.array([n for _, n in got], pa.int64()), "best_score": pa.array([s for s, _ in got], pa.float64())}

    return add_columns(df, make, {"n_tokens": "long", "best_score": "double"})


def op8_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = keyed(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "best_score")
