import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from forumetry.llm import byte_bpe, repair

from .helpers import TEXTS, documents, store


@pytest.mark.parametrize("seed,kinds,n", [(0, 3, 5000), (1, 50, 20000), (2, 1, 777), (3, 40000, 300), (4, 2, 1), (5, 2, 0)])
def test_grammar_round_trip(seed, kinds, n):
    ids = np.random.default_rng(seed).integers(0, kinds, n)
    ids = np.concatenate((ids, ids[: n // 2]))
    shard = repair.Shard(repair.pack_shard(ids, 50_000, np.array([len(ids)])))
    assert (shard.decode() == ids).all() and len(shard.decode()) == len(ids)
    for a, b in ((0, len(ids)), (3, 9), (len(ids) // 2, len(ids) // 2 + 40), (5, 5), (0, 10**9)):
        assert (shard.decode_range(a, b) == ids[a:b]).all()
    assert (shard.expand(shard.seq) == ids).all()


def test_grammar_compresses_and_replaces_every_frequent_pair():
    ids = np.tile([7, 8, 9, 7, 8], 500)
    rules, seq = repair.build_grammar(ids, 100)
    assert len(seq) < 20
    assert not rules.size or rules.max() < 100 + len(rules)


def plain_repair(ids, least):
    """Symbols and rules of Re-Pair one pair at a time: the most frequent pair, without overlaps, is replaced from the left."""
    seq, rules = list(map(int, ids)), 0
    while True:
        counts, last = {}, {}
        for k, pair in enumerate(zip(seq, seq[1:])):
            if last.get(pair) != k - 1 or pair[0] != pair[1]:
                counts[pair], last[pair] = counts.get(pair, 0) + 1, k
        best = max(counts, key=lambda p: (counts[p], p), default=None)
        if best is None or counts[best] < least:
            return len(seq), rules
        out, k = [], 0
        while k < len(seq):
            both = k + 1 < len(seq) and (seq[k], seq[k + 1]) == best
            out.append(10**6 + rules if both else seq[k])
            k += 2 if both else 1
        seq, rules = out, rules + 1


def test_grammar_is_about_as_small_as_plain_repair():
    random = np.random.default_rng(3)
    words = [random.integers(0, 300, random.integers(2, 6)) for _ in range(60)]
    ids = np.concatenate([words[int(k)] for k in random.zipf(1.3, 1500) % 60])
    rules, seq = repair.build_grammar(ids, 1000, 4)
    size, number = plain_repair(ids, 4)
    assert len(seq) + 2 * len(rules) <= 1.1 * (size + 2 * number) < len(ids)


def test_word_ids_equal_the_tokenizer(tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other = tmp_path / "other.json"
    other.write_text(open(path).read().replace('"Lowercase"', '"Strip","strip_left":true,"strip_right":true'))
    random = np.random.default_rng(5)
    letters = [*"abzABZäÄßÿñé09 \n\t.,!'<>|&*%$-_", "\u0130", "\u03a3", "e\u0301", "\u00a0", "\u2028", "\x0b", "'s", "<|endoftext|>", "\u4e00", "\U0001f600", "\ufb01", "\u0345"]
    texts = ["".join(letters[k] for k in random.integers(0, len(letters), n)) for n in random.integers(0, 60, 3000)] + [*TEXTS, "word" * 100_000, "one two " * 200_000]
    for file in (path, str(other)):
        tokenizer, encoder = Tokenizer.from_file(file), repair.WordIds(file)
        assert encoder.by_words == (file == path)
        for some in (texts, texts[::-1]):  # the second time, words are remembered
            flat, sizes = encoder.encode(repair.pa.array(some, repair.pa.string()), 1)
            for text, got in zip(some, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                assert got.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text


def expected_op1(rows, tokenizer):
    start, out = 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for folder in (sf, store(documents(spark), tmp_path)):
        rows = sorted(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))if folder == sf else list(enumerate(TEXTS))
        assert sorted(map(tuple, repair.op1_repair_token_ids(spark, folder).collect())) == expected_op1(rows, tokenizer)


def test_op1_null_ids_and_empty_table(spark, tmp_path):
    df = documents(spark, ["b", "a", "a", None], [None, 3, 3, None])
    got = sorted(map(tuple, repair.op1_repair_token_ids(spark, store(df, tmp_path)).select("start", "n_tokens").collect()))
    assert got == [(0, got[0][1]), *((a[0] + a[1], b[1]) for a, b in zip(got, got[1:]))]
    assert repair.op1_repair_token_ids(spark, store(df.limit(0), tmp_path / "none")).count() == 0


def test_op1_copies_of_a_row_are_dealt_out(spark, tmp_path):
    df = documents(spark, ["one and the same"] * 500 + ["two"], [7] * 500 + [8])
    got = sorted(map(tuple, repair.op1_repair_token_ids(spark, store(df, tmp_path)).select("start", "doc_id", "n_tokens").collect()))
    assert got == [*((5 * k, 7, 5) for k in range(500)), (2500, 8, 2)]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op3(spark, sf, tmp_path, tik):
    for folder in (sf, store(documents(spark), tmp_path)):
        want = {}
        for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
            ids = tik.encode_ordinary(text or "")
            want[doc] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert {r[0]: tuple(r[1:]) for r in byte_bpe.op3_byte_bpe(spark, folder).collect()} == want


def test_long_pieces_merge_alike(tik):
    bpe = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 200, 256, 257, 1000):
        piece = "".join(rng.choice(list("abeinrst"), n))
        ids = tik.encode_ordinary(piece)
        assert bpe.encode_pieces([piece.encode()])[0].tolist() == ids
        assert bpe.merge_long(piece.encode()).tolist() == tik._encode_single_piece(piece) == ids


def test_bpe_columns_keep_other_columns(spark):
    df = documents(spark).selectExpr("*", "1 AS ids", "doc_id AS decoded")
    out = byte_bpe.with_byte_bpe(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    assert all((r.text or "").encode() == r.decoded for r in out.collect())
    assert out.limit(0).count() == 0


def test_op1_names_pairs_that_occur_four_times():
    import numpy as np

    from forumetry.llm import repair

    ids = np.arange(40_000, dtype=np.int64) % 10_000
    rules, symbols = repair.build_grammar(ids, 49_408)
    assert len(rules) and len(symbols) < len(ids) // 2
