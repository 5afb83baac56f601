import numpy as np
import public_tokenizers
import pytest

from forumetry.llm import viterbi

from .helpers import documents, store


@pytest.fixture(scope="module")
def vocabulary():
    return viterbi.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def unigram(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [("<unk>", 0.0), *vocabulary.items(), *((f"<0x{b:02X}>", min(vocabulary.values())) for b in range(256))]
    pieces[0] = ("<unk>", min(vocabulary.values()))
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return tokenizer


def test_op8_counts_as_the_tokenizer(spark, sf, tmp_path, unigram):
    for folder in (sf, store(documents(spark), tmp_path)):
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        got = {r.doc_id: r.n_tokens for r in viterbi.op8_viterbi_token_counts(spark, folder).collect()}
        assert got == {k: len(unigram.encode(x, add_special_tokens=False).ids) if x else 0 for k, x in texts.items()}
    assert viterbi.op8_viterbi_token_counts(spark, store(documents(spark).limit(0), tmp_path / "none")).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_and_unknown_characters(fallback):
    from tokenizers import Tokenizer, models

    rng = np.random.default_rng(3)
    alphabet = "abcd▁"
    for trial in range(60):
        size = int(rng.integers(3, 25))
        pieces = {"".join(rng.choice(list(alphabet), int(rng.integers(1, 5)))): -float(rng.integers(1, 6)) for _ in range(size)}
        counter = viterbi.UnigramCounter(pieces, fallback)
        extra = [(f"<0x{b:02X}>", min(pieces.values())) for b in range(256)] if fallback else []
        tokenizer = Tokenizer(models.Unigram([("<unk>", min(pieces.values())), *pieces.items(), *extra], 0, fallback))
        for _ in range(30):
            text = "".join(rng.choice(list("abcdeé  "), int(rng.integers(1, 30))))
            want = len(tokenizer.encode(viterbi.BLANK + text.replace(" ", viterbi.BLANK), add_special_tokens=False).ids)
            assert counter.count(text)[1] == want, (trial, text, pieces)
