"""Encoders against the reference library and brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import kernel, sentencepiece, tokencount
from lodestone.llm.pieces import MODEL, Vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def _texts():
    rng = random.Random(7)
    fixed = ["", "a", " a", "  a", "Hello  world\nfoo", "   ", "\n", "a\n\n  b", "日本語のテキスト", "x" * 700, "▁a▁b", "émile zażółć 😀 q", "a  ", "\t\tfoo(bar);  // x", "\x00z", " " * 100]
    return fixed + ["".join(rng.choice("ab  \n▁é日x.1😀the") for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_encoding_equals_the_library(vocabulary):
    import sentencepiece as lib

    texts = _texts()
    want = lib.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)
    encoder, decoder = sentencepiece.Encoder(vocabulary, remembered=500), sentencepiece.Decoder(vocabulary)
    for at in range(0, len(texts), 100):  # words are forgotten between
        data, offs = kernel.texts(pa.array(texts[at : at + 100]))
        ids, o = encoder(data, offs)
        back, b = decoder(ids, o)
        for i, t in enumerate(texts[at : at + 100]):
            assert ids[o[i] : o[i + 1]].tolist() == want[at + i], t
            assert back[b[i] : b[i + 1]].tobytes().decode() == t.replace("▁", " ")
    with pytest.raises(IndexError):
        decoder(np.array([10**6]), np.array([0, 1]))


def test_counts_equal_the_library(vocabulary):
    import sentencepiece as lib

    texts = _texts()
    want = lib.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)
    pre, tokens, _ = tokencount.Counter(vocabulary)(*kernel.texts(pa.array([*texts, None])))
    assert tokens.tolist() == [*map(len, want), 0] and pre[-1] == 0


def test_long_pretokens(vocabulary, monkeypatch):
    """Beyond the trie's depth: against the library in stretches of any size, and one of a megabyte in bounded time."""
    import time

    import sentencepiece as lib

    rng = random.Random(9)
    texts = ["".join(rng.choice("abeinorst") for _ in range(n)) for n in (255, 256, 257, 300, 3000)] + ["x" * 5000, "ab " + "é" * 400 + "日本" * 200]
    want = [len(x) for x in lib.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)]
    for stretch in (70, 1 << 16):
        monkeypatch.setattr(tokencount, "STRETCH", stretch)
        assert tokencount.Counter(vocabulary)(*kernel.texts(pa.array(texts)))[1].tolist() == want
    short = [f"w{i}" for i in range(5000)]
    began = time.perf_counter()
    one = "".join(rng.choice("abeinorst") for _ in range(1 << 20))
    tokens = tokencount.Counter(vocabulary)(*kernel.texts(pa.array([one, " ".join(short)])))[1]
    assert time.perf_counter() - began < 120 and 1 << 17 < tokens[0] < 1 << 20


def test_unigram_forward_scores():
    """A small unigram model against dynamic programming without a trie."""
    pieces = ["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "ca"]
    v = Vocabulary(pieces, np.array([-3.0, -2, -2.1, -2.2, -2.5, -3.1, -2.7, -3.6, -5.5, -3.05]), np.zeros(256, int), "unigram")
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    score = dict(zip(pieces, v.scores))

    def brute(w):
        best = [(0.0, 0)] + [(-1e9, 0)] * len(w)
        for e in range(1, len(w) + 1):
            best[e] = max((best[s][0] + score[w[s:e]], best[s][1] + 1) for s in range(e) if w[s:e] in score)
        return best[-1]

    data, offs = kernel.texts(pa.array(["▁" + w for w in words]))
    trie = tokencount.Trie(data, offs, v, tokencount._Known(v))
    count, total, _ = trie.terminals()
    for w, s in zip(words, total):
        assert abs(s - brute("▁" + w)[0]) < 1e-9
    assert trie.nodes < len(data)
    long = "▁" + "".join(rng.choice("abc") for _ in range(900))
    n, total_, _ = tokencount.terminals(*kernel.texts(pa.array([long, "▁ab"])), v, tokencount._Known(v))
    assert abs(total_[0] - brute(long)[0]) < 1e-9 and n[1] == 1
    encoder = sentencepiece.Encoder(v)
    ids, n = encoder.words(data, offs)
    at = np.concatenate(([0], np.cumsum(n)))
    for i, s in enumerate(total):
        assert abs(v.scores[ids[at[i] : at[i + 1]]].sum() - s) < 1e-9
