import random
import tracemalloc

import numpy as np
import pytest

from sparkseek.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return P.pieces(P.MODEL)


def brute(p, text):
    out = []

    def go(at, score):
        if at == len(text):
            out.append(score)
        for end in range(at + 1, min(len(text), at + p.longest) + 1):
            s = p.score.get(text[at:end])
            if s is None and end == at + 1:
                s = p.unknown
            if s is not None:
                go(end, score + s)

    go(0, 0.0)
    return sorted(out, reverse=True)


def score_of(p, text, ids):
    """The score of a segmentation, from its ids alone; unknown characters are runs of bytes."""
    total, at, data = 0.0, 0, (P.META + text.replace(" ", P.META))
    names = {i: k for k, i in p.id.items()}
    while ids:
        if ids[0] in names:
            total, at, ids = total + p.score[names[ids[0]]], at + len(names[ids[0]]), ids[1:]
        else:
            total, ids, at = total + p.unknown, ids[len(data[at].encode()) :], at + 1
    assert at == len(data)
    return total


ODD = ["", " ", "a", "  two  spaces ", "line\nbreak\ttab", "日本語", "naïve café", "\U0001f600!", "thethethe", "é", "\x00\x01", "aaaaaaaaaaa"]


@pytest.mark.parametrize("n", [1, 2, 7])
def test_nbest_against_brute_force(model, n):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choices("the inga.\né ", k=rng.randint(1, 11))) for _ in range(60)]
    for text, (ids, count, scores, same) in zip(texts, P.encode_texts(model, P.Cache(), texts, n)):
        assert same and all(model.decode(np.frombuffer(x, "<u4").tolist()) == text for x in ids) and count == len(ids[0]) // 4
        assert len(set(ids)) == len(scores)
        for x, score in zip(ids, scores):
            assert score_of(model, text, np.frombuffer(x, "<u4").tolist()) == pytest.approx(score)
        expected = brute(model, P.META + text.replace(" ", P.META))[:n]
        assert scores == pytest.approx(expected)


def test_blocks_agree_with_single_words(model):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghinrst▁é\n", k=rng.randint(1, 30))) for _ in range(3000)]
    for word, found in zip(words, model.forward(words)):
        assert found == model._forward_one(word)


def test_cache_limits(model, monkeypatch):
    monkeypatch.setattr(P, "CACHE_SEGMENTS", 20)
    cache, rng = P.Cache(), random.Random(9)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abc", k=4)) for _ in range(6)) for _ in range(3)]
        assert P.encode_texts(model, cache, texts, 3) == P.encode_texts(model, P.Cache(), texts, 3)


def test_long_run_of_letters(model):
    """200 000 random letters without a space: memory stays in proportion to the length."""
    text = "".join(random.Random(3).choices("etaoinshrdlucmfwyp", k=200_000))
    tracemalloc.start()
    ((ids, _, scores, same),) = P.encode_texts(model, P.Cache(), [text], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert same and len(set(ids)) == 4 and scores == sorted(scores, reverse=True) and peak < 500 << 20
    assert all(model.decode(np.frombuffer(x, "<u4").tolist()) == text for x in ids)


def test_words_agree_with_the_library(model):
    """Common words are cut as the library's merges cut them; the sum of plain ranks would cut most of them finer."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    words = "the quick brown fox jumps over a lazy dog and understands nothing about words in language processing because probability requires training".split()
    got = P.encode_texts(model, P.Cache(), words, 1)
    assert all(np.frombuffer(ids[0], "<u4").tolist() == sp.encode(w) for w, (ids, *_) in zip(words, got))


def test_long_text(model):
    text = "x" * 20_000 + " word " * 5000
    ((ids, _, scores, same),) = P.encode_texts(model, P.Cache(), [text], 3)
    assert same and scores == sorted(scores, reverse=True)


def test_frames(spark, data):
    rows = [(i, t, "extra") for i, t in enumerate([*ODD, None])] + [(0, "a", "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, e string")
    out = P.decode(P.encode(df, with_ids=True)).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in out) == sorted((i, t or "") for i, t, _ in rows) and all(r["round_trip"] for r in out)
    assert all(r["ids"] == r["n_best_ids"][0] and len(r["n_best_ids"]) == len(r["n_best_scores"]) == len(set(r["n_best_sha256"])) for r in out)
    assert P.encode(df.limit(0)).count() == 0
    whole = P.op9_sentencepiece(spark, data).collect()
    assert len(whole) == 200 and all(r["round_trip"] for r in whole)


def test_meta_space_in_text(model):
    ((_, _, _, same),) = P.encode_texts(model, P.Cache(), ["a▁b"], 1)
    assert not same
