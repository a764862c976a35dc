"""Text rules against plain Python specifications and boundary values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T


def column(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_str_count_does_not_overlap(spark):
    assert column(spark, ["aaaa", "", "a b a"], T.str_count(F.col("t"), "aa"), T.str_count(F.col("t"), "a")) == [(2, 4), (0, 0), (0, 2)]


def test_white_space_is_unicode(spark):
    assert column(spark, [" a b \n", " ", ""], T.strip(F.col("t")), F.size(T.words(F.col("t")))) == [("a b", 2), ("", 0), ("", 0)]


def test_content_type_thresholds(spark):
    cases = {
        "$" * 5: (False, False, False, False),
        "$" * 6: (True, False, False, False),
        "def class import ": (False, False, False, False),
        "def class import {": (False, True, False, False),
        "```": (False, True, False, False),
        "1e5 2e5 3e5": (False, False, False, False),
        "1e5 2e5 3e5 4.0E-7": (False, False, True, False),
        "[" * 6: (False, False, False, True),
        "]" * 59: (False, False, False, False),
        "]" * 60: (False, False, False, True),
        "12:30:01 " * 6: (False, False, False, True),
    }
    got = column(spark, list(cases), T.content_type(F.col("t")).alias("k"))
    for (k,), (text, want) in zip(got, cases.items()):
        assert (k.is_math, k.is_code, k.is_physics, k.is_telemetry) == want, text
        assert k.is_technical == any(want)


def spec_quality(text, technical):
    score = 0.5
    if 500 <= len(text) <= 5000:
        score += 0.1
    elif len(text) < 100 or len(text) > 50_000:
        return 0.0
    low = text.lower()
    k = sum(w in low for w in T.KEYWORDS)
    score += 0.2 if k >= 3 else 0.1 if k >= 1 else 0
    tone = 0.0
    pieces = text.split(".")
    if len(pieces) > 2 and sum(bool(s.strip()) and s.strip()[0].isupper() for s in pieces) / len(pieces) > 0.7:
        tone += 0.05
    if sum(text.count(c) for c in ".!?") > 2:
        tone += 0.05
    if sum(w in low for w in T.FORMAL) >= 2:
        tone += 0.05
    if any(w in low for w in T.INFORMAL):
        tone -= 0.1
    return min(1.0, max(0.0, score + tone + (0.1 if technical else 0)))


def test_quality_equals_the_specification(spark):
    texts = ["x" * n for n in (49, 50, 99, 100, 499, 500, 5000, 5001, 50000, 50001)]
    texts += ["A sentence. " * 30, "lol " * 40, "However, therefore. " * 20 + "robot sensor python class", "😀" * 100, "Robot. Slam. Topic. Node. However moreover. " * 20, "omg" + "z" * 120]
    got = column(spark, texts, T.quality(F.col("t"), F.lit(False)), T.quality(F.col("t"), F.lit(True)))
    for t, (plain, technical) in zip(texts, got):
        assert plain == pytest.approx(spec_quality(t, False)) and technical == pytest.approx(spec_quality(t, True))


def test_only_informal_marker_scores_the_threshold_and_is_kept(spark):
    ((q,),) = column(spark, ["lol" + "z" * 200], T.quality(F.col("t"), F.lit(False)))
    assert q == pytest.approx(0.4) and not q < T.LOW_QUALITY


def test_cleaning_modes(spark):
    no = F.lit(False)
    faithful = lambda t: column(spark, [t], T.clean(F.col("t"), no))[0][0]
    intended = lambda t: column(spark, [t], T.clean(F.col("t"), no, "intended"))[0][0]
    assert faithful("hyphen-\nated word") == "hyphen- ated word" and intended("hyphen-\nated word") == "hyphenated word"
    assert faithful("Page 3 of 9\nthe rest") == "" and intended("Page 3 of 9\nthe rest") == "the rest"
    assert faithful("12345") == "" and faithful("a < b > c") == "a c" and faithful("x &amp; y") == "x y"
    assert faithful("mail me@x.org or http://a.b/c now") == "mail or now"
    assert column(spark, ["keep-\n12\n\n\n\nlines"], T.clean_pages(F.col("t"), F.lit(True)))[0][0] == "keep12\n\nlines"
    with pytest.raises(ValueError):
        T.clean(F.col("t"), no, "other")


def test_json_block(spark):
    cases = {"```json\n[1, 2]\n```": "[1, 2]", "see [1] and [2]": "[1] and [2]", "none": None}
    assert [x for (x,) in column(spark, list(cases), T.json_block(F.col("t")))] == list(cases.values())


def test_first_present(spark):
    df = spark.createDataFrame([("", None, "c"), ("a", "b", "c"), (None, "", "")], "x string, y string, z string")
    assert [r[0] for r in df.select(T.first_present([F.col(c) for c in "xyz"])).collect()] == ["c", "a", None]


def test_patterns_use_no_look_around():
    for p, _, _ in T.PAGE_RULES:
        assert not re.search(r"\(\?[=!<]", p)


def test_mail_removal_on_long_runs(spark):
    """What the plain pattern removes, in time that grows with the text only."""
    import re
    import time

    texts = ["a@b", "@a", "a@", "x@@", "@@@", "see a@b.c, or d@e@f g@ @h", "a" * 1_000_000, "no mail", " @ ", "a@b" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    began = time.perf_counter()
    got = {r.i: r.x for r in df.select("i", F.regexp_replace("t", T.EMAIL_RUN, "").alias("x")).collect()}
    assert time.perf_counter() - began < 20
    for i, t in enumerate(texts):
        if len(t) < 1000:
            assert got[i] == re.sub(r"\S+@\S+", "", t), t
    assert len(got[6]) == 1_000_000 and got[9] == ""


def test_language_by_common_words(spark):
    texts = ["the end of the day is near", "der Hund und die Katze", "le chat et les chiens", "el perro y los gatos", "", "xyz", None, "the und the der the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.orderBy("i").select(T.language(F.col("t")).alias("x")).collect()]
    assert got[:6] == ["en", "de", "fr", "es", "en", "en"] and got[7] == "en"


def test_embedding_of_words_whose_signs_cancel(spark):
    """Two words of one bucket and opposite signs still give a vector of unit length."""
    from lodestone.functions import vectors as V

    of = {}
    for w, h in spark.range(2000).select(F.concat(F.lit("w"), "id").alias("w")).select("w", F.xxhash64("w")).collect():
        of.setdefault((h >> 1) % V.SIZE, {})[h & 1] = w
    a, b = next((x[0], x[1]) for x in of.values() if len(x) == 2)
    got = column(spark, [f"{a} {b}", f"{b}, {a} {a} {b}", a, "?!", None], F.round(V.norm(V.hashed_embedding(F.col("t"))), 4))
    assert [x for (x,) in got] == [1.0, 1.0, 1.0, 0.0, 0.0]


def test_embedding_of_whole_texts(spark):
    """Words count wherever they stand in a text; the sums are those of a plain loop."""
    import numpy as np

    from lodestone.functions import vectors as V

    rng = random.Random(5)
    texts = [None, "", "?" * 600 + " Late", "a " * 300 + "Ünd b", *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 400))) for _ in range(40)), "long word " * 150_000 + "end"]
    texts += [""] * 1100 + ["x y z"]
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    of = dict(spark.createDataFrame([(w,) for w in sorted(set().union(*words))], "w string").select("w", F.xxhash64("w")).collect())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.v for r in df.select("i", V.hashed_embedding(F.col("t")).alias("v")).collect()}
    for i, ws in enumerate(words):
        v = np.zeros(V.SIZE)
        for w in ws:
            v[(of[w] >> 1) % V.SIZE] += 1 if of[w] & 1 else -1
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1), atol=1e-6), i
    assert any(got[2])
