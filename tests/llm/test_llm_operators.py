"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, decontaminate, flac, jaccard, lines, lm, sentencepiece, substring, tokencount, toxicity, warc
from lodestone.llm.pieces import MODEL
from lodestone.runtime import work_path

BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a jug of bitter violet ink near old quarry walls"
DOCS = [
    (0, BASE), (1, BASE), (2, BASE.upper()), (3, BASE + " today"), (4, None), (5, ""), (6, "   \n\t"), (7, "three words here"), (8, "Three Words here"),
    (9, BASE[:60] + "\n" + BASE[40:] + "\nother line of text that is long enough"), (10, "x" * 200 + " " + BASE), (11, "ä" * 70), (12, "ä" * 70 + "ö"),
    (13, "unrelated text without any shared run of words whatsoever in here"), (14, "line one is shared by two texts\nline two is not"), (15, "line one is shaped by two texts\nanother thing altogether"),
    (16, " ".join(f"word{i}" for i in range(3000))), (17, " ".join(f"word{i}" for i in range(20, 3000))), (None, BASE), (18, BASE), (18, BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 0, i, "z") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, a int, cid long, key string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _set(t, k=5):
    w = _words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (50, 60), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40}


def test_jaccard_join(docs, none):
    ids = sorted({i for i, _ in DOCS if i is not None})
    sets = {i: _set(t) for i, t in DOCS if i is not None}
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = jaccard.join(docs, bucket=50).collect()
    assert len(got) == len(DOCS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == len(_set(BASE))
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)), r
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    left = Counter(r.doc_id for r in kept.collect())
    assert left[None] == 1 and all(left[i] == (find(i) == i) for i in ids)


def test_jaccard_near_copies_in_a_large_group(spark):
    """Neighbours in a long chain of edits link although the ends don't; all must meet."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[(i * 7) % 120] = f"e{i}"
    sets = [_set(t) for _, t in rows]
    linked = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets, sets[1:])]
    assert all(linked) and 100 * len(sets[0] & sets[-1]) < 80 * len(sets[0] | sets[-1])
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_jaccard_null_id_before_its_only_copy(spark):
    words = [f"w{i}" for i in range(120)]
    copy, near = " ".join(words), " ".join([*words[:-2], "x", "y"])
    rows = [(None, copy), (5, copy), (None, near), (3, near)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (3, 3), (5, 3)]


def test_jaccard_one_id_with_two_texts(spark):
    """Each text's class links with its near copy, and is tested with its own set."""
    a, b = [f"a{i}" for i in range(120)], [f"b{i}" for i in range(120)]
    text = lambda w, *end: " ".join([*w[: len(w) - len(end)], *end])
    rows = [(1, text(a)), (1, text(b)), (2, text(a, "x", "y")), (3, text(b, "x", "y"))]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bit_parallel_distance(spark):
    import random

    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc"), ("äöü", "äü")]
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string")
    for t in (0, 1, 2, 3):
        for r in df.select("x", "y", lines.within(F.col("x"), F.col("y"), t).alias("near")).collect():
            assert r.near == (_edit(r.x, r.y) <= t), (r, t)


def _line_brute(rows, least=20, threshold=2, exact=1):
    first = {}
    strip = " \t\r\f\x0b"
    for i, t in sorted((i, t) for i, t in rows if i is not None and t is not None):
        for k, x in enumerate(t.split("\n")):
            x = x.strip(strip)
            if len(x) >= exact:
                first.setdefault(x, (i, k))
    long = [x for x in first if len(x) >= least]
    late = {y for y in long for x in long if first[x] < first[y] and abs(len(x) - len(y)) <= threshold and _edit(x, y) <= threshold}
    return lambda i, k, x: len(x.strip(strip)) >= exact and (first[x.strip(strip)] != (i, k) or x.strip(strip) in late)


def test_line_dedup(docs, none, spark):
    small = [(i, t) for i, t in DOCS if i is None or i not in (16, 17)]
    gone = _line_brute(small)
    for r in lines.deduplicate(docs.where("doc_id is null or doc_id not in (16, 17)")).collect():
        original = dict(small)[r.doc_id]
        if original is None:
            assert r.text is None and r.n_lines == 0
        elif r.doc_id is None:
            assert r.text == original and r.n_removed == 0
        else:
            parts = original.split("\n")
            kept = [x for k, x in enumerate(parts) if not gone(r.doc_id, k, x)]
            assert r.text == "\n".join(kept) and r.n_removed == len(parts) - len(kept), r.doc_id
    assert lines.deduplicate(none).count() == 0
    assert set(docs.columns) <= set(lines.deduplicate(none).columns)


def test_short_lines_go_as_exact_copies(spark):
    import corpus_pipeline

    text = {1: "short\n\na line of its own that is long enough\nshart", 2: " short \n\nshort\nshort one of two", 3: "x\nshort\na line of its own that is long enouge\nx", 5: None}
    rows = [*text.items(), (4, "short"), (4, "x"), (None, "short")]
    got = {(r.doc_id, r.n_lines): r for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != 4}
    assert got[1, 4].text == text[1] and got[2, 4].text == "\nshort one of two" and got[3, 4].text == "x"
    assert got[None, 1].text == "short" and got[5, 0].text is None
    want = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(list(text.items()), "doc_id long, text string"), exact_chars=20).collect()}
    assert want[2] == text[2] and want[3] == "x\nshort\nx"
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in text.items()], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.n_chars for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}[3] == 1


def test_line_dedup_with_common_segments(spark, monkeypatch):
    """Variants of one line share segments; with a low bound they take the way for common ones."""
    import random

    base = "a line about nothing that goes on for quite a while and ends"
    rows = [(i, base[:k] + "XYZ"[i % 3] + base[k + 1 :]) for i, k in enumerate(range(0, 58, 3))] + [(90 + i, base[: 5 * i] + "#####" + base[5 * i :]) for i in range(8)]
    rng = random.Random(5)
    for i in range(200, 320):  # up to four edits each, so that some pairs are near and some aren't
        x = list(base if i % 2 else "äöü abcabcabc abcabc abcab")
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        rows.append((i, "".join(x)))
    rng.shuffle(rows)
    gone = _line_brute(rows)
    want = {i: gone(i, 0, t) for i, t in rows}
    assert 20 < sum(want.values()) < len(rows)
    for bound in (2, 1000):
        monkeypatch.setattr(lines, "HOT", bound)
        got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.doc_id: r.n_removed == 1 for r in got.collect()} == want


def test_line_dedup_makes_few_pairs_of_a_group(spark):
    """Lines that share a segment: none of them is paired with all others, and the result is that of brute force."""
    shared = "the same beginning of all of these lines"
    rows = [(i, f"{shared} {k}") for i, k in enumerate(hashlib.sha256(str(j // 2).encode()).hexdigest()[: 40 + j % 2] for j in range(48))]
    first = lines._classes(spark.createDataFrame(rows, "doc_id long, text string"), 20, 1).select("id", "doc_id", "line", "n", "key").localCheckpoint()
    index, probe = lines._index(first, 2), lines._probe(first, 2)
    hot = index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= lines.HOT).select("k")
    pairs = lines._pairs(index.join(hot, "k", "left_anti"), probe, hot)
    assert hot.count() and pairs.count() < 8 * len(rows)
    gone = _line_brute(rows)
    want = {i: gone(i, 0, t) for i, t in rows}
    got = {r.doc_id: r.n_removed == 1 for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 0 < sum(want.values()) < len(rows)


def test_line_dedup_with_clashing_names(spark):
    import corpus_pipeline

    rows = [(1, "one line", 7, 8, "a", "b"), (2, "one line\nanother", 7, 8, "a", "b"), (None, "one line", 7, 8, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, N_lines int, kept string, `do.c` string")
    got = lines.deduplicate(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "kept", "do.c", "n_lines", "n_removed"])
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()} == {(1, "one line", 1, 0), (2, "another", 2, 1), (None, "one line", 1, 0)}
    stage = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert stage.columns == docs.columns and {(r.text, r.n_removed) for r in stage.collect()} == {("one line", 7), ("another", 7)}


def _substring_brute(rows, width=50):
    least = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                least[w] = min(least.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - width + 1):
                if least[b[k : k + width]] < i:
                    mark[k : k + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(mark)))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[i] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 8000])
def test_substring_dedup(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    want = _substring_brute(DOCS)
    got = substring.deduplicate(docs).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert substring.deduplicate(none).count() == 0


def _katz(rows, order=3, k=5):
    """The model in plain dictionaries; returns the scorer of (history, word), the words' counts and N."""
    grams = [None, *(Counter() for _ in range(order))]
    follow = [None, *({} for _ in range(order))]  # of each order, the words after each history
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            seq = ["<s>"] * (order - 1) + [*_words(t), "</s>"]
            for j in range(order - 1, len(seq)):
                for n in range(1, order + 1):
                    g = tuple(seq[j - n + 1 : j + 1])
                    grams[n][g] += 1
                    follow[n].setdefault(g[:-1], Counter())[g[-1]] += 1

    def discounts(counts):
        n = Counter(counts.values())
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, k + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
            out[r] = x if 0 < x < 1 else (r - (n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5)) / r
        return lambda c: c * out.get(c, 1.0)

    d = [None, *(discounts(x) for x in grams[1:])]
    total = sum(grams[1].values())
    low = lambda seen: not any(c <= k for c in seen.values())

    def p(history, w):
        n = len(history) + 1
        seen = follow[n].get(history, {})
        if n == 1:
            bottom = total + low(seen)
            return d[1](seen[w]) / bottom if seen.get(w) else (1 - sum(map(d[1], seen.values())) / bottom if total else 1.0)
        if not seen:
            return p(history[1:], w)
        bottom = sum(seen.values()) + low(seen)
        if w in seen:
            return d[n](seen[w]) / bottom
        left = 1 - sum(map(d[n], seen.values())) / bottom
        return left / (1 - sum(p(history[1:], x) for x in seen)) * p(history[1:], w)

    return p, {g[0]: c for g, c in grams[1].items()}, total, [h for f in follow[1:] for h in f]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_scores(docs, none, monkeypatch, order):
    monkeypatch.setattr(lm, "SLICE", 4000)
    rows = [(i, t) for i, t in DOCS if i is None or i not in (16, 17)]
    p, uni, total, histories = _katz(rows, order)
    unseen = [("the",) * n for n in range(order)] + [("</s>x", "fox")[:n] for n in range(min(order, 3))]
    for h in histories[:: max(1, len(histories) // 60)] + unseen:  # every distribution sums to one, with one unknown word
        assert abs(sum(p(h, w) for w in uni) + p(h, "<unknown>") - 1) < 1e-9
    got = lm.score(docs.where("doc_id is null or doc_id not in (16, 17)"), order=order, bucket=20).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        seq = [*_words(texts[r.doc_id]), "</s>"]
        assert r.train_tokens == total and r.n_tokens == len(seq) and r.n_known == sum(w in uni for w in seq)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((uni.get(w, 0) + 1) / (total + len(uni) + 1)) for w in seq))
        padded = ["<s>"] * (order - 1) + seq
        want = sum(math.log10(p(tuple(padded[j : j + order - 1]), w)) for j, w in enumerate(seq))
        assert r.score == pytest.approx(want), r.doc_id
    if order == 3:
        assert lm.score(none).count() == 0
        alone = lm.score(docs.where("doc_id = 4"), held=F.lit(True)).first()
        assert alone.train_tokens == 0 and alone.score == 0 and alone.base_score == 0


def test_decontamination(spark, docs, none):
    items = [(1, BASE), (2, "A question about seven wizards in the quarry. The answer is violet ink and nothing else"), (3, None), (4, "too short"), (None, BASE), (1, BASE), (5, "")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect())
    want = Counter()
    for i, t in DOCS:
        for j, q in items:
            if j is not None and q and len(_words(q)) >= 5 and len(_set(q) & _set(t)) >= 0.8 * len(_set(q)):
                want[i, j] += 1
    assert got == want and (0, 1) in want
    several = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, pass_bytes=60).collect())
    assert several == want
    clean = decontaminate.keep_clean(docs, bench, pass_bytes=60)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in DOCS} - {i for i, _ in want}
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.keep_clean(docs, bench.limit(0)).count() == len(DOCS)


def _contained(item, text):
    words, question = _words(item), item.rpartition(". ")[0]
    there, every = _set(text), set(_words(text))
    share = lambda x, y: len(x & y) / len(x) if x else 1.0
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    if len(words) < 5:
        return False
    asked = share(grams(_words(question + ".")) if question else grams(words), there)
    told = share(set(_words(item.rpartition(". ")[2])) if question else set(), every)
    return share(grams(words), there) >= 0.8 or (asked >= 0.8 and told >= 0.8)


def test_decontamination_finds_scattered_answers(spark, monkeypatch):
    """Against brute force: questions whole or with gaps, answers scattered over a long text, in part, or missing."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 4000}"
    items = [(0, "one two three four five six seven. " + " ".join(f"a{i}" for i in range(60))), (1, "why so. yes because it is"), (2, "a a a a a a a a a a a a. b b b"), (3, "no answer in this one of seven words")]
    for k in range(4, 60):
        items.append((k, " ".join(word() for _ in range(rng.randint(3, 30))) + ". " + " ".join(word() for _ in range(rng.randint(1, 40)))))
    rows = [(0, None), (1, ""), (2, " ".join(f"a{i} x{i} y{i} z{i}" for i in range(50)) + " one two three four five six seven. " + " ".join(f"u{i}" for i in range(500)))]
    for i in range(3, 240):
        question, _, answer = items[rng.randrange(len(items))][1].partition(". ")
        q, a = (question + ".").split(), answer.split()
        if rng.random() < 0.4:
            q[rng.randrange(len(q))] = "gap"
        a = [x for x in a if rng.random() < rng.choice((1, 0.9, 0.75))]
        rng.shuffle(a)
        text = [word() for _ in range(rng.randint(0, 200))]
        for x in a:
            text.insert(rng.randint(0, len(text)), x)
        at = rng.randint(0, len(text))
        rows.append((i, " ".join(text[:at] + q + text[at:])))
    want = {(i, k) for i, t in rows for k, q in items if t and _contained(q, t)}
    assert (2, 0) in want and len(want) > 60
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound, opened in ((1 << 20, 2_000_000), (1500, 2_000_000), (1 << 20, 10)):
        monkeypatch.setattr(decontaminate, "OPEN", opened)
        assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, pass_bytes=bound).collect()} == want


def test_decontamination_index_size():
    import random

    rng = random.Random(2)
    items = [" ".join(f"{rng.choice(['th', 'an', 'er'])}{int(rng.paretovariate(0.5)) % 30000}" for _ in range(40)) for _ in range(2000)]
    known = [decontaminate.Item(k, t) for k, t in enumerate(items)]
    terms = {t for i in known for t in i.terms.tolist()}
    index = decontaminate.Index(known, dict.fromkeys(terms, 1.0), 40)
    assert index.nbytes() < 10 * sum(map(len, items))


def test_decontamination_finds_items_across_passage_borders(spark):
    item = " ".join(f"q{i}" for i in range(50))
    rows = [(k, " ".join([f"w{j}" for j in range(k)] + [item] + [f"v{j}" for j in range(300)])) for k in range(0, 200, 9)]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {k for k, _ in rows}


def test_toxicity(spark, docs, none):
    rows = [(i, ("you are a vile scoundrel " if i % 5 == 0 else "what a fine day ") + f"thing{i % 40} other{i % 17}", i) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None), (10, 0), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(d, labels).collect()
    assert len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) == (r.doc_id % 5 == 0)
    clean = toxicity.keep_clean(d, labels)
    assert clean.columns == d.columns and clean.count() == 480
    assert toxicity.score_documents(docs, labels.limit(0)).count() == len(DOCS)
    assert toxicity.score_documents(none, labels).count() == 0
    odd = toxicity.score_documents(docs, labels).collect()
    assert {r.score for r in odd if r.doc_id in (4, 5, 6)}.__len__() == 1


def test_toxicity_on_held_out_documents(spark):
    """Labels 0 are never learnt from: accuracy on the held-out fold, with and without them."""
    import random

    rng = random.Random(8)
    plain, vile = [f"word{i}" for i in range(400)], [f"vile{i}" for i in range(25)]
    rows, marks = [], []
    for i in range(2500):
        toxic = rng.random() < 0.12
        rows.append((i, " ".join(rng.choices(plain, k=rng.randint(5, 80)) + (rng.choices(vile, k=3) if toxic else []))))
        marks.append((i, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([m for m in marks if m[0] % 2], "doc_id long, toxic int")
    got = toxicity.score_documents(d, known).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 400 and sum(r.predicted == marks[r.doc_id][1] for r in held) >= 0.97 * len(held)
    only = toxicity.score_documents(d, known.where("toxic = 1")).collect()
    assert {(r.doc_id, r.score) for r in only} == {(r.doc_id, r.score) for r in got}


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", "é" * 600), (7, "http://g", big), (8, "", "ö" * 500), (9, "h", "ö" * 500), (9, "h", "ö" * 500), (None, "n", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int").repartition(3)
    files = []
    for _ in range(2):
        root = work_path(spark, "warc-test")
        m = warc.write(pages, root, range_bytes=3000, roll_bytes=700)
        files.append(sorted((r.name, r.sha256, r.records) for r in m.collect()))
        got = warc.read(spark, root).collect()
        assert sorted(map(str, (r.page_id for r in got))) == sorted(str(r[0]) for r in rows)
        want = {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 8: ("revisit", 9), 9: ("response", None), None: ("response", None)}
        for r in got:
            body = (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()
            assert (r.record_type, r.refers_to) == want[r.page_id] and r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
    assert files[0] == files[1] and len(files[0]) > 2
    root = work_path(spark, "warc-test")
    assert warc.write(pages.limit(0), root).count() == 0 and warc.read(spark, root).count() == 0


def test_warc_shards_of_any_distribution_of_ids(spark):
    """Ids far apart, one id of many payloads, and null ids: shards hold about the bytes of a range."""
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(i, "u", text(10_000)) for i in range(300)] + [(10**15, "far", "x"), (-(2**62), "low", None), (2**63 - 1, "top", "y")]
    rows += [(7, f"v{i}", text(10_000)) for i in range(100)] + [(None, f"n{i}", text(10_000)) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = []
    for partitions in (2, 5):
        root = work_path(spark, "warc-ids")
        m = warc.write(pages.repartition(partitions), root, range_bytes=500_000)
        files.append(sorted((r.name, r.sha256, r.records) for r in m.collect()))
        assert len(files[-1]) >= 8 and max(r[2] for r in files[-1]) <= 60 and sum(r[2] for r in files[-1]) == len(rows)
        got = Counter((r.page_id, r.url, r.payload_digest) for r in warc.read(spark, root).collect())
        assert got == Counter((i, u, hashlib.sha1((h or "").encode()).hexdigest()) for i, u, h in rows)
    assert files[0] == files[1]


def test_flac_columns(docs, none):
    media = flac.encode_column(docs)
    got = {r.doc_id: r for r in flac.features(media).collect()}
    texts = dict(DOCS)
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[0].feature == got[1].feature and got[4].media_sha256 == got[5].media_sha256
    blocks = flac.pcm_blocks(media).where("doc_id = 16").orderBy("sample_offset").collect()
    assert [b.sample_offset for b in blocks] == [k * flac.BLOCK for k in range(len(blocks))] and b"".join(b.pcm for b in blocks).startswith(b"word0 word1")
    assert flac.features(flac.encode_column(none)).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")
def test_token_columns(docs, none):
    got = {r.doc_id: r for r in sentencepiece.encode(docs).collect()}
    counts = {r.doc_id: r.n_tokens for r in tokencount.count(docs).collect()}
    for i, t in DOCS:
        assert got[i].decoded == (t or "") and got[i].n_tokens == len(got[i].ids) == counts[i]
    assert sentencepiece.encode(none).count() == 0 and tokencount.count(none).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")
def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    toxic = [(100 + i, f"you vile scoundrel number {i} go away from topic {i % 31}") for i in range(40)]
    plain = [(200 + i, f"a plain text number {i} about {BASE.split()[i % 20]} and topic {i * 7 % 31} of the day") for i in range(300)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*DOCS, *toxic, *plain]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in plain], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "unrelated text without any shared run of words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 13 not in got and not any(i in got for i, _ in toxic) and 0 in got and 1 in got and got[1].n_tokens == 0 and 4 in got


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")
def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage in plain Python on what the one before it kept; the final digests are those of the texts that are left."""
    import random

    import corpus_pipeline

    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "se", "ra", "lo") for b in ("n", "rt", "l", "sk", "m", "d", "x")]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared, items = [line(7) for _ in range(6)], [(k, f"{line(12)}. {line(6)}") for k in range(5)]
    rows = []
    for i in range(120):
        text = [line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        kind = i % 8
        if kind == 0 and rows:  # a near copy of an earlier text, on one line
            text = [rng.choice(rows)[1].replace("\n", " ") + " more"]
        if kind == 1:
            text.insert(rng.randint(0, len(text)), rng.choice(shared)[: -rng.randint(0, 2) or None])
        if kind == 2:
            text.append(rng.choice(items)[1])
        if kind == 3:
            text.append("you vile scoundrel and filthy liar")
        rows.append((i, "\n".join(text)))
    rows += [(900, ""), (901, None), (902, "\n\n")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    first = {r.doc_id: r.text for r in corpus_pipeline.reject_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    assert all("vile" not in (t or "") for t in first.values()) and len(first) >= 0.8 * len(rows)
    gone = _line_brute(list(first.items()))
    texts = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not gone(i, k, x)) for i, t in first.items()}
    root = {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    sets = {i: _set(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {i: t for i, t in texts.items() if find(i) == i}
    left = {i: t for i, t in left.items() if not (t and any(_contained(q, t) for _, q in items))}
    assert len(left) < len(texts) < len(rows) and any(texts[i] != first[i] for i in texts)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in left.items()}


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")
def test_pipeline_ids_give_the_text_back(spark):
    import corpus_pipeline

    texts = {1: BASE, 2: "Größe  3 € 日本\nnext line", 3: ""}
    got = corpus_pipeline.tokenize(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
