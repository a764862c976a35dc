"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines (between "\\n", compared without white space at their ends) are classes of
equal text, identified by two hashes and represented by their first occurrence
(by document id, then line). A class of at least ``min_chars`` characters is put
under ``threshold`` + 1 segments with its length; by the pigeonhole principle, a
line within the threshold contains one of them near its place, so each class
probes the segments of its own and of slightly shorter lengths with the
substrings that multi-match-aware selection leaves. Candidates of which one
contains too few of the other's finer segments aren't near; what is left is
decided by banded bit-parallel edit distance between the common beginning and end: for each number of errors k a word holds, for the diagonals of the
band, which prefixes are within k edits; a character of the line updates all.
Most candidates that aren't near are so after the first few characters.

A segment that less than ``HOT`` classes share gives candidates as pairs of ids,
so that their number is a small multiple of that of the probes at most. The rows of a more common one carry their text and are put under a segment of the
rest of the line as well (the same principle holds for the rest with the edits
that are left); there only the existence of one earlier line is asked for, by
semi joins, which make no pairs and which Spark splits where a key is skewed.

An occurrence is removed if its text occurred before, or if its text is within
the threshold of one that occurred before. So the lines of a document that stay
are those classes' first occurrences in it that have no earlier near line, and
its lines below ``exact_chars``; no row per occurrence is kept or joined. Lines
below ``min_chars``, where two edits mean little, take part as exact copies only.

Defined results: a null text stays null and has no lines; an empty text has one
empty line; lines below both bounds always stay; rows with a null id stay whole and
remove nothing; rows that repeat an id are taken as one document: equal lines at
the same place stay in each, and of different ones at the same place each can
stay. Extra columns are kept; one that has the name of an added count gives way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import drop, fresh, materialize

#: Edits, and characters of a line that takes part in the edit join and in exact copies.
THRESHOLD, MIN_CHARS, EXACT_CHARS = 2, 20, 1
#: Classes that share a segment before their texts go along, which bounds the pairs of a probe; such segments that are broadcast (8 bytes each).
HOT, BROADCAST_KEYS = 8, 100_000
#: Classes of pairs up to this number are broadcast (8 bytes each) to pick their texts.
BROADCAST_IDS = 400_000
#: Descending powers of two, by which the length of a common beginning is searched.
_SHORT, _LONG = ([1 << b for b in range(top, -1, -1)] for top in (9, 29))
#: Finer segments of a line, of which all but one for each edit are in a near line.
PARTS = 12
#: Characters after which the automaton is asked first whether anything is within the threshold.
GLANCE = 12


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\x0b"))


def _segment(length: Column, i: Column, threshold: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th segment of a line of this length; the longer ones come last."""
    base = F.call_function("div", length, threshold + 1).cast("int")
    short = (threshold + 1) - (length - base * (threshold + 1))
    return base * i + F.greatest(i - short, F.lit(0)) + 1, base + F.when(i < short, 0).otherwise(1)


def _steps(threshold: int, longer: range) -> list[tuple[int, int, int, int]]:
    """(t, d, i, o): what a line of d more characters probes for t edits: segment i, o places to the right of its own."""
    out = []
    for d in longer:
        for i in range(threshold + 1):
            left, right = i, threshold - i
            out += [(threshold, d, i, o) for o in range(max(-left, d - right), min(left, d + right) + 1)]
    return out


def _array(steps: list[tuple[int, int, int, int]]) -> Column:
    return F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip("tdio", s, strict=True))) for s in steps))


def _index(first: DataFrame, threshold: int) -> DataFrame:
    """(k, a, i, at, to): the key of each segment of each class, and where the segment begins and ends."""
    rows = first.select("*", F.explode(F.array(*map(F.lit, range(threshold + 1)))).alias("i"))
    start, size = _segment(F.col("n"), F.col("i"), F.lit(threshold))
    rows = rows.withColumn("at", start).withColumn("to", F.col("at") + size)
    return rows.withColumn("k", F.xxhash64(F.substring("key", F.col("at"), F.col("to") - F.col("at")), "n", "i"))


def _probe(first: DataFrame, threshold: int) -> DataFrame:
    """(k, b, i, at, to, d, o): the substrings of each class that can be a segment of a line at most ``threshold`` shorter."""
    rows = first.select("*", F.explode(_array(_steps(threshold, range(threshold + 1)))).alias("s"))
    rows = rows.select(*first.columns, "s.d", "s.i", "s.o")
    start, size = _segment(F.col("n") - F.col("d"), F.col("i"), F.lit(threshold))
    rows = rows.withColumn("at", start + F.col("o")).withColumn("to", F.col("at") + size).where("at >= 1 and to - 1 <= n")
    return rows.withColumn("k", F.xxhash64(F.substring("key", F.col("at"), F.col("to") - F.col("at")), F.col("n") - F.col("d"), "i"))


def _rest(threshold: int) -> tuple[Column, Column, Column]:
    """What is left of a line beside its segment, on the side with more edits left: where it begins, its length, its edits."""
    last = F.col("i") == threshold
    return (
        F.when(last, 1).otherwise(F.col("to")),
        F.when(last, F.col("at") - 1).otherwise(F.col("n") + 1 - F.col("to")),
        F.when(last, threshold).otherwise(threshold - F.col("i")),
    )


def _refined_index(rows: DataFrame, threshold: int) -> DataFrame:
    at, n, t = _rest(threshold)
    rows = rows.withColumn("p", at).withColumn("m", n).withColumn("t", t).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("t"))))
    start, size = _segment(F.col("m"), F.col("j"), F.col("t"))
    return rows.withColumn("k2", F.xxhash64("k", "j", F.substring("key", F.col("p") - 1 + start, size)))


def _refined_probe(rows: DataFrame, threshold: int) -> DataFrame:
    """As :func:`_refined_index`; the rest of the shorter line has less characters, what the segment was moved by aside."""
    at, n, t = _rest(threshold)
    more = F.when(F.col("i") == threshold, F.col("o")).otherwise(F.col("d") - F.col("o"))
    steps = [s for left in range(1, threshold + 1) for s in _steps(left, range(-left, left + 1))]
    rows = rows.withColumn("p", at).withColumn("m", n).withColumn("t", t).withColumn("more", more)
    # only the steps that belong to a row become rows
    rows = rows.withColumn("s", F.explode(F.filter(_array(steps), lambda s: (s["t"] == F.col("t")) & (s["d"] == F.col("more")))))
    start, size = _segment(F.col("m") - F.col("more"), F.col("s.i"), F.col("t"))
    rows = rows.withColumn("from", start + F.col("s.o")).withColumn("size", size).where("from >= 1 and from + size - 1 <= m")
    return rows.withColumn("k2", F.xxhash64("k", F.col("s.i").alias("j"), F.substring("key", F.col("p") - 1 + F.col("from"), F.col("size"))))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(x: Column, y: Column) -> Column:
    """Characters of the common beginning of two different strings."""
    powers = F.when(F.greatest(F.length(x), F.length(y)) < 1024, F.lit(_SHORT)).otherwise(F.lit(_LONG))
    same = lambda p, s: F.substring(x, p + 1, s) == F.substring(y, p + 1, s)
    return F.aggregate(powers, F.lit(0), lambda p, s: p + F.when(same(p, s), s).otherwise(F.lit(0)))


def within(x: Column, y: Column, threshold: int) -> Column:
    """Whether two strings are within ``threshold`` edits, by a banded bit-parallel automaton.

    The distance is that of what lies between the common beginning and end.
    """
    cut = lambda s, k: F.substring(s, k + 1, F.length(s))
    pair = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    tail = lambda s: _bind(_common(s["x"], s["y"]), lambda k: pair(F.reverse(cut(s["x"], k)), F.reverse(cut(s["y"], k))))
    middle = lambda s: _bind(_common(s["x"], s["y"]), lambda k: pair(cut(s["x"], k), cut(s["y"], k)))
    decide = lambda s: _automaton(s["x"], s["y"], threshold)
    # of the pair with its ends cut off twice, in reverse, which changes no distance
    cut_off = F.transform(F.transform(F.transform(F.array(pair(x, y)), tail), middle), decide)
    return F.when(x == y, True).when(F.abs(F.length(x) - F.length(y)) > threshold, False).otherwise(F.get(cut_off, F.lit(0)))


def _automaton(x: Column, y: Column, threshold: int) -> Column:
    t = threshold
    lx, ly = F.length(x), F.length(y)
    few, apart = F.greatest(lx, ly) <= t, F.abs(lx - ly) > t
    alive = _run(F.substring(x, 1, GLANCE + t), F.substring(y, 1, GLANCE), t)[f"r{t}"] != 0
    end = _run(x, y, t)[f"r{t}"].bitwiseAND(F.call_function("shiftleft", F.lit(1), lx - ly + t)) != 0
    return F.when(few, True).when(apart | (ly == 0), False).when(~alive, False).otherwise(end)


def _run(x: Column, y: Column, t: int) -> Column:
    """The words after the last character of y, which isn't empty."""
    width = 2 * t + 1
    full = (1 << width) - 1
    # bit b of word k: the first i characters of y and i + b - t of x are within k edits.
    # The characters are in the state, so that they are split once
    words = [F.lit(sum(1 << (j + t) for j in range(k + 1))).alias(f"r{k}") for k in range(t + 1)]
    start = F.struct(F.split(x, "").alias("xs"), F.split(y, "").alias("ys"), *words)

    def step(s: Column, i: Column) -> Column:
        c, xs = F.get(s["ys"], i), s["xs"]
        match = F.lit(0)
        for b in range(width):
            match = match.bitwiseOR(F.when(F.get(xs, i + (b - t)) == c, F.lit(1 << b)).otherwise(F.lit(0)))
        # once no prefix is within the threshold, none will be
        return F.when(s[f"r{t}"] == 0, s).otherwise(F.struct(xs.alias("xs"), s["ys"].alias("ys"), *_step(s, match, t, full)))

    return F.aggregate(F.sequence(F.lit(0), F.length(y) - 1), start, step)


def _step(s: Column, match: Column, t: int, full: int) -> list[Column]:
    out: list[Column] = []
    for k in range(t + 1):
        r = s[f"r{k}"].bitwiseAND(match)
        if k:
            old = s[f"r{k - 1}"]
            r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(out[k - 1], 1))
        out.append(r.bitwiseAND(F.lit(full)))
    return [c.alias(f"r{k}") for k, c in enumerate(out)]


def _near(a: str, b: str, threshold: int) -> Column:
    """Whether the lines of two sides, in their column ``key``, are near."""
    x, y = F.col(f"{a}.key"), F.col(f"{b}.key")
    parts = (_segment(F.length(x), F.lit(i), F.lit(PARTS - 1)) for i in range(PARTS))
    there = reduce(Column.__add__, (F.when(F.contains(y, F.substring(x, start, size)), 1).otherwise(0) for start, size in parts))
    return (there >= PARTS - threshold) & within(x, y, threshold)


def _classes(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """(id, doc_id, line, h, n, key): the classes at their first occurrence; the text only of those in the edit join."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    line = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("doc_id", "line", _key(F.col("raw")).alias("key"))
    line = line.where(F.length("key") >= exact_chars).withColumn("n", F.length("key"))
    long = F.when(F.col("n") >= min_chars, F.col("key"))
    line = line.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), F.struct("doc_id", "line", "n", long.alias("key")).alias("m"))
    first = line.groupBy("h", "g").agg(F.min("m").alias("m"))
    return first.select(F.monotonically_increasing_id().alias("id"), "m.doc_id", "m.line", "h", "m.n", "m.key")


def _pairs(index: DataFrame, probe: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that share a segment with few, and (-1, b): classes that probe a common one (materialised)."""
    asked = index.select("k", F.col("id").alias("a")).unionAll(hot.select("k", F.lit(-1).cast("long")))
    pairs = asked.hint("shuffle_hash").join(probe.select("k", F.col("id").alias("b")), "k").where("a <> b")
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _late_in_pairs(pairs: DataFrame, first: DataFrame, threshold: int) -> DataFrame:
    """Ids of the classes of pairs that are near one that is earlier."""
    ids = materialize(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "ids")
    # only the texts of pairs are dealt out
    text = first.join(_small(ids, BROADCAST_IDS), "id", "left_semi").select("id", F.struct("doc_id", "line").alias("at"), "key")
    both = pairs.join(text.select(F.col("id").alias("a"), F.struct("at", "key").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.struct("at", "key").alias("y")), "b")
    late = both.where(_near("x", "y", threshold)).select(F.when(F.col("x.at") < F.col("y.at"), F.col("b")).otherwise(F.col("a")).alias("id"))
    late = materialize(late.distinct(), "late")
    drop(ids)
    return late


def _late_in_common(index: DataFrame, probe: DataFrame, threshold: int) -> DataFrame:
    """Ids of the classes with an earlier near line, of those that share a segment with many."""
    columns = ["k2", "id", F.struct("doc_id", "line").alias("at"), "key"]
    x = materialize(_refined_index(index, threshold).select(*columns), "common")
    y = materialize(_refined_probe(probe, threshold).select(*columns), "common")
    late = None
    for one, other in ((x, y), (y, x)):
        one, other = one.alias("one"), other.alias("other").hint("merge")
        earlier = (F.col("one.k2") == F.col("other.k2")) & (F.col("other.at") < F.col("one.at")) & _near("one", "other", threshold)
        some = one.join(other, earlier, "left_semi").select("one.id")
        late = some if late is None else late.unionAll(some)
    late = materialize(late.distinct(), "late")
    drop(x)
    drop(y)
    return late


def _small(keys: DataFrame, most: int) -> DataFrame:
    """A written table of numbers, to be broadcast where it has at most so many rows (8 bytes each)."""
    return F.broadcast(keys) if keys.count() <= most else keys


def kept_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """(doc_id, kept): numbers, from 0, and hashes of the lines that stay of each document; lines below ``exact_chars`` aren't listed."""
    every = materialize(_classes(docs, min_chars, min(exact_chars, min_chars)), "classes")
    first = every.where("key is not null").select("id", "doc_id", "line", "n", "key")
    index, probe = _index(first, threshold), _probe(first, threshold)
    hot = materialize(index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("k"), "hot")
    few = _small(hot, BROADCAST_KEYS)
    pairs = _pairs(index.join(few, "k", "left_anti"), probe, hot)
    late = _late_in_pairs(pairs.where("a >= 0"), first, threshold)
    if hot.limit(1).count():
        some = materialize(pairs.where("a < 0").select(F.col("b").alias("id")), "probing")
        probing = _probe(first.join(_small(some, BROADCAST_IDS), "id", "left_semi"), threshold)
        late = late.unionAll(_late_in_common(index.join(few, "k", "left_semi"), probing.join(few, "k", "left_semi"), threshold)).distinct()
        drop(some)
    drop(pairs)
    stay = every.join(late, "id", "left_anti").groupBy("doc_id").agg(F.collect_list(F.struct("line", "h")).alias("kept"))
    stay = materialize(stay, "kept")
    for x in (every, hot):
        drop(x)
    return stay


def deduplicate(
    docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS, counts: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """All columns of the documents, ``text`` without the removed lines, and the numbers of lines before and of lines removed."""
    doc, kept, stay, lines = fresh(docs, "doc", "kept", "stay", "lines")
    listed = kept_lines(docs, threshold, min_chars, exact_chars).toDF(doc, kept)
    known = docs.where("doc_id is not null")
    out = known.join(listed.hint("shuffle_hash"), known["doc_id"] == listed[doc], "left").drop(doc)
    split = F.split("text", "\n")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    line = lambda i: _key(F.get(F.col(lines), i))
    short = F.filter(every, lambda i: F.length(line(i)) < min(exact_chars, min_chars))
    long = F.transform(F.filter(F.col(kept), lambda m: F.xxhash64(line(m["line"])) == m["h"]), lambda m: m["line"])
    out = out.withColumn(lines, split).withColumn(stay, F.sort_array(F.concat(short, F.coalesce(long, F.array().cast("array<int>")))))
    # rows without an id stay whole
    unknown = docs.where("doc_id is null").withColumn(lines, split).withColumn(stay, every)
    out = out.drop(kept).unionByName(unknown)
    text = F.when(F.size(stay) == F.size(lines), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    whole = F.col("text").isNotNull()
    return out.select(
        *(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in {x.lower() for x in counts}),
        F.when(whole, F.size(lines)).otherwise(0).cast("long").alias(counts[0]),
        F.when(whole, F.size(lines) - F.size(stay)).otherwise(0).cast("long").alias(counts[1]),
    )
