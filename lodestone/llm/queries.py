"""The opN queries and the pipeline, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, flac, jaccard, lines, lm, sentencepiece, substring, tokencount, toxicity, warc
from lodestone.runtime import read_table, work_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), root)
    return warc.read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.features(flac.encode_column(_read(spark, sf_dir, "documents")))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicate(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.encode(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("overlap", "question_overlap", "answer_overlap")))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


#: A-Z in lower case, then words.
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_flac": op6_flac,
    "op7_suffix_array": op7_suffix_array,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_katz": op10_katz,
}
SQL = {
    "op7_suffix_array": """
        WITH h AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
        ), w AS (
            SELECT doc_id, i, x[2 * i + 1 : 2 * i + 100] AS g
            FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 50)) AS i FROM h WHERE len(x) >= 100)
        ), m AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM w
        ), r AS (
            SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM m WHERE least < doc_id
        ), g AS (
            SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
        ), s AS (
            SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run
        ), k AS (
            SELECT doc_id, a AS cut, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM s
        ), j AS (
            SELECT k.doc_id, string_agg(x[2 * kept_from + 1 : 2 * cut], '' ORDER BY cut) AS front, max(b) AS last, sum(b - cut) AS n, count(*) AS c
            FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY k.doc_id
        )
        SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN j.doc_id IS NULL THEN x ELSE concat(front, x[2 * last + 1 :]) END)) AS kept_sha256
        FROM h LEFT JOIN j ON j.doc_id = h.doc_id
    """,
    "op1_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_n >= 80 * (a.n + b.n - both_n)
        ), r AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
        )
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
    """,
    "op3_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, raw, regexp_replace(raw, '^[\x09\x0B\x0C\r ]+|[\x09\x0B\x0C\r ]+$', '', 'g') AS k
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
        ), f AS (
            SELECT k, min(doc_id * 2147483648 + i) AS place, length(k) AS n FROM l WHERE k <> '' GROUP BY k
        ), s AS (
            SELECT *, unnest([0, 1, 2]) AS j, n // 3 AS base, 3 - (n - 3 * (n // 3)) AS short FROM f WHERE n >= 20
        ), x AS (
            SELECT place, k, n, j, base * j + greatest(j - short, 0) AS at, substr(k, CAST(base * j + greatest(j - short, 0) + 1 AS BIGINT), CAST(CASE WHEN j < short THEN base ELSE base + 1 END AS BIGINT)) AS seg FROM s
        ), c AS (
            SELECT place, k, n, n - less AS m, less, j, o
            FROM (SELECT *, unnest([0, 1, 2]) AS less FROM f WHERE n >= 20), (SELECT unnest([0, 1, 2]) AS j), (SELECT unnest([-2, -1, 0, 1, 2]) AS o)
        ), p AS (
            SELECT place, k, n, m, j, substr(k, CAST((m // 3) * j + greatest(j - (3 - (m - 3 * (m // 3))), 0) + 1 + o AS BIGINT), CAST(CASE WHEN j < 3 - (m - 3 * (m // 3)) THEN m // 3 ELSE m // 3 + 1 END AS BIGINT)) AS seg
            FROM c WHERE (m // 3) * j + greatest(j - (3 - (m - 3 * (m // 3))), 0) + 1 + o >= 1
        ), e AS (
            SELECT DISTINCT greatest(x.place, p.place) AS place
            FROM x JOIN p ON x.seg = p.seg AND x.n = p.m AND x.j = p.j AND x.place <> p.place
            WHERE levenshtein(x.k, p.k) <= 2
        ), r AS (
            SELECT l.doc_id, l.i, l.raw, f.place IS NOT NULL AND (f.place <> l.doc_id * 2147483648 + l.i OR e.place IS NOT NULL) AS gone
            FROM l LEFT JOIN f ON f.k = l.k LEFT JOIN e ON e.place = f.place
        )
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed,
            sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM r GROUP BY doc_id
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
        ), m AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < top THEN top END AS refers_to
        FROM m
    """,
    "op9_decontamination": f"""
        WITH i AS (
            SELECT item_id, {_WORDS.format("text")} AS w,
                {_WORDS.format("CASE WHEN contains(text, '. ') THEN regexp_extract(text, '(?s)^(.*[.]) ', 1) ELSE text END")} AS q,
                {_WORDS.format("CASE WHEN contains(text, '. ') THEN regexp_extract(text, '(?s)^.*[.] (.*)$', 1) END")} AS a
            FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), g AS (
            SELECT DISTINCT item_id, 'w' AS part, array_to_string(w[k : k + 4], ' ') AS x FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS k FROM i)
            UNION ALL SELECT DISTINCT item_id, 'q', array_to_string(q[k : k + 4], ' ') FROM (SELECT *, unnest(generate_series(1, len(q) - 4)) AS k FROM i)
            UNION ALL SELECT DISTINCT item_id, 'a', unnest(a) FROM i
        ), n AS (
            SELECT item_id, part, count(*) AS n FROM g GROUP BY ALL
        ), d AS (
            SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
        ), t AS (
            SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS x, false AS one FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS k FROM d)
            UNION ALL SELECT DISTINCT doc_id, unnest(w), true FROM d
        ), h AS (
            SELECT doc_id, item_id, part, count(*) AS n FROM t JOIN g ON g.x = t.x AND (g.part = 'a') = t.one GROUP BY ALL
        ), s AS (
            SELECT h.doc_id, h.item_id, h.part, h.n * 1.0::DOUBLE / n.n AS share FROM h JOIN n ON n.item_id = h.item_id AND n.part = h.part
        ), o AS (
            SELECT w.doc_id, w.item_id, w.share AS overlap,
                CASE WHEN nq.n IS NULL THEN 1 ELSE coalesce(q.share, 0) END AS question_overlap,
                CASE WHEN na.n IS NULL THEN 1 ELSE coalesce(a.share, 0) END AS answer_overlap
            FROM (SELECT * FROM s WHERE part = 'w') w
            LEFT JOIN (SELECT * FROM s WHERE part = 'q') q ON q.doc_id = w.doc_id AND q.item_id = w.item_id
            LEFT JOIN (SELECT * FROM s WHERE part = 'a') a ON a.doc_id = w.doc_id AND a.item_id = w.item_id
            LEFT JOIN (SELECT * FROM n WHERE part = 'q') nq ON nq.item_id = w.item_id
            LEFT JOIN (SELECT * FROM n WHERE part = 'a') na ON na.item_id = w.item_id
        )
        SELECT doc_id, item_id, round(overlap, 6) AS overlap, round(question_overlap::DOUBLE, 6) AS question_overlap, round(answer_overlap::DOUBLE, 6) AS answer_overlap
        FROM o WHERE overlap >= 0.8 OR (question_overlap >= 0.8 AND answer_overlap >= 0.8)
    """,
}
