"""The thin queries over the tables of a data directory, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.llm.bpe import encode_texts
from tilecairn.llm.exact_dedup import dedup_exact
from tilecairn.llm.fingerprint import fingerprint_documents
from tilecairn.llm.html_text import extract_pages
from tilecairn.llm.jaccard_join import link_documents
from tilecairn.llm.line_dedup import dedup_lines
from tilecairn.llm.packing import pack
from tilecairn.llm.sharding import shard_rows
from tilecairn.llm.substring_dedup import dedup_passages
from tilecairn.llm.toxicity import detect_toxic

#: Shards of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_toxic(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


SPACE_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_fingerprint, op4_substring_dedup, op5_html_text, op6_toxicity, op7_line_dedup, op8_sharding, op9_bpe, op10_jaccard_join)}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
            row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)""",
    "op4_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM x),
        f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s HAVING min(doc_id) < max(doc_id)),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (s) WHERE doc_id > first),
        a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        t AS (
            SELECT a.doc_id, count(*) AS n_words, count(r.p) AS n_removed,
                string_agg(word, ' ' ORDER BY a.p) FILTER (r.p IS NULL) AS kept
            FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.p = r.p GROUP BY a.doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op10_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
        ), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x),
        k AS (SELECT doc_id, list_sort(list(g)) AS g FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN min(d.doc_id) OVER (PARTITION BY g) ELSE d.doc_id END AS class_id, component_id
        FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    # the pages of the tables all hold one article of paragraphs, for which text functions are enough
    "op5_html_text": r"""
        WITH a AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages
        ), b AS (
            SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda t: regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(replace(t, '<br>', ' '), '</?b>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g')) AS l FROM a
        ), c AS (
            SELECT page_id, url, array_to_string(list_filter(list_transform(l, lambda t: trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda t: t <> ''), chr(10)) AS text FROM b
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM c""",
    "op7_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
        ), x AS (
            SELECT doc_id, t, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM l
        ), k AS (
            SELECT *, translate(trim(line, {SPACE_CHARS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x
        ), s AS (
            SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND doc_id > first) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR doc_id = first), '')) AS kept_sha256
        FROM k LEFT JOIN s ON k.key = s.key GROUP BY doc_id, t""",
}
