"""The opN_ queries and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .collocations import COVERED, MIN_COUNT, SCALE, TOP, UND, collocations, frequent_phrases
from .common import table
from .exact_dedup import dedup_decisions
from .labelled import fold
from .line_dedup import BLOCKS, MIN_PAGES, RATIO, line_dedup
from .mixing import MAX_REPEATS, OFFSETS, SEED, WEIGHTS, WORD, mix_decisions
from .near_dedup import near_classes
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .sharding import shard_documents
from .spelling import spelling_variants, word_counts
from .token_files import token_file_round_trip
from .toxicity import fit_toxicity, score_toxicity
from .vectors import nearest


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_file_round_trip(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"), joined=False, end_id=1)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_digests(docs, vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).drop("text_id")


def _scores(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select(
        "doc.doc_id", (fold(F.col("doc.doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return _scores(score_toxicity(docs, model), 5, 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return _scores(score_quality(docs, model), 3, 1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_decisions(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", "host", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("text_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), slip=199))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_decisions(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_inverted_multi_index": op1_inverted_multi_index,
    "op2_sharding": op2_sharding,
    "op3_token_files": op3_token_files,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_prob_minhash": op5_prob_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_mixing": op12_source_mixing,
    "op13_collocations": op13_collocations,
}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    # crc32 by its table of 256 remainders; forms by deletion neighbourhoods: words one letter apart share what is left without it
    "op11_spelling_variants": rf"""
        WITH RECURSIVE crc_table AS (
          SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        runs AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(translate(text, {_A_TO_Z}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        counted AS (SELECT k, run, count(*) AS c, hex(encode(k || ':' || run)) AS bytes FROM runs WHERE length(run) >= 6 GROUP BY k, run),
        hashed AS (
          SELECT run, c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(bytes) // 2),
            lambda i: CAST('0x' || substr(bytes, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
            lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h
          FROM counted, crc_table),
        slipped AS (
          SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
        words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, CAST(length(word) + 1 AS INTEGER))) AS i)),
        near AS (
          SELECT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
        forms AS (
          SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
          FROM words w LEFT JOIN best b ON w.word = b.word),
        walk AS (SELECT word, word AS reached, 0 AS step FROM forms UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON w.reached = f.word WHERE f.form IS NOT NULL),
        roots AS (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word)
        SELECT f.word, n, n_near, form, form_n, root FROM forms f JOIN roots r ON f.word = r.word""",
    "op12_source_mixing": rf"""
        WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
        sources AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
          FROM sized GROUP BY source),
        levels AS (
          SELECT 0 AS k, CAST(sum(source_size) AS DOUBLE) / sum(w) AS level FROM sources
          UNION ALL
          SELECT k + 1, (SELECT CAST(sum(source_size) - coalesce(sum(CASE WHEN source_size * {MAX_REPEATS} <= w * level THEN source_size * {MAX_REPEATS} END), 0) AS DOUBLE)
                                / sum(CASE WHEN source_size * {MAX_REPEATS} <= w * level THEN NULL ELSE w END) FROM sources)
          FROM levels WHERE k < 60),
        aimed AS (
          SELECT source, source_size, least(CAST(source_size * {MAX_REPEATS} AS DOUBLE), w * (SELECT max(level) FROM levels)) AS target,
                 CAST(CAST('0x' || substr(md5(concat_ws(':', '{SEED}', source)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS base FROM sources),
        ranked AS (
          SELECT s.doc_id, s.source, size, source_size, target, base, row_number() OVER (PARTITION BY s.source ORDER BY size, s.doc_id NULLS LAST) - 1 AS k,
                 CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e
          FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
        tried AS (
          SELECT *, i, base + i / {OFFSETS}.0 - floor(base + i / {OFFSETS}.0) AS o FROM ranked, (SELECT unnest(range({OFFSETS})) AS i)),
        taken_ AS (SELECT *, CAST(floor(e) + floor((e - floor(e)) * (k + 1) + o) - floor((e - floor(e)) * k + o) AS BIGINT) AS copies FROM tried),
        best AS (
          SELECT source, arg_min(i, (by_, i)) AS i FROM (SELECT source, i, abs(sum(copies * size) - max(target)) AS by_ FROM taken_ GROUP BY source, i) GROUP BY source)
        SELECT doc_id, size, source_size, target, copies, copies * size AS taken
        FROM taken_ t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.i = b.i""",
    "op13_collocations": rf"""
        WITH pieces AS (
          SELECT row_number() OVER () AS p, lang, piece FROM (
            SELECT coalesce(lang, '{UND}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_A_TO_Z}), '[.,;:!?
-]')) AS piece FROM documents)),
        listed AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
        grams AS (
          SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
          FROM listed, LATERAL (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i)),
        counts AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS n FROM grams GROUP BY lang, k, phrase),
        totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND n >= {MIN_COUNT}),
        cuts AS (
          SELECT c.lang, c.k, c.phrase, a, w, cut, x.n AS l, y.n AS r, CAST(({SCALE}::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
          FROM candidates c, LATERAL (SELECT unnest(range(1, c.k)) AS cut)
          JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
          JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 : ], ' ')),
        weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        kept AS (
          SELECT * FROM weakest c WHERE NOT EXISTS (
            SELECT 1 FROM candidates t WHERE t.lang = c.lang AND t.k = 3 AND c.k = 2 AND 100 * t.a >= {COVERED} * c.a
            AND c.phrase IN (array_to_string(t.w[1 : 2], ' '), array_to_string(t.w[2 : 3], ' ')))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT r.lang, rank, phrase, a, l, r, t.n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {TOP}""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_line_dedup": rf"""
        WITH bodies AS (
          SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
                 regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
                   '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'),
                   '(?i)</?({BLOCKS})( [^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS body
          FROM pages),
        pages_ AS (
          SELECT page_id, host, row_number() OVER () AS r,
                 list_filter(list_transform(regexp_split_to_array(body, '[\r\n]+'),
                   lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM bodies),
        each_ AS (SELECT r, host, unnest(list_distinct(lines)) AS line FROM pages_),
        common AS (
          SELECT host, line FROM each_ JOIN (SELECT host, count(*) AS n FROM pages_ GROUP BY host) USING (host)
          GROUP BY host, line, n HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * n),
        gone AS (SELECT r, list(line) AS bad FROM each_ JOIN common USING (host, line) GROUP BY r),
        kept AS (SELECT p.*, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS k FROM pages_ p LEFT JOIN gone USING (r))
        SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(k) AS BIGINT) AS n_dropped,
               sha256(coalesce(array_to_string(k, chr(10)), '')) AS text_sha256 FROM kept""",
}
