"""The corpus operators' queries, on their whole tables, and their SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, language, toxicity
from .bpe_table import encode_table
from .chat_format import chat_digest, format_chats
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .license_scan import license_scan
from .packing import pack
from .substring_dedup import substring_dedup
from .topk_search import build_index, search

_SPACED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat_digest(format_chats(chats.unionByName(more)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(build_index(docs), docs.filter("doc_id % 100 = 0")).withColumn("score", F.round("score", 6))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(common.crc_of_id(), F.lit(5)) == 0
    model = language.fit(docs.filter(~held_out))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True).selectExpr("doc_id", "n_tokens", "ids AS ids_sha256", "decoded AS decoded_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(common.crc_of_id(), F.lit(3)) == 1
    model = toxicity.fit(docs.filter(~held_out), common.table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_license_scan": op2_license_scan,
        "op3_topk_search": op3_topk_search,
        "op4_packing": op4_packing,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_language_id": op6_language_id,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": r"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
            u AS (SELECT conv_id, list(role ORDER BY turn NULLS FIRST, role, text) AS roles,
                         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
                         string_agg('<|im_start|>' || regexp_replace(replace(replace(role, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\1\\|', 'g') || chr(10)
                             || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS formatted
                  FROM t GROUP BY conv_id),
            w AS (SELECT *, list_reduce(list_prepend('start', roles), lambda s, r: CASE s || ' ' || r
                      WHEN 'start system' THEN 'told' WHEN 'start user' THEN 'asked' WHEN 'told user' THEN 'asked' WHEN 'asked assistant' THEN 'answered'
                      WHEN 'answered user' THEN 'asked' WHEN 'answered tool' THEN 'asked' WHEN 'asked tool' THEN 'asked' ELSE 'invalid' END) AS state,
                      list_filter(range(len(roles)), lambda k: list_reduce(list_prepend('start', roles[:k + 1]), lambda s, r: CASE s || ' ' || r
                      WHEN 'start system' THEN 'told' WHEN 'start user' THEN 'asked' WHEN 'told user' THEN 'asked' WHEN 'asked assistant' THEN 'answered'
                      WHEN 'answered user' THEN 'asked' WHEN 'answered tool' THEN 'asked' WHEN 'asked tool' THEN 'asked' ELSE 'invalid' END) = 'invalid')[1] AS first_bad FROM u)
            SELECT conv_id, len(roles)::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
                   length(formatted)::BIGINT AS formatted_chars, CASE state WHEN 'answered' THEN 'complete' WHEN 'invalid' THEN 'invalid' ELSE 'open' END AS state, first_bad
            FROM w""",
        "op3_topk_search": r"""
            WITH w AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
            tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM w) GROUP BY r, term),
            n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
            idf AS (SELECT term, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term),
            q AS (SELECT min(r) AS r, doc_id AS query_id FROM w WHERE doc_id % 100 = 0 GROUP BY doc_id, text),
            s AS (SELECT query_id, q.r AS qr, d.r, sum(a.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len(w.ws) / mean))) AS score
                  FROM q JOIN tf a ON a.r = q.r JOIN idf USING (term) JOIN tf d USING (term) JOIN w ON w.r = d.r, n GROUP BY 1, 2, 3)
            SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (
                SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id, qr ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s JOIN w USING (r)) WHERE rank <= 10""",
        "op5_substring_dedup": r"""
            WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            p AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS spot FROM w WHERE len(ws) >= 35),
            k AS (SELECT r, spot, array_to_string(ws[spot:spot + 34], ' ') AS run FROM p),
            twice AS (SELECT r, spot FROM k QUALIFY count(*) OVER (PARTITION BY run) > 1),
            gone AS (SELECT r, list(DISTINCT spot + o) AS words FROM twice, range(0, 35) t(o) GROUP BY r)
            SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(words), 0)::BIGINT AS n_removed,
                   sha256(array_to_string(CASE WHEN words IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(words, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
            FROM w LEFT JOIN gone USING (r)""",
        "op7_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS grams FROM w),
            g AS (SELECT min(r) AS g, grams, count(*) AS copies, min(doc_id) AS least FROM s WHERE len(grams) > 0 GROUP BY grams),
            t AS (SELECT g, len(grams) AS n, unnest(grams) AS gram FROM g),
            both_ AS (SELECT a.g AS a, b.g AS b, count(*) AS c, max(a.n) AS na, max(b.n) AS nb FROM t a JOIN t b ON a.gram = b.gram AND a.g <> b.g AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY 1, 2),
            link AS (SELECT a, b FROM both_ WHERE c * 5 >= 4 * (na + nb - c)),
            walk AS (SELECT g AS a, g AS b FROM g UNION SELECT walk.a, link.b FROM walk JOIN link ON link.a = walk.b),
            class AS (SELECT a AS g, min(least) AS class_id FROM walk JOIN g ON g.g = walk.b GROUP BY a),
            near AS (SELECT a AS g, sum(copies) AS n FROM link JOIN g ON g.g = link.b GROUP BY a)
            SELECT doc_id, CASE WHEN copies > 1 OR near.n IS NOT NULL THEN class_id ELSE doc_id END AS class_id, (coalesce(near.n, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links, coalesce(copies, 1) AS copies
            FROM s LEFT JOIN g ON g.grams = s.grams AND len(s.grams) > 0 LEFT JOIN class ON class.g = g.g LEFT JOIN near ON near.g = g.g""",
        "op8_exact_dedup": f"""
            SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
            FROM (SELECT doc_id, {_SPACED} AS norm FROM documents)""",
    }
