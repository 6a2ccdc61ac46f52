"""The registered queries of the text operators, on the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    decontamination,
    exact_dedup,
    fill_in_middle,
    html_text,
    language_id,
    packing,
    quality,
    ranked_search,
    simhash,
    substring_dedup,
    token_counts,
    token_files,
    url_rules,
)
from logloom.llm.shared import crc_mod, table

#: (action, host, path) of the production rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_verdicts(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Learned from documents and labels whose crc32(doc_id) mod 4 is not 2."""
    return quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality",
                         usable=lambda doc_id: crc_mod(doc_id, 4) != 2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_texts(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, usable=lambda doc_id: crc_mod(doc_id, 5) != 0)
    return language_id.identify(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.fresh_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents),
        places AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM split),
        windows AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 34), ' ') AS win FROM places),
        repeats AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY win) > 1),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 35)))) AS dropped FROM repeats GROUP BY doc_id),
        kept AS (
            SELECT doc_id, len(words) AS n_words,
                   list_filter(words, lambda w, i: NOT list_contains(coalesce(dropped, []), i)) AS rest
            FROM split LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_words - len(rest) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256
        FROM kept
    """,
    "op2_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
                   length(coalesce(text, '')) AS n_chars
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM rows
        WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
    """,
    "op7_url_filter": r"""
        WITH rests AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parsed AS (
            SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
                   regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
            FROM rests),
        rules(action, rule_host, rule_path) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        best AS (
            SELECT page_id, max_by(struct_pack(rule := rule_host || rule_path, action := action),
                                   length(rule_host || rule_path)) AS b
            FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                                  AND starts_with(path, rule_path)
            GROUP BY page_id)
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict
        FROM parsed LEFT JOIN best USING (page_id)
    """,
    "op11_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM lengths),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, totals GROUP BY term, n_docs),
        wanted AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        impacts AS (
            SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)) AS impact
            FROM counts JOIN lengths USING (doc_id), totals),
        scores AS (
            SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
            FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op12_fill_in_middle": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h
            FROM documents),
        numbers AS (
            SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
                   ('0x' || h[17:24])::BIGINT % 100 AS keep, ('0x' || h[25:32])::BIGINT % 100 AS turn
            FROM texts),
        parts AS (
            SELECT doc_id, n, text,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR keep >= 90
                        THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form,
                   least(a, b) AS c, greatest(a, b) AS d
            FROM numbers)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN c END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN d - c END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || substr(text, 1, c) || '<S>' || substr(text, d + 1) || '<M>' || substr(text, c + 1, d - c)
                      ELSE '<S>' || substr(text, d + 1) || '<P>' || substr(text, 1, c) || '<M>' || substr(text, c + 1, d - c) END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}
