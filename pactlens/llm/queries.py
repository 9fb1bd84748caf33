"""The registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import bpe, conversation_repair, fill_in_middle, jaccard_join, license_scan, license_texts, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_files, topk, url_filter
from pactlens.llm.common import table
from pactlens.session import scratch_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = (
    url_filter.Rule.parse("block", "net/"),
    url_filter.Rule.parse("allow", "example.net/en/"),
    url_filter.Rule.parse("block", "example.com/de/"),
    url_filter.Rule.parse("allow", "org/fr/"),
)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decide(table(spark, sf_dir, "pages"), URL_RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, WORD_TOKENIZER)
    return token_files.read(spark, folder)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_jaccard_join": op13_jaccard_join,
}



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSE_VALUES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in license_texts.TEMPLATES.items())

ORACLES = {
    "op4_license_scan": f"""
WITH templates(license, notice) AS (VALUES {LICENSE_VALUES}),
cut_templates AS (SELECT license, list_filter(string_split_regex(lower(notice), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '') AS words FROM templates),
wanted AS (
    SELECT DISTINCT license, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
    FROM cut_templates
),
sizes AS (SELECT license, count(*) AS n FROM wanted GROUP BY license),
cut AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '') AS words FROM documents),
held AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM cut WHERE len(words) >= 5)
SELECT h.doc_id, w.license, CAST(count(*) AS DOUBLE) / any_value(s.n) AS containment
FROM held h JOIN wanted w USING (shingle) JOIN sizes s USING (license)
GROUP BY h.doc_id, w.license HAVING count(*) >= 0.8 * any_value(s.n)
""",
    "op2_topk_search": """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op8_url_filter": r"""
WITH rules(verdict, rule, host, path) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
           ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
),
cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
fits AS (
    SELECT p.page_id, max_by(struct_pack(r := r.rule, v := r.verdict), length(r.rule)) AS best
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.best.r AS rule, coalesce(f.best.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (page_id)
""",
    "op12_fill_in_middle": r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
    FROM documents
),
numbered AS (
    SELECT doc_id, text, units, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM drawn
),
parts AS (
    SELECT doc_id, text, n, list_aggregate(units[1:least(h1 % (n + 1), h2 % (n + 1))], 'string_agg', '') AS p,
           list_aggregate(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], 'string_agg', '') AS m,
           list_aggregate(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], 'string_agg', '') AS s,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbered
),
whole AS (SELECT doc_id, text, n, form, coalesce(p, '') AS p, coalesce(m, '') AS m, coalesce(s, '') AS s FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM whole
""",
    "op13_jaccard_join": r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
    FROM cut
),
held AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
    FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY 1, 2
),
linked AS (SELECT x, y FROM common WHERE 100 * shared >= 85 * (nx + ny - shared)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
""",
}
