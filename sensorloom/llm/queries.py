"""Registered queries of the subpackage and their comparison SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import bpe, embeddings, interactions, lengths, licenses, minhash, packing, pages, quality, rules, sharding, token_files, vector_codes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.ratings(table(spark, sf_dir, "labels")))
    return quality.graded(docs, model)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled_shards(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(table(spark, sf_dir, "documents"))
    base = rules.Policy("base-1", rules.BASE)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(base)).alias("base_failed"), rules.passes(rules.POLICIES["full-1"]).alias("kept"), "failed_bits",
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)[0]


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_report(lengths.length_histogram(table(spark, sf_dir, "documents"), VOCABULARY))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(interactions.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, end_id=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_quality, op3_sharding, op4_bpe, op5_rules, op6_embeddings, op7_licenses, op8_token_counts, op9_html, op10_packing,
        op11_vector_codes, op12_interactions, op13_token_files,
    )
}

RULES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), runs AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS run
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) > 8)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 8) AS t(k) GROUP BY r
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter,
         len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), judged AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (n_upper > n_lower)::INT + 32 * (word_chars < 2 * n_words)::INT
    + 64 * (word_chars > 20 * n_words)::INT + 128 * (100 * n_stutter > 20 * n_words)::INT AS BIGINT) AS failed_bits FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits % 4 > 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM judged
"""


def licenses_sql() -> str:
    """Every line against every template, and every phrase at every word."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    known = ",\n".join(f"({t.number}, '{t.label}', {quoted(sorted(t.words))}, {t.needed(licenses.PERCENT)})" for t in licenses.templates())
    phrases = ",\n".join(f"('{label}', {quoted(phrase.split())})" for phrase, label in licenses.PHRASES.items())
    words = lambda text: f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH templates(template, label, wanted, needed) AS (VALUES {known}),
phrases(label, phrase) AS (VALUES {phrases}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS words FROM documents),
blocks AS (SELECT r, {words("line")} AS held FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
matches AS (
  SELECT r, list(DISTINCT label) AS labels, max(len(list_intersect(wanted, held)) / len(wanted)) AS containment
  FROM blocks, templates WHERE len(list_intersect(wanted, held)) >= needed GROUP BY r
),
spots AS (
  SELECT r, label, i FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM docs), phrases
  WHERE words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase
),
base AS (
  SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM spots GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN matches m USING (r) LEFT JOIN base b USING (r)
"""


# The given pages hold their text in one article of headings and paragraphs.
HTML_SQL = r"""
WITH parts AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS part FROM pages
), cleaned AS (
  SELECT page_id, url, list_transform(part, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS part FROM parts
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(part, lambda x: x <> ''), chr(10)) AS text FROM cleaned
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""

# Every document against every order, without masks: the first filter of the order that it fails removes it.
INTERACTIONS_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
least AS (SELECT text, min(doc_id) AS least_id FROM docs GROUP BY text),
rated AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs JOIN least USING (text) LEFT JOIN rated USING (doc_id)
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least_id THEN 'E' ELSE '' END AS fails
  FROM worded
), counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), gone AS (
  SELECT part, fails, n, good, toxic, filter_order,
         coalesce(list_min(list_transform(regexp_extract_all(fails, '.'), lambda x: strpos(filter_order, x))), 6) AS gone_at
  FROM counted, orders
), shares AS (
  SELECT part, f, sum(CASE WHEN gone_at < 6 AND substr(filter_order, gone_at, 1) = f THEN n ELSE 0 END) AS shapley FROM gone, letters GROUP BY part, f
), steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
         sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone_at < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(shapley AS BIGINT) AS shapley
FROM steps JOIN shares USING (part, f)
"""

ORACLES: dict[str, str] = {"op9_html": HTML_SQL, "op5_rules": RULES_SQL, "op7_licenses": licenses_sql(), "op12_interactions": INTERACTIONS_SQL}
