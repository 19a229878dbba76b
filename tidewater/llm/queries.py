"""Named queries over the corpus tables, one ``opN_`` entry per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.decontaminate import contamination
from tidewater.llm.divergence import source_divergence
from tidewater.llm.exact_dedup import exact_dedup
from tidewater.llm.html_text import extract_text
from tidewater.llm.lm_score import lm_scores
from tidewater.llm.packing import pack
from tidewater.llm.pii import find_pii
from tidewater.llm.quality import quality_verdicts
from tidewater.llm.ranked_search import ranked_search
from tidewater.llm.shared import table
from tidewater.llm.simhash_dedup import near_duplicates
from tidewater.llm.substring_dedup import substring_dedup
from tidewater.llm.suffix_dedup import suffix_dedup
from tidewater.llm.vector_dedup import near_vectors

#: A-Z lowered, everything else left alone, in SQL.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), tails=True)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_keeper_rows")


OP5_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOW}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
"""

def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = f"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS terms, least(len(w), 10) AS n
  FROM bw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win),
cut AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS terms
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, item_id, i, cut.n FROM cut JOIN win ON cut.terms = win.terms AND cut.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN named USING (doc_id)
"""

def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT row_number() OVER () AS query, item_id, list_distinct(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), size AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, w, 100 - 50 + (50 * len(w) * docs) // words AS m FROM d, size WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM m) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
hit AS (
  SELECT query, item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT query, item_id, unnest(w) AS term FROM q) JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (r) GROUP BY ALL
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM hit WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, sum(n) AS total, count(*)::HUGEINT AS kinds FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
totals AS (SELECT lang, source, sum(c.n) AS total FROM counts c JOIN kept USING (lang, term) GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(o.total, 0)::HUGEINT AS total, l.total AS lang_total, kinds
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals o USING (lang, source) LEFT JOIN langs l USING (lang)
), dense AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (total + kinds) AS p,
    1 + (1000000000 * (kept.n + 1)) // (lang_total + kinds) AS q
  FROM kept JOIN groups USING (lang) LEFT JOIN counts c USING (lang, source, term)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_html_text": op2_html_text,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {"op5_exact_dedup": OP5_SQL, "op8_decontaminate": OP8_SQL, "op11_ranked_search": OP11_SQL, "op13_source_divergence": OP13_SQL}
