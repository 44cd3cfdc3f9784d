"""The registered queries of this package: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import hard_negatives, html_wrapper, iso_media, licenses, line_dedup, ngram_join, packing, pii, prefix_table, quality, quality_classifier, token_alignment, wavelet
from junctura.llm.license_texts import TEMPLATES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, from their wavelet shards.  Edge cases: :func:`junctura.llm.wavelet.wavelet_tokens`."""
    return wavelet.wavelet_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pieces of all documents, encoded and decoded.  Edge cases: :func:`junctura.llm.prefix_table.encode_decode`."""
    return prefix_table.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages.  Edge cases: :func:`junctura.llm.html_wrapper.extract`."""
    return html_wrapper.extract(_table(spark, sf_dir, "pages"))


def op4_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids.  Edge cases: :func:`junctura.llm.packing.pack`."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and statements of all documents.  Edge cases: :func:`junctura.llm.licenses.scan`."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, with thresholds from all labels.  Edge cases: :func:`junctura.llm.quality.quality`."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as media containers, read back.  Edge cases: :func:`junctura.llm.iso_media.media_columns`."""
    return iso_media.media_columns(_table(spark, sf_dir, "documents"))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents.  Edge cases: :func:`junctura.llm.pii.detect`."""
    return pii.detect(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of near copies of all documents.  Edge cases: :func:`junctura.llm.ngram_join.ngram_join`."""
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that many share.  Edge cases: :func:`junctura.llm.line_dedup.line_dedup`."""
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op11_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two tokenizers, aligned over all documents.  Edge cases: :func:`junctura.llm.token_alignment.alignment`."""
    return token_alignment.align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors.  Edge cases: :func:`junctura.llm.hard_negatives.mine`."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents.  Edge cases: :func:`junctura.llm.quality_classifier.classify`."""
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline over all documents.  Edge cases: the stages in ``corpus_pipeline``."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_wavelet, op2_prefix_pieces, op3_html_wrapper, op4_bounded_packing, op5_license_scan, op6_quality_rules, op7_iso_media, op8_pii_spans, op9_ngram_join, op10_line_dedup, op11_segment_alignment, op12_hard_negatives, op13_factorisation_machine, pipeline)}

def _quality_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    """The counts, the tuning order, the exact tails and the verdicts of :mod:`quality` in SQL."""
    rules = list(quality.GRIDS)
    grid = ", ".join(f"({i}, {float(c)!r})" for i, r in enumerate(rules) for c in quality.GRIDS[r])
    values = f"[{', '.join(rules)}]"
    ratio = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
    return rf"""
WITH w0 AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum FROM documents),
word AS (
  SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM (SELECT r, regexp_extract_all(t, '[^ 	-
]+') AS w FROM w0)),
win AS (
  SELECT r, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
n_word AS (
  SELECT r, count(*) AS n_words, sum(length(a)) AS word_chars FROM word GROUP BY r),
n_line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM w0)
  WHERE regexp_matches(x, '[^ 	-
]') GROUP BY r),
c AS (
  SELECT r, doc_id, stratum, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM w0 LEFT JOIN n_word USING (r) LEFT JOIN n_line USING (r) LEFT JOIN rep USING (r)),
f AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratio("n_symbols", "word_chars")} AS symbol_ratio, {ratio("n_bangs", "word_chars")} AS bang_ratio,
         {ratio("n_upper", "word_chars")} AS upper_ratio, {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio, {ratio("n_repeat_words", "n_words")} AS repeat_ratio FROM c),
label AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lab AS MATERIALIZED (
  SELECT r, stratum, {values} AS v, quality = 1 AS good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS tuning FROM f JOIN label USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
grid(rule, cutoff) AS (VALUES {grid}),
tuned AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good AND v[rule + 1] > cutoff) AS k, count(*) FILTER (NOT good AND v[rule + 1] > cutoff) AS hits
  FROM lab CROSS JOIN grid WHERE tuning GROUP BY ALL),
step AS MATERIALIZED (
  SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY k, -hits, rule, cutoff) AS i FROM tuned WHERE hits > 0),
first_step AS (
  SELECT h.r, h.stratum, h.good, min(s.i) AS i FROM lab h LEFT JOIN step s ON s.stratum = h.stratum AND h.v[s.rule + 1] > s.cutoff WHERE NOT h.tuning GROUP BY ALL),
test AS (
  SELECT s.stratum, s.i, count(*) FILTER (h.good) AS n, count(*) FILTER (h.good AND h.i <= s.i) AS k, count(*) FILTER (NOT h.good AND h.i <= s.i) AS hits
  FROM step s JOIN first_step h ON h.stratum = s.stratum GROUP BY s.stratum, s.i),
tail AS (
  SELECT stratum, i, n, k, hits, CASE WHEN k >= n * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) END AS p FROM test),
taken AS (
  SELECT stratum, arg_max(i, (hits - k) * 1000 - i) AS i FROM tail
  WHERE hits > k AND p <= {delta} / (SELECT greatest(1, count(DISTINCT stratum)) FROM lab WHERE tuning) GROUP BY stratum),
cut AS (
  SELECT s.stratum, s.rule, min(s.cutoff) AS cutoff FROM step s JOIN taken t ON t.stratum = s.stratum AND s.i <= t.i GROUP BY ALL),
lost AS (
  SELECT DISTINCT f.r FROM f JOIN cut ON cut.stratum = f.stratum AND ({values})[cut.rule + 1] > cut.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost.r IS NULL AS kept
FROM f LEFT JOIN lost USING (r)"""


def _license_sql(threshold: float = licenses.THRESHOLD) -> str:
    """Base phrases, and every window of word pairs around every template, in SQL."""
    rows = ", ".join(f"({k}, '{label}', '{' '.join(w.decode() for w in licenses.WORD.findall(text.encode().lower()))}')" for k, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS a FROM d),
next AS MATERIALIZED (
  SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
phrase(label, p) AS (VALUES {phrases}),
base AS MATERIALIZED (
  SELECT r, i, label FROM next JOIN phrase ON a = p[1] AND b = p[2] AND (len(p) = 2 OR c = p[3])),
template(k, label, t) AS (VALUES {rows}),
token AS (
  SELECT k, label, string_split(t, ' ') AS w FROM template),
pair AS (
  SELECT DISTINCT k, label, len(w) AS words, w[j] AS a, w[j + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS j FROM token)),
size AS (
  SELECT k, any_value(label) AS label, count(*) AS n, CAST(floor(any_value(words) / {threshold} + 1e-9) AS BIGINT) - 1 AS span, greatest(1, CAST(ceil({threshold} * count(*) - 1e-9) AS BIGINT)) AS need FROM pair GROUP BY k),
hit AS MATERIALIZED (
  SELECT r, i, pair.k, pair.a || ' ' || pair.b AS token FROM next JOIN pair ON next.a = pair.a AND next.b = pair.b),
held AS (
  SELECT j.r, j.k, j.i AS spot, h.token, max(h.i) AS i FROM hit j JOIN size s ON s.k = j.k JOIN hit h ON h.r = j.r AND h.k = j.k AND h.i <= j.i AND h.i > j.i - s.span GROUP BY ALL),
found AS MATERIALIZED (
  SELECT r, held.k, label, min(i) AS first, spot + 1 AS last, count(*) / any_value(n)::DOUBLE AS part FROM held JOIN size s ON s.k = held.k GROUP BY r, held.k, label, spot HAVING count(*) >= any_value(need)),
block AS (
  SELECT r, count(*) FILTER (first > coalesce(before, -1)) AS n_blocks FROM (
    SELECT r, first, max(last) OVER (PARTITION BY r ORDER BY first, last, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found) GROUP BY r),
named AS (
  SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found UNION SELECT r, label FROM base) GROUP BY r),
based AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
best AS (SELECT r, max(part) AS part FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN named USING (r) LEFT JOIN based USING (r) LEFT JOIN best USING (r) LEFT JOIN block USING (r)"""


NGRAM_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
                         WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END AS g FROM d),
named AS MATERIALIZED (
  SELECT r, doc_id, g, CASE WHEN len(g) > 0 THEN sha256(array_to_string(g, chr(10))) END AS node FROM grams),
node AS MATERIALIZED (
  SELECT node, any_value(g) AS g, min(doc_id) AS doc, count(*) AS n_copies FROM named WHERE node IS NOT NULL GROUP BY node),
piece AS MATERIALIZED (SELECT node, len(g) AS n, unnest(g) AS x FROM node),
link AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM piece a JOIN piece b ON a.x = b.x AND a.node <> b.node
  GROUP BY a.node, b.node HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (
  SELECT node AS a, node AS b FROM node
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT reach.a AS node, min(node.doc) AS class_id FROM reach JOIN node ON node.node = reach.b GROUP BY reach.a),
degree AS (SELECT a AS node, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, CASE WHEN node IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM named LEFT JOIN class USING (node) LEFT JOIN degree USING (node) LEFT JOIN (SELECT node, n_copies FROM node) USING (node)"""

NEGATIVES_SQL = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS MATERIALIZED (
  SELECT a.uid AS a, a.vec_id AS anchor_id, b.uid AS b, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
positive AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) AS i FROM pair WHERE same) WHERE i <= 5),
negative AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.b) AS rank
  FROM positive p JOIN pair n ON n.a = p.a AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10"""

# Where the rows of a query follow from SQL alone.
ORACLES: dict[str, str] = {
    "op5_license_scan": _license_sql(),
    "op6_quality_rules": _quality_sql(),
    "op9_ngram_join": NGRAM_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op10_line_dedup": r"""
WITH line AS (
  SELECT doc_id, i, x AS line,
         translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
hot AS (
  SELECT k, max(doc_id) AS last_doc FROM line WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, line, hot.k IS NOT NULL AND doc_id <> last_doc AS dropped FROM line LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
