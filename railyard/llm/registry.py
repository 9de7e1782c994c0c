"""Registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from railyard.llm.decontaminate import decontaminate
from railyard.llm.fingerprints import neighbour_likeness
from railyard.llm.html_text import extract_main_text
from railyard.llm.langid import fit, identify
from railyard.llm.licenses import licence_scan
from railyard.llm.minhash import minhash_near_dedup
from railyard.llm.mixing import curriculum_mix
from railyard.llm.ppm import score_documents
from railyard.llm.ranked_search import ranked_search
from railyard.llm.resample import importance_resample
from railyard.llm.simhash import hex_fingerprint, simhash_near_dedup
from railyard.llm.suffix_dedup import suffix_array_dedup
from railyard.llm.warc import archive_round_trip
from railyard.session import scratch_path

# weights 5, 2 and 1 over the whole of training: the first fades, the last grows
CURVES = [[(0, 6), (1, 4)], [(0, 2), (1, 2)], [(0, 0.5), (1, 1.5)]]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    """Rows in the order of their first reading; those that are not read come last."""
    mixed = curriculum_mix(_table(spark, sf_dir, "documents"), CURVES)
    return (mixed.withColumn("position", F.get("positions", F.lit(0))).drop("positions", "source")
                 .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_array_dedup(_table(spark, sf_dir, "documents"), length=100).drop("kept", "document")


def op3_license_scan(spark, sf_dir):
    """Documents as files of a tree: 40 to a directory, ten of those to the next; every fortieth is a licence file,
    every four-hundredth one that stands a level higher."""
    top, leaf = F.expr("concat('r', doc_id div 4000, '/p', doc_id div 400)"), F.expr("concat('/m', doc_id div 40)")
    path = (F.when(F.col("doc_id") % 400 == 0, F.concat(top, F.lit("/LICENSE")))
             .when(F.col("doc_id") % 40 == 0, F.concat(top, leaf, F.lit("/LICENSE")))
             .otherwise(F.concat(top, leaf, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licence_scan(_table(spark, sf_dir, "documents").withColumn("path", path))


def op4_html_extraction(spark, sf_dir):
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark, sf_dir):
    return score_documents(_table(spark, sf_dir, "documents"), folds=10)


def op6_warc(spark, sf_dir):
    """The archives go to a folder of their own in the shared checkpoint folder."""
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    return archive_round_trip(_table(spark, sf_dir, "pages"), folder)


def op7_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op8_decontaminate(spark, sf_dir):
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark, sf_dir):
    found = simhash_near_dedup(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_fingerprints(spark, sf_dir):
    return neighbour_likeness(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark, sf_dir):
    found = importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
                                runs=2, buckets=10_000, percent=25, least_words=20, seed=7)
    return found.drop("n_words")


def op12_minhash_near_dedup(spark, sf_dir):
    return minhash_near_dedup(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op13_ranked_search(spark, sf_dir):
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_suffix_array_dedup, op3_license_scan, op4_html_extraction, op5_lm_scoring, op6_warc,
    op7_language_id, op8_decontaminate, op9_simhash_near_dedup, op10_fingerprints, op11_importance_resampling,
    op12_minhash_near_dedup, op13_ranked_search)}

# CRC-32 of a byte, by its eight shifts with the reversed polynomial
_CRC_STEPS = "t0 AS (SELECT i, i AS c FROM range(256) r(i))," + "".join(
    f"\nt{k} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END AS c FROM t{k - 1})," for k in range(1, 9))

ORACLES = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS turn
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
         sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s),
t AS (SELECT source, source_size, weight, turn,
             least(most, max((total - filled) / weight_left) OVER () * weight) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM r),
x AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS rest FROM w),
y AS (
  SELECT *, (size > 0 AND (whole > 0 OR rest > begin)) AS used,
         begin / target * weight AS area,
         [6.0::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE][turn + 1] AS w0, [-2.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE][turn + 1] AS slope
  FROM x)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(rest - begin, 0)) AS BIGINT) AS taken,
       CASE WHEN used THEN CASE WHEN area > 0 THEN 2.0::DOUBLE * area / (w0 + sqrt(greatest(w0 * w0 + 2.0::DOUBLE * slope * area, 0))) ELSE 0.0::DOUBLE END END AS position
FROM y""",
    "op8_decontaminate": r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
bm AS (SELECT item, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bi AS (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM bm),
bw AS (SELECT DISTINCT m, array_to_string(w[p:p + m - 1], ' ') AS win, item FROM bi),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
dw AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS win FROM di),
h AS (SELECT doc_id, p, m, item FROM dw JOIN bw USING (m, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op11_importance_resampling": "WITH " + _CRC_STEPS + r"""
tab AS (SELECT list(c ORDER BY i) AS tab FROM t8),
d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM d),
bf AS (SELECT unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM b),
u AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
h AS (SELECT f, hex(encode(f)) AS x FROM u),
y AS (SELECT f, list_prepend(4294967295::BIGINT, [CAST(('0x' || x[2 * i + 1:2 * i + 2]) AS BIGINT) FOR i IN range(0, len(x) // 2)]) AS bytes FROM h),
k AS (SELECT f, xor(list_reduce(bytes, lambda c, v: xor(tab[xor(c, v) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM y, tab),
n AS (SELECT doc_id, bucket FROM df JOIN k USING (f)),
s AS (SELECT bucket, count(*) AS s FROM n GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
         / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*)::BIGINT AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM n JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
         CAST('0x' || substring(sha256('7:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r),
p AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place, 25 * count(*) FILTER (able) OVER () // 100 AS draw FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM p""",
    "op12_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS low FROM r GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(least(low, doc_id), doc_id) AS component_id, coalesce(least(low, doc_id), doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON doc_id = node""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest([x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> '']) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM f, s),
r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50""",
}
