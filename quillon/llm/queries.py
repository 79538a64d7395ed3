"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import contamination
from .labelled import labelled_table
from .packing import pack
from .phrases import remove_phrases
from .pii import personal_data
from .quality import quality_rules
from .secrets import secret_scan
from .sharding import shard_rows
from .simhash import simhash_groups
from .substrings import remove_substrings
from .wrappers import extract


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), labelled_table(spark))


def op2_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_packing_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"))


def op7_decontamination_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_phrases(table(spark, sf_dir, "documents"))


def op10_sharding_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 8 SQL can express: the counts and the base verdict."""
    return op8_quality_isolation_forest(spark, sf_dir).drop("kept", "anomaly")


def sharding_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 10 SQL can express: each row with its size, and how shards and slots add up."""
    rows = op10_sharding_bounded_ring(spark, sf_dir)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).groupBy().agg(
        F.count("*").alias("shards"), F.sum("n").alias("documents"), (F.max("n") - F.min("n")).alias("spread"), F.sum((F.col("slots") == F.col("n")).cast("int") * (F.col("last") == F.col("n") - 1).cast("int")).alias("gapless")
    ).crossJoin(F.broadcast(rows.agg(F.sum("size").alias("bytes"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii_crf, op2_secret_linking, op3_html_wrappers, op4_simhash_balls, op5_packing_hilbert, op6_substring_dedup, op7_decontamination_prefix_join, op8_quality_isolation_forest, op9_phrase_automata, op10_sharding_bounded_ring, quality_base_rules, sharding_balance)}
#: Windows of every length that items have, as the query's; a document's words are numbered once and joined on the window's words.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT spot.r, spot.i, spot.n, win.item_id FROM spot JOIN win USING (s, n)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""

#: Every string of 200 bytes by its MD5, counted over all documents; the runs that repeated ones cover go.
OP6_SQL = r"""
WITH s AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, encode(coalesce(text, '')) AS x FROM documents),
spot AS (SELECT r, i, md5_number(array_slice(x, i + 1, i + 200)) AS k FROM s, unnest(range(0, n - 199)) AS t(i) WHERE n >= 200),
often AS (SELECT k FROM spot GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM spot JOIN often USING (k)),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM hit),
gone AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, run),
told AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS rest FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(hex(array_slice(x, a + 1, b)), '' ORDER BY a) AS k FROM (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM gone) JOIN s USING (r) WHERE b > a GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_removed IS NULL THEN x ELSE unhex(coalesce(k, '') || hex(array_slice(x, rest + 1, n))) END) AS kept_sha256 FROM s LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

#: Every window of 35 words as one string, counted over all documents; the words that no repeated one covers stay.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
often AS (SELECT s FROM spot GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM spot JOIN often USING (s), unnest(range(i, i + 35)) AS t(p)),
lost AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(w[p], ' ' ORDER BY p) AS k FROM (SELECT r, w, p FROM d, unnest(range(1, len(w) + 1)) AS t(p)) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""

#: The words of each text are numbered once; windows of three words that occur again cover the repeated ones.
BASE_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
three AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS s FROM w, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) > 2),
again AS (SELECT r, s FROM three GROUP BY r, s HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM three JOIN again USING (r, s), unnest(range(i, i + 3)) AS t(p) GROUP BY r),
lines AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
 FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""

BALANCE_SQL = "SELECT CAST(least(24, count(*)) AS BIGINT) AS shards, count(*) AS documents, CAST(CASE WHEN count(*) % 24 = 0 THEN 0 ELSE 1 END AS BIGINT) AS spread, CAST(24 AS BIGINT) AS gapless, CAST(sum(octet_length(encode(coalesce(text, ''))) + 8) AS BIGINT) AS bytes FROM documents"

ORACLE: dict[str, str] = {"quality_base_rules": BASE_RULES_SQL, "sharding_balance": BALANCE_SQL, "op6_substring_dedup": OP6_SQL, "op7_decontamination_prefix_join": OP7_SQL, "op9_phrase_automata": OP9_SQL}
