"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import common


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.decontam import decontaminate

    return decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(common.documents(spark, sf_dir))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.mixing import mix

    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op4_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.toxicity import toxicity_scores

    return toxicity_scores(common.documents(spark, sf_dir), common.labels(spark, sf_dir)).drop("evidence")


def op5_hyperminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.neardup import near_duplicates

    return near_duplicates(common.documents(spark, sf_dir), percent=80, size=4)


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.lm import lm_scores

    return lm_scores(common.documents(spark, sf_dir))


def op7_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.quality import quality_scores

    return quality_scores(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.tokenout import token_output

    return token_output(common.documents(spark, sf_dir), vocabulary()).drop("path")


def op9_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.langid import language_id

    return language_id(common.documents(spark, sf_dir))


def op10_exact_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.exact_dedup import exact_dedup

    return exact_dedup(common.documents(spark, sf_dir)).drop("n_chunks")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS k, least(len(w), 13) AS n FROM i),
sz AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sz WHERE len(w) >= n),
m AS (SELECT doc_id, s, p.n, item_id FROM p JOIN g ON array_to_string(w[s:s + p.n - 1], ' ') = k AND p.n = g.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""

#: Every string of 100 bytes by its place; those seen earlier merge into runs, and what lies between the runs is kept.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS pos, h FROM d WHERE length(h) >= 200),
k AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 200)) AS key FROM s),
o AS (SELECT key, min((doc_id, pos)) AS earliest FROM k GROUP BY key HAVING count(*) > 1),
r AS (SELECT doc_id, pos FROM k JOIN o USING (key) WHERE (doc_id, pos) <> earliest),
n AS (SELECT *, coalesce((pos > 100 + lag(pos) OVER (PARTITION BY doc_id ORDER BY pos))::INT, 1) AS fresh FROM r),
g AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n),
x AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM x
      UNION ALL SELECT doc_id, length(h) // 2, coalesce(b, 0) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM x GROUP BY doc_id) USING (doc_id)),
t AS (SELECT c.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (upto - from_)), '' ORDER BY from_) AS kept FROM c JOIN d USING (doc_id) GROUP BY c.doc_id),
z AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM x GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN z USING (doc_id)
"""

#: Texts of equal sets are one class; classes that share a shingle are counted against the limit, and links are followed.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS s FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[s:s + 3], ' ')) AS k FROM p),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(k::VARCHAR, ',' ORDER BY k)) AS class FROM sh GROUP BY doc_id),
cls AS (SELECT class, min(doc_id) AS node, any_value(n) AS n FROM sets GROUP BY class),
m AS (SELECT node, n, k FROM cls JOIN sh ON sh.doc_id = cls.node),
l AS (SELECT a.node AS a, b.node AS b FROM m a JOIN m b ON a.k = b.k AND a.node <> b.node
      GROUP BY a.node, b.node HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT node, node AS c FROM cls UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
f AS (SELECT node, min(c) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id)::BIGINT AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN cls USING (class) LEFT JOIN f USING (node)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0::DOUBLE ELSE round(0.25::DOUBLE + 0.75::DOUBLE * (length(regexp_replace(text, '[#$%&*|!{}<>=+\\~^@_\[\]]', '', 'g'))::DOUBLE / length(text)), 6) END AS quality
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM p),
f AS (SELECT *, 3.0::DOUBLE * source_size / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM f),
v AS (SELECT coalesce((SELECT lev FROM l WHERE lev <= full_at ORDER BY full_at, lev LIMIT 1), 0::DOUBLE) AS lev),
t AS (SELECT l.source, l.source_size, round(least(v.lev * weight, 3.0::DOUBLE * source_size), 6) AS target FROM l, v),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.source,
         -ln((('0x' || substr(md5('mix:' || d.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / d.quality AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
s AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS ahead,
         CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM k)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken, epochs
FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_phrases": OP1_SQL, "op2_suffix_repeats": OP2_SQL, "op3_source_mix": OP3_SQL, "op5_hyperminhash_groups": OP5_SQL, "op10_exact_recipes": OP10_SQL}
