"""The opN_ queries of this subpackage, with production parameters, over whole tables; and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.llm import decontaminate, gam, middle, mixing, negatives, ngram_join, rules, sanitise, sharding, token_lengths, token_records, url_filter, warc


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_copies").alias("copies"))


def op2_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_disclosure_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.sanitise(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_terms", "n_spans")


def op4_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.suffix_sums(token_lengths.length_histogram(_table(spark, sf_dir, "documents"), vocabulary()))


def op8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents")).drop("row_number")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("fim_output"), F.col("fim_form"))
    return cut.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), F.sha2(F.col("fim_output"), 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: The rules of the query: text and verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = url_filter.write_list(spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), listed)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_pareto_mix, op2_gam_quality, op3_disclosure_sanitise, op4_bayes_jaccard, op5_risk_rules, op6_warc, op7_length_histogram, op8_containment, op9_feistel_shards, op10_token_records, op11_hard_negatives, op12_fill_in_middle, op13_url_filter)
    return {f.__name__: f for f in named}


#: The mix in SQL: sources, size classes, ranks and the point up to which ranks are taken.
MIX_SQL = """
    WITH c AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    d AS (SELECT doc_id, mark, source, size, length(bin(size)) AS class FROM c),
    cells AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
    s0 AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM cells GROUP BY 1),
    s1 AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s0),
    s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
    lv AS (SELECT level FROM s2 WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
    src AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM lv) * w, cap)), 6) AS target FROM s2),
    k1 AS (SELECT cells.source, class, words, source_size, target, pow(2.0::DOUBLE, 0.25::DOUBLE * class) AS m
           FROM cells JOIN src ON cells.source IS NOT DISTINCT FROM src.source),
    k2 AS (SELECT *, (target - coalesce(sum(2.0::DOUBLE * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / nullif(sum(m * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS l FROM k1),
    best AS (SELECT source, arg_max(l, class) AS l FROM k2 WHERE l * m <= 2 GROUP BY 1),
    k3 AS (SELECT k2.source, class, words, source_size, target, greatest(0.0::DOUBLE, least(2.0::DOUBLE, coalesce(best.l * m, 2.0::DOUBLE))) AS e
           FROM k2 LEFT JOIN best ON k2.source IS NOT DISTINCT FROM best.source),
    r AS (SELECT doc_id, d.source, size, source_size, target, floor(e) AS whole, e - floor(e) AS p,
            (('0x' || substr(md5('SEED:' || mark), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
          FROM d JOIN k3 ON d.source IS NOT DISTINCT FROM k3.source AND d.class = k3.class),
    o AS (SELECT *, CASE WHEN size > 0 AND p > 1e-12 THEN (u / (1 - u)) / (least(p, 1 - 1e-12) / (1 - least(p, 1 - 1e-12))) END AS odds FROM r),
    q AS (SELECT *, CAST(floor(odds / (1 + odds) * 1125899906842624.0::DOUBLE) AS BIGINT) AS k FROM o),
    g AS (SELECT source, max(target) - sum(floor(e) * words) AS missing FROM k3 GROUP BY 1),
    t AS (SELECT source, k, sum(size) AS x FROM q WHERE k IS NOT NULL GROUP BY ALL),
    v AS (SELECT t.source, k, x, missing, sum(x) OVER (PARTITION BY t.source ORDER BY k) AS upto FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
    y AS (SELECT *, upto <= missing AS inside, sum(CASE WHEN upto > missing THEN 1 END) OVER (PARTITION BY source ORDER BY k) AS nth,
            missing - coalesce(max(CASE WHEN upto <= missing THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM v),
    z AS (SELECT source, coalesce(max(CASE WHEN inside THEN k END), -1) AS cut,
            arg_min(k, (abs(gap - x), k)) FILTER (WHERE NOT inside AND nth <= 64 AND abs(gap - x) < gap) AS pick FROM y GROUP BY 1)
    SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken, CAST(n AS BIGINT) AS copies
    FROM (SELECT q.*, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN k <= cut OR k = pick THEN 1 ELSE 0 END END AS n
          FROM q LEFT JOIN z ON q.source IS NOT DISTINCT FROM z.source)""".replace("SEED", str(mixing.SEED))


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": MIX_SQL,
        "op6_warc": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
            s AS (SELECT d, n, max(page_id) AS m, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d, n)
            SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest,
                   CASE WHEN s.c > 1 AND s.m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN s.c > 1 AND s.m <> page_id THEN s.m END AS refers_to
            FROM p LEFT JOIN s ON p.d = s.d AND p.n = s.n""",
        "op11_hard_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                       FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
                  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
            p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
            n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
                  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
            SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
        "op12_fill_in_middle": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens, sha256('42:' || doc_id) AS h FROM documents),
            e AS (SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
            f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
                    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
            g AS (SELECT *, array_to_string(tokens[1:lo], '') AS p, array_to_string(tokens[lo + 1:hi], '') AS m, array_to_string(tokens[hi + 1:], '') AS s FROM f)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM g""",
        "op13_url_filter": r"""
            WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS found FROM pages),
            r AS (SELECT page_id, CASE WHEN found > 0 THEN substr(url, found + 3) ELSE '' END AS rest FROM u),
            h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
            SELECT page_id, host, path,
                   CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
                   CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'allow' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'block'
                        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'allow' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'block' ELSE 'allow' END AS verdict FROM h""",
    }
