"""One query per operator over whole tables, with SQL where SQL can express it."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.llm import (
    decontamination, fill_in_middle, hard_negatives, importance, jaccard_join, language_id, license_scan, mixing,
    piece_encoding, quality_rules, sharding, substring_dedup, token_files,
)
from newsflow.operators.staging import Staging


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; only the queries that use one need that package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    bits = F.col("failure_bits")
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality_rules.rejects(bits, quality_rules.BASE).alias("base_failed"),
        (~quality_rules.rejects(bits, quality_rules.STRICT)).alias("kept"),
        bits,
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "start", "size", "similarity")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.into_shards(table(spark, sf_dir, "documents"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "linked")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Staging(spark).root}/tokens-{uuid.uuid4().hex[:8]}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.summary(token_files.read_tokens(spark, path))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    trees = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs, trees, ["doc_id", "held_out"])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, info, copies = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    size = mixing.words_in(F.col("text"))
    return rows.select(
        "doc_id",
        size.alias("size"),
        F.col(f"{info}.source_size").alias("source_size"),
        F.col(f"{info}.target").alias("target"),
        (size * F.col(copies)).alias("taken"),
    )


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), good)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    rows = piece_encoding.decode(piece_encoding.encode(table(spark, sf_dir, "documents"), model), model)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col(names["output"]), F.col(names["form"])
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(output, form), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_importance": op9_importance,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_piece_encoding": op12_piece_encoding,
    "op13_fill_in_middle": op13_fill_in_middle,
}

WORD = r"[^\x20\x09-\x0D]+"

# Measures of quality rules, per document, as a table "measures".
_MEASURES_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d
), grams AS (
  SELECT r, i, w[i:i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{WORD}') GROUP BY r
), measures AS (
  SELECT w.r, doc_id, t, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) AS n_alpha_words
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN lines ON w.r = lines.r
)"""
_BITS_SQL = " | ".join(
    f"CASE WHEN {condition} THEN {1 << place} ELSE 0 END" for place, condition in enumerate(quality_rules.RULES.values())
)

ORACLE = {
    "op1_quality_rules": f"""{_MEASURES_SQL}, bits AS (SELECT *, ({_BITS_SQL})::BIGINT AS failure_bits FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & {quality_rules.BASE.mask()}) <> 0 AS base_failed,
  (failure_bits & {quality_rules.STRICT.mask()}) = 0 AS kept, failure_bits
FROM bits""",
    "op2_jaccard_join": rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), g AS (
  SELECT DISTINCT r, hash(s) AS g
  FROM (SELECT r, CASE WHEN len(w) < 3 THEN w ELSE w[p:p+2] END AS s
        FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 1))) AS p FROM d WHERE len(w) > 0))
), n AS (
  SELECT r, count(*) AS n FROM g GROUP BY r
), links AS (
  SELECT a, b FROM (
    SELECT x.r AS a, y.r AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.r < y.r GROUP BY ALL
  ) JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * common >= 90 * (na.n + nb.n - common)
), reach AS (
  SELECT r, r AS c FROM d
  UNION
  SELECT e.b, reach.c FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON reach.r = e.a
), least_of AS (
  SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.c GROUP BY reach.r
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN least_of ON least_of.r = d.r""",
    "op3_decontamination": rf"""
WITH d AS (
  SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark
), b AS (
  SELECT item_id, len(w) AS size, least(len(w), 5) AS k, w FROM i WHERE len(w) > 0
), ig AS (
  SELECT item_id, size, k, array_to_string(w[p:p+k-1], ' ') AS g, count(*) AS n
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS p FROM b) GROUP BY ALL
), dg AS (
  SELECT doc_id, text, p, k, array_to_string(w[p:p+k-1], ' ') AS g
  FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM b))
), anchors AS (
  SELECT doc_id, text, p, dg.k, item_id, size, n, g FROM dg JOIN ig USING (k, g)
), starts AS (
  SELECT DISTINCT doc_id, text, item_id, size, k, p AS s FROM anchors
), common AS (
  SELECT doc_id, text, item_id, size, k, s, sum(least(n, times)) AS common
  FROM (SELECT x.doc_id, x.text, x.item_id, x.size, x.k, s, g, any_value(n) AS n, count(*) AS times
        FROM starts x JOIN anchors a ON a.doc_id IS NOT DISTINCT FROM x.doc_id AND a.text = x.text
          AND a.item_id IS NOT DISTINCT FROM x.item_id AND a.p BETWEEN s AND s + x.size - x.k
        GROUP BY ALL) GROUP BY ALL
), scored AS (
  SELECT c.doc_id, c.text, c.item_id, c.s - 1 AS start, c.size,
    common::DOUBLE / (2 * (c.size - c.k + 1) - greatest(0, s + c.size - 1 - len(w)) - common) AS similarity
  FROM common c JOIN d ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text
)
SELECT doc_id, item_id, start::INTEGER AS start, size::INTEGER AS size, similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY similarity DESC, start) AS n
      FROM scored WHERE similarity >= 0.8) WHERE n = 1""",
    "op8_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || text, '')), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s WINDOW w AS (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE UNBOUNDED PRECEDING)::DOUBLE AS upto,
    sum(size) OVER (PARTITION BY d.source, place)::DOUBLE AS tied
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN budget > 0 AND (upto <= budget
    OR (upto - tied <= budget AND upto - budget < budget - (upto - tied))) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM r""",
    "op10_substring_dedup": rf"""
WITH w AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), wins AS (
  SELECT r, i, hash(w[i:i+19]) AS h, md5(array_to_string(w[i:i+19], ' ')) AS m
  FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM w)
), later AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY h, m ORDER BY r, i) AS n FROM wins) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM later
), words AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w
), kept AS (
  SELECT words.r, count(*) AS n, string_agg(x, ' ' ORDER BY words.j) AS t
  FROM words ANTI JOIN gone ON words.r = gone.r AND words.j = gone.j GROUP BY words.r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.r = kept.r""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.r, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) AS n FROM s WHERE same) WHERE n <= 5
), m AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 5""",
    "op13_fill_in_middle": r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(w[1:least(a, b)], '') AS x, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS y,
    array_to_string(w[greatest(a, b) + 1:n], '') AS z
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
    ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
}
