"""The queries opN_<name> of this subpackage and, where there is one, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.llm import bpe, exact_spans, gnat, html_extract, kneser_ney, matroska, maxscore, near_dedup, packing, periodic, rules, token_counts, window_index
from packaudit.llm.common import keyed, real_id, saved, table, units
from packaudit.llm.vectors import integer_vectors


def vocabulary() -> str:
    """The vocabulary file; where the package with the files is elsewhere, pass another path to the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(sf_dir, spark, "documents")
    judged = kneser_ney.quality(documents, table(sf_dir, spark, "labels"))
    rows = keyed(documents.select("doc_id", "text")).select("_id", "_h")
    found = rows.join(judged.distinct(), ["_id", "_h"], "left")
    return found.select(real_id().alias("doc_id"), "lang", "n_bytes", "perplexity", "threshold", F.coalesce("kept", F.lit(False)).alias("kept"))


def op2_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = window_index.without_seen_windows(units(table(sf_dir, spark, "documents")))
    return kept.select(real_id().alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(units(table(sf_dir, spark, "documents")), near_dedup.Near(shingle=4))
    return found.select(
        real_id().alias("doc_id"),
        "n_shingles",
        real_id("component").alias("component_id"),
        (F.col("_id") == F.col("component")).alias("kept"),
    )


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(sf_dir, spark, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(sf_dir, spark, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(sf_dir, spark, "documents"), vocabulary())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = exact_spans.stripped(units(table(sf_dir, spark, "documents")))
    return kept.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(sf_dir, spark, "documents"), vocabulary())


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = matroska.media_columns(table(sf_dir, spark, "documents"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(sf_dir, spark, "documents"), vocabulary())


def op11_gnat(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    items = saved(integer_vectors(table(sf_dir, spark, "embeddings"), label=label), "vectors")
    return gnat.hard_negatives(items, items.where("id % 100 = 0"), positives=5, negatives=10, least=30, most=90)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_made_periodic(table(sf_dir, spark, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.floor(1000 * F.col("_longest.length") / -F.col("_longest.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _made_periodic(documents: DataFrame) -> DataFrame:
    """Some documents with their tails replaced by a part of them that comes again and again."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), periodic.SPACE), "")
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("_w")
    g = F.floor(h / 10)
    chosen = documents.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_a", g % F.greatest(n, F.lit(1))).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    made = F.array_join(F.transform(place, lambda i: F.get("_w", i)), " ")
    return chosen.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = saved(integer_vectors(table(sf_dir, spark, "embeddings")), "vectors")
    items = vectors.select("id", maxscore.dense_terms(F.col("vec")).alias("terms"))
    asked = vectors.where("id % 50 = 0").select("id", maxscore.dense_query(F.col("vec")).alias("terms"))
    return maxscore.top_k(items, asked, k=5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kneser_ney": op1_kneser_ney,
        "op2_window_dedup": op2_window_dedup,
        "op3_near_dedup": op3_near_dedup,
        "op4_rules": op4_rules,
        "op5_html": op5_html,
        "op6_bpe": op6_bpe,
        "op7_suffix_array": op7_suffix_array,
        "op8_token_counts": op8_token_counts,
        "op9_matroska": op9_matroska,
        "op10_packing": op10_packing,
        "op11_gnat": op11_gnat,
        "op12_periodic": op12_periodic,
        "op13_maxscore": op13_maxscore,
    }


_WORDS = r"""words AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, string_split_regex({text}, '[\x20\x09-\x0D]+') AS w FROM documents)) WHERE word <> '')"""

OP2 = (
    "WITH "
    + _WORDS.format(text="coalesce(text, '')")
    + """, windows AS (SELECT doc_id, j, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
    first AS (SELECT s, min(doc_id) AS f FROM windows WHERE n = 50 GROUP BY s),
    gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 50)) AS j FROM windows JOIN first USING (s) WHERE n = 50 AND f < doc_id),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS k FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n, 0) - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) USING (doc_id) LEFT JOIN kept USING (doc_id)"""
)

OP3 = (
    "WITH RECURSIVE "
    + _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """, windows AS (SELECT doc_id, j, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    shingles AS (SELECT DISTINCT doc_id, s FROM windows WHERE n = 4 OR j = 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
        JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, r FROM reach JOIN links ON doc_id = a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)"""
)


_VECTORS = """v AS (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {more})"""
_DOT = "CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT)"

OP11 = (
    "WITH "
    + _VECTORS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", more="AND label IS NOT NULL")
    + f""", pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_DOT} AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN pairs USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
)

OP13 = (
    "WITH "
    + _VECTORS.format(label="0", more="")
    + f"""SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
)


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are held against brute force, libraries and round trips in tests/llm."""
    return {"op2_window_dedup": OP2, "op3_near_dedup": OP3, "op11_gnat": OP11, "op13_maxscore": OP13}
