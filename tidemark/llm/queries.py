"""One query for each operator, over its whole table, and oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS p, words FROM w WHERE len(words) >= 13
), h AS (
  SELECT doc_id, p, array_to_string(list_slice(words, p, p + 12), ' ') AS gram FROM g
), hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS first FROM h) WHERE first < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS places FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM hit) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


@query(OP5_SQL)
def op5_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.block_anchors import without_repeats

    kept = without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[]
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


@query(OP10_SQL)
def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.prefix_join import linked_documents

    return linked_documents(documents(spark, sf_dir))


@query()
def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.window_packing import packed_pieces

    pieces = packed_pieces(documents(spark, sf_dir))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query()
def op3_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_spans import section_tokens

    return section_tokens(documents(spark, sf_dir))


@query()
def op2_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vector_shards import sharded

    return sharded(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


@query()
def op1_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.labelled import held_out
    from tidemark.llm.quality_ftrl import scored, train

    docs = documents(spark, sf_dir)
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query()
def op9_toxic_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.labelled import held_out
    from tidemark.llm.toxic_gru import scored, train

    docs = documents(spark, sf_dir)
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query()
def op4_raking_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.raking import mixed

    return mixed(documents(spark, sf_dir))


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import simhash as S

    prints = S.edited_fingerprints(documents(spark, sf_dir))
    own = prints.groupBy(F.col("doc_id").alias("next_id")).agg(F.first("f1").alias("n1"), F.first("f2").alias("n2"))
    asked = prints.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q"), "f1", "f2")
    within = S.within_radius(asked, prints.select("f1", "f2")).withColumnRenamed("q", "doc_id")
    return prints.join(own, "next_id", "left").join(within, "doc_id", "left").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        S.text_of("f1", "f2").alias("fingerprint"), S.text_of("e1", "e2").alias("edited_fingerprint"),
        S.likeness(S.differing(("f1", "f2"), ("e1", "e2"))).alias("near_edited"),
        S.likeness(S.differing(("f1", "f2"), ("n1", "n2"))).alias("near_next"),
        (F.col("n_within") - 1).alias("n_within"),
    )


@query()
def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence_rules import judged

    return judged(documents(spark, sf_dir))


#: The text up to the end of the first k lines.
OP12_UP_TO = "CASE WHEN {k} >= n THEN t WHEN {k} = 0 THEN '' ELSE array_to_string(lines[1:{k}], chr(10)) || chr(10) END"
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), u AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS lines,
    CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END END AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, n, t, form, {OP12_UP_TO.format(k="i")} AS a, {OP12_UP_TO.format(k="j")} AS b FROM c
), o AS (
  SELECT doc_id, n, t, form, a, substr(b, length(a) + 1) AS m, substr(t, length(b) + 1) AS s FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""


@query(OP12_SQL)
def op12_fim_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fim_cuts import fill_in_middle, restored

    out = fill_in_middle(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query()
def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.word_runs import periodic_runs, strongest

    out = periodic_runs(documents(spark, sf_dir), plant=True)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", strongest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op11_merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.merge_pieces import encoded_texts

    out = encoded_texts(documents(spark, sf_dir))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
