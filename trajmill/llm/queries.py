"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trajmill.llm import bestfit, decontaminate, divergence, exact, licenses, linededup, packing, secrets, sharding, simhash, suffix_lm, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary; it is installed with Python on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "class")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan_licenses(docs, licenses.train(docs))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))

    def places(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    counts = [of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(places(base), 256).alias("base_sha256"), places(F.col("spans")).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_spread_lines(documents(spark, sf_dir))
    return cleaned.select("row.doc_id", "n_lines", "n_removed", "text")


OP4_SQL = f"""
WITH line AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), long AS (
  SELECT doc_id, site, trim(line) AS line, pos FROM line WHERE len(regexp_split_to_array(trim(line), '\\s+')) >= {linededup.LEAST_WORDS}
), spread AS (
  SELECT line, min(doc_id) AS first_id FROM long GROUP BY line HAVING count(DISTINCT site) >= {linededup.SITES}
), hit AS (
  SELECT doc_id, pos, doc_id = first_id AND pos = min(pos) OVER (PARTITION BY doc_id, line) AS stays FROM long JOIN spread USING (line)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE stays = false) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays IS DISTINCT FROM false), '') AS text
  FROM line LEFT JOIN hit USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = toxicity.learn(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(toxicity.fold_number("doc_id", 3) == 1, F.lit(False))
    scores = toxicity.score_documents(docs, lexicon)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(toxicity.fold_number("doc_id", 7) == 2, F.lit(False))
    model = suffix_lm.train(docs.filter(~held_out))
    scores = suffix_lm.score(docs, model)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "tree_score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(documents(spark, sf_dir), 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(documents(spark, sf_dir), benchmark)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard_documents(documents(spark, sf_dir), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"ids_crc32": F.crc32("ids")}
    pieces = bestfit.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), payload=digest)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir))


OP12_SQL = rf"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), word AS (
  SELECT d, lang, source, unnest(terms) AS term FROM doc
), kept AS (
  SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT d) >= {divergence.LEAST_DOCUMENTS}
), grp AS (
  SELECT DISTINCT lang, source FROM doc
), used AS (
  SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT lang, source, term, coalesce(used.n, 0) AS n, kept.n AS lang_n FROM grp JOIN kept USING (lang) LEFT JOIN used USING (lang, source, term)
), priced AS (
  SELECT lang, source, term, n,
         CAST(1 + ({divergence.UNIT} * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS BIGINT) AS p,
         CAST(1 + ({divergence.UNIT} * (lang_n + 1)) // (sum(lang_n) OVER g + count(*) OVER g) AS BIGINT) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), item AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM priced WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM item
QUALIFY part = 'pair' OR rank <= {divergence.RANKS}
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_licenses, op3_secrets, op4_line_dedup, op5_toxicity, op6_suffix_lm, op7_exact_dedup, op8_simhash, op9_decontamination, op10_sharding, op11_best_fit_packing, op12_source_divergence, op13_whitening)}
ORACLES: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op12_source_divergence": OP12_SQL}
