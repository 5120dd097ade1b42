"""The registered queries of these operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import bit_planes, digest_index, filters, language, licences, line_chunks, mixing, pieces, postorder_log, projection_passes, quality_trees, signature_trees, sketches, window_dedup

#: The place of the piece model: a function of the tokenizer files' folder.
MODEL = "piece_bpe_32k.model"


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> F.Column:
    """Rows no classifier learns from; a null key is not held out, as it has no remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def levels() -> tuple[mixing.Level, ...]:
    """The mixture: domains by the number of a source, then languages, then sources."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    lang = F.col("lang")
    return (
        mixing.Level("domain", F.when(number % 4 == 0, "books").otherwise("web"), F.when(F.col("domain") == "web", 3).otherwise(1)),
        mixing.Level("lang", lang, F.when(lang == "en", 4).when(lang.isin("de", "fr"), 2).otherwise(1)),
        mixing.Level("source", F.col("source"), F.lit(1)),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), levels(), share=(6, 10), epochs=4, seed=17)
    return rows.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "n_taken")


def op2_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(filters.whole_key(F.col("doc_id")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = sketches.with_next(rows, "k", {"own": sketches.sketch(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut))
    pairs = pairs.select("k", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("after"))
    pairs = pairs.select("k", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", sketches.sketch(F.col("edited")).alias("changed"), "after")
    return pairs.select(
        filters.shown_key(F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        sketches.shown(F.col("own")).alias("fingerprint"),
        sketches.shown(F.col("changed")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        sketches.resemblance(F.col("own"), F.col("after")).alias("near_next"),
    )


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_chunks.remove_repeats(table(spark, sf_dir, "documents"), spaced=True)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return rows.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"), kept.alias("kept_sha256"))


def op5_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signature_trees.link_documents(table(spark, sf_dir, "documents"), width=4, percent=85)
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op7_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("intervals", F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["begin"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_trees.Trees:
    known = table(spark, sf_dir, "labels").where(~held_out())
    return quality_trees.fit(table(spark, sf_dir, "documents"), known)


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_trees.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), model_file())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_postorder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return postorder_log.manifest(
        table(spark, sf_dir, "documents"),
        ["doc_id", "source", "lang", "n_chars", "text"],
        tampered={"text": F.translate("text", upper, upper.lower())},
        when=number % 3 == 0,
    )


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicate(table(spark, sf_dir, "documents"))


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bit_planes.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_sketches, op3_licence_scan, op4_line_chunks, op5_projection_passes, op6_signature_trees, op7_window_dedup, op8_quality_trees, op9_piece_codec, op10_language_id, op11_postorder_log, op12_digest_index, op13_bit_planes)
}
SQL: dict[str, str] = {
    "op1_mixing": r"""
WITH docs AS (
  SELECT doc_id, lang, source,
         CASE WHEN TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INT) % 4 = 0 THEN 'books' ELSE 'web' END AS domain,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n)::BIGINT AS supply FROM docs GROUP BY ALL HAVING sum(n) > 0
), top AS (
  SELECT domain, 4 * sum(supply) AS cap, CASE WHEN domain = 'web' THEN 3 ELSE 1 END AS w,
         (SELECT sum(supply) FROM leaves) * 6 // 10 AS budget
  FROM leaves GROUP BY domain
), top_share AS (
  SELECT *, max(s) OVER () AS share FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER before, 0))::DOUBLE
              / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS s FROM top
    WINDOW before AS (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), mid AS (
  SELECT l.domain, l.lang, 4 * sum(l.supply) AS cap,
         CASE WHEN l.lang = 'en' THEN 4 WHEN l.lang IN ('de', 'fr') THEN 2 ELSE 1 END AS w,
         any_value(least(t.cap, floor(t.share * t.w)::BIGINT)) AS budget
  FROM leaves l JOIN top_share t ON l.domain = t.domain GROUP BY l.domain, l.lang
), mid_share AS (
  SELECT *, max(s) OVER (PARTITION BY domain) AS share FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER before, 0))::DOUBLE
              / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER before, 0))::DOUBLE AS s FROM mid
    WINDOW before AS (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), low AS (
  SELECT l.*, 4 * l.supply AS cap, 1 AS w, least(m.cap, floor(m.share * m.w)::BIGINT) AS budget
  FROM leaves l JOIN mid_share m ON l.domain = m.domain AND l.lang IS NOT DISTINCT FROM m.lang
), low_share AS (
  SELECT *, max(s) OVER (PARTITION BY domain, lang) AS share FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER before, 0))::DOUBLE
              / (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER before, 0))::DOUBLE AS s FROM low
    WINDOW before AS (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), plan AS (
  SELECT domain, lang, source, supply, least(cap, floor(share * w)::BIGINT)::BIGINT AS granted FROM low_share
), chosen AS (
  SELECT d.*, p.granted // p.supply AS whole, p.granted % p.supply AS rest,
         sum(d.n) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5(concat_ws('|', '17', p.granted // p.supply, d.doc_id))
                        ROWS UNBOUNDED PRECEDING) - d.n AS before
  FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n AS n_tokens,
       (CASE WHEN epoch < whole THEN n ELSE least(n, rest - before) END)::BIGINT AS n_taken
FROM chosen, unnest(range(0, whole + 1)) AS e(epoch)
WHERE epoch < whole OR before < rest
""",
    "op4_line_chunks": """
WITH lines AS (
  SELECT doc_id, i, line, count(*) OVER (PARTITION BY doc_id) AS n_lines,
         ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)
), marked AS (
  SELECT *, i >= 2 AND (lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % 2 = 0 AS meets FROM lines
), spaced AS (
  SELECT *, meets AND NOT coalesce(lag(meets) OVER (PARTITION BY doc_id ORDER BY i), false) AND i < n_lines - 1 AS ends FROM marked
), numbered AS (
  SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx
  FROM spaced
), parts AS (
  SELECT doc_id, idx, n_lines, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, idx, n_lines
), ranked AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, idx) > 1 AS gone FROM parts
), kept AS (
  SELECT doc_id, any_value(n_lines) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed,
         coalesce(string_agg(body, chr(10) ORDER BY idx) FILTER (NOT gone), '') AS body
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op11_postorder_log": """
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf,
         CASE WHEN (4294967295 - list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                  lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE z END)))) % 3 = 0
              THEN sha256(head || coalesce(strlen(lower_az) || ':' || lower_az, '-')) END AS other
  FROM (
    SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf FROM (
      SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az,
             coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
      FROM documents))
), up AS (
  SELECT lang, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY lang) AS width FROM rows
  UNION ALL
  SELECT lang, level + 1, i // 8, string_agg(digest, '' ORDER BY i).sha256(), any_value((width + 7) // 8)
  FROM up WHERE width > 1 GROUP BY lang, level, i // 8
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up WHERE width = 1
), over_all AS (
  SELECT 0 AS level, i, digest, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), any_value((width + 7) // 8)
  FROM over_all WHERE width > 1 GROUP BY level, i // 8
), heights AS (
  SELECT lang, max(level) AS height FROM up GROUP BY lang
), around AS (
  SELECT a.lang, a.level AS step, a.i,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM up a JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.i // 8 = b.i // 8
  WHERE a.width > 1 GROUP BY a.lang, a.level, a.i
), around_all AS (
  SELECT a.level, a.i,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM over_all a JOIN over_all b ON a.level = b.level AND a.i // 8 = b.i // 8
  WHERE a.width > 1 GROUP BY a.level, a.i
), ways AS (
  SELECT r.doc_id, r.lang, r.i, r.leaf, r.other, w.step, w.before, w.after
  FROM rows r JOIN heights h ON r.lang IS NOT DISTINCT FROM h.lang, unnest(range(0, h.height)) AS s(step)
  JOIN around w ON w.lang IS NOT DISTINCT FROM r.lang AND w.step = s.step AND w.i = r.i // (8 ** s.step)::BIGINT
  UNION ALL
  SELECT r.doc_id, r.lang, r.i, r.leaf, r.other, h.height + w.level, w.before, w.after
  FROM rows r JOIN heights h ON r.lang IS NOT DISTINCT FROM h.lang JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
  JOIN around_all w ON w.i = s.i // (8 ** w.level)::BIGINT
), folds AS (
  SELECT lang, i, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256,
         list_reduce([{'before': '', 'after': coalesce(any_value(other), any_value(leaf))}] || list({'before': before, 'after': after} ORDER BY step),
           lambda x, w: {'before': '', 'after': sha256(w.before || x.after || w.after)}).after AS folded_root
  FROM ways GROUP BY lang, i
), root AS (SELECT digest FROM over_all WHERE width = 1)
SELECT r.doc_id, r.leaf, s.digest AS subroot, root.digest AS root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256,
       coalesce(f.folded_root, r.other, r.leaf) AS folded_root, coalesce(f.folded_root, r.other, r.leaf) = root.digest AS verified
FROM rows r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang LEFT JOIN folds f ON f.lang IS NOT DISTINCT FROM r.lang AND f.i = r.i, root
""",
    "op12_digest_index": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op13_bit_planes": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER best)::INTEGER AS rank, n.vec_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY rank <= 10
""",
}
