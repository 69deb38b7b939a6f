"""One query per operator over the given tables, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.llm import bags, chat, lines, merkle, packing, pages, pieces, quality, sharding, simhash, suffixes, topk, vectors


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation is written as a transcript and read again by a model
    counted on four fifths of them."""
    parts = stored(chat.with_transcripts(
        chat.conversations_as_parts(table(spark, sf, "conversations"))), "transcripts")
    model = chat.fit(parts.filter(~chat.held_out(F.col("conv_id"))))
    found = chat.format_transcripts(parts, model)
    return found.select(
        "conv_id", "part", chat.held_out(F.col("conv_id")).alias("held_out"), F.size("roles").alias("n_turns"),
        F.array_join("roles", " ").alias("roles"),
        (F.col("roles") == F.transform("turns", lambda t: t["role"])).alias("roles_agree"),
        (F.col("formatted") == chat.canonical(F.col("turns"))).alias("texts_agree"), "formatted")


def op4_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(table(spark, sf, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = sharding.shuffle_into_shards(table(spark, sf, "documents"))
    return docs.select(
        "doc_id", sharding.record_size(F.col("text")).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    clean = lines.remove_spread_lines(table(spark, sf, "documents"), removed="removed_lines")
    return clean.select(
        "doc_id", F.col("removed_lines").cast("long"), F.char_length("text").cast("long").alias("kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf, "documents"))


def op10_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_products(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf, "documents"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return bags.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of the true leaves, checked with those leaves and, for one id in seven,
    with the leaf of a row whose n_chars was raised by one."""
    raised = F.col("n_chars").cast("decimal(20,0)") + 1
    forged = merkle.leaf([raised if c == "n_chars" else F.col(c) for c in merkle.COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(table(spark, sf, "documents"), extra=F.when(chosen, forged))
    folded = merkle.folded(F.coalesce("extra", "leaf"), F.col("proof"), F.col("steps"))
    return found.withColumn("folded_root", folded).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_simhash, op3_chat_format, op4_page_text, op5_embedding_dedup, op6_sharding, op7_quality,
    op8_line_dedup, op9_sentencepiece, op10_top_k, op11_suffix_dedup,
    op12_ranked_search, op13_merkle_manifest)}

SQL = {
    "op8_line_dedup": """
WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS site, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS own
  FROM documents),
once AS (SELECT text, min(site) AS site, any_value(own) AS own FROM cut GROUP BY text),
each AS (
  SELECT text, site, unnest(list_distinct(list_filter(
    list_transform(own, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM once),
wide AS (SELECT line FROM each GROUP BY line HAVING count(DISTINCT site) >= 10),
copies AS (
  SELECT text FROM each GROUP BY text
  HAVING sum(CASE WHEN line IN (SELECT line FROM wide) THEN length(line) ELSE 0 END) >= 0.5 * sum(length(line))
    AND count(*) FILTER (line IN (SELECT line FROM wide)) >= 0.5 * count(*)),
bad AS (
  SELECT list(line) AS bad FROM (
    SELECT line FROM each WHERE line IN (SELECT line FROM wide) AND text NOT IN (SELECT text FROM copies)
    GROUP BY line HAVING count(DISTINCT site) >= 10)),
kept AS (
  SELECT doc_id, text, own,
         list_filter(own, lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13)))) AS k
  FROM cut, bad)
SELECT doc_id, CAST(len(own) - len(k) AS BIGINT) AS removed_lines,
       CAST(length(array_to_string(k, chr(10))) AS BIGINT) AS kept_chars,
       md5(array_to_string(k, chr(10))) AS text_md5
FROM kept""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.a AS vec_id, coalesce(n, 0) AS n_links, component_id, r.a = component_id AS kept
FROM root r LEFT JOIN degree d ON d.a = r.a""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op12_ranked_search": r"""
WITH item AS (
  SELECT item_id, item, unnest(own) AS term
  FROM (SELECT item_id, row_number() OVER () AS item,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS own
        FROM benchmark)),
cut AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS own
  FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(own)) AS BIGINT) AS n_terms FROM cut WHERE len(own) > 0),
held AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(own) AS n, unnest(own) AS term FROM cut)
  WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
worth AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS worth
  FROM held JOIN weight USING (term), total),
scored AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, CAST(sum(worth) AS BIGINT) AS score
  FROM item JOIN worth USING (term) GROUP BY item, row),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_merkle_manifest": """
WITH RECURSIVE told AS (
  SELECT doc_id, lang, source, text, n_chars,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)) AS crc
  FROM documents),
named AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') ||
            coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body, xor(crc, 4294967295) % 7 = 0 AS chosen
  FROM told),
leaves AS (
  SELECT row_number() OVER () AS row, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS tree, leaf, start
  FROM (SELECT doc_id, lang,
               sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
               sha256(head || coalesce(strlen(CAST(n_chars + CAST(chosen AS INT) AS VARCHAR)) || ':' ||
                                       (n_chars + CAST(chosen AS INT)), '-') || body) AS start
        FROM named)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
  SELECT tree, 0 AS level, pos, leaf AS node FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM low) WHERE c > 1 GROUP BY tree, level, pos // 2),
tops AS (SELECT tree, max(level) AS height, arg_max(node, level) AS subroot FROM low GROUP BY tree),
ordered AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS place FROM tops),
high AS (
  SELECT 0 AS level, place AS pos, subroot AS node FROM ordered
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS c FROM high) WHERE c > 1 GROUP BY level, pos // 2),
apex AS (SELECT max(level) AS heights, arg_max(node, level) AS root FROM high),
walk AS (
  SELECT row, tree, place, pos, 0 AS level, start AS node, '' AS proof FROM placed JOIN ordered USING (tree)
  UNION ALL
  SELECT w.row, w.tree, w.place, w.pos // 2, w.level + 1,
         sha256(CASE WHEN s.node IS NULL THEN w.node WHEN w.pos % 2 = 0 THEN w.node || s.node ELSE s.node || w.node END),
         w.proof || coalesce(s.node, '')
  FROM walk w JOIN ordered o ON o.tree = w.tree
  LEFT JOIN low s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.level < o.height),
climb AS (
  SELECT row, place AS pos, 0 AS level, node, proof FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY level DESC) AS last FROM walk) WHERE last = 1
  UNION ALL
  SELECT c.row, c.pos // 2, c.level + 1,
         sha256(CASE WHEN s.node IS NULL THEN c.node WHEN c.pos % 2 = 0 THEN c.node || s.node ELSE s.node || c.node END),
         c.proof || coalesce(s.node, '')
  FROM climb c JOIN apex ON c.level < heights LEFT JOIN high s ON s.level = c.level AND s.pos = xor(c.pos, 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM climb JOIN apex ON level = heights JOIN placed USING (row) JOIN tops USING (tree)""",
}
