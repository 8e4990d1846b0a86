"""The registered ``opN_<name>`` queries and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, cnn_toxicity, flat_graph, license_tfidf, mixing, pii_surrogates, popcount_simhash, recompression, segment_bpe, turn_repair, url_markov, warc_chunks, winnowing
from .common import SPACE, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("op2_source_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source
), w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         row_number() OVER (ORDER BY cap / w, rk) AS nth
  FROM w
), l AS (
  SELECT arg_min((budget - capped) / free, nth) FILTER (WHERE w * ((budget - capped) / free) <= cap) AS level FROM r
), t AS (
  SELECT source, rk, source_size::BIGINT AS source_size, coalesce(least(cap, w * level), cap)::DOUBLE AS target FROM w, l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0
             THEN budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - ahead))
             ELSE 0 END)::BIGINT AS taken
FROM p
""")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


@register("op7_block_naming", r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op7_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(table(spark, sf_dir, "documents"))


@register("op8_popcount_simhash")
def op8_popcount_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popcount_simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@register("op9_cnn_toxicity")
def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cnn_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_bpe(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return segment_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=with_ids)


@register("op10_segment_bpe")
def op10_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


@register("op1_warc_chunks", """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d JOIN f USING (h)
""")
def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.revisit_table(table(spark, sf_dir, "pages"), min_bytes=0).drop("target_uri")


#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _url_sql(order: int = 4) -> str:
    levels = []
    for k in range(order + 1):
        prior = f"p{k - 1}.qa" if k else "1.0 / 256"
        prior_b = f"p{k - 1}.qb" if k else "1.0 / 256"
        join = f"JOIN p{k - 1} ON p{k - 1}.s = right(l.s, {k})" if k else ""
        levels.append(f"""c{k} AS (SELECT right(gram, {k + 1}) AS s, left(right(gram, {k + 1}), {k}) AS ctx, sum(a) AS a, sum(b) AS b FROM counts GROUP BY ALL),
p{k} AS (
  SELECT l.s, CASE WHEN n.na > 0 THEN (l.a + n.ta * {prior}) / (n.na + n.ta) ELSE {prior} END::DOUBLE AS qa,
              CASE WHEN n.nb > 0 THEN (l.b + n.tb * {prior_b}) / (n.nb + n.tb) ELSE {prior_b} END::DOUBLE AS qb
  FROM c{k} l JOIN (SELECT ctx, sum(a) AS na, sum(b) AS nb, sum((a > 0)::INT) AS ta, sum((b > 0)::INT) AS tb FROM c{k} GROUP BY ctx) n USING (ctx) {join}
)""")
    return rf"""
WITH parts AS (
  SELECT DISTINCT coalesce(url, '') AS url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, substr(md5(url), 1, 1) IN ('0', '1', '2') AS held
  FROM parts
), r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
), ruled AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r
), grams AS (
  SELECT url, ruled, held, substr(repeat(chr(2), {order}) || url || chr(3), i, {order + 1}) AS gram
  FROM (SELECT *, unnest(generate_series(1, length(url) + 1)) AS i FROM ruled)
), counts AS (
  SELECT gram, sum((NOT held AND ruled IS NOT DISTINCT FROM 'allow')::INT)::BIGINT AS a, sum((NOT held AND ruled IS NOT DISTINCT FROM 'block')::INT)::BIGINT AS b FROM grams GROUP BY gram
), {", ".join(levels)}, scores AS (
  SELECT url, avg(ln(qa) - ln(qb)) AS score FROM grams JOIN p{order} ON s = gram GROUP BY url
), bins AS (
  SELECT floor(score / 0.01) AS bin, sum((ruled = 'allow')::INT) AS a, sum((ruled = 'block')::INT) AS b
  FROM ruled JOIN scores USING (url) WHERE held AND ruled IS NOT NULL GROUP BY ALL
), tried AS (
  SELECT bin, sum(a) OVER () AS good, sum(b) OVER () AS bad,
         sum(a) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
         coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under
  FROM bins
), cut AS (
  SELECT coalesce((SELECT bin * 0.01 FROM tried WHERE good > 0 AND bad > 0 ORDER BY above / good + under / bad DESC, bin LIMIT 1), 0) AS cut
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM pages JOIN ruled ON ruled.url = coalesce(pages.url, '') JOIN scores ON scores.url = ruled.url, cut
"""


@register("op3_url_markov", _url_sql())
def op3_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(table(spark, sf_dir, "pages"), URL_RULES, order=4).drop("score")


@register("op4_flat_graph", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_sum([abs(x) for x in embedding]) > 0
    AND len([1 for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.u = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id
""")
def op4_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings")).drop("audited_recall")


@register("op5_pii_surrogates")
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pseudonymise(table(spark, sf_dir, "documents"), key=b"ratewise-surrogates")


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source/thousands/fifties/doc_id.txt; the first of each directory is its licence file."""
    i = F.coalesce(F.col("doc_id"), F.lit(-1))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 1000).cast("string"), F.floor(i / 50).cast("string"))
    path = F.when(i % 50 == 0, F.concat(folder, F.lit("/LICENSE"))).otherwise(F.concat(folder, F.lit("/"), i.cast("string"), F.lit(".txt")))
    path = F.when(i % 1000 == 1, F.concat(F.regexp_extract(folder, "^(.*)/[^/]*$", 1), F.lit("/LICENSE"))).otherwise(path)
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")


@register("op6_license_tfidf")
def op6_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_tfidf.scan(as_files(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@register("op13_winnowing", r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (SELECT rid, s, dw.n, id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hit_words AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(generate_series(s, s + n - 1)) FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
""")
def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, gram=5)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents with words of every tenth (by the hash h of its id) made periodic from word a on; others as they are."""
    h = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    h = h.withColumn("_g", F.floor(F.col("_h") / 10))
    h = h.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")))
    h = h.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    h = h.withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    from_ = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    words = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", from_(i).cast("int")))
    return h.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@register("op11_recompression")
def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    start, length, period = -F.col("_top.back"), F.col("_top.length"), -F.col("_top.small")
    return found.withColumn("_top", F.array_max(ranked)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a hash of conv_id and turn: rows dropped, emptied, cut, repeated or given to the user."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("_d", F.crc32(name.cast("binary")) % 20).where("_d <> 0")
    d = F.col("_d")
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_d")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_d") == 3, 2).otherwise(1)))).drop("_d", "_copy")


@register("op12_turn_repair")
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    marked, turns = turn_repair.repair(damaged(conversations))
    told, digest = turn_repair.reports(marked), turn_repair.digests(marked, turns)
    out = conversations.select("conv_id").distinct()
    for part in (told, digest):
        part = part.withColumnRenamed("conv_id", "_c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
