r"""The queries of this subpackage, and SQL for those that SQL can express.

Each runs its operator with production parameters over a whole table and derives columns
from the operator's output. The SQL is DuckDB's and computes the same rows by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm._text import crc32_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_fold() -> Column:
    return crc32_mod(F.col("doc_id"), 3) == 1


def quality_fold() -> Column:
    return crc32_mod(F.col("doc_id"), 4) == 2


def model_fold() -> Column:
    return crc32_mod(F.col("doc_id"), 10) == 0


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_preference_pairs(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    from tremolo.llm.preference import preference_pairs, swapped_answers, trained_chars

    p = preference_pairs(*swapped_answers(_table(spark, sf_dir, "conversations"), every))
    sides = [x for s in ("chosen", "rejected") for x in (F.length(s).cast("long").alias(f"{s}_chars"), F.md5(F.col(s).cast("binary")).alias(f"{s}_md5"), trained_chars(F.col(f"{s}_mask")).alias(f"{s}_trained"))]
    return p.select("pair_id", "n_prompt", F.length("prompt").cast("long").alias("prompt_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), *sides)


def op2_every_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_preference_pairs(spark, sf_dir, every=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm._sample import labelled
    from tremolo.llm.quality_rules import PER_LABEL, apply_rules, learn

    docs = _table(spark, sf_dir, "documents")
    return apply_rules(docs, learn(labelled(docs, _table(spark, sf_dir, "labels"), "quality", PER_LABEL)))


def op4_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.impact_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.sampled_pieces import sample_encodings

    e = sample_encodings(_table(spark, sf_dir, "documents"), k=2)
    return e.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "log_inclusion", "round_trip")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("shards", F.lit(0)).alias("first_shard"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.language_id import identify, learn

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language_fold())
    return identify(docs, learn(docs.where(~F.col("held_out"))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).drop("url", "error")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm._sample import labelled
    from tremolo.llm.quality_nbsvm import PER_LABEL, fit, score

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", quality_fold())
    rows = labelled(docs, _table(spark, sf_dir, "labels"), "quality", PER_LABEL, where=~quality_fold())
    return score(docs, fit([r[1:] for r in rows]))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.collocations import mine

    return mine(_table(spark, sf_dir, "documents"), max_n=4, least=30, scale=2_000_000, share=(80, 100), top=2000)


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremolo.llm.context_mixing import learn, score

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", model_fold())
    return score(docs, learn(docs.where(~F.col("held_out"))))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_preference_pairs": op2_preference_pairs,
    "op2_every_answer": op2_every_answer,
    "op3_quality_rules": op3_quality_rules,
    "op4_impact_search": op4_impact_search,
    "op5_sampled_pieces": op5_sampled_pieces,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_license_scan": op9_license_scan,
    "op10_quality_nbsvm": op10_quality_nbsvm,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_context_mixing": op13_context_mixing,
}

_OP2_SQL = """
WITH t AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), a AS (
  SELECT pair_id, max({'turn': turn, 'text': text}) AS a FROM t WHERE role = 'assistant' GROUP BY pair_id
), p AS (
  SELECT a.pair_id, a.a.turn AS last, a.a.text AS answer, o.a.text AS other
  FROM a JOIN a AS o ON o.pair_id = xor(a.pair_id, 1::BIGINT)
), c AS (
  SELECT t.pair_id, turn, role, text, CASE WHEN turn = last THEN other ELSE text END AS alt
  FROM t JOIN p USING (pair_id)
  WHERE turn < last OR (turn = last AND role = 'assistant' AND text = answer)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS i FROM c
), r AS (
  SELECT pair_id, i, text = alt AS same, role = 'assistant' AS train,
    '<|' || replace(role, '|', '/') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS x,
    '<|' || replace(role, '|', '/') || '|>' || chr(10) || replace(alt, '<|', '< |') || '<|end|>' || chr(10) AS y
  FROM n
), k AS (
  SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS n_prompt FROM r GROUP BY pair_id
), s AS (
  SELECT pair_id, any_value(n_prompt) AS n_prompt,
    coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i <= n_prompt), '') AS prompt,
    coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i > n_prompt), '') AS chosen,
    coalesce(string_agg(y, '' ORDER BY i) FILTER (WHERE i > n_prompt), '') AS rejected,
    coalesce(sum(length(x)) FILTER (WHERE i > n_prompt AND train), 0)::BIGINT AS chosen_trained,
    coalesce(sum(length(y)) FILTER (WHERE i > n_prompt AND train), 0)::BIGINT AS rejected_trained
  FROM r JOIN k USING (pair_id) GROUP BY pair_id
)
SELECT pair_id, n_prompt::BIGINT AS n_prompt, length(prompt)::BIGINT AS prompt_chars, md5(prompt) AS prompt_md5,
  length(chosen)::BIGINT AS chosen_chars, md5(chosen) AS chosen_md5, chosen_trained,
  length(rejected)::BIGINT AS rejected_chars, md5(rejected) AS rejected_md5, rejected_trained
FROM s
"""

# Neighbours may be missing; then the rejected side is, and nothing is common.
_OP2_EVERY_SQL = (
    _OP2_SQL.replace("FROM a JOIN a AS o", "FROM a LEFT JOIN a AS o")
    .replace("CASE WHEN turn = last THEN other", "CASE WHEN other IS NULL THEN NULL WHEN turn = last THEN other")
    .replace("(WHERE NOT same)", "(WHERE same IS NOT TRUE)")
)

_OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to
FROM b
"""


def _mix_sql(blocks: int = 128, shards: int = 8) -> str:
    draw = lambda *parts: "md5(concat_ws('|', 'mix-1', " + ", ".join(f"coalesce(({p})::VARCHAR, chr(0))" for p in parts) + "))"
    tree, size, name = [], 1, "t0"
    while size < shards:
        new = f"t{len(tree) + 1}"
        tree.append(f"""{new} AS (
  SELECT 2 * node + CASE WHEN rank <= half THEN 0 ELSE 1 END AS node, source, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY {draw("'tree'", "node", "source", "slot")}, slot) AS rank,
      (count(*) OVER (PARTITION BY node)) // 2 AS half
    FROM (SELECT node, source, unnest(range(1, quota::BIGINT + 1)) AS slot FROM {name})
  ) GROUP BY ALL
)""")
        name, size = new, size * 2
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr({draw("'block'", "doc_id")}, 1, 8))::UBIGINT % {blocks})::INTEGER AS block,
    {draw("'split'", "doc_id")} AS k
  FROM documents
), bs AS (
  SELECT source, block, sum(size)::BIGINT AS block_size FROM d GROUP BY ALL
), s0 AS (
  SELECT source, sum(block_size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM bs GROUP BY source
), s1 AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3e0 * source_size / ((place - 1) % 3 + 1) AS stops_at FROM s0
), s2 AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3e0 * source_size) OVER (ORDER BY stops_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / (sum(weight) OVER (ORDER BY stops_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s1
), s3 AS (
  SELECT *, coalesce((SELECT arg_min(level, {{'a': stops_at, 'b': place}}) FROM s2 WHERE level <= stops_at), 0e0) AS share FROM s2
), s AS (
  SELECT source, source_size, least(3e0 * source_size, share * weight) AS target FROM s3
), b0 AS (
  SELECT bs.source, block, block_size, source_size, target,
    row_number() OVER (PARTITION BY bs.source ORDER BY {draw("bs.source", "block")}, block) - 1 AS place,
    (sum(block_size) OVER (PARTITION BY bs.source ORDER BY {draw("bs.source", "block")}, block))::BIGINT AS upto,
    count(*) OVER (PARTITION BY bs.source) AS n_blocks,
    CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes
  FROM bs JOIN s ON bs.source IS NOT DISTINCT FROM s.source
), b1 AS (
  SELECT *, target - passes * source_size - (upto - block_size) AS want FROM b0
), b AS (
  SELECT *, CASE WHEN want <= 0 THEN 0 WHEN want >= block_size THEN 2 ELSE 1 END AS extra,
    passes + CASE WHEN want > 0 THEN 1 ELSE 0 END AS slots FROM b1
), x0 AS (
  SELECT d.source, d.block, want, k, sum(size) AS size FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block WHERE extra = 1 GROUP BY ALL
), x AS (
  SELECT source, block, max(k) AS last_key FROM (
    SELECT *, sum(size) OVER (PARTITION BY source, block ORDER BY k) AS upto FROM x0
  ) WHERE upto - size / 2e0 <= want GROUP BY ALL
), t0 AS (
  SELECT 1 AS node, source, sum(slots)::BIGINT AS quota FROM b GROUP BY source
), {", ".join(tree)}, leaf AS (
  SELECT source, node - {shards} AS shard, quota, sum(quota) OVER (PARTITION BY source ORDER BY node) AS upto FROM {name}
), first_slot AS (
  SELECT b.source, block, shard FROM b JOIN leaf ON b.source IS NOT DISTINCT FROM leaf.source AND place >= leaf.upto - leaf.quota AND place < leaf.upto WHERE slots > 0
), r AS (
  SELECT doc_id, size, source_size, target, shard,
    passes + CASE WHEN extra = 2 OR (extra = 1 AND k <= last_key) THEN 1 ELSE 0 END AS copies
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block
  LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.block = x.block
  LEFT JOIN first_slot AS f ON d.source IS NOT DISTINCT FROM f.source AND d.block = f.block
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::INTEGER AS copies,
  CASE WHEN copies > 0 THEN shard END::INTEGER AS first_shard
FROM r
"""


_OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END)::INTEGER AS failed
  FROM d
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT array_to_string(fs, '') AS filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS applied
  FROM o, (SELECT unnest(range(1, 6)) AS k)
), r AS (
  SELECT part, filter_order, step, bit,
    count(*) FILTER (WHERE failed & (applied | bit) = 0) AS kept,
    count(*) FILTER (WHERE failed & applied = 0 AND failed & bit > 0) AS removed,
    count(*) FILTER (WHERE failed & applied > 0 AND failed & bit > 0) AS redundant,
    count(*) FILTER (WHERE failed = bit) AS unique_fails,
    count(*) FILTER (WHERE failed & applied = 0 AND failed & bit > 0 AND good) AS good_lost,
    count(*) FILTER (WHERE failed & applied = 0 AND failed & bit > 0 AND toxic) AS toxic_lost
  FROM b LEFT JOIN l USING (doc_id), s GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

_OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t
), o AS (
  SELECT lang, p, unnest(w) AS w, unnest(range(len(w))) AS i FROM p
), w AS (
  SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM o WINDOW x AS (PARTITION BY p ORDER BY i)
), g AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM w UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2) FROM w WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM w WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM w WHERE w4 IS NOT NULL
), f AS MATERIALIZED (
  SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, f AS a, k AS words, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), u AS (
  SELECT lang, phrase, a, unnest(range(1, words)) AS k, w FROM c
), x AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM u
), y AS (
  SELECT x.lang, x.phrase, a, x.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = x.p JOIN f AS r ON r.lang = x.lang AND r.phrase = x.q
), z AS (
  SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), h AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS whole
  FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < words AND i + m - 1 <= words GROUP BY ALL
), k AS (
  SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM z LEFT JOIN h USING (lang, phrase) WHERE whole IS NULL OR 100 * whole < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op2_preference_pairs": _OP2_SQL,
    "op2_every_answer": _OP2_EVERY_SQL,
    "op4_impact_search": _OP4_SQL,
    "op6_mixing": _mix_sql(),
    "op8_warc": _OP8_SQL,
    "op11_filter_audit": _OP11_SQL,
    "op12_collocations": _OP12_SQL,
}
