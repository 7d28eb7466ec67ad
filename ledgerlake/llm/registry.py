"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, exact_dedup, infill, line_frequency, near_dedup, packing, pii, quality, repeats, sharding, topk, toxicity
from .common import held_out, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "sentences", "offending")


def op2_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


SURROGATE_KEY = "ledgerlake-surrogates"  # a deployment passes its own secret


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", F.col("__entities").alias("n_entities"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 40)


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.described(table(spark, sf_dir, "documents"))
    return quality.score(found, quality.train(found))


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = repeats.remove_repeats(table(spark, sf_dir, "documents"), anchor=repeats.PASSAGE_ANCHOR, passage=repeats.PASSAGE)
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("bucket", "chain_pos")


def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_boundary_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_frequency.line_verdicts(table(spark, sf_dir, "documents"))
    return judged.withColumn("n_removed_lines", F.size("removed").cast("long")).drop("removed")


QUERIES = {f.__name__: f for f in (op1_toxicity_mil, op2_cover_tree_topk, op3_pii_surrogates, op4_rendezvous_sharding, op5_bpe_tree, op6_weak_label_quality, op7_run_length_index, op8_order_minhash, op9_extendible_dedup, op10_binary_packing, op11_gnat_codes, op12_boundary_infill, op13_line_frequency)}



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds one after the other; squared distances from dot products, which are whole numbers that a double holds."""
    nearest = "SELECT x.row, x.p, arg_min(b.k, {d}::BIGINT * 1000 + b.k) AS k, min({d})::BIGINT AS d FROM x JOIN b{r} b USING (p) GROUP BY 1, 2".replace("{d}", "(list_dot_product(x.c, x.c) - 2 * list_dot_product(x.c, b.c) + list_dot_product(b.c, b.c))")
    steps = "".join(f"""
             a{r} AS MATERIALIZED ({nearest.format(r=r)}),
             m{r} AS MATERIALIZED (SELECT p, k, list(v ORDER BY i) AS c FROM (SELECT p, k, i, floor(sum(v) / count(*)) AS v FROM (SELECT x.p, a.k, unnest(x.c) AS v, unnest(range(len(x.c))) AS i FROM x JOIN a{r} a USING (row, p)) GROUP BY ALL) GROUP BY ALL),
             b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, k)),""" for r in range(rounds))
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             x AS MATERIALIZED (SELECT row, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS c FROM v, range({parts}) r(p)),
             b0 AS MATERIALIZED (SELECT p, row AS k, c FROM x WHERE row < {entries}),{steps}
             last AS MATERIALIZED ({nearest.format(r=rounds)}),
             flat AS (SELECT sha256(string_agg(w, ',' ORDER BY p, k)) AS codebooks_sha256 FROM (SELECT p, k, array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ',') AS w FROM b{rounds})),
             coded AS (SELECT v.vec_id, v.label, string_agg(lpad(lower(hex(l.k)), 2, '0'), '' ORDER BY l.p) AS code, sum(l.d)::BIGINT AS error FROM v JOIN last l USING (row) GROUP BY v.row, v.vec_id, v.label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, flat"""


SQL = {
    "op11_gnat_codes": _codes_sql(),
    "op12_boundary_infill": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
             u AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS x, ('0x' || s[9:16])::BIGINT % (n + 1) AS y, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM h),
             f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END) AS output_sha256, sha256(t) AS restored_sha256
        FROM f""",
    "op13_line_frequency": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
             w AS (SELECT row, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, unnest(range(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS i FROM d),
             g AS (SELECT row, i, count(*) OVER (PARTITION BY row, word, w1, w2, w3, w4) AS n FROM (SELECT row, i, word, lead(word, 1) OVER s AS w1, lead(word, 2) OVER s AS w2, lead(word, 3) OVER s AS w3, lead(word, 4) OVER s AS w4 FROM w WINDOW s AS (PARTITION BY row ORDER BY i)) WHERE w4 IS NOT NULL),
             r AS (SELECT row, count(DISTINCT i + k) AS n FROM g, range(5) x(k) WHERE n > 1 GROUP BY row),
             c AS (SELECT row, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY row),
             l AS (SELECT row, source, md5(t) AS doc, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, array_to_string(regexp_extract_all(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+'), ' ') AS norm FROM (SELECT row, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
             k AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY row),
             h AS (SELECT source, count(DISTINCT md5(t)) AS docs FROM d GROUP BY source),
             f AS (SELECT l.source, norm FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source WHERE n > 0 GROUP BY l.source, norm, docs HAVING count(DISTINCT doc) > {line_frequency.MOST_DOCS} AND count(DISTINCT doc) > {line_frequency.MOST_SHARE}::DOUBLE * docs),
             z AS (SELECT row, sum(n) AS n, count(*) AS lines FROM l WHERE EXISTS (SELECT 1 FROM f WHERE f.source IS NOT DISTINCT FROM l.source AND f.norm = l.norm) GROUP BY row),
             o AS (SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(k.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(z.n, 0) AS gone, coalesce(z.lines, 0) AS n_removed_lines
                   FROM d LEFT JOIN c USING (row) LEFT JOIN k USING (row) LEFT JOIN r USING (row) LEFT JOIN z USING (row)),
             b AS (SELECT *, n_words < {line_frequency.LEAST_WORDS} OR 100 * n_repeat_words > {line_frequency.MOST_REPEATED} * n_words AS base_failed, (n_words - gone)::BIGINT AS words_left FROM o)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, NOT base_failed AND words_left >= {line_frequency.LEAST_LEFT}::DOUBLE * n_words AS kept, n_removed_lines FROM b""",
    "op2_cover_tree_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
                   FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    # CRC-32 by its table, which a list of remainders gives; rendezvous winners as the first largest hash.
    "op4_rendezvous_sharding": """
        WITH k AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) s(i))),
             d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, octet_length(encode(coalesce(text, ''))) + 16 AS size,
                          list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda x: instr('123456789ABCDEF', x)) AS h FROM documents),
             b AS (SELECT doc_id, key, size, list_transform(range(size - 16), lambda i: 16 * h[2 * i + 1] + h[2 * i + 2]) AS bytes, list_transform(range(41), lambda i: ('0x' || left(md5(key || '#' || i), 13))::BIGINT) AS u FROM d),
             s AS (SELECT doc_id, key, size, CASE WHEN size = 16 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) END AS text_crc32,
                          list_position(u[:40], list_max(u[:40])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown_shard FROM b, k)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM s""",
    "op9_extendible_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
}
