"""The queries of the training-data operators, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, embedding_dedup, exact_dedup, merkle, near_dedup, packing, pii, quality, secrets, sharding, token_files
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(rows)
    loss = chat.loss_text()
    return out.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.uniform_tree(24), sharding.uniform_tree(25))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    back = token_files.read_token_files(spark, files)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.document_manifest(table(spark, sf_dir, "documents")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, CASE WHEN regexp_matches(text, '\[/?INST\]|\[ESC\]|</s>')
    THEN 5 + length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(regexp_replace(text, '\[/?INST\]|\[ESC\]|</s>', '', 'g'))
      - length(regexp_replace(text, '\[/?INST\]|\[ESC\]|</s>', 'XXXXXX', 'g')) + length(regexp_replace(text, '\[/?INST\]|\[ESC\]|</s>', 'XXXXXXX', 'g'))
      - (length(text) - length(regexp_replace(text, '\[/?INST\]|\[ESC\]|</s>', '', 'g'))))
    ELSE length(text) END AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + length(role) + 7 + body + 4) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _draws(n_shards: int, to: str) -> str:
    """SQL for the descent in ``uniform_tree(n_shards)``: the shard with the longest straw."""
    straw = "ln((('0x' || substr(md5(key || ':shard' || shard), 1, 13))::BIGINT + 0.5) / 4503599627370496)"
    return f"{to} AS (SELECT key, arg_max(shard, {straw}) AS {to} FROM keys, range({n_shards}) t(shard) GROUP BY key)"


# CRC-32 from its polynomial: a table of 256 entries, then a fold over the bytes of the text
CRC32 = """list_reduce(list_transform(range(strlen(t)), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT), lambda acc, x: xor(acc >> 8, crc[(xor(acc, x) & 255) + 1]), 4294967295::BIGINT)"""
OP2_SQL = f"""
WITH keys AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id IS NOT NULL), {_draws(24, 'shard')}, {_draws(25, 'grown_shard')},
c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, CAST(strlen(t) + 8 AS BIGINT) AS size, xor({CRC32}, 4294967295) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM d CROSS JOIN c JOIN shard ON shard.key = CAST(doc_id AS VARCHAR) JOIN grown_shard ON grown_shard.key = CAST(doc_id AS VARCHAR)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.shingles) + len(y.shingles) - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, l.b FROM reach r JOIN edges l ON l.a = r.b)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, m) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _clustering(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """SQL of the rounds, one after the other; floors of quotients by whole numbers."""
    steps = []
    for r in range(rounds + 1):
        far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (q[i] - m[i]) * (q[i] - m[i])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, min(struct_pack(d := d, j := j)) AS best FROM (SELECT id, j, {far}::BIGINT AS d FROM v, c{r}) GROUP BY id)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT best.j AS j, i, sum(q[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (id), range(1, {dims + 1}) t(i) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM u{r} GROUP BY j)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (j))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, q AS m FROM v QUALIFY j < {k}),
{", ".join(steps)}
SELECT vec_id, best.j::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.j))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (id) JOIN c{rounds} ON c{rounds}.j = best.j
"""


def _tree(nodes: str, leaves: str, name: str, levels: int) -> str:
    """SQL that hashes ``nodes`` (g, idx, h, n) eight at a time and folds ``leaves`` (rid, g, idx, f, proof) up along them; a node that is alone stays."""
    steps, at, leaf = [], nodes, leaves
    for k in range(levels):
        to, fold = f"{name}n{k}", f"{name}p{k}"
        steps.append(f"{name}r{k} AS MATERIALIZED (SELECT g, idx // 8 AS par, any_value(n) AS n, list(h ORDER BY idx) AS hs FROM {at} GROUP BY g, par)")
        steps.append(f"{to} AS MATERIALIZED (SELECT g, par AS idx, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 7) // 8 AS n FROM {name}r{k})")
        before, behind = "array_to_string(hs[:idx % 8], '')", "array_to_string(hs[idx % 8 + 2:], '')"
        steps.append(f"""{fold} AS MATERIALIZED (SELECT rid, p.g, par AS idx, CASE WHEN n > 1 THEN sha256({before} || f || {behind}) ELSE f END AS f, CASE WHEN n > 1 THEN proof || {before} || {behind} ELSE proof END AS proof
  FROM {leaf} p JOIN {name}r{k} r ON r.g = p.g AND r.par = p.idx // 8)""")
        at, leaf = to, fold
    return ", ".join(steps)


LEAF_LEVELS, LANG_LEVELS = 8, 4
_field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_leaf = "sha256(" + " || ".join(_field.format(x) for x in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
OP12_SQL = f"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS crc),
d AS (SELECT *, doc_id::VARCHAR AS t, hex(encode(doc_id::VARCHAR)) AS h, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
l AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf.format(text="text")} AS leaf, CASE WHEN xor({CRC32}, 4294967295) % 3 = 0 THEN {_leaf.format(text="low")} END AS tampered FROM d CROSS JOIN c),
w AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
nodes AS (SELECT g, idx, leaf AS h, n FROM w), leaves AS (SELECT rid, g, idx, coalesce(tampered, leaf) AS f, '' AS proof FROM w),
{_tree("nodes", "leaves", "a", LEAF_LEVELS)},
top AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, h, count(*) OVER () AS n, g AS name FROM an{LEAF_LEVELS - 1}),
up AS (SELECT rid, '' AS g, top.idx, f, proof FROM ap{LEAF_LEVELS - 1} p JOIN top ON top.name = p.g),
{_tree("top", "up", "b", LANG_LEVELS)}
SELECT doc_id, leaf, top.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM w JOIN bp{LANG_LEVELS - 1} p USING (rid) JOIN top ON top.name = w.g CROSS JOIN bn{LANG_LEVELS - 1} root
"""

OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, m) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) x ON x.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) y ON y.a = vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op2_sharding": OP2_SQL, "op6_minhash_near_dedup": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_centroid_clustering": _clustering(), "op12_merkle_manifest": OP12_SQL, "op13_embedding_near_dedup": OP13_SQL}
