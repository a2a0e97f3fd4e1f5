"""One query for each operator of this folder, over the whole given tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bin_slack, bpe_automaton, chunked_bpe, histogram_sort, kneser_ney, near_dedup, prefix_trie, rules, suffix_dedup, syncmers, toxicity, tree_dedup

Query = Callable[[SparkSession, str], DataFrame]


#: Rows of a batch that Spark hands to a Python worker. Texts are long: the default of 10,000 rows is tens of MB, held
#: several times over by either side.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = tree_dedup.remove_passages(table(spark, folder, "documents"), length=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer(name: str) -> str:
    """Where the given tokenizer files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe_automaton.encode_and_decode(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return bin_slack.pack(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096)


def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), words=5, percent=85)


def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.classify(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("rid")


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    return histogram_sort.shard(table(spark, folder, "documents"), shards=8)


def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = syncmers.fingerprints(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def words_pattern() -> str:
    """The pattern that cuts texts before the merges of the byte-level files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunked_bpe.encode_and_decode(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"), words_pattern())
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.shared_prefix_trie(table(spark, folder, "conversations"))


def cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    rows = align.alignment(table(spark, folder, "documents"), *files, words_pattern(), hashed=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": quality_classifier,
    "op2_suffix_array_dedup": suffix_array_dedup,
    "op3_sharding": sharding,
    "op4_substring_dedup": substring_dedup,
    "op5_bpe_round_trip": bpe_round_trip,
    "op6_best_fit_packing": best_fit_packing,
    "op7_toxicity": toxic_scores,
    "op8_quality_rules": quality_rules,
    "op9_document_fingerprints": document_fingerprints,
    "op10_minhash_near_dedup": minhash_near_dedup,
    "op11_byte_bpe_chunks": byte_bpe_chunks,
    "op12_conversation_prefix_trie": conversation_prefix_trie,
    "op13_cross_tokenizer_alignment": cross_tokenizer_alignment,
}

#: The words of each text with their numbers, for the SQL of the word operators.
WORDS = r"""words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
)"""

ORACLES: dict[str, str] = {
    "op4_substring_dedup": rf"""WITH {WORDS},
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM words),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (h) WHERE low < doc_id),
gone AS (SELECT doc_id, list(j) AS js FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)""",
    "op10_minhash_near_dedup": r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached(doc, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, low FROM reached JOIN edges ON u = doc),
parts AS (SELECT doc, min(low) AS component_id FROM reached GROUP BY doc)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN parts ON doc = doc_id LEFT JOIN sizes USING (doc_id)""",
    "op12_conversation_prefix_trie": r"""WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS g, xor(list_reduce([4294967295::BIGINT] || list_transform(split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
),
parts AS (
  SELECT c.conv_id, 0 AS side, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.g AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
),
rebuilt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS d, role, text FROM parts),
named AS (
  SELECT conv_id, d, text, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p
  FROM rebuilt
),
walks AS (
  SELECT conv_id, d, p, lag(p, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS up, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM named
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM convs
),
lengths AS (SELECT conv_id, max(d) AS l FROM walks GROUP BY conv_id),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, min(up) AS up, max(words) AS words, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN d = l THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM walks JOIN lengths USING (conv_id) GROUP BY p, d
),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.p),
sums AS (
  SELECT w.p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * u.words) AS saved_tokens
  FROM full_nodes u JOIN walks w ON w.conv_id = u.conv_id AND w.d <= u.d GROUP BY w.p
)
SELECT v.conv_id, v.d::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM full_nodes v JOIN sums USING (p) LEFT JOIN nodes q ON q.p = v.up""",
}


def register(queries: dict[str, Query], oracles: dict[str, str]) -> None:
    queries.update(QUERIES)
    oracles.update(ORACLES)
