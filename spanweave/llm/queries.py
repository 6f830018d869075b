"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


VOCABULARY = "byte_bpe_50k.tiktoken"

_OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, 24 + length(role) + length(text) + length(role) - length(replace(role, chr(92), '')) + length(text) - length(replace(text, chr(92), ''))
    + (length(role) - length(replace(role, '<|', ''))) // 2 + (length(text) - length(replace(text, '<|', ''))) // 2
    + length(role) - length(replace(role, chr(10), '')) AS chars
  FROM turns
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS expanded_chars
FROM placed GROUP BY conv_id
"""


_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
 v AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS words FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w WHERE len(l) >= 13)),
 f AS (SELECT words, min(doc_id) AS first FROM v GROUP BY words),
 later AS (SELECT v.doc_id, v.i FROM v JOIN f ON v.words = f.words WHERE f.first < v.doc_id),
 gone AS (SELECT DISTINCT doc_id, i + o AS at FROM later, (SELECT unnest(range(0, 13)) AS o)),
 p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS at, unnest(l) AS word FROM w),
 kept AS (SELECT p.doc_id, count(g.at) AS n_removed, string_agg(word, ' ' ORDER BY p.at) FILTER (g.at IS NULL) AS kept FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at GROUP BY p.doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


#: CRC-32 byte by byte, by a table made from its polynomial.
_OP12 = r"""
WITH f AS (
  SELECT 0 AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), g AS (
  SELECT kind, doc_id, array_to_string(w[i:i + k], ' ') AS gram, count(*) AS n
  FROM (SELECT kind, doc_id, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM f, (VALUES (0), (1), (2)) v(k)) GROUP BY ALL
), crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t), h AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM g)
), step AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM h, crc
), counted AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM g JOIN step USING (gram) GROUP BY bucket
), gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counted
), weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN step USING (gram) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY doc_id
), scored AS (
  SELECT f.doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || f.doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM f LEFT JOIN weighed USING (doc_id) WHERE kind = 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (fit) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, within a tenth of the item's length in edits."""
    from spanweave.llm.decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all texts in tar shards of PNG files, and the columns read back from them."""
    from spanweave.llm.media import media_columns

    found = media_columns(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, from its classifier's evidence and the rates of its host and path."""
    from spanweave.llm.quality import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that an earlier document starts."""
    from spanweave.llm.substrings import drop_repeats

    return drop_repeats(_read(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the bytes decoded from them, of every document."""
    import public_tokenizers

    from spanweave.llm.bpe import Codec, read_ranks, round_trip

    codec = Codec(spark, read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    return round_trip(_read(spark, sf_dir, "documents"), codec)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network trained on the documents outside the held-out fold."""
    from spanweave.llm.language import detect_language

    return detect_language(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, as examples; the counts and digests read back from these."""
    from spanweave.llm.chat import examples, read_back

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(examples(turns.unionByName(more)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    import public_tokenizers

    from spanweave.llm.unigram import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: by the fixed rules, and those that the field adds."""
    from spanweave.llm.secrets import scan

    return scan(_read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from spanweave.llm.simhash import simhash_components

    found = simhash_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: by the fixed rules, and what the field adds."""
    from spanweave.llm.personal import scan

    return scan(_read(spark, sf_dir, "documents")).drop("found")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw toward the benchmark's texts."""
    from spanweave.llm.resample import importance

    found = importance(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the components of all of them, whitened."""
    from spanweave.llm.whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_media, op3_quality, op4_substring_dedup, op5_byte_bpe, op6_language, op7_chat, op8_token_counts, op9_secrets, op10_simhash, op11_personal, op12_resampling, op13_whitening,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_substring_dedup": _OP4, "op7_chat": _OP7, "op12_resampling": _OP12}
