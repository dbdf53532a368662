"""Registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import bpe_decode, bpe_encode
from tidemark.llm.chat import format_conversations, read_conversations
from tidemark.llm.common import crc_fold, shared_path, table
from tidemark.llm.cross_tokenizer import byte_level, cross_tokenizer_links, pieces
from tidemark.llm.decontamination import contaminated
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language_id import identify_languages, learn_languages
from tidemark.llm.quality import learn_quality, score_quality
from tidemark.llm.sharding import uniform_shards
from tidemark.llm.simhash import simhash_components
from tidemark.llm.source_divergence import source_divergence
from tidemark.llm.substring_dedup import remove_repeated
from tidemark.llm.toxicity import learn_toxicity, score_toxicity
from tidemark.llm.warc import read_warc, write_warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(table(spark, sf_dir, "documents"), min_words=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
 f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM p JOIN f ON f.win = p.win AND f.first < p.doc_id),
 r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY 1),
 u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d WHERE doc_id IN (SELECT doc_id FROM r)),
 k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.k = u.k WHERE g.k IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("id"), 5) != 0)
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("terms").alias("n_terms"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = uniform_shards(table(spark, sf_dir, "documents"), shards=24)
    return shards.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def encoded_digests(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Ids of every text, decoded again, as counts and digests."""
    back = bpe_decode(bpe_encode(docs, path, pattern), path, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = learn_languages(docs, ~held_out)
    return identify_languages(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    archives = write_warc(table(spark, sf_dir, "pages"), folder, keep="max", least_bytes=0)
    return read_warc(archives, folder).select(
        F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")
    )


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
 g AS (SELECT body, max(page_id) AS kept FROM p GROUP BY body),
 d AS (SELECT page_id, strlen(body) AS payload_bytes, kept, upper(sha1(body)) AS h FROM p JOIN g USING (body))
SELECT page_id, payload_bytes,
 list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(list_aggregate(list_transform(range(5), lambda j: (((strpos('0123456789ABCDEF', substr(h, 1 + CAST((5 * i + j) // 4 AS INT), 1)) - 1)
   >> CAST(3 - (5 * i + j) % 4 AS INT)) & 1) << CAST(4 - j AS INT)), 'sum') AS INT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d
"""


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_conversations(format_conversations(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (SELECT unnest([0, 1]) AS k)),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(15 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>'))) AS chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c
"""


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_quality(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("id"), 5) != 0)
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    return score_quality(docs, model, least=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted", "weakest")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = partial(byte_level, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    second = partial(pieces, public_tokenizers.path("piece_bpe_32k.model"))
    return cross_tokenizer_links(table(spark, sf_dir, "documents"), first, second)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
 f AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
 p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS BIGINT) AS p FROM f WINDOW w AS (PARTITION BY lang, source)),
 a AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
 q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS BIGINT) AS q FROM a WINDOW w AS (PARTITION BY lang)),
 s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
 r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
   FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_exact_dedup, op3_toxicity, op4_decontamination, op5_sharding,
        op6_byte_bpe, op7_simhash, op8_language_id, op9_warc, op10_chat,
        op11_quality, op12_cross_tokenizer, op13_source_divergence,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op9_warc": OP9_SQL, "op10_chat": OP10_SQL, "op13_source_divergence": OP13_SQL}
