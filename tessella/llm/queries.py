"""The registered queries opN_<name> over the whole tables, with their SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, conversation_trie, decontamination, fingerprints, language_model, licenses, media, quality, sharding, simhash, token_files, toxicity, vector_codes, word_model
from tessella.llm.sql import CONVERSATION_TRIE_SQL, DECONTAMINATION_SQL, LANGUAGE_MODEL_SQL, VECTOR_CODES_SQL, WORD_MODEL_SQL, sharding_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrase places and template spans of every document.

    A null, empty or wordless text has n_words 0, null first_word and last_word,
    empty labels and score 0. score is the largest share of a template that one
    chain covers. Repeated rows each get a row.
    """
    scanned = licenses.scan_licenses(_texts(spark, sf_dir)).select("doc_id", "licenses.*")
    first = F.col("base")["first"]
    base, spans = F.col("base")["label"], F.col("spans")["label"]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(first).cast("bigint").alias("first_word"),
        F.array_max(first).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, spans)).alias("labels"),
        F.col("cover").alias("score"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, posteriors and decision of every document, its site read from ``source``.

    A null text is empty, a null source a site of its own; repeated rows each
    count and get a row.
    """
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def byte_class_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3, with n-grams over byte classes, small enough for a table; a companion of op3, not the operator."""
    docs = _texts(spark, sf_dir)
    flagged = language_model.flag_target(docs, _table(spark, sf_dir, "labels"))
    scored = language_model.cross_entropy_difference(docs, flagged, "target")
    return scored.withColumns({c: F.round(c, 6) + 0.0 for c in ("target_loss", "background_loss", "score")})


def op3_word_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under the target and background word models.

    A text without words has n_tokens 0, losses and score 0. Repeated rows each
    count and get a row.
    """
    scored = word_model.word_cross_entropy(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.withColumns({c: F.round(c, 6) + 0.0 for c in ("target_loss", "background_loss", "score")})


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows that occur in every document.

    A null or wordless text has zeros, the digest of no items, and isn't
    contaminated; null items and items without words are left out; equal texts
    of several items name them all. Repeated rows each get a row.
    """
    found = decontamination.find_contamination(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        decontamination.n_hit(c).alias("n_hit"),
        F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (F.size(c["spans"]) > 0).alias("contaminated"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law ``key``; grown_shard is that with one more shard.

    A null text has size 1; null ids share a shard. Repeated rows each get a
    slot of their own, in order of arrival.
    """
    docs = _texts(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    placed = sharding.place(docs, 16).withColumn("slot_draw", sharding.uniform(sharding.key_text("doc_id"), "slot"))
    slotted = sharding.add_slots(placed, "shard", ["slot_draw", "doc_id"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids lie in the token files, as read back from them.

    A null or empty text is just the end id. Null ids come first; rows with
    equal ids follow each other in order of arrival.
    """
    folder = token_files.token_folder(spark)
    parts = token_files.write_token_files(_texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read_documents(spark, folder, parts)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's picture and of its samples, as read back.

    A null or empty text is one row of padding. Equal texts give equal values.
    """
    stored = media.add_png(_texts(spark, sf_dir)).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "media"
    )
    return media.read_png(stored).select(
        "doc_id",
        "n_bytes",
        "decoded.payload_bytes",
        "decoded.payload_sha256",
        "decoded.tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "decoded.feature",
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document.

    Texts without words have fingerprint 0. component_id is null only where all
    ids of a group are. Repeated rows each get a row.
    """
    rows = simhash.near_duplicates(_texts(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text they decode to.

    A null or empty text has no tokens. Repeated rows each get a row.
    """
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(_texts(spark, sf_dir), vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category for every document, and whether it is toxic.

    A null or empty text has no features. Without labels every probability is
    one half. Repeated rows each get a row.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.add_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "toxicity.*")
    names = {c: f"p_{c}" for c in toxicity.CATEGORIES}
    return scored.withColumnsRenamed(names).withColumn("toxic", F.col("p_toxic") > toxicity.TOXIC_ABOVE)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they and the next document's are.

    A null text is empty and like another empty one. Null ids come last, equal
    ids go by a hash of their texts. Repeated rows each get a row.
    """
    return fingerprints.with_next(_texts(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with the totals of its subtree.

    Rows without conv_id are left out, null roles and texts are empty; equal turn
    numbers stand by role and text. An empty table gives no row.
    """
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector with finite components, by codebooks fitted on all of them.

    Repeated rows each count and get a row; null labels are one label.
    """
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality": op2_quality,
        "op3_word_cross_entropy": op3_word_cross_entropy,
        "byte_class_cross_entropy": byte_class_cross_entropy,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_token_files": op6_token_files,
        "op7_media": op7_media,
        "op8_simhash": op8_simhash,
        "op9_bpe": op9_bpe,
        "op10_toxicity": op10_toxicity,
        "op11_fingerprints": op11_fingerprints,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_word_cross_entropy": WORD_MODEL_SQL,
        "byte_class_cross_entropy": LANGUAGE_MODEL_SQL,
        "op4_decontamination": DECONTAMINATION_SQL,
        "op5_sharding": sharding_sql(sharding.layout(16), sharding.layout(17)),
        "op12_conversation_trie": CONVERSATION_TRIE_SQL,
        "op13_vector_codes": VECTOR_CODES_SQL,
    }
