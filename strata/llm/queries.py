"""The corpus queries: each applies one operator to its whole table and derives digests."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontaminate, language_model, packing, repeats, rules, secrets, simhash, token_files
from .common import joined_digest, table


#: The queries' tokenizer, which drops white space, and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        joined_digest(F.col("leak.items"), ",").alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in enumerate(("user", "assistant"))])
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = chat.format_chat(rows)
    back = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        joined_digest(lines, "").alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), tokenizer(), END_ID, by_words=True)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = rules.apply_rules(docs, with_text=False)
    return got.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    texts = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    known = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        joined_digest(texts(known), ",").alias("base_sha256"),
        F.array_join(texts(F.col("secrets")), ",").alias("spans"),
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.find_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = classifier.fit(docs, table(spark, sf_dir, "labels"))
    got = classifier.classify(docs, net)
    return got.select(
        "doc_id",
        classifier.held_out().alias("held_out"),
        "judged.score",
        (F.col("judged.score") >= 0.7).cast("int").alias("predicted"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer(), END_ID, by_words=True)
    return token_files.read_tokens(written)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_pack": op3_pack,
    "op4_language_model": op4_language_model,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_repeats": op7_repeats,
    "op8_simhash": op8_simhash,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_files": op10_token_files,
}
ORACLES: dict[str, str] = {
    "op2_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
                + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 4 + 2 + 8 AS chars
            FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
}
