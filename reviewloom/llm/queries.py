"""Registered queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.addressable_codes import read_checksums, write_token_files
from reviewloom.llm.bottom_k import edited_fingerprints
from reviewloom.llm.collocations import collocations
from reviewloom.llm.combination_join import near_duplicate_components
from reviewloom.llm.cube_mix import mix_sources
from reviewloom.llm.line_dedup import drop_repeated_lines
from reviewloom.llm.mil_toxicity import score_documents, train
from reviewloom.llm.overlap_tokens import count_tokens
from reviewloom.llm.periodic_runs import find_runs, plant_runs
from reviewloom.llm.reply_trees import as_chain, format_paths, parse_conversation, reply_paths, unescape
from reviewloom.llm.tables import table
from reviewloom.llm.warc import RECORD_ID, normalise, read_records, record_decisions, write_archives
from reviewloom.llm.word_table_bpe import encode_decode
from reviewloom.llm.wu_manber import find_test_strings

#: Folder of the tokenizer files; the same on every machine. Default: the installed package.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@register
def op1_warc_normaliser(spark, sf_dir):
    archives = write_archives(record_decisions(table(spark, sf_dir, "pages")))
    records = read_records(normalise(archives))
    number = lambda c: F.nullif(F.substring(c, len(RECORD_ID) + 1, 40), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("computed_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


@register
def op2_word_table_bpe(spark, sf_dir):
    coded = encode_decode(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), keep=["doc_id"], digests=True)
    return coded.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


@register
def op3_wu_manber_decontamination(spark, sf_dir):
    found = find_test_strings(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


@register
def op4_overlap_token_counts(spark, sf_dir):
    counts = count_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), keep=["doc_id"])
    n = F.col("__n_tokens")
    return counts.select("doc_id", F.col("__n_bytes").alias("n_bytes"), n.alias("n_tokens"), (n > 1024).alias("over_limit"))


@register
def op5_line_dedup(spark, sf_dir):
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


#: Conversation -7: control strings inside texts.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def _digests(batches):
    """What the formatted conversations say when they are read back."""
    for batch in batches:
        out = []
        for conv_id, formatted, spans in zip(batch.column("tree").to_pylist(), batch.column("formatted"), batch.column("loss_spans").to_pylist()):
            formatted = formatted.as_py()
            turns = parse_conversation(formatted)
            all_turns = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
            loss = "".join(unescape(formatted[s["first"]:s["after"]]) for s in spans)
            out.append((conv_id, len(turns), hashlib.sha256(all_turns).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        kinds = (batch.schema.field("tree").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


@register
def op6_reply_tree_chat(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    messages = as_chain(given.unionByName(added))
    names = {"tree": "conv_id", "node": "__message"}
    paths = reply_paths(messages, **names, parent="__parent", score=None)
    formatted = format_paths(paths, messages, **names)
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(_digests, fields)


@register
def op7_bottom_k_fingerprints(spark, sf_dir):
    return edited_fingerprints(documents(spark, sf_dir))


@register
def op8_addressable_token_files(spark, sf_dir):
    files = write_token_files(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return read_checksums(files)


@register
def op9_combination_prefix_join(spark, sf_dir):
    return near_duplicate_components(documents(spark, sf_dir))


def held_out(doc_id: str = "doc_id"):
    """A fifth of the documents, by their id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@register
def op10_mil_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score_documents(docs, model, keep=["doc_id"])
    score = F.col("__score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@register
def op11_periodic_runs(spark, sf_dir):
    found = find_runs(plant_runs(documents(spark, sf_dir)), keep=["doc_id"])
    runs = F.col("__runs")
    # Runs come by start, then period: the first of equal ratios stays.
    first = F.when(F.size(runs) > 0, runs[0])
    best = F.reduce(runs, first, lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("__collapsed")).alias("collapsed_sha256"),
    )


@register
def op12_cube_mixing(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return mixed.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


@register
def op13_phrase_collocations(spark, sf_dir):
    return collocations(spark, table(spark, sf_dir, "documents").select("text", "lang"))
