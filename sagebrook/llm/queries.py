"""The pN_ queries: each runs its problem's operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import latest, limits, table
from .conversations import quotations, rebuild_conversations, sound_conversations
from .language import corrected_labels, fit, text_languages
from .mixing import mix_sources
from .neardup import CONTENT, TITLE, all_pairs, near_duplicates
from .neardup import groups as near_groups
from .neighbours import nearest
from .packing import container_use, pack_documents, packing_soundness
from .pairs import TRAIN_PAIRS, defective_pairs, prompt_pairs, train_classifier, training_pairs
from .sentences import sentence_units
from .splitting import soundness, split_oversized
from .textstats import kinds_apart_from_prose, text_statistics, word_statistics


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of chunks and messages, as their end positions."""
    rows = [latest(table(spark, sf_dir, kind), "id", "ingested_at", ["content"]).select(F.lit(kind).alias("record_kind"), F.col("id").alias("record_id"), "content") for kind in ("chunks", "messages")]
    return sentence_units(rows[0].unionByName(rows[1]), "content", ["record_kind", "record_id"]).select("record_kind", "record_id", "end_char")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the oversized chunks."""
    by = limits(spark, sf_dir)
    return split_oversized(table(spark, sf_dir, "chunks"), by["split_limit_chars"], by["split_overlap_chars"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks with the way they had to be cut."""
    return p2_pieces(spark, sf_dir).where("piece_no = 1").select("chunk_id", "cut_kind")


def p2_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each chunk give it back, keep the limit and overlap exactly."""
    by = limits(spark, sf_dir)
    return soundness(p2_pieces(spark, sf_dir), table(spark, sf_dir, "chunks"), by["split_limit_chars"], by["split_overlap_chars"])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents, chunks and messages; of rows delivered twice, the last."""
    parts = [
        table(spark, sf_dir, "documents").select(F.lit("documents").alias("record_kind"), F.col("doc_id").cast("string").alias("record_id"), "language", F.col("text").alias("content"), F.col("created_at").alias("at")),
        *(table(spark, sf_dir, kind).select(F.lit(kind).alias("record_kind"), F.col("id").alias("record_id"), "language", "content", F.col("ingested_at").alias("at")) for kind in ("chunks", "messages")),
    ]
    keep = ["record_kind", "record_id", "language", "at"]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("record_id").isNotNull())
    prototypes = fit(rows)
    found = text_languages(rows, prototypes, keep)
    last = F.max(F.struct("at", "language", "segments")).alias("r")
    return found.groupBy("record_kind", "record_id").agg(last).select("record_kind", "record_id", "r.language", "r.segments")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's stretches of one language, with confidence."""
    rows = _languages(spark, sf_dir).select("record_kind", "record_id", F.col("language").alias("label"), F.posexplode("segments").alias("segment_no", "s"))
    return rows.select("record_kind", "record_id", "label", "segment_no", "s.language", "s.confidence", "s.start_char", "s.end_char")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of records whose label is missing, wrong or cannot be right."""
    return corrected_labels(_languages(spark, sf_dir))


def p4_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective prompt and response pairs, with scores."""
    kinds = [table(spark, sf_dir, kind).select(F.lit(kind).alias("record_kind"), F.col("id").alias("record_id"), "language", "content") for kind in ("chunks", "messages")]
    prototypes = fit(kinds[0].unionByName(kinds[1]).where(F.col("record_id").isNotNull()))
    messages = table(spark, sf_dir, "messages")
    pairs = prompt_pairs(messages)
    rate = min(1.0, 4 * TRAIN_PAIRS / max(1, messages.count()))  # somewhat more pairs than are used
    model = train_classifier(*training_pairs(pairs, rate), prototypes)
    return defective_pairs(pairs, model, prototypes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers and what is wrong with them."""
    return p4_defects(spark, sf_dir).select("answer_id", "defect").distinct()


def _near(spark: SparkSession, sf_dir: str) -> list[tuple[str, bool, tuple[DataFrame, DataFrame]]]:
    """Links and members of contents and of titles, and whether their ids are numbers."""
    chunks = latest(table(spark, sf_dir, "chunks"), "id", "ingested_at", ["content"]).withColumnRenamed("content", "text")
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("text"))
    return [("chunks", False, near_duplicates(chunks, CONTENT)), ("documents", True, near_duplicates(titles, TITLE, True))]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with nearly the same content and of documents with nearly the same title."""
    out = [all_pairs(*found, number).select(F.lit(kind).alias("record_kind"), "id_a", "id_b") for kind, number, found in _near(spark, sf_dir)]
    return out[0].unionByName(out[1])


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same between texts that differ, each by its smallest id; p5_groups has who shares a text."""
    out = [links.select(F.lit(kind).alias("record_kind"), "id_a", "id_b", F.round("similarity", 6).alias("similarity")) for kind, _, (links, _) in _near(spark, sf_dir)]
    return out[0].unionByName(out[1])


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk and title with its class of equal texts and its group of nearly equal ones."""
    out = [near_groups(*found, number).select(F.lit(kind).alias("record_kind"), F.col("id").alias("record_id"), "class_id", "group_id", "n_links") for kind, number, found in _near(spark, sf_dir)]
    return out[0].unionByName(out[1])


def _vectors(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return latest(table(spark, sf_dir, "chunks"), "id", "ingested_at", [field]).select("id", F.col(field).alias("vector"))


def _neighbours(spark: SparkSession, sf_dir: str, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out = []
    for field in ("embedding", "embedding_translated"):
        rows = _vectors(spark, sf_dir, field)
        out.append(nearest(rows, chosen(rows)).select(F.lit(field).alias("vector_field"), F.col("query_id").alias("chunk_id"), "neighbour_id", "similarity"))
    return out[0].unionByName(out[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar chunks of each probe chunk, for both vectors."""
    probes = table(spark, sf_dir, "probe_chunks").select(F.col("chunk_id").alias("id")).distinct()
    return _neighbours(spark, sf_dir, lambda rows: rows.join(probes, "id", "left_semi")).drop("similarity")


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a fiftieth of all chunks, chosen by their hashed ids (ids are no numbers here), against all."""
    fiftieth = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 50 == 0
    return _neighbours(spark, sf_dir, lambda rows: rows.where(fiftieth)).withColumn("similarity", F.round("similarity", 4))  # units are kept as floats


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the conversations kept, in order."""
    kept = sound_conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return kept.select("conversation_id", "turn_no", "message_id")


def p7_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without a conversation, in those that their replies and quotations show; p7_quotations has what is quoted but held too often to show any."""
    found = rebuild_conversations(table(spark, sf_dir, "messages")).where("recovered")
    return found.select("conversation_id", "turn_no", "message_id", "role", "sound")


def p7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text quoted among messages without a conversation, with all that hold and all that quote it."""
    return quotations(table(spark, sf_dir, "messages"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of container_tokens tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["container_tokens"])


def p8_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full those containers are."""
    return container_use(p8_containers(spark, sf_dir), limits(spark, sf_dir)["container_tokens"])


def p8_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, and how many containers hold too much, parts were cut without need or tokens are missing or twice there."""
    return packing_soundness(p8_containers(spark, sf_dir), limits(spark, sf_dir)["container_tokens"])


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares the mixture reaches."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose text is not natural prose."""
    return kinds_apart_from_prose(table(spark, sf_dir, "documents"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every document."""
    return text_statistics(table(spark, sf_dir, "documents"))


def p10_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ratios of characters, lines and words of every document."""
    found = word_statistics(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes if c != "doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    named = {name.lower(): text for name, text in vars(sql).items() if name[0] == "P" and name[1:2].isdigit()}
    return {name: named[name] for name in queries() if name in named}
