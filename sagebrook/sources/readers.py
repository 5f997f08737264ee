"""Readers of files as the engine takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the records.
LABEL_TEXTS = "indications_and_usage dosage_and_administration contraindications boxed_warning warnings_and_cautions warnings adverse_reactions drug_interactions".split()
LABELS = "id string, openfda struct<brand_name:array<string>,generic_name:array<string>,product_type:array<string>>, " + ", ".join(f"{f} string" for f in LABEL_TEXTS)
CHAT = "messages array<struct<id:string,role:string,parts:array<struct<type:string,text:string>>>>, documentIds array<string>, mode string"
MOST_LABELS = 15
PAPERS = "resultList struct<result:array<struct<id:string,source:string,pmid:string,pmcid:string,doi:string,title:string,abstractText:string,authorString:string,journalTitle:string,pubYear:string,citedByCount:int>>>"
QUESTIONS = "id string, lang string, question string"
MOST_BYTES = 50 * 1024**2


def labels(spark: SparkSession, path: str, most: int | None = MOST_LABELS) -> DataFrame:
    """Human prescription labels that have indications, the first `most` by id (None: all).

    Each of LABEL_TEXTS may be a text or an array of texts; both come out as an array.
    """
    rows = spark.read.schema(LABELS).json(path)  # an array is read as its JSON text
    each = lambda f: F.when(F.col(f).startswith("["), F.coalesce(F.from_json(f, "array<string>"), F.array(f))).when(F.col(f).isNotNull(), F.array(f)).alias(f)
    kept = rows.where(F.array_contains("openfda.product_type", "HUMAN PRESCRIPTION DRUG") & F.col("indications_and_usage").isNotNull())
    out = kept.select("id", "openfda", *[each(f) for f in LABEL_TEXTS])
    return out.orderBy("id").limit(most) if most else out


def chat_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of a chat, a row each: the last user message's text parts joined by line breaks, document_ids and mode (documents by default)."""
    rows = spark.read.schema(CHAT).json(path)
    last = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)
    texts = F.transform(F.filter(last["parts"], lambda p: p["type"] == "text"), lambda p: p["text"])
    return rows.select(F.array_join(texts, "\n").alias("question"), F.col("documentIds").alias("document_ids"), F.coalesce("mode", F.lit("documents")).alias("mode"))


def page_size(wanted: int) -> int:
    """How many records one reply of the literature source may hold."""
    return min(max(wanted, 1), 100)


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Literature records of saved replies, a row each."""
    return spark.read.schema(PAPERS).json(path).select(F.explode("resultList.result").alias("r")).select("r.*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with the reason why one is turned away: path, length, verdict. Contents are not read."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    return rows.withColumn("verdict", F.when(~F.lower("path").endswith(".pdf"), "not a PDF").when(F.col("length") > MOST_BYTES, "too large").otherwise("ok"))
