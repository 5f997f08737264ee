"""Texts shown to readers and models, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapsed, prefix, trimmed

# Formats and messages that results must equal.
SOURCE_HEAD, SOURCE_SEPARATOR, NO_CONTEXT = "## Kaynak [^{n}] — {label}", "\n\n---\n\n", "Hiç kaynak bulunamadı."
PROMPT_PARTS = {
    "tr": ("Aşağıdaki kaynaklara dayanarak soruyu yanıtla.", "## Kaynaklar", "## Soru"),
    "en": ("Answer the question based on the sources below.", "## Sources", "## Question"),
}
NO_SOURCES = {
    ("tr", "documents"): "Bu konuda sağlanan kaynaklarda yeterli bilgi yok. Lütfen soruyu daha spesifik sorun ya da ilgili belgeyi kütüphaneye yükleyin.",
    ("en", "documents"): "The provided sources don't contain enough information on this topic. Please ask a more specific question or upload the relevant document.",
    ("tr", "literature"): "Bu soruyla ilgili literatürde (PubMed/Europe PMC) makale bulunamadı. Soruyu farklı ya da daha spesifik ifade edin.",
    ("en", "literature"): "No relevant literature (PubMed/Europe PMC) was found for this question. Try rephrasing or being more specific.",
}
EVIDENCE_LABELS = ("Study type", "Population (P)", "Intervention (I)", "Comparison (C)", "Outcome (O)", "Sample size", "Key finding", "Evidence", "Quality flags")
EVIDENCE_LABELS_TR = ("Çalışma tipi", "Popülasyon (P)", "Müdahale (I)", "Karşılaştırma (C)", "Sonuç (O)", "Örneklem", "Ana bulgu", "Kanıt", "Kalite notları")
SYNTHESIS_PARTS = {
    "tr": ("Aşağıdaki makale kanıtlarını sentezleyerek soruyu yanıtla.", "## Soru", "## Makale Kanıtları"),
    "en": ("Synthesize the paper evidence below to answer the question.", "## Question", "## Paper Evidence"),
}
RERANK_PROMPT = 'Soru: "{question}"\n\nAşağıda numaralı aday metin parçaları var. Soruyu yanıtlamak için EN ALAKALI olanları en alakalıdan başlayarak sırala. SADECE indeks numaralarını, alaka sırasıyla, virgülle ayrılmış döndür (örn: 3,0,7). Açıklama YAZMA.\n\n{list}'
RERANK_CHARS = 320
UNKNOWN_STUDY, NOT_STATED = "bilinmiyor", "belirtilmemiş"


def source_label(title: Column, page: Column, section: Column) -> Column:
    shown = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", sayfa "), page.cast("string"))).otherwise("")
    return F.concat(title, shown, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", "), section)).otherwise(""))


def source_block(n: Column, label: Column, content: Column) -> Column:
    return F.concat(F.lit("## Kaynak [^"), n.cast("string"), F.lit("] — "), label, F.lit("\n"), trimmed(content))


def judge_block(n: Column, title: Column, section: Column, content: Column) -> Column:
    place = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", "), section)).otherwise("")
    return F.concat(F.lit("Source ["), n.cast("string"), F.lit("] ("), title, place, F.lit("):\n"), prefix(content, 600))


def user_prompt(question: Column, context: Column, language: Column) -> Column:
    made = {k: F.concat(F.lit(f"{intro}\n\n{sources}\n\n"), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit(f"\n\n{head}\n\n"), question) for k, (intro, sources, head) in PROMPT_PARTS.items()}
    return F.when(language == "tr", made["tr"]).otherwise(made["en"])


def no_sources(language: Column, mode: str = "documents") -> Column:
    kind = "documents" if mode == "documents" else "literature"
    return F.when(language == "tr", NO_SOURCES["tr", kind]).otherwise(NO_SOURCES["en", kind])


def fallback_evidence(abstract: Column) -> dict[str, Column]:
    """Evidence of a paper whose reply could not be read."""
    fixed = {name: F.lit(NOT_STATED) for name in ("population", "intervention", "comparison", "outcome", "sample_size")}
    return {"study_type": F.lit(UNKNOWN_STUDY), **fixed, "key_finding": prefix(abstract, 200), "evidence_snippet": prefix(abstract, 160)}


def filled(template: str, **values: Column) -> Column:
    """A text with columns in the places of {names}; null where one is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def rerank_prompts(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id and prompt of questions (query_id, text) with candidates (query_id, place, content); a row for each question, with its few candidates."""
    line = F.concat(F.lit("["), (F.col("place") - 1).cast("string"), F.lit("] "), prefix(collapsed(F.col("content")), RERANK_CHARS))
    lines = candidates.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("_list"))
    return questions.select("query_id", "text").join(lines, "query_id").select("query_id", filled(RERANK_PROMPT, question=F.col("text"), list=F.col("_list")).alias("prompt"))


def synthesis_prompt(question: Column, blocks: Column, language: Column) -> Column:
    """The whole prompt from evidence blocks (an array in order)."""
    made = {k: filled("{intro}\n\n{head}\n\n{question}\n\n{evidence}\n\n{blocks}", intro=F.lit(i), head=F.lit(h), question=question, evidence=F.lit(e), blocks=F.array_join(blocks, "\n\n")) for k, (i, h, e) in SYNTHESIS_PARTS.items()}
    return F.when(language == "tr", made["tr"]).otherwise(made["en"])


def evidence_block(n: Column, title: Column, meta: Column, evidence: dict[str, Column], flags: Column, labels: tuple = EVIDENCE_LABELS) -> Column:
    """One paper of a synthesis prompt; the line of flags only where there are any."""
    head = F.concat(F.lit("### Makale [^"), n.cast("string"), F.lit("] — "), title, F.when(F.coalesce(meta, F.lit("")) != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""))
    names = ("study_type", "population", "intervention", "comparison", "outcome", "sample_size", "key_finding")
    lines = [F.concat(F.lit(f"- {label}: "), evidence[name]) for label, name in zip(labels, names)]
    quoted = F.concat(F.lit(f"- {labels[7]}: \""), evidence["evidence_snippet"], F.lit('"'))
    noted = F.when(F.size(flags) > 0, F.concat(F.lit(f"- {labels[8]}: "), F.array_join(flags, ", ")))
    return F.concat_ws("\n", head, *lines, quoted, noted)


def validation_label(v: Column, language: str = "en") -> Column:
    """What a reader is told about a validation (see citations.validation)."""
    percent = F.round(v["coverage"] * 100).cast("long").cast("string")
    valid, invalid, uncited = F.size(v["valid"]), F.size(v["invalid"]), v["uncited"]
    out_of_range = F.concat(F.lit("(^"), F.array_join(F.transform(v["invalid"], lambda n: n.cast("string")), ", ^"), F.lit(")"))
    s = lambda n: F.when(n > 1, "s").otherwise("")
    if language == "tr":
        good = F.concat(valid.cast("string"), F.lit(" atıf doğrulandı · kapsam %"), percent)
        parts = (F.when(invalid > 0, F.concat(invalid.cast("string"), F.lit(" geçersiz atıf "), out_of_range)), F.when(uncited > 0, F.concat(uncited.cast("string"), F.lit(" cümle kaynaksız"))), F.when(valid == 0, "geçerli atıf yok"))
        return F.when(v["ok"], good).otherwise(F.concat(F.lit("Doğrulama: "), F.concat_ws(" · ", *parts)))
    good = F.concat(valid.cast("string"), F.lit(" citations verified · "), percent, F.lit("% coverage"))
    parts = (F.when(invalid > 0, F.concat(invalid.cast("string"), F.lit(" invalid citation"), s(invalid), F.lit(" "), out_of_range)), F.when(uncited > 0, F.concat(uncited.cast("string"), F.lit(" uncited sentence"), s(uncited))), F.when(valid == 0, "no valid citations"))
    return F.when(v["ok"], good).otherwise(F.concat(F.lit("Check: "), F.concat_ws(" · ", *parts)))


def power_bytes(n: Column) -> Column:
    """Bytes by powers of 1,024 with up to two decimals, zeros at the end left out; nothing is shown for a unit beyond GB."""
    power = F.floor(F.ln(n.cast("double")) / F.ln(F.lit(1024.0)) + 1e-12).cast("int")
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", n / F.pow(F.lit(1024.0), power)), "(\\.\\d*?)0+\\z", "$1"), "\\.\\z", "")
    unit = F.coalesce(F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power), F.lit("undefined"))
    return F.when(n == 0, "0 B").otherwise(F.concat(shown, F.lit(" "), unit))


def risk(reply: Column) -> Column:
    """A judge's JSON reply as (detected, confidence, reason): not detected where it can't be read or confidence isn't in 0..1."""
    got = F.from_json(reply, "detected boolean, confidence double, reason string")
    sound = got["detected"].isNotNull() & got["confidence"].between(0.0, 1.0)
    return F.struct((sound & got["detected"]).alias("detected"), F.when(sound, got["confidence"]).otherwise(0.0).alias("confidence"), F.when(sound, got["reason"]).alias("reason"))
