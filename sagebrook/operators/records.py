"""Label and literature records: mapping, duplicates, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, collapsed, without_tags
from .ordering import running_sum, sequence_within, with_parts

# Fields of a label in the order of its sections, with the names of these.
LABEL_FIELDS = {
    "indications_and_usage": "Indications and Usage", "dosage_and_administration": "Dosage and Administration", "contraindications": "Contraindications", "boxed_warning": "Boxed Warning",
    "warnings_and_cautions": "Warnings and Cautions", "warnings": "Warnings", "adverse_reactions": "Adverse Reactions", "drug_interactions": "Drug Interactions",
}
# Addresses of papers, and the source where a record names none.
DOI, PUBMED, ARTICLE, SOURCE = "https://doi.org/", "https://pubmed.ncbi.nlm.nih.gov/", "https://europepmc.org/article/", "MED"
SECTION_MOST, SECTION_LEAST, ABSTRACT_LEAST = 3000, 40, 40


def label_title(brands: Column, generics: Column, key: Column) -> Column:
    first = lambda a: F.nullif(F.try_element_at(a, F.lit(1)), F.lit(""))
    return F.coalesce(first(brands), first(generics), F.concat(F.lit("Drug "), F.nullif(key, F.lit(""))), F.lit("Unknown drug"))


def label_sections(rows: DataFrame, key: str, fields: dict[str, str] | list[str]) -> DataFrame:
    """key, section_no, section, text, start, end of the sections that hold enough, in the order of `fields` (columns, with shown names).

    A field is a text or an array of texts, joined by line breaks; labels without a section give no rows.

    Text is collapsed and cut to SECTION_MOST; sections under SECTION_LEAST are left out. start
    counts the sections before, with one character between.
    """
    names = fields if isinstance(fields, dict) else {f: f for f in fields}
    whole = lambda f: F.array_join(f, "\n") if rows.schema[f].dataType.typeName() == "array" else F.coalesce(F.col(f), F.lit(""))
    parts = F.filter(
        F.array(*[F.struct(F.lit(name).alias("section"), F.substring(collapsed(F.coalesce(whole(f), F.lit(""))), 1, SECTION_MOST).alias("text")) for f, name in names.items()]),
        lambda s: F.length(s["text"]) >= SECTION_LEAST,
    )
    lens = F.transform(F.col("_s"), lambda s: F.length(s["text"]) + 1)
    flat = rows.select(key, parts.alias("_s")).select(key, F.posexplode("_s").alias("section_no", "s"), lens.alias("_l"))
    start = F.aggregate(F.slice("_l", F.lit(1), F.col("section_no")), F.lit(0), lambda a, x: a + x)
    return flat.select(key, "section_no", "s.section", "s.text", start.alias("start"), (start + F.length("s.text")).alias("end"))


def mapped_papers(rows: DataFrame) -> DataFrame:
    """Papers from records with source, id, pmid, doi, title, abstract, journal and year.

    Tags and superfluous blanks go; papers without a title or with a short abstract are left out.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    source = F.coalesce("source", F.lit(SOURCE))
    named = F.coalesce(given("doi"), given("pmid"), F.concat(source, F.lit(":"), F.coalesce("id", F.substring(without_tags(F.col("title")), 1, 24))))
    url = F.coalesce(F.concat(F.lit(DOI), given("doi")), F.concat(F.lit(PUBMED), given("pmid"), F.lit("/")), F.concat(F.lit(ARTICLE), source, F.lit("/"), F.coalesce("id", F.lit(""))))
    out = rows.select("*", without_tags(F.col("title")).alias("_t"), without_tags(F.col("abstract")).alias("_a"))
    kept = out.where((F.col("_t") != "") & (F.length("_a") >= ABSTRACT_LEAST))
    return kept.select(named.alias("paper_id"), F.col("_t").alias("title"), F.col("_a").alias("abstract"), "journal", "year", url.alias("url"), "doi", "pmid", "position")


def distinct_papers(papers: DataFrame, most: int | None = None) -> DataFrame:
    """For each key (doi, else pmid, else normal title) the longest abstract, the first of equals, with first_position, where its key first appears.

    Winners are found among keys, lengths and positions, which must be unique; texts are joined
    back afterwards. Rows come in no order unless `most` keeps the first by first_position.
    """
    from ..functions.text import normal_title

    key = F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.nullif(F.col("pmid"), F.lit("")), normal_title(F.col("title")))
    best = papers.groupBy(key.alias("_key")).agg(F.min("position").alias("first_position"), F.max(F.struct(F.length("abstract").alias("n"), (-F.col("position")).alias("p"))).alias("_b"))
    won = best.select("first_position", (-F.col("_b.p")).alias("position"))
    if most:
        won = won.orderBy("first_position").limit(most)
    return papers.join(won, "position").drop("position")


def paper_chunk(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n\n", title, abstract)


def paper_section(journal: Column, year: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(journal, F.lit("")), F.nullif(year, F.lit(""))), F.lit(""))


def grouped_lines(items: DataFrame, group: str, order: list[str], y: str, text: str, gap: float = 2.0) -> DataFrame:
    """group, line_no, text: items whose y differs from the item before by more than `gap` begin a new line; blank lines are dropped.

    `order` begins with a timestamp. Hot groups are numbered in parts, see ordering.
    """
    columns = [F.col(c) for c in order]
    placed = sequence_within(with_parts(items, group, order[0]), group, columns, y)
    marked = placed.withColumn("_new", F.when(F.abs(F.col(y) - F.col("_before")) > gap, 1).otherwise(0))
    lined = running_sum(marked, group, columns, "_new", "line_no")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_x")))), lambda s: s["_x"])
    out = lined.groupBy(group, "line_no").agg(F.array_join(pieces, "").alias("text"))
    return out.where(F.length(F.regexp_replace("text", f"{WS}+", "")) > 0)
