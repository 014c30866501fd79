"""From (anonymised) pages to summaries, with every rejected value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrail.operators import assemble as A
from vitrail.operators import codes, dedup, lexical, pages as P, sections, segments as S, validate as V
from vitrail.operators import entities as E
from vitrail.operators.spans import sub

ENGINES = {"rules": "rules", "regles": "rules", "drbert": "ner", "ner": "ner", "encoder": "ner", "llm": "llm", "hybride": "llm"}
DEFAULT_ENGINE = "drbert"


def engine_of(name: str | None) -> str:
    """The engine that a setting names, in any case; the default for none or one that there is not."""
    return ENGINES.get((name or DEFAULT_ENGINE).lower(), ENGINES[DEFAULT_ENGINE])


FIELDS = ["document_id", "section", "valeur", "confiance", "passage", "offset_debut", "origine", "mention_contexte"]


@dataclass(frozen=True)
class Options:
    """Tunables, fixed on the driver and carried in closures."""

    engine: str = "rules"
    min_score: float = E.MIN_SCORE
    keep_tests: bool = False


def _held(df: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    """Kept, as it is used several times, and spilled to disk rather than recomputed."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held.append(out)
    return out


def entity_fields(
    docs: DataFrame, page_map: DataFrame, found: DataFrame, options: Options, held: list[DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, rejects, rejected pages) of entities (document_id, label, debut, fin,
    score): filters, pages, splitting, routing, validation, posology, and the
    guard that validates an entity whole if none of its parts survived."""
    text = docs.select("document_id", "text")
    e = E.stitch(found, docs).join(text, "document_id")
    e = e.withColumn("regle", E.entity_reject(F.col("text"), options.keep_tests, options.min_score))
    log = e.where("regle is not null").select("document_id", F.col("texte").alias("valeur"), "regle", F.lit("").alias("detail"), F.col("debut").alias("offset_debut"))
    e = _held(P.page_of(e.where("regle is null").drop("regle", "text"), page_map, "debut"), held)
    bad = P.rejected_pages(page_map, e)
    dropped = e.join(bad.select("document_id", "page", "motif"), ["document_id", "page"])
    log = log.unionByName(dropped.select("document_id", F.col("texte").alias("valeur"), F.lit("P1_page_non_prescriptive").alias("regle"), F.col("motif").alias("detail"), F.col("debut").alias("offset_debut")))
    e = P.off_rejected_pages(e, bad).withColumn("origin_id", F.xxhash64("document_id", "label", "debut", "fin"))

    def candidates(df: DataFrame) -> DataFrame:
        return E.routed(df, docs).join(text, "document_id").select(
            "document_id", "origin_id", "section", F.col("texte").alias("valeur"), F.col("texte").alias("passage"), F.col("debut").alias("offset_debut"), F.col("score").alias("confiance"), "text"
        )

    parts = e.withColumn("p", F.explode(E.split_joined(F.col("texte"), F.col("debut"))))
    parts = parts.withColumn("texte", F.col("p.value")).withColumn("debut", F.col("p.debut")).withColumn("fin", F.col("p.fin")).drop("p")
    kept, rejects = V.validate(_held(candidates(parts), held))
    kept = _held(kept, held)
    whole, lost = V.no_loss_guard(candidates(e), kept)
    kept = _held(kept.unionByName(whole), held)
    generic = kept.where(V.is_generic(F.col("valeur")))
    log = log.unionByName(rejects).unionByName(lost)
    log = log.unionByName(generic.select("document_id", "valeur", F.lit("P4_terme_generique").alias("regle"), F.lit("").alias("detail"), "offset_debut"))
    kept = kept.where(~V.is_generic(F.col("valeur"))).join(text, "document_id")
    end = F.when(F.col("section") == "traitements_long_cours", E.extended_end(F.col("text"), F.col("offset_debut") + F.length("valeur")))
    kept = kept.withColumn("valeur", F.coalesce(sub(F.col("text"), F.col("offset_debut"), end - F.col("offset_debut")), F.col("valeur")))
    return kept.withColumn("origine", F.lit("ner")).select(*FIELDS), log, bad


def rule_fields(docs: DataFrame) -> DataFrame:
    found = sections.extract_rules(docs).withColumn("origine", F.lit("regles")).withColumn("mention_contexte", F.lit(None).cast("string"))
    return found.select(*FIELDS)


def llm_fields(docs: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, rejects, report) of a model's answers (`segments.llm_answers`).

    Items are validated against the text and their values corrected; a segment
    that failed or gave nothing goes by the rules, and a document without any item goes by
    them whole.  Of equal values of a section the model's counts."""
    key = F.concat_ws("#", "document_id", F.col("seg").cast("string"))
    text = docs.select("document_id", "text")
    candidates = S.llm_items(answers, docs).withColumn("valeur", F.trim("valeur"))
    kept, rejects = V.validate(candidates)
    kept = lexical.correct(kept.withColumn("_row", F.xxhash64("document_id", "valeur")), "valeur", "_row")  # equal values are corrected alike
    kept = kept.withColumn("passage", F.when(F.col("niveau") > 0, F.col("passage")).otherwise("")).withColumn("origine", F.lit("llm")).select(*FIELDS)
    with_items = kept.select("document_id").distinct()
    bare = answers.where(F.col("failed") | (F.size("items") == 0))
    parts = bare.join(with_items, "document_id", "left_semi").select(key.alias("document_id"), "text", F.col("document_id").alias("of"))
    by_segment = rule_fields(parts.select("document_id", "text")).join(parts.select("document_id", "of"), "document_id").drop("document_id")
    located = by_segment.withColumnRenamed("of", "document_id").join(text, "document_id")
    at = F.call_function("locate", F.col("valeur"), F.col("text")) - 1  # a segment's own offsets are not the document's
    by_segment = located.withColumn("offset_debut", F.greatest(at, F.lit(0))).select(*FIELDS)
    whole = rule_fields(text.join(with_items, "document_id", "left_anti"))
    seen = kept.select(F.col("document_id").alias("_d"), F.col("section").alias("_s"), F.lower(F.trim("valeur")).alias("_v")).distinct()
    same = (F.col("document_id") == F.col("_d")) & (F.col("section") == F.col("_s")) & (F.lower(F.trim("valeur")) == F.col("_v"))
    added = by_segment.join(seen, same, "left_anti").dropDuplicates(["document_id", "section", "valeur"])
    counts = answers.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("failed").alias("echecs"), F.count_if(F.col("failed") | (F.size("items") == 0)).alias("par_regles")
    )
    state = F.when(F.col("_has").isNull(), "repli_regles").when(F.coalesce("par_regles", F.lit(0)) == 0, "llm_complet").otherwise("llm_partiel")
    report = text.select("document_id").join(counts, "document_id", "left").join(with_items.withColumn("_has", F.lit(True)), "document_id", "left")
    return kept.unionByName(added).unionByName(whole), rejects, report.withColumn("statut", state).drop("_has")


def summarize(pages: DataFrame, options: Options = Options(), provider: Callable | None = None) -> dict[str, DataFrame]:
    """pages: document_id, page, text (anonymised; null for a failed page).

    Tables: vsm (a row per document, with identity), fields (deduplicated), rejects, rejected_pages,
    report (of the language model).  What is used several times is persisted: call `release` when done."""
    docs, page_map, held = P.joined_text(pages), P.page_map(pages), []
    engine, report = engine_of(options.engine), None
    if engine != "rules" and provider is None:
        raise ValueError("this engine needs a provider")
    if engine == "llm":
        answers = _held(S.llm_answers(docs, provider), held)  # a model is asked once
        fields, rejects, report = llm_fields(docs, answers)
        bad = None
    elif engine == "ner":
        fields, rejects, bad = entity_fields(docs, page_map, E.with_provider(docs, provider), options, held)
    else:
        fields, rejects, bad = rule_fields(docs), None, None
    located = _held(P.page_of(fields, page_map, "offset_debut"), held)
    headers = P.repeated_headers(located, page_map)
    coded = codes.attach_codes(P.without_headers(located, headers))
    w = Window.partitionBy("document_id", "section").orderBy("offset_debut", "valeur")
    coded = _held(coded.withColumn("ord", F.row_number().over(w)).withColumn("code", F.col("code_normalise.code")), held)
    unique = dedup.deduplicate(coded)
    extra = coded.select("document_id", "section", "ord", "code_normalise", "dosage", "mention_contexte", "offset_debut", "origine")
    unique = _held(unique.join(extra, ["document_id", "section", "ord"]), held)
    shown = ["valeur", "confiance", "code_normalise", "mention_contexte", "occurrences", "pages", "passages", "lateralite_divergente", "dosage", "origine"]
    vsm = A.assemble(unique.select("document_id", "section", "ord", *shown), docs)
    vsm = vsm.join(A.identity(docs), "document_id")
    repeated = headers.select("document_id", F.col("forme").alias("valeur"), F.lit("P6_entete_repete").alias("regle"), F.col("pages").cast("string").alias("detail"), F.lit(None).cast("int").alias("offset_debut"))
    return {"vsm": vsm, "fields": unique, "rejects": repeated if rejects is None else rejects.unionByName(repeated), "rejected_pages": bad, "report": report, "held": held}


def release(result: dict[str, DataFrame]) -> None:
    """Frees what `summarize` keeps, once its tables are written."""
    for df in result["held"]:
        df.unpersist()
