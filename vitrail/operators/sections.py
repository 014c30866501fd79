"""Sections, scored items and the free-text fallback.

Every extractor is a DataFrame of candidate rows (document_id, valeur, section,
confiance, passage, offset_debut, offset_fin); offsets are absolute positions
in the document, taken from the match itself, never looked up by content.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import terminology as T
from vitrail.functions.fuzzy import token_set_ratio
from vitrail.functions.text import DOSE, EDGE, in_words, normalize
from vitrail.operators.pii import line_of
from vitrail.operators.spans import let, regex_spans, running, sub

#: Section headings.
HEADINGS = {
    "antecedents": r"ANT[ÉE]C[ÉE]DENTS?",
    "allergies": r"ALLERGIES?",
    "traitements_long_cours": r"TRAITEMENTS?(?:\s+(?:EN\s+COURS|LONG\s+COURS|DE\s+SORTIE))?|ORDONNANCE",
    "vaccinations": r"VACCINATIONS?|VACCINS?",
    "pathologies_actives": r"PATHOLOGIES?\s+ACTIVES?|MOTIF|DIAGNOSTICS?",
    "facteurs_risque": r"FACTEURS?\s+DE\s+RISQUE",
    "points_vigilance": r"POINTS?\s+DE\s+VIGILANCE|PR[ÉE]CAUTIONS?",
}
CLOSING = r"(?iumU)^\s*(?:CONCLUSIONS?|OBSERVATIONS?)\b"
NO_ALLERGY = r"(?iuU)aucune?\s+allergie|pas\s+d'?allergie|sans\s+allergie"
NO_ALLERGY_FREE = r"(?iuU)(?:aucune|pas\s+d'?|sans)\s+allergie"
CONCLUSION = r"(?iumU)^\s*CONCLUSIONS?\b"
CONCLUSION_NOISE = r"(?iuU)^\s*(\d|page\b|le\s+\d|docteur\b|m[ée]decin\b|cp/?bp\b|signature\b)"
HISTORY_MARK = r"(?iuU)(?:dans\s+ses\s+ant[ée]c[ée]dents\s+on\s+note|ant[ée]c[ée]dents?\s*[:;]|sur\s+le\s+plan\s+[a-zà-ÿ]+)"
ALLERGY_FREE = (
    r"(?iuU)(?:allergie(?:s)?\s*(?:[àa]|aux|à la|à l'|:)?\s*|allergique\s+[àa]\s+)([A-Za-zÀ-ÿ'\-]+(?:\s+[A-Za-zÀ-ÿ'\-]+){0,3})"
)
ALLERGY_VOID = ("connue", "inconnue", "aucune", "aucunes", "pas", "médicamenteuse", "medicamenteuse", "alimentaire")
RISK_FREE = r"(?iuU)\b(?:tabagisme|tabac|alcool|ob[ée]sit[ée]|surpoids|s[ée]dentarit[ée]|dyslipid[ée]mie)\w*\b"
DRUG_FREE = r"(?iuU)(?:traitement\s+(?:par|:)\s*|trait[ée]e?\s+par\s+)([A-Za-zÀ-ÿ'\-]+(?:[ \t]+[A-Za-zÀ-ÿ'\-]+){0,2})"
LAB_LINE = r"(?iuU)(?:/L|/100|mmol|µmol|T[ée]ra|Giga|pg/mL|ng/mL|UI/L|%|g/100mL)"
PAST = r"(?iuU)ant[ée]c[ée]dent|historique|depuis|en\s+(?:19|20)\d{2}"
VACCINE_LINE = r"(?iu)vaccin|rappel"
YEAR = r"\b(?:19|20)\d{2}\b"

KEYS = ["document_id", "valeur", "section", "confiance", "passage", "offset_debut", "offset_fin"]


def _head(body: str) -> str:
    return rf"(?iumU)^\s*(?:{body})\s*:?\s*"


def section_zones(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(document_id, section, debut, fin, texte): a heading opens a zone that the next
    heading or a closing line ends.  Where two headings match at one place,
    the first in the table counts."""
    text = F.col(text_col)
    kinds = [*((k, _head(v)) for k, v in HEADINGS.items()), (None, CLOSING)]
    marks = F.concat(
        *(
            F.transform(regex_spans(text, rx), lambda s: F.struct(s["start"].alias("at"), F.lit(i).alias("rank"), s["end"].alias("open"), F.lit(k).cast("string").alias("section")))
            for i, (k, rx) in enumerate(kinds)
        )
    )
    rows = docs.where(text.isNotNull()).select("document_id", text.alias("_t"), F.explode(marks).alias("m"))
    rows = rows.select("document_id", "_t", "m.*").withColumn("n", F.row_number().over(Window.partitionBy("document_id", "at").orderBy("rank"))).where("n = 1")
    w = Window.partitionBy("document_id").orderBy("at")
    ends = rows.withColumn("fin", F.coalesce(F.lead("at").over(w), F.length("_t")))
    return ends.where("section is not null").select(
        "document_id", "section", F.col("open").alias("debut"), "fin", sub(F.col("_t"), F.col("open"), F.col("fin") - F.col("open")).alias("texte")
    )


def item_spans(chunk: Column) -> Column:
    """Items of a text with their own offsets in it (of the trimmed item)."""
    parts = F.split(chunk, r"(?<=[.;])\s+|\n", -1)
    gaps = F.concat(F.regexp_extract_all(chunk, F.lit(r"(?<=[.;])\s+|\n"), F.lit(0)), F.array(F.lit("")))

    def placed(p: Column) -> Column:
        ends = running(F.zip_with(p, gaps, lambda x, g: F.length(x) + F.length(g)))
        item = lambda x, i, e: F.struct(
            (F.when(i == 0, 0).otherwise(F.get(e, i - 1)) + F.length(x) - F.length(F.ltrim(x, F.lit(EDGE)))).cast("int").alias("start"),
            F.btrim(x, F.lit(EDGE)).alias("value"),
        )
        return let(ends, lambda e: F.transform(p, lambda x, i: item(x, i, e)))

    return F.filter(let(parts, placed), lambda s: F.length(s["value"]) >= 3)


def _rows(df: DataFrame, value: Column, section: Column | str, confidence: Column | float, start: Column) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "document_id", value.alias("valeur"), col(section).alias("section"), col(confidence).cast("double").alias("confiance"),
        F.left(value, F.lit(120)).alias("passage"), start.cast("int").alias("offset_debut"), (start + F.length(value)).cast("int").alias("offset_fin"),
    )


def scored_items(zones: DataFrame) -> DataFrame:
    """Rule-based entities: the items of each zone with their confidence."""
    it = zones.select("document_id", "section", "debut", F.explode(item_spans(F.col("texte"))).alias("i"))
    v = F.col("i.value")
    base = (
        F.when(F.col("section") == "traitements_long_cours", F.when(v.rlike(DOSE), 0.88).otherwise(0.6))
        .when((F.col("section") == "allergies") & v.rlike(NO_ALLERGY), 0.9)
        .otherwise(0.8)
    )
    conf = F.greatest(F.least(base - F.when(F.length(v) < 8, 0.15).otherwise(0.0), F.lit(1.0)), F.lit(0.0))
    out = _rows(it, v, F.col("section"), conf, F.col("debut") + F.col("i.start"))
    return out.withColumn("passage", F.col("valeur"))


def _lines(docs: DataFrame) -> DataFrame:
    """(document_id, line, at): all lines with their own offsets."""
    w = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    split = docs.where("text is not null").select("document_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return split.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int"))


def _trimmed(line: Column, at: Column, characters: str) -> tuple[Column, Column]:
    clean = F.btrim(line, F.lit(characters))
    return clean, at + F.length(line) - F.length(F.ltrim(line, F.lit(characters)))


def free_conclusions(docs: DataFrame) -> DataFrame:
    """The first four items after each conclusion line, without noise."""
    t = F.col("text")
    m = docs.select("document_id", "text", F.explode(regex_spans(t, CONCLUSION)).alias("m"))
    tail = sub(t, F.col("m.end"), F.length(t))
    it = m.select("document_id", F.col("m.end").alias("at"), F.explode(F.slice(item_spans(tail), 1, 4)).alias("i"))
    it = it.where((F.length("i.value") >= 4) & ~F.col("i.value").rlike(CONCLUSION_NOISE))
    return _rows(it, F.col("i.value"), "points_vigilance", 0.75, F.col("at") + F.col("i.start"))


def free_history(docs: DataFrame) -> DataFrame:
    """Items after a history marker, up to the next one or 250 characters."""
    t = F.col("text")
    m = docs.select("document_id", F.col("text"), F.posexplode(regex_spans(t, HISTORY_MARK)).alias("n", "m"))
    nxt = F.lead("m.start").over(Window.partitionBy("document_id").orderBy("n"))
    m = m.withColumn("until", F.coalesce(nxt, F.least(F.length(t), F.col("m.end") + 250)))
    it = m.select("document_id", F.col("m.end").alias("at"), F.explode(item_spans(sub(t, F.col("m.end"), F.col("until") - F.col("m.end")))).alias("i"))
    it = it.where(~F.lower("i.value").isin("ras", "rass", "rien"))
    return _rows(it, F.col("i.value"), "antecedents", 0.6, F.col("at") + F.col("i.start"))


def _drug_keys() -> list[str]:
    import unicodedata

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
    return sorted({plain(x) for _, label, dci in T.rows(T.ATC) for x in (dci, label)}, key=lambda x: (-len(x), x))


def free_drugs(docs: DataFrame) -> DataFrame:
    """Names after « traitement par », and lines with a known substance."""
    t = F.col("text")
    m = docs.select("document_id", F.explode(regex_spans(t, DRUG_FREE, 1)).alias("m"))
    kept = F.filter(F.split("m.value", r"\s+"), lambda w: ~in_words(F.lower(w), T.DRUG_STOP_WORDS))
    named = F.btrim(F.array_join(kept, " "), F.lit(" .;:"))
    first = _rows(m.where(F.length(named) >= 3), named, "traitements_long_cours", 0.55, F.col("m.start"))
    lines = _lines(docs).where(~F.col("line").rlike(LAB_LINE) & (F.length(F.trim("line")) >= 4))
    hit = normalize(F.col("line")).rlike("|".join(re.escape(k) for k in _drug_keys()))  # the line is normalised once
    clean, at = _trimmed(F.col("line"), F.col("at"), EDGE)
    second = _rows(lines.where(hit), clean, "traitements_long_cours", F.when(F.col("line").rlike(DOSE), 0.7).otherwise(0.55), at)
    return first.unionByName(second)


def free_allergies(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    inner = regex_spans(t, ALLERGY_FREE, 1)
    whole = regex_spans(t, ALLERGY_FREE)
    m = docs.select("document_id", "text", F.explode(F.arrays_zip(inner.alias("g"), whole.alias("w"))).alias("m"))
    lo = F.greatest(F.col("m.w.start") - 30, F.lit(0))
    window = sub(t, lo, F.col("m.w.end") + 15 - lo)
    v = F.btrim(F.col("m.g.value"), F.lit(" .;:"))
    m = m.where(~window.rlike(NO_ALLERGY_FREE) & ~F.lower(v).isin(*ALLERGY_VOID) & (F.length(v) >= 2))
    return _rows(m, v, "allergies", 0.8, F.col("m.g.start"))


def free_risks(docs: DataFrame) -> DataFrame:
    """The whole line around a risk word, if it is of a plausible length."""
    t = F.col("text")
    m = docs.select("document_id", "text", F.explode(regex_spans(t, RISK_FREE)).alias("m"))
    phrase = F.btrim(line_of(t, F.col("m")), F.lit(EDGE))
    head = F.length(F.element_at(F.split(sub(t, F.lit(0), F.col("m.start")), "\n"), -1))
    m = m.withColumn("p", phrase).withColumn("at", F.col("m.start") - head).where((F.length("p") > 3) & (F.length("p") < 120))
    return _rows(m, F.col("p"), "facteurs_risque", 0.65, F.col("at"))


def free_diagnoses(docs: DataFrame) -> DataFrame:
    """Short lines close to a code label (token-set ratio of 80 or more).  Distinct
    lines are scored once, against a table of fixed size."""
    import unicodedata

    labels = sorted({" ".join(x.split()) for _, x in T.rows(T.ICD10)})
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
    line = F.trim("line")
    lines = _lines(docs).where((F.length(line) > 3) & (F.length(line) < 60) & ~line.rlike(LAB_LINE))
    forms = lines.select(normalize(F.col("line")).alias("form")).distinct()

    def close_forms(batches):
        known = [bare(x) for x in labels]
        for batch in batches:
            yield batch[[any(token_set_ratio(f, k) >= 80 for k in known) for f in batch["form"]]]

    close = forms.mapInPandas(close_forms, "form string").withColumnRenamed("form", "_form")
    hit = lines.join(close, normalize(F.col("line")) == F.col("_form"))
    clean, at = _trimmed(F.col("line"), F.col("at"), " \t\r")
    section = F.when(line.rlike(PAST), "antecedents").otherwise("pathologies_actives")
    return _rows(hit, clean, section, 0.55, at)


def free_vaccinations(docs: DataFrame) -> DataFrame:
    clean, at = _trimmed(F.col("line"), F.col("at"), EDGE)
    hit = _lines(docs).where(F.lower("line").rlike(VACCINE_LINE) & F.col("line").rlike(YEAR) & (F.length(clean) > 3) & (F.length(clean) < 80))
    return _rows(hit, clean, "vaccinations", 0.6, at)


FALLBACKS = (
    ("points_vigilance", free_conclusions), ("antecedents", free_history), ("antecedents+pathologies_actives", free_diagnoses),
    ("allergies", free_allergies), ("traitements_long_cours", free_drugs), ("facteurs_risque", free_risks), ("vaccinations", free_vaccinations),
)


def with_fallback(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds free-text entities for the sections a document has none of, without
    repeating a (value, section); the first extractor wins."""
    present = found.groupBy("document_id").agg(F.collect_set("section").alias("_have"))
    base = docs.select("document_id", "text").join(present, "document_id", "left")
    missing = lambda k: ~F.coalesce(F.array_contains("_have", k), F.lit(False))
    parts = []
    for rank, (gate, extract) in enumerate(FALLBACKS, 1):
        cond = reduce(lambda a, b: a | b, (missing(k) for k in gate.split("+")))
        parts.append(extract(base.where(cond).select("document_id", "text")).withColumn("_rank", F.lit(rank)))
    every = reduce(DataFrame.unionByName, parts, found.select(*KEYS).withColumn("_rank", F.lit(0)))
    w = Window.partitionBy("document_id", "section", F.lower(F.trim("valeur"))).orderBy("_rank", "offset_debut", "offset_fin")
    return every.withColumn("_n", F.row_number().over(w)).where("_rank = 0 or _n = 1").drop("_rank", "_n")


def extract_rules(docs: DataFrame) -> DataFrame:
    """Sections, scored items, then the free-text fallback."""
    return with_fallback(docs, scored_items(section_zones(docs)))
