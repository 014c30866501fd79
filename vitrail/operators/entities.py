"""Named entities: token decoding, stitching, filters, as-of titles, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import terminology as T
from vitrail.functions.text import normalize
from vitrail.operators.sections import HEADINGS, _head
from vitrail.operators.spans import regex_spans, sub

MIN_SCORE = 0.70
CONTEXT = 120
PSEUDONYM = r"\[[A-Z_]+_\d+\]"
#: Routing vocabulary.
ALLERGY = r"(?iu)allergi|intol[ée]ran"
VACCINE = r"(?iu)vaccin"
SHORT_COURSE = r"(?iuU)\b(cure|pendant|pour)(?:\s+de)?\s+\d+\s*(jours?|semaines?)|\b\d+\s*(jours|semaines)\s+de\s+traitement"
HISTORY = r"(?iuU)ant[ée]c[ée]dent|chirurgical|op[ée]r[ée]|notion\s+de|\ben\s+(?:19|20)\d{2}\b"
DRUG_CLASS = r"(?iu)cortico[ïi]d|contico[ïi]d|corticoth[ée]rap|cortisone|prednisone|prednisolone|m[ée]thylprednisolone"
RISK = (
    r"(?iuU)tabac|tabagi|fumeur|\bfume\w*|paquet[s]?[-\s]ann[ée]e|alcool|[ée]thyli|ob[ée]s|surpoids|\bimc\b|s[ée]dentar|activit[ée]\s+physique|"
    r"toxicoman|stup[ée]fiant|exposition\s+professionnelle|amiante|silice|h[ée]r[ée]di|ant[ée]c[ée]dents?\s+familiaux|m[ée]nopause|contraception"
)
POSOLOGY = (
    r"(?iuU)^(?:[\s,:]*(?:\d+(?:[.,]\d+)?\s*(?:mg|g[ée]l(?:ules?)?|gcl|gouttes?|sachets?|comprim[ée]s?|bouff[ée]es?|amp|ui|µg|ml|cp|g)"
    r"|x\s*\d+|\d+\s*(?:fois|/)\s*(?:j|jour|24h)|matin|midi|soir|coucher|par jour|/j\b|en permanence|\d+\s*/\s*\d+))+"
)
POSOLOGY_LIMIT = 60
JOINED = r"([a-zà-ÿ]{3,}|(?<![A-ZÀ-Þ])[A-ZÀ-Þ]{2,5})\s+(?=[A-ZÀ-Þ][a-zà-ÿ]{3})"


def decode_bio(tokens: DataFrame, key: str = "document_id", order: str = "start", window: str | None = None) -> DataFrame:
    """Entities from token labels: a mention starts where the type changes, or at
    a B- label past the end so far; tokens without type end it.  Islands by a
    running sum over one sort; `window` is an optional column of separate windows."""
    part = [key, *([window] if window else [])]
    w = Window.partitionBy(*part).orderBy(order, "end")
    t = tokens.where("start < end").withColumn("_prev", F.lag("type").over(w)).withColumn("_pend", F.lag("end").over(w))
    new = F.col("type").isNotNull() & (
        F.col("_prev").isNull() | (F.col("_prev") != F.col("type")) | (F.col("is_b") & (F.col("start") >= F.col("_pend")))
    )
    t = t.withColumn("_n", F.sum(new.cast("int")).over(w)).where("type is not null")
    return t.groupBy(*part, "_n").agg(
        F.first("type").alias("label"), F.min("start").cast("int").alias("debut"), F.max("end").cast("int").alias("fin"), F.avg("score").alias("score")
    ).drop("_n")


def group_labels(words: DataFrame, key: str = "document_id", order: str = "i") -> DataFrame:
    """Runs of words with one label (B-/I- ignored): text, label, first and last index."""
    w = Window.partitionBy(key).orderBy(order)
    tag = F.when(~F.coalesce(F.col("label"), F.lit("O")).isin("O", ""), F.regexp_replace("label", r"^[^-]*-", ""))
    t = words.withColumn("_tag", tag).withColumn("_prev", F.lag("_tag").over(w))
    t = t.withColumn("_n", F.sum((F.col("_tag").isNotNull() & ~F.col("_tag").eqNullSafe(F.col("_prev"))).cast("int")).over(w)).where("_tag is not null")
    return t.groupBy(key, "_n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda x: x["word"]), " ").alias("text"),
        F.first("_tag").alias("label"), F.min(order).alias("start"), (F.max(order) + 1).alias("end"),
    ).drop("_n")


def merge_subwords(pieces: DataFrame, key: str = "document_id") -> DataFrame:
    """Pieces of a word id as one word: joined text, first label, best score."""
    p = pieces.where("word_id is not null and start < end")
    return p.groupBy(key, "word_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: F.replace(x["piece"], F.lit("▁"), F.lit(""))), "").alias("word"),
        F.min_by("label", "start").alias("label"), F.max("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"),
    )


def stitch(entities: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Joins mentions of one label that windows cut: overlapping, or at most two
    blanks apart; contained ones go.  The score is folded by length.

    entities: document_id, label, debut, fin, score.  A document's mentions of a
    label are folded in one array: document-sized, whatever the corpus."""
    one = "struct<debut:int,fin:int,score:double>"
    g = entities.groupBy("document_id", "label").agg(
        F.array_sort(F.collect_list(F.struct(F.col("debut").cast("int").alias("debut"), F.col("fin").cast("int").alias("fin"), F.col("score").cast("double").alias("score")))).alias("e")
    )
    g = g.join(docs.select("document_id", F.col(text_col).alias("_t")), "document_id")

    def fold(out: Column, e: Column) -> Column:
        last = F.element_at(out, -1)
        gap = e["debut"] - last["fin"]
        glued = (gap <= 0) | ((gap <= 2) & F.col("_t").isNotNull() & (F.trim(F.regexp_replace(sub(F.col("_t"), last["fin"], gap), r"(?U)\s", "")) == ""))
        a, b = last["fin"] - last["debut"], e["fin"] - e["debut"]
        joined = F.struct(last["debut"].alias("debut"), e["fin"].alias("fin"), ((last["score"] * a + e["score"] * b) / (a + b)).alias("score"))
        grown = F.when(e["fin"] <= last["fin"], out).when(glued, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(e)))
        return F.when(F.size(out) == 0, F.array(e)).otherwise(grown)

    merged = F.aggregate("e", F.array().cast(f"array<{one}>"), fold)
    rows = g.select("document_id", "label", "_t", F.explode(merged).alias("m"))
    return rows.select("document_id", "label", sub(F.col("_t"), F.col("m.debut"), F.col("m.fin") - F.col("m.debut")).alias("texte"), "m.debut", "m.fin", "m.score")


def entity_reject(text: Column, keep_tests: bool = False, min_score: float = MIN_SCORE) -> Column:
    """Name of the first filter an entity (label, debut, fin, score) fails, or null."""
    letter = r"(?U)[\p{L}\p{N}]"
    prev, nxt = sub(text, F.col("debut") - 1, F.lit(1)), sub(text, F.col("fin"), F.lit(1))
    inside = F.exists(regex_spans(text, PSEUDONYM), lambda s: (s["start"] < F.col("fin")) & (F.col("debut") < s["end"]))
    out = F.when(F.col("score") < min_score, "extracteur_score").when(
        ((F.col("debut") > 0) & prev.rlike(letter)) | nxt.rlike(letter), "extracteur_bord_mot"
    )
    if not keep_tests:
        out = out.when(F.col("label") == "test", "extracteur_label_test")
    return out.when(inside, "extracteur_anonymisation")


def titles(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(document_id, at, titre) of all section headings."""
    marks = F.concat(
        *(F.transform(regex_spans(F.col(text_col), _head(v)), lambda s: F.struct(s["start"].alias("at"), F.lit(k).alias("titre"))) for k, v in HEADINGS.items())
    )
    return docs.where(F.col(text_col).isNotNull()).select("document_id", F.explode(marks).alias("m")).select("document_id", "m.at", "m.titre")


def with_last_title(entities: DataFrame, headings: DataFrame) -> DataFrame:
    """As-of join: the last heading at or before each entity, and its position.
    One union and one window; no row of either side meets all of the other."""
    e = entities.withColumn("_at", F.col("debut")).withColumn("_kind", F.lit(1))
    h = headings.select("document_id", F.col("at").alias("_at"), F.lit(0).alias("_kind"), F.struct("titre", F.col("at").alias("at")).alias("_h"))
    w = Window.partitionBy("document_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = e.unionByName(h, allowMissingColumns=True).withColumn("_h", F.last("_h", ignorenulls=True).over(w)).where("_kind = 1")
    return both.withColumn("titre", F.col("_h.titre")).withColumn("titre_at", F.col("_h.at")).drop("_at", "_kind", "_h")


def has_any(normalized: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | normalized.contains(t)
    return out


def is_act(value: Column) -> Column:
    n = normalize(value)
    return has_any(n, T.ACT_ENDINGS) | has_any(n, T.ACT_WORDS)


def is_support(value: Column) -> Column:
    return has_any(normalize(value), T.SUPPORT_WORDS)


def is_risk(value: Column) -> Column:
    return value.rlike(RISK)


def route(label: Column, context: Column, title: Column, value: Column) -> Column:
    """Section of an entity: safety first, then what the entity itself is,
    then where it stands."""
    c, v, t = (F.coalesce(x, F.lit("")) for x in (context, value, title))
    past = (t == "antecedents") | c.rlike(HISTORY)
    treatment = (
        F.when(c.rlike(ALLERGY), "allergies").when(c.rlike(VACCINE), "vaccinations").when(is_support(v), "points_vigilance")
        .when(is_act(v), "antecedents").when(past, "antecedents").when(c.rlike(SHORT_COURSE), "points_vigilance").otherwise("traitements_long_cours")
    )
    problem = (
        F.when(c.rlike(ALLERGY), "allergies").when(past, "antecedents").when(v.rlike(DRUG_CLASS), "traitements_long_cours")
        .when((t == "facteurs_risque") | is_risk(v), "facteurs_risque").otherwise("pathologies_actives")
    )
    return F.when(label == "treatment", treatment).when(label == "problem", problem).when(label == "test", "points_vigilance").otherwise("pathologies_actives")


def routed(entities: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds section: context is 120 characters back, never past the current title."""
    e = with_last_title(entities, titles(docs, text_col)).join(docs.select("document_id", F.col(text_col).alias("_t")), "document_id")
    lo = F.greatest(F.coalesce("titre_at", F.lit(0)), F.col("debut") - CONTEXT)
    context = sub(F.col("_t"), lo, F.col("fin") - lo)
    return e.withColumn("section", route(F.col("label"), context, F.col("titre"), F.col("texte"))).drop("_t", "titre_at")


def extended_end(text: Column, end: Column) -> Column:
    """End of the entity with the posology that follows, at most 60 characters on."""
    tail = sub(text, end, F.lit(2 * POSOLOGY_LIMIT))
    return (end + F.least(F.length(F.regexp_extract(tail, POSOLOGY, 0)), F.lit(POSOLOGY_LIMIT))).cast("int")


def split_joined(value: Column, start: Column) -> Column:
    """array<struct<value,debut,fin>>: parts of an entity that ran two list items
    together; parts under three characters go."""
    cuts = F.transform(
        F.arrays_zip(regex_spans(value, JOINED).alias("w"), F.regexp_extract_all(value, F.lit(JOINED), F.lit(1)).alias("g")),
        lambda c: F.struct((c["w"]["start"] + F.length(c["g"])).alias("a"), c["w"]["end"].alias("b")),
    )
    edges_from = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["b"]))
    edges_to = F.concat(F.transform(cuts, lambda c: c["a"]), F.array(F.length(value)))
    parts = F.transform(
        F.arrays_zip(edges_from.alias("a"), edges_to.alias("b")),
        lambda p: F.struct(sub(value, p["a"], p["b"] - p["a"]).alias("value"), (start + p["a"]).cast("int").alias("debut"), (start + p["b"]).cast("int").alias("fin")),
    )
    return F.when(value.rlike(JOINED), F.filter(parts, lambda p: F.length(F.trim(p["value"])) >= 3)).otherwise(parts)


def gazetteer(docs: DataFrame, terms: list[tuple[str, str, float]], text_col: str = "text") -> DataFrame:
    """Stand-in for a model: whole-word matches of (term, label, score), longest first."""
    alt = "|".join(sorted((_quote(t) for t, _, _ in terms), key=len, reverse=True))
    rx = rf"(?iuU)\b(?:{alt})\b"
    key = F.create_map(*(F.lit(x) for t, lab, s in terms for x in (t.lower(), f"{lab}|{s}")))
    m = docs.where(F.col(text_col).isNotNull()).select("document_id", F.explode(regex_spans(F.col(text_col), rx)).alias("s"))
    info = F.split(F.element_at(key, F.lower("s.value")), r"\|")
    return m.select(
        "document_id", info[0].alias("label"), F.col("s.value").alias("texte"), F.col("s.start").alias("debut"), F.col("s.end").alias("fin"), info[1].cast("double").alias("score")
    )


def _quote(t: str) -> str:
    import re

    return re.sub(r"([^\w\s])", r"\\\1", t)


def with_provider(docs: DataFrame, provider, text_col: str = "text") -> DataFrame:
    """Entities from a provider: a callable that is made once per worker and
    maps a text to (label, debut, fin, score) tuples."""

    def run(batches):
        import pandas as pd

        model = provider()
        for b in batches:
            rows = [(d, lab, t[a:e], a, e, s) for d, t in zip(b["document_id"], b["text"]) for lab, a, e, s in model(t or "")]
            yield pd.DataFrame(rows, columns=["document_id", "label", "texte", "debut", "fin", "score"])

    from vitrail.schemas import NER_ENTITY

    return docs.select("document_id", F.col(text_col).alias("text")).mapInPandas(run, NER_ENTITY)


def augment(base: DataFrame, extra: DataFrame, keys: tuple[str, ...] = ("document_id", "valeur", "section")) -> DataFrame:
    """base and the rows of extra whose key it does not have."""
    return base.unionByName(extra.join(base.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


#: The complement model's labels by section, and those it is not asked for.
COMPLEMENT_SECTIONS = {
    "Disease": "pathologies_actives", "Medication/Vaccine": "traitements_long_cours", "MedicalProcedure": "antecedents",
    "Symptom": "points_vigilance", "CW": "traitements_long_cours",
}
COMPLEMENT_IGNORED = ("AnatomicalStructure", "PROD", "GRP", "LOC", "ORG", "PER")


def complement_fields(found: DataFrame) -> DataFrame:
    """Fields of a complement model's entities (document_id, label, texte, debut, fin,
    score) whose label has a section; the others, ignored ones among them, go."""
    names = F.create_map(*(F.lit(x) for kv in COMPLEMENT_SECTIONS.items() for x in kv))
    rows = found.where(~F.col("label").isin(*COMPLEMENT_IGNORED)).withColumn("section", F.try_element_at(names, F.col("label")))
    return rows.where("section is not null").select(
        "document_id", "section", F.col("texte").alias("valeur"), F.col("score").alias("confiance"), F.col("texte").alias("passage"),
        F.col("debut").alias("offset_debut"), F.col("fin").alias("offset_fin"),
    )


WINDOW_TOKENS, STRIDE, SPECIAL_TOKENS = 512, 64, 2


def windows(n: int, size: int = WINDOW_TOKENS, stride: int = STRIDE, special: int = SPECIAL_TOKENS) -> list[tuple[int, int]]:
    """Token ranges of overlapping windows: `size` tokens with the special ones,
    `stride` shared by neighbours; the last one ends with the text."""
    room = size - special
    if not 0 <= stride < room:
        raise ValueError("a window must be longer than what it shares")
    out = [(0, min(n, room))]
    while out[-1][1] < n:
        a = out[-1][1] - stride
        out.append((a, min(n, a + room)))
    return out


def windowed_entities(docs: DataFrame, provider, size: int = WINDOW_TOKENS, stride: int = STRIDE, text_col: str = "text") -> DataFrame:
    """Entities (document_id, label, texte, debut, fin, score) of texts of any
    length from a token classifier: windows are labelled apart, decoded apart, and
    the mentions that a window's edge cut are stitched.

    provider() is made once per worker: (tokenize, label), where tokenize(text) gives the
    tokens' (start, end) and label(text, offsets) a (type or None, score, is_b) for each."""

    def run(batches):
        import pandas as pd

        tokenize, label = provider()
        for b in batches:
            rows = []
            for d, t in zip(b["document_id"], b["text"]):
                offsets = tokenize(t or "")
                for w, (a, e) in enumerate(windows(len(offsets), size, stride)):
                    part = offsets[a:e]
                    rows += [(d, w, x, y, *told) for (x, y), told in zip(part, label(t or "", part))]
            yield pd.DataFrame(rows, columns=["document_id", "window", "start", "end", "type", "score", "is_b"])

    tokens = docs.select("document_id", F.col(text_col).alias("text")).mapInPandas(
        run, "document_id string, window int, start int, end int, type string, score double, is_b boolean"
    )
    return stitch(decode_bio(tokens, window="window"), docs, text_col)
