"""Named rejection rules: the first failing rule names the reject; every
candidate is either kept or logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.functions import terminology as T
from vitrail.functions.text import normalize
from vitrail.operators import context as C
from vitrail.operators.entities import SHORT_COURSE, has_any
from vitrail.operators.sections import HEADINGS
from vitrail.operators.spans import let

DIAGNOSTIC = ("pathologies_actives", "antecedents", "facteurs_risque")
#: Shapes of values that are no list entries.
HEADING_ALONE = r"(?iuU)^(?:" + "|".join(HEADINGS.values()) + r")\s*:?$"
CUT_START = r"(?iuU)^(?:de|du|des|la|le|les|au|aux|à|et|ou|un|une|par|pour|sur|dans)\s|^(?:d|l)'"
CUT_END = (
    r"(?iuU)\s(?:de|du|des|d'|la|le|les|l'|et|ou|à|sans|avec|par|pour|sur|dans|en|intra|inter|supra|rétro|retro|péri|peri)\s*$|\s\+$"
)
ANTIBODY = r"(?U)anti[-\s]?[A-Z0-9]"
STATE_VERB = r"(?U)\s(?:est|sont|était|etaient|a été|a ete|ont été|ont ete|sera|seront)\s"
LAB_VALUE = r"(?iuU)\d+[,.]\d+\s*(g/?100\s*mL|%|g/dL|mmol|UI/L|µ)"
MEDICAL_ENDING = (
    r"(?:ites?|oses?|algies?|emies?|uries?|opathies?|omes?|plegies?|graphies?|scopies?|therapies?|cardies?|phagies?|pnees?|ectasies?|"
    r"orragies?|cytoses?|iases?|megalies?|celes?|olymphies?|trophies?|tomies?|otomies?|ectomies?|oplasties?|orrhaps?)$"
)


def is_generic(value: Column) -> Column:
    bare = F.trim(F.regexp_replace(normalize(value), r"(?U)[^\w\s]", " "))
    return (bare == "") | bare.isin(*T.GENERIC_VALUES)


def is_non_medical(value: Column) -> Column:
    """Fewer than two words of three letters and none of them medical."""
    words = F.filter(F.split(normalize(F.coalesce(value, F.lit(""))), " "), lambda w: F.length(w) >= 3)
    known = [*T.GENERIC_VALUES, *T.words(T.MEDICAL_ABBREVIATIONS), *T.words(T.MEDICAL_WORDS)]
    medical = F.exists(words, lambda w: w.isin(*known) | ((F.length(w) >= 6) & w.rlike(MEDICAL_ENDING)))
    return (F.size(words) == 0) | (~medical & (F.size(words) < 2))


def _reject(rule: str, detail: Column | str) -> Column:
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(F.lit(rule).alias("regle"), d.alias("detail"))


def verdict(text: Column, value: Column, passage: Column, section: Column, offset: Column, text_norm: Column | None = None) -> Column:
    """struct<rejet: struct<regle,detail>, section, mention>; rejet is null for
    what is kept, section is where it goes.  `text_norm` is the normalised
    text where the caller has it, once per document.

    Context decides before the rules on treatments and lab values, and a
    value that it re-routes or marks is not held against those."""
    norm = normalize(F.coalesce(text, F.lit(""))) if text_norm is None else F.coalesce(text_norm, F.lit(""))
    known = F.struct(
        F.trim(F.coalesce(value, F.lit(""))).alias("v"), F.trim(F.coalesce(passage, F.lit(""))).alias("p"), normalize(F.trim(F.coalesce(value, F.lit("")))).alias("low"),
        C.qualify(F.coalesce(text, F.lit("")), offset).alias("q"),
    )
    return let(known, lambda k: _verdict(norm, k["v"], k["p"], k["low"], k["q"], section))


def _verdict(norm: Column, v: Column, p: Column, low: Column, q: Column, section: Column) -> Column:
    letters = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    dots = F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))
    words = F.size(F.filter(F.split(v, r"(?U)\s+"), lambda w: w != ""))
    diagnostic, drug = section.isin(*DIAGNOSTIC), section == "traitements_long_cours"
    said = C.verdict(q)
    early = (
        F.when((p == "") | ~norm.contains(normalize(p)), _reject("validateur_ancrage", "passage introuvable dans le texte source"))
        .when((F.length(v) < 3) | (F.length(v) > 120) | (F.length(p) > 250) | (dots >= 2) | (words > 18),
              _reject("validateur_longueur", F.concat(F.length(v), F.lit(" car., "), words, F.lit(" mots"))))
        .when(v.rlike(r"\[[A-Z_]+_\d+\]"), _reject("validateur_pseudo", "jeton de pseudonymisation dans la valeur"))
        .when(has_any(low, T.BLOCKED_TERMS), _reject("validateur_blocklist", "terme non clinique"))
        .when(v.rlike(HEADING_ALONE), _reject("validateur_entete_seule", "en-tête de rubrique seul"))
        .when((letters < 3) | (letters / F.greatest(F.length(v), F.lit(1)) < 0.45) | low.isin(*T.EMPTY_LABELS), _reject("validateur_fragments", "fragment sans sens clinique"))
        .when(v.rlike(CUT_START) | v.rlike(CUT_END), _reject("validateur_fragment_tronque", "découpe tronquée"))
        .when(v.rlike(STATE_VERB), _reject("validateur_phrase", "phrase de compte rendu"))
        .when(diagnostic & v.rlike(ANTIBODY), _reject("validateur_dosage_anticorps", "dosage d'auto-anticorps"))
        .when(diagnostic & is_non_medical(v), _reject("validateur_non_medical", "terme isolé hors vocabulaire médical"))
        .when(said == "niee", _reject("N1_entite_niee", C.mention(q)))
    )
    late = (
        F.when(drug & low.isin(*T.DRUG_CLASSES), _reject("validateur_classe_seule", "famille de médicaments seule"))
        .when(drug & (low.contains(" et ") | v.contains("/")), _reject("validateur_traitement_compose", "plusieurs traitements en une valeur"))
        .when(drug & ~v.rlike(r"[A-Za-zÀ-ÿ]{4,}"), _reject("validateur_mot_court", "aucun mot de 4 lettres"))
        .when((section == "points_vigilance") & v.rlike(LAB_VALUE), _reject("validateur_bio", "valeur biologique chiffrée"))
    )
    rejet = F.when(early.isNotNull(), early).when(said == "aucun", late)
    target = (
        F.when(said == "familial", "facteurs_risque").when(said == "hypothetique", "points_vigilance")
        .when((said == "aucun") & drug & p.rlike(SHORT_COURSE), "points_vigilance").otherwise(section)
    )
    return F.struct(rejet.alias("rejet"), target.alias("section"), C.mention(q).alias("mention"))


def judged(candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """Candidates with their verdict `_v`: struct<rejet,section,mention>."""
    norm = F.col("text_norm") if "text_norm" in candidates.columns else None
    v = verdict(F.col(text_col), F.col("valeur"), F.col("passage"), F.col("section"), F.col("offset_debut"), norm)
    return candidates.withColumn("_v", v).drop("text_norm")


def validate(candidates: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept, rejects) of candidates with their document's text (and text_norm, if
    they have it); kept + rejects = input."""
    c = judged(candidates, text_col)
    kept = (
        c.where("_v.rejet is null").withColumn("section", F.col("_v.section")).withColumn("mention_contexte", F.col("_v.mention"))
        .withColumn("valeur", F.trim("valeur")).drop("_v", text_col)
    )
    rejects = c.where("_v.rejet is not null").select(
        "document_id", F.trim("valeur").alias("valeur"), F.col("_v.rejet.regle").alias("regle"), F.col("_v.rejet.detail").alias("detail"), "offset_debut"
    )
    return kept, rejects


def no_loss_guard(originals: DataFrame, fragments_kept: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Originals none of whose fragments survived are validated whole.  Both have origin_id."""
    lost = originals.join(fragments_kept.select("origin_id").distinct(), "origin_id", "left_anti")
    return validate(lost, text_col)


def reject_histogram(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("regle").agg(F.count(F.lit(1)).alias("n"))
