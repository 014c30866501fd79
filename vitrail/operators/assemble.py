"""Assembly of summaries: identity, fields by section, rendering, edits, checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.functions.text import badge, percent
from vitrail.operators.spans import regex_spans
from vitrail.schemas import SECTIONS, STATES

TO_VALIDATE = 0.70
#: Titles and notices of the rendered summary.
TITLES = {
    "pathologies_actives": "Pathologies actives",
    "antecedents": "Antécédents médicaux et chirurgicaux",
    "allergies": "Allergies et intolérances",
    "traitements_long_cours": "Traitements au long cours",
    "facteurs_risque": "Facteurs de risque",
    "vaccinations": "Vaccinations",
    "points_vigilance": "Points de vigilance",
}
NOTICE = (
    "Document généré automatiquement à partir de documents scannés. Le contenu n'a PAS été vérifié médicalement : il doit être relu, "
    "corrigé si nécessaire et validé par un médecin avant tout usage clinique."
)
#: Identity fields of the first two headings, and their confidences.
PATIENT_FIELDS = {"identite": "Identité", "date_naissance": "Date de naissance", "sexe": "Sexe", "ins": "INS / NIR"}
DOCTOR_FIELDS = {"medecin": "Identité", "rpps": "RPPS", "adeli": "ADELI"}
TOKEN_CONFIDENCE, SEX_CONFIDENCE = 1.0, 0.9
TOKEN = r"\[(PATIENT|DATE_NAISSANCE|NIR|INS|RPPS|ADELI)_\d{3}\]"
SEX = r"(?iuU)\bsexe\s*:?\s*([HMF]|[Mm]asculin|[Ff][ée]minin)"


def identity(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """First pseudonym of each kind as identity fields, and the sex as H or F."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    tokens = regex_spans(t, TOKEN)

    def first(*kinds: str) -> Column:
        hit = F.filter(tokens, lambda s: F.regexp_extract(s["value"], r"^\[([A-Z_]+)_\d+\]$", 1).isin(*kinds))
        return F.get(hit, F.lit(0))["value"]

    raw = F.upper(F.left(F.regexp_extract(t, SEX, 1), F.lit(1)))
    return docs.select(
        "document_id", first("PATIENT").alias("identite"), first("DATE_NAISSANCE").alias("date_naissance"), first("NIR", "INS").alias("ins"),
        first("RPPS").alias("rpps"), first("ADELI").alias("adeli"), F.when(raw.isin("H", "M"), "H").when(raw == "F", "F").alias("sexe"),
    )


def assemble(fields: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per document: sections as map<section, array<field>> in canonical
    order of keys, mean confidence by section, state and notice.

    fields: document_id, section, ord, valeur, confiance and whatever else."""
    extra = [c for c in fields.columns if c not in ("document_id", "section", "ord")]
    f = fields.withColumn("a_valider", F.col("confiance") < TO_VALIDATE)
    item = F.struct("ord", *extra, "a_valider")
    by = f.groupBy("document_id", "section").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.round(F.avg("confiance"), 3).alias("completude")
    )
    agg = [F.coalesce(F.max(F.when(F.col("section") == s, F.col("items"))), F.array().cast(by.schema["items"].dataType)).alias(s) for s in SECTIONS]
    full = [F.coalesce(F.max(F.when(F.col("section") == s, F.col("completude"))), F.lit(0.0)).alias(f"completude_{s}") for s in SECTIONS]
    out = by.groupBy("document_id").agg(*agg, *full)
    if documents is not None:
        out = documents.select("document_id").join(out, "document_id", "left")
        empty = {s: F.array().cast(by.schema["items"].dataType) for s in SECTIONS}
        for s in SECTIONS:
            out = out.withColumn(s, F.coalesce(s, empty[s])).withColumn(f"completude_{s}", F.coalesce(f"completude_{s}", F.lit(0.0)))
    return out.withColumn("statut", F.lit("a_valider")).withColumn("avertissement", F.lit(NOTICE))


def violations(vsm: DataFrame) -> DataFrame:
    """Rows (document_id, violation) against the summary's contract."""
    checks = [F.when(~F.col("statut").isin(*STATES) | F.col("statut").isNull(), F.lit("statut"))]
    for s in SECTIONS:
        checks.append(F.when(F.col(s).isNull(), F.lit(f"{s}: absent")))
        bad = F.exists(s, lambda x: x["confiance"].isNull() | (x["confiance"] < 0) | (x["confiance"] > 1))
        checks.append(F.when(bad, F.lit(f"{s}: confiance")))
        checks.append(F.when(F.exists(s, lambda x: x["valeur"].isNull()), F.lit(f"{s}: valeur")))
    return vsm.select("document_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def _identity_lines(vsm: DataFrame, fields: dict[str, str], line) -> Column:
    """Texts line(title, value, confidence) of the identity fields that are there."""
    have = [c for c in fields if c in vsm.columns]
    rows = [F.when(F.col(c).isNotNull(), line(fields[c], F.col(c), F.lit(SEX_CONFIDENCE if c == "sexe" else TOKEN_CONFIDENCE))) for c in have]
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<string>")


def _or_empty(vsm: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in vsm.columns else F.lit("")


def _signed(vsm: DataFrame, signed: Column, blank: str) -> Column:
    return F.when(F.col("signe_par").isNotNull(), signed).otherwise(blank) if "signe_par" in vsm.columns else F.lit(blank)


def markdown(vsm: DataFrame) -> DataFrame:
    """(document_id, markdown): nine headings (the patient, the doctor, and the
    sections), a line per field, and the signature.

    Uses, where the columns are there: the fields of `identity`, date_generation,
    and signe_par, date_signature and empreinte_vsm (see `sign`)."""
    has = set(vsm.schema[SECTIONS[0]].dataType.elementType.names)

    def line(x: Column) -> Column:
        code = mention = F.lit("")
        if "code_normalise" in has:
            c = x["code_normalise"]
            code = F.coalesce(F.concat(F.lit(" — **"), c["systeme"], F.lit(" "), c["code"], F.lit("** ("), c["libelle_officiel"], F.lit(")")), F.lit(""))
        if "mention_contexte" in has:
            mention = F.coalesce(F.concat(F.lit(" — *"), x["mention_contexte"], F.lit("*")), F.lit(""))
        return F.concat(F.lit("- "), x["valeur"], code, mention, F.lit(" · "), badge(x["confiance"], x["a_valider"]))

    def known(fields: dict[str, str], missing: str) -> Column:
        lines = _identity_lines(vsm, fields, lambda title, v, c: F.concat(F.lit(f"- **{title} :** "), v, F.lit(" · "), badge(c, c < TO_VALIDATE)))
        return F.when(F.size(lines) == 0, missing).otherwise(F.array_join(lines, "\n"))

    when = F.concat(F.lit("*Généré le "), _or_empty(vsm, "date_generation"), F.lit(" — statut : "), F.col("statut"), F.lit("*"))
    blocks = [
        F.lit("# Volet de Synthèse Médicale (VSM)"), when, F.concat(F.lit("> "), F.col("avertissement")),
        F.concat(F.lit("## 1. Identification du patient\n"), known(PATIENT_FIELDS, "_Non renseignée (mode strict ou document non identifié)._")),
        F.concat(F.lit("## 2. Médecin traitant\n"), known(DOCTOR_FIELDS, "_Non renseigné._")),
    ]
    for i, s in enumerate(SECTIONS, 3):
        head = F.concat(F.lit(f"## {i}. {TITLES[s]}  `complétude "), percent(F.col(f"completude_{s}")), F.lit("`"))
        body = F.when(F.size(s) == 0, F.lit("_Aucune information extraite — section à compléter manuellement._")).otherwise(F.array_join(F.transform(s, line), "\n"))
        blocks.append(F.concat(head, F.lit("\n"), body))
    if "signe_par" in vsm.columns:
        by = F.concat(F.lit("**Signé par** "), F.col("signe_par"), F.lit(" le "), _or_empty(vsm, "date_signature"), F.lit(" — empreinte `"), F.left(_or_empty(vsm, "empreinte_vsm"), F.lit(16)), F.lit("…`"))
    else:
        by = F.lit("")
    blocks += [F.lit("---"), _signed(vsm, by, "**Signature du médecin :** ____________________    Date : ____ / ____ / ________")]
    return vsm.select("document_id", F.concat_ws("\n\n", *blocks).alias("markdown"))


STYLE = "body{font-family:sans-serif;max-width:50rem;margin:2rem auto}.check{background:#fdecea}.none,.share{color:#666}"


def _escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html(vsm: DataFrame) -> DataFrame:
    """(document_id, html): the same content as `markdown`, as a page; all values are escaped."""
    has = set(vsm.schema[SECTIONS[0]].dataType.elementType.names)
    e, lit = _escaped, F.lit

    def line(x: Column) -> Column:
        code = mention = source = lit("")
        if "code_normalise" in has:
            c = x["code_normalise"]
            code = F.when(c.isNotNull(), F.concat(lit(" <span class='code'>"), e(c["systeme"]), lit(" "), e(c["code"]), lit(" — "), e(c["libelle_officiel"]), lit("</span>"))).otherwise("")
        if "mention_contexte" in has:
            mention = F.when(x["mention_contexte"].isNotNull(), F.concat(lit(" <em>("), e(x["mention_contexte"]), lit(")</em>"))).otherwise("")
        if "passage" in has:
            source = e(x["passage"])
        tag = F.when(x["a_valider"], "<li class='check' title='Source : ").otherwise("<li title='Source : ")
        return F.concat(tag, source, lit("'>"), e(x["valeur"]), code, mention, lit(" · "), badge(x["confiance"], x["a_valider"]), lit("</li>"))

    def block(title: Column, lines: Column, missing: str) -> Column:
        listed = F.when(F.size(lines) == 0, f"<p class='none'>{missing}</p>").otherwise(F.concat(lit("<ul>"), F.array_join(lines, ""), lit("</ul>")))
        return F.concat(lit("<section><h2>"), title, lit("</h2>"), listed, lit("</section>"))

    def known(fields: dict[str, str]) -> Column:
        return _identity_lines(vsm, fields, lambda title, v, c: F.concat(lit(f"<li><strong>{title} :</strong> "), e(v), lit(" · "), badge(c, c < TO_VALIDATE), lit("</li>")))

    parts = [
        lit(f"<!doctype html><html lang='fr'><head><meta charset='utf-8'><title>Volet de Synthèse Médicale</title><style>{STYLE}</style></head><body>"),
        lit("<h1>Volet de Synthèse Médicale (VSM)</h1><p>Généré le "), e(_or_empty(vsm, "date_generation")), lit(" — statut : "), e(F.col("statut")), lit("</p><p class='check'>"),
        e(F.col("avertissement")), lit("</p>"), block(lit("1. Identification du patient"), known(PATIENT_FIELDS), "Non renseigné."),
        block(lit("2. Médecin traitant"), known(DOCTOR_FIELDS), "Non renseigné."),
    ]
    for i, s in enumerate(SECTIONS, 3):
        title = F.concat(lit(f"{i}. {TITLES[s]} <span class='share'>complétude "), percent(F.col(f"completude_{s}")), lit("</span>"))
        parts.append(block(title, F.transform(s, line), "Aucune information extraite — à compléter manuellement."))
    if "signe_par" in vsm.columns:
        by = F.concat(lit("<p><strong>Signé par "), e(F.col("signe_par")), lit("</strong> le "), e(_or_empty(vsm, "date_signature")), lit(" — empreinte <code>"), e(F.left(_or_empty(vsm, "empreinte_vsm"), lit(16))), lit("…</code></p>"))
    else:
        by = lit("")
    parts += [_signed(vsm, by, "<p><strong>Signature du médecin :</strong> ____________________ Date : ____ / ____ / ________</p>"), lit("</body></html>")]
    return vsm.select("document_id", F.concat(*parts).alias("html"))


def sign(vsm: DataFrame, by: str, when: str) -> DataFrame:
    """Signed: the state, who and when, and the fingerprint of what was signed."""
    return fingerprint(vsm, "empreinte_vsm").withColumn("signe_par", F.lit(by)).withColumn("date_signature", F.lit(when)).withColumn("statut", F.lit("signe"))


def edit(vsm: DataFrame, section: str, ord_: int, value: str | None = None) -> DataFrame:
    """An edited or confirmed field has confidence 1 and needs no validation."""
    changed = lambda x: F.when(
        x["ord"] == ord_,
        x.withField("confiance", F.lit(1.0)).withField("a_valider", F.lit(False)).withField("valeur", F.lit(value) if value is not None else x["valeur"]),
    ).otherwise(x)
    return vsm.withColumn(section, F.transform(section, changed))


def delete_item(vsm: DataFrame, section: str, ord_: int) -> DataFrame:
    return vsm.withColumn(section, F.filter(section, lambda x: x["ord"] != ord_))


def fingerprint(vsm: DataFrame, out: str = "empreinte") -> DataFrame:
    """SHA-256 of the sections as JSON with sorted keys and ASCII escapes; that
    form is Python's, hence an Arrow-batched function."""
    import hashlib
    import json


    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.sha256(json.dumps(json.loads(x), sort_keys=True).encode()).hexdigest())

    return vsm.withColumn(out, digest(F.to_json(F.struct(*SECTIONS))))


def search(vsm: DataFrame, words: str) -> DataFrame:
    """Case-insensitive substring of id and state."""
    return vsm.where(F.lower(F.concat_ws(" ", "document_id", "statut")).contains(words.lower()))


def assign_candidates(fields: DataFrame, candidates: DataFrame, cutoff: float = 60.0) -> DataFrame:
    """Greedy one-to-one assignment within a (document, section): each field in
    order takes the best unused candidate at or above the cutoff.

    fields, candidates: document_id, section, ord, valeur."""

    from vitrail.functions.fuzzy import token_set_ratio

    both = fields.withColumn("kind", F.lit(0)).unionByName(candidates.withColumn("kind", F.lit(1)))

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        left, right = (g[g["kind"] == k].sort_values("ord") for k in (0, 1))
        used, rows = set(), []
        for _, f in left.iterrows():
            best, score = None, 0.0
            for _, c in right.iterrows():
                s = token_set_ratio(f["valeur"] or "", c["valeur"] or "") if c["ord"] not in used else 0.0
                if s > score:
                    best, score = c, s
            if best is not None and score >= cutoff:
                used.add(best["ord"])
                rows.append((f["document_id"], f["section"], f["ord"], best["ord"], best["valeur"], score))
        return pd.DataFrame(rows, columns=["document_id", "section", "ord", "candidate", "valeur", "score"])

    cols = ["document_id", "section", "ord", "valeur", "kind"]
    return both.select(*cols).groupBy("document_id", "section").applyInPandas(
        assign, "document_id string, section string, ord int, candidate int, valeur string, score double"
    )
