"""Personal identifiers: detection, strict redaction, pseudonyms, audit rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import terminology as T
from vitrail.functions.text import in_words, short_hash, strip_accents
from vitrail.operators.spans import keep_best, let, line_spans, regex_spans, replace_spans, replace_values, running, sub

SPAN = (
    "struct<pii_type:string,start:int,end:int,value:string,confidence:double,method:string,context:string,seq:int>"
)

#: Fixed values: (type, pattern, group, confidence), in detection order.
PATTERNS = (
    ("INS", r"(?iuU)(?:INS(?:-NIR)?\s*:?\s*)(\d[\d\s]{12,20}\d)", 1, 0.97),
    ("NIR", r"(?U)\b[12]\s?\d{2}\s?(?:0[1-9]|1[0-2])\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}(?:\s?\d{2})?\b", 0, 0.95),
    ("RPPS", r"(?iuU)(?:RPPS\s*:?\s*)(\d{11})\b", 1, 0.98),
    ("RPPS", r"(?U)\b10\d{9}\b", 0, 0.70),
    ("ADELI", r"(?iuU)(?:ADELI\s*:?\s*)(\d{9})\b", 1, 0.95),
    ("FINESS", r"(?iuU)(?:FINESS\s*:?\s*)(\d{9})\b", 1, 0.95),
    ("TELEPHONE", r"(?U)\b0[1-9](?:[\s.\-]?\d{2}){4}\b", 0, 0.90),
    ("EMAIL", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.]+\b", 0, 0.97),
    (
        "ADRESSE",
        r"(?iuU)\b\d{1,4}\s?(?:bis|ter)?,?\s+(?:rue|avenue|av\.?|boulevard|bd|impasse|all[ée]e|chemin|place|quai)\s+[A-Za-zÀ-ÿ'’\- ]{3,60}",
        0,
        0.80,
    ),
    ("ADRESSE", r"(?U)\b\d{5}\s+[A-ZÀ-Ý][A-Za-zÀ-ÿ\-']{2,30}\b", 0, 0.60),
    (
        "NUMERO_DOSSIER",
        r"(?iuU)(?:(?:demande|dossier)\s+n[°o.]?|n[°o.]?\s*(?:de\s*)?(?:dossier|demande))\s*:?\s*([A-Z0-9\-]{4,15})",
        1,
        0.90,
    ),
    ("NUMERO_SEJOUR", r"(?iuU)(?:n[°o.]?\s*(?:de\s*)?s[ée]jour\s*:?\s*)([A-Z0-9\-]{4,15})", 1, 0.90),
)
FREE_OF_DIGITS = ("EMAIL", "NUMERO_DOSSIER", "NUMERO_SEJOUR")  # those that may have no digit
DATE = r"(?U)\b(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)?\d{2}\b"
BIRTH_CUE = r"(?iuU)(?:\bn[ée]\(?e?\)?\s+le\b|\bddn\b|\bdon\b|\bnaissance\b|\bnetssance\b)\s*:?\s*"
DEATH_CUE = r"(?iuU)\bd[ée]c[ée]d[ée]\(?e?\)?\s+le\b"
TITLED_NAME = (
    r"(?U)\b((?iu:patient(?:e)?|nom|pr[ée]nom|madame|monsieur|mme|mlle|m\.|mr|m|b[ée]n[ée]ficiaire|dr|docteur|pr|professeur))"
    r"[ \t]*:?[ \t]+([A-ZÀ-Ý]{2,}[A-ZÀ-Ý\-]*(?:[ \t]+[A-ZÀ-Ý][a-zà-ÿ'\-]+){1,3}"
    r"|[A-ZÀ-Ý][a-zà-ÿ'\-]+(?:[ \t]+[A-ZÀ-Ý][A-Za-zà-ÿ'\-]+){0,3})"
)
FIRST_LAST = r"(?U)\b[A-ZÀ-Ý][a-zà-ÿ\-]+\s+[A-ZÀ-Ý]{2,}[A-ZÀ-Ý\-]*\b"
IDENTITY_LINE = r"(?iuU)\b(?:nom|pr[ée]nom|b[ée]n[ée]ficiaire|b[ée]nef|concernant|patient(?:e)?|examen|demande)\b"
CAPITALS_NAME = r"(?<![A-ZÀ-Ý\-])[A-ZÀ-Ý]{2,}[A-ZÀ-Ý\-]*[ \t]+[A-ZÀ-Ý][a-zà-ÿ'\-]+(?:\-[A-ZÀ-Ý][a-zà-ÿ'\-]+)?"


def _span(kind: Column | str, s: Column, confidence: Column | float, method: str, context: Column | str, seq: int) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(kind).alias("pii_type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        as_col(confidence).cast("double").alias("confidence"), F.lit(method).alias("method"), as_col(context).alias("context"),
        F.lit(seq).alias("seq"),
    )


def line_of(text: Column, s: Column) -> Column:
    """The line a span lies in (or the lines, if it has a line break)."""
    before = F.element_at(F.split(sub(text, F.lit(0), s["start"]), "\n"), -1)
    after = F.element_at(F.split(sub(text, s["end"], F.length(text)), "\n"), 1)
    return F.concat(before, s["value"], after)


def before(lines: Column, row: Column, start: Column, width: int) -> Column:
    """The `width` characters before a place in a line; a line break is one of them."""
    i = row["i"]
    above = F.array_join(F.slice(lines, F.greatest(i - width + 1, F.lit(1)), F.least(i, F.lit(width))), "\n")
    return F.right(F.concat(F.when(i > 0, F.concat(above, F.lit("\n"))).otherwise(""), F.left(row["line"], start)), F.lit(width))


def pattern_spans(text: Column) -> list[Column]:
    """Identifiers by pattern, and dates."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(seq: int, kind: str, rx: str, group: int, confidence: float) -> Column:
        return F.transform(regex_spans(text, rx, group), lambda s: _span(kind, s, confidence, "regex", "", seq))

    every = list(enumerate(PATTERNS))
    # what must hold a digit is not looked for in a text without one
    numbers = F.concat(*(of(seq, *p) for seq, p in every if p[0] not in FREE_OF_DIGITS))
    others = [of(seq, *p) for seq, p in every if p[0] in FREE_OF_DIGITS]
    return [F.when(text.rlike(r"\p{Nd}"), F.concat(numbers, date_spans(text))).otherwise(none), *others]


def date_spans(text: Column) -> Column:
    """Dates with a birth cue in the 30 characters before or in the line, or a
    death cue before; other dates are no identifiers."""

    def dated(s: Column, inner: Column, row: Column, lines: Column) -> Column:
        window = before(lines, row, inner["start"], 30)
        kind = F.when(row["line"].rlike(BIRTH_CUE) | window.rlike(BIRTH_CUE), "DATE_NAISSANCE").when(window.rlike(DEATH_CUE), "DATE_DECES")
        return _span(kind, s, 0.95, "heuristique", "", 20)

    return F.filter(line_spans(text, DATE, None, dated), lambda s: s["pii_type"].isNotNull())


def _name_words(name: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(strip_accents(F.lower(name)), r"(?U)\s+", " ")), " ")


def _stopped(name: Column) -> Column:
    return F.exists(_name_words(name), lambda w: in_words(w, T.NAME_STOP_WORDS))


def titled_names(text: Column) -> Column:
    """Names after a title: in capitals, with a known first name, or after a
    title that only goes with names."""

    def span(whole: Column) -> Column:
        parts = F.struct(*(F.regexp_extract(whole["value"], TITLED_NAME, g).alias(n) for g, n in ((1, "title"), (2, "name"))))
        return let(parts, lambda p: named(whole, p["name"], p["title"]))

    def named(whole: Column, name: Column, title: Column) -> Column:
        known = F.exists(_name_words(name), lambda w: in_words(w, T.FIRST_NAMES))
        capitals = F.regexp_extract(name, r"^\S+", 0).rlike(r"^[A-ZÀ-Ý]{2,}[A-ZÀ-Ý\-]*$")
        strong = in_words(F.lower(title), T.STRONG_TITLES)
        confidence = F.when(_stopped(name), None).when(known, 0.95).when(capitals, 0.90).when(strong, 0.85)
        at = F.struct((whole["end"] - F.length(name)).alias("start"), whole["end"].alias("end"), name.alias("value"))
        return _span("NOM_PERSONNE", at, confidence, "heuristique", F.left(whole["value"], F.lit(20)), 30)

    return F.filter(F.transform(regex_spans(text, TITLED_NAME), span), lambda s: s["confidence"].isNotNull())


def dictionary_names(text: Column) -> Column:
    """A known first name before a name in capitals."""
    found = F.filter(
        regex_spans(text, FIRST_LAST),
        lambda s: in_words(strip_accents(F.lower(F.regexp_extract(s["value"], r"(?U)^[^\s]+", 0))), T.FIRST_NAMES),
    )
    return F.transform(found, lambda s: _span("NOM_PERSONNE", s, 0.90, "dictionnaire", "", 31))


def identity_line_names(text: Column) -> Column:
    """Capitals and a first name anywhere in a line that speaks of identity.
    Offsets are those in the document."""

    def named(s: Column, inner: Column, row: Column, lines: Column) -> Column:
        kept = ~_stopped(s["value"]) & (F.length(F.regexp_extract(s["value"], r"^[^ \t]+", 0)) >= 3)
        return F.when(kept, _span("NOM_PERSONNE", s, 0.85, "heuristique", F.left(row["line"], F.lit(20)), 32))

    found = F.filter(line_spans(text, CAPITALS_NAME, IDENTITY_LINE, named), lambda s: s.isNotNull())
    return F.when(text.rlike(IDENTITY_LINE), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def pii_spans(text: Column, *detectors: Callable[[Column], Column]) -> Column:
    """All detectors, then the best spans without overlaps; no UDF.  Further
    detectors map the text to an array of spans."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(*pattern_spans(t), titled_names(t), dictionary_names(t), identity_line_names(t), *(d(t) for d in detectors))
    return keep_best(found, SPAN)


PERSON_CONFIDENCE = 0.80  # fixed value


def person_spans(found: DataFrame) -> DataFrame:
    """(document_id, spans) of the persons that a name model gives (document_id,
    label, texte, debut, fin): those of label PER."""
    s = F.struct(F.col("debut").alias("start"), F.col("fin").alias("end"), F.col("texte").alias("value"))
    per = found.where(F.regexp_replace("label", "^[BI]-", "") == "PER")
    return per.groupBy("document_id").agg(F.collect_list(_span("NOM_PERSONNE", s, PERSON_CONFIDENCE, "ner", "", 40)).alias("spans"))


def with_pii(docs: DataFrame, text_col: str = "text", out: str = "pii", persons: DataFrame | None = None) -> DataFrame:
    """Adds the spans; `persons` (see `person_spans`) compete with the detectors' own."""
    if persons is None:
        return docs.withColumn(out, pii_spans(F.col(text_col)))
    added = docs.join(persons.select("document_id", F.col("spans").alias("_per")), "document_id", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return added.withColumn(out, pii_spans(F.col(text_col), lambda _: F.coalesce("_per", none))).drop("_per")


def redact(text: Column, spans: Column) -> Column:
    """Spans as [REDACTED:TYPE], then what is left of their values."""
    t = F.coalesce(text, F.lit(""))
    token = lambda s: F.concat(F.lit("[REDACTED:"), s["pii_type"], F.lit("]"))
    pairs = F.transform(spans, lambda s: F.struct(s["value"].alias("value"), token(s).alias("token")))
    return replace_values(replace_spans(t, spans, token), pairs)


def _prefix(kind: Column) -> Column:
    out = kind
    for k, v in T.TOKEN_PREFIX.items():
        if k != v:
            out = F.when(kind == k, v).otherwise(out)
    return out


def _key(s: Column) -> Column:
    return F.lower(F.trim(s["value"]))


def _numbered(prefix: Column, n: Column) -> Column:
    digits = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return F.concat(F.lit("["), prefix, F.lit("_"), digits, F.lit("]"))


def pseudonym_pairs(spans: Column) -> Column:
    """array<struct<start,end,value,token>>: numbers by type, in the order
    values first occur in the document; case and outer spaces do not count.

    By sorting: equal values meet, take their first place, and are numbered in the order of those."""

    def numbered(seen: Column) -> Column:  # (type, key, place), sorted
        new = lambda x, i: (i == 0) | (F.get(seen, i - 1)["t"] != x["t"]) | (F.get(seen, i - 1)["k"] != x["k"])
        head = running(F.transform(seen, lambda x, i: F.when(new(x, i), i).otherwise(0)), greatest=True)
        firsts = let(head, lambda h: F.transform(seen, lambda x, i: F.struct(x["t"].alias("t"), F.get(seen, F.get(h, i))["i"].alias("f"), x["i"].alias("i"))))
        return let(F.array_sort(firsts), counted)

    def counted(by_first: Column) -> Column:  # (type, first place, place), sorted
        prev = lambda i: F.get(by_first, i - 1)
        value = running(F.transform(by_first, lambda x, i: F.when((i == 0) | (prev(i)["t"] != x["t"]) | (prev(i)["f"] != x["f"]), 1).otherwise(0)))

        def from_type(v: Column) -> Column:
            base = running(F.transform(by_first, lambda x, i: F.when((i > 0) & (prev(i)["t"] != x["t"]), F.get(v, i - 1)).otherwise(0)), greatest=True)
            back = let(base, lambda b: F.array_sort(F.transform(by_first, lambda x, i: F.struct(x["i"].alias("i"), (F.get(v, i) - F.get(b, i)).alias("n")))))
            return F.transform(back, lambda x: x["n"])

        return let(value, from_type)

    seen = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["pii_type"].alias("t"), _key(s).alias("k"), i.alias("i"))))
    pair = lambda s, n: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _numbered(_prefix(s["pii_type"]), n).alias("token"))
    return F.zip_with(spans, let(seen, numbered), pair)


def token_map(pairs: Column) -> Column:
    """map<token,value>, by first occurrence; of several spellings the last in the document stays."""

    def ends(p: Column) -> Column:  # (token, place, value), sorted
        same = lambda x, i: F.coalesce(F.get(p, i)["t"] == x["t"], F.lit(False))
        firsts = F.filter(p, lambda x, i: (i == 0) | ~same(x, i - 1))
        lasts = F.filter(p, lambda x, i: ~same(x, i + 1))
        return F.array_sort(F.zip_with(firsts, lasts, lambda a, b: F.struct(a["i"].alias("i"), a["t"].alias("t"), b["v"].alias("v"))))

    ordered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["token"].alias("t"), i.alias("i"), p["value"].alias("v"))))
    return let(let(ordered, ends), lambda e: F.map_from_arrays(F.transform(e, lambda x: x["t"]), F.transform(e, lambda x: x["v"])))


def pseudonymize(text: Column, pairs: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    known = F.transform(F.map_entries(token_map(pairs)), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("token")))
    return replace_values(replace_spans(t, pairs, lambda p: p["token"]), known)


def depseudonymize(text: Column, mapping: Column) -> Column:
    return F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def anonymize(docs: DataFrame, mode: str = "pseudo", text_col: str = "text") -> DataFrame:
    """Replaces the text; `pseudo` adds pii_map (for the vault only), and either
    mode pii_count.  The raw text and the spans' values leave the row."""
    found = docs.withColumn("_pii", pii_spans(F.col(text_col))).withColumn("pii_count", F.size("_pii"))
    if mode == "strict":
        return found.withColumn(text_col, redact(F.col(text_col), F.col("_pii"))).drop("_pii")
    paired = found.withColumn("_pairs", pseudonym_pairs(F.col("_pii")))
    return (
        paired.withColumn("pii_map", token_map(F.col("_pairs")))
        .withColumn(text_col, pseudonymize(F.col(text_col), F.col("_pairs")))
        .drop("_pii", "_pairs")
    )


def dossier_tokens(spans: DataFrame, dossier: str = "dossier_id", order: tuple[str, ...] = ("document_id", "start")) -> DataFrame:
    """Token numbers across a dossier's documents: by first occurrence.

    spans: dossier, pii_type, value and the order columns.  One aggregation by
    key, then a window over the distinct values of a dossier and prefix."""
    keys = spans.select(dossier, _prefix(F.col("pii_type")).alias("prefix"), F.lower(F.trim("value")).alias("key"), F.struct(*order).alias("at"))
    first = keys.groupBy(dossier, "prefix", "key").agg(F.min("at").alias("at"))
    number = F.row_number().over(Window.partitionBy(dossier, "prefix").orderBy("at", "key"))
    return first.select(dossier, "prefix", "key", _numbered(F.col("prefix"), number).alias("token"))


def audit_entries(docs: DataFrame, spans: str = "pii", id_col: str = "document_id", action: str = "pseudonymize") -> DataFrame:
    """One row per span, with a hash in place of the value."""
    s = F.col("s")
    return docs.select(F.col(id_col), F.explode(spans).alias("s")).select(
        F.col(id_col).alias("document_id"), F.lit("pii_detected").alias("event"), s["pii_type"].alias("pii_type"),
        s["start"].alias("start"), s["end"].alias("end"), F.round(s["confidence"], 3).alias("confidence"), s["method"].alias("method"),
        short_hash(s["value"]).alias("value_hash"), F.lit(action).alias("action"),
    )


__all__ = ["anonymize", "audit_entries", "depseudonymize", "dossier_tokens", "let", "pii_spans", "pseudonymize", "redact", "with_pii"]
