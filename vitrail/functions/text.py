"""Text functions as Column expressions: no UDF, all inside the plan."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrail.functions import terminology as T


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose into one ASCII letter and marks, by rule."""
    src, dst = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1 and base.isascii():
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()


def in_words(c: Column, text: str) -> Column:
    return c.isin(*T.words(text))


def strip_accents(c: Column) -> Column:
    """Letters without marks; ligatures stay, as they do not decompose."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), ACCENTED, PLAIN)


def fold_ligatures(c: Column) -> Column:
    out = strip_accents(c)
    for a, b in (("Œ", "OE"), ("œ", "oe"), ("Æ", "AE"), ("æ", "ae")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize(c: Column) -> Column:
    """Without accents, lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"(?U)\s+", " "))


def flatten(c: Column) -> Column:
    """As `normalize`, with punctuation as spaces."""
    plain = F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.lower(plain), r"(?U)\s+", " "))


def alnum_words(c: Column) -> Column:
    """Everything but a-z and 0-9 as one space."""
    return F.regexp_replace(c, "[^a-z0-9]+", " ")


def alnum_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, "[^a-z0-9]+"), lambda t: t != "")


def code_tokens(c: Column) -> Column:
    """Distinct tokens, a plural s dropped from four letters on."""
    return F.array_distinct(
        F.transform(
            alnum_tokens(normalize(c)),
            lambda t: F.when((F.length(t) >= 4) & t.endswith("s"), F.left(t, F.length(t) - 1)).otherwise(t),
        )
    )


def content_tokens(normalized: Column) -> Column:
    """Tokens of two characters or more that are no stop words, in order."""
    return F.filter(alnum_tokens(normalized), lambda t: (F.length(t) >= 2) & ~in_words(t, T.DEDUP_STOP_WORDS))


def label_core(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)", " ")


def label_aliases(c: Column) -> Column:
    groups = F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "/"))), F.trim), lambda a: a != "")


DOSE = r"(?iu)(\d+[.,]?\d*)\s*(mg|g|µg|ug|ml|ui|%)"
FREQUENCY = r"(?iu)(matin et soir|matin|soir|midi|par jour|/j|x\s?\d|fois par jour|par semaine|a jeun|à jeun)"


def dosage(c: Column) -> Column:
    """First dose and first frequency, or null without either."""
    parts = [F.nullif(F.regexp_extract(c, rx, 0), F.lit("")) for rx in (DOSE, FREQUENCY)]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def apply_case(original: Column, corrected: Column) -> Column:
    """The corrected word in the original's case: upper, capitalised or as is."""
    has_letter = F.upper(original) != F.lower(original)
    first = F.left(original, F.lit(1))
    return (
        F.when(has_letter & (F.upper(original) == original), F.upper(corrected))
        .when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.left(corrected, F.lit(1))), F.lower(F.substring(corrected, 2, 1 << 20))))
        .otherwise(corrected)
    )


def strip_markers(c: Column) -> Column:
    """Lines without detector tags and bracketed boxes; blank lines go."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"<\|/?det\|>|\[[^\]]*\]", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_trailing(c: Column, characters: str = " .,;:") -> Column:
    return F.rtrim(c, F.lit(characters))


def atc_parents(code: Column) -> Column:
    """Prefixes at the ATC levels above, nearest first."""
    return F.filter(F.array(*(F.when(F.length(code) > n, F.left(code, F.lit(n))) for n in (5, 4, 3, 1))), lambda x: x.isNotNull())


def icd10_parents(code: Column) -> Column:
    return F.when(code.contains("."), F.array(F.left(code, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def badge(confidence: Column, to_validate: Column) -> Column:
    return F.when(to_validate, F.concat(F.lit("⚠ À valider ("), percent(confidence), F.lit(")"))).otherwise(
        F.concat(F.lit("✓ "), percent(confidence))
    )


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 16)


def document_key(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 12))


EDGE = " .;:-•\t"


def items(c: Column) -> Column:
    """Sentences and lines, trimmed of punctuation, three characters or more."""
    parts = F.transform(F.split(c, r"(?<=[.;])\s+|\n"), lambda x: F.btrim(x, F.lit(EDGE)))
    return F.filter(parts, lambda x: F.length(x) >= 3)


def redact_log(c: Column) -> Column:
    """Identifiers in log lines as their kind."""
    rules = (
        (r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", "[NIR]"),
        (r"\b0[1-9](?:[\s.\-]?\d{2}){4}\b", "[TEL]"),
        (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[EMAIL]"),
        (r"\b10\d{9}\b", "[RPPS]"),
        (r"\b\d{9}\b", "[NUM9]"),
        (r"\[(?:PATIENT|NIR|INS|RPPS|ADELI|TEL|EMAIL|ADRESSE|DATE_NAISSANCE|DATE_DECES|DOSSIER|SEJOUR)_\d{3}\]", "[TOKEN]"),
    )
    for rx, kind in rules:
        c = F.regexp_replace(c, rx, kind)
    return c


def repaired_json(buffer: Column, schema: str) -> Column:
    """Parses JSON, or the longest prefix of it that known closers complete."""
    b = F.rtrim(F.trim(buffer), F.lit(", \t\r\n"))
    fenced = F.regexp_replace(F.trim(buffer), r"(?m)^```(?:json)?\s*|\s*```$", "")
    sliced = F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    odd = (F.length(b) - F.length(F.replace(b, F.lit('"'), F.lit("")))) % 2 == 1
    whole = F.regexp_extract(b, r"(?s)^(.*\}), \{", 1)
    tries = [buffer, fenced, sliced, *(F.concat(b, F.lit(x)) for x in ("]}]}", "]}]", "]}")), F.when(odd, F.concat(b, F.lit('"}]}'))), F.concat(whole, F.lit("]}"))]
    valid = [F.when(F.get_json_object(t, "$").isNotNull() & F.try_parse_json(t).isNotNull(), t) for t in tries]
    return F.from_json(F.coalesce(*valid), schema)
