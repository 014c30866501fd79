"""Qualification of an entity by its left context: negation, experiencer, modality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrail.operators.spans import let, sub

WIDTH = 100
#: Cue patterns.
SEPARATOR = r"(?U)[.;:\n\r]|\s{4,}"
NEGATED = r"(?iuU)\b(?:pas\s+d[''’‘]|pas\s+de|pas\s+[üu]e|absence\s+d[''’‘]|absence\s+de|aucune?\s|sans\s)"
WEAKLY_NEGATED = r"(?iuU)\b(?:n[ie]\s|n[''’‘]\s*y?\s*a\s+pas|ne\s+pr[ée]sente\s+pas|non\s+retrouv[ée]|[ée]limin[ée]|[ée]cart[ée]|infirm[ée]|exclu)"
FAMILY = (
    r"(?iuU)\b(ant[ée]c[ée]dents?\s+familiaux|familiaux?|dans\s+la\s+famille|h[ée]r[ée]ditaires?|son\s+p[èe]re|sa\s+m[èe]re|ses\s+parents|"
    r"son\s+fr[èe]re|sa\s+s[œoe]ur|c[ôo]t[ée]\s+paternel|c[ôo]t[ée]\s+maternel|chez\s+le\s+p[èe]re|chez\s+la\s+m[èe]re)\b"
)
HYPOTHETICAL = (
    r"(?iuU)\b(risques?\s+de|pr[ée]vention\s+de|[àa]\s+[ée]liminer|[àa]\s+rechercher|en\s+cas\s+de|suspicion\s+de|[ée]ventuelle?|possible|"
    r"probable|[àa]\s+confirmer|d[ée]pistage\s+de|surveillance\s+de|pr[ée]disposition|indication\s+de)\b"
)
SCOPE_BREAK = r"(?iuU)[,;]|\b(?:et|ou)\b|\bjusqu[''’”]?\s*[àa]\b"
ANAPHORA = r"(?iuU)\b(?:ce|cet|cette|son|sa|ses|leur|leurs)\s*$"


def left_context(text: Column, start: Column, width: int = WIDTH) -> Column:
    """Up to `width` characters before, cut at the last sentence boundary."""
    at = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    from_ = F.greatest(at - width, F.lit(0))
    return F.element_at(F.split(sub(text, from_, at - from_), SEPARATOR, -1), -1)


def qualify(text: Column, start: Column, width: int = WIDTH) -> Column:
    """struct of flags and a short trace.  A frank negation only counts if neither
    a comma or conjunction nor an anaphora stands between it and the entity."""

    def flags(c: Column) -> Column:
        after = F.element_at(F.split(c, NEGATED, -1), -1)
        frank = c.rlike(NEGATED) & ~after.rlike(SCOPE_BREAK) & ~c.rlike(ANAPHORA)
        return F.struct(
            frank.alias("nie_franche"), c.rlike(WEAKLY_NEGATED).alias("nie_faible"), c.rlike(FAMILY).alias("familial"),
            c.rlike(HYPOTHETICAL).alias("hypothetique"), F.right(F.trim(c), F.lit(60)).alias("contexte"),
        )

    return let(left_context(text, start, width), flags)


def verdict(q: Column) -> Column:
    """niee > familial > hypothetique > nuance > aucun."""
    return (
        F.when(q["nie_franche"], "niee").when(q["familial"], "familial").when(q["hypothetique"], "hypothetique")
        .when(q["nie_faible"], "nuance").otherwise("aucun")
    )


def mention(q: Column) -> Column:
    """The note shown to the reader; null when nothing qualifies the entity."""
    quoted = F.concat(F.lit("« "), F.trim(q["contexte"]), F.lit(" »"))
    return (
        F.when(q["nie_franche"], F.concat(F.lit("nié dans le document : "), quoted))
        .when(q["familial"], F.concat(F.lit("antécédent familial — contexte : "), quoted))
        .when(q["hypothetique"], F.concat(F.lit("à confirmer (mention hypothétique) — contexte : "), quoted))
        .when(q["nie_faible"], F.concat(F.lit("mention nuancée dans le document : "), quoted))
    )
