"""Text functions, fuzzy kernel, spans and identifiers."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrail.functions import text as X
from vitrail.functions.fuzzy import edit_distance, extract_one, lcs_length, partial_ratio, ratio, token_set_ratio
from vitrail.operators import pii, spans

WORDS = st.text("abcdeéè -", max_size=14)


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first()[0]


@given(WORDS, WORDS)
@settings(max_examples=150, deadline=None)
def test_fuzzy_properties(a, b):
    for f in (ratio, token_set_ratio, partial_ratio):
        assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a))
    assert ratio(a, a) == 100


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(WORDS, WORDS)
@settings(max_examples=150, deadline=None)
def test_lcs_equals_the_plain_table(a, b):
    assert lcs_length(a, b) == _lcs(a, b)


@pytest.mark.parametrize(
    "f,a,b,want",
    [
        (ratio, "achilie", "achille", 85.7), (token_set_ratio, "ulcere libeaire", "ulcere bulbaire lineaire", 71.8),
        (token_set_ratio, "ulcere libeaire", "ulcere lineaire", 93.3), (token_set_ratio, "ulcere bulbmre", "ulcere bulbaire", 89.7),
        (token_set_ratio, "tumeur", "tumeur maligne du sein", 100), (ratio, "zygarthrose", "polyarthrose", 78.3),
    ],
)
def test_published_scores(f, a, b, want):
    assert f(a, b) == pytest.approx(want, abs=0.05)


def test_extract_one_takes_the_first_best():
    assert extract_one("ab", ["xx", "ab", "ab"], ratio, 50) == (1, 100.0)
    assert extract_one("ab", ["xx"], ratio, 50) is None
    assert edit_distance("a b c".split(), "a c".split()) == 1


def test_normalisers(spark):
    assert one(spark, X.normalize, "  Œsophagite  CHRONIQUE\n(é) ") == "œsophagite chronique (e)"
    assert one(spark, X.fold_ligatures, "Œsophagite éæ") == "OEsophagite eae"
    assert one(spark, X.flatten, "L'été, enfin !") == "l ete enfin"
    assert one(spark, X.code_tokens, "Maladies rénales, rénales os") == ["maladie", "renale", "os"]
    assert one(spark, X.dosage, "Metformine 1000 mg matin et soir") == "1000 mg matin et soir"
    assert one(spark, X.dosage, "rien") is None
    assert one(spark, X.items, "Un. Deux; x\n - Trois -") == ["Deux", "Trois"]
    assert one(spark, X.label_aliases, "Acide (Aspirine/Kardégic) x (Y)") == ["Aspirine", "Kardégic", "Y"]
    assert one(spark, X.atc_parents, "A10AE04") == ["A10AE", "A10A", "A10", "A"]
    assert one(spark, X.icd10_parents, "E78.0") == ["E78"] and one(spark, X.icd10_parents, "E78") == []


def test_truncated_json_is_repaired(spark):
    schema = "a array<struct<v:string>>"
    for buf, n in (('{"a": [{"v": "x"}, {"v": "y"}]}', 2), ('```json\n{"a": [{"v": "x"}]}\n```', 1), ('{"a": [{"v": "x"}, {"v": "y', 2), ('{"a": [{"v": "x"}, ', 1), ("rien", None)):
        got = one(spark, lambda c: X.repaired_json(c, schema), buf)
        assert (got and len(got.a)) == n, buf


REPORT = """Compte rendu : Dr Marie LAURENT, RPPS : 10001234567
Patient : Jean DUPONT né le 14/05/1956 - tél 06 12 34 56 78
NIR 1 56 05 75 123 456 78, mail jean.dupont@mail.fr, 12 rue des Lilas
75011 Paris. Dossier n° CARD-2024-0892. Consultation du 12/03/2024 avec Jean DUPONT.
Le 14/05/1956 encore. Nom et Rang du bénéficiaire / 1 ABRICOT Antrony"""


def test_identifiers_of_a_report(spark):
    found = one(spark, pii.pii_spans, REPORT)
    values = {(s.pii_type, s.value) for s in found}
    assert values == {
        ("NOM_PERSONNE", "Marie LAURENT"), ("RPPS", "10001234567"), ("NOM_PERSONNE", "Jean DUPONT"), ("DATE_NAISSANCE", "14/05/1956"),
        ("TELEPHONE", "06 12 34 56 78"), ("NIR", "1 56 05 75 123 456 78"), ("EMAIL", "jean.dupont@mail.fr"), ("ADRESSE", "12 rue des Lilas"),
        ("ADRESSE", "75011 Paris"), ("NUMERO_DOSSIER", "CARD-2024-0892"), ("NOM_PERSONNE", "ABRICOT Antrony"),
    }
    for s in found:
        assert REPORT[s.start : s.end] == s.value
    for a, b in zip(found, found[1:]):
        assert a.end <= b.start
    assert one(spark, pii.pii_spans, None) == []


@pytest.mark.parametrize("text", ["Consultation du 12/03/2024 pour contrôle", "Le compte rendu mentionne DURANDET sans titre", "dr Sodium élevé", "patient suivi pour asthme"])
def test_no_identifier(spark, text):
    assert one(spark, pii.pii_spans, text) == []


def test_pseudonyms_are_stable_and_reversible(spark):
    text = "Patient : Jean DUPONT né le 03/02/1951. Mme Jean DUPONT\n03/02/1951 et 03/02/1951"
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    r = pii.anonymize(df).first()
    assert r.text.count("[PATIENT_001]") == 2 and r.text.count("[DATE_NAISSANCE_001]") == 3 and "DUPONT" not in r.text
    back = pii.anonymize(df).select(pii.depseudonymize(F.col("text"), F.col("pii_map"))).first()[0]
    assert back == text
    strict = pii.anonymize(df, "strict").first()
    assert "DUPONT" not in strict.text and strict.text.count("[REDACTED:DATE_NAISSANCE]") == 3 and "pii_map" not in strict.asDict()


def test_audit_rows_hold_no_value(spark):
    df = pii.with_pii(spark.createDataFrame([("d", REPORT)], "document_id string, text string"))
    rows = pii.audit_entries(df).collect()
    assert len(rows) == 12 and all("DUPONT" not in str(r) and len(r.value_hash) == 16 for r in rows)


def test_greedy_selection_prefers_confidence_then_length(spark):
    kind = pii.SPAN
    rows = [("A", 0, 5, "", 0.7, "", "", 0), ("B", 3, 9, "", 0.9, "", "", 1), ("C", 8, 12, "", 0.9, "", "", 2), ("D", 12, 13, "", 0.1, "", "", 3)]
    df = spark.createDataFrame([(rows,)], f"s array<{kind}>")
    got = df.select(spans.keep_best(F.col("s"), kind).alias("k")).first().k
    assert [s.pii_type for s in got] == ["B", "D"]


def test_dense_spans_equal_finditer(spark):
    import re

    text = "aa bbb é aa\n" * 50
    got = one(spark, lambda c: spans.regex_spans(c, r"\b(?:aa|b+)"), text)
    assert [(s.start, s.end, s.value) for s in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\b(?:aa|b+)", text)]
