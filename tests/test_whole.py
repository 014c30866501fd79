"""Queries that once did less than the whole job."""

from __future__ import annotations

import pytest

from vitrail.operators import validate
from vitrail.plans import queries as Q

DOC = "document_id string, text string"


def test_candidates_stand_at_their_offsets_in_every_kind_of_section(spark):
    long = "mot " * 28 + "fin"
    text = f"Absence de malignité. Zut. inhibiteur\nMAALOX et RANIPLEX\nad 5 mm\nTaux anti-TRIM21 fort\nantécédents familiaux de mort subite\n{long}"
    c = Q._all_candidates(spark.createDataFrame([("d", text)], DOC))
    assert all(text[r.offset_debut :].startswith(r.valeur) and r.passage in text for r in c.collect())
    kept, rejects = validate.validate(c)
    found = {(r.valeur, r.regle) for r in rejects.collect()}
    assert found >= {
        ("malignité", "N1_entite_niee"), ("Zut", "validateur_non_medical"), ("inhibiteur", "validateur_classe_seule"),
        ("MAALOX et RANIPLEX", "validateur_traitement_compose"), ("ad 5 mm", "validateur_mot_court"),
        ("Taux anti-TRIM21 fort", "validateur_dosage_anticorps"),
    }
    assert {r.section for r in kept.where("valeur = 'mort subite'").collect()} == {"facteurs_risque"}
    assert c.where("length(passage) > 100").count() >= 3


def test_augment_drops_the_keys_that_any_order_has(spark, tmp_path):
    spark.createDataFrame([(1, 7), (500, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 3), (8, 4), (9, 5)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    rows = lambda q: sorted(map(tuple, q(spark, str(tmp_path)).collect()))
    assert rows(Q.augment_missing) == [(-1, 7), (-1, 8), (5, 9)]


def test_strip_trailing_reads_the_end_of_long_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 80 + " .;")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n for r in Q.strip_trailing(spark, str(tmp_path)).collect()] == [80]


def test_context_of_a_whole_table(spark, tmp_path):
    rows = [(1, "Mot. Absence de fièvre"), (2, "suspicion de phlébite"), (3, "antécédents familiaux de goutte"), (4, "rien ici")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.verdict: r.n for r in Q.context_after_cues(spark, str(tmp_path)).collect()}
    assert got == {"niee": 1, "hypothetique": 1, "familial": 1}
