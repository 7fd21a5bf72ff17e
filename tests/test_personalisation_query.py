from sigloom import model_queries
from sigloom.operators import models


def test_personalisation_asks_for_every_subject(spark, sf_dir, monkeypatch):
    asked = []

    def personalise(table, names, factory, subject, subjects, **options):
        asked.extend(subjects)
        rows = table.where("part = 'evaluate'").selectExpr("'raw' as variant", "subject_id", "label as truth", "label as predicted", "0.5D as probability")
        return rows, []

    monkeypatch.setattr(models, "personalise", personalise)
    got = {r.subject_id for r in model_queries.personalisation(spark, sf_dir).collect()}
    assert asked == sorted(got) == [f"S{i}" for i in range(6)]
