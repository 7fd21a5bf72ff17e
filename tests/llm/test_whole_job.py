"""What round 1's review found done by half."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import ann, language_id

DOCS = "doc_id long, text string, lang string, source string"


def prose(rng, syllables, words):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))


# ---------------------------------------------------------------- language_id


def test_unseen_languages_and_junk_are_rejected_by_default(spark):
    rng = random.Random(5)
    syllables = {"en": ["the", "ing", "th", "er", "and", "on", "re"], "fr": ["eau", "ou", "é", "que", "tion", "le", "des"], "de": ["sch", "ung", "ei", "ü", "der", "ich", "en"]}
    rows = [(i, prose(rng, syllables[lang], rng.choice([1, 2, 5, 20, 60, 300])), lang, "a") for i, lang in enumerate(rng.choices(list(syllables), k=600))]
    strange = [
        "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(400)),
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا",
        " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(80)),
        base64.b64encode(rng.randbytes(3000)).decode(),
    ]
    clean = spark.createDataFrame(rows, DOCS)
    asked = spark.createDataFrame(rows + [(1000 + i, t, "en", "a") for i, t in enumerate(strange)], DOCS)
    model = language_id.fit(clean, ~language_id.held_out(F.col("doc_id")), sample_rows=100)
    rejected = {r.doc_id for r in language_id.identify(asked, model).where("rejected").collect()}
    assert rejected == set(range(1000, 1000 + len(strange)))
    assert {r.doc_id for r in language_id.drop_rejected(asked, model).collect()} == {r[0] for r in rows}


def test_a_language_with_few_sample_rows_keeps_its_documents(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, ["the", "ing", "er", "and"], 60), "en", "a") for i in range(100)]
    rows += [(200 + i, prose(rng, ["sch", "ung", "ei", "der"], 60), "de", "a") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs, (F.col("lang") == "en") | (F.col("doc_id") < 203))
    assert language_id.identify(docs, model).where("rejected").count() == 0
    assert model.limits[model.languages.index("de")] == pytest.approx(1 - language_id.MAX_DISTANCE)
    assert language_id.fit(docs, F.col("doc_id").isin(0, 200)).languages == ["de", "en"]


# ---------------------------------------------------------------- nearest neighbours


@pytest.mark.parametrize("lengths", ["outlier", "spread"])
def test_recall_with_unequal_lengths(spark, lengths):
    rng = np.random.default_rng(3)
    n, dim = 3000, 32
    x = rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(rng.normal(size=(n, 1))) if lengths == "spread" else np.where(np.arange(n) == 1, 10.0, 1.0)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    got = ann.nearest(df, lambda v: F.pmod(v, F.lit(50)) == 0, k=20, verify=0.05).collect()
    for q in range(0, n, 50):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (20 * (n // 50)) >= 0.95
