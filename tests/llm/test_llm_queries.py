"""The registered queries against SQL, and the pipeline stage by stage."""

import collections
import re
import zlib

import numpy as np
import pytest
from oracles import compare, connection
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import language_id, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    compare(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.oracle_sql()[name])


def documents(sf_dir):
    return {r[0]: r for r in connection(sf_dir).sql("SELECT doc_id, text, lang, source FROM documents").fetchall()}


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_shards_of_the_table(spark, sf_dir):
    docs = documents(sf_dir)
    got = queries.op3_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, (_, t, *_) in docs.items()}
    total, groups = collections.Counter(), collections.defaultdict(set)
    for r in got:
        total[r.shard] += r.size
        groups[docs[r.doc_id][1]].add(r.shard)
    assert set(total) == set(range(8)) and all(len(s) == 1 for s in groups.values())
    assert max(total.values()) / min(total.values()) < 1.05


def test_held_out_accuracy(spark, sf_dir):
    docs = documents(sf_dir)
    got = queries.op5_language_id(spark, sf_dir).collect()
    held = [r for r in got if r.held_out and docs[r.doc_id][2]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id][2] for r in held) / len(held) > 0.95


def test_personal_data_of_the_table(spark, sf_dir):
    from test_llm_operators import base_spans

    docs = documents(sf_dir)
    import hashlib

    for r in queries.op7_pii(spark, sf_dir).collect():
        spans = base_spans(docs[r.doc_id][1] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in spans) for kind in ("email", "ip", "card", "phone")]


def test_neighbours_of_the_table(spark, sf_dir):
    rows = connection(sf_dir).sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = collections.defaultdict(set)
    for r in queries.op9_nearest_neighbours(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        best = set(ids[np.argsort(-score)[:20]].tolist())
        hits += len(best & got[int(ids[k])])
        total += len(best)
    assert hits / total >= 0.9


def test_pipeline_stage_by_stage(spark, sf_dir):
    from test_llm_operators import plain_components, plain_hits, targets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]

    one = stages["language_id"](spark, docs, sf_dir).cache()
    model = language_id.fit(docs, F.lit(True))
    want = {r.doc_id for r in language_id.identify(docs, model).collect() if not r.rejected}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == want

    two = stages["near_duplicates"](spark, one, sf_dir).cache()
    groups = plain_components(rows(one), 5, 80)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in groups})

    three = stages["decontamination"](spark, two, sf_dir).cache()
    items = connection(sf_dir).sql("SELECT item_id, text FROM benchmark").fetchall()
    clean = {i for i, _, n, _ in plain_hits(rows(two), items) if not n}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == clean

    four = stages["mixing"](spark, three, sf_dir).cache()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, _, s in rows(three):
        sizes[s] += size(t)
    copies = collections.Counter()
    for i, t, _, s in rows(four):
        taken[s] += size(t)
        copies[i] += 1
    most = max(size(t) for _, t, *_ in rows(three))
    assert four.columns == columns and max(copies.values()) <= 2
    assert all(abs(taken[s] - g) <= most for s, g in targets(sizes).items())

    five = stages["sharding"](spark, four, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in five) == copies and {r.shard for r in five} <= set(range(8))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(five)
