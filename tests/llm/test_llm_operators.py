"""Every operator against a plain version of itself, over texts that are awkward in every way."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import ann, common, components, decontaminate, jaccard_join, language_id, lm_scoring, mixing, pii, sharding, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; the tables below have them as extra columns.
CLASHES = ("block", "bucket", "rank", "n_words", "size", "shard", "slot", "part", "group", "key", "target", "spans", "rep", "token")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed=0, n=60):
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty, very long and repetitive texts, repeated rows."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["Été", "naïve", "ÅB", "日本語", "x" * 40]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = text(70), text(200)
    rows = [(i, text(rng.randint(1, 150)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"])) for i in range(n)]
    for i in range(n, n + 12):
        near = base.split(" ")
        near[rng.randrange(200)] = "edit%d" % (i % 9)
        rows.append((i, " ".join(near), "en", "a"))
    rows += [(i, text(20) + "\t\n" + passage + "  " + text(20), "de", "b") for i in range(n + 12, n + 18)]
    rows += [(i, base, "en", None) for i in range(n + 18, n + 22)]
    rows += [(n + 30, None, None, None), (n + 31, "", "en", "a"), (n + 32, " \t\n\x0b ", "en", "a"), (n + 33, "one", "en", "c"), (n + 34, "one", "en", "c"), (n + 35, "ha " * 400, "en", "c"), (n + 36, "a" * 700, "en", "c"), (n + 37, text(3000), "en", "a")]
    rows += [(n + 40, base, "en", "a"), (n + 40, base, "en", "a")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=True, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(partitions)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def empty(spark):
    return frame(spark, [(1, "x", "en", "a")]).where("doc_id = 2")


def ordered(rows):
    return sorted(rows, key=lambda r: r[0])


# ---------------------------------------------------------------- 1 and 8


@pytest.mark.parametrize("window", [10, 50])
def test_windows_that_repeat_go(spark, window):
    rows = corpus()
    first = {}
    for i, t, *_ in ordered(rows):
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    want = collections.Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = substring_dedup.remove_repeated_windows(frame(spark, rows), window, block_bytes=3000).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_bytes_that_repeat_go(spark):
    rows = [r for r in corpus() if r[0] != 100]  # rows of equal doc_id are ordered as stored
    for hot in (50_000, 3):
        seen, want = set(), {}
        for i, t, *_ in ordered(rows):
            b = (t or "").encode()
            gone = bytearray(len(b))
            for k in range(len(b) - 99):
                if b[k : k + 100] in seen:
                    gone[k : k + 100] = b"\1" * 100
                seen.add(b[k : k + 100])
            want[i] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g))
        got = suffix_dedup.remove_repeated_bytes(frame(spark, rows), 100, hot, block_bytes=4000).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in got} == want


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


@pytest.mark.parametrize("min_len", [64, 100, 130])
def test_longest_previous_factors_against_all_pairs(min_len):
    rng = random.Random(min_len)
    text = b"".join(rng.choice([b"abab", b"xyz", b"abababababababababab" * 4, bytes([rng.randrange(256)])]) for _ in range(90))
    raw = np.frombuffer(text, np.uint8)
    for at in (np.arange(len(raw) - min_len + 1), np.array(sorted(rng.sample(range(len(raw) - min_len + 1), 150)))):
        cut = [text[k : k + min_len] for k in at]
        want = [max((shared(cut[j], cut[i]) for j in range(i)), default=0) for i in range(len(cut))]
        assert suffix_dedup.longest_previous_factors(raw, at, min_len).tolist() == want
    assert not len(suffix_dedup.longest_previous_factors(raw, at[:0], min_len))


@pytest.mark.parametrize("rounds", [0, 1, 2, 12])
def test_nearest_smaller_values_of_any_order(rounds):
    rng = np.random.default_rng(rounds)
    for n in (0, 1, 2, 3, 17, 64, 100, 129):
        ramp = np.arange(n)
        for v in (ramp, ramp[::-1].copy(), rng.permutation(n), np.append(ramp[1:], ramp[:1]), np.concatenate([ramp[::2], ramp[1::2]])):
            want = [next((j for j in range(i - 1, -1, -1) if v[j] < v[i]), -1) for i in range(n)]
            assert suffix_dedup.smaller_before(v, rounds).tolist() == want
            want = [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]
            assert suffix_dedup.smaller_after(v).tolist() == want


# ---------------------------------------------------------------- 2


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_its_targets(spark):
    rows = corpus(3, 400)
    df = frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken, most = targets(sizes), collections.Counter(), max(len(WORD.findall(t or "")) for _, t, *_ in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= most for s in sizes)
    assert sum(taken.values()) <= sum(want.values()) + 1e-6
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert collections.Counter((r.doc_id, r.taken) for r in again) == collections.Counter((r.doc_id, r.taken) for r in got)


def test_mixed_stream_repeats_documents(spark):
    df = frame(spark, [r for r in corpus(4) if r[0] != 100])
    want = {r.doc_id: (r.taken // r.size if r.size else 1) for r in mixing.mix_sources(df).collect()}
    got = mixing.mixed_stream(df)
    assert got.columns == df.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter({k: v for k, v in want.items() if v})


def test_mix_plan_has_no_python(spark):
    plan = mixing.mix_sources(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 3


def plain_differencing(sizes, k):
    """Karmarkar-Karp for k parts, sums only."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0]


def test_differencing_matches_the_plain_version():
    rng = random.Random(5)
    for _ in range(20):
        sizes = rng.sample(range(1, 10_000), rng.randint(1, 40))
        to = sharding.difference([[s] for s in sizes], 4)
        sums = collections.Counter()
        for s, (shard,) in zip(sizes, to):
            sums[shard] += s
        spread = max(sums.get(i, 0) for i in range(4)) - min(sums.get(i, 0) for i in range(4))
        plain = plain_differencing(sizes, 4)
        assert sum(sums.values()) == sum(sizes)
        assert spread <= max(2 * (plain[0] - plain[-1]), min(sizes) * 4)


@pytest.mark.parametrize("options", [{}, {"bin_groups": 10, "fan": 2}])
def test_shards_are_even_and_groups_whole(spark, options):
    rows = corpus(6, 300)
    got = sharding.shard_documents(frame(spark, rows), 8, **options).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows)
    shard = collections.defaultdict(set)
    texts = {i: t for i, t, *_ in rows}
    total, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        shard[texts[r.doc_id]].add(r.shard)
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(len(s) == 1 for s in shard.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(collections.Counter({t: sum(len((t or "").encode()) + 1 for _, x, *_ in rows if x == t) for t in shard}).values())
    assert max(total.values()) - min(total.values()) <= biggest


# ---------------------------------------------------------------- 4


def plain_components(rows, n, percent):
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(low(t or ""))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    least = collections.defaultdict(lambda: 10**9)
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(least[root(x)], i)
    return collections.Counter((i, len(s), least[root(x)]) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_match_all_pairs(spark, n, percent):
    rows = corpus(7)
    for options in ({}, {"block_bytes": 3000, "part": 4}):
        got = jaccard_join.jaccard_components(frame(spark, rows), n, percent, **options).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, n, percent)


def test_a_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        if i % 8 == 0:
            words = [f"q{i}_{k}" for k in range(200)]
        words = list(words)
        for k in rng.sample(range(len(words)), 3):
            words[k] = f"e{i}_{k}"
        rows.append((i, " ".join(words), "en", "a"))
    got = jaccard_join.jaccard_components(frame(spark, rows), 4, 85, part=3).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 4, 85)


def test_overlaps_add_up_over_fragments():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    left, right = np.arange(5), np.arange(3, 12)
    got = jaccard_join.overlaps(sets, left, right, fragment=7)
    assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]


def test_overlaps_add_up_over_ranges_of_hashes():
    rng = np.random.default_rng(10)
    names = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    sets = [rng.choice(names, size, replace=False) for size in (30, 0, 1, 60, 25, 40)]
    left, right = np.array([0, 1, 3]), np.array([5, 2, 4])
    got = jaccard_join.overlaps(sets, left, right, fragment=7, entries=11)
    assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]


def test_a_join_of_long_documents_holds_little_beside_them():
    rng = np.random.default_rng(11)
    sets = [rng.permutation(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)) for _ in range(4)] * 20
    every = np.arange(len(sets))
    tracemalloc.start()
    got = jaccard_join.overlaps(sets, every, every)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [[50_000 * (a % 4 == b % 4) for b in every] for a in every]
    # 32 MB of n-grams; they were 80 bytes each in the join
    assert peak < 5 * sum(x.nbytes for x in sets)


def test_groups_of_long_documents_are_dealt_by_ngrams(spark):
    rng = random.Random(12)
    rows = []
    for i in range(36):
        if i % 12 == 0:
            words = [f"q{i}_{k}" for k in range(100 + 20 * i)]
        words = list(words)
        for k in rng.sample(range(len(words)), 2):
            words[k] = f"e{i}_{k}"
        rows.append((i, " ".join(words), "en", "a"))
    want = plain_components(rows, 4, 85)
    for part_tokens in (300, 2000):
        got = jaccard_join.jaccard_components(frame(spark, rows), 4, 85, part_tokens=part_tokens).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_one_of_each_group_stays(spark):
    df = frame(spark, corpus(7)).withColumn("n_chars", F.lit(1))
    kept = jaccard_join.keep_one_per_component(df, 5, 80)
    assert kept.columns == df.columns
    comp = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, 5, 80).collect()}
    assert {r.doc_id for r in kept.collect()} == set(comp.values())


def test_one_row_of_each_group_stays(spark):
    a, b, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "aby")
    rows = [(3, a, "x", 1), (3, a, "x", 1), (3, a, "w", 2), (5, b, "x", 3), (5, a, "x", 4), (None, a, "x", 5), (None, other, "x", 6), (None, other, "v", 7), (9, "", "x", 8), (9, "", "x", 8), (None, None, None, None), (7, "lone words here", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept_key int").withColumn("row", F.lit("r")).withColumn("root", F.map_from_arrays(F.array(F.lit("k")), F.array("kept_key")))
    kept = jaccard_join.keep_one_per_component(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.lang, r.kept_key) for r in kept.collect()), key=repr)
    want = [(3, a, "w", 2), (5, b, "x", 3), (None, other, "v", 7), (9, "", "x", 8), (9, "", "x", 8), (None, None, None, None), (7, "lone words here", None, 9)]
    assert got == sorted(want, key=repr)


def test_components_of_links(spark):
    rng = random.Random(10)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(50)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for e in links for x in e if any(p != q for p, q in links if x in (p, q))}


# ---------------------------------------------------------------- 5


def spoken(spark):
    rng = random.Random(11)
    syllables = {"en": ["the", "ing", "th", "er", "and"], "fr": ["eau", "ou", "é", "que", "tion"], "de": ["sch", "ung", "ei", "ü", "der"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang, "a") for i, lang in enumerate(rng.choices(list(syllables), [6, 2, 1], k=600))]
    rows += [(700, None, "en", "a"), (701, "", "en", "a"), (702, "123 !! ?", "en", "a"), (703, "the", None, None), (704, "É" * 30_000, "fr", "a")]
    return frame(spark, rows), {r[0]: r[2] for r in rows}, rows


def test_held_out_languages_are_recognised(spark):
    df, truth, rows = spoken(spark)
    model = language_id.fit(df, ~language_id.held_out(df["doc_id"]), sample_rows=50)
    assert model.languages == ["de", "en", "fr"] and (np.bincount(model.owner) <= 3).all()
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    for i in (700, 701, 702):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.drop_rejected(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    assert {r.doc_id for r in language_id.identify(df, model, max_distance=-1.0).where("not rejected").collect()} == set()


def test_prediction_sees_the_text_alone(spark):
    df, _, _ = spoken(spark)
    model = language_id.fit(df, F.lit(True), sample_rows=30)
    other = df.withColumns({"lang": F.lit("zz"), "source": F.lit("q")})
    assert sorted(map(tuple, language_id.identify(other, model).collect())) == sorted(map(tuple, language_id.identify(df, model).collect()))


def test_without_labels_everything_is_unknown(spark):
    df = frame(spark, [(1, "the", None, "a")])
    model = language_id.fit(df, F.lit(True))
    assert language_id.identify(df, model).first().lang_pred == "und"


def test_stray_labels_don_t_crowd_out_languages(spark):
    df, _, _ = spoken(spark)
    known = language_id.fit(df, F.lit(True), sample_rows=30)
    stray = spark.range(600).select((F.col("id") + 100_000).alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("stray"), "id").alias("lang"), F.lit("a").alias("source"))
    rows = 30 * len(known.languages)
    found = language_id.fit(df.select(stray.columns).union(stray), F.lit(True), sample_rows=30, total_rows=rows)
    assert found.languages == known.languages and np.array_equal(found.vectors, known.vectors)
    more = language_id.fit(df.select(stray.columns).union(stray), F.lit(True), sample_rows=30, total_rows=rows + 50)
    assert len(more.languages) == len(known.languages) + 50


# ---------------------------------------------------------------- 6


def test_losses_match_counting_by_hand(spark):
    rows = [r for r in corpus(12) if r[0] != 100]
    chosen = {i for i, *_ in rows if i % 3 == 0}
    counts = [[collections.Counter() for _ in range(3)] for _ in range(2)]
    words = {i: WORD.findall(low(t or "")) for i, t, *_ in rows}
    for i, w in words.items():
        for m in (0, 1) if i in chosen else (0,):
            counts[m][0].update(w)
            counts[m][1].update(zip(w, w[1:]))
            counts[m][2].update(w[:-1])
    v = len(counts[0][0])
    ids = spark.createDataFrame([(i,) for i in sorted(chosen)] + [(None,), (99_999,)], "id long")
    for r in lm_scoring.cross_entropy_difference(frame(spark, rows), ids, block_bytes=3000).collect():
        w = words[r.doc_id]
        assert r.n_words == len(w)
        if not w:
            assert r.score is None
            continue
        bits = []
        for uni, two, history in counts:
            n, total = sum(uni.values()), 0.0
            for k, x in enumerate(w):
                p = (uni[x] + 0.1) / (n + 0.1 * v)
                if k and history[w[k - 1]]:
                    p = 0.7 * two[w[k - 1], x] / history[w[k - 1]] + 0.3 * p
                total -= math.log2(p)
            bits.append(total / len(w))
        assert r.background_bits == pytest.approx(bits[0]) and r.target_bits == pytest.approx(bits[1])
        assert r.score == pytest.approx(bits[1] - bits[0])


def test_target_like_texts_score_lower(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"] if i % 2 else ["x", "y", "z"]) for _ in range(50)), "en", "a") for i in range(60)]
    ids = spark.createDataFrame([(i,) for i in range(1, 30, 2)], "id long")
    got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(frame(spark, rows), ids).collect()}
    assert max(got[i] for i in range(31, 60, 2)) < min(got[i] for i in range(0, 60, 2))


# ---------------------------------------------------------------- 7


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


AWKWARD = [
    "a@b.c@d.e x@@y.z @a.b a@b a.b@c-d.e.f.",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 999.1.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 0000 0000 0000",
    "+1 (555) 010-9999 +49.30.123456 ++12345678901 +1 2 +1234567890123456",
    "é@b.c ü.a@ö.de 日本1.2.3.4語+33 1 23 45 67 89",
    "", " ", "@", "+", "1" * 500, "a@" * 300, "1.1.1." * 100,
]


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(14)
    texts = AWKWARD + ["".join(rng.choice("ab1 2.3@+-4(5)é") for _ in range(200)) for _ in range(300)] + ["x" * 60_000 + " a@b.cd"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(9_000, None, None, None), (0, texts[0], "en", "a")]
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base_spans(text[r.doc_id]), text[r.doc_id][:80]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write joe.doe [at] example [dot] com today", "email", "joe.doe [at] example [dot] com"),
        ("joe at example dot com", "email", "joe at example dot com"),
        ("jоe@exаmple.com!", "email", "jоe@exаmple.com"),
        ("call ＋１ 555 010 9999 now", "phone", "＋１ 555 010 9999"),
        ("plus one five five five zero one zero nine nine nine nine", "phone", "plus one five five five zero one zero nine nine nine nine"),
        ("10 (dot) 0 (dot) 0 (dot) 1", "ip", "10 (dot) 0 (dot) 0 (dot) 1"),
        ("card 4111​1111 1111 1111.", "card", "4111​1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    assert found in [text[s:e] for k, s, e, base in pii.find(text) if k == kind and not base]
    assert found not in pii.redact(text)


@pytest.mark.parametrize("text", ["we met at the dot at noon", "one two three four", "look at this. And dot the i", "Самолет"])
def test_plain_prose_is_left_alone(text):
    assert pii.find(text) == [] and pii.redact(text) == text


# ---------------------------------------------------------------- 9


def vectors(spark, n=900, dim=16, seed=15):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, dim))).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], "x") for i in range(n)]
    bad = [(n, None, "x"), (n + 1, [0.0] * dim, "x"), (n + 2, [float("nan")] + [1.0] * (dim - 1), "x"), (n + 3, [None] + [1.0] * (dim - 1), "x"), (n + 4, [float("inf")] + [1.0] * (dim - 1), "x"), (n + 5, [1.0] * 3, "x"), (None, [1.0] * dim, "x")]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, block string"), x.astype(np.float64)


def test_recall_and_exact_scores(spark):
    df, x = vectors(spark)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, lambda v: F.pmod(v, F.lit(20)) == 0, k=20, block_rows=400, query_rows=16).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert [s for *_, s in found] == pytest.approx([float(x[v] @ x[q]) for _, v, _ in found], abs=1e-12)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_few_candidates_and_ties(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, lambda v: v == 0, k=20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 3, 1.0), (2, 5, 1.0), (3, 4, 0.0)]
    assert ann.nearest(df.where("vec_id > 100"), lambda v: v == 0).count() == 0


# ---------------------------------------------------------------- 10


def plain_hits(rows, items, size=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t or ""))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = collections.Counter()
    for i, t, *_ in rows:
        w = pattern.findall(low(t or ""))
        mask, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    mask[k : k + n] = [True] * n
        out[i, len(w), sum(mask), tuple(sorted(found))] += 1
    return out


def benchmark(spark, rows):
    text = {i: t for i, t, *_ in rows}
    items = [(1, " ".join(text[72].split()[10:40])), (2, "ONE"), (3, None), (4, ""), (5, "never seen words " * 5), (10, " ".join(text[72].split()[30:60])), (11, "w1 w2"), (12, "one"), (None, "w1")]
    return spark.createDataFrame(items, "item_id int, text string"), [x for x in items if x[0] is not None]


@pytest.mark.parametrize("slice_bytes", [decontaminate.SLICE_BYTES, 150])
def test_hits_match_every_window(spark, slice_bytes):
    rows = corpus(16)
    df, items = benchmark(spark, rows)
    got = decontaminate.find_contamination(frame(spark, rows), df, 10, slice_bytes).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == plain_hits(rows, items)
    assert any(r.n_hit for r in got)


def test_documents_or_spans_go(spark):
    rows = corpus(16)
    df, items = benchmark(spark, rows)
    docs = frame(spark, rows)
    clean = {i for i, _, n, _ in plain_hits(rows, items) if not n}
    kept = decontaminate.decontaminate(docs, df)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    cut = decontaminate.decontaminate(docs, df, mode="spans")
    assert cut.count() == len(rows)
    sliced = decontaminate.decontaminate(docs, df, mode="spans", slice_bytes=500)
    text = lambda found: collections.Counter((r.doc_id, r.text) for r in found.collect())
    assert text(sliced) == text(cut) and sliced.columns == docs.columns
    assert {r.doc_id for r in decontaminate.decontaminate(docs, df, slice_bytes=500).collect()} == clean
    assert {r.doc_id: r.text for r in cut.where(F.col("doc_id").isin(list(clean))).collect()} == {i: t for i, t, *_ in rows if i in clean}
    assert decontaminate.find_contamination(cut, df).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, df, mode="other")


# ---------------------------------------------------------------- empty tables, nulls in ids


def test_empty_tables(spark):
    df = empty(spark)
    none = spark.createDataFrame([], "item_id int, text string")
    assert substring_dedup.remove_repeated_windows(df).count() == 0
    assert suffix_dedup.remove_repeated_bytes(df).count() == 0
    assert mixing.mix_sources(df).count() == 0 and mixing.mixed_stream(df).count() == 0
    assert sharding.shard_documents(df).count() == 0
    assert jaccard_join.jaccard_components(df).count() == 0 and jaccard_join.keep_one_per_component(df).count() == 0
    assert language_id.identify(df, language_id.fit(df, F.lit(True))).count() == 0
    assert lm_scoring.cross_entropy_difference(df, none.select("item_id")).count() == 0
    assert pii.find_pii(df).count() == 0
    assert decontaminate.find_contamination(df, none).count() == 0
    full = frame(spark, corpus(1, 5))
    assert decontaminate.find_contamination(full, none).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(full, none).count() == full.count()


def test_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = frame(spark, [(None, long, None, None), (None, long, None, None), (3, long, "en", "a"), (2, "short", "en", "a")])
    got = substring_dedup.remove_repeated_windows(df).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in got) == [(2, 0), (3, 0), (99, 60), (99, 60)]
    assert sum(r.n_removed == 0 for r in suffix_dedup.remove_repeated_bytes(df).collect()) == 2
    assert sorted((r.doc_id or 99, r.component_id) for r in jaccard_join.jaccard_components(df).collect()) == [(2, 2), (3, 3), (99, 3), (99, 3)]
    assert len(mixing.mix_sources(df).collect()) == len(sharding.shard_documents(df).collect()) == 4
    assert pii.find_pii(df).count() == lm_scoring.cross_entropy_difference(df, df.select("doc_id")).count() == 4
    assert language_id.identify(df, language_id.fit(df, F.lit(True))).count() == 4
    assert sorted(r.doc_id for r in jaccard_join.keep_one_per_component(df).collect()) == [2, 3]


def test_blocks_and_numbers_round_trip(spark):
    rows = corpus(2)
    blocks = common.pack_documents(frame(spark, rows), 2000)
    got = []
    for r in blocks.toArrow().to_batches():
        for i in range(r.num_rows):
            b = common.Block(r.slice(i, 1))
            got += [(d, None if n else t.decode()) for d, t, n in zip(b.ids, b.texts, b.null)]
    assert collections.Counter(got) == collections.Counter((i, t) for i, t, *_ in rows)
    for values in ([], [0], [1, 2**64 - 1], list(range(1000))):
        a = np.array(values, np.uint64)
        assert common.decode(common.encode(a, a))[1].tolist() == values


def test_digests_of_spans():
    assert pii.digest([("email", 0, 5)]) == hashlib.sha256(b"email:0:5").hexdigest()
