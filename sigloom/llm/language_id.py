"""Language ID by nearest centroid: normalised TF-IDF n-gram vectors against several centroids per language.

Fitting takes a bounded sample: at most ``sample_rows`` labelled rows per language, those
with the smallest hash of doc_id, and at most ``total_rows`` of all languages, dealt in turn,
languages with fewer than ``PIECES`` rows last.  Spherical k-means gives each language up to ``clusters`` centroids, and a
document gets the language of the centroid with the largest cosine.  A document too far
from its nearest centroid is rejected, as is one without a letter.  Prediction scans whole
texts, shuffles nothing, and sees the text alone.

How far is too far follows the sample, per language and length (log2 of the number of
different features, as short texts are far from every centroid): centroids of one half of
the sample score pieces of the other half, and a document stays with at least ``SLACK`` of
the cosine that all but ``LOWEST`` of the pieces reach.  Lengths with fewer than ``PIECES``
pieces use the limit of the next shorter one, and a language with fewer sample rows than
that rejects beyond ``MAX_DISTANCE`` only.  A ``max_distance`` that is given replaces all this.

Features: byte n-grams of 1 to 4 of the lower-cased text in which every run of ASCII
non-letters is one space, hashed into ``DIM`` columns.

Defined results: a null text, an empty one or one without a letter gets ``und`` and score
0; ties go to the language first in code point order; rows are predicted one by one, so
repeated rows agree; without labelled rows every document gets ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
DIM = 1 << 13
SAMPLE_ROWS = 200
#: Rows of the sample over all languages.
TOTAL_ROWS = 10_000
SCAN_BYTES = 1 << 20
#: Rows of the dense count matrix at a time.
SCAN_ROWS = 256
MAX_DISTANCE = 0.97
SLACK = 0.4
LOWEST = 0.05
PIECES = 20

_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Centroids:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    vectors: np.ndarray  # unit rows
    idf: np.ndarray
    limits: np.ndarray  # least cosine that stays, by language and log2 of the number of features


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, one row a text."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = _KEEP[np.frombuffer(b"".join(parts), np.uint8)]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    if not len(raw):
        return np.zeros((len(parts), DIM), np.float32)
    single = ~((raw[1:] == 0x20) & (raw[:-1] == 0x20) & (row[1:] == row[:-1]))
    single = np.append(True, single)
    raw, row = raw[single].astype(np.uint64), row[single]
    out = np.zeros(len(parts) * DIM, np.float32)
    code = np.zeros(len(raw), np.uint64)
    for n in range(1, 5):
        m = len(raw) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | raw[n - 1 :][:m]
        ok = row[:m] == row[n - 1 :]
        if n == 1:
            ok &= raw != 0x20
        hashed = ((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
        out += np.bincount((row[:m] * DIM + hashed.astype(np.int64))[ok], minlength=len(out)).astype(np.float32)
    return out.reshape(len(parts), DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(tf) * idf)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; seeds are spread out: each is the row least like those before it."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    mid = x[seeds]
    for _ in range(rounds):
        near = np.argmax(x @ mid.T, axis=1)
        mid = _unit(np.stack([x[near == j].sum(0) if (near == j).any() else mid[j] for j in range(len(mid))]))
    return mid


def _pieces(text: str) -> list[str]:
    """Openings of 4, 8, 16... characters, and the whole text."""
    cut = [text[: 1 << k] for k in range(2, max(2, (len(text) - 1).bit_length()))]
    return [t for t in [*cut, text] if has_letter(t)]


def _size(tf: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum((tf > 0).sum(1), 1))[1] - 1


def rejection_limits(texts: list[str], x: np.ndarray, owner: np.ndarray, idf: np.ndarray, languages: int, clusters: int) -> np.ndarray:
    """Least cosine that stays, by language and log2 of the number of features, by halves of the sample."""
    half = np.zeros(len(owner), int)
    for j in range(languages):
        half[owner == j] = np.arange((owner == j).sum()) % 2
    seen: dict[tuple[int, int], list[float]] = {}
    for side in range(2):
        known = [j for j in range(languages) if ((owner == j) & (half != side)).any()]
        if not known:
            continue
        mids = [spherical_kmeans(x[(owner == j) & (half != side)], clusters) for j in known]
        of = np.repeat(known, [len(m) for m in mids])
        mid = np.concatenate(mids).astype(np.float32)
        for i in np.flatnonzero(half == side):
            tf = counts(_pieces(texts[i]))
            cos = vectors(tf, idf) @ mid.T
            for j, size, c in zip(of[cos.argmax(1)].tolist(), _size(tf).tolist(), cos.max(1).tolist(), strict=True):
                seen.setdefault((j, size), []).append(c)
    out = np.full((languages, DIM.bit_length()), 1 - MAX_DISTANCE)
    for j in np.flatnonzero(np.bincount(owner, minlength=languages) >= PIECES):
        for size in range(out.shape[1]):
            found = seen.get((j, size), [])
            if len(found) >= PIECES:
                out[j, size] = max(SLACK * np.quantile(found, LOWEST), 1 - MAX_DISTANCE)
            elif size:
                out[j, size] = out[j, size - 1]
    return out


def fit(docs: DataFrame, trainable, clusters: int = 3, sample_rows: int = SAMPLE_ROWS, total_rows: int = TOTAL_ROWS) -> Centroids:
    """Centroids from a bounded sample of the rows of ``docs`` where ``trainable`` holds and lang is known.

    At most ``sample_rows`` rows a language and ``total_rows`` in all, by hash of doc_id:
    one row of each language, then a second one, and so on, and rare labels after the rest.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), trainable.alias("use"))
    rows = rows.where("use and lang is not null and doc_id is not null")
    # the smallest hashes per language: only ids are shuffled
    # first per slice of the hash, so that no task sorts a whole language
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("slice", F.pmod("h", F.lit(64)))
    for keys in (["lang", "slice"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
        ids = ids.withColumn("place", place).where(F.col("place") <= sample_rows)
    # labels too rare to measure come last, so that stray ones don't crowd out languages
    ids = ids.withColumn("rare", F.count("*").over(Window.partitionBy("lang")) < min(PIECES, sample_rows))
    ids = ids.orderBy("rare", "place", "h", "lang").limit(total_rows).select("doc_id", F.col("lang").alias("l"))
    chosen = rows.join(F.broadcast(ids), "doc_id").where("lang = l").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    sample = sorted((r.lang, r.doc_id, r.text) for r in chosen.collect() if r.text and has_letter(r.text))
    languages = sorted({x[0] for x in sample}, key=lambda x: x.encode())
    if not languages:
        return Centroids([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros((0, DIM.bit_length())))
    tf = np.concatenate([counts([x[2]]) for x in sample])
    idf = np.log((1 + len(sample)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    x = vectors(tf, idf)
    owner = np.array([languages.index(s[0]) for s in sample])
    mids = [spherical_kmeans(x[owner == j], clusters) for j in range(len(languages))]
    limits = rejection_limits([s[2] for s in sample], x, owner, idf, len(languages), clusters)
    return Centroids(languages, np.repeat(np.arange(len(languages)), [len(m) for m in mids]), np.concatenate(mids).astype(np.float32), idf, limits)


def predict(model: Centroids, texts: list[str | None], max_distance: float | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (cosine, 0 to 1) and whether it is rejected, of each text."""
    lang = [UNKNOWN] * len(texts)
    score = np.zeros(len(texts))
    rejected = np.ones(len(texts), bool)
    ask = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.languages else []
    if ask:
        tf = counts([texts[i] for i in ask])
        cos = vectors(tf, model.idf) @ model.vectors.T
        best = np.argmax(cos, axis=1)  # the first of equals
        least = model.limits[model.owner[best], _size(tf)] if max_distance is None else np.full(len(ask), 1 - max_distance)
        for i, j, x, low in zip(ask, best.tolist(), cos.max(1).tolist(), least.tolist(), strict=True):
            lang[i], score[i] = model.languages[model.owner[j]], min(1.0, max(0.0, x))
            rejected[i] = score[i] < low
    return lang, score, rejected


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i, held = 0, 0
    for j, t in enumerate(texts):
        held += len(t or "")
        if held >= SCAN_BYTES or j + 1 - i >= SCAN_ROWS:
            yield i, j + 1
            i, held = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def identify(docs: DataFrame, model: Centroids, max_distance: float | None = None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers per centroid, for at most TOTAL_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _batches(texts):
                lang, score, rejected = predict(shared.value, texts[i:j], max_distance)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Centroids, max_distance: float | None = None) -> DataFrame:
    """``docs``, all columns, without the rows that ``identify`` rejects."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, j in _batches(texts):
                rejected = predict(shared.value, texts[i:j], max_distance)[2]
                yield b.slice(i, j - i).filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """Documents that never train: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
