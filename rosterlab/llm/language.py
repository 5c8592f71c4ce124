"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed letter n-grams (one to three letters, words bounded by a space), weighted by
``(1 + log count) * idf`` and normalised. Each language is described by a few centroids, found by spherical k-means over
a bounded sample of labelled rows. A text gets the language of the centroid with the greatest cosine. It is rejected
when its distance from that centroid exceeds the largest one seen among sampled texts of about its length, plus a margin; texts of fewer than ``LEAST`` letters are not judged that way.

Texts that are null or have no letter are ``und`` and rejected, with score 0. Without labelled rows every text is ``und``.
Extra columns pass through; the added columns must not exist yet.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .common_py import slices, with_columns, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Size of the hashed n-gram space.
SIZE = 1 << 13
#: At most so many labelled rows of a language are used to fit (the documented bound of the sample).
SAMPLE = 600
CENTROIDS, ROUNDS = 4, 8
#: Classes of length: the binary logarithm of the number of letters.
CLASSES = 32
MARGIN = 0.2
#: Texts of fewer letters hold too little to be called foreign; they are never rejected.
LEAST = 128
_TABLE, _STEP = 0x110000, 1 << 19
#: Most languages that are learned; centroids of more would not be a bounded broadcast.
LANGUAGES = 1000


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, else 0."""
    out = np.zeros(_TABLE, dtype=np.uint32)
    for i in range(_TABLE):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams of a whole text, and its number of letters."""
    table, total, n = worker_state("letters", _letters), np.zeros(SIZE, dtype=np.int64), 0
    tail = np.full(1, 32, dtype=np.uint32)
    for lo in range(0, len(text), _STEP):
        code = np.frombuffer(text[lo : lo + _STEP].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = table[np.where(code < _TABLE, code, 0)]
        n += int(np.count_nonzero(code))
        code = np.concatenate([tail, np.where(code, code, 32)])
        old = len(tail)
        if lo + _STEP >= len(text):
            code = np.append(code, np.uint32(32))
        keep = (code[1:] != 32) | (code[:-1] != 32)
        fresh = int(np.count_nonzero(keep[: old - 1])) + 1 if old > 1 else 1
        code = np.concatenate([code[:1], code[1:][keep]])
        one, two = code[fresh:] * np.uint32(2654435761), code[fresh - 1 : -1] * np.uint32(2246822519)
        grams = [one, one ^ (two + np.uint32(0x9E3779B9))]
        if fresh > 1:
            grams.append(grams[1] ^ (code[fresh - 2 : -2] * np.uint32(3266489917) + np.uint32(0x7F4A7C15)))
        elif len(code) > 2:
            grams.append((one[1:] ^ (two[1:] + np.uint32(0x9E3779B9))) ^ (code[:-2] * np.uint32(3266489917) + np.uint32(0x7F4A7C15)))
        for g in grams:
            g ^= g >> np.uint32(15)
            g *= np.uint32(0x85EBCA6B)
            total += np.bincount(g >> np.uint32(32 - 13), minlength=SIZE)
        tail = code[-2:]
    return total, n


def _vectors(tallies: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(tallies > 0, 1 + np.log(np.maximum(tallies, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _length_class(letters) -> np.ndarray:
    return np.log2(np.maximum(letters, 1)).astype(int)


_TALLY = "lang string, letters long, at array<int>, n array<int>"


def _tallied(batches):
    for batch in slices(batches):
        rows = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total, letters = counts(text)
            if letters:
                at = np.flatnonzero(total)
                rows.append((lang, letters, at, total[at]))
        if rows:
            lang, letters, at, n = zip(*rows)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(letters, pa.int64()), pa.array(at, ints), pa.array(n, ints)], names=["lang", "letters", "at", "n"])


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started with the row nearest the mean and then the row farthest from all chosen ones."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    chosen = [first]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        if near.min() > 0.999:
            break
        chosen.append(int(np.argmin(near)))
    c = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _fit_language(idf: np.ndarray, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("letters", kind="stable")
        tallies = np.zeros((len(rows), SIZE), dtype=np.float32)
        for i, (at, n) in enumerate(zip(rows["at"], rows["n"])):
            tallies[i, at] = n
        x = _vectors(tallies, idf)
        long = rows["letters"].to_numpy() >= 100  # very short texts would be clusters of their own
        c = _clusters(x[long] if long.sum() >= k else x, k)
        far, kind = 1 - (x @ c.T).max(axis=1), _length_class(rows["letters"].to_numpy())
        radius = [float(far[kind == i].max()) if (kind == i).any() else -1.0 for i in range(CLASSES)]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [v.astype("<f4").tobytes() for v in c], "radius": [radius] * len(c)})

    return run


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """The model: learned languages, centroids, inverse document frequencies and radii by length.

    Fitting uses at most ``sample`` rows of each language, chosen by a hash of the id, then of the text, whatever the size of the
    input and however often an id is repeated; repeated rows count once. ``k`` centroids of each language are held by the driver and sent
    to the tasks, so more than ``LANGUAGES`` languages raise an error.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("rid", F.xxhash64("id", "text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "rid")
    chosen = rows.select("lang", "id", "rid").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("lang", "rid")
    # at most ``sample`` rows a language
    texts = rows.join(F.broadcast(chosen), ["lang", "rid"], "left_semi").dropDuplicates(["lang", "rid"]).select("lang", "text")
    tally = written(texts.mapInArrow(_tallied, _TALLY), "language-sample")
    if (found := tally.select("lang").distinct().count()) > LANGUAGES:
        raise ValueError(f"{found} languages, {LANGUAGES} at most are learned")
    n = tally.count()
    idf = np.zeros(SIZE, dtype=np.float32)
    for r in tally.select(F.explode("at").alias("g")).groupBy("g").count().collect():  # SIZE rows at most
        idf[r["g"]] = np.log((1 + n) / (1 + r["count"])) + 0.05
    fitted = tally.groupBy("lang").applyInPandas(_fit_language(idf, k), "lang string, centroid binary, radius array<double>").collect()
    fitted.sort(key=lambda r: (r["lang"], r["centroid"]))
    radius = np.array([r["radius"] for r in fitted]).reshape(-1, CLASSES).max(axis=0, initial=-1)
    limit, low = np.full(CLASSES, 2.0), 2.0
    for i in range(CLASSES):  # a class without sampled texts takes over the limit of the class of shorter ones
        if radius[i] >= 0:
            low = radius[i] + MARGIN
        limit[i] = low
    return {
        "langs": [r["lang"] for r in fitted],
        "centroids": np.array([np.frombuffer(r["centroid"], dtype="<f4") for r in fitted], dtype=np.float32).reshape(-1, SIZE),
        "idf": idf,
        "limit": limit,
    }


def _predicted(batches, model: dict, at: int):
    langs, centroids, idf, limit = model["langs"], model["centroids"], model["idf"], model["limit"]
    for batch in slices(batches, 128):
        got = [counts(t) if t else (np.zeros(SIZE, dtype=np.int64), 0) for t in batch.column(at).to_pylist()]
        letters = np.array([n for _, n in got])
        known = letters > 0
        if langs:
            near = _vectors(np.stack([c for c, _ in got]), idf) @ centroids.T
            best = near.argmax(axis=1)
            score = np.where(known, np.clip(near.max(axis=1), 0, 1), 0)
        else:
            best, score, known = np.zeros(len(got), dtype=int), np.zeros(len(got)), np.zeros(len(got), dtype=bool)
        rejected = ~known | (letters >= LEAST) & (1 - score > limit[np.minimum(_length_class(letters), CLASSES - 1)])
        yield with_columns(batch, {
            "lang_pred": pa.array([langs[b] if ok else "und" for b, ok in zip(best, known)], pa.string()),
            "score": pa.array(score.astype(float), pa.float64()),
            "rejected": pa.array(rejected, pa.bool_()),
        })


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (``und`` where there is no letter), ``score`` (cosine, 0 to 1) and ``rejected``."""
    taken = {"lang_pred", "score", "rejected"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x centroids
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(lambda batches: _predicted(batches, sent.value, at), schema)


def held_out(id_col: str = "doc_id"):
    """The fold that is not learned from: crc32 of the id as text, divisible by 5; a null id belongs to it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
