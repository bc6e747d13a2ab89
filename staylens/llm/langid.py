"""Language identification by multilingual mixture inference.

Each language has a distribution over byte trigrams of its lower-cased words
(hashed into 2**16 buckets), learned from every labelled text, and mixed with
the distribution of all languages so that unseen trigrams weigh alike.  A
text's trigrams are taken as drawn from a mixture of languages:
expectation-maximisation finds its proportions, then nested sets of its
likeliest languages are refitted and the set with the best likelihood less a
penalty for each language is kept.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows
with null labels teach nothing; without any labelled row all texts are
``und``; a null id counts as an empty one when folds are dealt; an empty table
gives no row; other columns are ignored; ties go to the alphabetically first
language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import arrow_texts

BUCKETS = 1 << 16
SHARED = 0.02           # weight of the distribution of all languages
ROUNDS = 12
PENALTY = 6.0           # nats for each language beyond the first, per unit of log(trigrams)
TEMPER = 1 / 3          # neighbouring trigrams share two bytes
LEAST_SHARE = 0.01
UNKNOWN = "und"

_KIND = np.zeros(256, np.uint8)         # 0: not part of a word
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha() or _b >= 0x80:
        _KIND[_b] = 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every trigram that touches a letter byte."""
    import pyarrow as pa

    data, off = arrow_texts(pa.array([" " + t.lower() + "  " for t in texts], pa.large_string()))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.where(_KIND[data] == 1, data, 0x20).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    row = np.repeat(np.arange(len(texts)), np.diff(off))[:len(code)]
    ok = (b[1:-1] != 0x20)
    code = code[ok] * np.uint32(2654435761)
    return row[ok], (code >> np.uint32(16)).astype(np.int64)


def count_trigrams(docs: DataFrame, id_col="text", lang_col="lang") -> DataFrame:
    """(lang, bucket, n) over all rows; each task sums its own first."""
    def run(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                langs = part.column(1).to_pylist()
                row, bucket = trigrams([t or "" for t in part.column(0).to_pylist()])
                names = sorted(set(langs))
                index = {x: i for i, x in enumerate(names)}
                which = np.array([index[x] for x in langs])[row] if len(row) else row
                counts = np.bincount(which * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for x, i in index.items():
                    total[x] = total.get(x, 0) + counts[i * BUCKETS:(i + 1) * BUCKETS]
        for x, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                                             names=["lang", "bucket", "n"])

    return docs.select(F.col(id_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where("lang is not null").mapInArrow(run, "lang string, bucket long, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by bucket and language).  The model is bounded by languages x 2**16."""
    rows = count_trigrams(labelled).toPandas()
    langs = sorted(rows["lang"].unique())
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["bucket"].to_numpy(), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = rows["n"]
    shared = counts.sum(axis=1) + 0.5
    own = counts / np.maximum(counts.sum(axis=0), 1)
    return langs, (1 - SHARED) * own + SHARED * (shared / shared.sum())[:, None]


def _fit(p, n, first, row, weight, total, rounds):
    """Proportions of each text by expectation-maximisation from ``weight``; the last log-likelihood."""
    for _ in range(rounds):
        joint = p * weight[row]
        mass = joint.sum(axis=1)
        weight = np.add.reduceat(joint * (n / mass)[:, None], first) / total[:, None]
    return weight, np.add.reduceat(n * np.log((p * weight[row]).sum(axis=1)), first)


def mixtures(row: np.ndarray, bucket: np.ndarray, count: int, model: np.ndarray):
    """(texts that have trigrams, their proportions over the selected languages)."""
    key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    n = n.astype(float)
    doc = key // BUCKETS
    present, first, row = np.unique(doc, return_index=True, return_inverse=True)
    p = model[key % BUCKETS]
    total = np.add.reduceat(n, first)
    langs = model.shape[1]
    full, _ = _fit(p, n, first, row, np.full((len(present), langs), 1 / langs), total, ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    best, best_score = None, None
    for size in range(1, max(1, int((full >= LEAST_SHARE).sum(axis=1).max())) + 1):
        weight = np.where(place < size, np.maximum(full, 1e-6), 0)
        weight /= weight.sum(axis=1, keepdims=True)
        weight, like = _fit(p, n, first, row, weight, total, 0 if size == 1 else ROUNDS // 2)
        score = like * TEMPER - PENALTY * (size - 1) * np.log(total + 1)
        if best is None:
            best, best_score = weight, score
        else:
            better = score > best_score
            best[better], best_score[better] = weight[better], score[better]
    return present, best


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score (its share of the text), languages (all selected ones with shares)."""
    langs, table = model

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                texts = [t or "" for t in part.column(1).to_pylist()]
                pred, score, sets = [UNKNOWN] * len(texts), [0.0] * len(texts), [""] * len(texts)
                row, bucket = trigrams(texts)
                if len(row) and langs:
                    present, weight = mixtures(row, bucket, len(texts), table)
                    for i, w in zip(present.tolist(), weight):
                        if not any(c.isalpha() for c in texts[i]):
                            continue
                        chosen = sorted(((-w[j], langs[j]) for j in np.flatnonzero(w >= LEAST_SHARE)))
                        pred[i], score[i] = chosen[0][1], float(min(1.0, -chosen[0][0]))
                        sets[i] = ",".join(f"{x}:{-v:.4f}" for v, x in chosen)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.string())],
                    names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def held_out(col="doc_id", folds: int = 5):
    """The fold that teaches nothing: crc32 of the id as text is a multiple of ``folds``."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds == 0
