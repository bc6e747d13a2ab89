"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is over byte 5-grams (a 5-gram is the five bytes of one bigint), trained
on every trusted text (label quality 1 and toxic 0).  Trusted texts lie in two
folds; each text is scored by the model of the fold it is not in.

1. Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash of their id and
   travel as compressed Arrow batches.  Each block counts its 5-grams once: trusted
   counts of both folds and the set of all 5-grams to score.
2. Counts are summed by 5-gram, lower orders count their distinct left extensions,
   and discounts come from the counts of counts (four numbers for each order and fold).
3. Every distinct 5-gram of the corpus gets its interpolated probability by joins of
   count tables sharded by n-gram and context, from order 1 up.
4. Each block joins its 5-grams with these probabilities, and its documents sum them.

A text is rejected for any of three signs, each held against trusted texts of its language:

* its entropy for each byte, drawn to the language's mean as if it had ``PRIOR_BYTES``
  more bytes, is beyond ``SLACK`` times the language's ``QUANTILE``;
* its share of hostile words, as if it had ``PRIOR_WORDS`` more words, is beyond the
  ``HOSTILE_QUANTILE``.  Hostile words are learned from the toxic labels of the other fold
  (``hostile_words``), as a few words vanish in the mean of a text;
* its variety, the mean share of different words in stretches of ``STRETCH`` words, is below
  ``VARIETY_SLACK`` times the ``VARIETY_QUANTILE``: repeated clean words have a low entropy.

Cases: a null or empty text has no perplexity and is kept; a null language is one of
its own; a language with fewer than ``LEAST_TRUSTED`` trusted texts uses the threshold
of all languages; without any trusted text all documents are kept; without toxic labels no word is hostile; a
text of fewer than ``LEAST_WORDS`` words has no variety; null ids share a
block; repeated rows are scored each; an empty table gives no row; a label table with
several rows for a document trusts it only if all rows do; other columns are ignored.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import Stored, gives_back

ORDER = 5
BLOCK_BYTES = 32 << 20       # larger blocks share more of their 5-grams
BLOB_LEVEL = 6
PART_BYTES = 1 << 20         # of a text at once
PRIOR_BYTES = 400
QUANTILE = 0.99
SLACK = 1.08
LEAST_TRUSTED = 30

LEAST_TOXIC, TOXIC_SHARE, TOXIC_RATIO = 3, 0.05, 20
PRIOR_WORDS, HOSTILE_QUANTILE = 200, 0.995
STRETCH, LEAST_WORDS = 50, 8
VARIETY_QUANTILE, VARIETY_SLACK = 0.01, 0.8
_WORD, _BREAK = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def grams(text: bytes) -> np.ndarray:
    """The 5-gram that ends at each byte; four zero bytes stand before the text."""
    b = np.frombuffer(b"\0" * (ORDER - 1) + text, np.uint8).astype(np.int64)
    n = len(text)
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = (out << 8) | b[k:k + n]
    return out


def _dump(batch) -> bytes:
    import pyarrow as pa

    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", BLOB_LEVEL))) as w:
        w.write_batch(batch)
    return sink.getvalue()


def _load(blob: bytes):
    """(doc_id, lang, fold, text) of each row, one text at a time."""
    import pyarrow as pa

    for part in pa.ipc.open_stream(blob):
        head = [part.column(c).to_pylist() for c in ("doc_id", "lang", "fold")]
        for *row, text in zip(*head, part.column("text")):
            yield *row, text.as_py() or ""


def gram_parts(text: str):
    """The 5-grams of a text in order, in arrays of bounded size."""
    raw = text.encode("utf-8", "surrogatepass")
    yield grams(raw[:PART_BYTES])
    for at in range(PART_BYTES, len(raw), PART_BYTES):
        yield grams(raw[at - ORDER + 1:at + PART_BYTES])[ORDER - 1:]


def _pack(batches):
    """Rows of one block in one batch become one compressed blob."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        for block in pc.unique(b.column("block")).to_pylist():
            part = b.filter(pc.equal(b.column("block"), block))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([None], pa.int64()),
                 pa.array([None], pa.float64()), pa.array([None], pa.float64()), pa.array([_dump(part)], pa.binary())],
                names=["block", "kind", "key", "v0", "v1", "blob"])


ROW = "block long, kind int, key long, v0 double, v1 double, blob binary"


def _block_of(col, blocks: int):
    return F.pmod(F.xxhash64(col), F.lit(blocks)).cast("long")


def packed(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, kind 1, ..., blob) with doc_id, lang, fold and text inside the blob."""
    return docs.select(_block_of("doc_id", blocks).alias("block"), "doc_id", "lang",
                       _fold().alias("fold"), "text") \
        .mapInArrow(gives_back(_pack), ROW)


def in_blocks(extra: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``extra`` (kind 0) before the documents of each block; blocks are dealt evenly, as a hash of
    so few of them would put several in one task and none in others."""
    tasks = min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return extra.unionByName(docs).repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")) \
        .sortWithinPartitions("block", "kind")


def _by_block(batches):
    """Yield (block, keys and values of its kind 0 rows, iterator of its blobs)."""
    from itertools import groupby

    def pieces():
        for b in batches:
            block, kind = np.asarray(b.column("block")), np.asarray(b.column("kind"))
            edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0) | (kind[1:] == 1)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(block)]):
                if e > s:
                    yield int(block[s]), int(kind[s]), b.slice(s, e - s)

    for block, found in groupby(pieces(), key=lambda p: p[0]):
        extra = []
        found = iter(found)
        first = None
        for _, kind, part in found:
            if kind == 1:
                first = part
                break
            extra.append(part)

        def blobs(first=first, found=found):
            if first is not None:
                yield first.column("blob")[0].as_py()
            for _, _, part in found:
                yield part.column("blob")[0].as_py()

        yield block, extra, blobs()


def _merge(sums, codes, weights):
    """Add (codes, weight rows) to sorted (codes, weight rows)."""
    keys = np.concatenate([sums[0], codes])
    values = np.concatenate([sums[1], weights])
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _count_rows(batches):
    import pyarrow as pa

    for block, extra, blobs in _by_block(batches):
        trusted = {x for part in extra for x in part.column("key").to_pylist()}
        sums = (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def flush(sums, held):
            for which, arrays in enumerate(held):
                if arrays:
                    codes, n = np.unique(np.concatenate(arrays), return_counts=True)
                    weights = np.zeros((len(codes), 2), np.int64)
                    if which < 2:
                        weights[:, which] = n
                    sums = _merge(sums, codes, weights)
            return sums

        for blob in blobs:
            for doc_id, _, fold, text in _load(blob):
                for g in gram_parts(text):
                    held[fold if doc_id in trusted else 2].append(g)
                    size += len(g)
                    if size > PART_BYTES:
                        sums, held, size = flush(sums, held), [[], [], []], 0
        codes, weights = flush(sums, held)
        if len(codes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), block, np.int64)), pa.array(codes), pa.array(weights[:, 0].copy()),
                 pa.array(weights[:, 1].copy())], names=["block", "g", "n0", "n1"])


FOLDS = (0, 1)


def _discounts(table: DataFrame) -> list[list[float]]:
    """Modified Kneser-Ney discounts of each fold from its counts of counts."""
    n = table.agg(*[F.sum((F.col(f"c{f}") == i).cast("long")).alias(f"n{f}{i}") for f in FOLDS for i in (1, 2, 3, 4)]).first()
    out = []
    for f in FOLDS:
        n1, n2, n3, n4 = (n[f"n{f}{i}"] or 0 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [i - (i + 1) * y * b / a if a else y * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        out.append([min(max(x, 0.1), i - 0.1) for i, x in enumerate(d, 1)])
    return out


def _low(k: int):
    """Column: the last k bytes of a gram."""
    return F.col("g").bitwiseAND(F.lit((1 << (8 * k)) - 1))


def probabilities(counts: DataFrame, store: Stored) -> DataFrame:
    """(g, lp0, lp1): natural log-probability of the last byte of every 5-gram given the others, in
    the model of each fold.  ``counts`` is a stored table of g, n0, n1 (trusted counts, 0 where unseen).

    Level k has every k-gram that ends a 5-gram, seen or not, with both folds in one row; a context has at
    most 256 followers, so a window sums them without a join, and only the next lower order is joined."""
    levels = {ORDER: counts.select("g", *[F.col(f"n{f}").alias(f"c{f}") for f in FOLDS])}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = store.write(levels[k + 1].groupBy(_low(k).alias("g")).agg(
            *[F.sum((F.col(f"c{f}") > 0).cast("long")).alias(f"c{f}") for f in FOLDS]), f"order{k}")
    context = Window.partitionBy(F.shiftright("g", 8))
    p = None
    for k in range(1, ORDER + 1):
        rows = levels[k]
        for f, (a, b, e) in zip(FOLDS, _discounts(rows)):
            c = F.col(f"c{f}")
            rows = rows.withColumn(f"d{f}", F.when(c == 0, 0.0).when(c == 1, a).when(c == 2, b).otherwise(e))
        rows = rows.select("g", *[x for f in FOLDS for x in (
            (F.col(f"c{f}") - F.col(f"d{f}")).alias(f"own{f}"), F.sum(f"c{f}").over(context).alias(f"total{f}"),
            F.sum(f"d{f}").over(context).alias(f"freed{f}"))])
        if p is None:
            rows = rows.withColumns({f"p{f}": F.lit(1 / 256) for f in FOLDS})
        else:
            rows = rows.withColumn("suffix", _low(k - 1)).join(p.withColumnRenamed("g", "suffix"), "suffix")
        now = [F.coalesce(F.try_divide(F.col(f"own{f}") + F.col(f"freed{f}") * F.col(f"p{f}"), F.col(f"total{f}")),
                          F.col(f"p{f}")) for f in FOLDS]
        if k == ORDER:
            return store.write(rows.select("g", *[F.log(x).alias(f"lp{f}") for f, x in zip(FOLDS, now)]), "known")
        p = store.write(rows.select("g", *[x.alias(f"p{f}") for f, x in zip(FOLDS, now)]), f"p{k}")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_parts(text: str):
    """The words of a text in order, in lists of bounded size."""
    text, at = text.lower(), 0
    while len(text) - at > PART_BYTES and (cut := _BREAK.search(text, at + PART_BYTES)):
        yield _WORD.findall(text, at, cut.start())
        at = cut.start()
    yield _WORD.findall(text, at)


def word_signs(parts, bad=()) -> tuple[int, int, float | None]:
    """Words, hostile words and variety: the mean share of different words in whole stretches; a
    shorter text is one stretch, one of fewer than LEAST_WORDS words has none."""
    n = n_bad = stretches = different = 0
    rest: list[str] = []
    for found in parts:
        n += len(found)
        n_bad += sum(w in bad for w in found) if bad else 0
        rest += found
        whole = len(rest) // STRETCH
        stretches += whole
        different += sum(len(set(rest[i * STRETCH:(i + 1) * STRETCH])) for i in range(whole))
        rest = rest[whole * STRETCH:]
    if n < LEAST_WORDS:
        return n, n_bad, None
    return n, n_bad, different / (STRETCH * stretches) if stretches else len(set(rest)) / n


def variety(found: list[str]) -> float | None:
    return word_signs([found])[2]


def _texts_with(docs: DataFrame, ids: DataFrame, only: dict | None = None) -> DataFrame:
    """(lang, fold, word, n): texts of ``ids`` that hold a word, and all of them under the empty word;
    ``only`` names the words of each language to count."""
    def count(batches):
        import pyarrow as pa

        for b in batches:
            sums = Counter()
            for lang, fold, text in zip(*(b.column(c).to_pylist() for c in ("lang", "fold", "text"))):
                found = set(words(text))
                if only is not None:
                    found &= only.get(lang, set())
                sums.update((lang, fold, w) for w in ["", *found])
            lang, fold, word = zip(*sums) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(fold, pa.int32()), pa.array(word, pa.string()),
                                              pa.array(list(sums.values()), pa.int64())], names=["lang", "fold", "word", "n"])

    return docs.join(ids, "doc_id", "left_semi").select("lang", _fold().alias("fold"), "text") \
        .mapInArrow(gives_back(count), "lang string, fold int, word string, n long").groupBy("lang", "fold", "word").agg(F.sum("n").alias("n"))


def _fold():
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")


def hostile_words(docs: DataFrame, trusted: DataFrame, toxic: DataFrame) -> dict:
    """{(lang, fold): words}: words that at least LEAST_TOXIC toxic texts of the fold and the share
    TOXIC_SHARE of them hold, TOXIC_RATIO times as often as its trusted texts.  The share bounds the
    words that reach the driver by 1 / TOXIC_SHARE times the different words of a mean text."""
    seen = _texts_with(docs, toxic)
    n_toxic = {(r["lang"], r["fold"]): r["n"] for r in seen.where("word = ''").collect()}       # one row a language and fold
    least = F.lit(LEAST_TOXIC).cast("double")
    for (lang, fold), n in n_toxic.items():
        here = F.col("lang").eqNullSafe(F.lit(lang)) & (F.col("fold") == fold)
        least = F.when(here, float(max(LEAST_TOXIC, TOXIC_SHARE * n))).otherwise(least)
    often = seen.where("word <> ''").where(F.col("n") >= least).collect() if n_toxic else []
    only: dict = {}
    for r in often:
        only.setdefault(r["lang"], set()).add(r["word"])
    clean = {(r["lang"], r["fold"], r["word"]): r["n"] for r in _texts_with(docs, trusted, only).collect()} if often else {}
    out: dict = {}
    for r in often:
        at = r["lang"], r["fold"]
        if r["n"] / n_toxic[at] >= TOXIC_RATIO * (clean.get((*at, r["word"]), 0) + 0.5) / max(clean.get((*at, ""), 0), 1):
            out.setdefault(at, set()).add(r["word"])
    return out


def _score_rows(batches, hostile):
    import pyarrow as pa

    for _, extra, blobs in _by_block(batches):
        key = np.concatenate([np.asarray(p.column("key")) for p in extra]) if extra else np.zeros(0, np.int64)
        order = np.argsort(key)
        key = key[order]
        value = [np.concatenate([np.asarray(p.column(c)) for p in extra])[order] if extra else np.zeros(0)
                 for c in ("v0", "v1")]
        for blob in blobs:
            rows = []
            for doc_id, lang, fold, text in _load(blob):
                n, lp = 0, 0.0
                for g in gram_parts(text):
                    n += len(g)
                    lp += float(value[1 - fold][np.searchsorted(key, g)].sum()) if len(g) else 0.0
                rows.append((doc_id, lang, n, lp, *word_signs(word_parts(text), hostile.get((lang, 1 - fold), ()))))
            doc_id, lang, n, lp, n_words, n_hostile, varied = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(lang, pa.string()), pa.array(n, pa.int64()), pa.array(lp, pa.float64()),
                 pa.array(n_words, pa.int64()), pa.array(n_hostile, pa.int64()), pa.array(varied, pa.float64())],
                names=["doc_id", "lang", "n_bytes", "log_prob", "n_words", "n_hostile", "variety"])


def score(docs: DataFrame, trusted: DataFrame, store: Stored, id_col="doc_id", text_col="text", lang_col="lang",
          toxic: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, n_bytes, log_prob, n_words, n_hostile, variety of every text; ``trusted`` and
    ``toxic`` have the doc_id of trusted and of toxic ones."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(text_col).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    hostile = {} if toxic is None else hostile_words(src, trusted, toxic)
    docs_in = packed(src, blocks)
    none = [F.lit(None).cast("double").alias(c) for c in ("v0", "v1")]
    labels = trusted.select(_block_of("doc_id", blocks).alias("block"), F.lit(0).alias("kind"), F.col("doc_id").alias("key"),
                            *none, F.lit(None).cast("binary").alias("blob"))
    counted = store.write(in_blocks(labels, docs_in, blocks).mapInArrow(gives_back(_count_rows), "block long, g long, n0 long, n1 long"), "counts")
    types = store.write(counted.groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "types")
    known = probabilities(types, store)
    wanted = store.write(counted.select("block", "g").join(known, "g"), "wanted")
    store.drop("counts", "types", "known", *[f"{a}{k}" for a in ("order", "p") for k in range(1, ORDER)])
    wanted = wanted.select("block", F.lit(0).alias("kind"), F.col("g").alias("key"), F.col("lp0").alias("v0"),
                           F.col("lp1").alias("v1"), F.lit(None).cast("binary").alias("blob"))
    out = store.write(in_blocks(wanted, docs_in, blocks).mapInArrow(
        gives_back(lambda batches: _score_rows(batches, hostile)),
        "doc_id long, lang string, n_bytes long, log_prob double, n_words long, n_hostile long, variety double"), "scores")
    store.drop("wanted")
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that all their label rows call good and not toxic."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min((F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(1)) == 0)).alias("ok")) \
        .where("ok").select(F.col("doc_id").cast("long").alias("doc_id"))


def toxic_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that some label row calls good prose and toxic."""
    return labels.where("doc_id is not null and quality = 1 and toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def classify(docs: DataFrame, labels: DataFrame, store: Stored, quantile: float = QUANTILE, slack: float = SLACK,
             id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (for each byte), entropy (drawn to the mean), threshold, keep."""
    # stored, so that Spark knows their bytes: only small ones are broadcast
    trusted, toxic = store.write(trusted_ids(labels), "trusted"), store.write(toxic_ids(labels), "toxic")
    scores = score(docs, trusted, store, id_col, text_col, lang_col, toxic)
    own = -F.col("log_prob") / F.col("n_bytes")
    good = scores.where("n_bytes > 0").join(trusted, "doc_id", "left_semi").select(
        "lang", "n_bytes", own.alias("h"), "n_words", "n_hostile", "variety")
    mean = good.groupBy("lang").agg(F.avg("h").alias("mean"), F.count("*").alias("n"))
    overall = good.agg(F.avg("h").alias("mean")).first()["mean"]      # one number
    drawn = (F.col("h") * F.col("n_bytes") + F.col("mean") * PRIOR_BYTES) / (F.col("n_bytes") + PRIOR_BYTES)
    share = F.col("n_hostile") / (F.col("n_words") + PRIOR_WORDS)
    limits = good.join(F.broadcast(mean.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l"))) \
        .groupBy("lang").agg(F.percentile_approx(drawn, quantile, 10000).alias("q"), F.first("mean").alias("mean"),
                             F.percentile_approx(share, HOSTILE_QUANTILE, 10000).alias("hostile"),
                             F.percentile_approx("variety", VARIETY_QUANTILE, 10000).alias("variety"),
                             F.first("n").alias("n")).collect()       # one row a language
    usual = [r for r in limits if r["n"] >= LEAST_TRUSTED]
    all_q = max((r["q"] for r in usual), default=max((r["q"] for r in limits), default=None))
    mean_of, limit_of = F.lit(overall).cast("double"), F.lit(None if all_q is None else all_q * slack).cast("double")
    hostile_of = F.lit(max((r["hostile"] for r in usual or limits), default=None)).cast("double")
    least_of = F.lit(min((r["variety"] for r in usual or limits if r["variety"] is not None), default=None)).cast("double")
    for r in usual:
        here = F.col("lang").eqNullSafe(F.lit(r["lang"]))
        hostile_of = F.when(here, r["hostile"]).otherwise(hostile_of)
        least_of = F.when(here & F.lit(r["variety"] is not None), F.lit(r["variety"]).cast("double")).otherwise(least_of)
        mean_of = F.when(here, r["mean"]).otherwise(mean_of)
        limit_of = F.when(here, r["q"] * slack).otherwise(limit_of)
    out = scores.withColumn("mean", mean_of).withColumn("threshold", limit_of) \
        .withColumn("h", F.when(F.col("n_bytes") > 0, own)).withColumn("entropy", drawn)
    signs = [F.col("entropy") > F.col("threshold"), share > hostile_of, F.col("variety") < least_of * VARIETY_SLACK]
    reject = F.lit(False)
    for sign in signs:
        reject = reject | F.coalesce(sign, F.lit(False))
    return out.select("doc_id", "lang", "n_bytes", F.exp("h").alias("perplexity"), "entropy", "threshold", (~reject).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, store: Stored, **columns) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    rejected = store.write(classify(docs, labels, store, **columns).where("not keep").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, docs["doc_id"] == rejected["doc_id"], "left_anti")
