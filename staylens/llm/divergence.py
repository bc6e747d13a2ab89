"""Source divergence audit: which terms set the sources of a language apart, and by how much.

Terms are found by iceberg prefix refinement.  A level extends the byte prefixes of the terms
to twice the length; a prefix that fewer than ``min_docs`` distinct documents of its language
hold is dropped with all terms below it, and a term that ends within the level is complete.
The levels go on until no longer prefix is left.  Each level is one pass over the stored terms
of the documents: tasks count the distinct documents of a batch, the surviving parents filter
these counts (a semi join, broadcast only if small), and one aggregation adds them up.

Every group (lang, source) gives each of the V kept terms of its language
p = 1 + floor(10^9 (count + 5) / (N + 5 V)) in integer arithmetic.  ``pair`` compares a group
with each other source of the language (sum of |p - q| over all kept terms, by tiles of sources
and terms), ``term`` lists the terms it uses more than its language, up to ``top``.

Edge cases.  Null text, lang or source is ''.  Every row is a document, repeated rows too.
A group whose documents hold no term has count 0 everywhere; a language without kept terms
gives pairs of value 0 and no terms; an empty table gives no rows.  Long texts are read in
pieces, further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import Stored
from staylens.llm.terms import LETTERS, as_binary, binary_values, counted, parts, small, spaced

MIN_DOCS = 30
TOP = 50
FIRST_LEVEL = 2
TILE_TERMS, TILE_SOURCES = 4096, 256
SCALE, ADDED = 1_000_000_000, 5            # of p
DIGITS = (10_000, 10_000, 10)              # their product is SCALE


def document_terms(docs: DataFrame, lang_col="lang", source_col="source", text_col="text") -> DataFrame:
    """lang, source, terms (the distinct terms, a space after each) and n (their counts, little-endian
    unsigned 32-bit) of every document; two byte strings a document cost the JVM little."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, off in parts(batch):
                of, code, n, names = counted(data, off, LETTERS)
                values, offsets = spaced(*binary_values(names.take(pa.array(code))))
                edge = np.searchsorted(of, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("source"), as_binary(values, offsets[edge]),
                     as_binary(n.astype("<u4").view(np.uint8), 4 * edge)], names=["lang", "source", "terms", "n"])

    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                        for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return src.mapInArrow(run, "lang string, source string, terms binary, n binary")


def _flat(batch):
    """(row of each term, the terms) of the terms of a batch."""
    values, off = binary_values(batch.column("terms"))
    base = int(off[0])
    low = values[base:int(off[-1])]
    end = np.flatnonzero(low == 0x20)
    size = np.diff(np.concatenate([[-1], end])) - 1
    return np.searchsorted(off[1:] - base, end, "right"), \
        as_binary(low[low != 0x20], np.concatenate([[0], np.cumsum(size)]))


def _coded(column):
    found = column.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


def prefixes(terms: DataFrame, done: int, length: int) -> DataFrame:
    """lang, prefix, whole (a complete term), n (distinct documents of a batch) for the terms longer than ``done``."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            doc, term = _flat(batch)
            size = np.asarray(pc.binary_length(term))
            longer = np.flatnonzero(size > done)
            if not len(longer):
                continue
            code, names = _coded(pc.binary_slice(term.take(pa.array(longer)), 0, length))
            item = code * 2 + (size[longer] <= length)
            width = 2 * len(names)
            seen = np.unique(doc[longer] * width + item)                # a document counts once
            lang, langs = _coded(batch.column("lang"))
            key, n = np.unique(lang[seen // width] * width + seen % width, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(key // width)), names.take(pa.array(key % width // 2)),
                 pa.array(key % 2 == 1), pa.array(n)], names=["lang", "prefix", "whole", "n"])

    return terms.select("lang", "terms").mapInArrow(run, "lang string, prefix binary, whole boolean, n long")


def kept_terms(terms: DataFrame, store: Stored, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n_docs of the terms that at least ``min_docs`` documents of the language hold."""
    done, length, kept, alive = 0, FIRST_LEVEL, [], None
    while True:
        found = prefixes(terms, done, length).withColumn("parent", F.substring("prefix", 1, done))
        if alive is not None:
            found = found.join(small(alive), ["lang", "parent"], "left_semi")
        level = store.write(found.groupBy("lang", "parent", "prefix", "whole").agg(F.sum("n").alias("n_docs"))
                            .where(F.col("n_docs") >= min_docs).drop("parent"), f"level-{length}")
        kept.append(level.where("whole").select("lang", F.col("prefix").alias("term"), "n_docs"))
        alive = level.where("not whole").select("lang", F.col("prefix").alias("parent"))
        if alive.isEmpty():
            break
        done, length = length, length * 2
    out = kept[0]
    for level in kept[1:]:
        out = out.unionByName(level)
    return store.write(out, "kept")


def group_counts(terms: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, count and of_lang of the kept terms that occur in a group.

    Tasks add up a batch and give one row for each term, with the lists of its sources and counts; the
    kept terms filter these rows, equal terms meet in sorted partitions, and their lists are added up."""
    def lists(batches):
        import pyarrow as pa

        for batch in batches:
            doc, term = _flat(batch)
            if not len(term):
                continue
            code, names = _coded(term)
            lang, langs = _coded(batch.column("lang"))
            source, sources = _coded(batch.column("source"))
            values, off = binary_values(batch.column("n"))
            n = np.frombuffer(values[int(off[0]):int(off[-1])].tobytes(), "<u4")
            key, at = np.unique((lang[doc] * len(names) + code) * len(sources) + source[doc], return_inverse=True)
            total = np.bincount(at, n).astype(np.int64)
            yield _term_rows(langs, names, sources, key, total)

    def sums(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            term, lang = rows.column("term"), rows.column("lang")
            same = np.asarray(pc_equal(term, len(term) - 1)) & np.asarray(pc_equal(lang, len(lang) - 1))
            first = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0      # where the last term begins
            if first:
                yield _summed(rows.slice(0, first))
            held = rows.slice(first)
        if held is not None and len(held):
            yield _summed(held)

    found = terms.mapInArrow(lists, "lang string, term binary, sources array<string>, n array<long>")
    return found.join(small(kept.select("lang", "term")), ["lang", "term"], "left_semi") \
        .repartition("lang", "term").sortWithinPartitions("lang", "term") \
        .mapInArrow(sums, "lang string, source string, term binary, count long, of_lang long")


def pc_equal(column, at: int):
    import pyarrow.compute as pc

    return pc.equal(column, column[at])


def _term_rows(langs, names, sources, key, total):
    """A row for each (lang, term) of sorted keys, with lists of sources and counts."""
    import pyarrow as pa

    group = key // len(sources)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    edge = pa.array(np.append(first, len(key)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(group[first] // len(names))), names.take(pa.array(group[first] % len(names))),
         pa.ListArray.from_arrays(edge, sources.take(pa.array(key % len(sources)))),
         pa.ListArray.from_arrays(edge, pa.array(total))], names=["lang", "term", "sources", "n"])


def _summed(rows):
    """lang, source, term, count and of_lang (the count in the language) of whole runs of terms."""
    import pyarrow as pa

    rows = rows.combine_chunks()
    lists = rows.column("sources").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    of = np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()))
    lang, langs = _coded(rows.column("lang").combine_chunks())
    term, names = _coded(rows.column("term").combine_chunks())
    source, sources = _coded(lists.flatten())
    n = np.asarray(rows.column("n").combine_chunks().flatten())
    key, at = np.unique((lang * len(names) + term)[of] * len(sources) + source, return_inverse=True)
    total = np.bincount(at, n).astype(np.int64)
    group = key // len(sources)
    term_at = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(group // len(names))), sources.take(pa.array(key % len(sources))),
         names.take(pa.array(group % len(names))), pa.array(total), pa.array(np.bincount(term_at, total).astype(np.int64)[term_at])],
        names=["lang", "source", "term", "count", "of_lang"])


def _p(count, total, kept):
    """1 + floor(10^9 (count + ADDED) / (total + ADDED kept)) in whole numbers, four digits a step, so that no
    product passes 63 bits while the divisor is below 9 * 10^14."""
    below = F.nullif(F.coalesce(total, F.lit(0)) + ADDED * F.coalesce(kept, F.lit(0)), F.lit(0).cast("long"))
    rest, found = F.coalesce(count, F.lit(0)) + ADDED, F.lit(0).cast("long")
    for digits in DIGITS:
        rest = rest * F.lit(digits).cast("long")
        found, rest = found * F.lit(digits).cast("long") + F.call_function("div", rest, below), rest % below
    return found + 1


def _tiles(pdf):
    """Sums of |p - q| over the terms of a tile for the pairs of its sources, and how many terms it has."""
    import pandas as pd

    heads, rows = pdf[pdf["term"].isna()], pdf[pdf["term"].notna()]
    heads = heads.drop_duplicates("source").sort_values(["at", "source"]).reset_index(drop=True)
    place = {s: k for k, s in enumerate(heads["source"])}
    term, names = pd.factorize(rows["term"])
    p = np.repeat(heads["p"].fillna(0).to_numpy(np.int64)[:, None], len(names), axis=1)
    p[rows["source"].map(place).to_numpy(np.int64), term] = rows["p"].to_numpy(np.int64)
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    at, sources = heads["at"].to_numpy(), heads["source"].to_numpy(object)
    first, second, total = [], [], []
    for a in np.flatnonzero(at == i):
        other = np.arange(a + 1, len(p)) if i == j else np.flatnonzero(at == j)
        first.append(np.full(len(other), a))
        second.append(other)
        total.append(np.abs(p[other] - p[a]).sum(axis=1))
    first, second, total = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (first, second, total))
    return pd.DataFrame({"lang": np.full(len(first), pdf["lang"].iloc[0], object), "source": sources[first],
                         "item": sources[second], "total": total, "n_terms": len(names)})


def pair_sums(groups: DataFrame, p: DataFrame, max_terms: int, max_sources: int) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language.

    Terms and sources are dealt into tiles of about TILE_TERMS terms and two blocks of TILE_SOURCES
    sources; a tile holds the sources' p of its terms and, as head rows, their p of a term they lack.
    Kept terms that neither source of a pair holds in a tile's blocks add |p0 - q0| each."""
    terms, blocks = -(-max(max_terms, 1) // TILE_TERMS), -(-max(max_sources, 1) // TILE_SOURCES)
    at = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    heads = groups.select("lang", "source", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"), at.alias("at"),
                          F.explode(F.sequence(F.lit(0), F.lit(terms - 1))).alias("tile"))
    rows = p.select("lang", "source", "term", "p", at.alias("at"), F.pmod(F.xxhash64("term"), F.lit(terms)).cast("int").alias("tile"))
    dealt = heads.unionByName(rows).withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .withColumn("i", F.least("at", "_with")).withColumn("j", F.greatest("at", "_with")).drop("_with")
    part = dealt.groupBy("lang", "tile", "i", "j").applyInPandas(
        _tiles, "lang string, source string, item string, total long, n_terms long")
    one = part.groupBy("lang", "source", "item").agg(F.sum("total").alias("total"), F.sum("n_terms").alias("n_terms"))
    both = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "total", "n_terms"))
    own = groups.select("lang", "source", "kept", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    rest = (F.col("kept") - F.col("n_terms")) * F.abs(F.col("p0") - F.col("q0"))
    return both.join(own, ["lang", "source"]).join(other, ["lang", "item"]).select(
        "lang", "source", "item", (F.col("total") + F.coalesce(rest, F.lit(0))).alias("value"))


def audit(docs: DataFrame, store: Stored, min_docs: int = MIN_DOCS, top: int = TOP,
          lang_col="lang", source_col="source", text_col="text") -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    terms = store.write(document_terms(docs, lang_col, source_col, text_col), "terms")
    kept = kept_terms(terms, store, min_docs)
    counts = store.write(group_counts(terms, kept), "counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = terms.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left") \
        .select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), "total")
    groups = store.write(groups.withColumn("p0", _p(F.lit(0), F.col("total"), F.col("kept"))), "groups")
    store.drop("terms")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    p = counts.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("count"), F.col("total"), F.col("kept")))
    high = p.join(of_lang, "lang") \
        .withColumn("q", _p(F.col("of_lang"), F.col("all"), F.col("kept"))).where("p > q") \
        .select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    most = groups.groupBy("lang").agg(F.max("kept").alias("v"), F.count("*").alias("s")) \
        .agg(F.max("v").alias("v"), F.max("s").alias("s")).first()
    pairs = pair_sums(groups, p.select("lang", "source", "term", "p"), most["v"] or 0, most["s"] or 0)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))

    def ranked(df, part):
        return df.withColumn("rank", F.row_number().over(order)) \
            .select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pairs, "pair").unionByName(ranked(high, "term").where(F.col("rank") <= top))


LOWERED = ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''){LOWERED}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
gt AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang)
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (SELECT lang, source, term, n, 1 + CAST(n + {ADDED} AS HUGEINT) * {SCALE}
    // (sum(n) OVER (PARTITION BY lang, source) + {ADDED} * v.v) AS p FROM gt JOIN v USING (lang)),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lp AS (SELECT lang, term, 1 + CAST(n + {ADDED} AS HUGEINT) * {SCALE}
    // (sum(n) OVER (PARTITION BY lang) + {ADDED} * v.v) AS q FROM lt JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM gp JOIN lp USING (lang, term) WHERE gp.n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP}"""
