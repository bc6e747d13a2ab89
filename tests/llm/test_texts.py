"""Quality, language, personal data, fingerprints, decontamination and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from staylens.llm import decontam, fingerprints, langid, pii, quality
from staylens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- quality: the model against a direct computation -------------------------------

def kneser_ney(counts):
    """Interpolated modified Kneser-Ney of byte 5-grams, straight from its definition."""
    levels = {5: Counter({g: c for g, c in counts.items() if c})}
    for k in range(4, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount = {}
    for k, table in levels.items():
        n = [sum(1 for c in table.values() if c == i) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else y * i for i in (1, 2, 3)]
        discount[k] = [0, *(min(max(x, 0.1), i - 0.1) for i, x in enumerate(d, 1))]
    cut = {k: (lambda c, d=discount[k]: d[min(c, 3)]) for k in levels}
    total, freed = ({k: Counter() for k in levels} for _ in range(2))
    for k, table in levels.items():
        for g, c in table.items():
            total[k][g[:-1]] += c
            freed[k][g[:-1]] += cut[k](c)

    def p(g):
        if not g:
            return 1 / 256
        k, t = len(g), total[len(g)][g[:-1]]
        if not t:
            return p(g[1:])
        c = levels[k][g]
        return (c - cut[k](c) if c else 0) / t + freed[k][g[:-1]] / t * p(g[1:])
    return p


def test_perplexity_is_that_of_the_definition(spark, frame, store):
    r = random.Random(4)
    texts = {i: "".join(r.choice("abc de") for _ in range(r.randint(0, 80))) for i in range(40)}
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    df = frame(list(texts.items()))
    fold = {x["doc_id"]: x["f"] for x in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("f")).collect()}
    got = {x["doc_id"]: x for x in quality.score(df, trusted, store).collect()}
    models = []
    for f in (0, 1):
        counts = Counter()
        for i in range(0, 40, 2):
            if fold[i] == f:
                raw = b"\0" * 4 + texts[i].encode()
                counts.update(raw[j:j + 5] for j in range(len(raw) - 4))
        models.append(kneser_ney(counts))
    for i, t in texts.items():
        raw = b"\0" * 4 + t.encode()
        want = sum(math.log(models[1 - fold[i]](raw[j:j + 5])) for j in range(len(raw) - 4))
        assert got[i]["n_bytes"] == len(t) and got[i]["log_prob"] == pytest.approx(want, abs=1e-6)


def test_classifier_keeps_clean_and_rejects_junk(spark):
    found = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_classifier_rejects_toxic_and_repeated_words(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = QUERIES["op3_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(docs, "doc_id")
    rows = found.collect()
    kept = {name: np.mean([r["keep"] for r in rows if is_in(r)]) for name, is_in in (
        ("good", lambda r: r["quality"] == 1 and not r["toxic"]), ("toxic", lambda r: r["quality"] == 1 and r["toxic"]),
        ("junk", lambda r: r["quality"] == 0),
        ("repeated", lambda r: r["quality"] == 0 and len(set(r["text"].lower().split())) * 8 < len(r["text"].split())))}
    print("kept", kept)
    assert kept["good"] > 0.99 and kept["toxic"] < 0.1 and kept["junk"] < 0.05 and kept["repeated"] < 0.05


def test_variety_of_stretches():
    assert quality.variety(["a"] * 7) is None and quality.variety(["a"] * 10) == 0.1
    assert quality.variety([f"w{i}" for i in range(50)] + ["a"] * 60) == (1 + 0.02) / 2


@pytest.mark.parametrize("part", [quality.ORDER, 7, 60, 10_000])
def test_long_texts_in_parts_equal_whole_ones(monkeypatch, part):
    r = random.Random(8)
    text = "".join(r.choice(["é", "İ", "a", "Bc", " ", "\n", "7", "日", "word ", "bad "]) for _ in range(800))
    plain = quality.grams(text.encode())
    found = quality._WORD.findall(text.lower())
    starts = range(0, len(found) - quality.STRETCH + 1, quality.STRETCH)
    mean = sum(len(set(found[i:i + quality.STRETCH])) for i in starts) / (quality.STRETCH * len(starts))
    monkeypatch.setattr(quality, "PART_BYTES", part)
    assert (np.concatenate(list(quality.gram_parts(text))) == plain).all() and len(starts) > 1
    assert quality.word_signs(quality.word_parts(text), {"bad"}) == (len(found), found.count("bad"), mean)
    assert quality.word_signs(quality.word_parts("")) == (0, 0, None) and not len(next(quality.gram_parts("")))


def test_quality_edges(spark, edges, nothing, edge_rows, store):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 0, 0), (17, 1, None), (None, 1, 0), (11, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    assert sorted(r["doc_id"] for r in quality.trusted_ids(labels).collect()) == [1, 11]
    got = quality.classify(edges, labels, store).collect()
    assert len(got) == len(edge_rows)
    assert all(r["keep"] and r["perplexity"] is None for r in got if not r["n_bytes"])
    kept = quality.keep_good(edges, labels, store)
    assert kept.columns == edges.columns and kept.where("doc_id = 1").count() == 1
    assert quality.classify(nothing, labels, store).collect() == []
    assert all(r["keep"] for r in quality.classify(edges, labels.limit(0), store).collect())


# --- language -----------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixture_finds_both(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    text = {r["lang"]: r["text"] for r in docs.where(langid.held_out() & (F.length("text") > 800)).collect()}
    both = spark.createDataFrame([(1, text["de"][:700] + "\n" + text["fr"][:700])], "doc_id long, text string")
    sets = dict(x.split(":") for x in langid.predict(both, model).first()["languages"].split(","))
    assert set(sets) == {"de", "fr"} and 0.3 < float(sets["de"]) < 0.7


def test_language_edges(edges, nothing, edge_rows):
    model = langid.train(edges)
    got = langid.predict(edges, model).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    for i in (5, 6, 7, 13):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[10]["lang_pred"] in ("en", "de")
    assert langid.predict(nothing, model).collect() == [] and langid.train(nothing)[0] == []
    assert {r["lang_pred"] for r in langid.predict(edges, langid.train(nothing)).collect()} == {"und"}


# --- personal data --------------------------------------------------------------------

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(x):
    out = [(0, m.start(), m.end()) for m in MAIL.finditer(x)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(x):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(x) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_patterns_equal_plain_ones():
    r = random.Random(5)
    for signs in ("ab@@..+1120 -()%é\n", "0123456789 -", "1234.", "+123 ()-.", "a@b.c"):
        for _ in range(6000):
            x = "".join(r.choice(signs) for _ in range(r.randint(0, 45)))
            assert pii.base_spans(x) == plain_spans(x)
    for x in ("4" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 100_000):
        pii.base_spans(x)                        # linear time on long runs


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger()


def test_shape_is_that_of_the_whole_word():
    long = "x" * 300
    assert "mail" in pii.shape(f"1{long}@y.org") and "mail" not in pii.shape(f"1{long}y.org")
    assert "n=16" in pii.shape(long + "4" * 16)
    assert "mail" in pii.shape("a1" * 100_000 + "@b.c")                         # linear on long words


def test_field_learns_its_table(tagger):
    for words, tags in pii.labelled_rows():
        assert len(tagger.spans([" ".join(words)])[0]) == sum(t % 2 for t in tags)


def test_viterbi_is_the_best_path(tagger):
    from itertools import product

    r = np.random.RandomState(1)
    k = len(pii.TAGS)
    for n in (1, 2, 3, 4):
        emit = r.randn(n, k) * 3

        def value(path, first):
            v, prev = 0.0, k if first else 0
            for t, a in enumerate(path):
                v += tagger.tr[prev, a] + emit[t, a]
                prev = a
            return v
        for first in (True, False):
            got = tagger.viterbi([emit], [first])[0]
            assert value(got, first) == pytest.approx(max(value(p, first) for p in product(range(k), repeat=n)))


def test_cutting_runs_changes_no_tag(tagger):
    r = random.Random(8)
    sample = ["word", "call", "4111111111111111", "10.0.0.1", "a.b@c.org", "+1", "(212)", "555-0187", "2019", "the", "of"]
    for _ in range(40):
        text = " ".join(r.choice(sample if r.random() < 0.3 else ["plain", "words"]) for _ in range(60))
        cut = tagger.spans([text])
        reach, tagger.reach = tagger.reach, 100
        whole = tagger.spans([text])
        tagger.reach = reach
        assert cut == whole


def test_pii_table(spark, edges, nothing, edge_rows):
    got = pii.find(edges).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[18]["masked"] == "mail <EMAIL> or <PHONE>, <IP>"
    assert [by[18][f"n_{k}"] for k in pii.KINDS] == [1, 1, 0, 1]
    clean = pii.redact(edges)
    assert clean.columns == edges.columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    before = {r[0]: r[1] for r in edge_rows}
    assert rows[18]["text"] == by[18]["masked"] and rows[18]["n_chars"] == len(by[18]["masked"])
    assert all(rows[i]["text"] == before[i] for i in before if i not in (18, None))
    assert pii.find(nothing).collect() == [] and pii.redact(nothing).collect() == []


def test_redaction_streams_rows_and_keeps_all_columns(spark):
    docs = spark.sql("""select id as doc_id, if(id % 3 = 0, null, concat('x@y.org ', repeat('long text ', 30000))) as text,
                        int(7) as n_chars, array(named_struct('a', id)) as s, cast(id as decimal(12, 3)) as d,
                        timestamp'2020-01-01' as at, cast('b' as binary) as raw from range(12)""")
    clean = pii.redact(docs)
    plan = clean._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan       # no batches of pandas beside waiting rows
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert clean.dtypes == docs.dtypes and sorted(clean.select(rest).collect()) == sorted(docs.select(rest).collect())
    masked = "<EMAIL> " + "long text " * 30000
    assert all((r["text"], r["n_chars"]) == ((None, 7) if r["doc_id"] % 3 == 0 else (masked, len(masked))) for r in clean.collect())


# --- fingerprints -----------------------------------------------------------------------

def test_entropy_of_every_window():
    raw = random.Random(1).randbytes(300) + b"a" * 100 + b"hello world foo bar " * 9
    buf = np.frombuffer(raw, np.uint8) % 40
    want = [-sum(c / 64 * math.log2(c / 64) for c in Counter(buf[i:i + 64].tolist()).values()) * 1000 / 6
            for i in range(len(buf) - 63)]
    assert np.abs(fingerprints.entropy_steps(buf) - np.array(want)).max() < 1.01


def test_fingerprints_of_all_documents(spark):
    rows = QUERIES["op6_fingerprints"](spark, SF).orderBy("doc_id").collect()
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    prints = {}
    for i, (r, t) in enumerate(zip(rows, texts)):
        half = len(t) // 2
        new = t[:len(t) - half] + texts[(i + 1) % len(texts)][:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a, b = (fingerprints.from_hex(r[c]) for c in ("fingerprint", "edited_fingerprint"))
        assert fingerprints.likeness(a, b) == r["near_edited"] == fingerprints.likeness(b, a)
    assert len(rows) == len(texts)
    long = [r for r in rows if r["n_chars"] > 2000]
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > 0.05 > np.median([r["near_next"] for r in long])


def test_fingerprint_edges(spark, edges, nothing, edge_rows, frame):
    rows = fingerprints.fingerprint_documents(edges).collect()
    assert len(rows) == len(edge_rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[5]["fingerprint"] == by[6]["fingerprint"] == "" and by[5]["near_next"] == 1.0
    assert by[3]["near_next"] < by[1]["near_next"]
    assert fingerprints.fingerprint_documents(nothing).collect() == []
    one = fingerprints.fingerprint_documents(frame([(7, "alone " * 40)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# --- decontamination ---------------------------------------------------------------------

def fewest_edits(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (x != c), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_lemma_and_alignment_lose_nothing():
    r = random.Random(3)
    for _ in range(250):
        item = "".join(r.choice("abcdefgh ") for _ in range(r.randint(5, 90))).strip() or "abcdefghij"
        x = list(item)
        for _ in range(r.randint(0, 7)):
            p, o = r.randrange(max(1, len(x))), r.random()
            if o < 0.33 and x:
                x[p] = r.choice("abcdefgh ")
            elif o < 0.66:
                x.insert(p, r.choice("abcdefgh "))
            elif x:
                x.pop(p)
        around = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60))) for _ in range(2)]
        text = f"{around[0]} {''.join(x)} {around[1]}"
        got = [h for h in decontam.Index([item, "zzzzzzzzzzzzzz"]).hits(["other", text, ""]) if h[1] == 0]
        if len(item) < decontam.Q:
            want = 0 if f" {item} " in f" {text} " else None
        else:
            want = fewest_edits(item, text)
            want = want if want <= decontam.budget(len(item))[0] else None
        assert (got[0][2] if got else None) == want
        if got and len(item) >= decontam.Q:
            assert fewest_edits(item, text[got[0][3]:got[0][4]]) == want


def banded_edits(item, text, low, high, most):
    """Fewest edits and first end, sign by sign on the diagonals low..high."""
    far = 10 ** 6
    prev = {j: 0 for j in range(max(0, low), min(len(text), high) + 1)}
    for i, c in enumerate(item, 1):
        cur = {}
        for j in range(i + low, i + high + 1):
            if 0 <= j <= len(text):
                cur[j] = min(prev.get(j - 1, far) + (j > 0 and text[j - 1] != c), prev.get(j, far) + 1, cur.get(j - 1, far) + 1)
        prev = cur
    best = min(((v, j) for j, v in prev.items()), default=(far, 0))
    return best if best[0] <= most else None


def test_candidates_are_aligned_side_by_side(monkeypatch):
    r = random.Random(8)
    jobs = []
    for _ in range(200):
        item = "".join(r.choice("abcd ") for _ in range(r.randint(8, 70)))
        text = "".join(r.choice("abcd ") if r.random() < 0.1 else c for c in item)
        text = "".join(r.choice("abcd ") for _ in range(r.randint(0, 40))) + text[r.randint(0, 3):]
        low = r.randint(-5, 40)
        jobs.append((item, text, low, low + r.randint(0, 30), r.randint(0, 9)))
    want = [banded_edits(*j) for j in jobs]
    assert None in want and sum(w is not None for w in want) > 20
    coded = [(decontam.points(j[0]), decontam.points(j[1]), *j[2:]) for j in jobs]
    calls = []
    one = decontam._side_by_side
    monkeypatch.setattr(decontam, "_side_by_side", lambda jobs, anywhere: calls.append(len(jobs)) or one(jobs, anywhere))
    got = decontam.aligns(coded)
    assert [x and (x[0], x[2]) for x in got] == want
    assert calls == [200, sum(w is not None for w in want)]
    monkeypatch.setattr(decontam, "ALIGN_CELLS", 500)                # a few at a time, long ones alone
    assert decontam.aligns(coded) == got == [decontam.align(*j) for j in coded] and decontam.aligns([]) == []
    calls.clear()
    monkeypatch.undo()
    monkeypatch.setattr(decontam, "_side_by_side", lambda jobs, anywhere: calls.append(len(jobs)) or one(jobs, anywhere))
    items = ["".join(r.choice("abcdefgh ") for _ in range(60)).strip() for _ in range(30)]
    found = decontam.Index(items).hits(["so " + t + " on" for t in items])
    assert {(d, i) for d, i, *_ in found} >= {(k, k) for k in range(30)} and len(calls) == 2


def test_an_item_with_7_percent_of_edits_is_found(spark):
    r = random.Random(12)
    text = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(40)]
    item = " ".join(text)
    for i in (5, 20, 35):
        text[i] = "zyxwvutsq"
    docs = spark.createDataFrame([(1, "before it " + " ".join(text) + " and after")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r["item_id"] for r in decontam.find(docs, items).collect()] == [7]


def test_decontamination_of_tables(spark, frame, edges, nothing):
    r = random.Random(6)
    items = [" ".join(f"q{r.randrange(900)}z" for _ in range(40)) for _ in range(3)]
    benchmark = spark.createDataFrame([(0, items[0]), (1, items[1]), (2, None), (3, ""), (4, items[2]), (None, "hm")],
                                      "item_id long, text string")
    near = items[1].split()
    near[7] = "x" + near[7]
    docs = frame([(1, "pre " + items[0].upper().replace(" ", "!! ") + " post"), (2, "a " + " ".join(near) + " b"),
                  (3, items[0][:100]), (4, None), (5, ""), (1, "pre " + items[0])])
    for size in (decontam.SLICE_CHARS, 200):
        got = decontam.find(docs, benchmark, slice_chars=size).collect()
        assert sorted((x["doc_id"], x["item_id"], x["edits"]) for x in got) == [(1, 0, 0), (1, 0, 0), (2, 1, 1)]
    kept = decontam.remove(docs, benchmark)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [3, 4, 5]
    assert decontam.find(nothing, benchmark).collect() == [] and decontam.find(docs, benchmark.limit(0)).collect() == []
    assert decontam.remove(edges, benchmark).count() == edges.count()


def test_decontamination_finds_exactly_the_contained_items(spark):
    def norm(s):
        return re.sub(r"[\W_]+", " ", s.lower()).strip()

    docs = {x["doc_id"]: norm(x["text"]) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = {x["item_id"]: norm(x["text"]) for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    got = {(x["doc_id"], x["item_id"]) for x in QUERIES["op7_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    assert got >= {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    assert all(fewest_edits(items[i], docs[d]) <= decontam.budget(len(items[i]))[0] for d, i in got)


# --- the pipeline ----------------------------------------------------------------------------

def test_stages_on_edges(spark, edges, nothing):
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            rows = out.collect()
            assert docs is edges or not rows


def test_pipeline_equals_its_stages_by_hand(spark, store):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r["doc_id"] for r in quality.classify(docs, labels, store).where("keep").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    from test_repeats import jaccard_truth

    texts = {i: texts[i] for i, (root, _, _) in jaccard_truth(texts).items() if root == i}
    items = [re.sub(r"[\W_]+", " ", r["text"].lower()).strip() for r in bench.collect()]
    index = decontam.Index(items)
    texts = {i: t for i, t in texts.items() if not index.hits([re.sub(r"[\W_]+", " ", t.lower()).strip()])}
    tagger = pii.Tagger()
    texts = {i: pii._masked(t, pii.all_spans(t, pii.base_spans(t), tagger.spans([t])[0])) for i, t in texts.items()}
    from test_tokens import check_pieces

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    check_pieces(rows, texts)
