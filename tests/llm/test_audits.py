"""Source divergence, licence scan and target resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from staylens.llm import divergence, license_scan, resample, terms
from staylens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FIELDS = ("lang", "source", "part", "item", "value", "rank")


def lowered(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def letters(text):
    return lowered(text, "[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def alnum(text):
    return lowered(text, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- the words ------------------------------------------------------------------------

@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_of_buffers(piece):
    r = random.Random(5)
    texts = ["", "A", "a1", "é.É", *("".join(r.choice("aB1 .\né日") for _ in range(r.randrange(90))) for _ in range(60))]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for member, words in ((terms.LETTERS, letters), (terms.ALNUM, alnum)):
        got = [Counter() for _ in texts]
        for k in range(len(texts)):
            of, code, n, names = terms.counted(data, off[k:k + 2], member, piece)
            got[k].update(dict(zip((names[c].as_py().decode() for c in code.tolist()), n.tolist())))
        assert got == [Counter(words(t)) for t in texts]
        of, code, n, names = terms.counted(data, off, member)
        joint = defaultdict(Counter)
        for o, c, m in zip(of.tolist(), code.tolist(), n.tolist()):
            joint[o][names[c].as_py().decode()] += m
        assert [joint[k] for k in range(len(texts))] == got


# --- divergence --------------------------------------------------------------------------

def audit_by_hand(rows, min_docs, top):
    docs = [(r[2] or "", r[3] or "", Counter(letters(r[1]))) for r in rows]
    held, count, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, found in docs:
        held[lang].update(found.keys())
        count[lang, source].update(found)
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = sorted({s for x, s in count if x == lang})

        def shares(c):
            below = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // below for t in kept}
        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(order, 1)]
    return sorted(out)


def source_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, p string")


def source_rows(seed, n):
    r = random.Random(seed)
    stems = ["a", "ab", "abc", "Abcd", "abcdefgh", "abcdefghi", "é", "日本語", "x" * 40, "y" * 40 + "z", "y" * 41]
    word = lambda: r.choice(stems) + r.choice(["", "", "q", "r1s", "é"])
    return [(i, " ".join(word() for _ in range(r.randrange(30))), r.choice(["en", "en", "de", None]),
             r.choice(["s1", "s1", "s1", "s2", "s3", "s4", None, "é"]), "x", "y") for i in range(n)]


@pytest.mark.parametrize("min_docs", [1, 4, 15])
def test_audit_is_that_of_brute_force(spark, store, monkeypatch, min_docs):
    monkeypatch.setattr(divergence, "TILE_TERMS", 5)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    rows = source_rows(min_docs, 120) + [(1, None, "fr", "s1", "", ""), (1, "", "fr", "s2", "", ""), (None, "12 !", "xx", None, "", "")]
    rows += [rows[3]] * 5
    got = divergence.audit(source_frame(spark, rows).repartition(4), store, min_docs, 3)
    assert sorted(tuple(x[c] for c in FIELDS) for x in got.collect()) == audit_by_hand(rows, min_docs, 3)


def test_audit_drops_prefixes_below_the_threshold(spark, store):
    rows = [(i, "same" if i < 3 else f"longprefix{'abcdefgh'[i]}", "en", "s", "", "") for i in range(8)]
    found = store.write(divergence.document_terms(source_frame(spark, rows)), "t")
    kept = divergence.kept_terms(found, store, 3).collect()
    assert [(x["term"].decode(), x["n_docs"]) for x in map(lambda r: r.asDict() | {"term": bytes(r["term"])}, kept)] == [("same", 3)]
    levels = [spark.read.parquet(store.path(f"level-{k}")) for k in (2, 4, 8, 16)]
    assert [df.where("not whole").count() for df in levels] == [2, 1, 1, 0]


def test_audit_of_nothing_and_of_a_long_text(spark, store, monkeypatch):
    assert divergence.audit(source_frame(spark, []), store).collect() == []
    monkeypatch.setattr(terms, "PIECE", 1000)
    rows = [(1, "Ab " * 20_000 + "c" * 5000, "en", "s1", "", ""), (2, "ab cd", "en", "s2", "", "")]
    got = divergence.audit(source_frame(spark, rows), store, 1, 9)
    assert sorted(tuple(x[c] for c in FIELDS) for x in got.collect()) == audit_by_hand(rows, 1, 9)


# --- resampling ---------------------------------------------------------------------------

def resample_by_hand(rows, target, order, buckets, min_words, percent, seed):
    def features(text):
        w = alnum(text)
        return Counter(zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1))
    found = [features(r[1]) for r in rows]
    s, t = sum(found, Counter()), sum(map(features, target), Counter())
    whole, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in range(buckets)]
    out = []
    for r, c in zip(rows, found):
        weight = sum(n * gain[b] for b, n in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((r[0], len(alnum(r[1])), sum(c.values()), weight, score))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = Counter()
    ranks = defaultdict(list)
    for k, x in enumerate(able, 1):
        ranks[x].append(k if k <= len(able) * percent // 100 else None)
    for x in out:
        ranks.setdefault(x, [])
    assert not drawn
    return sorted(((*x, (ranks[x].pop(0) if ranks[x] else None)) for x in out), key=repr)


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_is_that_of_brute_force(spark, edges, edge_rows, store, order):
    target = ["w1 w2 w3\nw4", "w1 w2", None, ""]
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, key string")
    got = resample.resample(edges, goal, store, order, 50, 3, 40)
    want = resample_by_hand(edge_rows, target, order, 50, 3, 40, 2024)
    fields = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted((tuple(x[c] for c in fields) for x in got.collect()), key=repr) == want


def test_resampling_counts_runs_across_lines_and_repeated_lines(spark, frame, store):
    r = random.Random(2)
    lines = ["a b", "c", "", "d e f", " ", "a\tb c"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(12)))) for i in range(80)]
    target = ["a b c d"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame(rows).repartition(5), goal, store, 3, 997, 2, 50)
    fields = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted((tuple(x[c] for c in fields) for x in got.collect()), key=repr) == \
        resample_by_hand(rows, target, 3, 997, 2, 50, 2024)


def test_resampling_of_nothing(spark, nothing, frame, store):
    goal = spark.createDataFrame([], "text string")
    assert resample.resample(nothing, goal, store).collect() == []
    got = resample.resample(frame([(1, "a " * 30), (2, "b")]), goal, store).collect()
    assert [(x["n_features"], x["rank"]) for x in sorted(got, key=lambda x: x["doc_id"])] == [(30, None), (1, None)]


def test_a_line_without_end_is_read_in_pieces(spark, frame, store, monkeypatch):
    monkeypatch.setattr(terms, "PIECE", 500)
    rows = [(1, "Abc de " * 4000), (2, "abc")]
    goal = spark.createDataFrame([("abc",)], "text string")
    got = resample.resample(frame(rows), goal, store, 1, 97, 1, 100)
    fields = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted((tuple(x[c] for c in fields) for x in got.collect()), key=repr) == \
        resample_by_hand(rows, ["abc"], 1, 97, 1, 100, 2024)


# --- licences --------------------------------------------------------------------------------

def test_automaton_gives_longest_runs():
    r = random.Random(8)
    for _ in range(60):
        texts = [[r.randrange(3) for _ in range(r.randrange(1, 14))] for _ in range(r.randrange(1, 5))]
        a = license_scan.Automaton()
        for k, t in enumerate(texts):
            a.add(k, t)
        a.close()
        runs_ = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        doc = [r.randrange(4) for _ in range(40)]
        got = [n for n, _ in a.statistics(doc)]
        want = [max([n for n in range(i + 2) if n == 0 or tuple(doc[i + 1 - n:i + 1]) in runs_]) for i in range(len(doc))]
        assert got == want
        seen = set(a.anchors(doc, 2))
        for i, n in enumerate(want):
            if n >= 2 and (i + 1 == len(doc) or want[i + 1] <= n):
                run = doc[i + 1 - n:i + 1]
                assert {(k, i + 1 - n, j, n) for k, t in enumerate(texts) for j in range(len(t) - n + 1)
                        if t[j:j + n] == run} <= seen
        assert all(texts[k][t:t + n] == doc[d:d + n] for k, d, t, n in seen)


def base_by_hand(text):
    w = alnum(text)
    places = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(w))
                    if w[i:i + len(phrase.split())] == phrase.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, \
        ",".join(sorted({x for _, x in places}))


def test_base_and_spans_of_licences(spark, frame, monkeypatch):
    r = random.Random(6)
    filler = lambda n: " ".join(r.choice(["the", "of", "software", "license", "mit", "zzz", "under"]) for _ in range(n))
    rows = [(1, "x MIT License"), (2, None), (3, ""), (4, "mit-LICENSE, the GNU General\nPublic License; apache license"),
            (5, "Licensed under CC BY-NC 4.0."), (6, "mit"), (7, "license mit license"), (8, "mitlicense")]
    full = dict(enumerate(license_scan.TEMPLATES))
    for k, (label, text) in full.items():
        w = text.split()
        rows.append((100 + k, filler(30) + " zzz " + text + " zzz " + filler(30)))
        if len(w) >= 20:                                     # with a word changed and one more put in
            rows.append((200 + k, " ".join(w[:8] + ["changed"] + w[9:15] + ["added"] + w[15:])))
    rows += [(300 + i, filler(200)) for i in range(20)]
    monkeypatch.setattr(terms, "PIECE", 200)
    found = license_scan.scan(frame(rows).repartition(3))
    got = {x["doc_id"]: x for x in license_scan.labelled(found).collect()}
    spans = {x["doc_id"]: x["spans"] for x in found.collect()}
    for i, text in rows:
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == base_by_hand(text), i
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) | {""}
        assert 0 <= x["score"] <= 1
    for k, (label, text) in full.items():
        assert any(s["template"] == k and s["share"] == 1 for s in spans[100 + k])
        assert label in got[100 + k]["labels"].split(",")
        if 200 + k in got:
            assert any(s["template"] == k and 0.75 <= s["share"] < 1 for s in spans[200 + k]), (k, spans[200 + k])
    assert got[5]["labels"] == "cc" and got[5]["base_labels"] == "" and got[5]["score"] == 1
    assert (got[2]["labels"], got[2]["n_words"], got[2]["score"]) == ("", 0, 0)


def test_two_copies_and_edges_of_licences(spark, edges, edge_rows, frame, nothing):
    twice = license_scan.TEMPLATES[1][1]
    w = twice.split()
    broken = " ".join(w[:20] + ["other"] + w[21:])
    got = license_scan.scan(frame([(1, broken + " " + broken)])).first()["spans"]
    assert [s["template"] for s in got if s["template"] == 1] == [1, 1]
    rows = license_scan.labelled(license_scan.scan(edges)).collect()
    assert len(rows) == len(edge_rows)
    assert Counter((x["doc_id"], x["n_words"]) for x in rows) == Counter((r[0], len(alnum(r[1]))) for r in edge_rows)
    assert license_scan.labelled(license_scan.scan(nothing)).collect() == []
    assert license_scan.labelled(license_scan.scan(edges, templates=())).count() == len(edge_rows)


def test_license_query_is_the_base_over_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_license_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == base_by_hand(texts[x["doc_id"]])


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_target_resampling"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
