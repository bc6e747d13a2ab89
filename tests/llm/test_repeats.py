"""Substring operators and the Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from staylens.llm import common, ngram_join, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_repeats(docs, window):
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    seen = {}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            seen[key] = min(seen.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def byte_repeats(docs, length):
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            key = raw[s:s + length]
            if key in seen:
                gone[s:s + length] = True
            seen.add(key)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                  np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def planted(seed, count=60):
    """Texts with passages shared in whole, in part and at odd places, runs, and periodic stretches."""
    r = random.Random(seed)
    passages = [" ".join(f"p{r.randrange(3000)}" for _ in range(r.choice([30, 49, 50, 51, 90, 200]))) for _ in range(6)]
    docs = {}
    for i in range(count):
        parts = []
        for _ in range(r.randint(1, 4)):
            k = r.random()
            if k < 0.4:
                parts.append(" ".join(f"w{r.randrange(4000)}" for _ in range(r.randint(1, 120))))
            elif k < 0.75:
                w = r.choice(passages).split(" ")
                a = r.randrange(len(w))
                parts.append(" ".join(w if r.random() < 0.5 else w[a:] + w[:a // 2]))
            elif k < 0.87:
                parts.append("buy " * r.randint(1, 130))
            else:
                parts.append("ab cd ef " * r.randint(1, 40))
        docs[i] = r.choice([" ", "\n", "  "]).join(parts)
        if docs and r.random() < 0.1:
            docs[i] = docs[r.randrange(i + 1)]
    return docs


def edge_docs(edge_rows):
    return {r[0]: r[1] for r in edge_rows if r[0] is not None}


@pytest.mark.parametrize("which", ["planted1", "planted2", "edges"])
def test_word_repeats(which, frame, edge_rows, store):
    docs = edge_docs(edge_rows) if which == "edges" else planted(int(which[-1]))
    got = substring_dedup.remove_repeats(frame(list(docs.items())).repartition(3), store).collect()
    want = word_repeats(docs, substring_dedup.WINDOW)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


@pytest.mark.parametrize("which", ["planted3", "planted4", "edges"])
def test_byte_repeats(which, frame, edge_rows, store):
    docs = edge_docs(edge_rows) if which == "edges" else planted(int(which[-1]))
    got = suffix_dedup.remove_repeats(frame(list(docs.items())).repartition(3), store).collect()
    want = byte_repeats(docs, suffix_dedup.LENGTH)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got} == want


def test_byte_repeats_in_hot_groups(frame, store, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 1)
    docs = planted(5, 30)
    got = suffix_dedup.remove_repeats(frame(list(docs.items())), store).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got} \
        == byte_repeats(docs, suffix_dedup.LENGTH)


def test_merged_transforms_order_suffixes():
    r = random.Random(7)
    texts = [np.array([r.randint(1, 3) for _ in range(r.randint(1, 80))] + [0], np.uint16) for _ in range(5)]
    depth = 6
    arrays = [suffix_dedup.suffix_array(t, depth) for t in texts]
    shard, block = suffix_dedup.merge([suffix_dedup.transform(t, a) for t, a in zip(texts, arrays)], depth)
    at, seen = [0] * len(texts), {}
    last = None
    for s, b in zip(shard.tolist(), block.tolist()):
        t = texts[s]
        p = int(arrays[s][at[s]])
        at[s] += 1
        key = tuple(int(t[(p + k) % len(t)]) for k in range(depth))
        cut = key[:key.index(0) + 1] if 0 in key else key       # beyond a text's end it is a cycle
        assert last is None or last[:len(cut)] <= cut[:len(last)]
        last = cut
        if 0 not in key:
            assert seen.setdefault(key, b) == b
    assert len(set(seen.values())) == len(seen)


def test_steps_of_many_symbols_give_the_same_classes(monkeypatch):
    r = random.Random(9)
    base = bytes(r.choice(b"abcdefghijklmnop") for _ in range(300))
    parts = [bytearray(base[a:a + r.randint(20, 120)]) for a in (r.randrange(200) for _ in range(400))]
    for x in parts[::3]:
        x[r.randrange(len(x))] = r.choice(b"xyz")
    parts = [bytes(x) for x in parts if len(x) >= 20]
    windows = [x[i:i + 20] for x in parts for i in range(len(x) - 19)]
    took = []
    merge = suffix_dedup.merge
    monkeypatch.setattr(suffix_dedup, "merge", lambda t, rounds: took.append(rounds) or merge(t, rounds))
    for steps in (suffix_dedup.STEPS, (2, 1), (1,)):
        monkeypatch.setattr(suffix_dedup, "STEPS", steps)
        named, of = {}, np.concatenate(suffix_dedup.window_classes(parts, 20, 4000)).tolist()
        assert all(named.setdefault(w, c) == c for w, c in zip(windows, of, strict=True))
        assert len(set(named.values())) == len(named) == len(set(windows))
    assert took == [2, 10, 20]                               # steps of 10, 2 and 1 symbols
    monkeypatch.undo()
    noise = [np.array([r.randrange(1, 200) for _ in range(70_000)] + [0])]
    assert suffix_dedup.run_codes(noise, 200, 100)[0] == 2   # more different runs of 4 than 16 bits hold


def test_repeated_windows_leave_a_merge_as_runs():
    import pyarrow as pa

    r = random.Random(4)
    a = bytes(r.choice(b"abcdef") for _ in range(400))
    rows = [("g", 1, 11, 0, a[:250]), ("g", 2, 12, 7, b"x" * 9 + a[20:180] + b"y" * 5 + a[200:310]), ("g", 3, 13, 5, a[60:400])]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["name", "doc_id", "t", "s", "bytes"])
    got = [x for b in suffix_dedup._repeat_rows([batch]) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "s", "n")))]
    assert sorted(got) == [(2, 12, 16, 61), (3, 13, 5, 91), (3, 13, 145, 11)]


def test_kept_bytes_of_many_texts_at_once():
    import pyarrow as pa

    length = suffix_dedup.LENGTH
    a, b = "abcde" * 60, "é" * 100
    cases = [(1, a, None, [(0, 201)]), (2, a, True, None), (None, "", None, None), (3, a, None, [(0, 1), (150, 30), (20, 3)]),
             (4, "", True, None), (5, "short", True, []), (6, b, None, [(100, 1)]), (7, a, True, [(5, 1)]), (None, a, None, None), (8, b, True, [])]
    kind = pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([c[0] for c in cases], pa.int64()), pa.array([c[1] for c in cases]), pa.array([c[2] for c in cases], pa.bool_()),
         pa.array([None if c[3] is None else [{"s": s, "n": n} for s, n in c[3]] for c in cases], kind)],
        names=["doc_id", "text", "copy", "found"])
    for skip in (0, 3):                                      # a batch that is part of a larger one
        got = [r for x in suffix_dedup._kept_rows([batch.slice(skip)]) for r in x.to_pylist()]
        assert len(got) == len(cases) - skip
        for (doc, text, copy, found), r in zip(cases[skip:], got):
            raw = text.encode()
            gone = [bool(copy) and len(raw) >= length or any(s <= i < s + n + length - 1 for s, n in found or []) for i in range(len(raw))]
            edge = [i for i in range(len(raw) + 1) if (i < len(raw) and gone[i]) != (i > 0 and gone[i - 1])]
            assert (r["doc_id"], r["n_bytes"], r["n_removed"]) == (doc, len(raw), sum(gone))
            assert [x for p in r["spans"] for x in (p["start"], p["end"])] == edge
            assert r["kept"] == bytes(c for c, g in zip(raw, gone) if not g)


def test_units_find_every_repeat():
    """A window that repeats in another text has only shared units."""
    for seed in range(6, 10):
        docs = list(planted(seed, 40).values())
        import pyarrow as pa

        from staylens.llm.common import arrow_texts

        _, _, _, h, first = substring_dedup.words_of(*arrow_texts(pa.array(docs, pa.string())))
        name, a, b, doc = substring_dedup.units(h, first)
        owners = defaultdict(set)
        for n, d in zip(name.tolist(), doc.tolist()):
            owners[n].add(docs[d])
        seen = defaultdict(set)
        for d in range(len(docs)):
            for s in range(first[d], first[d + 1] - substring_dedup.WINDOW + 1):
                seen[h[s:s + substring_dedup.WINDOW].tobytes()].add(docs[d])
        for d in range(len(docs)):
            mine = np.flatnonzero(doc == d)
            for s in range(first[d], first[d + 1] - substring_dedup.WINDOW + 1):
                within = mine[(a[mine] <= s) & (s <= b[mine])]
                assert len(within)
                if len(seen[h[s:s + substring_dedup.WINDOW].tobytes()]) > 1:
                    assert all(len(owners[n]) > 1 for n in name[within].tolist())


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_truth(docs, num=4, den=5):
    rep = {}
    for i in sorted(docs):
        rep.setdefault(docs[i] or "", i)
    sets = {i: shingle_set(t) for t, i in rep.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (find(rep[docs[i] or ""]), rep[docs[i] or ""], links[rep[docs[i] or ""]]) for i in docs}


def near_docs(seed, groups=25):
    r = random.Random(seed)
    docs, i = {}, 0
    for _ in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"w{r.randrange(5000)}"
            docs[i] = " ".join(w)
            i += 1
    return docs


def alike_words():
    """Two words of 1,024 letters that polynomial hashes modulo 2**64 cannot tell apart, in a 50-word window each."""
    sign = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[x] for x in sign), "".join("ba"[x] for x in sign)
    rest = [f"w{i}" for i in range(49)]
    return {1: " ".join([one, *rest]), 2: " ".join([two, *rest]), 3: one, 4: two, 5: " ".join([one] * 5), 6: " ".join([two] * 5),
            7: "x" * 300 + one, 8: "x" * 300 + two}


def test_long_words_of_alternating_letters_stay_apart(frame, store):
    docs = alike_words()
    got = substring_dedup.remove_repeats(frame(list(docs.items())), store).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == word_repeats(docs, substring_dedup.WINDOW)
    got = ngram_join.jaccard_classes(frame(list(docs.items())), store).collect()
    assert {r["doc_id"]: (r["class_id"], r["text_id"], r["n_links"]) for r in got} == jaccard_truth(docs)
    got = suffix_dedup.remove_repeats(frame(list(docs.items())), store).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got} \
        == byte_repeats(docs, suffix_dedup.LENGTH)


def test_word_hashes_name_words_alone():
    r = random.Random(3)
    pool = ["".join(r.choice("ab") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(300)]
    texts = [r.choice(pool) for _ in range(3000)]
    buf = np.frombuffer(" ".join(texts).encode(), np.uint8)
    s, e, h = common.word_hashes(buf)
    g = common.word_hash(buf, s, e, 1)
    assert len(s) == len(texts) and not (h == g).any()
    for x in (h, g):
        names = {}
        for word, k in zip(texts, x.tolist()):
            assert names.setdefault(word, k) == k
        assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("which", ["near", "edges", "blocks"])
def test_jaccard_classes(which, frame, edge_rows, store, monkeypatch):
    if which == "blocks":                       # groups far beyond a block
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 4)
    docs = edge_docs(edge_rows) if which == "edges" else near_docs(1)
    got = ngram_join.jaccard_classes(frame(list(docs.items())).repartition(3), store).collect()
    assert {r["doc_id"]: (r["class_id"], r["text_id"], r["n_links"]) for r in got} == jaccard_truth(docs)


def test_pruning_bound_is_the_posterior():
    least = ngram_join.least_matches(0.8, 1e-6)
    x = np.linspace(0, 1, 200_001)
    for n, m in least.items():
        tails = []
        for k in (m - 1, m):
            density = x ** k * (1 - x) ** (n - k) if k >= 0 else np.zeros_like(x)
            tails.append(density[x >= 0.8].sum() / max(density.sum(), 1e-300))
        assert tails[0] < 1e-6 <= tails[1] * 1.02


def test_edges_and_empty_tables(edges, nothing, edge_rows, store):
    for run in (substring_dedup.remove_repeats, suffix_dedup.remove_repeats):
        assert run(nothing, store).collect() == []
        assert run(edges, store).count() == len(edge_rows)
    assert ngram_join.jaccard_classes(nothing, store).collect() == []
    got = ngram_join.jaccard_classes(edges, store).collect()
    assert len(got) == len({r[0] for r in edge_rows if r[0] is not None}) + 2
    kept = ngram_join.keep_one(edges, store)
    assert kept.columns == edges.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 4, 5, 8, 10, 11, 13, 14, 15, 16, 17, 18, 7}
