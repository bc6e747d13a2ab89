"""Packing and token files: exact ids, whole coverage, limits, round trip."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.llm import packing, token_output, tokens
from staylens.llm.queries import tokenizer_file
from staylens.llm.tokens import Encoder

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


def reference(path, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [np.array(e.ids + [1], np.uint32) for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    r = random.Random(1)
    signs = ["a", "B", "é", " ", "\n", "'s", "'", "!", "1", "²", "日", "Σ", "\x85", "\xa0", "\t", "\x1c", "\x00", "İ",
             "é", "<|endoftext|>", "ß", "​", "\U0001f600"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    for got, want in zip(Encoder(path).encode(texts), reference(path, texts)):
        assert got.tolist() == want[:-1].tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_word_is_cached_once_whatever_signs_follow(path):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "äklmnopqrs"]
    texts = [" ".join(w + sign for w in words) for sign in (".", ",", "!!", "###", ".%%%", "'s", "'ll", "\n1", "²", " ¿")]
    enc = Encoder(path)
    for got, want in zip(enc.encode(texts), reference(path, texts)):
        assert got.tolist() == want[:-1].tolist()
    assert len(enc.codes) < 300 and sum(len(w) for w in enc.codes) < 2000       # 100 words, as often as 2 at line starts


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cache_is_bounded_and_keeps_common_parts(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 400)
    r, enc = random.Random(5), Encoder(path)
    for k in range(12):
        texts = ["the and of " + " ".join(f"{c}{r.randrange(10 ** 6):x}q" for c in "xyé") + end for end in ("", " 日本") for _ in range(20)]
        for got, want in zip(enc.encode(texts), reference(path, texts)):
            assert got.tolist() == want[:-1].tolist()
    enc.encode(["."])
    assert len(enc.codes) <= 401 and b" and" in enc.codes and b" of" in enc.codes


def test_packer_takes_a_number_of_loss_bearing_tokens():
    r = random.Random(6)
    sizes = [r.randrange(0, 300) for _ in range(500)]
    ids = [np.arange(n, dtype=np.uint32) for n in sizes]
    limits = (128, 5, 128)
    ones = [p for rows in packing.pack_batches(((k, x, np.ones(len(x), np.int8)) for k, x in enumerate(ids)), limits) for p in rows]
    assert [p for rows in packing.pack_batches(((k, x, None) for k, x in enumerate(ids)), limits) for p in rows] == ones
    packer = packing.Packer(limits)
    for k in range(3):
        packer.offer(k, 100 - k)
    assert np.shares_memory(packer.totals[1], packer.totals[2])


def test_counts_are_those_of_each_text():
    import pyarrow as pa

    texts = [np.array(x, "<u4").tobytes() for x in ([1, 5, 5], [], [70000, 1])] * 200
    found = [b.to_pydict() for b in token_output._count(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["ids"])]))]
    assert found == [{"symbol": [1, 5, 70000], "count": [400, 400, 200]}]


def check_pieces(rows, texts):
    want = dict(zip(texts, reference(BYTE, [t or "" for t in texts.values()])))
    for doc, x in want.items():
        at = 0
        for p in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(x))
            assert p["ids_crc32"] == zlib.crc32(x[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(x)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
        used = sum(p["length"] for p in pieces)
        assert used <= 2048 and len(pieces) <= packing.MAX_SEGMENTS
        assert used == 2048 or used & (used - 1) == 0


def test_packing_covers_every_id(frame, edge_rows, nothing):
    unique = {r[0]: r[1] for r in edge_rows if r[0] is not None and r[0] != 14}
    rows = packing.pack_documents(frame([(k, v) for k, v in unique.items()]).repartition(2), BYTE).collect()
    check_pieces(rows, unique)
    assert packing.pack_documents(nothing, BYTE).collect() == []


def test_packing_of_repeated_rows_and_null_ids(edges):
    rows = packing.pack_documents(edges, BYTE).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 14) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 14)
    assert any(r["doc_id"] is None for r in rows)


def test_all_three_limits_hold(spark):
    r = random.Random(2)
    data = [(i, list(range(n := r.randint(1, 90))), [int(r.random() < 0.4) for _ in range(n)]) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, ids array<int>, loss array<int>").repartition(2)
    for cut in (True, False):
        rows = packing.pack_examples(df, tokens=128, segments=3, loss_tokens=60, cut=cut).collect()
        by = {}
        for p in rows:
            by.setdefault(p["sequence_id"], []).append(p)
        for pieces in by.values():
            assert sum(p["length"] for p in pieces) <= 128 and len(pieces) <= 3
            assert sum(p["loss_tokens"] for p in pieces) <= 60
        for i, ids, loss in data:
            mine = [p for p in rows if p["doc_id"] == i]
            assert sum(p["length"] for p in mine) == len(ids) and sum(p["loss_tokens"] for p in mine) == sum(loss)
            assert cut or len(mine) == 1
    with pytest.raises(Exception, match="does not fit"):
        packing.pack_examples(df, tokens=10, cut=False).collect()


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 300_000])
def test_coder_round_trip_and_segments(n):
    rng = np.random.RandomState(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
    counts = np.bincount(ids, minlength=5000)
    freq = token_output.quantise(counts)
    assert not n or freq.sum() == 1 << token_output.SCALE and ((freq > 0) == (counts > 0)).all()
    sym = np.flatnonzero(freq)
    coder = token_output.Coder(sym, freq[sym])
    states, at, words = coder.encode(ids)
    assert coder.decode(n, states, at, words).tolist() == ids.tolist()
    per = token_output.LANES * token_output.CHECK_STEPS
    for k in range(len(states)):
        assert coder.decode(n, states, at, words, segment=k).tolist() == ids[k * per:(k + 1) * per].tolist()


def test_token_files(spark, frame, edge_rows, nothing, store):
    rows = [r for r in edge_rows if r[0] is not None and r[0] != 14]
    token_output.write_tokens(frame(rows).repartition(3), store.path("files"), WORD, store, block_tokens=500)
    got = token_output.read_tokens(spark, store.path("files")).orderBy("doc_id").collect()
    at = 0
    for g, r, x in zip(got, rows, reference(WORD, [r[1] or "" for r in rows])):
        assert (g["doc_id"], g["start"], g["n_tokens"], bytes(g["ids"])) == (r[0], at, len(x), x.tobytes())
        at += len(x)
    assert len(got) == len(rows)
    token_output.write_tokens(nothing, store.path("none"), WORD, store)
    assert token_output.read_tokens(spark, store.path("none")).collect() == []


def test_token_files_keep_null_and_repeated_ids(spark, edges, edge_rows, store):
    token_output.write_tokens(edges, store.path("all"), WORD, store)
    got = token_output.read_tokens(spark, store.path("all"))
    assert got.count() == len(edge_rows) and got.where("doc_id is null").count() == 2
    assert got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == got.agg(F.sum("n_tokens")).first()[0]


def test_damage_is_noticed(spark, frame, store):
    token_output.write_tokens(frame([(1, "some words here")]), store.path("f"), WORD, store)
    blocks = spark.read.parquet(store.path("f") + "/blocks").withColumn("payload_crc32", F.lit(1).cast("long"))
    blocks.write.parquet(store.path("g") + "/blocks")
    spark.read.parquet(store.path("f") + "/freq").write.parquet(store.path("g") + "/freq")
    with pytest.raises(Exception, match="damaged"):
        token_output.read_tokens(spark, store.path("g")).collect()
