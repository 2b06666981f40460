"""Operators 11 to 13 against plain Python on awkward rows."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from cinderloom.llm import importance, treebpe, vectorcode

# --- operator 11 ---------------------------------------------------------------------------------------


def grams(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def resampled(docs, target):
    here, there = (Counter(b for t in texts for b in grams(t)[1]) for texts in ([t for _, t in docs], target))
    S, T = sum(here.values()), sum(there.values())
    gain = [math.floor(1000 * math.log((there[b] + 1.0) * (S + 10_000.0) / ((here[b] + 1.0) * (T + 10_000.0)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, features = grams(text)
        weight = sum(gain[b] for b in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), len(words)])
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(order) * 5 // 100
    return Counter((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)) + Counter((*r[:4], None) for r in rows if r[4] < 20)


def test_crc_of_joined_strings():
    rnd = random.Random(1)
    for size in (0, 1, 7, 63, 64, 65, 129, 70_000):
        a, b = rnd.randbytes(rnd.randrange(20)), rnd.randbytes(size)
        got = importance.crc_joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([size]))
        assert got[0] == zlib.crc32(a + b)


def test_features_are_all_runs_of_words():
    texts = ["Ab c\x00d É!Z漢 a a a", "", "one", None, "x " * 30, " lead two three", "w" * 200 + " " + "é" * 90 + " z"]
    row, bucket, words = importance.features(pa.array(texts, pa.string()).fill_null(""))
    for i, text in enumerate(texts):
        want = grams(text)
        assert Counter(bucket[row == i].tolist()) == Counter(want[1]) and words[i] == len(want[0])


@pytest.mark.parametrize("target", [[], ["the of tion", None, "sch äre the of"]])
def test_resampling_equals_plain_python(spark, awkward, awkward_rows, clashing, target):
    docs = [(r[0], r[1]) for r in awkward_rows] + [(100 + k, "the of tion äre sch a b c " * (k % 7 + 3)) for k in range(60)]
    more = spark.createDataFrame(docs[len(awkward_rows) :], "doc_id long, text string")
    wanted, goal = resampled(docs, target), spark.createDataFrame([(t,) for t in target], "text string")
    for frame in (awkward, clashing):
        rows = importance.resampled(frame.unionByName(more, allowMissingColumns=True), goal)
        assert Counter(tuple(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect()) == wanted


def test_awkward_names_of_kept_columns(spark, awkward):
    docs = awkward.withColumns({"a b": F.lit(1), "__at": F.lit(2), "Weight": F.lit(3), "__row": F.lit(4)})
    gain = spark.range(10_000).select(F.col("id").alias("bucket"), F.lit(1).cast("long").alias("gain"))
    rows = importance.weighed(docs, gain, "doc_id", "a b", "__at", "Weight", "__row")
    assert rows.columns == ["doc_id", "a b", "__at", "__row", "n_words", "n_features", "weight"]
    ranked = importance.drawn(rows.withColumn("score", F.col("weight")), percent=50)
    assert {(r["a b"], r["__at"], r["__row"]) for r in ranked.collect()} == {(1, 2, 4)} and ranked.where("rank = 1").count() == 1
    for block in (treebpe.BLOCK, 100):
        got = treebpe.encode(docs, treebpe.ranks_path(), treebpe.split_pattern(), "a b", "__row", "ids", check=True, block=block)
        assert got.columns == ["a b", "__row", "ids", "decoded"] and {(r["a b"], r["__row"]) for r in got.collect()} == {(1, 4)}


def test_resampling_of_nothing(spark, empty):
    assert importance.resampled(empty, empty).collect() == []


def test_ranks_are_one_order_over_all_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(50).cast("long").alias("n_words"), (F.col("id") % 5).alias("score"))
    got = importance.drawn(rows.repartition(7)).where("rank is not null").collect()
    order = sorted((-(i % 5), i % 3 == 0, i if i % 3 else 0) for i in range(3000))
    assert sorted(r["rank"] for r in got) == list(range(1, 151))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted(got, key=lambda r: r["rank"])] == order[:150]


# --- operator 12 ---------------------------------------------------------------------------------------


def coded(rows, rounds=6):
    """(vec_id, code, error, label_error, sha256) by plain Lloyd rounds on Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in kept if v and len(v) % 8 == 0), 0)
    kept = [r for r in kept if len(r[1]) == size and size]
    m = size // 8
    books = [[v[k * m : (k + 1) * m] for _, v, _ in kept[:16]] for k in range(8)]
    best = lambda v, k: min((sum((a - b) ** 2 for a, b in zip(v[k * m : (k + 1) * m], e)), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        owner = [[best(v, k)[1] for k in range(8)] for _, v, _ in kept]
        for k in range(8):
            for j in range(len(books[k])):
                mine = [v[k * m : (k + 1) * m] for (_, v, _), o in zip(kept, owner) if o[k] == j]
                if mine:
                    books[k][j] = [sum(c) // len(mine) for c in zip(*mine)]
    mark = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, label, [best(v, k) for k in range(8)]) for i, v, label in kept]
    total = Counter()
    for _, label, b in out:
        total[label] += sum(d for d, _ in b)
    return Counter((i, "".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b), total[label], mark) for i, label, b in out)


def vectors(rnd, n, size=16):
    rows = [(i, [rnd.choice([-1, 0, 1]) * 0.5 + rnd.gauss(0, 0.05) for _ in range(size)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += [(3, rows[3][1], 1), (n, None, 1), (n + 1, [0.1] * (size - 1) + [None], 1), (n + 2, [float("nan")] * size, 2), (n + 3, [float("-inf")] + [0.0] * (size - 1), 2)]
    return [*rows, (n + 4, [0.5] * (size + 8), 1), (n + 5, [], None), (None, rows[5][1], None), (None, [0.25] * size, 7), (-4, [0.5] * 3, 1)] + [(n + 10 + k, rows[1][1], 1) for k in range(40)]


@pytest.mark.parametrize("n", [0, 5, 200])
def test_codes_equal_plain_lloyd(spark, tmp_path, monkeypatch, n):
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in vectors(random.Random(n), n or 6)] if n else []
    for owner_rows in (1 << 20, 50):  # with one salt, and with several
        monkeypatch.setattr(vectorcode, "OWNER_ROWS", owner_rows)
        place = str(tmp_path / str(owner_rows))
        spark.createDataFrame([(*r, 0, None) for r in rows], "vec_id long, embedding array<float>, label int, v int, code string").repartition(3).write.parquet(f"{place}/embeddings.parquet")
        got = vectorcode.op12_vector_codes(spark, place)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == coded(rows)


def test_members_that_stay_are_not_shuffled(spark):
    books = np.zeros((8, 2, 1), np.int64)
    books[:, 1] = 100
    rows = spark.range(500).select(F.col("id").alias("row"), F.array_repeat((F.col("id") % 120).cast("int"), 8).alias("v"))
    members = vectorcode.placed(rows, books, 3).cache()
    assert members.count() == 4000 and members.select("position", "entry", "salt").distinct().count() == 48
    books[:, 0] = 10
    plan = vectorcode.judged(members, books)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    away = {r.p[0] for r in plan.where("entry != next").collect()}
    assert away == {51, 52, 53, 54, 55}  # 50 is as near to 0 as to 100, and 55 to both new ones


# --- operator 13 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(treebpe.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=treebpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


def pieces(rnd):
    some = ["a", "th", "ing", " ", "  ", "\n", "'s", "'", "ll", "!", "..", "é", "漢字", "かな", "😀", "12", "３", " the", "　", "́", "﻿"]
    if rnd.random() < 0.5:
        return "".join(rnd.choice(some) for _ in range(rnd.randrange(1, 60)))
    return rnd.choice(["x", "ab", "漢", "é", " ", "\n", "!", "'", "7", "the", "xyz"]) * rnd.randrange(1, 300)


def test_blocks_and_joins_give_the_library_s_ids(library):
    rnd, coder = random.Random(7), treebpe.coder(treebpe.ranks_path(), treebpe.split_pattern())
    for _ in range(150):
        text = "".join(pieces(rnd) for _ in range(rnd.randrange(1, 6)))
        for size in (24, 64, 200):
            parts = list(coder.blocks(text.encode(), size))
            assert b"".join(raw for _, _, raw in parts).decode() == text
            nodes = [dict(zip(("ids", "head", "tail"), coder.leaf(raw, left, right)), left=left, right=right) for left, right, raw in parts]
            while len(nodes) > 1:
                nodes = [coder.joined(a, b) for a, b in zip(nodes[::2], nodes[1::2])] + nodes[len(nodes) - len(nodes) % 2 :]
            assert (nodes[0]["ids"] if nodes else []) == library.encode_ordinary(text), text


@pytest.mark.parametrize("word", [b"x" * 5000, "漢字かな".encode() * 700, b"\xff\x00\x80" * 900, bytes(random.Random(2).randrange(97, 123) for _ in range(5000))])
def test_a_long_word_by_halves_is_the_plain_merge(word):
    ranks = treebpe.coder(treebpe.ranks_path(), treebpe.split_pattern()).ranks
    (got,) = ranks.encoded([word])
    assert got == ranks.merge(word)
    for cut in (1, 777, len(word) - 2):
        assert ranks.joined(ranks.merge(word[:cut]), ranks.merge(word[cut:])) == got


@pytest.mark.parametrize("block", [treebpe.BLOCK, 100])
def test_encoding_equals_the_library(spark, awkward, awkward_rows, clashing, library, block):
    want = Counter()
    for i, text, *_ in awkward_rows:
        ids = library.encode_ordinary(text or "")
        want[i, tuple(ids), (text or "").encode()] += 1
    path, pattern = treebpe.ranks_path(), treebpe.split_pattern()
    for frame in (awkward, clashing):
        rows = treebpe.encode(frame, path, pattern, "doc_id", "lang", check=True, block=block).collect()
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == want and rows[0].lang in ("en", None)
    packed = treebpe.encode(awkward, path, pattern, "doc_id", packed=True, block=block).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in packed) == Counter({(i, struct.pack(f"<{len(t)}I", *t)): n for (i, t, _), n in want.items()})


def test_decoding_up_the_tree(spark, awkward, awkward_rows):
    path, pattern = treebpe.ranks_path(), treebpe.split_pattern()
    encoded = treebpe.encode(awkward, path, pattern, "doc_id").union(spark.createDataFrame([(7, None), (8, [])], "doc_id long, ids array<int>")).cache()
    got = treebpe.decode(encoded, path, pattern, "doc_id", block=50).collect()
    want = Counter((r[0], (r[1] or "").encode()) for r in awkward_rows) + Counter([(7, b""), (8, b"")])
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == want


def test_op13_columns(spark, landed, awkward_rows, library):
    rows = treebpe.op13_byte_bpe(spark, landed["awkward"]).collect()
    want = Counter()
    for i, text, *_ in awkward_rows:
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert treebpe.op13_byte_bpe(spark, landed["empty"]).collect() == []
