import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderloom.llm import bpe, pretoken, tokencount, tokenfile
from cinderloom.llm.common import utf8
from cinderloom.llm.pretoken import BatchEncoder, Vocabulary, classes, library_encoder


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(bpe.vocabulary_path())


def test_character_classes_follow_the_library(library):
    points = [c for c in range(0, 0x110000, 11) if not 0xD800 <= c < 0xE000]
    for c, kind in zip(points, classes().of(np.array(points)).tolist(), strict=True):
        assert len(library.pre_tokenizer.pre_tokenize_str("a1!\n"[kind] + chr(c))) == 1, hex(c)


@pytest.mark.parametrize("own", [True, False])
def test_batch_encoder_equals_the_library(library, vocab, own):
    encode_words = (lambda words: vocab.merge_all([w.encode() for w in words])) if own else library_encoder(bpe.vocabulary_path()).encode_words
    coder = BatchEncoder(encode_words, vocab.added, remember=50)
    rnd, signs = random.Random(1), "ab 's'tredlvm  \n\t!1é<|endoftext|> 　漢😀ß"
    for _ in range(60):
        texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) + rnd.choice(["", "<|endoftext|>", "'ll x", "  "]) for _ in range(20)]
        ids, at = coder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        again = coder.encode_utf8(*utf8(pa.array([*texts[:5], None, ""])))
        assert again[0].tolist() == ids[: at[5]].tolist() and again[1].tolist() == [*at[:6].tolist(), at[5], at[5]]


def test_words_with_one_hash_are_told_apart(library, monkeypatch):
    """All words of a size have one hash here, and still get their own ids."""
    monkeypatch.setattr(pretoken, "stretch", lambda sums, start, end, powers: (end - start).astype(np.uint64))
    coder = BatchEncoder(library_encoder(bpe.vocabulary_path()).encode_words, {})
    for text in ("the cat sat on the mat", "a dog ran off far and cat"):
        assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_of_ids_that_are_no_text(library, vocab):
    """Parts of a sign decode as the library decodes them, text by text."""
    euro = vocab.merge("€".encode())
    lists = [vocab.single[:3], [vocab.single[0xE2], vocab.single[0x82]], [vocab.single[0xAC]], euro, []]
    at = np.append(0, np.cumsum([len(x) for x in lists]))
    got = bpe.texts(np.array([i for x in lists for i in x], np.int32), at, bpe.vocabulary_path()).to_pylist()
    assert got == [library.decode(x, skip_special_tokens=False) for x in lists]


@pytest.mark.parametrize("word", ["ab" * 3000 + "zq" * 500, "x" * 49, "Straße" * 9, "é", "thetion" * 6])
def test_merges_of_long_words(library, vocab, word):
    want = library.encode(word, add_special_tokens=False).ids
    assert vocab.merge(word.encode()) == want
    assert vocab.merge_all([word.encode()])[0].tolist() == want


def test_lexicon_is_minimal_and_exact():
    words = sorted(w.encode() for w in {a + b for a in ("walk", "talk", "jump", "ärg") for b in ("", "s", "ed", "ing")} | {"a"})
    lexicon = bpe.Lexicon.compile(words, [[i, i + 1] for i in range(len(words))])
    mapped = bpe.Lexicon.mapped(lexicon.dump())
    assert mapped.find(words).tolist() == list(range(len(words)))
    assert (mapped.find([b"", b"walke", b"walks!", b"b", "ä".encode()]) == -1).all()
    assert len(mapped.final) < sum(map(len, words)) / 3  # suffixes are shared
    none = bpe.Lexicon.mapped(bpe.Lexicon.compile([], []).dump())
    assert none.find([b"x", b""]).tolist() == [-1, -1]


def _expected(rows, library):
    out = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_op1_on_awkward_rows(spark, landed, awkward_rows, library):
    got = sorted((tuple(r) for r in bpe.op1_bpe(spark, landed["awkward"]).collect()), key=str)
    assert got == _expected(awkward_rows, library)
    assert bpe.op1_bpe(spark, landed["empty"]).count() == 0


def test_encode_keeps_other_columns_and_decodes(clashing):
    path = bpe.vocabulary_path()
    rows = bpe.encode(clashing, bpe.build_lexicon(clashing, path, 10), path)
    assert set(rows.columns) == set(clashing.columns) - {"decoded"}
    back = bpe.decode(rows, path)
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0


@pytest.mark.parametrize("high", [2, 200, 60_000, 2**31, 2**63])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_simple8b_round_trip(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    values[3:200] = 0
    if high == 2**63 and n > 2:
        values[1] = 2**64 - 1
    packed = tokenfile.pack(values)
    assert (tokenfile.unpack(packed, n) == values).all()
    if high == 2 and n:
        assert len(packed) <= n // 60 + 1


def test_op6_on_awkward_rows(spark, landed, awkward_rows, library):
    got = sorted((tuple(r) for r in tokenfile.op6_token_files(spark, landed["awkward"]).collect()), key=lambda r: r[1])
    want = []
    for doc, text, *_ in awkward_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((g[0], *g[2:]) for g in got), key=str) == sorted(want, key=str)
    assert [g[0] for g in got] == sorted((w[0] for w in want), key=lambda d: (d is not None, d or 0))
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    assert tokenfile.op6_token_files(spark, landed["empty"]).count() == 0


def test_op7_on_awkward_rows(spark, landed, awkward_rows):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.encode_special_tokens = True
    got = sorted(((r.doc_id, r.n_tokens) for r in tokencount.op7_token_counts(spark, landed["awkward"]).collect()), key=str)
    assert got == sorted(((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in awkward_rows), key=str)
    assert tokencount.op7_token_counts(spark, landed["empty"]).count() == 0


def test_separator_scan_across_small_blocks(spark, awkward, tmp_path):
    path, vocab = str(tmp_path / "flat"), bpe.vocabulary_path()
    tokencount.write_flat(awkward, path, lambda: BatchEncoder(library_encoder(vocab).encode_words, {}), block_ids=7)
    blocks = spark.read.parquet(path)
    stream: dict[int, list[int]] = {}
    for r in blocks.orderBy("file", "block").collect():
        assert len(r.ids) <= 14
        stream.setdefault(r.file, []).extend(np.frombuffer(r.ids, "<u2").tolist())
    want = []
    for file, ids in stream.items():
        begin = k = 0
        for i, x in enumerate(ids):
            if x == tokencount.SEPARATOR:
                want.append((file, k, begin, i - begin, True))
                begin, k = i + 1, k + 1
    got = [tuple(r)[:5] for r in tokencount.count_tokens(blocks).collect()]
    assert sorted(got) == sorted(want)


def test_separator_scan_of_an_open_end(spark):
    raw = [np.array(x, "<u2").tobytes() for x in ([5, 9, 5], [5, 5], [5, 9, 9])]
    blocks = spark.createDataFrame([(0, i, bytearray(x), []) for i, x in enumerate(raw)], "file int, block int, ids binary, names array<long>")
    got = sorted(tuple(r)[:5] for r in tokencount.count_tokens(blocks, separator=9).collect())
    assert got == [(0, 0, 0, 1, True), (0, 1, 2, 4, True), (0, 2, 7, 0, True)]
    got = sorted(tuple(r)[:5] for r in tokencount.count_tokens(blocks.where("block < 2"), separator=9).collect())
    assert got == [(0, 0, 0, 1, True), (0, 1, 2, 3, False)]


def test_frequent_words_are_whole_classes_that_fit(spark):
    texts = ["a " * 40 + "b " * 39 + "c " * 8 + "d e f"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # The words are the tokenizer's: all but a text's first have their blank with them.
    assert sorted(bpe.frequent_words(docs, 10)) == [(" a", 78), (" b", 78), (" c", 16), (" d", 2), (" e", 2), (" f", 2), ("a", 2)]
    assert sorted(bpe.frequent_words(docs, 5)) == [(" a", 78), (" b", 78), (" c", 16)]
    assert bpe.frequent_words(docs, 0) == [] and bpe.frequent_words(docs.limit(0), 5) == []


def test_long_words_stay_out_of_the_counts(spark, library):
    """Unspaced text and words of megabytes: short words are counted, and ids are the library's."""
    rnd = random.Random(3)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(30_000))
    texts = [han, "y" * 3_000_000, "ab " * 2000 + "z" * 200_000, han[:9] + "。" + han[9:15] + "。", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts = {r.word: r.n for r in bpe.word_counts(docs).collect()}
    assert max(len(w.encode()) for w in counts) <= bpe.LONGEST and counts[" ab"] == 1999 and counts["。"] == 2 and counts[han[9:15]] == 1
    path = bpe.vocabulary_path()
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, bpe.build_lexicon(docs, path), path).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_remembered_words_are_bounded_by_their_length(monkeypatch):
    monkeypatch.setattr(pretoken, "ROOM", 1000)
    monkeypatch.setattr(pretoken, "KEPT", 50)
    seen = []
    coder = BatchEncoder(lambda words: (seen.extend(words), (np.arange(len(words), dtype=np.uint32), np.ones(len(words), np.int64)))[1], {})
    for k in range(40):
        coder.encode(["ab" * 40 + " cd ef " + "".join(chr(97 + (k * 7 + i) % 26) for i in range(200))])
        assert coder.used[1] <= 2000
    assert seen.count(" cd") == 1 and seen.count("ab" * 40) > 1  # a word of 80 signs isn't kept


def test_op6_joins_its_files_without_a_broadcast_too(spark, landed, monkeypatch):
    want = sorted(map(str, tokenfile.op6_token_files(spark, landed["awkward"]).collect()))
    monkeypatch.setattr(tokenfile, "BROADCAST_FILES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = tokenfile.op6_token_files(spark, landed["awkward"])
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString() and sorted(map(str, rows.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
