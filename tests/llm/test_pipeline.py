import hashlib
import re

import corpus_pipeline
import pandas as pd
from tokenizers import Tokenizer

from cinderloom.llm import bpe, mixing
from cinderloom.llm.common import shared_dir

from .test_corpus import groups, mixed, near
from .test_text import verdict


def test_each_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        path = shared_dir(spark, f"test_{name}")
        function(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.toPandas()
    order = list(corpus_pipeline.COLUMNS)

    after = seen["quality_rules"]
    assert list(after.columns) == order and sorted(after.doc_id) == sorted(r.doc_id for r in before.itertuples() if verdict(r.text))

    before, after = after, seen["exact_dedup"]
    norm = before.assign(norm=[re.sub(r"\s", "", t, flags=re.ASCII) for t in before.text], n=[-len(t) for t in before.text])
    assert sorted(after.doc_id) == sorted(norm.sort_values(["n", "doc_id"]).drop_duplicates("norm").doc_id)

    before, after = after, seen["near_dedup"]
    assert sorted(after.doc_id) == sorted({c for _, c, *_ in near(list(before[["doc_id", "text"]].itertuples(index=False, name=None)))})

    before, after = after, seen["mix_sources"]
    sizes, _, target = mixed(list(before[order].itertuples(index=False, name=None)))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    got = after.assign(size=after.text.map(words)).groupby("source")["size"].sum()
    for s, t in target.items():
        assert abs(got.get(s, 0) - t) <= 1
    text = dict(zip(before.doc_id, before.text, strict=True))
    assert all(text[r.doc_id].startswith(r.text.rstrip()) or text[r.doc_id].lstrip().startswith(r.text.strip()) for r in after.itertuples())
    assert after.groupby("doc_id").size().max() <= mixing.MAX_EPOCHS
    assert list(after.columns) == order and (after.n_chars == after.text.map(len)).all()

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    want = sorted((int(r.doc_id), tok.encode(r.text, add_special_tokens=False).ids) for r in after.itertuples())
    assert sorted((int(r.doc_id), list(map(int, r.ids))) for r in seen["bpe_encoding"].itertuples()) == want


def test_bpe_stage_decodes_what_it_encodes(spark, awkward, awkward_rows):
    rows = corpus_pipeline.bpe_encoding(spark, awkward, "").collect()
    want = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in awkward_rows)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in rows) == want


def test_stages_on_awkward_rows(spark, clashing, awkward_rows):
    """Each stage by itself, on nulls, empty and long texts, repeated rows and clashing names."""
    stage = dict(corpus_pipeline.STAGES)
    names = corpus_pipeline.COLUMNS
    got = stage["quality_rules"](spark, clashing, "")
    assert got.columns == names
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(r) for r in awkward_rows if verdict(r[1]))
    got = stage["exact_dedup"](spark, clashing, "")
    assert got.columns == names and got.count() == groups(awkward_rows)[1]
    numbered = [(i, r[1]) for i, r in enumerate(awkward_rows)]
    classes = {c for i, c, *_ in near(numbered)}
    got = stage["near_dedup"](spark, clashing, "")
    assert got.columns == names and got.count() == len(classes)
    got = stage["mix_sources"](spark, clashing, "")
    sizes, _, target = mixed(awkward_rows)
    taken = {s: 0 for s in target}
    for r in got.collect():
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert got.columns == names and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_run_on_awkward_and_empty_tables(spark, clashing, empty, tmp_path):
    clashing.write.parquet(str(tmp_path / "awkward/documents.parquet"))
    empty.write.parquet(str(tmp_path / "empty/documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "awkward"))
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert all(r.n_tokens == len(r.ids) > 0 for r in rows.collect()) and rows.count() > 0
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, empty, "").count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
