import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderloom.llm import dedup, mixing, ngram_join, suffix_dedup
from cinderloom.llm.components import components
from cinderloom.llm.queries import ORACLE_SQL

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


# --- components ---


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    want = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | dict.fromkeys((200, 201, 202), 200)
    assert got == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_broadcast_no_table_of_two_keys(spark, monkeypatch):
    """Such a table takes a page of each executor, however small it is, and each round would leave two of them."""
    import cinderloom.llm.components as module

    plans, stage = [], module.stage

    def seen(spark, df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(spark, df, name)

    monkeypatch.setattr(module, "stage", seen)
    components(spark, spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    keys = re.findall(r"(?:BroadcastHashJoin|SortMergeJoin(?:\(skew=true\))?) \[([^\]]*)\]", "".join(plans))
    assert any("," in k for k in keys)
    assert not [k for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", "".join(plans)) if "," in k]


def test_components_of_pieces(spark, monkeypatch):
    """Edges that tasks contract a few at a time, in rounds; hubs above and below, and repeated edges."""
    import cinderloom.llm.components as module

    rnd, staged, stage = random.Random(3), [], module.stage
    edges = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(420)] + [(5000, k) for k in range(2000, 2090)] + [(1500, k) for k in range(3000, 3090)]
    edges += [(k, k + 1) for k in range(9000, 9100)] + edges[:50]
    rnd.shuffle(edges)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    monkeypatch.setattr(module, "EDGES", 3)
    monkeypatch.setattr(module, "stage", lambda s, df, name: staged.append(name) or stage(s, df, name))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "2")
    try:
        got = [tuple(r) for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()]
    finally:
        spark.conf.set(conf, old)
    assert sorted(got) == sorted((x, top(x)) for x in list(root))
    assert "stars" in staged


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """On check_h a round is a quarter of a minute, and one more only saw that nothing changed."""
    import cinderloom.llm.components as module

    staged, stage = [], module.stage
    monkeypatch.setattr(module, "stage", lambda s, df, name: staged.append(name) or stage(s, df, name))
    edges = [(k, 10 * (k // 10)) for k in range(100)]
    assert dict(map(tuple, components(spark, spark.createDataFrame(edges, "a long, b long")).collect())) == dict(edges)
    assert len(staged) == 3


def test_workers_give_free_memory_back():
    from cinderloom.llm.common import lean

    pins = []

    def run(batches):
        blocks = [b"x" * (100_000 + i) for i in range(2000)]
        pins.extend(blocks[::20])  # the rest is free, between blocks that are not
        del blocks
        yield from batches

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    assert list(run(iter([1]))) == [1]
    kept = resident()
    assert list(lean(run)(iter([1]))) == [1]
    assert resident() < kept - 100


def test_small_nodes_of_all_levels_meet_in_one_shuffle(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 32, ngram_join.WIDTH, dtype=np.uint32)
    rows = []
    for k in range(200):
        v = base.copy()
        v[rnd.integers(0, ngram_join.WIDTH, 12)] = rnd.integers(0, 1 << 32, 12, dtype=np.uint32)
        rows.append((1000 + k, bytearray(v.tobytes())))
    rows += [(k, bytearray(rnd.integers(0, 1 << 32, ngram_join.WIDTH, dtype=np.uint32).tobytes())) for k in range(50)]
    edges, staged = ngram_join.candidates(spark, spark.createDataFrame(rows, "set long, vector binary"))
    assert len(staged) > 3  # more than one level
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [node") == 1
    roots = dict(map(tuple, components(spark, edges).collect()))
    assert roots == {1000 + k: 1000 for k in range(200)}


# --- operator 10 ---


def groups(rows):
    norm = defaultdict(list)
    for row in rows:
        norm[re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")].append(row)
    out = []
    for text, members in norm.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], keep[0], len(members), hashlib.sha256(text.encode()).hexdigest()) for r in members]
    return sorted(out, key=str), len(norm)


def test_op10_on_awkward_rows(spark, landed, awkward_rows):
    got = dedup.op10_exact_dedup(spark, landed["awkward"]).collect()
    want, n = groups(awkward_rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n
    assert dedup.op10_exact_dedup(spark, landed["empty"]).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark, tmp_path, awkward, awkward_rows):
    path = str(tmp_path / "docs")
    awkward.write.parquet(path)
    weak = lambda norm: (F.length(norm) % 3).cast("string")
    got = dedup.dedup_files(spark, path, weak).collect()
    want, n = groups(awkward_rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert sum(r.kept for r in got) == n


def test_state_goes_on_with_later_files(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for texts in (["a b", "c"], ["ab", "a  b", "d"]):
        frame(spark, texts).coalesce(1).write.mode("append").parquet(path)
        rows = dedup.stream_state(spark, path, spark.read.parquet(path).schema, state_dir=state).collect()
    assert sorted((r.keep_id, r.group_size) for r in rows) == [(1, 1), (1, 3), (2, 1)]


def test_later_files_count_however_old_they_are(spark, tmp_path):
    path, state = tmp_path / "in", str(tmp_path / "state")
    for texts, days in ((["a b", "c"], 0), (["ab", "d"], 30)):
        before = set(path.glob("*.parquet"))
        frame(spark, texts).coalesce(1).write.mode("append").parquet(str(path))
        for file in set(path.glob("*.parquet")) - before:
            at = file.stat().st_mtime - 86_400 * days
            os.utime(file, (at, at))
        rows = dedup.stream_state(spark, str(path), spark.read.parquet(str(path)).schema, state_dir=state).collect()
    assert sorted(r.group_size for r in rows) == [1, 1, 2]


LEAST, MOST = -(2**63), 2**63 - 1


@pytest.mark.parametrize("tail", ["", "/"])
def test_extreme_ids_ties_and_odd_paths(spark, tmp_path, tail):
    rows = [(LEAST, "a b"), (0, "ab "), (MOST, "c"), (LEAST, "c"), (None, "c"), (None, "d"), (MOST, "d"), (LEAST, "e"), (LEAST, "e"), (None, "f"), (None, "f")]
    want, n = groups(rows)
    with pytest.raises(ValueError, match="pattern"):
        dedup.stream_state(spark, str(tmp_path / "odd[1]dir"), None)
    plain = str(tmp_path / "plain")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(plain)
    got = dedup.dedup_files(spark, plain + tail).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n


def test_deduplicated_keeps_columns(spark, clashing, awkward_rows):
    rows = dedup.deduplicated(spark, clashing)
    assert rows.columns == clashing.columns and rows.count() == groups(awkward_rows)[1]


# --- operator 8 ---


def mixed(rows, share=1.0):
    sizes = [len(WORD.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = [s for s in sources if s not in full]
        left = share * sum(total.values()) - sum(3 * total[s] for s in full)
        target = {s: 3.0 * total[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in sources}
        over = {s for s in rest if target[s] > 3 * total[s]}
        if not over:
            return sizes, total, target
        full |= over


def test_op8_on_awkward_rows(spark, landed, awkward_rows):
    got = mixing.op8_mix(spark, landed["awkward"]).collect()
    sizes, total, target = mixed(awkward_rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(w[0]), n) for w, n in zip(awkward_rows, sizes, strict=True))
    taken = Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.op8_mix(spark, landed["awkward"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.op8_mix(spark, landed["empty"]).count() == 0


def test_mix_takes_the_same_rows_however_they_are_partitioned(spark, monkeypatch):
    """Ids that are null, equal or extreme; rows that differ in nothing are as good as each other."""
    rnd = random.Random(9)
    ids = [None, None, 5, LEAST, MOST]
    rows = [(ids[i % 5], prose(rnd, 3), None if i % 3 else "s", 0, 0) for i in range(300)] + [(None, "same text here", "t", 0, 0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text", "source")
    taken = []
    for parts, bound in ((1, 10_000), (7, 10_000), (5, 2)):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bound)
        got = mixing.mix(docs.repartition(parts), "doc_id", "text").collect()
        taken.append(sorted(map(str, got)))
        _, _, target = mixed([(r[0], r[1], 0, r[2]) for r in docs.collect()])
        for s, t in target.items():
            assert abs(sum(r.taken for r in got if r.source == s) - t) <= 1
    assert taken[0] == taken[1] == taken[2]


@pytest.mark.parametrize("few", [0, 10_000])
def test_mix_with_few_and_many_sources(spark, landed, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    assert mixing.op8_mix(spark, landed["awkward"]).agg(F.sum("taken")).first()[0] > 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10_000 - few)
    assert len({tuple(sorted(map(str, mixing.op8_mix(spark, landed["awkward"]).collect()))) for _ in range(2)}) == 1


def test_sources_are_ranked_over_all_ranges(spark):
    """By code point, null last, whatever range of names a source is in."""
    rnd = random.Random(12)
    names = [*(chr(rnd.choice((65, 97, 233, 0x6F22, 0x1F600)) + i % 20) * (1 + i % 3) for i in range(400)), "", None]
    rows = [(i, prose(rnd, rnd.randrange(9)), None, s) for i, s in enumerate(names * 2)]
    got = mixing.targets(mixing.sizes(spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string"))).collect()
    _, total, target = mixed(rows)
    assert {r.source: r.source_size for r in got} == total and len(got) == len(total)
    for r in got:
        assert r.target == pytest.approx(target[r.source])


def test_mix_leaves_clashing_columns_out(clashing):
    rows = mixing.mix(clashing, *clashing.columns)
    assert rows.count() == clashing.count() and rows.columns.count("size") == 1


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    from cinderloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf)
    assert sorted(map(str, (tuple(r) for r in got.select(*sorted(got.columns)).collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(sorted(want.columns))} FROM want").fetchall()))


# --- operator 2 ---


def near(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    kinds = sorted({s for s in sets if s}, key=sorted)
    root, links = {s: s for s in kinds}, Counter()

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if 10 * len(a & b) >= 8 * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    copies, members = defaultdict(list), defaultdict(list)
    for row, s in zip(rows, sets, strict=True):
        if s:
            copies[s].append(row[0])
            members[find(s)].append(row[0])
    out = []
    for row, s in zip(rows, sets, strict=True):
        out.append((row[0], least(members[find(s)]), least(copies[s]), len(copies[s]), links[s]) if s else (row[0], row[0], row[0], 1, 0))
    return sorted(out, key=str)


def edited(rnd, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("group", "block", "stride", "small"), [(256, 192, 64, 64), (4, 3, 2, 3)])
def test_join_finds_all_links(spark, monkeypatch, group, block, stride, small):
    for name, value in (("GROUP", group), ("BLOCK", block), ("STRIDE", stride), ("SMALL", small)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(11)
    bases = [prose(rnd, 150) for _ in range(6)]
    texts = [edited(rnd, bases[i % 6], rnd.randrange(0, 5)) for i in range(70)] + [prose(rnd, 90) for _ in range(30)] + bases[:2] * 3
    got = ngram_join.near_classes(frame(spark, texts)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "class_id", "rep_id", "n_copies", "n_links")) for r in got), key=str) == near(list(enumerate(texts)))


@pytest.mark.parametrize("block", [400, 290])
def test_blocks_of_more_than_256_sets(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(13)
    base = prose(rnd, 60)
    texts = [base, *(edited(rnd, base, 1) for _ in range(560 if block == 290 else 300))]
    got = ngram_join.near_classes(frame(spark, texts)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "class_id", "rep_id", "n_copies", "n_links")) for r in got), key=str) == near(list(enumerate(texts)))


def test_large_group_of_near_and_far_sets(spark, monkeypatch):
    """Distances from the centre from 0 to over 0.2: sure links, doubtful ones, chains and sets that link to none."""
    for name, value in (("GROUP", 8), ("BLOCK", 5), ("STRIDE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(15)
    base = prose(rnd, 200)
    texts = [base, *(edited(rnd, base, rnd.randrange(0, 12)) for _ in range(120))]
    texts += [edited(rnd, rnd.choice(texts[1:]), rnd.randrange(1, 4)) for _ in range(40)]
    got = ngram_join.near_classes(frame(spark, texts)).collect()
    want = near(list(enumerate(texts)))
    assert sorted((tuple(r[c] for c in ("doc_id", "class_id", "rep_id", "n_copies", "n_links")) for r in got), key=str) == want
    assert len({w[4] for w in want}) > 20


@pytest.mark.parametrize("kind", ["template", "two families", "scattered"])
def test_centres_that_are_no_set_of_the_group(spark, monkeypatch, kind):
    """A template that no text shows plain, two families about equally large, and sets that are all far from what most agree on."""
    for name, value in (("GROUP", 8), ("BLOCK", 7), ("STRIDE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(kind)
    base = [f"w{k}" for k in range(200)]
    other = [f"v{k}" if k % 37 == 5 else w for k, w in enumerate(base)]
    texts = []
    for k in range(90):
        words = list(other if kind == "two families" and k % 2 else base)
        slots = range(10, 200, 60) if kind == "template" else rnd.sample(range(200), rnd.randrange(4) if kind == "two families" else rnd.randrange(3, 7))
        for at in slots:
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    got = ngram_join.near_classes(frame(spark, texts)).collect()
    want = near(list(enumerate(texts)))
    assert sorted((tuple(r[c] for c in ("doc_id", "class_id", "rep_id", "n_copies", "n_links")) for r in got), key=str) == want
    assert kind != "template" or {w[4] for w in want} == {89}


def test_join_equals_sql_on_ten_thousand_documents(spark):
    """Every link of all 10,000 documents is found: recall 1 against all pairs that share a 5-gram."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, class_id, rep_id, n_copies, n_links FROM ({ORACLE_SQL['op2_ngram_join']})").fetchall()
    got = ngram_join.op2_ngram_join(spark, sf).select("doc_id", "class_id", "rep_id", "n_copies", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op2_on_awkward_rows(spark, landed, awkward_rows):
    got = ngram_join.op2_ngram_join(spark, landed["awkward"]).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "class_id", "rep_id", "n_copies", "n_links")) for r in got), key=str) == near(awkward_rows)
    assert ngram_join.op2_ngram_join(spark, landed["empty"]).count() == 0


def test_distinct_documents_keeps_one_of_each_class(spark, clashing, awkward_rows):
    rows = ngram_join.distinct_documents(clashing)
    classes = {r[1] for r in near(awkward_rows) if r[1] is not None}
    assert rows.columns == clashing.columns
    # Rows that are in no class with an id stay: those with neither words nor id.
    assert rows.count() == len(classes) + sum(r[0] is None and not (r[1] or "").strip() for r in awkward_rows)


def test_classes_are_not_told_apart_by_their_ids(spark):
    rnd = random.Random(12)
    one, two, three, four = (prose(rnd, 150) for _ in range(4))
    near_copies = [(None, edited(rnd, one, 1)) for _ in range(4)]  # a class without any id
    rows = [*near_copies, (7, two), (7, three), (None, edited(rnd, three, 1)), (8, four), (None, " "), (7, None), (9, "")]
    got = [tuple(r) for r in ngram_join.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sum(r in near_copies for r in got) == 1
    assert sorted((r for r in got if r not in near_copies), key=str) == sorted([(7, two), (7, three), (8, four), (None, " "), (7, None), (9, "")], key=str)


def test_distinct_documents_row_by_row(spark):
    """Held against brute force by rows: repeated, null and extreme ids, rows without words, a column named like the place."""
    rnd = random.Random(14)
    bases = [prose(rnd, 80) for _ in range(6)]
    rows = [(rnd.choice([None, 3, LEAST, MOST, i]), edited(rnd, rnd.choice(bases), rnd.randrange(2)), i) for i in range(60)] + [(None, " ", 60), (3, None, 61), (3, "", 62)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __at long").repartition(3)
    got = {r["__at"] for r in ngram_join.distinct_documents(docs).collect()}
    # near() names classes by ids, so each row gets its number as its id here.
    classes = {n: c for n, c, *_ in near([(r[2], r[1]) for r in rows])}
    assert {60, 61, 62} <= got
    for c in set(classes.values()) - {60, 61, 62}:
        members = [r for r in rows if classes[r[2]] == c]
        stays = [r for r in members if r[2] in got]
        assert len(stays) == 1 and (stays[0][0] is None, stays[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in members)


def test_spread_join_equals_join(spark):
    from cinderloom.llm.common import frequent, spread_join

    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, x long").repartition(4)
    right = spark.createDataFrame([(k, -k) for k in range(0, 3000, 2)] + [(1, 7), (1, 8)], "k long, y long")
    often = frequent(left.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 3000)
    for how in ("inner", "left"):
        got, want = spread_join(left, right, "k", often, ["x"], how), left.join(right, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_enough_runs():
    assert ngram_join.runs() == 8 and ngram_join.runs(recall=0.9) < ngram_join.runs(recall=0.99)


# --- operator 3 ---


def without(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        left = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(left).hexdigest()))
    return out


def test_refinement_finds_repeated_strings_of_a_node():
    rnd = random.Random(6)
    base = "".join(rnd.choice("abc") for _ in range(400)).encode()
    parts = [base[:350], base[20:300], base[:210], bytes(rnd.choice(b"xyz") for _ in range(260)), base[:350]]
    nodes = [1, 1, 1, 1, 2]
    count = Counter((n, p[i : i + 200]) for n, p in zip(nodes, parts, strict=True) for i in range(len(p) - 199))
    want = [len(p) - i >= 200 and count[n, p[i : i + 200]] > 1 for n, p in zip(nodes, parts, strict=True) for i in range(len(p))]
    left = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
    node = np.repeat(np.array(nodes, np.uint64), [len(p) for p in parts])
    assert suffix_dedup.refined(np.frombuffer(b"".join(parts), np.uint8), left, node).tolist() == want


@pytest.mark.parametrize("small", [64, 3])
def test_repeats_are_removed_to_the_byte(spark, monkeypatch, small):
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    rnd = random.Random(3)
    bases, passage = [prose(rnd, 120) for _ in range(5)], prose(rnd, 45)
    texts = [edited(rnd, bases[i % 5], rnd.randrange(0, 3)) for i in range(60)]
    texts += [f"{prose(rnd, 25)} {passage} {prose(rnd, 25)}" for _ in range(25)]
    texts += ["ab" * rnd.randrange(90, 140) + prose(rnd, 4) for _ in range(9)] + ["", None, "x" * 199, "y" * 200, "z" * 201, "z" * 205 + "q"]
    got = suffix_dedup.without_repeats(frame(spark, texts), "doc_id").select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == without(texts)


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    rnd = random.Random(4)
    part = prose(rnd, 70)
    texts = [prose(rnd, 400) + part + prose(rnd, 300), part, prose(rnd, 100) + part[20:]]
    import pyarrow as pa

    from cinderloom.llm.common import utf8

    raw, offsets = utf8(pa.array(texts))
    whole = suffix_dedup.anchors(raw, offsets)
    strings = sum(int((h - l + 1).sum()) for l, h in [whole[4:]])
    pieces = sum(int((h - l + 1).sum()) for _, r, o, _ in suffix_dedup._pieces(raw, offsets) for l, h in [suffix_dedup.anchors(r, o)[4:]])
    assert strings == pieces == sum(max(0, len(t.encode()) - 199) for t in texts)


def test_op3_on_awkward_rows(spark, landed, awkward_rows):
    rows = [r for r in awkward_rows]
    got = sorted((tuple(r) for r in suffix_dedup.op3_suffix_dedup(spark, landed["awkward"]).collect()), key=str)
    short = [(r[0], r[1] if len(r[1] or "") < 100_000 else None) for r in rows]
    want = without([t for _, t in short])
    for doc, text in {(r[0], r[1]) for r in rows if len(r[1] or "") < 100_000 and (r[1] or "").count("x") < 1000}:
        exact = [w for (d, t), w in zip(short, want, strict=True) if d == doc and t == text][0]
        assert any(g[0] == doc and g[1:] == exact for g in got), (doc, exact)
    for r in rows:  # the long texts: copies lose everything, one sign over and over repeats itself
        if len(r[1] or "") >= 100_000:
            n = len(r[1].encode())
            assert (r[0], n, n, 1, hashlib.sha256(b"").hexdigest()) in got
    assert suffix_dedup.op3_suffix_dedup(spark, landed["empty"]).count() == 0


def _near_pairs(n, rnd):
    """n texts of 60 words, of which each two in a row differ in one word."""
    out = []
    for _ in range(n // 2):
        words = [f"w{rnd.randrange(10_000)}" for _ in range(60)]
        out += [" ".join(words), " ".join([*words[:-1], "other"])]
    return out


def test_shared_doc_ids_cost_no_more_than_own_ones(spark):
    """Texts are found again by their id and a hash of their own, so rows with one id don't all meet."""
    texts = _near_pairs(3000, random.Random(5))
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    took = {}
    for name, frame in (("warm", own), ("own", own), ("one", own.withColumn("doc_id", F.lit(7).cast("long"))), ("none", own.withColumn("doc_id", F.lit(None).cast("long")))):
        start = time.perf_counter()
        rows = ngram_join.near_classes(frame.withColumn("row", F.xxhash64("text")), "row").collect()
        took[name] = time.perf_counter() - start
        assert len(rows) == 3000 and {r.n_links for r in rows} == {1} and {r.n_copies for r in rows} == {1}
        assert {r.class_id for r in rows} == {"warm": set(range(0, 3000, 2)), "own": set(range(0, 3000, 2)), "one": {7}, "none": {None}}[name]
    assert took["one"] < 2 * took["own"] and took["none"] < 2 * took["own"], took


def test_kept_columns_with_the_join_s_own_names(spark):
    rows = [(k, t, f"i{k}", k * 10, f"v{k}", -k) for k, t in enumerate(["a b c d e f", "a b c d e f", "x y z", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, set long, vector string, rep_id int")
    got = ngram_join.near_classes(docs, "id", "set", "vector", "rep_id")
    assert sorted(got.columns) == sorted(["doc_id", "id", "set", "vector", "class_id", "rep_id", "n_copies", "n_links"])
    assert sorted((r.doc_id, r.id, r.set, r.vector, r.class_id, r.rep_id, r.n_copies) for r in got.collect()) == [(0, "i0", 0, "v0", 0, 0, 2), (1, "i1", 10, "v1", 0, 0, 2), (2, "i2", 20, "v2", 2, 2, 1), (3, "i3", 30, "v3", 3, 3, 1)]


def test_reruns_of_the_mix_take_the_same_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "one two three", "s0", f"l{k}") for k in range(30)] + [(2, "four five", "s1", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    runs = [sorted(map(tuple, mixing.mix(docs.repartition(n), "doc_id", "lang").select("doc_id", "lang", "taken").collect())) for n in (1, 5, 7)]
    assert runs[0] == runs[1] == runs[2] and len({t for *_, t in runs[0]}) > 1


def _shuffled(spark, run):
    """What ``run`` returns, and the bytes that its stages wrote to shuffles."""

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        gateway, found = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
        rows = found.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return [rows.apply(k) for k in range(rows.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    out = run()
    return out, sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)


def test_texts_that_meet_no_other_are_not_shuffled(spark, tmp_path):
    """Neither their texts nor their signatures: the join shuffles less than half of what its texts have."""
    rnd = random.Random(31)
    texts = [" ".join(f"{rnd.getrandbits(40):x}" for _ in range(250)) for _ in range(2000)]
    texts += [t + " more" for t in texts[:20]]
    frame(spark, texts).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows, written = _shuffled(spark, lambda: ngram_join.near_classes(docs).collect())
    assert len(rows) == 2020 and {r.doc_id: r.class_id for r in rows} == {k: k % 2000 for k in range(2020)}
    assert {r.doc_id for r in rows if r.n_links == 1} == {*range(20), *range(2000, 2020)} and sum(r.n_links for r in rows) == 40
    assert written < sum(map(len, texts)) / 2


@pytest.mark.parametrize("masks", [1, 1 << 18])
def test_repeated_rows_in_small_and_large_groups(spark, monkeypatch, masks):
    """Rows with one id and one text stand for one set, also where the filter of texts lets all pass."""
    for name, value in (("GROUP", 8), ("BLOCK", 5), ("STRIDE", 2), ("MASKS", masks)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(32)
    bases = [prose(rnd, 120) for _ in range(3)]
    rows = [(k, edited(rnd, bases[0], rnd.randrange(1, 6))) for k in range(30)] + [(None, bases[0])] * 40
    rows += [(40, bases[1])] * 30 + [(41, edited(rnd, bases[1], 1))] * 2 + [(None, bases[2])] * 20 + [(k, prose(rnd, 50)) for k in range(50, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.near_classes(docs).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "class_id", "rep_id", "n_copies", "n_links")) for r in got), key=str) == near(rows)


def test_sorted_groups_lose_their_repeated_rows():
    group = pa.table({"turn": [0, 0, 1, 1, 1, 1], "set": [5, 5, 2, 5, 5, 7], "grams": list("aabaac")})
    assert ngram_join._once(group, "turn", "set").to_pydict() == {"turn": [0, 1, 1, 1], "set": [5, 2, 5, 7], "grams": list("abac")}
    assert ngram_join._once(group, "grams").num_rows == 4 and ngram_join._once(group.slice(0, 0), "set").num_rows == 0


def test_filter_of_texts_keeps_all_that_are_wanted(spark):
    rows = spark.range(40_000).select(F.col("id"), (7 * F.col("id")).alias("mark"), F.lit(1).alias("word"))
    wanted = rows.where("id % 40 = 0").select("mark", "id")
    got = {r.id for r in ngram_join.maybe_wanted(rows, wanted, "id", "mark").collect()}
    assert {*range(0, 40_000, 40)} <= got and len(got) < 1100
    assert ngram_join.maybe_wanted(rows, wanted, "id", "mark").columns == rows.columns
    assert ngram_join.maybe_wanted(rows, wanted.limit(0), "id", "mark").count() == 0
