import gzip
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderloom import cli
from cinderloom.config import CohortConfig
from cinderloom.functions import features
from cinderloom.operators import feedback, gates, mixture, outputs, snps, thresholds
from cinderloom.plans import cohort
from cinderloom.sources import files, idat, idat_source, matrix, state
from cinderloom.streaming import feedback as stream
from cinderloom.timing import Timer, timing_summary

CFG = CohortConfig()


# --- files ---


def test_decoder_round_trip_plain_and_gzipped():
    ids, means = np.array([1, 70_000, 4_294_967_295]), np.array([0, 65_535, 7])
    raw = idat.encode(ids, means)
    for data in (raw, gzip.compress(raw)):
        got = idat.decode(data)
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == means.tolist()


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda r: b"XDAT" + r[4:], "bad magic"),
        (lambda r: r[:4] + struct.pack("<Q", 2) + r[12:], "unsupported version"),
        (lambda r: r[:12] + struct.pack("<I", 0) + r[16:], "unreasonable"),
        (lambda r: r[:12] + struct.pack("<I", 50_001) + r[16:], "unreasonable"),
        (lambda r: r[:16] + struct.pack("<H", 7) + r[18:], "missing field 1000"),
        (lambda r: r[:-1], "short read"),
        (lambda r: r[:14], "short read"),
    ],
)
def test_decoder_errors(change, message):
    with pytest.raises(ValueError, match=message):
        idat.decode(change(idat.encode(np.array([1, 2]), np.array([3, 4]))))


@pytest.fixture(scope="module")
def array_root(tmp_path_factory):
    """Six samples; one lacks markers, one green file has no red one."""
    root = tmp_path_factory.mktemp("arrays")
    rng = np.random.default_rng(1)
    ids = np.arange(1, 41)
    for s in range(6):
        kind = (ids + s) % 3
        red = np.choose(kind, [9000, 5000, 700]) + rng.integers(0, 90, 40)
        grn = np.choose(kind, [700, 5000, 9000]) + rng.integers(0, 90, 40)
        keep = slice(0, 38) if s == 2 else slice(None)
        folder = root / f"chip{s % 2}"
        folder.mkdir(exist_ok=True)
        end, pack = (".gz", gzip.compress) if s % 2 else ("", bytes)
        (folder / f"S{s}_{'Green' if s == 3 else 'Grn'}.idat{end}").write_bytes(pack(idat.encode(ids[keep], grn[keep])))
        (folder / f"S{s}_Red.idat").write_bytes(idat.encode(ids, red))
    (root / "alone_Grn.idat").write_bytes(idat.encode(ids, ids))
    (root / "notes.txt").write_text("no array")
    return str(root)


def test_pairs_in_path_order_with_names(spark, array_root):
    rows = idat.find_pairs(spark, array_root).orderBy("sample_idx").collect()
    assert [r.base for r in rows] == ["S0", "S2", "S4", "S1", "S3", "S5"]
    assert [r.sample for r in rows] == ["S0", "S2", "S4", "S1_Grn.idat", "S3_Green.idat", "S5_Grn.idat"]  # the channel goes where it ends the stem
    assert idat.find_pairs(spark, array_root, 2).count() == 2


def test_two_files_for_a_channel_are_an_error(spark):
    paths = spark.createDataFrame([("/a/X_Grn.idat",), ("/b/X_Grn.idat",), ("/a/X_Red.idat",)], "path string")
    with pytest.raises(Exception, match="several files"):
        idat.pair_channels(idat.channel_files(paths)).collect()


def test_run_from_files_twice(spark, array_root, tmp_path):
    feedback_path, bad_path = str(tmp_path / "feedback"), str(tmp_path / "bad")
    argv = ["--root", array_root, "--out-dir", str(tmp_path / "out"), "--feedback-out", feedback_path, "--bad-snps-out", bad_path, "--debug-snp", "5"]
    a, cfg = cli.parse(argv)
    done = cohort.run_from_files(spark, a.root, a.out_dir, cfg, None, a.feedback_out, None, a.bad_snps_out)
    assert done.calls.select("snp_id").distinct().count() == 38  # one sample lacks two
    assert {r.label for r in done.timer.frame(spark).collect()} >= {"load_samples", "common_ids", "chunk_cluster_em_bic"}
    first = {r.snp_id: r.seen for r in state.read_feedback(spark, feedback_path).collect()}
    assert set(first.values()) == {6}
    centres = spark.read.csv(str(tmp_path / "out/debug_snp_00000005_centres"), header=True)
    assert 1 <= centres.count() <= 3 and {r.geno for r in centres.collect()} <= set(gates.CALLS)
    assert 300 <= cohort.preflight_floor(spark, array_root, 2) <= 800
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out/cohort_calls").glob("part-*"))).splitlines()
    assert lines[0] == "SNP_ID,S0,S2,S4,S1_Grn.idat,S3_Green.idat,S5_Grn.idat" and len(lines) == 39
    qc = spark.read.csv(str(tmp_path / "out/cohort_qc_summary"), header=True)
    assert done.totals["total"] == 6 * 38 == sum(int(r.total_snps) for r in qc.collect()) and done.totals["calls_tau"] == sum(int(r.calls_at_tau) for r in qc.collect())
    assert qc.columns[0] == "Sample" and qc.count() == 6 and all(len(r.call_rate_tau.split(".")[1]) == 6 for r in qc.collect())
    cohort.run_from_files(spark, a.root, str(tmp_path / "out2"), cfg, feedback_path, feedback_path + "2", bad_path, bad_path + "2")
    second = {r.snp_id: r.seen for r in state.read_feedback(spark, feedback_path + "2").collect()}
    dropped = {r.snp_id for r in state.read_bad(spark, bad_path).collect()}
    assert all(n == (6 if s in dropped else 12) for s, n in second.items())


def test_command_line(spark, array_root, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["--root", array_root, "--out-dir", str(out), "--first", "4", "--rmin-formula", "exact", "--r-min", "auto", "--p-min", "auto", "--init", "kpp", "--plot-first-snps", "3"]) == 0
    text = capsys.readouterr()
    assert "cohort_qc_summary" in text.out and "chunk_cluster_em_bic" in text.err and "total ms" in text.err
    assert spark.read.csv(str(out / "cohort_qc_summary"), header=True).count() == 4
    pictures = sorted(out.glob("plots/name=*/part-*"))
    assert len(pictures) == 3 and all(p.read_text().startswith("<svg ") and "<circle" in p.read_text() for p in pictures)
    images = sorted((out / "pictures").iterdir())
    assert len(images) == 3 and all(plain_png(p.read_bytes())[:2] == (1400, 1000) for p in images[:1]) and all(p.name.endswith(".png") for p in images)
    (tmp_path / "none").mkdir()
    assert cli.main(["--root", str(tmp_path / "none"), "--out-dir", str(out)]) == 0
    assert "no pairs" in capsys.readouterr().out
    assert cli.parse(["--root", "a", "--out-dir", "b", "--rmin-formula", "exact"])[1].rmin_formula == "exact"


def test_channels_meet_as_far_as_the_shorter_goes(spark, array_root):
    rows = idat.read_probes(spark, array_root).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in rows} == {s: 38 if s == "S2" else 40 for s in ("S0", "S2", "S4", "S1_Grn.idat", "S3_Green.idat", "S5_Grn.idat")}
    assert idat.read_probes(spark, array_root, 2).select("sample").distinct().count() == 2


def test_source_reads_what_spark_reads(spark, array_root):
    idat_source.register(spark)
    for first in (0, 2):
        got = spark.read.format("idat").option("first", first).load(array_root)
        want = idat.through_spark(spark, array_root, first)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = idat.read_probes(spark, array_root)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchScan" in plan
    points = mixture.markers(got, snps.common_snps(got).hint("broadcast"), CFG)._jdf.queryExecution().executedPlan().toString()
    assert points.split("BroadcastExchange")[0].count("Exchange hashpartitioning(snp_id") == 1  # where a marker's points meet


def test_source_leaves_samples_and_markers_out(spark, array_root):
    idat_source.register(spark)
    table = spark.read.format("idat").load(array_root)
    every = [tuple(r) for r in table.collect()]
    # One DataFrame under many filters: none may stay with the table.
    for condition, keep in (("sample_idx = 3", lambda r: r[0] == 3), ("sample_idx in (1, 4) and snp_id > 30", lambda r: r[0] in (1, 4) and r[2] > 30), ("snp_id between 5 and 7 and sample != 'S0'", lambda r: 5 <= r[2] <= 7 and r[1] != "S0"), ("snp_id = 41", lambda r: False), ("snp_id in (1, 40) or red > 9000", lambda r: r[2] in (1, 40) or r[3] > 9000)):
        assert sorted(tuple(r) for r in table.where(condition).collect()) == sorted(filter(keep, every)), condition
    chosen = lambda **o: spark.read.format("idat").options(**o).load(array_root)
    assert sorted(map(tuple, chosen(samples="1, 4", low=31).collect())) == sorted(r for r in every if r[0] in (1, 4) and r[2] > 30)
    assert sorted(map(tuple, chosen(low=5, high=7, first=3).collect())) == sorted(r for r in every if r[0] < 3 and 5 <= r[2] <= 7)
    assert chosen(samples="9").collect() == [] and chosen(samples="").collect() == [] and chosen(high=0).collect() == []
    reader = idat_source.IdatReader({"path": array_root, "samples": "2", "high": "4"})
    (part,) = reader.partitions()
    assert part.sample_idx == 2 and sum(b.num_rows for b in reader.read(part)) == 4


def test_bloom_filter_of_markers(spark, tmp_path, array_root):
    chosen = spark.range(1, 400_001, 2).select((F.col("id") * 7).alias("snp_id"))
    path = idat_source.write_bloom(chosen, str(tmp_path / "deep/markers"))
    words = idat_source.read_bloom(path)
    ids = np.arange(1, 400_001, 2) * 7
    assert len(words) * 64 == idat_source.BLOOM_BITS and idat_source.bloom_has(words, ids).all()
    assert idat_source.bloom_has(words, ids + 1).mean() < 0.001
    few = idat_source.write_bloom(spark.createDataFrame([(3,), (17,), (40,)], "snp_id long"), str(tmp_path / "few"))
    rows = idat.read_probes(spark, array_root, markers=few).collect()
    assert len(rows) == 3 * 6 - 1 and {r.snp_id for r in rows} == {3, 17, 40}  # one sample lacks marker 40


def test_empty_and_broken_files_name_their_pair(spark, tmp_path):
    for name, raw in (("A_Grn", idat.encode(np.arange(2), np.arange(2))), ("A_Red", idat.encode(np.arange(0), np.arange(0)))):
        (tmp_path / f"{name}.idat").write_bytes(raw)
    for read in (idat.read_probes, idat.through_spark):
        with pytest.raises(Exception, match="empty pair"):
            read(spark, str(tmp_path)).collect()
    (tmp_path / "A_Red.idat").write_bytes(b"IDAT")
    with pytest.raises(Exception, match="A_Red.idat: short read"):
        idat.read_probes(spark, str(tmp_path)).collect()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/A_Red.idat").write_bytes(b"")
    with pytest.raises(Exception, match="several files"):
        idat.read_probes(spark, str(tmp_path)).collect()


def _fails(rows, at):
    """The rows, with an error where ``snp_id`` is ``at``."""
    return rows.withColumn("snp_id", F.when(F.col("snp_id") == at, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("snp_id")))


def test_written_channel_files(spark, tmp_path):
    idat_source.register(spark)
    cells = spark.range(300).select(F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("sample"), F.col("id").alias("snp_id"), (F.col("id") % 7).cast("int").alias("red"), (F.col("id") % 11).cast("int").alias("grn"))
    ready = cells.repartition(2, "sample").sortWithinPartitions("sample", "snp_id")
    place = tmp_path / "out"
    ready.write.format("idat").option("gzip", "true").mode("overwrite").save(str(place))
    assert sorted(p.name for p in place.iterdir()) == [f"S{k}_{c}.idat.gz" for k in range(3) for c in ("Grn", "Red")]
    read = spark.read.format("idat").load(str(place)).select(F.substring("sample", 1, 2), "snp_id", "red", "grn")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, cells.collect()))
    with pytest.raises(Exception, match="lost"):
        _fails(ready, 200).write.format("idat").mode("append").save(str(place))
    assert len(list(place.iterdir())) == 6
    with pytest.raises(Exception, match="several places"):
        cells.repartition(4, "snp_id").write.format("idat").mode("overwrite").save(str(tmp_path / "torn"))
    assert not list((tmp_path / "torn").iterdir())


def test_call_matrix_parts(spark, tmp_path):
    rows = [(s, k, "AA" if (s + k) % 3 else "NoCall") for s in range(2000, 0, -1) for k in range(5) if (s, k) != (7, 2)]
    called = spark.createDataFrame(rows, "snp_id long, sample_idx int, call string").repartition(6)
    place = tmp_path / "matrix"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts, small as they are
    matrix.write_matrix(called, [f"N{k}" for k in range(5)], str(place))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(place.iterdir())
    text = "".join(p.read_text() for p in parts).splitlines()
    assert len(parts) > 2 and text[0] == "SNP_ID,N0,N1,N2,N3,N4" and sum(t.startswith("SNP_ID") for t in text) == 1
    assert [int(t.split(",")[0]) for t in text[1:]] == list(range(1, 2001)) and text[7] == "7,AA,AA,,AA,AA"
    back = matrix.read_matrix(spark, str(place), 5)
    want = outputs.wide_calls(called, list(range(5)))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))
    before = [p.name for p in parts]
    with pytest.raises(Exception, match="lost"):
        matrix.write_matrix(_fails(called, 1500), ["x"] * 5, str(place))
    assert [p.name for p in sorted(place.iterdir())] == before
    for torn in (called.repartition(3).sortWithinPartitions("snp_id"), called.coalesce(1).orderBy(F.desc("snp_id"))):
        with pytest.raises(Exception, match="ordered"):
            torn.write.format("callmatrix").option("samples", "\n".join("abcde")).mode("overwrite").save(str(tmp_path / "torn"))
        assert not list((tmp_path / "torn").glob("*"))


def test_chosen_markers_are_left_out_where_they_are_decoded(spark, array_root, tmp_path):
    """A limited run from files reads twice, and its calls are those of the same run over all cells."""
    for limit in ({"max_snps": 9}, {"sample_snps": 11}):
        cfg = CohortConfig(plot_first_snps=0, **limit)
        bad = spark.createDataFrame([(2,), (5,)], "snp_id long")
        state.write_bad(bad, str(tmp_path / "bad"))
        done = cohort.run_from_files(spark, array_root, str(tmp_path / "out"), cfg, bad_in=str(tmp_path / "bad"))
        plain = cohort.run(idat.read_probes(spark, array_root).drop("sample"), cfg, bad)
        pick = lambda r: sorted(map(tuple, r.calls.select("snp_id", "sample_idx", "call").collect()))
        assert pick(done) == pick(plain) and len({r[0] for r in pick(done)}) == next(iter(limit.values()))
        cells, names, chosen = cohort.decoded_cells(spark, array_root, cfg, bad, 6)
        assert cells.count() == 6 * chosen.count() and names.count() == 6  # no false positive among so few


def test_no_pairs_and_too_few_samples(spark, tmp_path, array_root):
    (tmp_path / "x_Grn.idat").write_bytes(b"IDAT")
    assert cohort.run_from_files(spark, str(tmp_path), str(tmp_path / "o")) is None
    with pytest.raises(ValueError, match="two samples"):
        cohort.run(spark.createDataFrame([(0, 1, 5, 5)], "sample_idx int, snp_id long, red int, grn int"))
    with pytest.raises(ValueError, match="no common"):
        cohort.run(spark.createDataFrame([(0, 1, 5, 5), (1, 2, 5, 5)], "sample_idx int, snp_id long, red int, grn int"))
    with pytest.raises(Exception, match="marker twice"):
        cohort.run(spark.createDataFrame([(0, 1, 5, 5), (0, 1, 6, 5), (1, 1, 5, 5)], "sample_idx int, snp_id long, red int, grn int"))


def test_state_readers(spark, tmp_path):
    bad = tmp_path / "bad.txt"
    bad.write_text("# list\n\n 10 \n9\nx\n4294967296\n10\n-3")
    assert sorted(r.snp_id for r in state.read_bad(spark, str(bad)).collect()) == [9, 10]
    assert state.read_bad(spark, str(tmp_path / "none")).count() == 0
    old = tmp_path / "feedback.csv"
    old.write_text("snp_id,seen,nocall_raw,nocall_p,bad\n5,1,2,3,true\n0,9,9,9,true\n6,x,1,,false\n4294967296,1,1,1,true\n-4,1,1,1,true\n5,4,0,0,false\n")
    assert sorted(map(tuple, state.read_feedback(spark, str(old)).collect())) == [(5, 4, 0, 0, False), (6, 0, 1, 0, False)]
    assert state.read_feedback(spark, str(tmp_path / "none")).count() == 0
    state.write_bad(spark.createDataFrame([(9,), (10,)], "snp_id long"), str(tmp_path / "w"))
    assert "".join(p.read_text() for p in (tmp_path / "w").glob("part-*")).split() == ["10", "9"]
    rows = spark.createDataFrame([(k * 7919 % 1009, 1, 0, 0, k % 2 == 0) for k in range(1, 300)], state.FEEDBACK).repartition(5)
    state.write_feedback(rows, str(tmp_path / "f"))
    (part,) = (tmp_path / "f").glob("part-*")
    lines = part.read_text().splitlines()
    ids = [int(t.split(",")[0]) for t in lines[1:]]
    assert lines[0] == "snp_id,seen,nocall_raw,nocall_p,bad" and ids == sorted(ids) and len(ids) == 299


# --- features ---


def test_theta_at_the_edges(spark):
    rows = spark.createDataFrame([(0, 0), (0, 5), (5, 0), (7, 7)], "red int, grn int")
    got = [r[0] for r in rows.select(features.theta(F.col("red"), F.col("grn"))).collect()]
    assert got == pytest.approx([0, 1, 0, 0.5])


def test_names_and_single_intensities(spark):
    ids = spark.createDataFrame([(7,), (12345678,), (4_294_967_295,)], "snp_id long")
    assert [r[0] for r in ids.select(features.snp_name(F.col("snp_id"))).collect()] == ["snp_00000007", "snp_12345678", "snp_4294967295"]
    values = spark.createDataFrame([(0,), (1,), (65_535,)], "v int")
    assert [r[0] for r in values.select(features.log1p_intensity(F.col("v"))).collect()] == pytest.approx([0, math.log(2), math.log(65_536)])
    paths = spark.createDataFrame([("/a/X_Grn.idat",), ("/a/X_Grn.idat.gz",), ("X_Green.idat",), ("b/A_Grn_1_Grn.idat",)], "p string")
    assert [r[0] for r in paths.select(features.sample_name(F.col("p"))).collect()] == ["X", "X_Grn.idat", "X_Green", "A_Grn_1"] == [idat.stem(n) for n in ("X_Grn.idat", "X_Grn.idat.gz", "X_Green.idat", "A_Grn_1_Grn.idat")]
    assert [r[0] for r in paths.select(features.sample_name(F.col("p"), False)).collect()] == ["X", "X", "X", "A_Grn_1"]


def test_log_sum_exp(spark):
    row = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>").select(features.log_sum_exp(F.col("v"))).first()
    assert row[0] == pytest.approx(1000 + math.log(2))
    inf = math.inf
    values = spark.createDataFrame([([-inf, -inf],), ([inf, 1.0],), ([-inf, 2.0],)], "v array<double>")
    assert [r[0] for r in values.select(features.log_sum_exp(F.col("v"))).collect()] == [-inf, inf, 2.0]
    assert mixture._lse(np.array([[-inf, -inf], [inf, 1.0], [-inf, 2.0]])).tolist() == [-inf, inf, 2.0]


# --- mixtures ---


def scalar_em(xs, ys, centres, iters, tol):
    """The same EM, a point at a time."""
    n, k = len(xs), len(centres)
    var = lambda v: max(sum((a - sum(v) / n) ** 2 for a in v) / n, 1e-2)
    comps = [[1 / k, *c, var(xs), var(ys)] for c in centres]
    last = -math.inf
    for _ in range(iters):
        resp, loglik = [], 0.0
        for x, y in zip(xs, ys, strict=True):
            lp = [math.log(max(w, 1e-12)) - 0.5 * ((x - mx) ** 2 / max(vx, 1e-8) + (y - my) ** 2 / max(vy, 1e-8)) - 0.5 * math.log(max(vx, 1e-8) * max(vy, 1e-8)) - math.log(math.pi) for w, mx, my, vx, vy in comps]
            top = max(lp)
            total = top + math.log(sum(math.exp(v - top) for v in lp))
            resp.append([math.exp(v - total) for v in lp])
            loglik += total
        moved, new = 0.0, []
        for j in range(k):
            mass = sum(r[j] for r in resp)
            d = max(mass, 1e-8)
            mx, my = (sum(r[j] * a for r, a in zip(resp, v, strict=True)) / d for v in (xs, ys))
            vx, vy = (max(sum(r[j] * a * a for r, a in zip(resp, v, strict=True)) / d - m * m, 5e-6) for v, m in ((xs, mx), (ys, my)))
            moved += math.hypot(mx - comps[j][1], my - comps[j][2])
            new.append([min(max(mass / n, 1e-12), 1), mx, my, vx, vy])
        weight = sum(c[0] for c in new)
        comps = [[c[0] / weight, *c[1:]] for c in new]
        stop = abs(loglik - last) <= tol
        last = loglik
        if stop or moved / k < tol:
            break
    return comps, last


@pytest.mark.parametrize("k", [2, 3])
def test_batched_em_equals_the_scalar_one(k):
    rng = np.random.default_rng(k)
    x = rng.choice([0.1, 0.5, 0.9], (7, 24)) + rng.normal(0, 0.03, (7, 24))
    y = 4 + rng.normal(0, 0.1, (7, 24))
    cx, cy = mixture.quantile_centres(x, y, k)
    m = mixture.expectation_maximisation(x, y, (cx, cy), 200, 1e-6)
    for b in range(7):
        comps, loglik = scalar_em(x[b].tolist(), y[b].tolist(), list(zip(cx[b].tolist(), cy[b].tolist(), strict=True)), 200, 1e-6)
        assert np.allclose(np.stack([p[b] for p in m.parts()], 1), comps, atol=1e-9)
        assert m.loglik[b] == pytest.approx(loglik, abs=1e-7)


def test_no_rounds_give_minus_infinity():
    x = np.zeros((1, 4))
    assert mixture.expectation_maximisation(x, x, mixture.quantile_centres(x, x, 2), 0, 1e-6).loglik[0] == -math.inf


def test_ties_go_to_fewer_components():
    assert mixture.choose_k(np.array([[1, 1, 1], [2, 1, 1], [2, 1, 0]])).tolist() == [1, 2, 3]


def _model(w, theta):
    w, theta = np.array([w]), np.array([theta])
    return mixture.Model(w, theta, theta, theta, theta, np.zeros(1))


@pytest.mark.parametrize(
    ("k", "two", "three", "want"),
    [
        (3, ([0.5, 0.5], [0.1, 0.9]), ([0.03, 0.5, 0.47], [0.1, 0.5, 0.9]), 3),
        (3, ([0.5, 0.5], [0.1, 0.9]), ([0.0299, 0.5, 0.4701], [0.1, 0.5, 0.9]), 2),
        (3, ([0.01, 0.99], [0.1, 0.9]), ([0.0299, 0.5, 0.4701], [0.1, 0.5, 0.9]), 2),  # not tested again for weights
        (3, ([0.5, 0.5], [0.1, 0.9]), ([0.3, 0.3, 0.4], [0.1, 0.1349, 0.9]), 2),
        (3, ([0.5, 0.5], [0.1, 0.1199]), ([0.3, 0.3, 0.4], [0.1, 0.1349, 0.9]), 1),
        (3, ([0.5, 0.5], [0.1, 0.9]), ([0.3, 0.3, 0.4], [0.1, 0.1351, 0.9]), 3),
        (2, ([0.5, 0.5], [0.1, 0.1201]), ([0.3, 0.3, 0.4], [0.1, 0.2, 0.3]), 2),
        (2, ([0.0299, 0.9701], [0.1, 0.9]), ([0.3, 0.3, 0.4], [0.1, 0.2, 0.3]), 1),
    ],
)
def test_collapse_rules(k, two, three, want):
    models = {1: _model([1.0], [0.5]), 2: _model(*two), 3: _model(*three)}
    assert mixture.collapse(np.array([k]), models, 1.0).tolist() == [want]


@given(st.lists(st.tuples(st.integers(0, 65535), st.integers(0, 65535)), min_size=2, max_size=30))
@settings(max_examples=60, deadline=None)
def test_fit_invariants(cells):
    red, grn = np.array(cells, np.float64).T
    x, y = 2 * np.arctan2(grn, red)[None] / np.pi, 0.45 * np.log(red + grn + 1)[None]
    got = mixture.fit_all(x, y, CFG)
    k = int(got["k"][0])
    m = got["models"][k]
    assert 1 <= k <= 3 and abs(m.w.sum() - 1) < 1e-9
    assert ((got["post"] > 0) & (got["post"] <= 1 + 1e-12)).all() and got["lab"].max() < k
    back = mixture.fit_all(x[:, ::-1].copy(), y[:, ::-1].copy(), CFG)
    if len(set(x[0])) == x.shape[1]:
        assert back["k"][0] == k and np.allclose(back["bics"], got["bics"], atol=1e-5)


def test_restarts_keep_the_best(spark):
    rng = np.random.default_rng(0)
    x = rng.choice([0.1, 0.5, 0.9], (5, 30)) + rng.normal(0, 0.02, (5, 30))
    one = mixture.fitted(x, x, 3, CohortConfig(init="kpp", restarts=1))
    many = mixture.fitted(x, x, 3, CohortConfig(init="kpp", restarts=5))
    assert (many.loglik >= one.loglik - 1e-12).all()


def plain_spread(xs, ys, k, draw):
    """k-means++ for one marker, a point at a time; draw(d) gives the d-th number."""
    n = len(xs)
    picks = [int(draw(0) * n)]
    while len(picks) < k:
        d2 = [min((xs[i] - xs[c]) ** 2 + (ys[i] - ys[c]) ** 2 for c in picks) for i in range(n)]
        whole = []
        for d in d2:
            whole.append((whole[-1] if whole else 0.0) + d)
        if whole[-1] <= 0:
            return picks + [picks[0]] * (k - len(picks))
        goal = draw(len(picks)) * whole[-1]
        picks.append(next((i for i, w in enumerate(whole) if w >= goal), 0))
    return picks


@pytest.mark.parametrize("k", [1, 2, 3])
def test_spread_centres_equal_the_plain_ones(k):
    rng = np.random.default_rng(3)
    x, y = rng.choice([0.1, 0.5, 0.9], (40, 17)) + rng.normal(0, 0.03, (40, 17)), rng.normal(4, 0.1, (40, 17))
    x[5], y[5] = 0.25, 4.0  # all points equal: every distance is zero
    x[6], y[6] = np.repeat([0.1, 0.9], [9, 8]), 4.0  # two places: the third centre repeats the first
    x[7, 1:], y[7, 1:] = x[7, 0], y[7, 0]
    x[8, :8], y[8, :8] = x[8, 8], y[8, 8]  # zero distances in front
    for seed in (0, 42, -7):
        for restart in range(4):
            cx, cy = mixture.spread_centres(x, y, k, seed, restart)
            for b in range(len(x)):
                picks = plain_spread(x[b].tolist(), y[b].tolist(), k, lambda d: mixture.stream(seed, restart, d))
                assert cx[b].tolist() == [x[b, i] for i in picks] and cy[b].tolist() == [y[b, i] for i in picks]


def test_drawn_numbers_depend_on_their_counters_alone(spark):
    drawn = [mixture.stream(42, r, d) for r in range(40) for d in range(40)]
    assert len(set(drawn)) == 1600 and 0 <= min(drawn) and max(drawn) < 1 and abs(sum(drawn) / 1600 - 0.5) < 0.03
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(42), F.floor(F.col("id") / 40), F.col("id") % 40)), 1, 8), 16, 10).cast("double") / 2**32
    assert [r[0] for r in spark.range(1600).select(u).collect()] == drawn


def test_settings_are_checked():
    for bad in ({"k_max": 4}, {"restarts": 0}, {"max_snps": 1, "sample_snps": 1}, {"init": "x"}):
        with pytest.raises(ValueError):
            CohortConfig(**bad)


# --- gates ---


def test_labels_ascend_in_theta(spark):
    comp = lambda *t: [(1.0 / len(t), v, 0.0, 1.0, 1.0) for v in t]
    rows = [(1, comp(0.33)), (1, comp(0.34)), (1, comp(0.67)), (2, comp(0.9, 0.1)), (3, comp(0.5, 0.9, 0.1))]
    df = spark.createDataFrame(rows, f"k int, comps array<{mixture.COMPONENT}>")
    got = [r[0] for r in df.select(gates.genotypes(F.col("k"), F.col("comps"), 1.0)).collect()]
    assert got == [["BB"], ["AB"], ["AA"], ["AA", "BB"], ["AB", "AA", "BB"]]


def _fit_row(raw, post, x=0.1, thetas=(0.1, 0.5, 0.9), lab=0, v=1.0):
    comps = [(1 / len(thetas), t, 0.0, v, v) for t in thetas]
    return (1, len(thetas), comps, 0.0, 0.0, [0.0], len(thetas), [0], [raw], [x], [0.0], [lab], [post])


@pytest.mark.parametrize(
    ("row", "call"),
    [
        (_fit_row(499, 1.0), "NoCall"),
        (_fit_row(500, 0.85), "BB"),
        (_fit_row(500, 0.8499), "NoCall"),
        (_fit_row(500, 0.9, x=0.339), "BB"),  # within the band
        (_fit_row(500, 0.9, x=0.9, lab=0), "NoCall"),  # the only confident point moves its centre, not the midpoints' order
        (_fit_row(500, 0.97, x=0.9, lab=0), "BB"),  # no guard for strong posteriors
        (_fit_row(500, 0.84, x=0.9, lab=0), "NoCall"),
    ],
)
def test_gates_at_their_limits(spark, row, call):
    df = spark.createDataFrame([row], mixture.FIT)
    got = gates.calls(df, CFG, 0.85, 500).first()
    assert got.call == call


@pytest.mark.parametrize("lab", [3, -1])
def test_a_label_without_component_is_an_error(spark, lab):
    df = spark.createDataFrame([_fit_row(500, 0.9, lab=lab)], mixture.FIT)
    with pytest.raises(Exception, match="out of bounds"):
        gates.calls(df, CFG, 0.85, 500).collect()


def test_gate_counters_add_up(spark):
    from cinderloom.plans.queries import called

    rows = called(spark, "/root/testdata/sf0.001").cache()
    for r in gates.sample_summary(rows, 0.85, 500).collect():
        assert r.total_snps == r.nocall_raw + r.pass_raw and r.pass_raw == r.nocall_p_at_tau + r.calls_at_tau
        assert r.nocall_maha_at_tau <= r.nocall_p_at_tau
    assert all(r.seen == 24 for r in gates.marker_summary(rows).collect())
    bounds = outputs.plot_bounds(outputs.plot_points(rows, CFG)).collect()
    assert bounds and all(b.low_theta < b.high_theta for b in bounds)
    points = outputs.plot_points(rows, CFG).where("snp_id = 1").collect()
    assert outputs.svg(points, [(0.5, 8.0)]).count("<circle") == len(points)
    assert outputs.marker_dump(rows, 1, 0.85, 500).count() == 24


# --- pictures ---


def plain_png(raw):
    """Width, height and rows of pixels, a byte at a time: chunks with right checksums, filters 0 and 2."""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        assert struct.unpack_from(">I", raw, at + 8 + size)[0] == zlib.crc32(kind + body)
        chunks.append((kind, body))
        at += 12 + size
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    assert (depth, colour, rest) == (8, 2, [0, 0, 0])
    data, rows, above = zlib.decompress(chunks[1][1]), [], bytes(3 * width)
    for y in range(height):
        kind, line = data[y * (3 * width + 1)], data[y * (3 * width + 1) + 1 : (y + 1) * (3 * width + 1)]
        above = bytes((a + b) % 256 for a, b in zip(line, above, strict=True)) if kind == 2 else line
        rows.append([tuple(above[i : i + 3]) for i in range(0, 3 * width, 3)])
    return width, height, rows


def test_picture_of_a_marker(spark):
    points = [{"theta": t, "r": r, "call": c} for t, r, c in ((0.0, 4.0, "BB"), (0.5, 4.5, "AB"), (1.0, 5.0, "AA"), (0.9, 4.1, "AA"))]
    centres = [(0.25, 4.5)]
    width, height, rows = plain_png(outputs.png(outputs.raster(points, centres, 140, 100)))
    assert (width, height) == (140, 100)
    bounds = outputs.plot_bounds(spark.createDataFrame([(1, p["theta"], p["r"]) for p in points], "snp_id long, theta double, r double")).first()
    place = lambda t, r: (int((t - bounds.low_theta) / (bounds.high_theta - bounds.low_theta) * 140), int((bounds.high_r - r) / (bounds.high_r - bounds.low_r) * 100))
    for p in points:
        x, y = place(p["theta"], p["r"])
        assert "#%02x%02x%02x" % rows[y][x] == outputs.COLOURS[p["call"]] == "#%02x%02x%02x" % rows[y - outputs.DOT][x]
        assert rows[y - outputs.DOT - 1][x] == (255, 255, 255)
    x, y = place(*centres[0])
    assert all(rows[y][x + d] == (0, 0, 0) == rows[y + d][x] for d in (-outputs.CROSS, 0, outputs.CROSS)) and rows[y + 1][x + 1] == (255, 255, 255)
    assert (outputs.pixels(outputs.png(outputs.raster(points, centres, 140, 100))) == np.array(rows)).all()
    blank = plain_png(outputs.png(outputs.raster([], [], 9, 7)))
    assert blank[:2] == (9, 7) and {p for row in blank[2] for p in row} == {(255, 255, 255)}


def test_files_appear_together(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", bytearray(b"\x00\xff")), ("b.bin", bytearray())], "name string, content binary").repartition(2)
    files.write_files(rows, str(tmp_path / "f"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "f").iterdir()} == {"a.bin": b"\x00\xff", "b.bin": b""}
    with pytest.raises(Exception, match="one name"):
        files.write_files(rows.union(rows), str(tmp_path / "f"))
    assert len(list((tmp_path / "f").iterdir())) == 2


# --- thresholds ---


@given(st.lists(st.floats(0, 1), max_size=40), st.floats(0.001, 0.3))
@settings(max_examples=15, deadline=None)
def test_auto_tau_is_the_longest_good_prefix(spark, posts, alpha):
    e, total, tau = sorted(1 - p for p in posts), 0.0, None
    for i, v in enumerate(e):
        total += v
        if abs(total / (i + 1) - alpha) < 1e-9:
            return
        if total / (i + 1) <= alpha:
            tau = min(max(1 - v, 0.85), 0.9999)
    df = spark.createDataFrame([(p,) for p in posts], "post double")
    assert thresholds.auto_tau(df, alpha).first()[0] == pytest.approx(0.99 if tau is None else tau)


def test_a_cut_among_crowded_errors(spark):
    """All errors in a range of 1e-9, many of them equal: ranges are cut until one task gets few, and the cut is the plain one."""
    rng = np.random.default_rng(8)
    e = np.concatenate([0.3 + rng.random(4000) * 1e-9, np.full(3000, 0.3 + 5e-10), np.zeros(50), np.full(500, 1e-300)])
    for alpha in (0.2, 0.2999999, float(np.sort(e).cumsum()[6000] / 6001)):
        mean = np.sort(e).cumsum() / np.arange(1, len(e) + 1)
        want = min(max(1 - np.sort(e)[mean <= alpha][-1], 0.85), 0.9999)
        errors = spark.createDataFrame([(float(v),) for v in e], "e double").repartition(3).cache()
        inside, n0, s0 = thresholds.cut_range(errors, alpha, 40)
        held = [r.e for r in inside.collect()]
        assert len(held) <= 40 or len(set(held)) == 1
        assert n0 == (e < min(held)).sum() and s0 == pytest.approx(e[e < min(held)].sum())
        posts = errors.select((1 - F.col("e")).alias("post"))
        exact = [1 - (1 - v) for v in sorted(e)]
        assert thresholds.auto_tau(posts, alpha, 40).first()[0] == pytest.approx(want, abs=1e-12) and exact
    assert thresholds.cut_range(spark.createDataFrame([(0.5,)], "e double"), 0.1) is None
    assert thresholds.auto_tau(spark.createDataFrame([], "post double"), 0.1).first()[0] == 0.99


def test_upper_median_takes_the_upper_one(spark):
    df = lambda v: spark.createDataFrame([(x,) for x in v], "t int")
    assert [thresholds.upper_median(df(v), "t").first()[0] for v in ([3, 1, 2, 0], [5], [7, 5, 6])] == [2, 5, 6]


@pytest.mark.parametrize(("t", "want"), [(0.0, 300), (math.log(501), 500), (math.log(501.5), 501), (900.0, 800), (float("nan"), 300)])
def test_floor_is_rounded_and_clamped(t, want):
    if math.isnan(t):
        assert thresholds.floor_of(float("nan")) in (300,)
    else:
        assert thresholds.floor_of(t) == want


def test_exact_crossing_has_equal_densities():
    t = thresholds.crossing(0.3, 5.0, 0.5, 0.7, 8.0, 0.9, "exact")
    density = lambda w, m, s: w * math.exp(-((t - m) ** 2) / (2 * s * s)) / s
    assert density(0.3, 5.0, 0.5) == pytest.approx(density(0.7, 8.0, 0.9))


# --- marker sets, feedback, timing ---


@pytest.mark.parametrize("samples", [range(3), range(200), [5, 70, 4_000, 1_000_000]])
def test_intersection_by_bitmaps(spark, samples):
    cells = [(s, m, 1, 1) for k, s in enumerate(samples) for m in range(6) if (m, k) not in ((3, 1), (5, 0))]
    df = spark.createDataFrame([*cells, *cells[:4]], "sample_idx int, snp_id long, red int, grn int").repartition(5)
    assert sorted(r[0] for r in snps.common_snps(df).collect()) == [0, 1, 2, 4]  # cells twice count once
    with pytest.raises(Exception, match="marker twice"):
        snps.common_snps(df, once=True).collect()
    for known in (None, len(samples)):
        assert sorted(r[0] for r in snps.common_snps(df.distinct(), once=True, samples=known).collect()) == [0, 1, 2, 4]
    with pytest.raises(Exception, match="marker twice"):
        mixture.markers(df, snps.common_snps(df), CFG).collect()
    assert snps.common_snps(df.limit(0), once=True).collect() == []


def test_counters_that_do_not_add_up():
    good = {"total": 5, "pass_raw": 4, "nocall_raw": 1, "nocall_p": 1, "nocall_maha": 1, "calls_tau": 3, "calls_p090": 3}
    gates.check_totals(good)
    for name in ("total", "pass_raw", "nocall_p", "calls_tau"):
        with pytest.raises(ValueError, match="add up"):
            gates.check_totals(good | {name: 9})


def test_totals_are_those_of_the_samples(spark):
    from pyspark.sql import Observation

    from cinderloom.plans.queries import called

    seen = Observation("t")
    rows = called(spark, "/root/testdata/sf0.001")
    rows.observe(seen, *gates.totals()).write.format("noop").mode("overwrite").save()
    names = {"total": "total_snps", "pass_raw": "pass_raw", "nocall_raw": "nocall_raw", "nocall_p": "nocall_p_at_tau", "nocall_maha": "nocall_maha_at_tau", "calls_tau": "calls_at_tau", "calls_p090": "calls_p090"}
    qc = gates.sample_summary(rows, 0.85, 500).agg(*(F.sum(c).alias(n) for n, c in names.items())).first().asDict()
    assert seen.get == qc and qc["total"] > 0
    gates.check_totals(qc)


def test_marker_limits(spark):
    ids = spark.createDataFrame([(i,) for i in range(50)], "snp_id long").repartition(5)
    a = sorted(r[0] for r in snps.sampled_snps(ids, 10, 42).collect())
    assert a == sorted(r[0] for r in snps.sampled_snps(ids.repartition(2), 10, 42).collect()) and len(a) == 10
    assert snps.sampled_snps(ids, 500, 1).count() == 50
    assert a != sorted(r[0] for r in snps.sampled_snps(ids, 10, 43).collect())


def test_bad_is_sticky_and_dropped_markers_keep_their_counters(spark):
    old = spark.createDataFrame([(1, 10, 1, 1, True), (2, 10, 1, 1, False)], state.FEEDBACK)
    summary = spark.createDataFrame([(1, 20, 0, 0, 0), (3, 20, 3, 4, 7)], "snp_id long, seen long, nocall_raw long, nocall_p long, nocall long")
    got = sorted(map(tuple, feedback.updated_feedback(old, summary, 0.35).collect()))
    assert got == [(1, 30, 1, 1, True), (2, 10, 1, 1, False), (3, 20, 3, 4, True)]
    assert feedback.bad_of_run(summary, 0.0).count() == 0
    assert [r[0] for r in feedback.bad_of_run(summary, 0.35).collect()] == [3]


def _summaries(spark, place, *cohorts):
    """A file for each cohort: (cohort, rows of snp_id, seen, nocall_raw, nocall_p, nocall)."""
    for name, rows in cohorts:
        spark.createDataFrame([(name, *r) for r in rows], stream.SUMMARY).coalesce(1).write.mode("append").parquet(place)


def test_a_cohort_counts_once_over_restarts(spark, tmp_path):
    place, kept = str(tmp_path / "in"), str(tmp_path / "state")
    a, b, c = ("a", [(1, 20, 1, 2, 3), (2, 20, 9, 9, 18)]), ("b", [(1, 20, 0, 1, 1), (2, 20, 0, 0, 0)]), ("c", [(1, 10, 0, 0, 0), (3, 10, 0, 0, 0)])
    _summaries(spark, place, a, b, a)  # a comes again at once
    now = lambda: sorted(map(tuple, stream.counted_files(spark, place, 0.35, kept, 1).collect()))
    assert now() == [(1, 2, 40, 1, 3, False), (2, 2, 40, 9, 9, True)]
    assert now() == [(1, 2, 40, 1, 3, False), (2, 2, 40, 9, 9, True)]  # the stream starts again and finds nothing new
    _summaries(spark, place, b, c, (None, [(1, 5, 5, 5, 5)]))  # b once more, and rows of no cohort
    assert now() == [(1, 3, 50, 1, 3, False), (2, 2, 40, 9, 9, True), (3, 1, 10, 0, 0, False)]


def test_a_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], stream.SUMMARY).write.parquet(str(tmp_path / "in"))
    assert stream.counted_files(spark, str(tmp_path / "in"), 0.35, str(tmp_path / "state")).collect() == []


def test_timer(spark):
    t = Timer()
    for _ in range(2):
        with t.span("a"):
            pass
    row = timing_summary(t.frame(spark)).first()
    assert row["label"] == "a" and row["count"] == 2 and row.avg_ms == pytest.approx(row.total_ms / 2)
