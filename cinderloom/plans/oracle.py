"""SQL for the registered queries, written apart from the DataFrame code: plain relations, one row per point."""

from __future__ import annotations

from .queries import CFG, LIMIT, ROUNDS, SAMPLES, STREAM_BAD

PROBES = """
m AS (SELECT CAST(count(*) // 8 AS BIGINT) AS m FROM part),
cells AS (
  SELECT l_partkey % m.m + 1 AS snp_id, l_orderkey % 24 AS sample_idx,
         CAST(max(l_quantity) AS BIGINT) AS q1, CAST(min(l_quantity) AS BIGINT) AS q0, count(*) AS n
  FROM lineitem, m GROUP BY l_partkey % m.m + 1, l_orderkey % 24),
kinds AS (
  SELECT *, (snp_id * 7 + sample_idx * 5 + n) % 3 AS g, (snp_id + sample_idx * 3) % 37 = 0 AS low
  FROM cells WHERE NOT (sample_idx = 5 AND snp_id % 11 = 0)),
probes AS (
  SELECT snp_id, CAST(sample_idx AS INTEGER) AS sample_idx,
    CAST(CASE WHEN low THEN 100 + q0 WHEN g = 0 THEN 9000 + q1*20 - q0*10 WHEN g = 1 THEN 5000 + q1*20 - q0*10 ELSE 700 + q1*20 - q0*10 END AS INTEGER) AS red,
    CAST(CASE WHEN low THEN 90 + q1 WHEN g = 0 THEN 700 + q0*20 - q1*5 WHEN g = 1 THEN 5000 + q0*20 - q1*5 ELSE 9000 + q0*20 - q1*5 END AS INTEGER) AS grn
  FROM kinds),
common AS (SELECT snp_id FROM probes GROUP BY snp_id HAVING count(DISTINCT sample_idx) = (SELECT count(DISTINCT sample_idx) FROM probes)),
pts AS (
  SELECT snp_id, sample_idx, CAST(red + grn AS BIGINT) AS raw, atan2(grn, red) * 2 / pi() AS x, ln(red + grn + 1) * 0.45 AS y
  FROM probes JOIN common USING (snp_id))"""

SIZE = "(SELECT count(DISTINCT sample_idx) FROM pts)"


def density(p: str, c: str) -> str:
    vx, vy = f"greatest({c}.vx, 1e-8)", f"greatest({c}.vy, 1e-8)"
    return f"(-0.5 * (({p}.x - {c}.mx) * ({p}.x - {c}.mx) / {vx} + ({p}.y - {c}.my) * ({p}.y - {c}.my) / {vy}) - 0.5 * ln({vx} * {vy}) - ln(pi()))"


ONE = f"""
mean1 AS (SELECT snp_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, greatest(var_pop(x), 0.01) AS vx, greatest(var_pop(y), 0.01) AS vy FROM pts GROUP BY snp_id),
fit1 AS (SELECT c.snp_id, n, 0 AS comp, 1.0::DOUBLE AS w, mx, my, vx, vy, sum({density("p", "c")}) AS loglik FROM mean1 c JOIN pts p USING (snp_id) GROUP BY ALL)"""


def em(k: int, rounds: int, tol: float) -> str:
    """Rounds of EM from the quantile start, for all markers at once."""
    return f"""
start{k} AS (
  SELECT o.snp_id, t - 1 AS comp, o.x, o.y, m.vx, m.vy
  FROM (SELECT *, row_number() OVER (PARTITION BY snp_id ORDER BY x, sample_idx) - 1 AS place, count(*) OVER (PARTITION BY snp_id) AS s FROM pts) o
  JOIN mean1 m USING (snp_id), range(1, {k + 1}) AS q(t)
  WHERE place = least(CAST(floor(CAST(t AS DOUBLE) / {k + 1} * s) AS BIGINT), s - 1)),{rounds_of(k, rounds, tol, f"start{k}", "pts", f"em{k}")},
fit{k} AS (SELECT * FROM em{k} QUALIFY step = max(step) OVER (PARTITION BY snp_id))"""


def rounds_of(k: int, rounds: int, tol: float, start: str, points: str, name: str) -> str:
    """Recursive rounds of EM over ``points`` from the centres in ``start``; ``snp_id`` names what is fitted."""
    square = lambda v: f"sum(r * {v} * {v}) / greatest(sum(r), 1e-8) - power(sum(r * {v}) / greatest(sum(r), 1e-8), 2)"
    return f"""
{name}(snp_id, step, comp, w, mx, my, vx, vy, loglik, done) AS (
  SELECT snp_id, 0, comp, CAST(1 AS DOUBLE) / {k}, x, y, vx, vy, CAST('-inf' AS DOUBLE), false FROM {start}
  UNION ALL
  SELECT snp_id, step + 1, comp, wc / sum(wc) OVER (PARTITION BY snp_id), nx, ny, nvx, nvy, new,
    abs(new - loglik) <= {tol} OR sum(sqrt((nx - mx) * (nx - mx) + (ny - my) * (ny - my))) OVER (PARTITION BY snp_id) / {k} < {tol}
  FROM (
    SELECT snp_id, step, comp, any_value(loglik) AS loglik, any_value(mx) AS mx, any_value(my) AS my, sum(l) AS new,
      least(greatest(sum(r) / count(*), 1e-12), 1) AS wc,
      sum(r * x) / greatest(sum(r), 1e-8) AS nx, sum(r * y) / greatest(sum(r), 1e-8) AS ny,
      greatest({square("x")}, 5e-6) AS nvx, greatest({square("y")}, 5e-6) AS nvy
    FROM (
      SELECT *, exp(lp - l) AS r FROM (
        SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY snp_id, sample_idx)) AS l FROM (
          SELECT *, max(lp) OVER (PARTITION BY snp_id, sample_idx) AS top FROM (
            SELECT c.*, p.sample_idx, p.x, p.y, ln(greatest(c.w, 1e-12)) + {density("p", "c")} AS lp
            FROM {name} c JOIN {points} p USING (snp_id) WHERE NOT c.done AND c.step < {rounds}))))
    GROUP BY snp_id, step, comp))"""


def spread(seed: int, restarts: int) -> str:
    """Centres by k-means++ for each marker and restart: c1, c2, c3, each after the ones before it."""
    at = lambda n: f"(x - x{n}) * (x - x{n}) + (y - y{n}) * (y - y{n})"

    def step(n: int) -> str:
        near = at(1) if n == 2 else f"least({', '.join(at(j) for j in range(1, n))})"
        known = ", ".join(f"i{j}, x{j}, y{j}" for j in range(1, n))
        return f"""
far{n} AS (
  SELECT *, sum(d) OVER (PARTITION BY snp_id, r ORDER BY i) AS reached, sum(d) OVER (PARTITION BY snp_id, r) AS total
  FROM (SELECT o.i, o.x, o.y, c.*, {near} AS d FROM numbered o JOIN c{n - 1} c USING (snp_id))),
c{n} AS (
  SELECT p.snp_id, p.r, {known}, o.i AS i{n}, o.x AS x{n}, o.y AS y{n}
  FROM (
    SELECT snp_id, r, {known}, CASE WHEN any_value(total) > 0 THEN coalesce(min(i) FILTER (reached >= u * total), 0) ELSE i1 END AS pick
    FROM far{n} JOIN drawn USING (r) WHERE draw = {n - 1} GROUP BY snp_id, r, {known}) p
  JOIN numbered o ON o.snp_id = p.snp_id AND o.i = p.pick)"""

    return f"""
drawn AS (
  SELECT r, draw, CAST('0x' || md5('{seed}:' || r || ':' || draw)[1:8] AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM range({restarts}) AS a(r), range(3) AS b(draw)),
numbered AS (SELECT snp_id, x, y, row_number() OVER (PARTITION BY snp_id ORDER BY sample_idx) - 1 AS i, count(*) OVER (PARTITION BY snp_id) AS n FROM pts),
c1 AS (SELECT snp_id, r, i AS i1, x AS x1, y AS y1 FROM numbered, drawn WHERE draw = 0 AND i = least(CAST(floor(u * n) AS BIGINT), n - 1)),{step(2)},{step(3)},
again AS (SELECT snp_id * {restarts} + r AS snp_id, sample_idx, x, y FROM pts, range({restarts}) AS a(r))"""


def restarted(k: int, rounds: int, tol: float, restarts: int) -> str:
    """The best of all restarts, ties to the earlier one, as ``fit{k}``."""
    starts = " UNION ALL ".join(f"SELECT c.snp_id * {restarts} + c.r, {j - 1}, x{j}, y{j}, m.vx, m.vy FROM c{k} c JOIN mean1 m USING (snp_id)" for j in range(1, k + 1))
    return f"""
begin{k}(snp_id, comp, x, y, vx, vy) AS ({starts}),{rounds_of(k, rounds, tol, f"begin{k}", "again", f"run{k}")},
ended{k} AS (SELECT snp_id // {restarts} AS snp_id, snp_id % {restarts} AS r, * EXCLUDE (snp_id) FROM run{k} QUALIFY step = max(step) OVER (PARTITION BY run{k}.snp_id)),
best{k} AS (SELECT snp_id, r FROM (SELECT DISTINCT snp_id, r, loglik FROM ended{k}) QUALIFY row_number() OVER (PARTITION BY snp_id ORDER BY loglik DESC, r) = 1),
fit{k} AS (SELECT e.* FROM ended{k} e JOIN best{k} b ON b.snp_id = e.snp_id AND b.r = e.r)"""


MODELS = f"""
least2 AS (SELECT snp_id, min(w) AS w, max(mx) - min(mx) AS gap, any_value(loglik) AS loglik FROM fit2 GROUP BY snp_id),
least3 AS (
  SELECT snp_id, min(w) AS w, min(gap) AS gap, any_value(loglik) AS loglik
  FROM (SELECT *, mx - lag(mx) OVER (PARTITION BY snp_id ORDER BY mx) AS gap FROM fit3) GROUP BY snp_id),
bics AS (
  SELECT f.snp_id, -2 * f.loglik + 4 * ln(f.n) AS b1, -2 * a.loglik + 9 * ln(f.n) AS b2, -2 * b.loglik + 14 * ln(f.n) AS b3,
    a.w AS w2, a.gap AS gap2, b.w AS w3, b.gap AS gap3
  FROM fit1 f JOIN least2 a USING (snp_id) JOIN least3 b USING (snp_id)),
best AS (SELECT *, CASE WHEN b1 <= b2 AND b1 <= b3 THEN 1 WHEN b2 <= b3 THEN 2 ELSE 3 END AS k_bic FROM bics),
heavy AS (SELECT *, CASE WHEN k_bic = 3 AND w3 < 0.03 THEN 2 WHEN k_bic = 2 AND w2 < 0.03 THEN 1 ELSE k_bic END AS ka FROM best),
wide AS (SELECT *, CASE WHEN ka = 3 AND gap3 < 0.035 THEN 2 ELSE ka END AS kb FROM heavy),
sizes AS (SELECT snp_id, k_bic, CASE WHEN kb = 2 AND gap2 < 0.020 THEN 1 ELSE kb END AS k FROM wide),
comps AS (
  SELECT s.k, f.* FROM sizes s JOIN (
    SELECT 1 AS size, snp_id, comp, w, mx, my, vx, vy FROM fit1
    UNION ALL SELECT 2, snp_id, comp, w, mx, my, vx, vy FROM fit2
    UNION ALL SELECT 3, snp_id, comp, w, mx, my, vx, vy FROM fit3) f ON f.snp_id = s.snp_id AND f.size = s.k),
labels AS (
  SELECT *, CASE WHEN k = 1 THEN CASE WHEN mx <= 0.33 THEN 'BB' WHEN mx >= 0.67 THEN 'AA' ELSE 'AB' END
                 WHEN place = 1 THEN 'BB' WHEN place = k THEN 'AA' ELSE 'AB' END AS geno
  FROM (SELECT *, row_number() OVER (PARTITION BY snp_id ORDER BY mx, comp) AS place FROM comps)),
joint AS (SELECT p.*, c.k, c.comp, ln(greatest(c.w, 1e-12)) + {density("p", "c")} AS lp FROM pts p JOIN comps c USING (snp_id)),
post AS (
  SELECT snp_id, sample_idx, raw, x, y, k, comp AS lab, exp(lp - top - ln(rest)) AS post FROM (
    SELECT *, sum(exp(lp - top)) OVER (PARTITION BY snp_id, sample_idx) AS rest,
      row_number() OVER (PARTITION BY snp_id, sample_idx ORDER BY lp DESC, comp) AS place
    FROM (SELECT *, max(lp) OVER (PARTITION BY snp_id, sample_idx) AS top FROM joint)) WHERE place = 1)"""

GATES = f"""
moved AS (SELECT snp_id, lab, sum(post) AS w, sum(post * x) AS sx, sum(post * y) AS sy FROM post WHERE post >= {CFG.p_min} GROUP BY snp_id, lab),
centres AS (
  SELECT l.snp_id, l.k, l.comp, l.geno, l.vx, l.vy, CASE WHEN w2 > 1e-6 THEN sx / w2 ELSE l.mx END AS mx, CASE WHEN w2 > 1e-6 THEN sy / w2 ELSE l.my END AS my
  FROM labels l LEFT JOIN (SELECT snp_id, lab, w AS w2, sx, sy FROM moved) d ON d.snp_id = l.snp_id AND d.lab = l.comp),
mids AS (SELECT snp_id, list_sort(list(mx)) AS t FROM centres GROUP BY snp_id),
far AS (
  SELECT p.*, c.geno, power(p.x - c.mx, 2) / greatest(c.vx, 1e-8) + power(p.y - c.my, 2) / greatest(c.vy, 1e-8) AS maha2, t
  FROM post p JOIN centres c ON c.snp_id = p.snp_id AND c.comp = p.lab JOIN mids m ON m.snp_id = p.snp_id),
tests AS (
  SELECT *, raw >= {CFG.r_min} AS pass_raw, post >= {CFG.p_min} AND sqrt(maha2) > {CFG.max_maha} AS maha_gated,
    CASE WHEN k = 1 THEN true
      WHEN geno = 'BB' THEN x <= (t[1] + t[2]) / 2 + 0.04
      WHEN geno = 'AA' THEN x >= (t[k - 1] + t[k]) / 2 - 0.04
      ELSE x BETWEEN (t[1] + t[2]) / 2 - 0.04 AND (t[2] + t[3]) / 2 + 0.04 END AS guard_ok
  FROM far),
calls AS (
  SELECT *, CASE WHEN NOT pass_raw OR maha_gated OR post < {CFG.p_min} THEN 'NoCall' WHEN post >= 0.97 OR guard_ok THEN geno ELSE 'NoCall' END AS call FROM tests)"""

SUMMARY = """
marks AS (
  SELECT snp_id, count(*) AS seen, count(*) FILTER (NOT pass_raw) AS nocall_raw, count(*) FILTER (pass_raw AND call = 'NoCall') AS nocall_p,
    count(*) FILTER (call = 'NoCall') AS nocall FROM calls GROUP BY snp_id)"""

FLOORS = """
vals AS (SELECT sample_idx, ln(red + grn + 1) AS t FROM probes),
ends AS (
  SELECT sample_idx, count(*) AS n, greatest(stddev_pop(t), 1e-3) AS sd,
    list_sort(list(t))[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] AS a, list_sort(list(t))[CAST(floor(count(*) * 0.75) AS BIGINT) + 1] AS b FROM vals GROUP BY sample_idx),
two(sample_idx, step, n, w, m0, m1, s0, s1, loglik, done) AS (
  SELECT sample_idx, 0, n, CAST(0.5 AS DOUBLE), a, b, sd, sd, CAST('-inf' AS DOUBLE), false FROM ends
  UNION ALL
  SELECT sample_idx, step + 1, n, w2, q0, q1, sqrt(greatest(v0, 1e-6)), sqrt(greatest(v1, 1e-6)), new, abs(new - loglik) < 1e-6 FROM (
    SELECT sample_idx, step, n, any_value(loglik) AS loglik, sum(ln(den)) AS new, least(greatest(sum(r) / n, 1e-6), 1 - 1e-6) AS w2,
      sum(r * t) / greatest(sum(r), 1e-12) AS q0, sum((1 - r) * t) / greatest(sum(1 - r), 1e-12) AS q1,
      sum(r * t * t) / greatest(sum(r), 1e-12) - power(sum(r * t) / greatest(sum(r), 1e-12), 2) AS v0,
      sum((1 - r) * t * t) / greatest(sum(1 - r), 1e-12) - power(sum((1 - r) * t) / greatest(sum(1 - r), 1e-12), 2) AS v1
    FROM (SELECT *, d0 / den AS r FROM (SELECT *, greatest(d0 + d1, 1e-300) AS den FROM (
      SELECT c.*, t, exp(-(t - m0) * (t - m0) / (2 * s0 * s0) - ln(s0)) * w AS d0, exp(-(t - m1) * (t - m1) / (2 * s1 * s1) - ln(s1)) * (1 - w) AS d1
      FROM two c JOIN vals USING (sample_idx) WHERE NOT done AND step < 50)))
    GROUP BY sample_idx, step, n)),
last AS (SELECT * FROM two QUALIFY step = max(step) OVER (PARTITION BY sample_idx)),
ordered AS (
  SELECT sample_idx, CASE WHEN m0 <= m1 THEN w ELSE 1 - w END AS w0, CASE WHEN m0 <= m1 THEN 1 - w ELSE w END AS w1,
    least(m0, m1) AS m0, greatest(m0, m1) AS m1, CASE WHEN m0 <= m1 THEN s0 ELSE s1 END AS s0, CASE WHEN m0 <= m1 THEN s1 ELSE s0 END AS s1 FROM last),
quad AS (
  SELECT *, 0.5 * (1 / (s1 * s1) - 1 / (s0 * s0)) AS a, 2 * (m0 / (s0 * s0) - m1 / (s1 * s1)) AS b,
    0.5 * (m1 * m1 / (s1 * s1) - m0 * m0 / (s0 * s0)) + ln(w1 * s0 / (w0 * s1)) AS c FROM ordered),
roots AS (
  SELECT *, CASE WHEN abs(a) >= 1e-12 AND b * b - 4 * a * c >= 0 THEN sqrt(b * b - 4 * a * c) END AS d FROM quad),
cross_at AS (
  SELECT sample_idx, CASE WHEN abs(a) < 1e-12 THEN CASE WHEN abs(b) >= 1e-12 THEN -c / b ELSE (m0 + m1) / 2 END
    WHEN d IS NULL THEN (m0 + m1) / 2
    WHEN (-b - d) / (2 * a) BETWEEN m0 AND m1 THEN (-b - d) / (2 * a) ELSE (-b + d) / (2 * a) END AS t FROM roots),
floors AS (SELECT sample_idx, CAST(least(greatest(floor(greatest(exp(least(t, 700)) - 1, 0) + 0.5), 300), 800) AS INTEGER) AS r_min FROM cross_at)"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


_FITS = (PROBES, ONE, em(2, CFG.max_iters, CFG.tol), em(3, CFG.max_iters, CFG.tol), MODELS)
_CALLS = (*_FITS, GATES)
_SPREAD = (PROBES, ONE, spread(CFG.seed, CFG.restarts), *(restarted(k, CFG.max_iters, CFG.tol, CFG.restarts) for k in (2, 3)), MODELS)
_OLD = "SELECT p_partkey AS snp_id, CAST(p_size AS BIGINT) AS seen, CAST(p_size % 3 AS BIGINT) AS nocall_raw, CAST(p_size % 5 AS BIGINT) AS nocall_p, p_size % 10 = 0 AS bad FROM part"
_WIDE = ", ".join(f"max(CASE WHEN sample_idx = {s} THEN call END) AS s{s}" for s in range(SAMPLES))


def _fixed(k: int) -> str:
    return _with(PROBES, ONE, em(k, ROUNDS, -1.0), select=f"SELECT snp_id, CAST(comp AS INTEGER) AS comp, round(w, 4) AS w, round(mx, 4) AS mx, round(my, 4) AS my, round(vx, 4) AS vx, round(vy, 4) AS vy, round(loglik, 4) AS loglik FROM fit{k}")


ORACLE_SQL: dict[str, str] = {
    "probe_cells": _with(PROBES, select="SELECT * FROM probes"),
    "idat_decode": _with(PROBES, select="SELECT sample_idx, snp_id, red, grn FROM probes"),
    "idat_source": _with(PROBES, select="SELECT sample_idx, snp_id, red, grn FROM probes"),
    "channel_zip": _with(PROBES, select="""
SELECT sample_idx, snp_id, red, grn FROM (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY sample_idx, snp_id // 100000) AS n
  FROM probes WINDOW w AS (PARTITION BY sample_idx, snp_id // 100000 ORDER BY snp_id))
WHERE place <= n - sample_idx % 2 AND place <= n - sample_idx % 3"""),
    "state_round_trip": """
SELECT p_partkey AS snp_id, CAST(p_size AS BIGINT) AS seen, CAST(p_size % 3 AS BIGINT) AS nocall_raw, CAST(p_size % 5 AS BIGINT) AS nocall_p,
  p_size % 10 = 0 AS bad, p_size % 10 = 0 AS listed
FROM part WHERE p_partkey <> 0""",
    "plot_bounds": _with(*_CALLS, select=f"""
SELECT snp_id, round(min(t) - 0.06 * greatest(max(t) - min(t), 1), 5) AS low_theta, round(max(t) + 0.06 * greatest(max(t) - min(t), 1), 5) AS high_theta,
  round(min(r) - 0.06 * greatest(max(r) - min(r), 1), 5) AS low_r, round(max(r) + 0.06 * greatest(max(r) - min(r), 1), 5) AS high_r
FROM (SELECT snp_id, x AS t, y / 0.45 AS r FROM calls WHERE call <> 'NoCall' AND snp_id IN (SELECT DISTINCT snp_id FROM calls ORDER BY snp_id LIMIT {CFG.plot_first_snps}))
GROUP BY snp_id"""),
    "plot_png": _with(*_CALLS, select=f"""
SELECT snp_id, sample_idx, CAST(floor((x - lx) / (hx - lx) * 1400) AS INTEGER) AS px, CAST(floor((hy - y) / (hy - ly) * 1000) AS INTEGER) AS py, true AS inked
FROM (
  SELECT snp_id, sample_idx, x, y, min(x) OVER w - 0.06 * greatest(max(x) OVER w - min(x) OVER w, 1) AS lx, max(x) OVER w + 0.06 * greatest(max(x) OVER w - min(x) OVER w, 1) AS hx,
    min(y) OVER w - 0.06 * greatest(max(y) OVER w - min(y) OVER w, 1) AS ly, max(y) OVER w + 0.06 * greatest(max(y) OVER w - min(y) OVER w, 1) AS hy
  FROM (SELECT snp_id, sample_idx, x, y / 0.45 AS y FROM calls WHERE call <> 'NoCall' AND snp_id IN (SELECT DISTINCT snp_id FROM calls ORDER BY snp_id LIMIT {CFG.plot_first_snps}))
  WINDOW w AS (PARTITION BY snp_id))"""),
    "common_snps": _with(PROBES, select="SELECT snp_id FROM common"),
    "theta_r": _with(PROBES, select="SELECT snp_id, sample_idx, round(2 * atan2(grn, red) / pi(), 6) AS theta, round(0.45 * ln(red + grn + 1), 6) AS r FROM probes"),
    "raw_gate": _with(PROBES, select=f"SELECT snp_id, sample_idx, CAST(red + grn AS BIGINT) AS raw, red + grn >= {CFG.r_min} AS pass_raw FROM probes"),
    "log_intensity_stats": _with(PROBES, select="SELECT sample_idx, count(*) AS n, round(avg(ln(red + grn + 1)), 6) AS mean_z, round(var_pop(ln(red + grn + 1)), 6) AS var_z FROM probes GROUP BY sample_idx"),
    "first_snps": _with(PROBES, select=f"SELECT snp_id FROM common ORDER BY snp_id LIMIT {LIMIT}"),
    "sampled_snps": _with(PROBES, select=f"SELECT snp_id FROM common ORDER BY (snp_id * 1103515245 + {CFG.seed * 1013904223}) % 2147483648, snp_id LIMIT {LIMIT}"),
    "bad_snp_antijoin": _with(PROBES, select="SELECT snp_id FROM common WHERE snp_id NOT IN (SELECT p_partkey FROM part WHERE p_size % 7 = 0)"),
    "channel_pairs": """
WITH f AS (
  SELECT '/data/' || c_nationkey || '/C' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '_Grn.idat' WHEN 1 THEN '_Green.idat.gz' WHEN 2 THEN '_Grn.idat.gz' ELSE '.txt' END AS path FROM customer
  UNION ALL
  SELECT '/data/' || c_nationkey || '/C' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '_Red.idat' WHEN 1 THEN '_Red.idat.gz' ELSE '_red.idat' END FROM customer),
c AS (SELECT path, regexp_extract(path, '([^/]*)_(Grn|Green|Red)\\.idat(\\.gz)?$', 1) AS base, regexp_matches(path, '_Red\\.idat(\\.gz)?$') AS red FROM f WHERE regexp_matches(path, '_(Grn|Green|Red)\\.idat(\\.gz)?$'))
SELECT g.base, regexp_replace(regexp_replace(regexp_extract(g.path, '[^/]*$'), '\\.[^.]*$', ''), '_Grn$', '') AS sample, g.path AS green_path, r.path AS red_path
FROM c g JOIN c r ON g.base = r.base AND NOT g.red AND r.red""",
    "k1_fit": _with(PROBES, ONE, select="SELECT snp_id, n, round(mx, 4) AS mx, round(my, 4) AS my, round(vx, 4) AS vx, round(vy, 4) AS vy, round(loglik, 4) AS loglik, round(-2 * loglik + 4 * ln(n), 4) AS bic FROM fit1"),
    "em_k2": _fixed(2),
    "em_k3": _fixed(3),
    "kpp_centres": _with(PROBES, spread(CFG.seed, CFG.restarts), select=" UNION ALL ".join(f"SELECT snp_id, CAST(r AS INTEGER) AS restart, {j - 1} AS comp, round(x{j}, 6) AS x, round(y{j}, 6) AS y FROM c3" for j in (1, 2, 3))),
    "kpp_fits": _with(*_SPREAD, select="""
SELECT s.snp_id, k, round(CASE k WHEN 1 THEN f.loglik WHEN 2 THEN a.loglik ELSE b.loglik END, 4) AS loglik, round(CASE k WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END, 4) AS bic
FROM sizes s JOIN bics USING (snp_id) JOIN fit1 f USING (snp_id) JOIN least2 a USING (snp_id) JOIN least3 b USING (snp_id)"""),
    "bic_choose_k": _with(*_FITS, select="SELECT snp_id, k_bic AS k, round(b1, 3) AS bic1, round(b2, 3) AS bic2, round(b3, 3) AS bic3 FROM best"),
    "collapse_k": _with(*_FITS, select="SELECT snp_id, k_bic, k FROM sizes"),
    "posteriors": _with(*_FITS, select="SELECT snp_id, k, sample_idx, CAST(lab AS INTEGER) AS lab, round(post, 4) AS post FROM post"),
    "genotype_labels": _with(*_FITS, select="SELECT snp_id, CAST(comp AS INTEGER) AS comp, round(mx, 4) AS mx, geno FROM labels"),
    "refined_centres": _with(*_CALLS, select="SELECT snp_id, CAST(comp AS INTEGER) AS comp, round(mx, 4) AS mx, round(my, 4) AS my FROM centres"),
    "maha_gate": _with(*_CALLS, select="SELECT snp_id, count(*) FILTER (maha_gated) AS n_gated, round(max(maha2), 2) AS max_maha2 FROM calls GROUP BY snp_id"),
    "theta_guard": _with(*_CALLS, select="SELECT snp_id, geno, count(*) FILTER (guard_ok) AS n_ok, count(*) FILTER (NOT guard_ok) AS n_off FROM calls GROUP BY snp_id, geno"),
    "calls": _with(*_CALLS, select="SELECT snp_id, sample_idx, raw, k, CAST(lab AS INTEGER) AS lab, pass_raw, maha_gated, call FROM calls"),
    "calls_wide": _with(*_CALLS, select=f"SELECT snp_id, {_WIDE} FROM calls GROUP BY snp_id"),
    "calls_matrix": _with(*_CALLS, select=f"SELECT snp_id, {_WIDE} FROM calls GROUP BY snp_id"),
    "qc_summary": _with(*_CALLS, select=f"""
SELECT sample_idx, count(*) AS total_snps, count(*) FILTER (pass_raw) AS pass_raw, count(*) FILTER (NOT pass_raw) AS nocall_raw,
  count(*) FILTER (pass_raw AND call = 'NoCall') AS nocall_p_at_tau, count(*) FILTER (pass_raw AND maha_gated) AS nocall_maha_at_tau,
  count(*) FILTER (call <> 'NoCall') AS calls_at_tau, count(*) FILTER (pass_raw AND post >= 0.9) AS calls_p090,
  round(count(*) FILTER (call <> 'NoCall') / count(*), 6) AS call_rate_tau, round(count(*) FILTER (pass_raw AND post >= 0.9) / count(*), 6) AS call_rate_p090,
  {CFG.r_min} AS r_min_used, CAST({CFG.p_min} AS DOUBLE) AS tau_used
FROM calls GROUP BY sample_idx"""),
    "auto_tau": _with(*_FITS, select=f"""
SELECT round(CASE WHEN count(*) FILTER (mean <= {CFG.alpha}) > 0 THEN least(greatest(1 - max(e) FILTER (mean <= {CFG.alpha}), 0.85), 0.9999) ELSE 0.99 END, 4) AS tau FROM (
  SELECT e, avg(e) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS mean FROM (
    SELECT greatest(least(1 - post, 1), 0) AS e FROM post WHERE raw >= {CFG.r_min} AND snp_id IN (SELECT snp_id FROM common ORDER BY snp_id LIMIT 10000)))"""),
    "rmin_per_sample": _with(PROBES, FLOORS, select="SELECT sample_idx, r_min FROM floors"),
    "rmin_upper_median": _with(PROBES, FLOORS, select="SELECT list_sort(list(r_min))[count(*) // 2 + 1] AS r_min FROM floors"),
    "feedback_update": _with(*_CALLS, SUMMARY, select=f"""
SELECT snp_id, coalesce(o.seen, 0) + coalesce(n.seen, 0) AS seen, coalesce(o.nocall_raw, 0) + coalesce(n.nocall_raw, 0) AS nocall_raw,
  coalesce(o.nocall_p, 0) + coalesce(n.nocall_p, 0) AS nocall_p, coalesce(o.bad, false) OR coalesce(n.nocall / n.seen >= {CFG.nocall_bad_thresh}, false) AS bad
FROM ({_OLD}) o FULL JOIN marks n USING (snp_id)"""),
    "feedback_stream": f"""
SELECT snp_id, count(*) AS cohorts, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(nocall_raw) AS BIGINT) AS nocall_raw, CAST(sum(nocall_p) AS BIGINT) AS nocall_p,
  bool_or((nocall_raw + nocall_p) / seen >= {STREAM_BAD}) AS bad
FROM (
  SELECT user_id AS snp_id, event_type, count(*) AS seen, count(*) FILTER (value < 20) AS nocall_raw, count(*) FILTER (value > 80) AS nocall_p
  FROM events GROUP BY user_id, event_type)
GROUP BY snp_id""",
    "bad_snps_learned": _with(*_CALLS, SUMMARY, select=f"SELECT snp_id FROM ({_OLD}) WHERE bad UNION SELECT snp_id FROM marks WHERE nocall / seen >= 0.1"),
    "plot_points": _with(*_CALLS, select=f"""
SELECT snp_id, sample_idx, round(x, 6) AS theta, round(y / 0.45, 6) AS r, call, count(*) OVER (PARTITION BY snp_id) AS n_called
FROM calls WHERE call <> 'NoCall' AND snp_id IN (SELECT DISTINCT snp_id FROM calls ORDER BY snp_id LIMIT {CFG.plot_first_snps})"""),
    "timing_summary": "SELECT event_type AS label, round(sum(value), 3) AS total_ms, count(*) AS count, round(avg(value), 4) AS avg_ms FROM events GROUP BY event_type",
}
