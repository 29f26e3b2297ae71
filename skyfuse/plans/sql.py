"""DuckDB SQL for the queries, from shared parts."""

from __future__ import annotations


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


POINTS = """points AS (
  SELECT (l_linenumber % 2)::INT AS sat, (l_suppkey % 5)::INT AS t,
    round(35.0::DOUBLE + ((l_partkey * 37 + l_linenumber * 11) % 239 + 1) / 100.0::DOUBLE, 2) AS lat,
    round(-124.0::DOUBLE + ((l_orderkey * 53 + l_suppkey * 7) % 239 + 1) / 100.0::DOUBLE, 2) AS lon,
    l_discount * 10 AS aod
  FROM lineitem
), clean AS (
  SELECT sat, t, lat, lon, greatest(aod, 0.0::DOUBLE) AS aod FROM points
  WHERE aod IS NOT NULL AND lat > 35.0::DOUBLE AND lat < 37.4::DOUBLE AND lon > -124.0::DOUBLE AND lon < -121.6::DOUBLE
)"""


def axes(n: int, res: str) -> str:
    return f"""side AS (SELECT range::INT AS i FROM range({n})
), lat_axis AS (
  SELECT i, (i + 0.5::DOUBLE) * {res}::DOUBLE + 35.0::DOUBLE - 0.5::DOUBLE * {res}::DOUBLE AS lo, (i + 0.5::DOUBLE) * {res}::DOUBLE + 35.0::DOUBLE + 0.5::DOUBLE * {res}::DOUBLE AS hi FROM side
), lon_axis AS (
  SELECT i, (i + 0.5::DOUBLE) * {res}::DOUBLE + -124.0::DOUBLE - 0.5::DOUBLE * {res}::DOUBLE AS lo, (i + 0.5::DOUBLE) * {res}::DOUBLE + -124.0::DOUBLE + 0.5::DOUBLE * {res}::DOUBLE AS hi FROM side
)"""


def grid(keys: str = "t", n: int = 60, res: str = "0.04") -> str:
    """CTEs up to grid: cells with points; and images: all cells."""
    on = " AND ".join(f"g.{k} = k.{k}" for k in keys.split(", "))
    own = ", ".join(f"k.{k}" for k in keys.split(", "))
    return f"""{POINTS}, {axes(n, res)}, grid AS (
  SELECT {keys}, a.i AS lat_i, o.i AS lon_i, count(*) AS n, avg(aod) AS aod
  FROM clean JOIN lat_axis a ON lat >= a.lo AND lat <= a.hi JOIN lon_axis o ON lon >= o.lo AND lon <= o.hi GROUP BY ALL
), images AS (
  SELECT {own}, a.i AS lat_i, o.i AS lon_i, round(g.aod, 6) AS aod
  FROM (SELECT DISTINCT {keys} FROM grid) k CROSS JOIN side a CROSS JOIN side o LEFT JOIN grid g ON {on} AND g.lat_i = a.i AND g.lon_i = o.i
)"""


GRID = grid()
BOTH = grid("sat, t")
SMALL = grid("t", 12, "0.2")
SMALL_BOTH = grid("sat, t", 12, "0.2")

NEAR = f"""{GRID}, same AS (
  SELECT a.t, a.lon_i AS r, b.lon_i AS s, (60 - count(*))::INT AS d FROM images a JOIN images b ON a.t = b.t AND a.lat_i = b.lat_i AND a.aod = b.aod AND a.lon_i <> b.lon_i GROUP BY ALL
)"""

FILLED = f"""{NEAR}, ranked AS (
  SELECT x.t, x.lon_i, x.lat_i, y.aod AS v, row_number() OVER (PARTITION BY x.t, x.lon_i, x.lat_i ORDER BY coalesce(s.d, 60), y.lon_i) AS rank
  FROM images x JOIN images y ON x.t = y.t AND x.lat_i = y.lat_i AND y.aod IS NOT NULL LEFT JOIN same s ON s.t = x.t AND s.r = x.lon_i AND s.s = y.lon_i WHERE x.aod IS NULL
), votes AS (
  SELECT t, lon_i, lat_i, v, count(*) AS votes, min(rank) AS first FROM ranked WHERE rank <= 10 GROUP BY ALL
), modes AS (
  SELECT t, lon_i, lat_i, v, row_number() OVER (PARTITION BY t, lon_i, lat_i ORDER BY votes DESC, first) AS place FROM votes
), filled AS (
  SELECT g.t, g.lat_i, g.lon_i, coalesce(g.aod, m.v) AS aod FROM images g LEFT JOIN modes m ON m.place = 1 AND m.t = g.t AND m.lat_i = g.lat_i AND m.lon_i = g.lon_i
)"""

PAIRS = f"""{FILLED}, pairs AS (
  SELECT a.t AS pair, a.lat_i, a.lon_i, a.aod AS a, b.aod AS b FROM filled a JOIN filled b ON b.t = a.t + 1 AND a.lat_i = b.lat_i AND a.lon_i = b.lon_i
)"""

_PRODUCTS = {"y": "y", "x": "x", "z": "z", "xx": "x * x", "zz": "z * z", "xz": "x * z", "xy": "x * y", "zy": "z * y"}


def _sums(names: list[str], by: str, order: str) -> str:
    return ", ".join(f"sum({n}) OVER (PARTITION BY pair, {by} ORDER BY {order} ROWS BETWEEN 7 PRECEDING AND 5 FOLLOWING) AS {n}" for n in names)


_NAMES = ["n", "good", *[f"s_{k}" for k in _PRODUCTS]]
FLOW = f"""{PAIRS}, change AS (
  SELECT pair, lon_i AS r, lat_i AS c, b - a AS y, lead(a) OVER (PARTITION BY pair, lat_i ORDER BY lon_i) - a AS x, lead(a) OVER (PARTITION BY pair, lon_i ORDER BY lat_i) - a AS z FROM pairs
), product AS (
  SELECT pair, r, c, 1 AS n, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL THEN 1 ELSE 0 END AS good, {", ".join(f"{e} AS s_{k}" for k, e in _PRODUCTS.items())} FROM change WHERE r <= 57 AND c <= 57
), down AS (SELECT pair, r, c, {_sums(_NAMES, "c", "r")} FROM product
), win AS (SELECT pair, r, c, {_sums(_NAMES, "r", "c")} FROM down
), moments AS (
  SELECT pair, r, c, n, good, s_x AS px, s_z AS pz, s_xx AS pxx, s_xz AS pxz, s_xx - s_x * s_x / n AS sxx, s_zz - s_z * s_z / n AS szz, s_xz - s_x * s_z / n AS sxz, s_xy - s_x * s_y / n AS sxy, s_zy - s_z * s_y / n AS szy FROM win WHERE r >= 1 AND c >= 1
), vector AS (
  SELECT pair, r, c, n, CASE WHEN n >= 10 AND good = n THEN CASE WHEN flat THEN 0.0 ELSE -(sxy * szz - szy * sxz) / d END END AS vr, CASE WHEN n >= 10 AND good = n THEN CASE WHEN flat THEN 0.0 ELSE -(szy * sxx - sxy * sxz) / d END END AS vc
  FROM (SELECT *, sxx * szz - sxz * sxz AS d, second < 1e-12 OR abs((sxx * szz - sxz * sxz) * n) / (greatest(n, abs(px), abs(pz)) * second) < 1e-12 AS flat FROM (
    SELECT *, CASE WHEN n >= abs(px) AND n >= abs(pz) THEN greatest(abs(sxx), abs(sxz)) WHEN abs(px) >= abs(pz) THEN greatest(abs(px - n * pxx / px), abs(pxz - pz * pxx / px)) ELSE greatest(abs(pxx - px * pxz / pz), abs(px - n * pxz / pz)) END AS second FROM moments))
), flows AS (
  SELECT p.pair, p.lat_i, p.lon_i, sqrt(vr * vr + vc * vc) AS speed,
    CASE WHEN v.n IS NULL THEN NULL WHEN vr IS NULL THEN 0.0 WHEN vr = 0 AND vc = 0 THEN 0.0 WHEN degrees(atan2(vr, vc)) < 0 THEN degrees(atan2(vr, vc)) + 360 ELSE degrees(atan2(vr, vc)) END AS angle
  FROM pairs p LEFT JOIN vector v ON v.pair = p.pair AND v.r = p.lon_i AND v.c = p.lat_i
)"""

MEAN = f"""{FLOW}, totals AS (
  SELECT lat_i, lon_i, count(*) AS n, count(speed) AS ns, count(angle) AS na, avg(speed) AS speed, avg(angle * pi() / 180) AS angle FROM flows WHERE pair BETWEEN 0 AND 3 GROUP BY ALL
), mean_flow AS (
  SELECT lat_i, lon_i, CASE WHEN n = ns AND n = na THEN speed END AS speed, CASE WHEN n = ns AND n = na THEN angle END AS angle FROM totals
)"""


def smoothed(source: str, values: list[str], keys: str = "", name: str = "smoothed") -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", ") if k) or "TRUE"
    lead = "".join(f"a.{k}, " for k in keys.split(", ") if k)
    w = "exp(-((a.lat_i - b.lat_i) * (a.lat_i - b.lat_i))::DOUBLE) * exp(-((a.lon_i - b.lon_i) * (a.lon_i - b.lon_i))::DOUBLE)"
    out = ", ".join(f"CASE WHEN 0.5 * coalesce(sum({w}) FILTER (WHERE b.{v} IS NOT NULL), 0) > 1e-8 THEN sum({w} * b.{v}) / sum({w}) FILTER (WHERE b.{v} IS NOT NULL) END AS {v}" for v in values)
    return f"""{name} AS (
  SELECT {lead}a.lat_i, a.lon_i, {out} FROM {source} a JOIN {source} b ON {same} AND b.lat_i BETWEEN a.lat_i - 6 AND a.lat_i + 6 AND b.lon_i BETWEEN a.lon_i - 6 AND a.lon_i + 6 GROUP BY ALL
)"""


VELOCITY = f"""{MEAN}, {smoothed("mean_flow", ["speed", "angle"])}, velocity AS (
  SELECT lat_i, lon_i, speed / 60 AS speed, angle, speed / 60 * cos(angle) AS v_x, speed / 60 * sin(angle) AS v_y FROM smoothed
)"""

DIFFUSIVITY = f"""{VELOCITY}, steps AS (
  SELECT lat_i, lon_i, (lead(v_x) OVER la - v_x) * 60 AS p1, (lead(v_y) OVER lo - v_y) * 60 AS p2, (lead(v_x) OVER lo - v_x) * 60 AS p3, (lead(v_y) OVER la - v_y) * 60 AS p4
  FROM velocity WINDOW la AS (PARTITION BY lon_i ORDER BY lat_i), lo AS (PARTITION BY lat_i ORDER BY lon_i)
), diffusivity AS (
  SELECT lat_i, lon_i, CASE WHEN lat_i < 59 AND lon_i < 59 THEN 0.28::DOUBLE * (1.0::DOUBLE / 60) * (1.0::DOUBLE / 60) * sqrt((p1 - p2) * (p1 - p2) + (p3 + p4) * (p3 + p4)) END AS K FROM steps
)"""

GRADIENT = f"""{DIFFUSIVITY}, {smoothed("diffusivity", ["K"], name="ks")}, gradients AS (
  SELECT lat_i, lon_i, K, (CASE WHEN lat_i < 59 THEN lead(K) OVER la - K ELSE K - lag(K) OVER la END) * 60 AS dK_dx, (CASE WHEN lon_i < 59 THEN lead(K) OVER lo - K ELSE K - lag(K) OVER lo END) * 60 AS dK_dy
  FROM ks WINDOW la AS (PARTITION BY lon_i ORDER BY lat_i), lo AS (PARTITION BY lat_i ORDER BY lon_i)
)"""


def omega(n: int) -> str:
    h = n // 2
    return f"""om AS (
  SELECT 1 AS grp, row_number() OVER (ORDER BY k1, k2)::INT AS ord, k1, k2 FROM (VALUES (0, 0), (0, {h}), ({h}, 0), ({h}, {h})) v(k1, k2)
  UNION ALL
  SELECT 2, row_number() OVER (ORDER BY part, k2, k1)::INT, k1, k2 FROM (
    SELECT 1 AS part, a.range::INT AS k1, {h} AS k2 FROM range(1, {h}) a
    UNION ALL SELECT 2, a.range::INT, b.range::INT FROM range({h + 1}) a, range(1, {h}) b
    UNION ALL SELECT 3, a.range::INT, b.range::INT FROM range(1, {h}) a, range({1 - h}, 1) b)
)"""


BASIS = f"""{omega(4)}, columns_of AS (
  SELECT ord AS col, 'c1' AS kind, k1, k2 FROM om WHERE grp = 1 UNION ALL SELECT 4 + ord, 'c2', k1, k2 FROM om WHERE grp = 2 UNION ALL SELECT 10 + ord, 's2', k1, k2 FROM om WHERE grp = 2
), sites AS (
  SELECT (range + 1)::INT AS site, (range % 12) / 12.0::DOUBLE AS x, (range // 12) / 12.0::DOUBLE AS y FROM range(144)
), basis AS (
  SELECT site, col, CASE kind WHEN 'c1' THEN cos(th) WHEN 'c2' THEN 2 * cos(th) ELSE 2 * sin(th) END AS v FROM (SELECT *, 2 * pi() * (x * k1 + y * k2) AS th FROM sites, columns_of)
)"""

STATE = """state AS (
  SELECT (range // 32 + 1)::INT AS time_step, (range % 32 + 1)::INT AS coef_idx, ((range % 32 + 1) * 31 + (range // 32 + 1) * 17) % 101 / 100.0::DOUBLE AS value FROM range(160)
)"""

STATES = f"""{STATE}, other AS (SELECT time_step, coef_idx, value * 0.9::DOUBLE + ((coef_idx * 7 + time_step) % 13) / 50.0::DOUBLE AS value FROM state
), two AS (SELECT time_step, coef_idx, a.value AS a, b.value AS b FROM state a JOIN other b USING (time_step, coef_idx))"""

TRANSITION = """trans AS (SELECT range::INT AS i, range::INT AS j, 0.9::DOUBLE AS v FROM range(1, 17) UNION ALL SELECT range::INT, range::INT - 1, 0.05::DOUBLE FROM range(2, 17))"""


def ahead(start: int) -> str:
    parts = [f"x{start}_0 AS (SELECT coef_idx, value FROM state WHERE time_step = {start} AND coef_idx <= 16)"]
    parts += [f"x{start}_{k} AS (SELECT i AS coef_idx, sum(v * value) AS value FROM trans JOIN x{start}_{k - 1} ON j = coef_idx GROUP BY i)" for k in range(1, 6)]
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM x{start}_{k}" for k in range(1, 6))
    return ", ".join(parts) + f", ahead{start} AS (SELECT k, site, sum(v * value) AS field FROM basis JOIN ({every}) ON col = coef_idx GROUP BY k, site)"


GENERATOR = f"""{SMALL}, {BASIS}, design AS (
  SELECT t AS domain, lat_i * 12 + lon_i + 1 AS site, coalesce(aod, 0) * 0.01 AS vx, coalesce(aod, 0) * 0.02 - 0.01 AS vy, coalesce(aod, 0) * 0.001 AS K, coalesce(aod, 0) * 0.002 AS kx, coalesce(aod, 0) * -0.001 AS ky FROM images
), per AS (
  SELECT domain, site, col, kind, cos(th) AS c, sin(th) AS s, 2 * pi() * (vx * k1 + vy * k2) AS v, -4 * pi() * pi() * (k1 * k1 + k2 * k2) * K AS l, 2 * pi() * (kx * k1 + ky * k2) AS g
  FROM (SELECT *, 2 * pi() * (x * k1 + y * k2) AS th FROM sites JOIN design USING (site), columns_of)
), entries AS (
  SELECT m.domain, m.col AS i, k.col AS j, CASE WHEN m.kind = 's2' AND k.kind = 's2' THEN
      sum(-m.v * m.s * k.c + (m.l * m.s - m.g * m.c) * k.s)
    ELSE sum((CASE m.kind WHEN 's2' THEN m.s ELSE m.c END) * (CASE k.kind WHEN 's2' THEN -k.v * k.c + (k.l * k.s - k.g * k.c) ELSE k.v * k.s + (k.l * k.c - k.g * k.s) END)) END
    * (CASE k.kind WHEN 'c1' THEN 1 ELSE 2 END) * (CASE WHEN m.kind = 'c1' AND m.col > 1 THEN 2 ELSE 1 END) / 144.0::DOUBLE AS v
  FROM per m JOIN per k ON m.site = k.site AND m.domain = k.domain GROUP BY m.domain, m.col, k.col, m.kind, k.kind
)"""

#: exp(A) by its series; every term is the one before times A / k
TERMS = 20
SERIES = f"""{GENERATOR}, small AS MATERIALIZED (SELECT domain, i, j, v / 16 AS v FROM entries), t0 AS (SELECT DISTINCT domain, i, i AS j, 1.0::DOUBLE AS v FROM small), {", ".join(
    f"t{k} AS MATERIALIZED (SELECT a.domain, a.i, b.j, sum(a.v * b.v) / {k} AS v FROM t{k - 1} a JOIN small b ON a.domain = b.domain AND a.j = b.i GROUP BY ALL)" for k in range(1, TERMS)
)}, e0 AS MATERIALIZED (SELECT domain, i, j, sum(v) AS v FROM ({" UNION ALL ".join(f"FROM t{k}" for k in range(TERMS))}) GROUP BY ALL), {", ".join(
    f"e{k} AS MATERIALIZED (SELECT a.domain, a.i, b.j, sum(a.v * b.v) AS v FROM e{k - 1} a JOIN e{k - 1} b ON a.domain = b.domain AND a.j = b.i GROUP BY ALL)" for k in range(1, 5)
)}"""

#: The same for 20 x 20 functions and 3,600 sites: each function's values as a list over the sites, an entry an inner product
GENERATOR_FULL = f"""{GRID}, {omega(20)}, columns_of AS (
  SELECT ord AS col, 'c1' AS kind, k1, k2 FROM om WHERE grp = 1 UNION ALL SELECT 4 + ord, 'c2', k1, k2 FROM om WHERE grp = 2 UNION ALL SELECT 202 + ord, 's2', k1, k2 FROM om WHERE grp = 2
), design AS (
  SELECT lat_i * 60 + lon_i AS site, lon_i / 60.0::DOUBLE AS x, lat_i / 60.0::DOUBLE AS y, coalesce(avg(aod), 0) AS a FROM images GROUP BY lat_i, lon_i
), per AS (
  SELECT site, col, kind, cos(th) AS c, sin(th) AS s, 2 * pi() * (a * 0.01 * k1 + (a * 0.02 - 0.01) * k2) AS v, -4 * pi() * pi() * (k1 * k1 + k2 * k2) * a * 0.001 AS l, 2 * pi() * (a * 0.002 * k1 - a * 0.001 * k2) AS g
  FROM (SELECT *, 2 * pi() * (x * k1 + y * k2) AS th FROM design, columns_of)
), lists AS (
  SELECT col, kind, list(c ORDER BY site) AS c, list(s ORDER BY site) AS s, list(-v * s ORDER BY site) AS vs, list(l * s - g * c ORDER BY site) AS b,
    list(CASE kind WHEN 's2' THEN s ELSE c END ORDER BY site) AS test, list(CASE kind WHEN 's2' THEN -v * c + (l * s - g * c) ELSE v * s + (l * c - g * s) END ORDER BY site) AS image
  FROM per GROUP BY col, kind
), entries AS (
  SELECT m.col AS i, k.col AS j, (CASE WHEN m.kind = 's2' AND k.kind = 's2' THEN list_inner_product(m.vs, k.c) + list_inner_product(m.b, k.s) ELSE list_inner_product(m.test, k.image) END)
    * (CASE k.kind WHEN 'c1' THEN 1 ELSE 2 END) * (CASE WHEN m.kind = 'c1' AND m.col > 1 THEN 2 ELSE 1 END) / 3600.0::DOUBLE AS v
  FROM lists m, lists k
)"""

#: Two states (m1, m2) with covariance (a, b, d): the prediction of a step, then the filter's correction by y
TWO_STATE = f"""{SMALL_BOTH}, obs AS (SELECT sat, t + 1 AS t, {r6('avg(aod)')} AS y FROM images WHERE aod IS NOT NULL GROUP BY ALL), run AS (
  SELECT DISTINCT sat, 0 AS t, 0.1::DOUBLE AS m1, 0.0::DOUBLE AS m2, 0.01::DOUBLE AS a, 0.0::DOUBLE AS b, 0.01::DOUBLE AS d, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS pa, 0.0::DOUBLE AS pb, 0.0::DOUBLE AS pd FROM obs
  UNION ALL
  SELECT sat, t, p1 + (pa + 0.5 * pb) / q * e, p2 + (pb + 0.5 * pd) / q * e, pa - (pa + 0.5 * pb) * (pa + 0.5 * pb) / q, pb - (pa + 0.5 * pb) * (pb + 0.5 * pd) / q, pd - (pb + 0.5 * pd) * (pb + 0.5 * pd) / q, p1, p2, pa, pb, pd FROM (
    SELECT *, pa + pb + 0.25 * pd + 0.5 + 1e-8 AS q, y - p1 - 0.5 * p2 AS e FROM (
      SELECT r.sat, r.t + 1 AS t, o.y, m1 + m2 AS p1, 0.8 * m2 AS p2, a + 2 * b + d + 0.05 AS pa, 0.8 * (b + d) AS pb, 0.64 * d + 0.02 AS pd FROM run r JOIN obs o ON o.sat = r.sat AND o.t = r.t + 1))
), told AS (
  SELECT sat, 'filtered' AS kind, t, m1, m2, a, b, d FROM run WHERE t > 0 UNION ALL SELECT sat, 'predicted', t, p1, p2, pa, pb, pd FROM run WHERE t > 0
  UNION ALL SELECT sat, 'predicted', 6, m1 + m2, 0.8 * m2, a + 2 * b + d + 0.05, 0.8 * (b + d), 0.64 * d + 0.02 FROM run WHERE t = 5
)"""

OBSERVED = f"""{BOTH}, observed AS (
  SELECT sat, t, lat_i * 60 + lon_i AS site, aod AS y FROM images WHERE aod IS NOT NULL AND lat_i IN (SELECT trunc(60 / 20.0 * range)::INT - 1 FROM range(1, 21)) AND lon_i IN (SELECT trunc(60 / 20.0 * range)::INT - 1 FROM range(1, 21))
)"""

TWO = f"""{BOTH}, two AS (
  SELECT coalesce(a.t, b.t) AS t, coalesce(a.lat_i, b.lat_i) AS lat_i, coalesce(a.lon_i, b.lon_i) AS lon_i, a.aod AS a, b.aod AS b
  FROM (FROM images WHERE sat = 0) a FULL JOIN (FROM images WHERE sat = 1) b ON a.t = b.t AND a.lat_i = b.lat_i AND a.lon_i = b.lon_i
)"""

SCENES = """scenes AS (
  SELECT (user_id % 2)::INT AS sat, (event_id % 5 + 18)::INT AS hour, printf('img_%08d.nc', event_id) AS path FROM events
), kept AS (
  SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY sat, hour ORDER BY path) - 1)::INT AS j FROM scenes) WHERE j < 12
)"""


def geos(sweep: str, lon_0: float, suffix: str) -> str:
    h, a = 35786023.0, 6378137.0
    r1 = h / a
    rg = 1 + r1
    first = "tan(b) AS vz, tan(a) * sqrt(1 + tan(b) * tan(b)) AS vy" if sweep == "x" else "tan(a) AS vy, tan(b) * sqrt(1 + tan(a) * tan(a)) AS vz"
    return f"""g{suffix} AS (
  SELECT i, j, degrees(atan2(vy * k, {rg}::DOUBLE - k)) + {lon_0}::DOUBLE AS lon{suffix}, degrees(atan(vz * k * cos(atan2(vy * k, {rg}::DOUBLE - k)) / ({rg}::DOUBLE - k))) AS lat{suffix} FROM (
    SELECT *, ({2 * rg}::DOUBLE - sqrt(CASE WHEN d >= 0 THEN d END)) / (2 * q) AS k FROM (
      SELECT *, vy * vy + vz * vz + 1 AS q, {4 * rg * rg}::DOUBLE - (vy * vy + vz * vz + 1) * {4 * (rg * rg - 1)}::DOUBLE AS d FROM (
        SELECT i, j, {first} FROM mesh))))"""


def _pairs_stats(keys: str) -> str:
    return f"SELECT {keys}, {r6('sqrt(avg((a - b) * (a - b)))')} AS rmse, {r6('avg(abs(a - b))')} AS mae, {r6('max(abs(a - b))')} AS max_diff, {r6('avg(a - b)')} AS bias"


def _agree(t: str) -> str:
    good = "a IS NOT NULL AND b IS NOT NULL"
    return f"""SELECT {t} AS t, count(*) FILTER (WHERE {good}) AS n, {r6(f"corr(a, b) FILTER (WHERE {good})")} AS r, {r6("sqrt(avg((a - b) * (a - b)))")} AS rmse, {r6("avg(abs(a - b))")} AS mae,
  {r6(f"avg(a) FILTER (WHERE {good})")} AS mean_a, {r6(f"avg(b) FILTER (WHERE {good})")} AS mean_b,
  {r6("100.0 * count(*) FILTER (WHERE a IS NULL) / count(*)::DOUBLE")} AS missing_a, {r6("100.0 * count(*) FILTER (WHERE b IS NULL) / count(*)::DOUBLE")} AS missing_b,
  CASE WHEN corr(a, b) FILTER (WHERE {good}) >= 0.99 THEN 'PASS' WHEN corr(a, b) FILTER (WHERE {good}) >= 0.85 THEN 'CLOSE' ELSE 'DIFFERS' END AS verdict FROM two"""


def cols(*names: str) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


SQL: dict[str, str] = {
    "regrid_mean": f"WITH {GRID} SELECT t, lat_i, lon_i, n, {cols('aod')} FROM grid",
    "regrid_coverage": f"WITH {GRID} SELECT t, count(*) AS cells, count(aod) AS present, count(*) - count(aod) AS missing FROM images GROUP BY t",
    "domain_filter_clamp": f"WITH {POINTS}, low AS (SELECT sat, t, greatest(aod - 0.45::DOUBLE, 0.0::DOUBLE) AS aod FROM points WHERE lat > 35.0::DOUBLE AND lat < 37.4::DOUBLE AND lon > -124.0::DOUBLE AND lon < -121.6::DOUBLE) SELECT sat, t, count(*) AS n, count(*) FILTER (WHERE aod = 0) AS clamped, {r6('sum(aod)')} AS total FROM low GROUP BY ALL",
    "merge_series": f"WITH {GRID} SELECT t + 1 AS time_index, count(*) AS n_rows, count(aod) AS present, {r6('sum(aod)')} AS total FROM images GROUP BY t",
    "series_gaps": f"WITH {GRID} SELECT range::INT AS time_index, coalesce(n, 0) AS n_rows FROM range(1, 7) LEFT JOIN (SELECT t + 1 AS time_index, count(*) AS n FROM images WHERE t <> 2 GROUP BY t) ON time_index = range WHERE coalesce(n, 0) <> 3600",
    "first_k_per_hour": f"WITH {SCENES} SELECT sat, hour, path, j FROM kept",
    "slot_index": f"WITH {SCENES} SELECT sat, path, (hour - 18) * 12 + j + 1 AS t FROM kept",
    "new_files": "SELECT printf('img_%08d.nc', event_id) AS path FROM events WHERE NOT coalesce(floor(value * 1000) > 100000, FALSE)",
    "cell_bounds": f"WITH {axes(60, '0.04')} SELECT a.i * 60 + o.i AS site, a.i AS lat_i, o.i AS lon_i, {r6('(a.i + 0.5::DOUBLE) * 0.04::DOUBLE + 35.0::DOUBLE')} AS lat, {r6('(o.i + 0.5::DOUBLE) * 0.04::DOUBLE + -124.0::DOUBLE')} AS lon, {r6('a.lo')} AS lat_lo, {r6('a.hi')} AS lat_hi, {r6('o.lo')} AS lon_lo, {r6('o.hi')} AS lon_hi FROM lat_axis a, lon_axis o",
    "transpose_pivot": f"WITH {SMALL} SELECT t, lon_i AS lat_i, {', '.join(f'{r6(f"max(aod) FILTER (WHERE lat_i = {j})")} AS V{j + 1}' for j in range(12))} FROM images GROUP BY t, lon_i",
    "knn_distance": f"WITH {NEAR} SELECT t, r, s, d FROM same",
    "knn_impute": f"WITH {FILLED} SELECT t, lat_i, lon_i, {cols('aod')} FROM filled",
    "imputed_split": f"WITH {FILLED}, d AS (SELECT f.*, i.aod AS o, CASE WHEN f.aod IS NULL THEN NULL WHEN lat_i % 2 = 0 THEN 0.25 ELSE 0.125 END AS diff FROM filled f JOIN images i USING (t, lat_i, lon_i)) SELECT {r6('max(diff) FILTER (WHERE o IS NULL)')} AS imputed, {r6('max(diff) FILTER (WHERE o IS NOT NULL)')} AS untouched FROM d",
    "flow_pairs": f"WITH {PAIRS} SELECT pair, lat_i, lon_i, {cols('a', 'b')} FROM pairs",
    "optical_flow": f"WITH {FLOW} SELECT pair, lat_i, lon_i, {cols('speed', 'angle')} FROM flows",
    "flow_average": f"WITH {MEAN} SELECT lat_i, lon_i, {cols('speed', 'angle')} FROM mean_flow",
    "flow_average_independent": f"WITH {MEAN} SELECT lat_i, lon_i, {r6('CASE WHEN n = ns THEN speed END')} AS speed, {r6('CASE WHEN n = na THEN angle END')} AS angle FROM totals",
    "kernel_smooth": f"WITH {GRID}, {smoothed('images', ['aod'], 't')} SELECT t, lat_i, lon_i, {cols('aod')} FROM smoothed",
    "velocity_components": f"WITH {VELOCITY} SELECT lat_i, lon_i, {cols('speed', 'angle', 'v_x', 'v_y')} FROM velocity",
    "smagorinsky_k": f"WITH {DIFFUSIVITY} SELECT lat_i, lon_i, {r6('K * 1e4')} AS K FROM diffusivity",
    "k_gradient": f"WITH {GRADIENT} SELECT lat_i, lon_i, {r6('K * 1e4')} AS K, {r6('dK_dx * 1e4')} AS dK_dx, {r6('dK_dy * 1e4')} AS dK_dy FROM gradients",
    "unit_conversion": f"WITH {DIFFUSIVITY} SELECT lat_i, lon_i, {r6('speed * 60 * 0.04 * 111 * 12')} AS km_h, {r6('K * 60 * 60 * 0.04 * 111 * 0.04 * 111 * 12')} AS km2_h FROM velocity JOIN diffusivity USING (lat_i, lon_i)",
    "arrow_rescale": f"WITH {VELOCITY} SELECT lat_i, lon_i, {r6('speed')} AS speed, {r6('(speed - min(speed) OVER ()) / (CASE WHEN max(speed) OVER () > min(speed) OVER () THEN max(speed) OVER () - min(speed) OVER () ELSE 1 END) * 0.05 + 0.05')} AS scaled FROM velocity WHERE lat_i % 3 = 0 AND lon_i % 3 = 0",
    "polar_decode": f"WITH {VELOCITY} SELECT lat_i, lon_i, {r6('sqrt(v_x * v_x + v_y * v_y)')} AS speed, {r6('atan2(v_y, v_x)')} AS direction FROM velocity",
    "omega_set": f"WITH {omega(20)} SELECT grp, ord, k1, k2 FROM om",
    "fourier_basis": f"WITH {BASIS} SELECT site, col, {cols('v')} FROM basis",
    "dft_coefficients": f"WITH {SMALL}, {omega(6)} SELECT t, k1, k2, {r6('sum(coalesce(aod, 0) * cos(2 * pi() / 12 * (lon_i * k1 + lat_i * k2))) / 144')} AS re, {r6('sum(coalesce(aod, 0) * sin(2 * pi() / 12 * (lon_i * k1 + lat_i * k2))) / 144')} AS im FROM images, om GROUP BY t, k1, k2",
    "source_signal": f"WITH {BASIS} SELECT site, {r6('(exp(-sqrt((x - 0.2) * (x - 0.2) + (y - 0.3) * (y - 0.3)) / 0.32) + exp(-sqrt((x - 0.7) * (x - 0.7) + (y - 0.6) * (y - 0.6)) / 0.32) + exp(-sqrt((x - 0.5) * (x - 0.5) + (y - 0.9) * (y - 0.9)) / 0.32)) * 0.5 / (2 * pi() * 0.16)')} AS signal FROM sites",
    "generator_uniform": f"WITH {omega(6)} SELECT ord + 4 AS i, ord + 20 AS j, {r6('-2 * pi() * (k1 + k2)')} AS v FROM om WHERE grp = 2 UNION ALL SELECT ord + 20, ord + 4, {r6('2 * pi() * (k1 + k2)')} FROM om WHERE grp = 2",
    "generator_matrix_small": f"WITH {GENERATOR} SELECT domain, i, j, {cols('v')} FROM entries",
    "max_row_sum": f"WITH {GENERATOR} SELECT domain, {r6('max(s)')} AS norm FROM (SELECT domain, sum(abs(v)) AS s FROM entries GROUP BY domain, i) GROUP BY domain",
    "uds_lattice": "SELECT trunc(60 / 20.0 * range)::INT - 1 AS idx FROM range(1, 21)",
    "obs_assembly": f"WITH {OBSERVED} SELECT sat, t, site, {cols('y')} FROM observed",
    "obs_rows": f"WITH {SMALL_BOTH}, {BASIS} SELECT sat, t + 1 AS t, col, count(*) AS n, round(sum(v * aod), 9) AS fy FROM images JOIN basis ON site = lat_i * 12 + lon_i + 1 WHERE aod IS NOT NULL GROUP BY ALL",
    "obs_summary": f"WITH {OBSERVED} SELECT t, count(*) FILTER (WHERE sat = 0) AS n1, count(*) FILTER (WHERE sat = 1) AS n2, greatest(count(*) FILTER (WHERE sat = 0), count(*) FILTER (WHERE sat = 1)) AS most FROM observed GROUP BY t",
    "state_reconstruction": f"WITH {BASIS}, {STATE} SELECT time_step, site, {r6('sum(v * value) FILTER (WHERE coef_idx <= 16)')} AS field, {r6('sum(v * value) FILTER (WHERE coef_idx > 16)')} AS bias FROM basis JOIN state ON col = (coef_idx - 1) % 16 + 1 GROUP BY time_step, site",
    "kstep_forecast_small": f"WITH {BASIS}, {STATE}, {TRANSITION}, {ahead(5)} SELECT k, site, round(field, 9) + 0.0 AS field FROM ahead5",
    "forecast_error": f"WITH {SMALL_BOTH}, {BASIS}, {STATE}, {TRANSITION}, {ahead(5)}, two AS (SELECT k, round(field, 9) + 0.0 AS a, aod AS b FROM ahead5 JOIN images ON k = t + 1 AND site = lat_i * 12 + lon_i + 1 AND sat = 0 WHERE aod IS NOT NULL) {_pairs_stats('k')} FROM two GROUP BY k",
    "prediction_pool": f"WITH {BASIS}, {STATE}, {TRANSITION}, {ahead(5)}, {ahead(4)} SELECT k, site, round(a.field - b.field, 9) + 0.0 AS diff FROM ahead5 a JOIN ahead4 b USING (k, site)",
    "matrix_power": f"WITH {TRANSITION}, two AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM trans a JOIN trans b ON a.j = b.i GROUP BY a.i, b.j) SELECT a.i, b.j, {r6('sum(a.v * b.v)')} AS v FROM two a JOIN trans b ON a.j = b.i GROUP BY a.i, b.j",
    "augmented_transition": f"WITH {TRANSITION} SELECT i, j, v FROM trans UNION ALL SELECT range::INT, range::INT + 16, 1.0::DOUBLE FROM range(1, 17) UNION ALL SELECT range::INT + 16, range::INT + 16, 1.0::DOUBLE FROM range(1, 17)",
    "compare_per_step": f"WITH {TWO} {_agree('t')} GROUP BY t UNION ALL {_agree('NULL::INT')}",
    "nan_mismatch": f"WITH {TWO} SELECT t, count(*) AS cells, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS missing_mismatch, {r6('max(abs(a - b))')} AS max_diff, {r6('avg(abs(a - b))')} AS mean_diff, count(*) FILTER (WHERE abs(a - b) > 0.5) AS over FROM two GROUP BY t",
    "worst_cells": f"WITH {TWO} SELECT t, lat_i, lon_i, {cols('a', 'b')}, {r6('abs(a - b)')} AS diff FROM two WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY abs(a - b) DESC, t, lat_i, lon_i LIMIT 5",
    "histogram_density": f"WITH {GRID}, ends AS (SELECT min(aod) AS lo, max(aod) AS hi, count(aod) AS total FROM images) SELECT least(floor((aod - lo) * 100 / (hi - lo)), 99)::INT AS bin, count(*) AS n, {r6('count(*) / (any_value(total) * ((any_value(hi) - any_value(lo)) / 100))')} AS density FROM images, ends WHERE aod IS NOT NULL GROUP BY 1",
    "percentile_98": f"WITH {GRID} SELECT {r6('quantile_cont(abs(aod), 0.98)')} AS p98 FROM images",
    "coef_corr": f"WITH {STATES} SELECT time_step, {r6('corr(a, b)')} AS corr, {r6('avg(abs(a)) / avg(abs(b))')} AS size_ratio FROM two GROUP BY time_step",
    "filter_rmse": f"WITH {STATES} {_pairs_stats('time_step')} FROM two GROUP BY time_step",
    "count_equality": f"WITH {OBSERVED}, n AS (SELECT sat, t, count(*) AS n FROM observed GROUP BY ALL) SELECT t, a.n AS a, b.n AS b, coalesce(a.n = b.n, FALSE) AS equal FROM (SELECT t, n FROM n WHERE sat = 0) a FULL JOIN (SELECT t, n FROM n WHERE sat = 1) b USING (t)",
    "row_gates": f"WITH {GRID} SELECT 'grid' AS gate, count(*) AS n_rows, count(*) >= 18000 AS passed FROM images UNION ALL SELECT 'present', count(*), count(*) >= 10 FROM images WHERE aod IS NOT NULL",
    "geos_inverse": f"WITH mesh AS (SELECT x.range::INT AS i, y.range::INT AS j, (x.range - 12) * 0.0132::DOUBLE AS a, (y.range - 12) * 0.0132::DOUBLE AS b FROM range(25) x, range(25) y), {geos('x', -137.0, '')}, {geos('y', -75.0, '_y')} SELECT i, j, {cols('lon', 'lat', 'lon_y', 'lat_y')} FROM g JOIN g_y USING (i, j)",
    "ivw_fusion": f"WITH {SMALL_BOTH} SELECT a.t + 1 AS t, a.lat_i * 12 + a.lon_i + 1 AS site, {r6('a.aod / (1 + 0.01) + b.aod * (0.01 / (1 + 0.01))')} AS y FROM images a JOIN images b ON a.sat = 0 AND b.sat = 1 AND a.t = b.t AND a.lat_i = b.lat_i AND a.lon_i = b.lon_i WHERE a.aod IS NOT NULL AND b.aod IS NOT NULL",
    "matrix_expm": f"WITH {SERIES} SELECT domain, i, j, {cols('v')} FROM e4",
    "generator_matrix": f"WITH {GENERATOR_FULL} SELECT i, j, {cols('v')} FROM entries",
    "kalman_two_state": f"""WITH RECURSIVE {TWO_STATE} SELECT sat AS chain, kind, t AS time_step, unnest([1, 1, 1, 2, 2, 2]) AS i, unnest([0, 1, 2, 0, 1, 2]) AS j, unnest([{r6('m1')}, {r6('a')}, {r6('b')}, {r6('m2')}, {r6('b')}, {r6('d')}]) AS value FROM told""",
    "obs_stack": f"""WITH {SMALL_BOTH}, {BASIS}, own AS (SELECT sat, t + 1 AS t, lat_i * 12 + lon_i + 1 AS site, aod AS y, row_number() OVER (PARTITION BY t ORDER BY sat, lat_i, lon_i)::INT AS row FROM images WHERE aod IS NOT NULL)
  SELECT t, row, sat, site, {cols('y')}, {r6('CASE sat WHEN 0 THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END')} AS variance, count(*) AS entries, round(sum(v), 9) AS sum_v FROM own JOIN basis USING (site) GROUP BY ALL""",
    "residual_sums": f"""WITH {SMALL_BOTH}, {BASIS}, {STATE}, fit AS (SELECT time_step, site, sum(v * value) AS f FROM basis JOIN state ON col = coef_idx GROUP BY ALL)
  SELECT sat, count(*) AS n, {r6('sum((aod - f) * (aod - f))')} AS sum_sq FROM images JOIN fit ON time_step = t + 1 AND site = lat_i * 12 + lon_i + 1 WHERE aod IS NOT NULL GROUP BY sat""",
    "state_residuals": f"""WITH {STATE}, {TRANSITION}, big AS (SELECT i, j, v FROM trans UNION ALL SELECT range::INT, range::INT + 16, 1.0::DOUBLE FROM range(1, 17) UNION ALL SELECT range::INT + 16, range::INT + 16, 1.0::DOUBLE FROM range(1, 17)),
  said AS (SELECT time_step + 1 AS time_step, i AS coef_idx, sum(v * value) AS said FROM big JOIN state ON j = coef_idx GROUP BY ALL) SELECT time_step, coef_idx, round(value - said, 9) + 0.0 AS value FROM state JOIN said USING (time_step, coef_idx)""",
    "matrix_helpers": f"""WITH {TRANSITION}, square AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM trans a JOIN trans b ON a.j = b.i GROUP BY a.i, b.j), every AS (SELECT i, j, 2 * v AS v FROM trans UNION ALL SELECT range::INT, range::INT, 1.0::DOUBLE FROM range(1, 17) UNION ALL SELECT i, j, -0.3::DOUBLE * v FROM square)
  SELECT i, j, {r6('sum(v)')} AS v FROM every GROUP BY i, j""",
    "clip_field": f"WITH {SMALL} SELECT t, lat_i, lon_i, {r6('CASE WHEN aod IS NOT NULL THEN greatest(aod - 0.45, 0) END')} AS aod FROM images",
    "coordinate_rounding": "SELECT event_id, round(value / 7.0::DOUBLE, 2) + 0.0 AS lat, round(value / -3.0::DOUBLE, 2) + 0.0 AS lon FROM events",
    "scene_listing": """WITH keys AS (SELECT printf('product-%d/2024/%03d/%02d/OR_product-%d_s%d.%s', user_id % 3, user_id % 5 + 1, event_id % 24, user_id % 3, event_id, CASE WHEN event_id % 7 = 0 THEN 'tmp' ELSE 'nc' END) AS path, trunc(value)::BIGINT AS length, event_id % 24 AS h, user_id AS u, event_id AS e FROM events)
  SELECT path, length, h::INT AS hour FROM keys WHERE u % 3 = 1 AND u % 5 = 1 AND h BETWEEN 18 AND 22 AND e % 7 <> 0""",
    "kalman_scalar": f"""WITH RECURSIVE {SMALL_BOTH}, obs AS (SELECT sat, t + 1 AS t, {r6('avg(aod)')} AS y FROM images WHERE aod IS NOT NULL GROUP BY ALL), run AS (
  SELECT DISTINCT sat, 0 AS t, 0.1::DOUBLE AS m, 0.01::DOUBLE AS c FROM obs
  UNION ALL
  SELECT r.sat, r.t + 1, 0.9 * m + (c * 0.81 + 0.1) / (c * 0.81 + 0.1 + 0.5 + 1e-8) * (y - 0.9 * m), (c * 0.81 + 0.1) - (c * 0.81 + 0.1) * (c * 0.81 + 0.1) / (c * 0.81 + 0.1 + 0.5 + 1e-8) FROM run r JOIN obs o ON o.sat = r.sat AND o.t = r.t + 1
) SELECT sat AS chain, t AS time_step, 1 AS coef_idx, {r6('m')} AS value FROM run WHERE t > 0""",
}
