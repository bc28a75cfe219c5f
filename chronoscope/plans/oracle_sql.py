"""Independent SQL statements (DuckDB dialect) of the registered queries.

They are written from the operator definitions, not generated from the Spark plans,
and are what the correctness gate compares against. Shared CTE text lives here; each
query composes the CTEs it needs. Table views: embeddings, events, lineitem, ...
"""

from __future__ import annotations

import math

SEED = 42
TAU = 50.0
TWO32 = 4294967296.0


def u_sql(*keys: str, seed: int = SEED) -> str:
    """U[0,1) from md5(seed|k1|...) first 8 hex digits; keys are SQL expressions (int/str)."""
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {ks})), 1, 8)) AS BIGINT) / {TWO32})"


def normal_sql(*keys: str, seed: int = SEED) -> str:
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    h = f"md5(concat_ws('|', '{seed}', {ks}))"
    u1 = f"(CAST(('0x' || substr({h}, 1, 8)) AS BIGINT) / {TWO32})"
    u2 = f"(CAST(('0x' || substr({h}, 9, 8)) AS BIGINT) / {TWO32})"
    return f"(sqrt(-2.0 * ln({u1} + {2.0 ** -33!r})) * cos({2.0 * math.pi!r} * {u2}))"


def chunk_u_sql(*keys: str, a: str, seed: int = SEED) -> str:
    """Draw of attempt a: chunk a % 4 of md5(seed|keys|a // 4)."""
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    h = f"md5(concat_ws('|', '{seed}', {ks}, CAST(({a}) // 4 AS VARCHAR)))"
    return f"(CAST(('0x' || substr({h}, 1 + 8 * (({a}) % 4), 8)) AS BIGINT) / {TWO32})"


def key60_sql(*keys: str, seed: int = SEED) -> str:
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {ks})), 1, 15)) AS BIGINT)"


# --- signal sets -------------------------------------------------------------------------

EMB = """
cells AS (
  SELECT noun_id, CAST(0 AS BIGINT) AS feature, CAST(i AS BIGINT) AS t, CAST(embedding[i + 1] AS DOUBLE) AS x
  FROM (SELECT CAST(vec_id AS BIGINT) AS noun_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)),
targets AS (SELECT CAST(vec_id AS BIGINT) AS noun_id, CAST(label AS VARCHAR) AS target FROM embeddings)"""


def _dense(binned_sql: str, chan_sql: str) -> str:
    return f"""
binned AS ({binned_sql}),
chan AS ({chan_sql}),
dims AS (SELECT (SELECT max(step) + 1 FROM binned) AS nT, (SELECT count(*) FROM chan) AS nF),
grid AS (
  SELECT noun_id, CAST(k // nT AS BIGINT) AS feature, CAST(k % nT AS BIGINT) AS t, 0.0 AS x
  FROM (SELECT noun_id, unnest(range(nF * nT)) AS k, nT FROM (SELECT DISTINCT noun_id FROM binned), dims)),
cells AS (
  SELECT noun_id, feature, t, sum(x) AS x FROM (
    SELECT b.noun_id, CAST(c.feature AS BIGINT) AS feature, CAST(b.step AS BIGINT) AS t, b.v AS x
    FROM binned b JOIN chan c ON b.channel = c.channel
    UNION ALL SELECT * FROM grid) GROUP BY noun_id, feature, t),
totals AS (SELECT noun_id, sum(x) AS total FROM cells GROUP BY noun_id),
cls_thr AS (SELECT quantile_cont(total, [0.5, 1.0]) AS q FROM totals),
targets AS (
  SELECT noun_id, CAST(CASE WHEN total <= q[1] THEN 0 WHEN total <= q[2] THEN 1 ELSE 1 END AS VARCHAR) AS target
  FROM totals, cls_thr)"""


EVT = _dense(
    """SELECT noun_id, channel, step, sum(v) AS v FROM (
         SELECT CAST(user_id AS BIGINT) AS noun_id, event_type AS channel,
                date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS step,
                coalesce(value, 0.0) AS v FROM events) GROUP BY noun_id, channel, step""",
    "SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS feature FROM (SELECT DISTINCT event_type AS channel FROM events)")

SUP = _dense(
    """SELECT noun_id, channel, step, sum(v) AS v FROM (
         SELECT CAST(l_suppkey AS BIGINT) AS noun_id, l_returnflag AS channel,
                (year(l_shipdate) * 12 + month(l_shipdate) - 1)
                  - (SELECT min(year(l_shipdate) * 12 + month(l_shipdate) - 1) FROM lineitem) AS step,
                coalesce(l_quantity, 0.0) AS v FROM lineitem) GROUP BY noun_id, channel, step""",
    "SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS feature FROM (SELECT DISTINCT l_returnflag AS channel FROM lineitem)")

# events summed over either half of the days
TOT = EVT.replace("cells AS (", "daily AS (").replace("FROM cells", "FROM daily") + """,
cells AS (SELECT noun_id, feature, CAST(t * 2 // nT AS BIGINT) AS t, sum(x) AS x FROM daily, dims GROUP BY 1, 2, 3)"""

SIGNALS = {"emb": EMB, "evt": EVT, "sup": SUP, "tot": TOT}


# --- preparation ---------------------------------------------------------------------------

SPLIT = f"""
ranked AS (
  SELECT noun_id, row_number() OVER (ORDER BY h, noun_id) AS rnk
  FROM (SELECT noun_id, {key60_sql('noun_id')} AS h FROM targets)),
nsamp AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM targets),
split AS (
  SELECT noun_id, CASE WHEN rnk <= ceil(CAST(0.7 AS DOUBLE) * n) THEN 'train'
                       WHEN rnk <= ceil(CAST(0.7 AS DOUBLE) * n) + ceil(CAST(0.15 AS DOUBLE) * n) THEN 'val'
                       ELSE 'test' END AS split
  FROM ranked, nsamp),
train_ids AS (SELECT noun_id FROM split WHERE split = 'train'),
test_ids AS (SELECT noun_id FROM split WHERE split = 'test')"""

SCALER = """
scaler AS (
  SELECT feature, count(x) AS n, avg(x) AS mean, var_pop(x) * count(x) AS s,
         CASE WHEN count(x) > 1 THEN stddev_samp(x) ELSE 0.0 END AS std, min(x) AS min, max(x) AS max
  FROM cells WHERE noun_id IN (SELECT noun_id FROM train_ids) GROUP BY feature),
std_cells AS (
  SELECT c.noun_id, c.feature, c.t, CASE WHEN s.std <> 0 THEN (c.x - s.mean) / s.std ELSE 0.0 END AS x
  FROM cells c JOIN scaler s ON c.feature = s.feature)"""

ENCODER = """
encoder AS (
  SELECT target, CAST(row_number() OVER (ORDER BY target) - 1 AS BIGINT) AS class_idx, n
  FROM (SELECT CASE WHEN target = '' THEN '0' ELSE target END AS target, count(*) AS n
        FROM targets WHERE noun_id IN (SELECT noun_id FROM train_ids) GROUP BY 1)),
labelled AS (
  SELECT t.noun_id, e.class_idx FROM targets t
  JOIN encoder e ON (CASE WHEN t.target = '' THEN '0' ELSE t.target END) = e.target)"""

MODEL = f"""
mu AS (
  SELECT l.class_idx, c.feature, c.t, avg(c.x) AS mu
  FROM std_cells c JOIN labelled l ON c.noun_id = l.noun_id
  WHERE c.noun_id IN (SELECT noun_id FROM train_ids) GROUP BY 1, 2, 3),
wmodel AS (SELECT class_idx, feature, t, 2.0 * {TAU!r} * mu / count(*) OVER (PARTITION BY class_idx) AS w,
                  mu * mu / count(*) OVER (PARTITION BY class_idx) AS m2 FROM mu),
bmodel AS (SELECT class_idx, -{TAU!r} * sum(m2) AS b FROM wmodel GROUP BY class_idx),
test_cells AS (SELECT * FROM std_cells WHERE noun_id IN (SELECT noun_id FROM test_ids)),
z1 AS (
  SELECT c.noun_id, w.class_idx, sum(c.x * w.w) + max(b.b) AS z
  FROM test_cells c JOIN wmodel w ON c.feature = w.feature AND c.t = w.t JOIN bmodel b ON w.class_idx = b.class_idx
  GROUP BY c.noun_id, w.class_idx),
z1c AS (SELECT noun_id, class_idx, z, z - max(z) OVER (PARTITION BY noun_id) AS zc FROM z1),
p1 AS (SELECT noun_id, class_idx, z, exp(zc) / sum(exp(zc)) OVER (PARTITION BY noun_id) AS p FROM z1c),
pred AS (SELECT noun_id, first(class_idx ORDER BY p DESC, class_idx) AS pred FROM p1 GROUP BY noun_id),
score1 AS (SELECT p.noun_id, d.pred, p.p AS s1 FROM p1 p JOIN pred d ON p.noun_id = d.noun_id AND p.class_idx = d.pred)"""


def prelude(signal: str, *parts: str) -> str:
    return "WITH " + ",".join([SIGNALS[signal]] + list(parts))


# --- attribution ---------------------------------------------------------------------------------

def _gl_values() -> str:
    import numpy as np
    x, w = np.polynomial.legendre.leggauss(50)
    return ", ".join(f"({float(a)!r}, {float(g)!r})" for a, g in zip((x + 1.0) / 2.0, w / 2.0))


BASES = f"""
base AS (SELECT feature, t, {normal_sql("'baseline'", 'feature', 't')} AS xb FROM (SELECT DISTINCT feature, t FROM wmodel)),
zb AS (SELECT w.class_idx, sum(b.xb * w.w) + max(bm.b) AS z FROM base b
       JOIN wmodel w ON b.feature = w.feature AND b.t = w.t JOIN bmodel bm ON bm.class_idx = w.class_idx GROUP BY w.class_idx),
zbc AS (SELECT class_idx, z, z - max(z) OVER () AS zc FROM zb),
pbase AS (SELECT class_idx, z, exp(zc) / sum(exp(zc)) OVER () AS p FROM zbc),
bsel AS (SELECT noun_id, bid FROM (
           SELECT noun_id, row_number() OVER (ORDER BY h, noun_id) - 1 AS bid
           FROM (SELECT DISTINCT noun_id, {key60_sql("'baseline'", 'noun_id')} AS h FROM test_cells)) WHERE bid < 50),
bases AS (SELECT CAST(s.bid AS BIGINT) AS bid, c.feature, c.t, c.x AS xb FROM test_cells c JOIN bsel s ON c.noun_id = s.noun_id),
zbs AS (SELECT b.bid, w.class_idx, sum(b.xb * w.w) + max(bm.b) AS z FROM bases b
        JOIN wmodel w ON b.feature = w.feature AND b.t = w.t JOIN bmodel bm ON bm.class_idx = w.class_idx GROUP BY 1, 2),
zbsc AS (SELECT bid, class_idx, z, z - max(z) OVER (PARTITION BY bid) AS zc FROM zbs),
pbs AS (SELECT bid, class_idx, z, exp(zc) / sum(exp(zc)) OVER (PARTITION BY bid) AS p FROM zbsc),
nbase AS (SELECT count(DISTINCT bid) AS nb FROM bases),
wbar AS (SELECT feature, t, avg(w) AS wbar FROM wmodel GROUP BY feature, t)"""

REL = {}
REL["saliency"] = """
rel AS (
  SELECT c.noun_id, c.feature, c.t, c.x,
         abs(max(s.s1) * (sum(CASE WHEN w.class_idx = s.pred THEN w.w ELSE 0.0 END) - sum(p.p * w.w))) AS r
  FROM test_cells c JOIN wmodel w ON c.feature = w.feature AND c.t = w.t
  JOIN p1 p ON p.noun_id = c.noun_id AND p.class_idx = w.class_idx JOIN score1 s ON s.noun_id = c.noun_id
  GROUP BY c.noun_id, c.feature, c.t, c.x)"""

REL["integrated_gradients"] = f"""
nodes AS (SELECT * FROM (VALUES {_gl_values()}) v(a, g)),
za AS (SELECT z.noun_id, n.a, n.g, z.class_idx, zb.z + n.a * (z.z - zb.z) AS z FROM p1 z JOIN zb ON z.class_idx = zb.class_idx, nodes n),
zac AS (SELECT noun_id, a, g, class_idx, z - max(z) OVER (PARTITION BY noun_id, a) AS zc FROM za),
pa AS (SELECT noun_id, a, g, class_idx, exp(zc) / sum(exp(zc)) OVER (PARTITION BY noun_id, a) AS p FROM zac),
pac AS (SELECT pa.noun_id, pa.a, pa.p AS pc FROM pa JOIN score1 s ON pa.noun_id = s.noun_id AND pa.class_idx = s.pred),
igcoef AS (SELECT pa.noun_id, pa.class_idx, sum(pa.g * pac.pc * pa.p) AS bk, sum(pa.g * pac.pc) AS acoef
           FROM pa JOIN pac ON pa.noun_id = pac.noun_id AND pa.a = pac.a GROUP BY 1, 2),
rel AS (
  SELECT c.noun_id, c.feature, c.t, c.x,
         (c.x - max(b.xb)) * (sum(CASE WHEN w.class_idx = s.pred THEN w.w * k.acoef ELSE 0.0 END) - sum(k.bk * w.w)) AS r
  FROM test_cells c JOIN base b ON b.feature = c.feature AND b.t = c.t
  JOIN wmodel w ON c.feature = w.feature AND c.t = w.t
  JOIN igcoef k ON k.noun_id = c.noun_id AND k.class_idx = w.class_idx JOIN score1 s ON s.noun_id = c.noun_id
  GROUP BY c.noun_id, c.feature, c.t, c.x)"""

REL["deeplift"] = """
dl_m AS (
  SELECT s.noun_id, s.pred,
         (max(CASE WHEN p.class_idx = s.pred THEN p.z END) - avg(p.z)) - (max(CASE WHEN pb.class_idx = s.pred THEN pb.z END) - avg(pb.z)) AS dzt,
         max(CASE WHEN p.class_idx = s.pred THEN p.p END) - max(CASE WHEN pb.class_idx = s.pred THEN pb.p END) AS dp
  FROM score1 s JOIN p1 p ON p.noun_id = s.noun_id JOIN pbase pb ON pb.class_idx = p.class_idx GROUP BY s.noun_id, s.pred),
dl_mult AS (SELECT noun_id, pred, CASE WHEN dzt <> 0 THEN dp / dzt ELSE 0.0 END AS m FROM dl_m),
rel AS (
  SELECT c.noun_id, c.feature, c.t, c.x, m.m * (w.w - wb.wbar) * (c.x - b.xb) AS r
  FROM test_cells c JOIN dl_mult m ON m.noun_id = c.noun_id
  JOIN wmodel w ON w.feature = c.feature AND w.t = c.t AND w.class_idx = m.pred
  JOIN wbar wb ON wb.feature = c.feature AND wb.t = c.t JOIN base b ON b.feature = c.feature AND b.t = c.t)"""

REL["deepliftshap"] = """
dls_m AS (
  SELECT s.noun_id, s.pred, pb.bid,
         (max(CASE WHEN p.class_idx = s.pred THEN p.z END) - avg(p.z)) - (max(CASE WHEN pb.class_idx = s.pred THEN pb.z END) - avg(pb.z)) AS dzt,
         max(CASE WHEN p.class_idx = s.pred THEN p.p END) - max(CASE WHEN pb.class_idx = s.pred THEN pb.p END) AS dp
  FROM score1 s JOIN p1 p ON p.noun_id = s.noun_id JOIN pbs pb ON pb.class_idx = p.class_idx GROUP BY s.noun_id, s.pred, pb.bid),
dls_mult AS (SELECT noun_id, pred, bid, CASE WHEN dzt <> 0 THEN dp / dzt ELSE 0.0 END AS m FROM dls_m),
rel AS (
  SELECT c.noun_id, c.feature, c.t, c.x, (max(w.w) - max(wb.wbar)) * sum(m.m * (c.x - b.xb)) / max(nb.nb) AS r
  FROM test_cells c JOIN dls_mult m ON m.noun_id = c.noun_id
  JOIN bases b ON b.bid = m.bid AND b.feature = c.feature AND b.t = c.t
  JOIN wmodel w ON w.feature = c.feature AND w.t = c.t AND w.class_idx = m.pred
  JOIN wbar wb ON wb.feature = c.feature AND wb.t = c.t, nbase nb
  GROUP BY c.noun_id, c.feature, c.t, c.x)"""

REL["gradshap"] = f"""
gs_draw AS (SELECT s.noun_id, s.pred, d.s, CAST(floor({u_sql("'gs_b'", 's.noun_id', 'd.s')} * nb.nb) AS BIGINT) AS bid,
                   {u_sql("'gs_a'", 's.noun_id', 'd.s')} AS alpha
            FROM score1 s CROSS JOIN range(5) AS d(s) CROSS JOIN nbase nb),
gs_z AS (SELECT g.noun_id, g.s, g.bid, g.pred, p.class_idx, pb.z + g.alpha * (p.z - pb.z) AS z
         FROM gs_draw g JOIN p1 p ON p.noun_id = g.noun_id JOIN pbs pb ON pb.bid = g.bid AND pb.class_idx = p.class_idx),
gs_zc AS (SELECT *, z - max(z) OVER (PARTITION BY noun_id, s) AS zc FROM gs_z),
gs_p AS (SELECT noun_id, s, bid, pred, class_idx, exp(zc) / sum(exp(zc)) OVER (PARTITION BY noun_id, s) AS p FROM gs_zc),
gs_pc AS (SELECT noun_id, s, p AS pc FROM gs_p WHERE class_idx = pred),
gs_term AS (
  SELECT c.noun_id, c.feature, c.t, c.x, d.s,
         max(pc.pc) * (sum(CASE WHEN w.class_idx = d.pred THEN w.w ELSE 0.0 END) - sum(gp.p * w.w)) * (c.x - max(b.xb)) AS term
  FROM test_cells c JOIN gs_draw d ON d.noun_id = c.noun_id JOIN gs_pc pc ON pc.noun_id = d.noun_id AND pc.s = d.s
  JOIN gs_p gp ON gp.noun_id = d.noun_id AND gp.s = d.s
  JOIN wmodel w ON w.feature = c.feature AND w.t = c.t AND w.class_idx = gp.class_idx
  JOIN bases b ON b.bid = d.bid AND b.feature = c.feature AND b.t = c.t
  GROUP BY c.noun_id, c.feature, c.t, c.x, d.s),
rel AS (SELECT noun_id, feature, t, x, sum(term) / 5 AS r FROM gs_term GROUP BY noun_id, feature, t, x)"""

REL["shapleyvalue"] = f"""
sv_cells AS (
  SELECT c.noun_id, c.feature, c.t, c.x, b.xb, s.pred, pr.perm,
         {key60_sql("'sv'", 'c.noun_id', 'pr.perm', 'c.feature', 'c.t')} AS o
  FROM test_cells c JOIN base b ON b.feature = c.feature AND b.t = c.t JOIN score1 s ON s.noun_id = c.noun_id
  CROSS JOIN range(25) AS pr(perm)),
sv_z AS (
  SELECT v.noun_id, v.perm, v.feature, v.t, v.x, v.pred, v.o, w.class_idx,
         zb.z + sum(w.w * (v.x - v.xb)) OVER (PARTITION BY v.noun_id, v.perm, w.class_idx ORDER BY v.o, v.feature, v.t
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z
  FROM sv_cells v JOIN wmodel w ON w.feature = v.feature AND w.t = v.t JOIN zb ON zb.class_idx = w.class_idx),
sv_zc AS (SELECT *, z - max(z) OVER (PARTITION BY noun_id, perm, feature, t) AS zc FROM sv_z),
sv_p AS (SELECT *, exp(zc) / sum(exp(zc)) OVER (PARTITION BY noun_id, perm, feature, t) AS p FROM sv_zc),
sv_pc AS (SELECT noun_id, perm, feature, t, x, o, pred, p FROM sv_p WHERE class_idx = pred),
sv_m AS (SELECT v.noun_id, v.feature, v.t, v.x,
                v.p - coalesce(lag(v.p) OVER (PARTITION BY v.noun_id, v.perm ORDER BY v.o, v.feature, v.t), pb.p) AS dp
         FROM sv_pc v JOIN pbase pb ON pb.class_idx = v.pred),
rel AS (SELECT noun_id, feature, t, x, sum(dp) / 25 AS r FROM sv_m GROUP BY noun_id, feature, t, x)"""

REL["lrp"] = """
rel AS (
  SELECT c.noun_id, c.feature, c.t, c.x,
         c.x * w.w / (p.z + 1e-9 * CASE WHEN p.z >= 0 THEN 1.0 ELSE -1.0 END) * s.s1 AS r
  FROM test_cells c JOIN score1 s ON s.noun_id = c.noun_id
  JOIN wmodel w ON w.feature = c.feature AND w.t = c.t AND w.class_idx = s.pred
  JOIN p1 p ON p.noun_id = c.noun_id AND p.class_idx = s.pred)"""

def kernelshap_sql(n: int) -> str:
    """Shapley values of n cells from all 2**n coalitions, which KernelSHAP gives if it has them all."""
    weights = ", ".join(f"({k}, {math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)!r})" for k in range(n))
    return f"""
ks_cell AS (SELECT noun_id, feature, t, x, CAST(row_number() OVER (PARTITION BY noun_id ORDER BY feature, t) - 1 AS INTEGER) AS j FROM test_cells),
ks_z AS (SELECT c.noun_id, CAST(s.s AS INTEGER) AS s, w.class_idx, sum(w.w * CASE WHEN (CAST(s.s AS INTEGER) >> c.j) & 1 = 1 THEN c.x ELSE b.xb END) + max(bm.b) AS z
         FROM ks_cell c JOIN base b ON b.feature = c.feature AND b.t = c.t JOIN wmodel w ON w.feature = c.feature AND w.t = c.t
         JOIN bmodel bm ON bm.class_idx = w.class_idx CROSS JOIN range({2 ** n}) AS s(s) GROUP BY 1, 2, 3),
ks_zc AS (SELECT *, z - max(z) OVER (PARTITION BY noun_id, s) AS zc FROM ks_z),
ks_p AS (SELECT noun_id, s, class_idx, exp(zc) / sum(exp(zc)) OVER (PARTITION BY noun_id, s) AS p FROM ks_zc),
ks_v AS (SELECT p.noun_id, p.s, p.p AS v FROM ks_p p JOIN score1 s ON s.noun_id = p.noun_id AND s.pred = p.class_idx),
rel AS (SELECT c.noun_id, c.feature, c.t, c.x, sum((b.v - a.v) * k.k) AS r
        FROM ks_cell c JOIN ks_v a ON a.noun_id = c.noun_id AND (a.s >> c.j) & 1 = 0 JOIN ks_v b ON b.noun_id = a.noun_id AND b.s = a.s + (1 << c.j)
        JOIN (VALUES {weights}) k(n, k) ON k.n = bit_count(a.s) GROUP BY c.noun_id, c.feature, c.t, c.x)"""


REL["kernelshap"] = kernelshap_sql(10)

EXPECTED = {
    "single": "expv AS (SELECT s.noun_id, pb.p AS expected_value FROM score1 s JOIN pbase pb ON pb.class_idx = s.pred)",
    "set": """expv AS (SELECT s.noun_id, m.p AS expected_value FROM score1 s
                     JOIN (SELECT class_idx, avg(p) AS p FROM pbs GROUP BY class_idx) m ON m.class_idx = s.pred)""",
    "none": "expv AS (SELECT noun_id, CAST(NULL AS DOUBLE) AS expected_value FROM score1)",
}
EXPECTED_KIND = {"deepliftshap": "set", "gradshap": "set", "saliency": "none", "lrp": "none",
                 "integrated_gradients": "single", "deeplift": "single", "shapleyvalue": "single", "kernelshap": "single"}


def rel_prelude(method: str, signal: str = "emb", *more: str) -> str:
    return prelude(signal, SPLIT, SCALER, ENCODER, MODEL, BASES, REL[method], *more)


# --- corruption sweep ----------------------------------------------------------------------------

K_VALUES = [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.0]


def grid_values() -> str:
    rows = []
    for mi, mask in enumerate(("top", "bottom")):
        for ki, k in enumerate(K_VALUES):
            q = (1 - k) if mask == "top" else k
            rows.append(f"({mi * 11 + ki}, '{mask}', {k!r}, {q!r})")
    return ", ".join(rows)


def simpson_sql(name: str, src: str, keys: str, order: str, y: str, x: str | None = None) -> str:
    """Two CTEs: {name}_t (terms) and {name} (keys..., simp)."""
    w = f"(PARTITION BY {keys} ORDER BY {order})"
    if x is None:
        term = f"({y} + 4.0 * lead({y}, 1) OVER {w} + lead({y}, 2) OVER {w}) / 3.0"
        trap = f"0.5 * ({y} + lead({y}, 1) OVER {w})"
        extra = ""
    else:
        h0 = f"(lead({x}, 1) OVER {w} - {x})"
        h1 = f"(lead({x}, 2) OVER {w} - lead({x}, 1) OVER {w})"
        extra = f", {h0} AS h0, {h1} AS h1, lead({y}, 1) OVER {w} AS y1, lead({y}, 2) OVER {w} AS y2"
        term = None
        trap = f"0.5 * {h0} * ({y} + lead({y}, 1) OVER {w})"
    if term is None:
        t_cte = f"""{name}_r AS (SELECT {keys}, {y} AS y0, row_number() OVER {w} - 1 AS i,
                    count(*) OVER (PARTITION BY {keys}) AS n, {trap} AS trap{extra} FROM {src}),
{name}_t AS (SELECT {keys}, i, n, trap,
   (h0 + h1) / 6.0 * (y0 * (2.0 - CASE WHEN (CASE WHEN h1 <> 0 THEN h0 / h1 ELSE 0.0 END) <> 0
                                         THEN 1.0 / (CASE WHEN h1 <> 0 THEN h0 / h1 ELSE 0.0 END) ELSE 0.0 END)
                    + y1 * ((h0 + h1) * CASE WHEN h0 * h1 <> 0 THEN (h0 + h1) / (h0 * h1) ELSE 0.0 END)
                    + y2 * (2.0 - CASE WHEN h1 <> 0 THEN h0 / h1 ELSE 0.0 END)) AS term FROM {name}_r)"""
    else:
        t_cte = f"""{name}_t AS (SELECT {keys}, row_number() OVER {w} - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n,
                    {term} AS term, {trap} AS trap FROM {src})"""
    return t_cte + f""",
{name} AS (SELECT {keys}, CASE WHEN max(n) % 2 = 1
      THEN sum(CASE WHEN i % 2 = 0 AND i <= n - 3 THEN term ELSE 0.0 END)
      ELSE (sum(CASE WHEN i % 2 = 0 AND i <= n - 4 THEN term ELSE 0.0 END) + sum(CASE WHEN i = n - 2 THEN trap ELSE 0.0 END)
          + sum(CASE WHEN i % 2 = 1 AND i <= n - 3 THEN term ELSE 0.0 END) + sum(CASE WHEN i = 0 THEN trap ELSE 0.0 END)) / 2.0
      END AS simp FROM {name}_t GROUP BY {keys})"""


def multi_rel(methods) -> str:
    """rel(method, ...) and expv(method, ...) over several methods."""
    parts = []
    for m in methods:
        body = REL[m].replace("\nrel AS (", f"\nrel_{m} AS (")
        parts.append(body)
        parts.append(EXPECTED[EXPECTED_KIND[m]].replace("expv AS (", f"expv_{m} AS (", 1))
    parts.append("rel AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS method, noun_id, feature, t, x, r FROM rel_{m}" for m in methods) + ")")
    parts.append("expv AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS method, noun_id, expected_value FROM expv_{m}" for m in methods) + ")")
    return ",".join(parts)


SWEEP = f"""
kgrid AS (SELECT * FROM (VALUES {grid_values()}) v(g, mask, k, q)),
relr AS (SELECT method, noun_id, feature, t, x, r FROM rel),
stats AS (
  SELECT method, noun_id, min(r) AS min_Rx, max(r) AS max_Rx, avg(r) AS mean_Rx, quantile_cont(r, 0.5) AS median_Rx,
         coalesce(sum(CASE WHEN r < 0 THEN r END), 0.0) AS sum_rel_neg, coalesce(sum(CASE WHEN r >= 0 THEN r END), 0.0) AS sum_rel_pos,
         count(CASE WHEN r >= 0 THEN r END) AS n_nonneg, max(t) + 1 AS n_steps, count(DISTINCT feature) AS n_feat
  FROM relr GROUP BY method, noun_id HAVING count(CASE WHEN r >= 0 THEN r END) > 0),
thr_l AS (SELECT method, noun_id, quantile_cont(r, [{", ".join(repr((1 - k)) for k in K_VALUES)}, {", ".join(repr(k) for k in K_VALUES)}]) AS ql, list(r ORDER BY r) AS rs
          FROM relr WHERE r >= 0 GROUP BY method, noun_id),
thr AS (SELECT l.method, l.noun_id, g.g, l.ql[g.g + 1] AS thr,
               l.rs[CASE WHEN g.g < 11 THEN len(l.rs) - CAST(round(g.k * 100) AS BIGINT) * (len(l.rs) - 1) // 100
                    ELSE CAST(round(g.k * 100) AS BIGINT) * (len(l.rs) - 1) // 100 + 1 END] AS bound FROM thr_l l, kgrid g),
kept AS (
  SELECT r.method, r.noun_id, th.g, r.feature, r.t, r.x, r.r FROM relr r
  JOIN thr th ON r.method = th.method AND r.noun_id = th.noun_id
  WHERE r.r >= 0 AND ((th.g < 11 AND r.r >= th.bound) OR (th.g >= 11 AND r.r <= th.bound))),
runs AS (
  SELECT method, noun_id, g, feature, avg(len) AS mean_run, sum(len) AS n_kept FROM (
    SELECT method, noun_id, g, feature, isl, count(*) AS len FROM (
      SELECT *, t - row_number() OVER (PARTITION BY method, noun_id, g, feature ORDER BY t) AS isl FROM kept)
    GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
{simpson_sql("simp_k", "kept", "method, noun_id, g, feature", "t", "r")},
{simpson_sql("simp_a", "(SELECT * FROM relr WHERE r >= 0)", "method, noun_id, feature", "t", "r")},
fm AS (SELECT ru.method, ru.noun_id, ru.g, ru.feature, ru.n_kept, ru.mean_run, sk.simp / (sa.simp + 1e-12) AS tic
       FROM runs ru JOIN simp_k sk ON ru.method = sk.method AND ru.noun_id = sk.noun_id AND ru.g = sk.g AND ru.feature = sk.feature
       JOIN simp_a sa ON ru.method = sa.method AND ru.noun_id = sa.noun_id AND ru.feature = sa.feature),
sm AS (
  SELECT f.method, f.noun_id, f.g, sum(f.n_kept) / s.n_feat AS mean_n_pts_removed,
         sum(f.n_kept) / (s.n_feat * s.n_steps) AS mean_ratio_pts_removed, sum(f.tic) / s.n_feat AS mean_tic,
         CAST(round_even((sum(greatest(f.mean_run, 1.0)) + (s.n_feat - count(*))) / s.n_feat, 0) AS INTEGER) AS block_size,
         sum(f.n_kept) / (s.n_feat * s.n_steps) AS drop_prob, s.n_feat, s.n_steps
  FROM fm f JOIN stats s ON f.method = s.method AND f.noun_id = s.noun_id
  GROUP BY f.method, f.noun_id, f.g, s.n_feat, s.n_steps),
d2 AS (
  SELECT k.method, k.noun_id, k.g, w.class_idx,
         sum(w.w * ({normal_sql("'corrupt'", 'k.g', 'k.noun_id', 'k.feature', 'k.t')} - k.x)) AS d
  FROM kept k JOIN wmodel w ON w.feature = k.feature AND w.t = k.t GROUP BY 1, 2, 3, 4),
par AS (SELECT method, noun_id, g, drop_prob, block_size, n_steps, n_feat,
               least(greatest(drop_prob / block_size * (n_steps / (n_steps - block_size + 1)) * 1.2, 0.0), 1.0) AS gamma FROM sm),
rb AS (
  SELECT r.method, r.noun_id, p.g, a.a, r.feature, r.t, r.x, p.block_size, p.n_steps,
         {chunk_u_sql("'rb'", 'p.g', 'r.noun_id', 'r.feature', 'r.t', a='a.a')} < p.gamma AS seed
  FROM relr r JOIN par p ON r.method = p.method AND r.noun_id = p.noun_id CROSS JOIN range(26) AS a(a)),
rbm AS (
  SELECT *,
    coalesce(t - max(CASE WHEN seed THEN t END) OVER (PARTITION BY method, noun_id, g, a, feature ORDER BY t
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= floor(block_size / 2), false)
    OR coalesce(min(CASE WHEN seed THEN t END) OVER (PARTITION BY method, noun_id, g, a, feature ORDER BY t
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t <= block_size - 1 - floor(block_size / 2), false) AS m
  FROM rb),
rb_feat AS (
  SELECT method, noun_id, g, a, feature, sum(CASE WHEN m THEN 1 ELSE 0 END) AS nm,
         CASE WHEN max(block_size) % 2 = 0 AND max(CASE WHEN seed THEN t END) >= max(n_steps) - max(block_size) / 2 THEN 1 ELSE 0 END AS extra
  FROM rbm GROUP BY 1, 2, 3, 4, 5),
rb_att AS (
  SELECT f.method, f.noun_id, f.g, f.a, abs(max(p.drop_prob) - (sum(f.nm) + sum(f.extra)) / (max(p.n_feat) * max(p.n_steps))) AS diff
  FROM rb_feat f JOIN par p ON f.method = p.method AND f.noun_id = p.noun_id AND f.g = p.g GROUP BY 1, 2, 3, 4),
rb_pick AS (SELECT method, noun_id, g, coalesce(min(CASE WHEN diff <= 0.05 THEN a END), first(a ORDER BY diff, a)) AS a
            FROM rb_att GROUP BY 1, 2, 3),
d3 AS (
  SELECT m.method, m.noun_id, m.g, w.class_idx,
         sum(w.w * ({normal_sql("'random'", 'm.g', 'm.noun_id', 'm.feature', 'm.t')} - m.x)) AS d
  FROM rbm m JOIN rb_pick k ON m.method = k.method AND m.noun_id = k.noun_id AND m.g = k.g AND m.a = k.a
  JOIN wmodel w ON w.feature = m.feature AND w.t = m.t WHERE m.m GROUP BY 1, 2, 3, 4),
zz AS (
  SELECT s.method, s.noun_id, s.g, p.class_idx, p.z + d2.d AS z2, p.z + coalesce(d3.d, 0.0) AS z3
  FROM sm s JOIN p1 p ON p.noun_id = s.noun_id
  JOIN d2 ON d2.method = s.method AND d2.noun_id = s.noun_id AND d2.g = s.g AND d2.class_idx = p.class_idx
  LEFT JOIN d3 ON d3.method = s.method AND d3.noun_id = s.noun_id AND d3.g = s.g AND d3.class_idx = p.class_idx),
zzc AS (SELECT *, z2 - max(z2) OVER (PARTITION BY method, noun_id, g) AS c2, z3 - max(z3) OVER (PARTITION BY method, noun_id, g) AS c3 FROM zz),
pp AS (SELECT method, noun_id, g, class_idx, exp(c2) / sum(exp(c2)) OVER (PARTITION BY method, noun_id, g) AS p2,
              exp(c3) / sum(exp(c3)) OVER (PARTITION BY method, noun_id, g) AS p3 FROM zzc),
ppa AS (SELECT pp.method, pp.noun_id, pp.g, max(CASE WHEN pp.class_idx = s.pred THEN p2 END) AS s2,
               max(CASE WHEN pp.class_idx = s.pred THEN p3 END) AS s3,
               first(pp.class_idx ORDER BY p2 DESC, pp.class_idx) AS pred2, first(pp.class_idx ORDER BY p3 DESC, pp.class_idx) AS pred3
        FROM pp JOIN score1 s ON s.noun_id = pp.noun_id GROUP BY 1, 2, 3),
results AS (
  SELECT s.method, g.mask, g.k, s.noun_id, e.target AS class_name, st.min_Rx, st.max_Rx, st.mean_Rx, st.median_Rx,
         s.mean_n_pts_removed, s.mean_ratio_pts_removed, s.mean_tic, ev.expected_value AS sample_expected_values,
         st.sum_rel_neg, st.sum_rel_pos, s1.s1 AS score1, a.s2 AS score2, a.s3 AS score3,
         s1.s1 - a.s2 AS delta_score1, s1.s1 - a.s3 AS delta_score2,
         s1.pred = l.class_idx AS initial_classification, a.pred2 = l.class_idx AS modified_classification,
         a.pred3 = l.class_idx AS random_classification,
         (s1.s1 - a.s2) / s1.s1 AS metric_score, (s1.s1 - a.s3) / s1.s1 AS metric_score_random, s.block_size, s.drop_prob
  FROM sm s JOIN kgrid g ON g.g = s.g JOIN ppa a ON a.method = s.method AND a.noun_id = s.noun_id AND a.g = s.g
  JOIN score1 s1 ON s1.noun_id = s.noun_id JOIN stats st ON st.method = s.method AND st.noun_id = s.noun_id
  JOIN labelled l ON l.noun_id = s.noun_id JOIN encoder e ON e.class_idx = s1.pred
  JOIN expv ev ON ev.method = s.method AND ev.noun_id = s.noun_id),
resn AS (
  SELECT r.*, ref.score2 AS score_onlyrel_neg,
         CASE WHEN r.k <> 1.0 THEN least(greatest(
           CASE WHEN r.score1 - ref.score2 <> 0 THEN r.delta_score1 / (r.score1 - ref.score2)
                WHEN r.delta_score1 > 0 THEN 1.0 WHEN r.delta_score1 < 0 THEN 0.0 END, 0.0), 1.0) END AS metric_normalised
  FROM results r LEFT JOIN results ref ON ref.method = r.method AND ref.mask = r.mask AND ref.noun_id = r.noun_id AND ref.k = 1.0)"""


def sweep_prelude(methods, signal: str = "emb", *more: str) -> str:
    return prelude(signal, SPLIT, SCALER, ENCODER, MODEL, BASES, multi_rel(methods), SWEEP, *more)


# --- summaries -----------------------------------------------------------------------------------

_MEANS = ["mean_n_pts_removed", "mean_ratio_pts_removed", "mean_tic", "score1", "delta_score1", "delta_score2",
          "metric_score", "metric_score_random"]
_ACCS = ["initial_classification", "modified_classification", "random_classification"]

SUMMARY = ("\nsumm0 AS (SELECT method, mask, k, " + ", ".join(f"avg({c}) AS {c}" for c in _MEANS)
           + ", avg(metric_normalised) AS metric_normalised, "
           + ", ".join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {c}" for c in _ACCS)
           + " FROM resn GROUP BY method, mask, k),\nsumm AS (SELECT method, mask, k, "
           + ", ".join(c if c != "metric_score" else
                       "CASE WHEN mask = 'bottom' THEN greatest(metric_score, 0.0) ELSE metric_score END AS metric_score"
                       for c in _MEANS)
           + ", metric_normalised, " + ", ".join(_ACCS) + " FROM summ0)")


def _curve_sql(name: str, mask: str, y: str, end_y: str | None, where: str = "") -> str:
    src = f"(SELECT * FROM summ WHERE mask = '{mask}'{where})"
    parts = [f"SELECT method, 0 AS i, 0.0 AS x, 0.0 AS y FROM (SELECT DISTINCT method FROM {src})",
             f"SELECT method, row_number() OVER (PARTITION BY method ORDER BY k) AS i, mean_ratio_pts_removed AS x, {y} AS y FROM {src}"]
    if end_y:
        parts.append(f"SELECT method, count(*) + 1 AS i, 1.0 AS x, arg_max({end_y}, k) AS y FROM {src} GROUP BY method")
    return f"{name} AS (SELECT method, '{name}' AS curve, i, x, y FROM (" + " UNION ALL ".join(parts) + "))"


METRICS = ",\n".join([
    _curve_sql("c_aucse", "top", "metric_score", "metric_score"),
    "c_aucse_f AS (SELECT method, curve, i, x, y FROM (SELECT *, lead(x) OVER (PARTITION BY method, curve ORDER BY i) - x AS gap "
    "FROM c_aucse) WHERE gap IS NULL OR gap >= 0.01)",
    simpson_sql("s_aucse", "c_aucse_f", "method, curve", "i", "y", "x"),
    _curve_sql("c_top", "top", "metric_score", None),
    simpson_sql("s_top", "c_top", "method, curve", "i", "y", "x"),
    _curve_sql("c_bot", "bottom", "metric_score", None),
    simpson_sql("s_bot", "c_bot", "method, curve", "i", "y", "x"),
    _curve_sql("c_rnd", "top", "metric_score_random", "metric_score", " AND method = 'integrated_gradients'"),
    simpson_sql("s_rnd", "c_rnd", "method, curve", "i", "y", "x"),
    """mmetrics AS (
  SELECT a.method, a.simp AS AUCSE_top,
         CASE WHEN t.simp + (1 - b.simp) <> 0 THEN t.simp * (1 - b.simp) / (t.simp + (1 - b.simp)) END AS F_score
  FROM s_aucse a JOIN s_top t ON t.method = a.method JOIN s_bot b ON b.method = a.method
  UNION ALL SELECT 'random' AS method, simp AS AUCSE_top, CAST(NULL AS DOUBLE) AS F_score FROM s_rnd)"""])

MOMENTS = """
mom_m AS (SELECT method, k, avg(metric_score) AS m FROM resn WHERE mask = 'top' AND k <= 0.95 GROUP BY method, k),
mom_c AS (SELECT r.method, r.k, avg(power(r.metric_score - g.m, 2)) AS m2, avg(power(r.metric_score - g.m, 3)) AS m3,
                 avg(power(r.metric_score - g.m, 4)) AS m4
          FROM resn r JOIN mom_m g ON r.method = g.method AND r.k = g.k WHERE r.mask = 'top' GROUP BY r.method, r.k),
mom AS (SELECT method, k, CASE WHEN m2 <> 0 THEN m3 / power(m2, 1.5) END AS skew,
               CASE WHEN m2 <> 0 THEN m4 / (m2 * m2) - 3.0 END AS kurt FROM mom_c),
moments AS (SELECT method, k, skew, kurt,
   CASE WHEN max(skew) OVER () <> min(skew) OVER () THEN (skew - min(skew) OVER ()) / (max(skew) OVER () - min(skew) OVER ()) END AS skew_norm,
   CASE WHEN max(kurt) OVER () <> min(kurt) OVER () THEN (kurt - min(kurt) OVER ()) / (max(kurt) OVER () - min(kurt) OVER ()) END AS kurt_norm
   FROM mom),
aucm AS (SELECT method, 1 - coalesce(sum(sseg), 0.0) AS aucskew, coalesce(sum(kseg), 0.0) AS auckurt FROM (
   SELECT method, (lead(k) OVER w - k) * (skew_norm + lead(skew_norm) OVER w) / 2.0 AS sseg,
                  (lead(k) OVER w - k) * (kurt_norm + lead(kurt_norm) OVER w) / 2.0 AS kseg
   FROM moments WINDOW w AS (PARTITION BY method ORDER BY k)) GROUP BY method),
dauc AS (SELECT method, sum(CASE WHEN mask = 'top' THEN seg ELSE -seg END) AS diff_auc FROM (
   SELECT method, mask, coalesce((lead(mean_ratio_pts_removed) OVER w - mean_ratio_pts_removed)
                                 * (metric_score + lead(metric_score) OVER w) / 2.0, 0.0) AS seg
   FROM summ WINDOW w AS (PARTITION BY method, mask ORDER BY k)) GROUP BY method),
xp0 AS (SELECT d.method, d.diff_auc, a.aucskew, a.auckurt FROM dauc d JOIN aucm a ON a.method = d.method),
xp1 AS (SELECT *,
   CASE WHEN max(diff_auc) OVER () <> min(diff_auc) OVER () THEN (diff_auc - min(diff_auc) OVER ()) / (max(diff_auc) OVER () - min(diff_auc) OVER ()) END AS n_diff,
   CASE WHEN max(aucskew) OVER () <> min(aucskew) OVER () THEN (aucskew - min(aucskew) OVER ()) / (max(aucskew) OVER () - min(aucskew) OVER ()) END AS n_skew,
   CASE WHEN max(auckurt) OVER () <> min(auckurt) OVER () THEN (auckurt - min(auckurt) OVER ()) / (max(auckurt) OVER () - min(auckurt) OVER ()) END AS n_kurt
   FROM xp0),
xp2 AS (SELECT *, 0.5 * n_diff + 0.4 * n_skew + 0.1 * n_kurt AS xpower_raw FROM xp1),
xpow AS (SELECT *, CASE WHEN max(xpower_raw) OVER () <> min(xpower_raw) OVER ()
   THEN (xpower_raw - min(xpower_raw) OVER ()) / (max(xpower_raw) OVER () - min(xpower_raw) OVER ()) END AS xpower FROM xp2)"""


# --- augmentation ------------------------------------------------------------------------------------

def block_mask_sql(src: str, p: float, b: int, factor: float, key: str) -> str:
    """SELECT over `src` (noun_id, feature, t, x) adding m (masked) for a fixed (p, b)."""
    return f"""(SELECT *, coalesce(t - max(CASE WHEN sd THEN t END) OVER (PARTITION BY noun_id, feature ORDER BY t
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {b // 2}, false)
                 OR coalesce(min(CASE WHEN sd THEN t END) OVER (PARTITION BY noun_id, feature ORDER BY t
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t <= {b - 1 - b // 2}, false) AS m
   FROM (SELECT *, {u_sql(repr(key), 'noun_id', 'feature', 't')}
                   < least(greatest({p!r} / {b} * (nT / (nT - {b} + 1)) * {factor!r}, 0.0), 1.0) AS sd
         FROM (SELECT *, max(t) OVER (PARTITION BY noun_id, feature) + 1 AS nT FROM {src})))"""


def enforce_sql(p: float, b: int) -> str:
    """Random block with enforced fraction over `cells`, all 26 draws evaluated (CTE text)."""
    return f"""
eb_par AS (SELECT noun_id, max(t) + 1 AS n_steps, count(DISTINCT feature) AS n_feat,
                  least(greatest({p!r} / {b} * ((max(t) + 1) / ((max(t) + 1) - {b} + 1)) * 1.2, 0.0), 1.0) AS gamma
           FROM cells GROUP BY noun_id),
eb AS (SELECT c.noun_id, a.a, c.feature, c.t, c.x, p.n_steps,
              {chunk_u_sql("'rb'", '0', 'c.noun_id', 'c.feature', 'c.t', a='a.a')} < p.gamma AS sd
       FROM cells c JOIN eb_par p ON c.noun_id = p.noun_id CROSS JOIN range(26) AS a(a)),
ebm AS (SELECT *,
    coalesce(t - max(CASE WHEN sd THEN t END) OVER (PARTITION BY noun_id, a, feature ORDER BY t
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {b // 2}, false)
    OR coalesce(min(CASE WHEN sd THEN t END) OVER (PARTITION BY noun_id, a, feature ORDER BY t
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t <= {b - 1 - b // 2}, false) AS m FROM eb),
eb_feat AS (SELECT noun_id, a, feature, sum(CASE WHEN m THEN 1 ELSE 0 END) AS nm,
                   CASE WHEN {b} % 2 = 0 AND max(CASE WHEN sd THEN t END) >= max(n_steps) - {b} / 2 THEN 1 ELSE 0 END AS extra
            FROM ebm GROUP BY 1, 2, 3),
eb_att AS (SELECT f.noun_id, f.a, abs({p!r} - (sum(f.nm) + sum(f.extra)) / (max(p.n_feat) * max(p.n_steps))) AS diff
           FROM eb_feat f JOIN eb_par p ON f.noun_id = p.noun_id GROUP BY 1, 2),
eb_pick AS (SELECT noun_id, coalesce(min(CASE WHEN diff <= 0.05 THEN a END), first(a ORDER BY diff, a)) AS a FROM eb_att GROUP BY 1),
eb_out AS (SELECT c.noun_id, c.feature, c.t,
                  CASE WHEN m.m THEN {normal_sql("'random'", '0', 'c.noun_id', 'c.feature', 'c.t')} ELSE c.x END AS x
           FROM cells c JOIN eb_pick k ON k.noun_id = c.noun_id
           JOIN ebm m ON m.noun_id = c.noun_id AND m.a = k.a AND m.feature = c.feature AND m.t = c.t)"""


def resize_sql(n: int, crop: str) -> str:
    """Body over `cells` (noun_id, feature, t, x) cropping every sample to n steps."""
    def norm(e):
        return f"least(greatest(CASE WHEN ({e}) < 0 THEN L + ({e}) ELSE ({e}) END, 0), L)"
    if crop == "end":
        lb, ub = "0", norm(str(n))
    elif crop == "start":
        lb, ub = norm(f"L - {n}"), "L"
    else:
        lb = norm(f"CASE WHEN ((L - {n}) % 2 + 2) % 2 <> 0 THEN floor((L - {n}) / 2) + 1 ELSE floor((L - {n}) / 2) END")
        ub = norm(f"L - floor((L - {n}) / 2)")
    return f"""SELECT noun_id, feature, CAST(t - lb AS BIGINT) AS t, round(x, 6) AS x FROM (
  SELECT *, {lb} AS lb, {ub} AS ub FROM (SELECT *, max(t) OVER (PARTITION BY noun_id) + 1 AS L FROM cells)) WHERE t >= lb AND t < ub"""


# --- I11 / I12: block shuffle and RandAugment, with the draws in SQL --------------------------------------------

class Raw(str):
    """An SQL expression where a number may stand."""

    def __repr__(self) -> str:
        return str(self)


def shuffle_walk(name: str, src: str, p: str, b: int = 7) -> str:
    """Recursive CTE `name`(feature, nT, step, src): the order of steps after the blocks of 0 .. step - 1."""
    u_seed, u_perm = u_sql("'shuffle_block'", "feature", "step"), u_sql("'shuffle_perm'", "feature", "step", "j")
    return f"""{name} AS (
  SELECT feature, nT, CAST(0 AS BIGINT) AS step, range(nT) AS src
  FROM (SELECT DISTINCT feature, nT FROM (SELECT feature, max(t) OVER (PARTITION BY noun_id, feature) + 1 AS nT FROM {src}))
  UNION ALL
  SELECT feature, nT, step + 1,
         CASE WHEN {u_seed} < {p} / {b} * (nT / (nT - {b} + 1)) * 1.1
              THEN src[1:step] || list_transform(list_sort(list_transform(range(least({b}, nT - step)), lambda j: {{'k': {u_perm}, 'j': j}})), lambda s: src[step + s.j + 1]) || src[step + {b} + 1:]
              ELSE src END
  FROM {name} WHERE step < nT)"""


def shuffled(name: str, src: str) -> str:
    """SELECT of `src` with its steps in the final order of the walk `name`."""
    return f"""(SELECT c.noun_id, c.feature, m.t, c.x FROM (SELECT feature, nT, unnest(src) AS s, generate_subscripts(src, 1) - 1 AS t FROM {name} WHERE step = nT) m
   JOIN (SELECT *, max(t) OVER (PARTITION BY noun_id, feature) + 1 AS nT FROM {src}) c ON c.feature = m.feature AND c.nT = m.nT AND c.t = m.s)"""


# fixed values: operations in order, with the ends of their magnitude grid (none: no magnitude)
AUGMENT_SPACE = [("Identity", None, None), ("Jitter", 0.0, 0.8), ("Scaling", 0.0, 0.5), ("Flip_Y", None, None), ("Window_slice", 1.0, 0.4),
                 ("Drop_block", 0.0, 0.8), ("Random_block", 0.0, 0.8), ("Permute_block", 0.0, 0.8), ("Shuffle_block", 0.0, 0.8)]


def augment_stage(src: str, out: str, epoch: int, nth: int = 0, ops: tuple[str, ...] | None = None, magnitude: int = 3) -> str:
    """CTEs that apply the operation that SQL draws for (epoch, nth) to `src` and end in `out`."""
    space = [o for o in AUGMENT_SPACE if ops is None or o[0] in ops]
    key = ["'randaugment'", str(epoch)] + ([str(nth)] if nth else [])
    bound = int(epoch / 25 * magnitude) if epoch < 15 else magnitude
    rows = ", ".join(f"({i}, '{n}', {lo or 0.0}, {hi or 0.0})" for i, (n, lo, hi) in enumerate(space))
    m = Raw(f"(SELECT m FROM {out}_op)")
    normal3, flat = normal_sql("'jitter'", "s.noun_id", "s.feature", "s.t"), ("noun_id", "feature", "t")

    def mask(kind, factor):
        return f"{out}_{kind} AS " + block_mask_sql(src, m, 7, factor, kind)

    on = " AND ".join(f"%s.{c} = s.{c}" for c in flat)
    return f"""{out}_op AS (SELECT name, lo + {u_sql(*key, "'mag'")} * (hi - lo) * {bound} / 10.0 AS m FROM (VALUES {rows}) v(i, name, lo, hi) WHERE i = CAST(floor({u_sql(*key, "'op'")} * {len(space)}) AS INTEGER)),
{mask("drop_block", 1.1)}, {mask("random_block", 1.1)}, {mask("permute_block", 1.2)},
{out}_pm AS (SELECT noun_id, feature, row_number() OVER (PARTITION BY noun_id, feature ORDER BY {u_sql("'permute'", 'noun_id', 'feature', 't')}, t, x) - 1 AS t, x FROM {src}),
{out}_sl AS (SELECT i.noun_id, i.feature, i.t, c.x FROM (
    SELECT noun_id, feature, t, CASE WHEN L >= nT THEN t ELSE CAST(floor({u_sql("'window_slice'")} * (nT - L)) AS BIGINT) + CAST(floor(t * L / nT) AS BIGINT) END AS f
    FROM (SELECT noun_id, feature, nT, CAST(ceil(0.8 * nT) AS BIGINT) AS L, unnest(range(nT)) AS t FROM (SELECT noun_id, feature, max(t) + 1 AS nT FROM {src} GROUP BY 1, 2))) i
    JOIN {src} c ON c.noun_id = i.noun_id AND c.feature = i.feature AND c.t = i.f),
{shuffle_walk(out + "_walk", src, m)},
{out}_sh AS {shuffled(out + "_walk", src)},
{out} AS (SELECT s.noun_id, s.feature, s.t, CASE (SELECT name FROM {out}_op)
    WHEN 'Identity' THEN s.x
    WHEN 'Jitter' THEN s.x + {normal3} * s.sd * {m}
    WHEN 'Scaling' THEN s.x * (1.0 + {m} * {normal_sql("'scaling'", 's.noun_id', 's.feature')})
    WHEN 'Flip_Y' THEN s.x * CASE WHEN {u_sql("'flip'", 's.noun_id', 's.feature')} < 0.5 THEN -1.0 ELSE 1.0 END
    WHEN 'Window_slice' THEN sl.x
    WHEN 'Drop_block' THEN CASE WHEN db.m THEN 0.0 ELSE s.x END
    WHEN 'Random_block' THEN CASE WHEN rb.m THEN {normal_sql("'random_block_n'", 's.noun_id', 's.feature', 's.t')} ELSE s.x END
    WHEN 'Permute_block' THEN CASE WHEN pb.m THEN pm.x ELSE s.x END
    WHEN 'Shuffle_block' THEN sh.x END AS x
  FROM (SELECT *, stddev_samp(x) OVER (PARTITION BY noun_id, feature) AS sd FROM {src}) s
  JOIN {out}_sl sl ON {on % (("sl",) * 3)} JOIN {out}_drop_block db ON {on % (("db",) * 3)} JOIN {out}_random_block rb ON {on % (("rb",) * 3)}
  JOIN {out}_permute_block pb ON {on % (("pb",) * 3)} JOIN {out}_pm pm ON {on % (("pm",) * 3)} JOIN {out}_sh sh ON {on % (("sh",) * 3)})"""
