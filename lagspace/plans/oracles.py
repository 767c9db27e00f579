"""SQL of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators import ccm
from . import queries as q

USERS = "u AS MATERIALIZED (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS t, value AS x, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
HOURS = "h AS MATERIALIZED (SELECT count(*) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) - 1 AS t, x, count(*) OVER () AS n FROM (SELECT date_trunc('hour', ts) AS b, avg(value) AS x FROM events GROUP BY 1))"
DAYS = """r AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM orders GROUP BY 1),
s AS MATERIALIZED (SELECT count(*) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS t, x / 1e6 AS x, y / 1e6 AS y FROM r JOIN o USING (day))"""
RHO = "CASE WHEN stddev_pop({p}) * stddev_pop({o}) > 0 THEN covar_pop({p}, {o}) / (stddev_pop({p}) * stddev_pop({o})) ELSE 0 END"


def rounded(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


def halves(base: str, source: str, keys: str = "", targets: int = 1, dims: int = 2) -> str:
    """lib and qry: embeddings with the next values as targets."""
    over = f"OVER ({f'PARTITION BY {keys} ' if keys else ''}ORDER BY t)"
    k = f"{keys}, " if keys else ""
    lags = ", ".join(f"lag(x, {i}) {over} AS x{i}" for i in range(1, dims))
    leads = ", ".join(f"lead(x, {i + 1}) {over} AS y{i}" for i in range(targets))
    return f"""{base},
e AS (SELECT {k}t, n, x AS x0, {lags}, {leads} FROM {source}),
f AS (SELECT * FROM e WHERE t >= {dims - 1} AND y{targets - 1} IS NOT NULL),
lib AS (SELECT * FROM f WHERE t < floor(n * 0.5)),
qry AS (SELECT * FROM f WHERE t >= floor(n * 0.5))"""


def paired(keys: Sequence[str] = (), coords: int = 2, targets: int = 1, lib: str = "lib", qry: str = "qry", where: str = "TRUE", keep: str = "", slot: str = "0") -> str:
    """pairs: all queries with all library points of their key."""
    on = " AND ".join(f"q.{c} = l.{c}" for c in keys) or "TRUE"
    d = " + ".join(f"(q.x{i} - l.x{i}) * (q.x{i} - l.x{i})" for i in range(coords))
    ks = "".join(f"q.{c}, " for c in keys)
    return f"""pairs AS (SELECT {ks}q.t AS qt, l.t AS lt, {slot} AS slot, sqrt({d}) AS d, {", ".join(f"q.x{i} AS qx{i}, l.x{i} AS lx{i}" for i in range(coords))}{"".join(f", l.y{i} AS y{i}" for i in range(targets))}{keep} FROM {qry} q JOIN {lib} l ON {on} WHERE {where})"""


def near(k: int, keys: Sequence[str] = (), targets: int = 1, keep: Sequence[str] = ()) -> str:
    """p: simplex forecasts from pairs."""
    ks = "".join(f"{c}, " for c in keys)
    preds = ", ".join(f"sum(w * y{i}) / sum(w) AS pred{i}" for i in range(targets))
    return f"""rk AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY {ks}qt ORDER BY d, lt, slot) <= {k}),
wt AS (SELECT *, exp(-d / greatest(min(d) OVER (PARTITION BY {ks}qt), 1e-6)) AS w FROM rk),
p AS (SELECT {ks}qt AS t, {preds}{"".join(f", any_value({c}) AS {c}" for c in keep)} FROM wt GROUP BY {ks}qt HAVING count(*) = {k})"""


def local(theta: str, coords: int, keys: Sequence[str] = (), keep: Sequence[str] = (), alpha: float = 1e-10, extra: str = "") -> str:
    """p: S-Map forecasts from pairs, by Cramer's rule."""
    ks = "".join(f"{c}, " for c in keys)
    a = ["1.0", *[f"lx{i}" for i in range(coords)]]
    n = coords + 1
    sums = [f"sum(w * {a[i]} * {a[j]}) AS m{i}{j}" for i in range(n) for j in range(i, n)] + [f"sum(w * {a[i]} * y0) AS v{i}" for i in range(n)]
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    cell = lambda i, j: f"({m(i, j)} + rr)" if i == j and i else m(i, j)
    full = [[cell(i, j) for j in range(n)] for i in range(n)]

    def det(r):
        if len(r) == 2:
            return f"({r[0][0]} * {r[1][1]} - {r[0][1]} * {r[1][0]})"
        return "(" + " ".join(f"{'-' if c % 2 else '+'} {r[0][c]} * {det([row[:c] + row[c + 1 :] for row in r[1:]])}" for c in range(len(r))) + ")"

    cs = [f"{det([[f'v{i}' if j == c else full[i][j] for j in range(n)] for i in range(n)])} / {det(full)}" for c in range(n)]
    pred = " + ".join([cs[0], *[f"({cs[c]}) * qx{c - 1}" for c in range(1, n)]])
    return f"""md AS (SELECT *, avg(d) OVER (PARTITION BY {ks}qt) AS dbar FROM pairs),
wt AS (SELECT md.*{extra and ', theta'}, exp(-{theta} * d / greatest(dbar, 1e-6)) AS w FROM md{extra}),
mo AS (SELECT {ks}qt{extra and ', theta'}, {", ".join(f"any_value(qx{i}) AS qx{i}" for i in range(coords))}{"".join(f", any_value({c}) AS {c}" for c in keep)}, {", ".join(sums)} FROM wt GROUP BY {ks}qt{extra and ', theta'} HAVING count(*) >= {n}),
rg AS (SELECT *, {alpha} * greatest({" + ".join(m(i, i) for i in range(n))}, 1e-12) AS rr FROM mo),
p AS (SELECT {ks}qt AS t{extra and ', theta'}{"".join(f", {c}" for c in keep)}, {pred} AS pred0 FROM rg)"""


def scan(base: str, source: str, es: Sequence[int], taus: Sequence[int], train: str, val: str, metric: str, grows: bool = False, key: str = "", target: str = "x") -> str:
    """sc: scores of a grid. train and val: sizes, as expressions of n."""
    deep = (max(es) - 1) * max(taus)
    k = f"{key}, " if key else ""
    over = f"OVER ({f'PARTITION BY {key} ' if key else ''}ORDER BY t)"
    lags = ", ".join(f"lag(x, {j}) {over}" if j else "x" for j in range(deep + 1))
    begin = "0" if grows else "vs - tr"
    sq = " + ".join(f"CASE WHEN E > {j} THEN (ql[{j} * tau + 1] - ll[{j} * tau + 1]) * (ql[{j} * tau + 1] - ll[{j} * tau + 1]) ELSE 0.0 END" for j in range(max(es)))
    return f"""{base},
lg AS (SELECT {k}t, n, {target} AS y, [{lags}] AS l FROM {source}),
g0 AS (SELECT n, E, tau, (E - 1) * {max(taus)} AS ml, {train} AS tr, {val} AS va FROM (SELECT DISTINCT n FROM {source}), (VALUES {", ".join(f"({e})" for e in es)}) a(E), (VALUES {", ".join(f"({x})" for x in taus)}) b(tau)),
g AS (SELECT *, tr + fold * va AS vs FROM (SELECT *, unnest(generate_series(0, n)) AS fold FROM g0 WHERE n - ml >= 2 AND tr >= E + 1) WHERE tr + fold * va + va <= n - ml),
li AS (SELECT {k}E, tau, fold, t AS lt, y, l AS ll FROM lg JOIN g USING (n) WHERE t - ml >= {begin} AND t - ml < vs),
qy AS (SELECT {k}E, tau, fold, t AS qt, y AS truth, l AS ql FROM lg JOIN g USING (n) WHERE t - ml >= vs AND t - ml < vs + va),
pr AS (SELECT {k}E, tau, fold, qt, lt, y, truth, sqrt({sq}) AS d FROM qy JOIN li USING ({k}E, tau, fold)),
rk AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY {k}E, tau, fold, qt ORDER BY d, lt) <= E + 1),
wt AS (SELECT *, exp(-d / greatest(min(d) OVER (PARTITION BY {k}E, tau, fold, qt), 1e-6)) AS w FROM rk),
pd AS (SELECT {k}E, tau, fold, qt, sum(w * y) / sum(w) AS pred, any_value(truth) AS obs FROM wt GROUP BY ALL),
sc AS (SELECT {k}E, tau, fold, {metric} AS score FROM pd GROUP BY ALL)"""


def _scan_hour(es=q.E_GRID, taus=q.TAU_GRID) -> str:
    return scan(HOURS, "h", es, taus, "greatest(n // 5, 2)", "greatest(n // 10, 1)", RHO.format(p="pred", o="obs"))


def _drawn() -> str:
    import numpy as np

    sample, members, rows = ccm.sampler(q.SEED), np.asarray(list(q.POOL)), []
    for size in q.LIB_SIZES:
        for k in range(q.N_SAMPLES):
            rows += [f"({size},{k},{i},{int(v)})" for i, v in enumerate(sample(members, size))]
    return f"dr(lib_size, sample, slot, idx) AS (VALUES {', '.join(rows)})"


def _samples(effect: str = "y", cause: str = "x", smap: bool = False, permuted: bool = False) -> str:
    """bs: rho of every sample of the whole series; members are drawn by arithmetic on the slot."""
    src = "s1 AS (SELECT * FROM s)"
    if permuted:
        src = f"s1 AS (SELECT a.t, a.{effect}, b.{cause} FROM s a CROSS JOIN m JOIN s b ON b.t = (a.t * {q.PRIME} + 13) % m.n)"
    head = f"""{DAYS}, m AS (SELECT count(*) AS n, count(*) // 2 - 1 AS p FROM s), {src},
z AS (SELECT p, j, greatest(p >> CAST(3 - j AS INTEGER), 1) AS lib_size, k AS sample FROM m, range(4) a(j), range({q.N_SAMPLES}) b(k)),
dw AS (SELECT *, unnest(range(lib_size)) AS slot FROM z),
dr AS (SELECT lib_size, sample, slot, 1 + ((slot * slot * 7919 + slot * 31 + (j * {q.N_SAMPLES} + sample) * 104729) % {q.PRIME}) % p AS idx FROM dw),
e AS (SELECT t, {effect} AS x0, lag({effect}) OVER (ORDER BY t) AS x1, {cause} AS y0 FROM s1),
f AS (SELECT * FROM e WHERE t >= 1),
lib AS (SELECT lib_size, sample, slot, f.* FROM dr JOIN f ON idx = t),
qry AS (SELECT z.lib_size, z.sample, f.t, x0, x1, y0 AS truth FROM f, m, z WHERE t >= m.n // 2)"""
    by = ("lib_size", "sample")
    body = local("2.0", 2, by, ["truth"]) if smap else near(3, by, keep=["truth"])
    return f"""{head}, {paired(by, keep=", q.truth", slot="l.slot")}, {body},
bs AS (SELECT lib_size, sample, {RHO.format(p="pred0", o="truth")} AS rho FROM p GROUP BY ALL)"""


def _metric(select: str) -> str:
    return f"""WITH {halves(USERS, "u", "user_id", 2)}, {paired(("user_id",), targets=2, keep=", q.y0 AS o0, q.y1 AS o1")}, {near(3, ("user_id",), 2, ["o0", "o1"])},
lo AS (SELECT user_id, t, 0 AS dim, pred0 AS pred, o0 AS obs FROM p UNION ALL SELECT user_id, t, 1, pred1, o1 FROM p),
rh AS (SELECT user_id, dim, {RHO.format(p="pred", o="obs")} AS rho FROM lo GROUP BY ALL)
{select}"""


def _folds(body: str) -> str:
    return f"WITH {HOURS}, m AS (SELECT CAST(count(*) AS BIGINT) AS n FROM h) {body}"


AHEAD = f"{HOURS}, ah AS (SELECT t, n - 1 AS n, x, lead(x) OVER (ORDER BY t) AS y0 FROM h QUALIFY y0 IS NOT NULL)"
MIXED = f"{HOURS}, mx AS (SELECT a.t, a.n, b.x FROM h a JOIN h b ON b.t = (a.t * {q.PRIME} + 13) % a.n)"
_D2 = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))"
_UK = ("user_id",)
_PENDULUM = """w AS (SELECT 0 AS t, 1.0::DOUBLE AS a, 0.5::DOUBLE AS b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v UNION ALL
SELECT t + 1, a + 0.01::DOUBLE * u, b + 0.01::DOUBLE * v,
u + 0.01::DOUBLE * ((-9.81::DOUBLE * 3 * sin(a) - 9.81::DOUBLE * sin(a - 2 * b) - 2 * sin(a - b) * (v * v + u * u * cos(a - b))) / (3 - cos(2 * (a - b)))),
v + 0.01::DOUBLE * ((2 * sin(a - b) * (u * u * 2 + 9.81::DOUBLE * 2 * cos(a) + v * v * cos(a - b))) / (3 - cos(2 * (a - b))))
FROM w WHERE t < 199)"""

ORACLES: dict[str, str] = {
    "embed_user": f"WITH {USERS}, e AS (SELECT user_id, t, x AS x0, lag(x, 2) OVER w AS x1, lag(x, 4) OVER w AS x2, lead(x) OVER w AS y0 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT * FROM e WHERE t >= 4",
    "embed_multivariate": f"WITH {DAYS}, e AS (SELECT t, x AS x0, lag(x) OVER w AS x1, y AS x2, lag(y, 2) OVER w AS x3 FROM s WINDOW w AS (ORDER BY t)) SELECT t, {', '.join(f'round(x{i}, 8) AS x{i}' for i in range(4))} FROM e WHERE t >= 2",
    "knn_user": f"WITH {halves(USERS, 'u', 'user_id')}, {paired(_UK)} SELECT user_id, qt, row_number() OVER (PARTITION BY user_id, qt ORDER BY d, lt) AS rank, lt, {rounded('d', 'd')} FROM pairs QUALIFY rank <= 3",
    "knn_vectors": f"WITH z AS (SELECT a.vec_id AS qt, b.vec_id AS lt, sqrt({_D2}) AS dd FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0) SELECT qt, row_number() OVER (PARTITION BY qt ORDER BY dd, lt) AS rank, lt, {rounded('dd', 'd')} FROM z QUALIFY rank <= 5",
    "simplex_user": f"WITH {halves(USERS, 'u', 'user_id')}, {paired(_UK, keep=', q.y0 AS truth')}, {near(3, _UK, keep=['truth'])} SELECT user_id, t, {rounded('pred0', 'pred')}, truth FROM p",
    "simplex_hour": f"WITH {halves(HOURS, 'h')}, {paired(keep=', q.y0 AS truth')}, {near(3, keep=['truth'])} SELECT t, {rounded('pred0', 'pred')}, {rounded('truth', 'truth')} FROM p",
    "simplex_multi_target": f"WITH {halves(USERS, 'u', 'user_id', 2)}, {paired(_UK, targets=2)}, {near(3, _UK, 2)} SELECT user_id, t, {rounded('pred0', 'pred0')}, {rounded('pred1', 'pred1')} FROM p",
    "simplex_masked": f"WITH {halves(USERS, 'u', 'user_id')}, {paired(_UK, where='l.t % 3 <> 0')}, {near(3, _UK)} SELECT user_id, t, {rounded('pred0', 'pred')} FROM p",
    "loo_user": f"""WITH {USERS}, e AS (SELECT user_id, t, x AS x0, lag(x) OVER w AS x1, lead(x) OVER w AS y0 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t)),
f AS (SELECT * FROM e WHERE t >= 1 AND y0 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY user_id) >= 6), {paired(_UK, lib='f', qry='f', where='abs(q.t - l.t) > 1')}, {near(3, _UK)} SELECT user_id, t, {rounded('pred0', 'pred')} FROM p""",
    "loo_hour": f"""WITH {HOURS}, e AS (SELECT t, x AS x0, lag(x) OVER w AS x1, lead(x) OVER w AS y0 FROM h WINDOW w AS (ORDER BY t)),
f AS (SELECT * FROM e WHERE t >= 1 AND y0 IS NOT NULL), {paired(lib='f', qry='f', where='abs(q.t - l.t) > 1')}, {near(3)} SELECT t, {rounded('pred0', 'pred')} FROM p""",
    "loo_diagnostic_user": f"""WITH {USERS}, e AS (SELECT user_id, t, x AS x0, lag(x) OVER w AS x1, lead(x) OVER w AS y0 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t)),
f AS (SELECT * FROM e WHERE t >= 1 AND y0 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY user_id) >= 6), {paired(_UK, lib='f', qry='f', where='abs(q.t - l.t) > 1', keep=', q.y0 AS truth')}, {near(3, _UK, keep=['truth'])} SELECT user_id, {rounded(RHO.format(p='pred0', o='truth'), 'rho')} FROM p GROUP BY user_id""",
    "smap_linear_hour": f"WITH {halves(HOURS, 'h')}, {paired(coords=1)}, {local('0.0', 1)} SELECT t, {rounded('pred0', 'pred')} FROM p",
    "smap_local_e1": f"WITH {halves(HOURS, 'h')}, {paired(coords=1)}, {local('2.0', 1)} SELECT t, {rounded('pred0', 'pred')} FROM p",
    "smap_local_e2": f"WITH {halves(HOURS, 'h')}, {paired()}, {local('2.0', 2)} SELECT t, {rounded('pred0', 'pred')} FROM p",
    "smap_local_e3": f"WITH {halves(HOURS, 'h', dims=3)}, {paired(coords=3)}, {local('2.0', 3)} SELECT t, {rounded('pred0', 'pred')} FROM p",
    "nonlinearity_hour": f"""WITH {HOURS}, e AS (SELECT t, n, x AS x0, lag(x) OVER w AS x1, lead(x) OVER w AS y0 FROM h WINDOW w AS (ORDER BY t)),
f AS (SELECT * FROM e WHERE t >= 1 AND y0 IS NOT NULL), lib AS (SELECT * FROM f WHERE t < floor(n * 0.7::DOUBLE) - 1), qry AS (SELECT * FROM f WHERE t >= floor(n * 0.7::DOUBLE)),
{paired(keep=', q.y0 AS truth')}, {local('theta', 2, keep=['truth'], extra=', (VALUES ' + ', '.join(f'({v}::DOUBLE)' for v in q.THETAS) + ') th(theta)')} SELECT theta, {rounded(RHO.format(p='pred0', o='truth'), 'rho')} FROM p GROUP BY theta""",
    "smap_theta_sweep": f"WITH {halves(HOURS, 'h')}, {paired(coords=1, keep=', q.y0 AS truth')}, {local('theta', 1, keep=['truth'], extra=', (VALUES ' + ', '.join(f'({v}::DOUBLE)' for v in q.THETAS) + ') th(theta)')} SELECT theta, {rounded(RHO.format(p='pred0', o='truth'), 'rho')} FROM p GROUP BY theta",
    "metric_rhos": _metric(f"SELECT user_id, CAST(dim AS BIGINT) AS dim, {rounded('rho', 'rho')} FROM rh"),
    "metric_mean_rho": _metric(f"SELECT user_id, {rounded('avg(rho)', 'mean_rho')} FROM rh GROUP BY user_id"),
    "metric_rmse": _metric(f"SELECT user_id, {rounded('sqrt(avg((pred - obs) * (pred - obs)))', 'rmse')} FROM lo GROUP BY user_id"),
    "metric_mae": _metric(f"SELECT user_id, {rounded('avg(abs(pred - obs))', 'mae')} FROM lo GROUP BY user_id"),
    "fold_temporal": _folds("SELECT CAST(0 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS train_start, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS train_end, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + 3 AS val_start, n AS val_end FROM m"),
    "fold_expanding": _folds("SELECT i AS fold, CAST(0 AS BIGINT) AS train_start, 100 + 30 * i AS train_end, 102 + 30 * i AS val_start, 142 + 30 * i AS val_end FROM (SELECT n, unnest(generate_series(0::BIGINT, n)) AS i FROM m) WHERE 142 + 30 * i <= n"),
    "fold_sliding": _folds("SELECT i AS fold, 40 * i AS train_start, 100 + 40 * i AS train_end, 102 + 40 * i AS val_start, 142 + 40 * i AS val_end FROM (SELECT n, unnest(generate_series(0::BIGINT, n)) AS i FROM m) WHERE 142 + 40 * i <= n"),
    "scan_hour": f"WITH {_scan_hour()} SELECT CAST(E AS BIGINT) AS E, CAST(tau AS BIGINT) AS tau, CAST(fold AS BIGINT) AS fold, {rounded('score', 'score')} FROM sc",
    "scan_user": f"WITH {scan(USERS, 'u', [1, 2], [1], '20', '10', RHO.format(p='pred', o='obs'), key='user_id')} SELECT user_id, CAST(E AS BIGINT) AS E, CAST(tau AS BIGINT) AS tau, CAST(fold AS BIGINT) AS fold, {rounded('score', 'score')} FROM sc",
    "scan_expanding_rmse": f"WITH {scan(HOURS, 'h', q.E_GRID, q.TAU_GRID, '200', '100', 'sqrt(avg((pred - obs) * (pred - obs)))', grows=True)} SELECT CAST(E AS BIGINT) AS E, CAST(tau AS BIGINT) AS tau, CAST(fold AS BIGINT) AS fold, {rounded('score', 'score')} FROM sc",
    "select_hour": f"WITH {_scan_hour()}, a AS (SELECT E, tau, avg(score) AS mean, avg(score) - coalesce(stddev_samp(score) / sqrt(count(*)), 0) AS adj FROM sc GROUP BY E, tau) SELECT CAST(E AS BIGINT) AS E, CAST(tau AS BIGINT) AS tau, {rounded('mean', 'mean')} FROM a ORDER BY round(adj, 9) DESC, E, tau LIMIT 1",
    "e_curve": f"WITH {_scan_hour(taus=[1])} SELECT CAST(E AS BIGINT) AS E, {rounded('avg(score)', 'mean')}, {rounded('avg(score) - coalesce(stddev_samp(score) / sqrt(count(*)), 0)', 'adjusted')}, count(*) AS n FROM sc GROUP BY E",
    "dimension_curve_hour": f"WITH {scan(AHEAD, 'ah', q.E_GRID, [1], 'greatest(n // 5, 2)', 'greatest(n // 10, 1)', RHO.format(p='pred', o='obs'), target='y0')} SELECT CAST(E AS BIGINT) AS E, {rounded('avg(score)', 'mean')}, {rounded('avg(score) - coalesce(stddev_samp(score) / sqrt(count(*)), 0)', 'adjusted')} FROM sc GROUP BY E",
    "expanding_errors_hour": f"WITH {scan(AHEAD, 'ah', q.E_GRID, q.TAU_GRID, '200', '100', 'sqrt(avg((pred - obs) * (pred - obs)))', grows=True, target='y0')} SELECT CAST(E AS BIGINT) AS E, CAST(tau AS BIGINT) AS tau, {rounded('avg(score)', 'mean')} FROM sc GROUP BY E, tau",
    "noise_floor_hour": f"WITH {scan(MIXED, 'mx', q.E_GRID, q.TAU_GRID, 'greatest(n // 5, 2)', 'greatest(n // 10, 1)', RHO.format(p='pred', o='obs'))} SELECT CAST(E AS BIGINT) AS E, CAST(tau AS BIGINT) AS tau, {rounded('avg(score)', 'mean')} FROM sc GROUP BY E, tau",
    "lag_range_hour": f"WITH {HOURS}, c AS (SELECT t, x - avg(x) OVER () AS c, n, var_pop(x) OVER () AS v FROM h), f AS (SELECT b.t - a.t AS lag, sum(a.c * b.c) / any_value(a.n * a.v) AS acf FROM c a JOIN c b ON b.t - a.t BETWEEN 0 AND 47 GROUP BY 1) SELECT CAST(unnest(generate_series(1, greatest(1, (SELECT coalesce(min(lag), 0) FROM f WHERE acf < exp(-1))))) AS BIGINT) AS lag",
    "ccm_draws": f"WITH {_drawn()} SELECT CAST(lib_size AS BIGINT) AS lib_size, CAST(sample AS BIGINT) AS sample, CAST(slot AS BIGINT) AS slot, CAST(idx AS BIGINT) AS idx FROM dr",
    "ccm_bootstrap": f"WITH {_samples()} SELECT CAST(lib_size AS BIGINT) AS lib_size, CAST(sample AS BIGINT) AS sample, {rounded('rho', 'rho')} FROM bs",
    "ccm_mean": f"WITH {_samples()} SELECT CAST(lib_size AS BIGINT) AS lib_size, {rounded('avg(rho)', 'rho')} FROM bs GROUP BY lib_size",
    "ccm_reverse": f"WITH {_samples('x', 'y')} SELECT CAST(lib_size AS BIGINT) AS lib_size, {rounded('avg(rho)', 'rho')} FROM bs GROUP BY lib_size",
    "ccm_bands": f"WITH {_samples()} SELECT CAST(lib_size AS BIGINT) AS lib_size, {rounded('quantile_cont(rho, 0.05)', 'low')}, {rounded('quantile_cont(rho, 0.5)', 'median')}, {rounded('quantile_cont(rho, 0.95)', 'high')} FROM bs GROUP BY lib_size",
    "ccm_smap": f"WITH {_samples(smap=True)} SELECT CAST(lib_size AS BIGINT) AS lib_size, {rounded('avg(rho)', 'rho')} FROM bs GROUP BY lib_size",
    "ccm_surrogate": f"WITH {_samples(permuted=True)} SELECT CAST(lib_size AS BIGINT) AS lib_size, {rounded('median(rho)', 'rho')} FROM bs GROUP BY lib_size",
    "acf_hour": f"WITH {HOURS}, c AS (SELECT t, x - avg(x) OVER () AS c, n, var_pop(x) OVER () AS v FROM h) SELECT b.t - a.t AS lag, {rounded('sum(a.c * b.c) / any_value(a.n * a.v)', 'acf')} FROM c a JOIN c b ON b.t - a.t BETWEEN 0 AND 47 GROUP BY 1",
    "acf_user": f"WITH {USERS}, c AS (SELECT user_id, t, x - avg(x) OVER w AS c, n, var_pop(x) OVER w AS v FROM u WINDOW w AS (PARTITION BY user_id)) SELECT a.user_id, b.t - a.t AS lag, {rounded('sum(a.c * b.c) / any_value(a.n * a.v)', 'acf')} FROM c a JOIN c b ON a.user_id = b.user_id AND b.t - a.t BETWEEN 0 AND 9 AND (b.t - a.t) % 2 = 0 GROUP BY 1, 2",
    "tau_first_below": f"WITH {USERS}, c AS (SELECT user_id, t, x - avg(x) OVER w AS c, n, var_pop(x) OVER w AS v FROM u WINDOW w AS (PARTITION BY user_id)), f AS (SELECT a.user_id, b.t - a.t AS lag, sum(a.c * b.c) / any_value(a.n * a.v) AS acf FROM c a JOIN c b ON a.user_id = b.user_id AND b.t - a.t BETWEEN 0 AND 19 GROUP BY 1, 2) SELECT user_id, CAST(coalesce(min(CASE WHEN acf < exp(-1) THEN lag END), 0) AS BIGINT) AS tau FROM f GROUP BY user_id",
    "pairwise_vectors": f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, {rounded(_D2, 'd2')} FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0",
    "pairwise_self": f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, {rounded(_D2, 'd2')} FROM embeddings a CROSS JOIN embeddings b",
    "dtw_users": f"""WITH RECURSIVE {USERS}, g AS (SELECT user_id, list(x ORDER BY t) AS a FROM u GROUP BY user_id),
z AS (SELECT x.user_id, x.a, y.a AS b FROM g x JOIN g y ON y.user_id = x.user_id + 1),
r AS (SELECT user_id, 0 AS i, list_prepend(0.0::DOUBLE, list_transform(b, lambda e: 'inf'::DOUBLE)) AS v FROM z UNION ALL
SELECT r.user_id, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::DOUBLE]), lambda acc, j: list_append(acc, abs(a[i + 1] - b[j[1]::BIGINT]) + least(acc[j[1]::BIGINT], v[j[1]::BIGINT], v[j[1]::BIGINT + 1])), ['inf'::DOUBLE]) FROM r JOIN z USING (user_id) WHERE i < len(a))
SELECT user_id, round(v[-1], 6) + 0.0 AS dtw FROM r JOIN z USING (user_id) WHERE i = len(a)""",
    "pad_orders": """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) - 1 AS pos, o_totalprice AS value FROM orders),
m AS (SELECT max(pos) AS top FROM o), g AS (SELECT o_custkey, unnest(generate_series(0, (SELECT top FROM m))) AS pos FROM (SELECT DISTINCT o_custkey FROM o))
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(pos AS BIGINT) AS pos, coalesce(value, 0.0) AS value FROM g LEFT JOIN o USING (o_custkey, pos)""",
    "gen_lorenz": f"""WITH RECURSIVE w AS (SELECT 0 AS t, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y, 1.0::DOUBLE AS z UNION ALL
SELECT t + 1, x + 0.01::DOUBLE * (10.0::DOUBLE * (y - x)), y + 0.01::DOUBLE * (28.0::DOUBLE * x - y - x * z), z + 0.01::DOUBLE * (x * y - (8.0::DOUBLE / 3.0::DOUBLE) * z) FROM w WHERE t < 399)
SELECT CAST(t AS BIGINT) AS t, {rounded('x', 'x')}, {rounded('y', 'y')}, {rounded('z', 'z')} FROM w""",
    "gen_mackey_glass": f"""WITH RECURSIVE w AS (SELECT 16 AS t, list_transform(range(17), lambda i: 1.2::DOUBLE) AS l UNION ALL
SELECT t + 1, list_append(l, l[t + 1] + 1.0::DOUBLE * (0.2::DOUBLE * l[t - 15] / (1 + l[t - 15] ** 10) - 0.1::DOUBLE * l[t + 1])) FROM w WHERE t < 199),
f AS (SELECT l FROM w WHERE t = 199) SELECT CAST(i - 1 AS BIGINT) AS t, {rounded('l[i]', 'x')} FROM f, unnest(range(1, 201)) k(i)""",
    "gen_double_pendulum": f"WITH RECURSIVE {_PENDULUM} SELECT CAST(t AS BIGINT) AS t, {rounded('a', 'theta1')}, {rounded('b', 'theta2')}, {rounded('u', 'omega1')}, {rounded('v', 'omega2')} FROM w",
    "to_xy": f"WITH RECURSIVE {_PENDULUM} SELECT CAST(t AS BIGINT) AS t, {rounded('sin(a)', 'x1')}, {rounded('-cos(a)', 'y1')}, {rounded('sin(a) + sin(b)', 'x2')}, {rounded('-cos(a) - cos(b)', 'y2')} FROM w",
    "gen_logistic": f"""WITH RECURSIVE w AS (SELECT 0 AS t, 0.4::DOUBLE AS x, 0.2::DOUBLE AS y UNION ALL
SELECT t + 1, x * (3.8::DOUBLE - 3.8::DOUBLE * x), y * (3.5::DOUBLE - 3.5::DOUBLE * y) + 0.02::DOUBLE * x FROM w WHERE t < 59)
SELECT CAST(t AS BIGINT) AS t, {rounded('x', 'x')}, {rounded('y', 'y')} FROM w""",
}
