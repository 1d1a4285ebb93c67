"""DuckDB SQL of the unscented filters: the recursion written out entry by entry, from the fixed process and noise."""

from __future__ import annotations

from ..operators.filters import OFFSET, P4, PROCESS, Q4
from . import sql

D = range(4)
UPPER = [(i, j) for i in D for j in D if i <= j]


def _p(i: int, j: int, name: str = "p") -> str:
    return f"{name}{min(i, j)}{max(i, j)}"


def _sum(terms: list[str]) -> str:
    return " + ".join(terms) or "0.0"


def _predicted(p: str) -> str:
    """Columns e0.. of the predicted state and s00.. of A P A', from x0.. and the covariance named p; each may use those before it."""
    a = lambda i, j: f"({float(PROCESS[i][j])!r}::DOUBLE)"
    half = [f"{_sum([f'{a(i, k)} * {_p(k, j, p)}' for k in D if PROCESS[i][k]])} AS t{i}{j}" for i in D for j in D]
    spread = [f"{_sum([f't{i}{k} * {a(j, k)}' for k in D if PROCESS[j][k]])} AS s{i}{j}" for i, j in UPPER]
    state = [f"{_sum([f'{a(i, k)} * x{k}' for k in D if PROCESS[i][k]])} + {float(OFFSET[i])!r}::DOUBLE AS e{i}" for i in D]
    return ", ".join([*half, *spread, *state])


def _updated(q: str) -> str:
    """Columns x0.. and p00.. after the measurement z, which may be null, with observed variance pyy; q is the noise's factor."""
    state = [f"CASE WHEN z IS NULL THEN e{i} ELSE e{i} + s0{i} / pyy * (z - e0) END AS x{i}" for i in D]
    cov = []
    for i, j in UPPER:
        own = f"s{i}{j}" + (f" + {float(Q4[i])!r}::DOUBLE * {q}" if i == j else "")
        cov.append(f"{own} - CASE WHEN z IS NULL THEN 0.0 ELSE pyy * (s0{i} / pyy) * (s0{j} / pyy) END AS p{i}{j}")
    return ", ".join([*state, *cov])


def _start(first: str, diagonal: list[str]) -> str:
    state = [f"{v}::DOUBLE AS x{i}" for i, v in enumerate((first, "0.0", "0.1", first))]
    return ", ".join([*state, *[f"{diagonal[i] if i == j else '0.0'}::DOUBLE AS p{i}{j}" for i, j in UPPER]])


STATE = ", ".join([*(f"x{i}" for i in D), *(f"p{i}{j}" for i, j in UPPER)])


def robust(digits: int = 4) -> str:
    """The filter whose noise follows the last 30 innovations."""
    start = _start("a", ["0.1 * scale", "0.01 * scale", "0.1", "0.1 * scale"])
    inn = "inn[greatest(len(inn) - 28, 1) :] || [z - e0]"
    return f"""WITH RECURSIVE {sql.events(sql.MISSING)},
f AS (SELECT series_id, coalesce(arg_min(x, seq) FILTER (WHERE x IS NOT NULL), 0.0) AS a, CASE WHEN count(x) > 1 THEN stddev_pop(x) ELSE 1.0 END AS scale,
        count(x) = 0 OR max(abs(x)) = 0 AS nothing, min(x) = max(x) AS flat FROM s GROUP BY 1),
k AS (SELECT series_id, -1::BIGINT AS seq, scale, {start}, 1.0::DOUBLE AS f, 0.1::DOUBLE * scale AS r, []::DOUBLE[] AS inn FROM f
  UNION ALL
  SELECT series_id, seq, scale, {STATE}, CASE WHEN sd IS NULL THEN f WHEN abs(z - e0) > 3 * sd THEN f * 1.5::DOUBLE ELSE f * 0.99::DOUBLE END AS f,
    CASE WHEN sd IS NULL THEN r ELSE greatest(0.5 * sd, 0.01 * scale) END AS r, inn
  FROM (SELECT series_id, seq, scale, f, r, z, e0, {_updated("scale * f")}, CASE WHEN z IS NULL THEN inn ELSE {inn} END AS inn,
          CASE WHEN z IS NOT NULL AND len(inn) > 0 THEN list_stddev_pop({inn}) END AS sd
    FROM (SELECT s.series_id, s.seq, s.x AS z, k.scale, k.f, k.r, k.inn, {_predicted("p")}, s00 + k.r AS pyy FROM k JOIN s ON s.series_id = k.series_id AND s.seq = k.seq + 1)))
SELECT s.series_id, s.event_id, {sql.rnd("CASE WHEN nothing THEN 0.0 WHEN flat THEN s.x ELSE k.x0 END", digits)} AS y
FROM s JOIN k ON s.series_id = k.series_id AND s.seq = k.seq JOIN f ON f.series_id = s.series_id"""


def many(kinds: list[str], digits: int = 4) -> str:
    """The filter over several columns at once: with a variable-major layout every column is a filter of its own, but for their common scale."""
    squares = ["sqrt(p00) AS l00", "p01 / l00 AS l10", "p02 / l00 AS l20", "p03 / l00 AS l30", "sqrt(p11 - l10 * l10) AS l11", "(p12 - l20 * l10) / l11 AS l21", "(p13 - l30 * l10) / l11 AS l31"]
    squares += ["sqrt(p22 - l20 * l20 - l21 * l21) AS l22", "(p23 - l30 * l20 - l31 * l21) / l22 AS l32", "sqrt(p33 - l30 * l30 - l31 * l31 - l32 * l32) AS l33"]
    spread = [f"{_sum([f'l{k}{i} * l{k}{j}' for k in D if k >= j])} AS m{i}{j}" for i, j in UPPER]
    start = _start("a", [f"{float(v)!r} * scale" for v in P4])
    values = ", ".join(f"round(max(z) FILTER (WHERE kind = '{k}'), {digits}) + 0.0 AS {k}" for k in kinds)
    levels = ", ".join(f"round(max(x0) FILTER (WHERE kind = '{k}'), {digits}) + 0.0 AS {k}_level" for k in kinds)
    return f"""WITH RECURSIVE h AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, event_type AS kind, avg(value) AS z FROM events GROUP BY 1, 2),
r AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS seq FROM (SELECT DISTINCT hour FROM h)),
s AS (SELECT kind, hour, seq, z FROM (SELECT DISTINCT kind FROM h) CROSS JOIN r LEFT JOIN h USING (kind, hour)),
f AS (SELECT kind, coalesce(arg_min(z, seq) FILTER (WHERE z IS NOT NULL), 0.0) AS a FROM s GROUP BY 1),
g AS (SELECT kind, a, CASE WHEN count(*) OVER () > 1 THEN greatest(stddev_pop(a) OVER (), 1e-12) ELSE 1.0 END AS scale FROM f),
k AS (SELECT kind, -1::BIGINT AS seq, scale, {start} FROM g
  UNION ALL
  SELECT kind, seq, scale, {_updated("scale")}
  FROM (SELECT s.kind, s.seq, s.z, k.scale, {", ".join([*squares, *spread])}, {_predicted("m")}, s00 + 0.1::DOUBLE * k.scale AS pyy FROM k JOIN s ON s.kind = k.kind AND s.seq = k.seq + 1))
SELECT 0::BIGINT AS series_id, s.hour AS event_id, {values}, {levels} FROM s JOIN k USING (kind, seq) GROUP BY s.hour"""
