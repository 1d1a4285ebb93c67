"""The DuckDB SQL of the queries that SQL can express: written from the definitions, not from the plans."""

from __future__ import annotations

import math

W = "PARTITION BY series_id ORDER BY ts, event_id"
PAST = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FUTURE = f"{W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def events(x: str = "value") -> str:
    return f"s AS (SELECT user_id AS series_id, event_id, ts, {x} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)"


MISSING = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
BASE = "b AS (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS base FROM s)"
GRID = """g AS (SELECT 0::BIGINT AS series_id, h AS hour, h - mn AS seq, mn, mx, coalesce(v, 0.0) AS x
  FROM (SELECT mn, mx, unnest(range(mn, mx + 1)) AS h FROM (SELECT min(floor(epoch(ts) / 3600))::BIGINT AS mn, max(floor(epoch(ts) / 3600))::BIGINT AS mx FROM events))
  LEFT JOIN (SELECT floor(epoch(ts) / 3600)::BIGINT AS hh, sum(value) AS v FROM events GROUP BY 1) ON h = hh)"""
DAYS = """g AS (SELECT 0::BIGINT AS series_id, day, row_number() OVER (ORDER BY day) - 1 AS seq, x
  FROM (SELECT floor(epoch(o_orderdate) / 86400)::BIGINT AS day, count(*)::DOUBLE AS x FROM orders GROUP BY 1))"""

#: The same days with their places in a run without a gap.
RUNS = DAYS.replace("g AS", "all_days AS", 1) + """,
marked AS (SELECT *, sum(CASE WHEN day - before = 1 THEN 0 ELSE 1 END) OVER (ORDER BY seq) AS run FROM (SELECT *, lag(day) OVER (ORDER BY seq) AS before FROM all_days)),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) - 1 AS place FROM marked)"""


def rnd(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


def frame(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def fb(e: str) -> str:
    return f"coalesce(last_value({e} IGNORE NULLS) OVER ({PAST}), first_value({e} IGNORE NULLS) OVER ({FUTURE}))"


def feature(raw: str, x: str = "value", filled: bool = True, pre: str = "", digits: int = 6, source: str = "s") -> str:
    """series_id, event_id and y: raw over the series, filled; pre holds more common tables."""
    y = fb("r") if filled else "r"
    return f"WITH {events(x)}{pre}, r AS (SELECT *, {raw} AS r FROM {source}) SELECT series_id, event_id, {rnd(y, digits)} AS y FROM r"


def sides(lookback: int, horizon: int, where: str, source: str = GRID, center: str = "hour") -> str:
    """Long windows around the centers that a condition on c (and t, the number of rows) selects."""
    return f"""WITH {source}, t AS (SELECT count(*) AS n FROM g),
c AS (SELECT g.*, t.n, lag({center}, {lookback}) OVER (ORDER BY seq) AS back, lead({center}, {horizon}) OVER (ORDER BY seq) AS ahead FROM g, t)
SELECT c.series_id, c.{center} AS center, CASE WHEN r.seq < c.seq THEN 'x' ELSE 'y' END AS side,
       CASE WHEN r.seq < c.seq THEN r.seq - c.seq + {lookback} ELSE r.seq - c.seq END AS pos, {rnd("r.x")} AS value
FROM c JOIN g r ON r.seq BETWEEN c.seq - {lookback} AND c.seq + {horizon} - 1 WHERE {where}"""


def items(lookbacks: list[int], offset: int) -> str:
    """The starts i of the windows of a series s."""
    lb = ", ".join(f"({n})" for n in lookbacks)
    return f"""l AS (SELECT col0::BIGINT AS lookback FROM (VALUES {lb})), n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT n.series_id, lookback, unnest(range(0, greatest(n - lookback - 1 - {offset}, 0), lookback)) AS i FROM n, l)"""


def pairs(lookbacks: list[int], offset: int) -> str:
    return f"""WITH {events()}, {items(lookbacks, offset)}
SELECT i.series_id, lookback, i // lookback AS item, a.seq - i AS pos, a.x AS value, b.x AS y
FROM i JOIN s a ON a.series_id = i.series_id AND a.seq BETWEEN i AND i + lookback - 1
JOIN s b ON b.series_id = i.series_id AND b.seq = i + lookback - 1 + {offset}"""


def kalman(x: str) -> str:
    return f"""WITH RECURSIVE {events(x)},
f AS (SELECT series_id, coalesce(arg_min(x, seq) FILTER (WHERE x IS NOT NULL), 0.0) AS z0 FROM s GROUP BY 1),
k AS (SELECT series_id, -1::BIGINT AS seq, z0::DOUBLE AS l, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 2.0::DOUBLE AS c FROM f
  UNION ALL
  SELECT series_id, seq, CASE WHEN z IS NULL THEN l ELSE l + a / (a + 0.1) * (z - l) END, CASE WHEN z IS NULL THEN v ELSE v + b / (a + 0.1) * (z - l) END,
         CASE WHEN z IS NULL THEN a ELSE (1 - a / (a + 0.1)) * a END, CASE WHEN z IS NULL THEN b ELSE (1 - a / (a + 0.1)) * b END, CASE WHEN z IS NULL THEN c ELSE c - b / (a + 0.1) * b END
  FROM (SELECT s.series_id, s.seq, s.x AS z, k.l + k.v AS l, k.v AS v, k.a + 2 * k.b + k.c + 0.01 AS a, k.b + k.c AS b, k.c + 0.001 AS c
        FROM k JOIN s ON s.series_id = k.series_id AND s.seq = k.seq + 1))"""


def kernel(column: str, window: float = 10.0, gamma: float = 3.0, lookback: int = 32) -> str:
    return f"""WITH {events()},
kw AS (SELECT a.series_id, a.event_id, b.x, pow(3.0, -pow(3.0 * (a.seq - b.seq) / {window}, {gamma})) AS w FROM s a JOIN s b ON a.series_id = b.series_id AND b.seq BETWEEN a.seq - {lookback - 1} AND a.seq),
kn AS (SELECT *, w / (sum(w) OVER (PARTITION BY series_id, event_id) + 1e-8) AS q, count(*) OVER (PARTITION BY series_id, event_id) AS c FROM kw),
m AS (SELECT series_id, event_id, CASE WHEN min(c) = 1 THEN min(x) ELSE sum(x * q) END AS m FROM kn GROUP BY 1, 2),
p AS (SELECT series_id, event_id, min(m) AS avg, sum(pow(x - m, 2) * q) AS v2, sum(pow(x - m, 3) * q) AS v3, sum(pow(x - m, 4) * q) AS v4 FROM kn JOIN m USING (series_id, event_id) GROUP BY 1, 2)
SELECT series_id, event_id, {rnd(column)} AS y FROM p"""


def frames(n: int) -> str:
    return f"f AS (SELECT a.series_id, a.event_id, b.x FROM s a JOIN s b ON a.series_id = b.series_id AND b.seq BETWEEN a.seq - {n - 1} AND a.seq), m AS (SELECT series_id, event_id, min(x) AS lo, max(x) AS hi, count(*) AS n FROM f GROUP BY 1, 2)"


def entropy(n: int, bins: int = 10) -> str:
    return f"""WITH {events()}, {frames(n)},
h AS (SELECT series_id, event_id, least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS bin, count(*) / (min(n) * ((min(hi) - min(lo)) / {bins})) AS h FROM f JOIN m USING (series_id, event_id) WHERE hi > lo GROUP BY 1, 2, 3),
e AS (SELECT series_id, event_id, -sum(h * log2(h + 1e-10)) AS e FROM h GROUP BY 1, 2)
SELECT series_id, event_id, {rnd("coalesce(e, 0.0)", 4)} AS y FROM m LEFT JOIN e USING (series_id, event_id)"""


def fractal(n: int) -> str:
    last = "(ceil((hi + s - lo) / s) - 1)"
    mean = sum(math.log(1 / k) for k in (2, 4, 8)) / 3
    total = sum((math.log(1 / k) - mean) ** 2 for k in (2, 4, 8))
    return f"""WITH {events()}, {frames(n)}, k AS (SELECT unnest([2, 4, 8]) AS s),
b AS (SELECT series_id, event_id, s, CASE WHEN floor((x - lo) / s) = {last} THEN {last} - 1 ELSE floor((x - lo) / s) END AS b, {last} AS last FROM f JOIN m USING (series_id, event_id), k),
c AS (SELECT series_id, event_id, s, count(DISTINCT b) FILTER (WHERE b >= 0 AND b < last) AS c FROM b GROUP BY 1, 2, 3),
d AS (SELECT series_id, event_id, min(c) AS lo_c, max(c) AS hi_c, sum((ln(1.0 / s) - ({mean!r})) * ln(greatest(c, 1))) / {total!r} AS slope FROM c GROUP BY 1, 2),
r AS (SELECT s.series_id, s.event_id, s.ts, CASE WHEN n < 4 THEN 1.0 WHEN lo_c = hi_c AND lo_c > 0 THEN 1.0 WHEN lo_c = 0 THEN NULL ELSE slope END AS r FROM s JOIN m USING (series_id, event_id) JOIN d USING (series_id, event_id))
SELECT series_id, event_id, {rnd(fb("r"))} AS y FROM r"""


def calendar(period: str, step_ms: int) -> str:
    length = {"day": "86400000", "week": "604800000", "month": "day(last_day(ts)) * 86400000", "year": "dayofyear(make_date(year(ts), 12, 31)) * 86400000"}[period]
    return f"""WITH o AS (SELECT event_id, (epoch_us(ts) // {1000 * step_ms} * {step_ms} - epoch_ms(date_trunc('{period}', ts)::TIMESTAMP))::BIGINT AS offset_ms, ({length})::BIGINT AS length_ms FROM events)
SELECT event_id, offset_ms, {rnd("cos(2 * pi() * offset_ms / length_ms)")} AS period_cos, {rnd("sin(2 * pi() * offset_ms / length_ms)")} AS period_sin FROM o"""


FORECASTS = f"WITH {events()}, {BASE}, p AS (SELECT series_id, seq, base AS p, x AS y, seq % 8 AS t FROM b WHERE base IS NOT NULL)"


def loss(e: str) -> str:
    return f"{FORECASTS} SELECT series_id, {rnd(e)} AS loss FROM p GROUP BY series_id"


EARLY_STOP = f"""WITH RECURSIVE {FORECASTS.removeprefix("WITH ")},
l AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS i, seq, round(avg(abs(p - y)) OVER (PARTITION BY series_id ORDER BY seq), 9) AS loss FROM p),
k AS (SELECT series_id, -1::BIGINT AS i, 'inf'::DOUBLE AS best, 0 AS n, NULL::BIGINT AS stop FROM l GROUP BY 1
  UNION ALL
  SELECT l.series_id, l.i, CASE WHEN k.stop IS NULL AND loss < best - 0.5 THEN loss ELSE best END,
    CASE WHEN k.stop IS NOT NULL THEN n WHEN loss < best - 0.5 THEN 0 WHEN loss > best + 0.5 THEN n + 1 ELSE n END,
    CASE WHEN k.stop IS NOT NULL THEN k.stop WHEN loss > best + 0.5 AND n + 1 >= 3 THEN l.seq END
  FROM k JOIN l ON l.series_id = k.series_id AND l.i = k.i + 1)
SELECT series_id, max(stop) AS stopped_at, {rnd("arg_max(best, i)")} AS best FROM k GROUP BY 1"""


def closed(e: str, n: int = 200) -> str:
    return f"SELECT seq, {rnd(e)} AS x FROM (SELECT range AS seq, range::DOUBLE AS t FROM range({n}))"


def uniform(of: list[str], seed: int) -> str:
    """A number in (0, 1) from the first 52 bits of a digest."""
    return f"((('0x' || substr(md5(concat_ws('/', {', '.join(of)}, '{seed}')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE)"


def normal(of: list[str], seed: int) -> str:
    return f"(sqrt(-2 * ln({uniform(of, seed)})) * cos(2 * pi() * {uniform(of, seed + 1)}))"


def noise(deviation: float, n: int, seed: int, summed: bool = False) -> str:
    x = f"{deviation!r}::DOUBLE * {normal(['range'], seed)}"
    return f"SELECT seq, {rnd('sum(x) OVER (ORDER BY seq)' if summed else 'x')} AS x FROM (SELECT range AS seq, {x} AS x FROM range({n}))"


def placed(n: int) -> str:
    """p: each row's trailing frame of up to n rows, with their number c and places j from 0."""
    return f"""p AS (SELECT a.series_id, a.event_id, a.ts, least(a.seq, {n - 1}) + 1 AS c, b.seq - greatest(a.seq - {n - 1}, 0) AS j, b.x
  FROM s a JOIN s b ON a.series_id = b.series_id AND b.seq BETWEEN a.seq - {n - 1} AND a.seq)"""


#: The result of a frame's feature r, filled over the series.
_FILLED = f"SELECT s.series_id, s.event_id, {rnd(fb('r'))} AS y FROM s LEFT JOIN r USING (series_id, event_id)".replace(W, "PARTITION BY s.series_id ORDER BY s.ts, s.event_id")


def fft(n: int) -> str:
    return f"""WITH {events()}, {placed(n)},
w AS (SELECT *, x * CASE WHEN c = 1 THEN 1.0 ELSE 0.5 - 0.5 * cos(2 * pi() * j / (c - 1)) END AS v FROM p),
b AS (SELECT series_id, event_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * j / c)), 2) + pow(sum(v * sin(2 * pi() * k * j / c)), 2)) AS m FROM w, (SELECT unnest(range(1, {n // 2})) AS k) WHERE k < c // 2 GROUP BY 1, 2, 3),
r AS (SELECT series_id, event_id, sum(m) AS r FROM b GROUP BY 1, 2)
SELECT series_id, event_id, {rnd("coalesce(r, 0.0)")} AS y FROM s LEFT JOIN r USING (series_id, event_id)"""


def hurst(n: int, low: int = 2, high: int = 20) -> str:
    return f"""WITH {events()}, {placed(n)},
f AS (SELECT series_id, event_id, min(c) AS c, stddev_pop(x) AS sd FROM p GROUP BY 1, 2),
d AS (SELECT a.series_id, a.event_id, lag, b.x - a.x AS d FROM p a, (SELECT unnest(range({low}, {high})) AS lag) JOIN p b ON b.series_id = a.series_id AND b.event_id = a.event_id AND b.j = a.j + lag WHERE lag < a.c // 2 AND a.c >= {high}),
g AS (SELECT series_id, event_id, lag, ln(lag) AS l, CASE WHEN stddev_pop(d) > 0 AND max(d) > min(d) THEN ln((max(d) - min(d)) / stddev_pop(d)) END AS y FROM d GROUP BY 1, 2, 3),
h AS (SELECT series_id, event_id, CASE WHEN count(y) = count(*) AND stddev_pop(y) > 0 THEN regr_slope(y, l) END AS h FROM g GROUP BY 1, 2)
SELECT series_id, event_id, {rnd("CASE WHEN sd > 0 THEN coalesce(h, 0.5) ELSE 0.5 END")} AS y FROM f LEFT JOIN h USING (series_id, event_id)"""


def entropy_rate(n: int, bins: int = 10) -> str:
    eps = "1e-10::DOUBLE"
    return f"""WITH {events()}, {placed(n)},
q AS (SELECT a.series_id, a.event_id, a.x AS a, b.x AS b, a.c - 1 AS m FROM p a JOIN p b ON b.series_id = a.series_id AND b.event_id = a.event_id AND b.j = a.j + 1),
e AS (SELECT series_id, event_id, min(m) AS m, min(a) - CASE WHEN min(a) = max(a) THEN 0.5 ELSE 0 END AS al, max(a) + CASE WHEN min(a) = max(a) THEN 0.5 ELSE 0 END AS ah,
        min(b) - CASE WHEN min(b) = max(b) THEN 0.5 ELSE 0 END AS bl, max(b) + CASE WHEN min(b) = max(b) THEN 0.5 ELSE 0 END AS bh FROM q GROUP BY 1, 2),
k AS (SELECT series_id, event_id, least(floor((a - al) / (ah - al) * {bins}), {bins - 1}) AS i, least(floor((b - bl) / (bh - bl) * {bins}), {bins - 1}) AS j FROM q JOIN e USING (series_id, event_id)),
past AS (SELECT series_id, event_id, i AS j, count(*) AS n FROM k GROUP BY 1, 2, 3),
col AS (SELECT series_id, event_id, g.j, coalesce(n, 0) / (m * ((ah - al) / {bins})) + {eps} AS p FROM e CROSS JOIN (SELECT unnest(range({bins}))::DOUBLE AS j) g LEFT JOIN past USING (series_id, event_id, j)),
cell AS (SELECT series_id, event_id, j, i, count(*) AS n FROM k GROUP BY 1, 2, 3, 4),
dense AS (SELECT series_id, event_id, j, count(*) AS n, sum(d * log2(d / p)) AS t FROM (SELECT cell.*, p, n / (m * ((ah - al) / {bins}) * ((bh - bl) / {bins})) + {eps} AS d FROM cell JOIN e USING (series_id, event_id) JOIN col USING (series_id, event_id, j)) GROUP BY 1, 2, 3),
r AS (SELECT series_id, event_id, -sum(coalesce(t, 0.0) + ({bins} - coalesce(dense.n, 0)) * {eps} * log2({eps} / p)) AS r FROM col LEFT JOIN dense USING (series_id, event_id, j) GROUP BY 1, 2)
{_FILLED}"""


def kernel_hurst(gamma: float = 3.0, ranges: tuple[int, ...] = (16, 32, 64, 128), lookback: int = 128) -> str:
    logs = [math.log(r) for r in ranges]
    mean = sum(logs) / len(logs)
    slope = " + ".join(f"({v - mean!r}) * max(ln(greatest(q, 1e-8))) FILTER (WHERE g = {r})" for v, r in zip(logs, ranges, strict=True))
    return f"""WITH {events()}, {placed(lookback)},
w AS (SELECT p.*, g, pow(3.0, -pow(3.0 * (c - 1 - j) / g, {gamma})) AS w FROM p, (SELECT unnest({list(ranges)}) AS g)),
v AS (SELECT *, w / (sum(w) OVER (PARTITION BY series_id, event_id, g) + 1e-8) AS v FROM w),
m AS (SELECT *, x - sum(x * v) OVER (PARTITION BY series_id, event_id, g) AS d FROM v),
t AS (SELECT *, sum(d * v) OVER (PARTITION BY series_id, event_id, g ORDER BY j) AS path FROM m),
q AS (SELECT series_id, event_id, g, min(c) AS c, (max(path) - min(path)) / (sum(d * d * v) + 1e-8) AS q FROM t GROUP BY 1, 2, 3)
SELECT series_id, event_id, {rnd(f"CASE WHEN min(c) < 2 THEN 0.0 ELSE ({slope}) / {sum((v - mean) ** 2 for v in logs)!r} END")} AS y FROM q GROUP BY 1, 2"""


def kernel_dft(window: float, gamma: float, period: float, smoothness: float, lookback: int = 128) -> str:
    return f"""WITH {events()}, {placed(lookback)},
w AS (SELECT *, pow(3.0, -pow(3.0 * ((c - 1 - j) / ({window} + 1e-8)), {gamma})) AS w FROM p),
v AS (SELECT *, x * w / (sum(w) OVER (PARTITION BY series_id, event_id) + 1e-8) AS v FROM w),
b AS (SELECT series_id, event_id, k, min(c) AS c, sqrt(pow(sum(v * cos(2 * pi() * k * j / c)), 2) + pow(sum(v * sin(2 * pi() * k * j / c)), 2)) AS z FROM v, (SELECT unnest(range({lookback // 2 + 1})) AS k) WHERE k <= c // 2 GROUP BY 1, 2, 3),
f AS (SELECT *, exp(-pow(k - c / ({period} + 1e-8), 2) / (2 * ({smoothness}::DOUBLE * {smoothness} + 1e-8))) AS f FROM b)
SELECT series_id, event_id, {rnd("CASE WHEN min(c) <= 1 THEN 0.0 ELSE sum(z * f) / (sum(f) + 1e-8) END")} AS y FROM f GROUP BY 1, 2"""


def layer_tables(window: float, gamma: float, alpha: float, lookback: int) -> str:
    """n: the weighted mean and variance, the exponential average and its change, each normalised over all rows."""
    moments = kernel("avg", window, gamma, lookback).removeprefix("WITH ").rsplit("SELECT series_id", 1)[0]
    norm = lambda c: f"({c} - avg({c}) OVER ()) / sqrt(var_pop({c}) OVER () + 1e-5)"
    return f"""{moments},
ew AS (SELECT series_id, event_id, seq, x AS e, 0.0::DOUBLE AS d FROM s WHERE seq = 0 UNION ALL
  SELECT s.series_id, s.event_id, s.seq, (1 - {alpha}::DOUBLE) * e + {alpha}::DOUBLE * x, (1 - {alpha}::DOUBLE) * e + {alpha}::DOUBLE * x - e FROM ew JOIN s ON s.series_id = ew.series_id AND s.seq = ew.seq + 1),
n AS (SELECT series_id, event_id, {norm("avg")} AS avg, {norm("v2")} AS var, {norm("e")} AS smooth, {norm("d")} AS slope FROM p JOIN ew USING (series_id, event_id))"""


def layer(window: float, gamma: float, alpha: float, lookback: int) -> str:
    names = ", ".join(f"{rnd(c)} AS {c}" for c in ("avg", "var", "smooth", "slope"))
    return f"WITH RECURSIVE {layer_tables(window, gamma, alpha, lookback)} SELECT series_id, event_id, {names} FROM n"


def random_windows(lookback: int, horizon: int, samples: int, seed: int) -> str:
    return f"""WITH {GRID}, n AS (SELECT series_id, count(*) AS n FROM g GROUP BY 1), d AS (SELECT series_id, n, unnest(range({samples})) AS sample FROM n WHERE n >= {lookback + horizon}),
c AS (SELECT series_id, sample, floor({uniform(["series_id", "sample"], seed)} * (n - {horizon + lookback} + 1))::BIGINT + {lookback} AS place FROM d)
SELECT c.series_id, sample, k.hour AS center, CASE WHEN g.seq < place THEN 'x' ELSE 'y' END AS side, CASE WHEN g.seq < place THEN g.seq - place + {lookback} ELSE g.seq - place END AS pos, {rnd("g.x")} AS value
FROM c JOIN g k ON k.series_id = c.series_id AND k.seq = place JOIN g ON g.series_id = c.series_id AND g.seq BETWEEN place - {lookback} AND place + {horizon - 1}"""


_GRID_ITEMS = f"WITH {GRID}, s AS (SELECT * FROM g), {items([4, 8, 12], 1)}, t AS (SELECT series_id, lookback, count(*) AS n FROM i GROUP BY 1, 2)"
_CUT = f"""SELECT c.series_id, c.lookback, c.seg_id, c.start, c.length, i.i // c.lookback - c.start AS item_no, a.seq - i.i AS pos, {rnd("a.x")} AS value, {rnd("b.x")} AS y
FROM c JOIN i ON i.series_id = c.series_id AND i.lookback = c.lookback AND i.i // c.lookback BETWEEN c.start AND c.start + c.length - 1
JOIN s a ON a.series_id = i.series_id AND a.seq BETWEEN i.i AND i.i + c.lookback - 1 JOIN s b ON b.series_id = i.series_id AND b.seq = i.i + c.lookback"""


def drawn_segments(samples: int, how: str, a: float, b: float, seed: int) -> str:
    of = ["series_id", "lookback", "seg_id"]
    length = f"{a} + {uniform(of, seed)} * ({b - a})" if how == "uniform" else f"abs({a} + {b} * {normal(of, seed)})"
    return f"""{_GRID_ITEMS}, d AS (SELECT *, unnest(range({samples})) AS seg_id FROM t),
e AS (SELECT *, least(greatest(floor({length}), 1), n)::BIGINT AS length FROM d),
c AS (SELECT *, floor({uniform(of, seed + 7)} * (n - length + 1))::BIGINT AS start FROM e)
{_CUT}"""


def partition_segments(mean: float, deviation: float, seed: int) -> str:
    return f"""{_GRID_ITEMS}, d AS (SELECT *, unnest(range(ceil(n / {max(mean, 1.0)} * 2 + 16)::BIGINT + 1)) AS draw FROM t),
e AS (SELECT *, CASE WHEN draw = ceil(n / {max(mean, 1.0)} * 2 + 16)::BIGINT THEN n ELSE floor(abs({mean} + {deviation} * {normal(["series_id", "lookback", "draw"], seed)}))::BIGINT END AS long FROM d),
f AS (SELECT *, sum(long) OVER (PARTITION BY series_id, lookback ORDER BY draw) - long AS start FROM e WHERE long > 0),
c AS (SELECT series_id, lookback, start::BIGINT AS start, least(long, n - start)::BIGINT AS length, row_number() OVER (PARTITION BY series_id, lookback ORDER BY draw) - 1 AS seg_id FROM f WHERE start < n)
{_CUT}"""


def random_segments(low: int, high: int, samples: int, seed: int) -> str:
    of = ["series_id", "seg_id"]
    return f"""WITH {events()}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), d AS (SELECT *, unnest(range({samples})) AS seg_id FROM n),
e AS (SELECT *, least(greatest(floor({low} + {uniform(of, seed)} * ({high + 1 - low})), 1), n)::BIGINT AS length FROM d),
c AS (SELECT *, floor({uniform(of, seed + 7)} * (n - length + 1))::BIGINT AS start FROM e)
SELECT c.series_id, seg_id, start, length, s.seq - start AS pos, s.x AS value FROM c JOIN s ON s.series_id = c.series_id AND s.seq BETWEEN start AND start + length - 1"""


PANEL = """o AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS date_id, user_id AS symbol_id, ts, event_id, value AS feature FROM events),
panel AS (SELECT date_id::BIGINT AS date_id, symbol_id, row_number() OVER w - 1 AS time_id, feature, lead(feature) OVER w AS responder FROM o WINDOW w AS (PARTITION BY date_id, symbol_id ORDER BY ts, event_id))"""


def _numbered(keys: str, name: str) -> str:
    return f"SELECT {keys}, row_number() OVER (ORDER BY substr(md5(concat_ws('/', {keys})), 1, 3), {keys}) - 1 AS {name} FROM (SELECT DISTINCT {keys} FROM panel)"


def panel_sample(samples: int, low: int, high: int, seed: int) -> str:
    """Slices with the responder's gaps filled by the two rows nearest by feature, the feature standardised, the symbol's number."""
    u = lambda k: uniform(["sample_id"], seed + k)
    return f"""WITH {PANEL}, keys AS ({_numbered("date_id, symbol_id", "place")}), hot AS ({_numbered("symbol_id", "hot_at")}),
d AS (SELECT range AS sample_id, floor({u(2).replace("sample_id", "range")} * (SELECT count(*) FROM keys))::BIGINT AS place FROM range({samples})),
e AS (SELECT sample_id, date_id, symbol_id, min(time_id) AS lo, max(time_id) AS hi FROM d JOIN keys USING (place) JOIN panel USING (date_id, symbol_id) GROUP BY 1, 2, 3),
f AS (SELECT *, floor({low} + {u(0)} * {high - low}) AS length FROM e),
g AS (SELECT *, lo + floor({u(1)} * greatest(hi - lo - length + 1, 1)) AS t0 FROM f),
c AS (SELECT sample_id, panel.* FROM g JOIN panel USING (date_id, symbol_id) WHERE time_id BETWEEN t0 AND least(t0 + length, hi)),
near AS (SELECT a.sample_id, a.time_id, b.responder, row_number() OVER (PARTITION BY a.sample_id, a.time_id ORDER BY abs(b.feature - a.feature), b.time_id) AS k
  FROM c a JOIN c b ON a.sample_id = b.sample_id WHERE a.responder IS NULL AND b.responder IS NOT NULL),
fill AS (SELECT sample_id, time_id, avg(responder) AS responder FROM near WHERE k <= 2 GROUP BY 1, 2)
SELECT c.sample_id, c.date_id, c.symbol_id, c.time_id, {rnd("(c.feature - (SELECT avg(feature) FROM panel)) / (SELECT stddev_samp(feature) FROM panel)")} AS feature,
       {rnd("coalesce(c.responder, fill.responder, 0.0)")} AS responder, hot_at, (SELECT count(*) FROM hot) AS hot_size
FROM c JOIN hot USING (symbol_id) LEFT JOIN fill USING (sample_id, time_id)"""


def panel_segment(lookback: int, seed: int) -> str:
    return f"""WITH {PANEL}, k AS (SELECT * FROM panel WHERE time_id >= {lookback} ORDER BY md5(concat_ws('/', date_id, symbol_id, time_id, '{seed}')) LIMIT 1)
SELECT k.date_id, k.symbol_id, k.time_id - {lookback} AS t0, p.time_id - k.time_id + {lookback} AS pos, p.feature AS value, coalesce(k.responder, 0.0) AS y
FROM k JOIN panel p ON p.date_id = k.date_id AND p.symbol_id = k.symbol_id AND p.time_id BETWEEN k.time_id - {lookback} AND k.time_id - 1"""


TUMBLING = f"""SELECT user_id AS series_id, date_trunc('hour', ts) AS start, count(value) AS n, {rnd("sum(value)", 4)} AS total, {rnd("avg(value)", 4)} AS mean FROM events GROUP BY 1, 2"""
