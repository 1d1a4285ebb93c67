"""DuckDB SQL of the neural forecasters: the layers written out over lists, with the weights as literals."""

from __future__ import annotations

import math

import numpy as np

from . import sql

Weights = dict[str, np.ndarray]


def literal(a: np.ndarray) -> str:
    if a.ndim > 1:
        return "[" + ", ".join(map(literal, a)) + "]"
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" if v else "0" for v in a) + "]::DOUBLE[]"


def column(name: str) -> str:
    return "w_" + name.replace(".", "_")


def stored(w: Weights, flat: tuple[str, ...] = ()) -> str:
    """The weights as one row; kernels of convolutions (out, in, k) as one list per output, in the order of (k, in)."""
    lay = lambda a: a.transpose(0, 2, 1).reshape(len(a), -1) if a.ndim == 3 else a
    return "w AS (SELECT " + ", ".join(f"{literal(lay(a))} AS {column(k)}" for k, a in w.items()) + ")"


def each(x: str, var: str, f: str) -> str:
    return f"list_transform({x}, lambda {var}: {f})"


def dense(w: Weights, name: str, x: str) -> str:
    weights = column(f"{name}.w")
    bias = f" + {column(f'{name}.b')}[o + 1]" if f"{name}.b" in w else ""
    return each(f"range({len(w[f'{name}.w'])})", "o", f"list_dot_product({weights}[o + 1], {x}){bias}")


def leaky(x: str) -> str:
    return each(x, "v", "CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END")


def relu(x: str) -> str:
    return each(x, "v", "greatest(v, 0.0::DOUBLE)")


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def steps(name: str, source: str, n: int) -> str:
    """A table (vec, t, x) from one of (vec, row), its rows cut into steps of n values."""
    return f"{name} AS (SELECT vec, t, row[t * {n} + 1 : t * {n} + {n}] AS x FROM (SELECT vec, row, unnest(range(len(row) // {n})) AS t FROM {source}))"


def lstm(w: Weights, name: str, table: str, out: str, layer: int = 0, reverse: bool = False) -> str:
    """A table (vec, t, h) of the outputs over the steps of a table (vec, t, x)."""
    d = "r" if reverse else ""
    hidden = w[f"{name}.{layer}{d}.h"].shape[1]
    wx, wh, b = (column(f"{name}.{layer}{d}.{k}") for k in "xhb")
    zero = "[" + ", ".join(["0.0::DOUBLE"] * hidden) + "]"
    first, move = (f"(SELECT max(t) + 1 FROM {table})", "- 1") if reverse else ("-1::BIGINT", "+ 1")
    gates = each(f"range({4 * hidden})", "o", f"list_dot_product({wx}[o + 1], s.x) + {b}[o + 1] + list_dot_product({wh}[o + 1], k.h)")
    cell = each(f"range({hidden})", "i", f"{sigmoid(f'g[{hidden} + i + 1]')} * c[i + 1] + {sigmoid('g[i + 1]')} * tanh(g[{2 * hidden} + i + 1])")
    made = each(f"range({hidden})", "i", f"{sigmoid(f'g[{3 * hidden} + i + 1]')} * tanh(c[i + 1])")
    return f"""{out} AS (SELECT DISTINCT vec, {first} AS t, {zero} AS h, {zero} AS c FROM {table}
  UNION ALL SELECT vec, t, {made} AS h, c FROM (SELECT vec, t, g, {cell} AS c FROM (SELECT k.vec, s.t, k.c, {gates} AS g FROM {out} k JOIN {table} s ON s.vec = k.vec AND s.t = k.t {move}, w)))"""


def conv(w: Weights, name: str, table: str, out: str, n_in: int) -> str:
    """A table (vec, t, x) of convolved steps, as many as there were; steps beyond the ends are zeros."""
    width = w[f"{name}.w"].shape[2]
    zero = "[" + ", ".join(["0.0::DOUBLE"] * n_in) + "]"
    near = [f"coalesce(lag(x, {width // 2 - k}) OVER q, {zero})" if k < width // 2 else "x" if k == width // 2 else f"coalesce(lead(x, {k - width // 2}) OVER q, {zero})" for k in range(width)]
    joined = " || ".join(near)
    made = each(f"range({len(w[f'{name}.w'])})", "o", f"list_dot_product({column(f'{name}.w')}[o + 1], y) + {column(f'{name}.b')}[o + 1]")
    return f"{out} AS (SELECT vec, t, {made} AS x FROM (SELECT vec, t, {joined} AS y FROM {table} WINDOW q AS (PARTITION BY vec ORDER BY t)), w)"


def pooled(table: str, out: str, width: int) -> str:
    """Pairs of steps, the greater of each value."""
    best = each(f"range({width})", "i", "greatest(a.x[i + 1], b.x[i + 1])")
    return f"{out} AS (SELECT a.vec, a.t // 2 AS t, {best} AS x FROM {table} a JOIN {table} b ON a.vec = b.vec AND b.t = a.t + 1 WHERE a.t % 2 = 0)"


def activated(table: str, out: str, f) -> str:
    return f"{out} AS (SELECT vec, t, {f('x')} AS x FROM {table})"


def normed(x: str, scale: str, shift: str) -> str:
    """Layer norm of a list."""
    at = f"({x}[i + 1] - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5)"
    return each(f"range(len({x}))", "i", f"{at} * {scale}[i + 1] + {shift}[i + 1]")


EMBEDDINGS = "e AS (SELECT vec_id AS vec, embedding::DOUBLE[] AS row FROM embeddings)"
FORECAST = "SELECT vec AS vec_id, pos - 1 AS pos, round(y[pos], 6) + 0.0 AS value FROM (SELECT vec, y, unnest(range(1, len(y) + 1)) AS pos FROM o)"


def _over(w: Weights, *tables: str, source: str = EMBEDDINGS, forecast: str = FORECAST) -> str:
    return "WITH RECURSIVE " + ",\n".join([source, stored(w), *tables]) + "\n" + forecast


def mlp(w: Weights, **where: str) -> str:
    y, k = leaky(dense(w, "in", "row")), 0
    tables = [f"y0 AS (SELECT vec, {y} AS y FROM e, w)"]
    while f"hidden{k}.w" in w:
        tables.append(f"y{k + 1} AS (SELECT vec, {leaky(dense(w, f'hidden{k}', 'y'))} AS y FROM y{k}, w)")
        k += 1
    return _over(w, *tables, f"o AS (SELECT vec, {dense(w, 'out', 'y')} AS y FROM y{k}, w)", **where)


def _stack(w: Weights, table: str) -> list[str]:
    """The layers of a network in one direction; the last is h<k>."""
    out, k = [], 0
    while f"lstm.{k}.x" in w:
        out.append(lstm(w, "lstm", table, f"k{k}", k))
        out.append(f"h{k} AS (SELECT vec, t, h AS x FROM k{k} WHERE t >= 0)")
        table, k = f"h{k}", k + 1
    return out


def _most(w: Weights, table: str, hidden: int) -> str:
    """The greatest of each output over the steps."""
    best = ", ".join(f"max(x[{i + 1}])" for i in range(hidden))
    return f"o AS (SELECT vec, {dense(w, 'out', 'y')} AS y FROM (SELECT vec, [{best}] AS y FROM {table} GROUP BY vec), w)"


def max_lstm(w: Weights, n_in: int, **where: str) -> str:
    hidden, layers = w["lstm.0.h"].shape[1], sum(f"lstm.{k}.x" in w for k in range(9))
    return _over(w, steps("st", "e", n_in), *_stack(w, "st"), _most(w, f"h{layers - 1}", hidden), **where)


def attention_lstm(w: Weights, n_in: int) -> str:
    hidden = 2 * w["lstm.0.h"].shape[1]
    score = f"({dense(w, 'score2', 'r')})[1]"
    mean = ", ".join(f"sum(a * x[{i + 1}]) / sum(a)" for i in range(hidden))
    return _over(
        w, steps("st", "e", n_in), lstm(w, "lstm", "st", "f"), lstm(w, "lstm", "st", "b", reverse=True),
        "h AS (SELECT f.vec, f.t, f.h || b.h AS x FROM f JOIN b ON f.vec = b.vec AND f.t = b.t WHERE f.t >= 0 AND f.t < (SELECT max(t) FROM b))",
        f"r AS (SELECT vec, t, x, {relu(dense(w, 'score1', 'x'))} AS r FROM h, w)",
        f"z AS (SELECT vec, x, exp({score}) AS a FROM r, w)",
        f"o AS (SELECT vec, {dense(w, 'out', 'y')} AS y FROM (SELECT vec, [{mean}] AS y FROM z GROUP BY vec), w)",
    )


def cnn_lstm(w: Weights, n_in: int, pooling: bool) -> str:
    one, two = len(w["conv1.b"]), len(w["conv2.b"])
    tables = [steps("st", "e", n_in), conv(w, "conv1", "st", "c1", n_in)]
    if pooling:
        tables += [pooled("c1", "p1", one), activated("p1", "a1", leaky), conv(w, "conv2", "a1", "c2", one), pooled("c2", "p2", two), activated("p2", "z", leaky)]
    else:
        tables += [activated("c1", "a1", leaky), conv(w, "conv2", "a1", "c2", one), activated("c2", "a2", leaky), "z AS (SELECT st.vec, st.t, st.x || a2.x AS x FROM st JOIN a2 ON st.vec = a2.vec AND st.t = a2.t)"]
    tables += [*_stack(w, "z"), "y0 AS (SELECT vec, arg_max(x, t) AS y FROM h0 GROUP BY vec)"]
    k = 0
    while f"fc{k}.w" in w:
        tables.append(f"d{k} AS (SELECT vec, {dense(w, f'fc{k}', 'y')} AS d FROM y{k}, w)")
        tables.append(f"y{k + 1} AS (SELECT vec, {leaky(normed('d', column(f'norm{k}.s'), column(f'norm{k}.b')))} AS y FROM d{k}, w)")
        k += 1
    return _over(w, *tables, f"o AS (SELECT vec, {dense(w, 'out', 'y')} AS y FROM y{k}, w)")


def spread(kernel: np.ndarray, high: int, wide: int) -> np.ndarray:
    """The matrix of a convolution (out, in, odd, odd) that keeps the size of an image, over values in the order of channel, row, column."""
    n_out, n_in, p, q = kernel.shape
    out = np.zeros((n_out, high, wide, n_in, high, wide))
    for y in range(high):
        for x in range(wide):
            for i in range(p):
                for j in range(q):
                    a, b = y + i - p // 2, x + j - q // 2
                    if 0 <= a < high and 0 <= b < wide:
                        out[:, y, x, :, a, b] = kernel[:, :, i, j]
    return out.reshape(n_out * high * wide, -1)


def conv_lstm(w: Weights, n_in: int, high: int, wide: int) -> str:
    """Cells of images as cells of lists: a convolution is a matrix with many zeros. The outputs of the last layer, step by step."""
    dense_, k, size = {}, 0, high * wide
    while f"cell{k}.w" in w:
        n = len(w[f"cell{k}.b"]) // 4
        order = np.concatenate([np.arange(n), np.arange(n, 2 * n), np.arange(3 * n, 4 * n), np.arange(2 * n, 3 * n)])  # as lstm() has its gates
        kernel = w[f"cell{k}.w"][order]
        dense_ |= {f"lstm.{k}.x": spread(kernel[:, :-n], high, wide), f"lstm.{k}.h": spread(kernel[:, -n:], high, wide), f"lstm.{k}.b": np.repeat(w[f"cell{k}.b"][order], size)}
        k += 1
    return _over(dense_, steps("st", "e", n_in * size), *_stack(dense_, "st"), f"o AS (SELECT vec, flatten(list(x ORDER BY t)) AS y FROM h{k - 1} GROUP BY vec)")


def transformer(w: Weights, n_in: int, d: int, heads: int, t: int) -> str:
    """Added positions and causal blocks that normalise after each part; one forecast per step."""
    part = d // heads
    place = "[" + ", ".join(f"{'sin' if i % 2 == 0 else 'cos'}(t * {math.exp(-(i - i % 2) * math.log(10000.0) / d)!r}::DOUBLE)" for i in range(d)) + "]"
    plus = lambda a, b: each(f"range({d})", "i", f"{a}[i + 1] + {b}[i + 1]")
    tables, k = [steps("st", "e", n_in), f"x0 AS (SELECT vec, t, {plus('x', 'p')} AS x FROM (SELECT vec, t, {dense(w, 'project', 'x')} AS x, {place} AS p FROM st, w))"], 0
    while f"block{k}.up.w" in w:
        b = f"block{k}"
        head = lambda x, h: f"{x}[{h * part + 1} : {h * part + part}]"
        tables.append(f"q{k} AS (SELECT vec, t, x, {dense(w, f'{b}.q', 'x')} AS q, {dense(w, f'{b}.k', 'x')} AS k, {dense(w, f'{b}.v', 'x')} AS v FROM x{k}, w)")
        looks = ", ".join(f"exp(list_dot_product({head('a.q', h)}, {head('b.k', h)}) / {math.sqrt(part)!r}::DOUBLE) AS e{h}" for h in range(heads))
        tables.append(f"l{k} AS (SELECT a.vec, a.t, b.v, {looks} FROM q{k} a JOIN q{k} b ON a.vec = b.vec AND b.t <= a.t)")
        seen = ", ".join(f"sum(e{i // part} * v[{i + 1}]) / sum(e{i // part})" for i in range(d))
        tables.append(f"m{k} AS (SELECT vec, t, [{seen}] AS m FROM l{k} GROUP BY vec, t)")
        tables.append(f"u{k} AS (SELECT vec, t, {plus('x', 'm')} AS x FROM (SELECT q.vec, q.t, q.x, {dense(w, f'{b}.o', 'm.m')} AS m FROM q{k} q JOIN m{k} m ON q.vec = m.vec AND q.t = m.t, w))")
        tables.append(f"n{k} AS (SELECT vec, t, {normed('x', column(f'{b}.norm1.s'), column(f'{b}.norm1.b'))} AS x FROM u{k}, w)")
        tables.append(f"f{k} AS (SELECT vec, t, x, {relu(dense(w, f'{b}.up', 'x'))} AS f FROM n{k}, w)")
        tables.append(f"g{k} AS (SELECT vec, t, {plus('x', 'f')} AS x FROM (SELECT vec, t, x, {dense(w, f'{b}.down', 'f')} AS f FROM f{k}, w))")
        tables.append(f"x{k + 1} AS (SELECT vec, t, {normed('x', column(f'{b}.norm2.s'), column(f'{b}.norm2.b'))} AS x FROM g{k}, w)")
        k += 1
    tables.append(f"o AS (SELECT vec, flatten(list({dense(w, 'out', 'x')} ORDER BY t)) AS y FROM x{k}, w GROUP BY vec)")
    return _over(w, *tables)


def gelu(x: str, terms: int = 48) -> str:
    """x / 2 * (1 + erf(x / sqrt 2)), the error function by its power series."""
    series = [(-1) ** n * 2 / math.sqrt(math.pi) / (math.factorial(n) * (2 * n + 1)) for n in range(terms)]
    erf = f"list_dot_product({literal(np.array(series))}, list_transform(range({terms}), lambda n: pow(v / {math.sqrt(2)!r}::DOUBLE, 2 * n + 1)))"
    return each(x, "v", f"0.5 * v * (1 + {erf})")


def rotated(x: str, d: int, heads: int) -> str:
    """Each pair of neighbours turned by an angle that grows with t; the angles of a head are laid out in halves."""
    part, out = d // heads, []
    for i in range(d):
        k = i % part
        angle = f"(t * {10000.0 ** (-2 * (k % (part // 2)) / part)!r}::DOUBLE)"
        other = f"-{x}[{i + 2}]" if i % 2 == 0 else f"{x}[{i}]"
        out.append(f"{x}[{i + 1}] * cos{angle} + {other} * sin{angle}")
    return "[" + ", ".join(out) + "]"


def decoder(w: Weights, n_in: int, d: int, heads: int) -> str:
    """Causal blocks with rotary positions that normalise before each part; one forecast per step."""
    part = d // heads
    plus = lambda a, b: each(f"range({d})", "i", f"{a}[i + 1] + {b}[i + 1]")
    head = lambda x, h: f"{x}[{h * part + 1} : {h * part + part}]"
    tables, k = [steps("st", "e", n_in), f"x0 AS (SELECT vec, t, {dense(w, 'project', 'x')} AS x FROM st, w)"], 0
    while f"block{k}.up.w" in w:
        b = f"block{k}"
        norm = lambda n: normed("x", column(f"{b}.{n}.s"), column(f"{b}.{n}.b"))  # noqa: B023, E731
        tables.append(f"a{k} AS (SELECT vec, t, x, {norm('norm1')} AS z FROM x{k}, w)")
        tables.append(f"q{k} AS (SELECT vec, t, x, {dense(w, f'{b}.q', 'z')} AS q, {dense(w, f'{b}.k', 'z')} AS k, {dense(w, f'{b}.v', 'z')} AS v FROM a{k}, w)")
        tables.append(f"r{k} AS (SELECT vec, t, x, {rotated('q', d, heads)} AS q, {rotated('k', d, heads)} AS k, v FROM q{k})")
        looks = ", ".join(f"exp(list_dot_product({head('a.q', h)}, {head('b.k', h)}) / {math.sqrt(part)!r}::DOUBLE) AS e{h}" for h in range(heads))
        tables.append(f"l{k} AS (SELECT a.vec, a.t, b.v, {looks} FROM r{k} a JOIN r{k} b ON a.vec = b.vec AND b.t <= a.t)")
        seen = ", ".join(f"sum(e{i // part} * v[{i + 1}]) / sum(e{i // part})" for i in range(d))
        tables.append(f"m{k} AS (SELECT vec, t, [{seen}] AS m FROM l{k} GROUP BY vec, t)")
        tables.append(f"u{k} AS (SELECT vec, t, {plus('x', 'm')} AS x FROM (SELECT r.vec, r.t, r.x, {dense(w, f'{b}.o', 'm.m')} AS m FROM r{k} r JOIN m{k} m ON r.vec = m.vec AND r.t = m.t, w))")
        tables.append(f"n{k} AS (SELECT vec, t, x, {norm('norm2')} AS z FROM u{k}, w)")
        tables.append(f"f{k} AS (SELECT vec, t, x, {gelu(dense(w, f'{b}.up', 'z'))} AS f FROM n{k}, w)")
        tables.append(f"x{k + 1} AS (SELECT vec, t, {plus('x', 'f')} AS x FROM (SELECT vec, t, x, {dense(w, f'{b}.down', 'f')} AS f FROM f{k}, w))")
        k += 1
    tables.append(f"o AS (SELECT vec, flatten(list({dense(w, 'out', 'x')} ORDER BY t)) AS y FROM x{k}, w GROUP BY vec)")
    return _over(w, *tables)


def featured(window: float, gamma: float, alpha: float, lookback: int, length: int) -> dict[str, str]:
    """Windows of the feature layer's rows as the source, named by series and event."""
    rows = sql.layer_tables(window, gamma, alpha, lookback)
    source = f"""{rows},
z AS (SELECT s.series_id, s.event_id, s.ts, [s.x::DOUBLE, n.avg, n.smooth] AS v FROM s JOIN n USING (series_id, event_id)),
e AS (SELECT vec, row FROM (SELECT (series_id, event_id) AS vec, flatten(list(v) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)) AS row FROM z) WHERE len(row) = {3 * length})"""
    return {"source": source, "forecast": "SELECT vec[1] AS series_id, vec[2] AS event_id, pos - 1 AS pos, round(y[pos], 6) + 0.0 AS value FROM (SELECT vec, y, unnest(range(1, len(y) + 1)) AS pos FROM o)"}
