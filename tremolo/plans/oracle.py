"""DuckDB SQL for the queries that SQL can express, written for the long layout of samples.

The engine's queries work on arrays; here every sample is a row, delays are self-joins,
recursions are recursive CTEs and spectra are sums over joins, so little is shared but the
literal coefficients of filters.
"""

from __future__ import annotations

import math

from tremolo.functions import dsp, psychoacoustics
from tremolo.operators import kernels

E = "e AS (SELECT vec_id AS clip_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
PI2 = "6.283185307179586e0"


def r(x: str, digits: int = 9) -> str:
    return f"round({x}, {digits}) + 0e0"


def u(seed: str, *place: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(place)})), 1, 8))::UBIGINT)::DOUBLE + 5e-1) / 4294967296e0"


def normal(seed: str, *place: str) -> str:
    return f"sqrt(-2e0 * ln({u(seed + 'a', *place)})) * cos({PI2} * ({u(seed + 'b', *place)}))"


def lit(v: float) -> str:
    return f"{v!r}::DOUBLE"


def y(expr: str, ctes: str = E, source: str = "e", digits: int = 9, where: str = "") -> str:
    return f"WITH RECURSIVE {ctes} SELECT clip_id, i, {r(expr, digits)} AS y FROM {source} {where}"


def iir(source: str, name: str, b, a, combine: str = "{y}") -> str:
    """CTEs that filter source(clip_id, i, x) into name(clip_id, i, x)."""
    k = len(a) - 1
    terms = [f"{lit(float(c))} * CASE WHEN i + 2 - {j} >= 1 THEN xs[i + 2 - {j}] ELSE 0e0 END" for j, c in enumerate(b)]
    terms += [f"{lit(-float(c))} * ys[{j}]" for j, c in enumerate(a) if j]
    zeros = ", ".join(["0e0"] * k)
    out = combine.format(x="xs[i + 1]", y="y")
    return f"""{name}_l AS (SELECT clip_id, list(x ORDER BY i) AS xs FROM {source} GROUP BY clip_id),
{name}_r AS (
  SELECT clip_id, -1 AS i, xs, [{zeros}]::DOUBLE[] AS ys, 0e0 AS y FROM {name}_l
  UNION ALL
  SELECT clip_id, i + 1, xs, list_prepend(v, ys[1:{k - 1}]), v FROM (SELECT clip_id, i, xs, ys, {' + '.join(terms)} AS v FROM {name}_r WHERE i + 1 < len(xs))
), {name} AS (SELECT clip_id, i, {out} AS x FROM {name}_r WHERE i >= 0)"""


def chip(seed: int, i: str) -> str:
    return f"CASE WHEN (((({i} % 65536)::BIGINT + 1) * (({i} % 65536)::BIGINT + 3) * 48271 + ({i}::BIGINT + 7) * {69621 * (seed + 1)}) % 2147483647) & 1024 = 0 THEN -1e0 ELSE 1e0 END"


def embed(source: str, name: str, seed: int, bit: str) -> str:
    """CTEs that mark source(clip_id, i, x); bit: the bit of position b as 0 or 1."""
    return f"""{name}_c AS (
  SELECT clip_id, (i % 16) AS b, sum(x * ({chip(seed, 'i')})) / count(*) AS c FROM {source} GROUP BY ALL
), {name} AS (
  SELECT s.clip_id, s.i, s.x + ({chip(seed, 's.i')}) * (5e-2 * (2 * ({bit}) - 1) - c.c) AS x
  FROM {source} AS s JOIN {name}_c AS c ON s.clip_id = c.clip_id AND s.i % 16 = c.b
)"""


RUN_BIT = f"CASE WHEN {u('7:message', 's.i % 16')} > 0.5 THEN 1 ELSE 0 END"
OWN_BIT = lambda seed: f"CASE WHEN {u(seed, 's.clip_id', 's.i % 16')} > 0.5 THEN 1 ELSE 0 END"
MARKED = E + ", " + embed("e", "w", 1, RUN_BIT)

SQL: dict[str, str] = {}
SQL["atk_sign_inversion"] = y("-x")
for _b in (8, 16, 24):
    _s = float(2 ** (_b - 1) - 1)
    SQL[f"atk_pcm_{_b}"] = y(f"trunc(least(greatest(x * {lit(_s)}, {lit(-_s - 1)}), {lit(_s)})) / {lit(_s)}")
SQL["atk_quantization"] = f"""WITH {E}, m AS (SELECT *, min(x) OVER (PARTITION BY clip_id) AS a, max(x) OVER (PARTITION BY clip_id) AS b FROM e)
SELECT clip_id, i, {r("round_even((x - a) / (b - a + 1e-8) * 255e0, 0) / 255e0 * (b - a) + a")} AS y FROM m"""
SQL["atk_smoothing"] = y("sum(x) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10e0")
SQL["smoothing_long"] = f"""WITH s AS (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS i, value AS x FROM events)
SELECT clip_id, i, {r("sum(x) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10e0", 6)} AS y FROM s"""
for _key, _kind, _cut, _order, _digits in (("atk_lowpass", "lowpass", 5000.0, 5, 9), ("atk_highpass", "highpass", 50.0, 4, 6)):
    _bb, _aa = dsp.polynomials(dsp.butter(_order, _cut / 8000, _kind))
    SQL[_key] = y("x", E + ", " + iir("e", "f", _bb, _aa), "f", _digits)
_stages, _from = [E], "e"
for _k, (_bb, _aa) in enumerate(kernels.equalizer_stages([10, 10, 10, 10, 0, 0, -5, -10], 16000)):
    _stages.append(iir(_from, f"q{_k}", _bb, _aa, "{x} + {y}"))
    _from = f"q{_k}"
SQL["atk_equalizer"] = y("x / max(abs(x)) OVER (PARTITION BY clip_id)", ", ".join(_stages), _from)
_pink = f"g AS (SELECT clip_id, i, {normal('0:pink', 'clip_id', 'i')} AS x FROM e), " + iir("g", "p", *kernels.PINK)
SQL["atk_pink_noise"] = y("e.x + p.x / (max(abs(p.x)) OVER (PARTITION BY clip_id)) * 3e-2", f"{E}, {_pink}", "e JOIN p USING (clip_id, i)")


def _settled(source: str, name: str, b, a) -> str:
    """iir() of source(clip_id, i, x, lv) as if x had been lv for ever; lv of the result is what it then had been."""
    gain, k = lit(float(sum(b) / sum(a))), len(a) - 1
    terms = [f"{lit(float(c))} * CASE WHEN i + 2 - {j} >= 1 THEN xs[i + 2 - {j}] ELSE lv END" for j, c in enumerate(b)]
    terms += [f"{lit(-float(c))} * ys[{j}]" for j, c in enumerate(a) if j]
    return f"""{name}_l AS (SELECT clip_id, list(x ORDER BY i) AS xs, any_value(lv) AS lv FROM {source} GROUP BY clip_id),
{name}_r AS (
  SELECT clip_id, -1 AS i, xs, lv, [{", ".join([f"lv * {gain}"] * k)}] AS ys, 0e0 AS y FROM {name}_l
  UNION ALL
  SELECT clip_id, i + 1, xs, lv, list_prepend(v, ys[1:{k - 1}]), v FROM (SELECT clip_id, i, xs, lv, ys, {' + '.join(terms)} AS v FROM {name}_r WHERE i + 1 < len(xs))
), {name} AS (SELECT clip_id, i, y AS x, lv * {gain} AS lv FROM {name}_r WHERE i >= 0)"""


def _bandstop() -> str:
    """Forward and backward through the sections, the clip extended by 27 samples mirrored through each end."""
    parts = dsp.sections(dsp.butter(4, [200 / 8000, 300 / 8000], "bandstop"))
    whole = "OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    ctes = [E, "xl AS (SELECT clip_id, list(x ORDER BY i) AS xs, len(list(x)) AS n FROM e GROUP BY clip_id)", "xt AS (SELECT *, unnest(range(-27, n + 27)) AS t FROM xl)",
        "s0 AS (SELECT clip_id, (t + 27)::INTEGER AS i, CASE WHEN t < 0 THEN 2 * xs[1] - xs[1 - t] WHEN t < n THEN xs[t + 1] ELSE 2 * xs[n] - xs[2 * n - 1 - t] END AS x, 2 * xs[1] - xs[28] AS lv FROM xt)"]
    at = "s0"
    for way in ("f", "g"):
        for k, (b, a) in enumerate(parts):
            ctes.append(_settled(at, f"{way}{k}", b, a))
            at = f"{way}{k}"
        ctes.append(f"{way}t AS (SELECT clip_id, (max(i) {whole} - i)::INTEGER AS i, x, last_value(x) {whole} AS lv FROM {at})")
        at = f"{way}t"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT clip_id, (i - 27)::INTEGER AS i, {r('x', 6)} AS y FROM gt JOIN xl USING (clip_id) WHERE i BETWEEN 27 AND n + 26"


SQL["atk_bandstop"] = _bandstop()
_HANN = f"(5e-1 - 5e-1 * cos({PI2} * j / 16))"
SQL["atk_stft_quant"] = f"""WITH {E}, c AS (SELECT clip_id, (max(i) + 1)::INTEGER AS n FROM e GROUP BY clip_id),
f AS (SELECT c.clip_id, m, j, coalesce(e.x, 0) * {_HANN} AS v FROM (SELECT clip_id, unnest(range(n // 8 + 1))::INTEGER AS m FROM c) AS c, (SELECT unnest(range(16))::INTEGER AS j) AS k LEFT JOIN e ON e.clip_id = c.clip_id AND e.i = m * 8 + j - 8),
s AS (SELECT clip_id, m, k, sum(v * cos({PI2} / 16 * j * k)) / 8 AS a, -sum(v * sin({PI2} / 16 * j * k)) / 8 AS b FROM f, (SELECT unnest(range(9))::INTEGER AS k) GROUP BY ALL),
h AS (SELECT *, sqrt(a * a + b * b) AS x, min(sqrt(a * a + b * b)) OVER w AS low, max(sqrt(a * a + b * b)) OVER w AS high FROM s WINDOW w AS (PARTITION BY clip_id)),
q AS (SELECT *, (round_even((x - low) / (high - low + 1e-8) * 63, 0) / 63 * (high - low) + low) / x AS g FROM h),
b AS (SELECT clip_id, m, j, {_HANN} AS w, sum(CASE WHEN k IN (0, 8) THEN a * cos({PI2} / 16 * j * k) ELSE 2 * (a * cos({PI2} / 16 * j * k) - b * sin({PI2} / 16 * j * k)) END * g) / 2 AS v FROM q, (SELECT unnest(range(16))::INTEGER AS j) GROUP BY ALL)
SELECT b.clip_id, (m * 8 + j - 8)::INTEGER AS i, {r("sum(v * w) / sum(w * w)")} AS y FROM b JOIN c ON b.clip_id = c.clip_id WHERE m * 8 + j - 8 BETWEEN 0 AND n - 1 GROUP BY b.clip_id, m * 8 + j - 8"""
SQL["atk_lpc"] = f"""WITH {E}, z AS (
  SELECT clip_id, i, x, lag(x) OVER w AS p, lag(x, 2) OVER w AS q, max(i) OVER (PARTITION BY clip_id) AS n FROM e WINDOW w AS (PARTITION BY clip_id ORDER BY i)
), k1 AS (SELECT clip_id, -2 * sum(x * p) / sum(x * x + p * p) AS k, sum(x * x + p * p) AS den FROM z WHERE i >= 1 GROUP BY clip_id),
f1 AS (SELECT z.clip_id, i, n, x + k * p AS f, p + k * x AS b, k, den FROM z JOIN k1 USING (clip_id) WHERE i >= 1),
d1 AS (SELECT clip_id, any_value((1 - k * k) * den) - sum(CASE WHEN i = n THEN b * b ELSE 0 END) - sum(CASE WHEN i = 1 THEN f * f ELSE 0 END) AS den FROM f1 GROUP BY clip_id),
s1 AS (SELECT clip_id, i, f, lag(b) OVER (PARTITION BY clip_id ORDER BY i) AS b FROM f1),
k2 AS (SELECT s1.clip_id, -2 * sum(f * b) / any_value(den) AS k FROM s1 JOIN d1 USING (clip_id) WHERE b IS NOT NULL GROUP BY s1.clip_id)
SELECT z.clip_id, i, {r("-(k1.k * (1 + k2.k) * coalesce(p, 0) + k2.k * coalesce(q, 0))", 6)} AS y FROM z JOIN k1 USING (clip_id) JOIN k2 USING (clip_id)"""


def _tap(i: str, start: float, width: float, rate: float) -> str:
    return f"(floor(16000 * {lit(start)}) + floor(16000 * {lit(width)}) * sin({lit(2 * math.pi * rate)} * {i} / 16000))"


def _delays(taps: list[tuple[float, float, float, float]], dry: float) -> str:
    parts, joins = [f"e.x * {lit(dry)}"], ""
    for k, (s, w, rate, gain) in enumerate(taps):
        tau = _tap("e.i", s, w, rate)
        joins += f" LEFT JOIN e AS a{k} ON a{k}.clip_id = e.clip_id AND a{k}.i = e.i - floor({tau})::INTEGER LEFT JOIN e AS b{k} ON b{k}.clip_id = e.clip_id AND b{k}.i = e.i - floor({tau})::INTEGER - 1"
        parts.append(f"(coalesce(b{k}.x, 0) * ({tau} - floor({tau})) + coalesce(a{k}.x, 0) * (1 - ({tau} - floor({tau})))) * {lit(gain)}")
    return f"{E}, t AS (SELECT e.clip_id, e.i, {' + '.join(parts)} AS x FROM e{joins})"


SQL["atk_chorus"] = y("x / max(abs(x)) OVER (PARTITION BY clip_id)", _delays([(0.0005, 0.0002, 200.0, 0.3), (0.001, 0.0002, 120.0, 0.2), (0.002, 0.0002, 120.0, 0.1)], 1.0), "t")
SQL["atk_flanger"] = y("x", _delays([(0.0005, 0.0002, 250.0, 0.7)], 1.0), "t")


def _numbers(values) -> str:
    return "[" + ", ".join(lit(float(v)) for v in values) + "]"


_h, _g = dsp.decimation_taps(2), dsp.resampling_taps(2, 1)
SQL["atk_resampling"] = f"""WITH {E}, h AS (SELECT unnest(range({len(_h)})) AS j, unnest({_numbers(_h)}) AS c), g AS (SELECT unnest(range({len(_g)})) AS j, unnest({_numbers(_g)}) AS c),
down AS (SELECT o.clip_id, o.i // 2 AS m, sum(h.c * e.x) AS x FROM (SELECT clip_id, i FROM e WHERE i % 2 = 0) AS o JOIN e ON e.clip_id = o.clip_id JOIN h ON h.j = o.i - e.i + {len(_h) // 2} GROUP BY ALL),
n AS (SELECT clip_id, 2 * max(m) + 1 AS last FROM down GROUP BY clip_id)
SELECT n.clip_id, o.i::INTEGER AS i, {r("sum(g.c * down.x)")} AS y FROM n JOIN (SELECT unnest(range(1000)) AS i) AS o ON o.i <= n.last JOIN down ON down.clip_id = n.clip_id JOIN g ON g.j = o.i - 2 * down.m + {len(_g) // 2} GROUP BY ALL"""

_h = dsp.resampling_taps(441, 320)
SQL["resample_audio"] = f"""WITH {E}, h AS (SELECT unnest(range({len(_h)})) AS j, unnest({_numbers(_h)}) AS c), n AS (SELECT clip_id, ceil((max(i) + 1) * 441 / 320e0)::INTEGER AS n FROM e GROUP BY clip_id),
o AS (SELECT clip_id, unnest(range(n))::INTEGER AS i FROM n), t AS (SELECT o.clip_id, o.i, e.x, o.i * 320 + {len(_h) // 2} - e.i * 441 AS j FROM o JOIN e ON e.clip_id = o.clip_id)
SELECT clip_id, i, {r("sum(c * x)")} AS y FROM t JOIN h USING (j) GROUP BY clip_id, i"""

_levels, _s2 = [E.replace("e AS", "a0 AS", 1)], "sqrt(2e0)"
for _k in range(6):
    _levels.append(f"p{_k} AS (SELECT clip_id, i // 2 AS i, sum(CASE WHEN i % 2 = 0 THEN x ELSE 0 END) AS u, sum(CASE WHEN i % 2 = 1 THEN x ELSE 0 END) AS v FROM a{_k} GROUP BY ALL)")
    _levels.append(f"a{_k + 1} AS (SELECT clip_id, i, (u + v) / {_s2} AS x FROM p{_k}), d{_k} AS (SELECT clip_id, i, (u - v) / {_s2} AS x FROM p{_k})")
_levels.append("t AS (SELECT clip_id, median(abs(x)) / 0.6745e0 * sqrt(2e0 * ln(64e0)) * 5e-1 AS t FROM d0 GROUP BY clip_id)")
_soft = lambda n, m: f"{m} AS (SELECT clip_id, i, sign(x) * greatest(abs(x) - t, 0e0) AS x FROM {n} JOIN t USING (clip_id))"
_levels.append(_soft("a6", "s6"))
for _k in reversed(range(6)):
    _levels.append(_soft(f"d{_k}", f"c{_k}"))
    _levels.append(f"s{_k} AS (SELECT clip_id, 2 * s.i + h AS i, (s.x + CASE WHEN h = 0 THEN c.x ELSE -c.x END) / {_s2} AS x FROM s{_k + 1} AS s JOIN c{_k} AS c USING (clip_id, i), (VALUES (0), (1)) AS hh(h))".replace("2 * s.i", "2 * i"))
SQL["atk_wavelet_haar"] = f"WITH {', '.join(_levels)} SELECT clip_id, i::INTEGER AS i, {r('x')} AS y FROM s0"
SQL["universal_threshold"] = f"WITH {', '.join(_levels[:3])}, t AS (SELECT clip_id, median(abs(x)) / 0.6745e0 * sqrt(2e0 * ln(64e0)) * 5e-1 AS t FROM d0 GROUP BY clip_id) SELECT clip_id, {r('t')} AS threshold FROM t"
SQL["atk_additive_noise"] = y(f"x + 3e-3 * {normal('0:noise', 'clip_id', 'i')}")
SQL["atk_gaussian_noise"] = y(f"x + sqrt(avg(x * x) OVER (PARTITION BY clip_id) / 100e0) * {normal('0:gauss', 'clip_id', 'i')}")
SQL["atk_echo"] = f"""WITH {E}, v AS (
  SELECT clip_id, max(i) + 1 AS n, max(abs(x)) AS top, floor(16000 * (2e-4 + (2e-3 - 2e-4) * ({u('0:echo-delay', 'clip_id')})))::INTEGER AS d, 1e-1 + (5e-1 - 1e-1) * ({u('0:echo-volume', 'clip_id')}) AS g FROM e GROUP BY clip_id
), k AS (SELECT clip_id, n, top, g, d, unnest(range(n + d))::INTEGER AS i FROM v),
w AS (SELECT k.clip_id, k.i, n, top, coalesce(a.x, 0) + g * coalesce(b.x, 0) AS x FROM k LEFT JOIN e AS a ON a.clip_id = k.clip_id AND a.i = k.i LEFT JOIN e AS b ON b.clip_id = k.clip_id AND b.i = k.i - k.d),
m AS (SELECT *, max(abs(x)) OVER (PARTITION BY clip_id) AS whole FROM w)
SELECT clip_id, i, {r("x / whole * top")} AS y FROM m WHERE i < n"""


def _segment(what: str, seconds: float) -> str:
    return f"seg AS (SELECT clip_id, n, least({int(16000 * seconds)}, n) AS size, floor(({u(f'0:{what}-start', 'clip_id')}) * (n - least({int(16000 * seconds)}, n)))::INTEGER AS start FROM (SELECT clip_id, (max(i) + 1)::INTEGER AS n FROM e GROUP BY clip_id))"


SQL["atk_flip_samples"] = f"""WITH {E}, {_segment("flip", 0.003)},
k AS (SELECT clip_id, start + j AS i, row_number() OVER (PARTITION BY clip_id ORDER BY {u('0:flip-place', 'clip_id', 'j')}, j) - 1 AS rank, size FROM (SELECT *, unnest(range(size))::INTEGER AS j FROM seg)),
c AS (SELECT * FROM k WHERE rank < least(16, size) // 2 * 2),
p AS (SELECT a.clip_id, a.i, b.i AS j FROM c AS a JOIN c AS b ON a.clip_id = b.clip_id AND xor(a.rank::BIGINT, 1::BIGINT) = b.rank)
SELECT e.clip_id, e.i, {r("coalesce(o.x, e.x)")} AS y FROM e LEFT JOIN p ON p.clip_id = e.clip_id AND p.i = e.i LEFT JOIN e AS o ON o.clip_id = p.clip_id AND o.i = p.j"""
SQL["atk_cut_samples"] = f"""WITH RECURSIVE {E}, {_segment("cut", 0.003)},
k AS (SELECT clip_id, j, row_number() OVER (PARTITION BY clip_id ORDER BY {u('0:cut-place', 'clip_id', 'j')}, j) AS rank FROM (SELECT *, unnest(range(size - 4))::INTEGER AS j FROM seg)),
c AS (SELECT k.clip_id, j, j + floor(({u('0:cut-length', 'k.clip_id', 'j')}) * 4)::INTEGER + 1 AS stop, start, size, row_number() OVER (PARTITION BY k.clip_id ORDER BY j) AS nr FROM k JOIN seg USING (clip_id) WHERE rank <= 6),
v AS (SELECT c.*, abs(a.x - b.x) AS step FROM c JOIN e AS a ON a.clip_id = c.clip_id AND a.i = start + j LEFT JOIN e AS b ON b.clip_id = c.clip_id AND b.i = start + stop),
w AS (SELECT *, coalesce(bool_or(stop >= size) OVER (PARTITION BY clip_id ORDER BY nr), false) AS over FROM v),
ok AS (SELECT clip_id, j, stop, row_number() OVER (PARTITION BY clip_id ORDER BY nr) AS nr FROM w WHERE NOT over AND step <= 0.1),
parts AS (
  SELECT clip_id, nr, coalesce(lag(stop) OVER (PARTITION BY clip_id ORDER BY nr), 0) AS a, j AS b FROM ok
  UNION ALL SELECT seg.clip_id, 1000, coalesce(max(stop) FILTER (WHERE true), 0), any_value(size) FROM seg LEFT JOIN (SELECT clip_id, arg_max(stop, nr) AS stop FROM ok GROUP BY clip_id) AS l USING (clip_id) GROUP BY seg.clip_id
), kept AS (
  SELECT e.clip_id, 0 AS nr, e.i, x FROM e JOIN seg USING (clip_id) WHERE e.i < start
  UNION ALL SELECT p.clip_id, p.nr, e.i, x FROM parts AS p JOIN seg USING (clip_id) JOIN e ON e.clip_id = p.clip_id AND e.i >= start + p.a AND e.i < start + p.b
  UNION ALL SELECT e.clip_id, 2000, e.i, x FROM e JOIN seg USING (clip_id) WHERE e.i >= start + size
)
SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY nr, i) - 1)::INTEGER AS i, {r("x")} AS y FROM kept"""
_CROSS = "z AS (SELECT clip_id, i FROM (SELECT clip_id, i, sign(x) AS s, lead(sign(x)) OVER (PARTITION BY clip_id ORDER BY i) AS t FROM e) WHERE t IS NOT NULL AND s <> t)"
SQL["zero_crossings"] = f"WITH {E}, {_CROSS} SELECT clip_id, i FROM z"
SQL["atk_zero_cross_inserts"] = f"""WITH RECURSIVE {E}, {_CROSS}, l AS (SELECT e.clip_id, list(DISTINCT z.i ORDER BY z.i) FILTER (WHERE z.i IS NOT NULL) AS zs FROM (SELECT DISTINCT clip_id FROM e) AS e LEFT JOIN z USING (clip_id) GROUP BY e.clip_id),
g AS (
  SELECT clip_id, zs, 1 AS k, -8 AS last, false AS hit FROM l
  UNION ALL SELECT clip_id, zs, k + 1, CASE WHEN zs[k] - last >= 8 THEN zs[k] ELSE last END, zs[k] - last >= 8 FROM g WHERE k <= len(zs)
), ins AS (SELECT clip_id, last AS place FROM g WHERE hit),
o AS (SELECT clip_id, i * 2 + 1 AS pos, 0 AS nr, x FROM e UNION ALL SELECT clip_id, place * 2, nr, 0e0 FROM ins, (VALUES (0), (1), (2)) AS n(nr))
SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY pos, nr) - 1)::INTEGER AS i, {r("x")} AS y FROM o"""
_PAIR = f"{MARKED}, p AS (SELECT w.clip_id, w.i, w.x, e.x AS o, count(*) OVER (PARTITION BY w.clip_id) AS n FROM w JOIN e USING (clip_id, i))"
SQL["atk_zero_bit_collusion_front"] = y("CASE WHEN i < floor(n * 20e0 / 100) THEN o ELSE x END", _PAIR, "p")
SQL["atk_zero_bit_collusion_end"] = y("CASE WHEN i >= n - floor(n * 20e0 / 100) THEN o ELSE x END", _PAIR, "p")
SQL["atk_zero_bit_collusion_random"] = y("CASE WHEN rank <= floor(n * 20e0 / 100) THEN o ELSE x END", f"{_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY {u('0:collude', 'clip_id', 'i')}, i) AS rank FROM p)", "k")
SQL["atk_collusion"] = y(f"CASE WHEN {u('0:coin', 'clip_id', '(i // 25)')} > 0.5 THEN w.x ELSE v.x END", MARKED + ", " + embed("e", "v", 1, OWN_BIT("0:collusion")), "w JOIN v USING (clip_id, i)")
SQL["atk_same_model"] = y("x", MARKED + ", " + embed("w", "v", 1, OWN_BIT("0:same-model")), "v")
SQL["atk_cross_model"] = y("x", MARKED + ", " + embed("w", "v", 2, OWN_BIT("0:cross-model")), "v")

_FRAMES = f"""{E}, c AS (SELECT clip_id, ceil((max(i) + 1 - 16) / 4e0)::INTEGER + 1 AS blocks FROM e GROUP BY clip_id),
f AS (SELECT c.clip_id, m, j, coalesce(e.x, 0) * (5e-1 - 5e-1 * cos({PI2} * (j + 1) / 17)) AS v
  FROM (SELECT clip_id, unnest(range(blocks))::INTEGER AS m FROM c) AS c, (SELECT unnest(range(16))::INTEGER AS j) AS k LEFT JOIN e ON e.clip_id = c.clip_id AND e.i = m * 4 + j)"""
_MAGNITUDES = f"""{_FRAMES}, s AS (SELECT clip_id, m, k, sqrt(sum(v * cos({PI2} / 16 * j * k)) ** 2 + sum(v * sin({PI2} / 16 * j * k)) ** 2) AS x
  FROM f, (SELECT unnest(range(16))::INTEGER AS k) GROUP BY ALL)"""
_DIST = f"{_MAGNITUDES}, d AS (SELECT a.clip_id, a.m, b.m AS other, {r('sqrt(sum((a.x - b.x) * (a.x - b.x)))', 8)} AS dist FROM s AS a JOIN s AS b ON a.clip_id = b.clip_id AND a.k = b.k AND abs(a.m - b.m) > 4 GROUP BY ALL)"
_MASKED = f"""{_MAGNITUDES}, h AS (SELECT *, round_even(6e0 * asinh(k * 1000e0 / 600e0) / {lit(6 * math.asinh(8000 / 600) / 23)}, 0)::INTEGER AS band FROM s WHERE k <= 8),
l AS (SELECT clip_id, m, band, sum(x) AS x, count(*) AS n FROM h GROUP BY ALL),
t AS (SELECT a.clip_id, a.m, a.band, pow(sum(CASE WHEN a.band = b.band THEN 0e0 ELSE pow(b.x / (pow(10e0, 14.5e0 / 20) * pow(10e0, 12e0 / 20)) *
  pow(1 / pow(10e0, CASE WHEN b.band < a.band THEN 7.5e0 ELSE 26e0 END / 20), abs(a.band - b.band)::DOUBLE), 9e-1) END), 1 / 9e-1) / sqrt(any_value(a.n)) AS t
  FROM l AS a JOIN l AS b ON a.clip_id = b.clip_id AND a.m = b.m GROUP BY ALL),
g AS (SELECT h.clip_id, h.m, k, x, t FROM h JOIN t USING (clip_id, m, band))"""
SQL["frame_blocks"] = f"WITH {_FRAMES} SELECT clip_id, m, j, {r('v')} AS v FROM f"
SQL["stft_magnitude"] = f"WITH {_FRAMES}, s AS (SELECT clip_id, m, k, sum(v * cos({PI2} / 16 * j * k)) AS a, sum(v * sin({PI2} / 16 * j * k)) AS b FROM f, (SELECT unnest(range(9))::INTEGER AS k) GROUP BY ALL) SELECT clip_id, m, k, {r('sqrt(a * a + b * b)', 8)} AS magnitude FROM s"
SQL["block_distance"] = f"WITH {_DIST} SELECT * FROM d"
SQL["block_distance_masked"] = f"""WITH {_MASKED}, p AS (SELECT a.clip_id, a.m, b.m AS other, CASE WHEN a.x > a.t THEN a.x ELSE 0e0 END - CASE WHEN b.x > greatest(a.t, b.t) THEN b.x ELSE 0e0 END AS v FROM g AS a JOIN g AS b ON a.clip_id = b.clip_id AND a.k = b.k AND abs(a.m - b.m) > 4)
SELECT clip_id, m, other, {r("sqrt(sum(v * v))", 8)} AS dist FROM p GROUP BY ALL"""
SQL["block_candidates"] = f"WITH {_DIST} SELECT clip_id, m, count(*) AS n FROM d WHERE dist <= 1 GROUP BY ALL"
SQL["block_topk_first"] = f"WITH {_DIST}, k AS (SELECT clip_id, m, other, (row_number() OVER (PARTITION BY clip_id, m ORDER BY other))::INTEGER AS rank FROM d WHERE dist <= 1) SELECT * FROM k WHERE rank <= 3"
SQL["block_nearest"] = f"WITH {_DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY clip_id, m ORDER BY dist, other) AS rank FROM d) SELECT clip_id, m, other, dist FROM k WHERE rank = 1"
# The fit from one or two blocks by normal equations; spectra of real blocks have the blocks' inner products.
SQL["block_fit"] = f"""WITH {_DIST}, k AS (SELECT clip_id, m, other, row_number() OVER (PARTITION BY clip_id, m ORDER BY other) AS rank FROM d WHERE dist <= 1),
b AS (SELECT clip_id, m, min(dist) AS best_dist FROM d GROUP BY ALL),
v AS (SELECT k1.clip_id, k1.m, f.j, f.v AS x, p.v AS p, q.v AS q FROM k AS k1 LEFT JOIN k AS k2 ON k2.clip_id = k1.clip_id AND k2.m = k1.m AND k2.rank = 2
  JOIN f ON f.clip_id = k1.clip_id AND f.m = k1.m JOIN f AS p ON p.clip_id = k1.clip_id AND p.m = k1.other AND p.j = f.j
  LEFT JOIN f AS q ON q.clip_id = k1.clip_id AND q.m = k2.other AND q.j = f.j WHERE k1.rank = 1),
g AS (SELECT clip_id, m, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * x) AS px, sum(q * x) AS qx FROM v GROUP BY ALL),
co AS (SELECT clip_id, m, CASE WHEN qq IS NULL THEN 1 ELSE 2 END::INTEGER AS n_used, CASE WHEN qq IS NULL THEN px / pp ELSE (px * qq - qx * pq) / (pp * qq - pq * pq) END AS a, CASE WHEN qq IS NULL THEN 0e0 ELSE (qx * pp - px * pq) / (pp * qq - pq * pq) END AS b FROM g),
y AS (SELECT v.clip_id, v.m, n_used, j, x, co.a * p + co.b * coalesce(q, 0e0) AS y FROM v JOIN co USING (clip_id, m)),
z AS (SELECT clip_id, m, k, any_value(n_used) AS n_used, sqrt(sum(x * cos({PI2} / 16 * j * k)) ** 2 + sum(x * sin({PI2} / 16 * j * k)) ** 2) - sqrt(sum(y * cos({PI2} / 16 * j * k)) ** 2 + sum(y * sin({PI2} / 16 * j * k)) ** 2) AS gap
  FROM y, (SELECT unnest(range(16))::INTEGER AS k) GROUP BY ALL),
w AS (SELECT clip_id, m, any_value(n_used) AS n_used, {r('sqrt(sum(gap * gap))', 6)} AS fit_dist FROM z GROUP BY ALL)
SELECT w.clip_id, w.m, n_used, fit_dist, best_dist, fit_dist <= best_dist AS kept FROM w JOIN b ON b.clip_id = w.clip_id AND b.m = w.m"""
SQL["fractional_band_levels"] = f"""WITH {_MAGNITUDES}, b AS (SELECT band, 650e0 * sinh((7e0 * asinh(80e0 / 650) + band * 25e-2) / 7) AS low, CASE WHEN band = 108 THEN 18000e0 ELSE 650e0 * sinh((7e0 * asinh(80e0 / 650) + (band + 1) * 25e-2) / 7) END AS high FROM (SELECT unnest(range(109))::INTEGER AS band))
SELECT clip_id, m, band, {r('sum(x * (least(high, (k + 5e-1) * 1000) - greatest(low, (k - 5e-1) * 1000)) / 1000)', 8)} AS level FROM s JOIN b ON least(high, (k + 5e-1) * 1000) > greatest(low, (k - 5e-1) * 1000) WHERE k <= 8 GROUP BY ALL"""
_EVENTS = "s AS (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS i, value AS x FROM events)"
SQL["cut_intervals"] = f"""WITH {_EVENTS}, n AS (SELECT clip_id, count(*) AS n, unnest(range(5))::INTEGER AS nr FROM s GROUP BY clip_id),
a AS (SELECT clip_id, nr, floor(({u('3:cut', 'clip_id', 'nr')}) * n)::BIGINT AS start FROM n),
c AS (SELECT clip_id, nr, start, start + floor(({u('3:length', 'clip_id', 'nr')}) * 7)::BIGINT + 1 AS stop FROM a)
SELECT s.clip_id, i, count(*) AS n_cuts, min(nr) AS first_cut FROM s JOIN c ON c.clip_id = s.clip_id AND i >= start AND i < stop GROUP BY ALL"""
SQL["frame_samples"] = f"""WITH {_EVENTS}, c AS (SELECT clip_id, greatest(ceil((max(i) + 1 - 16) / 4e0)::INTEGER + 1, 1) AS blocks FROM s GROUP BY clip_id)
SELECT c.clip_id, m, j, {r(f'coalesce(s.x, 0) * (5e-1 - 5e-1 * cos({PI2} * (j + 1) / 17))', 6)} AS v
FROM (SELECT clip_id, unnest(range(blocks))::INTEGER AS m FROM c) AS c, (SELECT unnest(range(16))::INTEGER AS j) AS k LEFT JOIN s ON s.clip_id = c.clip_id AND s.i = m * 4 + j"""
SQL["wav_round_trip"] = f"WITH {E} SELECT clip_id, i::BIGINT AS i, {r('trunc(least(greatest(x * 32767, -32768e0), 32767e0)) / 32768')} AS y FROM e"
_bb, _aa = dsp.polynomials(dsp.butter(5, 5000 / 8000, "lowpass"))
SQL["lowpass_long"] = f"WITH RECURSIVE {_EVENTS}, {iir('s', 'g', _bb, _aa)} SELECT clip_id, i::BIGINT AS i, {r('x', 6)} AS y FROM g"
_bb, _aa = dsp.polynomials(dsp.butter(2, 0.3, "lowpass"))
SQL["stream_chunk_filter"] = f"WITH RECURSIVE {E}, {iir('e', 'g', _bb, _aa)} SELECT clip_id, i::BIGINT AS i, {r('x', 6)} AS y FROM g"
SQL["overlap_add"] = f"WITH {_FRAMES}, o AS (SELECT clip_id, m * 4 + j AS i, v, 5e-1 - 5e-1 * cos({PI2} * (j + 1) / 17) AS w FROM f) SELECT clip_id, i, {r('sum(v * w) / sum(w * w)', 8)} AS y FROM o GROUP BY clip_id, i"
SQL["hz_to_bark"] = f"SELECT p_partkey, {r('6e0 * asinh(p_retailprice / 600e0)')} AS bark FROM part"
SQL["bark_to_hz"] = f"SELECT p_partkey, {r('650e0 * sinh(p_size / 2e0 / 7e0)', 6)} AS hz FROM part"
_step = lit(6 * math.asinh(8000 / 600) / 23)
SQL["bark_bands"] = f"""WITH b AS (SELECT k, round_even(6e0 * asinh(k * 15.625e0 / 600e0) / {_step}, 0)::INTEGER AS band FROM (SELECT unnest(range(513))::INTEGER AS k)),
g AS (SELECT band, count(*) AS n, min(k) AS first, 650e0 * sinh((band * {_step} + 1) / 7e0) / 1000 AS f FROM b GROUP BY band)
SELECT band, n, first, {r("3.64e0 * pow(f, -8e-1) - 6.5e0 * exp(-6e-1 * (f - 3.3e0) * (f - 3.3e0)) + 1e-3 * pow(f, 4e0)", 6)} AS limit_db FROM g"""
SQL["masking_threshold"] = f"""WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM e), l AS (SELECT clip_id, (i * 8 // n)::INTEGER AS m, sum(abs(x)) AS x FROM n GROUP BY ALL)
SELECT a.clip_id, a.m AS band, {r("pow(sum(pow(b.x / (pow(10e0, 14.5e0 / 20) * pow(10e0, 12e0 / 20)) * CASE WHEN b.m < a.m THEN pow(1 / pow(10e0, 7.5e0 / 20), (a.m - b.m)::DOUBLE) ELSE pow(1 / pow(10e0, 26e0 / 20), (b.m - a.m)::DOUBLE) END, 9e-1)), 1 / 9e-1)")} AS threshold
FROM l AS a JOIN l AS b ON a.clip_id = b.clip_id AND a.m <> b.m GROUP BY a.clip_id, a.m"""
SQL["masking_threshold_frames"] = f"""WITH {_FRAMES}, s AS (SELECT clip_id, m, k, sum(v * cos({PI2} / 16 * j * k)) AS a, sum(v * sin({PI2} / 16 * j * k)) AS b FROM f, (SELECT unnest(range(9))::INTEGER AS k) GROUP BY ALL),
l AS (SELECT clip_id, m, round_even(6e0 * asinh(k * 1000e0 / 600e0) / {lit(6 * math.asinh(8000 / 600) / 7)}, 0)::INTEGER AS band, sum(sqrt(a * a + b * b)) AS x FROM s GROUP BY ALL)
SELECT l.clip_id, l.m, n.band, {r("pow(sum(CASE WHEN l.band = n.band THEN 0e0 ELSE pow(l.x / (pow(10e0, 14.5e0 / 20) * pow(10e0, 12e0 / 20)) * CASE WHEN l.band < n.band THEN pow(1 / pow(10e0, 7.5e0 / 20), (n.band - l.band)::DOUBLE) ELSE pow(1 / pow(10e0, 26e0 / 20), (l.band - n.band)::DOUBLE) END, 9e-1) END), 1 / 9e-1)", 8)} AS threshold
FROM l, (SELECT unnest(range(8))::INTEGER AS band) AS n GROUP BY l.clip_id, l.m, n.band"""

# Long clips in blocks of 1024 samples; bins of spectra by a table of sines, since there are but 1024 phases.
_LINES = "li AS (SELECT l_suppkey AS clip_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_extendedprice / 1e5 - 5e-1 AS x FROM lineitem)"
_WIDE = f"""{_LINES}, lc AS (SELECT clip_id, greatest(ceil((count(*) - 1024) / 256e0)::INTEGER + 1, 1) AS blocks FROM li GROUP BY clip_id),
lf AS (SELECT c.clip_id, m, li.i - m * 256 AS j, x, trunc(least(greatest(x * 127, -128e0), 127e0)) / 127 AS y FROM (SELECT clip_id, unnest(range(blocks)) AS m FROM lc) AS c JOIN li ON li.clip_id = c.clip_id AND li.i >= m * 256 AND li.i < m * 256 + 1024),
lw AS (SELECT clip_id, m, j, x * (5e-1 - 5e-1 * cos({PI2} * (j + 1) / 1025)) AS x, y * (5e-1 - 5e-1 * cos({PI2} * (j + 1) / 1025)) AS y FROM lf),
tr AS MATERIALIZED (SELECT p, cos({PI2} * p / 1024) AS c, sin({PI2} * p / 1024) AS s FROM (SELECT unnest(range(1024)) AS p)),
ks AS (SELECT unnest(range(513)) AS k),
sp AS (SELECT clip_id, m, k, sqrt(sum(x * c) ** 2 + sum(x * s) ** 2) AS x, sqrt(sum(y * c) ** 2 + sum(y * s) ** 2) AS y FROM lw, ks JOIN tr ON p = (j * k) % 1024 GROUP BY ALL)"""
_TAPS = ", ".join(repr(float(v)) for v in psychoacoustics.ear_taps(1024, 16000))
_EAR = f"""tp AS (SELECT unnest(range(1024)) AS j, unnest([{_TAPS}]::DOUBLE[]) AS h),
eg AS (SELECT k, sqrt(sum(h * c) ** 2 + sum(h * s) ** 2) AS g FROM tp, ks JOIN tr ON p = (j * k) % 1024 GROUP BY k), ew AS (SELECT k, g / max(g) OVER () AS w FROM eg)"""
SQL["ear_weighted_levels"] = f"WITH {_WIDE}, {_EAR} SELECT clip_id, m::INTEGER AS m, {r('sqrt(sum(x * x * w * w * CASE WHEN k IN (0, 512) THEN 1 ELSE 2 END))', 6)} AS level FROM sp JOIN ew USING (k) GROUP BY clip_id, m"
SQL["metric_nmr"] = f"""WITH {_WIDE}, {_EAR},
fb AS (SELECT band, 650e0 * sinh((7e0 * asinh(80e0 / 650) + band * 25e-2) / 7) AS low, CASE WHEN band = 108 THEN 18000e0 ELSE 650e0 * sinh((7e0 * asinh(80e0 / 650) + (band + 1) * 25e-2) / 7) END AS high FROM (SELECT unnest(range(109)) AS band)),
wt AS MATERIALIZED (SELECT k, band, (least(high, (k + 5e-1) * 15.625e0) - greatest(low, (k - 5e-1) * 15.625e0)) / 15.625e0 AS share FROM ks JOIN fb ON least(high, (k + 5e-1) * 15.625e0) > greatest(low, (k - 5e-1) * 15.625e0)),
hb AS (SELECT band, sum(share) AS held FROM wt GROUP BY band),
lv AS (SELECT clip_id, m, band, sum(x * share) AS x FROM sp JOIN wt USING (k) GROUP BY ALL),
th AS (SELECT a.clip_id, a.m, n.band, pow(sum(CASE WHEN a.band = n.band THEN 0e0 ELSE pow(a.x / (pow(10e0, 14.5e0 / 20) * pow(10e0, 12e0 / 20)) * CASE WHEN a.band < n.band THEN pow(1 / pow(10e0, 7.5e0 / 20), (n.band - a.band)::DOUBLE) ELSE pow(1 / pow(10e0, 26e0 / 20), (a.band - n.band)::DOUBLE) END, 9e-1) END), 1 / 9e-1) / sqrt(any_value(n.held)) AS t
  FROM lv AS a, hb AS n GROUP BY a.clip_id, a.m, n.band),
ht AS (SELECT clip_id, m, k, sum(t * share) AS t FROM th JOIN wt USING (band) GROUP BY ALL),
er AS (SELECT clip_id, m, sum((x - y) * (x - y) * w / (t + 2.220446049250313e-16)) AS e FROM sp JOIN ht USING (clip_id, m, k) JOIN ew USING (k) GROUP BY ALL)
SELECT clip_id, {r('10e0 * log10(avg(e) / 109)', 5)} AS value FROM er GROUP BY clip_id"""


def _bits(n: int) -> str:
    return f"b AS (SELECT vec_id AS clip_id, b, CASE WHEN {u('7:message', 'vec_id', 'b')} > 0.5 THEN 1 ELSE 0 END AS bit FROM embeddings, (SELECT unnest(range({n}))::INTEGER AS b))"


SQL["watermark_bits"] = f"WITH {_bits(16)} SELECT clip_id, b, bit FROM b"
SQL["bits_pack"] = f"WITH {_bits(40)} SELECT clip_id, (b // 8)::INTEGER AS g, sum(bit * (1 << (7 - b % 8)))::INTEGER AS value FROM b GROUP BY ALL"
SQL["bits_unpack"] = f"WITH {_bits(40)} SELECT clip_id, b, bit FROM b"
SQL["bits_bipolar"] = f"WITH {_bits(16)} SELECT clip_id, b, 2 * bit - 1 AS v, bit FROM b"
SQL["compare_watermarks"] = f"""WITH {_bits(16)}, g AS (SELECT clip_id, CASE WHEN clip_id % 5 < 2 THEN NULL WHEN (b + clip_id) % 3 = 0 THEN 0 ELSE 1 END AS same FROM b)
SELECT clip_id, {r("coalesce(100e0 * sum(same) / 16, 50e0)")} AS accuracy FROM g GROUP BY clip_id"""
_M = f"WITH {MARKED}, p AS (SELECT clip_id, e.x AS s, w.x AS m FROM e JOIN w USING (clip_id, i))"
SQL["metric_snr"] = f"{_M} SELECT clip_id, {r('10 * log10(sum(s * s) / sum((m - s) * (m - s)))', 6)} AS value FROM p GROUP BY clip_id"
SQL["metric_psnr"] = f"{_M} SELECT clip_id, {r('10 * log10(1 / avg((m - s) * (m - s)))', 6)} AS value FROM p GROUP BY clip_id"
SQL["metric_si_sdr"] = f"""{_M}, d AS (SELECT clip_id, s - avg(s) OVER (PARTITION BY clip_id) AS s, m - avg(m) OVER (PARTITION BY clip_id) AS m FROM p),
q AS (SELECT clip_id, sum(s * m) / (sum(s * s) + 1e-8) AS a, sum(s * s) AS rr FROM d GROUP BY clip_id),
n AS (SELECT d.clip_id, any_value(a * a * rr) AS good, sum((m - a * s) * (m - a * s)) AS bad FROM d JOIN q USING (clip_id) GROUP BY d.clip_id)
SELECT clip_id, {r("10 * log10(good / (bad + 1e-8))", 6)} AS value FROM n"""
SQL["trim_match"] = "SELECT vec_id AS clip_id, (len(embedding) - vec_id % 7)::INTEGER AS n, (len(embedding) - vec_id % 7)::INTEGER AS m FROM embeddings"
SQL["renormalize"] = f"WITH {E}, p AS (SELECT clip_id, i, x, x * x * 3 AS p FROM e), m AS (SELECT *, min(x) OVER w AS a, max(x) OVER w AS b, min(p) OVER w AS c, max(p) OVER w AS d FROM p WINDOW w AS (PARTITION BY clip_id)) SELECT clip_id, i, {r('(p - c) / (d - c) * (b - a) + a')} AS y FROM m"
SQL["resample_ratio"] = "WITH r AS (SELECT unnest([8000, 16000, 22050, 24000, 44100, 48000]) AS x) SELECT a.x AS input, b.x AS target, (b.x // gcd(a.x, b.x))::INTEGER AS up, (a.x // gcd(a.x, b.x))::INTEGER AS down FROM r AS a, r AS b"
SQL["scan_suffix_filter"] = r"SELECT page_id, regexp_matches(lower(url), '\.(wav|mp3)$') AS audio, regexp_matches(lower(url), '(/|#top)$') AS folder FROM pages"
SQL["basename_stem"] = r"SELECT page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '^(.+)\.[^.]*$', '\1') AS stem FROM pages"
SQL["json_params"] = "SELECT event_id, (props->>'k')::INTEGER AS k FROM events"
SQL["biquad_coeffs"] = f"""WITH w AS (SELECT cos({PI2} * 1000 / 16000) AS c, sin({PI2} * 1000 / 16000) * 1000 / (2 * 710e0) AS al, pow(10e0, 6e0 / 40) AS g), s AS (SELECT *, 2 * sqrt(g) * al AS t FROM w), f AS (
  SELECT 'LowPass' AS kind, [(1 - c) / 2, 1 - c, (1 - c) / 2, 1 + al, -2 * c, 1 - al] AS v FROM s
  UNION ALL SELECT 'HighPass', [(1 + c) / 2, -(1 + c), (1 + c) / 2, 1 + al, -2 * c, 1 - al] FROM s
  UNION ALL SELECT 'BandPass', [al, 0, -al, 1 + al, -2 * c, 1 - al] FROM s
  UNION ALL SELECT 'AllPass', [1 - al, -2 * c, 1 + al, 1 + al, -2 * c, 1 - al] FROM s
  UNION ALL SELECT 'Notch', [1, -2 * c, 1, 1 + al, -2 * c, 1 - al] FROM s
  UNION ALL SELECT 'Peaking', [1 + al * g, -2 * c, 1 - al * g, 1 + al / g, -2 * c, 1 - al / g] FROM s
  UNION ALL SELECT 'LowShelf', [g * (g + 1 - (g - 1) * c + t), 2 * g * (g - 1 - (g + 1) * c), g * (g + 1 - (g - 1) * c - t), g + 1 + (g - 1) * c + t, -2 * (g - 1 + (g + 1) * c), g + 1 + (g - 1) * c - t] FROM s
  UNION ALL SELECT 'HighShelf', [g * (g + 1 + (g - 1) * c + t), -2 * g * (g - 1 + (g + 1) * c), g * (g + 1 + (g - 1) * c - t), g + 1 - (g - 1) * c + t, 2 * (g - 1 - (g + 1) * c), g + 1 - (g - 1) * c - t] FROM s
) SELECT kind, {', '.join(f"{r(f'v[{k}] / v[4]')} AS {n}" for k, n in ((1, 'b0'), (2, 'b1'), (3, 'b2'), (5, 'a1'), (6, 'a2')))} FROM f"""
_REQ = "q AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'SignInversionAttack' WHEN 'view' THEN 'SmoothingAttack' WHEN 'error' THEN 'NoSuchAttack' WHEN 'purchase' THEN 'EchoAttack' ELSE 'OtherAttack' END AS attack FROM events)"
SQL["known_attacks_semi"] = f"WITH {_REQ} SELECT event_id, attack FROM q WHERE attack IN ('SignInversionAttack', 'SmoothingAttack', 'EchoAttack')"
SQL["unknown_attacks_anti"] = f"WITH {_REQ} SELECT attack, count(*) AS n FROM q WHERE attack IN ('NoSuchAttack', 'OtherAttack') GROUP BY attack"
SQL["attack_subset"] = f"WITH {_REQ} SELECT attack, count(*) AS n FROM q WHERE attack IN ('SignInversionAttack', 'EchoAttack') GROUP BY attack"
SQL["display_name"] = rf"WITH {_REQ} SELECT event_id, trim(regexp_replace(replace(attack, 'Attack', ''), '([A-Z])', ' \1', 'g')) AS name FROM q"
SQL["param_merge"] = "SELECT * FROM (VALUES ('PCMQuantizationAttack', 'pcm', '8'), ('GaussianNoiseAttack', 'snr_db', '20.0'), ('SmoothingAttack', 'window_size', '10')) AS t(attack, name, value)"
SQL["model_rate_join"] = "SELECT vec_id AS clip_id, CASE WHEN vec_id % 2 = 0 THEN 22050 ELSE 16000 END AS rate FROM embeddings"
SQL["clip_attack_cross"] = "SELECT vec_id AS clip_id, attack FROM embeddings, (VALUES ('EchoAttack'), ('SignInversionAttack'), ('SmoothingAttack')) AS a(attack)"
SQL["catalog_models"] = "SELECT * FROM (VALUES ('SpreadA', 16000, 16), ('SpreadB', 16000, 16)) AS t(model, sampling_rate, watermark_size)"
SQL["stream_tumbling"] = f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {r('sum(value)', 6)} AS total FROM events GROUP BY ALL"
SQL["stream_sessions"] = f"""WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, value, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n, {r('sum(value)', 6)} AS total FROM s GROUP BY user_id, session"""
SQL["stream_running_accuracy"] = f"SELECT event_type AS attack, count(value) AS n, {r('avg(value)', 6)} AS accuracy_mean FROM events GROUP BY ALL"

_BENCH = f"""{MARKED}, a AS (
  SELECT clip_id, 'SignInversionAttack' AS attack, i, -x AS x, x AS s FROM w
  UNION ALL SELECT clip_id, 'PCMQuantizationAttack', i, trunc(least(greatest(x * 32767e0, -32768e0), 32767e0)) / 32767e0, x FROM w
  UNION ALL SELECT clip_id, 'SmoothingAttack', i, sum(x) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4e0, x FROM w
  UNION ALL SELECT clip_id, 'GaussianNoiseAttack', i, x + sqrt(avg(x * x) OVER (PARTITION BY clip_id) / 100e0) * {normal('7:gauss', 'clip_id', 'i')}, x FROM w
), d AS (
  SELECT clip_id, attack, i % 16 AS b, CASE WHEN sum(x * ({chip(1, 'i')})) >= 0 THEN 1 ELSE 0 END AS bit FROM a GROUP BY ALL
), v AS (
  SELECT clip_id, attack, 100e0 * sum(CASE WHEN bit = CASE WHEN {u('7:message', 'b')} > 0.5 THEN 1 ELSE 0 END THEN 1 ELSE 0 END) / 16 AS accuracy FROM d GROUP BY ALL
), st AS (SELECT attack, count(*) AS n, avg(accuracy) AS accuracy_mean FROM v GROUP BY attack)"""
_BAND = "CASE WHEN accuracy_mean >= 95 THEN 'excellent' WHEN accuracy_mean >= 85 THEN 'good' WHEN accuracy_mean >= 70 THEN 'fair' ELSE 'poor' END"
SQL["bench_results"] = f"WITH {_BENCH}, sn AS (SELECT clip_id, attack, 10 * log10(sum(s * s) / sum((x - s) * (x - s))) AS snr FROM a GROUP BY ALL) SELECT clip_id, attack, {r('accuracy')} AS accuracy, {r('snr', 6)} AS snr FROM v JOIN sn USING (clip_id, attack)"
SQL["results_nested_json"] = f"""WITH {_BENCH}, sn AS (SELECT clip_id, attack, {r('10 * log10(sum(s * s) / sum((x - s) * (x - s)))', 3)} AS snr FROM a GROUP BY ALL)
SELECT clip_id, '{{' || string_agg('"' || attack || '":{{"accuracy":' || ({r('accuracy', 6)})::VARCHAR || ',"snr":' || snr || '}}', ',' ORDER BY attack) || '}}' AS scores
FROM v JOIN sn USING (clip_id, attack) WHERE attack IN ('SignInversionAttack', 'PCMQuantizationAttack') GROUP BY clip_id"""
SQL["mean_accuracy"] = f"WITH {_BENCH} SELECT attack, n, {r('accuracy_mean', 6)} AS accuracy_mean FROM st"
SQL["overall_mean"] = f"WITH {_BENCH} SELECT {r('coalesce(avg(accuracy_mean), 0)', 6)} AS overall FROM st"
SQL["accuracy_bands"] = f"WITH {_BENCH} SELECT {_BAND} AS band, count(*) AS n FROM st GROUP BY ALL"
SQL["report_rows"] = rf"WITH {_BENCH} SELECT attack, trim(regexp_replace(replace(attack, 'Attack', ''), '([A-Z])', ' \1', 'g')) AS name, printf('%.2f', accuracy_mean) AS accuracy, {_BAND} AS band FROM st"
_CROSSED = f"""{MARKED}, {embed('w', 'sm', 1, OWN_BIT('7:same-model'))}, {embed('w', 'cm', 2, OWN_BIT('7:cross-model'))}, {embed('e', 'c2', 1, OWN_BIT('7:collusion'))}, a AS (
  SELECT clip_id, 'SameModelAttack' AS attack, i, x FROM sm UNION ALL SELECT clip_id, 'CrossModelAttack', i, x FROM cm
  UNION ALL SELECT clip_id, 'CollusionAttack', i, CASE WHEN {u('7:coin', 'clip_id', '(i // 25)')} > 0.5 THEN w.x ELSE c2.x END FROM w JOIN c2 USING (clip_id, i)
), d AS (
  SELECT clip_id, attack, i % 16 AS b, sum(x * ({chip(1, 'i')})) >= 0 AS bit, sum(x * ({chip(2, 'i')})) >= 0 AS other FROM a GROUP BY ALL
), v AS (
  SELECT clip_id, attack, 100e0 * sum((bit = ({u('7:message', 'b')} > 0.5))::INTEGER) / 16 AS accuracy,
    CASE WHEN attack = 'CrossModelAttack' THEN 100e0 * sum((other = ({u('7:cross-model', 'clip_id', 'b')} > 0.5))::INTEGER) / 16 END AS crossed FROM d GROUP BY clip_id, attack
)"""
SQL["bench_cross_model"] = f"WITH {_CROSSED} SELECT attack, count(*) AS n, {r('avg(accuracy)', 6)} AS accuracy_mean, {r('avg(crossed)', 6)} AS accuracy_cross_model_mean FROM v GROUP BY attack"
