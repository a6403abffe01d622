"""SQL for the queries, written apart from the operators: plain joins on (idx + k) mod n, theta joins and generate_series."""

from __future__ import annotations

from .synth import BASE

TAU = "(2 * pi())"


def r(expr: str, name: str, p: int = 4) -> str:
    return f"case when round({expr}, {p}) = 0 then 0.0 else round({expr}, {p}) end as {name}"


def cols(p: int = 4, **kw: str) -> str:
    return ", ".join(r(v, k, p) for k, v in kw.items())


def turn(a: str, b: str, c: str) -> str:
    """The turn at b from a to c; each is a pair 'x,y'."""
    (ax, ay), (bx, by), (cx, cy) = (s.split(",") for s in (a, b, c))
    return f"((atan2({cy} - {by}, {cx} - {bx}) - atan2({ay} - {by}, {ax} - {bx}) + {TAU}) % {TAU})"


def near(src: str, step: int, alias: str, of: str = "a") -> str:
    """A join with the row ``step`` further around the ring."""
    return f"join {src} {alias} on {alias}.track_id = {of}.track_id and {alias}.idx = ({of}.idx + {step} + {of}.n) % {of}.n"


def feat(src: str, name: str) -> str:
    """CTEs that give ``name``: src with width, angle, off, ox, oy (the point driven)."""
    a3 = f"{turn('q.cx,q.cy', 'a.cx,a.cy', 'a.x1,a.y1')} - pi()"
    b3 = f"{turn('a.x1,a.y1', 'a.cx,a.cy', 'p.cx,p.cy')} - pi()"
    return f"""{name}_c as (select *, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy from {src}),
      {name} as (select a.*, sqrt((a.x1 - a.x2) * (a.x1 - a.x2) + (a.y1 - a.y2) * (a.y1 - a.y2)) width,
        {turn('q.cx,q.cy', 'a.cx,a.cy', 'p.cx,p.cy')} - pi() angle, ({b3}) - (({a3}) + ({b3})) / 2 off,
        a.x1 + (a.x2 - a.x1) * a.pos ox, a.y1 + (a.y2 - a.y1) * a.pos oy
        from {name}_c a {near(f'{name}_c', -1, 'p')} {near(f'{name}_c', 1, 'q')})"""


FEAT = BASE + ", " + feat("tracks", "f")
MIRROR = BASE + ", mirrored as (select track_id, idx, n, x2 x1, -y2 y1, x1 x2, -y1 y2, 1 - pos pos, vel from tracks), " + feat("mirrored", "f")
ENC = FEAT + ", e as (select track_id, idx, n, width, angle, off, case when pos = 0 then -1 else pos end position, case when vel = 0 then -1 else vel end velocity from f)"
F32 = "cast(cast({} as float) as double)"


def lap(src: str, name: str) -> str:
    d = "sqrt((a.ox - p.ox) * (a.ox - p.ox) + (a.oy - p.oy) * (a.oy - p.oy))"
    return f"{name} as (select a.track_id, sum(2 * {d} / nullif(a.vel + p.vel, 0)) t from {src} a {near(src, -1, 'p')} group by 1)"


def apex(src: str) -> str:
    return f"""hot as (select track_id, idx, case when pos < 0.5 then pos else 1 - pos end edge, idx - row_number() over (partition by track_id order by idx) run
        from {src} where (pos < 0.02 or pos > 0.98) and abs(angle) > 0.01),
      best as (select *, row_number() over (partition by track_id, run order by edge, idx) k, count(*) over (partition by track_id, run) run_length from hot),
      ap as (select track_id, idx, edge, run_length from best where k = 1)"""


def cross(a: str, b: str) -> tuple[str, str, str]:
    """(condition, x, y) for the crossing of segments a and b."""
    adx, ady, bdx, bdy = f"({a}.x1 - {a}.x2)", f"({a}.y1 - {a}.y2)", f"({b}.x1 - {b}.x2)", f"({b}.y1 - {b}.y2)"
    delta = f"nullif({adx} * {bdy} - {ady} * {bdx}, 0)"
    da, db = f"({a}.x1 * {a}.y2 - {a}.y1 * {a}.x2)", f"({b}.x1 * {b}.y2 - {b}.y1 * {b}.x2)"
    x, y = f"(({da} * {bdx} - {adx} * {db}) / {delta})", f"(({da} * {bdy} - {ady} * {db}) / {delta})"
    box = " and ".join(f"{v} between least({s}.{c}1, {s}.{c}2) - 1e-9 and greatest({s}.{c}1, {s}.{c}2) + 1e-9" for s in (a, b) for c, v in (("x", x), ("y", y)))
    return box, x, y


def ring_of(src: str, name: str, x: str, y: str, step: int = 1) -> str:
    """Segments from each point of a ring to the next (or from the one before)."""
    a, b = ("a", "q") if step == 1 else ("q", "a")
    sub = lambda e, t: e.replace("$", f"{t}.")
    return f"{name} as (select a.track_id, a.idx, a.n, {sub(x, a)} x1, {sub(y, a)} y1, {sub(x, b)} x2, {sub(y, b)} y2 from {src} a {near(src, step, 'q')})"


MID = ("(($x1 + $x2) / 2)", "(($y1 + $y2) / 2)")
BOX4 = cols(x1="x1", y1="y1", x2="x2", y2="y2")
BOX3 = cols(3, x1="x1", y1="y1", x2="x2", y2="y2")


def normals_of(src: str, name: str, length: float, x: str = "x", y: str = "y") -> str:
    ang = f"atan2(p.{y} - a.{y}, p.{x} - a.{x}) + ({turn(f'p.{x},p.{y}', f'a.{x},a.{y}', f'q.{x},q.{y}')} - pi()) / 2"
    return f"""{name}_a as (select a.track_id, a.idx, a.n, a.{x} x, a.{y} y, {ang} g from {src} a {near(src, -1, 'p')} {near(src, 1, 'q')}),
      {name} as (select track_id, idx, n, x, y, x + sin(g) * {length / 2} x1, y - cos(g) * {length / 2} y1, x - sin(g) * {length / 2} x2, y + cos(g) * {length / 2} y2 from {name}_a)"""


def catmull_of(src: str, name: str, samples: int, x: str, y: str) -> str:
    """src: track_id, idx, n and point columns."""

    def mixed(a: str, b: str, lo: str, hi: str, c: str) -> str:
        return f"(({hi} - t) / ({hi} - {lo}) * {a}{c} + (t - {lo}) / ({hi} - {lo}) * {b}{c})"

    lv1 = ", ".join(f"{mixed(f'p{i}', f'p{i + 1}', f't{i}', f't{i + 1}', c)} a{i}{c}" for i in range(3) for c in "xy")
    lv2 = ", ".join(f"{mixed(f'a{i}', f'a{i + 1}', f't{i}', f't{i + 2}', c)} b{i}{c}" for i in range(2) for c in "xy")
    d = lambda i: f"sqrt(sqrt((p{i}x - p{i + 1}x) * (p{i}x - p{i + 1}x) + (p{i}y - p{i + 1}y) * (p{i}y - p{i + 1}y)))"
    return f"""{name}_p as (select a.track_id, a.idx ai, a.n, m.{x} p0x, m.{y} p0y, a.{x} p1x, a.{y} p1y, q.{x} p2x, q.{y} p2y, w.{x} p3x, w.{y} p3y
        from {src} a {near(src, -1, 'm')} {near(src, 1, 'q')} {near(src, 2, 'w')}),
      {name}_t as (select *, cast(0 as double) t0, {d(0)} t1, {d(0)} + {d(1)} t2, {d(0)} + {d(1)} + {d(2)} t3 from {name}_p),
      {name}_s as (select {name}_t.*, g.s, t1 + (t2 - t1) * g.s / cast({samples} as double) t from {name}_t, generate_series(0, {samples - 1}) g(s)),
      {name}_1 as (select *, {lv1} from {name}_s), {name}_2 as (select *, {lv2} from {name}_1),
      {name} as (select track_id, ai, s, ai * {samples} + s idx, n * {samples} n, n n0, {mixed('b0', 'b1', 't1', 't2', 'x')} x, {mixed('b0', 'b1', 't1', 't2', 'y')} y from {name}_2)"""


STAT = {
    "max": "max(abs({d}))", "mean": "avg({d})", "mean_absolute": "avg(abs({d}))", "rmse": "sqrt(avg({d} * {d}))",
    "ci95": "list_sort(list(abs({d})) filter (where {d} is not null))[cast(floor(count({d}) * cast(0.95 as double)) as int) + 1]",
    "percentage_mean": "avg({p})", "percentage_max": "max({p})", "percentage_ci95": "list_sort(list({p}) filter (where {p} is not null))[cast(floor(count({p}) * cast(0.95 as double)) as int) + 1]",
    "apex_mean": "avg(case when hit then {d} end)", "apex_mean_absolute": "avg(abs(case when hit then {d} end))", "apex_max": "max(abs(case when hit then {d} end))",
}
LAP = {"truth": "t.t", "predicted": "u.t", "error": "t.t - u.t", "abs_error": "abs(t.t - u.t)", "percentage": "abs(t.t - u.t) / t.t * 100", "error_per_minute": "abs(t.t - u.t) / t.t * 60"}


def evaluation(extra: str, position: str, percent: str, joined: str = "") -> str:
    """CTE ``ev``: one row per track with all figures."""
    stats = ", ".join(f"{v.format(d=f'{k}_delta', p=f'{k}_pct')} {k}_{s}" for k in ("position", "velocity") for s, v in STAT.items())
    laps = ", ".join(f"{v} laptime_{k}" for k, v in LAP.items())
    return (
        FEAT
        + f", predx as (select *, x1 + (x2 - x1) * pos ox, y1 + (y2 - y1) * pos oy from predicted), {apex('f')}, {lap('f', 'lt')}, {lap('predx', 'lp')}{extra}, "
        + f"""span as (select a.track_id, max(greatest(a.vel, p.vel)) - min(least(a.vel, p.vel)) w from f a join predx p using (track_id, idx) group by 1),
      d as (select a.track_id, {position} position_delta, {percent} position_pct, a.vel - p.vel velocity_delta, abs(a.vel - p.vel) / span.w * 100 velocity_pct, ap.idx is not null hit
        from f a join predx p on p.track_id = a.track_id and p.idx = a.idx join span on span.track_id = a.track_id
        left join ap on ap.track_id = a.track_id and ap.idx = a.idx {joined}),
      st as (select track_id, {stats} from d group by 1),
      ev as (select st.*, {laps} from st join lt t on t.track_id = st.track_id join lp u on u.track_id = st.track_id)"""
    )


FIGURES = [f"laptime_{k}" for k in LAP] + [f"{k}_{s}" for k in ("position", "velocity") for s in STAT]
DIST = "sqrt((a.ox - p.ox) * (a.ox - p.ox) + (a.oy - p.oy) * (a.oy - p.oy))"
EVAL = evaluation("", f"case when p.pos < a.pos then -{DIST} else {DIST} end", "abs(p.pos - a.pos) * 100")
ALL = cols(6, **{c: f"({c} + cast(1e-9 as double))" for c in FIGURES})
NAMED = EVAL + ", nm as (select *, 'v' || cast(track_id % 3 as varchar) vehicle, 't' || cast(track_id % 7 as varchar) track from ev)"
MEANS = cols(6, **{c: f"({'max' if c.endswith('_max') else 'avg'}({c}) + cast(1e-9 as double))" for c in FIGURES})
_hit, _hx, _hy = cross("m", "q")
MISS = (
    f", {normals_of('f', 'nn', 10.0, 'ox', 'oy')}, {catmull_of('predx', 'cc', 5, 'ox', 'oy')}, {ring_of('cc', 'cl', '$x', '$y')}, "
    f"us as (select m.track_id, m.idx, min(case when q.idx is not null then sqrt(({_hx} - m.x) * ({_hx} - m.x) + ({_hy} - m.y) * ({_hy} - m.y)) end) delta "
    f"from nn m left join cl q on q.track_id = m.track_id and {_hit} group by 1, 2), "
    "ur as (select us.*, us.delta / f.width ratio from us join f using (track_id, idx))"
)


def scaled(v: str, hi: str, lo: str) -> str:
    return f"case when {hi} = {lo} then 0.0 else ({v} - {lo}) / ({hi} - {lo}) end"


BOUNDS = "select max(abs(width)) max_width, min(abs(width)) min_width, max(abs(angle)) max_angle, max(abs(off)) max_offset, max(abs(velocity)) max_velocity, min(abs(velocity)) min_velocity from e"
SCALARS = ("max_width", "min_width", "max_angle", "max_offset", "max_velocity", "min_velocity")
VEHICLES = "v as (select s_suppkey track_id, cast(s_suppkey % 13 as double) a, cast(s_acctbal as double) b, cast(s_suppkey % 3 as double) c from supplier), vl as (select track_id, 0 dim, a value from v union all select track_id, 1, b from v union all select track_id, 2, c from v)"
CHANNEL = "case c when 0 then {0}.width when 1 then {0}.angle else {0}.off end"
PATHSEG = BASE + ", " + ring_of("path", "ps", "$x", "$y")
_ix = cross("a", "b")
CROSSINGS = PATHSEG + f" select a.track_id, a.idx, b.idx seg_idx, {r(_ix[1], 'hx', 3)}, {r(_ix[2], 'hy', 3)} from tracks a join ps b on b.track_id = a.track_id and {_ix[0]}"


def resampled(loop: bool, spacing: float) -> str:
    return (
        BASE + ", " + ring_of("tracks", "sg", *MID)
        + f""", l as (select *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) len from sg {'' if loop else 'where idx < n - 1'}),
      cu as (select *, sum(len) over (partition by track_id order by idx) hi, sum(len) over (partition by track_id) total from l),
      k as (select track_id, idx, n, x1, y1, x2, y2, len, hi - len lo0, coalesce(lag(hi) over (partition by track_id order by idx), 0) lo, hi, total from cu),
      pt as (select k.track_id, g.k idx, x1 + (x2 - x1) * ((g.k * {spacing} - lo) / len) x, y1 + (y2 - y1) * ((g.k * {spacing} - lo) / len) y
        from k join generate_series(0, 2000) g(k) on g.k * cast({spacing} as double) <= hi and (g.k * cast({spacing} as double) > lo or (g.k = 0 and lo = 0))
        where g.k * cast({spacing} as double) < total {'-' if loop else '+'} cast({spacing / 2} as double))
      select track_id, idx, {cols(3, x='x', y='y')} from pt"""
    )


def by_vector(w: str) -> str:
    """Sums of the vectors of w (track_id, idx, j, k, v)."""
    v = F32.format("v")
    return f" select track_id, idx, j, {r(f'sum({v})', 'total', 2)}, {r(f'sum({v} * (k + 1))', 'weighted', 2)} from {w} group by 1, 2, 3"


def _window_sql(f: int) -> str:
    return ENC + f""", w as (select e.track_id, e.idx, e.n, g.k from e, generate_series(0, {2 * f}) g(k)),
      x as (select w.track_id, w.idx, cc.c j, w.k, {CHANNEL.format('s')} v
        from w join e s on s.track_id = w.track_id and s.idx = (w.idx + w.k - {f} + 1000 * w.n) % w.n, generate_series(0, 2) cc(c))"""


def _lag_sql() -> str:
    """Patches of 5 lines: 15 values and a time."""
    return ENC + f""", z as (select cast(ceil(max(n) / cast(5 as double)) as bigint) * 2 most from e),
      g as (select track_id, idx, n, n + idx + 1 len, (5 - (n + idx + 1) % 5) % 5 missing, (n + 4) // 5 places, idx // 5 + 1 tail, most from e, z),
      h as (select *, (len + missing) // 5 m from g),
      w as (select h.*, jj.j, kk.k, jj.j - (most - m) pj from h, generate_series(0, (select most - 1 from z)) jj(j), generate_series(0, 15) kk(k)),
      y as (select *, pj * 5 + k // 3 - missing src, k % 3 c from w),
      x as (select y.track_id, y.idx, y.j, y.k, case when pj < 0 then -1
          when k = 15 then case when pj >= m - tail then (pj - (m - tail)) / cast(greatest(1, places - 1) as double) when pj < places then pj / cast(greatest(1, places - 1) as double) else 0 end
          when src < 0 then -1 else {CHANNEL.format('s')} end v
        from y left join e s on s.track_id = y.track_id and s.idx = y.src % y.n and y.src >= 0 and y.pj >= 0 and y.k < 15)""" + by_vector("x")


def _stateful_sql() -> str:
    value = f"case when k = 15 then (case when j >= m - places then j - (m - places) when j < places then j else 0 end) / cast(greatest(1, places - 1) as double) when src < 0 then -1 else {CHANNEL.format('s')} end"
    return ENC + f""", t as (select track_id, n, (5 - (2 * n) % 5) % 5 missing, (n + 4) // 5 places from e where idx = 0),
      u as (select *, (2 * n + missing) // 5 m from t),
      w as (select u.*, jj.j, kk.k, jj.j * 5 + kk.k // 3 - missing src, kk.k % 3 c from u, generate_series(0, (select max(m) from u)) jj(j), generate_series(0, 15) kk(k) where jj.j < m)
      select w.track_id, w.j, w.k, {r(F32.format(value), 'v', 3)}
      from w left join e s on s.track_id = w.track_id and s.idx = w.src % w.n and w.src >= 0 and w.k < 15"""


def _stateful_targets_sql() -> str:
    return ENC + f""", t as (select track_id, n, (n + 4) // 5 m from e where idx = 0),
      w as (select t.*, jj.j, kk.k, (n - 5 * (m - jj.j + 1) - 2 + kk.k + 10 * n) % n src from t, generate_series(0, (select max(m) from t)) jj(j), generate_series(0, 14) kk(k) where jj.j < m)
      select w.track_id, w.j, w.k, {r('s.velocity', 'v')} from w join e s on s.track_id = w.track_id and s.idx = w.src"""


def _bidirectional_sql() -> str:
    """Patches of 5 lines: of each line 3 values onward and 3 backward."""
    return ENC + f""", z as (select cast(ceil(max(n) / cast(5 as double)) as bigint) most from e),
      g as (select track_id, idx, n, (5 - n % 5) % 5 missing, (n + 4) // 5 m, most from e, z),
      w as (select g.*, jj.j, kk.k, (jj.j - (most - m)) * 5 + kk.k // 6 - missing src, kk.k % 6 c6, (kk.k % 6) % 3 c from g, generate_series(0, (select most - 1 from z)) jj(j), generate_series(0, 29) kk(k)),
      x as (select w.track_id, w.idx, w.j, w.k, case when src < 0 then -1 else {CHANNEL.format('s')} end v
        from w left join e s on s.track_id = w.track_id and s.idx = case when c6 < 3 then (w.idx + 1 + src) % w.n else (w.idx - 1 - src + 2 * w.n) % w.n end and w.src >= 0)""" + by_vector("x")


def _splice_sql() -> str:
    hit, hx, hy = cross("e", "b")
    return BASE + f""", legs as (select a.track_id, a.idx, q.x x1, q.y y1, a.x x2, a.y y2, q.vel v0, a.vel v1, q.acc c0, a.acc c1 from path a {near('path', -1, 'q')}),
      ex as (select a.track_id, a.idx, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, g.k, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) len from tracks a, generate_series(0, 5) g(k)),
      e as (select *, ax1 - (ax2 - ax1) / len * gr x1, ay1 - (ay2 - ay1) / len * gr y1, ax2 + (ax2 - ax1) / len * gr x2, ay2 + (ay2 - ay1) / len * gr y2
        from (select *, least(k / cast(5 as double), len / 2) gr from ex) z),
      h as (select e.track_id, e.idx, e.k, b.idx seg, {hx} hx, {hy} hy, b.x1, b.y1, b.x2, b.y2, b.v0, b.v1, b.c0, b.c1, row_number() over (partition by e.track_id, e.idx, e.k order by b.idx) rn,
          count(*) over (partition by e.track_id, e.idx, e.k) cnt from e join legs b on b.track_id = e.track_id and {hit}),
      lo as (select track_id, idx, min(k) k from h where cnt in (1, 2) group by 1, 2),
      p as (select a.*, b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2 from lo join h a on a.track_id = lo.track_id and a.idx = lo.idx and a.k = lo.k and a.rn = 1
        left join h b on b.track_id = lo.track_id and b.idx = lo.idx and b.k = lo.k and b.rn = 2),
      z as (select *, case when cnt = 1 then hx when (x1 = bx1 and y1 = by1) or (x1 = bx2 and y1 = by2) then x1 when (x2 = bx1 and y2 = by1) or (x2 = bx2 and y2 = by2) then x2 else x1 end px,
        case when cnt = 1 then hy when (x1 = bx1 and y1 = by1) or (x1 = bx2 and y1 = by2) then y1 when (x2 = bx1 and y2 = by1) or (x2 = bx2 and y2 = by2) then y2 else y1 end py from p),
      o as (select t.track_id, t.idx, z.track_id is null failed, sqrt((px - t.x1) * (px - t.x1) + (py - t.y1) * (py - t.y1)) d1, sqrt((px - t.x2) * (px - t.x2) + (py - t.y2) * (py - t.y2)) d2,
        sqrt((t.x1 - t.x2) * (t.x1 - t.x2) + (t.y1 - t.y2) * (t.y1 - t.y2)) size, v0, v1, c0, c1,
        greatest(cast(0 as double), least(cast(1 as double), sqrt((z.x1 - px) * (z.x1 - px) + (z.y1 - py) * (z.y1 - py)) / sqrt((z.x1 - z.x2) * (z.x1 - z.x2) + (z.y1 - z.y2) * (z.y1 - z.y2)))) l
        from tracks t left join z on z.track_id = t.track_id and z.idx = t.idx)
      select track_id, idx, {r('case when d1 > size then 1 when d2 > size then 0 else d1 / size end', 'pos', 3)},
        case when failed then null else {r('v0 * (1 - l) + v1 * l', 'vel', 3).rsplit(' as ', 1)[0]} end as vel, case when failed then null else {r('c0 * (1 - l) + c1 * l', 'acc', 3).rsplit(' as ', 1)[0]} end as acc, failed from o"""


def _trim_sql() -> str:
    out = FEAT + """, lg as (select *, least(cast(4 as double), width / 2) gr from f),
      w as (select track_id, idx, n, x1 - (x2 - x1) / width * gr x1, y1 - (y2 - y1) / width * gr y1, x2 + (x2 - x1) / width * gr x2, y2 + (y2 - y1) / width * gr y2 from lg),
      wc as (select *, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy from w), """
    out += ring_of("tracks", "lb", "$x1", "$y1") + ", " + ring_of("tracks", "rb", "$x2", "$y2")
    for k, b in (("1", "lb"), ("2", "rb")):
        hit, hx, hy = cross("h", "b")
        out += f""", h{k} as (select track_id, idx, x{k} x1, y{k} y1, cx x2, cy y2 from wc),
          m{k} as (select h.track_id, h.idx, {hx} hx, {hy} hy, row_number() over (partition by h.track_id, h.idx order by ({hx} - h.x2) * ({hx} - h.x2) + ({hy} - h.y2) * ({hy} - h.y2), b.idx) rn
            from h{k} h join {b} b on b.track_id = h.track_id and {hit})"""
    return out + f""" select wc.track_id, wc.idx, {cols(3, x1='coalesce(p.hx, wc.x1)', y1='coalesce(p.hy, wc.y1)', x2='coalesce(q.hx, wc.x2)', y2='coalesce(q.hy, wc.y2)')}
      from wc left join m1 p on p.track_id = wc.track_id and p.idx = wc.idx and p.rn = 1 left join m2 q on q.track_id = wc.track_id and q.idx = wc.idx and q.rn = 1"""


def _extend_sql() -> str:
    hit, hx, hy = cross("h", "b")
    return BASE + f""", bp as (select track_id, idx, n, (x1 + x2) / 2 * cast(0.985 as double) x, (y1 + y2) / 2 * cast(0.985 as double) y from tracks), {ring_of('bp', 'bs', '$x', '$y', -1)},
      h as (select track_id, idx, g.k ext, (x1 + x2) / 2 x1, (y1 + y2) / 2 y1, x1 + (x1 - (x1 + x2) / 2) * g.k x2, y1 + (y1 - (y1 + y2) / 2) * g.k y2 from tracks, generate_series(0, 4) g(k)),
      c as (select h.track_id, h.idx, h.ext, b.idx seg_idx, {hx} hx, {hy} hy, min(h.ext) over (partition by h.track_id, h.idx) lo from h join bs b on b.track_id = h.track_id and {hit})
      select track_id, idx, ext, seg_idx, {cols(3, hx='hx', hy='hy')} from c where ext = lo"""


def _projected_sql() -> str:
    """Snyder's ellipsoidal form, step by step; the way back gives what went in."""
    a, f = "cast(6378137.0 as double)", "(1 / cast(298.257223563 as double))"
    e2 = f"({f} * (2 - {f}))"
    return BASE + f""", p as (select cast(track_id as varchar) "name", idx, x / 5000 lon, 50 + y / 5000 lat from path), o as (select "name", avg(lon) lon0, avg(lat) lat0 from p group by 1),
      j as (select p.*, radians(lat) b, radians(lat0) a, radians(lon - lon0) d from p join o using ("name")),
      k as (select *, {a} / sqrt(1 - {e2} * sin(a) * sin(a)) n1, {a} / sqrt(1 - {e2} * sin(b) * sin(b)) n2 from j),
      l as (select *, atan((1 - {e2}) * tan(b) + {e2} * n1 * sin(a) / (n2 * cos(b))) psi from k),
      m as (select *, sin(d) * cos(psi) ea, cos(a) * sin(psi) - sin(a) * cos(psi) * cos(d) we, sin(a) * sin(psi) + cos(a) * cos(psi) * cos(d) co from l),
      q as (select *, atan2(ea, we) az, atan2(sqrt(ea * ea + we * we), co) s, sqrt({e2} / (1 - {e2})) * sin(a) gg from m),
      r as (select *, sqrt({e2} / (1 - {e2})) * cos(a) * cos(az) h from q),
      c as (select *, n1 * s * (1 - pow(s, 2) * pow(h, 2) * (1 - pow(h, 2)) / 6 + pow(s, 3) / 8 * gg * h * (1 - 2 * pow(h, 2)) + pow(s, 4) / 120 * (pow(h, 2) * (4 - 7 * pow(h, 2)) - 3 * pow(gg, 2) * (1 - 7 * pow(h, 2))) - pow(s, 5) / 48 * gg * h) c from r)
      select "name", idx, {cols(2, x='c * sin(az)', y='c * cos(az)')}, {cols(5, lon='lon', lat='lat')} from c"""


def fixed_weights(widths: tuple[int, ...], heads: int) -> dict:
    """Weights of a small network, by a rule: hidden layers of these widths and two heads."""
    import numpy as np

    def layer(a: int, b: int, k: int):
        i, j = np.meshgrid(np.arange(a), np.arange(b), indexing="ij")
        return np.sin(0.7 * i + 1.3 * j + k) * 0.4, np.cos(0.5 * np.arange(b) + k) * 0.1

    pairs = list(zip(widths[:-1], widths[1:], strict=True))
    return {"hidden": [layer(a, b, k) for k, (a, b) in enumerate(pairs)], "heads": [layer(widths[-1], heads, 10 + k) for k in range(2)]}


def _model_sql() -> str:
    """Layer by layer with lists of weights; the mean of the three outputs that each line gets."""
    w = fixed_weights((17, 8, 5), 3)
    num = lambda x: "[" + ", ".join(f"cast({v!r} as double)" for v in x.tolist()) + "]"

    def dense(x: str, layer, act: str) -> str:
        m, b = layer
        return "[" + ", ".join(act.format(f"(list_dot_product({x}, {num(m[:, j])}) + cast({b.tolist()[j]!r} as double))") for j in range(m.shape[1])) + "]"

    sigmoid, hard = "(1 / (1 + exp(-({0}))))", "greatest(0.0::double, least(1.0::double, ({0} + 2.5::double) / 5))"
    sc = f"sc as (select e.track_id, e.idx, e.n, {scaled('width', 'max_width', 'min_width')} width, angle / max_angle angle, off / max_offset off, b.max_velocity hi, b.min_velocity lo from e, b)"
    ch = lambda c: ", ".join(f"cast(cast(max(case when g.k = {k} then s.{c} end) as float) as double)" for k in range(5))
    return ENC + f""", b as ({BOUNDS}), {sc},
      x as (select a.track_id, a.idx, a.n, a.hi, a.lo, [0.5::double, 0.25::double, {ch('width')}, {ch('angle')}, {ch('off')}] x
        from sc a, generate_series(0, 4) g(k) join sc s on s.track_id = a.track_id and s.idx = (a.idx + g.k - 2 + a.n) % a.n group by 1, 2, 3, 4, 5),
      h1 as (select track_id, idx, n, hi, lo, {dense('x', w['hidden'][0], sigmoid)} h from x),
      h2 as (select track_id, idx, n, hi, lo, {dense('h', w['hidden'][1], sigmoid)} h from h1),
      y as (select track_id, idx, n, hi, lo, {dense('h', w['heads'][0], hard)} p, {dense('h', w['heads'][1], hard)} v from h2),
      z as (select track_id, (idx + g.k - 1 + n) % n idx, hi, lo, p[g.k + 1] p, v[g.k + 1] v from y, generate_series(0, 2) g(k))
      select track_id, idx, {r('avg(v) * (max(hi) - max(lo)) + max(lo)', 'velocity')}, {r('avg(p)', 'position')} from z group by 1, 2"""


def _path_normals_sql() -> str:
    pt = resampled(True, 97.0)
    pt = pt[: pt.rindex("select track_id, idx,")]
    return pt + ", pn as (select track_id, idx, x, y, count(*) over (partition by track_id) n from pt), " + normals_of("pn", "nn", 20.0) + f" select track_id, idx, {BOX3} from nn where n >= 3"


def _loop_sql(i: int) -> str:
    """The spline by t = k (2n - 1) / (2i - 1), each sample from the four points around floor(t)."""
    b = {c: f"((1 - u) * (1 - u) * (1 - u) * p.{c} + (3 * u * u * u - 6 * u * u + 4) * a.{c} + (-3 * u * u * u + 3 * u * u + 3 * u + 1) * q.{c} + u * u * u * w.{c}) / 6" for c in "xy"}
    return BASE + f""", mp as (select track_id, idx, n, (x1 + x2) / 2 x, (y1 + y2) / 2 y from tracks),
      tk as (select track_id, n, g.k, g.k / (cast({2 * i - 1} as double) / (2 * n - 1)) t from mp, generate_series({i // 2}, {2 * i - 1}) g(k) where idx = 0),
      tu as (select *, cast(floor(t) as bigint) f, t - floor(t) u from tk),
      sp as (select tu.track_id, tu.k, {b['x']} x, {b['y']} y from tu join mp a on a.track_id = tu.track_id and a.idx = tu.f % tu.n join mp p on p.track_id = tu.track_id and p.idx = (tu.f - 1 + tu.n) % tu.n
        join mp q on q.track_id = tu.track_id and q.idx = (tu.f + 1) % tu.n join mp w on w.track_id = tu.track_id and w.idx = (tu.f + 2) % tu.n),
      dd as (select sp.*, sqrt((sp.x - s.x) * (sp.x - s.x) + (sp.y - s.y) * (sp.y - s.y)) d from sp join sp s on s.track_id = sp.track_id and s.k = {i // 2}),
      en as (select track_id, arg_min(k, (d, k)) e from dd where k >= {i} group by 1),
      kept as (select sp.track_id, sp.k, sp.x, sp.y, sqrt((sp.x - m.x) * (sp.x - m.x) + (sp.y - m.y) * (sp.y - m.y)) d from sp join en on en.track_id = sp.track_id and sp.k < en.e - 1 join mp m on m.track_id = sp.track_id and m.idx = 0),
      st as (select track_id, arg_min(k, (d, k)) k0, min(k) lo, max(k) hi, count(*) c from kept group by 1),
      seg as (select a.track_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) len from kept a join st on st.track_id = a.track_id join kept b on b.track_id = a.track_id and b.k = case when a.k = st.hi then st.lo else a.k + 1 end)
      select st.track_id, st.c samples, {r('max(l.len)', 'length', 3)}, {r('max(f.x)', 'x', 3)}, {r('max(f.y)', 'y', 3)} from st join (select track_id, sum(len) len from seg group by 1) l on l.track_id = st.track_id join kept f on f.track_id = st.track_id and f.k = st.k0 group by 1, 2"""


def _rounded_splice() -> str:
    return BASE + " select track_id, idx, " + cols(**{c: f"round_even({c}, 1)" for c in ("x1", "y1", "x2", "y2")}) + " from tracks"


def _results(key: str) -> str:
    figures = ("laptime_abs_error", "laptime_percentage", "laptime_error_per_minute", "position_mean_absolute", "position_ci95", "velocity_mean_absolute", "velocity_ci95")
    return NAMED + f" select {key} kind, " + cols(6, **{c: f"(avg({c}) + cast(1e-9 as double))" for c in figures}) + " from nm where position_apex_mean is not null group by 1"


def _smooth_sql(sweeps: int, width: float) -> str:
    """Sweep by sweep over one list for each track."""
    i = "lambda i:"
    around = lambda c: f"list_transform(range(1, n + 1), {i} {c}[case when i = 1 then n else i - 1 end] + {c}[i] + {c}[case when i = n then 1 else i + 1 end])"
    size = "(sqrt(nx[i] * nx[i] + ny[i] * ny[i]) * sqrt(fx[i] * fx[i] + fy[i] * fy[i]))"
    cos = f"case when {size} > 0 then -(nx[i] * fx[i] + ny[i] * fy[i]) / {size} else 1 end"
    turned = "list_transform(cos, lambda c: case when round(c, 8) = 1 then false else acos(greatest(-1, least(1, c))) > pi() / 3 end)"
    pick = lambda v, w: f"list_transform(range(1, n + 1), {i} case when far[i] then {v}[i] else {w}[i] end)"
    unit = lambda a: f"list_transform(range(1, n + 1), {i} case when mx[i] * mx[i] + my[i] * my[i] > 0 then {a}[i] / sqrt(mx[i] * mx[i] + my[i] * my[i]) else 0 end)"
    return BASE.replace("with ev0", "with recursive ev0", 1) + f""", c as (select track_id, idx, n, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy, x1 - (x1 + x2) / 2 vx, y1 - (y1 + y2) / 2 vy, x2 - x1 fx, y2 - y1 fy from tracks),
      r as (select track_id, max(n) n, 0 k, list(vx order by idx) vx, list(vy order by idx) vy, list(fx order by idx) fx, list(fy order by idx) fy from c group by 1
        union all select track_id, n, k + 1, {unit('mx')}, {unit('my')}, fx, fy from (select *, {pick('vx', 'nx')} mx, {pick('vy', 'ny')} my from (select *, {turned} far from (
          select *, list_transform(range(1, n + 1), {i} {cos}) cos from (select *, {around('vx')} nx, {around('vy')} ny from r where k < {sweeps}))))),
      v as (select track_id, unnest(range(0, n)) idx, unnest(vx) vx, unnest(vy) vy from r where k = {sweeps})
      select c.track_id, c.idx, {cols(x1=f'cx + v.vx * {width / 2}', y1=f'cy + v.vy * {width / 2}', x2=f'cx - v.vx * {width / 2}', y2=f'cy - v.vy * {width / 2}')} from c join v on v.track_id = c.track_id and v.idx = c.idx"""


PROJECTED = _projected_sql()


_T = BASE + " select track_id, idx, "
_len = "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"
SQL: dict[str, str] = {
    "geometry_points": _T
    + cols(
        rx="x2 + (x1 - x2) * cos(cast(0.5 as double)) - (y1 - y2) * sin(cast(0.5 as double))", ry="y2 + (x1 - x2) * sin(cast(0.5 as double)) + (y1 - y2) * cos(cast(0.5 as double))",
        mx="x1 + (x2 - x1) * cast(0.25 as double)", my="y1 + (y2 - y1) * cast(0.25 as double)", ux=f"(x2 - x1) / {_len}", uy=f"(y2 - y1) / {_len}", d=_len, la="atan2(y2 - y1, x2 - x1)",
    )
    + " from tracks",
    "geometry_lines": BASE
    + f", l as (select *, {_len} w, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy from tracks), u as (select *, (x2 - x1) / w dx, (y2 - y1) / w dy from l) select track_id, idx, "
    + cols(cx="cx", cy="cy", len="w", dx="dx", dy="dy", sx="cx - dx * cast(1.5 as double)", sy="cy + dy * cast(1.5 as double)", ex="x1 - dx * 2", ey="y2 + dy * 2", capx="x2 + dx * least(20, w / 2)", capy="y1 - dy * least(20, w / 2)")
    + " from u",
    "geometry_angles": BASE
    + f", j as (select a.*, q.x1 qx1, q.y1 qy1, q.x2 qx2, q.y2 qy2 from tracks a {near('tracks', 1, 'q')}), k as (select *, {turn('x1,y1', 'x2,y2', 'qx2,qy2')} t, "
    "((x2 - x1) * (qx2 - qx1) + (y2 - y1) * (qy2 - qy1)) / (sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) * sqrt((qx1 - qx2) * (qx1 - qx2) + (qy1 - qy2) * (qy1 - qy2))) c from j) select track_id, idx, "
    + cols(turn="t", turn3="t - pi()", between="case when round(c, 8) = 1 then 0 else acos(greatest(-1, least(1, c))) end")
    + " from k",
    "interpolated_points": BASE + " select track_id, idx, g.k, " + cols(x="x1 + (x2 - x1) * (g.k / cast(4 as double))", y="y1 + (y2 - y1) * (g.k / cast(4 as double))") + " from tracks, generate_series(1, 3) g(k)",
    "midline": BASE
    + " select track_id, idx, 'mid' side, " + cols(x="(x1 + x2) / 2", y="(y1 + y2) / 2") + " from tracks union all select track_id, idx, 'left', "
    + cols(x="x1", y="y1") + " from tracks union all select track_id, idx, 'right', " + cols(x="x2", y="y2") + " from tracks",
    "optimal_positions": FEAT + " select track_id, idx, " + cols(x="ox", y="oy") + " from f",
    "half_lines": BASE + " select track_id, idx, 'L' side, " + cols(x1="(x1 + x2) / 2", y1="(y1 + y2) / 2", x2="x1", y2="y1") + " from tracks union all select track_id, idx, 'R', " + cols(x1="(x1 + x2) / 2", y1="(y1 + y2) / 2", x2="x2", y2="y2") + " from tracks",
    "track_length": BASE + ", " + ring_of("tracks", "sg", *MID) + f" select track_id, {r(f'sum({_len})', 'length')} from sg group by 1",
    "ring_roll": BASE + " select track_id, (idx - 7 + n) % n idx, " + cols(vel="vel") + " from tracks",
    "ring_segments": BASE + ", " + ring_of("tracks", "sg", "$x1", "$y1") + f" select track_id, idx, {BOX4} from sg",
    "ring_normals": BASE + ", mp as (select track_id, idx, n, (x1 + x2) / 2 x, (y1 + y2) / 2 y from tracks), " + normals_of("mp", "nn", 10.0) + f" select track_id, idx, {BOX4} from nn",
    "resample_loop": resampled(True, 97.0),
    "resample_open": resampled(False, 97.0),
    "catmull_loop": BASE + ", mp as (select track_id, idx, n, (x1 + x2) / 2 x, (y1 + y2) / 2 y from tracks), " + catmull_of("mp", "cc", 4, "x", "y") + " select track_id, idx, " + cols(3, x="x", y="y") + " from cc",
    "catmull_open": BASE + ", mp as (select track_id, idx, n, (x1 + x2) / 2 x, (y1 + y2) / 2 y from tracks), " + catmull_of("mp", "cc", 4, "x", "y") + " select track_id, idx - 4 idx, " + cols(3, x="x", y="y") + " from cc where ai >= 1 and ai < n0 - 2",
    "b_spline": BASE
    + f""", mp as (select track_id, idx, n, (x1 + x2) / 2 x, (y1 + y2) / 2 y from tracks),
      sp as (select a.track_id, a.idx * 4 + g.s idx, g.s / cast(4 as double) t, m.x x0, m.y y0, a.x x1, a.y y1, q.x x2, q.y y2, w.x x3, w.y y3 from mp a {near('mp', -1, 'm')} {near('mp', 1, 'q')} {near('mp', 2, 'w')}, generate_series(0, 3) g(s))
      select track_id, idx, """
    + cols(3, **{c: f"((1 - t) * (1 - t) * (1 - t) * {c}0 + (3 * t * t * t - 6 * t * t + 4) * {c}1 + (-3 * t * t * t + 3 * t * t + 3 * t + 1) * {c}2 + t * t * t * {c}3) / 6" for c in "xy"})
    + " from sp",
    "track_features": FEAT + " select track_id, idx, " + cols(width="width", angle="angle", offset="off") + " from f",
    "track_features_flipped": MIRROR + " select track_id, idx, " + cols(width="width", angle="angle", offset="off", pos="pos") + " from f",
    "encode": ENC + " select track_id, idx, " + cols(width="width", angle="angle", offset="off", position="position", velocity="velocity") + " from e",
    "lap_time": FEAT + ", " + lap("f", "lt") + f" select track_id, {r('t', 'lap_time')} from lt",
    "lap_summary": FEAT + ", " + lap("f", "lt") + f" select f.track_id, count(*) n_lines, {r('max(abs(angle))', 'max_turn')}, {r('max(width)', 'max_width')}, {r('max(lt.t)', 'lap_time')} from f join lt on lt.track_id = f.track_id group by 1",
    "apexes": FEAT + ", " + apex("f") + f" select track_id, idx, {r('edge', 'edge')}, run_length from ap",
    "lateral_deviation": FEAT + " select track_id, idx, " + cols(distance="idx * cast(5 as double)", deviation="pos * width - width / 2", vel="vel") + " from f",
    "encoded_bounds": ENC + f", b as ({BOUNDS}) select " + cols(**{c: c for c in SCALARS}) + " from b",
    "bounds_merge": ENC + f", b as ({BOUNDS}) select " + cols(**{c: c for c in SCALARS}) + " from b",
    "normalised": ENC
    + f", b as ({BOUNDS}) select track_id, idx, "
    + cols(width=scaled("width", "max_width", "min_width"), angle="angle / max_angle", offset="off / max_offset", position="position", velocity=scaled("velocity", "max_velocity", "min_velocity"))
    + " from e, b",
    "vehicle_vectors": f"with {VEHICLES} select track_id, cast(dim as bigint) dim, {r('value', 'value')} from vl",
    "vehicle_scaled": f"with {VEHICLES}, m as (select dim, min(value) lo, max(value) hi from vl group by 1) select track_id, cast(dim as bigint) dim, {r('(value - lo) / case when hi = lo then 1 else hi - lo end', 'value')} from vl join m using (dim)",
    "flat_window": _window_sql(120) + by_vector("x"),
    "window": _window_sql(120) + by_vector("x"),
    "narrow_window": ENC + f", w as (select e.*, cc.c, g.k from e, generate_series(0, 2) cc(c), generate_series(0, 4) g(k)) select a.track_id, a.idx, a.c j, a.k, {r(F32.format(CHANNEL.replace(' c ', ' a.c ').format('s')), 'v', 3)} from w a join e s on s.track_id = a.track_id and s.idx = (a.idx + a.k - 2 + a.n) % a.n",
    "targets": ENC + f", w as (select e.*, g.k from e, generate_series(0, 14) g(k)) select a.track_id, a.idx, a.k, {r('s.velocity', 'v')} from w a join e s on s.track_id = a.track_id and s.idx = (a.idx + a.k - 10 + a.n) % a.n",
    "detransform_window": ENC + " select track_id, idx, " + cols(y_velocity="velocity") + " from e",
    "lag": _lag_sql(),
    "stateful_lag": _stateful_sql(),
    "stateful_targets": _stateful_targets_sql(),
    "bidirectional": _bidirectional_sql(),
    **{k: ENC + " select track_id, idx, " + cols(y_velocity="velocity") + " from e" for k in ("detransform_lag", "detransform_stateful", "detransform_bidirectional")},
    "evaluate": EVAL + f" select track_id, {ALL} from ev",
    "evaluate_by_vehicle": NAMED + f" select vehicle, {MEANS}, count(*) n_tracks from nm group by 1",
    "evaluate_by_track": NAMED + f" select track, {MEANS}, count(*) n_tracks from nm group by 1",
    "evaluate_both": NAMED + f" select vehicle, track, {MEANS}, count(*) n_tracks from nm group by grouping sets ((vehicle), (track))",
    "unsmoothed_errors": EVAL.split(", span as")[0] + MISS + " select track_id, idx, " + cols(3, delta="delta", ratio="ratio") + " from ur",
    "evaluate_unsmoothed": evaluation(MISS, "ur.delta", "ur.ratio", "join ur on ur.track_id = a.track_id and ur.idx = a.idx") + f" select track_id, {ALL} from ev",
    "training_history": "with x as (select event_id % 50 - (event_id % 50) % 2 epoch, avg(case when event_id % 2 = 0 then value end) train, avg(case when event_id % 2 = 1 then value end) val from events group by 1) "
    f"select epoch, {cols(7, train='train', val='val')}, coalesce(val < min(val) over (order by epoch rows between unbounded preceding and 1 preceding), val is not null) best from x",
    "intersections": CROSSINGS,
    "grid_intersections": CROSSINGS,
    "extend_until_hit": _extend_sql(),
    "nearest_point": FEAT + f", m as (select a.track_id, a.idx, p.idx near_idx, sqrt((a.ox - p.x) * (a.ox - p.x) + (a.oy - p.y) * (a.oy - p.y)) d from f a join path p on p.track_id = a.track_id), k as (select *, row_number() over (partition by track_id, idx order by d, near_idx) rn from m) select track_id, idx, near_idx, {r('d', 'distance', 3)} from k where rn = 1",
    "trim_normals": _trim_sql(),
    "splice_path": _splice_sql(),
    "from_xyrl": BASE
    + ", " + normals_of("path", "nn", 10.0)
    + ", z as (select nn.*, cast(idx % 5 + 2 as double) r, cast(idx % 3 + 1 as double) l, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) d1, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) d2 from nn) select track_id, idx, "
    + cols(3, x1="x + (x1 - x) / d1 * l", y1="y + (y1 - y) / d1 * l", x2="x + (x2 - x) / d2 * r", y2="y + (y2 - y) / d2 * r")
    + " from z",
    "sweep_optimum": "with x as (select o_custkey run, o_orderkey p, o_totalprice t, o_totalprice * (o_orderkey % 7 + 1) u from orders), a as (select *, row_number() over (partition by run order by t, p) i, row_number() over (partition by run order by u, p) j from x) "
    f"select a.run, a.p param_1, b.p pred_param_1, {r('abs(a.t - b.t)', 'lap_delta', 2)} from a join a b on b.run = a.run and b.j = 1 where a.i = 1",
    "sweep_names": "select 'car' || cast(s_suppkey % 3 as varchar) || ' - track' || cast(s_suppkey % 5 as varchar) || ' - mass' pair, 'car' || cast(s_suppkey % 3 as varchar) vehicle, 'track' || cast(s_suppkey % 5 as varchar) track, count(*) n, cast(min(s_suppkey) as double) p1, "
    "max(case when s_suppkey % 2 = 0 then cast(s_suppkey % 9 as double) else -1 end) p2 from supplier group by 1, 2, 3",
    "sweep_grid": f"select k step, {r('cast(0.5 as double) + k * cast(0.05 as double)', 'value')} from generate_series(0, 40) g(k)",
    "partition_tracks": BASE + ", c as (select 2 * count(distinct track_id) total from tracks), s as (select total, (total + 6) // 7 size from c) select cast(k as integer) partition_id, least(size, total - k * size) n_tracks from s, generate_series(0, 6) g(k) where k * size < total",
    "swap_left_right": BASE + " select track_id, idx, " + cols(left="y", right="x") + " from path",
    "projected": PROJECTED,
    "model_inference": _model_sql(),
    "smooth_normals": _smooth_sql(400, 80.0),
    "results_by_vehicle": _results("vehicle"),
    "results_by_track": _results("track"),
    "sweep_files": "select * from (select 't' || cast(s_suppkey % 5 as varchar) || ' - car' || cast(s_suppkey % 3 as varchar) || ' - mass - ' || cast(s_suppkey as varchar) path from supplier) where path like '%t2 - car1%'",
    "at_indexes": BASE + " select w.track_id, w.idx, " + cols(vel="t.vel") + " from tracks w join tracks t on t.track_id = w.track_id and t.idx = w.n - 1 - w.idx * 3 where w.idx * 3 < w.n",
    "sum_points": BASE + " select track_id, idx, " + cols(x="(x1 + x2) * cast(1.5 as double)", y="(y1 + y2) * cast(1.5 as double)") + " from tracks",
    "splice_rounded": _rounded_splice(),
    "splice_errors": "with s as (" + _splice_sql() + ") select distinct track_id from s where failed",
    "normals_on_path": _path_normals_sql(),
    "b_spline_loop": _loop_sql(400),
    "rolled_copies": ENC + f", w as (select e.track_id, e.idx, e.n, g.k from e, generate_series(0, 9) g(k)) select w.track_id, w.idx, w.k, {r('case when w.k % 2 = 0 then s.width else s.velocity end', 'v', 3)} from w join e s on s.track_id = w.track_id and s.idx = (w.idx + w.k // 2 - 2 + w.n) % w.n",
    "vehicle_join": f"{ENC}, {VEHICLES} select e.track_id, e.idx, {cols(mass='v.a', front='v.b')} from e join v on v.track_id = e.track_id % 10 + 1",
    "normalise_and_transform": ENC + f", {VEHICLES}, b as ({BOUNDS}), sc as (select e.track_id, e.idx, e.n, {scaled('width', 'max_width', 'min_width')} width, off / max_offset off, velocity from e, b), "
    "used as (select distinct track_id, track_id % 10 + 1 k from e), vb as (select max(v.a) hi, min(v.a) lo from used join v on v.track_id = used.k) "
    f"select a.track_id, a.idx, {r(F32.format('p.width'), 'first', 3)}, {r(F32.format('q.off'), 'last', 3)}, {r('case when hi = lo then v.a - lo else (v.a - lo) / (hi - lo) end', 'mass', 3)}, {r('a.velocity', 'velocity')} "
    f"from sc a {near('sc', -1, 'p')} {near('sc', 1, 'q')} join v on v.track_id = a.track_id % 10 + 1, vb",
    "xyrl_text": BASE + " select track_id, idx, " + cols(3, x="x", y="y", r="cast(idx % 5 + 2 as double)", l="cast(idx % 3 + 1 as double)") + " from path",
    "xyrl_files": BASE + " select 't' || cast(track_id as varchar) \"name\", idx, " + cols(3, x="x", y="y") + ", " + cols(r="cast(idx % 5 + 2 as double)", l="cast(idx % 3 + 1 as double)") + " from path",
    "spliced_files": BASE + " select 't ' || cast(track_id as varchar) \"name\", idx, " + cols(x1="x1", y1="y1", x2="x2", y2="y2", pos="pos", vel="vel", acc="cast(0.5 as double)", mass="cast(track_id as double)") + " from tracks",
    "tracks_not_done": BASE + " select distinct 't' || cast(track_id as varchar) \"name\" from tracks where length('t' || cast(track_id as varchar)) <> 2",
    "partition_files": ENC + ", o as (select track_id, cast(row_number() over (order by track_id % 2, track_id) - 1 as integer) track_no from (select distinct track_id from e)) select e.track_id, o.track_no, e.idx, " + cols(width="width", position="position", velocity="velocity") + " from e join o using (track_id)",
    "bounds_files": ENC + f", b as ({BOUNDS}) select " + cols(**{c: c for c in ("max_width", "min_width", "max_angle", "max_offset")}) + ", true no_max, true no_min from b",
    "project_files": BASE + """, p as (select 'GB ' || cast(track_id as varchar) "name", idx, idx % 4 m, x / 5000 lon, 50 + y / 5000 lat from path where track_id % 4 <> 0),
      q as (select "name", case m when 0 then 'Left' when 1 then 'Left' when 2 then 'Right' else 'Reference' end layer, case when m = 0 then 1 else 0 end part, idx, lon, lat from p)
      select "name", layer, row_number() over (partition by "name", layer order by part, idx) - 1 idx, """ + cols(6, lon="lon", lat="lat") + " from q",
    "count_helpers": BASE + ", n as (select track_id, count(*) n from tracks group by 1) select count(*) tracks, cast(sum(n) as bigint) lines, max(n) longest from n",
    "track_pairs": BASE + " select t.track_id, t.idx, " + cols(pos_delta="t.pos - p.pos", vel_gap="t.vel - max(p.vel) over (partition by t.track_id)") + " from tracks t join predicted p on p.track_id = t.track_id and p.idx = t.idx",
}
