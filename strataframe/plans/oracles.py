"""DuckDB SQL of the figure queries, for comparing results across engines."""

from __future__ import annotations

from strataframe.operators.labels import HUE_NAMES, PALETTE
from strataframe.operators.overlays import distinct_colors
from strataframe.operators.properties import DEFAULTS, SNIPPET

ROWS = "rows_ as (select vec_id - vec_id % 64 as figure_id, row_number() over (partition by vec_id - vec_id % 64 order by label, vec_id) - 1 as y, cast(label as int) as label, embedding from embeddings)"
PX = ROWS + """,
cells as (select figure_id, y, i - 1 as x, label, cast(trunc(cast(embedding[i] as double) * 60) as int) as s from rows_, range(1, 65) t(i)),
px as (select figure_id, y, x, label, greatest(0, least(255, (label * 53) % 256 + s)) as r, greatest(0, least(255, (label * 97 + 80) % 256 + s)) as g, greatest(0, least(255, (label * 151 + 160) % 256 + s)) as b from cells),
dims as (select figure_id, max(y) + 1 as h, max(x) + 1 as w from px group by 1)"""
GRAY = "(r * 0.2125::double + g * 0.7154::double + b * 0.0721::double) / 255.0::double"
LAYERS = "lb as (select figure_id, y, x, label as lbl, r, g, b from px)"

SHEET = """panel as (select s_suppkey as k, s_suppkey // 4 as figure_id, s_suppkey % 4 as slot, s_suppkey % 2 * 100 + 4 + s_suppkey * 7 % 12 as x0, s_suppkey % 4 // 2 * 80 + 3 + s_suppkey * 5 % 10 as y0, 40 + s_suppkey * 13 % 50 as pw, 32 + s_suppkey * 11 % 40 as ph from supplier),
shown as (select * from panel where not (figure_id % 5 = 1 and slot > 1 or figure_id % 5 = 2 and slot % 2 = 1)),
canvas as (select figure_id, y, x from (select distinct figure_id from panel), range(0, 160) t(y), range(0, 200) u(x)),
own as (select c.figure_id, y, x, min(k) as k from canvas c join shown s on c.figure_id = s.figure_id and x >= x0 and x < x0 + pw and y >= y0 and y < y0 + ph where c.figure_id % 5 <> 3 or x % 2 = 0 and y % 2 = 0 group by 1, 2, 3),
px as (select figure_id, y, x, coalesce(k * 53 % 200 + y * 3 % 40, back) as r, coalesce(k * 97 % 200 + y * 3 % 40, back) as g, coalesce(k * 151 % 200 + y * 3 % 40, back) as b from (select *, case when figure_id % 5 = 4 then 0 else 255 end as back from canvas left join own using (figure_id, y, x)))"""
CORNERS = "corners as (select figure_id, round(avg((r * 0.2125::double + g * 0.7154::double + b * 0.0721::double) / 255.0::double), 6) as m from px where (y < 20 or y >= 140) and (x < 20 or x >= 180) group by 1), kinds as (select figure_id, m as corner_mean, case when m < 0.5 then 'black' else 'white' end as background from corners)"


def _content(white: str, dark: str) -> str:
    return f"content as (select figure_id, y, x, case when background = 'black' then v > {dark} else v < {white} end as on_ from (select *, (r * 0.2125::double + g * 0.7154::double + b * 0.0721::double) / 255.0::double as v from px) join kinds using (figure_id))"


def _gaps(ratio: str) -> str:
    """Projections of both axes, their gaps of five or more, and the stretches of ten or more between them."""
    return f"""lines as (select figure_id, 'x' as axis, x as pos, count(*) filter (on_) as n, 160 * {ratio} as most from content group by all union all select figure_id, 'y', y, count(*) filter (on_), 200 * {ratio} from content group by all),
gap as (select figure_id, axis, min(pos) as lo, max(pos) + 1 as hi from (select *, pos - row_number() over (partition by figure_id, axis order by pos) as island from lines where n < most) group by figure_id, axis, island having count(*) >= 5),
stretch as (select figure_id, axis, prev as lo, lo as hi from (select *, coalesce(lag(hi) over (partition by figure_id, axis order by lo, hi), 0) as prev from (select * from gap union all select distinct figure_id, axis, case axis when 'x' then 200 else 160 end, case axis when 'x' then 200 else 160 end from lines)) where lo - prev >= 10)"""


def _sobel(value: str) -> str:
    near = lambda c, w: f"coalesce(lag({c}) over {w}, {c}), coalesce(lead({c}) over {w}, {c})"
    row, col = "(partition by figure_id, y order by x)", "(partition by figure_id, x order by y)"
    return f""",
so0 as (select *, {value} as v from src),
so1 as (select *, {near("v", row).replace("), coalesce(lead", ") as l1, coalesce(lead", 1)} as r1 from so0),
so2 as (select *, (l1 + 2 * v + r1) / 4.0 as sx, l1 - r1 as dx from so1),
so3 as (select *, coalesce(lag(sx) over {col}, sx) as su, coalesce(lead(sx) over {col}, sx) as sd, coalesce(lag(dx) over {col}, dx) as du, coalesce(lead(dx) over {col}, dx) as dd from so2),
so as (select *, sqrt((power(su - sd, 2) + power((du + 2 * dx + dd) / 4.0, 2)) / 2.0) as edge from so3)"""


def _with(body: str, *parts: str) -> str:
    return f"with {', '.join(parts)}\n{body}"


def _lab() -> str:
    lin = lambda c: f"case when {c} / 255.0::double > 0.04045 then power(({c} / 255.0::double + 0.055) / 1.055, 2.4) else {c} / 255.0::double / 12.92 end"
    f = lambda t: f"case when {t} > 0.008856 then power({t}, {1 / 3}::double) else {t} * 7.787 + {16 / 116}::double end"
    return f"""lin as (select figure_id, y, x, {lin("r")} as lr, {lin("g")} as lg, {lin("b")} as lb_ from px),
xyz as (select figure_id, y, x, (lr * 0.412453 + lg * 0.357580 + lb_ * 0.180423) / 0.95047 as tx, (lr * 0.212671 + lg * 0.715160 + lb_ * 0.072169) as ty, (lr * 0.019334 + lg * 0.119193 + lb_ * 0.950227) / 1.08883 as tz from lin),
ff as (select figure_id, y, x, {f("tx")} as fx, {f("ty")} as fy, {f("tz")} as fz from xyz),
lab as (select figure_id, y, x, fy * 116.0 - 16.0 as l, (fx - fy) * 500.0 as a, (fy - fz) * 200.0 as bb from ff)"""


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows) + f") t({names})"


PAL = f"pal as (select * from {_values([(k, *map(float, p)) for k, p in enumerate(PALETTE)], 'k, pr, pg, pb')})"
NEAR = PAL + ", near as (select figure_id, y, x, r, g, b, cast(arg_min(k, (d, k)) as int) as lbl from (select *, round((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), 6) as d from px, pal) group by figure_id, y, x, r, g, b)"
STEPS = "steps as (select figure_id, lbl, lead(lbl) over (partition by figure_id, y order by x) as nx, lead(lbl) over (partition by figure_id, x order by y) as ny, lag(lbl) over (partition by figure_id, y order by x) as px_, lag(lbl) over (partition by figure_id, x order by y) as py_, * exclude (figure_id, lbl) from lb)"
GRAD = f"""gv as (select *, {GRAY} as v from px),
gn as (select *, lag(v) over (partition by figure_id, y order by x) as l, lead(v) over (partition by figure_id, y order by x) as rr, lag(v) over (partition by figure_id, x order by y) as u, lead(v) over (partition by figure_id, x order by y) as dn from gv),
gr as (select *, case when l is null then rr - v when rr is null then v - l else (rr - l) / 2.0 end as gx, case when u is null then dn - v when dn is null then v - u else (dn - u) / 2.0 end as gy from gn)"""
SRC = "src as (select * from px)"
FEATURES = PX + ", " + SRC + _sobel(GRAY) + ", " + GRAD + """,
f1 as (select figure_id, round(avg(case when greatest(r, g, b) - least(r, g, b) > 80 then 1.0::double else 0.0 end), 6) as saturation_ratio from px group by 1),
f2 as (select figure_id, round(avg(case when edge > 0.05 then 1.0::double else 0.0 end), 6) as edge_density from so group by 1),
f3 as (select figure_id, round(case when avg(m) < 1e-9 then 1.0 else least(1.0, stddev_pop(m) / avg(m) / 3.0) end, 5) as gradient_uniformity from (select figure_id, sqrt(gx * gx + gy * gy) as m from gr) group by 1),
f4 as (select figure_id, round(least(1.0, avg(case when abs(gy) > 0.05 and abs(gx) < 0.03 then 1.0::double else 0.0 end) * 3.0), 5) as striation from gr group by 1),
f5 as (select figure_id, round(case when max(y) + 1 < 20 then 0.0 else least(1.0, avg(abs(v - l)) / 0.15) end, 5) as text_density from gn group by 1),
feat as (select * from dims join f1 using (figure_id) join f2 using (figure_id) join f3 using (figure_id) join f4 using (figure_id) join f5 using (figure_id)),
pos as (select figure_id, h, w, [h // 4 + cast(floor((3 * h // 4 - h // 4) * i / 3.0::double) as bigint) for i in [0, 1, 2, 3]] as ys, [w // 4 + cast(floor((3 * w // 4 - w // 4) * i / 3.0::double) as bigint) for i in [0, 1, 2, 3]] as xs from dims),
hash_ as (select figure_id, (sum(r + g + b) + 7 * any_value(h) + 13 * any_value(w)) % 4 as panel_hash from px join pos using (figure_id) where list_contains(ys, y) and list_contains(xs, x) group by 1)"""
LAST = "hist as (select user_id as session_id, event_id % 6 as figure_id, event_id as ord, ts, ['pending','classified','segmented','reviewed','exported','skipped','error'][cast(event_id * 11 % 7 + 1 as int)] as status, round(value % 1, 4) as score from events), last_ as (select session_id, figure_id, arg_max(status, ord) as status, arg_max(score, ord) as score, max(ord) as ord from hist group by 1, 2)"
LOG = "log as (select event_id as ord, event_type as engine, case when event_id % 4 = 0 then 'failure' else 'success' end as outcome, (event_id * 31 % 1000) / 1000.0::double as saturation, (event_id * 17 % 50) / 1000.0::double as edge_density, 1 + (event_id * 13 % 200) / 100.0::double as aspect, event_id * 7 % 15 as groups, case when event_id % 5 <> 0 then round(value % 1, 4) end as alignment from events)"
BOX = "box as (select p_partkey // 8 as page_id, p_partkey as box_id, p_partkey * 37 % 400 as x, p_partkey * 53 % 300 as y, p_size * 6 + 20 as w, p_size * 4 + 20 as h, (p_partkey * 7 % 100) / 100.0::double as conf from part)"
DARK = "dark as (select figure_id, x, sum(case when (r + g + b) / 3.0 < 150 then 1 else 0 end) as dark, count(*) as h from px group by 1, 2)"


def _runs(name: str, where: str, least: int) -> str:
    return f"{name} as (select figure_id, min(x) as lo, max(x) + 1 as hi from (select *, x - row_number() over (partition by figure_id order by x) as island from dark where {where}) group by figure_id, island having max(x) + 1 - min(x) >= {least})"


GAPS = _runs("gaps", "dark < h * 0.5", 2)
NAMED = "named as (select figure_id, lbl, lbl as ord, case when lbl % 7 < 6 then ['red','orange','yellow','green','blue','purple'][lbl % 7 + 1] else 'gray' end as name from (select distinct figure_id, label as lbl from px))"
PROPS = f"def_ as (select * from {_values([(k, *v) for k, v in DEFAULTS.items()], 'name, vp, vs, rho')})"
LAYERP = NAMED + ", " + PROPS + ", layer as (select figure_id, lbl, ord, named.name, vp, vs, rho from named left join def_ using (name))"
GRID = "grid as (select lb.figure_id, y as z, x, coalesce(vp, 3000.0) as vp, coalesce(vs, 1732.0) as vs, coalesce(rho, 2200.0) as rho from lb left join (select * from layer where lbl <> 0) l on lb.figure_id = l.figure_id and lb.lbl = l.lbl)"
BOUND = "ord_ as (select figure_id, lbl, row_number() over (partition by figure_id order by med, lbl) as k from (select figure_id, lbl, median(y) as med from lb group by 1, 2)), pair as (select a.figure_id, a.lbl as t, b.lbl as b from ord_ a join ord_ b on a.figure_id = b.figure_id and a.k = 1 and b.k = 2)"
TOP = BOUND.split(", pair as")[0] + ", tp as (select lb.figure_id, y, x, cast(coalesce(k, 0) as int) as lbl from lb left join (select * from ord_ where k <= 2) o on lb.figure_id = o.figure_id and lb.lbl = o.lbl)"
DENSE = TOP + ", db as (select figure_id, x, round(case when t1 < b0 then (mt + mb) / 2 else (lo + hi) / 2.0 end, 4) as yb from (select figure_id, x, median(case when lbl = 1 then y end) as mt, median(case when lbl = 2 then y end) as mb, max(case when lbl = 1 then y end) as t1, min(case when lbl = 2 then y end) as b0, min(y) as lo, max(y) as hi from tp where lbl in (1, 2) group by 1, 2) where mt is not null and mb is not null)"
ADJUST = DENSE + ", adj as (select tp.figure_id, y, tp.x, cast(case when lbl in (1, 2) and abs(y - yb) <= 5 then case when y <= round_even(yb, 0) then 1 else 2 end else lbl end as int) as lbl from tp left join db on tp.figure_id = db.figure_id and tp.x = db.x)"
WIDE = _runs("wide", "dark >= h * 0.5", 4)


def _kmeans(rounds: int) -> str:
    out = PAL + ", c0 as (select figure_id, k, pr, pg, pb from dims, pal)"
    for i in range(rounds):
        out += f", k{i} as (select px.figure_id, y, x, r, g, b, arg_min(k, (round((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), 6), k)) as lbl from px join c{i} c on px.figure_id = c.figure_id group by px.figure_id, y, x, r, g, b)"
        out += f", m{i} as (select figure_id, lbl as k, round(avg(r), 6) as ar, round(avg(g), 6) as ag, round(avg(b), 6) as ab from k{i} group by 1, 2)"
        out += f", c{i + 1} as (select c.figure_id, c.k, coalesce(ar, pr) as pr, coalesce(ag, pg) as pg, coalesce(ab, pb) as pb from c{i} c left join m{i} m on c.figure_id = m.figure_id and c.k = m.k)"
    return out


HUE = "case when mx = mn then 0.0 when mx = r then ((((g - b) / (mx - mn)) % 6.0) + 6.0) % 6.0 when mx = g then (b - r) / (mx - mn) + 2.0 else (r - g) / (mx - mn) + 4.0 end / 6.0"
MEDIANS = "pm as (select figure_id, lbl, median(r) as r, median(g) as g, median(b) as b from lb group by 1, 2)"

COARSE = NEAR + ", lb as (select figure_id, y, x, lbl + 1 as lbl from near)"
#: Bands over the sheets, the pairs of neighbouring layers, and the curve between their medians.
BANDS = SHEET + ", lb as (select figure_id, y, x, cast(case when (y * 31 + x * 17 + figure_id * 7) % 97 = 0 then band % 4 + 1 else band end as int) as lbl from (select *, greatest(1, least(4, floor((y + 7 * sin(x / 13.0::double + figure_id)) / 40) + 1)) as band from canvas))"
PAIRS = "pairs as (select * from (select figure_id, row_number() over (partition by figure_id order by med, lbl) - 1 as ord, lbl as top, lead(lbl) over (partition by figure_id order by med, lbl) as bottom from (select figure_id, lbl, median(y) as med from lb where lbl > 0 group by 1, 2)) where bottom is not null)"
TOUCH = """near4 as (select *, lag(lbl) over (partition by figure_id, y order by x) as n1, lead(lbl) over (partition by figure_id, y order by x) as n2, lag(lbl) over (partition by figure_id, x order by y) as n3, lead(lbl) over (partition by figure_id, x order by y) as n4 from lb),
touch as (select distinct figure_id, y, x, lbl, other from (select figure_id, y, x, lbl, unnest([n1, n2, n3, n4]) as other from near4) where other <> lbl)"""
MIDDLES = "meds as (select figure_id, x, lbl, median(y) as m from lb group by 1, 2, 3), mids as (select p.figure_id, ord, top, bottom, a.x, (a.m + b.m) / 2 as yb from pairs p join meds a on a.figure_id = p.figure_id and a.lbl = top join meds b on b.figure_id = p.figure_id and b.lbl = bottom and b.x = a.x)"
PLACES = "places as (select figure_id, ord, place, not bool_or(coalesce(close, false)) over (partition by figure_id) as ok from (select *, row_number() over (partition by figure_id order by med, ord) as place, lead(med) over (partition by figure_id order by med, ord) - med < 3 as close from (select figure_id, ord, median(yb) as med from mids group by 1, 2)))"
ZONES = "zones as (select distinct p.figure_id, ord, t.y + dy as y, t.x + dx as x from touch t join pairs p on p.figure_id = t.figure_id and (p.top = lbl and p.bottom = other or p.top = other and p.bottom = lbl), range(-5, 6) u(dy), range(-5, 6) v(dx) where abs(dy) + abs(dx) <= 5)"
DRAWN = """corner as (select figure_id, unnest([{'k': 0, 'x': 10 + figure_id % 20, 'y': 12}, {'k': 1, 'x': 150 + figure_id % 30, 'y': 5 + figure_id % 9}, {'k': 2, 'x': 120, 'y': 70}, {'k': 3, 'x': 185 - figure_id % 11, 'y': 150}, {'k': 4, 'x': 5 + figure_id % 7, 'y': 140 - figure_id % 13}], recursive := true) from (select distinct s_suppkey // 4 as figure_id from supplier)),
side as (select c.figure_id, c.x, c.y, d.x as x1, d.y as y1 from corner c join corner d on c.figure_id = d.figure_id and d.k = (c.k + 1) % 5),
crossing as (select figure_id, r as y, x + (r - y) * (x1 - x) / (y1 - y)::double as pos from side, range(0, 160) t(r) where y <> y1 and r >= least(y, y1) and r < greatest(y, y1)),
span as (select distinct figure_id, y, lo, hi from (
    select figure_id, y, ceil(pos - 1e-9) as lo, floor(upto + 1e-9) as hi from (select *, row_number() over w as n, lead(pos) over w as upto from crossing window w as (partition by figure_id, y order by pos)) where n % 2 = 1 and ceil(pos - 1e-9) <= floor(upto + 1e-9)
    union all select figure_id, y, least(x, x1), greatest(x, x1) from side where y = y1 union all select figure_id, y, x, x from corner))"""

WORK = LAST + """, ws as (select session_id, figure_id::varchar as figure_id, status, ord, score, list_position(['pending','classified','segmented','reviewed','exported','skipped','error'], status) as at_, status in ('skipped', 'error') and ord % 2 = 1 as odd from last_),
w as (select session_id, figure_id, status, case when at_ between 2 and 5 or odd then ['conceptual_model', 'multi_panel', 'other'][ord % 3 + 1] end as figure_type, case when at_ between 2 and 5 or odd then round(score * 1.5, 6) end as confidence, case when at_ between 3 and 5 or odd then ord % 4 end as target,
    case when at_ between 3 and 5 then case when ord % 2 = 0 then 'v4_kmeans' else 'edge_grow' end end as engine, case when status = 'exported' then 'x/' || ord || '.xyz' end as tomo, case when status = 'skipped' then 'too small' end as skip_reason from ws)"""


def _back(stage: str) -> str:
    able = {"classify": "true", "panel": "figure_type is not null", "segment": "target is not null"}[stage]
    gone = {"classify": ("figure_type", "confidence", "target", "engine", "tomo"), "panel": ("target", "engine", "tomo"), "segment": ("engine", "tomo")}[stage]
    kept = ", ".join(f"case when able then null else {c} end as {c}" if c in gone else c for c in ("figure_type", "confidence", "target", "engine", "tomo"))
    return _with(f"select session_id, figure_id, case when able then '{'pending' if stage == 'classify' else 'classified'}' else status end as status, not able as refused, {kept}, skip_reason from (select *, {able} as able from w)", WORK)


ORACLE_SQL: dict[str, str] = {
    "px_saturation_ratio": _with("select * from f1", FEATURES),
    "px_is_grayscale": _with("select figure_id, round(avg(greatest(r, g, b) - least(r, g, b)), 6) as mean_saturation, avg(greatest(r, g, b) - least(r, g, b)) < 15.0 as is_grayscale from px group by 1", PX),
    "px_background_color": _with("select figure_id, cast(trunc(median(r)) as int) as bg_r, cast(trunc(median(g)) as int) as bg_g, cast(trunc(median(b)) as int) as bg_b from px join dims using (figure_id) where (y in (0, h - 1) and x in (0, w - 1)) or (y = h // 2 and x = w // 2) group by 1", PX),
    "px_panel_hash": _with("select figure_id, cast(panel_hash as bigint) as panel_hash from hash_", FEATURES),
    "px_edge_density": _with("select * from f2", FEATURES),
    "px_noise_level": _with("select figure_id, round(least(1.0, avg(case when edge > 0.05 then 1.0::double else 0.0 end) * 1.5), 4) as noise_level from so group by 1", PX + ", " + SRC + _sobel(f"{GRAY} * 255.0")),
    "px_gradient_uniformity": _with("select * from f3", FEATURES),
    "px_striation": _with("select * from f4", FEATURES),
    "px_text_density": _with("select * from f5", FEATURES),
    "fig_quality_check": _with("select figure_id, h, w, round(blank, 5) as blank_ratio, round(edges, 5) as edge_ratio, case when least(h, w) < 40 then 'too_small' when blank > 0.95 then 'mostly_blank' when edges < 0.005 then 'no_edges' else '' end as reason, not (least(h, w) < 40 or blank > 0.95 or edges < 0.005) as ok from (select figure_id, max(y) + 1 as h, max(x) + 1 as w, avg(case when v > 0.97 then 1.0::double else 0.0 end) as blank, avg(case when edge > 0.05 then 1.0::double else 0.0 end) as edges from so group by 1)", FEATURES),
    "fig_quality_split": _with("select ok, reason, count(*) as n from (select figure_id, h, w, round(blank, 5) as blank_ratio, round(edges, 5) as edge_ratio, case when least(h, w) < 40 then 'too_small' when blank > 0.95 then 'mostly_blank' when edges < 0.005 then 'no_edges' else '' end as reason, not (least(h, w) < 40 or blank > 0.95 or edges < 0.005) as ok from (select figure_id, max(y) + 1 as h, max(x) + 1 as w, avg(case when v > 0.97 then 1.0::double else 0.0 end) as blank, avg(case when edge > 0.05 then 1.0::double else 0.0 end) as edges from so group by 1)) group by 1, 2", FEATURES),
    "fig_classify": _with("select figure_id, s1 as conceptual_score, s2 as observational_score, case when least(h, w) < 50 then 'other' when s1 >= s2 + 0.15 then 'conceptual' when s2 >= s1 + 0.15 then 'observational' else 'other' end as figure_type from (select *, round(edge_density * 0.15 + (1 - gradient_uniformity) * 0.15 + text_density * 0.20 - striation * 0.50, 4) as s1, round(gradient_uniformity * 0.25 + (1 - edge_density) * 0.15 + striation * 0.35, 4) as s2 from feat)", FEATURES),
    "fig_complexity": _with("select figure_id, round(case when least(h, w) < 10 then 0.0 else edge_density * 0.5 + saturation_ratio * 0.3 + (1 - gradient_uniformity) * 0.2 end, 4) as complexity from feat", FEATURES),
    "route_engine": _with("select figure_id, case when saturation_ratio < 0.005 then 'grayscale_agglomerative' when saturation_ratio < 0.1 then 'v4_kmeans_pastel' when saturation_ratio < 0.5 then 'v4_kmeans' else ['kmeans_full', 'edge_guided', 'edge_grow'][cast(panel_hash % 3 + 1 as int)] end as engine from feat join hash_ using (figure_id)", FEATURES),
    "gray_histogram_peaks": _with("select figure_id, rank, bin, n, mr, mg, mb from (select *, row_number() over (partition by figure_id order by n desc, bin) as rank from (select *, sum(n) over (partition by figure_id) as total, arg_max(bin, (n, -bin)) over (partition by figure_id) as mode_ from (select figure_id, bin, count(*) as n, cast(trunc(median(r)) as int) as mr, cast(trunc(median(g)) as int) as mg, cast(trunc(median(b)) as int) as mb from (select *, least(24, cast(floor(cast(trunc((r + g + b) / 3.0::double) as int) * 25 / 256.0::double) as int)) as bin from px) group by 1, 2)) where n >= 0.02 * total and abs((bin + 0.5) * 256.0 / 25 - (mode_ + 0.5) * 256.0 / 25) > 30) where rank <= 8", PX),
    "px_lab_stats": _with("select figure_id, round(avg(l), 3) as l_mean, round(stddev_pop(l), 3) as l_std, round(stddev_pop(a), 3) as a_std, round(stddev_pop(bb), 3) as b_std from lab group by 1", PX, _lab()),
    "colorbar_bbox": _with("select figure_id, coalesce(strip, 'none') as strip, coalesce(score, 0.0) as score from dims left join (select figure_id, arg_min(strip, ord) as strip, arg_min(score, ord) as score from (select figure_id, ord, strip, round(least(1.0, (stddev_pop(a) + stddev_pop(bb)) / 2 / 40), 4) as score from (select lab.figure_id, ord, strip, a, bb from lab join dims using (figure_id) join (values (0, 'top'), (1, 'bottom'), (2, 'right'), (3, 'left')) s(ord, strip) on case strip when 'top' then y < greatest(4, least(h, w) // 10) when 'bottom' then y >= h - greatest(4, least(h, w) // 10) when 'right' then x >= w - greatest(4, least(h, w) // 10) else x < greatest(4, least(h, w) // 10) end) group by 1, 2, 3) where score > 0.3 group by 1) using (figure_id)", PX, _lab()),
    "colorbar_samples": _with("select px.figure_id, i, px.y, r, g, b from px join (select figure_id, i, cast(floor(lo + (floor(h * 0.95::double) - 1 - lo) * i / 4) as bigint) as y from (select figure_id, h, floor(h * 0.05::double) as lo, i from dims, range(0, 5) t(i))) s on px.figure_id = s.figure_id and px.y = s.y where px.x = 0", PX),
    "lb_nearest_palette": _with("select figure_id, lbl, count(*) as n from near group by 1, 2", PX, NEAR),
    "lb_kmeans_rounds": _with("select figure_id, lbl, count(*) as n from k9 group by 1, 2", PX, _kmeans(10)),
    "lb_reorder_median_y": _with("select figure_id, lbl, count(*) as n from (select figure_id, new as lbl from near join (select figure_id, lbl, row_number() over (partition by figure_id order by median(y), lbl) - 1 as new from near group by 1, 2) using (figure_id, lbl)) group by 1, 2", PX, NEAR),
    "lb_map_common": _with("select figure_id, lbl, arg_min(k, (d, k)) as mapped from (select *, round((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), 6) as d from pm, pal) group by 1, 2", PX, LAYERS, MEDIANS, PAL),
    "lb_weighted_vote": _with("select figure_id, lbl, count(*) as n, round(sum(votes), 4) as votes from (select figure_id, y, x, arg_max(lbl, (s, -lbl)) as lbl, max(s) as votes from (select figure_id, y, x, lbl, round(sum(wt), 6) as s from (select figure_id, y, x, lbl, 0.4::double as wt from near union all select figure_id, y, x, label % 6, 0.35::double from px union all select figure_id, y, x, r // 43, 0.25::double from px) group by 1, 2, 3, 4) group by 1, 2, 3) group by 1, 2", PX, NEAR),
    "lb_consistency": _with("select figure_id, round(avg(case when lbl = coalesce(lag(lbl), 0) then 1 else 0 end), 6) as consistency from near group by 1" if False else "select figure_id, round(avg(case when l = lbl and rr = lbl and u = lbl and d = lbl then 1.0::double else 0.0 end), 6) as consistency from (select figure_id, lbl, coalesce(lag(lbl) over rw, last_value(lbl) over rf) as l, coalesce(lead(lbl) over rw, first_value(lbl) over rf) as rr, coalesce(lag(lbl) over cw, last_value(lbl) over cf) as u, coalesce(lead(lbl) over cw, first_value(lbl) over cf) as d from near window rw as (partition by figure_id, y order by x), rf as (partition by figure_id, y order by x rows between unbounded preceding and unbounded following), cw as (partition by figure_id, x order by y), cf as (partition by figure_id, x order by y rows between unbounded preceding and unbounded following)) group by 1", PX, NEAR),
    "lb_boundary_pixels": _with("select figure_id, count(*) filter (coalesce(nx <> lbl, false) or coalesce(ny <> lbl, false) or coalesce(px_ <> lbl, false) or coalesce(py_ <> lbl, false)) as boundary_pixels from steps group by 1", PX, LAYERS, STEPS),
    "lb_boundary_alignment": _with("select figure_id, round(coalesce(avg(case when (coalesce(nx <> lbl, false) or coalesce(ny <> lbl, false) or coalesce(px_ <> lbl, false) or coalesce(py_ <> lbl, false)) then case when edge > 0.05 then 1.0::double else 0.0 end end), 0.0), 6) as boundary_alignment from steps group by 1", PX, SRC + _sobel(GRAY), "lb as (select figure_id, y, x, label as lbl, edge from so)", STEPS),
    "lb_region_stats": _with("select figure_id, lbl, count(*) as area, round(count(*) / any_value(n), 4) as fraction, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from lb join (select figure_id, count(*) as n from lb group by 1) using (figure_id) where lbl <> 0 group by 1, 2", PX, LAYERS),
    "lb_background_label": _with("select figure_id, arg_max(lbl, (score, -lbl)) as background_label, max(score) as score from (select *, round(e / te * n / tn, 6) as score from (select *, sum(n) over (partition by figure_id) as tn, sum(e) over (partition by figure_id) as te from (select figure_id, lbl, count(*)::double as n, count(*) filter (y = 0 or x = 0 or y = h - 1 or x = w - 1)::double as e from lb join dims using (figure_id) group by 1, 2)) where e / te > 0.25 and n / tn > 0.08) group by 1", PX, LAYERS),
    "lb_n_layers": _with("select figure_id, count(distinct case when lbl <> 0 then lbl end) as n_layers from lb group by 1", PX, LAYERS),
    "lb_palette_median": _with("select figure_id, lbl, r, g, b, 'region_' || (row_number() over (partition by figure_id order by lbl) - 1) as name from pm", PX, LAYERS, MEDIANS),
    "palette_names_by_hue": _with(f"select figure_id, lbl, hue, case when k <= 6 then {HUE_NAMES!r}[least(k, 6)] else 'c' || (k - 1) end as name from (select *, row_number() over (partition by figure_id order by hue, lbl) as k from (select figure_id, lbl, round({HUE}, 6) as hue from (select *, greatest(r, g, b) as mx, least(r, g, b) as mn from pm)))", PX, LAYERS, MEDIANS),
    "lb_broken_pairs": _with("select p.figure_id, top, bot, t.lo is null as broken from (select figure_id, lbl as top, lead(lbl) over (partition by figure_id order by med, lbl) as bot from (select figure_id, lbl, median(y) as med from lb where lbl <> 0 group by 1, 2)) p left join (select distinct figure_id, least(lbl, nx) as lo, greatest(lbl, nx) as hi from (select figure_id, lbl, nx from steps union all select figure_id, lbl, ny from steps) where nx <> lbl) t on p.figure_id = t.figure_id and least(top, bot) = t.lo and greatest(top, bot) = t.hi where bot is not null", PX, LAYERS, STEPS),
    "lb_noise_regions": _with("select figure_id, lbl, round(aspect, 4) as aspect, fraction, noise from (select *, case when aspect > 8 and fraction < 0.15 then 'extreme_aspect' when (x0 < w * 0.05::double or x1 > w * 0.95::double or y0 < h * 0.05::double or y1 > h * 0.95::double) and (aspect > 3 or fraction < 0.05) then 'border_strip' end as noise from (select *, greatest(x1 - x0 + 1, y1 - y0 + 1) / least(x1 - x0 + 1, y1 - y0 + 1) as aspect from (select figure_id, lbl, round(count(*) / any_value(n), 4) as fraction, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from lb join (select figure_id, count(*) as n from lb group by 1) using (figure_id) where lbl <> 0 group by 1, 2) join dims using (figure_id))) where noise is not null", PX, LAYERS),
    "lb_close_boundaries": _with("select figure_id, least(lbl, next) as lo, greatest(lbl, next) as hi, count(*) as touching from (select figure_id, lbl, nx as next from steps union all select figure_id, lbl, ny from steps) s join (select p.k as i, q.k as j from pal p join pal q on q.k = p.k + 1 where sqrt((p.pr - q.pr) * (p.pr - q.pr) + (p.pg - q.pg) * (p.pg - q.pg) + (p.pb - q.pb) * (p.pb - q.pb)) < 130) c on least(lbl, next) = i and greatest(lbl, next) = j group by 1, 2, 3", PX, NEAR, "lb as (select * from near)", STEPS),
    "panel_candidates": _with("select figure_id, row_number() over (partition by figure_id order by lo) - 1 as panel_id, lo as x, y0 as y, hi - lo as w, y1 - y0 as h, area_ratio from (select e.*, round((hi - lo) * (y1 - y0) / (h * w), 5) as area_ratio from (select figure_id, lo, hi, min(y) as y0, max(y) + 1 as y1 from (select px.figure_id, lo, hi, y, count(*) as n from px join wide on px.figure_id = wide.figure_id and x >= lo and x < hi where (r + g + b) / 3.0 < 150 group by 1, 2, 3, 4) where n > 0.1::double * (hi - lo) group by 1, 2, 3) e join dims using (figure_id)) where area_ratio between 0.02 and 0.95", PX, DARK, WIDE),
    "panel_gap_runs": _with("select * from gaps", PX, DARK, GAPS),
    "panel_gutter_cells": _with("select figure_id, x0, x1, density, round(density * 0.3 + 0.6, 2) as conf from (select c.figure_id, x0, x1, round(sum(dark) / sum(h), 5) as density from (select e.figure_id, edge as x0, coalesce(lead(edge) over (partition by e.figure_id order by edge), w) as x1 from (select figure_id, hi as edge from gaps union select distinct figure_id, 0 from px) e join dims using (figure_id)) c join dark on dark.figure_id = c.figure_id and dark.x >= x0 and dark.x < x1 group by 1, 2, 3) where density >= 0.15", PX, DARK, GAPS),
    "panel_iou_pairs": _with("select page_id, a, b, iou from (select *, round(iw * ih / (wa * ha + wb * hb - iw * ih), 5) as iou from (select p.page_id, p.box_id as a, q.box_id as b, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x))::double as iw, greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) as ih, p.w as wa, p.h as ha, q.w as wb, q.h as hb from box p join box q on p.page_id = q.page_id and p.box_id < q.box_id)) where iou >= 0.05", BOX),
    "panel_ambiguous": _with("select page_id, count(*) as n, count(*) = 1 and (max(conf) < 0.5 or max(w * h) > 0.95 * 350000) as ambiguous from box group by 1", BOX),
    "panel_background_type": _with("select figure_id, m as corner_mean, case when m < 0.35 then 'black' when m > 0.65 then 'white' when m < 0.5 then 'black' else 'white' end as background from (select figure_id, round(avg(" + GRAY + "), 6) as m from px join dims using (figure_id) where (y < 8 or y >= h - 8) and (x < 8 or x >= w - 8) group by 1)", PX),
    "hz_dense_boundary": _with("select figure_id, x, round(case when t1 < b0 then (mt + mb) / 2 else (lo + hi) / 2.0 end, 4) as yb from (select lb.figure_id, x, median(case when lbl = t then y end) as mt, median(case when lbl = b_ then y end) as mb, max(case when lbl = t then y end) as t1, min(case when lbl = b_ then y end) as b0, min(y) as lo, max(y) as hi from lb join (select figure_id, t, b as b_ from pair) using (figure_id) where lbl in (t, b_) group by 1, 2) where mt is not null and mb is not null", PX, LAYERS, BOUND),
    "hz_zero_crossing": _with("select figure_id, x, round(arg_min(at_, y), 5) as yb from (select *, y + v / (v - n) as at_ from (select *, lead(v) over (partition by figure_id, x order by y) as n from (select *, avg(s) over (partition by figure_id, x order by y rows between 1 preceding and 1 following) as v from (select lb.figure_id, x, y, case when lbl = t then 1.0::double when lbl = b_ then -1.0 else 0.0 end as s from lb join (select figure_id, t, b as b_ from pair) using (figure_id)))) where v > 0 and n <= 0) group by 1, 2", PX, LAYERS, BOUND),
    "hz_adjust": _with("select figure_id, lbl, count(*) as n from adj group by 1, 2", PX, LAYERS, ADJUST),
    "hz_repartition": _with("select tp.figure_id, case when yb <= y then 1 else 0 end as lbl, count(*) as n from tp left join db on tp.figure_id = db.figure_id and tp.x = db.x group by 1, 2", PX, LAYERS, DENSE),
    "hz_quality_gate": _with("select figure_id, round(c, 6) as changed, n0 as layers_before, n1 as layers_after, c <= 0.15 and n1 >= n0 - 1 as accepted from (select tp.figure_id, avg(case when tp.lbl <> adj.lbl then 1.0::double else 0.0 end) as c, count(distinct tp.lbl) as n0, count(distinct adj.lbl) as n1 from tp join adj on tp.figure_id = adj.figure_id and tp.y = adj.y and tp.x = adj.x group by 1)", PX, LAYERS, ADJUST),
    "hz_hampel": "with s as (select user_id, event_id, value from events), m as (select *, median(value) over w as med, list(value) over w as near from s window w as (partition by user_id order by event_id rows between 10 preceding and 10 following)), d as (select *, list_median([abs(v - med) for v in near]) as mad from m) select user_id, event_id, round(case when n >= 21 and abs(value - med) > 3.0 * 1.4826 * mad then med else value end, 4) as filtered, n >= 21 and abs(value - med) > 3.0 * 1.4826 * mad as is_outlier from (select *, count(*) over (partition by user_id) as n from d)",
    "props_assign": _with("select figure_id, lbl, ord, name, vp, vs, rho from layer", PX, LAYERP),
    "props_missing_anti": _with("select figure_id, lbl, ord, name from named where name not in (select name from def_)", PX, LAYERP),
    "props_generate": _with("select figure_id, ord, name, round(t * 3000 + 3000, 2) as vp, round((t * 3000 + 3000) / 1.732, 2) as vs, round(t * 600 + 2200, 2) as rho from (select *, case when n = 1 then 0.5 else i::double / greatest(n - 1, 1) end as t from (select *, count(*) over (partition by figure_id) as n, row_number() over (partition by figure_id order by ord) - 1 as i from named))", PX, NAMED),
    "grid_vp_vs_rho": _with("select figure_id, z, round(avg(vp), 4) as vp, round(avg(vs), 4) as vs, round(avg(rho), 4) as rho from grid group by 1, 2", PX, LAYERS, LAYERP, GRID),
    "tomo_lines": _with("select figure_id, z, x, printf('%.6f %.6f %.4f %.4f %.4f', x::double, z::double, vp, vs, rho) as line from grid", PX, LAYERS, LAYERP, GRID),
    "parfile_lines": _with(f"select figure_id, '{SNIPPET.format(nx=100, nz=50, dx=1.0, dz=1.0)}' || string_agg(printf('#   %-10s:  Vp=%.1f  Vs=%.1f  rho=%.1f', name, vp, vs, rho) || chr(10), '' order by ord) as snippet from (select figure_id, ord, name, round(t * 3000 + 3000, 2) as vp, round((t * 3000 + 3000) / 1.732, 2) as vs, round(t * 600 + 2200, 2) as rho from (select *, case when n = 1 then 0.5 else i::double / greatest(n - 1, 1) end as t from (select *, count(*) over (partition by figure_id) as n, row_number() over (partition by figure_id order by ord) - 1 as i from named))) group by 1", PX, NAMED),
    "external_ascii": _with("select figure_id, block, z, string_agg(printf('%.4f', v), ' ' order by x) as line from (select figure_id, z, x, 0 as block, vp as v from grid union all select figure_id, z, x, 1, vs from grid union all select figure_id, z, x, 2, rho from grid) group by 1, 2, 3 union all select figure_id, -3, 0, w || ' ' || h from dims union all select figure_id, -2, 0, string_agg(printf('%.6f', x::double), ' ' order by x) from grid where z = 0 group by 1 union all select figure_id, -1, 0, string_agg(printf('%.6f', z::double), ' ' order by z) from grid where x = 0 group by 1", PX, LAYERS, LAYERP, GRID),
    "mem_engine_rates": _with("select engine, count(*) as n, round(count(*) filter (outcome = 'success') / count(*), 3) as success_rate from log group by 1 having count(*) >= 2", LOG),
    "mem_feature_bins": _with("select case when saturation < 0.1 then 'pastel' when saturation < 0.5 then 'mixed' else 'vivid' end as sat_bin, case when edge_density < 0.01 then 'low' when edge_density < 0.03 then 'medium' else 'high' end as edge_bin, count(*) as n from log group by 1, 2", LOG),
    "mem_patterns": _with("select sat_bin, edge_bin, engine as best_engine, n, round(rate, 3) as success_rate, round(al / c, 4) as avg_alignment, least(1.0, n / 20.0) as confidence from (select *, row_number() over (partition by sat_bin, edge_bin order by rate desc, c desc, first_) as k from (select *, ok / c as rate from (select *, cast(sum(c) over (partition by sat_bin, edge_bin) as bigint) as n from (select case when saturation < 0.1 then 'pastel' when saturation < 0.5 then 'mixed' else 'vivid' end as sat_bin, case when edge_density < 0.01 then 'low' when edge_density < 0.03 then 'medium' else 'high' end as edge_bin, engine, count(*) as c, count(*) filter (outcome = 'success') as ok, min(ord) as first_, sum(coalesce(alignment, 0.0)) as al from log group by 1, 2, 3))) where n >= 3 and c >= 2 and rate > 0) where k = 1", LOG),
    "mem_query_similar": _with("select ord, engine, distance from (select *, round((abs(saturation - 0.42) * 2 + abs(edge_density - 0.02) + abs(groups - 6.0) + abs(aspect - 1.5) * 0.5) / 4.5, 6) as distance from log where outcome = 'success') order by distance, ord limit 3", LOG),
    "sess_summary": _with("select session_id, " + ", ".join(f"count(*) filter (status = '{s}') as n_{s}" for s in ("pending", "classified", "segmented", "reviewed", "exported", "skipped", "error")) + " from last_ group by 1", LAST),
    "sess_ready": _with("select session_id, figure_id, ord from last_ where status = 'segmented'", LAST),
    "sess_backtrack": _with("select session_id, figure_id, 'pending' as status, cast(null as double) as score from last_", LAST),
    "sess_backtrack_panel": _with("select session_id, figure_id, case when status in ('pending', 'skipped', 'error') then status else 'classified' end as status, case when status in ('pending', 'skipped', 'error') then score end as score from last_", LAST),
    "sess_backtrack_segment": _with("select session_id, figure_id, case when status in ('segmented', 'reviewed', 'exported') then 'classified' else status end as status, case when status not in ('segmented', 'reviewed', 'exported') then score end as score from last_", LAST),
    "sess_update": _with("select l.session_id, l.figure_id, coalesce(new_status, l.status) as status, coalesce(new_score, l.score) as score from last_ l left join (select session_id, figure_id, 'reviewed' as new_status, round(score / 2, 4) as new_score from last_ where status = 'segmented') u using (session_id, figure_id)", LAST),
    "report_stats": _with("select session_id, count(*) as total, count(*) filter (status = 'exported') as exported, count(*) filter (status = 'segmented') as segmented, count(*) filter (status = 'skipped') as skipped, round(coalesce(avg(score), 0.0), 4) as avg_score from last_ group by 1", LAST),
    "report_cards": _with("select session_id, figure_id, row_number() over (partition by session_id order by ord) as card, case when score >= 0.75 then 'good' when score >= 0.6 then 'warn' else 'bad' end as band, coalesce(score < 0.7 and status = 'segmented', false) as alert, status || ' ' || coalesce(printf('%.2f', score), '—') as caption from last_", LAST),
    "batch_resume_anti": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 1)",
    "batch_tally": "select count(*) filter (status = 'processed') as processed, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'error') as error, count(*) as total from (select case o_orderstatus when 'F' then 'processed' when 'O' then 'skipped' else 'error' end as status from orders)",
    "retry_underseg": _with("select figure_id, engine, n_layers, case when n_layers < 2 then case engine when 'grayscale_agglomerative' then 'v4_kmeans' when 'v4_kmeans_pastel' then 'v4_kmeans_colorbar' when 'v4_kmeans_colorbar' then 'kmeans_full' when 'v4_kmeans' then 'edge_guided' when 'edge_guided' then 'edge_grow' when 'edge_grow' then 'kmeans_full' when 'kmeans_full' then 'edge_guided' end end as retry_engine from (select figure_id, case when saturation_ratio < 0.005 then 'grayscale_agglomerative' when saturation_ratio < 0.1 then 'v4_kmeans_pastel' when saturation_ratio < 0.5 then 'v4_kmeans' else ['kmeans_full', 'edge_guided', 'edge_grow'][cast(panel_hash % 3 + 1 as int)] end as engine from feat join hash_ using (figure_id)) join (select figure_id, count(distinct case when lbl <> 0 then lbl end) as n_layers from lb group by 1) using (figure_id)", FEATURES, LAYERS),
    "pages_semi_join": "select page_id, url from pages where page_id in (select doc_id from documents where lang = 'en')",
    "captions_join": "select p.page_id, coalesce(d.caption, '') as caption from pages p left join (select doc_id, trim(text, ' ') as caption from documents) d on p.page_id = d.doc_id",
    "text_blocks_top15": "select source, doc_id, block, kind from (select source, doc_id, substr(text, 1, 120) as block, lang as kind, row_number() over (partition by source order by doc_id) as k from documents) where k <= 15",
    "feedback_messages": "select conv_id, turn, '【' || conv_id || '】' || trim(text, ' ') as message from conversations where role = 'user' and trim(text, ' ') <> ''",
    "figure_id_sanitize": r"select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9_-]', '_', 'g') as figure_id from pages",
    "tag_count_parse": "select event_id, coalesce(try_cast(nullif(regexp_extract(tag, 'count=([0-9]+)\\)?', 1), '') as int), 0) as n from (select event_id, case when event_id % 3 = 0 then 'auto(count=' || (event_id * 7 % 1000) || ')' else 'seed' end as tag from events)",
    "doc_text_blocks": "select doc_id as doc, 0 as page, 0 as k, 'title' as kind, trim(coalesce(lang, '') || ' ' || coalesce(source, '')) as text, (doc_id % 100)::double as x1 from documents where coalesce(lang, '') || coalesce(source, '') <> '' union all select doc_id, 0, 1, 'text', text, null from documents where text <> '' union all select doc_id, 2, 0, 'image_caption', source, null from documents where source <> ''",
    "doc_figures": "select doc_id as doc, doc_id || case doc_id % 3 when 0 then '.png' when 1 then '.jpeg' else '.jpg' end as name, 2 as page, nullif(trim(source, ' '), '') as caption from documents where doc_id % 5 <> 0",
    "review_parse": "select event_id, case when problem is null then kind end as kind, case when problem is null then confidence end as confidence, problem from (select event_id, event_type as kind, (event_id * 13 % 100) / 100.0::double as confidence, case when event_id % 7 = 0 or event_id % 11 = 0 or event_type is null then 'schema' when (event_id * 13 % 100) / 100.0::double < 0.7 then 'confidence' end as problem from events)",
    "review_overview": "select page_id, case when n = 0 then 'no_panels_detected' end as warning, score, n = 0 as can_auto_fix, case when score >= 0.7 then 'continue' else 'manual_intervention' end as suggested_action from (select p_partkey // 8 as page_id, count(*) filter ((p_partkey * 7 % 100) / 100.0::double > 0.8) as n, max((p_partkey * 7 % 100) / 100.0::double) as score from part group by 1)",
    "sess_json": _with("select session_id, figure_id, status, score, ord from last_", LAST),
    "fig_gate": _with("select figure_id, case when reason is null then 'ready' else 'skipped' end as status, reason from (select figure_id, case when w < 32 or h < 60 then printf('too_small_for_auto_segmentation (%dx%d < 32x60)', w, h) when k % 3 = 2 then case when k % 9 < 3 then 'figure_type=observational' when k % 9 > 5 then 'figure_type=other' end when k % 5 = 1 then 'vlm_recommended_skip: ' || kind when k % 5 = 2 then 'vlm_recommended_manual_review: ' || kind when k % 5 <> 3 and kind = 'photo' then 'vlm_rejected: ' || kind end as reason from (select *, figure_id // 64 as k, case when (figure_id // 64) % 4 = 0 then 'velocity_model' else 'photo' end as kind from dims))", PX),
    "panel_sheet_background": _with("select figure_id, corner_mean, background, 160 as h, 200 as w from kinds", SHEET, CORNERS),
    "panel_gap_stretches": _with("select figure_id, axis, lo, hi from stretch", SHEET, CORNERS, _content("0.94::double", "0.06::double"), _gaps("0.15::double")),
    "panel_gap_split": _with(
        """select figure_id, x, y, w, h, n from (
            select v.figure_id, v.lo as x, u.lo as y, v.hi - v.lo as w, u.hi - u.lo as h, (select count(*) from content c where on_ and c.figure_id = v.figure_id and x >= v.lo and x < v.hi and y >= u.lo and y < u.hi) as n
            from stretch v join stretch u on v.figure_id = u.figure_id and v.axis = 'x' and u.axis = 'y' join many on many.figure_id = v.figure_id where nv > 1 and nh > 1 and v.hi - v.lo >= 50 and u.hi - u.lo >= 30
            union all select figure_id, case axis when 'x' then lo else a end, case axis when 'x' then a else lo end, case axis when 'x' then hi - lo else b - a end, case axis when 'x' then b - a else hi - lo end, n
            from (select figure_id, axis, lo, hi, a, b, sum(line) filter (pos >= a and pos < b) as n from (select *, min(pos) filter (line > (hi - lo) * 0.05) over w as a, max(pos) filter (line > (hi - lo) * 0.05) over w + 1 as b from crossed window w as (partition by figure_id, axis, lo)) group by all)
        ) where n between 100 and 30400""",
        SHEET, CORNERS, _content("0.94::double", "0.06::double"), _gaps("0.15::double"),
        "many as (select figure_id, count(*) filter (axis = 'x') as nv, count(*) filter (axis = 'y') as nh from stretch group by 1)",
        "crossed as (select s.figure_id, axis, lo, hi, case axis when 'x' then y else x end as pos, count(*) as line from stretch s join many using (figure_id) join content c on c.figure_id = s.figure_id and on_ and case axis when 'x' then x else y end >= lo and case axis when 'x' then x else y end < hi where axis = 'x' and nv > 1 and nh <= 1 and hi - lo >= 50 or axis = 'y' and nh > 1 and nv <= 1 and hi - lo >= 30 group by all)",
    ),
    "panel_gutters": _with(
        """select figure_id, x, y, w, h, round(0.6::double + 0.3::double * least(density, 1), 2) as confidence from (select *, n / (w * h) as density from (
            select v.figure_id, v.lo as x, u.lo as y, v.hi - v.lo as w, u.hi - u.lo as h, (select count(*) from content c where on_ and c.figure_id = v.figure_id and x >= v.lo and x < v.hi and y >= u.lo and y < u.hi) as n
            from cell v join cell u on v.figure_id = u.figure_id and v.axis = 'x' and u.axis = 'y' where v.figure_id in (select figure_id from gap)) where w * h >= 320 and h / w between 0.3 and 3) where density >= 0.15::double""",
        SHEET, "content as (select figure_id, y, x, (r + g + b) / 3.0::double < 245 as on_ from px)", _gaps("0.01::double"),
        "cell as (select * from (select figure_id, axis, pos as lo, lead(pos) over (partition by figure_id, axis order by pos) as hi from (select figure_id, axis, hi as pos from gap union all select distinct figure_id, axis, unnest([0, case axis when 'x' then 200 else 160 end]) from lines)) where hi > lo)",
    ),
    "panel_layout": "with recursive box as (select p_partkey // 8 as f, p_partkey as k, p_partkey * 37 % 400 as x, p_partkey * 53 % 300 as y, p_size * 6 + 20 as w, p_size * 4 + 20 as h from part),"
    """
c as (select *, x + w / 2 as cx, y + h / 2 as cy from box),
per as (select f, count(*) as n, median(w * h) as median, min(cx) as xlo, max(cx) as xhi, min(cy) as ylo, max(cy) as yhi, greatest(2, count(*) // 2) as bins from c group by f),
s as (select f, n, median, bins, case when xlo = xhi then xlo - 0.5 else xlo end as xlo, ((case when xlo = xhi then xhi + 0.5 else xhi end) - (case when xlo = xhi then xlo - 0.5 else xlo end)) / bins as xs,
    case when ylo = yhi then ylo - 0.5 else ylo end as ylo, ((case when ylo = yhi then yhi + 0.5 else yhi end) - (case when ylo = yhi then ylo - 0.5 else ylo end)) / bins as ys from per),
b as (select *, least(floor((cx - xlo) / xs), bins - 1) as bx, least(floor((cy - ylo) / ys), bins - 1) as by_ from c join s using (f)),
u as (select f, list_sort(list(distinct bx)) as ux, list_sort(list(distinct by_)) as uy from b group by f),
d as (select *, list_transform(ux, lambda i: abs(cx - ((xlo + i * xs) + (xlo + (i + 1) * xs)) / 2)) as dx, list_transform(uy, lambda i: abs(cy - ((ylo + i * ys) + (ylo + (i + 1) * ys)) / 2)) as dy,
    n > 1 and len(ux) * len(uy) >= n * 0.5 and len(ux) * len(uy) <= n * 2 as grid from b join u using (f)),
g as (select f, k, median, case when grid then list_position(dx, list_min(dx)) else -k end as gx, case when grid then list_position(dy, list_min(dy)) else 0 end as gy, x as x0, y as y0, x + w as x1, y + h as y1 from d),
r as (select *, row_number() over (partition by f, gx, gy order by -(x1 - x0) * (y1 - y0), k) as i, count(*) over (partition by f, gx, gy) as m from g),
fold as (select f, gx, gy, i, m, x0, y0, x1, y1, null::struct(x bigint, y bigint, w bigint, h bigint) as out from r where i = 1
    union all select f, gx, gy, i, m, case when j then least(a0, x0) else a0 end, case when j then least(b0, y0) else b0 end, case when j then greatest(a1, x1) else a1 end, case when j then greatest(b1, y1) else b1 end,
        case when not j then {'x': x0, 'y': y0, 'w': x1 - x0, 'h': y1 - y0} end
    from (select *, (x1 - x0) * (y1 - y0) >= median * 0.2 and ((greatest(0, ox) >= least(a1 - a0, x1 - x0) * 0.5 and greatest(0, -oy) < least(b1 - b0, y1 - y0) * 0.3) or (greatest(0, oy) >= least(b1 - b0, y1 - y0) * 0.5 and greatest(0, -ox) < least(a1 - a0, x1 - x0) * 0.3)) as j
        from (select r.*, q.x0 as a0, q.y0 as b0, q.x1 as a1, q.y1 as b1, least(q.x1, r.x1) - greatest(q.x0, r.x0) as ox, least(q.y1, r.y1) - greatest(q.y0, r.y0) as oy from fold q join r on r.f = q.f and r.gx = q.gx and r.gy = q.gy and r.i = q.i + 1)))
select f as page_id, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h from fold where i = m union all select f, out.x, out.y, out.w, out.h from fold where out is not null""",
    "hz_pairs": _with("select * from pairs", PX, COARSE, PAIRS),
    "hz_contacts": _with("select p.*, (select count(*) from touch t where t.figure_id = p.figure_id and lbl = top and other = bottom) as contact from pairs p", PX, COARSE, PAIRS, TOUCH),
    "hz_zones": _with("select figure_id, ord, count(*) as n, sum(y) as ys from zones group by 1, 2", PX, COARSE, PAIRS, TOUCH, ZONES),
    "hz_separated": _with("select figure_id, ord, place, ok from places", BANDS, PAIRS, MIDDLES, PLACES),
    "hz_every_column": _with(
        "select figure_id, ord, x, coalesce(list_median(list_concat(list_concat(near, case when a is not null and x < 5 then list_transform(range(0, 5 - x), lambda i: a) else [] end), case when b is not null and x > 194 then list_transform(range(0, x - 194), lambda i: b) else [] end)), 80) as yb from (select *, list(yb) filter (yb is not null) over (partition by figure_id, ord order by x rows between 5 preceding and 5 following) as near, first_value(yb) over (partition by figure_id, ord order by x) as a, last_value(yb) over (partition by figure_id, ord order by x rows between unbounded preceding and unbounded following) as b from (select figure_id, ord, x from (select distinct figure_id, ord from known), range(0, 200) t(x)) left join known using (figure_id, ord, x))".replace("list_median(", "list_aggregate(").replace(" else [] end)), 80)", " else [] end), 'median'), 80)"),
        BANDS, PAIRS, MIDDLES, "known as (select figure_id, ord, x, yb from mids where x % 7 <> 3 and x > 4)",
    ),
    "hz_adjusted": """with recursive """ + ", ".join([BANDS, PAIRS, TOUCH, MIDDLES, PLACES, ZONES]) + """,
z as (select z.figure_id, z.y, z.x, p.top, p.bottom, z.y <= greatest(0, least(159, round_even(m.yb, 0))) as above, row_number() over (partition by z.figure_id, z.y, z.x order by place) as i from zones z join mids m on m.figure_id = z.figure_id and m.ord = z.ord and m.x = z.x join pairs p on p.figure_id = z.figure_id and p.ord = z.ord join places q on q.figure_id = z.figure_id and q.ord = z.ord),
step as (select figure_id, y, x, lbl, 0 as i from lb union all select s.figure_id, s.y, s.x, case when s.lbl in (top, bottom) then case when above then top else bottom end else s.lbl end, z.i from step s join z on z.figure_id = s.figure_id and z.y = s.y and z.x = s.x and z.i = s.i + 1)
select figure_id, lbl, count(*) as n from (select figure_id, y, x, arg_max(lbl, i) as lbl from step group by 1, 2, 3) group by 1, 2""",
    "lb_edges": _with("select figure_id, lbl, count(*) as sides, sum(a) as twice_area from (select figure_id, lbl, unnest([case when n3 is distinct from lbl then -y end, case when n2 is distinct from lbl then x + 1 end, case when n4 is distinct from lbl then y + 1 end, case when n1 is distinct from lbl then -x end]) as a from near4) where a is not null group by 1, 2", PX, COARSE, TOUCH),
    "lb_ring_areas": _with("select figure_id, lbl, count(*) as area from lb group by 1, 2", PX, COARSE),
    "hz_local_lines": """
        with n as (select user_id, event_id, value, list({'d': abs(o - event_id), 'dx': (o - event_id)::double, 'v': v}) as near from (select e.user_id, e.event_id, e.value, f.event_id as o, f.value as v from (select *, row_number() over (partition by user_id order by event_id) as i from events) e join (select *, row_number() over (partition by user_id order by event_id) as i from events) f on e.user_id = f.user_id and f.i between e.i - 8 and e.i + 8) group by all),
        p as (select user_id, event_id, list_sort(near)[1 : 9] as near from n),
        w as (select user_id, event_id, unnest(near) as q, near[-1].d as radius from p),
        s as (select user_id, event_id, sum(w) as sw, sum(w * dx) as sx, sum(w * v) as sv, sum(w * dx * dx) as sxx, sum(w * dx * v) as sxv from (select user_id, event_id, q.dx as dx, q.v as v, case when radius > 0 then power(1 - power(q.d / radius::double, 3), 3) else 1 end as w from w) group by all)
        select user_id, event_id, round(case when sw * sxx - sx * sx > 1e-9 then (sxx * sv - sx * sxv) / (sw * sxx - sx * sx) else sv / sw end, 4) as smooth from s""",
    "poly_spans": _with("select figure_id, y, lo::int as lo, hi::int as hi from span", DRAWN),
    "poly_mask": _with(
        "select figure_id, lbl, count(*) as n from (select figure_id, case when lbl = 0 then 0 else dense_rank() over (partition by figure_id, lbl > 0 order by lbl) end as lbl from (select l.figure_id, case when exists (select 1 from span s where s.figure_id = l.figure_id and s.y = l.y and l.x between lo and hi) then lbl else 0 end as lbl from lb l)) group by 1, 2",
        SHEET, DRAWN, "lb as (select figure_id, y, x, case when r + g + b > 0 and not (r = 255 and g = 255) then least(3, floor((y + 6 * sin(x / 9.0::double) + figure_id % 4 * 5) / 55) + 1) else 0 end::int as lbl from px)",
    ),
    "lb_disagreement": _with("select figure_id, round(avg(case when near.lbl <> px.r // 43 then 1.0 else 0.0 end), 6) as disagreement from near join px using (figure_id, y, x) group by 1", PX, NEAR),
    "ws_saved": _with("select * from w", WORK),
    "ws_clamped": _with("select session_id, figure_id, status, figure_type, case when confidence is not null then greatest(0, least(1, confidence)) end as confidence, target, engine, tomo, skip_reason from w", WORK),
    **{f"ws_backtrack_{stage}": _back(stage) for stage in ("classify", "panel", "segment")},
    "fig_has_colorbar": "",
    "ov_blend": _with(
        """select figure_id, y, sum(r) as r, sum(g) as g, sum(b) as b from (select figure_id, y, case when lbl is distinct from back and edge then 255 when lbl is not distinct from back then r else floor(r * (1 - 0.65::double) + cr * 0.65::double) end as r,
            case when lbl is distinct from back and edge then 255 when lbl is not distinct from back then g else floor(g * (1 - 0.65::double) + cg * 0.65::double) end as g, case when lbl is distinct from back and edge then 255 when lbl is not distinct from back then b else floor(b * (1 - 0.65::double) + cb * 0.65::double) end as b
        from (select n.*, px.r, px.g, px.b, back, cr, cg, cb, coalesce(n1 <> n.lbl, false) or coalesce(n2 <> n.lbl, false) or coalesce(n3 <> n.lbl, false) or coalesce(n4 <> n.lbl, false) as edge from near4 n join px using (figure_id, y, x) join place p on p.figure_id = n.figure_id and p.lbl = n.lbl join tint on tint.k = p.k left join ground g on g.figure_id = n.figure_id)) group by 1, 2""",
        PX, COARSE, TOUCH,
        "place as (select figure_id, lbl, row_number() over (partition by figure_id order by lbl) as k from (select distinct figure_id, lbl from lb))",
        f"tint as (select * from {_values([(k, *c) for k, c in enumerate(distinct_colors(64), 1)], 'k, cr, cg, cb')})",
        "ground as (select figure_id, arg_max(lbl, (score, -lbl)) as back from (select *, round(e / sum(e) over f * (n / sum(n) over f), 6) as score, e / sum(e) over f as edge, n / sum(n) over f as area from (select lb.figure_id, lbl, count(*) as n, count(*) filter (y = 0 or x = 0 or y = h - 1 or x = w - 1) as e from lb join dims using (figure_id) group by 1, 2) window f as (partition by figure_id)) where edge > 0.25 and area > 0.08 group by 1)",
    ),
    "fig_complexity_best_panel": "",
    "colorbar_value_sample": "",
}

# Built on other queries' SQL.
ORACLE_SQL["fig_complexity_best_panel"] = f"select figure_id // 256 as group_id, arg_max(figure_id, (complexity, -figure_id)) as figure_id, max(complexity) as complexity from ({ORACLE_SQL['fig_complexity']}) group by 1"
ORACLE_SQL["colorbar_value_sample"] = f"""
    with bar as ({ORACLE_SQL["colorbar_bbox"]}), {PX},
    b as (select figure_id, strip, h, w, greatest(4, least(h, w) // 10) as s from bar join dims using (figure_id) where strip <> 'none'),
    f as (select *, case when strip in ('left', 'right') then h else s end as bh, case when strip in ('left', 'right') then s else w end as bw, case strip when 'bottom' then h - s else 0 end as oy, case strip when 'right' then w - s else 0 end as ox from b),
    z as (select figure_id, color_name, (figure_id + k * 37) % 111 as value from (select distinct figure_id from b), (values (0, 'red'), (1, 'yellow'), (2, 'green'), (3, 'blue')) t(k, color_name)),
    a as (select f.*, color_name, value, floor((0.05::double + greatest(0, least(100, value)) / 100.0::double * 0.9::double) * (greatest(bh, bw) - 1))::int as pos from f join z using (figure_id))
    select px.figure_id, color_name, value::int as value, pos as "at", r, g, b from a join px on px.figure_id = a.figure_id and px.y = oy + case when bh >= bw then pos else bh // 2 end and px.x = ox + case when bh >= bw then bw // 2 else pos end"""
ORACLE_SQL["mem_templates"] = ORACLE_SQL["mem_patterns"]
ORACLE_SQL["props_saved"] = f"select figure_id, name, max(vp) as vp, max(vs) as vs, max(rho) as rho, 0 as missing from ({ORACLE_SQL['props_generate']}) group by 1, 2"
ORACLE_SQL["fig_has_colorbar"] = _with(
    "select figure_id, coalesce((rl > 8 and (ra + rb) / 2 > 10) or (bl > 8 and (ba + bb_) / 2 > 10), false) as has_colorbar from (select figure_id, stddev_pop(l) filter (x >= 180) as rl, stddev_pop(a) filter (x >= 180) as ra, stddev_pop(bb) filter (x >= 180) as rb, stddev_pop(l) filter (y >= 140) as bl, stddev_pop(a) filter (y >= 140) as ba, stddev_pop(bb) filter (y >= 140) as bb_ from lab group by 1)", SHEET, _lab()
)
