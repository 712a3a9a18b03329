"""SQL twins of the catalog queries, written for an engine with SHA-256 and bit_xor."""

from __future__ import annotations

from itertools import combinations
from math import pi

from ..config import SynthConfig
from ..functions.hashing import SHUFFLE_ROUNDS, text_seed
from ..operators.cells import SET_PRIME, combo_seed
from .catalog import BLOCKS, CONFIG, FOUR_COLUMNS, MEASURES, QUALITY_PLAN, SALT, THREE_COLUMNS

LEVELS = 26  # deeper than any tree of the order and event columns


def h(text: str) -> str:
    return f"greatest(cast('0x' || substr(sha256({text}), 1, 15) as bigint), 1)"


def entity(expr: str) -> str:
    return f"case when {expr} is null or {expr}::varchar = '' then 0 else {h(f'{expr}::varchar')} end"


def salted(seed: str) -> str:
    return h(f"'{SALT}:' || ({seed})::varchar")


def mix(seed: str, step: str) -> str:
    return f"xor({seed}, {text_seed(step)})"


def normal(seed: str) -> str:
    low, high = f"((({seed}) & 1073741823)::double + 0.5e0)", f"((({seed}) >> 30)::double + 0.5e0)"
    return f"(sqrt(-2e0 * ln({low} / 1073741824e0)) * sin({2 * pi!r}::double * ({high} / 1073741824e0)))"


def layer(seed: str, step: str) -> str:
    return normal(mix(salted(seed), step))


def micro(value: str) -> str:
    return f"cast(floor(({value}) * 1e6 + 0.5e0) as bigint)"


def round_away(value: str) -> str:
    return f"cast(sign({value}) * floor(abs({value}) + 0.5e0) as bigint)"


def strength(n: str, seed: str, config: SynthConfig = CONFIG) -> str:
    noise = layer(seed, "suppress")
    return f"({n} - greatest(0e0, {config.low_layer_sd}::double * ({config.low_mean_gap}::double + {noise})))"


def added(e: str, where: str = "true") -> str:
    """Seed of a set of rows that are entities of their own."""
    return f"(coalesce(sum(({e}) % {SET_PRIME}) filter (where {where}), 0) % {SET_PRIME})::bigint"


def noisy_unique(n: str, seed: str, bucket: str, config: SynthConfig = CONFIG) -> str:
    total = f"({n} + ({layer(bucket, 'noise')} + {layer(seed, 'noise')}) * {config.noise_sd}::double)"
    return round_away(total)


def next_power(x: str) -> str:
    g = f"pow(2e0, ceil(log2({x})))"
    return f"(case when {g} / 2 >= {x} then {g} / 2 when {g} < {x} then {g} * 2 else {g} end)"


def money(x: str) -> str:
    tens = f"pow(10e0, floor(log10({x})))"
    lead = f"({x}) / {tens}"
    return (f"(case when {x} < 1e-10 then 0e0 else {tens} * (case when {lead} < 1.5e0 then 1e0 when {lead} < 3.5e0 "
            f"then 2e0 when {lead} < 7.5e0 then 5e0 else 10e0 end) end)")


def reported(sd: str) -> str:
    step = money(f"({sd} * 0.05e0)")
    return f"(case when {sd} = 0 then 0e0 else ceil({sd} / {step}) * {step} end)"


def row_limit(seed: str, rows: str, fraction: int) -> str:
    limit = f"floor({rows}::double / {fraction})::bigint"
    spread = f"floor(({limit})::double / 20)::bigint"
    return f"({limit} - {spread} + {mix(salted(seed), 'precision_limit')} % (2 * {spread} + 1))"


def snapped(source: str, lo: str, hi: str, keep: str) -> str:
    """CTE body: columns of source plus root_lo, root_size."""
    return f"""
      select {keep}, case when al + sz >= hi__ then al else floor(al / (wide / 2)) * (wide / 2) end as root_lo,
             case when al + sz >= hi__ then sz else wide end as root_size
      from (select *, {next_power('(hi__ - al)')} as wide
            from (select *, floor(lo__ / (sz / 2)) * (sz / 2) as al
                  from (select *, case when hi__ = lo__ then 1e0 else {next_power('(hi__ - lo__)')} end as sz
                        from (select *, {lo} as lo__, {hi} as hi__ from {source}))))"""


NULL_CODE = "case when hi > 0 then 2 * hi when lo < 0 then 2 * lo else 1e0 end"


def flatten_ctes(keys: str, bucket: str, prefix: str = "", config: SynthConfig = CONFIG) -> str:
    """CTEs from contrib(keys, kind, entity, contribution) to counted(keys, noisy, noise_scale, strength)."""
    out, top = config.outliers, config.top
    orr, trr = out.upper - out.lower, top.upper - top.lower
    on = " and ".join(f"a.{k.strip()} is not distinct from b.{k.strip()}" for k in [*keys.split(","), "kind"])
    return f"""
    tot as materialized (select {keys}, kind, count(*) filter (where entity <> 0) as n,
              coalesce(bit_xor(entity) filter (where entity <> 0), 0) as seed,
              coalesce(sum(contribution) filter (where entity <> 0), 0)::bigint as acc,
              coalesce(sum(contribution) filter (where entity = 0), 0)::bigint as una
            from contrib group by all),
    iv as (select *, {out.upper + top.upper} - n as ex from tot),
    iv2 as (select *, floor(ex / 2e0)::bigint as oc, ex - floor(ex / 2e0)::bigint as tc from iv),
    iv3 as (select *, case when n < {out.lower + top.lower} then null when ex <= 0 then {out.upper}
                 when oc <= {orr} and tc <= {trr} then {out.upper} - oc when oc > {orr} then {out.lower}
                 else {out.upper} - ex + {trr} end as ou,
               case when n < {out.lower + top.lower} then null when ex <= 0 then {top.upper}
                 when oc <= {orr} and tc <= {trr} then {top.upper} - tc when oc > {orr} then {top.upper} - ex + {orr}
                 else {top.lower} end as tu from iv2),
    rk as materialized (select *, row_number() over (partition by {keys}, kind order by contribution desc, entity desc) as r
            from contrib where entity <> 0),
    sd as materialized (select a.*, {salted('coalesce((select bit_xor(entity) from rk b where ' + on + ' and b.r <= a.ou + a.tu), 0)')} as fseed
            from iv3 a),
    nn as materialized (select *, {out.lower} + {mix('fseed', 'outlier')} % (ou - {out.lower} + 1) as no,
                  {top.lower} + {mix('fseed', 'top')} % (tu - {top.lower} + 1) as nt from sd),
    mean as materialized (select a.*, (select sum(contribution)::double from rk b where {on} and b.r > a.no and b.r <= a.no + a.nt)
                    / nullif(nt, 0) as m0 from nn a),
    flat as materialized (select a.*, case when ou is null then null else coalesce(m0, 0) end as m,
               case when ou is null then null else coalesce((select sum(greatest(contribution - coalesce(a.m0, 0), 0e0)) from rk b
                 where {on} and b.r <= a.no), 0) end as f from mean a),
    per as materialized (select *, acc - f + greatest(una - f, 0e0) as fsum,
              {config.noise_sd}::double * greatest((acc - f) / nullif(n, 0), 0.5e0 * m) as nsd,
              ({layer(bucket, 'noise')} + {layer('seed', 'noise')}) as unit, {strength('n', 'seed', config)} as st from flat),
    best as (select *, row_number() over (partition by {keys} order by f desc, fsum desc) as vr,
               row_number() over (partition by {keys} order by nsd desc, abs(unit * nsd) desc) as nr from per),
    counted as (select {keys}, bool_or(f is null) as failed, min(st) as strength,
               max(fsum) filter (where vr = 1) as v, max(unit * nsd) filter (where nr = 1) as z, max(nsd) as nsd
             from best group by {keys})"""


def noisy_or_zero() -> str:
    return f"case when failed then 0 else {round_away('(v + z)')} end"


# -- trees -----------------------------------------------------------------------

def tree_strength(n: str, seed: str, config: SynthConfig = CONFIG) -> str:
    least = min(config.low_threshold, config.singularity_threshold, config.range_threshold)
    return f"(case when {n} < {least} then {n}::double else {strength(n, seed, config)} end)"


def label(mid: str, size: str) -> str:
    return f"(round(log2({size}))::int::varchar || ':' || cast(floor({mid} / {size} * 1099511627776e0) as decimal(38, 0))::varchar)"


def tree_ctes(name: str, table: str, column: str, ident: str, p: str, config: SynthConfig = CONFIG,
              unique: bool = True) -> str:
    """CTEs {p}nodes (level, cell, rows, n, s, mn, mx, strength, split) and {p}root of one column's tree.

    Existence counts the ancestors that split; the root moves down while one half is weak.
    """
    low = config.low_threshold
    seed = combo_seed(config, [name])
    stats = (f"count(*) as rows_, count(*) filter (where e <> 0) as n, {added('e')} as s"
             if unique else
             "count(*) as rows_, count(distinct e) filter (where e <> 0) as n, "
             "coalesce((select bit_xor(u) from unnest(list_distinct(list(e))) t(u) where u <> 0), 0) as s")
    grouped = f"""select level, cell, {stats}, min(x) as mn, max(x) as mx from {p}cells group by level, cell"""
    if not unique:
        grouped = f"""select g.level, g.cell, g.rows_, d.n, d.s, g.mn, g.mx from
          (select level, cell, count(*) as rows_, min(x) as mn, max(x) as mx from {p}cells group by level, cell) g
          join (select level, cell, count(*) as n, bit_xor(e) as s from (select distinct level, cell, e from {p}cells
                where e <> 0) group by level, cell) d on g.level = d.level and g.cell = d.cell"""
    return f"""
    {p}base as materialized (select {ident if ident.startswith('greatest(') else entity(ident)} as e, ({column})::double as x from {table}),
    {p}ext as (select *, {NULL_CODE} as nc from (select min(x) as lo, max(x) as hi from {p}base)),
    {p}snap as materialized ({snapped(p + 'ext', 'least(lo, nc)', 'greatest(hi, nc)', 'nc')}),
    {p}cells as materialized (select e, x, l::int as level, least(floor((x - root_lo) / root_size * pow(2e0, l)), pow(2e0, l) - 1)::bigint as cell
              from {p}base, {p}snap, generate_series(0, {LEVELS}) t(l)),
    {p}stats as ({grouped}),
    {p}flag as materialized (select *, mn < mx and strength >= {low} and (level <= {config.depth_threshold} or rows_ - 1 >= lim) as split
             from (select *, {tree_strength('n', 's', config)} as strength,
                   {row_limit(str(seed), f'(select count(*) from {p}base)', config.depth_row_fraction)} as lim from {p}stats)),
    {p}real as materialized (select n.* from {p}flag n join (
               select c.level, c.cell, count(a.level) as up from {p}flag c left join {p}flag a
                 on a.split and a.level < c.level and a.cell = c.cell >> (c.level - a.level) group by c.level, c.cell) u
             on n.level = u.level and n.cell = u.cell where u.up = n.level),
    {p}side as (select level - 1 as level, cell >> 1 as cell,
               coalesce(bool_and(not split and strength < {low}) filter (where cell & 1 = 0), true) as w0,
               coalesce(bool_and(not split and strength < {low}) filter (where cell & 1 = 1), true) as w1
             from {p}real where level > 0 group by 1, 2),
    {p}pass as (select level, cell, w0::int as go from {p}side where w0 <> w1),
    {p}chain as (select e.level + 1 as level, e.cell * 2 + e.go as cell from {p}pass e where e.level + 1 = (
               select count(*) from {p}pass a where a.level <= e.level and
                 a.cell = (e.cell * 2 + e.go) >> (e.level + 1 - a.level) and
                 a.go = ((e.cell * 2 + e.go) >> (e.level - a.level)) & 1)),
    {p}top as materialized (select coalesce(max(level), 0) as tl, coalesce(arg_max(cell, level), 0) as tc from {p}chain),
    {p}root as materialized (select root_lo + tc * (root_size / pow(2e0, tl)) as lo, root_size / pow(2e0, tl) as size, tl, tc,
               nc, r.mn as amin, r.mx as amax from {p}snap, {p}top, {p}real r where r.level = tl and r.cell = tc),
    {p}out as materialized (select coalesce(sum((cell < tc)::int), 0)::bigint as ln, {added('e', 'cell < tc')} as ls,
               coalesce(sum((cell > tc)::int), 0)::bigint as hn, {added('e', 'cell > tc')} as hs
             from {p}cells, {p}root where level = tl),
    {p}sub as (select level - tl as level, cell - (tc << (level - tl)) as cell, rows_, n, s, mn, mx, split, lo, size, amin, amax
             from {p}real, {p}root where level >= tl and cell >> (level - tl) = tc),
    {p}nodes as materialized (select *, {tree_strength('n', 's', config)} as strength from (
             select level, cell, rows_ + (mn = amin)::int * ln + (mx = amax)::int * hn as rows_,
               n + (mn = amin)::int * ln + (mx = amax)::int * hn as n,
               (s + case when mn = amin then ls else 0 end + case when mx = amax then hs else 0 end) % {SET_PRIME} as s,
               mn, mx, split, case when mn = mx then mn else lo + (2 * cell + 1) * size / pow(2e0, level + 1) end as mid,
               size, case when mn = mx then mn else lo + cell * size / pow(2e0, level) end as rlo,
               case when mn = mx then mx else lo + (cell + 1) * size / pow(2e0, level) end as rhi
             from {p}sub, {p}out)),
    {p}counted as materialized (select *, greatest({noisy_unique('n', 's', f"xor({seed}, {h(label('mid', 'size'))})", config)}, {low}) as noisy from {p}nodes)"""


def exact_label(v: str) -> str:
    guess = f"greatest(floor(log2(abs({v}))), -1022)"
    e = (f"greatest(-1022, case when pow(2e0, {guess}) > abs({v}) then {guess} - 1 when pow(2e0, {guess}) * 2 <= abs({v}) then {guess} + 1 "
         f"else {guess} end)::int")
    return (f"(case when {v} = 0 then '0' else (case when {v} < 0 then '-' else '' end) || ({e})::varchar || ':' || "
            f"(abs({v}) / pow(2e0, ({e}) - 52))::bigint::varchar end)")


def deep_tree_sql(value: str, levels: int) -> str:
    """Tree of part sizes, ``levels`` deep: cells are whole numbers in doubles, which halve without an end."""
    cfg, low = CONFIG, CONFIG.low_threshold
    seed = combo_seed(cfg, ["x"])

    def width(size: str, level: str) -> str:
        return f"({size} / pow(2e0, ({level}) // 2) / pow(2e0, ({level}) - ({level}) // 2))"

    def up(cell: str, by: str) -> str:
        return f"floor(({cell}) / pow(2e0, {by}))"

    named = f"case when level > 40 then {exact_label('mid')} else {label('mid', 'size')} end"
    return f"""with base as materialized (select {entity('p_partkey')} as e, ({value})::double as x from part),
      ext as (select *, {NULL_CODE} as nc from (select min(x) as lo, max(x) as hi from base)),
      snap as materialized ({snapped('ext', 'least(lo, nc)', 'greatest(hi, nc)', 'nc')}),
      cells as materialized (select e, x, l::int as level, case when l = 0 then 0e0 else floor(x / {width('root_size', 'l')}) end as cell
        from base, snap, generate_series(0, {levels}) t(l)),
      flag as materialized (select *, mn < mx and strength >= {low} and (level <= {cfg.depth_threshold} or n - 1 >= lim) as split
        from (select *, {tree_strength('n', 's')} as strength, {row_limit(str(seed), '(select count(*) from base)', cfg.depth_row_fraction)} as lim
          from (select level, cell, count(*) as n, {added('e')} as s, min(x) as mn, max(x) as mx from cells group by 1, 2))),
      opened as materialized (select level, cell from flag where split),
      real as materialized (select n.* from flag n where n.level = (select count(*) from opened a
        where a.level < n.level and a.cell = {up('n.cell', 'n.level - a.level')})),
      side as (select level - 1 as level, {up('cell', '1')} as cell,
          coalesce(bool_and(not split and strength < {low}) filter (where cell % 2 = 0), true) as w0,
          coalesce(bool_and(not split and strength < {low}) filter (where cell % 2 = 1), true) as w1 from real where level > 0 group by 1, 2),
      pass as materialized (select level, cell, w0::int as go, cell * 2 + w0::int as child from side where w0 <> w1),
      way as (select e.level + 1 as level, e.child as cell from pass e where e.level + 1 = (select count(*) from pass a
        where a.level <= e.level and a.child = {up('e.child', 'e.level - a.level')})),
      top as materialized (select coalesce(max(level), 0) as tl, coalesce(arg_max(cell, level), 0e0) as tc from way),
      root as materialized (select tc * {width('root_size', 'tl')} as lo, {width('root_size', 'tl')} as size, tl, tc, r.mn as amin, r.mx as amax
        from snap, top, real r where r.level = tl and r.cell = tc),
      far as materialized (select coalesce(sum((cell < tc)::int), 0)::bigint as ln, {added('e', 'cell < tc')} as ls,
          coalesce(sum((cell > tc)::int), 0)::bigint as hn, {added('e', 'cell > tc')} as hs from cells, root where level = tl),
      nodes as materialized (select level - tl as level, case when level = tl then 0e0 else cell end as cell, mn, mx, split, size,
          n + (mn = amin)::int * ln + (mx = amax)::int * hn as n,
          (s + case when mn = amin then ls else 0 end + case when mx = amax then hs else 0 end) % {SET_PRIME} as s,
          case when mn = mx then mn when level = tl then lo + size / 2 else (cell * 2 + 1) * {width('size', 'level - tl')} / 2 end as mid
        from real, root, far where level >= tl and {up('cell', 'level - tl')} = tc)
      select level, cell::bigint as c1, n as rows, n as entities, mn = mx as single, split,
        greatest({noisy_unique('n', 's', f'xor({seed}, {h(named)})')}, {low}) as noisy_count from nodes"""


def order_tree(column: str = "o_totalprice", p: str = "") -> str:
    return tree_ctes(column, "orders", column, "o_orderkey", p)


def tree_2d(columns: tuple[str, str] = ("o_totalprice", "o_custkey")) -> str:
    """CTEs of two one-column trees and dnodes, the nodes of the tree over both columns."""
    cfg, (cx, cy) = CONFIG, columns
    seed = combo_seed(cfg, columns)
    halves = ",\n".join(
        f"count(*) filter (where b{d} = {b}) as h{d}{b}n, {added('e', f'b{d} = {b}')} as h{d}{b}s"
        for d in (1, 2) for b in (0, 1))

    def half(d: int) -> str:
        ok = [f"{tree_strength(f'h{d}{b}n', f'h{d}{b}s')} >= {cfg.low_threshold}" for b in (0, 1)]
        return f"case when {ok[0]} and not ({ok[1]}) then 0 when {ok[1]} and not ({ok[0]}) then 1 else -1 end as half{d}"

    def live(p: str, d: int) -> str:
        return (f"exists (select 1 from {p}nodes s where s.level = c.level and s.cell = c.c{d} and s.strength >= "
                f"case when s.mn = s.mx then {cfg.singularity_threshold} else {cfg.range_threshold} end)")

    def cell(p: str, v: str, level: str) -> str:
        return (f"greatest(0, least(floor(({v} - {p}root.lo) / {p}root.size * pow(2e0, {level})), pow(2e0, {level}) - 1))::bigint")

    labels = {d: label(f"m{d}", f"z{d}") for d in (1, 2)}
    bucket = (f"xor(xor({seed}, {h(labels[1])}), case when {labels[1]} = {labels[2]} then 0 else {h(labels[2])} end)")
    return f"""{order_tree(cx, 'x')}, {order_tree(cy, 'y')},
    dcells as materialized (select {entity('o_orderkey')} as e, {cx}::double as x, {cy}::double as y, l::int as level,
        {cell('x', cx + '::double', 'l')} as c1, {cell('y', cy + '::double', 'l')} as c2,
        {cell('x', cx + '::double', 'l + 1')} & 1 as b1, {cell('y', cy + '::double', 'l + 1')} & 1 as b2
      from orders, xroot, yroot, generate_series(0, 16) t(l)),
    dstats as materialized (select level, c1, c2, count(*) as n, {added('e')} as s, min(x) as mn1, max(x) as mx1, min(y) as mn2,
        max(y) as mx2, {halves} from dcells group by level, c1, c2),
    dlive as materialized (select *, {tree_strength('n', 's')} as strength from dstats),
    dflag as materialized (select *, (mn1 < mx1 or mn2 < mx2) and strength >= {cfg.low_threshold} and not stub as split from (
        select c.*, case when strength < {cfg.low_threshold} then true
          else not {live('x', 1)} and not {live('y', 2)} end as stub from dlive c)),
    dreal as materialized (select n.* from dflag n join (
        select c.level, c.c1, c.c2, count(a.level) as up from dflag c left join dflag a on a.split and a.level < c.level
          and a.c1 = c.c1 >> (c.level - a.level) and a.c2 = c.c2 >> (c.level - a.level) group by all) u
      on n.level = u.level and n.c1 = u.c1 and n.c2 = u.c2 where u.up = n.level),
    dmid as (select d.*, xroot.size as z1, yroot.size as z2,
        case when mn1 = mx1 then mn1 else xroot.lo + (2 * c1 + 1) * xroot.size / pow(2e0, level + 1) end as m1,
        case when mn2 = mx2 then mn2 else yroot.lo + (2 * c2 + 1) * yroot.size / pow(2e0, level + 1) end as m2
      from dreal d, xroot, yroot),
    dnodes as materialized (select *, {half(1)}, {half(2)},
        greatest({noisy_unique('n', 's', bucket)}, {cfg.low_threshold}) as noisy from dmid)"""


def subset_tree(name: str, subset: tuple[int, ...], columns: tuple[str, ...], levels: int) -> list[str]:
    """CTEs of the tree over some columns of orders, level by level; ``name`` holds its nodes.

    Trees of one column fewer are there already, as n<columns>.
    """
    cfg, k = CONFIG, len(subset)
    dims = range(1, k + 1)

    def cell(c: int, level: str) -> str:
        return (f"greatest(0, least(floor(({columns[c]}::double - x{c}root.lo) / x{c}root.size * pow(2e0, {level})), "
                f"pow(2e0, {level}) - 1))::bigint")

    cells = ", ".join(f"{columns[c]}::double as v{d}, {cell(c, 'l')} as c{d}, {cell(c, 'l + 1')} & 1 as b{d}" for d, c in enumerate(subset, 1))
    roots = ", ".join(f"x{c}root" for c in subset)
    keys = ", ".join(f"c{d}" for d in dims)
    spans = ", ".join(f"min(v{d}) as mn{d}, max(v{d}) as mx{d}" for d in dims)
    halves = ", ".join(f"count(*) filter (where b{d} = {b}) as h{d}{b}n, {added('e', f'b{d} = {b}')} as h{d}{b}s"
                       for d in dims for b in (0, 1))
    live = []
    for omit in range(k):
        kept = [d for d in dims if d != omit + 1]
        sub = "n" + "_".join(str(subset[d - 1]) for d in kept)
        same = " and ".join(f"s.c{i} = f.c{d}" for i, d in enumerate(kept, 1))
        point = " and ".join(f"s.mn{i} = s.mx{i}" for i in range(1, k))
        live.append(f"exists (select 1 from {sub} s where s.level = f.level and {same} and not s.stub and s.strength >= "
                    f"case when {point} then {cfg.singularity_threshold} else {cfg.range_threshold} end)")
    varied = " or ".join(f"mn{d} < mx{d}" for d in dims)
    ctes = [f"""{name}cells as materialized (select {entity('o_orderkey')} as e, l::int as level, {cells}
        from orders, {roots}, generate_series(0, {levels}) t(l))""",
            f"""{name}stats as materialized (select *, {tree_strength('n', 's')} as strength from (
        select level, {keys}, count(*) as n, {added('e')} as s, {spans}, {halves} from {name}cells group by level, {keys}))"""]
    for level in range(levels + 1):
        above = "" if not level else (f"join {name}l{level - 1} p on p.split and " + " and ".join(f"p.c{d} = f.c{d} >> 1" for d in dims))
        ctes.append(f"""{name}l{level} as materialized (select *, ({varied}) and strength >= {cfg.low_threshold} and not stub as split from (
            select f.*, f.strength < {cfg.low_threshold} or not ({' or '.join(live)}) as stub
            from (select f.* from {name}stats f {above} where f.level = {level}) f))""")
    return [*ctes, f"{name} as materialized ({' union all '.join(f'select * from {name}l{level}' for level in range(levels + 1))})"]


def subset_nodes_sql(columns: tuple[str, ...], levels: int) -> str:
    """Nodes of the tree over all columns; text columns of orders count by the rank of their value."""
    cfg, k = CONFIG, len(columns)
    texts = [c for c in columns if c in ("o_orderstatus", "o_orderpriority")]
    ranks = ", ".join(f"dense_rank() over (order by {c}) - 1 as {c}" for c in texts)
    ctes = [f"orders as materialized (select * replace ({ranks}) from main.orders)"]
    for i, c in enumerate(columns):
        ctes.append(order_tree(c, f"x{i}"))
        ctes.append(f"n{i} as materialized (select level, cell as c1, mn as mn1, mx as mx1, strength, false as stub from x{i}nodes)")
    for size in range(2, k + 1):
        for subset in combinations(range(k), size):
            ctes += subset_tree("n" + "_".join(map(str, subset)), subset, columns, levels)
    dims = range(1, k + 1)

    def half(d: int) -> str:
        ok = [f"{tree_strength(f'h{d}{b}n', f'h{d}{b}s')} >= {cfg.low_threshold}" for b in (0, 1)]
        return f"case when {ok[0]} and not ({ok[1]}) then 0 when {ok[1]} and not ({ok[0]}) then 1 else -1 end as half{d}"

    mids = ", ".join(f"case when mn{d} = mx{d} then mn{d} else x{d - 1}root.lo + (2 * c{d} + 1) * x{d - 1}root.size / pow(2e0, level + 1) end as m{d}, "
                     f"x{d - 1}root.size as z{d}" for d in dims)
    labels = ", ".join(f"{label(f'm{d}', f'z{d}')} as t{d}" for d in dims)
    bucket = str(combo_seed(cfg, columns))
    for d in dims:
        repeated = " or ".join(f"t{d} = t{e}" for e in range(1, d)) or "false"
        bucket = f"xor({bucket}, case when {repeated} then 0 else {h(f't{d}')} end)"
    shown = ", ".join([*[f"c{d}" for d in dims], *[f"{n}{d}" for d in dims for n in ("mn", "mx")]])
    return f"""with {', '.join(ctes)}
      select level, {shown}, n as rows, strength >= {cfg.low_threshold} and stub as stub, split, {', '.join(half(d) for d in dims)},
        greatest({noisy_unique('n', 's', bucket)}, {cfg.low_threshold}) as noisy_count
      from (select *, {labels} from (select n.*, {mids} from n{'_'.join(map(str, range(k)))} n, {', '.join(f'x{i}root' for i in range(k))}))"""


def rescaled_buckets(buckets: str, node: str, order: str) -> str:
    """Rows of a bucket table (node columns, s, t, n) with n scaled from s to t by carrying remainders over one unit.

    Nothing is carried before the first bucket that does not scale exactly.
    """
    def scaled(p: str) -> str:
        return f"(case when bad is null or {p} <= bad then {p} * t // s else greatest(({p} * t + s - 1) // s - 1, 0) end)"

    return f"""select * exclude (n, bad, p1), ({scaled('p1')} - {scaled('(p1 - n)')})::bigint as n from (
        select *, min(p1 - n) filter (where (n * t) % s <> 0) over (partition by {node}) as bad from (
          select *, (sum(n) over (partition by {node} order by {order}))::bigint as p1 from {buckets}))"""


def harvest_ctes(tree: str | None = None, config: SynthConfig = CONFIG) -> str:
    """CTEs b<level>: bucket lists of all nodes, from the deepest level up to the root."""
    ctes = [tree or order_tree()]
    ctes.append(f"b{LEVELS + 1} as (select 0::bigint as cell, 0 as blevel, 0::bigint as bcell, 0::bigint as ord, 0::bigint as n where false)")
    for lv in range(LEVELS, -1, -1):
        ctes.append(f"""below{lv} as materialized (select cell >> 1 as cell, blevel, bcell, ord, n from b{lv + 1})""")
        ctes.append(f"""sums{lv} as materialized (select cell, sum(n)::bigint as s from below{lv} group by 1)""")
        ctes.append(f"""here{lv} as materialized (select c.cell, c.noisy as t, c.strength, c.split, coalesce(k.s, 0)::bigint as s
          from counted c left join sums{lv} k on c.cell = k.cell where c.level = {lv})""")
        ctes.append(f"""kids{lv} as (select b.*, h.s, h.t from below{lv} b join here{lv} h on b.cell = h.cell where split and 2 * h.s >= h.t)""")
        ctes.append(f"""b{lv} as materialized (select cell, {lv} as blevel, cell as bcell, cell << {LEVELS - lv} as ord, t::bigint as n from here{lv}
            where (not split and strength >= {config.low_threshold}) or (split and 2 * s < t)
          union all select cell, blevel, bcell, ord, n from ({rescaled_buckets(f'kids{lv}', 'cell', 'ord')}) where n > 0)""")
    return ",\n".join(ctes)


def harvest_sql(tree: str | None = None, config: SynthConfig = CONFIG) -> str:
    return (f"with {harvest_ctes(tree, config)}" + """
      select b.blevel as level, b.bcell as c1, c.rlo as lo1, c.rhi as hi1, b.n as count
      from b0 b join counted c on c.level = b.blevel and c.cell = b.bcell""")


def single_sql() -> str:
    """Rows drawn from the buckets of the root, numbered in tree order."""
    draw = f"({h("p || '|0:0'")} >> 7)::double / 9007199254740992e0"
    return f"""with {harvest_ctes()},
      placed as (select c.rlo as lo, c.rhi as hi, b.n, (sum(b.n) over (order by ord))::bigint - b.n as start
        from b0 b join counted c on c.level = b.blevel and c.cell = b.bcell),
      drawn as (select lo, hi, start + unnest(generate_series(0, n - 1)) as p from placed)
      select lo + {draw} * (hi - lo) as o_totalprice from drawn"""


def dependence_sql() -> str:
    """Pairwise walk, level by level, over all pairs of reachable cells."""
    cfg = CONFIG

    def reach(p: str) -> str:
        return f"""{p}heavy as materialized (select * from {p}counted where noisy >= {cfg.range_threshold}),
        {p}reach as materialized (select n.* from {p}heavy n where n.level = (select count(*) from {p}heavy a
            where a.level < n.level and a.cell = n.cell >> (n.level - a.level))),
        {p}walk as materialized (select level, cell, noisy, false as held from {p}reach union all
            select l::int, least(floor((mn - r.lo) / r.size * pow(2e0, l)), pow(2e0, l) - 1)::bigint, noisy, true
            from {p}reach n, {p}root r, generate_series(0, {LEVELS}) t(l) where n.mn = n.mx and l > n.level
              and l <= (select max(level) from {p}nodes))"""

    return f"""with {tree_2d()}, {reach('x')}, {reach('y')},
      pairs as materialized (select a.level, a.cell as c1, b.cell as c2,
          a.noisy::double * b.noisy / (select count(*) from orders) as e
        from xwalk a join ywalk b on a.level = b.level where a.level > 0 and not (a.held and b.held)),
      scored as (select e, coalesce(d.noisy, 0)::double as a from pairs p left join dnodes d
        on d.level = p.level and d.c1 = p.c1 and d.c2 = p.c2)
      select 0 as col_x, 1 as col_y, {micro('coalesce(sum(e * abs(e - a) / greatest(e, a)) / sum(e), 0)')} as dependence from scored"""


def entity_tree_sql() -> str:
    """Events: tree of value over users; rows of kept nodes, outlying values clamped, then flattened counts."""
    cfg = CONFIG
    seed = combo_seed(cfg, ["value"])
    tree = tree_ctes("value", "events", "value", "user_id", "", unique=False)
    bucket = f"xor({seed}, {h(label('mid', 'size'))})"
    return f"""with {tree},
      kept as materialized (select level, cell, mn, mx, split, size, mid from nodes),
      contrib as materialized (select k.level, k.cell, k.mid, k.size, 0 as kind, b.e as entity, count(*) as contribution
        from (select e, greatest(amin, least(amax, x)) as x from base, root) b, root r, kept k
        where least(floor((b.x - r.lo) / r.size * pow(2e0, k.level)), pow(2e0, k.level) - 1)::bigint = k.cell group by all),
      {flatten_ctes('level, cell, mid, size', bucket)}
      select k.level, k.cell as c1, s.n as entities, k.mn as mn1, k.mx as mx1, k.split,
             greatest({noisy_or_zero()}, {cfg.low_threshold}) as noisy_count
      from kept k join counted2 c on k.level = c.level and k.cell = c.cell join sub s on s.level = k.level and s.cell = k.cell
      """.replace("counted2", "counted_e").replace("counted as (select level, cell, mid", "counted_e as (select level, cell, mid")


def node_totals_sql() -> str:
    """Bucket lists of two-column nodes; leaves that are no points are refined to single rows, so are gaps."""
    ctes, deepest = [tree_2d()], 16
    ctes.append(f"b{deepest + 1} as (select 0::bigint as c1, 0::bigint as c2, 0::bigint as ord, 0::bigint as n where false)")
    for lv in range(deepest, -1, -1):
        ctes.append(f"""below{lv} as materialized (select c1 >> 1 as c1, c2 >> 1 as c2, n, row_number() over (
            partition by c1 >> 1, c2 >> 1 order by c1 & 1, c2 & 1, ord) as ord from b{lv + 1})""")
        ctes.append(f"""here{lv} as materialized (select d.c1, d.c2, d.noisy as t, d.split, d.strength, d.mn1 = d.mx1 and d.mn2 = d.mx2 as point,
            coalesce(k.s, 0)::bigint as s, d.split and 2 * coalesce(k.s, 0) < d.noisy as gap
          from dnodes d left join (select c1, c2, sum(n)::bigint as s from below{lv} group by 1, 2) k on d.c1 = k.c1 and d.c2 = k.c2
          where d.level = {lv})""")
        ctes.append(f"kids{lv} as (select b.*, h.s, h.t from below{lv} b join here{lv} h on b.c1 = h.c1 and b.c2 = h.c2 where split and not gap)")
        ctes.append(f"""b{lv} as materialized (
          select c1, c2, 0::bigint as ord, t::bigint as n from here{lv} where not split and point and strength >= {CONFIG.low_threshold}
          union all select c1, c2, 1000000000 + i, 1::bigint from (select c1, c2, unnest(generate_series(1, t - s)) as i from here{lv}
            where gap or (not split and not point and strength >= {CONFIG.low_threshold}))
          union all select b.c1, b.c2, b.ord, b.n from below{lv} b join here{lv} h on b.c1 = h.c1 and b.c2 = h.c2 where gap
          union all select c1, c2, ord, n from ({rescaled_buckets(f'kids{lv}', 'c1, c2', 'ord')}) where n > 0)""")
        ctes.append(f"""t{lv} as (select {lv} as level, h.c1, h.c2, h.s as inr, coalesce(x.total, 0)::bigint as total from here{lv} h left join (
          select c1, c2, sum(n) as total from b{lv} group by 1, 2) x on h.c1 = x.c1 and h.c2 = x.c2)""")
    union = " union all ".join(f"select * from t{lv}" for lv in range(deepest + 1))
    return ("with " + ",\n".join(ctes) + f"""
      select level, c1, c2, total, inr as children, coalesce(sum(total) over (partition by level, c1 >> 1, c2 >> 1
        order by c1 & 1, c2 & 1 rows between unbounded preceding and 1 preceding), 0)::bigint as offset_rows from ({union})""")


def stitch_bins_sql() -> str:
    """A range is halved while both halves hold similar counts on the two sides and neither side has a single row."""
    return f"""
      with v as (select 'l' as side, o_totalprice as x from orders union all
                 select 'r', o_totalprice + 500 * (o_custkey % 7) from orders),
        c as materialized (select l::int as level, least(floor(x / 524288e0 * pow(2e0, l)), pow(2e0, l) - 1)::bigint as cell,
          count(*) filter (where side = 'l') as a, count(*) filter (where side = 'r') as b
          from v, generate_series(0, {LEVELS}) t(l) group by 1, 2),
        h as (select level - 1 as level, cell >> 1 as cell, count(*) as parts,
          bool_and(least(a, b) > 0 and least(a, b)::double / greatest(a, b) >= 0.7e0) as fair from c where level > 0 group by 1, 2),
        f as materialized (select c.*, coalesce(h.parts = 2 and h.fair and a <> 1 and b <> 1, false) as opened
          from c left join h on c.level = h.level and c.cell = h.cell)
      select level, cell, a as left_rows, b as right_rows, round_even((a + b) / 2, 0)::bigint as merged from f n
      where not opened and level = (select count(*) from f u where u.opened and u.level < n.level
        and u.cell = n.cell >> (n.level - u.level))"""


def stitch_owners_sql() -> str:
    """Bins by the recursion itself, a step of every open bin at a time; then draws, ranks and pairs inside the bins."""
    def now(low: str, high: str) -> str:
        return f"case when turn = 0 then {low} else {high} end"

    step = f"""select side, pos, x, y, num, bin || case when split then up::int::varchar else '' end as bin,
          case when turn = 0 and (split and up or empty_low) then mid else lo0 end as lo0,
          case when turn = 0 and (split and not up or empty_high) then mid else hi0 end as hi0,
          case when turn = 1 and (split and up or empty_low) then mid else lo1 end as lo1,
          case when turn = 1 and (split and not up or empty_high) then mid else hi1 end as hi1,
          1 - turn as turn, case when split then 2 else attempts - 1 end as attempts, false as done
        from (select *, open and least(l1, r1) > 0 and least(l1, r1)::double / greatest(l1, r1) >= 0.7e0
              and least(l0, r0) > 0 and least(l0, r0)::double / greatest(l0, r0) >= 0.7e0 as split,
            open and l0 + r0 = 0 as empty_low, open and l1 + r1 = 0 as empty_high
          from (select *, turn = 0 or hi1 - lo1 > 1 or (hi1 = 1048576 and hi1 - lo1 >= 1) as open,
              count(*) filter (where side = 'l' and up) over w as l1, count(*) filter (where side = 'r' and up) over w as r1,
              count(*) filter (where side = 'l' and not up) over w as l0, count(*) filter (where side = 'r' and not up) over w as r0
            from (select *, ({now('lo0 + hi0', 'lo1 + hi1')}) / 2 as mid, {now('x', 'y')} >= ({now('lo0 + hi0', 'lo1 + hi1')}) / 2 as up from b where not done)
            window w as (partition by bin)))
        """
    marked = """select * replace (attempts = 0 or count(*) filter (where side = 'l') over (partition by bin) = 1
          or count(*) filter (where side = 'r') over (partition by bin) = 1 as done) from"""

    def side(tag: str, owner: str) -> str:
        again = h(f"pos || '|' || copy || '|{tag}2'")
        return f"""(select bin, x, y, num, row_number() over (partition by bin order by x, y, {again}, pos, copy) - 1 as i from (
            select k.bin, k.pos, k.x, k.y, k.num, 0::bigint as copy from ranked k join sized z on k.bin = z.bin and z.owner = '{owner}' where k.side = '{tag}' and k.at < z.m
            union all select k.bin, k.pos, k.x, k.y, k.num, e.copy from (select bin, copy, {h(f"bin || '|' || copy || '|{tag}'")} % n as at from (
                select bin, {tag} as n, unnest(generate_series({tag}, m - 1)) as copy from sized where owner = '{owner}' and m > {tag})) e
              join ranked k on k.side = '{tag}' and k.bin = e.bin and k.at = e.at))"""

    def pairs(owner: str, ours: str) -> str:
        return f"""select '{owner}' as owner, case when {ours} then a.x else b.x end as price, case when {ours} then a.y else b.y end as customer,
          a.num as number, b.num as raised_number from {side('l', owner)} a join {side('r', owner)} b on a.bin = b.bin and a.i = b.i"""

    ranking = "row_number() over (partition by side, bin order by " + h("pos || '|' || side") + ", pos) - 1 as at"
    return f"""with recursive v as (select 'l' as side, o_orderkey::varchar as pos, o_totalprice as x, o_custkey::double as y, o_orderkey::double as num from orders
          union all select 'r', o_orderkey::varchar, o_totalprice + 500 * (o_custkey::double % 7), o_custkey::double, o_orderkey::double
            from orders where o_orderkey % 5 <> 0),
        b as ({marked} (select *, 'b' as bin, 0e0 as lo0, 524288e0 as hi0, 0e0 as lo1, 1048576e0 as hi1, 0 as turn, 2 as attempts, false as done from v)
          union all {marked} ({step})),
        ranked as materialized (select side, pos, x, y, num, bin, {ranking} from b where done),
        sizes as (select bin, count(*) filter (where side = 'l') as l, count(*) filter (where side = 'r') as r from ranked group by 1),
        sized as materialized (select 'left' as owner, *, l as m from sizes union all select 'right', *, r from sizes
          union all select 'shared', *, round_even((l + r) / 2, 0)::bigint from sizes)
      {pairs('left', 'true')} union all {pairs('right', 'false')} union all {pairs('shared', 'a.i % 2 = 0')}"""


def shuffled_sql(rows: str, key: str) -> str:
    """Rows (.., spot, size) with spot moved by a keyed permutation: mirrored pairs are swapped, round by round."""
    for i in range(SHUFFLE_ROUNDS):
        mirror, factor, shift = (text_seed(f"{name}|{i}|{key}") for name in ("mirror", "factor", "shift"))
        prime = 2147483647
        rows = f"""select * replace (case when ((mixed % {prime}) * (mixed % {prime}) % {prime}) & 8192 <> 0 then other else spot end as spot)
          from (select * exclude (mixed), greatest(spot, other) % {prime} * {factor % (prime - 1) + 1} % {prime} + {shift % prime} as mixed
            from (select *, 0 as mixed, (({mirror} % size - spot) % size + size) % size as other
              from ({rows})))"""
        rows = f"select * exclude (mixed, other) from ({rows})"
    return rows


def corr(i: int, j: int) -> str:
    return f"abs(corr({MEASURES[i]}, {MEASURES[j]}))"


def oracle_queries() -> dict[str, str]:
    visitor = "case when user_id % 10 <> 0 then user_id end"
    x, low = "(o_totalprice / 7)", CONFIG.low_threshold
    out: dict[str, str] = {}

    out["value_parsing"] = """
      select o_orderkey,
        case o_orderkey % 8 when 0 then 'true' when 1 then 'true' when 2 then 'false' when 4 then 'false' when 6 then 'true'
          when 7 then 'false' else 'NULL' end as flag,
        case when o_orderkey % 5 <> 0 then o_orderkey else -1 end as whole,
        case when o_orderkey % 7 <> 0 then (o_orderkey + 1000) * 1000e0 + o_orderkey % 1000 + 0.25e0 end as amount,
        case when o_orderkey % 3 < 2 then o_orderdate end as moment from orders"""
    out["seed_texts"] = f"""
      select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') as day, case when o_orderkey % 2 = 0 then 't' else 'f' end as flag,
        case when o_orderstatus = 'P' then 'NULL' else o_orderstatus end as status,
        '[''' || o_orderstatus || ''', ''' || o_orderpriority || ''']' as listed,
        xor(xor({text_seed('demo')}, {h('o_orderstatus')}), {h("case when o_orderkey % 2 = 0 then 't' else 'f' end")}) as seed
      from orders"""
    ent = entity("nullif(o_orderkey % 1000, 0)")
    out["noise_values"] = f"""
      select o_orderkey, entity, salted, 2 + {mix('salted', 'top')} % 4 as uniform, {micro(normal('salted'))} as normal,
        {micro('(' + layer('entity', 'noise') + ' + ' + layer('pri', 'noise') + ') * 2e0')} as noise
      from (select *, {salted('entity')} as salted, {h('o_orderpriority')} as pri from (select *, {ent} as entity from orders))"""
    out["row_limits"] = f"select o_orderkey, {row_limit(h('o_orderpriority'), '(o_orderkey * 1000)', 10000)} as row_limit from orders"
    thousand = f"floor({x} / 1000)"
    out["rounding"] = f"""
      select o_orderkey, {micro(money(x))} as money, abs({money(thousand)} - {thousand}) < 1e-12 as is_money,
        {micro(reported(x))} as reported, {round_away(f'({x} - 20000)')} as rounded,
        {micro(f'floor({x} / 0.5e0) * 0.5e0')} as floored, {micro(f'ceil({x} / 0.5e0) * 0.5e0')} as ceiled from orders"""
    out["range_tests"] = f"""
      with li as (select l_suppkey, min(l_quantity) as lo, max(l_quantity) as hi, min(l_discount) as lo2, avg(l_quantity) as mean
                  from lineitem group by 1),
        m as (select *, case when lo = hi then lo else (lo + hi) / 2 end as mid from li),
        f as (select *, case when lo = hi or mean < mid then 0 else 1 end as side from m)
      select l_suppkey, mid as middle, side, case when side = 0 then mid else hi end as half_hi, 2 >= lo and 49 <= hi as holds,
        50 = lo or (50 > lo and 50 < hi) as has, 50 >= lo and 50 <= hi as has_end, 50 < hi and 60 > lo as meets, lo = hi as single,
        root_lo as snap_lo, root_size as snap_size from ({snapped('f', 'lo2', 'mean', '*')})"""
    out["numeric_codes"] = f"""
      select event_id, {micro('epoch_us(ts) / 1e6 + 5364662400e0')} as moment, case when value > 50 then 1e0 else 0e0 end as flag,
        user_id::double as whole, nullif(value, 5) as amount from events"""
    u = f"({h('o_orderkey::varchar')} / 1152921504606846976e0)"
    out["decoded_fields"] = f"""
      with d as (select *, lo + u * (hi - lo) as code from (select *, case when o_orderkey % 4 = 0 then lo else lo + 64 end as hi
                 from (select *, floor(o_totalprice / 64) * 64e0 as lo, {u} as u from orders)))
      select o_orderkey, case when lo <> 64000 then trunc(code)::bigint else -1 end as whole, case when lo <> 64000 then {micro('code')} else -1 end as amount,
        case when lo <> 64000 then date_trunc('second', make_timestamp(trunc((code - 5364662400e0) * 1e6)::bigint))::timestamp end as moment,
        u >= 0.5e0 as flag from d"""
    out["string_codes"] = " union all ".join(
        f"select '{c}' as name, text, dense_rank() over (order by text) - 1 as code from (select distinct {c} as text from part)"
        for c in ("p_name", "p_brand", "p_type"))
    measures = [*MEASURES, "-l_tax", "0e0", "null"]
    extents = " union all ".join(
        f"select {i} as \"column\", coalesce(min({m})::double, 0e0) as lo, coalesce(max({m})::double, 0e0) as hi from lineitem"
        for i, m in enumerate(measures))
    keep = '"column", lo, hi, null_code'
    out["root_ranges"] = f"""
      with ext as (select *, {NULL_CODE} as null_code from ({extents}))
      select "column", lo + 0e0 as lo, hi + 0e0 as hi, null_code + 0e0 as null_code, root_lo + 0e0 as root_lo, root_size
      from ({snapped('ext', 'least(lo, null_code)', 'greatest(hi, null_code)', keep)})"""
    out["cell_counts"] = """
      select l::int as level, least(floor(l_extendedprice / 131072e0 * pow(2e0, l)), pow(2e0, l) - 1)::bigint as cell,
        count(*) as rows, min(l_extendedprice) as lowest from lineitem, generate_series(0, 14) t(l) group by 1, 2"""
    marked = ", ".join(f"coalesce('=' || {c}::varchar, '~')" for c in ("conv_id", "role", "text", "turn"))
    out["content_digests"] = f"""
      with d as (select cast('0x' || substr(sha256(concat_ws(chr(31), {marked})), 1, 15) as bigint) as digest from conversations)
      select bit_xor(digest) as digest, sum(digest % 1048573)::bigint as weight, count(*) as rows from d"""
    out["csv_texts"] = """
      select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_orderstatus, o_totalprice::varchar as o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority from orders"""
    out["csv_round_trip"] = """
      select o_orderkey, o_totalprice, o_orderdate, case when o_orderstatus = 'P' then '' else o_orderstatus end as o_orderstatus,
        o_orderpriority, o_custkey::varchar as o_custkey from orders"""
    out["csv_inferred"] = "select event_id::int as event_id, date_trunc('second', ts)::timestamp as ts, event_type, value from events"

    line_contrib = " union all ".join(
        f"select {{keys}}, {k} as kind, {entity(c)} as entity, count(*) as contribution from {{source}} group by all"
        for k, c in enumerate(("l_orderkey", "l_suppkey")))
    out["entity_counts"] = f"""
      select l_returnflag, l_linestatus, kind, count(*) as entities, bit_xor(entity) as seed, sum(contribution)::bigint as accounted,
        0::bigint as unaccounted from ({line_contrib.format(keys='l_returnflag, l_linestatus', source='lineitem')}) group by 1, 2, 3"""
    weak = strength("entities", "seed")
    out["low_count_groups"] = f"""
      select day, entities, {weak} < {low} as low_count, {weak} < {CONFIG.range_threshold} as below_range
      from (select day, count(*) as entities, bit_xor(e) as seed from (select distinct strftime(l_shipdate, '%Y-%m-%d') as day,
            {entity('l_suppkey')} as e from lineitem) group by 1)"""
    bucket = h("month || '|' || o_orderpriority")
    out["noisy_unique_counts"] = f"""
      select month, o_orderpriority, entities, {noisy_unique('entities', 'seed', bucket)} as noisy_count
      from (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority, count(*) as entities, bit_xor({entity('o_orderkey')}) as seed
            from orders group by 1, 2)"""
    out["entity_contributions"] = f"""
      select event_type, 0 as kind, entity, count(*) as contribution from (select event_type, {entity('v')} as entity
        from (select *, {visitor} as v from events)) group by all"""
    bucket = h("event_type || '|' || slot")
    out["flattened_counts"] = f"""
      with contrib as materialized (select event_type, slot, 0 as kind, {entity('v')} as entity, count(*) as contribution
          from (select *, {visitor} as v, strftime(ts, '%Y-%m-%d %H') as slot from events) group by all),
        {flatten_ctes('event_type, slot', bucket)}
      select event_type, slot, {noisy_or_zero()} as noisy_count, case when not failed then {micro(reported('nsd'))} else -1 end as noise_scale,
        {micro('strength')} as strength from counted"""
    bucket = h("l_returnflag || '|' || size::varchar")
    source = "(select *, floor(l_quantity / 10)::bigint as size from lineitem)"
    out["private_groups"] = f"""
      with contrib as materialized ({line_contrib.format(keys='l_returnflag, size', source=source)}),
        {flatten_ctes('l_returnflag, size', bucket)}
      select l_returnflag, size, greatest({noisy_or_zero()}, {low}) as noisy_count from counted where strength >= {low}"""

    out["tree_nodes_1d"] = f"""with {order_tree()}
      select level, cell as c1, rows_ as rows, n as entities, s as seed, mn as mn1, mx as mx1, {micro('strength')} as strength, split,
        noisy as noisy_count from counted"""
    row = h(f"'=' || {exact_label('l_quantity::double')}")
    out["tree_nodes_no_ids"] = f"""with {tree_ctes('l_quantity', 'lineitem', 'l_quantity', row, '')}
      select level, cell as c1, rows_ as rows, s as seed, mn as mn1, mx as mx1, {micro('strength')} as strength, split, noisy as noisy_count
      from counted"""
    out["tree_nodes_3d"] = subset_nodes_sql(THREE_COLUMNS, 16)
    out["tree_nodes_4d"] = subset_nodes_sql(FOUR_COLUMNS, 16)
    out["tree_nodes_far"] = deep_tree_sql("case when p_partkey = 1 then 1e30 else p_size end", 115)
    out["tree_nodes_fine"] = deep_tree_sql("case when p_partkey % 3 = 0 then p_size * 1e-300 else 1e0 end", 1005)
    out["root_facts"] = f"""with {order_tree()}
      select 'o_totalprice' as name, 'real' as kind, nc as null_code, lo as root_lo, lo + size as root_hi from root"""
    out["tree_nodes_2d"] = f"""with {tree_2d()}
      select level, c1, c2, n as rows, mn1, mx1, mn2, mx2, {micro('strength')} as strength,
        strength >= {low} and stub as stub, split, half1, half2, noisy as noisy_count from dnodes"""
    bounds = ", ".join(f"case when mn{d} = mx{d} then mn{d} else {r}.lo + (c{d} + {i}) * {r}.size / pow(2e0, level) end as {n}{d}"
                       for d, r in ((1, "xroot"), (2, "yroot")) for i, n in enumerate(("lo", "hi")))
    out["inspected_nodes"] = f"""with orders as materialized (select * replace (dense_rank() over (order by o_orderstatus) - 1 as o_orderstatus)
          from main.orders), {tree_2d(("o_totalprice", "o_orderstatus"))}
      select level, c1, c2, {bounds}, stub, split, noisy as noisy_count from dnodes, xroot, yroot"""
    out["harvest_1d"] = harvest_sql()
    block = ("(select o_orderkey, o_orderkey // 3780 * 128 + case when o_orderkey % 3780 < 3720 then o_orderkey % 3780 // 186 * 2 "
             "+ (o_orderkey % 3780 % 186 >= 124)::int else 64 end as x from orders)")
    out["harvest_fronts"] = harvest_sql(tree_ctes("x", block, "x", "o_orderkey", "", BLOCKS), BLOCKS)
    out["synthesize_single"] = single_sql()
    out["column_entropies"] = f"""with {order_tree()},
        e as (select sum(-(noisy / total) * log2(noisy / total)) as entropy from (select noisy::double as noisy,
              (select noisy::double from counted where level = 0) as total from counted where not split))
      select 0 as col, {micro('entropy')} as entropy, {micro('1 + sqrt(greatest(entropy, 1e0))')} as weight from e"""
    out["pair_dependence"] = dependence_sql()
    totals = " union all ".join(
        f"select {i} as col, {micro(' + '.join(corr(i, j) for j in range(4) if j != i))} as total from lineitem" for i in range(4))
    out["total_dependences"] = totals
    initial, derived = QUALITY_PLAN
    groups = [initial, *[[*s, *d] for s, d in derived]]
    met = " + ".join(corr(a, b) for g in groups for a in g for b in g if a != b)
    total = " + ".join(corr(i, j) for i in range(4) for j in range(4) if i != j)
    out["plan_quality"] = f"select {micro(f'(({total}) - ({met})) / 8e0')} as quality from lineitem"
    role = "case when count(distinct {c}) <= 15 then 'categorical' when '{k}' = 's' then 'text' else 'continuous' end"
    kinds = [("l_quantity", "r", "lineitem"), ("l_discount", "r", "lineitem"), ("l_returnflag", "s", "lineitem"),
             ("l_shipdate", "t", "lineitem"), ("l_suppkey", "i", "lineitem"), ("text", "s", "documents"), ("lang", "s", "documents")]
    out["column_roles"] = " union all ".join(
        f"select '{c}' as \"column\", {role.format(c=c, k=k)} as role from {t}" for c, k, t in kinds)
    out["complete_rows"] = f"""
      select event_id, event_type as kind, {micro('epoch_us(ts) / 1e6 + 5364662400e0')} as moment from events where event_type <> 'view'"""
    out["text_ranges"] = """
      with recursive w as (select text, row_number() over (order by text) - 1 as code from (select distinct text from documents)),
        p as (select a.code, a.text as lo, b.text as hi from w a join w b on b.code = a.code + 1),
        s as (select code, lo, hi, 0::bigint as ok, least(length(lo), length(hi))::bigint as top from p union all
              select code, lo, hi, case when substr(lo, 1, m) = substr(hi, 1, m) then m else ok end,
                case when substr(lo, 1, m) = substr(hi, 1, m) then top else m - 1 end
              from (select *, (ok + top + 1) // 2 as m from s where ok < top))
      select code, substr(lo, 1, ok) || '*' || code as shown from s where ok = top"""
    out["tree_nodes_by_entity"] = entity_tree_sql()
    out["node_totals_2d"] = node_totals_sql()
    out["stitch_owners"] = stitch_owners_sql()
    out["stitch_bin_sizes"] = stitch_bins_sql()
    out["patch_join"] = f"""
      with n as (select (select count(*) from customer) as have, (select count(*) from orders) as wanted),
        r as ({shuffled_sql("select c_acctbal as balance, c_custkey as spot, have as size from customer, n", "1")}),
        l as (select o_orderkey as pos, o_totalprice as price, case when have >= wanted or o_orderkey < have then o_orderkey
            else {h("o_orderkey || '|1'")} % have end as slot from orders, n)
      select pos, price, balance from l join r on l.slot = r.spot"""
    return out
