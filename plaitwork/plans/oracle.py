"""SQL that gives the queries' rows: recursion over anti-diagonals and over anchors."""

from __future__ import annotations



def record_pairs(size: int) -> str:
    return f"""d as (select doc_id, text t from documents where text is not null),
p0 as (select doc_id, cast(i as int) rec, substr(t, {size} * i + 1, {size}) query, substr(t, {size} * (i + 1) + 1, {size}) ref
  from (select doc_id, t, unnest(range(0, (length(t) - 1) // {size})) i from d where length(t) > {size}))"""


RECORD_PAIRS = record_pairs(32)
TURN_PAIRS = """p0 as (select a.conv_id, a.turn, coalesce(a.text, '') query, coalesce(b.text, '') ref
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""
PART_PAIRS = "p0 as (select p_partkey, p_name query, lower(p_type) ref from part)"
RECORD_KEYS, TURN_KEYS, PART_KEYS = "doc_id, rec", "conv_id, turn", "p_partkey"


def _pairs(source: str) -> str:
    """p: the pairs numbered, with arrays of symbols and their lengths."""
    return f"""{source},
p as materialized (select *, row_number() over () id, case when query = '' then [] else string_split(query, '') end q, case when ref = '' then [] else string_split(ref, '') end r, length(query) m, length(ref) n from p0)"""


def diagonals(cell: str, edge: str, extra: str = "", extra_zero: str = "", name: str = "w", pairs: str = "p") -> str:
    """Recursion over anti-diagonals k of pairs(id, q, r, m, n): h1 and h2 are the last two, indexed by ref column from 1.

    ``cell`` gives an inner cell from h1, h2, i, j and s, ``edge`` one on the border; others are null.
    """
    return f"""{name}(id, k, h1, h2{extra_zero and ', ' + extra_zero.split(':')[0]}) as (
  select id, 0, [0], cast([] as int[]){extra_zero and ', ' + extra_zero.split(':')[1]} from {pairs}
  union all
  select w.id, w.k + 1, w.h, w.h1{extra} from (select w.*, list_transform(range(0, least(w.k + 1, n) + 1), lambda j:
    case when w.k + 1 - j > m then null when j = 0 or w.k + 1 = j then {edge} else {cell} end) h
  from {name} w join {pairs} p using (id) where w.k < m + n) w)"""


_STEP = "case when q[w.k + 1 - j] = r[j] then 1 else -1 end"
_IN = "coalesce({0}, -1000000)"
NW_CELL = f"cast(greatest(w.h2[j] + {_STEP}, {_IN.format('w.h1[j + 1]')} - 1, {_IN.format('w.h1[j]')} - 1) as int)"
NW_EDGE = "cast(-(w.k + 1) as int)"
SW_CELL = f"cast(greatest(0, w.h2[j] + {_STEP}, w.h1[j + 1] - 1, w.h1[j] - 1) as int)"


def sw_sql(source: str, keys: str, out: str = "score") -> str:
    best = ", greatest(w.best, coalesce(list_max(w.h), 0))"
    return f"with recursive {_pairs(source)}, {diagonals(SW_CELL, '0', best, 'best:0')} select {keys}, cast(best as int) {out} from w join p using (id) where w.k = m + n"


def sw_cte(source: str, prefix: str = "with recursive ") -> str:
    best = ", greatest(w.best, coalesce(list_max(w.h), 0))"
    return f"{prefix}{_pairs(source)}, {diagonals(SW_CELL, '0', best, 'best:0')}"


def banded_cell(band: int) -> str:
    return f"case when 2 * j - w.k - 1 >= 0 and 2 * j - w.k - 1 < {band} then {SW_CELL} else 0 end"


def banded_sql(source: str, keys: str, band: int) -> str:
    best = ", greatest(w.best, coalesce(list_max(w.h), 0))"
    return f"with recursive {_pairs(source)}, {diagonals(banded_cell(band), '0', best, 'best:0')} select {keys}, cast(best as int) score from w join p using (id) where w.k = m + n"


def argmax_sql(source: str, keys: str) -> str:
    # On a diagonal the first best cell by rows is the one of the largest j.
    top = "coalesce(list_max(w.h), 0)"
    j = f"(len(w.h) - list_position(list_reverse(w.h), {top}))"
    better = f"({top} > w.best or ({top} = w.best and {top} > 0 and w.k + 1 - {j} < w.bi))"
    extra = f", case when {better} then {top} else w.best end, case when {better} then w.k + 1 - {j} else w.bi end, case when {better} then {j} else w.bj end"
    sql = diagonals(SW_CELL, "0", extra, "best, bi, bj:0, cast(1 as bigint), cast(1 as bigint)")
    return f"with recursive {_pairs(source)}, {sql} select {keys}, cast(best as int) score, cast(bi - 1 as int) i, cast(bj - 1 as int) j from w join p using (id) where w.k = m + n"


def nw_sql(source: str, keys: str) -> str:
    return f"with recursive {_pairs(source)}, {diagonals(NW_CELL, NW_EDGE)} select {keys}, cast(w.h1[n + 1] as int) score from w join p using (id) where w.k = m + n"


def _cells(name: str, out: str) -> str:
    return f"{out} as materialized (select id, cast(k - j as int) i, cast(j as int) j, h from (select id, k, unnest(range(0, len(h1))) j, unnest(h1) h from {name}) where h is not null)"


def matrix_cte(source: str) -> str:
    return f"with recursive {_pairs(source)}, {diagonals(NW_CELL, NW_EDGE)}, {_cells('w', 'f')}"


def both_cte(source: str) -> str:
    """f and s: prefix and suffix matrices."""
    turned = "pr as (select id, list_reverse(q) q, list_reverse(r) r, m, n from p)"
    suffix = diagonals(NW_CELL, NW_EDGE, name="v", pairs="pr")
    return f"{matrix_cte(source)}, {turned}, {suffix}, {_cells('v', 's0')}, s as materialized (select id, cast(m - i as int) i, cast(n - j as int) j, h from s0 join p using (id))"


def matrix_sql(source: str, keys: str) -> str:
    return f"{matrix_cte(source)} select {keys}, i, j, h from f join p using (id)"


def suffix_sql(source: str, keys: str) -> str:
    return f"{both_cte(source)} select {keys}, i, j, h from s join p using (id)"


_PATH = """, o as materialized (select id, h opt from f join p using (id) where i = m and j = n),
e as materialized (select f.id, f.j, min(f.i) i from f join s using (id, i, j) join o using (id) where f.h + s.h = opt group by f.id, f.j)"""


def path_sql(source: str, keys: str) -> str:
    return f"{both_cte(source)}{_PATH} select {keys}, opt score, e.j ref_idx, e.i query_idx from e join o using (id) join p using (id) where e.j < n"


def split_sql(source: str, keys: str) -> str:
    return f"{both_cte(source)}{_PATH} select {keys}, opt score, e.i split from e join o using (id) join p using (id) where e.j = n // 2"


def check_path_sql(source: str, keys: str) -> str:
    return f"""{both_cte(source)}{_PATH}
select {keys}, true valid, cast(n as int) point_count, opt score, cast(null as varchar) error from p join o using (id)"""


ANCHORS = """a as (select user_id chain_id, event_id idx, event_id x, 10 * try_cast(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') as bigint) + cast(trunc(value) as bigint) y from events)"""
_COST = "cast(trunc(cast(0.01 as float) * cast(15 as float) * cast(abs({dy} - {dx}) as float)) as bigint)"


def chain_cte(lookback: int, name: str = "c") -> str:
    dx, dy = "xs[i + 1] - xs[j]", "ys[i + 1] - ys[j]"
    step = f"case when {dx} > 0 and {dy} > 0 then f[j] + least({dx}, {dy}, 15) - {_COST.format(dx=f'({dx})', dy=f'({dy})')} else 15 end"
    return f"""g{name} as materialized (select chain_id, list(idx order by idx) ids, list(x order by idx) xs, list(y order by idx) ys from a group by chain_id),
{name}(chain_id, i, f) as (select chain_id, 0, cast([] as bigint[]) from g{name}
  union all select chain_id, i + 1, list_append(f, greatest(15, coalesce(list_max(list_transform(range(greatest(1, i - {lookback} + 1), i + 1), lambda j: {step})), 15)))
  from {name} join g{name} using (chain_id) where i < len(xs)),
{name}s as (select chain_id, unnest(ids) idx, unnest(xs) x, unnest(ys) y, unnest(f) score from {name} join g{name} using (chain_id) where i = len(xs))"""


def chain_sql(lookback: int) -> str:
    return f"with recursive {ANCHORS}, {chain_cte(lookback)} select chain_id, idx, x, y, cast(score as int) score from cs"


def one_chain_sql(lookback: int) -> str:
    """All events as one chain: the recursion carries the last scores only, and each step is a row."""
    dx, dy = "xs[i + 1] - xs[j]", "ys[i + 1] - ys[j]"
    step = f"case when {dx} > 0 and {dy} > 0 then f[len(f) - (i - j)] + least({dx}, {dy}, 15) - {_COST.format(dx=f'({dx})', dy=f'({dy})')} else 15 end"
    new = f"greatest(15, coalesce(list_max(list_transform(range(greatest(1, i - {lookback} + 1), i + 1), lambda j: {step})), 15))"
    return f"""with recursive {ANCHORS},
g as materialized (select list(x order by idx) xs, list(y order by idx) ys from a),
c(i, f) as (select 0, cast([] as bigint[]) union all select i + 1, list_append(case when len(f) >= {lookback} then f[2:] else f end, {new}) from c, g where i < len(xs)),
n as (select *, row_number() over (order by idx) i from a)
select 0 chain_id, idx, x, y, f[-1] score from c join n using (i)"""


def edges_sql(lookback: int) -> str:
    return f"""with {ANCHORS}, n as (select *, row_number() over (partition by chain_id order by idx) k from a)
select b.chain_id, b.idx, c.idx prev, cast(least(b.x - c.x, b.y - c.y, 15) as int) gain, cast({_COST.format(dx='(b.x - c.x)', dy='(b.y - c.y)')} as int) cost
from n b join n c on b.chain_id = c.chain_id and c.k between b.k - {lookback} and b.k - 1 and b.x > c.x and b.y > c.y"""


def alignment_sql(source: str, keys: str) -> str:
    """Traced from the end, with ties diagonal, up, left."""
    same = "p.q[t.i] = p.r[t.j]"
    diagonal = f"t.i > 0 and t.j > 0 and t.h = d.h + case when {same} then 1 else -1 end"
    up = "t.i > 0 and (t.j = 0 or t.h = u.h - 1)"
    step = f"case when {diagonal} then case when {same} then '=' else 'X' end when {up} then 'I' else 'D' end"
    return f"""{matrix_cte(source)},
t(id, i, j, h, steps) as (select f.id, i, j, h, '' from f join p using (id) where i = m and j = n
  union all select id, i, j, f.h, steps from (
    select t.id, t.i - case when step = 'D' then 0 else 1 end i, t.j - case when step = 'I' then 0 else 1 end j, step || t.steps steps from (
      select t.*, {step} step from t join p using (id) left join f d on d.id = t.id and d.i = t.i - 1 and d.j = t.j - 1 left join f u on u.id = t.id and u.i = t.i - 1 and u.j = t.j
      where t.i > 0 or t.j > 0) t) join f using (id, i, j))
select {keys}, o.h score, t.steps from t join p using (id) join f o on o.id = p.id and o.i = m and o.j = n where t.i = 0 and t.j = 0"""


#: Checkpoints that are changed, by key: none, every second one left out, one out of range, one moved down, all turned around.
CHANGED = """case p_partkey % 5 when 0 then i when 1 then case when j % 2 = 1 then -1 else i end when 2 then case when j = n // 2 then m + 3 else i end
  when 3 then case when j = n // 2 then i + 1 else i end else turned end"""


def changed_paths_sql(source: str, where: str = "true") -> str:
    """The rules on changed paths; paths of which every second point is left out are right, all others have a point in each column."""
    seg = "case when j = 0 then -i when i = prev then -1 when list_contains(q[prev + 1:i], r[j]) then 2 - (i - prev) else -(i - prev) end"
    return f"""{both_cte(source)}{_PATH},
x as materialized (select id, p_partkey, j, n, m, q, r, opt, cast({CHANGED} as int) i from (
  select e.*, p_partkey, n, m, q, r, opt,
    y.i turned from e join p using (id) join o using (id) join e y on y.id = e.id and y.j = n - 1 - e.j where e.j < n)),
y as (select *, coalesce(lag(i) over (partition by id order by j), 0) prev from x where p_partkey % 5 <> 1),
z as (select *, {seg} seg from y),
c as materialized (select z.*, sum(seg) over (partition by id order by j) traced, i < 0 or i > m or i < prev bad_a, f.h + s.h <> opt bad_b, f.h fh from z left join f using (id, i, j) left join s using (id, i, j)),
g as materialized (select *, case when bad_a then 0 when bad_b then 1 when traced <> fh then 2 end err from c),
b as (select id, min(j) j from g where err is not null group by id),
k as (select g.id, g.j, g.i, g.err, cast(coalesce(g.traced, 0) - case when g.err = 2 then 0 else g.seg end as int) score from b join g using (id, j))
select * from (select p_partkey, k.id is null valid, cast(coalesce(k.j, -1) as int) bad_ref, cast(coalesce(k.i, -1) as int) bad_query,
  cast(case when k.id is not null then k.j when p_partkey % 5 = 1 then (n + 1) // 2 else n end as int) point_count, coalesce(k.score, opt) score,
  ['checkpoint is out of range or not monotonic', 'checkpoint is not on an optimal full-matrix path', 'checkpoint chain does not trace through the dp matrix'][k.err + 1] error, opt expected
from p join o using (id) left join k using (id)) where {where}"""
