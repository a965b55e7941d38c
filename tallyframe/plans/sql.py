"""Building blocks of the comparison SQL (DuckDB). Kept apart from the operators they check."""

from __future__ import annotations

RANGE = "281474976710656"  # 2^48
RESPONSES = "select *, l_partkey as qid, l_suppkey as uid, l_quantity as human_score from lineitem"
COVERAGE = """count(distinct qid) as n_qid, count(distinct uid) as n_uid,
  count(distinct (qid, uid))::double / nullif(count(distinct qid), 0) as avg_workers_per_qid,
  count(distinct (qid, uid))::double / nullif(count(distinct uid), 0) as avg_qids_per_uid,
  count(*) as n_obs"""


def h(seed: object, *cols: str) -> str:
    """Hash of a key; columns are SQL expressions."""
    parts = ", ".join(f"cast({c} as varchar)" for c in cols)
    return f"cast('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 12) as bigint)"


def u(seed: object, *cols: str) -> str:
    return f"({h(seed, *cols)}::double / {RANGE}::double)"


def normal(seed: object, *cols: str) -> str:
    low = f"greatest({u(f'{seed}a', *cols)}, 1.0::double / {RANGE}::double)"
    return f"(sqrt(-2.0::double * ln({low})) * cos(2.0::double * pi() * {u(f'{seed}b', *cols)}))"


def ranks(source: str, key: str, seed: object) -> str:
    """Rank and number of the distinct keys."""
    return (
        f"select {key}, row_number() over (order by hh, {key}) as rk, count(*) over () as n "
        f"from (select distinct {key}, {h(seed, key)} as hh from {source})"
    )


def clamp(value: str, lo: object, hi: object) -> str:
    return f"least(greatest({value}, {lo}), {hi})"


def linspace(a: str, b: str, n: str, i: str) -> str:
    return f"case when {i} = {n} - 1 and {n} > 1 then {b} when {n} = 1 then {a} else {a} + {i} * (({b} - {a}) / ({n} - 1)) end"


def safe_ratio_ctes(target: str, holder: str, m: int, source: str = "r", trials: int = 20, points: int = 50) -> str:
    """CTE ``safe(safe_ratio, required_k, total, feasible)``."""
    return f"""
    p as (select distinct {target} as t, {holder} as o from {source}),
    d as (select trial, t, o, {h(42, 'trial', 't')} as hh from p, (select unnest(range(1, {trials + 1})) as trial)),
    mth as (select trial, o, hh, row_number() over (partition by trial, o order by hh, t) as rn from d),
    reach as (select trial, max(hh) as reach, count(*) as no from mth where rn = {m} group by trial),
    tg as (select trial, count(*) as total, count(*) filter (where hh <= reach) as rk, max(coalesce(no, 0)) as no
           from (select distinct trial, t, hh from d) left join reach using (trial) group by trial),
    need as (select max(total) as total, max(rk) as required_k,
                    min(no) = (select count(distinct o) from p) as feasible from tg),
    grid as (select i, {linspace('1.0::double', '0.1::double', str(points), 'i')} as ratio
             from (select unnest(range(0, {points})) as i)),
    judged as (select coalesce(min(case when not feasible or greatest(floor(total * ratio)::bigint, {m}) < required_k
                                   then i end), {points}) - 1 as good from need, grid),
    safe as (select case when good < 0 then 1.0::double else (select ratio from grid where i = good) end as safe_ratio,
                    case when feasible then required_k end as required_k, total, feasible from judged, need)"""


def layer(name: str, inputs: int, units: int) -> str:
    """Untrained weights of a layer as (unit, w, b)."""
    bound = f"(1.0::double / sqrt({inputs}::double))"
    w = f"({u(42, repr(name), 'unit', 'j')} * 2 - 1) * {bound}"
    b = f"({u(42, repr(name), 'unit', repr('b'))} * 2 - 1) * {bound}"
    return (
        f"select unit, list({w} order by j) as w, {b} as b from (select unnest(range({units})) as unit), "
        f"(select unnest(range({inputs})) as j) group by unit"
    )


def network_ctes(features: int, contexts: int, latent: int, hidden: int = 400, blend: int = 10) -> str:
    sizes = {
        "fc1": (features + contexts, hidden), "fc21": (hidden, latent), "fc22": (hidden, latent),
        "fc": (latent + contexts, latent), "fcc": (latent, blend), "gc1": (blend, 1),
    }
    return ",\n".join(f"{n} as ({layer(n, *s)})" for n, s in sizes.items())


def dense(layer_name: str, source: str, keys: str, vector: str, out: str, elu: bool = False) -> str:
    """Layer applied to a list column."""
    value = f"list_dot_product(w, {vector}) + b"
    if elu:
        value = f"case when {value} > 0 then {value} else exp({value}) - 1 end"
    return f"select {keys}, list({value} order by unit) as {out} from {source}, {layer_name} group by {keys}"
