"""The same results in SQL, written without the library's shortcuts: plain
windows, and slots as one fraction instead of cells and shifted offsets."""

from __future__ import annotations

from murmuration.catalog.queries import COARSE, LIMIT, LOOP_VARIANCE, NODE, OFFSET, SEED, SHIFT, SPREAD, TARGET
from murmuration.functions.model import ESS_FRACTION, INITIAL_VARIANCE, PROCESS_VARIANCE
from murmuration.functions.slots import WEIGHT_BITS, offset_bits
from murmuration.plans.filter import OFFSET_KEY, ROUNDING_KEY

U32 = offset_bits(OFFSET)
N_STEPS = 5

EVENTS = "(select event_id as id, value as x, user_id from events)"
PARTICLES = "(select event_id + 1 as id, value as x, user_id from events)"
ORDERS = "(select o_orderkey as id, o_totalprice as v from orders)"
CENTS = f"(select id, user_id, cast(floor(x * 100 + 0.5e0) as bigint) as wq from {EVENTS})"


def _hash_key(step: int, *keys: str) -> str:
    texts = [f"cast({k} as varchar)" for k in keys]
    parts = [f"case when {t} is null then 'null' else concat(length({t}), '=', {t}) end" for t in texts]
    return f"concat_ws(':', '{SEED}', '{step}', {', '.join(parts)})"


def _hex(key: str, start: int, length: int) -> str:
    return f"cast('0x' || substr(md5({key}), {start}, {length}) as bigint)"


def _bits(step: int, *keys: str) -> str:
    return _hex(_hash_key(step, *keys), 1, 8)


def _gauss(step: int, *keys: str) -> str:
    key = _hash_key(step, *keys)
    u1 = f"cast({_hex(key, 1, 12)} + 1 as double) / 281474976710657e0"
    u2 = f"cast({_hex(key, 13, 12)} as double) / 281474976710656e0"
    return f"sqrt(-2e0 * ln({u1})) * cos(2e0 * pi() * ({u2}))"


def _move(step: int, *keys: str) -> str:
    return (
        f"5e-1 * x + 25e0 * x / (1e0 + x * x) + 8e0 * cos(12e-1 * ({step} - 1))"
        f" + sqrt({PROCESS_VARIANCE}::double) * ({_gauss(step, *keys)})"
    )


def _log_density(z: str, expected: str, variance: float) -> str:
    return (
        f"(-ln(sqrt(2e0 * pi() * {variance}::double))"
        f" - ({z} - {expected}) * ({z} - {expected}) / (2e0 * {variance}::double))"
    )


LW = _log_density(f"{TARGET}::double", "x", SPREAD)
LOGS = f"(select id, user_id, x, {LW} as lw from {EVENTS})"


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0e0 as {name}"


def _slot(cumulative: str, total: str, n: str, bits: str) -> str:
    return (
        f"cast((({cumulative})::hugeint * {n}::hugeint * 4294967296::hugeint"
        f" + ({bits})::hugeint * ({total})::hugeint)"
        f" // (({total})::hugeint * 4294967296::hugeint) as bigint)"
    )


def _copies(source: str, bits: str, group: str = "") -> str:
    """id, (group,) slot_lo, slot_hi of integer weights wq."""
    over = f"partition by {group}" if group else ""
    keys = f"{group}, " if group else ""
    return f"""
      select {keys}id, wq, {_slot('c - wq', 'w', 'n', bits)} as slot_lo, {_slot('c', 'w', 'n', bits)} as slot_hi
      from (select {keys}id, wq,
                   sum(wq::hugeint) over ({over} order by id rows unbounded preceding) as c,
                   sum(wq::hugeint) over ({over}) as w,
                   count(*) over ({over}) as n
            from {source})"""


def _observations(group: str = "") -> str:
    keys = f"{group}, " if group else ""
    return f"""
      select {keys}cast(dense_rank() over (order by event_type) as integer) as step,
             (cast(sum(cast(floor(value * 100 + 0.5e0) as bigint)) as bigint) % 2000) / 100e0 as z
      from events group by {keys}event_type"""


def _loop(
    steps: list[tuple[int, str]],
    first: str,
    variance: float,
    group: str = "",
    carry: bool = False,
    offset: str = "",
    keyed: bool = False,
) -> list[str]:
    """CTEs p{step} (id, x, b) and r{step} (ess, resampled, ..), one block per
    step; ``steps`` pairs a step with the SQL of its observation; ``b`` is the
    log-weight carried over."""
    keys = f"{group}, " if group else ""
    over = f"partition by {group}" if group else ""
    id_keys = [group, "id"] if group else ["id"]
    offset_keys = [f"'{OFFSET_KEY}'", group] if group else [f"'{OFFSET_KEY}'"]
    kept = "case when resampled then 0e0 else fall end" if carry else "0e0"

    def bits(step: int) -> str:
        return offset or _bits(step, *offset_keys)

    def up(step: int) -> str:
        keys_of_draw = [f"'{ROUNDING_KEY}'", *id_keys]
        return f"{_bits(step, *keys_of_draw)} / 4294967296e0" if keyed else "5e-1"

    ctes = [f"p0 as materialized (select *, 0e0 as b from ({first}))"]
    for i, (step, observed) in enumerate(steps, start=1):
        seen = f"(select * from obs where step = {step})"
        source = f"p{i - 1} left join {seen} o using ({group})" if group else f"p{i - 1}"
        z = "o.z" if group else observed
        density = f"case when z is null then 0e0 else {_log_density('z', 'x * x / 20e0', variance)} end"
        moved_keys = [f"p{i - 1}.id" if k == "id" else k for k in id_keys]
        ctes += [
            f"m{i} as materialized (select {keys}id, {_move(step, *moved_keys)} as x, {z} as z, b from {source})",
            f"l{i} as materialized (select *, {density} + b as lw from m{i})",
            f"k{i} as materialized (select *, lw - max(lw) over ({over}) as fall from l{i})",
            f"w{i} as materialized (select *, cast(floor(exp(fall) * (2::double ** {WEIGHT_BITS}) + {up(step)}) as bigint) as wq from k{i})",
            f"""c{i} as materialized (select *, sum(wq::hugeint) over ({over} order by id rows unbounded preceding) as c,
                 sum(wq::hugeint) over ({over}) as w,
                 sum(wq::hugeint * wq::hugeint) over ({over}) as s2,
                 count(*) over ({over}) as n from w{i})""",
            f"e{i} as materialized (select *, w::double * w::double / s2::double as ess from c{i})",
            f"""r{i} as materialized (select *, ess <= {ESS_FRACTION}::double * n as resampled,
                 case when ess <= {ESS_FRACTION}::double * n then {_slot('c - wq', 'w', 'n', bits(step))} else id - 1 end as lo,
                 case when ess <= {ESS_FRACTION}::double * n then {_slot('c', 'w', 'n', bits(step))} else id end as hi
               from e{i})""",
            f"p{i} as materialized (select {keys}unnest(generate_series(lo + 1, hi)) as id, x, {kept} as b from r{i} where hi > lo)",
        ]
    return ctes


def _with(ctes: list[str], final: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + final


def _prior(group: str = "") -> str:
    keys = f"{group}, " if group else ""
    over = f"partition by {group} " if group else ""
    id_keys = [group, "id"] if group else ["id"]
    return f"""select {keys}id, x + sqrt({INITIAL_VARIANCE}::double) * ({_gauss(0, *id_keys)}) as x
      from (select {keys}row_number() over ({over}order by event_id) as id, value as x from events)"""


def _filter_ctes(group: str = "", **settings) -> list[str]:
    steps = [(t, f"(select z from obs where step = {t})") for t in range(1, N_STEPS + 1)]
    loop = _loop(steps, _prior(group), LOOP_VARIANCE, group, **settings)
    return [f"obs as materialized ({_observations(group)})"] + loop


def _reports(group: str = "", weighted: bool = False) -> str:
    keys = f"{group}, " if group else ""
    by = f"group by {group}" if group else ""
    blocks = []
    for t in range(1, N_STEPS + 1):
        facts = f"select {keys}max(z) as z, max(ess) as ess, bool_or(resampled) as resampled from r{t} {by}"
        means = f"select {keys}avg(x) as estimate from p{t} {by}"
        if weighted:
            means = f"select {keys}sum(wq::double * x) / sum(wq::double) as estimate from c{t} {by}"
        join = f"join ({means}) using ({group})" if group else f", ({means})"
        blocks.append(
            f"select {keys}cast({t} as integer) as step, {_r('z', 'z')}, {_r('ess', 'ess')}, resampled,"
            f" {_r('estimate', 'estimate')} from ({facts}) {join}"
        )
    return "\nunion all ".join(blocks)


NOISY = """(select event_id + 1 as id, event_type,
    case when (event_id + 1) % 7 <> 0 then cast(user_id as varchar) end as k from events)"""
SPOILT = f"""(select id, user_id, case when id % 5 = 0 or user_id % 3 = 0 or (user_id % 3 = 1 and id % 2 = 0)
    then '-infinity'::double else lw end as lw from {LOGS})"""
PRIOR = f"x + sqrt({INITIAL_VARIANCE}::double) * ({_gauss(0, 'id')})"
NODE_OF = f"(id + {NODE} - 1) // {NODE}"
UNION = f"select id, x from {EVENTS} union all select id, v as x from {ORDERS}"

ORACLE: dict[str, str] = {
    "scan_keyvalue_text": f"select id, x from {EVENTS}",
    "sink_keyvalue_text": f"select cast(id as varchar) || ',' || cast(x as varchar) as line from {EVENTS}",
    "merge_sources": f"select 'events' as source, id, x as v from {EVENTS} union all select 'orders' as source, id, v from {ORDERS}",
    "id_range_source": "select unnest(generate_series(1, (select count(*) from lineitem))) as id",
    "step_report": _with(_filter_ctes(), _reports()),
    "materialize_step": f"select id, {_r(_move(1, 'id'), 'x')} from {PARTICLES}",
    "rebalance": UNION,
    "init_particles": f"select id, {_r(PRIOR, 'x')} from {PARTICLES}",
    "propagate_state": f"select id, {_r(_move(2, 'id'), 'x')} from {PARTICLES}",
    "measurement": f"select id, {_r('x * x / 20e0', 'h')} from {EVENTS}",
    "log_weight": f"select id, {_r('lw', 'lw')} from {LOGS}",
    "linear_weight": f"select id, {_r('exp(lw)', 'w')} from {LOGS}",
    "quantize_offset": f"select id, slot_hi as slot from ({_copies(CENTS, str(U32))})",
    "node_bucket": f"select id, cast(ceil(id / {NODE}e0) as bigint) as node from {PARTICLES}",
    "clamp_counts": f"select id, least(wq, {LIMIT}) as low, greatest(wq, {LIMIT}) as high from {CENTS}",
    "keyed_noise": f"select id, {_r(_bits(3, 'id') + ' / 4294967296e0', 'u')}, {_r(_gauss(3, 'id'), 'g')} from {PARTICLES}",
    "keyed_noise_by_group": f"""select id, {_r(_bits(3, 'event_type', 'k', 'id') + ' / 4294967296e0', 'u')},
        {_r(_gauss(3, 'event_type', 'k', 'id'), 'g')} from {NOISY}""",
    "half_filter": f"select id, x, case when (id - 1) % {NODE} < {NODE // 2} then 'lower' else 'upper' end as half from {PARTICLES}",
    "threshold_flag": f"select id, cast(wq > {LIMIT} as integer) as flag from {CENTS}",
    "negate_flag": f"select id, cast(wq > {LIMIT} as integer) as flag, cast(wq <= {LIMIT} as integer) as negated from {CENTS}",
    "rekey": f"select id + {NODE_OF} as id, x from {PARTICLES}",
    "drop_sentinel": f"select id, x, v from {ORDERS} join {EVENTS} using (id) where x is not null",
    "tag_and_pair": f"select {NODE_OF} as key, id as member, x as state from {PARTICLES}",
    "range_expand": f"""select unnest(generate_series(node * {NODE} - {NODE - 1}, node * {NODE})) as id, node, total
        from (select event_id // {NODE} + 1 as node, cast(sum(cast(floor(value * 100 + 0.5e0) as bigint)) as bigint) as total
              from events group by 1)""",
    "range_expand_overlapping": "select event_id as src, unnest(generate_series(1, event_id % 3 + 1)) as id from events",
    "join_on_id": f"select id, x, v from {EVENTS} join {ORDERS} using (id)",
    "join_scalar": f"select id, x, (select max(value) from events) as max_x from {EVENTS}",
    "join_node_value": f"select id, user_id, wq, cast(sum(wq) over (partition by user_id) as bigint) as total from {CENTS}",
    "merge_by_max": f"""select id, case when a.x is null then b.x when b.x is null then a.x when a.x > b.x then a.x else b.x end as x
        from {EVENTS} a full outer join (select id + {LIMIT} as id, x from {EVENTS}) b using (id)""",
    "gather_by_index": f"""select a.id, b.x as gathered from {PARTICLES} a left join {PARTICLES} b
        on b.id = ({SHIFT} + a.id - 1) % {NODE} + 1 + ((a.id - 1) // {NODE}) * {NODE}""",
    "elementwise_combine": f"""select id, {_r('x * v', 'product')}, {_r('x + v', 'total')}, {_r('abs(x - v)', 'abs_diff')}
        from {EVENTS} join {ORDERS} using (id)""",
    "max_weight": f"select {_r('max(lw)', 'max_w')} from {LOGS}",
    "tree_sum": f"select cast(sum(wq) as bigint) as total from {CENTS}",
    "tree_sum_by_node": f"select user_id, cast(sum(wq) as bigint) as total from {CENTS} group by user_id",
    "log_sum_exp": f"select {_r('ln(sum(exp(lw)))', 'log_total')} from {LOGS}",
    "log_sum_exp_by_group": f"select user_id, {_r('ln(sum(exp(lw)))', 'log_total')} from {LOGS} group by user_id",
    "normalize_weights": f"select id, {_r('lw - ln(sum(exp(lw)) over ())', 'lw')} from {LOGS}",
    "normalize_weights_by_group": f"select id, user_id, {_r('lw - ln(sum(exp(lw)) over (partition by user_id))', 'lw')} from {LOGS}",
    "normalize_weights_degenerate": f"""
        with p as (select *, max(lw) over (partition by user_id) as peak, count(*) over (partition by user_id) as n from {SPOILT})
        select id, user_id, {_r("case when peak = '-infinity'::double then 1e0 / n else exp(lw - peak)"
                                " / sum(case when peak > '-infinity'::double then exp(lw - peak) end) over (partition by user_id) end", 'w')}
        from p""",
    "effective_sample_size": f"select {_r('sum(exp(lw)) * sum(exp(lw)) / sum(exp(2e0 * lw))', 'ess')} from {LOGS}",
    "effective_sample_size_by_group": f"select user_id, {_r('sum(exp(lw)) * sum(exp(lw)) / sum(exp(2e0 * lw))', 'ess')} from {LOGS} group by user_id",
    "weighted_mean": f"select user_id, {_r('sum(exp(s) * x) / sum(exp(s))', 'estimate')}"
    f" from (select *, lw - max(lw) over (partition by user_id) as s from {LOGS}) group by user_id",
    "tree_sum_reproducible": f"""select user_id, {_r("sum(case when id % 10 = 0 then x * pow(2.0, -60) else x end)", "total")}
        from {EVENTS} group by user_id""",
    "weighted_mean_reproducible": f"select user_id, {_r('sum(exp(s) * x) / sum(exp(s))', 'estimate')}"
    f" from (select *, lw - max(lw) over (partition by user_id) as s from {LOGS}) group by user_id",
    "posterior_mean_reproducible": f"select {_r('avg(x)', 'estimate')} from {EVENTS}",
    "posterior_mean": f"select {_r('avg(x)', 'estimate')} from {EVENTS}",
    "group_max_key": f"select {NODE_OF} as node, max(id) as max_id, max(id) - {NODE} as before_first from {PARTICLES} group by 1",
    "count_rows": "select count(*) as n_rows from lineitem",
    "conditional_count": f"""select user_id, count(*) filter (where wq <= {LIMIT}) as n_left,
        count(*) filter (where wq > {LIMIT}) as n_right from {CENTS} group by user_id""",
    "prefix_sum": f"select id, wq, cast(sum(wq) over (order by id) as bigint) as prefix from {CENTS}",
    "segmented_prefix_sum": f"select id, user_id, wq, cast(sum(wq) over (partition by user_id order by id) as bigint) as prefix from {CENTS}",
    "exclusive_prefix": f"select id, wq, cast(sum(wq) over (order by id) as bigint) - wq as before from {CENTS}",
    "adjacent_difference": f"select id, wq, wq - lag(wq, 1, 0) over (order by id) as diff from {CENTS}",
    "adjacent_difference_by_group": f"select id, user_id, wq, wq - lag(wq, 1, 0) over (partition by user_id order by id) as diff from {CENTS}",
    "sort_by_copies": f"""select id, n_copies, row_number() over (order by n_copies desc, id) as position
        from (select id, slot_hi - slot_lo as n_copies from ({_copies(CENTS, str(U32))}))""",
    "union_all": UNION,
    "systematic_copies": f"select id, slot_lo, slot_hi, slot_hi - slot_lo as n_copies from ({_copies(CENTS, str(U32))})",
    "systematic_copies_by_group": f"""select user_id, id, slot_lo, slot_hi, slot_hi - slot_lo as n_copies
        from ({_copies(CENTS, _bits(1, 'user_id'), 'user_id')})""",
    "systematic_copies_lineitem": f"""select id, wq, slot_hi - slot_lo as n_copies from ({_copies(
        "(select l_orderkey as id, cast(sum(cast(floor(l_extendedprice * 100 + 0.5e0) as bigint)) as bigint) as wq from lineitem group by 1)",
        str(U32))})""",
    "replicate_by_count": f"select id as src, unnest(generate_series(slot_lo + 1, slot_hi)) as id from ({_copies(CENTS, str(U32))}) where slot_hi > slot_lo",
    "replicate_balanced": f"""select id as src, unnest(generate_series(slot_lo + 1, slot_hi)) as id
        from ({_copies(f'(select id, wq * wq * wq as wq from {CENTS})', str(U32))}) where slot_hi > slot_lo""",
    "resample": f"""select s.id as src, unnest(generate_series(slot_lo + 1, slot_hi)) as id, x
        from ({_copies(CENTS, str(U32))}) s join {EVENTS} e on e.id = s.id where slot_hi > slot_lo""",
    "resample_if_needed": f"""
        with w as (select user_id, id, x, cast(floor(exp(lw - max(lw) over (partition by user_id)) * (2::double ** {WEIGHT_BITS}) + 5e-1) as bigint) as wq from {LOGS}),
        s as ({_copies('w', _bits(1, 'user_id'), 'user_id')}),
        f as (select user_id, sum(wq::double) * sum(wq::double) / sum(wq::double * wq::double) as ess, count(*) as n from w group by user_id),
        r as (select w.user_id, w.id as src, x, ess, ess <= 65e-2 * n as resampled, slot_lo, slot_hi,
                     row_number() over (partition by w.user_id order by w.id) as place
              from w join s on w.user_id = s.user_id and w.id = s.id join f on f.user_id = w.user_id)
        select user_id, src, unnest(generate_series(case when resampled then slot_lo + 1 else place end,
                                                    case when resampled then slot_hi else place end)) as id,
               x, {_r('ess', 'ess')}, resampled
        from r where not resampled or slot_hi > slot_lo""",
    "filter_step": _with(
        _loop([(1, "125e-1")], f"select id, x from {PARTICLES}", LOOP_VARIANCE), f"select id, {_r('x', 'x')} from p1"
    ),
    "run_filter": _with(_filter_ctes(), f"select id, {_r('x', 'x')} from p{N_STEPS}"),
    "run_filter_grouped": _with(_filter_ctes("user_id"), f"select user_id, id, {_r('x', 'x')} from p{N_STEPS}"),
    "step_report_grouped": _with(_filter_ctes("user_id"), _reports("user_id")),
    "step_report_weighted": _with(_filter_ctes(), _reports(weighted=True)),
    "step_report_carried": _with(_filter_ctes(carry=True), _reports(weighted=True)),
    "step_report_carried_grouped": _with(_filter_ctes("user_id", carry=True), _reports("user_id", weighted=True)),
    "step_report_offset": _with(_filter_ctes(offset=str(U32), keyed=True), _reports()),
    "run_filter_resumed": _with(_filter_ctes(), f"select id, {_r('x', 'x')} from p{N_STEPS}"),
    "step_report_resumed": _with(_filter_ctes(), _reports()),
    "step_report_resumed_grouped": _with(_filter_ctes("user_id"), _reports("user_id")),
    "weight_totals": f"""select user_id, {_r('ln(sum(exp(lw)))', 'log_total')},
        {_r('sum(exp(lw)) * sum(exp(lw)) / sum(exp(2e0 * lw))', 'ess')}, count(*) as rows from {LOGS} group by user_id""",
    "systematic_copies_rounded": f"""with w as (select id, cast(floor(exp(lw - max(lw) over ()) * {2**COARSE}e0
            + {_bits(4, 'id')} / 4294967296e0) as bigint) as wq from {LOGS})
        select id, wq, slot_hi - slot_lo as n_copies from ({_copies('w', str(U32))})""",
}
