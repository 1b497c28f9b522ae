"""SQL of the executor and the validator, written from their rules over lists and joins; for checks only."""

from __future__ import annotations

KEYWORD = r"(^|[^\p{L}\p{M}\p{N}_])(%s)([^\p{L}\p{M}\p{N}_]|$)"
THRESHOLD = KEYWORD % "while|under|at least|at most|below|above|exceed|exceeds|less than|greater than|no more than|no less than|of at least|of at most"
TRADEOFF = KEYWORD % "pareto|trade-?off|optimal|optimize|optimise|maxim|minim"
TOTAL = KEYWORD % "total|subtotal|aggregate"


def number(cell: str) -> str:
    """The number in a cell."""
    bare = rf"regexp_replace(regexp_replace({cell}, '[$%]', '', 'g'), '^\s+|\s+$|,', '', 'g')"
    return rf"try_cast(nullif(regexp_extract(regexp_replace(regexp_replace({bare}, '^\(\s*(.*?)\s*\)$', '-\1'), '^--', ''), '^-?[0-9]+(\.[0-9]+)?$'), '') as double)"


def fires(kind: str, question: str) -> str:
    """Whether the gate rejects an operation of a type for a question."""
    return f"""case when {kind} in ('best_under_constraint', 'threshold_filter') then not regexp_matches(lower(coalesce({question}, '')), '{THRESHOLD}')
        when {kind} = 'tradeoff_summary' then not regexp_matches(lower(coalesce({question}, '')), '{TRADEOFF}') else true end"""


def entity_rows(rows: str) -> str:
    return f"list_filter(range(len({rows})), lambda i: not regexp_matches(lower(coalesce({rows}[i + 1][1], '')), '{TOTAL}'))"


_NUMS = f"list_transform(rw, lambda r: list_transform(r, lambda c: {number('c')}))"
_LOST = "not coalesce(list_contains(h, {}), false)"
_ERROR = f"""case when s.type = 'best_under_constraint' then case when {_LOST.format('s.target')} or {_LOST.format('s."constraint"')} then 'column' when coalesce(s.op, '') not in ('lt', 'gte', 'ge') then 'comparison'
            when coalesce(s.target_dir, '') not in ('higher', 'lower') then 'direction' when s.threshold is null then 'threshold' end
        when s.type = 'threshold_filter' then case when s.conditions is null then 'conditions' when len(list_filter(s.conditions, lambda c: {_LOST.format('c.metric')})) > 0 then 'column'
            when len(list_filter(s.conditions, lambda c: coalesce(c.op, '') not in ('lt', 'gte', 'ge'))) > 0 then 'comparison' when len(list_filter(s.conditions, lambda c: c.t is null)) > 0 then 'threshold' end
        when s.type = 'tradeoff_summary' then case when {_LOST.format('s.m1')} or {_LOST.format('s.m2')} then 'column' when coalesce(s.d1, '') not in ('higher', 'lower') or coalesce(s.d2, '') not in ('higher', 'lower') then 'direction' end
        when s.type = 'extremum' then case when {_LOST.format('s.target')} then 'column' when coalesce(s.target_dir, '') not in ('higher', 'lower') then 'direction' end
        else 'type' end"""
_WHOLE = 'case when s."rows" is null then range(len(rw)) else list_filter(s."rows", lambda i: i >= 0 and i < len(rw)) end'


def executed(source: str) -> str:
    """CTEs over ``source`` (``id``, ``h`` headers, ``rw`` rows, ``rl`` row labels, ``s`` operation) that end in ``x`` with ``ans``, ``label``, ``error`` and ``ev``, a row for each cell read."""
    return f"""b as (select id, h, coalesce(rw, []) as rw, rl, s, {_NUMS.replace('rw', 'coalesce(rw, [])', 1)} as nums, {_ERROR} as error from {source}),
    l as (select id, s, h, nums, unnest(range(len(rw))) as i from b where error is null),
    m as (select id, i, s, nums[i + 1][list_position(h, coalesce(s.target, s.m1))] as v1, nums[i + 1][list_position(h, coalesce(s."constraint", s.m2))] as v2,
        list_transform(coalesce(s.conditions, []), lambda c: coalesce(case when c.op = 'lt' then nums[i + 1][list_position(h, c.metric)] < c.t else nums[i + 1][list_position(h, c.metric)] >= c.t end, false)) as ok
        from l where s."rows" is null or list_contains(s."rows", i)),
    f as (select id, i, s.type as type, case when coalesce(s.d1, s.target_dir) = 'lower' then -v1 else v1 end as o1, case when s.d2 = 'lower' then -v2 else v2 end as o2 from m
        where case s.type when 'best_under_constraint' then v1 is not null and coalesce(case when s.op = 'lt' then v2 < s.threshold else v2 >= s.threshold end, false)
            when 'extremum' then v1 is not null when 'threshold_filter' then len(list_filter(ok, lambda x: not x)) = 0 else v1 is not null and v2 is not null end),
    w as (select id, i from (select *, max(o1) over (partition by id) as best from f where type in ('best_under_constraint', 'extremum')) where abs(o1 - best) <= 1e-9
        union all select id, i from f where type = 'threshold_filter'
        union all select id, i from f where type = 'tradeoff_summary' and not exists (select 1 from f g where g.id = f.id and g.o1 >= f.o1 - 1e-9 and g.o2 >= f.o2 - 1e-9 and (g.o1 > f.o1 + 1e-9 or g.o2 > f.o2 + 1e-9))),
    won as (select id, list(i order by i) as ans from w group by 1),
    y as (select b.*, coalesce(ans, []) as ans from b left join won using (id)),
    x as (select *, case when error is not null then null when s.type = 'tradeoff_summary' then concat(s.m1, ' vs ', s.m2) when len(ans) = 0 then 'none'
            else array_to_string(list_transform(ans, lambda i: coalesce(case when len(rl) > 0 then rl[i + 1] else rw[i + 1][1] end, '')), ', ') end as label,
        case when error is not null then [] when len(ans) = 0 and s.type <> 'tradeoff_summary' then {_WHOLE} else ans end as read,
        case s.type when 'best_under_constraint' then case when len(ans) = 0 then [s."constraint"] else [s.target, s."constraint"] end
            when 'threshold_filter' then list_transform(s.conditions, lambda c: c.metric) when 'tradeoff_summary' then [s.m1, s.m2] else [s.target] end as names from y),
    ev as (select distinct id, i as "row", list_position(h, n) - 1 as col, n as col_name, coalesce(rw[i + 1][list_position(h, n)], '') as value
        from (select id, h, rw, i, unnest(names) as n from (select id, h, rw, names, unnest(read) as i from x)))"""


_CELL = 'c is null or coalesce(c."row" >= 0 and c.col >= 0 and c.col_name is not null and c.value is not null, false)'
_STEP = f"""coalesce(p."index" >= 0 and p.kind in ('filter', 'compare', 'aggregate', 'select', 'conclude') and p.description is not null and len(list_filter(coalesce(p.cites, []), lambda c: not ({_CELL}))) = 0, false)"""
_SHAPE = f"""coalesce(table_id is not null and domain is not null and question is not null and question_type in ('best_under_constraint', 'threshold_filter', 'tradeoff_summary', 'compare_rows', 'rank_models')
    and coalesce(trace_source, 'programmatic') in ('programmatic', 'llm') and len(h) > 0 and len(ct) = len(h) and len(list_filter(ct, lambda c: not coalesce(c in ('numeric', 'categorical', 'text'), false))) = 0
    and has_rows and len(list_filter(rw, lambda r: not coalesce(len(r) = len(h), false))) = 0 and (rl is null or len(rl) = len(rw)) and gold.label is not null and len(steps) > 0
    and len(list_filter(steps, lambda p: not ({_STEP}))) = 0 and steps[-1].kind = 'conclude' and len(list_filter(coalesce(evidence, []), lambda c: not ({_CELL}))) = 0, false)"""


def _keeps(v: str, op: str, t: str) -> str:
    return f"coalesce(case when coalesce({op} = 'lt', false) then {v} < {t} else {v} >= {t} end, false)"


_MEETS = f"len(list_filter(coalesce(s.conditions, []), lambda c: not {_keeps('nums[i + 1][list_position(h, c.metric)]', 'c.op', 'c.t')})) = 0"
_ABLE = f"""case s.type when 'best_under_constraint' then list_filter(uni, lambda i: nums[i + 1][a] is not null and {_keeps('nums[i + 1][b]', 's.op', 's.threshold')})
    when 'threshold_filter' then list_filter(uni, lambda i: {_MEETS}) when 'extremum' then list_filter(uni, lambda i: nums[i + 1][a] is not null) else [] end"""
_O = "case when coalesce(s.{d} = 'higher', false) then nums[{i} + 1][{c}] else -nums[{i} + 1][{c}] end"
_A, _B = (lambda i: f"({_O.format(d='d1', i=i, c='a')})"), (lambda i: f"({_O.format(d='d2', i=i, c='b')})")
_BEATEN = f"len(list_filter(pts, lambda j: {_A('j')} >= {_A('i')} - 1e-9 and {_B('j')} >= {_B('i')} - 1e-9 and ({_A('j')} > {_A('i')} + 1e-9 or {_B('j')} > {_B('i')} + 1e-9))) > 0"
_EXISTS = f"""coalesce(c."row" >= 0 and c.col >= 0 and c."row" < len(rw) and h[c.col + 1] = c.col_name and (coalesce(abs(nums[c."row" + 1][c.col + 1] - {number('c.value')}) <= 1e-6, false) or coalesce(rw[c."row" + 1][c.col + 1], '') = coalesce(c.value, '')), false)"""


def validated(source: str) -> str:
    """CTEs over ``source`` (the fields of a record, with ``id``, ``h``, ``rw``, ``rl``, ``ct``, ``gold``, ``steps``, ``evidence``, ``s``, ``level``, ``edges``) that end in ``checked``."""
    return f"""v1 as (select * exclude (rw, steps), rw is not null as has_rows, coalesce(rw, []) as rw, list_filter(steps, lambda p: p is not null) as steps, list_filter(coalesce(gold."rows", []), lambda r: r is not null) as said from {source}),
    v2 as (select *, {_NUMS} as nums, list_position(h, coalesce(s.target, s.m1)) as a, list_position(h, coalesce(s."constraint", s.m2)) as b, {_WHOLE} as uni,
        list_filter(list_concat(flatten(list_transform(coalesce(steps, []), lambda p: coalesce(p.cites, []))), coalesce(evidence, [])), lambda c: c is not null) as cites,
        case s.type when 'best_under_constraint' then [s.target, s."constraint"] when 'threshold_filter' then list_transform(coalesce(s.conditions, []), lambda c: c.metric) when 'tradeoff_summary' then [s.m1, s.m2] when 'extremum' then [s.target] else [] end as needs from v1),
    v3 as (select *, {_ABLE} as able, case when s.type = 'tradeoff_summary' then list_filter(uni, lambda i: nums[i + 1][a] is not null and nums[i + 1][b] is not null) else [] end as pts from v2),
    v4 as (select *, case when coalesce(s.target_dir = 'higher', false) then list_max(list_transform(able, lambda i: nums[i + 1][a])) else list_min(list_transform(able, lambda i: nums[i + 1][a])) end as best, nums[said[1] + 1][a] as first from v3),
    v5 as (select *, case when s.type in ('best_under_constraint', 'extremum') then list_sort(list_filter(able, lambda i: abs(nums[i + 1][a] - best) <= 1e-9)) when s.type = 'threshold_filter' then list_sort(able)
        when s.type = 'tradeoff_summary' then list_sort(list_filter(pts, lambda i: not ({_BEATEN}))) end as want from v4),
    v6 as (select id, {_SHAPE} as schema_valid, len(list_filter(cites, lambda c: not {_EXISTS})) = 0 as cells_exist,
        coalesce(s.type is not null and len(list_filter(needs, lambda n: not coalesce(list_contains(h, n), false))) = 0 and list_sort(said) = want and (s.type <> 'tradeoff_summary' or list_sort(list_distinct(coalesce(gold.metrics, []))) = list_sort(list_distinct([s.m1, s.m2]))), false) as answer_correct,
        coalesce(case when s.type in ('best_under_constraint', 'extremum') then len(able) = 0 or len(said) = 0 or (first is not null and len(list_filter(able, lambda i: case when coalesce(s.target_dir = 'higher', false) then nums[i + 1][a] > first + 1e-9 else nums[i + 1][a] < first - 1e-9 end)) = 0)
            when s.type = 'threshold_filter' then len(list_filter(able, lambda i: not list_contains(said, i))) = 0 else true end, false) as numeric_comparisons_correct,
        coalesce(case s.type when 'best_under_constraint' then len(list_filter(said, lambda i: not list_contains(able, i))) = 0 when 'threshold_filter' then len(list_filter(said, lambda i: not (i >= 0 and i < len(rw) and {_MEETS}))) = 0 else true end, false) as threshold_satisfaction,
        len(list_filter(needs, lambda n: not (s.type = 'best_under_constraint' and len(said) = 0 and coalesce(n = s.target, false)) and len(list_filter(coalesce(evidence, []), lambda c: c is not null and coalesce(c.col_name = n, n is null))) = 0)) = 0 as relevance,
        coalesce(s.type <> 'tradeoff_summary' or s.type is null or list_sort(said) = want, false) as pareto_frontier_correct,
        coalesce(len(said) > 0 or (gold.label = 'none' and steps[-1].kind = 'conclude'), false) as empty_result_consistency, coalesce(level in ('easy', 'hard') and edges is not null, false) as difficulty_tag_present from v5),
    checked as (select id, schema_valid, {', '.join(f'schema_valid and {c} as {c}' for c in ('cells_exist', 'answer_correct', 'numeric_comparisons_correct', 'threshold_satisfaction', 'relevance', 'pareto_frontier_correct', 'empty_result_consistency', 'difficulty_tag_present'))} from v6)"""


#: The first balanced object of ``raw`` as ``o`` and its operation as ``s``, by ``detail_id``.
OBJECTS = r"""ra as (select detail_id, substr(raw, strpos(raw, '{')) as t from p3_4b_exec_test_verified where strpos(raw, '{') > 0),
    rk as (select detail_id, generate_subscripts(k, 1) as i, unnest(k) as w from (select detail_id, regexp_extract_all(t, '(?s)"(?:[^"\\]|\\.)*(?:"|$)|[{}]|[^"{}]+') as k from ra)),
    rd as (select *, sum(case w when '{' then 1 when '}' then -1 else 0 end) over (partition by detail_id order by i) as depth from rk),
    re as (select detail_id, min(i) as last from rd where depth = 0 and w = '}' group by 1),
    ro as (select rk.detail_id, string_agg(w, '' order by i) as o from rk join re using (detail_id) where i <= last group by 1),
    rp as (select detail_id, case when json_valid(o) then json_extract(o::json, '$.operation') end as p from ro),
    op as (select detail_id, case when json_type(p) = 'OBJECT' then json_transform(p, '{"type":"VARCHAR","target":"VARCHAR","target_dir":"VARCHAR","constraint":"VARCHAR","op":"VARCHAR","threshold":"DOUBLE","conditions":[{"metric":"VARCHAR","op":"VARCHAR","T":"DOUBLE"}],"m1":"VARCHAR","m2":"VARCHAR","d1":"VARCHAR","d2":"VARCHAR"}') end as m from rp)"""
