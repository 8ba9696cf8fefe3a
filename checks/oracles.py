"""SQL for the queries that SQL can express, in the dialect of the checker."""

from __future__ import annotations

import math

from caselight.operators.neural import SUBSETS
from caselight.operators.signals import THETA_INIT
from caselight.sources.layouts import LAYOUTS
from checks import loads
from checks.queries import EMBEDDED, GENE_TERMS, THETAS

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

_PAIRS = """pairs as (
  select l_orderkey as id, p_brand as var1, p_type as var2
  from lineitem join part on l_partkey = p_partkey)"""

_PART_PAIRS = """pairs as (
  select l_orderkey as id, l_partkey as var1, l_suppkey as var2 from lineitem)"""

_COUNTED = """total as (select count(distinct id)::double as ids from pairs),
m1 as (select var1, count(distinct id)::double as ids1 from pairs group by var1),
m2 as (select var2, count(distinct id)::double as ids2 from pairs group by var2),
seen as (select var1, var2, count(distinct id)::bigint as N from pairs group by var1, var2),
counted as (
  select var1, var2, N, ids1, ids2, ids, ids1 * ids2 / ids as E
  from seen join m1 using (var1) join m2 using (var2), total)"""

_A1, _B1, _A2, _B2, _P = (repr(v) for v in THETA_INIT.astuple())

# Posterior weight of the first part at the starting prior.
_WEIGHTED = f"""weighted as (
  select *, 1 / (1 + exp(-(
      ln({_P}) - ln(1 - {_P}) + lgamma(N + {_A1}) - lgamma({_A1})
      - lgamma(N + {_A2}) + lgamma({_A2})
      - {_A1} * ln(1 + E / {_B1}) + {_A2} * ln(1 + E / {_B2})
      + N * ln((E + {_B2}) / (E + {_B1}))))) as qn
  from counted)"""

# Digamma at the two starting shapes; whole steps up are sums.
_DIGAMMA_A1, _DIGAMMA_A2 = -5.289039896592188, 0.42278433509846713

_EBGM = f"""exp(
    qn * ({_DIGAMMA_A1} + list_sum(list_transform(range(0, N), lambda i: 1 / ({_A1} + i)))
          - ln({_B1} + E))
    + (1 - qn) * ({_DIGAMMA_A2} + list_sum(list_transform(range(0, N), lambda i: 1 / ({_A2} + i)))
          - ln({_B2} + E)))"""


def _gamma_cdf(a: str, x: str) -> str:
    """Lower incomplete gamma ratio by its power series."""
    return f"""list_sum(list_transform(range(0, cast({x} + 20 * sqrt({x}) + 60 as bigint)),
        lambda j: exp(({a} + j) * ln({x}) - {x} - lgamma({a} + j + 1))))"""


def _bisected(percents: str) -> str:
    """Posterior quantiles by halving a bracket 46 times."""
    return f"""halved as (
  select var1, var2, N, E, qn, pct, 0::double as lo, 3 * (N + 3) / E as hi, 0 as step
  from weighted, (select unnest({percents}) as pct)
  union all
  select var1, var2, N, E, qn, pct,
         case when below then mid else lo end, case when below then hi else mid end, step + 1
  from (
    select *, qn * {_gamma_cdf(f"({_A1} + N)", f"(({_B1} + E) * mid)")}
        + (1 - qn) * {_gamma_cdf(f"({_A2} + N)", f"(({_B2} + E) * mid)")} < pct / 100 as below
    from (select *, (lo + hi) / 2 as mid from halved where step < 46))),
quantiles as (select var1, var2, pct, (lo + hi) / 2 as q from halved where step = 46)"""


_SQUASH_ONE = """points as (select N, E, 1::bigint as weight from counted),
placed1 as (
  select *, row_number() over (order by E) - 1 as place, count(*) over () as size
  from points where N = 1),
cut1 as (select *, ((size - 100) // 50) * 50 as thinned from placed1),
once as (
  select N, E, weight from points where N <> 1
  union all select N, E, weight from cut1 where place >= thinned
  union all select 1, avg(E), 50 from cut1 where place < thinned group by place // 50)"""

_SQUASH_TWO = """placed2 as (
  select *, row_number() over (order by E) - 1 as place, count(*) over () as size
  from once where N = 2),
cut2 as (select *, ((size - 100) // 10) * 10 as thinned from placed2),
twice as (
  select N, E, weight from once where N <> 2
  union all select N, E, weight from cut2 where place >= thinned
  union all select 2, avg(E), 10 from cut2 where place < thinned group by place // 10)"""


def _likelihood(thetas=tuple(t.astuple() for t in THETAS), digits: int | None = 4) -> str:
    rows = ", ".join(f"({i}, {', '.join(repr(v) for v in t)})" for i, t in enumerate(thetas))

    def nb(a: str, b: str) -> str:
        return f"""exp(lgamma({a} + N) - lgamma({a}) - lgamma(N + 1)
            + {a} * ln({b} / ({b} + E)) + N * ln(E / ({b} + E)))"""

    value = f"""-sum(weight * ln((p * {nb('a1', 'b1')} + (1 - p) * {nb('a2', 'b2')})
        / (1 - p * pow(b1 / (b1 + E), a1) - (1 - p) * pow(b2 / (b2 + E), a2))))"""
    told = value if digits is None else f"round({value}, {digits})"
    return f"""select theta_id::int as theta_id, {told} as neg_log_lik
    from twice, (values {rows}) as t(theta_id, a1, b1, a2, b2, p) group by theta_id"""


def _slopes(step: float = 1e-4) -> str:
    """By differences, in the logs of the four and the logit of the share."""
    start = THETAS[0].astuple()
    free = [*map(math.log, start[:4]), math.log(start[4] / (1 - start[4]))]
    points = [free]
    for i in range(5):
        for sign in (1, -1):
            points.append([x + sign * step * (i == j) for j, x in enumerate(free)])
    thetas = [(*map(math.exp, x[:4]), 1 / (1 + math.exp(-x[4]))) for x in points]
    at = "max(neg_log_lik) filter (where theta_id = {})"
    slopes = ", ".join(
        f"round(({at.format(2 * i + 1)} - {at.format(2 * i + 2)}) / {2 * step!r}, 1) as slope_{i}" for i in range(5)
    )
    return f"select round({at.format(0)}, 4) as value, {slopes} from ({_likelihood(thetas, None)})"


_FOLD_ORDER = """with firsts as (select {label} as c, min({key}) as first from {table} group by 1),
numbered as (
  select {columns}, (row_number() over (
      order by first, md5(concat({key}, ':1004')), {key}) - 1) % {k} as fold
  from {table} join firsts on {label} = c)"""


def _folds(k: int = 4) -> str:
    return _FOLD_ORDER.format(
        label="quality", key="doc_id", table="labels", columns="doc_id, quality, toxic", k=k
    )


_SETS = f"""members as (
  select term_id, p_partkey as gene_id, concat('parts of ', term_id) as description
  from (select p_partkey, unnest([{', '.join(GENE_TERMS)}]) as term_id from part))"""

_LISTED = """query as (
  select p_partkey as gene_id from part
  where p_type = (select min(p_type) from part) or p_brand = 'Brand#13')"""

_LISTED_SIZES = "query as (select p_partkey as gene_id from part where p_size <= 40)"

_WORD_PAIRS = r"""pairs as (
  select * from (
    select doc_id as id, concat(source, '/', lang) as var1, unnest(string_split_regex(text, '[ \n]+')) as var2
    from documents)
  where var2 <> '')"""


def _log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


_TAIL = f"""least(1, list_sum(list_transform(range(k, least(n, big_m) + 1), lambda i: exp(
    {_log_choose('big_m', 'i')} + {_log_choose('(big_n - big_m)', '(n - i)')}
    - {_log_choose('big_n', 'n')}))))"""


def _enriched(genes: str, cuts: str = "pvalue <= 0.05 and p_adjust <= 0.05 and (q_value is null or q_value <= 0.2)") -> str:
    return f"""{_SETS}, {genes},
hits as (select term_id, gene_id from members where gene_id in (select gene_id from query)),
sizes as (
  select term_id, count(*) as big_m, min(description) as description from members group by 1
  having count(*) between 10 and 500),
tested as (
  select *, {_TAIL} as pvalue
  from (select term_id, count(*) as k from hits group by 1) join sizes using (term_id),
       (select count(distinct gene_id) as n from hits),
       (select count(distinct gene_id) as big_n from members)),
ranked as (
  select *, pvalue * count(*) over () / rank_last as raw
  from (select *, count(*) over (order by pvalue) as rank_last from tested)),
adjusted as (
  select *, min(raw) over (order by pvalue desc) as p_adjust from ranked),
nulls as (
  select least(1, avg((pvalue >= 0.05)::int) / 0.95) as share from tested),
scored as (
  select *, case when share > 0 then p_adjust * share end as q_value from adjusted, nulls),
enriched as (
  select *, (select list(gene_id order by gene_id) from hits where hits.term_id = scored.term_id)
         as genes
  from scored where {cuts})"""


_ENRICH_COLUMNS = """select term_id, description, concat(k, '/', n) as gene_ratio,
  concat(big_m, '/', big_n) as bg_ratio, k, n, big_m, big_n,
  round(pvalue, 9) as pvalue, round(p_adjust, 9) as p_adjust, round(q_value, 9) as q_value,
  array_to_string(genes, '/') as genes, k as count from enriched"""

_P_VALUES = """p as (
  select o_orderkey as id, round(o_totalprice / (o_totalprice + 3000000), 4) as pvalue
  from orders),
ranked as (
  select *, pvalue * count(*) over () / (count(*) over (order by pvalue)) as raw from p),
adjusted as (select id, pvalue, min(raw) over (order by pvalue desc) as p_adjust from ranked)"""

_QUALITY = """pred as (
  select doc_id, quality as label, n_chars / (n_chars + 1000) as score,
         (n_chars / (n_chars + 1000) >= 0.5)::int as prediction
  from documents join labels using (doc_id))"""

_CURVE = """counts as (
  select score, sum(label)::double as pos, sum(1 - label)::double as neg from pred group by 1),
taken as (
  select score, sum(pos) over w as tp, sum(neg) over w as fp from counts
  window w as (order by score desc)),
curve as (
  select score as threshold, tp / (tp + fp) as precision, tp / (select sum(pos) from counts) as recall
  from taken union all select null, 1, 0)"""

_LOSS = "avg(-ln(case when label = 1 then score else 1 - score end))"


def _vector(n: int) -> str:
    return ", ".join(f"embedding[{i + 1}]::double as f{i}" for i in range(n))


_NEAR = f"""vectors as (
  select vec_id, (label = 0)::int as label, {_vector(64)},
         list_transform(embedding, lambda x: x::double) as vec from embeddings),
near as (
  select * from (
    select a.label, a.vec_id as key, b.vec_id as neighbour, list_distance(a.vec, b.vec) as distance,
           row_number() over (partition by a.vec_id
               order by list_distance(a.vec, b.vec), b.vec_id) - 1 as slot
    from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id)
  where slot < 5)"""

_DRAWN = f"""sizes as (select label, count(*) as m, max(count(*)) over () as most from vectors group by 1),
draws as (
  select label, draw, digest,
         ('0x' || substr(digest, 1, 12))::bigint % m as row,
         ('0x' || substr(digest, 9, 12))::bigint % 5 as slot,
         ('0x' || substr(digest, 21, 12))::bigint / 281474976710656.0::double as step
  from (select label, m, draw, md5(concat(label, ':', draw, ':0')) as digest
        from (select label, m, unnest(range(0, most - m)) as draw from sizes))),
numbered as (
  select *, row_number() over (partition by label order by md5(concat(vec_id, ':0')), vec_id) - 1 as row
  from vectors),
made as (
  select concat('new:', d.label, ':', d.draw) as vec_id, d.label,
         {", ".join(f"a.f{i} + step * (b.f{i} - a.f{i}) as f{i}" for i in range(64))},
         true as synthetic
  from draws d join numbered a using (label, row)
  join near on near.key = a.vec_id and near.slot = d.slot
  join vectors b on b.vec_id = near.neighbour
  union all
  select vec_id::varchar, label, {", ".join(EMBEDDED)}, false from vectors)"""


_STUMPED = """parts as (
  select p_partkey, case when p_size + 3 * length(p_type) + p_partkey % 13 > 52 then 1.0::double else -1.0::double end as y,
    [p_size // 2, length(p_type), length(p_name), replace(p_brand, 'Brand#', '')::int % 25] as x
  from part)"""


def _best_cut(name: str, table: str, y: str, each: str = "1") -> str:
    """The feature f and value v whose cut leaves least of the variance of y, with
    count and sum below it and of all; one for each value of ``each``."""
    return f"""cells_{name} as (
  select part, f, v, count(*) as n, sum(y) as s
  from (select {each} as part, unnest(x) as v, unnest([0, 1, 2, 3]) as f, {y} as y from {table}) group by all),
cuts_{name} as (
  select part, f, v, sum(n) over w as nl, sum(s) over w as sl,
    sum(n) over (partition by part, f) as n, sum(s) over (partition by part, f) as s
  from cells_{name} window w as (partition by part, f order by v)),
{name} as (
  select * from cuts_{name} where nl < n
  qualify row_number() over (partition by part order by sl * sl / nl + (s - sl) * (s - sl) / (n - nl) desc) = 1)"""


_LEAF = "case when x[{b}.f + 1] <= {b}.v then {b}.sl / {b}.nl else ({b}.s - {b}.sl) / ({b}.n - {b}.nl) end"


def _given_score(subset) -> str:
    """Chance of class 1 by the network of given weights, on a row's embedding."""
    hidden = f"(1 / (1 + exp(-(0.5 + {' + '.join(f'embedding[{i + 1}]::double' for i in subset)}))))"
    return f"(1 / (1 + exp(0.25 - (2 * {hidden} - 0.25))))"


def _described(select: str) -> str:
    return " union all ".join(select.format(c=c) for c in _NUMBERS)


_ORDER_DAY = "replace(substr(cast(o_orderdate as varchar), 1, 10), '-', '')"
_NOTE_BYTES = "strlen(o_orderpriority)"

_SQL: dict[str, str] = {
    # fixed-width
    "fixed_width_parse": f"""select o_orderkey as key, o_custkey as customer,
        o_orderstatus as status, {_ORDER_DAY} as day, trim(o_orderpriority) as note from orders""",
    "fixed_width_errors": """select 'orders' as "table", count(*) as records,
        count(*) filter (where o_orderstatus = 'P') as error_records, 0::bigint as cut_fields
        from orders""",
    "fixed_width_short_missing": f"""select o_orderkey as key, o_custkey as customer,
        o_orderstatus as status, {_ORDER_DAY} as day,
        case when {_NOTE_BYTES} >= 16 then o_orderpriority end as note, false as _error,
        ({_NOTE_BYTES} < 16)::int as _cut_fields from orders""",
    "fixed_width_short_truncate": f"""select o_orderkey as key, o_custkey as customer,
        o_orderstatus as status, {_ORDER_DAY} as day, o_orderpriority as note, false as _error,
        ({_NOTE_BYTES} < 16)::int as _cut_fields from orders""",
    "fixed_width_latin1": """select concat('Ã©', p_brand) as brand, p_type as type from part""",
    "load_extracts_report": " union all ".join(
        f"""select '{layout.table}' as "table", count(*) as records, 0::bigint as error_records,
        0::bigint as cut_fields from {loads.source_of(layout)}"""
        for layout in LAYOUTS.values()
    ),
    # other sources and sinks
    "read_table_csv": "select * from part",
    "read_tables_six": """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
        l_linestatus from lineitem""",
    "write_table_round_trip": "select * from supplier",
    "write_scores_row_id": f"""with {_PAIRS}, {_COUNTED}
        select row_number() over (order by var1, var2) as row_id, var1, var2, N from counted""",
    "genes_literal": """select p_brand as symbol, p_partkey as entrez_id from part
        where p_brand in ('Brand#1', 'Brand#2')""",
    # columns and rows
    "select_positions": "select p_partkey, p_brand, p_type, p_retailprice from part",
    "drop_columns": "select p_partkey, p_brand, p_type, p_size from part",
    "split_label": "select doc_id, toxic, quality as label from labels",
    "feature_subset": """select l_orderkey, round(l_quantity, 4) as l_quantity,
        round(l_extendedprice, 4) as l_extendedprice, round(l_tax, 4) as l_tax from lineitem""",
    "union_rename": """select l_orderkey as id, l_partkey as var1, l_returnflag as study_drug,
        l_suppkey as var2 from lineitem""",
    "first_n": "select * from orders order by o_orderkey limit 5",
    "last_n": "select * from orders order by o_orderkey desc limit 2",
    "dense_row_id": """select o_orderkey, o_totalprice,
        row_number() over (order by o_totalprice desc, o_orderkey) - 1 as row_id from orders""",
    "running_sum": """select l_quantity, count(*) as n,
        (sum(count(*)) over (order by l_quantity))::bigint as running_sum_n
        from lineitem group by 1""",
    "running_min_backwards": """select o_custkey, min(o_totalprice) as least,
        o_custkey::double as customer,
        min(min(o_totalprice)) over (order by o_custkey desc) as running_min_least
        from orders group by 1""",
    # profile
    "shape": "select count(*) as rows, 11 as columns from lineitem",
    "value_counts": "select quality, count(*) as count from labels where quality is not null group by 1",
    "class_share": """select quality, count(*) as count,
        round(count(*) / sum(count(*)) over (), 9) as share
        from labels where quality is not null group by 1""",
    "describe_features": _described(
        "select '{c}' as feature, count({c}) as count, round(avg({c}), 4) as mean, "
        "round(var_samp({c}), 4) as variance from lineitem"
    ),
    "fit_scaler": _described(
        "select '{c}' as feature, round(avg({c}), 4) as mean, "
        "round(stddev_pop({c}), 4) as sd from lineitem"
    ),
    "standardize": "select l_orderkey, "
    + ", ".join(
        f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 5) + 0 as {c}" for c in _NUMBERS
    )
    + " from lineitem",
    # folds
    "stratified_folds": f"{_folds()} select doc_id, quality, toxic, fold::int as fold from numbered",
    "stratified_folds_five": _FOLD_ORDER.format(
        label="o_orderstatus", key="o_orderkey", table="orders",
        columns="o_orderkey, o_orderstatus", k=5,
    )
    + " select o_orderkey, o_orderstatus, fold::int as fold from numbered",
    "fold_split_train": f"{_folds()} select doc_id, quality, toxic, fold::int as fold from numbered where fold <> 0",
    "fold_split_valid": f"{_folds()} select doc_id, quality, toxic, fold::int as fold from numbered where fold = 0",
    "split_report": f"""{_folds()} select case when fold = 0 then 'valid' else 'train' end as side,
        count(*) as rows, round(count(*) / sum(count(*)) over (), 9) as share,
        round(avg((quality = 1)::int), 9) as positive_rate from numbered group by 1""",
    # signals
    "disproportionality": f"""with {_PAIRS}, {_COUNTED}
        select var1, var2, N, round(E, 6) as E, round(N / E, 2) as RR,
          case when ids = ids1 then null when ids2 = N then 'infinity'::double
               else round((N / ids1) / ((ids2 - N) / (ids - ids1)), 2) end as PRR from counted""",
    "disproportionality_parts": f"""with {_PART_PAIRS}, {_COUNTED}
        select var1, var2, N, round(E, 9) as E, round(N / E, 6) as RR,
          case when ids = ids1 then null when ids2 = N then 'infinity'::double
               else round((N / ids1) / ((ids2 - N) / (ids - ids1)), 6) end as PRR from counted""",
    "mixture_weight": f"""with {_PAIRS}, {_COUNTED}, {_WEIGHTED}
        select var1, var2, round(qn, 6) as qn from weighted""",
    "ebgm": f"""with {_PAIRS}, {_COUNTED}, {_WEIGHTED}
        select var1, var2, round({_EBGM}, 4) as EBGM from weighted""",
    "posterior_quantile": f"""with recursive {_PAIRS}, {_COUNTED}, {_WEIGHTED},
        {_bisected('[50.0::double]')}
        select var1, var2, round(q, 4) as median from quantiles""",
    "signal_scores": f"""with recursive {_PAIRS}, {_COUNTED}, {_WEIGHTED},
        {_bisected('[2.5::double, 97.5::double]')}
        select var1, var2, N, round(E, 6) as E, round(N / E, 2) as RR,
          case when ids = ids1 then null when ids2 = N then 'infinity'::double
               else round((N / ids1) / ((ids2 - N) / (ids - ids1)), 2) end as PRR,
          round({_EBGM}, 2) as EBGM, round(l.q, 2) as QUANT_025, round(h.q, 2) as QUANT_975
        from weighted join quantiles l using (var1, var2) join quantiles h using (var1, var2)
        where l.pct = 2.5 and h.pct = 97.5""",
    "squash_once": f"""with {_PART_PAIRS}, {_COUNTED}, {_SQUASH_ONE}
        select N, round(E, 9) as E, weight::bigint as weight from once""",
    "squash": f"""with {_PART_PAIRS}, {_COUNTED}, {_SQUASH_ONE}, {_SQUASH_TWO}
        select N, round(E, 9) as E, weight::bigint as weight from twice""",
    "neg_log_lik": f"""with {_PART_PAIRS}, {_COUNTED}, {_SQUASH_ONE}, {_SQUASH_TWO}
        {_likelihood()}""",
    "prior_slopes": f"""with {_PART_PAIRS}, {_COUNTED}, {_SQUASH_ONE}, {_SQUASH_TWO}
        {_slopes()}""",
    "fit_prior": f"""with {_WORD_PAIRS}, {_COUNTED}, {_SQUASH_ONE}, {_SQUASH_TWO}
        select neg_log_lik as start, true as lower, true as settled, true as in_range
        from ({_likelihood()}) where theta_id = 0""",
    "fit_prior_improves": f"""select theta_id::int as theta_id, true as same
        from (select unnest(range({len(THETAS)})) as theta_id)""",
    # genes
    "map_ids": """select s_suppkey, s_nationkey, n_name from supplier
        join nation on s_nationkey = n_nationkey where n_regionkey <> 0""",
    "unmapped_ids": """select s_suppkey, s_nationkey from supplier where s_nationkey not in
        (select n_nationkey from nation where n_regionkey <> 0)""",
    "enrich": f"with {_enriched(_LISTED)} {_ENRICH_COLUMNS}",
    "enrich_all_tested": f"with {_enriched(_LISTED, 'true')} {_ENRICH_COLUMNS}",
    "hypergeom_sf": f"""with counted as (
          select l_suppkey, count(*) as big_m, count(*) filter (where l_linestatus = 'O') as k
          from lineitem group by 1),
        totals as (
          select count(*) as big_n, count(*) filter (where l_linestatus = 'O') as n from lineitem)
        select l_suppkey, round({_TAIL}, 6) as pvalue from counted, totals""",
    "hypergeom_edges": f"""with urns as (
          select p_partkey, p_size as big_n, p_size // 2 as big_m, p_size - p_size // 3 as n,
            unnest([-1, 0, 1, p_size // 2, p_size // 2 + 1, p_size + 1, null]) as k from part)
        select p_partkey, big_n, big_m, n, k,
          case when k is null then null when k > least(n, big_m) then 0
               when k <= greatest(0, n + big_m - big_n) then 1
               else round({_TAIL}, 9) end as pvalue from urns""",
    "hypergeom_large": f"""with urns as (
          select p_partkey, 4000000 as big_n, 1000000 as big_m, 1000000 as n, 250000 + (p_size - 25) * 40 as k
          from part),
        tails as (select k, least(1, list_sum(list_transform(range(k, k + 6000), lambda i: exp(
            {_log_choose('big_m', 'i')} + {_log_choose('(big_n - big_m)', '(n - i)')}
            - {_log_choose('big_n', 'n')})))) as tail
          from (select distinct k, big_n, big_m, n from urns))
        select p_partkey, k::bigint as k, round(tail, 6) as pvalue from urns join tails using (k)""",
    "bh_adjust": f"with {_P_VALUES} select id, pvalue, round(p_adjust, 9) as p_adjust from adjusted",
    "q_value": f"""with {_P_VALUES},
        nulls as (select least(1, avg((pvalue >= 0.05)::int) / 0.95) as share from p)
        select id, pvalue, round(p_adjust, 9) as p_adjust,
          round(case when share > 0 then p_adjust * share end, 9) as q_value from adjusted, nulls""",
    "set_readable": f"""with {_enriched(_LISTED)}
        select term_id, array_to_string(list(concat(p_name, ' ', p_partkey) order by p_partkey), '/') as genes
        from (select term_id, unnest(genes) as gene_id from enriched)
        join part on gene_id = p_partkey group by 1""",
    "top_terms": f"""with {_enriched(_LISTED)}
        select term_id, k as count, round(p_adjust, 9) as p_adjust
        from enriched order by pvalue, term_id limit 35""",
    "term_gene_edges": f"""with {_enriched(_LISTED)}
        select term_id, unnest(genes) as gene_id
        from (select * from enriched order by pvalue, term_id limit 5)""",
    "term_gene_nodes": f"""with {_enriched(_LISTED)},
        shown as (select * from enriched order by pvalue, term_id limit 30)
        select term_id as node_id, 'term' as kind, round(pvalue, 9) as size from shown
        union all select gene_id::varchar, 'gene', count(*)::double
        from (select unnest(genes) as gene_id from shown) group by 1""",
    "top_terms_cut": f"""with {_enriched(_LISTED_SIZES)}
        select term_id, k as count, round(p_adjust, 9) as p_adjust
        from enriched order by pvalue, term_id limit 35""",
    "term_gene_edges_cut": f"""with {_enriched(_LISTED_SIZES)}
        select term_id, unnest(genes) as gene_id
        from (select * from enriched order by pvalue, term_id limit 5)""",
    "term_gene_nodes_cut": f"""with {_enriched(_LISTED_SIZES)},
        shown as (select * from enriched order by pvalue, term_id limit 30)
        select term_id as node_id, 'term' as kind, round(pvalue, 9) as size from shown
        union all select gene_id::varchar, 'gene', count(*)::double
        from (select unnest(genes) as gene_id from shown) group by 1""",
    # metrics
    "accuracy": f"with {_QUALITY} select round(avg((label = prediction)::int), 9) as accuracy from pred",
    "classification_report": f"""with {_QUALITY}, c as (
          select count(*) filter (where label = 1 and prediction = 1) as tp,
            count(*) filter (where label = 0 and prediction = 1) as fp,
            count(*) filter (where label = 1 and prediction = 0) as fn,
            count(*) filter (where label = 0 and prediction = 0) as tn from pred)
        select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy,
          round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall,
          round(2 * tp / (2 * tp + fp + fn), 9) as f1 from c""",
    "prediction_share": f"""with {_QUALITY} select prediction, count(*) as count,
        round(count(*) / sum(count(*)) over (), 9) as share from pred group by 1""",
    "log_loss": f"with {_QUALITY} select round({_LOSS}, 9) as log_loss from pred",
    "evaluate": f"""with {_QUALITY} select round({_LOSS}, 9) as log_loss,
        round(avg((label = prediction)::int), 9) as accuracy from pred""",
    "measures_with_missing": f"""with pred as (
          select quality as label, case when lang <> 'fr' then n_chars / (n_chars + 1000) end as score,
            case when lang <> 'de' then (n_chars >= 1000)::int end as prediction
          from documents left join labels using (doc_id)),
        ranks as (select label, rank() over (order by score)
                    + (count(*) over (partition by score) - 1) / 2 as r
                  from pred where label is not null and score is not null),
        s as (select sum(r) filter (where label = 1) as w, sum(label)::double as p,
                     sum(1 - label)::double as q from ranks),
        l as (select {_LOSS} as loss from pred where label is not null and score is not null)
        select round(avg((label = prediction)::int), 9) as accuracy, round(any_value(loss), 9) as log_loss,
          round(any_value(loss), 9) as loss_again,
          round(any_value((w - p * (p + 1) / 2) / (p * q)), 9) as roc_auc,
          count(*) filter (where label = 1 and prediction = 1) as tp,
          count(*) filter (where label = 0 and prediction = 1) as fp,
          count(*) filter (where label = 1 and prediction = 0) as fn,
          count(*) filter (where label = 0 and prediction = 0) as tn
        from pred, s, l""",
    "roc_auc": f"""with {_QUALITY},
        ranks as (select label, rank() over (order by score)
                    + (count(*) over (partition by score) - 1) / 2 as r from pred),
        s as (select sum(r) filter (where label = 1) as w, sum(label)::double as p,
                     sum(1 - label)::double as q from ranks)
        select round((w - p * (p + 1) / 2) / (p * q), 9) as roc_auc from s""",
    "pr_curve": f"""with {_QUALITY}, {_CURVE} select round(threshold, 9) as threshold,
        round(precision, 9) as precision, round(recall, 9) as recall from curve""",
    "auprc": f"""with {_QUALITY}, {_CURVE},
        steps as (select (recall - lag(recall) over w) * (precision + lag(precision) over w) / 2 as a
          from curve window w as (order by threshold desc nulls first))
        select round(sum(a), 9) as auprc from steps""",
    # models: which rows are scored, and on which side of the fold
    "gbt_scores_sound": """select vec_id, (label = 0)::int as label, true as sound
        from embeddings""",
    "mlp_final_sound": f"""with vectors as (
          select vec_id, (label = 0)::int as label from embeddings),
        {_FOLD_ORDER.removeprefix("with ").format(
            label="label", key="vec_id", table="vectors", columns="vec_id", k=5)}
        select vec_id, case when fold = 0 then 'valid' else 'train' end as side,
          fold::int as fold, true as sound from numbered""",
    "mlp_final": f"""with vectors as (
          select vec_id, (label = 0)::int as label from embeddings),
        {_FOLD_ORDER.removeprefix("with ").format(
            label="label", key="vec_id", table="vectors", columns="vec_id", k=5)}
        select case when fold = 0 then 'valid' else 'train' end as side, count(*) as rows,
          true as better from numbered group by 1""",
    "mlp_history": """select step::int as step, side, metric,
          case when side = 'train' and metric = 'loss' and step > 2 then true end as falls
        from (select unnest(range(2, 21, 2)) as step), (values ('train'), ('valid')) a(side),
             (values ('loss'), ('accuracy')) b(metric)""",
    "mlp_forward": f"""with hidden as (
          select vec_id, 1 / (1 + exp(-(0.5 + {" + ".join(f"embedding[{i + 1}]::double" for i in SUBSETS[0])}))) as h
          from embeddings),
        out as (select vec_id, 1 / (1 + exp(0.25 - (2 * h - 0.25))) as p from hidden)
        select vec_id, round(p, 9) as score, (p > 0.5)::int as prediction from out""",
    "gbt_stump": f"""with {_STUMPED}, {_best_cut("best", "parts", "y")}
        select p_partkey, round(1 / (1 + exp(-2 * m)), 9) as score, (m > 0)::int as prediction
        from (select p_partkey, {_LEAF.format(b="best")} as m from parts, best)""",
    "gbt_two_rounds": f"""with {_STUMPED}, {_best_cut("best", "parts", "y")},
        after as (select *, {_LEAF.format(b="best")} as m from parts, best),
        left_over as (select p_partkey, x, m, 4 * y / (1 + exp(2 * y * m)) as y2 from after),
        {_best_cut("second", "left_over", "y2")}
        select p_partkey, round(1 / (1 + exp(-2 * t)), 6) as score, (t > 0)::int as prediction
        from (select p_partkey, m + 0.5 * {_LEAF.format(b="second")} as t from left_over, second)""",
    "grid_search_stump": f"""with {_STUMPED}, {_FOLD_ORDER.removeprefix("with ").format(
            label="y", key="p_partkey", table="parts", columns="p_partkey, x, y", k=5)},
        trains as (select t.k as side, p_partkey, x, y from numbered, (values (0), (1), (2), (3), (4)) t(k) where fold <> t.k),
        {_best_cut("best", "trains", "y", "side")},
        told as (select n.fold, ({_LEAF.format(b="best")} > 0) = (y > 0) as hit from numbered n, best where best.part = n.fold),
        mean as (select avg(share) as accuracy from (select avg(hit::int) as share from told group by fold))
        select 1 as rounds, rate::double as rate, round(accuracy, 9) as accuracy, rate = 0.1 as best
        from mean, (values (0.1), (0.5)) r(rate)""",
    "feature_importance_stump": f"""with {_STUMPED}, {_best_cut("best", "parts", "y")}
        select name as feature, (f = place)::int::double as importance
        from best, (values ('half', 0), ('wide', 1), ('long', 2), ('brand', 3)) n(name, place)""",
    "mlp_sweep_given": f"""with vectors as (
          select vec_id, (label = 0)::int as label, embedding from embeddings),
        {_FOLD_ORDER.removeprefix("with ").format(
            label="label", key="vec_id", table="vectors", columns="vec_id, label, embedding", k=5)},
        scored as ({" union all ".join(f"select fold, label, {s} as subset, {_given_score(subset)} as p from numbered"
                                       for s, subset in enumerate(SUBSETS))}),
        sided as (select t.k as fold, subset, case when fold = t.k then 'valid' else 'train' end as side, label, p
                  from scored, (values (0), (1), (2), (3), (4)) t(k)),
        told as (select fold, subset, side, avg(-ln(case when label = 1 then p else 1 - p end)) as loss,
                   avg(((p > 0.5)::int = label)::int) as accuracy from sided group by all)
        select fold, subset, 0 as step, side, metric, round(value, 9) as value
        from (select fold, subset, side, unnest(['loss', 'accuracy']) as metric, unnest([loss, accuracy]) as value from told)""",
    "mlp_untrained_given": f"""with said as (select ({_given_score(SUBSETS[0])} > 0.5)::int as prediction from embeddings)
        select prediction, count(*) as count, round(count(*) / sum(count(*)) over (), 9) as share from said group by 1""",
    "feature_file_boosted": " union all ".join(
        f"""select '{name}' as feature, count({sql}) as count, round(avg({sql}), 4) as mean,
        round(var_samp({sql}), 4) as variance from embeddings"""
        for name, sql in [("Label", "(label = 0)::int::double")]
        + [(f"x{i}", f"embedding[{i + 1}]::double") for i in range(26) if i not in (3, 4)]
    ),
    "feature_file_neural": f"""with vectors as (
          select vec_id, (label = 0)::int as label from embeddings),
        {_FOLD_ORDER.removeprefix("with ").format(
            label="label", key="vec_id", table="vectors", columns="vec_id, label", k=5)}
        select case when fold = 0 then 'valid' else 'train' end as side,
        count(*) as rows, round(count(*) / sum(count(*)) over (), 9) as share,
        round(avg((label = 1)::int), 9) as positive_rate from numbered group by 1""",
    # oversampling
    "smote_missing_is_refused": """select count(*) as rows, true as refused from embeddings
        where label = 0 and embedding[2] > 0""",
    "knn_within_class": f"""with {_NEAR} select label, key, slot::int as slot, neighbour,
        round(distance, 6) as distance from near""",
    "smote_rows": f"""with {_NEAR}, {_DRAWN} select vec_id, label,
        {", ".join(f"round({c}, 6) + 0 as {c}" for c in EMBEDDED)}, synthetic from made""",
    "smote_balance": f"""with {_NEAR}, {_DRAWN}
        select label, synthetic, count(*) as n from made group by all""",
}


def oracle_sql() -> dict[str, str]:
    return _SQL | loads.oracle_sql()
