"""The same rows in SQL, written apart from the Spark code: plain windows and percentiles over whole tables."""

from __future__ import annotations

import re

from tranche.operators import features
from tranche.operators.reasons import phrase
from tranche.sources import testtables as tt
from tranche.sources.schemas import DEFAULT_CODES

from .models import BLOCK
from .queries import ACQ_SHOWN, COLUMNS, FIXED, LAST_TRAIN, OWN_RATES

PLAIN = {t: t for t in tt.TABLES}
NUMBERS = [c for c in COLUMNS if "=" not in c]
SEED, TEST_SHARE, REPEATS = 7, 0.25, 3
RATES = "(values " + ", ".join(f"({y}, cast({v} as double), {i})" for i, (y, v) in enumerate(features.BENCHMARK.items())) + ") as t(year, rate, pos)"
OWN = "(values " + ", ".join(f"({y}, cast({v} as double), {i})" for i, (y, v) in enumerate(OWN_RATES.items())) + ") as t(year, rate, pos)"
VOCAB = {f.name: f.vocab for f in features.spec() if f.vocab}


def seeded(seed: int, what: str) -> str:
    return f"cast(concat('0x', substr(md5(concat('{seed}:', {what})), 1, 15)) as bigint)"


def part(f: str) -> str:
    m, s, c = next((m, s, c) for x, m, s, c in zip(FIXED.features, FIXED.means, FIXED.stds, FIXED.coefs, strict=True) if x == f)
    return f"({q(f)} - {m}) / {s} * {c}"


def q(c: str) -> str:
    return f'"{c}"'


def known(c: str, vocab: tuple[str, ...]) -> str:
    return f"case when {c} in ({', '.join(repr(v) for v in vocab)}) then {c} else 'UNK' end as {c}"


PARTS = {
    "acq": tt.ACQUISITION_SQL.format(**PLAIN),
    "perf": tt.PERFORMANCE_SQL.format(**PLAIN),
    "seen": f"""select loan_id, min(loan_age) as age, arg_min(period, loan_age) as period, greatest(0, max(loan_age)) as observed_months,
        min(case when d >= 3 then loan_age end) as d90m, min(case when d >= 6 then loan_age end) as d180m,
        min(case when zb_code in {DEFAULT_CODES} then loan_age end) as event, min(case when zb_code = '01' then loan_age end) as prepay_month
      from (select *, case when upper(trim(dlq_status)) not in ('X', '') then cast(trim(dlq_status) as integer) end as d from perf) group by loan_id""",
    "bad": "select *, least(d90m, event) as m90, least(d180m, event) as m180, (observed_months >= 36 or coalesce(prepay_month <= 36, false)) as sure, cast(date_trunc('month', period - to_months(age)) as date) as orig_date from seen",
    "lab": """select loan_id, cast(year(orig_date) as integer) as vintage, orig_date, observed_months,
        case when m90 <= 36 then true when sure then false end as d90, case when m180 <= 36 then true when sure then false end as d180,
        event is not null as defaulted, m90 as default_month, prepay_month is not null as prepaid, prepay_month from bad""",
    "bench": f"select y, arg_min(rate, abs(y - year) * 1000 + pos) as rate from (select distinct year(orig_date) as y from acq), {RATES} group by y",
    "feat": f"""select a.loan_id as acq_id, l.loan_id as lab_id, coalesce(a.loan_id, l.loan_id) as loan_id, vintage, d90 as y, state,
        cast(fico as double) as fico, oltv, dti, orig_rate, case when orig_upb > 0 then ln(orig_upb) end as log_upb, coalesce(ocltv, oltv) as ocltv,
        coalesce(orig_rate - rate, 0) as rate_spread, coalesce(mi_pct, 0) as mi_pct, cast(case when coalesce(num_borrowers, 0) = 0 then 1 else num_borrowers end as double) as num_borrowers,
        case when coalesce(co_fico, 0) <> 0 then 1.0 else 0.0 end as has_coborrower, case when first_time_buyer = 'Y' then 1.0 else 0.0 end as first_time_buyer,
        {', '.join(known(c, v) for c, v in VOCAB.items())}
      from acq a left join bench b on b.y = year(a.orig_date) full outer join lab l on a.loan_id = l.loan_id""",
    "fated": """select *, case when lab_id is null then 'no_label' when acq_id is null then 'no_acquisition' when y is null then 'censored'
        when fico is null or oltv is null or dti is null or orig_rate is null or log_upb is null then 'missing' else 'row' end as fate from feat""",
    "loanrows": "select * from fated where fate = 'row'",
    "mat": f"select loan_id, vintage, cast(y as integer) as y, state, {', '.join(NUMBERS)}, "
    + ", ".join(f"case when {c.split('=')[0]} = '{c.split('=')[1]}' then 1.0 else 0.0 end as {q(c)}" for c in COLUMNS if "=" in c)
    + " from loanrows",
    "sc": "select *, 1 / (1 + exp(-z)) as raw, round(1 / (1 + exp(-z)), 9) as pd from (select *, "
    + " + ".join([str(FIXED.intercept), *[f"({q(f)} - {m}) / {s} * {c}" for f, m, s, c in zip(FIXED.features, FIXED.means, FIXED.stds, FIXED.coefs, strict=True)]])
    + " as z from mat)",
    "aucrank": "select y, rank() over (order by pd) + (count(*) over (partition by pd) - 1) / 2.0 as rk from sc",
    "onerow": """select count(*) as n, avg((pd - y) * (pd - y)) as brier, avg(y) as realised, avg(pd) as mean_predicted, avg(y) * (1 - avg(y)) as climatology,
        (select (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) from aucrank) as auc from sc""",
    "sp": f"select *, vintage > {LAST_TRAIN} as is_test from sc",
    "long": f"select loan_id, is_test, state as grp, unnest({[*COLUMNS, 'pd']}) as feature, unnest([{', '.join(q(c) for c in [*COLUMNS, 'pd'])}]) as value from sp",
    "pos": f"select unnest({COLUMNS}) as feature, unnest(range({len(COLUMNS)})) as position",
    "ordered": "select feature, value, row_number() over (partition by feature order by value) as i, count(*) over (partition by feature) as n from long where not is_test",
    "cuts": "select feature, list(distinct value) as c from ordered, range(1, 10) as t(b) where i = (b * n + 9) // 10 group by feature",
    "binned": "select feature, is_test, len(list_filter(coalesce(c, []), lambda e: e < value)) as bin, count(*) as n from long left join cuts using (feature) group by all",
    "shares": """select feature, bin, greatest(sum(case when is_test then 0 else n end) / any_value(te), 1e-4) as e, greatest(sum(case when is_test then n else 0 end) / any_value(ta), 1e-4) as a
      from binned join (select feature, sum(case when is_test then 0 else n end) as te, sum(case when is_test then n else 0 end) as ta from binned group by feature) using (feature) group by feature, bin""",
    "psis": "select feature, sum((a - e) * ln(a / e)) as psi from shares group by feature",
    "contrib": "select loan_id, unnest([" + ", ".join(f"'{f}'" for f in COLUMNS) + "]) as feature, unnest(range(30)) as position, unnest([" + ", ".join(f"({q(f)} - {m}) / {s} * {c}" for f, m, s, c in zip(FIXED.features, FIXED.means, FIXED.stds, FIXED.coefs, strict=True)) + "]) as contribution, unnest([" + ", ".join(q(f) for f in COLUMNS) + "]) as value from mat",
    "ranked": "select *, row_number() over (partition by loan_id order by contribution desc, position) as rank from contrib where contribution > 0",
    "par": "select state as grp, count(*) as n, avg(pd_raw) as mean_predicted, avg(y) as realised, avg(pd_raw) - avg(y) as gap from (select *, raw as pd_raw from sc) group by state",
    "gsize": "select state as grp, count(*) as n, cast(least(10, greatest(2, floor(count(*) / 20.0))) as integer) as k from sc group by state having count(*) >= 30",
    "blocked": f"select loan_id, y, z, [{', '.join(part(f) for f in COLUMNS)}] as p, {seeded(SEED, 'loan_id')} % cast(ceil(count(*) over () / {BLOCK}.0) as bigint) as block, {seeded(SEED + 1, 'loan_id')} as mark from sc",
    "placed": "select *, row_number() over (partition by block order by mark, loan_id) as i, count(*) over (partition by block) as n from blocked",
    "dealt": f"""select b + 1 as b, avg(pow(1 / (1 + exp(-(own.z - own.p[b + 1] + donor.p[b + 1]))) - own.y, 2)) as loss
      from placed own, range(1, {REPEATS + 1}) as t(r), range(0, {len(COLUMNS)}) as u(b) join placed donor on donor.block = own.block and donor.i = (own.i + r - 1) % own.n + 1 group by b""",
    "worse": f"select [{', '.join(repr(f) for f in COLUMNS)}][b] as feature, b as position, greatest(0, loss - (select avg(pow(1 / (1 + exp(-z)) - y, 2)) from sc)) as w from dealt",
    "import": "select feature, position, case when sum(w) over () > 0 then w / sum(w) over () else 0 end as importance from worse",
    "relia": "select cast(b - 1 as integer) as bin, count(*) as n, avg(pd) as mean_predicted, avg(y) as realised, min(pd) as p_lo, max(pd) as p_hi from (select *, ntile(10) over (order by pd, y, loan_id) as b from sc) group by b",
    "decis": "select cast(b as integer) as bin, count(*) as n, avg(pd) as mean_predicted, avg(y) as realised, avg(y) / (select avg(y) from sc) as lift from (select *, ntile(10) over (order by pd desc, loan_id) as b from sc) group by b",
    "alls": "select feature, value, row_number() over (partition by feature order by value) as i, count(*) over (partition by feature) as n from plong",
    "marked": f"select loan_id, row_number() over (order by {seeded(SEED, 'loan_id')}, loan_id) <= greatest(1, floor(count(*) over () * {TEST_SHARE})) as is_test from mat",
    "shown": f"""select 'in_sample' as protocol, y, pd from sc where vintage <= {LAST_TRAIN} union all select 'oot', y, pd from sc where vintage > {LAST_TRAIN}
      union all select 'naive', y, pd from sc join marked using (loan_id) where is_test
      union all select 'first', y, pd from sc union all select 'second', y, round(1 / (1 + exp(-(-1.0 + (fico - 700.0) / 69.0 * -0.7 + (oltv - 68.0) / 17.0 * 0.2))), 9) from mat""",
    "shownrank": "select *, rank() over (partition by protocol order by pd) + (count(*) over (partition by protocol, pd) - 1) / 2.0 as rk from shown",
    "figures": """select protocol, cast(count(*) as double) as n, avg(y) as realised, avg(pd) as mean_predicted, avg(y) / avg(pd) as ratio,
        (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) as auc, avg((pd - y) * (pd - y)) as brier,
        avg(y) * (1 - avg(y)) as climatology, 1 - avg((pd - y) * (pd - y)) / (avg(y) * (1 - avg(y))) as skill from shownrank group by protocol""",
    "longfig": "select protocol, unnest(['n', 'realised', 'mean_predicted', 'ratio', 'auc', 'brier', 'climatology', 'skill']) as metric, unnest([n, realised, mean_predicted, ratio, auc, brier, climatology, skill]) as value from figures",
    "kcuts": "select feature, k, list(distinct value) as c from alls, range(2, 11) as t(k), range(1, 10) as u(b) where b < k and i = (b * n + k - 1) // k group by feature, k",
    "kall": "select feature, k, len(list_filter(coalesce(c, []), lambda e: e < value)) as bin, count(*) as e from plong cross join range(2, 11) as t(k) left join kcuts using (feature, k) group by all",
    "kgrp": "select feature, grp, k, len(list_filter(coalesce(c, []), lambda e: e < value)) as bin, count(*) as a from plong join gsize using (grp) left join kcuts using (feature, k) group by all",
    "power": """select feature, max(psi) as power from (select feature, grp, sum((greatest(coalesce(a, 0) / n, 1e-4) - greatest(e / te, 1e-4)) * ln(greatest(coalesce(a, 0) / n, 1e-4) / greatest(e / te, 1e-4))) as psi
      from kall join gsize using (k) join (select feature, k, sum(e) as te from kall group by feature, k) using (feature, k) left join kgrp using (feature, grp, k, bin) group by feature, grp) group by feature""",
}
#: The rows whose proxy power is asked; the second holds a planted proxy.
PLONG = "select * from long where feature <> 'pd'"
PLANTED = PLONG + " union all select loan_id, is_test, state, 'planted', case when state = 'CHINA' then 100.0 else 0.0 end from sp"


def with_parts(select: str, plong: str = PLONG) -> str:
    parts = {}
    for name, sql in PARTS.items():
        if name == "alls":
            parts["plong"] = plong
        parts[name] = sql
    used, wanted = [], select
    for name in reversed(parts):
        if re.search(rf"\b{name}\b", wanted):
            used.insert(0, name)
            wanted += " " + parts[name]
    return "with " + ",\n".join(f"{n} as ({parts[n]})" for n in used) + "\n" + select


def rd(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 as {q(name or c.strip(chr(34)))}"


SELECTS = {
    "parse_acquisition": f"select {', '.join('cast(orig_date as varchar) as orig_date' if c == 'orig_date' else c for c in ACQ_SHOWN)} from acq",
    "parse_performance": "select loan_id, cast(period as varchar) as period, loan_age, dlq_status, zb_code from perf",
    "load_stats": "select count(*) as rows_read, count(*) filter (where faulty = 0) as rows_ok, count(*) filter (where faulty = 1) as rows_skipped from (select case when loan_id like '%007' or loan_id like '%013' then 1 else 0 end as faulty from acq)",
    "rejected_rows": "select loan_id, case when loan_id like '%007' then 'expected 25 fields, found 24' else 'num_borrowers: no int: n/a' end as reason from acq where loan_id like '%007' or loan_id like '%013'",
    "delinquency_months": "select case when upper(trim(dlq_status)) not in ('X', '') then cast(dlq_status as integer) end as months, count(*) as n from perf group by 1",
    "loan_labels": "select * replace (cast(orig_date as varchar) as orig_date) from lab",
    "vintage_cohorts": "select vintage, count(*) as n_loans, count(*) filter (where d90) as n_d90, count(*) filter (where d180) as n_d180, count(*) filter (where prepaid) as n_prepaid, count(*) filter (where d90 is null) as n_censored, count(d90) as n_determinable, round(count(*) filter (where d90) / nullif(count(d90), 0), 6) as d90_rate from lab group by vintage",
    "benchmark_spread": f"select loan_id, rate as benchmark, {rd('orig_rate - rate', 'rate_spread')} from acq join bench on y = year(orig_date)",
    "feature_table": f"select loan_id, vintage, y, {', '.join(rd(c) for c in NUMBERS)}, {', '.join(VOCAB)} from loanrows",
    "design_matrix": f"select loan_id, vintage, y, {', '.join(rd(q(c)) for c in COLUMNS)} from mat",
    "join_accounting": """select count(acq_id) as n_acquisitions, count(*) filter (where acq_id is not null and lab_id is not null) as n_joined, count(*) filter (where fate = 'row') as n_rows,
      count(*) filter (where fate = 'censored') as n_censored_excluded, count(*) filter (where fate = 'missing') as n_missing_required, count(*) filter (where fate = 'no_acquisition') as n_label_without_acq,
      count(*) filter (where fate = 'no_label') as n_acq_without_label, count(distinct lab_id) as n_labels from fated""",
    "missing_by_field": "select case when fico is null then 'fico' when oltv is null then 'oltv' when dti is null then 'dti' when orig_rate is null then 'orig_rate' else 'log_upb' end as missing_field, count(*) as n from fated where fate = 'missing' group by 1",
    "vintage_split": f"select vintage, vintage > {LAST_TRAIN} as is_test, count(*) as n from mat group by 1, 2",
    "score_fixed_model": f"select loan_id, {rd('raw', 'pd')} from sc",
    "auc": f"select {rd('auc')} from onerow",
    "brier": f"select n, {rd('brier')} from onerow",
    "brier_skill": f"select {rd('climatology')}, {rd('1 - brier / climatology', 'skill')} from onerow",
    "calibration_in_large": f"select {rd('mean_predicted')}, {rd('realised')}, {rd('realised / mean_predicted', 'ratio')} from onerow",
    "reliability_quantile": f"select bin, n, {rd('mean_predicted')}, {rd('realised')}, {rd('p_lo')}, {rd('p_hi')} from relia",
    "reliability_uniform": f"select bin, count(*) as n, {rd('avg(pd)', 'mean_predicted')}, {rd('avg(y)', 'realised')}, {rd('bin / 10.0', 'p_lo')}, {rd('(bin + 1) / 10.0', 'p_hi')} from (select *, cast(least(9, floor(pd * 10)) as integer) as bin from sc) group by bin",
    "decile_table": f"select bin as decile, n, {rd('mean_predicted')}, {rd('realised')}, {rd('lift')} from decis",
    "evaluation_full": """select 'overall' as part, 0 as bin, unnest(['n', 'realised', 'mean_predicted', 'ratio', 'auc', 'brier', 'climatology', 'skill']) as metric, round(unnest([n, realised, mean_predicted, realised / mean_predicted, auc, brier, climatology, 1 - brier / climatology]), 6) as value from onerow
      union all select 'reliability', bin, unnest(['n', 'mean_predicted', 'realised', 'p_lo', 'p_hi']), round(unnest([n, mean_predicted, realised, p_lo, p_hi]), 6) from relia
      union all select 'decile', bin, unnest(['n', 'mean_predicted', 'realised', 'lift']), round(unnest([n, mean_predicted, realised, lift]), 6) from decis""",
    "hash_split": f"select loan_id, row_number() over (order by {seeded(SEED, 'loan_id')}, loan_id) <= greatest(1, floor(count(*) over () * {TEST_SHARE})) as is_test from mat",
    "permutation_importance": f"select feature, {rd('importance')} from import",
    "top_importances": f"select cast(row_number() over (order by import.importance desc, position) as integer) as rank, feature, {rd('import.importance', 'importance')} from import order by import.importance desc, position limit 5",
    "custom_benchmark": f"""select loan_id, {rd('l.orig_rate - rate', 'rate_spread')}, {rd('l.ocltv - l.oltv', 'second_lien')} from loanrows l join acq a using (loan_id)
      join (select yr, arg_min(rate, abs(yr - year) * 1000 + pos) as rate from (select distinct year(orig_date) as yr from acq), {OWN} group by yr) on yr = year(a.orig_date)""",
    "evaluation_report": "select unnest(['n', 'realised', 'mean_predicted', 'ratio', 'auc', 'brier', 'climatology', 'skill']) as metric, unnest([round(n, 6), round(realised, 6), round(mean_predicted, 6), round(realised / mean_predicted, 6), round(auc, 6), round(brier, 6), round(climatology, 6), round(1 - brier / climatology, 6)]) as value from onerow",
    "quantile_cuts": "select distinct percentile as cut from (select unnest(percentile_list) as percentile from (select quantile_disc(fico, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as percentile_list from mat))",
    "psi_score": f"select feature, {rd('psi')} from psis where feature = 'pd'",
    "psi_features": f"select feature, cast(position as integer) as position, {rd('psi')} from psis join pos using (feature)",
    "top_drifted": f"select feature, {rd('psi')} from psis join pos using (feature) order by psis.psi desc, position limit 5",
    "contributions": f"select loan_id, feature, {rd('contribution')} from contrib",
    "reason_codes": f"select loan_id, cast(rank as integer) as rank, feature, {rd('contribution')}, {rd('value')} from ranked where rank <= 4",
    "explained_loans": f"select loan_id, {rd('raw', 'pd')}, {rd('z', 'log_odds')}, coalesce(n, 0) as n_reasons, first as first_reason from sc left join (select loan_id, least(4, count(*)) as n, arg_min(feature, rank) as first from ranked group by loan_id) using (loan_id)",
    "group_attach": """select coalesce(a.state, 'UNKNOWN') as grp, count(*) as n from mat m left join (
      select case when loan_id like '%3' then concat('X', loan_id) else loan_id end as loan_id, case when loan_id like '%5' then concat('A ', state) when loan_id not like '%7' then state end as state from acq) a using (loan_id) group by 1""",
    "labels_over_deltas": "select * replace (cast(orig_date as varchar) as orig_date) from lab",
    "saved_and_scored": f"select loan_id, {rd('raw', 'pd')} from sc",
    "gzip_acquisitions": f"select {', '.join('cast(orig_date as varchar) as orig_date' if c == 'orig_date' else c for c in ACQ_SHOWN)} from acq",
    "rejected_lines": """select cast(year(orig_date) as varchar) as year, line, loan_id, case when loan_id like '%007' then 'expected 25 fields, found 24' else 'num_borrowers: no int: n/a' end as reason
      from (select *, row_number() over (partition by year(orig_date) order by loan_id) as line from acq) where loan_id like '%007' or loan_id like '%013'""",
    "labels_horizon_12": "select * replace (cast(orig_date as varchar) as orig_date) from lab",
    "label_faults": """select case when loan_id like '%63' then 'no loan_id' when loan_id like '%42' then 'no loan_age' else 'unknown dlq_status' end as reason, count(*) as n
      from perf where loan_id like '%63' or loan_id like '%42' or loan_id like '%21' group by 1""",
    "d180_matrix": """select l.vintage, cast(l.d180 as integer) as y, count(*) as n from feat f join lab l on l.loan_id = f.lab_id
      where acq_id is not null and l.d180 is not null and fico is not null and oltv is not null and dti is not null and orig_rate is not null and log_upb is not null group by 1, 2""",
    "standardised": "select loan_id, " + ", ".join(rd(f"({q(f)} - avg({q(f)}) over ()) / stddev_pop({q(f)}) over ()", f) for f in ("fico", "log_upb", "purpose=C")) + " from mat",
    "one_loan": f"select loan_id, {rd('raw', 'pd')}, {rd('z', 'log_odds')}, (select least(4, count(*)) from ranked r where r.loan_id = sc.loan_id) as n_reasons from sc where loan_id = (select max(loan_id) from sc)",
    "reason_phrases": "select [" + ", ".join(repr(phrase(f)) if "'" not in phrase(f) else "'" + phrase(f).replace("'", "''") + "'" for f in COLUMNS) + "][position + 1] as phrase, count(*) as n from ranked where rank <= 4 group by 1",
    "saved_report": f"select metric, {rd('value')} from longfig where protocol = 'first'",
    "gzip_by_extension": "select loan_id, cast(period as varchar) as period, loan_age, dlq_status, zb_code from perf",
    "oot_fixed_model": f"select protocol, metric, {rd('value')} from longfig where protocol in ('in_sample', 'oot', 'naive')",
    "headline_fixed_model": f"""select cast(list_position(['n', 'realised', 'mean_predicted', 'ratio', 'auc', 'brier', 'skill'], a.metric) - 1 as integer) as position, a.metric, {rd('a.value', 'naive')}, {rd('b.value', 'oot')}
      from longfig a join longfig b on a.metric = b.metric and a.protocol = 'naive' and b.protocol = 'oot' where a.metric <> 'climatology'""",
    "comparison_fixed_models": f"select a.metric, {rd('a.value', 'first')}, {rd('b.value', 'second')}, {rd('b.value - a.value', 'delta')} from longfig a join longfig b on a.metric = b.metric and a.protocol = 'first' and b.protocol = 'second'",
    "logistic_certificate": f"select unnest({['(intercept)', *COLUMNS]}) as parameter, cast(0 as double) as gradient from onerow where n > 0",
    "group_parity": f"select grp, n, {rd('mean_predicted')}, {rd('realised')}, {rd('gap')} from par",
    "group_pooling": "select case when n < 30 then 'OTHER' else g end as grp, cast(sum(n) as bigint) as n from (select concat(state, '-', cast(vintage as varchar)) as g, count(*) as n from mat group by 1) group by 1",
    "proxy_power": f"select feature, {rd('power')} from power",
    "proxy_flags": f"select feature, {rd('power')} from (select * from power order by power.power desc limit 5) where power >= 0.25",
    "fairness_audit": "select grp as name, unnest(['n', 'mean_predicted', 'realised', 'gap']) as figure, unnest([cast(n as double), round(mean_predicted, 6), round(realised, 6), round(gap, 6)]) as value from par union all select feature, 'power', round(power.power, 6) from power",
    "worst_group": f"select grp, {rd('gap')} from par order by par.gap desc limit 1",
}


def oracle() -> dict[str, str]:
    made = {name: with_parts(sql, PLANTED if name == "proxy_flags" else PLONG) for name, sql in SELECTS.items()}
    made["labels_horizon_12"] = re.sub(r"\b36\b", "12", made["labels_horizon_12"])  # the horizon, and nothing else there
    return made
