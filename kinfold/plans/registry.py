"""Registered queries by name, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import storage
from kinfold.functions import similarity as S
from kinfold.functions import tables as T
from kinfold.functions import text
from kinfold.operators import blocking as B
from kinfold.operators import decode as D
from kinfold.operators import evaluate as E
from kinfold.operators import features as X
from kinfold.operators import learn as L
from kinfold.operators import profile as P
from kinfold.operators import validate as V
from kinfold.session import ship

from . import fixtures as X0
from . import normal_sql as N
from . import runs as R
from . import similarity_sql as Q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The thresholds of the golden decode.
GOLDEN = D.DecodeConfig(gate=0.3, pair=0.7)
GATES, PAIRS, RELS = (0.2, 0.4, 0.6, 0.8), (0.5, 0.6, 0.7, 0.8, 0.9), (0.0, 0.9)


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            return fn(ship(spark), sf_dir)

        run.__doc__, run.__name__ = fn.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums differ in their last bits from engine to engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


# --- scored candidates: decoding and evaluation ---------------------------------------------

F05 = "case when t = 0 then (case when k = 0 then 1.0 else 0.0 end) when k = 0 or h = 0 then 0.0 else 1.25 * h / (k + 0.25 * t) end"
_KEPT = """
m as (select *, max(prob) over (partition by s1_id) >= 0.3 and prob >= 0.7 as kept, row_number() over (partition by s1_id order by prob desc, cand_id) - 1 as rank from a),
n as (select s1_id, count(*) filter (where kept and label) as h, count(*) filter (where kept) as k from m group by 1),
p as (
  select s1_id, grp, h, k, t, (@F05)::double as score,
    case when t = 0 and k = 0 then 'singleton_ok' when t = 0 then 'singleton_false_merge' when k = 0 then 'gated_shut' when h = t and k = h then 'exact' else 'partial' end as outcome
  from (select e.s1_id, grp, coalesce(h, 0) as h, coalesce(k, 0) as k, n_true as t from e left join n on n.s1_id = e.s1_id)
)"""


_KEPT = _KEPT.replace("@F05", F05.replace("1.0", "1.0::double").replace("0.0", "0.0::double"))
KEPT, KEPT_MISSES = f"{X0.SCORED_SQL},{_KEPT}", f"{X0.MISSES_SQL},{_KEPT}"


def _marked(spark, sf_dir, cfg=GOLDEN, misses=False) -> DataFrame:
    return D.marked(D.assign_owner(X0.scored_with_misses(spark, sf_dir)) if misses else X0.owned(spark, sf_dir), cfg)


def _table(spark, sf_dir, misses=False) -> DataFrame:
    return E.entity_counts(_marked(spark, sf_dir, misses=misses), X0.entities(spark, sf_dir))


@query("scored_candidates", f"with {X0.SCORED_SQL} select s1_id, cand_id, prob, label, source, array_to_string(keys, '|') as keys from c")
def scored_candidates(spark, sf_dir):
    return joined(X0.scored(spark, sf_dir), "keys")


@query("one_owner_assignment", f"with {X0.SCORED_SQL} select s1_id, cand_id, prob from a")
def one_owner_assignment(spark, sf_dir):
    return X0.owned(spark, sf_dir).select("s1_id", "cand_id", "prob")


@query("decode_threshold", f"with {KEPT} select s1_id, cand_id, rank::int as rank from m where kept")
def decode_threshold(spark, sf_dir):
    return _marked(spark, sf_dir).where("kept").select("s1_id", "cand_id", F.col("rank").cast("int").alias("rank"))


@query(
    "decode_any_gate",
    f"""with {X0.SCORED_SQL}, g as (select *, 1 - exp(sum(ln(1 - least(greatest(prob, 0.0), 1 - 1e-12))) over (partition by s1_id)) as gate, max(prob) over (partition by s1_id) as best from a)
select s1_id, cand_id from g where gate >= 0.95 and prob >= 0.5 and prob >= 0.8 * best""",
)
def decode_any_gate(spark, sf_dir):
    return _marked(spark, sf_dir, D.DecodeConfig(gate=0.95, gate_source="any", pair=0.5, rel=0.8)).where("kept").select("s1_id", "cand_id")


@query(
    "decode_caps",
    f"""with {X0.SCORED_SQL}, g as (select *, row_number() over (partition by s1_id order by prob desc, cand_id) as r, row_number() over (partition by s1_id, source order by prob desc, cand_id) as q, max(prob) over (partition by s1_id) as best from a)
select s1_id, cand_id from g where best >= 0.3 and prob >= 0.4 and r <= 2 and q <= 1""",
)
def decode_caps(spark, sf_dir):
    return _marked(spark, sf_dir, D.DecodeConfig(gate=0.3, pair=0.4, max_k=2, max_per_source=1)).where("kept").select("s1_id", "cand_id")


_EXPECTED = f"""with {X0.SCORED_SQL},
l as (select s1_id, list(prob order by prob desc, cand_id) as ps, list(cand_id order by prob desc, cand_id) as cs from a group by 1),
w as (select s1_id, ps, unnest(range(0, (1 << len(ps))::bigint)) as world from l),
v as (select s1_id, len(ps) as n, list_product([case when (world >> (i - 1)) & 1 = 1 then ps[i] else 1 - ps[i] end for i in range(1, len(ps) + 1)]) as weight, world, bit_count(world) as t from w),
k as (select s1_id, k, sum(weight * case when t = 0 then 0.0 else 1.25 * bit_count(world & ((1::bigint << k) - 1)) / (k + 0.25 * t) end) as value from (select *, unnest(range(1, n + 1)) as k from v where weight > 0) group by 1, 2
  union all select s1_id, 0, coalesce(sum(weight) filter (where t = 0), 0) from v group by 1),
best as (select s1_id, min(k) as k from (select *, max(value) over (partition by s1_id) as top from k) where value >= top - 1e-10 group by 1)
select s1_id, unnest(cs[1:k]) as cand_id, unnest(ps[1:k]) as prob from l join best using (s1_id) where k > 0"""


@query("expected_f_decode", _EXPECTED)
def expected_f_decode(spark, sf_dir):
    """Sets of the largest expected F0.5 (exact, by dynamic programming)."""
    return _marked(spark, sf_dir, D.DecodeConfig(mode="expected_f")).where("kept").select("s1_id", "cand_id", "prob")


@query("per_entity", f"with {KEPT} select s1_id, h::bigint as hits, k::bigint as n_pred, t::bigint as n_true, round(score, 6) as score, (k - h)::bigint as fp, (t - h)::bigint as fn, outcome from p")
def per_entity(spark, sf_dir):
    pred = _marked(spark, sf_dir).where("kept")
    truth = X0.scored(spark, sf_dir).where("label")
    return rounded(E.per_entity(pred, truth, X0.entities(spark, sf_dir).select("s1_id")))


REPORT_SQL = """count(*) as n, avg(score) as score, avg((t = 0)::int) as singleton_frac, avg(case when t = 0 then (k = 0)::int end) as spec,
  avg(case when t > 0 then (k > 0)::int end) as open_rate, avg(case when t > 0 and k > 0 then score end) as f_open, avg(case when t > 0 then score end) as f_matched,
  sum(h) / sum(k) as pair_precision, sum(h) / sum(t) as pair_recall, avg(case when t > 0 then (outcome = 'exact')::int end) as exact_rate"""
_OUTCOMES = ", ".join(f"count(*) filter (where outcome = '{o}') as {o}" for o in E.OUTCOMES)
_ROUND = ", ".join(f"round({c}, 6) as {c}" for c in "score singleton_frac spec open_rate f_open f_matched pair_precision pair_recall exact_rate".split())


@query("report", f"with {KEPT} select n, {_ROUND}, {', '.join(E.OUTCOMES)} from (select {REPORT_SQL}, {_OUTCOMES} from p)")
def report(spark, sf_dir):
    """The macro F0.5 of one-owner threshold decoding and what it is made of."""
    return rounded(E.report(_table(spark, sf_dir)))


@query("report_with_misses", f"with {KEPT_MISSES} select n, {_ROUND}, {', '.join(E.OUTCOMES)} from (select {REPORT_SQL}, {_OUTCOMES} from p)")
def report_with_misses(spark, sf_dir):
    """The same where blocking misses true pairs: they count against the score."""
    return rounded(E.report(_table(spark, sf_dir, misses=True)))


@query("report_by_group", f"with {KEPT} select grp, count(*) as n, round(avg(score), 6) as score, round(sum(1 - score) / (select sum(1 - score) from p), 6) as loss_share from p group by grp")
def report_by_group(spark, sf_dir):
    return rounded(E.by_group(_table(spark, sf_dir)))


@query("report_by_size", f"with {KEPT} select case when t >= 3 then '3+' else t::varchar end as n_true, count(*) as n, round(avg(score), 6) as score from p group by 1")
def report_by_size(spark, sf_dir):
    return rounded(E.by_true_size(_table(spark, sf_dir)))


@query("projection", f"with {KEPT} select round(singleton_frac * spec + (1 - singleton_frac) * open_rate * f_open, 6) as projected, round(score, 6) as score from (select {REPORT_SQL} from p)")
def projection(spark, sf_dir):
    return rounded(E.project(E.report(_table(spark, sf_dir))))


_VALUES = lambda name, xs: f"(select * from (values {', '.join(f'({i}, {x}::double)' for i, x in enumerate(xs))}) v({name}_i, {name}))"
_GRID = f"""
b as (select *, max(prob) over (partition by s1_id) as best from a),
cfg as (select * from {_VALUES("gate", GATES)}, {_VALUES("pair", PAIRS)}, {_VALUES("rel", RELS)}),
k as (select gate_i, pair_i, rel_i, s1_id, count(*) as k, count(*) filter (where label) as h from b, cfg where best >= gate and prob >= pair and (rel <= 0 or prob >= rel * best) group by all),
x as (
  select gate_i, pair_i, rel_i, gate, pair, rel, t, k, {F05} as f
  from (select cfg.*, e.s1_id, n_true as t, coalesce(k, 0) as k, coalesce(h, 0) as h from cfg cross join e left join k using (gate_i, pair_i, rel_i, s1_id))
), s as (
  select gate_i, pair_i, rel_i, gate, pair, rel, avg(f) as score, avg((k = 0)::int) filter (where t = 0) as spec, avg((k > 0)::int) filter (where t > 0) as open_rate,
    coalesce(avg(f) filter (where t > 0 and k > 0), 0) as f_open, coalesce(avg(k) filter (where k > 0), 0) as avg_set_size from x group by all
)
select x.gate, x.pair, x.rel, round(x.score, 6) as score, round(x.spec, 6) as spec, round(x.open_rate, 6) as open_rate, round(x.f_open, 6) as f_open, round(x.avg_set_size, 6) as avg_set_size, round(avg(y.score), 6) as score_smooth
from s x join s y on abs(x.gate_i - y.gate_i) + abs(x.pair_i - y.pair_i) + abs(x.rel_i - y.rel_i) <= 1 group by all"""
GRID = {"gate": GATES, "pair": PAIRS, "rel": RELS}


@query("grid_search", f"with {X0.SCORED_SQL},{_GRID}")
def grid_search(spark, sf_dir):
    return rounded(E.grid_search(X0.owned(spark, sf_dir), X0.entities(spark, sf_dir), GRID))


@query("grid_search_with_misses", f"with {X0.MISSES_SQL},{_GRID}")
def grid_search_with_misses(spark, sf_dir):
    """The grid where blocking misses true pairs."""
    return rounded(E.grid_search(D.assign_owner(X0.scored_with_misses(spark, sf_dir)), X0.entities(spark, sf_dir), GRID))


_CAPS_GRID = f"""
r as (select *, row_number() over (partition by s1_id order by prob desc, cand_id::varchar) as r, row_number() over (partition by s1_id, source order by prob desc, cand_id::varchar) as q,
  1 - exp(sum(ln(1 - least(greatest(prob, 0.0), 1 - 1e-12))) over (partition by s1_id)) as gate from a),
cfg as (select * from (values (0, 1), (1, 2)) v(i, max_k), (values (0, 1), (1, 3)) w(j, max_per_source)),
k as (select i, j, s1_id, count(*) as k, count(*) filter (where label) as h from r, cfg where gate >= 0.95 and prob >= 0.4 and r <= max_k and q <= max_per_source group by all),
s as (select i, j, max_k, max_per_source, avg({F05}) as score from (select cfg.*, n_true as t, coalesce(k, 0) as k, coalesce(h, 0) as h from cfg cross join e left join k using (i, j, s1_id)) group by all)
select x.max_k, x.max_per_source, round(x.score, 6) as score, round(avg(y.score), 6) as score_smooth from s x join s y on abs(x.i - y.i) + abs(x.j - y.j) <= 1 group by all"""


@query("grid_search_caps", f"with {X0.MISSES_SQL},{_CAPS_GRID}")
def grid_search_caps(spark, sf_dir):
    """Any field of the configuration can be an axis: here the caps, behind a noisy-or gate."""
    base = D.DecodeConfig(gate=0.95, gate_source="any", pair=0.4)
    grid = E.grid_search(D.assign_owner(X0.scored_with_misses(spark, sf_dir)), X0.entities(spark, sf_dir), {"max_k": (1, 2), "max_per_source": (1, 3)}, base)
    return rounded(grid.select("max_k", "max_per_source", "score", "score_smooth"))


_ORACLES = f"""
reach as (select s1_id, count(*) filter (where prob >= 0.7) as open_size, count(*) filter (where prob >= 0.7 and label) as open_hits, count(*) filter (where label) as true_ones, bool_or(rank = 0 and label)::int as first_hit from m group by 1),
q as (select t, h, k, coalesce(open_size, 0) as open_size, coalesce(open_hits, 0) as open_hits, coalesce(true_ones, 0) as true_ones, coalesce(first_hit, 0) as first_hit, (reach.s1_id is not null)::int as first_size from p left join reach using (s1_id)),
got as (
  select 'current' as scenario, t, h, k from q
  union all select 'perfect gate', t, case when t > 0 then case when open_size > 0 then open_hits else first_hit end else 0 end, case when t > 0 then case when open_size > 0 then open_size else first_size end else 0 end from q
  union all select 'perfect sets', t, case when k > 0 and t > 0 then true_ones else h end, case when k > 0 and t > 0 then true_ones else k end from q
  union all select 'blocking ceiling', t, true_ones, true_ones from q),
means as (select scenario, avg({F05}) as macro_f05 from got group by 1 union all select 'perfect blocking', 1.0)
select scenario, round(macro_f05, 6) as macro_f05, round(macro_f05 - (select macro_f05 from means where scenario = 'current'), 6) as gain_vs_current from means"""


def _oracles(spark, sf_dir, misses=False):
    opened = _marked(spark, sf_dir, D.DecodeConfig(gate=float("-inf"), pair=0.7), misses)
    return rounded(E.oracles(_marked(spark, sf_dir, misses=misses), opened, X0.entities(spark, sf_dir)))


@query("oracles", f"with {KEPT},{_ORACLES}")
def oracles(spark, sf_dir):
    return _oracles(spark, sf_dir)


@query("oracles_with_misses", f"with {KEPT_MISSES},{_ORACLES}")
def oracles_with_misses(spark, sf_dir):
    return _oracles(spark, sf_dir, misses=True)


@query(
    "error_pairs_with_misses",
    f"""with {KEPT_MISSES} select case when label and not kept then 'model_miss' when n_true = 0 then 'false_merge_singleton' else 'false_merge_matched' end as kind, s1_id, cand_id, prob
from m join e using (s1_id) where label <> kept union all select 'blocking_miss', s1_id, cand_id, null from (select * from c0 where label) anti join c using (s1_id, cand_id)""",
)
def error_pairs_with_misses(spark, sf_dir):
    """Wrong pairs by cause, those that blocking missed among them."""
    truth = X0.scored(spark, sf_dir).where("label").select("s1_id", "cand_id")
    return E.error_pairs(_marked(spark, sf_dir, misses=True), truth, X0.entities(spark, sf_dir))


@query(
    "error_pairs",
    f"""with {KEPT} select case when label and not kept then 'model_miss' when n_true = 0 then 'false_merge_singleton' else 'false_merge_matched' end as kind, s1_id, cand_id, prob
from m join e using (s1_id) where label <> kept""",
)
def error_pairs(spark, sf_dir):
    """Wrong pairs by cause; here every true pair is a candidate, so none was missed by blocking."""
    truth = X0.scored(spark, sf_dir).where("label").select("s1_id", "cand_id")
    return E.error_pairs(_marked(spark, sf_dir), truth, X0.entities(spark, sf_dir))


CAL_SQL = f"with {X0.SCORED_SQL}, b as (select greatest(1, ceil(prob * 10))::int as bin, count(*) as n, avg(prob) as mean_prob, avg(label::int) as match_rate from c group by 1)"


@query("calibration", f"{CAL_SQL} select bin, n, round(mean_prob, 6) as mean_prob, round(match_rate, 6) as match_rate, round(mean_prob - match_rate, 6) as gap from b")
def calibration(spark, sf_dir):
    return rounded(E.calibration(X0.scored(spark, sf_dir)))


@query("calibration_error", f"{CAL_SQL} select round(sum(n * abs(mean_prob - match_rate)) / sum(n), 6) as ece from b")
def calibration_error(spark, sf_dir):
    return rounded(E.calibration_error(E.calibration(X0.scored(spark, sf_dir))))


FOLD_SQL = f"""with {X0.SCORED_SQL}, s as (select *, (case when n_true >= 3 then '3+' else n_true::varchar end) || '|' || grp as stratum, md5(s1_id::varchar || ':0') as o from e),
f as (select *, ((row_number() over (partition by stratum order by o, s1_id) - 1 + ('0x' || substr(md5(stratum), 1, 8))::bigint % 3) % 3)::int as fold from s)"""


@query("kfold", f"{FOLD_SQL} select s1_id, fold from f")
def kfold(spark, sf_dir):
    return E.kfold(X0.entities(spark, sf_dir)).select("s1_id", "fold")


@query("kfold_balance", f"{FOLD_SQL} select fold, count(*) as n, round(avg((n_true = 0)::int), 6) as singleton_frac, round(avg(n_true), 6) as mean_true from f group by 1")
def kfold_balance(spark, sf_dir):
    return rounded(E.fold_balance(E.kfold(X0.entities(spark, sf_dir))))


@query("match_histogram", f"with {X0.SCORED_SQL} select n_true, count(*) as entities from e group by 1")
def match_histogram(spark, sf_dir):
    return P.match_histogram(X0.entities(spark, sf_dir))


@query("target_reuse", f"with {X0.SCORED_SQL} select count(*) as targets, sum(n)::bigint as links, max(n) as most from (select cand_id, count(distinct s1_id) as n from c where label group by 1)")
def target_reuse(spark, sf_dir):
    return P.target_reuse(X0.scored(spark, sf_dir).where("label"))


@query("scored_blocking_audit", f"""with {X0.SCORED_SQL}, q as (select e.s1_id, n_true as t, coalesce(n, 0) as n_cand, coalesce(h, 0) as h from e left join (select s1_id, count(*) as n, count(*) filter (where label) as h from c group by 1) using (s1_id))
select sum(n_cand)::bigint as n_candidate_pairs, round(avg(n_cand), 6) as cands_mean, quantile_cont(n_cand, 0.5)::double as cands_p50, quantile_cont(n_cand, 0.95)::double as cands_p95, max(n_cand) as cands_max, count(*) filter (where n_cand = 0) as zero_cand_entities,
  round(sum(h) / sum(t), 6) as pair_recall, round(avg(case when t > 0 then (h = t)::int end), 6) as entity_full_recall, round(avg(case when t > 0 then (h > 0)::int end), 6) as entity_any_hit, round(sum(h) / sum(n_cand), 6) as pair_precision,
  round(avg(case when t = 0 then 1.0 when h = 0 then 0.0 else 1.25 * h / (h + 0.25 * t) end), 6) as macro_f05_ceiling, round(1 - sum(n_cand) / (count(*) * 1000.0), 6) as reduction_ratio from q""")  # fmt: skip
def scored_blocking_audit(spark, sf_dir):
    c = X0.scored(spark, sf_dir)
    return rounded(E.blocking_audit(c, c.where("label"), X0.entities(spark, sf_dir), n_targets=1000))


@query("scored_per_key", f"with {X0.SCORED_SQL}, x as (select label, len(keys) as n, unnest(keys) as key from c) select key, count(*) as pairs, round(count(*) filter (where label) / (select count(*) from c where label), 6) as pair_recall, round(avg(label::int), 6) as precision, count(*) filter (where label and n = 1) as unique_true_pairs from x group by 1")
def scored_per_key(spark, sf_dir):
    c = X0.scored(spark, sf_dir)
    return rounded(E.per_key(c, c.where("label").agg(F.count("*").alias("n"))))


SUBMISSION = f"""with {KEPT}, l as (select s1_id, string_agg(cand_id::varchar, ',' order by cand_id) as ids from m where kept group by 1),
z as (select e.s1_id::varchar as s1_id, coalesce(ids, '') as ids from e left join l using (s1_id))"""


def _submission(spark, sf_dir) -> DataFrame:
    sets = D.decode(X0.owned(spark, sf_dir), X0.entities(spark, sf_dir), GOLDEN)
    return sets.select(F.col("s1_id").cast("string").alias("s1_id"), F.array_join("cand_ids", ",").alias("ids"))


@query("submission", f"{SUBMISSION} select s1_id, ids from z")
def submission(spark, sf_dir):
    return _submission(spark, sf_dir)


@query("candidate_lists", f"with {X0.SCORED_SQL} select s1_id, string_agg(cand_id::varchar, ',' order by cand_id) as ids from c group by 1")
def candidate_lists(spark, sf_dir):
    return X0.scored(spark, sf_dir).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))


_BAD = "(select s1_id, case when s1_id::bigint % 7 = 0 then ids || ',' || ids when s1_id::bigint % 11 = 0 then s1_id || ',9999999' else ids end as ids from z where s1_id::bigint % 5 <> 0 union all select s1_id, ids from z where s1_id::bigint % 13 = 0 union all select '-5', ' 1')"
CHECKS_SQL = f"""{SUBMISSION}, b as {_BAD}, pp as (select s1_id, ids, [x for x in string_split(ids, ',') if x <> ''] as l from b)
select 'duplicate_rows' as "check", count(*) as n from (select s1_id from b group by 1 having count(*) > 1)
union all select 'unknown_references', count(distinct s1_id) from b where s1_id not in (select s1_id from z)
union all select 'missing_references', count(*) from z where s1_id not in (select s1_id from b)
union all select 'duplicate_ids', sum(len(l) - len(list_distinct(l)))::bigint from pp
union all select 'self_matches', count(*) from pp where list_contains(l, s1_id)
union all select 'inner_space', count(*) from b where regexp_matches(ids, '\\s')
union all select 'unknown_targets', count(*) from (select distinct unnest(l) as t from pp) where t not in (select cand_id::varchar from c)"""


@query("submission_checks", CHECKS_SQL)
def submission_checks(spark, sf_dir):
    """The checks over a result that was spoilt on purpose."""
    z = _submission(spark, sf_dir)
    i = F.col("s1_id").cast("bigint")
    bad = z.where(i % 5 != 0).withColumn("ids", F.when(i % 7 == 0, F.concat("ids", F.lit(","), "ids")).when(i % 11 == 0, F.concat("s1_id", F.lit(",9999999"))).otherwise(F.col("ids")))
    bad = bad.unionByName(z.where(i % 13 == 0)).unionByName(spark.range(1).select(F.lit("-5").alias("s1_id"), F.lit(" 1").alias("ids")))
    return V.violations(bad, X0.entities(spark, sf_dir), X0.scored(spark, sf_dir).select("cand_id"))


_CTX = """p1, ln(least(greatest(p1, 1e-6), 1 - 1e-6) / (1 - least(greatest(p1, 1e-6), 1 - 1e-6))) as p1_logit, rank() over (partition by s1_id order by p1 desc) as p1_rank_s1, max(p1) over s as s1_max_p, max(p1) over s - p1 as p1_gap_best_s1,
  p1 - lead(p1, 1, 0.0) over (partition by s1_id order by p1 desc, cand_id) as p1_gap_next_s1, count(*) filter (where p1 >= 0.5) over s as s1_n_strong, sum(p1) over s as s1_sum_p,
  max(p1) over t as t_max_p, rank() over (partition by cand_id order by p1 desc) as t_rank, count(*) filter (where p1 >= 0.5) over t as t_n_strong"""
_CTX_COLUMNS = "p1_logit p1_rank_s1 p1_gap_best_s1 p1_gap_next_s1 s1_n_strong s1_sum_p s1_max_p t_max_p t_gap_best_other t_rank t_n_strong is_best_for_t".split()


@query("score_context", f"""with {X0.SCORED_SQL}, x as (select s1_id, cand_id, prob as p1 from c), w as (select s1_id, cand_id, {_CTX} from x window s as (partition by s1_id), t as (partition by cand_id)),
o as (select x.s1_id, x.cand_id, coalesce(max(y.p1), 0.0) as other from x left join x y on x.cand_id = y.cand_id and x.s1_id <> y.s1_id group by 1, 2),
z as (select w.*, p1 - other as t_gap_best_other, (p1 >= t_max_p)::int as is_best_for_t from w join o using (s1_id, cand_id))
select s1_id, cand_id, round(p1_logit, 6) as p1_logit, p1_rank_s1::int as p1_rank_s1, round(p1_gap_best_s1, 6) as p1_gap_best_s1, round(p1_gap_next_s1, 6) as p1_gap_next_s1, s1_n_strong, round(s1_sum_p, 6) as s1_sum_p, s1_max_p, t_max_p,
  round(t_gap_best_other, 6) as t_gap_best_other, t_rank::int as t_rank, t_n_strong, is_best_for_t from z""")  # fmt: skip
def score_context(spark, sf_dir):
    df = X.score_context(X0.scored(spark, sf_dir).withColumn("p1", F.col("prob")))
    return rounded(df.select("s1_id", "cand_id", *_CTX_COLUMNS))


def _two_tables(spark, sf_dir):
    """Golden thresholds, and a stricter pair threshold."""
    ents = X0.entities(spark, sf_dir)
    return (E.entity_counts(_marked(spark, sf_dir, D.DecodeConfig(gate=0.3, pair=p)), ents) for p in (0.7, 0.8))


@query("paired_differences", f"""with {KEPT}, m2 as (select s1_id, count(*) filter (where keep and label) as h2, count(*) filter (where keep) as k2 from (select *, max(prob) over (partition by s1_id) >= 0.3 and prob >= 0.8 as keep from a) group by 1),
q as (select score, t, coalesce(h2, 0) as h, coalesce(k2, 0) as k from p left join m2 using (s1_id)) select round({F05} - score, 6) as d, count(*) as n from q group by 1""")  # fmt: skip
def paired_differences(spark, sf_dir):
    """What the paired bootstrap draws from."""
    return rounded(E.differences(*_two_tables(spark, sf_dir))).groupBy("d").agg(F.sum("n").alias("n"))


@query("bootstrap_compare")
def bootstrap_compare(spark, sf_dir):
    """Golden thresholds against a stricter pair threshold, by paired bootstrap."""
    one, two = _two_tables(spark, sf_dir)
    r = E.paired_bootstrap(one, two)
    return spark.createDataFrame([tuple(r.values())], "delta double, lo double, hi double, win_rate double, verdict string")


_ISOTONIC = f"""with {X0.SCORED_SQL}, f as (select s1_id, cand_id, prob, label, ('0x' || substr(md5(s1_id::varchar), 1, 8))::bigint % 3 as fold from c),
x as (select k.fold, f.prob, sum(label::int) as y, count(*) as n from f, (select unnest([0, 1, 2]) as fold) k where f.fold <> k.fold group by all),
s as (select *, sum(y) over w as sy, sum(n) over w as sn from x window w as (partition by fold order by prob)),
r as (select a.fold, a.prob as lo, b.prob as hi, (b.sy - a.sy + a.y) / (b.sn - a.sn + a.n) as mean from s a join s b on a.fold = b.fold and a.prob <= b.prob),
i as (select x.fold, x.prob, lo, min(mean) as low from x join r on r.fold = x.fold and lo <= x.prob and hi >= x.prob group by all),
z as (select fold, prob, least(greatest(max(low), 1e-4), 1 - 1e-4) as p from i group by all)
select s1_id, cand_id, round(z.p, 6) as prob, label from f join z using (fold, prob)"""


@query("isotonic_calibration", _ISOTONIC)
def isotonic_calibration(spark, sf_dir):
    """Isotonic regression as max over lows of min over highs of the means between; the SQL twin is that formula."""
    out = L.calibrate_out_of_fold(X0.scored(spark, sf_dir).select("s1_id", "cand_id", "prob", "label"))
    return rounded(out.select("s1_id", "cand_id", "prob", "label"))


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Out-of-fold scores of boosted trees on the context of each pair."""
    df = X.score_context(X0.scored(spark, sf_dir).withColumn("p1", F.col("prob"))).drop("prob")
    return L.out_of_fold(df, ["p1", "p1_rank_s1", "p1_gap_best_s1", "s1_n_strong", "t_max_p", "t_rank"], k=2, rounds=5, depth=3).select("s1_id", "cand_id", "label", "prob")


# --- records: profile, normalisation, blocking, features --------------------------------------


@query("profile_sources", f"""with {X0.RECORDS_SQL} select src, country, count(*) as n, round(avg((business_name = '')::int), 6) as empty_name, round(avg((business_address = '')::int), 6) as empty_address,
  round(avg(regexp_matches(business_name, '[^\\x00-\\x7F]')::int), 6) as non_ascii, median(length(business_name))::double as median_name, median(length(business_address))::double as median_address from records group by 1, 2""")  # fmt: skip
def profile_sources(spark, sf_dir):
    return rounded(P.profile_sources(X0.records(spark, sf_dir)))


@query("country_summary", f"with {X0.RECORDS_SQL} select src, string_agg(country || ':' || n, ' ' order by n desc, country) as countries from (select src, country, count(*) as n from records group by 1, 2) group by 1")
def country_summary(spark, sf_dir):
    return P.country_summary(X0.records(spark, sf_dir))


@query("dev_subset", f"""with {X0.RECORDS_SQL}, {X0.TRUTH_SQL}, u as (select *, ('0x' || substr(md5(entity_id), 1, 8))::bigint % 100 < 10 as pick from records), s as (select entity_id from u where src = 'S1' and pick)
select entity_id, src, country from u where (src = 'S1' and pick) or (src <> 'S1' and entity_id in (select cand_id from truth where s1_id in (select entity_id from s))) or (src <> 'S1' and pick and entity_id not in (select cand_id from truth))""")  # fmt: skip
def dev_subset(spark, sf_dir):
    return P.dev_subset(X0.records(spark, sf_dir), X0.truth_pairs(spark, sf_dir)).select("entity_id", "src", "country")


NAME_COLUMNS = ["entity_id", "name_clean", "name_core", "name_concat", "name_skel", "name_phon", "legal", "is_domain", "is_translit", "alias_core"]
ADDRESS_COLUMNS = ["entity_id", "addr_clean", "house_no", "addr_nums", "street", "postcode"]


@query("normalized_names", N.names(X0.RECORDS_SQL))
def normalized_names(spark, sf_dir):
    return X0.normalized(spark, sf_dir).select(*NAME_COLUMNS)


@query("normalized_addresses", N.addresses(X0.RECORDS_SQL))
def normalized_addresses(spark, sf_dir):
    return X0.normalized(spark, sf_dir).select(*ADDRESS_COLUMNS)


@query("normalized_odd_names", N.names(X0.ODD_SQL))
def normalized_odd_names(spark, sf_dir):
    """Legal forms, initials, domains, other names and digits for letters, which the tables' texts do not hold."""
    return text.normalize_records(X0.odd_records(spark)).select(*NAME_COLUMNS)


@query("normalized_odd_addresses", N.addresses(X0.ODD_SQL))
def normalized_odd_addresses(spark, sf_dir):
    """Abbreviations by country, junk, leading zeros and postcodes, which the tables' texts do not hold."""
    return text.normalize_records(X0.odd_records(spark)).select(*ADDRESS_COLUMNS)


@query("transliterated_names", N.transliterated())
def transliterated_names(spark, sf_dir):
    """Names in nine Indic scripts, in Latin letters."""
    return spark.createDataFrame(list(enumerate(N.INDIC_NAMES)), "name_id int, name string").select("name_id", text.fold_name("name").alias("latin"))


@query("sound_keys", f"with {X0.PLAIN_SQL} select entity_id, name_skel, name_phon from plain")
def sound_keys(spark, sf_dir):
    return X0.plain(spark, sf_dir).select("entity_id", "name_skel", "name_phon")


_STOP = ", ".join(f"'{w}'" for w in T.STREET_STOP)
KEYS_SQL = f"""{X0.PLAIN_SQL},
r as (select *, coalesce([x for x in string_split(street, ' ') if length(x) >= 3 and not regexp_matches(x, '[0-9]') and x not in ({_STOP})][1], '') as skey from plain),
toks as (select * from (select entity_id, country, unnest(string_split(name_core, ' ')) as tok from plain) where length(tok) >= 2),
df as (select country, tok, count(*) as df from toks group by 1, 2),
rare as (select * from (select entity_id, tok, df, row_number() over (partition by entity_id order by df, tok) as k from (select distinct * from toks) join df using (country, tok)) where k <= 2 and df <= {T.TOKEN_DF_MAX}),
atoks as (select distinct * from (select entity_id, country, unnest(string_split(regexp_replace(addr_clean, '[^a-z ]', ' ', 'g'), ' ')) as tok from plain) where length(tok) >= 4),
adf as (select country, tok, count(*) as df from atoks group by 1, 2),
ar as (select * from (select entity_id, tok, row_number() over (partition by entity_id order by df, tok) as k from atoks join adf using (country, tok)) where k <= 2),
ar2 as (select entity_id, min(tok) as lo, max(tok) as hi from ar group by 1 having count(*) = 2),
keys as (
  select entity_id, src, 'addr' as kind, country || '|' || house_no || '|' || skey as key from r where house_no <> '' and skey <> ''
  union all select entity_id, src, 'tok', country || '|' || tok from r join rare using (entity_id)
  union all select entity_id, src, 'pre', country || '|' || substr(name_concat, 1, 8) from r where length(name_concat) >= 5
  union all select entity_id, src, 'skel', country || '|' || substr(name_skel, 1, 6) from r where length(name_skel) >= 4
  union all select entity_id, src, 'num', country || '|' || house_no || '|' || tok from r join rare using (entity_id) where k = 1 and house_no <> ''
  union all select entity_id, src, 'full', country || '|' || name_concat from r where length(name_concat) >= 4
  union all select entity_id, src, 'tokat', country || '|' || rare.tok || '|' || ar.tok from r join rare using (entity_id) join ar using (entity_id) where ar.k = 1
  union all select entity_id, src, 'prehs', country || '|' || substr(name_concat, 1, 8) || '|' || house_no from r where length(name_concat) >= 5 and house_no <> ''
  union all select entity_id, src, 'prest', country || '|' || substr(name_concat, 1, 8) || '|' || skey from r where length(name_concat) >= 5 and skey <> ''
  union all select entity_id, src, 'addr2', country || '|' || lo || '|' || hi from r join ar2 using (entity_id)
  union all select entity_id, src, 'phonhs', country || '|' || substr(name_phon, 1, 6) || '|' || house_no from r where length(name_phon) >= 3 and house_no <> ''
  union all select entity_id, src, 'phonat', country || '|' || substr(name_phon, 1, 4) || '|' || tok from r join ar using (entity_id) where k = 1 and length(name_phon) >= 3
  union all select entity_id, src, 'hsat', country || '|' || house_no || '|' || tok from r join ar using (entity_id) where house_no <> ''
)"""
_CAPS = " or ".join(f"(kind = '{k}' and n_t <= {n} and n_s <= {T.CAP_S1[k]})" for k, n in T.CAP_TARGETS.items())
SIZES_SQL = f"{KEYS_SQL}, sizes as (select * from (select kind, key, count(*) filter (where src <> 'S1') as n_t, count(*) filter (where src = 'S1') as n_s from keys group by 1, 2) where n_t > 0 and n_s > 0), ok as (select * from sizes where {_CAPS})"
CANDS_SQL = f"{SIZES_SQL}, cands as (select a.entity_id as s1_id, b.entity_id as cand_id, list_sort(list(distinct a.kind)) as keys from keys a join keys b using (kind, key) join ok using (kind, key) where a.src = 'S1' and b.src <> 'S1' group by 1, 2)"
LABELED_SQL = f"{CANDS_SQL}, {X0.TRUTH_SQL}, lab as (select cands.*, truth.s1_id is not null as label from cands left join truth using (s1_id, cand_id))"


def _keys(spark, sf_dir):
    return X0.plain_keys(spark, sf_dir)


def _cands(spark, sf_dir):
    return X0.plain_candidates(spark, sf_dir)


@query("token_frequency", f"with {KEYS_SQL} select country, tok, df from df")
def token_frequency(spark, sf_dir):
    return B.token_frequency(B.name_tokens(X0.plain(spark, sf_dir)))


@query("rare_name_tokens", f"with {KEYS_SQL} select entity_id, string_agg(tok, '|' order by k) as toks from rare group by 1")
def rare_name_tokens(spark, sf_dir):
    return joined(B.rare_tokens(B.name_tokens(X0.plain(spark, sf_dir)), 2, T.TOKEN_DF_MAX), "toks")


@query("rare_address_words", f"with {KEYS_SQL} select entity_id, string_agg(tok, '|' order by k) as toks from ar group by 1")
def rare_address_words(spark, sf_dir):
    return joined(B.rare_tokens(B.address_tokens(X0.plain(spark, sf_dir)), 2), "toks")


@query("blocking_keys", f"with {KEYS_SQL} select entity_id, src, kind, key from keys")
def blocking_keys(spark, sf_dir):
    return B.build_keys(X0.plain(spark, sf_dir))


@query("block_sizes", f"with {SIZES_SQL} select kind, key, n_t, n_s from sizes")
def block_sizes(spark, sf_dir):
    return B.block_sizes(_keys(spark, sf_dir))


@query("usable_blocks", f"with {SIZES_SQL} select kind, key, n_t, n_s from ok")
def usable_blocks(spark, sf_dir):
    return B.usable_blocks(B.block_sizes(_keys(spark, sf_dir)))


@query("block_statistics", f"with {SIZES_SQL} select s.kind, count(*) as blocks, count(ok.key) as usable, sum(s.n_t * s.n_s)::bigint as pairs_uncapped, coalesce(sum(ok.n_t * ok.n_s), 0)::bigint as pairs_capped from sizes s left join ok using (kind, key) group by 1")
def block_statistics(spark, sf_dir):
    return B.block_statistics(_keys(spark, sf_dir))


@query("candidates", f"with {CANDS_SQL} select s1_id, cand_id, array_to_string(keys, '|') as keys from cands")
def candidates(spark, sf_dir):
    return joined(B.build_candidates(_keys(spark, sf_dir)), "keys")


LINKS_SQL = f"""lk as (select * from (select *, count(*) over (partition by k, kk) as n from (
  select entity_id, 'p' as k, country || '|' || name_phon as kk from plain where src <> 'S1' and length(name_phon) >= 3
  union all select entity_id, 'a', country || '|' || addr_clean from plain where src <> 'S1' and length(addr_clean) >= 8
  union all select entity_id, 'h', country || '|' || house_no || '|' || substr(name_phon, 1, 3) from plain where src <> 'S1' and house_no <> '' and length(name_phon) >= 3)) where n between 2 and {T.HOP_GROUP_MAX})"""


@query("hop_candidates", f"""with {CANDS_SQL}, {LINKS_SQL}, hop as (select distinct s.s1_id, b.entity_id as cand_id from (select * from cands where len(keys) >= {T.HOP_SEED_KEYS}) s join lk a on a.entity_id = s.cand_id join lk b on b.k = a.k and b.kk = a.kk and b.entity_id <> a.entity_id)
select s1_id, cand_id, 'hop' as keys from hop anti join cands using (s1_id, cand_id)""")  # fmt: skip
def hop_candidates(spark, sf_dir):
    norm = X0.plain(spark, sf_dir)
    return joined(B.add_hops(_cands(spark, sf_dir), norm).where(F.array_contains("keys", "hop")), "keys")


@query("blocking_recall", f"with {LABELED_SQL} select (select count(*) from cands) as pairs, (select count(distinct s1_id) from cands) as s1_covered, (select count(*) from truth) as true_pairs, (select count(*) from lab where label) as found, round((select count(*) from lab where label) / (select count(*) from truth), 6) as recall")
def blocking_recall(spark, sf_dir):
    return rounded(B.recall_report(_cands(spark, sf_dir), X0.truth_pairs(spark, sf_dir)))


@query("blocking_per_key", f"with {LABELED_SQL}, x as (select label, len(keys) as n, unnest(keys) as key from lab) select key, count(*) as pairs, round(count(*) filter (where label) / (select count(*) from truth), 6) as pair_recall, round(avg(label::int), 6) as precision, count(*) filter (where label and n = 1) as unique_true_pairs from x group by 1")
def blocking_per_key(spark, sf_dir):
    truth = X0.truth_pairs(spark, sf_dir)
    return rounded(E.per_key(B.label(_cands(spark, sf_dir), truth), truth.agg(F.count("*").alias("n"))))


@query("missed_pairs", f"with {CANDS_SQL}, {X0.TRUTH_SQL} select distinct s1_id, cand_id from truth anti join (select * from cands where list_contains(keys, 'addr')) q using (s1_id, cand_id)")
def missed_pairs(spark, sf_dir):
    """True pairs that the address key alone would miss."""
    return B.missed_pairs(_cands(spark, sf_dir).where(F.array_contains("keys", "addr")), X0.truth_pairs(spark, sf_dir))


def _greedy_sql() -> str:
    """The search, step by step: each step is a query over what the steps before have left."""
    kinds = len(T.CAP_TARGETS)
    steps = ["kinds as (select distinct unnest(keys) as kind from lab)", "g0 as (select keys, label from lab)"]
    for i in range(1, kinds + 1):
        taken = " union all ".join(f"select add_key from p{j}" for j in range(1, i)) or "select '' as add_key"
        steps.append(f"""p{i} as (
  select {i} as i, kind as add_key, count(*) filter (where label) as h, count(label) as n from kinds left join (select unnest(keys) as key, label from g{i - 1}) on key = kind
  where kind not in ({taken}) group by kind order by h desc, n, add_key limit 1)""")
        steps.append(f"g{i} as (select * from g{i - 1} where not list_contains(keys, coalesce((select add_key from p{i}), '')))")
    every = " union all ".join(f"select * from p{i}" for i in range(1, kinds + 1))
    return f"""with {LABELED_SQL}, {", ".join(steps)}
select add_key, round(sum(h) over (order by i) / (select count(*) from truth), 6) as cum_pair_recall, (sum(n) over (order by i))::bigint as cum_pairs from ({every})"""


@query("greedy_key_order", _greedy_sql())
def greedy_key_order(spark, sf_dir):
    truth = X0.truth_pairs(spark, sf_dir)
    rows = E.greedy_keys(B.label(_cands(spark, sf_dir), truth), truth.count())
    return rounded(spark.createDataFrame([tuple(r.values()) for r in rows], "add_key string, cum_pair_recall double, cum_pairs long"))


IDF_SQL = f"{X0.PLAIN_SQL}, idf as (select country, tok, ln((select count(*) from plain) / count(*)) as idf from (select country, unnest(string_split(name_core, ' ')) as tok from plain) where tok <> '' group by 1, 2)"


@query("idf", f"with {IDF_SQL} select country, tok, round(idf, 6) as idf from idf")
def idf(spark, sf_dir):
    return rounded(X.idf_table(X0.plain(spark, sf_dir)))


@query("name_frequency", f"with {X0.PLAIN_SQL} select country, name_concat, count(*) filter (where src = 'S1') as n_s1, count(*) filter (where src <> 'S1') as n_t from plain group by 1, 2")
def name_frequency(spark, sf_dir):
    return X.name_frequency(X0.plain(spark, sf_dir))


@query("target_counts", f"with {CANDS_SQL} select cand_id, count(*) as t_ncands from cands group by 1")
def target_counts(spark, sf_dir):
    return X.target_counts(_cands(spark, sf_dir))


PAIR_SQL = f"""with {CANDS_SQL}, f as (select s1_id, cand_id, keys, a.name_core as na, b.name_core as nb, a.house_no as ha, b.house_no as hb, a.name_concat as ca, b.name_concat as cb, a.addr_clean as aa, b.addr_clean as ab from cands join plain a on a.entity_id = s1_id join plain b on b.entity_id = cand_id)"""


#: Features of plain records without similarities.
EXACT_SQL = {
    "n_len_diff": "abs(length(na) - length(nb)) / greatest(length(na), length(nb), 1)",
    "n_tok_a": "(length(na) - length(replace(na, ' ', '')) + 1)::int",
    "n_tok_b": "(length(nb) - length(replace(nb, ' ', '')) + 1)::int",
    "legal_same": "0", "legal_conflict": "0", "legal_missing": "1", "dom_any": "0", "translit_any": "0", "post_eq": "-1",
    "house_eq": "case when ha = '' or hb = '' then -1 else (ha = hb)::int end",
    "house_near": "case when ha = '' or hb = '' then -1 when ha = hb then 2 else (levenshtein(ha, hb) <= 1 or starts_with(ha, hb) or starts_with(hb, ha) or ends_with(ha, hb) or ends_with(hb, ha))::int end",
    "nums_jacc": "case when ha = '' or hb = '' then -1.0 else (ha = hb)::int::double end",
    "addr_empty": "(aa = '' or ab = '')::int", "addr_empty_s1": "(aa = '')::int", "addr_empty_t": "(ab = '')::int",
    "is_s3": "(cand_id[1:2] = 'S3')::int", "n_keys": "len(keys)::int",
    **{f"k_{k}": f"list_contains(keys, '{k}')::int" for k in T.KEY_KINDS},
}
EXACT = "n_len_diff n_tok_a n_tok_b house_eq house_near nums_jacc addr_empty is_s3 n_keys k_tok k_full".split()


@query("pair_features_exact", f"{PAIR_SQL} select s1_id, cand_id, {', '.join(f'round({v}, 6) as {c}' if c == 'n_len_diff' else f'{v} as {c}' for c, v in EXACT_SQL.items() if c in EXACT)} from f")
def pair_features_exact(spark, sf_dir):
    df = X.with_attributes(_cands(spark, sf_dir), X0.plain(spark, sf_dir))
    exact = X.exact_features()
    return rounded(df.select("s1_id", "cand_id", *[exact[c].alias(c) for c in EXACT]))


@query("pair_jaro_winkler", f"{PAIR_SQL} select s1_id, cand_id, round(case when x = y then 1.0 when x = '' or y = '' then 0.0 else jaro_winkler_similarity(x, y) end, 6) as n_jw from (select *, regexp_replace(ca, '[^a-z0-9]', '', 'g') as x, regexp_replace(cb, '[^a-z0-9]', '', 'g') as y from f)")
def pair_jaro_winkler(spark, sf_dir):
    """On the ASCII letters of the names, as DuckDB's own function compares bytes."""
    df = X.with_attributes(_cands(spark, sf_dir), X0.plain(spark, sf_dir), ["name_concat"])
    ascii_only = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    return rounded(df.select("s1_id", "cand_id", S.jaro_winkler(ascii_only("name_concat_a"), ascii_only("name_concat_b")).alias("n_jw")))


@query("pair_idf", f"""{PAIR_SQL}, v as (select country, tok, ln((select count(*) from plain) / count(*)) as idf from (select country, unnest(string_split(name_core, ' ')) as tok from plain) where tok <> '' group by 1, 2),
w as (select distinct entity_id, tok, idf from (select entity_id, country, unnest(string_split(name_core, ' ')) as tok from plain) join v using (country, tok)),
t as (select s1_id, cand_id, tok, max(idf) as idf, count(*) as n from (select s1_id, cand_id, tok, idf from f join w on entity_id = s1_id union all select s1_id, cand_id, tok, idf from f join w on entity_id = cand_id) group by 1, 2, 3)
select s1_id, cand_id, round(coalesce(sum(idf) filter (where n = 2), 0) / sum(idf), 6) as n_idf_overlap, round(coalesce(max(idf) filter (where n = 2), 0), 6) as n_shared_max_idf, round(coalesce(max(idf) filter (where n = 1), 0), 6) as n_unshared_max_idf from t group by 1, 2""")  # fmt: skip
def pair_idf(spark, sf_dir):
    w = X.idf_weights(X0.plain(spark, sf_dir))
    df = _cands(spark, sf_dir).join(w.toDF("s1_id", "w_a"), "s1_id").join(w.toDF("cand_id", "w_b"), "cand_id")
    return rounded(df.select("s1_id", "cand_id", *[c.alias(n) for n, c in X.idf_features(F.col("w_a"), F.col("w_b")).items()]))


SIMILAR = {"n_tsort": (Q.sorted_words("na"), Q.sorted_words("nb")), "n_concat_ratio": ("ca", "cb"), "n_skel": ("ka", "kb"), "n_clean_ratio": ("na", "nb"), "n_phon": ("pa", "pb"), "a_ratio": ("aa", "ab"), "a_street": ("ta", "tb")}


def _similar_sql() -> str:
    """Steps up to ``likeness``: the pairs of PAIR_SQL with all similarities; the records have neither aliases nor empty addresses of their own."""
    windows, slide, slid = Q.partial("select ca as x, cb as y from both_sides")
    ratios = " union ".join([*(f"select {x} as x, {y} as y from both_sides" for x, y in SIMILAR.values()), slide])
    sets = "select na as x, nb as y from both_sides union select aa, ab from both_sides"
    no_address = "aa = '' or ab = ''"
    given = lambda n, v: f"case when {no_address} then -1.0 else {v} end as {n}" if n.startswith("a_") else f"{v} as {n}"
    columns = ", ".join([given("n_tset", "s1.v"), given("a_tset", "s2.v"), "p.v as n_concat_partial", f"{Q.winkler('ca', 'cb')} as n_jw", "-1.0::double as n_alias", *(given(n, f"r_{n}.r") for n in SIMILAR)])
    joins = " ".join(f"join rated r_{n} on r_{n}.x = {x} and r_{n}.y = {y}" for n, (x, y) in SIMILAR.items())
    return f"""{PAIR_SQL}, both_sides as (select f.*, a.name_skel as ka, b.name_skel as kb, a.name_phon as pa, b.name_phon as pb, a.street as ta, b.street as tb, a.country as country_a, b.country as country_b from f join plain a on a.entity_id = s1_id join plain b on b.entity_id = cand_id),
{windows}, {Q.steps(ratios, sets)}, {slid},
likeness as (select f.*, {columns} from both_sides f join token_sets s1 on s1.x = na and s1.y = nb join token_sets s2 on s2.x = aa and s2.y = ab join slid p on p.x = ca and p.y = cb {joins})"""


SIMILAR_COLUMNS = ["n_tset", "a_tset", "n_concat_partial", "n_jw", "n_alias", *SIMILAR]


@query("pair_similarities", f"{_similar_sql()} select s1_id, cand_id, {', '.join(f'round({c}, 6) as {c}' for c in SIMILAR_COLUMNS)} from likeness")
def pair_similarities(spark, sf_dir):
    df = X.with_attributes(_cands(spark, sf_dir), X0.plain(spark, sf_dir))
    return rounded(df.select("s1_id", "cand_id", *[c.alias(n) for n, c in X.similarity_features().items()]))


_SHARED_IDF = ["n_idf_overlap", "n_shared_max_idf", "n_unshared_max_idf"]
_COUNTED = {"nf_s1_a": "x.n_s1", "nf_s1_b": "y.n_s1", "nf_s1_lg_b": "y.n_s1", "nf_t_b": "y.n_t"}


def _wide_sql() -> str:
    """Steps up to ``wide``: all features but the context, of plain records, which have no legal forms, domains or postcodes: then frequencies with the legal form are those of the name."""
    known = ["n_tset", "a_tset", "n_concat_partial", "n_jw", "n_alias", *SIMILAR]
    exact = ", ".join(f"{v} as {n}" for n, v in EXACT_SQL.items())
    return f"""{_similar_sql()},
tok_idf as (select country, tok, ln((select count(*) from plain) / count(*)) as idf from (select country, unnest(string_split(name_core, ' ')) as tok from plain) where tok <> '' group by 1, 2),
own_idf as (select distinct entity_id, tok, idf from (select entity_id, country, unnest(string_split(name_core, ' ')) as tok from plain) join tok_idf using (country, tok)),
met_idf as (select s1_id, cand_id, tok, max(idf) as idf, count(*) as n from (select s1_id, cand_id, tok, idf from f join own_idf on entity_id = s1_id union all select s1_id, cand_id, tok, idf from f join own_idf on entity_id = cand_id) group by 1, 2, 3),
pair_idf as (select s1_id, cand_id, coalesce(sum(idf) filter (where n = 2), 0) / sum(idf) as n_idf_overlap, coalesce(max(idf) filter (where n = 2), 0) as n_shared_max_idf, coalesce(max(idf) filter (where n = 1), 0) as n_unshared_max_idf from met_idf group by 1, 2),
named as (select country, name_concat, count(*) filter (where src = 'S1') as n_s1, count(*) filter (where src <> 'S1') as n_t from plain group by 1, 2),
targets as (select cand_id, count(*) as t_ncands from cands group by 1),
wide as (
  select s1_id, cand_id, t_ncands, {", ".join(known)}, {exact}, {", ".join(f"coalesce({v}, 0) as {n}" for n, v in _COUNTED.items())},
    {", ".join(f"case when na = '' or nb = '' then 0 else coalesce({c}, 0) end as {c}" for c in _SHARED_IDF)}
  from likeness join targets using (cand_id) left join pair_idf using (s1_id, cand_id)
  left join named x on x.country = country_a and x.name_concat = ca left join named y on y.country = country_b and y.name_concat = cb
  where keys <> ['tok']
)"""


def _features_sql() -> str:
    whole = [c for c in [*EXACT_SQL, *_COUNTED, "t_ncands", "s1_ncands", "rank_in_s1"] if c not in ("n_len_diff", "nums_jacc")]
    final = ", ".join(c if c in whole else f"round({c}, 6) as {c}" for c in X.FEATURES)
    return f"""{_wide_sql()}, ranked as (select *, round(n_tset + n_concat_ratio + n_idf_overlap + greatest(a_tset, 0.0), 9) as s from wide)
select s1_id, cand_id, {final} from (select *, count(*) over (partition by s1_id) as s1_ncands, (rank() over (partition by s1_id order by s desc))::int as rank_in_s1, max(s) over (partition by s1_id) - s as gap_to_best_s1 from ranked)"""


@query("pair_features_plain", _features_sql())
def pair_features_plain(spark, sf_dir):
    """All features of all candidates of records by rules that SQL can repeat."""
    return rounded(X.pair_features(_cands(spark, sf_dir), X0.plain(spark, sf_dir)))


@query("interactions", f"{_wide_sql()} select s1_id, cand_id, round(n_tset * least(greatest(a_tset, 0.0), 1.0), 6) as x_name_addr, (n_concat_ratio >= 0.999 and addr_empty = 1)::int as x_exact_name_noaddr, round(least(n_tset, case when a_tset < 0 then n_tset else a_tset end), 6) as x_name_min_addr from wide")
def interactions(spark, sf_dir):
    df = X.interactions(X.pair_features(_cands(spark, sf_dir), X0.plain(spark, sf_dir)))
    return rounded(df.select("s1_id", "cand_id", "x_name_addr", "x_exact_name_noaddr", "x_name_min_addr"))


@query("pair_features")
def pair_features(spark, sf_dir):
    """All features of all candidates of the fully normalised records."""
    norm, folder = X0.normalized(spark, sf_dir), storage.shared_dir(spark)
    keys = storage.written(B.build_keys(norm), folder, "keys")
    return rounded(X.pair_features(storage.written(B.build_candidates(keys), folder, "candidates"), norm))


_SIBLINGS = f"""with {CANDS_SQL}, scores as (select s1_id, cand_id, least(1.0, len(keys) / 8.0)::double as p1 from cands),
top as (select s1_id, cand_id as sib from scores where p1 >= {X.STRONG} qualify row_number() over (partition by s1_id order by p1 desc, cand_id) <= {X.SIBLINGS}),
likes as (select s1_id, s.cand_id, a.name_core as n1, b.name_core as n2, a.addr_clean as a1, b.addr_clean as a2 from scores s join top using (s1_id) join plain a on a.entity_id = s.cand_id join plain b on b.entity_id = sib where s.cand_id <> sib and p1 >= {X.LIVE}),
{Q.steps("select '' as x, '' as y", "select n1 as x, n2 as y from likes union select a1, a2 from likes")},
best as (select s1_id, cand_id, max(n.v) as sib_name_max, max(case when a1 = '' or a2 = '' then -1.0 else a.v end) as sib_addr_max, count(*) as sib_n from likes join token_sets n on n.x = n1 and n.y = n2 join token_sets a on a.x = a1 and a.y = a2 group by 1, 2)
select s1_id, cand_id, round(p1, 6) as p1, round(coalesce(sib_name_max, -1.0), 6) as sib_name_max, round(coalesce(sib_addr_max, -1.0), 6) as sib_addr_max, coalesce(sib_n, 0)::int as sib_n from scores left join best using (s1_id, cand_id)"""


@query("sibling_features", _SIBLINGS)
def sibling_features(spark, sf_dir):
    norm = X0.plain(spark, sf_dir)
    df = X.with_attributes(_cands(spark, sf_dir), norm, ["name_concat"])
    df = df.select("s1_id", "cand_id", F.least(F.lit(1.0), F.size("keys") / 8.0).alias("p1"))
    return rounded(X.sibling_features(df, norm))


@query("uncertain_band", f"with {X0.SCORED_SQL} select s1_id, cand_id, prob, round(ln(p / (1 - p)), 6) as z from (select *, least(greatest(prob, 1e-6), 1 - 1e-6) as p from c) where prob between 0.2 and 0.8")
def uncertain_band(spark, sf_dir):
    """Pairs that a second look would pay for, with their log-odds."""
    df = L.band(X0.scored(spark, sf_dir), 0.2, 0.8, "prob")
    return rounded(df.select("s1_id", "cand_id", "prob", L.logit(F.col("prob")).alias("z")))


@query("deduplicated_candidates", "select l_orderkey as s1_id, l_suppkey as cand_id, max(round(l_quantity::double / 51.0, 6)) as prob from lineitem group by 1, 2")
def deduplicated_candidates(spark, sf_dir):
    """Pairs that are listed several times, by their highest score."""
    rows = X0.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1_id"), F.col("l_suppkey").alias("cand_id"), F.round(F.col("l_quantity").cast("double") / 51.0, 6).alias("prob"))
    return rounded(D.deduplicate(rows))


@query("rerank_texts", f"""with {CANDS_SQL}, ids as (select s1_id as entity_id from cands union select cand_id from cands)
select entity_id, concat_ws(' | ', business_name, business_address) as text from records join ids using (entity_id)""")
def rerank_texts(spark, sf_dir):
    """What a re-ranker reads of every record that is in a candidate pair."""
    pairs = _cands(spark, sf_dir)
    ids = pairs.select(F.col("s1_id").alias("entity_id")).union(pairs.select("cand_id")).distinct()
    return L.texts(X0.records(spark, sf_dir), ids)


@query("rerank_blend")
def rerank_blend(spark, sf_dir):
    """A stand-in re-ranker on the uncertain pairs, blended with the first score."""
    truth, folder = X0.truth_pairs(spark, sf_dir), storage.shared_dir(spark)
    pairs = B.label(_cands(spark, sf_dir), truth).select("s1_id", "cand_id", "label", F.least(F.lit(0.98), F.size("keys") / 12.0).alias("p1"))
    pairs = storage.written(L.band(pairs), folder, "band")
    t = L.texts(X0.records(spark, sf_dir), pairs.select(F.col("s1_id").alias("entity_id")).union(pairs.select("cand_id")).distinct())
    t = storage.written(t, folder, "texts")
    df = pairs.join(t.toDF("s1_id", "text_a"), "s1_id").join(t.toDF("cand_id", "text_b"), "cand_id")
    df = storage.written(L.rerank(df, L.overlap_scorer).drop("text_a", "text_b"), folder, "reranked")  # read by the fit and by what it is applied to
    return rounded(L.apply_blend(L.fit_blend(df), df))


@query("random_sample", f"with {X0.RECORDS_SQL} select entity_id from records where ('0x' || substr(md5(entity_id), 1, 8))::bigint % 1000 < 200")
def random_sample(spark, sf_dir):
    """A reproducible fifth of the records (this operator's purpose is to sample)."""
    return P.sample(X0.records(spark, sf_dir), "entity_id", 0.2).select("entity_id")


@query("three_splits", f"with {X0.RECORDS_SQL} select entity_id, case when b < 50 then 0 when b < 75 then 1 else 2 end::int as split from (select entity_id, ('0x' || substr(md5(entity_id), 1, 8))::bigint % 100 as b from records)")
def three_splits(spark, sf_dir):
    """Entities to fit on, to calibrate on and to evaluate on."""
    return X0.records(spark, sf_dir).select("entity_id", P.split_of(F.col("entity_id"), 50, 25, 25).alias("split"))


_ALIGN = f"""with {KEPT}, g as (select grp as run, avg(score) as local, avg(h) as board from p group by 1), d as (select *, board - local as gap from g),
r as (select *, rank() over (order by local) + (count(*) over (partition by local) - 1) / 2.0 as rl, rank() over (order by board) + (count(*) over (partition by board) - 1) / 2.0 as rb from d)
select count(*) as n, round(avg(gap), 6) as gap_mean, round(stddev_samp(gap), 6) as gap_std, coalesce(string_agg(run, '|' order by run) filter (where abs(gap - (select avg(gap) from d)) > {R.DRIFT}), '') as drifters, round(corr(rl, rb), 6) as spearman from r"""


@query("leaderboard_alignment", _ALIGN)
def leaderboard_alignment(spark, sf_dir):
    """How two scores of each run agree; the runs here are the five groups, with their mean hits as the second score, and one all-empty probe, which stays out."""
    means = _table(spark, sf_dir).groupBy("grp").agg(F.avg("score").alias("local"), F.avg("hits").alias("board")).collect()
    logged = [{"run": r.grp, "config": {}, "report": {"score": r.local}, "leaderboard": r.board} for r in means]
    a = R.alignment([*logged, {"run": "probe", "config": {"kind": R.PROBE}, "report": {"score": 0.0}, "leaderboard": 0.25}])
    row = (a["n"], a["gap_mean"], a["gap_std"], "|".join(sorted(a["drifters"])), a["spearman"])
    return rounded(spark.createDataFrame([row], "n long, gap_mean double, gap_std double, drifters string, spearman double"))
