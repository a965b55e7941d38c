"""Registered queries: each operator on the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.config import ResponseConfig, ScoringConfig
from tallyframe.constants import (
    DISTRICTS, MANY_NUMBERS, NO_NUMBER, PREFERENCE_SCORES, RANDOM_VECTOR_SIZE, TASK_COUNTS, WORKER_COUNTS,
)
from tallyframe.functions import columns as fc, hashing
from tallyframe.operators import (
    coverage, joins, keyorder, population, ratings, reduction, responses as rs, scoring, splits, summary,
)
from tallyframe.plans.answer import answer_tasks
from tallyframe.plans import prepare as pp, simulate as sim, sql, tables as tb, training
from tallyframe.session import shared_folder
from tallyframe.sources import tables as sources
from tallyframe.plans.tables import FEATURES, HASH, SEED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LATENT, CONTEXTS, VECTOR = 4, 5, 64
R = f"r as ({sql.RESPONSES})"


def register(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if oracle is not None:
            ORACLES[key] = oracle
        return query

    return add


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def rounded_scores(grid: DataFrame) -> DataFrame:
    return grid.withColumn("score", fc.round_double("score", 5))


# --- keys and splits -------------------------------------------------------------------------------


@register(f"select c_custkey as uid, round({sql.u(SEED, 'c_custkey')}, 9) as u, round({sql.normal(SEED, 'c_custkey')}, 6) as z from customer")
def draws(spark, d):
    key = _customers(spark, d)
    u, z = hashing.u01(SEED, "uid", fn=HASH), hashing.n01(SEED, "uid", fn=HASH)
    return key.select("uid", F.round(u, 9).alias("u"), F.round(z, 6).alias("z"))


@register(sql.ranks("(select l_partkey as qid from lineitem)", "qid", SEED).replace(", count(*) over () as n", ""))
def rank_keys(spark, d):
    return keyorder.rank_keys(tb.responses(spark, d), "qid", SEED, HASH)


def _split_sql(key: str) -> str:
    return f"""with {R}, k as ({sql.ranks('r', key, SEED)}),
    s as (select r.qid, r.uid, case when rk <= ceil(0.2::double * n) then 'test' else 'train' end as split
          from r join k on r.{key} = k.{key})
    select split, {sql.COVERAGE} from s group by split"""


@register(_split_sql("qid"))
def split_by_task(spark, d):
    split = splits.group_split(tb.responses(spark, d), "qid", 0.2, seed=SEED, hash_fn=HASH)
    return coverage.coverage_stats(split, ["split"])


@register(_split_sql("uid"))
def split_by_worker(spark, d):
    split = splits.group_split(tb.responses(spark, d), "uid", 0.2, seed=SEED, hash_fn=HASH)
    return coverage.coverage_stats(split, ["split"])


@register(f"""with {R}, k as ({sql.ranks('r', 'qid', SEED)}),
    tr as (select r.* from r join k on r.qid = k.qid where rk > ceil(0.2::double * n)),
    w as ({sql.ranks('tr', 'uid', '42w')}),
    s as (select r.qid, r.uid, case when k.rk <= ceil(0.2::double * k.n) then 'test'
            when w.rk <= ceil((1 - 0.7::double) * w.n) then 'dropped' else 'train' end as split
          from r join k on r.qid = k.qid left join w on r.uid = w.uid)
    select split, {sql.COVERAGE} from s group by split""")
def split_frac(spark, d):
    split = splits.group_split(tb.responses(spark, d), "qid", 0.2, frac=0.7, seed=SEED, hash_fn=HASH)
    return coverage.coverage_stats(split, ["split"])


@register(f"""with {R}, k as ({sql.ranks('r', 'qid', SEED)}),
    tr as (select r.* from r join k on r.qid = k.qid where rk > ceil(0.2::double * n)),
    v as ({sql.ranks('tr', 'qid', SEED)}),
    s as (select tr.qid, tr.uid, case when rk <= ceil(0.1::double * n) then 'val' else 'train' end as split
          from tr join v on tr.qid = v.qid)
    select split, {sql.COVERAGE} from s group by split""")
def train_val_split(spark, d):
    split = splits.group_split(tb.responses(spark, d), "qid", 0.2, seed=SEED, hash_fn=HASH)
    inner = splits.train_val_split(splits.side(split, "train"), 0.1, SEED, hash_fn=HASH)
    return coverage.coverage_stats(inner, ["split"])


@register(f"""with {R}, k as ({sql.ranks('r', 'uid', SEED)})
    select qid, r.uid, l_orderkey, l_linenumber from r join k on r.uid = k.uid where rk <= floor(n * 0.3::double)""")
def choose_workers(spark, d):
    df = tb.responses(spark, d)
    choice = keyorder.choose_keys(df, "uid", SEED, lambda n: [keyorder.floor_size(n, 0.3)], HASH)
    return df.filter(choice.chosen()).select("qid", "uid", "l_orderkey", "l_linenumber")


@register(f"with {R} select qid, uid, l_orderkey, l_linenumber from r where qid in (select doc_id from labels)")
def keep_keys(spark, d):
    rows = tb.responses(spark, d).select("qid", "uid", "l_orderkey", "l_linenumber")
    return joins.keep_keys(rows, tb.task_reference(spark, d), "qid")


# --- responses -------------------------------------------------------------------------------------


@register(f"with {R} select l_orderkey, l_linenumber, qid, uid, human_score from r")
def read_responses(spark, d):
    cfg = ResponseConfig(qid_col="l_partkey", uid_col="l_suppkey", human_score_col="l_quantity", text_col="l_shipdate")
    df = sources.read_responses(spark, f"{d}/lineitem.parquet", cfg)
    return df.select("l_orderkey", "l_linenumber", "qid", "uid", "human_score")


@register("""select d.doc_id, coalesce(cast(l.quality as varchar), 'nan') as quality,
    coalesce(case when l.toxic = 1 then 'True' when l.toxic = 0 then 'False' end, 'nan') as toxic
    from documents d left join labels l using (doc_id)""")
def string_features(spark, d):
    labels = tb.table(spark, d, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))
    df = joins.join_by_key(tb.table(spark, d, "documents").select("doc_id"), labels, "doc_id")
    return rs.string_features(df, ["quality", "toxic"])


@register(f"""with {R} select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    {sql.clamp('human_score', '10.0::double', '20.0::double')} as score from r""")
def clamp(spark, d):
    df = tb.table(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fc.clamp("l_quantity", 10, 20).alias("score"))


@register(f"""select p_partkey as qid, i::int as pos,
    round({sql.linspace('0.0::double', 'p_retailprice', '(p_size % 4 + 1)', 'i')}, 6) as k
    from (select *, unnest(range(p_size % 4 + 1)) as i from part)""")
def linspace(spark, d):
    df = tb.table(spark, d, "part").select(F.col("p_partkey").alias("qid"), "p_retailprice", (F.col("p_size") % 4 + 1).alias("n"))
    grid = df.select("qid", F.posexplode(fc.linspace(F.lit(0.0), "p_retailprice", "n")).alias("pos", "k"))
    return rounded(grid, 6, "k")


@register(f"""with {R} select count(*) as n_rows, count(*) filter (where qid is null) as null_qid,
    count(*) filter (where uid is null) as null_uid,
    count(*) filter (where human_score is null or isnan(human_score)) as missing_score,
    count(*) filter (where qid is null or uid is null) = 0 as valid from r""")
def validate_responses(spark, d):
    return rs.validate_responses(tb.responses(spark, d))


@register("""with j as (select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id))
    select 'doc_id' as "column", count(*) filter (where doc_id is null) as n_missing from j
    union all select 'lang', count(*) filter (where lang is null) from j
    union all select 'n_chars', count(*) filter (where n_chars is null) from j
    union all select 'quality', count(*) filter (where quality is null) from j
    union all select 'toxic', count(*) filter (where toxic is null) from j""")
def null_counts(spark, d):
    docs = tb.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = tb.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return rs.null_counts(joins.join_by_key(docs, labels, "doc_id"))


@register("select min(l_quantity) as score_min, max(l_quantity) as score_max from lineitem")
def score_range(spark, d):
    return rs.score_range(tb.responses(spark, d))


@register(f"""with {R} select count(distinct qid) as n_qid, count(distinct uid) as n_uid, count(*) as n_obs from r""")
def entity_counts(spark, d):
    return coverage.entity_counts(tb.responses(spark, d))


@register(f"with {R} select {sql.COVERAGE} from r")
def coverage_stats(spark, d):
    return coverage.coverage_stats(tb.responses(spark, d))


@register(f"""with {R}, k as ({sql.ranks('r', 'qid', SEED)}),
    f as (select r.* from r join k on r.qid = k.qid where rk > ceil(0.2::double * n))
    select (select count(distinct qid) from f) = (select count(distinct qid) from r) as all_tasks,
           (select count(distinct uid) from f) = (select count(distinct uid) from r) as all_workers""")
def covers_all(spark, d):
    df = tb.responses(spark, d)
    train = splits.side(splits.group_split(df, "qid", 0.2, seed=SEED, hash_fn=HASH), "train")
    return coverage.covers_all(train, df)


_ONE_HOT_SQL = ", ".join(
    f"cast(l_{f} = '{v}' as int)::float as l_{f}_{v}" for f, v in
    [("returnflag", "A"), ("returnflag", "N"), ("returnflag", "R"), ("linestatus", "F"), ("linestatus", "O")]
)


@register(f"with {R} select qid, uid, l_orderkey, l_linenumber, {_ONE_HOT_SQL} from r")
def one_hot(spark, d):
    df = tb.responses(spark, d).select("qid", "uid", "l_orderkey", "l_linenumber", *FEATURES)
    return rs.one_hot(df, FEATURES)[0]


@register("""with v as (select position, value, row_number() over (order by position, value) - 1 as idx from
      (select distinct 0 as position, o_orderstatus as value from orders union select distinct 1, o_orderpriority from orders))
    select o_orderkey, a.idx as first_idx, b.idx as second_idx from orders
    join v a on a.position = 0 and a.value = o_orderstatus join v b on b.position = 1 and b.value = o_orderpriority""")
def one_hot_sparse(spark, d):
    df = tb.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    coded = rs.one_hot_sparse(df, ["o_orderstatus", "o_orderpriority"])
    return coded.select("o_orderkey", F.col("context_idx")[0].alias("first_idx"), F.col("context_idx")[1].alias("second_idx"))


@register("""select p_partkey as qid, 3 as n_ratings, p_size::float::double as b1,
    round(p_retailprice::float::double, 3) as b2, 0.0::double as b3 from part""")
def ratings_array(spark, d):
    base = tb.task_baseline(spark, d)
    return base.select("qid", fc.ratings_to_array(base, "r", 3).alias("b")).select(
        "qid", F.size("b").alias("n_ratings"), *_elements("b", 3)
    )


def _elements(column: str, n: int) -> list:
    return [F.round(F.col(column)[i].cast("double"), 3).alias(f"b{i + 1}") for i in range(n)]


@register(f"""with {R} select qid, uid, l_orderkey, l_linenumber, coalesce(quality, 0)::double as yref_llm
    from r left join labels on qid = doc_id""")
def attach_reference(spark, d):
    rows = tb.responses(spark, d).select("qid", "uid", "l_orderkey", "l_linenumber")
    out = rs.attach_reference(rows, tb.task_reference(spark, d))
    return out.withColumn("yref_llm", F.col("yref_llm").cast("double"))


@register(f"""with {R} select qid, uid, l_orderkey, l_linenumber, coalesce(quality, 0)::double as b1,
    coalesce(toxic, 0)::double as b2, 0.0::double as b3 from r left join labels on qid = doc_id""")
def attach_baseline(spark, d):
    rows = tb.responses(spark, d).select("qid", "uid", "l_orderkey", "l_linenumber")
    base = tb.table(spark, d, "labels").withColumnsRenamed({"doc_id": "qid", "quality": "r1", "toxic": "r2"})
    out = rs.attach_baseline(rows, base, ResponseConfig(baseline_prefix="r", num_baseline_ratings=3))
    return out.select("qid", "uid", "l_orderkey", "l_linenumber", *_elements("baseline_llm_ratings_dist", 3))


PREPARE_CONFIG = ResponseConfig(
    qid_col="qid", uid_col="uid", human_score_col="human_score", embedding_col="vector_text", text_col="l_shipdate",
    categorical_features=tuple(FEATURES), baseline_prefix="r", num_baseline_ratings=3, test_size=0.2, seed=SEED,
)


def raw_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a vector written as text, as in the raw data."""
    return tb.responses(spark, d).withColumn("vector_text", F.to_json(F.array("human_score", "l_discount", "l_tax")))


# Cells are weighed by their places, so that a vector in another order gives another number.
_VECTOR_SUM = "round(l_quantity::float::double + 2 * l_discount::float::double + 3 * l_tax::float::double, 4)"


def _vector_sum(column: str):
    weighed = F.transform(column, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x), 4)


@register(f"""with {R}, k as ({sql.ranks('r', 'qid', SEED)})
    select r.qid, uid, human_score, 3 as vector_size, {_VECTOR_SUM} as vector_sum, coalesce(quality, 0)::double as yref_llm,
      coalesce(p_size, 0)::float::double as b1, round(coalesce(p_retailprice, 0)::float::double, 3) as b2, 0.0::double as b3,
      {_ONE_HOT_SQL}, case when rk <= ceil(0.2::double * n) then 'test' else 'train' end as split
    from r join k on r.qid = k.qid left join labels on r.qid = doc_id left join part on r.qid = p_partkey""")
def prepare(spark, d):
    out = pp.prepare(raw_answers(spark, d), tb.task_reference(spark, d), tb.task_baseline(spark, d), PREPARE_CONFIG, hash_fn=HASH)
    return out.table.select(
        "qid", "uid", F.col("human_score").cast("double").alias("human_score"),
        F.size("task_embedding").alias("vector_size"), _vector_sum("task_embedding").alias("vector_sum"),
        F.col("yref_llm").cast("double").alias("yref_llm"), *_elements("baseline_llm_ratings_dist", 3),
        *out.features, "split",
    )


_SPARSE_CONFIG = ResponseConfig(
    qid_col="qid", uid_col="uid", human_score_col="human_score", embedding_col="vector_text", text_col="l_shipdate",
    categorical_features=("l_returnflag", "l_orderkey"), baseline_prefix="r", num_baseline_ratings=3, test_size=0.2, seed=SEED,
)


@register(f"""with {R}, k as ({sql.ranks('r', 'qid', SEED)}),
    v as (select position, value, row_number() over (order by position, value) - 1 as idx from (
      select distinct 0 as position, l_returnflag as value from r union select distinct 1, l_orderkey::varchar from r))
    select r.qid, uid, l_linenumber, a.idx::bigint as first_place, b.idx::bigint as second_place, {_VECTOR_SUM} as vector_sum,
      case when rk <= ceil(0.2::double * n) then 'test' else 'train' end as split
    from r join k on r.qid = k.qid join v a on a.position = 0 and a.value = l_returnflag
      join v b on b.position = 1 and b.value = l_orderkey::varchar""")
def prepare_sparse(spark, d):
    """A feature of far more categories than there could be columns."""
    config = replace(_SPARSE_CONFIG, uid_col="who")
    raw = raw_answers(spark, d).withColumn("who", F.struct("uid", "l_linenumber")).drop("uid")  # keeps the row's number
    out = pp.prepare(raw, tb.task_reference(spark, d), tb.task_baseline(spark, d), config, hash_fn=HASH, encoding="sparse")
    return out.table.select(
        "qid", F.col("uid.uid").alias("uid"), F.col("uid.l_linenumber").alias("l_linenumber"),
        F.col("context_idx")[0].alias("first_place"), F.col("context_idx")[1].alias("second_place"),
        _vector_sum("task_embedding").alias("vector_sum"), "split",
    )


@register("""with v as (select *, case when event_type = 'click' then null when event_type = 'view' then props
        when user_id % 3 = 0 then '(' || user_id || ', 2)' else '[1, ' || user_id || ', 3.5]' end as t from events)
    select count(*) as n_rows, count(*) filter (where user_id is null or event_id is null) as n_without_key,
      count(*) filter (where t is null) as n_missing, count(*) filter (where event_type = 'view' and t is not null) as n_unreadable,
      min(case when event_type not in ('click', 'view') then case when user_id % 3 = 0 then 2 else 3 end end)::int as shortest,
      max(case when event_type not in ('click', 'view') then case when user_id % 3 = 0 then 2 else 3 end end)::int as longest
    from v""")
def vector_report(spark, d):
    text = F.when(F.col("event_type") == "click", None).when(F.col("event_type") == "view", F.col("props")).when(
        F.col("user_id") % 3 == 0, F.concat(F.lit("("), "user_id", F.lit(", 2)"))
    ).otherwise(F.concat(F.lit("[1, "), "user_id", F.lit(", 3.5]")))
    return rs.vector_report(tb.table(spark, d, "events").withColumn("t", text), "t", ("user_id", "event_id"))


@register("""select vec_id, len(embedding)::int as dim, round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 4) as total
    from embeddings""")
def parse_embedding(spark, d):
    text = tb.table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("text"))
    return text.select("vec_id", fc.parse_embedding("text").alias("v")).select(
        "vec_id", F.size("v").alias("dim"), _vector_sum("v").alias("total")
    )


@register("""select vec_id, list_sum(list_transform(embedding, lambda x, i: trunc(x::double * 10)::bigint * i))::bigint as total
    from embeddings""")
def long_array(spark, d):
    df = tb.table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 10))
    return df.select("vec_id", fc.as_long_array(df, "v").alias("v")).select(
        "vec_id", F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total")
    )


@register("select p_partkey as qid, round(p_size::float::double + 2 * p_retailprice::float::double, 3) as total from part")
def float_array(spark, d):
    df = tb.table(spark, d, "part").select(
        F.col("p_partkey").alias("qid"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("v")
    )
    v = fc.as_float_array(df, "v")
    return df.select("qid", F.round(v[0].cast("double") + 2 * v[1].cast("double"), 3).alias("total"))


_WORDS = "select conv_id, turn, len(string_split(text, ' '))::int as dim from conversations"


@register(f"""with w as ({_WORDS}) select conv_id, turn, dim from w
    where dim = (select dim from w group by dim order by count(*) desc, dim limit 1)""")
def modal_length(spark, d):
    return rs.modal_length_filter(_word_lengths(spark, d), "v").select("conv_id", "turn", F.size("v").alias("dim"))


@register(f"with w as ({_WORDS}) select dim as length, count(*) as n from w group by dim")
def length_counts(spark, d):
    return rs.length_counts(_word_lengths(spark, d), "v")


def _word_lengths(spark: SparkSession, d: str) -> DataFrame:
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    return tb.table(spark, d, "conversations").select("conv_id", "turn", words.alias("v"))


@register("""select min(len(embedding))::int as dim_min, max(len(embedding))::int as dim_max,
    count(*) filter (where embedding is null) as n_null, min(len(embedding)) = max(len(embedding)) as equal from embeddings""")
def check_dim(spark, d):
    return rs.check_dim(tb.table(spark, d, "embeddings"), "embedding")


# --- reduction studies -----------------------------------------------------------------------------


@register(f"with {R}, {sql.safe_ratio_ctes('qid', 'uid', 1)} select * from safe")
def safe_ratio_task(spark, d):
    return reduction.safe_ratio(tb.responses(spark, d), "task", 1, seed=SEED, hash_fn=HASH)


@register(f"with {R}, {sql.safe_ratio_ctes('uid', 'qid', 3)} select * from safe")
def safe_ratio_worker(spark, d):
    return reduction.safe_ratio(tb.responses(spark, d), "worker", 3, seed=SEED, hash_fn=HASH)


def _ratio_sql(mode: str) -> str:
    target, holder = ("qid", "uid") if mode == "task" else ("uid", "qid")
    safe = "safe as (select 0.1::double as safe_ratio)" if mode == "both" else sql.safe_ratio_ctes(target, holder, 1)
    on = {"worker": "rw <= floor(nw * ratio)", "task": "rt <= floor(nt * ratio)"}
    where = " and ".join(on.values()) if mode == "both" else on[mode]
    return f"""with {R}, {safe},
    kw as ({sql.ranks('r', 'uid', '42uid')}), kt as ({sql.ranks('r', 'qid', '42qid')}),
    x as (select r.qid, r.uid, kw.rk as rw, kw.n as nw, kt.rk as rt, kt.n as nt
          from r join kw on r.uid = kw.uid join kt on r.qid = kt.qid),
    l as (select {sql.linspace('1.0::double', 'safe_ratio', '10', 'i')} as ratio
          from safe, (select unnest(range(10)) as i))
    select round(ratio, 2) as ratio, {sql.COVERAGE} from x, l where {where} group by l.ratio"""


@register(_ratio_sql("worker"))
def ratio_ablation_worker(spark, d):
    return reduction.ratio_ablation(tb.responses(spark, d), "worker", seed=SEED, hash_fn=HASH).stats


@register(_ratio_sql("task"))
def ratio_ablation_task(spark, d):
    return reduction.ratio_ablation(tb.responses(spark, d), "task", seed=SEED, hash_fn=HASH).stats


@register(_ratio_sql("both"))
def ratio_ablation_both(spark, d):
    return reduction.ratio_ablation(tb.responses(spark, d), "both", seed=SEED, hash_fn=HASH).stats


_COPIES = """a as (select qid, uid, l_orderkey, l_linenumber,
      row_number() over (partition by qid, uid, l_orderkey, l_linenumber) as cp from r)"""
_ROW_HASH = sql.h(SEED, "qid", "uid", "l_orderkey", "l_linenumber", "cp")
_ROW_ORDER = f"{_ROW_HASH}, qid, uid, l_orderkey, l_linenumber, cp"


def _fixed_sql(mode: str, rows: str, order: str, step: int = 1, least: int = 1) -> str:
    group, entity = ("qid", "uid") if mode == "responses_per_task" else ("uid", "qid")
    return f"""with {rows},
    g as (select {group} as g, count(distinct {entity}) as dd from a group by 1),
    x as (select a.qid, a.uid, row_number() over (partition by {group} order by {order}) as rk, dd
          from a join g on a.{group} = g.g),
    l as (select unnest(range(0, greatest((select min(dd) from g) - {least}, 0) + 1, {step})) as remove),
    s as (select remove, {sql.COVERAGE} from x, l where rk <= greatest(dd - remove, {least}) group by remove),
    t as (select count(distinct qid) as q, count(distinct uid) as u from a)
    select '{mode}' as mode, s.* from s, t
    where remove < coalesce((select min(remove) from s, t where n_qid < q or n_uid < u), 1000000)"""


@register(_fixed_sql("responses_per_task", f"{R}, {_COPIES}", _ROW_ORDER))
def fixed_entity_responses_per_task(spark, d):
    return reduction.fixed_entity_ablation(tb.answer_rows(spark, d), "responses_per_task", seed=SEED, hash_fn=HASH).stats


@register(_fixed_sql(
    "tasks_per_worker", "a as (select event_type as qid, user_id as uid, event_id from events)",
    f"{sql.h(SEED, 'event_id')}, event_id",
))
def fixed_entity_tasks_per_worker(spark, d):
    return reduction.fixed_entity_ablation(
        tb.event_answers(spark, d), "tasks_per_worker", seed=SEED, row_key=["event_id"], hash_fn=HASH
    ).stats


@register(_fixed_sql("responses_per_task", f"{R}, {_COPIES}", _ROW_ORDER, 2, 2))
def fixed_entity_steps(spark, d):
    return reduction.fixed_entity_ablation(
        tb.answer_rows(spark, d), "responses_per_task", step=2, min_keep=2, seed=SEED, hash_fn=HASH
    ).stats


def _key_scenario_sql(key: str, name: str, counts: list[int]) -> str:
    return f"""with {R}, k as ({sql.ranks('r', key, SEED)}),
    l as (select i, {counts}[i] as c from (select unnest(range(1, {len(counts) + 1})) as i)),
    x as (select r.qid, r.uid, rk, n from r join k on r.{key} = k.{key})
    select any_value(least(c, n))::int as {name}, {sql.COVERAGE} from x, l where rk <= least(c, n) group by i"""


@register(_key_scenario_sql("uid", "workers", WORKER_COUNTS))
def scenario_worker(spark, d):
    return reduction.scenario(tb.responses(spark, d), "worker", SEED, hash_fn=HASH).stats


@register(_key_scenario_sql("qid", "tasks", TASK_COUNTS))
def scenario_task(spark, d):
    return reduction.scenario(tb.responses(spark, d), "task", SEED, hash_fn=HASH).stats


def _group_scenario_sql(group: str, name: str, most: int) -> str:
    return f"""with {R}, {_COPIES},
    x as (select qid, uid, row_number() over (partition by {group} order by {_ROW_ORDER}) as rk from a)
    select c::int as {name}, {sql.COVERAGE} from x, (select unnest(range(1, {most + 1})) as c) where rk <= c group by c"""


@register(_group_scenario_sql("uid", "tasks_per_worker", 20))
def scenario_tasks_per_worker(spark, d):
    return reduction.scenario(tb.answer_rows(spark, d), "tasks_per_worker", SEED, hash_fn=HASH).stats


@register(_group_scenario_sql("qid", "workers_per_task", 7))
def scenario_responses_per_task(spark, d):
    return reduction.scenario(tb.answer_rows(spark, d), "responses_per_task", SEED, hash_fn=HASH).stats


@register(f"""with {R}, {_COPIES},
    x as (select qid, uid, l_orderkey, l_linenumber, row_number() over (partition by qid order by {_ROW_ORDER}) as rk from a)
    select c::int as workers_per_task, qid, uid, l_orderkey, l_linenumber
    from x, (select unnest(range(1, 8)) as c) where rk <= c""")
def scenario_samples(spark, d):
    return reduction.scenario(tb.answer_rows(spark, d), "responses_per_task", SEED, hash_fn=HASH).samples()


# Rows that repeat: every copy has a number and can be drawn.
_EVENT_COPIES = """e as (select event_type as qid, user_id as uid,
    row_number() over (partition by event_type, user_id order by event_id) as copy from events)"""


def _copies_sql(group: str, name: str, most: int) -> str:
    order = f"{sql.h(SEED, 'qid', 'uid', 'copy')}, qid, uid, copy"
    return f"""with {_EVENT_COPIES},
    x as (select qid, uid, row_number() over (partition by {group} order by {order}) as rk from e)
    select c::int as {name}, {sql.COVERAGE} from x, (select unnest(range(1, {most + 1})) as c) where rk <= c group by c"""


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    return tb.event_answers(spark, d).select("qid", "uid")


@register(_copies_sql("uid", "tasks_per_worker", 20))
def scenario_tasks_per_worker_copies(spark, d):
    return reduction.scenario(_repeated(spark, d), "tasks_per_worker", SEED, hash_fn=HASH).stats


@register(_copies_sql("qid", "workers_per_task", 7))
def scenario_responses_per_task_copies(spark, d):
    return reduction.scenario(_repeated(spark, d), "responses_per_task", SEED, hash_fn=HASH).stats


# The mode in which every level has a draw of its own.
def _key_independent_sql(key: str, name: str, counts: list[int]) -> str:
    levels = " union all ".join(
        f"select {i} as pos, {c} as c, {key} as k, row_number() over (order by {sql.h(f'{SEED}{key}/{i}', key)}, {key}) as rk "
        f"from (select distinct {key} from r)" for i, c in enumerate(counts)
    )
    return f"""with {R}, k as ({levels})
    select any_value(least(c, (select count(distinct {key}) from r)))::int as {name}, {sql.COVERAGE}
    from r join k on r.{key} = k.k where rk <= c group by pos"""


@register(_key_independent_sql("uid", "workers", WORKER_COUNTS))
def scenario_worker_independent(spark, d):
    return reduction.scenario(tb.responses(spark, d), "worker", SEED, hash_fn=HASH, nested=False).stats


@register(_key_independent_sql("qid", "tasks", TASK_COUNTS))
def scenario_task_independent(spark, d):
    return reduction.scenario(tb.responses(spark, d), "task", SEED, hash_fn=HASH, nested=False).stats


def _group_independent_sql(group: str, name: str, most: int) -> str:
    first = sql.h(SEED, "event_id")
    return f"""with a as (select event_type as qid, user_id as uid, event_id, {first} as hh from events),
    x as (select c, qid, uid, row_number() over (partition by {group}, c order by {sql.h(SEED, 'c - 1', 'hh')}, event_id) as rk
          from a, (select unnest(range(1, {most + 1})) as c))
    select c::int as {name}, {sql.COVERAGE} from x where rk <= c group by c"""


@register(_group_independent_sql("uid", "tasks_per_worker", 20))
def scenario_tasks_per_worker_independent(spark, d):
    return reduction.scenario(
        tb.event_answers(spark, d), "tasks_per_worker", SEED, row_key=["event_id"], hash_fn=HASH, nested=False
    ).stats


@register(_group_independent_sql("qid", "workers_per_task", 7))
def scenario_responses_per_task_independent(spark, d):
    return reduction.scenario(
        tb.event_answers(spark, d), "responses_per_task", SEED, row_key=["event_id"], hash_fn=HASH, nested=False
    ).stats


def _safe_independent_ctes(trials: int = 20, points: int = 50, target: str = "qid", holder: str = "uid", m: int = 1) -> str:
    """CTE ``safe`` where every point of the grid has trials of its own; workers answer, tasks are drawn."""
    return f"""
    p as (select distinct {target} as t, {holder} as o from r),
    d as (select trial, t, {sql.h(42, 'trial', 't')} as hh
          from (select distinct t from p), (select unnest(range(1, {trials * points + 1})) as trial)),
    place as (select trial, o, hh, row_number() over (partition by trial, o order by hh, t) as rn from p join d using (t)),
    reach as (select trial, max(hh) as reach, count(*) as no from place where rn = {m} group by trial),
    tg as (select trial, count(*) as total, count(*) filter (where hh <= reach) as rk, max(no) as no
           from d join reach using (trial) group by trial),
    need as (select (trial - 1) // {trials} as i, max(total) as total, max(rk) as required_k,
                    min(no) = (select count(distinct o) from p) as feasible from tg group by 1),
    grid as (select i, {sql.linspace('1.0::double', '0.1::double', str(points), 'i')} as ratio
             from (select unnest(range(0, {points})) as i)),
    judged as (select coalesce(min(case when not feasible or greatest(floor(total * ratio)::bigint, {m}) < required_k then i end), {points}) - 1 as good,
               max(required_k) as required_k, max(total) as total, bool_and(feasible) as feasible from need join grid using (i)),
    safe as (select case when good < 0 then 1.0::double else (select ratio from grid where i = good) end as safe_ratio,
                    case when feasible then required_k end as required_k, total, feasible from judged)"""


@register(f"with r as (select qid, uid from (select event_type as uid, user_id as qid from events)), {_safe_independent_ctes()} select * from safe")
def safe_ratio_independent(spark, d):
    answers = tb.event_answers(spark, d).select(F.col("uid").alias("qid"), F.col("qid").alias("uid"))
    return reduction.safe_ratio(answers, "task", hash_fn=HASH, nested=False)


_FEW = {"check_points": 10, "trials": 5}


@register(f"with {R}, {_safe_independent_ctes(5, 10, m=2)} select * from safe")
def safe_ratio_of_two_independent(spark, d):
    return reduction.safe_ratio(tb.responses(spark, d), "task", 2, seed=SEED, hash_fn=HASH, nested=False, **_FEW)


@register(f"with {R}, {_safe_independent_ctes(5, 10, 'uid', 'qid', 3)} select * from safe")
def safe_ratio_worker_independent(spark, d):
    return reduction.safe_ratio(tb.responses(spark, d), "worker", 3, seed=SEED, hash_fn=HASH, nested=False, **_FEW)


def _ratio_independent_sql(mode: str) -> str:
    target, holder = ("qid", "uid") if mode == "task" else ("uid", "qid")
    safe = "safe as (select 0.1::double as safe_ratio)" if mode == "both" else _safe_independent_ctes(5, 10, target, holder)
    keys = {"worker": ["uid"], "task": ["qid"], "both": ["uid", "qid"]}[mode]
    orders = ", ".join(
        f"k{k} as (select pos, ratio, {k}, row_number() over (partition by pos order by cast('0x' || substr(md5(concat('42{k}/', pos, ':', {k})), 1, 12) as bigint), {k}) as rk, "
        f"count(*) over (partition by pos) as n from (select distinct {k} from r), l)" for k in keys
    )
    chosen = " join ".join(f"(select pos, ratio, {k} from k{k} where rk <= floor(n * ratio)) c{k}" for k in keys)
    chosen += " using (pos, ratio)" if len(keys) == 2 else ""
    return f"""with {R}, {safe},
    l as (select i as pos, {sql.linspace('1.0::double', 'safe_ratio', '10', '(9 - i)')} as ratio from safe, (select unnest(range(10)) as i)),
    {orders}, c as (select * from {chosen})
    select round(ratio, 2) as ratio, {sql.COVERAGE} from r join c using ({', '.join(keys)}) group by pos, c.ratio"""


@register(_ratio_independent_sql("worker"))
def ratio_ablation_worker_independent(spark, d):
    return reduction.ratio_ablation(tb.responses(spark, d), "worker", seed=SEED, hash_fn=HASH, nested=False, **_FEW).stats


@register(_ratio_independent_sql("task"))
def ratio_ablation_task_independent(spark, d):
    return reduction.ratio_ablation(tb.responses(spark, d), "task", seed=SEED, hash_fn=HASH, nested=False, **_FEW).stats


@register(_ratio_independent_sql("both"))
def ratio_ablation_both_independent(spark, d):
    return reduction.ratio_ablation(tb.responses(spark, d), "both", seed=SEED, hash_fn=HASH, nested=False, **_FEW).stats


def _fixed_independent_sql(mode: str, rows: str, row_hash: str, ties: str) -> str:
    group, entity = ("qid", "uid") if mode == "responses_per_task" else ("uid", "qid")
    return f"""with {rows}, b as (select *, {row_hash} as hh from a),
    g as (select {group} as g, count(distinct {entity}) as dd from a group by 1),
    l as (select unnest(range(0, (select min(dd) from g))) as remove),
    x as (select remove, qid, uid, dd, row_number() over (partition by {group}, remove order by {sql.h(SEED, 'remove', 'hh')}, {ties}) as rk
          from b join g on b.{group} = g.g, l),
    s as (select remove, {sql.COVERAGE} from x where rk <= greatest(dd - remove, 1) group by remove),
    t as (select count(distinct qid) as q, count(distinct uid) as u from a)
    select '{mode}' as mode, s.* from s, t
    where remove < coalesce((select min(remove) from s, t where n_qid < q or n_uid < u), 1000000)"""


@register(_fixed_independent_sql("responses_per_task", f"{R}, {_COPIES}", _ROW_HASH, "qid, uid, l_orderkey, l_linenumber, cp"))
def fixed_entity_independent(spark, d):
    return reduction.fixed_entity_ablation(tb.answer_rows(spark, d), "responses_per_task", seed=SEED, hash_fn=HASH, nested=False).stats


@register(_fixed_independent_sql(
    "tasks_per_worker", "a as (select event_type as qid, user_id as uid, event_id from events)", sql.h(SEED, "event_id"), "event_id",
))
def fixed_entity_tasks_independent(spark, d):
    return reduction.fixed_entity_ablation(
        tb.event_answers(spark, d), "tasks_per_worker", seed=SEED, row_key=["event_id"], hash_fn=HASH, nested=False
    ).stats


@register(_fixed_independent_sql(
    "tasks_per_worker", "a as (select event_id % 3 as qid, event_type as uid, event_id from events)", sql.h(SEED, "event_id"), "event_id",
))
def fixed_entity_independent_large_groups(spark, d):
    """Few groups of so many rows each that their hashes are not gathered."""
    answers = tb.table(spark, d, "events").select((F.col("event_id") % 3).alias("qid"), F.col("event_type").alias("uid"), "event_id")
    return reduction.fixed_entity_ablation(
        answers, "tasks_per_worker", seed=SEED, row_key=["event_id"], hash_fn=HASH, nested=False, piece_rows=500
    ).stats


# --- summaries -------------------------------------------------------------------------------------

_ERRORS = "e as (select event_type as agent, (user_id % 20 + 1)::int as num_workers, value as error from events)"
_SUMMARY = f"""{_ERRORS}, m as (select agent, num_workers, avg(error) as mean, stddev_samp(error) as std,
      case when count(*) > 1 then 1.96::double * stddev_samp(error) / sqrt(count(*)) else 0.0 end as ci
    from e group by 1, 2)"""


@register(f"""with {_SUMMARY} select agent, num_workers, round(mean, 6) as mean, round(std, 6) as std, round(ci, 6) as ci from m""")
def error_summary(spark, d):
    return rounded(summary.error_summary(tb.errors_long(spark, d)), 6, "mean", "std", "ci")


_Z = 1.959963984540054
_T = """(z + (pow(z,3) + z) / (4 * f) + (5 * pow(z,5) + 16 * pow(z,3) + 3 * z) / (96 * pow(f,2))
    + (3 * pow(z,7) + 19 * pow(z,5) + 17 * pow(z,3) - 15 * z) / (384 * pow(f,3))
    + (79 * pow(z,9) + 776 * pow(z,7) + 1482 * pow(z,5) - 1920 * pow(z,3) - 945 * z) / (92160 * pow(f,4)))"""


@register(f"""with {_ERRORS}, g as (select agent, count(*) as n, avg(error) as mean, stddev_samp(error) as std,
      {_Z}::double as z, (count(*) - 1)::double as f from e group by 1)
    select agent, n, round(mean, 6) as mean, round(std / sqrt(n) * {_T}, 6) as h from g""")
def mean_ci_t(spark, d):
    return rounded(summary.mean_ci(tb.errors_long(spark, d), ["agent"], "error"), 6, "mean", "h")


_NW = "(l_suppkey % 20 + 1)::int as num_workers"


@register(f"""select {_NW}, 'pure' as agent, l_discount as error from lineitem
    union all select {_NW}, 'pure', l_tax from lineitem
    union all select {_NW}, 'blended', l_quantity from lineitem where l_linestatus <> 'O'""")
def flatten_errors(spark, d):
    return summary.flatten_errors(tb.error_records(spark, d), ["pure", "blended"])[0]


@register(f"select {_NW}, l_extendedprice as time from lineitem")
def flatten_times(spark, d):
    return summary.flatten_errors(tb.error_records(spark, d), ["pure", "blended"])[1]


@register(f"""with {_ERRORS}, t as (select agent, num_workers, round(avg(error), 6) as time from e group by 1, 2)
    select num_workers, a.time as time_a, b.time as time_b from
    (select * from t where agent = 'click') a join (select * from t where agent = 'view') b using (num_workers)""")
def compare_times(spark, d):
    return summary.compare_times(tb.mean_times(spark, d, "click"), tb.mean_times(spark, d, "view"))


@register(f"""with {_SUMMARY} select case agent when 'view' then 0 else 1 end::int as ord, agent,
    case agent when 'view' then 'Page view' else replace(agent, '_', ' ') end as label, num_workers as x,
    round(mean, 6) as y, round(mean - ci, 6) as lower, round(mean + ci, 6) as upper
    from m where agent in ('view', 'click')""")
def band_table(spark, d):
    bands = summary.band_table(summary.error_summary(tb.errors_long(spark, d)), ["view", "click"], {"view": "Page view"})
    return rounded(bands, 6, "y", "lower", "upper")


@register(f"""with {_SUMMARY}, s as (select case agent when 'view' then 'A' else 'B' end as label, num_workers as x,
      round(mean, 6) as y, round(mean - ci, 6) as lower, round(mean + ci, 6) as upper from m where agent in ('view', 'click'))
    select x, label, y, lower, upper from s""")
def band_pair(spark, d):
    m = summary.error_summary(tb.errors_long(spark, d))
    one = m.filter(F.col("agent") == "view").select("num_workers", F.col("mean").alias("m1"), F.col("ci").alias("c1"))
    two = m.filter(F.col("agent") == "click").select("num_workers", F.col("mean").alias("m2"), F.col("ci").alias("c2"))
    pair = one.join(two, "num_workers")
    return rounded(summary.band_pair(pair, "num_workers", ("m1", "c1"), ("m2", "c2"), ("A", "B")), 6, "y", "lower", "upper")


def _axis_sql(runs: str) -> str:
    return f"""with runs as ({runs}),
    a as (select round_even(avg(n), 0)::int as length, max(first) as k_start, min(last) as k_end from runs)
    select length, i::int as pos, round({sql.linspace('k_start', 'k_end', 'length', 'i')}, 6) as k
    from a, (select unnest(range(length)) as i from a)"""


@register(_axis_sql("select user_id, count(value) as n, min(value) as first, max(value) as last from events group by user_id"))
def fixed_k(spark, d):
    return rounded(summary.fixed_k_long(tb.table(spark, d, "events"), "user_id", "value"), 6, "k")


@register(_axis_sql("select len(embedding) as n, embedding[1]::double as first, embedding[-1]::double as last from embeddings"))
def fixed_k_arrays(spark, d):
    return rounded(summary.fixed_k(tb.table(spark, d, "embeddings"), "embedding"), 6, "k")


# --- population ------------------------------------------------------------------------------------



def _marginals_sql(source: str) -> str:
    return f"""mg as (select feature, value, n, n::double / sum(n) over (partition by feature) as p from (
      select 'l_returnflag' as feature, l_returnflag as value, count(*) as n from {source} group by 2
      union all select 'l_linestatus', l_linestatus, count(*) from {source} group by 2))"""


_MARGINALS = _marginals_sql("lineitem")


@register(f"with {_MARGINALS} select * from mg")
def fit_marginals(spark, d):
    return population.fit_marginals(tb.responses(spark, d), FEATURES)


@register(f"with {_MARGINALS} select * from mg", "marginals_from_one_hot")
def _marginals_from_one_hot(spark, d):
    coded, _ = rs.one_hot(tb.responses(spark, d).select("qid", *FEATURES), FEATURES)
    groups = {f: {c[len(f) + 1:]: c for c in coded.columns if c.startswith(f + "_")} for f in FEATURES}
    return population.marginals_from_one_hot(coded, groups)


def _draw_ctes(weight: str, source: str = "mg", name: str = "iv") -> str:
    return f"""{name}w as (select feature, value, {weight} as w, {sql.h('', 'value')} as hh from {source}),
    {name} as (select feature, value, sum(w) over (partition by feature order by hh, value) - w as lo,
      sum(w) over (partition by feature order by hh, value) as hi, sum(w) over (partition by feature) as total from {name}w)"""


def _drawn(ids: str, key: str, feature: str, iv: str = "iv") -> str:
    place = f"floor({sql.u(SEED, key, repr(feature))} * total::double)"
    return f"(select {key}, value as {feature} from {ids}, {iv} where feature = '{feature}' and {place} >= lo and {place} < hi)"


def _population_sql(weight: str) -> str:
    one, two = (_drawn("ids", "uid", f) for f in FEATURES)
    return f"""with {_MARGINALS}, {_draw_ctes(weight)}, ids as (select c_custkey as uid from customer)
    select uid, l_returnflag, l_linestatus from {one} join {two} using (uid)"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "customer").select(F.col("c_custkey").alias("uid"))


def _population(spark: SparkSession, d: str, ids: DataFrame, **options) -> DataFrame:
    marginals = population.fit_marginals(tb.responses(spark, d), FEATURES)
    return population.sample_population(marginals, ids, SEED, hash_fn=HASH, **options).select("uid", *FEATURES)


@register(_population_sql("n"))
def sample_population(spark, d):
    return _population(spark, d, _customers(spark, d))


@register(_population_sql("round(exp((p - max(p) over (partition by feature)) / 0.5::double) * 1099511627776::double)::bigint"))
def sample_population_temp(spark, d):
    return _population(spark, d, _customers(spark, d), temperature=0.5)


def _redraw_sql() -> str:
    return _population_sql("n").replace(f"'{SEED}', cast(uid", f"'{SEED + 1}', cast(uid")


@register(_redraw_sql())
def redraw_population(spark, d):
    marginals = population.fit_marginals(tb.responses(spark, d), FEATURES)
    drawn = population.sample_population(marginals, _customers(spark, d), SEED + 1, hash_fn=HASH)
    return drawn.select("uid", *FEATURES)


@register(_population_sql("1"))
def sample_population_uniform(spark, d):
    return _population(spark, d, _customers(spark, d), uniform=True)


@register(f"""with {_MARGINALS}, {_draw_ctes('n')}, ids as (select c_custkey as uid from customer),
    dr as (select uid, l_returnflag, l_linestatus from {_drawn('ids', 'uid', 'l_returnflag')}
           join {_drawn('ids', 'uid', 'l_linestatus')} using (uid))
    select uid, {_ONE_HOT_SQL} from dr""")
def population_one_hot(spark, d):
    vocabulary = rs.one_hot_fit(tb.responses(spark, d), FEATURES)
    return rs.one_hot_apply(_population(spark, d, _customers(spark, d)), vocabulary)


@register(f"""with mg as (select distinct 'o_orderstatus' as feature, o_orderstatus as value from orders
      union select distinct 'o_orderpriority', o_orderpriority from orders),
    {_draw_ctes('1')}, ids as (select doc_id as qid from documents)
    select qid, o_orderstatus, o_orderpriority from {_drawn('ids', 'qid', 'o_orderstatus')}
    join {_drawn('ids', 'qid', 'o_orderpriority')} using (qid)""")
def assign_persona(spark, d):
    docs = tb.table(spark, d, "documents").select(F.col("doc_id").alias("qid"))
    return population.assign_persona(docs, tb.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], SEED, hash_fn=HASH)


def _pick(name: str, size: int) -> str:
    return f"floor({sql.u(SEED, 'uid', repr(name))} * {size})::bigint"


@register(f"""with ids as (select c_custkey as uid from customer),
    c as (select uid, 1 + {_pick('cut1', 98)} as a, 1 + {_pick('cut2', 97)} as b0, {_pick('district', 4)} as ds from ids),
    e as (select uid, a, case when b0 >= a then b0 + 1 else b0 end as b, ds from c)
    select uid, least(a, b) as transport, greatest(a, b) - least(a, b) as culture, 100 - greatest(a, b) as nature,
    {', '.join(f'{_pick(n, 5)} as {n}' for n in PREFERENCE_SCORES)},
    {', '.join(f'(ds = {i})::bigint as {n}' for i, n in enumerate(DISTRICTS))} from e""")
def random_preferences(spark, d):
    return population.random_preferences(spark, _customers(spark, d), SEED, hash_fn=HASH)


@register(f"""select s_suppkey as uid, count(*)::int as dim, round(sum({sql.u(SEED, 's_suppkey', 'j')}::float::double * (j + 1)), 4) as total
    from supplier, (select unnest(range({RANDOM_VECTOR_SIZE})) as j) group by s_suppkey""")
def random_vectors(spark, d):
    vectors = population.random_vectors(spark, tb.worker_ids(spark, d), seed=SEED, hash_fn=HASH)
    return vectors.select("uid", F.size("comment").alias("dim"), _vector_sum("comment").alias("total"))


# --- ratings ---------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(persona: str) -> str:
    before, _, rest = ratings.TEMPLATE.partition("{persona}")
    middle, _, after = rest.partition("{text}")
    return f"{_quoted(before)} || {persona} || {_quoted(middle)} || text || {_quoted(after)}"


_PERSONA = "'Lang: ' || lang || ' | Source: ' || source"


@register(f"select doc_id as qid, {_prompt_sql(_PERSONA)} as prompt from documents")
def build_prompts(spark, d):
    return ratings.build_prompts(_documents(spark, d), ["lang", "source"]).select("qid", "prompt")


@register(f"select conv_id, turn, {_prompt_sql(_quoted('general human'))} as prompt from conversations")
def build_prompts_general(spark, d):
    return ratings.build_prompts(tb.table(spark, d, "conversations")).select("conv_id", "turn", "prompt")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text", "lang", "source")


def _validated_sql(source: str) -> str:
    """Adds rating and status to rows with the column ``reply``."""
    return f"""select * exclude (found), case when len(found) = 1 then found[1]::int end as llm_rating,
      case when len(found) = 0 then 'INVALID: {NO_NUMBER}' || reply
           when len(found) > 1 then 'INVALID: {MANY_NUMBERS}[''' || array_to_string(found, ''', ''') || ''']'
           else 'VALID' end as validation_status
    from (select *, regexp_extract_all(reply, '\\b[1-5]\\b') as found from
          (select * replace (regexp_replace(reply, '^\\s+|\\s+$', '', 'g') as reply) from ({source})))"""


@register(f"select event_id, llm_rating, validation_status from ({_validated_sql('select event_id, props as reply from events')})")
def validate_ratings(spark, d):
    out = ratings.validate_ratings(tb.table(spark, d, "events"), "props")
    return out.select("event_id", "llm_rating", "validation_status")


@register(f"select doc_id, llm_rating, validation_status from ({_validated_sql('select doc_id, text as reply from documents')})")
def validate_ratings_text(spark, d):
    out = ratings.validate_ratings(tb.table(spark, d, "documents"), "text")
    return out.select("doc_id", "llm_rating", "validation_status")


def length_responder(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model."""
    return [f"Difficulty: {len(p) % 7}" for p in prompts]


_RATED = _validated_sql(
    f"select doc_id as qid, 'Difficulty: ' || (length({_prompt_sql(_PERSONA)}) % 7) as reply from documents"
)


_PROMPTED = f"select doc_id as qid, lang, {_prompt_sql(_PERSONA)} as prompt from documents"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return ratings.rate(ratings.build_prompts(_documents(spark, d), ["lang", "source"]), length_responder, 8)


@register(f"select qid, reply, llm_rating, validation_status from ({_RATED})")
def rate_tasks(spark, d):
    return _rated(spark, d).select("qid", "reply", "llm_rating", "validation_status")


@register(f"""select case when validation_status = 'VALID' then 'valid' when validation_status like 'INVALID: {NO_NUMBER}%'
      then 'no number' else 'several numbers' end as kind, llm_rating, count(*) as n,
      count(*)::double / (select count(*) from documents) as share from ({_RATED}) group by 1, 2""")
def rating_summary(spark, d):
    return ratings.rating_summary(_rated(spark, d))


@register(f"""select v.qid, reply, llm_rating, validation_status,
      case when p.prompt in (select prompt from ({_PROMPTED}) where lang = 'en') then 'first' else 'second' end as run
    from ({_RATED}) v join ({_PROMPTED}) p using (qid)""")
def rate_tasks_resumed(spark, d):
    """The ledger of a first run over the English tasks, and a second run over all."""
    ledger = shared_folder(spark, "ledger")
    prompts = ratings.build_prompts(_documents(spark, d), ["lang", "source"])
    ratings.rate_resumed(prompts.filter(F.col("lang") == "en"), length_responder, 8, ledger, "first")
    return ratings.rate_resumed(prompts, length_responder, 8, ledger, "second").select("qid", "reply", "llm_rating", "validation_status", "run")


_TASK_PERSONA = f"""with mg as (select distinct 'o_orderstatus' as feature, o_orderstatus as value from orders
      union select distinct 'o_orderpriority', o_orderpriority from orders),
    {_draw_ctes('1')}, ids as (select doc_id as qid from documents),
    who as (select qid, o_orderstatus, o_orderpriority from {_drawn('ids', 'qid', 'o_orderstatus')}
            join {_drawn('ids', 'qid', 'o_orderpriority')} using (qid))"""
_WHO = "'O_orderstatus: ' || o_orderstatus || ' | O_orderpriority: ' || o_orderpriority"
_ASKED = f"select qid, 'Difficulty: ' || (length({_prompt_sql(_WHO)}) % 7) as reply from who join documents on doc_id = qid"


def _answered(spark: SparkSession, d: str, **options) -> DataFrame:
    docs = tb.table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text")
    return answer_tasks(docs, length_responder, seed=SEED, hash_fn=HASH, **options).select("qid", "reply", "llm_rating", "validation_status")


@register(f"{_TASK_PERSONA} select qid, reply, llm_rating, validation_status from ({_validated_sql(_ASKED)})")
def answer_tasks_personas(spark, d):
    return _answered(spark, d, attributes=tb.table(spark, d, "orders"), columns=["o_orderstatus", "o_orderpriority"])


@register(f"""select qid, reply, llm_rating, validation_status from ({_validated_sql(
    "select doc_id as qid, 'Difficulty: ' || (length(" + _prompt_sql(_quoted('general human')) + ") % 7) as reply from documents")})""")
def answer_tasks_general(spark, d):
    return _answered(spark, d, multi_persona=False)


@register("select doc_id as qid, 'Q: ' || text || ' P: Lang: ' || lang || ' | Source: ' || source || '.' as prompt from documents")
def prompts_text_first(spark, d):
    return ratings.build_prompts(_documents(spark, d), ["lang", "source"], "Q: {text} P: {persona}.").select("qid", "prompt")


# --- scoring ---------------------------------------------------------------------------------------


def _weights(spark: SparkSession) -> scoring.Weights:
    return scoring.load_weights(scoring.init_weights(spark, VECTOR, CONTEXTS, LATENT, seed=SEED, hash_fn=HASH), VECTOR)


def _config(spark: SparkSession, d: str, **options) -> ScoringConfig:
    bounds = rs.score_range(tb.responses(spark, d)).first()
    return ScoringConfig(bounds["score_min"], bounds["score_max"], seed=SEED, hash_fn=HASH, precision="float64", **options)


_NET = sql.network_ctes(VECTOR, CONTEXTS, LATENT)
_BOUNDS = "bd as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)"
_TASKS = """tk as (select vec_id as qid, (label % 5 + 1)::double as ref, list_transform(embedding, lambda x: x::double) as x,
      list_transform(range(5), lambda j: case when label % 5 = j then 1.0::double else 0.0::double end) as c from embeddings)"""


def _task_contexts(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label") % CONTEXTS
    context = F.array(*[F.when(label == j, 1.0).otherwise(0.0) for j in range(CONTEXTS)])
    return tb.grid_tasks(spark, d).join(
        tb.table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), context.alias("context")), "qid"
    )


_ENCODED = f"""{_NET}, {_TASKS}, xc as (select qid, ref, c, list_concat(x, c) as v from tk),
    hd as ({sql.dense('fc1', 'xc', 'qid', 'v', 'hl', elu=True)}),
    mu as ({sql.dense('fc21', 'hd', 'qid', 'hl', 'mu')}), lv as ({sql.dense('fc22', 'hd', 'qid', 'hl', 'logvar')})"""


@register(f"""with {_ENCODED} select qid, {', '.join(f'round(mu[{i}], 6) as mu{i}, round(logvar[{i}], 6) as logvar{i}' for i in range(1, 5))}
    from mu join lv using (qid)""")
def encode_beliefs(spark, d):
    out = scoring.encode(_task_contexts(spark, d), _weights(spark), "x", "context")
    return out.select("qid", *[F.round(F.col(n)[i], 6).alias(f"{n}{i + 1}") for i in range(LATENT) for n in ("mu", "logvar")])


@register(f"""with {_ENCODED} select qid, {', '.join(
    f"round(mu[{i}] + {sql.normal(SEED, 'qid', str(i - 1))} * exp(logvar[{i}] * 0.5::double), 6) as z{i}" for i in range(1, 5))}
    from mu join lv using (qid)""")
def reparameterize(spark, d):
    out = scoring.encode(_task_contexts(spark, d), _weights(spark), "x", "context")
    z = scoring.reparameterize("mu", "logvar", SEED, "qid", hash_fn=HASH)
    return out.select("qid", z.alias("z")).select("qid", *[F.round(F.col("z")[i], 6).alias(f"z{i + 1}") for i in range(LATENT)])


def _blend_sql(ref: str) -> str:
    z = ", ".join(f"mu[{i}] + {sql.normal(SEED, 'qid', str(i - 1))} * exp(logvar[{i}] * 0.5::double)" for i in range(1, LATENT + 1))
    return f"""with {_ENCODED}, {_BOUNDS},
    zc as (select qid, ref, list_concat([{z}], c) as v from tk join mu using (qid) join lv using (qid)),
    b1 as ({sql.dense('fc', 'zc', 'qid', 'v', 'o')}), b2 as ({sql.dense('fcc', 'b1', 'qid', 'o', 'o')}),
    b3 as ({sql.dense('gc1', 'b2', 'qid', 'o', 'o')})
    select qid, round({sql.clamp(f"{ref} + o[1] + {sql.normal('42d', 'qid')} * 0.5::double", 'lo', 'hi')}, 6) as score
    from zc join b3 using (qid), bd"""


def _blended(spark: SparkSession, d: str, only_generative: bool, **options) -> DataFrame:
    weights = _weights(spark)
    encoded = scoring.encode(_task_contexts(spark, d), weights, "x", "context")
    df = encoded.withColumn("z", scoring.reparameterize("mu", "logvar", SEED, "qid", hash_fn=HASH))
    out = scoring.blend(df, weights, _config(spark, d, **options), "z", "context", "ref", ["qid"], only_generative)
    return rounded(out.select("qid", "score"), 6, "score")


@register(_blend_sql("ref"))
def blend_scores(spark, d):
    return _blended(spark, d, False)


@register(_blend_sql("2.5::double"))
def blend_scores_generative(spark, d):
    return _blended(spark, d, True, fixed_reference=2.5)


_PROFILES = f"""{_draw_ctes('n')}, ids as (select s_suppkey as uid from supplier),
    pr as (select uid, [{', '.join(f"(l_{f} = '{v}')::int::double" for f, v in
      [('returnflag', 'A'), ('returnflag', 'N'), ('returnflag', 'R'), ('linestatus', 'F'), ('linestatus', 'O')])}] as pc
      from {_drawn('ids', 'uid', 'l_returnflag')} join {_drawn('ids', 'uid', 'l_linestatus')} using (uid))"""


_TRAIN = f"""{R}, ks as ({sql.ranks('r', 'qid', SEED)}),
    tr as (select r.* from r join ks on r.qid = ks.qid where rk > ceil(0.2::double * n))"""


def _grid_sql(collapsed: bool, marginals: str = _MARGINALS, ref: str = "ref") -> str:
    """Layer by layer for every pair, without the rewrites of the operator."""
    eps = [sql.normal(SEED, "uid", "qid", str(j)) for j in range(LATENT)]
    z = ", ".join(f"mu[{j + 1}] + {e} * exp(0.5::double * lv[{j + 1}])" for j, e in enumerate(eps))
    if collapsed:
        noise = " + ".join(f"pow(wz[{j}], 2) * exp(lv[{j}])" for j in range(1, LATENT + 1))
        z = ", ".join(f"mu[{j + 1}]" for j in range(LATENT))
        extra = f" + {sql.normal(SEED, 'uid', 'qid')} * sqrt({noise})"
        wz = """, wv as (select [sum(g * f * w[1]), sum(g * f * w[2]), sum(g * f * w[3]), sum(g * f * w[4])] as wz from
          (select unnest(w) as g, unnest(range(10)) as k from gc1) join (select unit as k, unnest(w) as f, unnest(range(4)) as m from fcc) using (k)
          join (select unit as m, w from fc) using (m))"""
    else:
        extra, wz = "", ""
    return f"""with {_NET}, {_TASKS}, {_BOUNDS}, {marginals}, {_PROFILES}{wz},
    pairs as (select qid, uid, ref, pc, list_concat(x, pc) as v from tk, pr),
    hx as (select qid, list(list_dot_product(w[1:64], x) + b order by unit) as a from tk, fc1 group by qid),
    hc as (select uid, list(list_dot_product(w[65:69], pc) order by unit) as a from pr, fc1 group by uid),
    hid as (select qid, uid, list_transform(list_zip(hx.a, hc.a), lambda e: case when e[1] + e[2] > 0 then e[1] + e[2]
              else exp(e[1] + e[2]) - 1 end) as hl from hx, hc),
    f1 as (select list(w order by unit) as ws, list(b order by unit) as bs from fc21),
    f2 as (select list(w order by unit) as ws, list(b order by unit) as bs from fc22),
    bel as (select qid, uid, list_transform(range(1, 5), lambda i: list_dot_product(f1.ws[i], hl) + f1.bs[i]) as mu,
              list_transform(range(1, 5), lambda i: list_dot_product(f2.ws[i], hl) + f2.bs[i]) as lv from hid, f1, f2),
    zs as (select qid, uid, lv, list_concat([{z}], pc) as zc, ref from bel join pairs using (qid, uid)),
    o1 as (select qid, uid, ref, lv, list_transform(range(1, 5), lambda i: list_dot_product(ws[i], zc) + bs[i]) as o
           from zs, (select list(w order by unit) as ws, list(b order by unit) as bs from fc)),
    o2 as (select qid, uid, ref, lv, list_transform(range(1, 11), lambda i: list_dot_product(ws[i], o) + bs[i]) as o
           from o1, (select list(w order by unit) as ws, list(b order by unit) as bs from fcc)),
    o3 as (select qid, uid, ref, lv, list_dot_product(w, o) + b as bias from o2, gc1)
    select uid, qid, round({sql.clamp(f"{ref} + bias{extra} + {sql.normal('42d', 'uid', 'qid')} * 0.5::double", 'lo', 'hi')}, 5) as score
    from o3, bd{', wv' if collapsed else ''}"""


def _grid(spark: SparkSession, d: str, collapsed: bool) -> DataFrame:
    vocabulary = rs.one_hot_fit(tb.responses(spark, d), FEATURES)
    profiles = sim.profile_contexts(_population(spark, d, tb.worker_ids(spark, d)), vocabulary)
    return rounded_scores(
        scoring.score_grid(tb.grid_tasks(spark, d), profiles, _weights(spark), _config(spark, d), collapsed=collapsed)
    )


@register(_grid_sql(False))
def score_grid(spark, d):
    return _grid(spark, d, False)


@register(_grid_sql(True))
def score_grid_collapsed(spark, d):
    return _grid(spark, d, True)


@register(_grid_sql(False, f"{_TRAIN}, {_marginals_sql('tr')}", "2.0::double"))
def simulate(spark, d):
    out = sim.simulate(
        tb.responses(spark, d), tb.grid_tasks(spark, d), FEATURES, tb.worker_ids(spark, d), _weights(spark),
        seed=SEED, fixed_reference=2.0, hash_fn=HASH, precision="float64",
    )
    return rounded_scores(out)


@register(_grid_sql(False, f"{_TRAIN}, {_marginals_sql('tr')}"))
def simulate_references(spark, d):
    """Every task with the reference rating of its own."""
    out = sim.simulate(
        tb.responses(spark, d), tb.grid_tasks(spark, d), FEATURES, tb.worker_ids(spark, d), _weights(spark),
        seed=SEED, hash_fn=HASH, precision="float64",
    )
    return rounded_scores(out)


# A feature of as many categories as there are tasks: contexts are places, not columns.
_WIDE = ["l_returnflag", "part"]
_VOCABULARY = """vt as (select position, value, row_number() over (order by position, value) - 1 as idx from (
      select distinct 0 as position, l_returnflag as value from r union select distinct 1, qid::varchar from r))"""


def _wide_layers(hidden: int = 400, blend: int = 10) -> str:
    """Weights as rows (unit, j, w) where the inputs are as many as the vocabulary has values."""
    def cells(name: str, first: str, count: str, inputs: str, units: int) -> str:
        return (
            f"select unit, j, ({sql.u(42, repr(name), 'unit', 'j')} * 2 - 1) * (1.0::double / sqrt({inputs}::double)) as w from "
            f"(select unnest(range({units})) as unit), (select unnest(range({first}, {first} + {count})) as j from nv), nv"
        )

    def bias(name: str, inputs: str, units: int) -> str:
        return f"select unit, ({sql.u(42, repr(name), 'unit', repr('b'))} * 2 - 1) * (1.0::double / sqrt({inputs}::double)) as b from (select unnest(range({units})) as unit), nv"

    narrow = {"fc21": (hidden, LATENT), "fc22": (hidden, LATENT), "fcc": (LATENT, blend), "gc1": (blend, 1)}
    return ", ".join([
        "nv as (select count(*) as n from vt)",
        f"fc1x as ({cells('fc1', '0', str(VECTOR), f'({VECTOR} + n)', hidden)})", f"fc1c as ({cells('fc1', str(VECTOR), 'n', f'({VECTOR} + n)', hidden)})",
        f"fc1b as ({bias('fc1', f'({VECTOR} + n)', hidden)})",
        f"fcz as ({cells('fc', '0', str(LATENT), f'({LATENT} + n)', LATENT)})", f"fcc_ as ({cells('fc', str(LATENT), 'n', f'({LATENT} + n)', LATENT)})",
        f"fcb as ({bias('fc', f'({LATENT} + n)', LATENT)})",
        *[f"{n} as ({sql.layer(n, *size)})" for n, size in narrow.items()],
    ])


def _sparse_sql() -> str:
    eps = [sql.normal(SEED, "uid", "qid", str(j)) for j in range(LATENT)]
    z = ", ".join(f"mu[{j + 1}] + {e} * exp(0.5::double * lv[{j + 1}])" for j, e in enumerate(eps))
    marginals = """mg as (select feature, value, n from (
      select 'l_returnflag' as feature, l_returnflag as value, count(*) as n from tr group by 2
      union all select 'part', qid::varchar, count(*) from tr group by 2))"""
    return f"""with {_TRAIN}, {_VOCABULARY}, {_wide_layers()}, {_TASKS}, {_BOUNDS}, {marginals}, {_draw_ctes('n')},
    ids as (select s_suppkey as uid from supplier),
    dr as (select * from {_drawn('ids', 'uid', 'l_returnflag')} join {_drawn('ids', 'uid', 'part')} using (uid)),
    pl as (select uid, idx from dr join vt on position = 0 and value = l_returnflag
           union all select uid, idx from dr join vt on position = 1 and value = part),
    hx as (select qid, list(h order by unit) as a from (
      select qid, fc1x.unit, sum(w * xv) + any_value(b) as h from (select qid, unnest(x) as xv, unnest(range({VECTOR})) as j from tk)
      join fc1x using (j) join fc1b on fc1x.unit = fc1b.unit group by qid, fc1x.unit) group by qid),
    hc as (select uid, list(h order by unit) as a from (
      select uid, unit, sum(w) as h from pl join fc1c on j = idx + {VECTOR} group by uid, unit) group by uid),
    cz as (select uid, list(h order by unit) as a from (
      select uid, unit, sum(w) as h from pl join fcc_ on j = idx + {LATENT} group by uid, unit) group by uid),
    hid as (select qid, uid, list_transform(list_zip(hx.a, hc.a), lambda e: case when e[1] + e[2] > 0 then e[1] + e[2]
              else exp(e[1] + e[2]) - 1 end) as hl from hx, hc),
    f1 as (select list(w order by unit) as ws, list(b order by unit) as bs from fc21),
    f2 as (select list(w order by unit) as ws, list(b order by unit) as bs from fc22),
    bel as (select qid, uid, list_transform(range(1, 5), lambda i: list_dot_product(f1.ws[i], hl) + f1.bs[i]) as mu,
              list_transform(range(1, 5), lambda i: list_dot_product(f2.ws[i], hl) + f2.bs[i]) as lv from hid, f1, f2),
    zs as (select qid, uid, [{z}] as zz, cz.a as ca from bel join cz using (uid)),
    fz as (select list(ws order by unit) as ws, list(b order by unit) as bs from
      (select fcz.unit, list(w order by j) as ws, any_value(b) as b from fcz join fcb on fcz.unit = fcb.unit group by fcz.unit) t(unit, ws, b)),
    o1 as (select qid, uid, list_transform(range(1, 5), lambda i: list_dot_product(ws[i], zz) + ca[i] + bs[i]) as o from zs, fz),
    o2 as (select qid, uid, list_transform(range(1, 11), lambda i: list_dot_product(ws[i], o) + bs[i]) as o
           from o1, (select list(w order by unit) as ws, list(b order by unit) as bs from fcc)),
    o3 as (select qid, uid, list_dot_product(w, o) + b as bias from o2, gc1)
    select uid, qid, round({sql.clamp(f"ref + bias + {sql.normal('42d', 'uid', 'qid')} * 0.5::double", 'lo', 'hi')}, 5) as score
    from o3 join tk using (qid), bd"""


@register(_sparse_sql())
def simulate_sparse(spark, d):
    answers = tb.responses(spark, d).withColumn("part", F.col("qid").cast("string"))
    width = rs.vocabulary_table(answers, _WIDE).count()
    weights = scoring.load_weights(scoring.init_weights(spark, VECTOR, width, LATENT, seed=SEED, hash_fn=HASH), VECTOR, sparse=True)
    out = sim.simulate(
        answers, tb.grid_tasks(spark, d), _WIDE, tb.worker_ids(spark, d), weights,
        seed=SEED, hash_fn=HASH, precision="float64", encoding="sparse",
    )
    return rounded_scores(out)


# --- training rows and batches ---------------------------------------------------------------------


@register(f"""with {R} select qid, uid, l_returnflag_A, l_returnflag_N, l_returnflag_R, l_linestatus_F, l_linestatus_O, vector_sum, human_score, yref_llm from (
    select qid, uid, {_ONE_HOT_SQL}, {_VECTOR_SUM} as vector_sum, human_score, coalesce(quality, 0)::double as yref_llm
    from r left join labels on qid = doc_id)""")
def training_rows(spark, d):
    coded, names = rs.one_hot(raw_answers(spark, d), FEATURES)
    rows = rs.attach_reference(coded.withColumnRenamed("vector_text", "task_embedding"), tb.task_reference(spark, d))
    out = training.training_rows(rows, names, "parsed")
    return out.select(
        "qid", "uid", *[F.col("context")[i].alias(n) for i, n in enumerate(names)],
        _vector_sum("task_embedding").alias("vector_sum"), F.col("human_score").cast("double").alias("human_score"),
        F.col("yref_llm").cast("double").alias("yref_llm"),
    )


@register(f"""with {R} select qid, uid, l_returnflag_A, l_returnflag_N, l_returnflag_R, l_linestatus_F, l_linestatus_O,
      vector_sum, human_score, yref_llm, b1, b2, b3 from (
    select qid, uid, {_ONE_HOT_SQL}, {_VECTOR_SUM} as vector_sum, human_score, coalesce(quality, 0)::double as yref_llm,
      coalesce(p_size, 0)::float::double as b1, round(coalesce(p_retailprice, 0)::float::double, 3) as b2, 0.0::double as b3
    from r left join labels on qid = doc_id left join part on qid = p_partkey)""")
def training_rows_full(spark, d):
    out = pp.prepare(raw_answers(spark, d), tb.task_reference(spark, d), tb.task_baseline(spark, d), PREPARE_CONFIG, hash_fn=HASH)
    rows = training.training_rows(out.table, out.features)
    return rows.select(
        "qid", "uid", *[F.col("context")[i].alias(n) for i, n in enumerate(out.features)],
        _vector_sum("task_embedding").alias("vector_sum"), F.col("human_score").cast("double").alias("human_score"),
        F.col("yref_llm").cast("double").alias("yref_llm"), *_elements("baseline_llm_ratings_dist", 3),
    )


@register("""select vec_id as qid, label as uid, round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 4) as context_sum,
      round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 4) as vector_sum, label::double as human_score, 2.5::double as yref_llm
    from embeddings""")
def training_rows_vector_context(spark, d):
    df = tb.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("qid"), F.col("label").alias("uid"), F.col("embedding").alias("comment"),
        F.col("embedding").alias("task_embedding"), F.col("label").alias("human_score"), F.lit(2.5).alias("yref_llm"),
    )
    rows = training.training_rows(df, [], "vector_context")
    return rows.select(
        "qid", "uid", _vector_sum("context").alias("context_sum"), _vector_sum("task_embedding").alias("vector_sum"),
        F.col("human_score").cast("double").alias("human_score"), F.col("yref_llm").cast("double").alias("yref_llm"),
    )


@register(f"""with {R}, {_VOCABULARY}
    select r.qid, uid, l_orderkey, l_linenumber, a.idx::bigint as first_place, b.idx::bigint as second_place, {_VECTOR_SUM} as vector_sum,
      human_score::float::double as human_score, coalesce(quality, 0)::double as yref_llm
    from r join vt a on a.position = 0 and a.value = l_returnflag join vt b on b.position = 1 and b.value = r.qid::varchar
      left join labels on r.qid = doc_id""")
def training_rows_sparse(spark, d):
    rows = raw_answers(spark, d).withColumns({"part": F.col("qid").cast("string"), "who": F.struct("uid", *tb.ROW_KEY)}).drop("uid")
    rows = rs.attach_reference(rows.withColumnsRenamed({"vector_text": "task_embedding", "who": "uid"}), tb.task_reference(spark, d))
    out = training.training_rows(rows, _WIDE, "parsed", encoding="sparse")
    return out.select(
        "qid", "uid.*", F.col("context_idx")[0].alias("first_place"), F.col("context_idx")[1].alias("second_place"),
        _vector_sum("task_embedding").alias("vector_sum"), F.col("human_score").cast("double").alias("human_score"),
        F.col("yref_llm").cast("double").alias("yref_llm"),
    )


def _batch_sql(source: str, key: str, order: str) -> str:
    return f"""select {key}, ((rk - 1) // 64)::bigint as batch_id, ((rk - 1) % 64)::int as pos
    from (select {key}, row_number() over (order by {order}) as rk from {source})"""


@register(_batch_sql("events", "event_id", f"{sql.h('42/0', 'event_id')}, event_id"))
def assign_batches(spark, d):
    df = tb.table(spark, d, "events").select("event_id")
    return training.assign_batches(df, 64, seed=SEED, row_key=["event_id"], hash_fn=HASH)


@register(_batch_sql("events", "event_id", "ts, event_id"))
def assign_batches_ordered(spark, d):
    df = tb.table(spark, d, "events").select("ts", "event_id")
    return training.assign_batches(df, 64, shuffle=False, row_key=["event_id"], order_by=["ts"]).drop("ts")


_LOADER = f"""e as (select user_id as qid, event_id, ts from events), k as ({sql.ranks('e', 'qid', SEED)}),
    s as (select e.*, case when rk <= ceil(0.2::double * n) then 'val' else 'train' end as split from e join k on e.qid = k.qid),
    b as (select split, event_id, row_number() over (partition by split order by
      case when split = 'train' then {sql.h('42/0', 'event_id')} end, case when split = 'val' then ts end, event_id) - 1 as place from s)"""


def _loader(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    answers = tb.table(spark, d, "events").select(F.col("user_id").alias("qid"), "event_id", "ts")
    path = shared_folder(spark, "loader")
    index = training.train_val_files(answers, path, 64, 0.2, SEED, 0, ["event_id"], ["ts"], per_file=10, hash_fn=HASH)
    return path, index


@register(f"""with {_LOADER} select split, event_id, (place // 64)::bigint as batch_id, (place % 64)::int as pos, (place // 640)::bigint as file from b""")
def train_val_batches(spark, d):
    """What a trainer reads: the written rows of both sides."""
    path, _ = _loader(spark, d)
    sides = [spark.read.parquet(f"{path}/{x}/rows").withColumn("split", F.lit(x)) for x in (splits.TRAIN, splits.VALIDATION)]
    return sides[0].unionByName(sides[1]).select("split", "event_id", "batch_id", "pos", F.col("file").cast("bigint").alias("file"))


@register(f"""with {_LOADER}, c as (select split, place // 64 as batch_id, count(*) as n_rows from b group by 1, 2)
    select split, batch_id::bigint as batch_id, (batch_id // 10)::bigint as file, n_rows,
      (sum(n_rows) over (partition by split, batch_id // 10 order by batch_id) - n_rows)::bigint as first_row from c""")
def batch_index(spark, d):
    """Where a trainer finds a batch: file, first row and number of rows."""
    return _loader(spark, d)[1].select("split", "batch_id", "file", "n_rows", "first_row")


@register(f"""with {R}, k as ({sql.ranks('r', 'qid', SEED)}),
    s as (select r.*, case when rk <= ceil(0.2::double * n) then 'test' else 'train' end as split from r join k on r.qid = k.qid),
    w as (select split from s group by split having count(*) < (select count(*) / 2 from s))
    select split, qid, uid, l_orderkey, l_linenumber from s join w using (split)""")
def split_round_trip(spark, d):
    """A split as it was written; of it only the side with less than half of the answers."""
    answers = tb.answer_rows(spark, d)
    path = shared_folder(spark, "split")
    sources.write_split(splits.group_split(answers, "qid", 0.2, seed=SEED, hash_fn=HASH), path)
    sizes = spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.filter(F.col("n") < answers.count() / 2)
    return sources.read_sides(spark, path, wanted).select("split", "qid", "uid", *tb.ROW_KEY)


# --- profiles --------------------------------------------------------------------------------------

_PROFILED = ["doc_id", "text", "lang", "n_chars", "quality", "toxic"]


def _profile_sql() -> str:
    kinds = {"text": False, "lang": False}
    parts = [
        f"""select lang as part, '{c}' as "column", count(*) as n_rows, count(*) filter (where {c} is null) as n_missing,
        {f'min({c})::double' if kinds.get(c, True) else 'null::double'} as smallest, {f'max({c})::double' if kinds.get(c, True) else 'null::double'} as largest,
        {'null::varchar' if kinds.get(c, True) else f'min({c})'} as smallest_text, {'null::varchar' if kinds.get(c, True) else f'max({c})'} as largest_text
        from j group by lang""" for c in _PROFILED
    ]
    return " union all ".join(parts)


_LABELLED = "j as (select d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id))"
_PROFILE_COLUMNS = ["column", "n_rows", "n_missing", "smallest", "largest", "smallest_text", "largest_text"]


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    docs = tb.table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    return rs.profile_sketches(joins.join_by_key(docs, tb.table(spark, d, "labels"), "doc_id").withColumn("part", F.col("lang")), _PROFILED, ["part"])


@register(f"with {_LABELLED} {_profile_sql()}")
def profile_counts(spark, d):
    """A profile per language."""
    return _sketches(spark, d).select("part", *_PROFILE_COLUMNS)


@register(f"""with {_LABELLED} select "column", sum(n_rows)::bigint as n_rows, sum(n_missing)::bigint as n_missing, min(smallest) as smallest, max(largest) as largest,
      min(smallest_text) as smallest_text, max(largest_text) as largest_text from ({_profile_sql()}) group by 1""")
def profile_merged(spark, d):
    """The profiles of all languages merged into one."""
    return rs.read_profile(rs.merge_profiles(_sketches(spark, d))).select(*_PROFILE_COLUMNS)


# --- heavy keys ------------------------------------------------------------------------------------

# Joins beyond the broadcast bound, with a bound so low that keys are heavy.
_FORCED = {"max_rows": 20, "hot_rows": 600}


@register(f"""with {R} select l_orderkey, l_linenumber, r.qid, r.uid, coalesce(s_acctbal, 0)::float::double as yref_llm
    from (select l_orderkey, l_linenumber, l_suppkey as qid, l_partkey as uid from r) r left join supplier on r.qid = s_suppkey and s_suppkey % 7 <> 0""")
def attach_reference_hot(spark, d):
    rows = tb.responses(spark, d).select("l_orderkey", "l_linenumber", F.col("uid").alias("qid"), F.col("qid").alias("uid"))
    refs = tb.table(spark, d, "supplier").filter(F.col("s_suppkey") % 7 != 0).select(F.col("s_suppkey").alias("qid"), F.col("s_acctbal").alias("yref_llm"))
    out = rs.attach_reference(rows, refs, **_FORCED)
    return out.select("l_orderkey", "l_linenumber", "qid", "uid", F.col("yref_llm").cast("float").cast("double").alias("yref_llm"))


@register(f"""with {R} select l_orderkey, l_linenumber, qid, uid from r where uid in (select s_suppkey from supplier where s_suppkey % 7 <> 0)""")
def keep_keys_hot(spark, d):
    rows = tb.responses(spark, d).select("l_orderkey", "l_linenumber", "qid", "uid")
    keys = tb.table(spark, d, "supplier").filter(F.col("s_suppkey") % 7 != 0).select(F.col("s_suppkey").alias("uid"))
    return joins.keep_keys(rows, keys, "uid", **_FORCED)
