"""Registered queries over the driver's tables, with the SQL that a second engine answers them by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varileaf.functions import geometry as g
from varileaf.functions.draws import HART_OVER, HART_UNDER
from varileaf.operators import baselines, budgets, generate, metrics, select, targets, tree
from varileaf.operators.neighbours import nearest
from varileaf.operators.projection import PROJECTION
from varileaf.operators.scaling import Scaler
from varileaf.plans.compose import alpha_losses, linear_models, refined
from varileaf.plans.model import PRESETS, FittedModel, Partitioner, geometry_by_partition, geometry_summary, sign_by_partition, sign_summary
from varileaf.sources.tables import LINE_FEATURES, LINE_IDS, summary, table
from varileaf.streaming.windows import partition_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDS = ", ".join(LINE_IDS)
Z = [f"z_{c}" for c in LINE_FEATURES]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c: Column, n: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, n) + F.lit(0.0)


def sr(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


def lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*dict.fromkeys([*LINE_IDS, *LINE_FEATURES, *keep]))
    return Scaler(LINE_FEATURES).fit(df).transform(df, [*LINE_IDS, *keep])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, z of size and price, and the partition by price."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    z = Scaler(["p_size", "p_retailprice"]).fit(df).transform(df, ["p_partkey"])
    return z.withColumn("partition_id", F.when(F.col("z_p_retailprice") <= 0, 0).otherwise(1))


def _zs(table_: str, columns: list[str], extra: str) -> str:
    """CTE body: extra columns and the z columns."""
    z = ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as z_{c}" for c in columns)
    return f"select {extra}, {z} from {table_}"


LINES = f"with z as ({_zs('lineitem', LINE_FEATURES, IDS + ', l_returnflag, l_linestatus')}) "
S_ = " + ".join(Z)
Q_ = " + ".join(f"{c}*{c}" for c in Z)
ABS_ = " + ".join(f"abs({c})" for c in Z)
T_ = f"(({S_})*({S_}) - ({Q_}))"
A_ = f"(abs({S_}) - ({ABS_}))"
#: A fixed tree of four leaves.
ROUTE = "case when z_l_quantity <= 0 then case when z_l_tax <= 0 then 0 else 1 end else case when z_l_discount <= 0 then 2 else 3 end end"
FIXED = tree.Tree(Z, [tree.Node(0, 0, 0, 0.0, 0, 0.0, left=1, right=2), tree.Node(1, 1, 0, 0.0, 3, 0.0, left=3, right=4), tree.Node(2, 1, 0, 0.0, 2, 0.0, left=5, right=6), *[tree.Node(3 + i, 2, 0, float(i), leaf=i) for i in range(4)]])
PART_Z = _zs("part", ["p_size", "p_retailprice"], "p_partkey")
PARTS = f"with pz as ({PART_Z}), p as (select *, case when z_p_retailprice <= 0 then 0 else 1 end as partition_id from pz), b as (select *, row_number() over (partition by partition_id order by md5(concat_ws('|', p_partkey, '42')), p_partkey) - 1 as rk, count(*) over (partition by partition_id) as n from p) "
BUDGETS = {0: 300, 1: 200}
SLOTS = "s as (select 0 as pid, i, 300 as m from range(300) t(i) union all select 1, i, 200 from range(200) t(i))"


@query(LINES + f"select {IDS}, {', '.join(sr(c) + ' as ' + c for c in Z)} from z")
def zscore_features(spark, sf_dir):
    return lines(spark, sf_dir).select(*LINE_IDS, *[r(F.col(c)).alias(c) for c in Z])


@query("with m as (select median(o_totalprice) m from orders), d as (select median(abs(o_totalprice - m)) d from orders, m) select o_orderkey, " + sr("(o_totalprice - m) / (1.4826 * d)") + " as z_o_totalprice from orders, m, d")
def mad_scale_features(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return Scaler(["o_totalprice"], "mad").fit(df).transform(df, ["o_orderkey"]).select("o_orderkey", r(F.col("z_o_totalprice")).alias("z_o_totalprice"))


@query("with c as (select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as double) as code from orders) select o_orderkey, code from c")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    s = Scaler(["o_orderpriority"], categorical=["o_orderpriority"]).fit(df)
    return df.select("o_orderkey", s.raw("o_orderpriority").alias("code"))


@query("select o_orderkey, o_orderpriority, " + sr("o_totalprice", 4) + " as o_totalprice from orders")
def inverse_scaling(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    s = Scaler(["o_totalprice", "o_orderpriority"], categorical=["o_orderpriority"]).fit(df)
    back = s.inverse(s.transform(df, ["o_orderkey"]))
    return back.select("o_orderkey", "o_orderpriority", r(F.col("o_totalprice"), 4).alias("o_totalprice"))


def _projection_sql(table_: str, ids: str, columns: list[str], y: str, depth: int) -> str:
    """A tree of `depth` levels over the columns' values: at each level every node takes the best cut between two values that occur in it."""
    ctes = [f"k0 as (select {', '.join(columns)}, count(*) as n, sum({y}) as s, 0 as node from {table_} group by all)", "lim as (select greatest(10, sum(n) // 100) as least from k0)"]
    for d in range(depth):
        each = " union all ".join(f"select node, {j} as col, {c} as v, n, s from k{d}" for j, c in enumerate(columns))
        ctes += [
            f"v{d} as (select node, col, v, sum(n) as n, sum(s) as s from ({each}) group by all)",
            f"w{d} as (select *, sum(n) over up as nl, sum(s) over up as sl, sum(n) over whole as nw, sum(s) over whole as sw from v{d} window up as (partition by node, col order by v), whole as (partition by node, col))",
            f"b{d} as (select node, col, v, row_number() over (partition by node order by sl * sl / nl + (sw - sl) * (sw - sl) / (nw - nl) desc, col, v) as place from w{d}, lim where nl >= least and nw - nl >= least)",
            f"k{d + 1} as (select {', '.join('k.' + c for c in columns)}, k.n, k.s, 2 * k.node + case when b.place is null or (case b.col {' '.join(f'when {j} then k.{c}' for j, c in enumerate(columns))} end) <= b.v then 1 else 2 end as node from k{d} k left join b{d} b on b.node = k.node and b.place = 1)",
        ]
    ctes += [f"p as (select {', '.join(columns)}, sum(s) over (partition by node) / sum(n) over (partition by node) as value, n from k{depth})", "m as (select sum(n * value) / sum(n) as mean from p)", "d as (select sqrt(sum(n * (value - mean) * (value - mean)) / sum(n)) + 1e-10 as dev from p, m)"]
    return f"with {', '.join(ctes)} select {ids}, {', '.join('t.' + c for c in columns)}, {sr('(value - mean) / dev')} as projection from {table_} t join p on {' and '.join(f't.{c} = p.{c}' for c in columns)}, m, d"


def _projected(df: DataFrame, ids: list[str], columns: list[str], y: str) -> DataFrame:
    scaler = Scaler(columns, categorical=columns).fit(df).project(df, y)
    return scaler.transform(df, [*ids, *columns]).select(*ids, *columns, r(F.col(PROJECTION)).alias("projection"))


@query(_projection_sql("lineitem", IDS, ["l_returnflag", "l_linestatus"], "l_quantity", 2))
def categorical_projection(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus"]
    return _projected(table(spark, sf_dir, "lineitem").select(*dict.fromkeys([*LINE_IDS, *columns, "l_quantity"])), LINE_IDS, columns, "l_quantity")


@query(_projection_sql("orders", "o_orderkey", ["o_orderpriority", "o_orderstatus"], "o_totalprice", 3))
def categorical_projection_deeper(spark, sf_dir):
    columns = ["o_orderpriority", "o_orderstatus"]
    return _projected(table(spark, sf_dir, "orders").select("o_orderkey", *columns, "o_totalprice"), ["o_orderkey"], columns, "o_totalprice")


_REFINED = ["l_quantity", "l_discount", "l_tax"]


def _refined_sql() -> str:
    """In each group the best of all cuts between neighbouring values, for the sum of the features scaled within the group."""
    z = ", ".join(f"({c} - avg({c}) over w) / stddev_pop({c}) over w as z{i}" for i, c in enumerate(_REFINED))
    each = " union all ".join(f"select g, {i} as f, z{i} as v, t from s" for i in range(3))
    left = "case f " + " ".join(f"when {i} then z{i}" for i in range(3)) + " end <= v"
    return (
        f"with z as (select {IDS}, ascii(l_returnflag) as a, {z} from lineitem window w as (partition by l_returnflag)), s as (select *, dense_rank() over (order by a) - 1 as g, z0 + z1 + z2 as t from z), "
        f"c as (select g, f, v, count(*) as n, sum(t) as t from ({each}) group by all), r as (select *, sum(n) over up as nl, sum(t) over up as tl, sum(n) over (partition by g, f) as nw, sum(t) over (partition by g, f) as tw from c window up as (partition by g, f order by v)), "
        f"b as (select g, f, v, row_number() over (partition by g order by tl * tl / nl + (tw - tl) * (tw - tl) / (nw - nl) desc, f, v) as place from r where nl >= 50 and nw - nl >= 50) "
        f"select {', '.join('s.' + c for c in LINE_IDS)}, cast(2 * s.g + case when {left} then 0 else 1 end as int) as partition_id from s join b on s.g = b.g and place = 1"
    )


@query(_refined_sql())
def refined_partitions(spark, sf_dir):
    """Fixed groups, two partitions in each."""
    df = table(spark, sf_dir, "lineitem").select(*dict.fromkeys([*LINE_IDS, *_REFINED, "l_returnflag"]))
    flags = Scaler(["l_returnflag"], categorical=["l_returnflag"]).fit(df)
    return refined(df.withColumn("g", flags.raw("l_returnflag")), "g", _REFINED, 2, 50).select(*LINE_IDS, "partition_id")


_BREADTH = ["l_quantity", "l_discount", "late", "l_tax"]


def _breadth_sql(depth: int, leaves: int, least: int) -> str:
    """Level by level: each node's best cut, a two-valued column's after all others; of a level the first nodes split, as far as there is room for leaves."""
    turn = {0: 0, 1: 1, 3: 2, 2: 3}  # the two-valued column is the third
    ctes = [f"n0 as (select {IDS}, l_quantity as f0, l_discount as f1, cast(l_linestatus = 'O' as int) as f2, l_tax as f3, l_extendedprice as t, 0 as node, true as live, 0 as made from lineitem)"]
    for d in range(depth):
        each = " union all ".join(f"select node, {turn[f]} as turn, {f} as f, f{f} as v, t from n{d} where live" for f in range(4))
        side = "case b.f " + " ".join(f"when {f} then n.f{f}" for f in range(4)) + " end <= b.v"
        ctes += [
            f"c{d} as (select node, turn, f, v, count(*) as n, sum(t) as t from ({each}) group by all)",
            f"r{d} as (select *, sum(n) over up as nl, sum(t) over up as tl, sum(n) over every as nw, sum(t) over every as tw from c{d} window up as (partition by node, f order by v), every as (partition by node, f))",
            f"g{d} as (select node, f, v, least(nl, nw - nl) as small, row_number() over (partition by node order by tl * tl / nl + (tw - tl) * (tw - tl) / (nw - nl) desc, turn, v) as place from r{d} where nw > nl and (f = 2 or (nl >= {least} and nw - nl >= {least})))",
            f"o{d} as (select node, f, v, row_number() over (order by node) as turn from g{d} where place = 1 and small >= {least})",
            f"b{d} as (select o.*, turn + m.made as made from o{d} o, (select max(made) as made from n{d}) m where turn + m.made < {leaves})",
            f"n{d + 1} as (select n.* exclude (node, live, made), case when b.node is null then n.node else 2 * n.node + case when {side} then 1 else 2 end end as node, b.node is not null as live, (select coalesce(max(made), (select max(made) from n{d})) from b{d}) as made from n{d} n left join b{d} b on n.live and b.node = n.node)",
        ]
    return f"with {', '.join(ctes)} select {IDS}, cast(dense_rank() over (order by node) - 1 as int) as partition_id from n{depth}"


@query(_breadth_sql(3, 7, 40))
def breadth_first_partitions(spark, sf_dir):
    """Seven partitions of a tree of three levels: the last node of the third level finds no room and stays whole."""
    df = table(spark, sf_dir, "lineitem").select(*dict.fromkeys([*LINE_IDS, "l_quantity", "l_discount", "l_tax", "l_extendedprice"]), (F.col("l_linestatus") == "O").cast("int").alias("late"))
    z = Scaler(_BREADTH).fit(df).transform(df, [*LINE_IDS, "l_extendedprice"])
    grown = tree.grow(z, [f"z_{c}" for c in _BREADTH], "l_extendedprice", 7, 40, 3, order="breadth")
    return z.select(*LINE_IDS, grown.leaf().alias("partition_id"))


@query(LINES + f"select {IDS}, {sr(S_)} as s, {sr(Q_)} as q, {sr(T_)} as t, {sr(A_)} as a, {sr('-' + A_ + '/2')} as mst from z")
def row_geometry(spark, sf_dir):
    c = [F.col(x) for x in Z]
    return lines(spark, sf_dir).select(*LINE_IDS, r(g.signed_sum(c)).alias("s"), r(g.square_sum(c)).alias("q"), r(g.cooperation(c)).alias("t"), r(g.sign_deficit(c)).alias("a"), r(g.minority_sign(c)).alias("mst"))


_PAIRS = [f"{a}*{b}" for i, a in enumerate(Z) for b in Z[i + 1 :]]
PAIRWISE = " + ".join(f"({p} - avg({p}) over ()) / stddev_pop({p}) over ()" for p in _PAIRS)


@query(LINES + f"select {IDS}, {sr(PAIRWISE, 5)} as target from z")
def pairwise_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.geometric(df, Z, "pairwise"), 5).alias("target"))


def _standard_sql(x: str) -> str:
    return LINES + f", x as (select *, {x} as x from z) select {IDS}, {sr('(x - avg(x) over ()) / stddev_pop(x) over ()', 5)} as target from x"


@query(_standard_sql(f"(({ABS_})*({ABS_}) - ({Q_})) / 2"))
def abs_pairwise_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.geometric(df, Z, "abs_pairwise"), 5).alias("target"))


@query(_standard_sql(f"(({S_})*({S_})*({S_}) + 2*({' + '.join(f'{c}*{c}*{c}' for c in Z)}) - 3*({Q_})*({S_})) / 6"))
def e3_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.geometric(df, Z, "e3"), 5).alias("target"))


@query(_standard_sql(S_))
def sum_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.geometric(df, Z, "sum_z"), 5).alias("target"))


@query(_standard_sql(A_))
def l1_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.geometric(df, Z, "l1_z"), 5).alias("target"))


def _selective_sql(residual: str, k: int) -> str:
    n = len(_PAIRS)
    products = ", ".join(f"{p} as p{i}" for i, p in enumerate(_PAIRS))
    stats = ", ".join(f"abs(corr(p{i}, {residual})) as r{i}, avg(p{i}) as m{i}, stddev_pop(p{i}) as s{i}" for i in range(n))
    ahead = [" + ".join(f"cast(r{j} > r{i} or (r{j} = r{i} and {j} < {i}) as int)" for j in range(n) if j != i) for i in range(n)]
    total = " + ".join(f"case when {ahead[i]} < {k} then (p{i} - m{i}) / s{i} else 0 end" for i in range(n))
    return LINES + f", q as (select *, {products} from z), c as (select {stats} from q), x as (select *, {total} as x from q, c) select {IDS}, {sr('(x - avg(x) over ()) / stddev_pop(x) over ()', 5)} as target from x"


@query(_selective_sql("z_l_tax", 3))
def selective_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.selective(df, Z, F.col("z_l_tax"), 3), 5).alias("target"))


@query(_standard_sql(PAIRWISE))
def pairwise_z_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.geometric(df, Z, "pairwise_z"), 5).alias("target"))


@query(LINES + f"select {IDS}, {sr(ABS_, 5)} as target from z")
def l1_norm_target(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.select(*LINE_IDS, r(targets.geometric(df, Z, "l1_norm"), 5).alias("target"))


def _robust_sql(x: str, of: str, out: str) -> str:
    """CTEs: out adds the robust form of x as v to the table `of`."""
    return f"{out}m as (select median({x}) as m from {of}), {out}d as (select 1.4826 * median(abs({x} - m)) + 1e-10 as d from {of}, {out}m), {out} as (select {of}.o_orderkey, ({x} - m) / d as v from {of}, {out}m, {out}d)"


@query(f"with {_robust_sql('o_totalprice', 'orders', 'a')}, f as (select o_orderkey, abs(v - (select median(v) from a)) as far from a), {_robust_sql('far', 'f', 'b')} select o_orderkey, {sr('v', 5)} as label from b")
def robust_extremeness(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return df.select("o_orderkey", r(targets.extremeness(df, F.col("o_totalprice"), "mad")[0], 5).alias("label"))


_UNIT = "with z as (select o_orderkey, (o_custkey - avg(o_custkey) over ()) / stddev_pop(o_custkey) over () as x, (o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()) as u from orders), e as (select *, abs(u - (select median(u) from z)) as far from z), n as (select o_orderkey, (x - avg(x) over ()) / stddev_pop(x) over () as x, (far - avg(far) over ()) / stddev_pop(far) over () as label from e), c as (select *, x * label as xy from n), m as (select o_orderkey, 0.7 * x + 0.3 * label + 0.3 * (xy - avg(xy) over ()) / stddev_pop(xy) over () as t from c) "


@query(_UNIT + f"select o_orderkey, {sr('(t - avg(t) over ()) / stddev_pop(t) over ()', 5)} as target from m")
def blend_scaled(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    z = Scaler(["o_custkey"]).fit(df).transform(df, ["o_orderkey", "o_totalprice"])
    return z.select("o_orderkey", r(targets.blend_scaled(z, F.col("z_o_custkey"), F.col("o_totalprice"), 0.3, cross=True), 5).alias("target"))


ORDERS = "with z as (select o_orderkey, o_totalprice as y, (o_custkey - avg(o_custkey) over ()) / stddev_pop(o_custkey) over () as x, (o_totalprice - avg(o_totalprice) over ()) / (stddev_pop(o_totalprice) over () + 1e-10) as yn from orders), e as (select *, abs(yn - (select median(yn) from z)) as far from z), l as (select *, (far - avg(far) over ()) / (stddev_pop(far) over () + 1e-10) as label, max(far) over () as top from e), c as (select *, 1 - abs((select corr(x, label) from l)) as att from l) "
_MODES = {"fixed": "0.3", "adaptive": "0.3 * att", "linear": "0.3 * far / (top + 1e-10)", "adaptive_linear": "0.3 * att * far / (top + 1e-10)"}


def _blend(mode: str):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
        z = Scaler(["o_custkey"]).fit(df).transform(df, ["o_orderkey", "o_totalprice"])
        return z.select("o_orderkey", r(targets.blend(z, F.col("z_o_custkey"), F.col("o_totalprice"), 0.3, mode), 5).alias("target"))

    run.__name__ = f"blend_{mode}"
    return run


for _mode, _w in _MODES.items():
    query(ORDERS + f"select o_orderkey, {sr(f'(1 - {_w}) * x + {_w} * label', 5)} as target from c")(_blend(_mode))


@query(LINES + f", x as (select {T_} as t, {Q_} as q from z) select count(*) as n_samples, {sr('avg(t)', 4)} as e_t, {sr('avg(q)', 4)} as e_q, {sr('stddev_pop(t)', 4)} as std_t, {sr('stddev_pop(q)', 4)} as std_q, {sr('covar_samp(t, q)', 4)} as cov_tq, {sr('corr(t, q)', 4)} as corr_tq, {sr('avg(cast(t > 0 as double))', 4)} as frac_in_cone from x")
def geometry_stats_global(spark, sf_dir):
    x = geometry_summary(lines(spark, sf_dir), Z)
    return x.select("n_samples", *[r(F.col(c), 4).alias(c.lower()) for c in ("E_T", "E_Q", "std_T", "std_Q", "cov_TQ", "corr_TQ", "frac_in_cone")])


@query(LINES + f", x as (select {ROUTE} as id, {T_} as t, {Q_} as q from z) select cast(id as int) as id, count(*) as n, {sr('avg(t)', 4)} as e_t, {sr('avg(q)', 4)} as e_q, {sr('stddev_pop(t)', 4)} as std_t, {sr('avg(cast(t > 0 as double))', 4)} as frac_in_cone from x group by id")
def geometry_stats_by_partition(spark, sf_dir):
    x = geometry_by_partition(lines(spark, sf_dir).withColumn("partition_id", FIXED.leaf()), Z)
    return x.select("id", "n", r(F.col("E_T"), 4).alias("e_t"), r(F.col("E_Q"), 4).alias("e_q"), r(F.col("std_T"), 4).alias("std_t"), r(F.col("frac_in_cone"), 4).alias("frac_in_cone"))


_SIGN = f"x as (select {S_} as s, {Q_} as q, {T_} as t, {A_} as a, {ROUTE} as id from z)"
_MOMENTS = ", ".join(f"{sr(f'avg({k})', 4)} as {k}_mean, {sr(f'stddev_pop({k})', 4)} as {k}_std" for k in "sqta")
_RANGES = ", ".join(f"{sr(f'min({k})', 4)} as {k}_min, {sr(f'max({k})', 4)} as {k}_max" for k in "sqta")
_RELATIONS = {"corr_tq": "corr(t, q)", "corr_aq": "corr(a, q)", "corr_at": "corr(a, t)", "corr_as": "corr(a, abs(s))", "cone_fraction": "avg(cast(t > 0 as double))", "cooperation_ratio": "avg(t) / (avg(q) + 1e-12)", "a_theoretical_lower_bound": "-avg(sqrt(q)) * 2", "sign_consistent_fraction": "avg(cast(a >= -1e-10 as double))", "minority_sign_mean": "avg(-a / 2)", "a_homogeneity": "2.0::double", "t_homogeneity": "4.0::double"}


@query(LINES + f", {_SIGN} select count(*) as n, 4 as d, {_MOMENTS}, {_RANGES}, " + ", ".join(f"{sr(v, 4)} as {k}" for k, v in _RELATIONS.items()) + " from x")
def sign_geometry_stats(spark, sf_dir):
    x = sign_summary(lines(spark, sf_dir), Z)
    return x.select(*[F.col(c) if c in ("n", "d") else r(F.col(c), 4).alias(c.lower()) for c in x.columns])


@query(LINES + f", {_SIGN} select cast(id as int) as id, count(*) as n, {_MOMENTS}, {sr('avg(-a / 2)', 4)} as minority_sign_mean, {sr('avg(cast(t > 0 as double))', 4)} as cone_fraction from x group by id")
def sign_stats_by_partition(spark, sf_dir):
    x = sign_by_partition(lines(spark, sf_dir).withColumn("partition_id", FIXED.leaf()), Z)
    return x.select("id", "n", *[r(F.col(c), 4).alias(c.lower()) for c in x.columns if c not in ("id", "n")])


def fixed_model(spark: SparkSession, sf_dir: str, *keep: str) -> FittedModel:
    df = table(spark, sf_dir, "lineitem").select(*LINE_IDS, *[c for c in LINE_FEATURES if c not in LINE_IDS], *keep)
    return FittedModel(Partitioner(), df, Scaler(LINE_FEATURES).fit(df), LINE_IDS, tree=FIXED)


@query(LINES + f", x as (select {ROUTE} as pid, {Q_} as q from z) select cast(pid as int) as partition_id, count(*) as size, {sr('var_pop(sqrt(q))', 4)} as variance from x group by pid")
def norm_variances(spark, sf_dir):
    return fixed_model(spark, sf_dir).norm_variances().select("partition_id", "size", r(F.col("variance"), 4).alias("variance"))


@query(LINES + f", x as (select *, {ROUTE} as pid, ({ABS_}) / 4 as m, {S_} as s, {Q_} as q from z) select cast(pid as int) as partition_id, count(*) as size, {sr('avg(m)', 4)} as mean_abs_z, {sr('sum(q) / (4 * count(*)) - (sum(s) / (4 * count(*))) * (sum(s) / (4 * count(*)))', 4)} as variance from x group by pid")
def partitions_table(spark, sf_dir):
    return fixed_model(spark, sf_dir).get_partitions().select("partition_id", "size", r(F.col("mean_abs_z"), 4).alias("mean_abs_z"), r(F.col("variance"), 4).alias("variance"))


@query(LINES + f", x as (select {IDS}, {ROUTE} as pid from z), k as (select *, row_number() over (partition by pid order by md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42')), l_extendedprice) - 1 as rk from x) select {IDS}, cast(pid as int) as partition_id, rk as selection_rank from k where rk < 25")
def reduce_stratified(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("partition_id", FIXED.leaf())
    ranked = select.ranked(df.select(*LINE_IDS, "partition_id"), LINE_IDS[:4], 42)
    return ranked.where("rank < 25").select(*LINE_IDS, "partition_id", F.col("rank").alias("selection_rank"))


RECURSIVE = PARTS.replace("with pz", "with recursive pz", 1)
_FAR = "(x.z_p_size - y.z_p_size) * (x.z_p_size - y.z_p_size) + (x.z_p_retailprice - y.z_p_retailprice) * (x.z_p_retailprice - y.z_p_retailprice)"
_MEAN = "c as (select partition_id, avg(z_p_size) as z_p_size, avg(z_p_retailprice) as z_p_retailprice, count(*) as n from p group by partition_id)"
_NEAR = f"e as (select x.*, y.n, row_number() over (partition by x.partition_id order by {_FAR}, x.p_partkey) as near from p x join c y using (partition_id))"
_CENTRE = "f as (select partition_id, p_partkey as first from e where near = 1)"
_POOL = "g as (select partition_id, p_partkey, z_p_size, z_p_retailprice from e where n <= 200 or near <= least(n, greatest(30, cast(floor(sqrt(n)) as bigint))))"
_MEDOID = f"{_POOL}, f as (select partition_id, arg_min(key, total) as first from (select x.partition_id, x.p_partkey as key, (sum({_FAR}), x.p_partkey) as total from g x join g y using (partition_id) group by x.partition_id, x.p_partkey) group by partition_id)"
#: Always the row farthest from all chosen ones; `pick` is the k-th choice, which round k + 1 measures from.
_ROUNDS = """r as (select p.partition_id, p.p_partkey, z_p_size, z_p_retailprice, 1e300::double as least, 0 as k, f.first as pick from p join f using (partition_id)
union all select partition_id, p_partkey, z_p_size, z_p_retailprice, d, k + 1, first_value(p_partkey) over (partition by partition_id order by d desc, p_partkey) from (
select *, case when p_partkey = pick then -1 else least(least, (z_p_size - a) * (z_p_size - a) + (z_p_retailprice - b) * (z_p_retailprice - b)) end as d from (
select *, max(case when p_partkey = pick then z_p_size end) over (partition by partition_id) as a, max(case when p_partkey = pick then z_p_retailprice end) over (partition by partition_id) as b from r) where k < {rounds})),
h as (select distinct partition_id, pick as p_partkey, k from r where k < case when partition_id = 0 then {n0} else {n1} end)"""
_SPREAD = f"w as (select partition_id, p_partkey, round(var_pop(sqrt(d)), 12) as score from (select x.partition_id, x.p_partkey, {_FAR} as d, count(*) over (partition by x.p_partkey) as n, row_number() over (partition by x.p_partkey order by {_FAR}) as i from p x join p y using (partition_id)) where i <= least(10, n - 1) group by partition_id, p_partkey)"
_PICKED = "select p_partkey, cast(partition_id as int) as partition_id, cast({at} as bigint) as selection_rank from "
_FARTHEST = _ROUNDS.format(rounds=29, n0=30, n1=20)
SELECTIONS = {
    "fps": f"{RECURSIVE}, {_MEAN}, {_NEAR}, {_CENTRE}, {_FARTHEST} {_PICKED.format(at='k')} h",
    "medoid_fps": f"{RECURSIVE}, {_MEAN}, {_NEAR}, {_MEDOID}, {_FARTHEST} {_PICKED.format(at='k')} h",
    "variance_ordered": f"{RECURSIVE}, {_SPREAD}, o as (select *, row_number() over (partition by partition_id order by score desc, p_partkey) - 1 as k from w) {_PICKED.format(at='k')} o where k < case when partition_id = 0 then 30 else 20 end",
    "mixed_fps": f"{RECURSIVE}, {_MEAN}, {_NEAR}, {_CENTRE}, {_ROUNDS.format(rounds=20, n0=21, n1=14)}, {_SPREAD}, o as (select *, row_number() over (partition by partition_id order by score desc, p_partkey) - 1 as k from w where p_partkey not in (select p_partkey from h)) {_PICKED.format(at='k')} h union all {_PICKED.format(at='k + case when partition_id = 0 then 21 else 14 end')} o where k < case when partition_id = 0 then 9 else 6 end",
}


def _reduced(method: str):
    def run(spark, sf_dir):
        return select.select(parts(spark, sf_dir), ["p_partkey"], ["z_p_size", "z_p_retailprice"], {0: 30, 1: 20}, method)

    run.__name__ = f"reduce_{method}"
    return run


for _m, _sql in SELECTIONS.items():
    query(_sql)(_reduced(_m))


_ORTHANT = f"with z as ({_zs('part', ['p_size', 'p_retailprice'], 'p_partkey, p_retailprice as y')}), m as (select median(z_p_size) as m0, median(z_p_retailprice) as m1 from z), o as (select *, case when z_p_size >= m0 then '+' else '-' end || case when z_p_retailprice >= m1 then '+' else '-' end as orthant from z, m), c as (select orthant, median(y) as my, avg(z_p_size) as c0, avg(z_p_retailprice) as c1, count(*) as n from o group by orthant), d as (select o.*, c.n, my, round(abs(z_p_size - c0) + abs(z_p_retailprice - c1), 9) as far from o join c using (orthant)), w as (select orthant, n, n * (median(abs(y - my)) + 1e-12) as w from d group by orthant, n), s as (select *, 40 * w / sum(w) over () as share from w), b as (select *, cast(floor(share) as bigint) + case when row_number() over (order by share - floor(share) desc, orthant) <= 40 - (select sum(floor(share)) from s) then 1 else 0 end as budget from s), k as (select d.*, row_number() over (partition by orthant order by far desc, p_partkey) - 1 as pos from d), l as (select orthant, i, cast(floor(i * (n - 1) / greatest(budget - 1, 1) + 0.5) as bigint) as pos from b, range(40) t(i) where i < budget) select p_partkey, orthant, i as selection_rank from k join l using (orthant, pos)"


@query(_ORTHANT)
def reduce_orthant(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    z = Scaler(["p_size", "p_retailprice"]).fit(df).transform(df, ["p_partkey", "p_retailprice"])
    return select.orthants(z, ["p_partkey"], ["z_p_size", "z_p_retailprice"], "p_retailprice", 40)


PZ = ["z_p_size", "z_p_retailprice"]


def _made(name: str):
    def run(spark, sf_dir):
        made = generate.generate(parts(spark, sf_dir), ["p_partkey"], PZ, BUDGETS, name)
        return made.select("partition_id", "synthetic_id", *[r(F.col(c), 5).alias(c) for c in PZ])

    run.__name__ = f"expand_{name}"
    return run


def _lat(j: int) -> str:
    x = f"((s.i + 0.5::double) / s.m + {j * 0.6180339887498949!r}::double)"
    return f"greatest(1e-6, least(1 - 1e-6, {x} - floor({x})))"


_OUT = "select cast(s.pid as int) as partition_id, s.i as synthetic_id, "
_MIX = "greatest(0.1, least(0.9, (s.i + 0.5) / s.m))"
query(PARTS + f", {SLOTS} {_OUT}" + ", ".join(sr(f"a.{c} + {_MIX} * (b2.{c} - a.{c})", 5) + f" as {c}" for c in PZ) + " from s join b a on a.partition_id = s.pid and a.rk = s.i % a.n join b b2 on b2.partition_id = s.pid and b2.rk = (s.i + b2.n // 2 + 1) % b2.n")(_made("simplex_mixup"))
_LAP = "case when {u} < 0.5 then ln(2 * {u}) else -ln(2 * (1 - {u})) end"
query(PARTS + f", {SLOTS}, md as (select partition_id, avg(z_p_size) c0, avg(z_p_retailprice) c1, quantile_disc(z_p_size, 0.5) m0, quantile_disc(z_p_retailprice, 0.5) m1 from p group by partition_id), ma as (select p.partition_id, 1.4826 * quantile_disc(abs(z_p_size - m0), 0.5) d0, 1.4826 * quantile_disc(abs(z_p_retailprice - m1), 0.5) d1 from p join md using (partition_id) group by p.partition_id) {_OUT}" + ", ".join(sr(f"c{j} + greatest(d{j}, 1e-8) * ({_LAP.format(u=_lat(j))})", 5) + f" as {c}" for j, c in enumerate(PZ)) + " from s join md on md.partition_id = s.pid join ma on ma.partition_id = s.pid")(_made("laplace"))
_ST = "st as (select partition_id, sqrt(stddev_pop(z_p_size) * stddev_pop(z_p_size) + 1e-8) s0, sqrt(stddev_pop(z_p_retailprice) * stddev_pop(z_p_retailprice) + 1e-8) s1 from p group by partition_id)"
query(PARTS + f", {SLOTS}, {_ST} {_OUT}" + ", ".join(sr(f"a.{c} + ({_lat(2)}) * (b2.{c} - a.{c}) + 2 * sin(asin(2 * ({_lat(j)}) - 1) / 3) * pow(a.n, -1/6::double) * s{j}", 5) + f" as {c}" for j, c in enumerate(PZ)) + " from s join st on st.partition_id = s.pid join b a on a.partition_id = s.pid and a.rk = s.i % a.n join b b2 on b2.partition_id = s.pid and b2.rk = (s.i % b2.n + greatest(1, cast(floor(b2.n * 0.6180339887498949) as bigint))) % b2.n")(_made("lattice_epanechnikov"))


def _probit(p: str) -> str:
    log = f"ln(1 - (2*({p})-1)*(2*({p})-1))"
    k = f"(2 / (pi() * 0.147) + {log} / 2)"
    return f"sqrt(2) * sign(2*({p})-1) * sqrt(sqrt({k} * {k} - {log} / 0.147) - {k})"


query(PARTS + f", {SLOTS}, {_ST} {_OUT}" + ", ".join(sr(f"a.{c} + {_probit(_lat(j))} * 0.1 * s{j}", 5) + f" as {c}" for j, c in enumerate(PZ)) + " from s join st on st.partition_id = s.pid join b a on a.partition_id = s.pid and a.rk = s.i % a.n")(_made("lattice_bootstrap"))


def _u(keys: str, part: int = 0) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '42', s.pid, s.i, {keys})), {1 + 10 * part}, 10))::bigint / 1099511627776.0::double)"


def _normal(keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(keys)})) * cos(2 * pi() * {_u(keys, 1)}))"


def _noise(keys: str) -> str:
    a, b, c = (f"(2 * {_u(keys, part)} - 1)" for part in range(3))
    return f"(case when abs({c}) >= abs({b}) and abs({c}) >= abs({a}) then {b} else {c} end)"


_DEV = "st as (select partition_id, count(*) as n, greatest(stddev_pop(z_p_size), 0.01) as s0, greatest(stddev_pop(z_p_retailprice), 0.01) as s1, covar_samp(z_p_size, z_p_size) as v0, covar_samp(z_p_size, z_p_retailprice) as v1, covar_samp(z_p_retailprice, z_p_retailprice) as v2, quantile_disc({A}, 0.05) as low, quantile_disc({A}, 0.95) as high from p group by partition_id)".replace("{A}", "abs(z_p_size + z_p_retailprice) - (abs(z_p_size) + abs(z_p_retailprice))")
_BASE = " from s join st on st.partition_id = s.pid join b a on a.partition_id = s.pid and a.rk = {rank}"
_ANY = f"cast(floor({_u('100')} * st.n) as bigint)"
_H = "pow(st.n, -1/6::double)"
_CHOL = (f"{_H} * sqrt(v0) * {{0}}", f"{_H} * (v1 / sqrt(v0) * {{0}} + sqrt(v2 - v1 * v1 / v0) * {{1}})")


def _expanded(values: list[str], rank: str = _ANY, more: str = "", where: str = "") -> str:
    return PARTS + f", {SLOTS}, {_DEV}{where} {_OUT}" + ", ".join(f"{sr(v, 5)} as {c}" for v, c in zip(values, PZ, strict=True)) + _BASE.format(rank=rank) + more


_OWN, _OTHER = "(abs(a.z_p_size) + abs(a.z_p_retailprice) - abs(a.z_p_size + a.z_p_retailprice)) / 2", "(abs(b2.z_p_size) + abs(b2.z_p_retailprice) - abs(b2.z_p_size + b2.z_p_retailprice)) / 2"
_TRIED = [f"(a.{c} + {_H} * s{j} * {_noise(f'y.k, {j}')})" for j, c in enumerate(PZ)]
_SUM_A = f"abs({_TRIED[0]} + {_TRIED[1]}) - (abs({_TRIED[0]}) + abs({_TRIED[1]}))"
_FITTING = f", y as (select unnest(range(20)) as k), q as (select s.pid, s.i, min(y.k) as k{_BASE.format(rank=_ANY)} join y on true where {_SUM_A} between low and high group by s.pid, s.i)"
HASHED = {
    "epanechnikov": _expanded([f"a.{c} + {_H} * s{j} * {_noise(str(j))}" for j, c in enumerate(PZ)]),
    "epanechnikov_unscaled": _expanded([f"a.{c} + {_H} * {_noise(str(j))}" for j, c in enumerate(PZ)]),
    "bootstrap_noise": _expanded([f"a.{c} + 0.1 * s{j} * {_normal(str(j))}" for j, c in enumerate(PZ)]),
    "sign_preserving_epanechnikov": _expanded([f"sign(a.{c}) * abs(abs(a.{c}) + {_H} * s{j} * {_noise(str(j))})" for j, c in enumerate(PZ)]),
    "multivariate_kde": _expanded([f"a.{c} + " + _CHOL[j].format(_normal("0"), _normal("1")) for j, c in enumerate(PZ)]),
    "lattice_kde": _expanded([f"a.{c} + " + _CHOL[j].format(_probit(_lat(0)), _probit(_lat(1))) for j, c in enumerate(PZ)], "s.i % st.n"),
    "minority_sign_resampler": _expanded([f"case when (a.{c} < 0) = (a.z_p_size + a.z_p_retailprice >= 0) then a.{c} * case when {_OWN} > 1e-10 then ({_OTHER}) / ({_OWN}) else 1 end else a.{c} + 0.05 * s{j} * {_normal(str(j))} end" for j, c in enumerate(PZ)], more=f" join b b2 on b2.partition_id = s.pid and b2.rk = cast(floor({_u('101')} * st.n) as bigint)"),
    "a_range_rejection": _expanded([f"case when y.k is null then a.{c} else {_TRIED[j]} end" for j, c in enumerate(PZ)], more=" left join q y on y.pid = s.pid and y.i = s.i", where=_FITTING),
}
for _m, _sql in HASHED.items():
    query(_sql)(_made(_m))
for _m in ("knn_interpolation", "partition_gmm"):
    query()(_made(_m))
query(_expanded([f"{('a', 'b2')[j]}.{c} + {_normal(str(j))} * st.d{j} * pow(st.n, -0.2::double)" for j, c in enumerate(PZ)], f"cast(floor({_u('200')} * st.n) as bigint)", f" join b b2 on b2.partition_id = s.pid and b2.rk = cast(floor({_u('201')} * st.n) as bigint)").replace("count(*) as n, greatest", "count(*) as n, stddev_pop(z_p_size) as d0, stddev_pop(z_p_retailprice) as d1, greatest", 1))(_made("independent_kde"))


def _horner(values: tuple[float, ...], x: str) -> str:
    out = f"{values[0]!r}::double"
    for c in values[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def _copula_sql(normal: tuple[str, str]) -> str:
    """Mean ranks, their normal scores' correlation r, and quantiles at 2,000 points."""
    points = "[" + ", ".join(f"{i / 1999!r}" for i in range(2000)) + "]"
    score = ", ".join(_probit(f"((rank() over (partition by partition_id order by {c}) + (count(*) over (partition by partition_id, {c}) - 1) / 2.0::double) / (n + 1))") + f" as s{j}" for j, c in enumerate(PZ))
    tail = f"exp(-least(abs(m), 7) * least(abs(m), 7) / 2) * {_horner(HART_OVER, 'least(abs(m), 7)')} / {_horner(HART_UNDER, 'least(abs(m), 7)')}"
    at = "greatest(1e-6, least(1 - 1e-6, case when m > 0 then 1 - tail else tail end)) * 1999"
    value = ", ".join(sr(f"max(case when j = {j} then grid[g + 1] + (u - g) * (grid[g + 2] - grid[g + 1]) end)", 5) + f" as {c}" for j, c in enumerate(PZ))
    return (
        PARTS + f", {SLOTS}, sc as (select partition_id, {score} from b), r as (select partition_id as pid, covar_samp(s0, s1) / (stddev_samp(s0) * stddev_samp(s1) + 1e-8) as r from sc group by partition_id), "
        f"gr as (select partition_id as pid, 0 as j, quantile_cont(z_p_size, {points}) as grid from p group by all union all select partition_id, 1, quantile_cont(z_p_retailprice, {points}) from p group by all), "
        f"nn as (select pid, i, {normal[0]} as n0, {normal[1]} as n1 from s), mm as (select pid, i, 0 as j, n0 as m from nn union all select pid, i, 1, r * n0 + sqrt(1 - r * r) * n1 from nn join r using (pid)), "
        f"tt as (select *, {tail} as tail from mm), uu as (select pid, i, j, {at} as u from tt), gg as (select *, cast(floor(u) as bigint) as g from uu) "
        f"select cast(pid as int) as partition_id, i as synthetic_id, {value} from gg join gr using (pid, j) group by pid, i"
    )


query(_copula_sql((_normal("0"), _normal("1"))))(_made("univariate_kde_copula"))
query(_copula_sql((_probit(_lat(0)), _probit(_lat(1)))))(_made("lattice_copula"))


def _drawn(j: int) -> str:
    x = f"((s.i + 0.5::double) / 250 + {j * 0.6180339887498949!r}::double)"
    return f"greatest(1e-6, least(1 - 1e-6, {x} - floor({x})))"


_FLAGS = "f{j} as (select pid, {c} as v, sum(count(*)) over (partition by pid order by {c}) as upto, sum(count(*)) over (partition by pid) as whole from x group by pid, {c}), d{j} as (select s.pid, s.i, arg_min(v, upto) as v from s join f{j} on f{j}.pid = s.pid and f{j}.upto > {u} * f{j}.whole group by s.pid, s.i)"


@query(LINES + f", x as (select *, {ROUTE} as pid from z), s as (select p.pid, i from range(4) p(pid), range(250) t(i)), " + ", ".join(_FLAGS.format(j=j, c=c, u=_drawn(j)) for j, c in enumerate(("l_returnflag", "l_linestatus"))) + " select cast(d0.pid as int) as partition_id, d0.i as synthetic_id, d0.v as l_returnflag, d1.v as l_linestatus from d0 join d1 using (pid, i)")
def expand_categorical(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag", "l_linestatus").withColumn("partition_id", FIXED.leaf())
    made = generate.slots(df, dict.fromkeys(range(4), 250)).select(F.col("_pid").alias("partition_id"), F.col("_i").alias("synthetic_id"))
    return generate.categories(df, ["l_returnflag", "l_linestatus"], made, by_lattice=True)


@query(
    PARTS + ", w as (select *, case partition_id when 0 then 300 else 200 end as budget from b), m as (select *, budget >= 0.65 * n or (n > 400 and budget >= 400) as at_random from w), q as (select * from m where rk < 400 and not at_random), "
    "dd as (select a.p_partkey, a.partition_id, a.rk, a.budget, (a.z_p_size - o.z_p_size) * (a.z_p_size - o.z_p_size) + (a.z_p_retailprice - o.z_p_retailprice) * (a.z_p_retailprice - o.z_p_retailprice) as d from q a join q o using (partition_id)), "
    "near as (select *, row_number() over (partition by p_partkey order by d) as place from dd), sc as (select p_partkey, partition_id, rk, budget, round(case when count(*) filter (d > 1e-15) > 1 then var_pop(sqrt(d)) filter (d > 1e-15) else 0 end, 12) as score from near where place <= 8 group by all), "
    "pl as (select *, row_number() over (partition by partition_id order by score desc, rk) - 1 as selection_rank from sc) select p_partkey, cast(partition_id as int) as partition_id, selection_rank from pl where selection_rank < budget union all select p_partkey, cast(partition_id as int), rk from m where at_random and rk < budget"
)
def reduce_sampled_variance(spark, sf_dir):
    return select.select(parts(spark, sf_dir), ["p_partkey"], PZ, BUDGETS, "sampled_variance")


_ALPHAS = (0.0, 0.25, 0.5, 1.0, 2.0)
_CLASSES = ("A", "N", "R")


def _alpha_sql() -> str:
    """Logits from three columns; a partition's bias of a class is the log of its share there over its share of all rows."""
    share = ", ".join(f"ln((count_if(l_returnflag = '{k}') + 1.0::double) / (count(*) + 3)) as b{i}" for i, k in enumerate(_CLASSES))
    whole = ", ".join(f"ln((count_if(l_returnflag = '{k}') + 1.0::double) / (count(*) + 3)) as w{i}" for i, k in enumerate(_CLASSES))
    moved = ", ".join(f"l{i} + a * (b{i} - w{i}) as m{i}" for i in range(3))
    loss = "ln(exp(m0) + exp(m1) + exp(m2)) - case l_returnflag " + " ".join(f"when '{k}' then m{i}" for i, k in enumerate(_CLASSES)) + " end"
    return LINES + f", x as (select *, {ROUTE} as pid, z_l_quantity as l0, z_l_extendedprice as l1, z_l_discount as l2 from z), pb as (select pid, {share} from x group by pid), wb as (select {whole} from x), al as (select unnest([{', '.join(f'{a}::double' for a in _ALPHAS)}]) as a), mv as (select a, l_returnflag, {moved} from x join pb using (pid), wb, al) select a as alpha, {sr('avg(' + loss + ')', 8)} as loss from mv group by a"


@query(_alpha_sql())
def alpha_grid_losses(spark, sf_dir):
    """Mean loss of logits with a partition's correction, for each alpha of a grid."""
    x = lines(spark, sf_dir, "l_returnflag").withColumn("partition_id", FIXED.leaf())
    log_share = [F.log((F.count_if(F.col("l_returnflag") == k) + 1) / (F.count(F.lit(1)) + 3)) for k in _CLASSES]
    whole = x.agg(*log_share).first()
    bias = x.groupBy("partition_id").agg(F.array(*[s - F.lit(w) for s, w in zip(log_share, whole, strict=True)]).alias("bias"))
    rows = x.join(bias, "partition_id").select(F.array("z_l_quantity", "z_l_extendedprice", "z_l_discount").alias("logits"), (F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("l_returnflag")) - 1).alias("target"), "bias")
    found = alpha_losses(rows, "logits", "target", "bias", list(_ALPHAS))
    return spark.createDataFrame(list(found.items()), "alpha double, loss double").select("alpha", r(F.col("loss"), 8).alias("loss"))


_SCORES = {"A": "l_quantity", "N": "l_extendedprice", "R": "l_discount"}


def _auc_sql(k: str, c: str) -> str:
    """The class's mean ranks, ties sharing theirs, less what they would be if it came first."""
    inside = f"count_if(l_returnflag = '{k}')"
    area = f"(sum(case when l_returnflag = '{k}' then rk end) - {inside} * ({inside} + 1) / 2) / ({inside}::double * count_if(l_returnflag <> '{k}'))"
    return f"select '{k}' as class, cast({inside} as bigint) as positives, {sr(area, 8)} as auc from (select l_returnflag, rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as rk from lineitem)"


@query(" union all ".join(_auc_sql(k, c) for k, c in _SCORES.items()))
def auc_by_class(spark, sf_dir):
    """Each class against the rest, by a score of its own that stands in for a model's."""
    found = metrics.auc(table(spark, sf_dir, "lineitem"), "l_returnflag", _SCORES)
    return found.select("class", "positives", r(F.col("auc"), 8).alias("auc"))


@query("with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings) select a.vec_id, " + sr("min(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))", 5) + " as distance from v a join v b on b.label < 5 where a.label >= 5 group by a.vec_id")
def novelty_min_distance(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    wide = df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    found = nearest(wide.where("label >= 5"), wide.where("label < 5"), [f"e{i}" for i in range(64)], ["vec_id"])
    return found.select("vec_id", r(F.col("distance"), 5).alias("distance"))


@query("with p as (select p_partkey, p_size::double s, p_retailprice r from part) select a.p_partkey, " + sr("min(sqrt((a.s-b.s)*(a.s-b.s) + (a.r-b.r)*(a.r-b.r)))", 5) + " as distance from p a join p b on a.p_partkey <> b.p_partkey group by a.p_partkey")
def self_nearest(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return nearest(df, df, ["p_size", "p_retailprice"], ["p_partkey"], exclude_self=True).select("p_partkey", r(F.col("distance"), 5).alias("distance"))


@query("with u as (select value x, case when event_id % 2 = 0 then 1 else 0 end a from events where value is not null), c as (select x, sum(a) a, sum(1 - a) b from u group by x), s as (select x, sum(a) over (order by x) / sum(a) over () f, sum(b) over (order by x) / sum(b) over () g, lead(x) over (order by x) nx from c) select 'value' as feature, " + sr("sum(abs(f - g) * (nx - x))", 5) + " as w1 from s")
def wasserstein_distance(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    found = metrics.wasserstein(df.where("event_id % 2 = 0"), df.where("event_id % 2 <> 0"), ["value"])
    return found.select("feature", r(F.col("w1"), 5).alias("w1"))


_ROUTED = LINES + f", x as (select *, {ROUTE} as partition_id from z), k as (select partition_id, l_returnflag, count(*) as k from x group by all)"


@query(_ROUTED + f" select cast(partition_id as int) as partition_id, cast(sum(k) as bigint) as n, arg_max(l_returnflag, (k, l_returnflag)) as dominant, {sr('max(k) / sum(k)')} as purity from k group by partition_id")
def partition_purity(spark, sf_dir):
    found = metrics.purity(lines(spark, sf_dir, "l_returnflag").withColumn("partition_id", FIXED.leaf()), "l_returnflag")
    return found.select("partition_id", "n", "dominant", r(F.col("purity")).alias("purity"))


@query(_ROUTED + f", p as (select max(k) as m, sum(k) as n from k group by partition_id) select {sr('sum(m) / sum(n)')} as purity from p")
def purity_by_size(spark, sf_dir):
    found = metrics.weighted_purity(lines(spark, sf_dir, "l_returnflag").withColumn("partition_id", FIXED.leaf()), "l_returnflag")
    return found.select(r(F.col("purity")).alias("purity"))


@query(_ROUTED + f" select cast(partition_id as int) as partition_id, l_returnflag, {sr('k / sum(k) over (partition by partition_id)')} as share, cast(row_number() over (partition by partition_id order by k desc, l_returnflag) as int) as place from k")
def partition_composition(spark, sf_dir):
    found = metrics.composition(lines(spark, sf_dir, "l_returnflag").withColumn("partition_id", FIXED.leaf()), "l_returnflag")
    return found.select("partition_id", "l_returnflag", r(F.col("share")).alias("share"), "place")


@query(LINES + f", x as (select *, {ROUTE} as pid from z), k as (select pid, l_returnflag, count(*) as k, avg(l_discount) as p from x join lineitem using ({IDS}, l_returnflag, l_linestatus) group by all) select cast(pid as int) as partition_id, l_returnflag, {sr('ln(k / sum(k) over (partition by pid)) - ln(p)', 5)} as bias from k")
def partition_bias(spark, sf_dir):
    """The discount stands in for a model's probability."""
    df = fixed_model(spark, sf_dir, "l_returnflag")
    marked = df.data.join(df.assigned().select(*LINE_IDS, "partition_id"), LINE_IDS)
    return metrics.log_ratio_bias(marked, "l_returnflag", "l_discount").select("partition_id", "l_returnflag", r(F.col("bias"), 5).alias("bias"))


@query(_ROUTED + f", o as (select l_returnflag from k group by 1 order by sum(k) desc, 1 limit 2) select cast(partition_id as int) as partition_id, l_returnflag, {sr('ln(k / sum(k) over (partition by partition_id))', 5)} as log_share from k where l_returnflag in (select l_returnflag from o)")
def restricted_bias(spark, sf_dir):
    df = lines(spark, sf_dir, "l_returnflag").withColumn("partition_id", FIXED.leaf())
    return metrics.restricted_bias(df, "l_returnflag", 2).select("partition_id", "l_returnflag", r(F.col("log_share"), 5).alias("log_share"))


@query(_ROUTED + f", p as (select partition_id, sum(k) as k from k group by 1), q as (select *, k / sum(k) over () as share from p) select cast(partition_id as int) as partition_id, {sr('share')} as density, case when share < 0.22 then 'LOW' else 'OK' end as confidence from q")
def partition_density(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("partition_id", FIXED.leaf())
    return metrics.density(df, 0.22).select("partition_id", r(F.col("density")).alias("density"), "confidence")


@query("with k as (select o_custkey, count(*) as k from orders group by 1) select " + sr("avg(cast(k < 9 as double))") + " as at_risk, " + sr("avg(cast(k < 2 as double))") + " as failed from k")
def partitions_at_risk(spark, sf_dir):
    """Customers stand for partitions, in eight dimensions."""
    found = metrics.at_risk(table(spark, sf_dir, "orders"), 8, "o_custkey")
    return found.select(r(F.col("at_risk")).alias("at_risk"), r(F.col("failed")).alias("failed"))


@query("select " + sr("var_pop(1000 * l_quantity) / var_pop(l_extendedprice - 1000 * l_quantity)", 5) + " as snr from lineitem")
def signal_to_noise(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", (1000 * F.col("l_quantity").cast("double")).alias("fitted"))
    return metrics.signal_to_noise(df, "l_extendedprice", "fitted").select(r(F.col("snr"), 5).alias("snr"))


_RUNS = "with v as (select o_orderpriority as dataset, o_orderstatus as method, avg(o_totalprice) as value from orders group by all), c as (select *, {score} as score from v), k as (select *, row_number() over (partition by dataset order by score desc, method) as place, min(score) over (partition by dataset) as low, max(score) over (partition by dataset) as high from c) "


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices stand for a metric of methods on data sets."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("method")).agg(F.avg("o_totalprice").alias("value"))


@query(_RUNS.format(score="-value") + f"select dataset, method, cast(place as int) as place, {sr('case when high > low then (score - low) / (high - low) else 1 end', 5)} as heat from k")
def method_ranks(spark, sf_dir):
    return metrics.ranks(_runs(spark, sf_dir), "value", "lower", "dataset", "method").select("dataset", "method", "place", r(F.col("heat"), 5).alias("heat"))


@query(_RUNS.format(score="-abs(value - 1)") + "select method, cast(sum(case when place = 1 then 1 else 0 end) as bigint) as wins from k group by method")
def method_wins(spark, sf_dir):
    return metrics.wins(_runs(spark, sf_dir), "value", "one", "dataset", "method")


@query("with v as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), u as (select label, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y*y)))) as e from v) select a.label, count(distinct a.vec_id) as n, " + sr("avg(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])))", 5) + " as cosine from u a join u b on a.label = b.label and a.vec_id <> b.vec_id group by a.label")
def cosine_cohesion(spark, sf_dir):
    return metrics.cohesion(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", "n", r(F.col("cosine"), 5).alias("cosine"))


@query(LINES + f", x as (select *, {ROUTE} as pid from z) select cast(pid as int) as partition_id, count(*) as n, {sr(' + '.join(f'abs(skewness({c})) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))' for c in Z) , 4)} as skewness, {sr(' + '.join(f'abs(kurtosis_pop({c}))' for c in Z), 4)} as kurtosis from x group by pid")
def partition_moments(spark, sf_dir):
    x = metrics.moments(lines(spark, sf_dir).withColumn("partition_id", FIXED.leaf()), Z)
    return x.select("partition_id", "n", r(F.col("skewness") * 4, 4).alias("skewness"), r(F.col("kurtosis") * 4, 4).alias("kurtosis"))


@query("select time_bucket(interval '1 day', ts) as window_start, event_type as partition_id, count(*) as n, " + sr("avg(value)", 8) + " as mean, " + sr("stddev_pop(value)", 8) + " as std from events group by all")
def windowed_partition_stats(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("partition_id", F.col("event_type"))
    x = partition_windows(df, "ts", "value", "1 day")
    return x.select("window_start", "partition_id", "n", r(F.col("mean"), 8).alias("mean"), r(F.col("std"), 8).alias("std"))


def line_model(spark, sf_dir, **settings):
    df = table(spark, sf_dir, "lineitem").select(*LINE_IDS, *[c for c in LINE_FEATURES if c not in LINE_IDS])
    return replace(PRESETS["pairwise"], min_gain=0.0, n_partitions=40).set_params(**settings).fit(df, LINE_FEATURES, LINE_IDS)


@query()
def fit_partitions(spark, sf_dir):
    return line_model(spark, sf_dir).get_partitions()


@query()
def fit_partitions_absolute(spark, sf_dir):
    return line_model(spark, sf_dir, target="l1", scaling="mad", criterion="absolute_error").get_partitions()


@query()
def fit_reduce(spark, sf_dir):
    return line_model(spark, sf_dir).reduce(ratio=0.1)


@query()
def fit_expand(spark, sf_dir):
    return line_model(spark, sf_dir).expand(20_000)


@query()
def fit_augment(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return PRESETS["sum"].set_params(min_gain=0.0).fit(df, ["p_size", "p_retailprice"], ["p_partkey"]).augment(2 * df.count())


_FOLD = "least(4, cast(floor(('0x' || substr(md5(concat_ws('|', '42', o_orderkey)), 1, 10))::bigint / 1099511627776.0::double * 5) as int))"


@query(f"select o_orderkey, {_FOLD} as fold from orders")
def fold_split(spark, sf_dir):
    return metrics.folds(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5)


_KEYED = "md5(concat_ws('|', o_orderkey, '42'))"


@query(f"select o_orderkey from orders order by {_KEYED}, o_orderkey limit 500")
def random_rows(spark, sf_dir):
    return baselines.random_rows(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 500)


@query(f"with k as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {_KEYED}, o_orderkey) - 1 as rk, count(*) over (partition by o_orderstatus) as n from orders) select o_orderkey, o_orderstatus from k where rk < greatest(1, round(n * 0.1))")
def stratified_rows(spark, sf_dir):
    return baselines.stratified_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", 0.1)


#: Orders of two halves, which stand for given and for made rows.
_HALVES = "with a as (select * from orders where o_orderkey % 2 = 0), b as (select * from orders where o_orderkey % 2 <> 0) "


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"), "o_totalprice")
    return df.where("o_orderkey % 2 = 0"), df.where("o_orderkey % 2 <> 0")


def _one(spark: SparkSession, **values: float) -> DataFrame:
    row = spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))
    return row.select(*[r(F.col(k), 5).alias(k) for k in values])


@query(_HALVES + ", x as (select corr(o_custkey, o_totalprice) as c from a), y as (select corr(o_custkey, o_totalprice) as c from b) select " + sr("1 - sqrt(2 * (x.c - y.c) * (x.c - y.c) / (2 + 2 * x.c * x.c))", 5) + " as fidelity, " + sr("abs(x.c - y.c)", 5) + " as mae from x, y")
def correlation_fidelity(spark, sf_dir):
    real, made = _halves(spark, sf_dir)
    columns = ["o_custkey", "o_totalprice"]
    return _one(spark, fidelity=metrics.correlation_fidelity(real, made, columns), mae=metrics.correlation_mae(real, made, columns))


def _span(c: str, t: str) -> str:
    return f"(select quantile_cont({c}::double, 0.95) - quantile_cont({c}::double, 0.05) from {t})"


@query(_HALVES + "select " + sr(f"exp((ln({_span('o_custkey', 'b')} / {_span('o_custkey', 'a')}) + ln({_span('o_totalprice', 'b')} / {_span('o_totalprice', 'a')})) / 2)", 5) + " as tails")
def tail_preservation(spark, sf_dir):
    real, made = _halves(spark, sf_dir)
    return _one(spark, tails=metrics.tail_preservation(real, made, ["o_custkey", "o_totalprice"]))


_PART_HALVES = "with p as (select p_partkey, p_size::double as s, p_retailprice as r from part), a as (select * from p where p_partkey % 2 = 0), b as (select * from p where p_partkey % 2 <> 0), n as (select b.p_partkey, min(sqrt((a.s-b.s)*(a.s-b.s) + (a.r-b.r)*(a.r-b.r))) as d from b join a on true group by 1), o as (select x.p_partkey, min(sqrt((x.s-y.s)*(x.s-y.s) + (x.r-y.r)*(x.r-y.r))) as d from a x join a y on x.p_partkey <> y.p_partkey group by 1) "


def _part_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return df.where("p_partkey % 2 = 0"), df.where("p_partkey % 2 <> 0")


@query(_PART_HALVES + f"select {sr('min(d)', 5)} as min, {sr('avg(d)', 5)} as mean, {sr('quantile_cont(d, 0.05)', 5)} as p5 from n")
def novelty_statistics(spark, sf_dir):
    real, made = _part_halves(spark, sf_dir)
    return _one(spark, **metrics.novelty(real, made, ["p_size", "p_retailprice"], ["p_partkey"]))


@query(_PART_HALVES + "select " + sr("(select median(d) from n) / (select median(d) from o)", 5) + " as dcr")
def privacy_distance_ratio(spark, sf_dir):
    real, made = _part_halves(spark, sf_dir)
    return _one(spark, dcr=metrics.privacy_dcr(real, made, ["p_size", "p_retailprice"], ["p_partkey"]))


@query("select " + sr("avg(cast(p_size < 5 or p_size > 45 or p_retailprice < 5 or p_retailprice > 45 as double))", 5) + " as outside from part")
def boundary_escape(spark, sf_dir):
    return _one(spark, outside=metrics.boundary_escape(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], 5, 45))


@query(LINES + f", x as (select {ROUTE} as pid from z), c as (select pid, count(*) as n from x group by pid), s as (select *, 1001 * n / sum(n) over () as share from c) select cast(pid as int) as partition_id, cast(floor(share) as bigint) + case when row_number() over (order by share - floor(share) desc, pid) <= 1001 - (select sum(floor(share)) from s) then 1 else 0 end as budget from s")
def budgets_by_remainder(spark, sf_dir):
    rows = sorted(fixed_model(spark, sf_dir).get_partitions().select("partition_id", "size").collect())
    budget = budgets.largest_remainder(np.array([x.size for x in rows], float), 1001)
    return spark.createDataFrame([(x.partition_id, int(b)) for x, b in zip(rows, budget, strict=True)], "partition_id int, budget long")


@query(LINES + f", x as (select {ROUTE} as pid from z), c as (select pid, count(*) as n from x group by pid), s as (select *, cast(floor(1001 * n / sum(n) over ()) as bigint) as budget from c) select cast(pid as int) as partition_id, budget + case when row_number() over (order by budget, pid) = 1 then 1001 - cast((select sum(budget) from s) as bigint) else 0 end as budget from s")
def budgets_by_size(spark, sf_dir):
    """What is over goes to the smallest partition, as long as it stays the smallest."""
    rows = sorted(fixed_model(spark, sf_dir).get_partitions().select("partition_id", "size").collect())
    budget = budgets.allocate(budgets.weights(np.array([x.size for x in rows])), 1001)
    return spark.createDataFrame([(x.partition_id, int(b)) for x, b in zip(rows, budget, strict=True)], "partition_id int, budget long")


_COUNTS = "with c as (select 'lineitem' as name, count(*) as n from lineitem union all select 'orders', count(*) from orders union all select 'part', count(*) from part), l as (select name, n, kind, case when kind = 'reduction' then greatest(5, 80 * 4 // 3) else greatest(4 + 2, cast(floor(sqrt(n)) as bigint)) end as least from c, (values ('reduction'), ('expansion')) k(kind)) "


@query(_COUNTS + "select name, kind, cast(greatest(30, least(1500, 3 * n // (2 * least))) as bigint) as leaves, cast(least as bigint) as min_samples_leaf from l")
def tuned_parameters(spark, sf_dir):
    rows = [(name, kind, *tree.tuned(table(spark, sf_dir, name).count(), 4, kind == "reduction")) for name in ("lineitem", "orders", "part") for kind in ("reduction", "expansion")]
    return spark.createDataFrame(rows, "name string, kind string, leaves long, min_samples_leaf long")


@query(f"with m as (select o_orderkey, unnest([150000.0, 10.0, 300000.0]) as v, o_totalprice as y from orders) select o_orderkey, arg_min(v::double, (abs(y - v), v)) as label from m group by o_orderkey")
def snap_to_label(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return df.select("o_orderkey", g.nearest_label(F.col("o_totalprice"), [150000.0, 10.0, 300000.0]).alias("label"))


@query(LINES + f", x as (select *, {ROUTE} as partition_id from z) select cast(partition_id as int) as partition_id, count(*) as n, {sr('regr_slope(z_l_extendedprice, z_l_quantity)', 5)} as slope, {sr('regr_intercept(z_l_extendedprice, z_l_quantity)', 5)} as intercept from x group by partition_id")
def partition_lines(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("partition_id", FIXED.leaf())
    found = linear_models(df, ["z_l_quantity"], "z_l_extendedprice")
    return found.select("partition_id", "n", r(F.element_at("weights", 1), 5).alias("slope"), r(F.element_at("weights", 2), 5).alias("intercept"))


@query("with e as (select event_type, metric, value from (select event_type, unnest(['x', 'y']) as metric, unnest([value, -value]) as value from events)) select event_type as method, metric, " + ", ".join(f"{sr(v, 5)} as {k}" for k, v in {"mean": "avg(value)", "std": "stddev_pop(value)", "median": "median(value)", "min": "min(value)", "max": "max(value)"}.items()) + ", count(value) as n from e group by all")
def method_summary(spark, sf_dir):
    """Events stand for runs with two metrics."""
    runs = table(spark, sf_dir, "events").select(F.lit("d").alias("dataset"), F.col("event_type").alias("method"), F.create_map(F.lit("x"), F.col("value"), F.lit("y"), -F.col("value")).alias("metrics"))
    found = summary(runs)
    return found.select("method", "metric", *[r(F.col(c), 5).alias(c) for c in ("mean", "std", "median", "min", "max")], "n")
