"""Queries of statistics: correlation, agreement, bootstrap, stability, aggregates over the score cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import statistics as st, vectors as vx
from ..operators import gates, metrics, quantiles, resample
from ..session import fresh_dir
from ..sources import corpus, sinks
from .registry import query
from .views import SQL_PROBE, probe, read


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def corr_pearson(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(st.pearson("x", "y"), 6).alias("r"))


_RANKS = "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS b FROM part)"


@query(_RANKS + " SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def corr_spearman_ties(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_size", F.col("p_retailprice").cast("double").alias("price"))
    rows = resample.average_ranks(resample.average_ranks(part, "p_size", "a"), "price", "b")
    return rows.agg(F.count("*").alias("n"), F.round(st.pearson("a", "b"), 6).alias("rho"))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS a, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS b FROM part) SELECT count(*) AS n, round(1 - 6 * sum(CAST(a - b AS DOUBLE) * (a - b)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 6) AS rho FROM r")
def spearman_no_ties(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_size", "p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    rows = resample.numbered(resample.numbered(part, "p_size", "p_partkey", out="a"), "price", "p_partkey", out="b")
    d = (F.col("a") - F.col("b")).cast("double")
    n = F.count("*")
    return rows.agg(n.alias("n"), F.round(1 - 6 * F.sum(d * d) / (n * (n.cast("double") * n - 1)), 6).alias("rho"))


#: Two-sided p of a correlation by t: Simpson's rule over the density in 4,000 steps.
def _p_sql(r: str) -> str:
    t = f"(abs({r}) * sqrt((n - 2) / (1 - {r} * {r})))"
    density = f"exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE)) / sqrt((n - 2) * pi()) * pow(1 + pow(i * {t} / 4000, 2) / (n - 2), -(n - 1) / 2.0::DOUBLE)"
    return f"1 - 2 * {t} / 12000 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}))"


_BLOCK = "WITH v AS (SELECT CAST(s_nationkey AS DOUBLE) AS x, CAST(s_acctbal AS DOUBLE) AS y FROM supplier), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM v), c AS (SELECT count(*) AS n, corr(x, y) AS r, corr(a, b) AS rho FROM k)"


@query(_BLOCK + f" SELECT n, round(r, 4) AS r, round({_p_sql('r')}, 4) AS p, round(rho, 4) AS rho, round({_p_sql('rho')}, 4) AS p_rho FROM c")
def correlation_block(spark, sf_dir):
    """r, its p, and the rank form."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").cast("double").alias("y"))
    rows = resample.average_ranks(resample.average_ranks(rows, "x", "a"), "y", "b")
    out = rows.agg(F.count("*").alias("n"), st.pearson("x", "y").alias("r"), st.pearson("a", "b").alias("rho"))
    return out.select("n", F.round("r", 4).alias("r"), F.round(st.correlation_p("r", "n"), 4).alias("p"), F.round("rho", 4).alias("rho"), F.round(st.correlation_p("rho", "n"), 4).alias("p_rho"))


#: Systems are the return flags and line states; queries the ship modes' days. A cube of many cells.
def _means(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("system")).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("a"), F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("b"))
    return rows


_MEANS = "WITH m AS (SELECT l_returnflag || '-' || l_linestatus AS system, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS a, round(avg(CAST(l_discount AS DOUBLE)), 6) AS b FROM lineitem GROUP BY ALL), r AS (SELECT system, row_number() OVER (ORDER BY a DESC, system) AS ra, row_number() OVER (ORDER BY b DESC, system) AS rb FROM m)"


@query(_MEANS + " SELECT CAST(sum((x.rb > y.rb)::INT) AS BIGINT) AS inversions, round(1 - 2 * sum((x.rb > y.rb)::INT)::DOUBLE / count(*), 6) AS tau FROM r x JOIN r y ON x.ra < y.ra")
def kendall_tau(spark, sf_dir):
    m = _means(spark, sf_dir)
    a, b = metrics.ranking(m, "system", "a"), metrics.ranking(m, "system", "b")
    return resample.kendall(b.withColumn("rep", F.lit(0)), a).select("inversions", F.round("tau", 6).alias("tau"))


@query(_MEANS + " SELECT x.system AS first, y.system AS second FROM r x JOIN r y ON x.ra < y.ra AND x.rb > y.rb")
def ranking_inversions(spark, sf_dir):
    m = _means(spark, sf_dir)
    rows = metrics.ranking(m, "system", "a").select("system", F.col("rk").alias("ra")).join(metrics.ranking(m, "system", "b").select("system", F.col("rk").alias("rb")), "system")
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(y, F.expr("x.ra < y.ra AND x.rb > y.rb")).select(F.col("x.system").alias("first"), F.col("y.system").alias("second"))




@query(
    "WITH c AS (SELECT lang, sum(quality) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang), z AS (SELECT *, k::DOUBLE / n AS p, 1.959964::DOUBLE AS z FROM c) "
    "SELECT coalesce(lang, '-') AS lang, n, round(greatest((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0::DOUBLE*n*n))) / (1 + z*z/n), 0), 6) AS low, round(least((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0::DOUBLE*n*n))) / (1 + z*z/n), 1), 6) AS high FROM z"
)
def wilson_ci(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return rows.select(F.coalesce("lang", F.lit("-")).alias("lang"), "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_K = "WITH c AS (SELECT avg((quality = 1 - toxic)::INT) AS po, avg(quality) AS a, avg(1 - toxic) AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@query(_K + " SELECT n, round(CASE WHEN a*b + (1-a)*(1-b) = 1 THEN 1.0::DOUBLE ELSE (po - (a*b + (1-a)*(1-b))) / (1 - (a*b + (1-a)*(1-b))) END, 6) AS kappa FROM c")
def cohens_kappa(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").agg(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("double")).alias("po"), F.avg("quality").alias("a"), F.avg(1 - F.col("toxic")).alias("b"), F.count("*").alias("n"))
    expected = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return rows.select("n", F.round(st.kappa(F.col("po"), expected, 1.0), 6).alias("kappa"))


@query("WITH v AS (SELECT doc_id, unnest([quality, 1 - toxic, CAST(doc_id % 2 AS INT)]) AS vote FROM labels), m AS (SELECT doc_id, avg(vote) >= 0.5::DOUBLE AS accepted FROM v GROUP BY doc_id) SELECT source, count(*) AS n, round(avg(accepted::INT), 6) AS rate FROM m JOIN documents USING (doc_id) GROUP BY source")
def majority_vote(spark, sf_dir):
    votes = read(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.col("quality").cast("int"), (1 - F.col("toxic")).cast("int"), (F.col("doc_id") % 2).cast("int"))).alias("vote"))
    kept = votes.groupBy("doc_id").agg((F.avg("vote") >= 0.5).alias("accepted"))
    return kept.join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("accepted").cast("double")), 6).alias("rate"))


@query(
    "WITH v AS (SELECT doc_id, unnest([CASE quality WHEN 1 THEN 'P' ELSE 'A' END, CASE toxic WHEN 0 THEN 'P' ELSE 'A' END]) AS vote FROM labels), u AS (SELECT doc_id, CASE WHEN count(DISTINCT vote) = 1 THEN min(vote) END AS label FROM v GROUP BY doc_id) "
    "SELECT CASE WHEN label IS NOT NULL THEN label WHEN doc_id % 3 = 0 THEN 'D' ELSE 'unresolved' END AS label, count(*) AS n FROM u GROUP BY ALL"
)
def final_labels(spark, sf_dir):
    """Unanimous, else adjudicated (here: every third), else unresolved."""
    rows = read(spark, sf_dir, "labels")
    votes = rows.select("doc_id", F.explode(F.array(F.when(F.col("quality") == 1, "P").otherwise("A"), F.when(F.col("toxic") == 0, "P").otherwise("A"))).alias("vote"))
    agreed = votes.groupBy("doc_id").agg(F.when(F.countDistinct("vote") == 1, F.min("vote")).alias("agreed"))
    ruled = rows.where("doc_id % 3 = 0").select("doc_id", F.lit("D").alias("ruled")).distinct()
    return agreed.join(ruled, "doc_id", "left").groupBy(F.coalesce("agreed", "ruled", F.lit("unresolved")).alias("label")).agg(F.count("*").alias("n"))


_BOOT = """WITH v AS (SELECT {value} AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT rep, CAST(('0x' || substr(md5(rep || '-' || j), 1, 8)) AS BIGINT) % n AS i FROM (SELECT unnest(range(200)) AS rep) CROSS JOIN (SELECT n, unnest(range(n)) AS j FROM n)),
m AS (SELECT rep, avg(v) AS m FROM d JOIN v USING (i) GROUP BY rep)
"""


def _balances(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"), (F.col("c_acctbal").cast("double") - F.lit(100.0) * (F.col("c_custkey") % 90)).alias("d"))


@query(_BOOT.format(value="CAST(c_acctbal AS DOUBLE)") + "SELECT (SELECT count(*) FROM v) AS n, (SELECT round(avg(v), 6) FROM v) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_ci(spark, sf_dir):
    out = resample.hashed_bootstrap(_balances(spark, sf_dir), "v", "c_custkey", 200)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(_BOOT.format(value="CAST(c_acctbal AS DOUBLE) - 100.0::DOUBLE * (c_custkey % 90)") + "SELECT (SELECT round(avg(v), 6) FROM v) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m > 0)::INT), 6) AS p_positive FROM m")
def bootstrap_paired(spark, sf_dir):
    out = resample.hashed_bootstrap(_balances(spark, sf_dir), "d", "c_custkey", 200)
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")), F.round("p_positive", 6).alias("p_positive"))


_POISSON = "CASE " + " ".join(f"WHEN u < {x!r} THEN {k}" for k, x in enumerate(resample.POISSON)) + f" ELSE {len(resample.POISSON)} END"


@query(
    f"WITH v AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS v FROM customer), u AS (SELECT rep, v, CAST(('0x' || substr(md5(rep || '-' || c_custkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM v CROSS JOIN (SELECT unnest(range(200)) AS rep)), "
    f"m AS (SELECT rep, sum(v * {_POISSON}) / sum({_POISSON}) AS m FROM u GROUP BY rep) SELECT (SELECT count(*) FROM v) AS n, (SELECT round(avg(v), 4) FROM v) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, round(avg((m > 0)::INT), 6) AS p_positive FROM m"
)
def bootstrap_poisson(spark, sf_dir):
    out = resample.poisson_bootstrap(_balances(spark, sf_dir), "v", "c_custkey", 200)
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")), F.round("p_positive", 6).alias("p_positive"))


_SEEDS = _BOOT.format(value="(CAST(c_acctbal AS DOUBLE) - 100.0::DOUBLE * (c_custkey % 90)) / 10000")


@query(_SEEDS + ", s AS (SELECT c_custkey % 3 AS seed, avg((CAST(c_acctbal AS DOUBLE) - 100.0::DOUBLE * (c_custkey % 90)) / 10000) AS m FROM customer GROUP BY ALL) SELECT (SELECT count(*) FROM v) AS n, (SELECT round(100 * avg(v), 4) FROM v) AS mean_pp, round(100 * quantile_cont(m, 0.025), 4) AS low_pp, round(100 * quantile_cont(m, 0.975), 4) AS high_pp, round(avg((m > 0)::INT), 6) AS p_positive, (SELECT round(100 * stddev_samp(m), 4) FROM s) AS seed_std_pp FROM m")
def seed_merged(spark, sf_dir):
    """Three runs' paired differences as one, in points, and the deviation of the runs."""
    rows = _balances(spark, sf_dir).select("c_custkey", (F.col("c_custkey") % 3).alias("seed"), (F.col("d") / 10000).alias("d"))
    out = resample.seed_merged(rows, "seed", "d", "c_custkey", 200)
    return resample.in_points(out, also=("seed_std",)).withColumn("p_positive", F.round("p_positive", 6))


@query(_BOOT.format(value="CAST(c_acctbal AS DOUBLE) - 100.0::DOUBLE * (c_custkey % 90)") + "SELECT round((SELECT avg(v) FROM v), 4) AS mean, round(100 * (SELECT avg(v) FROM v) / (SELECT avg(CAST(c_acctbal AS DOUBLE)) FROM customer), 4) AS pct_change, quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS significant FROM m")
def significant_change(spark, sf_dir):
    out = resample.hashed_bootstrap(_balances(spark, sf_dir), "d", "c_custkey", 200)
    reference = _balances(spark, sf_dir).agg(F.avg("v").alias("reference"))
    out = resample.significance(out.crossJoin(reference), F.col("reference"))
    return out.select(F.round("mean", 4).alias("mean"), F.round("pct_change", 4).alias("pct_change"), "significant")


@query()
def bootstrap_exact(spark, sf_dir):
    """NumPy's stream for each nation: no SQL. The tests hold it against NumPy itself."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return resample.exact_bootstrap(rows, ("c_nationkey",), "v", "c_custkey", 1000)


_CUBE = "WITH s AS (SELECT l_returnflag || '-' || l_linestatus AS system, l_suppkey AS qa_id, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY ALL), f AS (SELECT qa_id FROM s GROUP BY qa_id HAVING count(*) = (SELECT count(DISTINCT system) FROM s)), c AS MATERIALIZED (SELECT * FROM s WHERE qa_id IN (SELECT qa_id FROM f))"


def _cube(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("system"), F.col("l_suppkey").alias("qa_id")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))
    systems = rows.select("system").distinct().count()
    full = rows.groupBy("qa_id").count().where(F.col("count") == systems).select("qa_id")
    return rows.join(full, "qa_id", "left_semi")


_STABLE = _CUBE + """, t AS (SELECT rep, qa_id FROM (SELECT rep, qa_id, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '-' || qa_id), qa_id) AS p FROM (SELECT DISTINCT qa_id FROM c) CROSS JOIN (SELECT unnest(range(100)) AS rep)) WHERE p <= 20),
m AS (SELECT rep, system, round(avg(value), 9) AS mean FROM t JOIN c USING (qa_id) GROUP BY ALL), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY mean DESC, system) AS rk FROM m),
g AS (SELECT system, row_number() OVER (ORDER BY mean DESC, system) AS ref FROM (SELECT system, round(avg(value), 9) AS mean FROM c GROUP BY system))
"""


def _full_ranks(cube: DataFrame) -> DataFrame:
    return metrics.ranking(cube.groupBy("system").agg(F.round(F.avg("value"), 9).alias("mean")), "system", "mean")


@query(_STABLE + "SELECT system, CAST(rk AS BIGINT) AS rk, count(*) AS n FROM r GROUP BY ALL")
def rank_histogram(spark, sf_dir):
    return resample.stability(_cube(spark, sf_dir), 20, 100).groupBy("system", F.col("rk").cast("long").alias("rk")).agg(F.count("*").alias("n"))


@query(_STABLE + ", k AS (SELECT a.rep, 1 - 2 * sum((a.rk > b.rk)::INT)::DOUBLE / count(*) AS tau FROM (SELECT * FROM r JOIN g USING (system)) a JOIN (SELECT * FROM r JOIN g USING (system)) b ON a.rep = b.rep AND a.ref < b.ref GROUP BY a.rep) SELECT round(avg(tau), 6) AS tau_mean, round(min(tau), 6) AS tau_min, round(avg((tau = 1)::INT), 6) AS unchanged FROM k")
def rank_stability(spark, sf_dir):
    cube = _cube(spark, sf_dir)
    taus = resample.kendall(resample.stability(cube, 20, 100), _full_ranks(cube))
    return taus.agg(F.round(F.avg("tau"), 6).alias("tau_mean"), F.round(F.min("tau"), 6).alias("tau_min"), F.round(F.avg((F.col("tau") == 1).cast("double")), 6).alias("unchanged"))


@query(_CUBE + " SELECT system, round(avg(value), 6) AS mean, count(*) AS n FROM c GROUP BY system")
def cube_means(spark, sf_dir):
    return _cube(spark, sf_dir).groupBy("system").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


_PAIR = "WITH p AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS treated, CAST(o_totalprice AS DOUBLE) + 10 * (o_orderkey % 7 - 3) AS control FROM orders)"


def _paired(spark, sf_dir) -> DataFrame:
    t = F.col("o_totalprice").cast("double")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", t.alias("treated"), (t + 10 * (F.col("o_orderkey") % 7 - 3)).alias("control"))


@query(_PAIR + ", d AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS level, treated - control AS diff FROM p UNION ALL SELECT 'o_orderpriority', o_orderpriority, treated - control FROM p) SELECT dimension, level, count(*) AS n, round(avg(diff), 6) AS delta FROM d GROUP BY ALL HAVING count(*) >= 8")
def subgroup_deltas(spark, sf_dir):
    return metrics.subgroup_deltas(_paired(spark, sf_dir), ("o_orderstatus", "o_orderpriority")).withColumn("delta", F.round("delta", 6))


@query(_PAIR + " SELECT count(*) AS n, round(100 * avg((round(treated - control, 4) > 0)::INT), 6) AS improved, round(100 * avg((round(treated - control, 4) < 0)::INT), 6) AS degraded, round(100 * avg((round(treated - control, 4) = 0)::INT), 6) AS unchanged FROM p")
def change_shares(spark, sf_dir):
    rows = _paired(spark, sf_dir).select(F.round(F.col("treated") - F.col("control"), 4).alias("treated"), F.lit(0.0).alias("control"))
    return metrics.change_shares(rows).select("n", *(F.round(c, 6).alias(c) for c in ("improved", "degraded", "unchanged")))


@query(_PAIR + ", h AS (SELECT *, o_orderkey % 2 AS b FROM p) SELECT 'combined' AS bench, count(*) AS n, round(avg(treated - control), 6) AS delta FROM h UNION ALL SELECT CASE b WHEN 0 THEN 'even' ELSE 'odd' END, count(*), round(avg(treated - control), 6) FROM h GROUP BY b")
def combined_benchmarks(spark, sf_dir):
    rows = _paired(spark, sf_dir)
    named = [rows.where(F.col("o_orderkey") % 2 == i).withColumn("bench", F.lit(n)) for i, n in enumerate(("even", "odd"))]
    every = reduce(DataFrame.unionByName, [*named, *(x.withColumn("bench", F.lit("combined")) for x in named)])
    return every.groupBy("bench").agg(F.count("*").alias("n"), F.round(F.avg(F.col("treated") - F.col("control")), 6).alias("delta"))


@query(_PAIR + " SELECT o_orderkey FROM p WHERE abs(treated - control) > 25")
def differing_values(spark, sf_dir):
    rows = _paired(spark, sf_dir)
    return gates.differing(rows.select("o_orderkey", "treated"), rows.select("o_orderkey", F.col("control").alias("treated")), ("o_orderkey",), "treated", 25.0).select("o_orderkey")


@query(_CUBE + " SELECT system, CAST(qa_id AS VARCHAR) AS qa_id, round(value, 6) AS value, 'mrr' AS metric, 5 AS k, 'dense' AS retriever FROM c")
def cube_round_trip(spark, sf_dir):
    """The cube as one JSON document, written to the shared folder and read back."""
    cube = _cube(spark, sf_dir).select("system", F.lit("dense").alias("retriever"), F.lit("mrr").alias("metric"), F.lit(5).alias("k"), F.col("qa_id").cast("string").alias("qa_id"), F.round("value", 6).alias("value"))
    path = fresh_dir(spark, "cube")
    sinks.cube_json(cube).write.text(path)
    return corpus.read_cube(spark, path)


_LP = "WITH l AS (SELECT l_orderkey, l_linenumber, -CAST(l_quantity AS DOUBLE) / 10 AS pc, -CAST(l_extendedprice AS DOUBLE) / 10000 AS pr, -CAST(l_discount AS DOUBLE) * 10 AS rc, -CAST(l_tax AS DOUBLE) * 10 AS rr, CAST(l_quantity AS INT) AS nc, l_linenumber + 1 AS nr FROM lineitem)"


def _logprobs(spark, sf_dir) -> DataFrame:
    d = lambda c: -F.col(c).cast("double")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (d("l_quantity") / 10).alias("pc"), (d("l_extendedprice") / 10000).alias("pr"), (d("l_discount") * 10).alias("rc"), (d("l_tax") * 10).alias("rr"), F.col("l_quantity").cast("int").alias("nc"), (F.col("l_linenumber") + 1).alias("nr"))


_SOFT = "(greatest(-({m}), 0) + ln(1 + exp(-abs({m}))))"


@query(_LP + ", m AS (SELECT *, 0.1::DOUBLE * ((pc - pr) - (rc - rr)) AS m FROM l) SELECT count(*) AS n, round(avg(" + _SOFT.format(m="m") + "), 6) AS loss, round(avg(0.9::DOUBLE * " + _SOFT.format(m="m") + " + 0.1::DOUBLE * " + _SOFT.format(m="-m") + "), 6) AS smoothed, round(avg(((pc - rc) > (pr - rr))::INT), 6) AS accuracy, round(avg(0.1::DOUBLE * ((pc - rc) - (pr - rr))), 6) AS reward_margin FROM m")
def dpo_loss(spark, sf_dir):
    m = vx.dpo_margin(*(F.col(c) for c in ("pc", "pr", "rc", "rr")))
    chosen, rejected = F.col("pc") - F.col("rc"), F.col("pr") - F.col("rr")
    return _logprobs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(vx.dpo_loss(m)), 6).alias("loss"), F.round(F.avg(vx.dpo_loss(m, 0.1)), 6).alias("smoothed"), F.round(F.avg((chosen > rejected).cast("double")), 6).alias("accuracy"), F.round(F.avg(0.1 * (chosen - rejected)), 6).alias("reward_margin"))


@query(_LP + ", m AS (SELECT 2.0::DOUBLE * (pc / greatest(nc, 1) - pr / greatest(nr, 1)) - 1 AS m FROM l) SELECT count(*) AS n, round(avg(" + _SOFT.format(m="m") + "), 6) AS loss FROM m")
def simpo_loss(spark, sf_dir):
    m = vx.simpo_margin(F.col("pc"), F.col("nc"), F.col("pr"), F.col("nr"))
    return _logprobs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(-vx.log_sigmoid(m)), 6).alias("loss"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id, list_dot_product(a.e, b.e) / 0.07::DOUBLE AS pos, [list_dot_product(a.e, b.e), list_dot_product(a.e, c.e), list_dot_product(a.e, d.e)] AS l FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 JOIN e d ON d.vec_id = a.vec_id + 3) SELECT vec_id, round(ln(list_sum(list_transform(l, lambda x: exp(x / 0.07::DOUBLE)))) - pos, 5) AS loss FROM s")
def infonce(spark, sf_dir):
    """Each vector against the next three, the first of which is its positive."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = e
    for i in (1, 2, 3):
        rows = rows.join(e.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(f"e{i}")), "vec_id")
    s = rows.select("vec_id", *(vx.dot(F.col("embedding"), F.col(f"e{i}")).alias(f"s{i}") for i in (1, 2, 3)))
    return s.select("vec_id", F.round(vx.info_nce(F.col("s1"), F.array("s2", "s3")), 5).alias("loss"))


@query("SELECT vec_id, round((CAST(embedding AS DOUBLE[])[1] + CAST(embedding AS DOUBLE[])[3]) / 2, 6) AS masked, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm FROM embeddings")
def pooled_vectors(spark, sf_dir):
    """Masked mean over the first four numbers as vectors of one, and the norm."""
    e = F.col("embedding")
    rows = F.transform(F.slice(e, 1, 4), lambda x: F.array(x.cast("double")))
    mask = F.array(*(F.lit(m) for m in (1, 0, 1, 0)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.masked_mean(rows, mask)[0], 6).alias("masked"), F.round(vx.norm(e), 5).alias("norm"))


@query("SELECT l_orderkey, round(sum(lp) FILTER (WHERE n > 1 AND m = 1), 6) AS logprob, count(*) FILTER (WHERE n > 1 AND m = 1) AS n_tokens FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount DESC) AS n, CAST(l_linenumber % 3 <> 0 AS INT) AS m, lag(-CAST(l_discount AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount DESC) AS lp FROM lineitem) GROUP BY l_orderkey HAVING count(*) FILTER (WHERE n > 1 AND m = 1) > 0")
def sequence_logprobs(spark, sf_dir):
    """Log-probabilities whose next token is in the response, summed."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (-F.col("l_discount").cast("double")).alias("lp"), (F.col("l_linenumber") % 3 != 0).cast("int").alias("m")))).alias("t"))
    got = rows.select("l_orderkey", vx.sequence_logprob(F.transform("t", lambda x: x["lp"]), F.transform("t", lambda x: x["m"])).alias("s"))
    return got.select("l_orderkey", F.round("s.sum", 6).alias("logprob"), F.col("s.n").cast("long").alias("n_tokens")).where("n_tokens > 0")


@query("SELECT l_returnflag, max(CASE WHEN l_linestatus = 'F' THEN q END) AS f, max(CASE WHEN l_linestatus = 'O' THEN q END) AS o FROM (SELECT l_returnflag, l_linestatus, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS q FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def metric_pivot(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6))
    return out.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("SELECT source, lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source, lang")
def composition(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))




@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.05), 4) AS low, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95), 4) AS high FROM lineitem GROUP BY ALL")
def exact_quantiles(spark, sf_dir):
    """Exact quantiles by narrowing ranges: no group's values meet in one place."""
    got = quantiles.exact(read(spark, sf_dir, "lineitem"), "l_extendedprice", (0.05, 0.5, 0.95), ("l_returnflag", "l_linestatus"))
    return got.select("l_returnflag", "l_linestatus", "n", *(F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("low", "median", "high"))))


@query("SELECT l_returnflag, count(*) AS n, true AS within FROM lineitem GROUP BY l_returnflag")
def sketched_quantiles(spark, sf_dir):
    """Quantiles by mergeable sketches: the rank of each is as near as the error says."""
    at, error = (0.01, 0.25, 0.5, 0.75, 0.99), 0.002
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    got = quantiles.sketched(rows, "v", at, ("l_returnflag",), error)
    both = rows.join(F.broadcast(got), "l_returnflag")  # a row for each of three flags
    below = [F.sum((F.col("v") < F.col("q")[i]).cast("long")) / F.count("*") for i in range(len(at))]
    upto = [F.sum((F.col("v") <= F.col("q")[i]).cast("long")) / F.count("*") for i in range(len(at))]
    slack = error + 1 / F.count("*")  # and one row
    near = [(b <= p + slack) & (u >= p - slack) for b, u, p in zip(below, upto, at)]
    return both.groupBy("l_returnflag").agg(F.count("*").alias("n"), reduce(lambda a, b: a & b, near).alias("within"))


@query(f"WITH {SQL_PROBE}, s AS (SELECT CASE WHEN grouping(question_type) = 0 THEN 'question_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'all' END AS dimension, coalesce(question_type, difficulty, 'all') AS level, count(*) AS n FROM qa_v GROUP BY GROUPING SETS ((), (question_type), (difficulty))) SELECT dimension, level, n, round(n / (SELECT max(n) FROM s WHERE dimension = 'all'), 6) AS share FROM s")
def question_summary(spark, sf_dir):
    """A run's questions by type and by difficulty."""
    got = metrics.distribution(probe(spark, sf_dir), ("question_type", "difficulty"))
    return got.withColumn("share", F.round("share", 6))
