"""Registered aggregates (A), set operations (U) and data-quality products (X9, X13), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.functions.math import binned
from finlark.operators import aggregates as A
from finlark.operators.order import grouped_quantiles
from finlark.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = run, B.WITH + sql
        return run

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


#: The report's categories, scaled to the balances of the table.
TIER = "case when market_cap >= 60e9 then 'mega' when market_cap >= 30e9 then 'large' when market_cap >= 10e9 then 'mid' else 'small' end"


@query("A1_bucket_join_count", f"select {TIER} as bucket, count(*) as n from filing join company using (company_id) group by 1")
def bucket_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).join(B.companies(spark, sf_dir).select("company_id", "market_cap"), "company_id").groupBy(F.expr(TIER).alias("bucket")).agg(F.count("*").alias("n"))


@query("A2_bucket_share", "select case when concern <= 2 then 'LOW' when concern <= 4 then 'MODERATE' when concern <= 6 then 'ELEVATED' when concern <= 8 then 'HIGH' else 'CRITICAL' end as bucket, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from filing group by 1")
def bucket_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.functions.math import concern_label

    return rounded(A.share_of_total(B.filings(spark, sf_dir), concern_label(F.col("concern"))))


@query("A3_A4_counts", "select count(*) as n, count(pe_ratio) as with_pe, round(avg(pe_ratio), 6) as mean_pe, min(beta) as low, max(beta) as high, count(*) filter (beta > 1) as above from company")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.companies(spark, sf_dir).agg(F.count("*").alias("n"), F.count("pe_ratio").alias("with_pe"), F.avg("pe_ratio").alias("mean_pe"), F.min("beta").alias("low"), F.max("beta").alias("high"), F.count_if(F.col("beta") > 1).alias("above")))


@query("A5_children_count", "select company_id, count(filing_id) as filings from company left join filing using (company_id) group by 1")
def children_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = B.filings(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n"))
    return B.companies(spark, sf_dir).join(made, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("filings"))


@query("A6_conditional_counts", "select filing_type, count(*) filter (concern > 6) as high, count(*) filter (sentiment > 0 and confidence >= 0.8) as good, count(*) filter (predicted * actual > 0) as same from filing group by 1")
def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).groupBy("filing_type").agg(F.count_if(F.col("concern") > 6).alias("high"), F.count_if((F.col("sentiment") > 0) & (F.col("confidence") >= 0.8)).alias("good"), F.count_if(F.col("predicted") * F.col("actual") > 0).alias("same"))


@query("A7_first_per_key", "select company_id, filing_id from (select *, row_number() over (partition by company_id order by filing_date desc, filing_id) as k from filing) where k = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).select("company_id", "filing_id", "day")
    return A.first_of(rows, ["company_id"], [-F.col("day"), F.col("filing_id")]).select("company_id", "filing_id")


ERR = "count(*) as n, round(avg(abs(predicted - actual)), 6) as mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) as rmse, round(avg(predicted - actual), 6) as bias, round(avg(cast(sign(predicted) = sign(actual) as double)) * 100, 6) as direction, count(*) filter (abs(predicted - actual) < 1) as excellent, count(*) filter (abs(predicted - actual) >= 1 and abs(predicted - actual) < 2) as good, count(*) filter (abs(predicted - actual) >= 2 and abs(predicted - actual) < 4) as fair, count(*) filter (abs(predicted - actual) >= 4) as poor"


@query("A8_error_statistics", f"select filing_type, {ERR} from filing group by 1")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.filings(spark, sf_dir).groupBy("filing_type").agg(*A.error_statistics(F.col("predicted"), F.col("actual"))))


@query("A9_alpha_statistics", "select status, round(avg(case when predicted <> 0 then cast(sign(predicted) = sign(actual) as double) end) * 100, 6) as direction, round(avg(case when predicted <> 0 and confidence >= 0.8 then cast(sign(predicted) = sign(actual) as double) end) * 100, 6) as sure_direction, round(avg(actual) filter (predicted > 0), 6) as long, round(avg(actual) filter (predicted < 0), 6) as short, round(avg(actual) filter (predicted > 0) - avg(actual) filter (predicted < 0), 6) as spread from filing group by 1")
def alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.filings(spark, sf_dir).groupBy("status").agg(*A.alpha_statistics(F.col("predicted"), F.col("actual"), F.col("confidence"))))


@query("A10_error_labels", "select case when e < 5 then 'excellent' when e < 15 then 'good' when e < 30 then 'fair' else 'poor' end as label, count(*) as n, count(*) filter ((predicted > 0) = (actual > 0)) as same from (select *, abs((predicted - actual) * 100 / nullif(actual, 0)) as e from filing) group by 1")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs(F.try_divide((F.col("predicted") - F.col("actual")) * 100, F.col("actual")))
    return B.filings(spark, sf_dir).groupBy(F.when(e < 5, "excellent").when(e < 15, "good").when(e < 30, "fair").otherwise("poor").alias("label")).agg(F.count("*").alias("n"), F.count_if((F.col("predicted") > 0) == (F.col("actual") > 0)).alias("same"))


@query("A12_trade_statistics", "select company_id, count(*) as trades, count(*) filter (actual > 0) as wins, round(sum(actual) filter (actual > 0) / nullif(-sum(actual) filter (actual <= 0), 0), 6) as profit_factor, max_by(filing_id, (actual, -filing_id)) as best, min_by(filing_id, (actual, filing_id)) as worst from filing group by 1")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain, loss = F.sum(F.when(F.col("actual") > 0, F.col("actual"))), -F.sum(F.when(F.col("actual") <= 0, F.col("actual")))
    best, worst = F.max_by("filing_id", F.struct(F.col("actual"), -F.col("filing_id"))), F.min_by("filing_id", F.struct(F.col("actual"), F.col("filing_id")))
    return rounded(B.filings(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("trades"), F.count_if(F.col("actual") > 0).alias("wins"), F.try_divide(gain, loss).alias("profit_factor"), best.alias("best"), worst.alias("worst")))


@query("A13_model_metrics_by_slice", f"select coalesce(filing_type, 'all') as filing_type, coalesce(status, 'all') as status, {ERR}, round(1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual), 6) as r2 from filing group by grouping sets ((filing_type), (status), ())")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir)
    made = rows.groupingSets([[F.col("filing_type")], [F.col("status")], []], F.col("filing_type"), F.col("status")).agg(*A.error_statistics(F.col("predicted"), F.col("actual")), A.r_squared(F.col("predicted"), F.col("actual")).alias("r2"))
    return rounded(made.fillna("all", ["filing_type", "status"]))


@query("A13_upper_median", "select filing_type, round(list_sort(list(abs(predicted - actual)))[count(*) // 2 + 1], 6) as median from filing group by 1")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.upper_median(B.filings(spark, sf_dir), "filing_type", F.abs(F.col("predicted") - F.col("actual"))))


@query("A14_ranking", "select status, round(avg(cast(sign(predicted) = sign(actual) as double)) - 10 * avg(abs(predicted - actual)), 6) as score from filing group by 1 order by score desc")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.filings(spark, sf_dir).groupBy("status").agg((F.avg((F.signum(F.col("predicted")) == F.signum(F.col("actual"))).cast("double")) - 10 * F.avg(F.abs(F.col("predicted") - F.col("actual")))).alias("score"))).orderBy(F.col("score").desc())


@query("A15_correlation", "select filing_type, round(corr(sentiment, actual), 6) as r, 0.0::double as constant from filing group by 1")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.filings(spark, sf_dir).groupBy("filing_type").agg(A.correlation(F.col("sentiment"), F.col("actual")).alias("r"), A.correlation(F.col("sentiment") * 0, F.col("actual")).alias("constant")))


@query("A16_beat_miss_means", "select case when predicted > 2 then 'beat' when predicted < -2 then 'miss' else 'inline' end as kind, count(*) as n, round(avg(actual), 6) as mean from filing group by 1")
def beat_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.functions.math import surprise_class

    return rounded(B.filings(spark, sf_dir).groupBy(surprise_class(F.col("predicted")).alias("kind")).agg(F.count("*").alias("n"), F.avg(F.col("actual")).alias("mean")))


@query("A17_A18_right_closed_bins", "select case when predicted > -8 and predicted <= -4 then '(-8,-4]' when predicted > -4 and predicted <= 0 then '(-4,0]' when predicted > 0 and predicted <= 4 then '(0,4]' when predicted > 4 and predicted <= 8 then '(4,8]' end as bin, count(*) as n from filing group by 1")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).groupBy(binned(F.col("predicted"), [-8, -4, 0, 4, 8], ["(-8,-4]", "(-4,0]", "(0,4]", "(4,8]"]).alias("bin")).agg(F.count("*").alias("n"))


@query("A19_quantiles", "select filing_type, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90 from filing group by 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grouped_quantiles(B.filings(spark, sf_dir), ["filing_type"], F.col("value"), [0.1, 0.5, 0.9], ["p10", "p50", "p90"]).drop("n"))


@query("A20_winsorised", "select filing_id, round(greatest(lo, least(hi, value)), 6) as value_clipped from filing, (select quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from filing)")
def winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.winsorised_at(B.filings(spark, sf_dir), "value").select("filing_id", "value_clipped"))


@query("A21_months", "select cast(date_trunc('month', filing_date) as date) as month, count(*) as n from filing where abs(actual) > 7 group by 1 order by n desc, month limit 20")
def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).where(F.abs(F.col("actual")) > 7).groupBy(F.trunc(F.col("filing_date").cast("date"), "month").alias("month")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "month").limit(20)


@query("A22_deviations", "select sector, round(stddev_samp(market_cap), 4) as sample, round(stddev_pop(market_cap), 4) as population from company group by 1")
def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.companies(spark, sf_dir).groupBy("sector").agg(F.stddev_samp("market_cap").alias("sample"), F.stddev_pop("market_cap").alias("population")), 4)


@query("A23_calibration", f"select case when confidence >= 0.65 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as bucket, {TIER} as tier, grouping({TIER}) as whole, count(*) as n, round(avg(confidence), 6) as mean_confidence, round(avg(cast(sign(predicted) = sign(actual) as double)), 6) as accuracy from filing join company using (company_id) group by rollup (1, 2) having grouping(1) = 0".replace("having grouping(1) = 0", "having bucket is not null"))
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).join(B.companies(spark, sf_dir).select("company_id", "market_cap"), "company_id").withColumns({"bucket": F.when(F.col("confidence") >= 0.65, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"), "tier": F.expr(TIER)})
    made = rows.rollup("bucket", "tier").agg(F.grouping("tier").cast("bigint").alias("whole"), F.count("*").alias("n"), F.avg(F.col("confidence")).alias("mean_confidence"), F.avg((F.signum(F.col("predicted")) == F.signum(F.col("actual"))).cast("double")).alias("accuracy"))
    return rounded(made.where("bucket is not null"))


@query("A24_segments", f"select {TIER} as tier, count(*) as n, round(avg(beta), 6) as mean, round(stddev_pop(beta), 6) as sd, count(*) filter (latest_revenue_yoy > 0) as growing from company group by 1")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.companies(spark, sf_dir).groupBy(F.expr(TIER).alias("tier")).agg(F.count("*").alias("n"), F.avg("beta").alias("mean"), F.stddev_pop("beta").alias("sd"), F.count_if(F.col("latest_revenue_yoy") > 0).alias("growing")))


@query("A25_threshold_sweep", "select threshold, count(*) as n, round(avg(cast(sign(predicted) = sign(actual) as double)), 6) as accuracy, round(avg(actual), 6) as mean_return, round(avg(actual) filter (predicted > 0), 6) as long_return, round(count(*) * 1.0 / (select count(*) from filing), 6) as coverage from filing, (select unnest([0.1, 0.3, 0.5, 0.7, 0.8, 0.9]::double[]) as threshold) where confidence >= threshold group by 1")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.sweep(B.filings(spark, sf_dir), [0.1, 0.3, 0.5, 0.7, 0.8, 0.9], confidence="confidence", predicted="predicted", actual="actual"))


@query("A26_confusion", "select filing_type, tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from (select filing_type, count(*) filter (predicted > 0 and actual > 0) as tp, count(*) filter (predicted > 0 and actual <= 0) as fp, count(*) filter (predicted <= 0 and actual > 0) as fn, count(*) filter (predicted <= 0 and actual <= 0) as tn from filing group by 1)")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.filings(spark, sf_dir).groupBy("filing_type").agg(*A.confusion(F.col("predicted") > 0, F.col("actual") > 0)))


@query("A26_auc", ", r as (select actual > 0 as y, rank() over (order by confidence) + (count(*) over (partition by confidence) - 1) / 2.0 as k from filing) select round((sum(k) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2.0) / (count(*) filter (y) * count(*) filter (not y)), 6) as auc from r")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.auc(B.filings(spark, sf_dir).select("confidence", (F.col("actual") > 0).alias("y")), "confidence", "y"))


@query("A27_completeness", "select 'pe_ratio' as column, round(count(pe_ratio) / count(*), 6) as ratio from company union all select 'beta', round(count(beta) / count(*), 6) from company union all select 'market_cap', 1.0 from company limit 3".replace(" union all select 'market_cap', 1.0 from company limit 3", " union all select 'market_cap', round(count(market_cap) / count(*), 6) from company"))
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.completeness(B.companies(spark, sf_dir), ["pe_ratio", "beta", "market_cap"]))


@query("A28_failure_rate", "select company_id, count(*) as n, round(avg(cast(action = 'error' as double)), 6) as rate from (select *, row_number() over (partition by company_id order by ts desc, event_id desc) as k from activity) where k <= 10 group by 1 having count(*) >= 5 and avg(cast(action = 'error' as double)) > 0.25")
def failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.streaming.jobs import failing

    return rounded(failing(B.activity(spark, sf_dir), key="company_id", order=["ts", "event_id"], failed=F.col("action") == "error", over=0.25))


@query("A30_A31_duplicates", "select company_id, day, count(*) as copies, min(filing_id) as kept from filing group by 1, 2 having count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).groupBy("company_id", "day").agg(F.count("*").alias("copies"), F.min("filing_id").alias("kept")).where("copies > 1")


@query("A32_segment_counts", "select filing_type, status, count(*) as n from filing group by 1, 2")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.filings(spark, sf_dir).groupBy("filing_type", "status").agg(F.count("*").alias("n"))


@query("U1_U2_union_left_wins", "select filing_id, 'feed' as origin from filing where filing_id % 4 = 0 union all select filing_id, 'index' from filing where filing_id % 6 = 0 and filing_id % 4 <> 0")
def union_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.operators.merge import union_by_key

    ids = B.filings(spark, sf_dir).select("filing_id")
    return union_by_key(ids.where("filing_id % 4 = 0").withColumn("origin", F.lit("feed")), ids.where("filing_id % 6 = 0").withColumn("origin", F.lit("index")), ["filing_id"])


@query("U3_U4_distinct_membership", "select distinct company_id from filing where company_id in (select company_id from company order by market_cap desc, company_id limit 100)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = B.companies(spark, sf_dir).orderBy(F.col("market_cap").desc(), "company_id").limit(100).select("company_id")
    return B.filings(spark, sf_dir).select("company_id").distinct().join(F.broadcast(best), "company_id", "left_semi")


@query("S25_upsert", "select filing_id, value, 'old' as origin from filing where filing_id % 2 = 0 and filing_id % 10 <> 0 union all select filing_id, value * 2, 'new' from filing where filing_id % 5 = 0")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.operators.merge import upsert

    rows = B.filings(spark, sf_dir).select("filing_id", "value")
    base = rows.where("filing_id % 2 = 0").withColumn("origin", F.lit("old"))
    delta = rows.where("filing_id % 5 = 0").select("filing_id", (F.col("value") * 2).alias("value"), F.lit("new").alias("origin"))
    return upsert(base, delta, ["filing_id"])


@query("S26_S27_update_delete", "select filing_id, case when status = 'P' then 'failed' else status end as status from filing where company_id not in (select company_id from company where sector = 'BUILDING')")
def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finlark.operators.merge import delete_matching, update_where

    rows = B.filings(spark, sf_dir).select("filing_id", "company_id", "status")
    kept = delete_matching(rows, B.companies(spark, sf_dir).where("sector = 'BUILDING'").select("company_id"), ["company_id"])
    return update_where(kept, F.col("status") == "P", {"status": F.lit("failed")}).select("filing_id", "status")


@query("X9_data_quality", "select filing_type, count(*) as n, count(*) - count(distinct (company_id, day)) as repeats, count(distinct company_id) as companies, count(*) filter (abs(actual) > 7.5) as extreme, round(quantile_cont(actual, 0.05), 10) as p5, round(quantile_cont(actual, 0.95), 10) as p95, count(distinct concern) < 5 as suspicious from filing group by 1")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = B.filings(spark, sf_dir).groupBy("filing_type").agg(F.count("*").alias("n"), F.count_distinct("company_id", "day").alias("d"), F.count_distinct("company_id").alias("companies"), F.count_if(F.abs(F.col("actual")) > 7.5).alias("extreme"), (F.count_distinct("concern") < 5).alias("suspicious"))
    made = made.join(grouped_quantiles(B.filings(spark, sf_dir), ["filing_type"], F.col("actual"), [0.05, 0.95], ["p5", "p95"]).drop("n"), "filing_type")
    return rounded(made.select("filing_type", "n", (F.col("n") - F.col("d")).alias("repeats"), "companies", "extreme", "p5", "p95", "suspicious"), 10)


@query("X13_job_health", "select action as job, min(ts) as first, max(ts) as last, count(*) as runs, count(*) filter (value > 50) as slow from activity where ts >= timestamp '2024-01-23' group by 1")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.activity(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-23")).groupBy(F.col("action").alias("job")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("runs"), F.count_if(F.col("value") > 50).alias("slow"))


@query("V14_distribution", "select coalesce(filing_type, 'all') as filing_type, coalesce(cast(year(filing_date) as varchar), 'all') as y, count(*) as n, count(*) filter (actual > 0) as up, round(quantile_cont(actual, 0.25), 10) as p25, round(quantile_cont(actual, 0.75), 10) as p75 from filing group by grouping sets ((filing_type), (cast(year(filing_date) as varchar)))".replace("cast(year(filing_date) as varchar), 'all') as y", "yy, 'all') as y").replace("from filing group by grouping sets ((filing_type), (cast(year(filing_date) as varchar)))", "from (select *, cast(year(filing_date) as varchar) as yy from filing) group by grouping sets ((filing_type), (yy))"))
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.filings(spark, sf_dir).withColumn("y", F.year("filing_date").cast("string"))
    sets = F.array(F.struct("filing_type", F.lit("all").alias("y")), F.struct(F.lit("all").alias("filing_type"), "y"))
    each = rows.select("actual", F.explode(sets).alias("s")).select("actual", "s.*")
    made = each.groupBy("filing_type", "y").agg(F.count("*").alias("n"), F.count_if(F.col("actual") > 0).alias("up"))
    return rounded(made.join(grouped_quantiles(each, ["filing_type", "y"], F.col("actual"), [0.25, 0.75], ["p25", "p75"]).drop("n"), ["filing_type", "y"]), 10)

