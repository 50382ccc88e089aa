"""Registered queries: merges, listings, status, messages, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions import text
from trellium.operators import listing, merge, metrics, scoring
from trellium.operators.joins import join_hot
from trellium.plans.book import query, table
from trellium.sources import messages as msg
from trellium.sources import registry as reg
from trellium.sources.catalog import Catalog
from trellium.sources.folders import new_folder, read_table, write_table


def _job(key: str = "o_orderkey"):
    return F.concat(F.lit("job-"), F.col(key))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs; the priority stands for the owner."""
    return table(spark, sf_dir, "orders").select(
        _job().alias("job_id"),
        F.concat(F.lit("model "), F.col("o_custkey")).alias("model_name"),
        F.when(F.col("o_orderstatus") == "F", "regression").otherwise("classification").alias("task_type"),
        F.lit("label").alias("target_column"),
        F.lit(None).cast("string").alias("uploader"),
        F.lit("queued").alias("status"),
        F.col("o_orderpriority").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of finished orders have a model; the owner is left empty there."""
    done = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return done.select(
        _job().alias("job_id"),
        F.concat(F.lit("/models/"), _job(), F.lit(".pkl")).alias("model_path"),
        F.lit(None).cast("string").alias("user_id"),
        F.current_timestamp().alias("created_at"),
    )


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders of two priorities have metadata."""
    known = table(spark, sf_dir, "orders").filter(
        (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    )
    return known.select(
        _job().alias("model_id"),
        F.lit("spark_mllib").alias("model_type"),
        F.concat(F.lit("/models/"), _job(), F.lit(".pkl.spark")).alias("spark_path"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("sqft"), F.lit("age"))).alias("feature_cols"),
        F.lit("regression").alias("task_type"),
        F.lit("label").alias("target_column"),
        F.lit(None).cast("map<string,string>").alias("feature_types"),
        F.lit("linear").alias("estimator"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


_DAY = "yyyy-MM-dd"


@query(
    """
    select 'job-' || o_orderkey as job_id, 'model ' || o_custkey as model_name, 'regression' as task_type,
           o_orderpriority as user_id, strftime(o_orderdate, '%Y-%m-%d') as created_at,
           '/models/job-' || o_orderkey || '.pkl' as model_path
    from orders where o_orderstatus = 'F'
    """
)
def model_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that have a model, newest first."""
    got = listing.model_listing(_jobs(spark, sf_dir), _models(spark, sf_dir))
    return got.withColumn("created_at", F.date_format("created_at", _DAY))


@query(
    """
    select 'job-' || o_orderkey as job_id, strftime(o_orderdate, '%Y-%m-%d') as created_at
    from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'
    """
)
def owner_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of one owner; the filter reaches the scan."""
    got = listing.model_listing(_jobs(spark, sf_dir), _models(spark, sf_dir), "1-URGENT")
    return got.select("job_id", F.date_format("created_at", _DAY).alias("created_at"))


@query(
    """
    select 'job-' || o_orderkey as job_id, '/models/job-' || o_orderkey || '.pkl' as model_path,
           case when o_orderpriority < '3' then 'label' end as target_column,
           case when o_orderpriority = '2-HIGH' then 'sqft,age' else '' end as feature_cols
    from orders where o_orderstatus = 'F'
    """
)
def model_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with target and features, null and empty where unknown."""
    got = listing.model_detail(_jobs(spark, sf_dir), _models(spark, sf_dir), _registry(spark, sf_dir))
    return got.select("job_id", "model_path", "target_column", F.array_join("feature_cols", ",").alias("feature_cols"))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as stored artifacts of their order's job."""
    job, number, kind = _job("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")
    path = (
        F.when(kind == "A", F.concat(F.lit("uploads/"), job, F.lit("/"), number, F.lit(".csv")))
        .when((kind == "N"), F.concat(F.lit("s3a://bucket/processed/"), job, F.lit(".parquet/part-"), number))
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("models/"), job, F.lit(".pkl.meta")))
        .otherwise(F.concat(F.lit("models/"), job, F.lit(".pkl.spark/metadata/part-0")))
    )
    return table(spark, sf_dir, "lineitem").select(path.alias("path"))


@query(
    """
    with a as (select l_orderkey, max(case when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 2
                                           when l_linestatus = 'O' then 3 else 0 end) as r
               from lineitem group by 1)
    select 'job-' || o_orderkey as job_id, o_orderstatus = 'F' as model_file,
           case when o_orderstatus = 'F' or r = 3 then 'completed' when r = 2 then 'training'
                when r = 1 then 'ingested' else 'queued' end as status
    from orders left join a on l_orderkey = o_orderkey
    """
)
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of all jobs from model rows and artifacts, one aggregate and one join."""
    return listing.job_status(_jobs(spark, sf_dir), _models(spark, sf_dir), _artifacts(spark, sf_dir))


@query(
    """
    select 'p' || o_orderkey as predict_id,
           case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
                then 'ready' else 'pending' end as status
    from orders
    """
)
def predict_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready once the output is there."""
    requests = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), "o_orderkey").alias("predict_id"))
    lines = table(spark, sf_dir, "lineitem")
    output = F.concat(F.lit("predictions_output/p"), "l_orderkey", F.lit(".csv"))
    other = F.concat(F.lit("uploads/p"), "l_orderkey", F.lit("/in.csv"))
    artifacts = lines.select(F.when(F.col("l_returnflag") == "R", output).otherwise(other).alias("path"))
    return listing.predict_status(requests, artifacts)


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a target table, and order rows as its source.

    The source repeats keys: a customer with many orders arrives many times. Open
    orders come under the negative key, which no customer has.
    """
    target = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("old").alias("status"),
        F.col("c_mktsegment").alias("target_column"),
    )
    source = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "O", -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("key"),
        F.concat(F.lit("order "), "o_orderkey").alias("name"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("target_column"),
        F.col("o_orderkey").alias("at"),
    )
    return target, source


_MERGE_SQL = """
    with t as (select c_custkey as key, c_name as name, 'old' as status, c_mktsegment as target_column
               from customer),
    o as (select *, case when o_orderstatus = 'O' then -o_custkey else o_custkey end as k from orders),
    s as (select k as key, 'order ' || o_orderkey as name, o_orderstatus as status,
                 case when o_orderstatus <> 'P' then o_orderpriority end as target_column,
                 row_number() over (partition by k order by o_orderkey) as first,
                 row_number() over (partition by k order by o_orderkey desc) as last
          from o)
"""


@query(
    _MERGE_SQL
    + """
    select * from t
    union all
    select key, name, status, target_column from s where first = 1 and key not in (select key from t)
    """
)
def merge_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, keep what exists; read back from the next version of the table."""
    target, source = _customers(spark, sf_dir)
    root = new_folder(spark, "customers")
    write_table(target, root)
    write_table(merge.merge_keep_first(read_table(spark, root), source, "key", ["at"]).drop("at"), root)
    return read_table(spark, root)


@query(
    _MERGE_SQL
    + """
    select coalesce(t.key, f.key) as key, coalesce(t.name, f.name) as name,
           coalesce(l.status, t.status) as status,
           case when l.key is not null then l.target_column else t.target_column end as target_column
    from t full join (select * from s where first = 1) f on t.key = f.key
           left join (select * from s where last = 1) l on l.key = f.key
    """
)
def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, or update two columns on a clash, nulls included."""
    target, source = _customers(spark, sf_dir)
    return merge.merge_update(target, source, "key", ["status", "target_column"], ["at"]).drop("at")


@query(
    """
    select 'job-' || o_orderkey as job_id,
           case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')
                then 'completed' else 'queued' end as status
    from orders
    """
)
def mark_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: set the status of the finished keys; a key may be reported many times."""
    done = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "A").select(_job("l_orderkey").alias("job_id"))
    got = merge.update_where_key(_jobs(spark, sf_dir), done, "job_id", {"status": F.lit("completed")})
    return got.select("job_id", "status")


@query("select c_custkey, c_name, null::varchar as target_column, null::varchar as user_id from customer")
def add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: new columns are null in old rows; a column that is there stays."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.with_columns_if_absent(old, {"target_column": "string", "user_id": "string", "C_NAME": "string"})


@query(
    """
    with m as (select 'cust-' || o_custkey as job_id, round(sum(o_totalprice), 2) as total, count(*) as n from orders group by 1)
    select job_id, 'total' as metric_name, total as metric_value from m
    union all select job_id, 'n_samples', n::double from m
    """
)
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: metrics in long form, appended and read back."""
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n_samples")
    )
    catalog = Catalog(spark, new_folder(spark, "catalog"))
    named = wide.withColumn("job_id", F.concat(F.lit("cust-"), "o_custkey"))
    catalog.add_metrics(metrics.to_long(named, ["total", "n_samples"]))
    return catalog.read("metrics").select("job_id", "metric_name", "metric_value")


@query(
    """
    with m as (select 'job-' || o_orderkey as job_id, case o_orderstatus when 'F' then 'completed' else 'queued' end as status,
                      o_orderpriority as user_id, o_orderstatus = 'F' as has_model from orders)
    select user_id, status, count(*) as n_jobs, count(*) filter (has_model) as n_models from m group by 1, 2
    """
)
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and models through the catalog, sent twice, read back."""
    catalog = Catalog(spark, new_folder(spark, "catalog"))
    jobs, done = _jobs(spark, sf_dir), _models(spark, sf_dir)
    catalog.add_jobs(jobs)
    catalog.add_jobs(jobs)
    catalog.add_models(done)
    catalog.add_models(done)
    catalog.complete(done.select("job_id"))
    have = catalog.read("models").select("job_id", F.lit(1).alias("m"))
    return (
        catalog.read("jobs")
        .join(have, "job_id", "left")
        .groupBy("user_id", "status")
        .agg(F.count("*").alias("n_jobs"), F.count("m").alias("n_models"))
    )


@query(
    """
    select 'job-' || o_orderkey as model_id, '/models/job-' || o_orderkey || '.pkl.spark' as spark_path,
           case when o_orderpriority = '2-HIGH' then 'sqft,age' end as feature_cols, 'regression' as task_type,
           case when o_orderpriority = '1-URGENT' then 'price' else 'label' end as target_column
    from orders where o_orderstatus = 'F' and o_orderpriority < '3'
    """
)
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged by model id; models trained again replace their row."""
    root = new_folder(spark, "registry")
    rows = _registry(spark, sf_dir)
    reg.save_rows(rows, root)
    again = rows.filter(F.col("feature_cols").isNull()).withColumn("target_column", F.lit("price"))
    reg.save_rows(again, root)
    return reg.read_registry(spark, root).select(
        "model_id", "spark_path", F.array_join("feature_cols", ",").alias("feature_cols"), "task_type", "target_column"
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upload requests; a user sends many."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        F.when(kind != "view", F.concat(kind, F.lit(" model"))).alias("model_name"),
        F.concat(F.lit("/data/"), "event_id", F.lit(".csv")).alias("csv_path"),
        F.lit("data.csv").alias("filename"),
        kind.alias("task_type"),
        text.iso_time("ts").alias("timestamp"),
    )


@query(
    """
    select user_id::varchar as job_id, case when event_type <> 'view' then event_type || ' model' end as model_name,
           '/data/' || event_id || '.csv' as csv_path, null::varchar as target_column,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at
    from events
    """
)
def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written and read by schema; absent fields are null."""
    out = new_folder(spark, "messages")
    msg.write_messages(_requests(spark, sf_dir), "upload_request", out)
    back = msg.read_messages(spark, "upload_request", out, one_object_per_file=False)
    at = F.date_format(text.parse_time("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return back.select("job_id", "model_name", "csv_path", "target_column", at.alias("at"))


@query(
    """
    select user_id::varchar as job_id, '/data/' || event_id || '.csv' as csv_path
    from (select *, row_number() over (partition by user_id order by ts desc) as rn from events) where rn = 1
    """
)
def messages_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest message per job; copies fold before the shuffle."""
    out = new_folder(spark, "messages")
    msg.write_messages(_requests(spark, sf_dir), "upload_request", out)
    back = msg.read_messages(spark, "upload_request", out, one_object_per_file=False)
    return msg.latest_per_key(back).select("job_id", "csv_path")


def _predict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scoring requests; the status names the model, ``P`` has none."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("predict_id"),
        F.concat(F.lit("m-"), F.col("o_orderstatus"), F.lit(".pkl.spark")).alias("model_id"),
        F.when(F.col("o_orderstatus") == "P", "Regression").otherwise("classification").alias("model_type"),
    )


def _status_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mean model per order status, as registry rows with their constant."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P")
    return orders.groupBy(F.concat(F.lit("m-"), F.col("o_orderstatus")).alias("model_id")).agg(
        F.lit("regression").alias("task_type"),
        metrics.mean_label("o_totalprice").alias("prediction"),
        F.lit("spark_mllib").alias("model_type"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


@query(
    """
    select o_orderkey as predict_id, 'm-' || o_orderstatus as model_id, 'regression' as task_type,
           case when o_orderstatus = 'P' then 'No model found for ID m-P' end as error
    from orders
    """
)
def match_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with its model, or with an error."""
    got = scoring.match_models(_predict_requests(spark, sf_dir), _status_models(spark, sf_dir))
    return got.select("predict_id", "model_id", "task_type", "error")


def _scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all matched requests (their order's lines), scored in one go."""
    models = _status_models(spark, sf_dir)
    matched = scoring.match_models(_predict_requests(spark, sf_dir), models).filter(F.col("error").isNull())
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("predict_id"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"),
    )
    tagged = join_hot(rows, matched.select("predict_id", "model_id"), "predict_id")
    return scoring.score_constants(tagged, models.select("model_id", "prediction"))


@query(
    """
    with m as (select o_orderstatus as s, avg(o_totalprice) as p from orders where o_orderstatus <> 'P' group by 1)
    select o_orderkey as predict_id, count(*) as n_rows, least(count(*), 5) as n_samples,
           round(any_value(p), 3) as prediction
    from lineitem join orders on l_orderkey = o_orderkey join m on s = o_orderstatus
    group by 1
    """
)
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request scored at once, one summary per request."""
    scored = _scored_requests(spark, sf_dir)
    got = scoring.summarise(scored, ["line", "part", "quantity"], extra=[F.round(F.max("prediction"), 3).alias("prediction")])
    return got.select("predict_id", "n_rows", F.size("sample_predictions").cast("long").alias("n_samples"), "prediction")


@query(
    """
    select predict_id, line, part, quantity, sample_no from (
      select o_orderkey as predict_id, l_linenumber::bigint as line, l_partkey as part, l_quantity as quantity,
             row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_quantity) as sample_no
      from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P')
    where sample_no <= 5
    """
)
def sample_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each request."""
    got = scoring.sample_rows(_scored_requests(spark, sf_dir), ["predict_id"], ["line", "part", "quantity"])
    return got.select("predict_id", "line", "part", "quantity", F.col("sample_no").cast("long").alias("sample_no"))
