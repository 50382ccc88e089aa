"""Registered queries: scans, cleaning, profiles, validation, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions import feature_lists as fl
from trellium.functions import text
from trellium.operators import clean as cleaning
from trellium.operators import profile, validate
from trellium.plans.book import query, table
from trellium.sources import csv as files
from trellium.sources.folders import new_folder


@query(
    """
    with f as (
      select case when event_type <> 'signup' then user_id end as id, event_id, event_type,
             case when event_type <> 'error' then value end as label
      from events)
    select id, event_id, event_type, label
    from (select *, row_number() over (partition by id order by event_id) as rn
          from f where label is not null)
    where rn = 1
    """
)
def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy names, null targets, repeated and null ids."""
    raw = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias(" ID "),
        F.col("event_id").alias("Event_Id"),
        F.col("event_type").alias("EVENT_TYPE"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("Label"),
    )
    out = new_folder(spark, "clean")
    files.write_parquet(cleaning.clean(raw, "Label", ["event_id"]), out)
    return files.read_parquet(spark, out)


@query(
    """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority
    from orders
    """
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, read back with inferred types."""
    out = new_folder(spark, "orders-csv")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    files.write_csv(orders, out)
    back = files.read_training_csv(spark, out)
    kinds = dict(back.dtypes)
    if kinds["o_totalprice"] != "double" or kinds["o_orderdate"] != "date":
        raise AssertionError(f"types not inferred: {kinds}")
    return back.withColumns(
        {
            "o_orderkey": F.col("o_orderkey").cast("long"),
            "o_custkey": F.col("o_custkey").cast("long"),
            "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        }
    )


@query(
    """
    select l_orderkey, l_linenumber::bigint as l_linenumber, l_extendedprice,
           case when l_returnflag <> 'R' then l_quantity end as l_quantity,
           l_discount, (l_returnflag = 'R')::int::bigint as cast_failures
    from lineitem
    """
)
def csv_scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded names, types of the model, values that do not fit counted."""
    out = new_folder(spark, "lineitem-csv")
    lineitem = table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("L_Discount"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_quantity").cast("string")).alias("L_QUANTITY"),
        F.col("l_extendedprice"),
        F.col("l_linenumber"),
        F.col("l_orderkey").alias("L_OrderKey"),
    )
    files.write_csv(lineitem, out)
    types = {
        "l_orderkey": "bigint",
        "l_linenumber": "bigint",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
    }
    back = files.read_scoring_csv(spark, out, types)
    return back.withColumn("cast_failures", F.col("cast_failures").cast("long"))


def _order_files(spark: SparkSession, sf_dir: str, header: bool = True) -> str:
    """Orders as CSV, one folder of part files per status, rows in key order."""
    out = new_folder(spark, "orders-by-status")
    orders = (
        table(spark, sf_dir, "orders")
        .withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .repartitionByRange("o_orderstatus", "o_orderkey")
        .sortWithinPartitions("o_orderstatus", "o_orderkey")
    )
    files.write_csv(orders, out, header=header, partition_by=["o_orderstatus"])
    return out


def _status_of(dataset: str = "dataset"):
    return F.regexp_extract(dataset, r"o_orderstatus=([^/]+)", 1)


@query(
    """
    select o_orderstatus as dataset, count(*) as row_count, 5::bigint as column_count,
           'o_orderkey,o_custkey,o_totalprice,o_orderdate,o_orderpriority' as columns,
           true as has_header, 9::bigint as n_preview
    from orders group by o_orderstatus
    """
)
def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 A3 A4: counts, header and header vote of many files at once."""
    found = profile.profile_files(spark, _order_files(spark, sf_dir), "folder", headers_in_parts=True)
    return found.select(
        _status_of().alias("dataset"),
        "row_count",
        "column_count",
        F.array_join("columns", ",").alias("columns"),
        "has_header",
        F.size("preview").cast("long").alias("n_preview"),
    )


@query(
    """
    select o_orderstatus as dataset, rn - 1 as row_no, o_orderkey::varchar as order_key,
           strftime(o_orderdate, '%Y-%m-%d') as order_date, o_orderpriority as priority
    from (select *, row_number() over (partition by o_orderstatus order by o_orderkey) as rn from orders)
    where rn <= 9
    """
)
def profile_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the first rows of every data set, cut down before the shuffle."""
    found = profile.profile_files(spark, _order_files(spark, sf_dir), "folder", headers_in_parts=True)
    rows = found.select(_status_of().alias("dataset"), F.posexplode("preview").alias("row_no", "cells"))
    return rows.select(
        "dataset",
        F.col("row_no").cast("long").alias("row_no"),
        F.col("cells")[0].alias("order_key"),
        F.col("cells")[3].alias("order_date"),
        F.col("cells")[4].alias("priority"),
    )


@query(
    """
    select o_orderstatus as dataset, true as written_with, true as has_header from orders group by all
    union all
    select o_orderstatus, false, false from orders group by all
    """
)
def header_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the vote on files with a header and on the same files without."""
    parts = []
    for header in (True, False):
        lines = profile.read_lines(spark, _order_files(spark, sf_dir, header))
        heads = profile.first_records(lines, profile.VOTE_ROWS + 1, "folder", headers_in_parts=header)
        votes = profile.header_votes(heads)
        parts.append(votes.select(_status_of().alias("dataset"), F.lit(header).alias("written_with"), "has_header"))
    return parts[0].unionByName(parts[1])


@query(
    """
    select lang as dataset, count(*) as row_count,
           sum(1 + length(text) - length(replace(text, chr(10), '')))::bigint as n_body_lines,
           3::bigint as column_count
    from documents group by lang
    """
)
def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: records and lines of texts with quoted line breaks, counted without reading a file in one task."""
    out = new_folder(spark, "documents-csv")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "lang")
    files.write_csv(documents, out, partition_by=["lang"])
    records = profile.profile_records(spark, out, "folder", headers_in_parts=True)
    return records.select(
        F.regexp_extract("dataset", r"lang=([^/]+)", 1).alias("dataset"),
        "row_count",
        (F.col("n_lines") - F.col("n_files")).alias("n_body_lines"),
        "column_count",
    )


def _job_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a job: its table's columns, target and its model's list."""
    status = F.col("o_orderstatus")
    names = F.array(*[F.lit(c) for c in ("id", "label", "price", "target", "prediction", "qty")])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.array_remove(names, "qty")).otherwise(names).alias("columns"),
        F.when(status == "F", "label").when(status == "O", "price").alias("target"),
        F.when(F.col("o_orderpriority") < "3", F.array(F.lit("PRICE"), F.lit("Qty"))).when(
            F.col("o_orderpriority") == "5-LOW", F.array(F.lit("qty"), F.lit("price"))
        ).alias("configured"),
    )


@query(
    """
    with j as (
      select o_orderkey as job,
             case when o_orderpriority = '5-LOW' then ['id','label','price','target','prediction']
                  else ['id','label','price','target','prediction','qty'] end as columns,
             case o_orderstatus when 'F' then 'label' when 'O' then 'price' end as target,
             case when o_orderpriority < '3' then ['price','qty']
                  when o_orderpriority = '5-LOW' then ['qty','price'] end as configured
      from orders)
    select job,
      array_to_string(list_filter(columns, lambda c: c not in ('id','prediction') and c <> coalesce(target, 'label')), ',') as training,
      array_to_string(list_filter(columns, lambda c: c not in ('id','prediction','label','target')), ',') as reported,
      array_to_string(case when configured is not null then configured
        when target is not null then list_filter(columns, lambda c: c not in ('id','prediction') and c <> target)
        else list_filter(columns, lambda c: c not in ('id','prediction','label','target')) end, ',') as scoring,
      array_to_string(case when configured is not null
        then list_filter(configured, lambda c: not list_contains(columns, c)) else [] end, ',') as missing,
      case when target is null then 'prediction' else target || '_predicted' end as prediction_column
    from j
    """
)
def feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 P3 P4 P7 for all jobs at once."""
    jobs = _job_columns(spark, sf_dir)
    columns, target, configured = F.col("columns"), F.col("target"), F.col("configured")
    lists = {
        "training": fl.training_features_expr(columns, F.coalesce(target, F.lit("label"))),
        "reported": fl.reported_features_expr(columns),
        "scoring": fl.scoring_features_expr(columns, configured, target),
        "missing": fl.missing_features_expr(columns, configured),
    }
    return jobs.select(
        "job",
        *[F.array_join(v, ",").alias(k) for k, v in lists.items()],
        fl.prediction_name_expr(columns, target).alias("prediction_column"),
    )


@query(
    """
    select event_id,
      case when event_type = 'view' then 'regression'
           when event_type = 'error' and value > 10 then 'regression'
           else 'classification' end as task_type
    from events
    """
)
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first non-empty candidate, folded, unknown means classification."""
    kind = F.col("event_type")
    override = F.when(kind == "view", "Regression").when(kind == "click", "").when(kind == "signup", "clustering")
    fallback = F.when(kind == "click", "CLASSIFICATION").when((kind == "error") & (F.col("value") > 10), "REGRESSION")
    return table(spark, sf_dir, "events").select("event_id", text.task_type(override, fallback).alias("task_type"))


@query(
    """
    with r as (
      select o_orderkey as job,
        case o_orderpriority when '1-URGENT' then 'Data.CSV' when '5-LOW' then 'data.txt' else 'data.csv' end as filename,
        case o_orderstatus when 'F' then ['id','price'] when 'O' then ['price'] else ['id','qty'] end as cols,
        case when o_orderpriority = '2-HIGH' then '' when o_orderpriority = '3-MEDIUM' then 'price' else 'qty' end as target,
        o_totalprice > 400000 as no_header
      from orders)
    select job,
      case when filename = 'data.txt' then 'Only .csv files are supported.'
           when no_header then 'CSV header row is missing or could not be parsed.'
           when target = '' then 'Missing target column.'
           when not list_contains(cols, target) then 'Target column ''' || target || ''' was not found in the CSV header.'
           when len(cols) = 1 then 'CSV must contain at least one feature column besides the target column.'
           else 'accepted' end as verdict,
      case when filename = 'Data.CSV' then 'Data' when filename = 'data.txt' then 'data.txt' else 'my model' end as model_name,
      case when filename = 'Data.CSV' then 'regression' else 'classification' end as task_type
    from r
    """
)
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request accepted, or rejected with its first reason."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    header = (
        F.when(F.col("o_totalprice") > 400000, F.array().cast("array<string>"))
        .when(status == "F", F.array(F.lit("id"), F.lit("price")))
        .when(status == "O", F.array(F.lit("price")))
        .otherwise(F.array(F.lit("id"), F.lit("qty")))
    )
    name = F.when(priority == "1-URGENT", "Data.CSV").when(priority == "5-LOW", "data.txt").otherwise("data.csv")
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job"),
        name.alias("filename"),
        F.when(name == "data.csv", "  my model ").otherwise(" ").alias("model_name"),
        F.when(priority == "2-HIGH", "  ").when(priority == "3-MEDIUM", " price").otherwise("qty ").alias("target_column"),
        F.when(priority == "1-URGENT", "Regression").otherwise("other").alias("task_type"),
        header.alias("columns"),
    )
    checked = validate.with_verdict(requests)
    return checked.select("job", F.coalesce("reason", F.lit("accepted")).alias("verdict"), "model_name", "task_type")


@query(
    """
    select event_id,
      event_type || ' file.csv' as file_name,
      'uploads/' || user_id || '/' || event_type || ' file.csv' as upload_key,
      event_type || '-' || user_id as model_id,
      'uploads' as kind, user_id::varchar as owner,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at,
      strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as parsed,
      case when event_type = 'error' then sha256(event_id::varchar || chr(1) || user_id::varchar)
           else 'job-' || event_id end as job_id
    from events
    """
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on paths, ids and times."""
    path = F.concat(F.lit("/data/uploads/"), F.col("event_id") + 1700000000000, F.lit("_"), F.col("event_type"), F.lit(" file.csv"))
    events = table(spark, sf_dir, "events").withColumn("path", path)
    name = text.strip_upload_prefix(text.base_name("path"))
    key = text.artifact_key("uploads", F.col("user_id").cast("string"), name)
    model = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    given = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("job-"), F.col("event_id")))
    at = text.iso_time("ts")
    return events.select(
        "event_id",
        name.alias("file_name"),
        key.alias("upload_key"),
        text.bare_model_id(F.concat(model, F.lit(".pkl.spark"))).alias("model_id"),
        text.artifact_kind(key).alias("kind"),
        text.artifact_id(key).alias("owner"),
        at.alias("at"),
        F.date_format(text.parse_time(at), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"),
        text.job_id_or_new(given, "event_id", "user_id").alias("job_id"),
    )
