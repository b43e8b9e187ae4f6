"""End-to-end batch job: configs + feed files (+ SKU maps) -> outputs.

    result = run_job(spark, config_path, feeds, out_dir, run_id=..., now=...)

* ``config_path``: tenant config documents (JSON lines, one per tenant).
* ``feeds``: DataFrame (tenant_id, vendor_id, path) of received files
  (e.g. ``latest_inbound`` over a listing), optionally ``sku_maps`` the same
  for map files.

Files are grouped by (delimiter, charset) -- one positional scan per group,
all tenants together.  The bytes of UTF-8 files are checked; a file with
invalid ones fails its tenant (DECODE_ERROR), not the job.  ``run_batch`` takes
run requests, config versions and a listing instead of ready paths.  Outputs
below ``<artifact>/run_id=<id>/tenant_id=<id>``: normalised feeds per vendor,
the merged feed (succeeded tenants only), errors, summary, config snapshot,
input manifest and status events.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmerge.functions.text import basename
from feedmerge.operators import ledger
from feedmerge.operators.normalize import header_position
from feedmerge.plans.batch import RunInputs, RunResult, engine
from feedmerge.schema import STAGES
from feedmerge.session import configure, materialize, scratch_path
from feedmerge.sinks.csv import write_feed
from feedmerge.sinks.reports import write_error_report
from feedmerge.sources import config as cfg
from feedmerge.sources import copies
from feedmerge.sources import feeds as src
from feedmerge.sources import listing as lst


@dataclass
class JobOutput:
    result: RunResult
    gates: list  # collected gate rows (one per tenant)
    events: DataFrame  # status events for the run ledger


def _scan_groups(spark: SparkSession, received: DataFrame):
    received = received.withColumn("charset", src.charset(F.col("encoding")))
    unsupported = received.where("charset is null").select(
        "tenant_id", "vendor_id",
        F.concat(F.lit("unsupported encoding '"), "encoding", F.lit("' for vendor "), "vendor_id").alias("error_message"))
    groups = received.where("charset is not null").select("delimiter", "charset").distinct().collect()  # a few layouts
    files_parts, rows_parts, decode_parts = [], [], [unsupported]
    for g in groups:
        sel = received.where((F.col("delimiter") == g.delimiter) & (F.col("charset") == g.charset))
        paths = [r.path for r in sel.select("path").distinct().collect()]  # file names only
        files, rows = src.scan_feeds(spark, paths, delimiter=g.delimiter, encoding=g.charset)
        if g.charset == "UTF-8":
            bad = src.decode_failures(spark, paths)
            decode_parts.append(
                bad.join(sel.select(F.col("path").alias("source_file"), "tenant_id", "vendor_id"),
                         "source_file").select("tenant_id", "vendor_id",
                                               F.lit("invalid utf-8 bytes").alias("error_message")))
        files_parts.append(files)
        rows_parts.append(rows)
    def union(parts):
        return reduce(DataFrame.unionByName, parts) if parts else None
    return union(files_parts), union(rows_parts), union(decode_parts)


def _qualified(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Paths as the scans report them (``file:`` URIs for local files)."""
    return paths.withColumn("path", F.when(F.col("path").contains(":"), F.col("path"))
                            .otherwise(F.concat(F.lit("file:"), F.col("path"))))


def read_sku_maps(spark: SparkSession, maps: DataFrame, vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map files (header ``vendor_sku,sku``) -> raw map rows in file order, and
    (tenant_id, vendor_id, error_message) of those that cannot be decoded.  A
    map is in its vendor's encoding; files of one encoding share a scan."""
    maps = _qualified(spark, maps).join(vendors.select("tenant_id", "vendor_id", "encoding"), ["tenant_id", "vendor_id"])
    files, rows, broken = _scan_groups(spark, maps.withColumn("delimiter", F.lit(",")))
    if files is None:
        return spark.createDataFrame([], "tenant_id string, vendor_id string, vendor_sku string, sku string, "
                                         "row_number bigint"), broken
    ident = maps.select(F.col("path").alias("source_file"), "tenant_id", "vendor_id")

    def pos(name):
        return header_position(F.lit(name))  # last column of that name wins
    j = rows.join(files, "source_file").join(ident, "source_file")
    mapped = j.select("tenant_id", "vendor_id",
                      F.when(pos("vendor_sku") > 0, F.try_element_at("values", pos("vendor_sku").cast("int")))
                      .alias("vendor_sku"),
                      F.when(pos("sku") > 0, F.try_element_at("values", pos("sku").cast("int"))).alias("sku"),
                      "row_number")
    return mapped, broken


def _single_documents(configs: DataFrame) -> DataFrame:
    """The configs, refused if a tenant has two: which one holds is the
    caller's choice (see ``run_batch``), never a join's."""
    twice = configs.groupBy("tenant_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError("more than one config document for " + ", ".join(str(r["tenant_id"]) for r in twice)
                         + ": pass one each, or config versions and runs to run_batch")
    return configs


def _write_rows(df: DataFrame, path: str, *by: str) -> None:
    """JSON rows; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def _execute(spark: SparkSession, configs: DataFrame, runs: DataFrame, feeds: DataFrame, out_dir: str, now: str,
             sku_maps: DataFrame | None, one_file_per_tenant: bool) -> JobOutput:
    """Engine and outputs of one run for each tenant of ``configs``.

    ``runs``: tenant_id, run_id, config_version.  Every artifact lies below
    ``<artifact>/run_id=<id>/tenant_id=<id>/`` and only those folders are
    replaced, so a run never touches what another one wrote.
    """
    started = time.time()
    rules = cfg.rules_from_configs(configs)
    vendors = cfg.vendors_from_configs(configs)
    feeds = _qualified(spark, feeds)
    received = feeds.join(vendors.select("tenant_id", "vendor_id", "delimiter", "encoding"),
                          ["tenant_id", "vendor_id"])
    files, rows, decode = _scan_groups(spark, received)
    if files is None:
        files = spark.createDataFrame([], "source_file string, header array<string>, header_truncated boolean")
        rows = spark.createDataFrame([], "source_file string, row_number bigint, values array<string>")
    ident = received.select(F.col("path").alias("source_file"), "tenant_id", "vendor_id")
    decode = materialize(decode, "decode-errors")
    # a received file without a single line has no header: all columns are missing
    files = (ident.join(files, "source_file", "left")
             .withColumn("header", F.coalesce("header", F.array().cast("array<string>")))
             .join(decode.select("tenant_id", "vendor_id"), ["tenant_id", "vendor_id"], "left_anti"))
    map_rows, map_broken = read_sku_maps(spark, sku_maps, vendors) if sku_maps is not None else (None, None)
    inputs = RunInputs(rules=rules, vendors=vendors, files=files, rows=rows,
                       sku_maps=map_rows, decode_errors=decode,
                       map_decode_errors=materialize(map_broken, "map-decode-errors") if map_broken is not None else None,
                       schema_versions=configs.select("tenant_id", "schema_version"),
                       received=feeds.select("tenant_id", "vendor_id"),
                       maps_received=sku_maps.select("tenant_id", "vendor_id") if sku_maps is not None else None)
    result = engine(inputs, F.lit(now).cast("timestamp"))
    # read by the summary, the normalised feeds and the merge
    result = replace(result, vendor_counts=materialize(result.vendor_counts, "vendor-counts"))
    gates = materialize(result.gates.join(runs, "tenant_id"), "gates")
    gate_rows = gates.collect()  # one row per tenant
    parsed_s = time.time() - started

    base = out_dir.rstrip("/")
    tag = runs.select("tenant_id", "run_id")
    by_run = ("run_id", "tenant_id")
    ok = gates.where(F.col("status") == "SUCCEEDED").select(*by_run)
    write_feed(result.merged.join(ok, "tenant_id"), f"{base}/outputs/merged_inventory",
               rules.select("tenant_id", "output_columns").join(ok, "tenant_id"), partition_cols=by_run,
               one_file_per_partition=one_file_per_tenant)
    # normalised feeds: vendors with an input, of tenants that got past parsing
    past = gates.where("failed_stage is null or failed_stage not in ('FETCH_INPUTS', 'NORMALIZE')").select(*by_run)
    delivered = received.select("tenant_id", "vendor_id").distinct()
    layouts = delivered.join(past, "tenant_id").withColumn("output_columns", F.array().cast("array<string>"))
    write_feed(result.records.join(past, "tenant_id"), f"{base}/normalized", layouts,
               partition_cols=(*by_run, "vendor_id"), one_file_per_partition=one_file_per_tenant)
    write_error_report(result, f"{base}/reports/errors", gates)

    counts = result.vendor_counts.groupBy("tenant_id").agg(
        F.map_from_entries(F.collect_list(F.struct("vendor_id", "n_valid"))).alias("vendor_record_counts"))
    took = time.time() - started
    summary = (gates.join(counts, "tenant_id", "left")
               .withColumn("duration_seconds", F.lit(took))
               .withColumn("stage_times", F.create_map(F.lit("engine_seconds"), F.lit(parsed_s),
                                                       F.lit("output_seconds"), F.lit(took - parsed_s)))
               .withColumn("completed_at", F.lit(now)))
    _write_rows(summary, f"{base}/reports/run_summary", *by_run)
    snapshot = configs.select("tenant_id", F.to_json(F.struct(*configs.columns)).alias("config")).join(tag, "tenant_id")
    _write_rows(snapshot, f"{base}/reports/config_snapshot", *by_run)
    events = status_events(gates, now)
    _write_rows(events, f"{base}/events", *by_run)
    return JobOutput(result=result, gates=gate_rows, events=events)


def status_events(gates: DataFrame, now: str) -> DataFrame:
    """Ledger events of the runs (see ``ledger.fold_runs``): RUNNING at each
    stage that was reached, then the outcome."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    reached = F.transform(F.slice(stages, 1, F.col("stage_index") + 1), lambda s, i: F.struct(
        i.cast("bigint").alias("seq"), F.lit("RUNNING").alias("status"), s.alias("stage")))
    last = F.array(F.struct(F.lit(len(STAGES)).cast("bigint").alias("seq"), F.col("status").alias("status"),
                            F.col("stage").alias("stage")))
    e = gates.withColumn("e", F.explode(F.concat(reached, last)))
    final = F.col("e.seq") == len(STAGES)
    when_final = lambda c: F.when(final, F.col(c))
    return e.select("run_id", "tenant_id", "config_version", F.col("e.seq").alias("seq"),
                    F.col("e.status").alias("status"), F.col("e.stage").alias("stage"),
                    F.lit(now).cast("timestamp").alias("started_at"),
                    F.when(final, F.lit(now).cast("timestamp")).alias("finished_at"),
                    when_final("failed_stage").alias("failed_stage"), when_final("error_code").alias("error_code"),
                    when_final("error_message").alias("error_message"))


def run_job(spark: SparkSession, config_path: str, feeds: DataFrame, out_dir: str, *, run_id: str,
            now: str, sku_maps: DataFrame | None = None, one_file_per_tenant: bool = False) -> JobOutput:
    """One run (``run_id``) over ready file paths and one config per tenant."""
    configure(spark)
    configs = _single_documents(cfg.read_configs(spark, config_path))
    runs = configs.select("tenant_id", F.lit(run_id).alias("run_id"), F.lit(None).cast("bigint").alias("config_version"))
    return _execute(spark, configs, runs, feeds, out_dir, now, sku_maps, one_file_per_tenant)


def run_batch(spark: SparkSession, requests: DataFrame, versions: DataFrame, listing: DataFrame, out_dir: str, *,
              now: str, one_file_per_tenant: bool = False) -> JobOutput:
    """Run requests against their pinned configs and the inbound listing.

    * ``requests``: run_id, tenant_id, config_version (one active run a tenant);
    * ``versions``: tenant_id, config_version, config (JSON document), seq;
    * ``listing``: key, etag, size, last_modified (``listing.list_files``).

    The newest object of each vendor's prefix is its feed, the object of the
    configured key its SKU map; the input manifest, config snapshot and status
    events are written with the other artifacts.  Each feed is first copied byte
    by byte to ``runs/<run_copy_key>``; the manifest holds the copy's digest.  A run whose version does not
    exist gets a failure-form error report and a FAILED event.
    """
    configure(spark)
    pinned = materialize(ledger.pinned_config(requests, ledger.config_versions(versions)), "pinned-configs")
    found = pinned.where("config_found")
    documents = scratch_path(spark, "config-documents")
    # the run's tenant is the tenant, whatever the document says
    found.select("config").write.text(documents)
    configs = _single_documents(cfg.read_configs(spark, documents))
    runs = found.select("tenant_id", "run_id", "config_version")
    configs = materialize(configs.join(runs.select("tenant_id"), "tenant_id", "left_semi"), "configs")
    vendors = cfg.vendors_from_configs(configs)
    manifest = materialize(lst.input_manifest(listing, vendors), "manifest")
    feeds = manifest.where("status = 'found'").select("tenant_id", "vendor_id", F.col("s3_key").alias("path"))
    # the inbound copies that the manifest names, before anything is parsed
    base = out_dir.rstrip("/")
    by_run = ("run_id", "tenant_id")
    copy_key = F.when(F.col("s3_key").isNotNull(), F.concat_ws(
        "/", "run_id", F.lit("tenants"), "tenant_id", F.lit("inbound"), "vendor_id", basename(F.col("s3_key"))))
    tagged = manifest.join(runs.select("tenant_id", "run_id"), "tenant_id").withColumn("run_copy_key", copy_key)
    received = tagged.where("status = 'found'").select(F.col("s3_key").alias("path"), F.col("run_copy_key").alias("key"),
                                                       F.col("size").cast("bigint").alias("size"))
    copied = copies.copy_files(received.dropDuplicates(["key"]), f"{base}/runs")
    maps = vendors.where("has_sku_map").select("tenant_id", "vendor_id", F.col("sku_map_key").alias("path"))
    maps = maps.join(listing.select(F.col("key").alias("path")), "path").select("tenant_id", "vendor_id", "path")
    out = _execute(spark, configs, runs, feeds, out_dir, now, materialize(maps, "map-files"), one_file_per_tenant)

    _write_rows(tagged.join(copied.withColumnRenamed("key", "run_copy_key"), "run_copy_key", "left"),
                f"{base}/reports/input_manifest", *by_run)
    lost = pinned.where("not config_found")
    _write_rows(lost.select(*by_run, "error_code", F.lit("tenant config not found").alias("error_message")),
                f"{base}/reports/errors", *by_run)
    failed = lost.select(*by_run, "config_version", F.lit(len(STAGES)).cast("bigint").alias("seq"),
                         F.lit("FAILED").alias("status"), F.lit(STAGES[0]).alias("stage"),
                         F.lit(now).cast("timestamp").alias("started_at"), F.lit(now).cast("timestamp").alias("finished_at"),
                         F.lit(STAGES[0]).alias("failed_stage"), "error_code",
                         F.lit("tenant config not found").alias("error_message"))
    _write_rows(failed, f"{base}/events", *by_run)
    return replace(out, events=out.events.unionByName(failed))
