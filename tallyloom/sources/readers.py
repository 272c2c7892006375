"""Sources: record runs, splits, logs, tables in Markdown, caches, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import domains, text
from ..operators.longform import first_of

RECORD = ", ".join(
    ["admission_reason_tags: array<string>", "dominant_admission_reason: string", "primary_diagnosis_text: string", *[f"{f}: string" for f in (*domains.TRISTATE_FIELDS, *domains.ENUMS)], "new_meds_started_count: int", "meds_stopped_count: int", "reasoning: string"]
)
RUN = f"hadm_id long, parse_ok boolean, features_json struct<{RECORD}>, parse_error string, input_tokens int, output_tokens int, latency_seconds double"


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel ranges of a key where its bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def discover(columns: DataFrame, wanted: dict[str, tuple[list[str], list[str]]], prefix: str = "mimic") -> DataFrame:
    """(table_schema, table_name, column_name) -> where each logical table is.

    wanted: logical name -> (candidate tables in order, required columns). Preferred: earlier candidate, then schemas that
    begin with the prefix, then schema name.
    """
    spark = columns.sparkSession
    rows = [(k, t, i, c) for k, (tables, _) in wanted.items() for i, t in enumerate(tables) for c in [sorted(wanted[k][1])]]
    w = spark.createDataFrame(rows, "logical string, table_name string, place int, needed array<string>")
    have = columns.groupBy("table_schema", "table_name").agg(F.collect_set("column_name").alias("have"))
    t = have.join(F.broadcast(w), "table_name").where(F.size(F.array_except("needed", "have")) == 0)
    return first_of(t, "logical", [F.asc("place"), F.when(F.col("table_schema").startswith(prefix), 0).otherwise(1), F.asc("table_schema")]).select("logical", "table_schema", "table_name")


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def jsonl_run(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a run with file and position, so that "last" has a meaning; unreadable lines are left out."""
    t = spark.read.schema(RUN + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # positions order lines within a file's partitions; files are ordered by name
    return t.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where("_corrupt_record is null and hadm_id is not null").drop("_corrupt_record")


def last_ok(run: DataFrame) -> DataFrame:
    """Parsed records, the last line of each document."""
    t = run.where("parse_ok and features_json is not null")
    return first_of(t, "hadm_id", [F.desc("file"), F.desc("block"), F.desc("line")])


def flat(run: DataFrame, variant: str) -> DataFrame:
    """Features as columns, with the variant."""
    return last_ok(run).select(F.col("hadm_id").cast("long").alias("hadm_id"), "features_json.*").withColumn("variant", F.lit(variant))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file a document; metadata and unreadable files are left out."""
    t = spark.read.schema("hadm_id long, run_id string, variant string, processed_at_utc string, raw_response string, features_json string, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return t.where(~F.col("_metadata.file_name").isin("run_metadata.json")).where("_corrupt_record is null and hadm_id is not null").drop("_corrupt_record")


def split_ids(spark: SparkSession, path: str, column: str = "hadm_id") -> DataFrame:
    t = spark.read.option("header", True).csv(path)
    return t.select(F.col(column).try_cast("long").alias(column)).where(f"{column} is not null").distinct()


def markdown_table(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """The first table under a heading (a short document): one array of cells a row, numbers without ` % and ,."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("l"))
    after = F.slice("l", F.array_position(F.transform("l", lambda x: F.trim(x) == heading), F.lit(True)).cast("int") + 1, 1 << 20)
    t = lines.where(F.array_contains(F.transform("l", lambda x: F.trim(x)), heading)).select(F.posexplode(after).alias("at", "line"))
    t = t.withColumn("is_row", F.trim("line").startswith("|"))
    w = Window.orderBy("at")  # the lines of one short document
    t = t.withColumn("gaps", F.sum((F.col("is_row") & ~F.lag("is_row", 1, False).over(w)).cast("int")).over(w))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x))
    return t.where("is_row and gaps = 1 and not line rlike '^[ |:-]+$'").select("at", cells.alias("cells"))


def first_number(cell):
    return F.regexp_extract(F.regexp_replace(cell, "[`%,]", ""), "-?[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")


def log_hours(spark: SparkSession, path: str) -> DataFrame:
    """Hours between the first and last timestamp of log files."""
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract("value", "^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}),", 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    t = spark.read.text(path).select(stamp.alias("ts")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return t.withColumn("hours", (F.col("last").cast("double") - F.col("first").cast("double")) / 3600)


def cost_state(spark: SparkSession, path: str) -> DataFrame:
    """The last event of each run."""
    t = spark.read.schema("ts string, event string, run_id string, total_input_tokens long, total_output_tokens long, total_cost_usd double, n_calls long").json(path)
    return t.groupBy("run_id").agg(F.max_by(F.struct("ts", "total_input_tokens", "total_output_tokens", "total_cost_usd", "n_calls"), F.struct("ts", "n_calls")).alias("x")).select("run_id", "x.*")


def cached(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(texts with their cached vectors, distinct texts that are missing), by model and text."""
    t = texts.withColumn("cache_key", text.cache_key(F.lit(model), F.col("text")))
    return t.join(cache, "cache_key", "left"), t.join(cache, "cache_key", "left_anti").select("cache_key", "text").dropDuplicates(["cache_key"])


def pending(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: ids without an output, in order."""
    return ids.join(done.select(key).distinct(), key, "left_anti").orderBy(key)


def still_failed(failed: DataFrame, retried_ok: DataFrame, key: str) -> DataFrame:
    return failed.join(retried_ok.select(key).distinct(), key, "left_anti")


PATTERN_FILE = "path string, field_name string, target_value string, regex_patterns array<string>, compound_patterns array<struct<all_of: array<string>, window_chars: int, description: string>>, error string"


def pattern_errors(payload) -> list[str]:
    """All that is wrong with what a pattern file holds."""
    if not isinstance(payload, dict):
        return ["not a mapping"]
    out = [f"missing {k}" for k in ("field_name", "regex_patterns", "target_value") if k not in payload]
    patterns = payload.get("regex_patterns", [])
    if not isinstance(patterns, list):
        out.append("regex_patterns is not a list")
    elif any(not isinstance(p, str) for p in patterns):
        out.append("regex_patterns holds more than strings")
    compounds = payload.get("compound_patterns") or []
    if not isinstance(compounds, list):
        return [*out, "compound_patterns is not a list"]
    for i, c in enumerate(compounds):
        at = f"compound_patterns[{i}]"
        if not isinstance(c, dict):
            out.append(f"{at} is not a mapping")
            continue
        out += [f"{at} missing {k}" for k in ("all_of", "window_chars") if k not in c]
        if "all_of" in c and (not isinstance(c["all_of"], list) or not c["all_of"] or any(not isinstance(x, str) for x in c["all_of"])):
            out.append(f"{at}.all_of is not a list of strings")
        if "window_chars" in c and (not isinstance(c["window_chars"], int) or isinstance(c["window_chars"], bool)):
            out.append(f"{at}.window_chars is not a whole number")
        if c.get("description") is not None and not isinstance(c["description"], str):
            out.append(f"{at}.description is not a string")
    return out


def pattern_files(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern files (YAML) of a folder and of those in it: a row for each good file, and one for each error of a bad one.

    Spark lists and reads the files, so they may be in any store; each is parsed where it is read.
    """

    def parse(batches):
        import pyarrow as pa
        import yaml

        for batch in batches:
            rows = []
            for path, value in zip(batch["path"].to_pylist(), batch["value"].to_pylist(), strict=True):
                try:
                    payload = yaml.safe_load(value)
                    errors = pattern_errors(payload)
                except yaml.YAMLError as e:
                    errors = [f"not YAML: {getattr(e, 'problem', None) or 'unreadable'}"]
                if errors:
                    rows += [{"path": path, "error": e} for e in errors]
                    continue
                compounds = [{"all_of": c["all_of"], "window_chars": c["window_chars"], "description": c.get("description")} for c in payload.get("compound_patterns") or []]
                rows.append({"path": path, "field_name": str(payload["field_name"]), "target_value": str(payload["target_value"]), "regex_patterns": payload["regex_patterns"], "compound_patterns": compounds, "error": None})
            compound = pa.struct([("all_of", pa.list_(pa.string())), ("window_chars", pa.int32()), ("description", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*((c, pa.string()) for c in ("path", "field_name", "target_value")), ("regex_patterns", pa.list_(pa.string())), ("compound_patterns", pa.list_(compound)), ("error", pa.string())]))

    t = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml,txt}")
    return t.select(F.input_file_name().alias("path"), "value").mapInArrow(parse, PATTERN_FILE)
