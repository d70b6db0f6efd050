"""Writers of reports, guarded exports and run records. Each writes datasets; none passes rows through the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import manual_check_status
from .report import domain_label_matrix, issue_rows, label_counts, result_view, top_domains

# The choices a run may record.
MODULES = ("S826", "SD816", "S390", "S350", "SXH890", "Other")
S390_CHOICES = ("SXB", "SXH", "SXC", "SXG", "SXP", "SXE", "SXBM")
NOTICE = "Results show bibliographic differences only. All but a sufficient match must be checked by a person before they are used."


def report_tables(results: DataFrame, view: str = "full", review: bool = False, debug: bool = False) -> dict[str, DataFrame]:
    """The tables of a report by name."""
    return {
        "summary": label_counts(results),
        "results": result_view(results, view, review, debug, export=True),
        "issues": result_view(issue_rows(results), view, review, debug, export=True),
        "top_domains": top_domains(results),
        "domains": domain_label_matrix(results),
    }


def write_report(results: DataFrame, path: str, file_format: str = "parquet", **view) -> None:
    """Each table as a dataset in a directory of its own under ``path``. Columns with spaces need a format that allows them."""
    for name, df in report_tables(results, **view).items():
        if file_format == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("map", "array", "struct")]
            df = df.withColumns({n: F.to_json(F.col(f"`{n}`")) for n in nested})
        df.write.mode("overwrite").format(file_format).option("header", "true").save(f"{path}/{name}")


def clean_identifier(value: str | None) -> str:
    """A code of up to 120 characters with a letter or digit and no control characters, or ""."""
    code = (value or "").strip()
    fits = len(code) <= 120 and any(ch.isalnum() for ch in code) and all(ord(ch) >= 32 for ch in code)
    return code if fits else ""


def guarded(results: DataFrame, identifier: str, acknowledged: bool) -> DataFrame:
    """Results with check status, identifier and notice; refused without a valid identifier and the acknowledgement."""
    code = clean_identifier(identifier)
    if not code or not acknowledged:
        raise ValueError("an export needs a file identifier and the acknowledgement")
    return results.withColumns({"Manual check status": manual_check_status(F.col("Validation Result")), "File identifier": F.lit(code), "Important notice": F.lit(NOTICE)})


def guarded_export(results: DataFrame, path: str, identifier: str, acknowledged: bool, file_format: str = "parquet") -> None:
    guarded(results, identifier, acknowledged).write.mode("overwrite").format(file_format).save(path)


def module_choice(module: str | None, s390_choice: str | None = None, other_module: str | None = None) -> dict[str, str]:
    """A complete choice of module; ValueError if it is not one."""
    other = (other_module or "").strip()
    complete = module in MODULES and (module != "S390" or s390_choice in S390_CHOICES) and (module != "Other" or other)
    if not complete:
        raise ValueError("a run needs a complete module choice")
    return {"module": module, "s390_choice": s390_choice if module == "S390" else None, "other_module": other if module == "Other" else None}


def run_records(results: DataFrame, submissions: DataFrame, app_name: str, module: str, s390_choice: str | None = None, other_module: str | None = None, version: str = "1", check_reviews: bool = False, run: str | None = None) -> DataFrame:
    """One row per submission: its text, references, findings and counts by label, under a run_id of the submission and ``run`` (by default a new one).

    A task that is run again writes the same ids.
    """
    choice, run = module_choice(module, s390_choice, other_module), run or uuid.uuid4().hex
    finding = F.struct(F.col("`Ref #`").alias("ref_no"), F.col("Reference").alias("reference"), F.col("`Validation Result`").alias("label"), F.col("Score").alias("score"), F.col("Notes").alias("notes"))
    found = results.groupBy("submission_id").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    counts = results.groupBy("submission_id", "Validation Result").count().groupBy("submission_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("`Validation Result`").alias("key"), F.col("count").alias("value"))))).alias("result_counts"))
    texts = submissions.select("submission_id", F.col("text").alias("input_text"))
    df = texts.join(found, "submission_id").join(counts, "submission_id").withColumn("split_refs", F.transform("findings", lambda f: f["reference"]))
    fixed = {"run": F.lit(run), "run_id": F.md5(F.concat_ws("|", F.lit(run), F.col("submission_id").cast("string"))), "app_name": F.lit(app_name), **{k: F.lit(v).cast("string") for k, v in choice.items()}, "validator_version": F.lit(version), "check_reviews": F.lit(check_reviews), "error_text": F.lit(None).cast("string")}
    return df.withColumns(fixed)


def write_run_records(records: DataFrame, path: str) -> None:
    """Add the records of runs to those under ``path``; runs that are there already are replaced, so writing twice is writing once.

    Each run is a partition, put in place when all its files are written. Then the run is entered in the list of
    complete runs, by which alone ``read_run_records`` goes: what a failed job has left is not read, and is replaced
    by the next try.
    """
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")
    put(records, "records")
    put(records.groupBy("run").agg(F.count("*").alias("n_records")), "complete")


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all complete runs."""
    text = lambda name: spark.read.parquet(f"{path}/{name}").withColumn("run", F.col("run").cast("string"))
    return text("records").join(text("complete").select("run"), "run", "left_semi")
