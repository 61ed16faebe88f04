"""Reports: JSON documents, dry runs, status, summary text. What reaches the driver is one row or a bounded list; documents of any size are written by tasks and joined as files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions.text import line_range_text, truncated
from patchloom.operators import findings as R
from patchloom.shared import new_path, remove

SCHEMA_VERSION = "1.0"


def finding_json(column_names: list[str]) -> Column:
    """A finding as a JSON object; null fields are left out and a line range is nested."""
    plain = [c for c in ("finding_id", "what", "why", "how_to_fix", "severity", "confidence", "cwe_id", "owasp_category", "file_path") if c in column_names]
    lines = F.when(F.col("line_start").isNotNull(), F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end"))).alias("line_range")
    return F.to_json(F.struct(*plain, *([lines] if "line_start" in column_names else [])))


def write_findings(findings: DataFrame, path: str) -> None:
    """All findings as JSON lines, in parallel: the form for results that one file can't hold."""
    findings.select(finding_json(findings.columns).alias("value")).write.mode("overwrite").text(path)


def report(findings: DataFrame, errors: DataFrame, metadata: dict, order: str, timestamp: str, suppressed: int | None = None) -> dict:
    """The report of one scan as a document; its findings are gathered in order, which suits a single repository's scan."""
    counts = {r["severity"]: r["n"] for r in R.by_severity(findings).collect()}
    rows = findings.orderBy(order).select(finding_json(findings.columns).alias("j")).toLocalIterator()
    out = {"schema_version": SCHEMA_VERSION, "version": metadata.get("version", "1.0.0"), "timestamp": timestamp, "metadata": {k: v for k, v in metadata.items() if v is not None and k != "version"}, "summary": {"total": sum(counts.values()), **{s.lower(): counts.get(s, 0) for s in C.SEVERITIES}}}
    if suppressed is not None:
        out["summary"]["suppressed"] = suppressed
    out["findings"] = [json.loads(r["j"]) for r in rows]
    failed = [r.asDict() for r in errors.toLocalIterator()]
    if failed:
        out["errors"] = failed
    return out


def write_document(document: dict, path: str) -> None:
    """A document as one pretty file, replaced as a whole; folders are made as needed."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    part = at.with_name(f"{at.name}.{os.getpid()}.part")
    part.write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n", "utf-8")
    os.replace(part, at)


def dry_run(prompts: DataFrame, staged: int, system_tokens: int = 0) -> DataFrame:
    """One row: dry_run, staged_files, analyzed_files, total_tokens and each file's tokens by path."""
    each = F.struct(F.col("path"), (F.col("tokens") + system_tokens).alias("estimated_tokens"))
    return prompts.agg(F.lit(True).alias("dry_run"), F.lit(staged).alias("staged_files"), F.count("*").alias("analyzed_files"), F.coalesce(F.sum(F.col("tokens") + system_tokens), F.lit(0)).alias("total_tokens"), F.array_sort(F.collect_list(each)).alias("files"))


def summary_line(findings: DataFrame, suppressed: int = 0) -> DataFrame:
    """One row: counts by severity, worst first, without zeros, and how many are suppressed."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES]
    parts = [F.when(F.col(s) > 0, F.concat_ws(" ", F.col(s).cast("string"), F.lit(s))) for s in C.SEVERITIES]
    text = F.array_join(F.array_compact(F.array(*parts)), ", ")
    tail = F.lit(f" ({suppressed} suppressed)" if suppressed else "")
    return findings.agg(*counts).select(F.concat(F.when(text == "", F.lit("No findings")).otherwise(text), tail).alias("summary"))


def table_rows(findings: DataFrame, width: int = 60) -> DataFrame:
    """Rows for a table on a terminal: severity, place, what, id."""
    place = F.concat_ws(":", F.coalesce("file_path", F.lit("(unknown)")), F.nullif(line_range_text("line_start", "line_end"), F.lit("")))
    return findings.select("severity", place.alias("place"), truncated("what", width).alias("what"), "finding_id")


def status(findings: DataFrame, errors: DataFrame, fail_on_error: bool = True, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row: exit_code, 2 for errors, 1 for a blocking finding, 0 otherwise."""
    rows = findings.select(F.coalesce(R.action("severity", overrides) == "block", F.lit(False)).alias("block"), F.lit(False).alias("failed"))
    rows = rows.unionByName(errors.select(F.lit(False).alias("block"), F.lit(fail_on_error).alias("failed")))
    code = F.when(F.bool_or("failed"), 2).when(F.bool_or("block"), 1).otherwise(0)
    return rows.agg(code.alias("exit_code"))


def _parts(rows: DataFrame, label: str) -> str:
    """Rows (value: a JSON object) written by tasks in their order, a line each, after a comma."""
    at = new_path(rows.sparkSession, label)
    rows.select(F.concat(F.lit(", "), "value").alias("value")).write.text(at)
    return at


def _joined(df: DataFrame, path: str, pieces: list[str | tuple[str]]) -> None:
    """One file from texts and folders of parts (as 1-tuples), streamed from file to file; the file at ``path`` is replaced as a whole."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    goal = jvm.org.apache.hadoop.fs.Path(path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}")
    fs = goal.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(goal.getParent(), f"{goal.getName()}.{os.getpid()}.part")
    fs.setWriteChecksum(False)
    out = fs.create(part, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            folder = jvm.org.apache.hadoop.fs.Path(piece[0])
            files = folder.getFileSystem(conf)
            listed = sorted((s.getPath().getName(), s.getPath()) for s in files.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
            for k, (_, name) in enumerate(listed):
                read = files.open(name)
                read.seek(0 if k else 1)  # nothing stands before the first row's comma
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
                read.close()
    finally:
        out.close()
    fs.delete(goal, False)
    if not fs.rename(part, goal):
        raise OSError(f"{part} can't be renamed to {goal}")
    for piece in pieces:
        if not isinstance(piece, str):
            remove(spark, piece[0])


def _object(fields: dict) -> str:
    """The first fields of a document, open for more."""
    return json.dumps(fields, indent=2, ensure_ascii=False)[:-2] + (",\n" if fields else "")


def write_report(findings: DataFrame, errors: DataFrame, metadata: dict, order: str, timestamp: str, path: str, suppressed: int | None = None) -> None:
    """The document of ``report`` for findings of any number: sorted ranges are written by tasks and joined; counts are observed on the way (after the sort, whose sampling would count twice)."""
    counts = Observation()
    seen = findings.orderBy(order).observe(counts, F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.SEVERITIES])
    rows = _parts(seen.select(finding_json(findings.columns).alias("value")), "report")
    failed = _parts(errors.select(F.to_json(F.struct(*errors.columns), {"ignoreNullFields": "false"}).alias("value")), "errors")
    head = {"schema_version": SCHEMA_VERSION, "version": metadata.get("version", "1.0.0"), "timestamp": timestamp, "metadata": {k: v for k, v in metadata.items() if v is not None and k != "version"}, "summary": counts.get | ({} if suppressed is None else {"suppressed": suppressed})}
    more = [] if errors.isEmpty() else [',\n  "errors": [\n', (failed,), "]"]
    _joined(findings, path, [_object(head) + '  "findings": [\n', (rows,), "]", *more, "\n}\n"])


def write_baseline(entries: DataFrame, path: str) -> None:
    """A baseline file, replaced as a whole; null paths are left out."""
    rows = _parts(entries.select(F.to_json(F.struct(*entries.columns)).alias("value")), "baseline")
    _joined(entries, path, [_object({"version": "1.0"}) + '  "entries": [\n', (rows,), "]\n}\n"])


def write_scan_cache(findings: DataFrame, path: str, scan_time: str) -> None:
    """The scan's findings before any is suppressed, for later additions to the baseline."""
    fields = ("finding_id", "cwe_id", "what", "file_path", "severity")
    rows = _parts(findings.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")), "cache")
    _joined(findings, path, [_object({"scan_time": scan_time}) + '  "findings": [\n', (rows,), "]\n}\n"])
