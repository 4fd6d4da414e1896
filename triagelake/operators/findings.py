"""Everyday work on the findings table: filters, joins, union, gate inputs, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.severity import lookup
from triagelake.operators.ordered import first_n


def true_positives(findings: DataFrame, decision: str = "llm_decision") -> DataFrame:
    return findings.where(F.col(decision) == "true_positive")


def cap(findings: DataFrame, max_findings: int | None, order: list[str]) -> DataFrame:
    """At most ``max_findings`` rows in a stated order; 0 or None means all."""
    return findings.orderBy(*order).limit(max_findings) if max_findings else findings


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All findings of all parts; a column a part lacks is null, ``part`` keeps the order of the parts."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def with_job(findings: DataFrame, jobs: DataFrame) -> DataFrame:
    own = jobs.select(F.col("id").alias("scan_job_id"), "repo_full_name", "pr_number", "commit_sha", "status")
    return findings.join(own, "scan_job_id")


def cascade_delete(findings: DataFrame, deleted_jobs: DataFrame) -> DataFrame:
    """Findings left after their scan jobs are deleted."""
    return findings.join(deleted_jobs.select(F.col("id").alias("scan_job_id")), "scan_job_id", "left_anti")


#: Characters of a gram of the name index.
GRAM = 5


def _grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM))))


def pr_candidates(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs ``scan_job_id, path, name`` in which the path holds the name's rarest gram.

    Grams of a job's names are an inverted index over its paths; how many paths hold each is counted, and
    every name looks up only its rarest one. A name with a gram that no path holds has no
    candidate. ``name`` has at least ``GRAM`` characters.
    """
    named = files.select("scan_job_id", "name", F.explode(_grams(F.col("name"))).alias("gram"))
    held = paths.where(F.length("path") >= GRAM).select("scan_job_id", "path", F.explode(_grams(F.col("path"))).alias("gram"))
    held = held.join(named.select("scan_job_id", "gram").distinct(), ["scan_job_id", "gram"], "left_semi")
    counts = held.groupBy("scan_job_id", "gram").count()
    counted = named.join(counts, ["scan_job_id", "gram"], "left")
    rarest = counted.groupBy("scan_job_id", "name").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("r"))
    chosen = rarest.where("r.n > 0").select("scan_job_id", "name", F.col("r.gram").alias("gram"))
    return held.join(chosen, ["scan_job_id", "gram"]).select("scan_job_id", "path", "name")


def in_pr_files(findings: DataFrame, pr_files: DataFrame, tested: int = 1 << 20) -> DataFrame:
    """Findings whose path contains any file name changed in their PR.

    Paths repeat a lot within a scan, so each distinct (job, path) is tested once, and the
    findings are kept by an equality semi join. In a job with more than ``tested`` pairs of finding and name,
    paths that are a changed name are found by equality and for the others :func:`pr_candidates` picks the pairs that are
    tested; names of fewer than ``GRAM`` characters have no gram and are tested against the job's other paths. An
    empty name is in every path, a missing path counts as an empty one.
    """
    findings = findings.withColumn("__path", F.coalesce("file_path", F.lit("")))
    paths = findings.select("scan_job_id", F.col("__path").alias("path")).distinct()
    files = pr_files.select("scan_job_id", F.col("file_name").alias("name")).where("name IS NOT NULL").distinct()

    def holding(paths: DataFrame, files: DataFrame) -> DataFrame:
        # A semi join stops at the first match and emits no pairs.
        inside = (F.col("p.scan_job_id") == F.col("f.scan_job_id")) & F.contains(F.col("p.path"), F.col("f.name"))
        return paths.alias("p").join(files.alias("f"), inside, "left_semi")

    sizes = findings.groupBy("scan_job_id").agg(F.count("*").alias("p")).join(files.groupBy("scan_job_id").agg(F.count("*").alias("n")), "scan_job_id")
    large = sizes.where(F.col("p") * F.col("n") > tested).select("scan_job_id")
    if large.first() is None:
        hit = holding(paths, files)
    else:
        in_large = lambda df: df.join(large, "scan_job_id", "left_semi")
        names = in_large(files)
        same = names.withColumnRenamed("name", "path")
        rest = in_large(paths).join(same, ["scan_job_id", "path"], "left_anti")
        found = pr_candidates(rest, names.where(F.length("name") >= GRAM)).where(F.contains("path", "name")).select("scan_job_id", "path")
        hit = holding(paths.join(large, "scan_job_id", "left_anti"), files)
        hit = hit.union(same).union(found).union(holding(rest, names.where(F.length("name") < GRAM))).distinct()
    return findings.join(hit.withColumnRenamed("path", "__path"), ["scan_job_id", "__path"], "left_semi").drop("__path")


def first_per_job(findings: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """First ``n`` findings of each scan job."""
    return first_n(findings, ["scan_job_id"], [F.col(c) for c in order], n)


def with_verification(findings: DataFrame, verifications: DataFrame) -> DataFrame:
    """Findings with their review verdict, null where not reviewed."""
    return findings.join(verifications, findings["id"] == verifications["finding_id"], "left").drop("finding_id")


def funnel(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, in PR files, verified: counts of one scan's narrowing (needs ``in_pr`` and ``llm_decision``)."""
    return findings.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if("in_pr").alias("in_pr_files"),
        F.count_if(F.col("in_pr") & (F.col("llm_decision") == "true_positive")).alias("verified"),
    )


# The audit tool of each kind of project, by the files that mark it.
PROJECT_FILES = {
    "requirements.txt": "pip-audit",
    "pyproject.toml": "pip-audit",
    "package.json": "npm-audit",
    "go.mod": "govulncheck",
    "Cargo.toml": "cargo-dependencies",
    "pom.xml": "dependency-check",
    "build.gradle": "dependency-check",
}


def dependency_tools(files: DataFrame) -> DataFrame:
    """``(project, tool)``: which dependency audits apply to each folder of a file listing."""
    name = F.substring_index("path", "/", -1)
    folder = F.left(F.col("path"), F.greatest(F.length("path") - F.length(name) - 1, F.lit(0)))
    rows = files.select(folder.alias("project"), lookup(name, PROJECT_FILES, None).alias("tool"))
    return rows.where("tool IS NOT NULL").distinct()


def relative_path(path, root):
    """Path below the clone root."""
    return F.replace(path, F.concat(root, F.lit("/")), F.lit(""))
