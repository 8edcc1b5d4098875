"""Renderings of ranked findings as text columns, and writers. Rendering is distributed; only writers choose files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scoring import lookup


def json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*[F.col(c) for c in findings.columns])).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result for each finding (category, severity, message, file, start_line, end_line)."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("category").alias("ruleId"), lookup(F.col("severity"), vocab.SARIF_LEVEL, "note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select(F.to_json(result).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule for each category, with the number of its results."""
    return findings.groupBy(F.col("category").alias("rule_id")).agg(F.count("*").alias("n_results"))


def quiet_lines(findings: DataFrame) -> DataFrame:
    """file:line: [SEVERITY] title. Nothing at all for no findings."""
    return findings.select(F.format_string("%s:%d: [%s] %s", F.col("file").cast("string"), F.col("start_line").cast("int"), F.upper("severity"), "title").alias("value"))


def console_lines(findings: DataFrame) -> DataFrame:
    badge = F.concat(F.lit("["), F.rpad(F.upper("severity"), 8, " "), F.lit("]"))
    fix = F.when(F.length("suggested_fix") > 0, F.concat(F.lit("\n    fix: "), F.col("suggested_fix"))).otherwise("") if "suggested_fix" in findings.columns else F.lit("")
    return findings.select(F.concat(badge, F.lit(" "), F.col("file").cast("string"), F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), F.col("title"), fix).alias("value"))


RENDERERS = {"json": json_lines, "sarif": sarif_results, "quiet": quiet_lines, "console": console_lines}


def render(findings: DataFrame, kind: str) -> DataFrame:
    if kind not in RENDERERS:
        raise ValueError(f"unknown format {kind}; one of {', '.join(sorted(RENDERERS))}")
    return RENDERERS[kind](findings)


def write(findings: DataFrame, kind: str, path: str) -> None:
    render(findings, kind).write.mode("overwrite").text(path)


def write_memo(df: DataFrame, path: str, commit: str, config: str) -> None:
    """A result kept under its key; a reader with another key finds nothing."""
    df.write.mode("overwrite").parquet(f"{path}/commit={commit}/config={config}")


def read_memo(spark, path: str, commit: str, config: str) -> DataFrame | None:
    at = f"{path}/commit={commit}/config={config}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(at) if fs.exists(hadoop) else None


def evaluation_report(scorecard: DataFrame) -> DataFrame:
    """(value): a scorecard of one row as a Markdown table."""
    rows = F.array(*[F.concat(F.lit(f"| {c.replace('_', ' ')} | "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(" |")) for c in scorecard.columns])
    return scorecard.select(F.concat(F.lit("# Evaluation\n\n| Measure | Value |\n|-|-|\n"), F.array_join(rows, "\n")).alias("value"))


def write_evaluation(scorecard: DataFrame, per_fixture: DataFrame, path: str) -> None:
    """The Markdown report, and the raw results of each fixture as JSON lines."""
    evaluation_report(scorecard).write.mode("overwrite").text(f"{path}/report")
    json_lines(per_fixture).write.mode("overwrite").text(f"{path}/raw")


# Columns for screens.


def snippet(code: F.Column, first: F.Column, marked: F.Column) -> F.Column:
    """Code with line numbers from ``first``; the marked line begins with >."""
    numbered = lambda x, i: F.concat(F.when(first + i == marked, "> ").otherwise("  "), F.lpad((first + i).cast("string"), 5, " "), F.lit(" | "), x)
    return F.array_join(F.transform(F.split(code, "\n"), numbered), "\n")


#: Colours of a terminal by the kind of a diff's line; fixed values.
DIFF_COLORS = {"+": "\x1b[32m", "-": "\x1b[31m", "@": "\x1b[36m"}
_RESET = "\x1b[0m"


def colored_diff(diff: F.Column) -> F.Column:
    def one(x):
        out = x
        for mark, color in DIFF_COLORS.items():
            out = F.when(x.startswith(mark), F.concat(F.lit(color), x, F.lit(_RESET))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(diff, "\n"), one), "\n")


def patch_preview(old: F.Column, new: F.Column) -> F.Column:
    """A replacement as removed and added lines."""
    each = lambda mark, c: F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.concat(F.lit(mark + " "), x))
    return F.array_join(F.concat(each("-", old), each("+", new)), "\n")
