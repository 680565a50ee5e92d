"""Text formats: event files, spike times with clusters, features, positions, XML parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``<milliseconds> <description>`` as (t seconds, description); others are left out."""
    lines = spark.read.text(path)
    parts = lines.select(F.regexp_extract("value", r"^\s*([-+0-9.eE]+)\s+(.*?)\s*$", 1).alias("ms"), F.regexp_extract("value", r"^\s*([-+0-9.eE]+)\s+(.*?)\s*$", 2).alias("description"))
    return parts.select((F.expr("try_cast(ms as double)") / 1000).alias("t"), "description").where("t is not null")


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (t, description) as tab-separated milliseconds and description, ordered by time."""
    lines = events.repartitionByRange("t").sortWithinPartitions("t").select(F.concat_ws("\t", F.format_string("%.6f", F.col("t") * 1000), "description").alias("value"))
    lines.write.mode(mode).text(path)


def period_events(periods: DataFrame, label: str) -> DataFrame:
    """(start, peak, stop) rows as three events each, named with the label."""
    named = [F.struct(F.col(c).alias("t"), F.lit(f"{label} {c}").alias("description")) for c in ("start", "peak", "stop")]
    return periods.select(F.inline(F.array(*named)))


def compact_events(events: DataFrame) -> DataFrame:
    """Pairs "beginning of X" and "end of X" as (description X, start, stop).

    Each beginning is closed by the next end of that name; one without is left out.
    """
    kind = F.regexp_extract("description", r"^(beginning|end) of (.*)$", 1)
    name = F.regexp_extract("description", r"^(beginning|end) of (.*)$", 2)
    marked = events.select("t", kind.alias("kind"), name.alias("description")).where("kind <> ''")
    w = Window.partitionBy("description").orderBy("t")
    paired = marked.withColumn("stop", F.lead("t").over(w)).withColumn("next", F.lead("kind").over(w))
    return paired.where("kind = 'beginning' and next = 'end'").select("description", F.col("t").alias("start"), "stop")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line from 0, value): line numbers by file.

    Blocks of a file come in order of their offsets, so numbers are a running
    sum of the blocks' line counts and no file passes through one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.withColumn("base", before).drop("n")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = lines.withColumn("k", inside).join(base, ["file", "block"])
    return numbered.select("file", (F.col("k") + F.col("base")).alias("line"), "value")


def _group():
    return F.regexp_extract("file", r"\.(\d+)$", 1).cast("int")


def read_spikes(spark: SparkSession, times: str, clusters: str, rate: float) -> DataFrame:
    """(t, grp, cluster) from sample numbers (``.res.N``) and clusters (``.clu.N``).

    The first line of a cluster file is a count and is skipped; lines are
    joined by number within group N.
    """
    res = numbered_lines(spark, times).where("trim(value) not like '!%%' escape '!'").select(_group().alias("grp"), "line", (F.trim("value").cast("double") / rate).alias("t"))
    clu = numbered_lines(spark, clusters).where("line > 0").select(_group().alias("grp"), (F.col("line") - 1).alias("line"), F.trim("value").cast("int").alias("cluster"))
    return res.join(clu, ["grp", "line"]).select("t", "grp", "cluster")


def read_features(spark: SparkSession, path: str, rate: float) -> DataFrame:
    """(t, grp, features) of ``.fet.N``: the first line is a count, the last column the sample."""
    rows = numbered_lines(spark, path).where("line > 0").select(_group().alias("grp"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("x"))
    return rows.select((F.element_at("x", -1) / rate).alias("t"), "grp", F.slice("x", 1, F.size("x") - 1).alias("features"))


def read_positions(spark: SparkSession, path: str, rate: float, missing: float = -1.0) -> DataFrame:
    """(t, x, y, ...) of an untimed position file; ``missing`` values are null."""
    rows = numbered_lines(spark, path).select((F.col("line") / rate).alias("t"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: F.nullif(x.cast("double"), F.lit(missing))).alias("v"))
    return rows.select("t", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"), F.get("v", F.lit(2)).alias("x2"), F.get("v", F.lit(3)).alias("y2"))


def read_channel_groups(spark: SparkSession, path: str) -> DataFrame:
    """(grp, channel) of the anatomical groups in an XML parameter file."""
    groups = spark.read.format("xml").option("rowTag", "group").option("valueTag", "id").schema("channel array<string>").load(path)
    numbered = groups.withColumn("grp", F.monotonically_increasing_id())
    return numbered.select("grp", F.explode("channel").alias("channel")).select("grp", F.col("channel").cast("int").alias("channel"))


def select_units(spikes: DataFrame, units: list[tuple[int, int]]) -> DataFrame:
    """Spikes of (group, cluster) pairs; cluster -1 leaves out 0 and 1, -2 leaves out 0, -3 takes all."""
    wanted = F.lit(False)
    for grp, cluster in units:
        own = {-1: F.col("cluster") > 1, -2: F.col("cluster") > 0, -3: F.lit(True)}.get(cluster, F.col("cluster") == cluster)
        wanted = wanted | ((F.col("grp") == grp) & own)
    return spikes.where(wanted)
