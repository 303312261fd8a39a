"""Request metrics, latencies and profiles (G3–G8, G10 aside, A22)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (50, 90, 95, 99)


def request_metrics(log: DataFrame, failed: Column, degraded: Column, latency: Column) -> DataFrame:
    """One row: requests, failures, degraded, average latency (0 without requests)."""
    return log.agg(
        F.count("*").alias("requests"),
        F.count_if(failed).alias("failures"),
        F.count_if(degraded).alias("degraded"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("average_latency"),
    )


def count_states(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("tasks"))


def render_metrics(metrics: DataFrame, prefix: str = "foldstone") -> DataFrame:
    """``line`` of each metric as exposition text."""
    kinds = {"requests": "requests_total", "failures": "failures_total", "degraded": "degraded_total", "average_latency": "latency_average"}
    names = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)])
    long = metrics.unpivot([], list(kinds), "metric", "value")
    return long.select(F.format_string(f"{prefix}_%s %s", names[F.col("metric")], F.col("value").cast("double").cast("string")).alias("line"))


def values_at(df: DataFrame, value: str, places: list[int]) -> DataFrame:
    """``place, value`` of the values at places (from 0) of the sorted column.

    Rows are sorted across partitions; only the partitions' sizes meet in one task,
    so that the column is never gathered.
    """
    spread = df.select(F.col(value).alias("value")).repartitionByRange("value").sortWithinPartitions("value")
    numbered = spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist(StorageLevel.MEMORY_AND_DISK)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = numbered.join(F.broadcast(sizes.select("part", "offset")), "part").withColumn("place", F.col("at") + F.col("offset"))
    return placed.filter(F.col("place").isin([int(p) for p in places])).select("place", "value")


def percentiles(df: DataFrame, value: str, points: tuple[int, ...] = PERCENTILES, rounding: str = "half_even") -> DataFrame:
    """``percentile, latency`` by nearest rank (G5): the value at ``p / 100 * (n - 1)``,
    rounded half to even, or cut off with ``rounding="floor"`` (G6). Nulls don't count;
    an empty column gives no rows."""
    own = df.filter(F.col(value).isNotNull())
    n = own.count()
    spark = df.sparkSession
    at = [(p, int(round(p / 100 * (n - 1)) if rounding == "half_even" else p / 100 * (n - 1))) for p in points] if n else []
    wanted = spark.createDataFrame(at, "percentile int, place bigint")
    found = values_at(own, value, sorted({x for _, x in at}))
    return F.broadcast(wanted).join(found, "place").select("percentile", F.col("value").alias("latency"))


def load_summary(log: DataFrame, ok: Column, latency: str, seconds: float, batch: int = 1) -> DataFrame:
    """One row: successes, errors, requests and records a second, average and largest latency."""
    good = F.count_if(ok)
    return log.agg(good.alias("successes"), F.count_if(~ok).alias("errors"), (good / seconds).alias("qps"), (good * batch / seconds).alias("records_per_s"), F.avg(latency).alias("average"), F.max(latency).alias("largest"))


def fold_stacks(samples: DataFrame, stack: str = "stack") -> DataFrame:
    """``stack, samples``: equal stacks counted."""
    return samples.filter(F.col(stack) != "").groupBy(F.col(stack).alias("stack")).agg(F.count("*").alias("samples"))


def roll_up(folded: DataFrame, separator: str = ";") -> DataFrame:
    """``prefix, depth, samples`` of every node of the tree of frames, the root as ""
    with depth 0 (G8)."""
    frames = F.split("stack", separator)
    depths = F.sequence(F.lit(0), F.size(frames))
    nodes = folded.select("samples", frames.alias("frames"), F.explode(depths).alias("depth"))
    prefix = F.array_join(F.slice("frames", 1, F.col("depth")), separator)
    return nodes.select(F.when(F.col("depth") > 0, prefix).otherwise("").alias("prefix"), "depth", "samples").groupBy("prefix", "depth").agg(F.sum("samples").alias("samples"))


def rank_siblings(rolled: DataFrame, separator: str = ";") -> DataFrame:
    """``roll_up`` with ``parent`` and ``rank``: the place among the children of a node, most
    samples first, ties by name (H5). The root is its own parent, with rank 1."""
    frames = F.split("prefix", separator)
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice(frames, 1, F.col("depth") - 1), separator)).otherwise("")
    order = Window.partitionBy("parent", F.least("depth", F.lit(1)), "depth").orderBy(F.desc("samples"), "prefix")
    return rolled.withColumn("parent", parent).withColumn("rank", F.row_number().over(order))


def error_histogram(log: DataFrame, ok: Column, error: Column) -> DataFrame:
    """``error, requests`` of the requests that failed, most first."""
    return log.filter(~ok).groupBy(F.coalesce(error.cast("string"), F.lit("")).alias("error")).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "error")


def collapse_profile(lines: DataFrame) -> DataFrame:
    """Profiler text (``line_no, line``, samples apart by blank lines, innermost frame
    first) to ``stack`` per sample, outermost first (G7). A sample's frames are few."""
    blank = F.trim("line") == ""
    sample = F.sum(blank.cast("int")).over(Window.partitionBy("file").orderBy("line_no"))
    # an indented line: address, frame and, after white space, perhaps a module in brackets
    frame = F.trim(F.regexp_extract("line", r"^\s+[0-9a-fA-F]+\s+(.+?)(?:\s+\(.*|\s*)$", 1))
    rows = lines.withColumn("sample", sample).withColumn("frame", frame).filter((F.col("frame") != "") & (F.col("frame") != "[unknown]"))
    per = rows.groupBy("file", "sample").agg(F.array_sort(F.collect_list(F.struct((-F.col("line_no")).alias("o"), "frame"))).alias("f"))
    return per.select(F.array_join(F.transform("f", lambda x: x["frame"]), ";").alias("stack"))
