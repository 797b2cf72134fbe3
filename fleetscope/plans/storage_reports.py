"""Files, memory and generated command lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import MIB, count_if

MIN_SAVING_MB = 200  # fixed value: smaller savings are not reported
RESIZE_ABOVE_MB = 2  # fixed value: smaller savings get no command


def _mb(blocks: Column) -> Column:
    return F.ceil(blocks * F.col("block_size") / F.lit(MIB)).cast("bigint")


def shrink_candidates(files: DataFrame, extents: DataFrame, tablespaces: DataFrame, min_mb: int = MIN_SAVING_MB, exclude: str | None = None) -> DataFrame:
    """Files whose end is unused, with the smallest possible size, the saving, and resize commands.

    Extents are reduced to one high-water mark per file before the join. exclude: pattern of file names to leave out.
    """
    high = extents.groupBy("file_id").agg(F.max(F.col("block_id") + F.col("blocks") - 1).alias("hwm"))
    kept = files if exclude is None else files.where(~F.col("file_name").like(exclude))
    sized = (kept.join(tablespaces, "tablespace_name").join(high, "file_id", "left")
             .withColumns({"min_mb": _mb(F.coalesce("hwm", F.lit(1))), "current_mb": _mb(F.col("blocks"))})
             .withColumn("saving_mb", F.col("current_mb") - F.col("min_mb")).where(F.col("saving_mb") > min_mb))
    worth = F.col("saving_mb") > RESIZE_ABOVE_MB
    resize = render("alter database datafile '{}' resize {}M;", F.col("file_name"), F.col("min_mb") + 1)
    grow = render("alter database datafile '{}' autoextend on next 10M maxsize {}M;", F.col("file_name"), F.col("current_mb"))
    return sized.select(
        "file_id", "file_name", "min_mb", "current_mb", "saving_mb", F.when(worth, resize).alias("script"),
        F.when(worth & (F.col("autoextensible") == "NO"), grow).alias("script2")).orderBy(F.col("saving_mb").desc(), "file_id")


def render(template: str, *args: Column) -> Column:
    """Command text with each {} replaced by a value; NULL when a value is NULL."""
    parts = template.split("{}")
    pieces: list[Column] = [F.lit(parts[0])]
    for value, text in zip(args, parts[1:]):
        pieces += [value.cast("string"), F.lit(text)]
    return F.concat(*pieces)


def rename_commands(files: DataFrame, old: str, new: str) -> DataFrame:
    return files.select(render("alter database rename file '{}' to '{}';", F.col("file_name"), F.replace(F.col("file_name"), F.lit(old), F.lit(new))).alias("line"))


# The types of objects that can be compiled.
COMPILED = ("PACKAGE BODY", "PACKAGE", "FUNCTION", "PROCEDURE", "TRIGGER", "VIEW", "MATERIALIZED VIEW", "SYNONYM")


def recompile_commands(objects: DataFrame) -> DataFrame:
    """Compile command of every invalid object of a compiled type; public synonyms and package bodies have their own form."""
    kind, owner, name = F.col("object_type"), F.col("owner"), F.col("object_name")
    return objects.where((F.col("status") == "INVALID") & kind.isin(*COMPILED)).select(
        F.when((kind == "SYNONYM") & (owner == "PUBLIC"), render('alter public synonym "{}" compile', name))
        .when(kind == "PACKAGE BODY", render('alter package "{}"."{}" compile body', owner, name))
        .otherwise(render('alter {} "{}"."{}" compile', F.lower(kind), owner, name)).alias("line"))


def delete_target_commands(targets: DataFrame, pattern: str, target_type: str) -> DataFrame:
    return targets.where(F.col("target_name").like(pattern) & (F.col("target_type") == target_type)).select(
        render('emcli delete_target -name="{}" -type="{}"', F.col("target_name"), F.col("target_type")).alias("line"))


def memory_report(measures: DataFrame, registry: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Memory figures per instance and their grand total; an instance without figures is reported as down.

    Figures are megabytes rounded per instance, an absent one counts as zero.
    """
    wide = measures.groupBy("inst_id").agg(
        *[F.coalesce(F.max(F.when(F.col("name") == n, F.round(F.col("value").try_cast("decimal(38,0)") / MIB, 0).cast("bigint"))), F.lit(0)).alias(a) for n, a in columns.items()])
    lines = registry.select(F.col("id").alias("inst_id"), "instance_name").join(wide, "inst_id", "left")
    total = lines.rollup("instance_name").agg(*[F.sum(a).alias(a) for a in columns.values()], F.grouping("instance_name").alias("is_total"))
    first = next(iter(columns.values()))
    return total.select(
        F.when(F.col("is_total") == 1, "Total").otherwise(F.col("instance_name")).alias("instance"), *columns.values(),
        F.when((F.col("is_total") == 0) & F.col(first).isNull(), "Database is down").alias("note"))


def large_pages(segments: DataFrame, size: str, page_bytes: int, by: list[str]) -> DataFrame:
    """Large pages needed per host: every segment of at least one page takes its whole pages plus one."""
    pages = F.floor(F.col(size) / page_bytes)
    return segments.groupBy(*by).agg(F.coalesce(F.sum(F.when(pages > 0, pages + 1)), F.lit(0)).alias("pages"), count_if(pages > 0).alias("segments"))


def repo_usage(snapshots: DataFrame, segments: DataFrame, size: str, time: str) -> DataFrame:
    """Distinct snapshots, oldest entry and total segment size, as one row."""
    from ..functions.numbers import scaled

    return snapshots.agg(
        F.count_distinct(F.concat_ws("", F.col("snap_id").cast("string"), F.col("instance_number").cast("string"))).alias("snapshot_count"),
        F.date_format(F.min(time), "yyyy-MM-dd").alias("oldest_entry"),
    ).withColumn("size_mb", segments.select(scaled(F.sum(size), MIB)).scalar())


def value_or_zero(df: DataFrame, value: str) -> DataFrame:
    """The largest value, or zero when there is none."""
    return df.agg(F.coalesce(F.max(value), F.lit(0)).alias("value"))
