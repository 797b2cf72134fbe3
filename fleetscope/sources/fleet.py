"""Collecting one relation from many databases, and writing the daily snapshot."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions.times import ts
from ..operators.snapshots import DATE
from ..session import scratch_dir

#: Slots of sources within a day, and the column that tells them.
SLOTS, SLOT = 32, "source_slot"
#: Rows, and batches of sources, at most that are handed on together.
BATCH_ROWS, BATCH_PARTS = 10_000, 2_000
ERROR_SCHEMA = "inst_id long, collector string, error string"


def collect_fleet(registry: DataFrame, reader: Callable[[Row], DataFrame], date, path: str, collector: str = "collector",
                  parallel: int = 8) -> DataFrame:
    """Read the same relation from every registered source into the snapshot of the day below path.

    Each source is read by a job of its own, `parallel` of them at a time; what was read replaces the sources' parts of the
    day together, so a repeated source touches no other one. A source that can't be
    opened, or that fails while it is read, keeps its former rows and becomes a row of the result, with the whole
    error text. Sources that land as files are read in one scan by `collect_landing` instead.
    """
    spark, landed = registry.sparkSession, defaultdict(list)

    def one(row: Row) -> tuple | None:
        try:
            landing = scratch_dir(spark, "collected")
            found = reader(row).withColumns({"inst_id": F.lit(row["id"]).cast("bigint"), DATE: ts(date)})
            found.write.parquet(landing)
            landed[found.schema.json()].append((found.schema, landing))
        except Exception as e:  # any failure of one source must not stop the others
            return row["id"], collector, str(e) or type(e).__name__
        return None

    with ThreadPoolExecutor(parallel) as pool:
        errors = [e for e in pool.map(one, registry.toLocalIterator()) if e]
    for found in landed.values():
        write_snapshot(spark.read.schema(found[0][0]).parquet(*[landing for _, landing in found]), path)
    return spark.createDataFrame(errors, ERROR_SCHEMA).withColumn(DATE, ts(date))


class SourceError(Exception):
    """What a reader raises when its source answers, but not as it should."""


def slot_of(source: str, slots: int) -> Column:
    """The slot of a source, 0 to slots - 1; the same for every integer type of its id."""
    return F.pmod(F.crc32(F.coalesce(F.col(source).cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def source_rows(registry: DataFrame, connect: Callable[[dict], Iterable], schema: str, failures: tuple[type[Exception], ...] = (OSError, SourceError),
                tasks: int | None = None, group: str | None = None) -> DataFrame:
    """inst_id, the columns of schema, and error: the rows of every registered source, read by one scan of the registry.

    The registry's rows are dealt to `tasks` (four for each core by default), and a task takes its sources in turn; those with
    the same value of the column `group` go to the same task, one after the other. connect runs in the source's task: it gets the
    registry's row and yields Arrow record batches with the columns of schema, one at a time. If it raises one of failures (a
    connection or file that fails is an OSError), the source ends with a row that has the error's text and nulls; any other
    exception is a fault of the program and fails the job.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = f"inst_id long, {schema}, error string"
    shape = to_arrow_schema(StructType.fromDDL(whole))
    n = tasks or 4 * registry.sparkSession.sparkContext.defaultParallelism
    dealt = registry.repartition(n, group).sortWithinPartitions(group) if group else registry.repartition(n)

    def one(source: dict) -> Iterator:
        import pyarrow as pa

        def batch(columns: dict, rows: int, error: str | None) -> pa.RecordBatch:
            given = {"inst_id": pa.array([source["id"]] * rows, pa.int64()), "error": pa.array([error] * rows, pa.string())} | columns
            return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(rows, f.type) for f in shape], schema=shape)

        try:
            for found in connect(source):
                yield batch({c: found.column(c) for c in found.schema.names}, found.num_rows, None)
        except failures as e:
            yield batch({}, 1, str(e) or type(e).__name__)

    def read(registered: Iterator) -> Iterator:
        import pyarrow as pa

        few, rows = [], 0
        for b in (b for sources in registered for source in sources.to_pylist() for b in one(source)):
            few.append(b)
            rows += b.num_rows
            if rows >= BATCH_ROWS or len(few) >= BATCH_PARTS:
                yield from pa.Table.from_batches(few).combine_chunks().to_batches()
                few, rows = [], 0
        if few:
            yield from pa.Table.from_batches(few).combine_chunks().to_batches()

    return dealt.mapInArrow(read, whole)


def collect_at_once(registry: DataFrame, connect: Callable[[dict], Iterable], schema: str, date, path: str, collector: str = "collector",
                    failures: tuple[type[Exception], ...] = (OSError, SourceError), group: str | None = None) -> DataFrame:
    """Read all sources as source_rows does, in one job, and replace their parts of the day below path; returns the errors as rows.

    What was read is landed first, so nobody is asked twice. A source with an error keeps its former rows, also where it
    gave some before it failed.
    """
    spark = registry.sparkSession
    landing = scratch_dir(spark, "collected")
    source_rows(registry, connect, schema, failures, group=group).write.parquet(landing)
    landed = spark.read.parquet(landing)
    errors = landed.where("error is not null").select("inst_id", F.lit(collector).alias("collector"), "error")
    whole = landed.where("error is null").join(errors.select("inst_id"), "inst_id", "left_anti").drop("error")
    write_snapshot(whole.withColumn(DATE, ts(date)), path)
    return errors.withColumn(DATE, ts(date))


def folder_rows(root: str, columns: list[str], c: str = "id") -> Callable[[dict], Iterator]:
    """connect() for sources whose relation lies as Parquet files in root/<c>=<id>; a source without files is not reachable."""

    def connect(source: dict) -> Iterator:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        folder = f"{top}/{c}={source['id']}"
        if system.get_file_info(folder).type == fs.FileType.NotFound:
            raise ConnectionError(f"source {source['id']} has nothing to read")
        yield from ds.dataset(folder, filesystem=system, format="parquet").to_batches(columns=columns)

    return connect


def grouped_rows(root: str, columns: list[str], c: str = "id", group: str = SLOT) -> Callable[[dict], Iterator]:
    """connect() for sources whose relation lies as Parquet files of many sources in root/<group>=<the source's>; one without rows is not reachable.

    A group is read once by a task that takes its sources one after the other, and held while it does.
    """
    held = {}

    def connect(source: dict) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        if held.get("group", held) != source[group]:
            system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
            folder, at = f"{top}/{group}={source[group]}", {}
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                table = ds.dataset(folder, filesystem=system, format="parquet").to_table(columns=[c, *columns]).sort_by(c).combine_chunks()
                held["table"], start = table.select(columns), 0
                for run in pc.run_end_encode(table.column(c)).chunks:
                    for k, end in zip(run.values.to_pylist(), run.run_ends.to_pylist()):
                        at[k], start = (start, end - start), end
            held.update(group=source[group], at=at)
        if source["id"] is None or source["id"] not in held["at"]:
            raise ConnectionError(f"source {source['id']} has nothing to read")
        yield from held["table"].slice(*held["at"][source["id"]]).to_batches()

    return connect


def jdbc_reader(spark: SparkSession, table: str, url: Callable[[Row], str], **options) -> Callable[[Row], DataFrame]:
    """Reader of one table per source database."""
    return lambda row: spark.read.format("jdbc").options(url=url(row), dbtable=table, **options).load()


def folder_reader(spark: SparkSession, root: str) -> Callable[[Row], DataFrame]:
    """Reader of per-source parquet folders below root."""
    return lambda row: spark.read.parquet(f"{root}/{row['id']}")


def collect_landing(spark: SparkSession, root: str, registry: DataFrame, date, c: str = "id") -> DataFrame:
    """All per-source folders root/id=<source>/ in one scan, restricted to registered sources."""
    return spark.read.option("basePath", root).parquet(root).join(registry.select(c), c, "left_semi").withColumn(DATE, ts(date))


def write_snapshot(df: DataFrame, path: str, by: tuple[str, ...] = (DATE, "inst_id"), slots: int = SLOTS) -> None:
    """Replace the parts present in df (by default the day of each source), keep all others; running it again changes nothing.

    by names the day's column, or that and the source's. Sources lie in slots of a day (partition column source_slot), so the number
    of files follows the days and not the sources; slots must stay the same for a path. A slot of which some sources are
    replaced is written again with the stored rows of the others, so two writers of one path must not run at once.
    """
    if len(by) > 1:
        *days, source = by
        df = df.drop(SLOT).withColumn(SLOT, slot_of(source, slots))
        parts = [*days, SLOT]
        old = _stored(df.sparkSession, path)
        if old is not None:
            old = old.withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in parts})
            same = lambda keys: reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys])
            kept = old.alias("o").join(df.select(*parts).distinct().alias("n"), same(parts), "left_semi")
            kept = kept.alias("o").join(df.select(*parts, source).distinct().alias("n"), same([*parts, source]), "left_anti")
            df = df.unionByName(kept, allowMissingColumns=True)
        df, by = df.repartition(*parts), tuple(parts)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What lies at path; None if nothing does."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def purge_stored(spark: SparkSession, path: str, new_path: str, pred: Column, by: tuple[str, ...] = (DATE, "inst_id")) -> None:
    """Write the stored history without the rows that meet pred to new_path; readers switch to it when it is complete."""
    write_snapshot(purge_snapshot(spark.read.parquet(path), pred), new_path, by)


def purge_snapshot(df: DataFrame, pred: Column) -> DataFrame:
    """Rows that stay when those meeting pred are deleted."""
    return df.where(~F.coalesce(pred, F.lit(False)))
