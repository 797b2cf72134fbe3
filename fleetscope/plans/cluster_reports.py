"""Resource-by-node status matrices of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import title_case
from ..operators.filters import health_class

UNKNOWN, DISABLED = "-", "x"  # fixed values: cell marks
DAY_HOURS = 24


def _cells(states: DataFrame, shown: Column, health: Column) -> DataFrame:
    """Cell text and health of every resource and node."""
    mark = F.when(F.col("disabled"), DISABLED)
    empty = F.coalesce(mark, F.lit(UNKNOWN))
    return states.withColumns({"cell": F.when(shown.isNull(), empty).otherwise(F.concat_ws(" ", title_case(shown), mark)), "health": health})


def _matrix(cells: DataFrame, keys: list[str], nodes: list[str] | None) -> DataFrame:
    """Nodes become columns (cell and health each). Without a list, the nodes are those that occur."""
    grouped = cells.groupBy(*keys)
    wide = (grouped.pivot("node", nodes) if nodes else grouped.pivot("node")).agg(F.max("cell").alias("cell"), F.max("health").alias("health"))
    cell_columns = [c for c in wide.columns if c.endswith("_cell")]
    return wide.select(*keys, *[F.coalesce(c, F.lit(UNKNOWN)).alias(c[:-5]) for c in cell_columns],
                       *[F.col(c) for c in wide.columns if c.endswith("_health")])


def technical_matrix(states: DataFrame, within_hours: int = DAY_HOURS, nodes: list[str] | None = None) -> DataFrame:
    rows = states.where("kind = 'TECH'")
    cells = _cells(rows, F.col("state"), health_class("state", "target", "started_hours", within_hours))
    return _matrix(cells, ["tech_type", "resource", "vip"], nodes)


def listener_matrix(states: DataFrame, within_hours: int = DAY_HOURS, nodes: list[str] | None = None) -> DataFrame:
    rows = states.where("kind = 'LISTENER'").withColumn("listener_type", F.when(F.upper("resource").contains("SCAN"), "SCAN").otherwise("Listener"))
    cells = _cells(rows, F.col("state"), health_class("state", "target", "started_hours", within_hours))
    return _matrix(cells, ["resource", "port", "listener_type"], nodes)


def service_matrix(states: DataFrame, within_hours: int = DAY_HOURS, nodes: list[str] | None = None) -> DataFrame:
    """Services of known databases; one that is down because its role is not the database's is as expected."""
    roles = states.where("kind = 'DB'").groupBy("database").agg(F.max("role").alias("database_role"))
    rows = states.where("kind = 'SERVICE'").join(roles, "database")
    expected = F.coalesce((F.col("role") != F.col("database_role")) & (F.col("state") != "ONLINE"), F.lit(False))
    cells = _cells(rows, F.col("state"), health_class("state", "target", "started_hours", within_hours, expected, status_first=True))
    return _matrix(cells.withColumn("pdb", F.coalesce("pluggable", F.lit(UNKNOWN))), ["database", "part", "pdb"], nodes).withColumnRenamed("part", "service")


def database_matrix(states: DataFrame, within_hours: int = DAY_HOURS, nodes: list[str] | None = None) -> DataFrame:
    """Databases with version, home and role, and their pluggable databases."""
    is_db = F.col("kind") == "DB"
    role = F.when(F.col("role") == "PRIMARY", " (P)").otherwise(" (S)")
    rows = states.where(F.col("kind").isin("DB", "PDB")).withColumns({
        "shown": F.when(is_db, F.col("details")).otherwise(F.col("state")),
        "part": F.when(~is_db, F.col("part")), "version": F.when(is_db, F.col("version")), "home": F.when(is_db, F.col("home")),
        "database_type": F.when(is_db, F.concat_ws("", "database_type", role)).otherwise("PDB")})
    cells = _cells(rows, F.col("shown"), health_class("shown", "target", "started_hours", within_hours))
    return _matrix(cells, ["database", "part", "version", "home", "database_type"], nodes).withColumnRenamed("part", "pdb")


def homes(states: DataFrame) -> DataFrame:
    """Distinct software homes with owner and group."""
    return states.where("kind = 'DB' AND home IS NOT NULL").groupBy("home").agg(F.min("owner").alias("owner"), F.min("owner_group").alias("owner_group"))


def sorted_by(matrix: DataFrame, *columns: str) -> DataFrame:
    return matrix.orderBy(*[F.col(c).asc_nulls_last() for c in columns])
