"""Cluster-resource dumps: text records of KEY=VALUE lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import labels
from ..functions.nulls import null_if_empty
from ..functions.text import acl_group, acl_owner, version_from_path
from ..functions.times import hours_since

RECORD_BREAK = "BREAK_HERE\n"  # fixed value: separator line of saved dumps

# The name ending that tells the kind of a resource; anything else is technical.
KINDS = {"db": "DB", "pdb": "PDB", "lsnr": "LISTENER", "svc": "SERVICE"}
DYNAMIC = ["LAST_SERVER", "STATE", "TARGET", "USR_ORA_OPEN_MODE", "LAST_RESTART", "LAST_STATE_CHANGE", "STATE_DETAILS"]
# End of fixed values.


def read_resource_dump(spark: SparkSession, path: str, separator: str = RECORD_BREAK) -> DataFrame:
    """Raw records of saved dumps; the reader splits files at the separator, so big files are read in parallel."""
    return spark.read.text(path, lineSep=separator).where(F.col("value").contains("NAME="))


def attribute(key: str | Column, keys: str = "keys", values: str = "vals") -> Column:
    """Value of the first line with this key."""
    key = F.lit(key) if isinstance(key, str) else key
    return null_if_empty(F.try_element_at(F.col(values), F.array_position(keys, key).cast("int") + 1))


def parsed(records: DataFrame, *keep: Column) -> DataFrame:
    """Each record's KEY=VALUE lines as two arrays in line order; the values start with an empty one for absent keys."""
    line = F.lit(r"(?m)^([^=\n]+)=(.*)$")
    values = F.concat(F.array(F.lit("")), F.regexp_extract_all("value", line, F.lit(2)))
    return records.select(*keep, F.regexp_extract_all("value", line, F.lit(1)).alias("keys"), values.alias("vals"))


def _having(records: DataFrame, key: str) -> DataFrame:
    """Records with a value for key, parsed, with the plain resource name.

    The test runs on the raw text and the name is never NULL, so no filter repeats the parsing. The record is bound by a generator:
    a record whose text is made by a query is made once, and no test on it gets below that query's distinct or grouping.
    """
    records = records.select(F.explode(F.array("value")).alias("value"))
    plain = F.coalesce(F.regexp_extract("value", r"(?m)^NAME=(?:ora\.)?([^(\n]*)", 1), F.lit(""))
    return parsed(records.where(F.col("value").rlike(rf"(?m)^{key}=.")), plain.alias("plain"))


def _kind(plain: str = "plain") -> Column:
    return labels.map_code(F.substring_index(plain, ".", -1), KINDS, "TECH")


def _profile(records: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Static attributes of a resource, from its record that has an access list; the key arrays serve the per-server flags."""
    listed = _having(records, "ACL")
    if kinds:
        listed = listed.where(_kind().isin(*kinds))
    raw = listed.groupBy("plain").agg(F.max(F.struct("keys", "vals")).alias("r")).select("plain", "r.keys", "r.vals")
    return raw.select(
        "plain", acl_owner(attribute("ACL")).alias("owner"), acl_group(attribute("ACL")).alias("owner_group"),
        attribute("ORACLE_HOME").alias("home"), version_from_path(attribute("ORACLE_HOME")).alias("version"),
        attribute("DATABASE_TYPE").alias("database_type"), attribute("ROLE").alias("role"), attribute("ENDPOINTS").alias("port"),
        attribute("PLUGGABLE_DATABASE").alias("pluggable"), attribute("PDB_NAME").alias("pdb_name"), attribute("USR_ORA_VIP").alias("vip"),
        F.lower(attribute("VOLUME_DEVICE")).alias("device"), F.col("keys").alias("profile_keys"), F.col("vals").alias("profile_vals"))


def resource_states(records: DataFrame, now: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row per resource and server: state, target, hours since the last change, details, and the static attributes.

    For databases the target comes from the open mode. kinds: only these, of whose resources alone records are parsed.
    """
    raw = _having(records, "LAST_SERVER").select(
        "plain", F.regexp_replace("plain", r"\.[A-Za-z0-9]*$", "").alias("resource"), F.substring_index("plain", ".", -1).alias("ending"),
        _kind().alias("kind"), *[attribute(k).alias(k) for k in DYNAMIC])
    if kinds:
        raw = raw.where(F.col("kind").isin(*kinds))
    states = raw.select(
        "plain", "kind", "resource", F.when(F.col("kind").isin("DB", "PDB", "SERVICE"), F.substring_index("resource", ".", 1)).alias("database"),
        F.when(F.col("kind").isin("PDB", "SERVICE"), F.regexp_replace("resource", r"^[^.]*\.", "")).alias("part"),
        F.when(F.col("kind") == "TECH", F.col("ending")).alias("tech_type"),
        F.col("LAST_SERVER").alias("node"), F.regexp_replace("STATE", r" on .*$", "").alias("state"),
        F.coalesce(F.when(F.col("kind") == "DB", labels.target_state("USR_ORA_OPEN_MODE")), F.col("TARGET")).alias("target"),
        F.least(hours_since("LAST_RESTART", now), hours_since("LAST_STATE_CHANGE", now)).alias("started_hours"),
        labels.status_detail("STATE_DETAILS").alias("details"))
    at_server = F.concat(F.lit("ENABLED@SERVERNAME("), F.col("node"), F.lit(")"))
    flag = lambda key: attribute(key, "profile_keys", "profile_vals")
    enabled = F.coalesce(flag(at_server), flag("ENABLED"), F.lit("1"))
    return states.join(_profile(records, kinds), "plain", "left").withColumn("disabled", enabled == "0").drop("profile_keys", "profile_vals", "plain")


def explode_status_lists(records: DataFrame) -> DataFrame:
    """Four-line records with comma lists: one row per position, target next to state."""
    listed = lambda key: F.split(F.regexp_replace(attribute(key), r" *, *", ","), ",")
    rows = parsed(records).select(attribute("NAME").alias("name"), attribute("TYPE").alias("type"), listed("TARGET").alias("t"), listed("STATE").alias("s"))
    return rows.select("name", "type", F.inline(F.arrays_zip(F.col("t").alias("target"), F.col("s").alias("state")))).where("target IS NOT NULL")
