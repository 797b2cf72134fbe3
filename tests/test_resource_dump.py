from conftest import rows
from fleetscope.plans import cluster_reports as R
from fleetscope.sources import resource_dump as D

DUMP = """BREAK_HERE
NAME=ora.prod.db
TYPE=ora.database.type
ACL=owner:oracle:rwx,pgrp:dba:r-x
ORACLE_HOME=/u01/app/oracle/product/19.0.0/dbhome_1
DATABASE_TYPE=RAC
ROLE=PRIMARY
ENABLED=1
ENABLED@SERVERNAME(n1)=1
ENABLED@SERVERNAME(n2)=0

BREAK_HERE
NAME=ora.prod.db
TYPE=ora.database.type
LAST_SERVER=n1
STATE=ONLINE on n1
TARGET=ONLINE
USR_ORA_OPEN_MODE=open
LAST_RESTART=01/19/2024 20:00:00
STATE_DETAILS=Open,HOME=/u01/app

BREAK_HERE
NAME=ora.prod.db
TYPE=ora.database.type
LAST_SERVER=n2
STATE=OFFLINE
TARGET=OFFLINE
USR_ORA_OPEN_MODE=open
LAST_RESTART=NEVER
STATE_DETAILS=Instance Shutdown

BREAK_HERE
NAME=ora.prod.web.svc
TYPE=ora.service.type
ACL=owner:oracle:rwx,pgrp:dba:r-x
ROLE=PHYSICAL_STANDBY

BREAK_HERE
NAME=ora.prod.web.svc
TYPE=ora.service.type
LAST_SERVER=n1
STATE=OFFLINE
TARGET=OFFLINE
LAST_RESTART=NEVER

BREAK_HERE
NAME=ora.lost.web.svc
TYPE=ora.service.type
LAST_SERVER=n1
STATE=ONLINE
TARGET=ONLINE
"""


def states(spark, tmp_path):
    (tmp_path / "dump.txt").write_text(DUMP)
    return D.resource_states(D.read_resource_dump(spark, str(tmp_path / "dump.txt")), "2024-01-20 00:00:00")


def test_separate_profile_and_state_records(spark, tmp_path):
    got = rows(states(spark, tmp_path).where("kind = 'DB'"), "node", "details", "target", "version", "owner", "disabled", "started_hours")
    assert got == [("n1", "Open", "Open", "19.0.0", "oracle", False, 4), ("n2", "Shutdown", "Open", "19.0.0", "oracle", True, 999999999999)]


def test_database_matrix(spark, tmp_path):
    r = R.database_matrix(states(spark, tmp_path)).first()
    assert (r["n1"], r["n1_health"], r["n2"], r["n2_health"], r["database_type"]) == ("Open", "recently restarted", "Shutdown x", "status issue", "RAC (P)")


def test_services_of_unknown_databases_are_ignored(spark, tmp_path):
    got = R.service_matrix(states(spark, tmp_path), nodes=["n1", "n2"]).collect()
    assert [(r["database"], r["service"], r["n1"], r["n1_health"], r["n2"]) for r in got] == [("prod", "web", "Offline", "offline as expected", "-")]


def test_status_lists_of_unequal_length(spark):
    df = spark.createDataFrame([("NAME=ora.x\nTYPE=t\nTARGET=ONLINE, ONLINE\nSTATE=ONLINE on a",)], "value string")
    assert rows(D.explode_status_lists(df), "name", "target", "state") == [("ora.x", "ONLINE", "ONLINE on a"), ("ora.x", "ONLINE", None)]


def test_texts_made_by_a_query_are_made_once(spark):
    """No test on the text gets below the distinct that the texts come from; kinds give the rows of the whole with that kind."""
    parts = [(x,) for x in DUMP.split("BREAK_HERE\n") if x] * 2
    records = spark.createDataFrame(parts, "part string").selectExpr("concat(part, '') AS value").distinct()
    whole, some = D.resource_states(records, "2024-01-20 00:00:00"), D.resource_states(records, "2024-01-20 00:00:00", ("DB",))
    for found in (whole.where("kind = 'DB'"), some):
        lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        for i, line in enumerate(lines):
            if "Generate " in line:
                below = lines[i + 1:next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))]
                assert below and not any("RLIKE" in x for x in below)
        assert sum("Generate " in x for x in lines) == 2
    assert rows(some, *whole.columns) == rows(whole.where("kind = 'DB'"), *whole.columns) != []
