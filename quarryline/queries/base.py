"""What the query modules share: the model over the given tables, and registration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import Entity, Model, Relation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in the cluster's checkpoint folder, or for a local master in a temporary one."""
    home = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = tempfile.mkdtemp(prefix="spark-")
    return f"{home}/tables-{uuid.uuid4().hex}"


def registrar(queries: dict, oracles: dict):
    """A decorator that registers a query under its function's name, with its SQL if it has one."""

    def add(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return add


def sales(spark: SparkSession, sf_dir: str) -> Model:
    """Region <- Nation <- Customer <- Order <- Line -> Part, Supplier -> Nation, with the inverse relations."""
    t = lambda n: table(spark, sf_dir, n)
    return Model.of(
        (Entity("Region", "r_regionkey"), t("region")),
        (Entity("Nation", "n_nationkey", (Relation("in_region", "Region", ("n_regionkey",)), Relation("customers", "Customer", ("n_nationkey",), ("c_nationkey",), "o2m"))), t("nation")),
        (Entity("Customer", "c_custkey", (Relation("of_nation", "Nation", ("c_nationkey",)), Relation("orders", "Order", ("c_custkey",), ("o_custkey",), "o2m"))), t("customer")),
        (Entity("Supplier", "s_suppkey", (Relation("of_nation", "Nation", ("s_nationkey",)), Relation("lines", "Line", ("s_suppkey",), ("l_suppkey",), "o2m"))), t("supplier")),
        (Entity("Part", "p_partkey"), t("part")),
        (Entity("Order", "o_orderkey", (Relation("by_customer", "Customer", ("o_custkey",)), Relation("lines", "Line", ("o_orderkey",), ("l_orderkey",), "o2m")), timestamps=("o_orderdate",)), t("orders")),
        (Entity("Line", "l_orderkey", (Relation("of_order", "Order", ("l_orderkey",)), Relation("of_part", "Part", ("l_partkey",)), Relation("by_supplier", "Supplier", ("l_suppkey",))), timestamps=("l_shipdate",)), t("lineitem")),
    )


def activity(spark: SparkSession, sf_dir: str) -> Model:
    """Events whose subject is a customer (purchases) or a supplier (others)."""
    t = lambda n: table(spark, sf_dir, n)
    events = t("events").withColumn("subject_type", F.when(F.col("event_type") == "purchase", "Customer").otherwise("Supplier"))
    customers = t("customer").withColumn("name", F.col("c_name"))
    suppliers = t("supplier").withColumn("name", F.col("s_name"))
    return Model.of(
        (Entity("Event", "event_id", (Relation("subject", via=("user_id",), kind="dynamic", type_col="subject_type"),), timestamps=("ts",)), events),
        (Entity("Customer", "c_custkey"), customers),
        (Entity("Supplier", "s_suppkey"), suppliers),
    )


def user_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of each user's state: the type of the latest event, open at the end."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("state"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), "event_id")


#: The same in SQL.
USER_STATES = "(SELECT user_id, event_type AS state, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, event_id FROM events)"
