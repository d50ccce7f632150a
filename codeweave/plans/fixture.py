"""The driver tables seen as a code-structure graph, so that every graph operator has real rows to work on.

Folders are regions and nations, files customers and suppliers, functions orders, methods line items (whose keys repeat),
classes parts; customers import suppliers that they bought from, class files import the next brand's file. Of these only regions and nations, which don't
grow with the tables, are broadcast: estimates by file size would send hundreds of thousands of customers through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def places(self) -> DataFrame:
        return self.t("nation").join(self.t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("folder"))

    def customer_files(self) -> DataFrame:
        return self.t("customer").join(F.broadcast(self.places()), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", "folder", "c_name").alias("path"))

    def supplier_files(self) -> DataFrame:
        return self.t("supplier").join(F.broadcast(self.places()), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("/", "folder", "s_name").alias("path"))

    def files(self) -> DataFrame:
        return self.customer_files().select("path").unionByName(self.supplier_files().select("path")).withColumn("language", F.lit(None).cast("string"))

    def functions(self) -> DataFrame:
        o = self.t("orders").hint("merge").join(self.customer_files().hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
        k = F.col("o_orderkey")
        return o.select(F.col("path").alias("file_path"), F.concat(F.lit("o"), k.cast("string")).alias("name"), F.col("o_orderpriority").alias("params"), F.col("o_orderstatus").alias("return_type"),
                        (k % 1000).cast("int").alias("line"), (k % 1000 + 1).cast("int").alias("end_line"), (k % 2 == 0).alias("is_exported"), (k % 3 == 0).alias("is_async"), k.alias("o_orderkey"))

    def methods(self) -> DataFrame:
        o = self.t("orders").hint("merge").join(self.customer_files().hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "path")
        l = self.t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")  # noqa: E741
        return l.hint("merge").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("path").alias("file_path"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("class_name"), F.col("l_linenumber").cast("string").alias("name"),
            F.col("l_returnflag").alias("params"), F.col("l_linestatus").alias("return_type"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_linenumber").cast("int").alias("end_line"), F.lit(False).alias("is_async"))

    def imports(self) -> DataFrame:
        """``file_path, resolved_file``: a row for each line item."""
        o = self.t("orders").select("o_orderkey", "o_custkey")
        l = self.t("lineitem").select("l_orderkey", "l_suppkey").distinct()  # noqa: E741
        return (l.hint("merge").join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
                .join(self.customer_files().withColumnRenamed("path", "file_path").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
                .join(self.supplier_files().withColumnRenamed("path", "resolved_file").hint("merge"), F.col("l_suppkey") == F.col("s_suppkey")).select("file_path", "resolved_file"))

    def classes(self) -> DataFrame:
        k = F.col("p_partkey")
        u = lambda n: F.concat(F.lit("U"), n.cast("string"))
        parent = (F.when(k % 4 == 0, u(k * 7 % 40 * 5)).when(k % 4 == 1, F.concat(F.lit("ext."), F.col("p_type")))
                  .when(k % 4 == 2, F.concat(F.lit("red "), F.get(F.split("p_name", " "), F.lit(1)))).otherwise(F.concat(F.lit("mod."), u(k * 3 % 40 * 5))))
        wanted = F.when(k % 3 == 0, F.array(F.concat(F.lit("I_"), F.col("p_size").cast("string")))).otherwise(F.array().cast("array<string>"))
        return self.t("part").select(
            F.col("p_brand").alias("file_path"), F.when(k % 5 == 0, u(k)).otherwise(F.col("p_name")).alias("name"), k.cast("int").alias("line"), k.cast("int").alias("end_line"), k.alias("parse_order"),
            parent.alias("parent"), wanted.alias("implements"), F.array(parent).alias("parents"))

    def interfaces(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.t("part").filter(k % 50 == 0).select(F.col("p_brand").alias("file_path"), F.concat(F.lit("I_"), F.col("p_size").cast("string")).alias("name"), k.cast("int").alias("line"), (k % 100 == 0).alias("is_exported"))

    def class_imports(self) -> DataFrame:
        """Brand n's file imports every name of the next brand's."""
        n = F.regexp_extract("file_path", r"(\d+)$", 1).cast("int")
        return self.classes().select("file_path").distinct().select("file_path", F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string")).alias("resolved_file"))

    def orders_state(self, version: str) -> DataFrame:
        """Elements of two snapshots that differ: ``old`` lacks keys that end in 0, ``new`` those that end in 1 and changes those in 2."""
        f = self.functions()
        last = F.col("o_orderkey") % 10
        if version == "old":
            return f.filter(last != 0)
        return f.filter(last != 1).withColumn("params", F.when(last == 2, F.lit("changed")).otherwise(F.col("params")))
