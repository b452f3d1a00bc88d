"""Registers queries: a function of (spark, sf_dir), and SQL over the same tables with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.graph import sieved

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Graph:
    """The entity graph seen in the star schema: orders are chunks, parts entities, customers documents, nations tenants."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda name: table(spark, sf_dir, name)

    def chunks(self) -> DataFrame:
        documents = self.read("customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("tenant"), F.col("c_mktsegment").alias("source"))
        rows = self.read("orders").select(
            F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("format"),
            F.col("o_orderpriority").alias("access"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created"),
        )
        return rows.join(documents, "doc_id", "left")

    def listed(self) -> DataFrame:
        """Mentions as they are listed, some more than once."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))

    def contains(self) -> DataFrame:
        return self.listed().distinct()

    def held(self) -> DataFrame:
        """Distinct mentions of the chunks that have vectors, and of a few others."""
        return sieved(self.listed(), "chunk_id", self.vectors().select("id")).distinct()

    def owners(self) -> DataFrame:
        """(doc_id, chunks, kept): how many chunks a document has, and how many of them mention an entity."""
        has = self.read("lineitem").select(F.col("l_orderkey").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct().withColumn("_has", F.lit(1))
        rows = self.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id")).join(has, "chunk_id", "left")
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("_has").alias("kept"))

    def entities(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))

    def mentions(self) -> DataFrame:
        """(doc_id, entity_id) of documents."""
        owners = self.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))
        return self.contains().join(owners, "chunk_id").select("doc_id", "entity_id").distinct()

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("grp"))


CONTAINS = "contains_ AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS entity_id FROM lineitem)"
CHUNKS = (
    "chunks AS (SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, o_orderstatus AS format, o_orderpriority AS access, o_totalprice AS price,"
    " o_orderdate AS created, c_nationkey AS tenant, c_mktsegment AS source FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"
)
ENTITIES = "entities AS (SELECT p_partkey AS entity_id, p_name AS name, p_type AS type, p_brand AS brand FROM part)"
MENTIONS = f"{CONTAINS}, mentions AS (SELECT DISTINCT o_custkey AS doc_id, entity_id FROM contains_ JOIN orders ON chunk_id = o_orderkey)"
SIZED = f"{CONTAINS}, sized AS (SELECT * FROM contains_ WHERE chunk_id IN (SELECT chunk_id FROM contains_ GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25))"
VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS grp FROM embeddings)"
