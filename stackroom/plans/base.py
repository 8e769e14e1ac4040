"""Registration of named queries and the views of the test tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer splits than there are cores are dealt to all of them first."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df


def dealt(df: DataFrame) -> DataFrame:
    """Rows that lie in fewer splits than there are cores, dealt to all of them: for small rows that cost much work each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Lines of documents stand for a paper's paragraphs: four to a page, `source` for its section.
LINES = "lines as (select doc_id, source, lang, unnest(range(0, len(l)))::int pos, unnest(l) as text from (select *, string_split(text, chr(10)) l from documents)), para as (select *, pos // 4 + 1 page from lines)"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "text")).where("pos is not null").withColumn("page", F.expr("cast(pos div 4 + 1 as int)"))


def literal(x) -> str:
    """A value as SQL that both engines read alike."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return repr(x)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of inline rows."""
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    ship(spark)
    return spark.createDataFrame(rows, schema)


def cases(texts: list[str | None], names: str = "k, s") -> str:
    """A subquery of `part` rows: each key has one of the texts, with its name for @n and its size for @z."""
    k, text = names.split(", ")
    return f"(select p_partkey {k}, replace(replace({literal(texts)}[p_partkey % {len(texts)} + 1], '@n', p_name), '@z', p_size::varchar) {text} from part)"


def expected(texts: list[str | None]) -> str:
    """The text that belongs to a row of `cases`."""
    return f"replace(replace({literal(texts)}[p_partkey % {len(texts)} + 1], '@n', p_name), '@z', p_size::varchar)"


def case_of(texts: list[str | None]) -> Column:
    one = F.element_at(F.array(*[F.lit(x).cast("string") for x in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    return F.replace(F.replace(one, F.lit("@n"), F.col("p_name")), F.lit("@z"), F.col("p_size").cast("string"))


def case_table(spark: SparkSession, sf_dir: str, texts: list[str | None]) -> DataFrame:
    """(k, s): the rows of `cases`."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), case_of(texts).alias("s"))
