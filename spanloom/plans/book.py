"""The registry that plan modules write to, and the views that they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.intervals import with_loci
from spanloom.sources.stages import packed as stage
from spanloom.sources.view import VIEW_SQL, exons, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class View:
    """Lazily built tables of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ex(self) -> DataFrame:
        return exons(self.spark, self.sf_dir)

    @cached_property
    def tx(self) -> DataFrame:
        return transcripts(self.ex)

    @cached_property
    def lo(self) -> DataFrame:
        """Transcripts with loci. Finding them takes several passes, so transcripts are written first."""
        return with_loci(stage(self.tx, "plain-transcripts"))

    @cached_property
    def origins(self) -> DataFrame:
        """lo with origin, where a locus begins."""
        return with_loci(stage(self.tx, "plain-transcripts"), start="origin")

    @cached_property
    def lex(self) -> DataFrame:
        """Exons with loci, exploded from the transcripts: no join back."""
        return self.lo.select("chrom", "tid", "gene", "strand", "lib", "sample", "score", "ref", "tst", "locus", F.explode("exons").alias("x")).select("*", "x.s", "x.e").drop("x")

    @cached_property
    def loci(self) -> tuple[DataFrame, DataFrame]:
        """lo and lex, written once: for queries that read them many times."""
        self.__dict__["lo"] = stage(self.lo, "transcripts")
        self.__dict__["lex"] = stage(self.lex, "exons")
        return self.lo, self.lex

    @cached_property
    def sizes(self) -> DataFrame:
        """Chromosome sizes: a bit more than what is used."""
        return self.ex.groupBy("chrom").agg((F.max("e") + 1000).alias("size"))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a View under a name; sql continues the common view's WITH list, or stands alone if it begins with SELECT or WITH."""

    def add(f: Callable[[View], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(View(spark, sf_dir))
        if sql:
            text = sql.strip()
            SQL[name] = text if text.startswith("WITH") else VIEW_SQL.rstrip() + ("\n" if text.startswith("SELECT") else ",\n") + text
        return f

    return add


def spans(exon_array: str | Column = "exons") -> Column:
    """'s-e,s-e' of an array of spans."""
    return F.array_join(F.transform(exon_array, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Exons of a transcript as text, in SQL.
SPANS_SQL = "string_agg(s || '-' || e, ',' ORDER BY s, e)"
SIZES_SQL = "sz AS (SELECT chrom, max(e) + 1000 AS size FROM ex GROUP BY chrom)"
