"""TF-IDF over token and bigram terms with smoothed idf and unit-length rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiflow.functions.text import feature_names, tokens, with_bigrams


def terms(text: str) -> Column:
    return with_bigrams(tokens(F.col(text)))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has, as one file may hold all texts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def term_statistics(df: DataFrame, text: str) -> DataFrame:
    """Total count and document frequency of every term.

    Each document gives its terms and, marked, each distinct term once more; both
    are counted by one map-side combined aggregation.
    """
    listed = spread(df.select(text)).select(terms(text).alias("all"))
    both = listed.select(
        F.explode(F.array(F.struct(F.lit(0).alias("first"), F.col("all").alias("t")), F.struct(F.lit(1).alias("first"), F.array_distinct("all").alias("t")))).alias("x")
    )
    return (
        both.select("x.first", F.explode("x.t").alias("term"))
        .groupBy("term")
        .agg(F.count_if(F.col("first") == 0).alias("term_count"), F.sum("first").alias("document_frequency"))
    )


def vocabulary(df: DataFrame, text: str, min_df: int = 10, max_features: int = 100) -> DataFrame:
    """The most counted terms among those found in enough documents, with idf.

    Every row is a document, also one without text.
    """
    documents = df.count()
    known = term_statistics(df, text).filter(F.col("document_frequency") >= min_df)
    top = known.orderBy(F.desc("term_count"), "term").limit(max_features)
    smoothed = F.lit(1.0 + documents) / (F.col("document_frequency") + F.lit(1.0))
    return top.withColumn("idf", F.log(smoothed) + F.lit(1.0))


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary, in alphabetical order; at most ``max_features`` terms."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def fit(cls, df: DataFrame, text: str, min_df: int = 10, max_features: int = 100) -> TfidfModel:
        return cls.of(vocabulary(df, text, min_df, max_features))

    @classmethod
    def of(cls, table: DataFrame) -> TfidfModel:
        rows = sorted((r["term"], r["idf"]) for r in table.select("term", "idf").collect())
        return cls([t for t, _ in rows], [i for _, i in rows])

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(self.terms, self.idf, strict=True))
        spark.createDataFrame(rows, "term string, idf double").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        return cls.of(spark.read.parquet(path))

    def names(self) -> list[str]:
        return feature_names(self.terms)

    def _sparse(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add the weights as one sparse vector of unit length; rows are not moved."""
        if not self.terms:
            return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
        counter = CountVectorizerModel.from_vocabulary(self.terms, "__terms", "__counts")
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="__counts", outputCol="__raw")
        unit = Normalizer(p=2.0, inputCol="__raw", outputCol=out)
        rows = df.withColumn("__terms", terms(text))
        return unit.transform(scaled.transform(counter.transform(rows))).drop("__terms", "__counts", "__raw")

    def with_vector(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add the dense weights as an array; rows are not moved."""
        return self._sparse(df, text, out).withColumn(out, vector_to_array(out))

    def weight_rows(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """Long form (key, term, weight) of the non-zero weights."""
        names = F.from_json(F.lit(json.dumps(self.terms)), "array<string>")
        vectors = self.with_vector(spread(df.select(key, text)), text, "__tfidf")
        cells = F.zip_with(names, F.col("__tfidf"), lambda t, w: F.struct(t.alias("term"), w.alias("weight")))
        return vectors.select(key, F.inline(F.filter(cells, lambda c: c["weight"] > 0)))

    def with_columns(self, df: DataFrame, text: str) -> DataFrame:
        """Add one float column per term."""
        vectors = self.with_vector(df, text, "__tfidf")
        return vectors.select(
            *df.columns,
            *[F.get("__tfidf", F.lit(i)).cast("float").alias(n) for i, n in enumerate(self.names())],
        )
