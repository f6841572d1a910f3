"""Full-text search (M4): an inverted index with positions, ranked search and phrases, as of an instant.

A row of the index is a term in a document, with its positions. Rows are filed
in folders by the hash of the term, so that a search opens the folders of its
own terms, and dealt out within a folder by the hash of the document, so that a
term that a third of all documents hold is built and read by many tasks. A run
appends its documents and changes no earlier row: document frequencies are
counted when a search asks for them, among the documents known at its instant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.identity import ranked

#: A term is a run of letters and digits, in lower case.
TERM = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """The terms of a text in order; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


class FullText:
    """An index in a folder. Document ids must be unique over all runs: another version of a text is another document."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", buckets: int = 64, slices: int = 8):
        self.spark, self.folder, self.id_type, self.buckets, self.slices = spark, folder, id_type, buckets, slices

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, run_id: str) -> None:
        """File documents (id, text, known_at) of a run. Writing a run again replaces it; null ids and unknown times go."""
        rows = docs.filter("id IS NOT NULL AND known_at IS NOT NULL").select(F.col("id").cast(self.id_type), F.col("known_at").cast("timestamp"), terms(F.col("text")).alias("terms"))
        held = rows.withColumn("length", F.size("terms"))
        held.select("id", "known_at", "length").write.mode("overwrite").parquet(f"{self.folder}/documents/run_id={run_id}")
        said = held.select("id", "known_at", "length", F.posexplode("terms").alias("position", "term"))
        said = said.withColumns({"bucket": self._bucket(F.col("term")), "slice": F.pmod(F.xxhash64("id"), F.lit(self.slices)).cast("int")})
        # The grouping keys begin with those of the shuffle: it is the only one.
        filed = said.repartition("bucket", "slice").groupBy("bucket", "slice", "term", "id", "known_at", "length").agg(F.array_sort(F.collect_list("position")).alias("positions"))
        filed.drop("slice").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/run_id={run_id}")

    def postings(self, as_of: str | None = None) -> DataFrame:
        schema = f"term string, id {self.id_type}, known_at timestamp, length int, positions array<int>, run_id string, bucket int"
        return self._known(self.spark.read.schema(schema).parquet(f"{self.folder}/postings"), as_of)

    def documents(self, as_of: str | None = None) -> DataFrame:
        return self._known(self.spark.read.schema(f"id {self.id_type}, known_at timestamp, length int, run_id string").parquet(f"{self.folder}/documents"), as_of)

    @staticmethod
    def _known(df: DataFrame, as_of: str | None) -> DataFrame:
        return df if as_of is None else df.filter(F.col("known_at") <= F.lit(as_of).cast("timestamp"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(qid, place, term, bucket) for every term of a query."""
        out = queries.select("qid", F.posexplode(terms(F.col("text"))).alias("place", "term"))
        return out.withColumn("bucket", self._bucket(F.col("term")))

    def _opened(self, asked: DataFrame, as_of: str | None) -> DataFrame:
        """Postings in the folders of the asked terms: at most ``buckets`` numbers go through the driver."""
        found = sorted(r.bucket for r in asked.select("bucket").distinct().collect())
        return self.postings(as_of).filter(F.col("bucket").isin(found))

    def frequencies(self, asked: DataFrame, as_of: str | None = None) -> DataFrame:
        """(term, documents): in how many documents known at the instant each asked term stands."""
        wanted = asked.select("bucket", "term").distinct()
        return self._opened(asked, as_of).join(wanted, ["bucket", "term"]).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))

    def search(self, queries: DataFrame, k: int, as_of: str | None = None, digits: int = 6) -> DataFrame:
        """(qid, id, score, rank): the k best documents of each query (qid, text) by BM25, ties by id. Exact.

        A query's term counts as often as the query holds it. Scores are rounded
        to ``digits`` before they are ranked, so the order of summing decides nothing.
        """
        size = self.documents(as_of).agg(F.count(F.lit(1)), F.avg("length")).first()
        n, mean = size[0], size[1] or 1.0
        asked = self._asked(queries)
        wanted = asked.groupBy("qid", "bucket", "term").agg(F.count(F.lit(1)).alias("times"))
        rare = F.log(1 + (F.lit(n) - F.col("documents") + 0.5) / (F.col("documents") + 0.5))
        weighed = wanted.join(self.frequencies(asked, as_of), "term").select("qid", "bucket", "term", (F.col("times") * rare).alias("weight"))
        hits = self._opened(asked, as_of).select("bucket", "term", "id", "length", F.size("positions").alias("tf")).join(weighed, ["bucket", "term"])
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))
        scored = hits.groupBy("qid", "id").agg(F.round(F.sum(part), digits).alias("score"))
        return ranked(scored, ["qid"], [F.desc("score"), F.asc("id")], k)

    def phrases(self, queries: DataFrame, save: Callable[[DataFrame], DataFrame], as_of: str | None = None) -> DataFrame:
        """(qid, id, times): documents in which a query's terms follow one another in its order, and how often. Exact.

        The places where a phrase could begin come from its rarest term; the other
        terms are then looked up in those documents only. A query without a term has none.
        """
        asked = save(self._asked(queries))
        # A term in no document leaves its query without a phrase.
        counted = asked.join(self.frequencies(asked, as_of), "term", "left")
        anchors = counted.groupBy("qid").agg(
            F.count(F.lit(1)).alias("n"), F.count("documents").alias("held"), F.min_by(F.struct("bucket", "term", "place"), F.struct("documents", "place")).alias("anchor")
        )
        anchors = save(anchors.filter("n = held").select("qid", "n", "anchor.*"))
        postings = self._opened(asked, as_of)
        starts = postings.select("bucket", "term", "id", "positions").join(anchors, ["bucket", "term"])
        starts = save(starts.select("qid", "n", "id", F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("start")).filter("start >= 0"))
        looked = starts.join(asked, "qid")
        met = looked.join(postings.select("bucket", "term", "id", "positions"), ["bucket", "term", "id"]).filter(F.array_contains("positions", F.col("start") + F.col("place")))
        whole = met.groupBy("qid", "id", "start").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).filter("found = n")
        return whole.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("times"))
