"""A stored inverted index: searches by words that do not read the corpus again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.cross import lexical_candidates
from weftline.operators.retrieval import top_k
from weftline.shared import cut, delete, discard
from weftline.sources.keyed import KeyedTable


#: Documents whose postings of a bucket are one file.
DOCUMENTS = 1 << 14


class PostingIndex:
    """Postings (token, doc_id, gen) in folders by a hash of the token, and the live documents as a keyed table.

    Every addition writes its postings beside the others under a name of its own (``gen``)
    and then says in the document table that this is the documents' latest one; that single
    step makes them visible, so a search never sees half an addition. A posting counts if it
    is of its document's latest gen, so a change or a delete rewrites no posting, only the
    buckets of the document table that it touches. ``compact`` drops postings that no longer
    count. A search reads the folders of the questions' tokens only.

    Defined results: a null or empty text is a document without words; repeated ids in one
    addition are one document with the words of all its rows; null ids are left out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.documents = KeyedTable(spark, f"{path}/documents", ("doc_id",), ("doc_id",), buckets)

    def _bucket(self, token: str = "token"):
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str, documents: int | None = None) -> None:
        # a part of a bucket is a file: a row is small in bytes and large when sorted, so parts are made by numbers
        parts = max(1, -(-self.documents.read().count() // DOCUMENTS)) if self.documents.version() else 1
        parts = parts if documents is None else max(1, -(-documents // DOCUMENTS))
        dealt = rows.withColumn("bucket", self._bucket()).repartition(parts * self.buckets, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
        dealt.write.mode("append").partitionBy("bucket").parquet(folder)

    def _read(self) -> DataFrame:
        kind = self.documents.read().schema["doc_id"].dataType.simpleString()
        return self.spark.read.schema(f"token string, doc_id {kind}, gen string, bucket int").parquet(f"{self.path}/postings")

    def add(self, texts: DataFrame) -> None:
        """Indexes (doc_id, text); documents that are there get the words of the new text instead."""
        gen = uuid.uuid4().hex
        rows = texts.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        ids = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
        found = lambda df: df.select(F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("token"), "doc_id")
        again = ids.where("n > 1").select("doc_id")
        if again.isEmpty():
            postings = found(rows)
        else:  # only repeated ids can repeat a token
            postings = found(rows.join(again, "doc_id", "left_anti")).unionByName(found(rows.join(again, "doc_id", "left_semi")).distinct())
        self._write(postings.withColumn("gen", F.lit(gen)), f"{self.path}/postings", ids.count())
        self.documents.upsert(ids.select("doc_id", F.lit(gen).alias("gen")))
        discard(ids)

    def remove(self, ids: DataFrame) -> None:
        """Documents of ``ids`` (doc_id) are no longer found."""
        self.documents.delete(ids.select("doc_id"))

    def apply(self, changes: DataFrame, texts: DataFrame) -> None:
        """Follows changes (doc_id, change) of ``ingest.changes``; ``texts`` has the new texts."""
        live = changes.where("change <> 'deleted'").select("doc_id")
        self.add(texts.join(live, "doc_id", "left_semi"))
        self.remove(changes.where("change = 'deleted'"))

    def _live(self, postings: DataFrame) -> DataFrame:
        return postings.join(self.documents.read(), ["doc_id", "gen"], "left_semi")

    def _wanted(self, wanted: DataFrame) -> DataFrame:
        """The postings (token, doc_id, gen) of the tokens of ``wanted``."""
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        return self._read().where(F.col("bucket").isin(buckets)).select("token", "doc_id", "gen").join(wanted.select("token").distinct(), "token", "left_semi")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, n_tokens, hits) as ``retrieval.lexical_scores`` gives them."""
        q = queries.select("query_id", T.query_tokens(F.col("question")).alias("tokens"))
        wanted = q.select("query_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
        return self._live(self._wanted(wanted)).join(wanted, "token").groupBy("query_id", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("hits"))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, doc_id, hits, n_tokens, rank): documents by the share of the question's tokens they have.

        Live documents with their tokens meet the questions in blocks, as in
        ``retrieval.lexical_search``, so a token that all have is no row a pair.
        """
        none = F.array().cast("array<string>")
        q = queries.select("query_id", F.coalesce(T.query_tokens(F.col("question")), none).alias("tokens"))
        wanted = q.select(F.explode("tokens").alias("token")).distinct()
        held = self._wanted(wanted).groupBy("doc_id", "gen").agg(F.collect_list("token").alias("tokens"))
        held = cut(held.join(self.documents.read(), ["doc_id", "gen"], "left_semi").select("doc_id", "tokens"))
        return top_k(lexical_candidates(q, held, k), ["query_id"], [F.desc("hits"), F.asc("doc_id")], k)

    def frequencies(self) -> DataFrame:
        """(token, documents): in how many live documents each token is."""
        return self._live(self._read().select("token", "doc_id", "gen")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))

    def compact(self) -> None:
        """Writes the live postings anew and drops the others. Not while others write or search."""
        fs, old = self.documents._fs(f"{self.path}/postings")
        fresh = f"{self.path}/compacted-{uuid.uuid4().hex}"
        self._write(self._live(self._read().select("token", "doc_id", "gen")), fresh)
        away = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/old-{uuid.uuid4().hex}")
        fs.rename(old, away)
        fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(fresh), old)
        delete(self.spark, away.toString())
