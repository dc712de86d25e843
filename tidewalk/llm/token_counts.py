"""Token counts without token ids.

A merge never crosses the border of a pre-token, so a text has as many tokens as its pre-tokens have pieces. Pre-tokens are
counted over all documents, each distinct one is encoded once, and documents get their counts from a join of their own
pre-token frequencies with that table. The most frequent pre-tokens, at most ``HEAD`` of them, are sent to the tasks that
split the documents; only the rest is joined, which also keeps hot keys out of the join.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside texts are what the library takes
them for by default, one token each; a null ``doc_id`` is kept; repeated rows are counted each; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewalk.llm.pretokens import pretoken_counts
from tidewalk.llm.scratch import cut

#: Most pre-tokens that every task holds.
HEAD = 1 << 18
#: Pre-tokens that a task gathers before it hands on their counts.
GATHERED = 200_000


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return tokenizer, specials


def pretoken_table(documents: DataFrame, vocabulary: str) -> DataFrame:
    """piece, freq (over all documents), n (its tokens): one row per distinct pre-token."""

    def count(batches):
        tokenizer, specials = _tokenizer(vocabulary)
        total: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "freq"])

        for batch in batches:
            for text in batch.column(0):
                total.update(pretoken_counts(text.as_py(), tokenizer, specials))
                if len(total) >= GATHERED:
                    yield rows()
                    total.clear()
        yield rows()

    def encode(batches):
        tokenizer, _ = _tokenizer(vocabulary)
        for batch in batches:
            n = [len(x) for x in tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], names=["piece", "freq", "n"])

    counts = documents.select("text").mapInArrow(count, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return cut(counts.mapInArrow(encode, "piece string, freq long, n int"), "pretokens")


def frequent_pieces(table: DataFrame, limit: int) -> DataFrame:
    """The most frequent pieces, as many whole buckets of frequencies (16 to a doubling) as have no more than ``limit`` rows."""
    bucket = F.floor(F.log2("freq") * 16).cast("int")
    least, room = None, limit
    for b, n in sorted(((r["b"], r["count"]) for r in table.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = b
    return table.filter(bucket >= least if least is not None else F.lit(False))


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text, as the ``tokenizers`` file ``vocabulary`` gives them."""
    spark = documents.sparkSession
    table = pretoken_table(documents, vocabulary)
    top = frequent_pieces(table, HEAD).select("piece", "n").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(top["piece"].to_pylist(), top["n"].to_pylist())))

    def split(batches):
        tokenizer, specials = _tokenizer(vocabulary)
        known = head.value
        for batch in batches:
            sizes, sums, pieces, counts, at = [], [], [], [], [0]
            for text in batch.column(1):
                text, n = text.as_py(), 0
                for piece, count in pretoken_counts(text, tokenizer, specials).items():
                    if (own := known.get(piece)) is not None:
                        n += own * count
                    else:
                        pieces.append(piece)
                        counts.append(count)
                sizes.append(len(text.encode()) if text else 0)
                sums.append(n)
                at.append(len(pieces))
            rest = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], ["piece", "count"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), rest)], names=["doc_id", "n_bytes", "known", "rest"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    parts = documents.select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, n_bytes long, known long, rest array<struct<piece:string,count:long>>")
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()), "documents")
    rest = parts.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    rest = rest.join(table.select("piece", "n"), "piece").groupBy("row").agg(F.sum(F.col("count") * F.col("n")).alias("joined"))
    return parts.drop("rest").join(rest, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("joined", F.lit(0))).alias("n_tokens"))
