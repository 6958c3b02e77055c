"""Encoding a corpus with a byte-level BPE vocabulary through a table of distinct words.

Texts are split into words once, by the vocabulary's pattern inside the JVM; every distinct word is encoded once; the ids
are joined back by position. The most frequent words (a table of bounded bytes) meet the texts by broadcast, where they
stand, on Arrow arrays; only the rare rest moves, and no rare word can be hot. No text is shuffled.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, spread
from .survivors import WHITE

#: Where the vocabulary files are on every machine.
VOCABULARIES = os.environ.get("SHELFMARK_VOCABULARIES", "/opt/tokenizers")

#: Fixed: the pattern that splits a text into words before the merges, with white space spelled out for Java.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = None
        for b in batches:
            enc = enc or tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})
            ids = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def _pieces(b: pa.RecordBatch, column: str, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """A batch in slices of some rows, with the flattened lists of a column and the ends of each row's part."""
    for at in range(0, b.num_rows, rows):
        part = b.slice(at, rows)
        lists = part.column(part.schema.get_field_index(column))
        yield part, lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, words, _ in _pieces(b, "words"):
            c = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], names=["word", "n"])


class Encoded:
    """The words of a corpus, split once, and the table of distinct words with their ids.

    Words that are frequent enough are `hot`: as many classes of frequency (eight to a doubling), from the top, as take
    `hot_bytes` with their ids. They meet the texts by broadcast, whatever their length. A word with n places has at most
    (bytes of the corpus) / n bytes, so whatever is so frequent that its places would fill a task is hot.
    """

    def __init__(self, documents: DataFrame, id: str, text: str, vocabulary: str, hot_bytes: int):
        self.spark = spark = documents.sparkSession
        self.scratch = Scratch(spark, "tokens")
        docs = documents.select(F.col(id).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL")
        if not docs.groupBy("d").count().where("count > 1").isEmpty():  # only ids are moved to find this out
            docs = docs.groupBy("d").agg(F.max("t").alias("t"))
        words = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(WORDS), F.lit(0))
        self.words = self.scratch.save(spread(docs, "d").select("d", words.alias("words")))
        counted = self.words.select("words").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        path = os.path.join(VOCABULARIES, vocabulary + ".tiktoken")
        rank = F.floor(F.log2("n") * 8).cast("int").alias("rank")
        self.distinct = self.scratch.save(counted.mapInArrow(_encoder(path), "word string, n long, ids array<int>").select("word", "ids", rank))
        classes = self.distinct.groupBy("rank").agg(F.sum(F.octet_length("word") + F.size("ids") * 4 + 8).alias("bytes"))
        bar = None  # at most some 400 classes
        for r in sorted(classes.collect(), key=lambda r: -r["rank"]):
            hot_bytes -= r["bytes"]
            if hot_bytes < 0:
                break
            bar = r["rank"]
        is_hot = F.lit(False) if bar is None else F.col("rank") >= bar
        self.hot = self.distinct.where(is_hot).select("word", "ids").toArrow().combine_chunks()
        self.cold = self.distinct.where(~is_hot).select("word", "ids")
        self.has_cold = not self.cold.isEmpty()

    def shared(self):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.hot.schema) as w:
            w.write_table(self.hot)
        return self.spark.sparkContext.broadcast(sink.getvalue().to_pybytes())  # at most hot_bytes and some 20 more a word


def _hot(shared) -> tuple[pa.Array, pa.Array, np.ndarray]:
    t = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    ids = one(t["ids"])
    return one(t["word"]), ids, pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)


def _lengths(words: pa.Array, hot: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The row of the hot table for each word (null for a cold one), which are cold, and how many ids each hot one brings."""
    if not len(hot):
        return pa.nulls(len(words), pa.int32()), np.ones(len(words), bool), np.zeros(len(words), np.int64)
    at = pc.index_in(words, value_set=hot)
    cold = pc.is_null(at).to_numpy(zero_copy_only=False)
    n = np.where(cold, 0, sizes[pc.fill_null(at, 0).to_numpy()])
    return at, cold, n


COLD = "cold array<struct<pos: int, after: int, word: string>>"


def _place_ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, ids, sizes = _hot(shared)
        for b in batches:
            for part, words, ends in _pieces(b, "words"):
                at, cold, n = _lengths(words, hot, sizes)
                made = np.concatenate([[0], np.cumsum(n)])
                starts = np.concatenate([[0], ends])
                values = ids.take(at.drop_null()).flatten() if len(hot) else pa.array([], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(made[starts].astype(np.int32)), values)
                where = np.flatnonzero(cold)
                row = np.searchsorted(ends, where, side="right")
                rest = pa.StructArray.from_arrays([pa.array((where - starts[row]).astype(np.int32)), pa.array((made[where] - made[starts[row]]).astype(np.int32)), words.take(pa.array(where))], names=["pos", "after", "word"])
                cuts = np.searchsorted(where, starts)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("d")), lists, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), rest)], names=["d", "ids", "cold"])

    return run


def encode(documents: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", hot_bytes: int = 8 << 20) -> DataFrame:
    """`id, ids`: the token ids (ARRAY<INT>) of every text, without special tokens; their names in a text are ordinary text.

    A null or an empty text has an empty list. Rows with a null id are left out; of repeated ids the greatest text
    holds. Other columns are not read. `hot_bytes`: bound of the table of frequent words that is broadcast.
    """
    e = Encoded(documents, id, text, vocabulary, hot_bytes)
    kind = documents.schema[id].dataType.simpleString()
    near = e.words.mapInArrow(_place_ids(e.shared()), f"d {kind}, ids array<int>, {COLD}")
    if not e.has_cold:
        return near.select(F.col("d").alias(id), "ids")
    near = e.scratch.save(near)
    whole = near.where(F.size("cold") == 0).select("d", "ids")
    far = near.select("d", F.inline("cold")).join(e.cold.withColumnRenamed("ids", "x"), "word").groupBy("d").agg(F.array_sort(F.collect_list(F.struct("pos", "after", "x"))).alias("far"))
    both = near.where(F.size("cold") > 0).select("d", "ids").join(far, "d")
    before = lambda k: F.when(k == 0, 0).otherwise(F.get("far", k - 1)["after"])
    mixed = F.flatten(F.transform("far", lambda c, k: F.concat(F.slice("ids", before(k) + 1, c["after"] - before(k)), c["x"])))
    last = F.element_at("far", -1)["after"]
    mixed = F.concat(mixed, F.slice("ids", last + 1, F.size("ids") - last))
    return whole.unionByName(both.select("d", mixed.alias("ids"))).withColumnRenamed("d", id)


def _number_ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, _, sizes = _hot(shared)
        for b in batches:
            for part, words, ends in _pieces(b, "words"):
                _, cold, n = _lengths(words, hot, sizes)
                made = np.concatenate([[0], np.cumsum(n)])
                starts = np.concatenate([[0], ends])
                cuts = np.searchsorted(np.flatnonzero(cold), starts)
                rest = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), words.filter(pa.array(cold)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("d")), pa.array(np.diff(made[starts])), rest], names=["d", "n", "cold"])

    return run


def token_counts(documents: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", hot_bytes: int = 8 << 20) -> DataFrame:
    """`id, n_tokens` of every text, by the same table of words; 0 for a null or an empty text."""
    e = Encoded(documents, id, text, vocabulary, hot_bytes)
    kind = documents.schema[id].dataType.simpleString()
    near = e.words.mapInArrow(_number_ids(e.shared()), f"d {kind}, n long, cold array<string>")
    if not e.has_cold:
        return near.select(F.col("d").alias(id), F.col("n").alias("n_tokens"))
    near = e.scratch.save(near)
    far = near.select("d", F.explode("cold").alias("word")).join(e.cold.select("word", F.size("ids").cast("long").alias("x")), "word").groupBy("d").agg(F.sum("x").alias("x"))
    return near.select("d", "n").join(far, "d", "left").select(F.col("d").alias(id), (F.col("n") + F.coalesce("x", F.lit(0))).alias("n_tokens"))


def decode(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """`id, text` from ids, by a join with the pieces (as many rows as the vocabulary has, so broadcast); '' for an empty or null list.

    An id that the vocabulary hasn't is an error (a failed assertion); bytes that are no UTF-8 become U+FFFD.
    """
    spark = encoded.sparkSession
    rows = [(i, piece.hex()) for piece, i in ranks(os.path.join(VOCABULARIES, vocabulary + ".tiktoken")).items()]
    pieces = F.broadcast(spark.createDataFrame(rows, "i int, piece string"))
    one = encoded.where(F.col(id).isNotNull()).select(F.col(id).alias("d"), F.col(ids).alias("l")).repartition("d").select("d", F.posexplode_outer("l").alias("pos", "i")).join(pieces, "i", "left")
    good = F.when(F.col("i").isNotNull(), F.coalesce("piece", F.raise_error(F.lit("an id outside the vocabulary"))))
    joined = one.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("pos", good.alias("p")))).alias("l"))
    text = F.decode(F.unhex(F.array_join(F.transform("l", lambda s: F.coalesce(s["p"], F.lit(""))), "")), "UTF-8")
    return joined.select(F.col("d").alias(id), text.alias("text"))
