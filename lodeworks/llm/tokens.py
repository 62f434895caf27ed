"""Encoding texts by a public byte-level BPE, through a table of distinct words.

Texts are split into words in Spark; each distinct word is encoded once and the word table is written to the shared
folder. The most frequent words, a fixed number, go to every task as a dictionary; the other words of a document are
joined with the table by word, and their ids go back to their positions. Decoding joins ids with the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.shared import settle

# Fixed value: the pattern that splits text before the merges, for Java and for the encoder.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
JAVA_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{IsWhite_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{IsWhite_Space})").replace(r"\s+", r"\p{IsWhite_Space}+")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of at most WORD_BYTES bytes, so many, form the dictionary that every task gets: 65,536 * 128 bytes and at most as many ids.
HEAD_WORDS, WORD_BYTES = 65_536, 128


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and their ranks of a rank file, which is under 1 MB."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_of(text: Column) -> Column:
    """The words of a text, which put together are the text."""
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


def spread(df: DataFrame, by: str) -> DataFrame:
    """At least as many partitions as there are cores, for tables of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, by)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what Python makes of long texts stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def word_table(texts: DataFrame, column: str, ranks: dict[bytes, int]) -> DataFrame:
    """(word, n, ids) of each distinct word of the texts with the number of times it occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    counted = texts.select(F.explode(words_of(F.col(f"`{column}`"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return settle(counted.mapInArrow(encode, "word string, n bigint, ids array<int>"), "words")


def _head(table: DataFrame) -> tuple[pa.Array, pa.Array]:
    """The most frequent short words and their ids: at most HEAD_WORDS of WORD_BYTES bytes each."""
    rows = table.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD_WORDS).select("word", "ids").toArrow()
    return rows["word"].combine_chunks().cast(pa.string()), rows["ids"].combine_chunks()


def encoded(docs: DataFrame, id_column: str, text_column: str, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(id, ids) of each row: the ids of its text, without special tokens; such tokens' strings are ordinary text.

    Empty and null texts give an empty list; blank texts have ids. Ids must be unique; rows with a null id are left out,
    as nothing could be said of them. An empty table gives no rows. Other columns play no part. Very long texts and words
    are encoded whole.

    Scale: texts are not shuffled. The count of words combines on the map side; only words outside the dictionary, few
    by Zipf's law, are shuffled, once by word and once by document, and no frequent word is among them.
    """
    spark = docs.sparkSession
    ranks = vocabulary(vocabulary_path)
    texts = spread(docs.select(F.col(f"`{id_column}`").alias("d"), F.col(f"`{text_column}`").alias("t")).where("d is not null"), "d")
    table = word_table(texts, "t", ranks)
    shared = spark.sparkContext.broadcast(tuple(map(_pickled, _head(table))))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = map(_unpickled, shared.value)
        for b in slices(batches, 2048):
            yield _runs(b["d"], b["w"], words, ids)

    part = "array<struct<p: int, i: array<int>>>"
    kind = docs.schema[id_column].dataType.simpleString()
    looked = texts.select("d", F.coalesce(words_of(F.col("t")), F.array().cast("array<string>")).alias("w")).mapInArrow(look_up, f"d {kind}, runs {part}, tail array<struct<p: int, w: string>>")
    looked = settle(looked, "looked")
    rare = looked.select("d", F.explode("tail").alias("x")).select("d", "x.p", F.col("x.w").alias("word"))
    found = rare.join(table.select("word", "ids"), "word").groupBy("d").agg(F.collect_list(F.struct("p", F.col("ids").alias("i"))).alias("more"))
    whole = looked.select("d", "runs").join(found, "d", "left")
    parts = F.when(F.col("more").isNull(), F.col("runs")).otherwise(F.array_sort(F.concat("runs", "more")))
    return whole.select(F.col("d").alias(id_column), F.flatten(F.transform(parts, lambda x: x["i"])).alias("ids"))


def _pickled(a: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", a.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([a], names=["x"]))
    return sink.getvalue().to_pybytes()


def _unpickled(b: bytes) -> pa.Array:
    return pa.ipc.open_stream(b).read_all()["x"].combine_chunks()


def _runs(d: pa.Array, lists: pa.ListArray, words: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
    """Of each document: runs of ids of dictionary words between the others, by position, and the other words."""
    offsets = lists.offsets.to_numpy().astype(np.int64)  # of a slice, these don't begin at 0
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    at = pc.index_in(flat.cast(pa.string()), value_set=words)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    code = at.fill_null(0).to_numpy(zero_copy_only=False)
    n = len(flat)
    doc = np.repeat(np.arange(len(d)), np.diff(offsets))
    pos = np.arange(n) - offsets[:-1][doc]
    # ids of the known words, one after the other
    starts = ids.offsets.to_numpy().astype(np.int64)
    size = np.where(known, (starts[1:] - starts[:-1])[code] if len(words) else 0, 0)
    ends = np.cumsum(size)
    total = int(ends[-1]) if n else 0
    source = np.repeat((starts[:-1][code] if len(words) else np.zeros(n, np.int64)) - (ends - size), size) + np.arange(total)
    values = ids.values.to_numpy()[source] if total else np.empty(0, np.int32)
    # a run begins where a known word follows another document or an unknown word
    first = known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])[:n]
    begin = np.flatnonzero(first)
    run_offsets = np.append((ends - size)[begin], total).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(pos[begin].astype(np.int32)), pa.ListArray.from_arrays(pa.array(run_offsets), pa.array(values.astype(np.int32)))], names=["p", "i"])
    rest = np.flatnonzero(~known)
    tail = pa.StructArray.from_arrays([pa.array(pos[rest].astype(np.int32)), flat.take(pa.array(rest)).cast(pa.string())], names=["p", "w"])
    edges = np.arange(len(d) + 1)
    lists_of = lambda which, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[which], edges).astype(np.int32)), values)
    return pa.RecordBatch.from_arrays([d, lists_of(begin, runs), lists_of(rest, tail)], names=["d", "runs", "tail"])


def pieces_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(id, piece) of the vocabulary, pieces as hexadecimal digits."""
    return spark.createDataFrame([(i, p.hex().upper()) for p, i in ranks.items()], "id int, piece string")


def decoded(coded: DataFrame, id_column: str, ids_column: str = "ids", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(id, text) of each row of ids. An empty list gives an empty text, a null list a null text; unknown ids are dropped.

    The vocabulary, 50,257 rows at most, is the broadcast side of the join. Pieces meet by document after a partial
    collection in the task that exploded them.
    """
    pieces = F.broadcast(pieces_table(coded.sparkSession, vocabulary(vocabulary_path)))
    ids = coded.select(F.col(f"`{id_column}`").alias("d"), F.posexplode(F.col(f"`{ids_column}`")).alias("p", "id"))
    texts = ids.join(pieces, "id").groupBy("d").agg(F.array_sort(F.collect_list(F.struct("p", "piece"))).alias("x")).select("d", F.decode(F.unhex(F.array_join(F.col("x.piece"), "")), "UTF-8").alias("text"))
    base = coded.select(F.col(f"`{id_column}`").alias("d"), F.col(f"`{ids_column}`").isNull().alias("none"))
    return base.join(texts, "d", "left").select(F.col("d").alias(id_column), F.when(~F.col("none"), F.coalesce("text", F.lit(""))).alias("text"))
