"""Token counts through a digest cache.

A text is normalised (line ends to newlines, canonical composition, outer white space off) and named by the SHA-256 of the result; a
tokenizer by the SHA-256 of its version, its pattern and its vocabulary file. The cache is a Parquet table of (content,
tokenizer, n_tokens). Counting joins the digests of the rows to it; what is missing is encoded once per digest and
appended, and a second join gives each row its count.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import materialize

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Raise it when normalisation or encoding changes: counts of other versions are then no hits.
VERSION = "1"
CACHE = "content binary, tokenizer string, n_tokens long"


def normalise(text: str) -> str:
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


@lru_cache(maxsize=4)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_digest(vocabulary: str, version: str = VERSION) -> str:
    with open(vocabulary, "rb") as f:
        return hashlib.sha256(version.encode() + b"\0" + PATTERN.encode() + b"\0" + f.read()).hexdigest()


def count_one(text: str, vocabulary: str) -> int:
    """Tokens of one normalised text; strings of special tokens are ordinary text."""
    return len(_encoding(vocabulary).encode_ordinary(text))


def _digests(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, content), with ``texts`` also the normalised text, compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            content, packed = [], []
            for t in batch.column(1).to_pylist():
                raw = None if t is None else normalise(t).encode("utf-8")
                content.append(None if raw is None else hashlib.sha256(raw).digest())
                if texts:
                    packed.append(None if raw is None else pack(raw))
            columns = {"doc_id": batch.column(0), "content": pa.array(content, pa.binary())} | ({"packed": pa.array(packed, pa.binary())} if texts else {})
            yield pa.RecordBatch.from_pydict(columns)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; an empty one where there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, cache: str, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, cached) for every row of ``docs``; ``cached``: its count was in the table at ``cache`` before.

    Null text: n_tokens and cached are null. Empty and blank texts have no tokens. Repeated rows and texts that are equal
    once normalised are encoded once and reported each. Other columns are not read. Texts are encoded whole. Where two
    writers appended the same digest, it counts once. An empty table gives an empty table.
    """
    spark, tokenizer = docs.sparkSession, tokenizer_digest(vocabulary)
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = materialize(some.mapInArrow(lambda it: _digests(it, False), "doc_id long, content binary"), "digests")
    packed = some.where("text is not null").mapInArrow(lambda it: _digests(it, True), "doc_id long, content binary, packed binary")

    def known() -> DataFrame:
        # A count is a function of the two digests, so any of repeated entries will do.
        return read_cache(spark, cache).where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))

    before = known()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            counts = [count_one(unpack(b).decode("utf-8"), vocabulary) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    # Digests are cheap to make twice; texts kept in a table as well as in the shuffle would take twice the disk.
    misses = packed.select("content", "packed").join(before, "content", "left_anti").dropDuplicates(["content"])
    counted = misses.mapInArrow(encode, "content binary, n_tokens long")
    fresh_counts = materialize(counted, "counted")
    fresh_counts.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    new = fresh_counts.select("content", F.lit(True).alias("new"))
    found = rows.select("doc_id", "content").join(known(), "content", "left").join(new, "content", "left")
    return found.select("doc_id", "n_tokens", F.when(F.col("content").isNotNull(), F.col("new").isNull()).alias("cached"))
