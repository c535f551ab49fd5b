"""Token totals, quantiles and truncated totals from an exact histogram of encoded lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import whole

#: Byte-level BPE vocabulary of a public tokenizer; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer cuts a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary larger than this is refused, which bounds what is broadcast.
VOCABULARY_BYTES = 64 << 20
#: Lengths are summed in spans of this many lengths, then over the spans.
SPAN = 4096


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of base64 tokens, read once on the driver."""
    with open(path, "rb") as file:
        content = file.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class PieceCounter(dict):
    """Tokens of a piece; pieces are merged on their own, so each distinct one is encoded once. Emptied at a million pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        super().__init__()
        self.cut = regex.compile(PIECES).findall
        self.encoding = tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        count = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = count
        return count

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.cut(text)))


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The id and encoded length (``tokens``) of every row; null and empty texts have length 0."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = docs.select(F.col(key), whole(text).alias("text"))
    schema = rows.select(key).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "tokens"])

    return rows.mapInArrow(run, schema)


def histogram(counted: DataFrame) -> DataFrame:
    """One row per length that occurs: ``length``, ``documents``."""
    return counted.groupBy(F.col("tokens").alias("length")).agg(F.count("*").alias("documents"))


def suffix_sums(lengths_: DataFrame) -> DataFrame:
    """The histogram with what answers every context limit.

    ``docs_from`` and ``tokens_from`` are the documents of at least this length and their tokens; ``docs_to`` those up to it;
    ``truncated_total`` the tokens left if every document is cut at this length. Sums run within spans of lengths and then over the spans'
    totals, so no task sorts the whole histogram.
    """
    rows = lengths_.withColumn("__span", F.floor(F.col("length") / SPAN)).withColumn(
        "__tokens", F.col("length") * F.col("documents")
    )
    later = Window.orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("__span").agg(F.sum("documents").alias("__d"), F.sum("__tokens").alias("__t"))
    all_docs, all_tokens = (F.sum(c).over(Window.partitionBy()) for c in ("__d", "__t"))
    above = spans.select(
        "__span",
        F.coalesce(F.sum("__d").over(later), F.lit(0)).alias("__docs_above"),
        F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__tokens_above"),
        all_docs.alias("total_documents"),
        all_tokens.alias("total_tokens"),
    )
    here = Window.partitionBy("__span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("docs_from", F.sum("documents").over(here))
        .withColumn("tokens_from", F.sum("__tokens").over(here))
        .join(above, "__span")
        .withColumn("docs_from", F.col("docs_from") + F.col("__docs_above"))
        .withColumn("tokens_from", F.col("tokens_from") + F.col("__tokens_above"))
        .withColumn("docs_to", F.col("total_documents") - F.col("docs_from") + F.col("documents"))
        .withColumn(
            "truncated_total",
            F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from"),
        )
        .select(
            "length", "documents", "docs_from", "tokens_from", "docs_to", "truncated_total", "total_documents", "total_tokens"
        )
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit, present in the histogram or not: documents cut, and tokens left."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    longer = F.when(F.col("length") > F.col("context"), F.struct("length", "docs_from", "tokens_from"))
    # The limits are an argument of bounded size; each row of the histogram meets every limit.
    met = sums.withColumn("context", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    found = met.groupBy("context").agg(F.min(longer).alias("next"), F.max("total_tokens").alias("total_tokens"))
    return asked.join(found, "context", "left").select(
        "context",
        F.coalesce("next.docs_from", F.lit(0)).alias("documents_cut"),
        (
            F.coalesce("total_tokens", F.lit(0))
            - F.coalesce("next.tokens_from", F.lit(0))
            + F.col("context") * F.coalesce("next.docs_from", F.lit(0))
        ).alias("tokens"),
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share in (0, 1], the smallest length that at least this share of the documents does not exceed."""
    met = sums.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    return met.where(F.col("docs_to") >= F.col("share") * F.col("total_documents")).groupBy("share").agg(
        F.min("length").alias("length")
    )
