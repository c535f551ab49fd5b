"""Whole-corpus n-gram model as a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from mercato.llm.common import Stored, whole

#: Tokens after which a task starts a new block, and n-grams that one counting group holds on average; both bound the memory of a task.
BLOCK_TOKENS, GROUP_KEYS = 1 << 20, 1 << 21
#: Common words that have a short number in every block (two are the marks), of each block's SENT most frequent ones. They shorten what is
#: sent, nothing else: any other word is named by its hash.
NUMBERED, SENT = 1 << 16, 1 << 12
#: Bits of such a number; n-grams whose numbers do not fit a key are named by hash.
NUMBER_BITS = 16


class Strengths(dict):
    """Strength of the shorter context in the smoothed probability, by order of the n-gram; from order 4 on that of order 3."""

    def __missing__(self, n: int) -> float:
        return self[3]


STRENGTH = Strengths({2: 200.0, 3: 50.0})
#: Local numbers of the two marks: a text's start (a state, never a token) and its end (a token).
START, END = 0, 1


class Numbers(dict):
    """Words of one block to local numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


def words(text: str) -> list[bytes]:
    """Lower-cased words; the methods of bytes fold A-Z and cut at ASCII white space alone."""
    return text.encode().lower().split()


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane, compressed; as many planes as the largest needs, whose number comes first."""
    import zstandard

    wide = numbers.astype("<u8")
    width = max(1, -(-int(wide.max(initial=0)).bit_length() // 8))
    planes = wide.view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    width = packed[0]
    planes = np.frombuffer(zstandard.decompress(packed[1:]), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<i8").reshape(-1)


def pack_ascending(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, whose high bytes are mostly zero."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_ascending(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed).view(np.uint64), dtype=np.uint64)


def hashes(vocabulary: Numbers) -> np.ndarray:
    """A 64-bit hash for each local number; the marks have fixed ones."""
    import xxhash

    found = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in vocabulary), np.uint64, len(vocabulary))
    return np.concatenate([np.array([0x5354415254, 0x454E44], np.uint64), found])


def encode(docs: DataFrame, training: Column, stored: Stored, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of whole documents as numbers, stored so that later passes see the same blocks.

    Each task numbers the words of its rows and starts a new block after ``BLOCK_TOKENS`` tokens. Nothing shuffles.
    """
    rows = docs.select(F.col(key).alias("id"), whole(text).alias("text"), training.alias("training"))
    schema = StructType(
        [
            StructField("block", StringType()),
            StructField("ids", ArrayType(rows.schema["id"].dataType)),
            StructField("training", ArrayType(BooleanType())),
            StructField("sizes", BinaryType()),
            StructField("tokens", BinaryType()),
            StructField("words", BinaryType()),
            StructField("n_training", LongType()),
            StructField("n_tokens", LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, training_, pieces, size, vocabulary = [], [], [], 0, Numbers()

        def block() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in pieces])
            learnt = int(((sizes - 1) * np.array(training_)).sum())
            values = [
                [f"{task}-{number}"],
                [pa.concat_arrays(ids)],
                [training_],
                [pack(sizes)],
                [pack(np.concatenate(pieces))],
                [hashes(vocabulary).tobytes()],
                [learnt],
                [int((sizes - 1).sum())],
            ]
            kinds = [f.type for f in arrow]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema(
                    [
                        ("block", pa.string()),
                        ("ids", pa.list_(batch.schema.field("id").type)),
                        ("training", pa.list_(pa.bool_())),
                        ("sizes", pa.binary()),
                        ("tokens", pa.binary()),
                        ("words", pa.binary()),
                        ("n_training", pa.int64()),
                        ("n_tokens", pa.int64()),
                    ]
                )
            for at, (value, learnt) in enumerate(zip(batch.column("text"), batch.column("training"), strict=True)):
                listed = words(value.as_py())
                piece = np.empty(len(listed) + 2, np.uint32)
                piece[0], piece[-1] = START, END
                piece[1:-1] = np.fromiter(map(vocabulary.__getitem__, listed), np.uint32, len(listed))
                ids.append(batch.column("id").slice(at, 1))
                training_.append(bool(learnt.as_py()))
                pieces.append(piece)
                size += len(piece)
                if size >= BLOCK_TOKENS:
                    yield block()
                    number += 1
                    ids, training_, pieces, size, vocabulary = [], [], [], 0, Numbers()
        if pieces:
            yield block()

    return stored.save(rows.mapInArrow(run, schema))


def common_words(blocks: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, at most NUMBERED less the marks, most frequent first.

    Every block sends the counts of its SENT most frequent words, which are added up; what reaches the driver is bounded by NUMBERED.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, vocabulary in zip(batch.column("tokens"), batch.column("words"), strict=True):
                known = np.frombuffer(vocabulary.as_py(), np.uint64)
                counts = np.bincount(unpack(tokens.as_py()), minlength=len(known))
                counts[:2] = 0
                top = np.argsort(-counts, kind="stable")[:SENT]
                top = top[counts[top] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(known[top].view(np.int64)), pa.array(counts[top])], names=["word", "n"])

    totals = blocks.select("tokens", "words").mapInArrow(send, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "word").limit(NUMBERED - 2).select("word").collect()
    return np.array([r["word"] for r in top], np.int64).view(np.uint64)


class Grams:
    """The n-grams of one block, by order: which one ends at each token, its key, and how often training texts have it.

    The key of an n-gram of common words is made of their numbers, so that ascending keys differ by little; any other has a hash with the
    highest bit set.
    """

    def __init__(self, sizes: bytes, tokens: bytes, vocabulary: bytes, training: list[bool], order: int, common: np.ndarray):
        self.sizes = unpack(sizes)
        self.tokens = unpack(tokens)
        begins = np.cumsum(self.sizes) - self.sizes
        self.depth = np.arange(len(self.tokens)) - np.repeat(begins, self.sizes)
        learnt = np.repeat(np.array(training, dtype=bool), self.sizes)
        base = np.frombuffer(vocabulary, np.uint64)
        #: For each order, the local n-gram that ends at each position; positions nearer to the start have none.
        self.at, self.keys, self.counts = {1: self.tokens}, {1: base}, {}
        self.word_numbers = numbered(base, common)
        names, number = base, self.word_numbers
        is_token = self.depth > 0
        self.counts[1] = np.bincount(self.tokens[is_token & learnt], minlength=len(base))
        for n in range(2, order + 1):
            ends = np.flatnonzero(self.depth >= n - 1)
            pairs = self.at[n - 1][ends - 1] * len(base) + self.tokens[ends]
            known, inverse = np.unique(pairs, return_inverse=True)
            index = np.zeros(len(self.tokens), np.int64)
            index[ends] = inverse
            self.at[n] = index
            self.counts[n] = np.bincount(inverse[learnt[ends]], minlength=len(known))
            context, word = known // len(base), known % len(base)
            names = mixed(names[context], base[word], n)
            both = (number[context] >= 0) & (self.word_numbers[word] >= 0) & (n * NUMBER_BITS < 63)
            number = np.where(both, number[context] << NUMBER_BITS | self.word_numbers[word], -1)
            self.keys[n] = np.where(both, number.view(np.uint64), names | np.uint64(1 << 63))


def mixed(context: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of an n-gram from those of its context and its last word."""
    with np.errstate(over="ignore"):
        z = context * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(order)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def numbered(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Numbers of the marks and the common words among a block's words, -1 for others."""
    found = np.full(len(words), -1, np.int64)
    found[:2] = START, END
    if len(common) and len(words) > 2:
        by = np.argsort(common)
        at = np.minimum(np.searchsorted(common[by], words[2:]), len(common) - 1)
        found[2:] = np.where(common[by][at] == words[2:], by[at] + 2, -1)
    return found


def grouped(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where each group's keys begin and end in it: ascending within a group, which is a range of hashes.

    N-grams of common words are hashed without the last word: those of one context, at most NUMBERED, stay together and differ by little.
    """
    context = np.where(keys >> np.uint64(63) > 0, keys, keys >> np.uint64(NUMBER_BITS))
    group = (mixed(context, np.uint64(0), 0) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    order = np.lexsort((keys, group))
    return order, np.searchsorted(group[order], np.arange(groups + 1, dtype=np.uint64))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For each list of keys their totals over all lists, and how many keys have a total above 0."""
    known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(known), np.int64)
    np.add.at(sums, inverse, np.concatenate(counts))
    ends = np.cumsum([len(k) for k in keys])
    return [sums[inverse[end - len(k) : end]] for k, end in zip(keys, ends, strict=True)], int((sums > 0).sum())


def count(blocks: DataFrame, order: int, groups: int, common: np.ndarray, stored: Stored) -> DataFrame:
    """Training counts of every n-gram of every block, over all blocks.

    A block sends each of its distinct n-grams once, with its own count, in one chunk per range of hashes. The task of a range sums the chunks
    and answers each with the totals in its order; a range holds an even share of the distinct n-grams, however frequent one is. A row
    without a block has the number of distinct training n-grams of its range.
    """
    chunk = "part int, n int, block string, keys binary, counts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row["sizes"], row["tokens"], row["words"], row["training"], order, common)
                for n in range(1, order + 1):
                    keys, counts = grams.keys[n], grams.counts[n]
                    by, edges = grouped(keys, groups)
                    parts = [by[edges[g] : edges[g + 1]] for g in range(groups)]
                    full = [g for g in range(groups) if len(parts[g])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int32()),
                            pa.array([n] * len(full), pa.int32()),
                            pa.array([row["block"]] * len(full), pa.string()),
                            pa.array([pack_ascending(keys[parts[g]]) for g in full], pa.binary()),
                            pa.array([pack(counts[parts[g]]) for g in full], pa.binary()),
                        ],
                        names=["part", "n", "block", "keys", "counts"],
                    )

    def total(chunks: pa.Table) -> pa.Table:
        rows = chunks.to_pylist()
        answers, types = summed([unpack_ascending(r["keys"]) for r in rows], [unpack(r["counts"]) for r in rows])
        one = rows[0]
        return pa.table(
            {
                "block": pa.array([*(r["block"] for r in rows), None], pa.string()),
                "n": pa.array([one["n"]] * (len(rows) + 1), pa.int32()),
                "part": pa.array([one["part"]] * (len(rows) + 1), pa.int32()),
                "totals": pa.array([*map(pack, answers), None], pa.binary()),
                "types": pa.array([None] * len(rows) + [types], pa.int64()),
            }
        )

    sent = blocks.select("block", "sizes", "tokens", "words", "training").mapInArrow(send, chunk)
    answered = sent.groupBy("n", "part").applyInArrow(total, "block string, n int, part int, totals binary, types long")
    return stored.save(answered)


def follow(
    grams: Grams, totals: dict[int, np.ndarray], order: int, n_training: int, n_types: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 probability of each token by the automaton, its base probability, and whether it is known.

    States are the contexts that training texts have; an arc is an n-gram they have, with weight log p. The state before a token is its
    longest known context. Without an arc for the token, the failure arc leads to the next shorter context at the cost
    log(strength / (context count + strength)), down to the words themselves, which every token has an arc from. All texts of the block are
    followed from left to right at once, one array element per token.
    """
    is_token = grams.depth > 0
    unigram = totals[1]
    word_count = unigram[grams.tokens]
    base = np.log10((word_count + 1.0) / (n_training + n_types + 1.0))
    score = base.copy()
    # A start mark precedes as many texts as there are end marks.
    context_count = np.where(grams.tokens == START, unigram[END], word_count)
    for n in range(2, order + 1):
        ends = np.flatnonzero(grams.depth >= n - 1)
        before = context_count[ends - 1].astype(float)
        seen = totals[n][grams.at[n][ends]].astype(float)
        strength = STRENGTH[n]
        shorter = score[ends]
        arc = np.log10(seen + strength * 10.0**shorter) - np.log10(before + strength)
        failure = np.log10(strength / (before + strength)) + shorter
        score[ends] = np.where(before > 0, np.where(seen > 0, arc, failure), shorter)
        context_count = np.zeros(len(grams.tokens), np.int64)
        context_count[ends] = totals[n][grams.at[n][ends]]
    return score, base, is_token & (word_count > 0)


def score(docs: DataFrame, training: Column, order: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, training, n_tokens, n_known, train_tokens, base_score, score.

    The n-grams of ``order`` and below are counted over all training texts, none left out, and smoothed as
    p(w | h) = (c(hw) + strength * p(w | shorter h)) / (c(h) + strength), which sums to one; single words have the base probability. The model is
    never gathered in one place: a block of texts receives the totals of its own n-grams and follows the automaton with them.

    Cases: null and empty texts are one end mark; a null id belongs to the texts that ``training`` says; rows that repeat an id are texts
    of their own; without training texts every token has probability 1. No rows in, no rows out. Only the id and the text are read.
    """
    stored = Stored(docs.sparkSession)
    blocks = encode(docs, training, stored, text, key)
    sums = blocks.agg(F.sum("n_training").alias("n"), F.sum("n_tokens").alias("all")).first()
    n_training, n_tokens = sums["n"] or 0, sums["all"] or 0
    groups = max(16, -(-n_tokens // GROUP_KEYS))
    common = common_words(blocks)
    answers = count(blocks, order, groups, common, stored)
    n_types = answers.where("n = 1").agg(F.sum("types")).first()[0] or 0

    result = StructType(
        [
            StructField(key, blocks.schema["ids"].dataType.elementType),
            StructField("training", BooleanType()),
            StructField("n_tokens", LongType()),
            StructField("n_known", LongType()),
            StructField("base_score", DoubleType()),
            StructField("score", DoubleType()),
        ]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = Grams(row["sizes"], row["tokens"], row["words"], row["training"], order, common)
        totals = {n: np.zeros(len(grams.keys[n]), np.int64) for n in range(1, order + 1)}
        places = {n: grouped(grams.keys[n], groups) for n in range(1, order + 1)}
        for answer in right.to_pylist():
            by, edges = places[answer["n"]]
            part = answer["part"]
            totals[answer["n"]][by[edges[part] : edges[part + 1]]] = unpack(answer["totals"])
        scored, base, known = follow(grams, totals, order, n_training, n_types)
        begins = np.cumsum(grams.sizes) - grams.sizes
        scored[begins] = base[begins] = 0.0
        ids = left.column("ids").combine_chunks()
        return pa.table(
            {
                key: ids.chunk(0).flatten() if isinstance(ids, pa.ChunkedArray) else ids.flatten(),
                "training": pa.array(row["training"], pa.bool_()),
                "n_tokens": pa.array(grams.sizes - 1, pa.int64()),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), begins), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, begins)),
                "score": pa.array(np.add.reduceat(scored, begins)),
            }
        )

    needed = blocks.select("block", "ids", "training", "sizes", "tokens", "words").groupBy("block")
    to_blocks = answers.where("block is not null").select("block", "n", "part", "totals").groupBy("block")
    return (
        needed.cogroup(to_blocks).applyInArrow(run, result).withColumn("train_tokens", F.lit(n_training).cast("long"))
    )
