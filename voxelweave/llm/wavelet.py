"""Token ids as wavelet matrices, one compressed file for each shard.

Documents are dealt into ranges of ascending id, one for each shard. A shard's
ids lie in a wavelet matrix: one bit-plane for each bit of an id, from the
highest, each ordered by the planes above it. With counts of ones at every 512
bits it gives access to a token, counting of an id in a range, and the places of
an id, all without unpacking the ids. The file of a shard is a Parquet file of
one row with the compressed planes, the counts, the document ids and lengths.

Ids of words are found with the tokenizer itself; since white space ends a word
in these vocabularies (lower case, white space dropped), a worker remembers the
ids of words it has met.

Defined cases: a null text counts as empty and holds the end id only; a null
document id comes first; documents that repeat an id stand together, in order of
hashes of their texts; an empty table gives no file and no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.words import Memory, for_texts, slices
from voxelweave.session import new_path, ship_package

SHARD_BYTES = 24 << 20
BLOCK = 512
END = 2
LATIN = "\u024f"  # the last letter of the Latin blocks without combining forms
MIXED = "[\u0130\u0300-\u036f]"  # changes what comes before or after it when lowered or composed
CUT = r"([A-Za-zÀ-ÖØ-öø-ɏ])([!-&(-/:-@\[-`{-~])"  # a Latin letter, then a mark other than the apostrophe


class WaveletMatrix:
    """Ids below ``2 ** levels`` with rank and select on every bit-plane."""

    def __init__(self, n: int, words: list[np.ndarray], blocks: list[np.ndarray], zeros: list[int]):
        self.n, self.words, self.blocks, self.zeros = n, words, blocks, zeros
        self._ones: list[np.ndarray | None] = [None] * len(words)

    @staticmethod
    def build(ids: np.ndarray, levels: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        words, blocks, zeros = [], [], []
        for level in range(levels):
            bit = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            room = np.zeros(-(-len(ids) // BLOCK) * (BLOCK // 8), dtype=np.uint8)
            room[:len(packed)] = packed
            plane = room.view("<u8")
            each = np.bitwise_count(plane).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            words.append(plane)
            blocks.append((np.cumsum(each, dtype=np.uint32) - each).astype(np.uint32))
            low = now.take(np.flatnonzero(~bit))
            zeros.append(len(low))
            now = np.concatenate([low, now.take(np.flatnonzero(bit))])
        return WaveletMatrix(len(ids), words, blocks, zeros)

    def _before(self, level: int) -> np.ndarray:
        """Ones before every word of a plane."""
        if self._ones[level] is None:
            each = np.bitwise_count(self.words[level]).reshape(-1, BLOCK // 64).astype(np.uint32)
            self._ones[level] = (self.blocks[level][:, None] + np.cumsum(each, axis=1, dtype=np.uint32) - each).ravel()
        return self._ones[level]

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position (0 to n)."""
        at = np.asarray(at, dtype=np.int64)
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        words, before = self.words[level], self._before(level)
        past = word >= len(words)
        safe = np.where(past, 0, word)
        low = words[safe] & ((np.uint64(1) << inside) - np.uint64(1))
        total = int(before[-1]) + int(np.bitwise_count(words[-1])) if len(words) else 0
        return np.where(past, total, before[safe] + np.bitwise_count(low).astype(np.int64)) if len(words) else np.zeros_like(at)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        for level, words in enumerate(self.words):
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self.ones(level, at)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of an id in [low, high) stand after the last plane."""
        if token >> len(self.words):
            return 0, 0
        for level in range(len(self.words)):
            a, b = self.ones(level, np.array([low, high])).tolist()
            if token >> (len(self.words) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs in [low, high)."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def places(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """The positions of an id in [low, high), ascending: select, from the last plane up."""
        a, b = self._range(token, low, self.n if high is None else high)
        at = np.arange(a, b, dtype=np.int64)
        for level in reversed(range(len(self.words))):
            one = token >> (len(self.words) - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Position of the nth (from 0) one or zero of a plane."""
        before = self._before(level).astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * 64 - before
        word = np.searchsorted(before, nth, side="right") - 1
        left = nth - before[word]
        bits = self.words[level][word] if bit else ~self.words[level][word]
        for _ in range(int(left.max(initial=0))):  # drop the lowest ones
            more = left > 0
            bits = np.where(more, bits & (bits - np.uint64(1)), bits)
            left = left - more
        lowest = bits & (~bits + np.uint64(1))
        return word * 64 + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)

    def tokens(self) -> np.ndarray:
        """All ids in order, rebuilt from the last plane up."""
        kind = np.uint16 if len(self.words) <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level in reversed(range(len(self.words))):
            bit = np.unpackbits(self.words[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~bit)] = now[:self.zeros[level]]
            above[np.flatnonzero(bit)] = now[self.zeros[level]:] | kind(1 << (len(self.words) - 1 - level))
            now = above
        return now.astype("<u4")

    def pack(self) -> dict:
        press = zstandard.ZstdCompressor(level=1).compress
        return {"n": self.n, "zeros": self.zeros, "planes": [press(x.tobytes()) for x in self.words],
                "blocks": [press(x.astype("<u4").tobytes()) for x in self.blocks]}

    @staticmethod
    def unpack(row: dict) -> WaveletMatrix:
        plain = zstandard.ZstdDecompressor().decompress
        return WaveletMatrix(row["n"], [np.frombuffer(plain(x), dtype="<u8") for x in row["planes"]],
                             [np.frombuffer(plain(x), dtype="<u4") for x in row["blocks"]], list(row["zeros"]))


_encoders: dict[str, tuple[Memory, int, pa.Array]] = {}


def encoder(path: str) -> tuple[Memory, int, pa.Array]:
    """The worker's memory of words for a tokenizer file, the bits of an id, and the special tokens."""
    if path not in _encoders:
        os.environ.update(TOKENIZERS_PARALLELISM="false", RAYON_NUM_THREADS="1")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tool = Tokenizer.from_file(path)
        # Without normaliser and splitting, which leave plain lower-case words as they are.
        bare, model = Tokenizer(tool.model), tool.model
        bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found: list[list[int]] = [[]] * len(words)
            latin, rest = [], []
            for i, w in enumerate(words):
                if not w.isalpha() or w.lower() != w or max(w) > LATIN:
                    rest.append(i)
                elif w.isascii():
                    found[i] = [x.id for x in model.tokenize(w)]
                else:
                    latin.append(i)
            for one, which in ((bare, latin), (tool, rest)):
                for i, x in zip(which, one.encode_batch_fast([words[i] for i in which], add_special_tokens=False)):
                    found[i] = x.ids
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(size.sum())), size

        special = pa.array(sorted(x.content for x in tool.get_added_tokens_decoder().values()))
        bits = max(1, (tool.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        _encoders[path] = Memory(encode, np.uint32), bits, special
    return _encoders[path]


def _words(texts: pa.Array, special: pa.Array) -> pa.ListArray:
    """Words between blanks, in lower case, with a cut between a letter and a mark that follows it.

    These vocabularies lower their texts and cut there too, so fewer different
    words come out. Texts with the name of a special token, with combining marks or
    with a letter of two lower-case code points are only cut at blanks.
    """
    cut = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=CUT, replacement=r"\1 \2")
    whole = pc.match_substring_regex(texts, MIXED).to_numpy(zero_copy_only=False)
    for name in special.to_pylist():
        whole = whole | pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
    return pc.ascii_split_whitespace(pc.if_else(pa.array(whole), texts, cut) if whole.any() else cut)


def encode(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, each text's followed by the end id, and how many each text has."""
    memory, _, special = encoder(path)
    ids, sizes = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
    texts = pc.fill_null(texts, "")
    for low, high in slices(texts):
        got, size, _ = memory.encode_lists(_words(texts.slice(low, high - low), special))
        ids.append(np.insert(got, np.cumsum(size), np.uint32(end)))
        sizes.append(size + 1)
    return np.concatenate(ids), np.concatenate(sizes)


def _writer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, parts = [], [], []
        for batch in batches:
            names += batch.column("id").to_pylist()
            ids, size = encode(batch.column("text"), path, end)
            sizes += size.tolist()
            parts.append(ids.astype(np.uint16) if encoder(path)[1] <= 16 else ids)
        if names:
            packed = WaveletMatrix.build(np.concatenate(parts), encoder(path)[1]).pack()
            yield pa.RecordBatch.from_pylist([packed | {"doc_ids": names, "sizes": sizes}], schema=pa.schema([
                ("n", pa.int64()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
                ("blocks", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
            ]))

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end: int = END, shard_bytes: int = SHARD_BYTES) -> str:
    """Encodes the texts and writes one file for each range of ids; gives the folder."""
    spark = docs.sparkSession
    for_texts(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    path = path or new_path(spark, "tokens")
    # Rows of one id may be many; equal rows may change places.
    order = ["id", "__hash", "text", "__row"]
    rows = rows.withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), "id", "__hash", "__row")
    shards = dealt.sortWithinPartitions(*order).select("id", "text").mapInArrow(_writer(tokenizer, end), "n long, zeros array<long>, planes array<binary>, "
                                "blocks array<binary>, doc_ids array<long>, sizes array<long>")
    shards = shards.withColumn("shard", F.spark_partition_id())
    shards.write.option("compression", "uncompressed").parquet(path)
    return path


def read_shards(spark, path: str) -> DataFrame:
    """One row for each shard, with ``start``, the ids of all shards before it."""
    shards = spark.read.schema(
        "shard int, n long, zeros array<long>, planes array<binary>, blocks array<binary>, doc_ids array<long>, sizes array<long>"
    ).parquet(path)
    few = shards.select("shard", "n", (F.col("shard") / 1024).cast("int").alias("run"))
    runs = few.groupBy("run").agg(F.sum("n").alias("m"))
    runs = runs.select("run", (F.sum("m").over(Window.orderBy("run")) - F.col("m")).alias("base"))
    starts = few.join(runs, "run").select("shard", (
        F.col("base") + F.sum("n").over(Window.partitionBy("run").orderBy("shard")) - F.col("n")).alias("start"))
    return shards.join(F.broadcast(starts), "shard") if _few(spark, path) else shards.join(starts, "shard")


def _few(spark, path: str) -> bool:
    """At most 100,000 shards: their starts take under 2 MB."""
    return spark.read.schema("shard int").parquet(path).limit(100_001).count() <= 100_000


def read_tokens(spark, path: str) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit)."""
    ship_package(spark)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = WaveletMatrix.unpack(row).tokens()
                ends = np.cumsum(row["sizes"])
                begin = ends - row["sizes"]
                for low in range(0, len(ends), 2000):
                    cut = slice(low, low + 2000)
                    yield pa.record_batch([
                        pa.array(row["doc_ids"][cut], pa.int64()), pa.array(row["start"] + begin[cut]),
                        pa.array(row["sizes"][cut], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begin[cut], ends[cut])], pa.binary()),
                    ], schema=out)

    return read_shards(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def occurrences(spark, path: str, token: int) -> DataFrame:
    """The places of an id over all shards: (position), counted from the first id of the first shard."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch([pa.array(row["start"] + WaveletMatrix.unpack(row).places(token))], names=["position"])

    return read_shards(spark, path).mapInArrow(run, "position long")
