"""Token-ID files: one zstandard frame per document under a shared trained dictionary.

A file is, in order (integers little-endian; ``\\n`` ends each part):

* header: ``ARBTOK02``, id width in bytes (u8), SHA-256 of the dictionary (32 bytes), number of the file among all (u64);
* per document, in ascending doc_id order: a zstandard frame of its ids (unsigned, of that width);
* index: per document has_id (u8), doc_id (i64), offset (u64), length (u32), ids (u32);
* footer: index offset (u64), documents (u64), ``ARBTOKIX``.

A document is reached by its index entry alone.  The dictionary lies beside the files as Parquet."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, scratch_path, small, stored, text_or_empty

MAGIC, TAIL = b"ARBTOK02", b"ARBTOKIX"
ENTRY = np.dtype([("has", "u1"), ("doc", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u4")])
END = 1
#: The bound on the dictionary's training sample: the documents of the smallest hashes of doc_id.
SAMPLE, DICTIONARY_BYTES, LEVEL = 1000, 32 << 10, 3
#: Bytes of ids that training takes of a document, at most.
SAMPLE_BYTES = 64 << 10
#: Bytes of frames that a file gets, about.
FILE_BYTES = 16 << 20
#: Pieces whose ids a Python worker keeps, and documents that it encodes before it hands them on.
KEPT_WORDS, SLICE = 100_000, 256


# Fixed values of the tokenizer file that has the short way: its normalizers, and the pattern that it cuts text by.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern for characters up to U+017F, where normal form C changes nothing and letter case depends on no neighbour.
LETTER, NUMBER, SPACE = "a-zA-Zªµºß-öø-\u017fÀ-ÖØ-Þ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: What the short way leaves to the tokenizer: other characters, and texts that may hold special tokens.
OTHER = re.compile(r"[^\x00-\u017f]|<\|")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: a printable Latin-1 character stands for its own byte, the rest for 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return str.maketrans({chr(b): chr(b) for b in shown} | {chr(b): chr(256 + i) for i, b in enumerate(rest)})


class Encoder:
    """Serialized ids of texts.  For a tokenizer of the known make, which drops white space and merges within pieces only,
    pieces met before are looked up and new ones go to its model; all else goes to the tokenizer whole."""

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.end = np.array([END], dtype).tobytes()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = ((made.get("normalizer") or {}).get("normalizers") == NORMALIZERS
                      and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
                      and [x["type"] for x in steps[1:]] == ["ByteLevel"] and made.get("post_processor") is None)
        self.pieces = _Pieces(self.tokenizer.model, dtype)

    def __call__(self, text: str) -> bytes:
        """Ids of a text with the end id."""
        if self.known and not OTHER.search(text):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower()))) + self.end
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids + [END], self.dtype).tobytes()


class _Pieces(dict):
    """Lower-case piece -> its ids as bytes; the first pieces met are kept."""

    def __init__(self, model, dtype: str) -> None:
        self.model, self.dtype, self.letters = model, dtype, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()
        if len(self) < KEPT_WORDS and len(piece) < 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=1)
def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _dtype(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, path: str, dtype: str, sample: int = SAMPLE) -> bytes:
    """A zstandard dictionary of the id arrays of ``sample`` documents; empty (none) if they are too few."""
    place = [F.xxhash64("doc_id"), F.col("doc_id")]
    # ids alone are ordered, then the texts of those few are fetched
    chosen = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(*place).limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(*place, F.length("text"), "text").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, dtype)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(t.as_py())[:SAMPLE_BYTES] for t in b.column(0)], pa.binary())], names=["ids"])

    arrays = [bytes(r["ids"]) for r in rows.select("text").mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, tokenizer_path: str, target: str) -> None:
    """Writes all documents to ``target``: ids/ (the files), dictionary/ (bytes and their SHA-256)."""
    spark = docs.sparkSession
    dtype = _dtype(tokenizer_path)
    raw = train_dictionary(docs, tokenizer_path, dtype)
    digest = hashlib.sha256(raw).digest()
    spark.createDataFrame([(digest.hex(), bytearray(raw))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{target}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=False)
        encode = Encoder(tokenizer_path, dtype)  # of this task, gone with it
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                ids = [encode(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) // int(dtype[-1]) for x in ids], pa.int64()), pa.array(map(packer.compress, ids), pa.binary())],
                    names=["doc_id", "n", "frame"])
        del encode
        give_back()

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    made = stored(made.mapInArrow(frames, "doc_id bigint, n bigint, frame binary"), "token-frames")
    size = made.agg(F.sum(F.octet_length("frame"))).first()[0] or 0

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], names=["part"])
        from pyspark import TaskContext

        header = MAGIC + bytes([int(dtype[-1])]) + digest + int(TaskContext.get().partitionId()).to_bytes(8, "little")
        yield row([header])
        at, index = len(header) + 1, []
        for batch in batches:
            parts = batch.column(2).to_pylist()
            for doc, n, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), parts, strict=True):
                index.append((doc is not None, doc or 0, at, len(part), n))
                at += len(part) + 1
            yield row(parts)
        yield row([np.array(index, ENTRY).tobytes()])
        yield row([np.array([at, len(index)], "<u8").tobytes() + TAIL])

    # the order of a doc_id's rows is part of the range, so that they can be dealt to several files
    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("hash")]
    (made.withColumn("hash", F.xxhash64("frame")).repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order)
     .mapInArrow(files, "part binary").select(F.col("part").cast("string").alias("value"))
     .write.option("lineSep", "\n").text(f"{target}/ids"))


def read_index(content: bytes) -> tuple[int, bytes, int, np.ndarray]:
    """Id width, dictionary hash, number and index of a file."""
    if content[:8] != MAGIC or content[-9:-1] != TAIL:
        raise ValueError("not a token-ID file")
    at, n = np.frombuffer(content[-25:-9], "<u8")
    return content[8], content[9:41], int.from_bytes(content[41:49], "little"), np.frombuffer(content, ENTRY, int(n), int(at))


def read_document(content: bytes, doc_id: int, dictionary: bytes) -> np.ndarray:
    """Ids of one document (the first of several of that id) through the index; only its frame is decompressed."""
    width, digest, _, index = read_index(content)
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("another dictionary")
    known = index[index["has"] == 1]
    i = int(np.searchsorted(known["doc"], doc_id))
    if i == len(known) or known["doc"][i] != doc_id:
        raise KeyError(doc_id)
    e = known[i]
    frame = content[int(e["offset"]): int(e["offset"]) + int(e["length"])]
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(frame), f"<u{width}")


def read(spark: SparkSession, target: str) -> DataFrame:
    """Per document, from the files: file (its number), doc_id, at (ids before it in its file), n_tokens, ids_crc32."""
    raw = bytes(spark.read.parquet(f"{target}/dictionary").first()["dictionary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                view = memoryview(data)
                width, digest, number, index = read_index(view.tobytes())
                if hashlib.sha256(raw).digest() != bytes(digest):
                    raise ValueError(f"{path} was written under another dictionary")
                unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
                crcs = []
                for e in index:
                    ids = np.frombuffer(unpack.decompress(view[int(e["offset"]): int(e["offset"]) + int(e["length"])]), f"<u{width}")
                    if len(ids) != e["ids"]:
                        raise ValueError(f"{path}: a document of {len(ids)} ids is indexed with {e['ids']}")
                    crcs.append(crc32(ids.astype("<u4").tobytes()))
                n = index["ids"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(n), pa.int64()), pa.array(index["doc"].astype(np.int64), mask=index["has"] == 0),
                     pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{target}/ids").select("path", "content")
            .mapInArrow(run, "file bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"))


def token_files(docs: DataFrame, tokenizer_path: str, target: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null and empty texts are the end id alone.  Null ids come first.  Repeated rows are documents of their own, in
    order of length, then of a hash of their frames.  An empty table gives a file without documents and an empty result.  Only doc_id and text are
    read."""
    spark = docs.sparkSession
    target = target or scratch_path(spark, "token-ids")
    write(docs, tokenizer_path, target)
    rows = stored(read(spark, target), "token-read")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(files.select("file", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead")), "token-files")
    return rows.join(small(files), "file").select("doc_id", (F.col("ahead") + F.col("at")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")
