"""Token-id output as sorted-string-table shards.

A shard file holds documents in ascending key order:

    block*  index  bloom  footer

A block is zstd-compressed and holds entries ``shared, rest, size`` (unsigned varints), the
last ``rest`` bytes of the key and ``size`` bytes of ids.  Keys are 8 bytes, big-endian with the sign bit
flipped, then a 4-byte counter for repeated keys; the first ``shared`` bytes of a key are those of the key before it (none
at a block's start).  Ids are little-endian, 2 bytes each if the vocabulary allows, else 4.  The index has one
entry a block: last key, offset, length, documents and ids in it.  The Bloom filter holds the
8-byte keys, ``BLOOM_BITS`` bits a key.  The footer has fixed size and points to index and
filter; a reader needs only it, the index and one block to find a key by binary search.

Files are written by executors into the shared folder under a temporary name and renamed, so
a task that is run again leaves the same file.  Reading goes through the files alone.

Words are encoded one by one only if the tokenizer file has the rules that make them independent (``splits_words``);
texts of any other file are encoded whole.

Edge cases: a null or empty text has the end id only; very long texts are one entry.  Null keys sort first and are
written as a flag in the counter; repeated keys are kept, in an order their texts give.  An
empty table gives no files and no rows.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.spm import Memory
from millrace.llm.words import mix

MODEL = "word_bpe_49k.json"
END = 1
BLOCK_BYTES = 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"MRSST001"
FOOTER = struct.Struct("<QIQIQQB3x8s")
INDEX = struct.Struct("<12sQIIQ")
NULL_FLAG = 1 << 31


# --- file format -------------------------------------------------------------------------


def packed_key(doc_id: int | None, repeat: int) -> bytes:
    if doc_id is None:
        return struct.pack(">QI", 0, NULL_FLAG | repeat)
    return struct.pack(">QI", doc_id + 2**63, repeat)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    one = mix(keys)
    two = mix(keys ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.concatenate([(one + np.uint64(k) * two) % np.uint64(bits) for k in range(BLOOM_HASHES)])


class Writer:
    """Writes one shard to ``sink``; entries must come in ascending order of doc_id, nulls first."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.press = zstandard.ZstdCompressor(level=1)
        self.at, self.docs, self.ids, self.last, self.doc_id, self.repeat = 0, 0, 0, b"", None, -1
        self.index: list[bytes] = []
        self.keys: list[int] = []
        self._open()

    def _open(self) -> None:
        self.parts, self.bytes, self.n, self.n_ids, self.before = [], 0, 0, 0, b""

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian, ``width`` bytes each."""
        self.repeat = self.repeat + 1 if self.docs and doc_id == self.doc_id else 0
        self.doc_id = doc_id
        key = packed_key(doc_id, self.repeat)
        if self.docs and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        while shared < len(self.before) and self.before[shared] == key[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.parts += (entry, ids)
        self.bytes += len(entry) + len(ids)
        self.n, self.n_ids = self.n + 1, self.n_ids + len(ids) // self.width
        self.docs, self.ids, self.last, self.before = self.docs + 1, self.ids + len(ids) // self.width, key, key
        self.keys.append(int.from_bytes(key[:8], "big"))
        if self.bytes >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            block = self.press.compress(b"".join(self.parts))
            self.sink.write(block)
            self.index.append(INDEX.pack(self.last, self.at, len(block), self.n, self.n_ids))
            self.at += len(block)
            self._open()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        bloom[_bloom_places(np.array(self.keys, np.uint64), bits).astype(np.int64)] = 1
        bloom = np.packbits(bloom).tobytes()
        self.sink.write(index)
        self.sink.write(bloom)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.ids, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable ``source`` of known length."""

    def __init__(self, source, length: int):
        self.source = source
        source.seek(length - FOOTER.size)
        at, size, bloom_at, self.bits, self.docs, self.ids, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        source.seek(at)
        self.index = list(INDEX.iter_unpack(source.read(size)))
        source.seek(bloom_at)
        self.bloom = np.unpackbits(np.frombuffer(source.read((self.bits + 7) // 8), np.uint8))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        _, at, size, n, _ = self.index[i]
        self.source.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(size))
        place, key = 0, b""

        def number() -> int:
            nonlocal place
            value = shift = 0
            while True:
                byte = raw[place]
                place += 1
                value |= (byte & 0x7F) << shift
                if byte < 0x80:
                    return value
                shift += 7

        for _ in range(n):
            shared, rest, length = number(), number(), number()
            key = key[:shared] + raw[place : place + rest]
            place += rest
            yield key, raw[place : place + length]
            place += length

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                value, counter = struct.unpack(">QI", key)
                yield (None if counter & NULL_FLAG else value - 2**63), ids

    def may_have(self, doc_id: int) -> bool:
        places = _bloom_places(np.array([doc_id + 2**63], np.uint64), self.bits)
        return bool(self.bloom[places.astype(np.int64)].all())

    def get(self, doc_id: int) -> bytes | None:
        """Ids of the first document with this key: filter, binary search over the index, one block."""
        if not self.may_have(doc_id):
            return None
        key = packed_key(doc_id, 0)
        i = bisect_left([e[0] for e in self.index], key)
        if i < len(self.index):
            for found, ids in self._block(i):
                if found == key:
                    return ids
        return None


# --- tokenizing --------------------------------------------------------------------------

#: Letters that are whole pre-tokens in runs, are lower case and composed already.
_LETTERS = "a-zß-öø-ÿ"
#: A stop at the end of a word is a pre-token of its own after such a letter or a digit, and after nothing else for sure.
_STOP_ELSE = re.compile(f"(?:^|[^{_LETTERS}0-9])[.,]")
_STOP = re.compile(f"(?<=[{_LETTERS}0-9])([.,])(?=[ \n])")
_SIMPLE = re.compile(f"([{_LETTERS}]+)([.,!;:?]*)")


_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer file has the rules that make words independent: composed lower case, white space dropped, its pattern's pre-tokens as bytes."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": _PATTERN}
        and (parts[0].get("behavior"), parts[0].get("invert")) == ("Removed", True)
        and (parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == (False, False)
        and spec.get("model", {}).get("type") == "BPE"
        and not (spec.get("truncation") or spec.get("padding") or spec.get("post_processor"))
        # Special strings are looked for before all else: those known begin so, hold no white space and take none along.
        and all(a["content"].startswith("<|") and not re.search(r"\s", a["content"]) and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in spec.get("added_tokens", []))
    )


class WordIds:
    """Ids of whole texts, word by word: white space always parts pre-tokens and is dropped, so words are independent."""

    _loaded: dict[str, "WordIds"] = {}

    @classmethod
    def at(cls, path: str) -> "WordIds":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Whether words may be encoded one by one; a file with other rules is given whole texts.
        self.by_word = splits_words(json.loads(self.tokenizer.to_str()))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 65536 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        # The byte-level stand-in of every letter that may be in a simple word.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x61, 0x100) if re.fullmatch(f"[{_LETTERS}]", chr(c))]
        self.stand_in = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        self.memory = Memory(self._word)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            return array("H" if self.width == 2 else "I", [t.id for t in self.model.tokenize(word)]).tobytes()
        simple = _SIMPLE.fullmatch(word)
        if not simple or not unicodedata.is_normalized("NFC", word):
            return self._library(word)
        letters, tail = simple.groups()
        if tail:
            return self.memory[letters] + self.memory[tail]
        return array("H" if self.width == 2 else "I", [t.id for t in self.model.tokenize(letters.translate(self.stand_in))]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed."""
        if not self.by_word:
            return self._library(text)
        if "<|" not in text:  # no special string can be in it, so ASCII capitals may go first
            text = text.encode().lower().decode()
        if _STOP_ELSE.search(text):
            text = _STOP.sub(r" \1", text)
        else:
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return b"".join(map(self.memory.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


# --- operator ----------------------------------------------------------------------------


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system, as Spark resolves it, so that executors open the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


_MANIFEST = "part int, path string, length bigint, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint"


def write_shards(docs: DataFrame, folder: str, model: str | None = None, end_id: int = END, parts: int | None = None) -> DataFrame:
    """Encode and write; returns the manifest: part, path, length, n_docs, n_tokens, first and last id (nulls aside)."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # Rows that share a key are spread by a hash of their text and stay in one order.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, "text")
        .withColumn("part", F.spark_partition_id())
    )

    def write(batches: Iterable[pa.RecordBatch]):
        import public_tokenizers

        words = WordIds.at(model or public_tokenizers.path(MODEL))
        end = np.array([end_id], words.kind).tobytes()
        writer = sink = first = last = None

        for batch in batches:
            if batch.num_rows and writer is None:
                part = batch.column(2)[0].as_py()
                system, base = _open(folder)
                name, spare = f"{base}/shard-{part:06d}.sst", f"{base}/_{uuid.uuid4().hex}"
                system.create_dir(base, recursive=True)
                sink = system.open_output_stream(spare)
                writer = Writer(sink, words.width)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, words.encode(text.as_py()) + end)
                first, last = doc_id if first is None else first, doc_id
        if writer is None:
            return
        writer.close()
        length = sink.tell()
        sink.close()
        system.move(spare, name)
        path = f"{folder}/shard-{part:06d}.sst"
        facts = {"length": length, "n_docs": writer.docs, "n_tokens": writer.ids, "first_id": first, "last_id": last}
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "path": [path], **{k: pa.array([v], pa.int64()) for k, v in facts.items()}}
        )

    return ordered.mapInArrow(write, _MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (over 4-byte ids)."""
    spark = manifest.sparkSession
    files = manifest.orderBy("part").collect()  # one small row a file
    starts = np.cumsum([0, *(f["n_tokens"] for f in files)])
    rows = [(f["path"], f["length"], int(s)) for f, s in zip(files, starts)]
    listed = spark.createDataFrame(rows, "path string, length bigint, start bigint").repartition(max(1, len(rows)))

    def read(batches):
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _open(path)
                with system.open_input_file(name) as source:
                    shard = Reader(source, length)
                    kind = np.uint16 if shard.width == 2 else np.uint32
                    out: list[tuple] = []
                    for doc_id, ids in shard:
                        wide = np.frombuffer(ids, kind).astype("<u4")
                        out.append((doc_id, start, len(wide), zlib.crc32(wide.tobytes())))
                        start += len(wide)
                        if len(out) == 8192:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return listed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def look_up(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id and found_crc32 (over the 4-byte ids; null if no shard has the key) of the distinct ids of ``asked``.

    Keys are dealt out in ranges; each goes to the shards whose range of ids holds it, past the Bloom filter, by binary
    search over the block index to one block.  The first of repeated keys is found.
    """
    spark = asked.sparkSession
    files = manifest.filter("first_id IS NOT NULL").orderBy("part").select("path", "length", "first_id", "last_id").collect()  # one small row a file
    files = [tuple(f) for f in files]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = asked.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()

    def search(batches):
        starts, path, shard, source = [f[2] for f in files], None, None, None
        for batch in batches:
            wanted, out = sorted(batch.column(0).to_pylist()), []
            for doc_id in wanted:
                found, i = None, bisect_right(starts, doc_id) - 1
                # The ranges of neighbouring shards share at most an end: the first that has the key is the earliest.
                while i > 0 and files[i - 1][3] >= doc_id:
                    i -= 1
                while found is None and 0 <= i < len(files) and files[i][2] <= doc_id:
                    if files[i][0] != path:
                        if source is not None:
                            source.close()
                        path = files[i][0]
                        system, name = _open(path)
                        source = system.open_input_file(name)
                        shard = Reader(source, files[i][1])
                    found = shard.get(doc_id)
                    i += 1
                kind = np.uint16 if shard is not None and shard.width == 2 else np.uint32
                out.append(None if found is None else zlib.crc32(np.frombuffer(found, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(out, pa.int64())], ["doc_id", "found_crc32"])
        if source is not None:
            source.close()

    return keys.repartitionByRange(parts, "doc_id").mapInArrow(search, "doc_id bigint, found_crc32 bigint")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


#: The query looks these ids up by key as well.
ASKED = 50


def op4_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from the files read in order, then ``found_crc32``: of ids divisible by 50, looked up by key (else null)."""
    folder = f"{common.shared_folder(spark)}/millrace-sst-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    manifest = common.written(write_shards(docs, folder), "manifest")
    found = look_up(manifest, docs.filter(F.col("doc_id") % ASKED == 0).select("doc_id"))
    return read_shards(manifest).join(found, "doc_id", "left")


QUERIES = {"op4_token_tables": op4_token_tables}
ORACLES: dict[str, str] = {}
