"""Token-ID output: Arrow IPC files of fixed-size-list batches, and their reader.

Documents are dealt by ranges of doc_id, one shard file a range, sorted within it. A shard holds one stream of ids, all
its documents' one after another, cut into sequences of equal length: column `ids` is a fixed-size list of unsigned
16-bit integers (32-bit where the vocabulary needs it), column `mask` a fixed-size list of booleans, false on the
filling at the end. Record batches hold equally many sequences, so that sequence i lies in batch i // BATCH at row
i % BATCH, and a memory-mapped file gives it as an array without a copy (`Shard.sequence`). Next to each shard lies a
file of the same format with (doc_id, start, n_tokens) of its documents, in order.

Tasks write under a name of their own attempt and rename it at the end: a task that is run again, on another executor
too, leaves the same file. Files go to the shared scratch folder through Arrow's file systems, never to a local one.

Encoding is Python, in Arrow batches. Texts are taken apart at ASCII blanks, which this tokenizer drops and over which
none of its tokens reaches; pieces that a worker doesn't know yet are encoded many at a time, and the frequent ones stay
in a cache of bounded size.

Defined cases: a null text counts as an empty one, which still has its end id; texts of any length go whole into one
shard, over as many sequences as they need; rows with equal doc_id, or without one, stand in the order of hashes of their
texts, and may fill many shards; a null doc_id sorts last; equal rows are each written; other columns are ignored,
whatever their names; an empty table gives an empty result and empty shards.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import fresh, saved, table, tasks_for

LENGTH = 2048
BATCH = 64
END_ID = 1
SHARD_BYTES = 32 << 20
#: A worker keeps the pieces it met among the last CACHED to twice as many different ones, of at most LONGEST characters.
CACHED, LONGEST = 300_000, 40
#: Schemes by which Hadoop and Arrow call the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts to little-endian bytes of ids."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.lowers = any(r["type"] == "Lowercase" for r in rules.get("normalizers", [rules] if rules else []))
        self.recent: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def plain(self, text: str) -> str:
        """A-Z lower-cased where the tokenizer would do so itself: fewer different pieces. Its special tokens have marks."""
        return text.encode().lower().decode() if self.lowers and "<|" not in text else text

    def pieces(self, words: list[str]) -> list[bytes]:
        """The ids of each word: many are encoded as one text, and its tokens come apart by their offsets."""
        out = []
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            at = np.array([o[0] for o in found.offsets], np.int64)
            cuts = np.searchsorted(at, starts) * self.dtype.itemsize
            whole = ids.tobytes()
            out += [whole[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return out

    def encode(self, texts: list[str | None], end_id: int = END_ID) -> list[bytes]:
        end = self.dtype.type(end_id).tobytes()
        split = [self.plain(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known, long, new = self.recent, {}, []
        for w in set().union(*split).difference(known):
            if (ids := self.former.get(w)) is not None:
                known[w] = ids
            else:
                new.append(w)
        for w, ids in zip(new, self.pieces(new)):
            known[w] = ids
            if len(w) > LONGEST:
                long[w] = ids
        out = [b"".join(map(known.__getitem__, p)) + end for p in split]
        for w in long:
            del known[w]
        if len(known) > CACHED:
            self.former, self.recent = known, {}
        return out


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI of the shared folder, and the path there."""
    scheme, colon, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


class ShardWriter:
    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype, length: int) -> None:
        self.fs, self.path, self.length, self.dtype = fs, path, length, dtype
        self.own = f".{os.getpid()}-{os.urandom(4).hex()}"
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sinks = [fs.open_output_stream(path + x + self.own) for x in ("", ".index")]
        self.files = [pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (self.schema, INDEX))]
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: pa.Array, encoded: list[bytes]) -> None:
        sizes = np.array([len(x) for x in encoded], np.int64) // self.dtype.itemsize
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.waiting.append(np.frombuffer(b"".join(encoded), self.dtype))
        self.n_tokens += int(sizes.sum())
        self.n_waiting += int(sizes.sum())
        self.n_docs += len(encoded)
        if self.n_waiting >= self.length * BATCH:
            self.flush(self.length * BATCH)

    def flush(self, step: int, last: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.dtype)
        whole = len(ids) if last else len(ids) // step * step
        for k in range(0, whole, step):
            part = ids[k : min(k + step, whole)]
            fill = -len(part) % self.length
            mask = np.ones(len(part) + fill, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(fill, self.dtype)]) if fill else part
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.files[0].write_batch(pa.record_batch(columns, schema=self.schema))
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self.flush(self.length * BATCH, last=True)
        for f, s in zip(self.files, self.sinks):
            f.close()
            s.close()
        for x in ("", ".index"):
            self.fs.move(self.path + x + self.own, self.path + x)


class Shard:
    """Reads a shard. With a local path the file is mapped, and sequences are views of it."""

    def __init__(self, uri: str) -> None:
        fs, path = store(uri)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.file, self.index = (pa.ipc.open_file(opened(path + x)) for x in ("", ".index"))
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of sequence i, neither of them copied: the mask keeps Arrow's form of a bit each."""
        batch, row = self.file.get_batch(i // BATCH), i % BATCH
        part = slice(row * self.length, (row + 1) * self.length)
        return batch.column("ids").flatten().to_numpy(zero_copy_only=True)[part], batch.column("mask").flatten()[part]

    def ids(self) -> Iterator[np.ndarray]:
        """The stream of ids, batch by batch, without the filling."""
        for k in range(self.file.num_record_batches):
            batch = self.file.get_batch(k)
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
            n = len(ids)
            if k == self.file.num_record_batches - 1:
                n = batch.column("mask").flatten().true_count
            yield ids[:n]

    def documents(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """For batches of documents: the index rows, and the crc32 of each one's ids as little-endian 32-bit integers."""
        stream, held = self.ids(), np.empty(0, np.uint32)
        for k in range(self.index.num_record_batches):
            rows = self.index.get_batch(k)
            sums = np.empty(rows.num_rows, np.int64)
            for i, n in enumerate(rows.column("n_tokens").to_pylist()):
                crc = 0
                while n:
                    if not len(held):
                        held = next(stream)
                    part, held = held[:n], held[n:]
                    crc, n = zlib.crc32(part.astype("<u4").tobytes(), crc), n - len(part)
                sums[i] = crc
            yield rows, sums


def written(docs: DataFrame, tokenizer: str, place: str, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Writes the shards under `place`; returns a row for each: part (ascending with doc_id), uri, n_docs, n_tokens."""
    n = tasks_for(docs, SHARD_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # the hash deals rows that share a doc_id over several shards
    rows = rows.withColumn("nth", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), "nth", "text"]
    dealt = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    fs, path = store(place)
    fs.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = Encoder.at(tokenizer)
        fs, path = store(place)
        shard = ShardWriter(fs, f"{path}/part-{part:07d}.arrow", encoder.dtype, length)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                some = batch.slice(k, 128)
                shard.add(some.column(0), encoder.encode(some.column(1).to_pylist()))
        shard.close()
        uri = f"{place}/part-{part:07d}.arrow"
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "uri": [uri], "n_docs": pa.array([shard.n_docs], pa.int64()), "n_tokens": pa.array([shard.n_tokens], pa.int64())}
        )

    return saved(dealt.mapInArrow(write, "part int, uri string, n_docs long, n_tokens long"), "shards")


def read_back(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start (over all shards), n_tokens, ids_crc32. One task per shard."""
    before = F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")
    placed = shards.withColumn("before", before).select("uri", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns)):
                for rows, sums in Shard(uri).documents():
                    starts = pa.array(rows.column("start").to_numpy() + first)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), starts, rows.column("n_tokens"), pa.array(sums)],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = placed.repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism * 4), "uri")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Writes docs as shards and reads them back."""
    place = fresh(docs.sparkSession, "token-shards")
    return read_back(written(docs, tokenizer or public_tokenizer(), place, length, text))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"))
