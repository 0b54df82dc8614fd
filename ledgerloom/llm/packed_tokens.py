"""Token ids in fixed-width bit-packed files (operator 6).

Ids take ``bits`` bits each, the fewest that hold every id of the vocabulary.
A file holds consecutive documents; its ids are cut into blocks of
``BLOCK_IDS``, and every block starts at a byte of its own, so any id's block
is found in the block table and unpacked with numpy at once.

File layout (little-endian): the 8 bytes of ``MAGIC``; eight longs (version,
bits, ids a block, documents, ids, blocks, documents without an id, 0); the
documents' ids (long; those without one come first, as 0) and first places
(long, one more at the end); the blocks' offsets in the payload (long, one more
at the end); payload.

Documents are dealt by ranges of ``doc_id`` and sorted inside; each task
writes files of at most about ``FILE_IDS`` ids under names of their own, and
only names in the manifest, a row a file, are ever read: a task that runs
twice leaves no trace in the result. Files are written and read through
pyarrow's file systems: the folder may be on a shared disk, HDFS, S3 (``s3a``
is read as ``s3``), GCS or ABFS.

Defined results: null counts as empty; every document ends with the end id;
equal ids stay in the order of their texts' hash; an empty table gives no rows
and no files; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, read_table, shared_dir
from .textvec import parts

MAGIC = b"PACKIDS1"
BLOCK_IDS = 4096
FILE_IDS = 4 << 20
END_ID = 2
MEMO = 800_000
#: Text encoded at once; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of ``ids`` at ``bits`` bits each, lowest bit first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return np.ascontiguousarray(raw[:, : bits // 8]).ravel()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")


def unpack(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids that ``pack`` made ``data`` of."""
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = data[: n * bits // 8].reshape(n, bits // 8)
    else:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
        out = np.packbits(wide, axis=1, bitorder="little")
    return out.ravel().view("<u4")


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> Iterator[bytes]:
    """One file of documents in ascending order of their ids, nulls first."""
    full = -(-block_ids * bits // 8)
    blocks = -(-len(ids) // block_ids)
    last = -(-(len(ids) - (blocks - 1) * block_ids) * bits // 8) if blocks else 0
    offsets = np.arange(blocks + 1, dtype="<i8") * full
    if blocks:
        offsets[-1] = (blocks - 1) * full + last
    yield MAGIC
    nulls = sum(d is None for d in doc_ids)
    if any(d is None for d in doc_ids[nulls:]):
        raise ValueError("documents without an id come first")
    yield np.array([1, bits, block_ids, len(doc_ids), len(ids), blocks, nulls, 0], "<i8").tobytes()
    yield np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    yield np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes()
    yield offsets.tobytes()
    for k in range(blocks):
        yield pack(ids[k * block_ids : (k + 1) * block_ids], bits).tobytes()


class Reader:
    """Random access to one file: ``ids(a, b)`` reads and unpacks only the blocks that hold the places a to b."""

    def __init__(self, path: str):
        fs, inner = _file_system(path)
        self.file = fs.open_input_file(inner)
        head = self.file.read_at(72, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a packed file: {path}")
        _, self.bits, self.block_ids, n, self.n_ids, blocks, self.nulls, _ = np.frombuffer(head, "<i8", 8, 8).tolist()
        table = np.frombuffer(self.file.read_at(8 * (2 * n + 1 + blocks + 1), 72), "<i8")
        self.doc_ids, self.first, self.offsets = table[:n], table[n : 2 * n + 1], table[2 * n + 1 :]
        self.payload = 72 + 8 * len(table)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.empty(0, np.uint32)
        lo, hi = a // self.block_ids, (b - 1) // self.block_ids
        data = np.frombuffer(self.file.read_at(int(self.offsets[hi + 1] - self.offsets[lo]), self.payload + int(self.offsets[lo])), np.uint8)
        out = []
        for k in range(lo, hi + 1):
            begin = int(self.offsets[k] - self.offsets[lo])
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack(data[begin : begin + -(-n * self.bits // 8)], n, self.bits))
        return np.concatenate(out)[a - lo * self.block_ids : b - lo * self.block_ids]

    def close(self) -> None:
        self.file.close()


def _file_system(path: str):
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Encoder:
    """The library's ids of whole texts, in columns.

    Texts are cut at ASCII spaces, which this vocabulary's pre-tokeniser never joins. A slice's words are
    dictionary-encoded by Arrow, so only its distinct words are looked up; their ids lie one after the other in
    ``flat`` and are copied to every occurrence at once. What was learned is forgotten when it exceeds a bound.

    What is assumed of a vocabulary is tried out on ``PROBE`` first: that texts may be cut at white space, that case makes no
    difference, and that a plain word's letters and closing marks are told apart. Where one fails, texts are encoded whole,
    words with their case, or each word by the library.
    """

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.size = self.library.get_vocab_size()
        self.end = np.array([end_id], "<u4")
        # ids that end a word, where the model marks them
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for w, i in self.library.get_vocab().items() if w.endswith(suffix)]] = True
        self.by_word = all(x.tolist() == np.concatenate([self.end[:0], *self._whole(t.split())]).tolist() for t, x in zip(PROBE, self._whole(PROBE)))
        letters = [c for c in map(chr, range(65, 256)) if re.match(_PLAIN, c)]
        self.caseless = all(x.tolist() == y.tolist() for x, y in zip(self._whole([*letters, *PROBE]), self._whole([x.lower() for x in (*letters, *PROBE)])))
        self._forget()
        if self.by_word and self.ends is not None:
            ids, count = self.encode(pa.array(PROBE, pa.large_string()))
            want = [np.concatenate((x, self.end)) for x in self._whole(PROBE)]
            if ids.tolist() != np.concatenate(want).tolist() or count.tolist() != list(map(len, want)):
                self.ends = None
        self._forget()

    def _forget(self) -> None:
        # words 0 and 1: the end id, under a name that no word has, and the empty word
        self.words = pa.array([" ", ""], pa.large_string())
        self.flat, self.first, self.count = self.end, np.array([0, 1]), np.array([1, 0])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: pa.Array, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Adds words; their places."""
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate((self.flat, ids))
        self.count = np.concatenate((self.count, count))
        self.first = np.cumsum(self.count) - self.count
        return np.arange(len(self.words) - len(words), len(self.words))

    def _places(self, words: pa.Array, learn) -> np.ndarray:
        """Places of distinct words; ``learn`` adds those that are missing."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null()
        places = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            places[places < 0] = learn(words.filter(new))
        return places

    def _learn(self, words: pa.Array) -> np.ndarray:
        """A plain word is a run of letters and perhaps closing marks, so two pre-tokens at most, which are learned by themselves."""
        if self.ends is None:
            return self._learn_each(words)
        cut = pc.extract_regex(words, _PLAIN)
        plain = cut.is_valid()
        core, tail = (cut.field(k).filter(plain) for k in (0, 1))
        runs = pa.concat_arrays([pc.utf8_lower(core) if self.caseless else core, tail]).dictionary_encode()
        two = self._places(runs.dictionary, self._learn_runs)[runs.indices.to_numpy()].reshape(2, -1)
        places = np.empty(len(words), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        pair = two.T.ravel()
        places[plain] = self._keep(words.filter(pa.array(plain)), self.flat[_ranges(self.first[pair], self.count[pair])], self.count[two].sum(axis=0))
        if not plain.all():
            places[~plain] = self._learn_each(words.filter(pa.array(~plain)))
        return places

    def _learn_runs(self, runs: pa.Array) -> np.ndarray:
        """Single pre-tokens: all are encoded as one text and cut after each end-of-word id, which only the last id of a pre-token is."""
        ids = self._whole([" ".join(runs.to_numpy(zero_copy_only=False))])[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(runs):
            return self._learn_each(runs)
        return self._keep(runs, ids, np.diff(stops, prepend=0))

    def _learn_each(self, words: pa.Array) -> np.ndarray:
        some = [x for k in range(0, len(words), 4096) for x in self._whole(words[k : k + 4096].to_pylist())]
        return self._keep(words, np.concatenate(some), np.array(list(map(len, some)), np.int64))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by the end id, and their number in each text."""
        if not self.by_word:
            some = [np.concatenate((x, self.end)) for x in self._whole(text.to_pylist())]
            return np.concatenate(some), np.array(list(map(len, some)), np.int64)
        lists = pc.ascii_split_whitespace(text)
        coded = lists.flatten().dictionary_encode()
        if len(self.words) + len(coded.dictionary) > MEMO:
            self._forget()
        known = self._places(coded.dictionary, self._learn)
        borders = np.cumsum(pc.list_value_length(lists).to_numpy())
        word = np.insert(known[coded.indices.to_numpy()], borders, 0)
        count = self.count[word]
        total = np.cumsum(count)
        return self.flat[_ranges(self.first[word], count)], np.diff(total[borders + np.arange(len(text))], prepend=0)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from ``start`` on, ``n`` of each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


#: Texts on which a vocabulary shows how it cuts words.
PROBE = ["a b\tc 1", "Hello WORLD, (Again)! iPhone McX don't DON'T x.y; e.g. A-B 3.14 100% $5 #tag @me", "Éa ÀÖØ straße Ünder ÿ, naïve... «a» “b” it’s", "the The THE tHe the, The. THE! thethe", "漢字 日本語 mixed漢 1a a1 A1 _x__ --- ... ,,"]

#: Latin letters, which lower-casing keeps letters, and closing marks, which make one pre-token.
_PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!#$%&*+,./:;=?@^_~-]*)$"


@functools.cache
def _encoder(vocabulary: str, end_id: int) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    return Encoder(vocabulary, end_id)


def write_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` in ascending ``doc_id`` order; returns the manifest (``part``, ``seq``, ``path``, ``n_ids``), a row a file."""
    docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(docs.sparkSession._jsparkSession.sessionState().newHadoopConf()).mkdirs(docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(vocabulary, end_id)
        bits = max(1, int(max(encoder.size - 1, end_id)).bit_length())
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names: list[pa.Array] = []
        counts: list[np.ndarray] = []
        chunks: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{seq:06d}-{attempt}.ids"
            fs, inner = _file_system(path)
            with fs.open_output_stream(inner) as out:
                for piece in file_bytes(pa.concat_arrays(names).to_pylist(), np.concatenate(counts), np.concatenate(chunks), bits):
                    out.write(piece)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([path]), pa.array([held])], ["part", "seq", "path", "n_ids"])

        for batch in batches:
            for piece in parts(batch, max_bytes=SLICE_BYTES):
                ids, n = encoder.encode(piece.column("text"))
                names.append(piece.column("doc_id"))
                counts.append(n)
                chunks.append(ids)
                held += len(ids)
                if held >= FILE_IDS:
                    yield flush()
                    names, counts, chunks, held, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = slim.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    return materialize(dealt.mapInArrow(run, "part long, seq long, path string, n_ids long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """A row for each document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    # a window over one row a writing task, and one inside each task's files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(tasks, manifest.part == tasks._part).select("path", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    spark = manifest.sparkSession
    # rows are tiny but stand for whole files, so their number of tasks is given: Spark would join them into one
    tasks_to_read = max(1, min(manifest.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["path"])
                first = reader.first
                crc = np.empty(len(reader.doc_ids), np.int64)
                step = 1024
                for k in range(0, len(crc), step):  # a stretch of documents at once
                    to = min(k + step, len(crc))
                    ids = reader.ids(int(first[k]), int(first[to]))
                    for i in range(k, to):
                        crc[i] = zlib.crc32(ids[first[i] - first[k] : first[i + 1] - first[k]].astype("<u4").tobytes())
                reader.close()
                doc = pa.array(reader.doc_ids, mask=np.arange(len(crc)) < reader.nulls)
                yield pa.RecordBatch.from_arrays([doc, pa.array(row["base"] + first[:-1]), pa.array(np.diff(first)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(tasks_to_read, F.col("path")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    return read_files(write_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder))


QUERIES = {"op6_packed_tokens": op6_packed_tokens}
SQL: dict[str, str] = {}
