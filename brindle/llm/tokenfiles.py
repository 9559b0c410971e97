"""Token sequences in training order, as binary shards of fixed stride.

Documents become token ids, an end mark is added, and the ids are cut into sequences of a
fixed length, the last one filled up. Sequences are numbered in the order of the input's
files and rows, however they are split; a keyed Feistel permutation with cycle walking
turns a number into a global slot, the sequence's place in the training order. Slots are
dealt out by ranges: a shard holds as many consecutive slots as make up its size in bytes
(the last one may hold fewer), as records of the same size, in slot order; a task writes a
range of consecutive shards. So record r of the training order lies in shard r div
per_shard at byte (r mod per_shard) * stride, and a reader resumes by seeking.

The input is read twice, to count the sequences of each split and to write them; ids are
shuffled once. A shard is written under a name of its own and renamed when whole, so that
lost or repeated tasks leave no partial shard. A shard already there, with a note that
says the same of its contents, isn't written again, and nothing is when the folder holds
all shards of the same plan.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .sharding import with_place
from .util import Scratch


#: How a pattern ends that looks ahead, and an end that cuts alike wherever no two blanks meet. Without looking ahead, a text is cut faster.
AHEAD, PLAIN = r"|\s+(?!\S)|\s+", r"|\s+"
#: Two blanks that meet, of those that \s stands for in a pattern.
BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"
#: Tasks that write shards; with more shards than that, each writes several, one after another.
MOST_TASKS = 8192


@dataclass(frozen=True)
class Settings:
    """vocabulary: a rank file; end_id closes a document and fills up its last sequence; shard_bytes: a shard's size."""

    vocabulary: str
    pattern: str
    length: int = 512
    shard_bytes: int = 32 << 20
    end_id: int = 50256
    seed: int = 2024

    @property
    def kind(self) -> str:
        return "<u2" if self.end_id < 1 << 16 else "<u4"

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.kind).itemsize

    @property
    def per_shard(self) -> int:
        return max(1, self.shard_bytes // self.stride)


_encodings = {}


def _encoding(s: Settings, plain: bool = False):
    """The library's encoding; plain: one for texts in which no two blanks meet, that gives them the same ids."""
    pattern = s.pattern
    if plain and pattern.endswith(AHEAD) and not pattern.endswith("\\" + AHEAD):
        pattern = pattern.removesuffix(AHEAD) + PLAIN
    key = (s.vocabulary, pattern, s.end_id)
    if key not in _encodings:
        import tiktoken

        with open(s.vocabulary, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}
        if s.end_id in ranks.values() or max(ranks.values()) >= 1 << (8 * np.dtype(s.kind).itemsize):
            raise ValueError("end_id must be free, and as wide as the vocabulary's ids")
        # no text is ever read as the end mark; it is there because the library takes half as long again to fill arrays if there are no special tokens
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": s.end_id})
    return _encodings[key]


def _plain(column: pa.Array) -> list[bool]:
    """For each text of a column, whether no two blanks meet in it."""
    return pc.invert(pc.match_substring_regex(column, BLANKS)).fill_null(True).to_pylist()


def _ids(text: str, s: Settings, plain: bool) -> np.ndarray:
    return _encoding(s, plain).encode_to_numpy(text, disallowed_special=())


def sequences(text: str | None, s: Settings, plain: bool = False) -> np.ndarray:
    """Matrix of a document's sequences; an empty text is one sequence of end marks. plain: no two blanks meet in the text."""
    ids = _ids(text or "", s, plain)
    out = np.full((len(ids) // s.length + 1, s.length), s.end_id, s.kind)
    out.reshape(-1)[: len(ids)] = ids
    return out


def column_sequences(column: pa.Array, s: Settings) -> list[np.ndarray]:
    """sequences() of each text of a column."""
    return [sequences(x.as_py(), s, plain) for x, plain in zip(column, _plain(column))]


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _placed(df: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(_key, _text, _file, _at) with each row's file and its place there; what isn't read from files is first written in order of key and text."""
    rows = [F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text")]

    def of_files(x: DataFrame, *columns) -> DataFrame:
        source = x.metadataColumn("_metadata")
        return x.select(*columns, source["file_path"].alias("_file"), source["row_index"].alias("_at"))

    try:
        found = of_files(df, *rows)
        found.schema  # noqa: B018, asks Spark to resolve it
        return found
    except AnalysisException:
        by = ["_key", F.xxhash64("_text")]
        return of_files(scratch.save(df.select(*rows).repartitionByRange(*by).sortWithinPartitions(*by), "ordered"), "_key", "_text")


class _Part:
    """Rows of one file that follow each other in a split: where they begin, how many sequences they make, a sum over their texts."""

    def __init__(self, file: str, begin: int):
        self.file, self.begin, self.n, self.sum, self.at = file, begin, 0, 0, begin - 1

    def fits(self, file: str, at: int) -> bool:
        return self.file == file and at > self.at

    def add(self, at: int, text: memoryview, sequences: int) -> None:
        self.at = at
        self.n += sequences
        self.sum = (self.sum + (zlib.crc32(text) + 1) * (2 * len(text) + 1)) & (2**63 - 1)


def plan(df: DataFrame, s: Settings, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list, dict]:
    """(df's rows with their places, a row for each part of a file, what identifies the shards: the same for the same files and settings)."""
    scratch = scratch or Scratch(df.sparkSession, "tokens")
    rows = _placed(df, key, text, scratch)

    def counted(batches):
        parts = []
        for batch in batches:
            data, offsets = tk.column_bytes(batch.column(0))
            data, column = memoryview(np.ascontiguousarray(data)), batch.column(0)
            plain = _plain(column)
            for i, (file, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                size = int(offsets[i + 1] - offsets[i])
                # there are at most as many ids as bytes, so short texts needn't be encoded to be counted
                n = 1 if size < s.length else len(_ids(column[i].as_py(), s, plain[i])) // s.length + 1
                if not parts or not parts[-1].fits(file, at):
                    parts.append(_Part(file, at))
                parts[-1].add(at, data[offsets[i] : offsets[i + 1]], n)
        yield pa.RecordBatch.from_arrays([pa.array([getattr(p, k) for p in parts], t) for k, t in (("file", pa.string()), ("begin", pa.int64()), ("n", pa.int64()), ("sum", pa.int64()))], names=["file", "begin", "n", "sum"])

    # a row for each split of a file
    parts = scratch.save(rows.select("_text", "_file", "_at").mapInArrow(tk.tidy(counted), "file string, begin long, n long, sum long"), "counts").collect()
    parts = sorted((r.file, r.begin, r.n, r.sum) for r in parts)
    files: dict[str, int] = {}
    for file, _, _, x in parts:
        files[file] = (files.get(file, 0) + x) & (2**63 - 1)
    same = {"sequences": sum(p[2] for p in parts), "per_shard": s.per_shard, "stride": s.stride, "length": s.length, "kind": s.kind, "seed": s.seed, "end_id": s.end_id, "key": key, "text": text, "files": zlib.crc32(json.dumps(list(files.values())).encode())}
    return rows, parts, same


def write(df: DataFrame, folder: str, s: Settings, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text", planned: tuple | None = None) -> DataFrame:
    """Writes the shards into folder (a URI that all executors reach) and returns a row for each sequence.

    (key, sequence int, n_tokens int, slot long, shard int, record long, record_crc32 long);
    n_tokens counts a sequence's ids without those that fill it up, the end mark included.
    A null text counts as empty. Rows that repeat are each written; keys may be null. Other
    columns are ignored. An empty df writes no shards. df is best read from files, whose rows
    have an order: files by name, rows by place. Any other df is written in order of key and
    text first; rows equal in both are interchangeable. If the input changes between the two
    readings, an error is raised. The result is read from a table beside the shards. planned
    is what plan() gave, if it was asked before.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, sequence int, n_tokens int, slot long, shard int, record long, record_crc32 long"
    rows, parts, same = planned or plan(df, s, scratch, key, text)
    total, per_shard = same["sequences"], same["per_shard"]
    if not total:
        return spark.createDataFrame([], schema)
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    if _note(fs, f"{path}/plan.json") == same and all(_whole(fs, path, k, same) for k in range(-(-total // per_shard))):
        return spark.read.schema(schema).parquet(f"{folder}/index")
    starts, at = {}, 0
    for file, begin, n, _ in parts:
        starts[file, begin] = at
        at += n
    known = spark.sparkContext.broadcast((starts, {p[:2]: p[2:] for p in parts}))

    def numbered(batches):
        starts, sums = known.value
        part, number = None, 0

        def done():
            if part is not None and (part.n, part.sum) != sums[part.file, part.begin]:
                raise RuntimeError("the input has changed between two readings; write it to a table first")

        for batch in batches:
            data, offsets = tk.column_bytes(batch.column(1))
            data = memoryview(np.ascontiguousarray(data))
            files, places = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            step = 256
            for low in range(0, batch.num_rows, step):
                piece = batch.slice(low, step)
                made = column_sequences(piece.column(1), s)
                n = np.array([len(m) for m in made])
                numbers = []
                for i, size in enumerate(n.tolist(), low):
                    if part is None or not part.fits(files[i], places[i]):
                        done()
                        if (files[i], places[i]) not in starts:
                            raise RuntimeError("the input is split in another way than before; write it to a table first")
                        part, number = _Part(files[i], places[i]), starts[files[i], places[i]]
                    part.add(places[i], data[offsets[i] : offsets[i + 1]], size)
                    numbers.append(number)
                    number += size
                ids = np.concatenate(made)
                sequence = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
                last = sequence == np.repeat(n, n) - 1
                # ids up to the first end mark; only a document's last sequence is filled up
                size = np.where(last, (ids == s.end_id).argmax(1) + 1, s.length)
                offset = pa.py_buffer(np.arange(0, ids.nbytes + 1, s.stride, dtype=np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, offset, pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(sequence.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.repeat(np.array(numbers), n) + sequence), binary], names=[key, "sequence", "n_tokens", "_number", "ids"])
        done()

    placed = with_place(rows.mapInArrow(tk.tidy(numbered), f"`{key}` {kind}, sequence int, n_tokens int, _number long, ids binary"), "_number", total, s.seed, "slot").drop("_number")
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)"))
    shards = -(-total // per_shard)
    tasks = min(shards, MOST_TASKS)
    # task t writes the consecutive shards whose number times tasks div shards is t
    dealt = placed.repartitionById(tasks, F.expr(f"cast(cast(shard as long) * {tasks} div {shards} as int)")).sortWithinPartitions("slot")

    def stored(batches):
        fs, path = _file_system(folder)
        out = None
        for batch in batches:
            shards = np.asarray(batch.column(5))
            crcs = []
            for shard, data in zip(shards.tolist(), batch.column(4).to_pylist()):
                crcs.append(zlib.crc32(data))
                if out is None or out.shard != shard:
                    if out:
                        out.close()
                    out = _Shard(fs, path, shard, same)
                out.add(data)
            slots = np.asarray(batch.column(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), batch.column(5), pa.array(slots % per_shard), pa.array(crcs, pa.int64())], names=[key, "sequence", "n_tokens", "slot", "shard", "record", "record_crc32"])
        if out:
            out.close()

    result = dealt.select(key, "sequence", "n_tokens", "slot", "ids", "shard").mapInArrow(tk.tidy(stored), schema)
    result.write.mode("overwrite").parquet(f"{folder}/index")
    with fs.open_output_stream(f"{path}/plan.json") as f:
        f.write(json.dumps(same, sort_keys=True).encode())
    return spark.read.schema(schema).parquet(f"{folder}/index")


def _note(fs, path: str) -> dict | None:
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type != FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _whole(fs, path: str, shard: int, same: dict) -> bool:
    note = _note(fs, f"{path}/{shard_name(shard)}.json")
    return note is not None and note["plan"] == same and fs.get_file_info(f"{path}/{shard_name(shard)}").size == note["records"] * same["stride"]


class _Shard:
    """A shard being written: kept in memory by the block, renamed at the end with a note beside it."""

    def __init__(self, fs, path: str, shard: int, same: dict):
        self.fs, self.path, self.shard, self.crc, self.records = fs, f"{path}/{shard_name(shard)}", shard, 0, 0
        self.note = {"shard": shard, "first_slot": shard * same["per_shard"], "plan": same}
        self.temporary = f"{path}/.{shard_name(shard)}.{uuid.uuid4().hex}"
        self.stream = fs.open_output_stream(self.temporary)
        self.block: list[bytes] = []

    def add(self, data: bytes) -> None:
        self.records += 1
        self.block.append(data)
        if len(self.block) == 1024:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.block)
        self.block = []
        self.crc = zlib.crc32(data, self.crc)
        self.stream.write(data)

    def close(self) -> None:
        self._flush()
        self.stream.close()
        note = self.note | {"records": self.records, "crc32": self.crc}
        beside = f"{self.path}.json"
        if _note(self.fs, beside) == note and self.fs.get_file_info(self.path).size == self.records * note["plan"]["stride"]:
            self.fs.delete_file(self.temporary)
            return
        self.fs.move(self.temporary, self.path)
        with self.fs.open_output_stream(beside) as f:
            f.write(json.dumps(note, sort_keys=True).encode())


def read(folder: str, shard: int, record: int = 0, records: int | None = None) -> np.ndarray:
    """Records of a shard from the one given on, as a matrix of ids, by one seek."""
    fs, path = _file_system(folder)
    with fs.open_input_stream(f"{path}/{shard_name(shard)}.json") as f:
        note = json.loads(f.read())
    n = max(0, min(note["records"] - record, note["records"] if records is None else records))
    with fs.open_input_file(f"{path}/{shard_name(shard)}") as f:
        f.seek(record * note["plan"]["stride"])
        return np.frombuffer(f.read(n * note["plan"]["stride"]), note["plan"]["kind"]).reshape(n, note["plan"]["length"])
