"""Token ids in flat unsigned integer files with 64-bit document offsets, read by memory map.

The documents are dealt to ranges of their ids; a range becomes one pair of files:

    part-00007.ids   the ids, little-endian unsigned 16- or 32-bit, one after the other
    part-00007.idx   little-endian 64-bit: number of documents n, n document ids, n+1 offsets
                     in ids from the start of the .ids file

and ``manifest.json`` names them in order with the first id and document of each, which are
prefix sums over the parts. A part is written under another name first and renamed when whole,
so a retried task leaves nothing half written. There are as many parts as shuffle partitions, and
more where the input is larger than PART_BYTES for each. Reading maps the files into memory where
the store is a local one, and takes ranges of at most READ_BYTES (or one document) elsewhere.

Strings of special tokens in a text become those tokens, as the library has it by default;
``plain_specials`` takes them for ordinary text.

Rows: ascending id, null id first, rows repeating an id by their text; null text is empty and
still has the end id; an empty table gives a manifest without parts.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import PieceEncoder
from ._shared import listed, materialize, new_path, partition_keys, qualified, range_bounds, range_of, width
from .bpe import _per_process, _slices, contents


_NULL = -(1 << 63)  # a null id in the .idx file
PART_BYTES, READ_BYTES = 1 << 28, 1 << 26


def _store(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


class _File:
    """Ranges of a file's bytes: of a map if the store is a local one, else read as asked for."""

    def __init__(self, store, path: str):
        self.map, self.file = None, None
        if store.type_name != "local":
            self.file = store.open_input_file(path)
        else:
            self.map = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)

    def get(self, kind: str, start: int, stop: int) -> np.ndarray:
        """Items start to stop of a file of ``kind``."""
        size = np.dtype(kind).itemsize
        if self.map is not None:
            return self.map[start * size : stop * size].view(kind)
        return np.frombuffer(self.file.read_at((stop - start) * size, start * size), kind)


def write_token_files(
    docs: DataFrame, tokenizer_json: str, pattern: str, folder: str | None = None, end_id: int = 0, id_bytes: int | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    plain_specials: bool = False,
) -> str:
    """Encode with the tokenizers library and write the files; returns their folder.

    ``pattern`` is that of the tokenizer's split; ids take 2 bytes if the vocabulary allows it.
    """
    if id_bytes not in (None, 2, 4):
        raise ValueError("ids take 2 or 4 bytes")
    if id_bytes is None:
        from tokenizers import Tokenizer

        id_bytes = 2 if max(Tokenizer.from_str(tokenizer_json).get_vocab().values()) < 1 << 16 else 4
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_path(spark, "tokens"))
    n = parts or max(width(spark), -(-_bytes_of(docs) // PART_BYTES))
    bounds = range_bounds(docs.where(F.col(id_col).isNotNull()), id_col, n)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("part", range_of(F.col("id"), bounds))
    key_of = F.element_at(listed(partition_keys(spark, n)), (F.col("part") + 1).cast("int"))
    dealt = named.withColumn("key", key_of).repartition(n, "key").sortWithinPartitions("part", "id", "text").select("part", "id", "text")
    shared = spark.sparkContext.broadcast(tokenizer_json)
    kind = f"<u{id_bytes}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _per_process(("tokenizers", pattern, contents(shared.value), plain_specials), lambda: _library(shared.value, pattern, plain_specials))
        end = np.array([end_id], "<u4").tobytes()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part, out, ids, offsets, spare = None, None, [], [0], ""

        def close() -> tuple[int, int, int]:
            out.close()
            with store.open_output_stream(f"{spare}.idx") as f:
                f.write(np.array([len(ids)], "<i8").tobytes() + np.array(ids, "<i8").tobytes() + np.array(offsets, "<i8").tobytes())
            for x in ("ids", "idx"):
                store.move(f"{spare}.{x}", f"{base}/part-{part:05d}.{x}")
            return part, len(ids), offsets[-1]

        done = []
        for b in batches:
            for lo, hi in _slices(b.column(2)):
                for p, i, t in zip(*(b.column(k).slice(lo, hi - lo).to_pylist() for k in range(3)), strict=True):
                    if p != part:
                        if out is not None:
                            done.append(close())
                        part, ids, offsets, spare = p, [], [0], f"{base}/.{uuid.uuid4().hex}"
                        out = store.open_output_stream(f"{spare}.ids")
                    data = encode(t or "") + end
                    ids.append(_NULL if i is None else i)
                    offsets.append(offsets[-1] + len(data) // 4)
                    out.write(data if id_bytes == 4 else np.frombuffer(data, "<u4").astype(kind).tobytes())
        if out is not None:
            done.append(close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], ["part", "docs", "ids"])

    # one row a part: what the driver gets grows with the parts, not with the documents
    written = sorted(tuple(r) for r in materialize(dealt.mapInArrow(run, "part long, docs long, ids long"), "token-parts").collect())
    first_doc = first_id = 0
    names = []
    for part, n_docs, n_ids in written:
        names.append({"part": part, "docs": n_docs, "ids": n_ids, "first_doc": first_doc, "first_id": first_id})
        first_doc, first_id = first_doc + n_docs, first_id + n_ids
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"id_bytes": id_bytes, "docs": first_doc, "ids": first_id, "parts": names}).encode())
    return folder


def _bytes_of(df: DataFrame) -> int:
    """What Catalyst knows of the table's size from its files, without a scan; 0 if it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 0


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen,
    else the next of those from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)}


def _library(tokenizer_json: str, pattern: str, plain_specials: bool) -> Callable[[str], bytes]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer_json)
    made.encode_special_tokens = plain_specials
    parts = json.loads(tokenizer_json)
    before = parts.get("pre_tokenizer") or {}
    if parts["model"].get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not parts.get("normalizer"):
        # a word that is one match goes to the library's model as it is, in the letters that stand for bytes
        letters, tokenize = _byte_letters(), made.model.tokenize
        words = lambda some: [array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes() for w in some]
    else:
        words = lambda some: [array("I", x.ids).tobytes() for x in made.encode_batch_fast(some, add_special_tokens=False)]
    pieces = PieceEncoder(pattern, words, 350_000, 100_000)
    added = [t["content"] for t in parts.get("added_tokens") or []]

    def encode(text: str) -> bytes:
        # such tokens are found in the whole text before it is cut into words
        if any(x in text for x in added):
            return array("I", made.encode(text, add_special_tokens=False).ids).tobytes()
        return pieces.encode(text)

    return encode


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    start counts the ids of all documents before it; the checksum is of the ids as
    little-endian unsigned 32-bit integers.
    """
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = f"<u{manifest['id_bytes']}"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = [(p["part"], p["first_id"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "part long, first_id long").repartition(max(1, min(len(rows), 4 * width(spark))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for b in batches:
            for part, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index, file = _File(store, f"{base}/part-{part:05d}.idx"), _File(store, f"{base}/part-{part:05d}.ids")
                n = int(index.get("<i8", 0, 1)[0])
                for at in range(0, n, 10_000):
                    to = min(at + 10_000, n)
                    names, offsets = index.get("<i8", 1 + at, 1 + to), index.get("<i8", 1 + n + at, 2 + n + to)
                    crcs = []
                    while len(crcs) < to - at:
                        lo = len(crcs)
                        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + READ_BYTES // 4, "right")) - 1)
                        ids = file.get(kind, int(offsets[lo]), int(offsets[hi])).astype("<u4")
                        crcs += [zlib.crc32(ids[offsets[i] - offsets[lo] : offsets[i + 1] - offsets[lo]]) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if x == _NULL else x for x in names.tolist()], pa.int64()), pa.array(offsets[:-1] + first), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return parts.mapInArrow(run, schema)


def read_ids(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, offsets and token ids of one part, mapped where the store allows it."""
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        kind = f"<u{json.loads(f.read())['id_bytes']}"
    index, file = _File(store, f"{base}/part-{part:05d}.idx"), _File(store, f"{base}/part-{part:05d}.ids")
    n = int(index.get("<i8", 0, 1)[0])
    names, offsets = index.get("<i8", 1, n + 1), index.get("<i8", n + 1, 2 * n + 2)
    return names, offsets, file.get(kind, 0, int(offsets[-1]))
