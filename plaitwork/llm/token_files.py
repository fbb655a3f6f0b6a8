"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file: frames one after another, each a complete zstandard frame (with zstandard's own content
checksum) of the ids of some whole documents, little-endian, 16 bits wide if the vocabulary allows, else 32; then
the seek table as a zstandard skippable frame, so that ``zstd -d`` still reads the file:

    frame entry     u32 documents, u32 compressed bytes, u32 crc32 of the decompressed bytes
    document entry  i64 id, u32 ids
    footer          u32 frames, u32 documents, u8 bytes of an id, 8 bytes magic

A reader loads the footer and the table, then decompresses only the frames that hold wanted documents.
Files are range-partitioned and sorted by document id. Each is written by one task under a temporary name
and renamed when whole; ids depend on the input alone, so a task that runs again writes the same
file. A manifest of the files (not their contents) gives the ids before each file.

A null or empty text has only the end id. A null document id comes first. Rows that repeat an id
are documents of their own, in the order of their texts.
"""

from __future__ import annotations

import array
import codecs
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaitwork.llm._util import prepare

#: Fixed values of the file format.
SKIPPABLE, MAGIC, NULL_ID = 0x184D2A5E, b"TOKSEEK1", -(2**63)
FRAME, DOC, FOOTER = struct.Struct("<III"), struct.Struct("<qI"), struct.Struct("<IIB8s")
FRAME_IDS, LOT, MEMO, LONG = 65_536, 8_000_000, 600_000, 64
#: The pre-token pattern that ``cuts`` is made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def _newer_letters():
    """Letters and numbers younger than Python's tables: the libraries' own tables may not agree on them."""
    import unicodedata

    import regex

    letter, runs = regex.compile(r"[\p{L}\p{N}]"), []
    for i in range(0x110000):
        if unicodedata.category(chr(i)) == "Cn" and letter.match(chr(i)):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


@lru_cache(maxsize=4)
def id_width(json_path: str) -> int:
    with open(json_path, encoding="utf-8") as f:
        return 2 if len(json.load(f)["model"]["vocab"]) + 16 < 65_536 else 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """A byte's class (mark, white space, letter, digit, not ASCII), and between which two classes pieces always part."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(9, 14), 32]], kind[128:] = 1, 4
    kind[[*range(65, 91), *range(97, 123)]], kind[48:58] = 2, 3
    parts = np.zeros((5, 5), bool)
    parts[[0, 2, 3, 4], 1] = parts[2, [0, 3]] = parts[3, [0, 2]] = True
    return kind, parts.ravel()


#: White space past ASCII, as the bytes of its UTF-8.
WHITE_2, WHITE_3 = ([int.from_bytes(chr(x).encode()) for x in y] for y in ((0x85, 0xA0), (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where to cut texts (UTF-8 on end, beginning at ``starts``): at each start, and where two pre-tokens meet for certain.

    No pre-token has white space after anything else, an ASCII letter before another ASCII character that
    is none, or a digit before one that is none; and a pre-token depends on nothing before it, and on nothing behind it but
    whether white space goes on. So white space is never cut inside, and a part's pre-tokens are the text's.
    """
    kind, parts = _classes()
    of = kind[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = parts[of[:-1] * 5 + of[1:]]
    after = np.flatnonzero((of[:-1] == 4) & (of[1:] == 1)) + 1
    last = [raw[after - k].astype(np.int64) for k in (1, 2, 3)]
    two = last[1] << 8 | last[0]
    cut[after[np.isin(two, WHITE_2) | np.isin(last[2] << 16 | two, WHITE_3)]] = False
    cut[starts[starts < len(raw)]] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=4)
def encoder(json_path: str, pattern: str | None, width: int):
    """A function from texts (a list or an Arrow array) to their packed ids, as the tokenizers library gives them for ``json_path``.

    With ``PATTERN`` as the tokenizer's own pre-token pattern (for one without normaliser and prefix space), texts are cut by
    ``cuts``, Arrow finds the different parts, and a text's ids are its parts' ids in a row. A part that isn't kept is
    cut by the pattern, and the library encodes its pre-tokens. Up to ``MEMO`` parts are kept, the last used; of a part of more
    than ``LONG`` characters its pre-tokens are, up to the same length. Parts with letters so new that the pattern could
    cut them otherwise, and texts with a special token's string, go through the library whole, as all do with
    another pattern or none.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    full, kind = Tokenizer.from_file(json_path), {2: "H", 4: "I"}[width]

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        return [array.array(kind, e.ids).tobytes() for e in full.encode_batch_fast(texts, add_special_tokens=False)]

    if pattern != PATTERN:
        return encode
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    # The library's white space is Unicode's.
    pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    # The byte-level alphabet: printable bytes stand for themselves, others for the code points from 256 on.
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    alphabet = "".join(chr(x if x in shown else next(other)) for x in range(256))
    model = full.model.tokenize
    memo: list[dict[str, bytes]] = [{}, {}]  # the parts used last, and those before

    def settled(text: str) -> bool:
        """Whether all tables agree on the text's letters; nothing below U+0530 is new."""
        return text.isascii() or max(text) < "\u0530" or not _newer_letters().search(text)

    def ids_of_part(part: str) -> bytes:
        if not settled(part):
            return encode([part])[0]
        return array.array(kind, [x.id for piece in pieces(part) for x in model(codecs.charmap_decode(piece.encode(), "strict", alphabet)[0])]).tobytes()

    def known(parts: list[str]) -> list[bytes]:
        out = [*map(memo[0].get, parts)]
        for k in [k for k, ids in enumerate(out) if ids is None]:
            part = parts[k]
            if len(part) > LONG:
                cut = pieces(part) if settled(part) else [part]
                out[k] = b"".join(known(cut)) if len(cut) > 1 else ids_of_part(part)
                continue
            out[k] = memo[1].get(part) or ids_of_part(part)
            if len(memo[0]) >= MEMO // 2:
                memo[:] = [{}, memo[0]]
            memo[0][part] = out[k]
        return out

    def run(texts: list[str] | pa.Array) -> list[bytes]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if not len(texts):
            return []
        _, offsets, raw = texts.buffers()
        starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(raw or b"", np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        at = cuts(raw, starts)
        found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        ids, of = known(found.dictionary.to_pylist()), found.indices.to_numpy()
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        packed, first, n = np.frombuffer(b"".join(ids), kind), (np.cumsum(n) - n)[of], n[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(first - ends[:-1], n)
        where += np.arange(len(where))
        packed = packed[where]
        ends = ends[np.searchsorted(at, starts)].tolist()
        out = [packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for text in special:
            for k in np.flatnonzero(pc.match_substring(texts, text)).tolist():
                out[k] = encode([texts[k].as_py()])[0]
        return out

    return run


def lots(texts: pa.Array) -> Iterator[slice]:
    """Runs of about ``LOT`` bytes of text, of a text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, LOT + (ends[at - 1] if at else 0), "right")))
        yield slice(at, to)
        at = to


def _open(uri: str):
    """The file system and path of a folder; any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Collects documents into frames and writes one file."""

    def __init__(self, sink, width: int, frame_ids: int = FRAME_IDS) -> None:
        import zstandard

        self.sink, self.width, self.frame_ids = sink, width, frame_ids
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.frames, self.docs, self.held, self.n_held, self.n_docs = [], [], [], 0, 0
        self.total = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // self.width
        self.held.append(ids)
        self.docs.append(DOC.pack(doc_id, n))
        self.n_held, self.n_docs, self.total = self.n_held + n, self.n_docs + 1, self.total + n
        if self.n_held >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        if self.n_docs:
            raw = b"".join(self.held)
            packed = self.packer.compress(raw)
            self.sink.write(packed)
            self.frames.append(FRAME.pack(self.n_docs, len(packed), zlib.crc32(raw)))
            self.held, self.n_held, self.n_docs = [], 0, 0

    def close(self) -> None:
        self.flush()
        table = b"".join(self.frames) + b"".join(self.docs) + FOOTER.pack(len(self.frames), len(self.docs), self.width, MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def read_table(source) -> tuple[list, np.ndarray, int]:
    """(frames, documents, bytes of an id) of an open file; a frame: documents, start, bytes, crc32."""
    size = source.size()
    source.seek(size - FOOTER.size)
    n_frames, n_docs, width, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    length = n_frames * FRAME.size + n_docs * DOC.size
    source.seek(size - FOOTER.size - length)
    table = source.read(length)
    frames, at = [], 0
    for docs, packed, crc in FRAME.iter_unpack(table[: n_frames * FRAME.size]):
        frames.append((docs, at, packed, crc))
        at += packed
    return frames, np.frombuffer(table[n_frames * FRAME.size :], np.dtype([("id", "<i8"), ("n", "<u4")])), width


def read_frame(source, frame: tuple) -> bytes:
    """The decompressed bytes of one frame; raises if they don't have its checksum."""
    import zstandard

    _, at, packed, crc = frame
    source.seek(at)
    raw = zstandard.ZstdDecompressor().decompress(source.read(packed))
    if zlib.crc32(raw) != crc:
        raise ValueError(f"frame at {at}: wrong checksum")
    return raw


def write(df: DataFrame, folder: str, json_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """Writes the files of ``df`` into ``folder`` and returns the manifest (file, n_docs, n_ids)."""
    spark = df.sparkSession
    prepare(spark)
    src = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = id_width(json_path)
        run, task, end = encoder(json_path, pattern, width), TaskContext.get(), end_id.to_bytes(width, "little")
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        name = f"part-{task.partitionId():06d}.tok"
        draft = f"{top}/.{name}.{task.taskAttemptId()}"
        with fs.open_output_stream(draft) as sink:
            out = Writer(sink, width)
            for batch in batches:
                for lot in lots(batch["text"]):
                    for doc, ids in zip(batch["id"][lot].to_pylist(), run(batch["text"][lot]), strict=True):
                        out.add(doc, ids + end)
            out.close()
        fs.move(draft, f"{top}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(out.docs)], "n_ids": [out.total]})

    made = src.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(save, "file string, n_docs long, n_ids long")
    made.write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return spark.read.schema(made.schema).parquet(f"{folder}/manifest.parquet")


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as 32-bit integers) of a folder's documents, by file.

    ``wanted(doc_id)``: only these documents, and only frames that hold one are decompressed. The wanted
    ids are grouped by the files whose range holds them, so no task sees more than one file's.
    """
    prepare(spark)
    manifest = spark.read.parquet(f"{folder}/manifest.parquet").where("n_docs > 0")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A task for each file: a stated number of partitions is kept.
    files = manifest.withColumn("before", before.cast("long")).select("file", "before").repartition(max(1, manifest.count()), "file")
    out_schema = "doc_id long, start long, n_tokens long, ids binary"

    def rows(name: str, before: int, only) -> Iterator[pd.DataFrame]:
        fs, top = _open(folder)
        with fs.open_input_file(f"{top}/{name}") as source:
            frames, docs, width = read_table(source)
            starts = before + np.concatenate([[0], np.cumsum(docs["n"], dtype=np.int64)])
            at = 0
            for frame in frames:
                k = slice(at, at + frame[0])
                at += frame[0]
                keep = np.ones(frame[0], bool) if only is None else np.isin(docs["id"][k], only)
                if not keep.any():
                    continue
                ids = np.frombuffer(read_frame(source, frame), f"<u{width}").astype("<u4")
                ends = np.cumsum(docs["n"][k], dtype=np.int64)
                lists = [ids[e - n : e].tobytes() for e, n, yes in zip(ends, docs["n"][k].astype(int), keep, strict=True) if yes]
                own = docs["id"][k][keep]
                yield pd.DataFrame({"doc_id": pd.array(own, dtype="Int64").copy() if (own != NULL_ID).all() else pd.array([None if x == NULL_ID else x for x in own.tolist()], dtype="Int64"), "start": starts[:-1][k][keep], "n_tokens": docs["n"][k][keep].astype(np.int64), "ids": lists})

    def all_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, before in zip(pdf["file"], pdf["before"], strict=True):
                yield from rows(name, int(before), None)

    if wanted is None:
        return files.mapInPandas(all_of, out_schema)

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, before in zip(pdf["file"], pdf["before"], strict=True):
                fs, top = _open(folder)
                with fs.open_input_file(f"{top}/{name}") as source:
                    docs = read_table(source)[1]
                yield pd.DataFrame({"file": [name], "before": [before], "lo": [int(docs["id"].min())], "hi": [int(docs["id"].max())]})

    def some_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [*rows(key[0], int(key[1]), pdf["id"].to_numpy())]
        return pd.concat(got) if got else pd.DataFrame({"doc_id": pd.array([], "Int64"), "start": [], "n_tokens": [], "ids": []})

    spans = files.mapInPandas(ranges, "file string, before long, lo long, hi long")
    asked = wanted.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")).distinct()
    dealt = asked.join(F.broadcast(spans), F.col("id").between(F.col("lo"), F.col("hi")))  # a row for each file
    return dealt.groupBy("file", "before").applyInPandas(some_of, out_schema)


def ids_of(raw: bytes) -> list[int]:
    return array.array("I", raw).tolist()
