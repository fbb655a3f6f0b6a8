"""Byte-level BPE by ranks: overlapping chunks, stitched where pre-token boundaries agree.

A text is cut into chunks of ``chunk_chars`` characters that reach ``overlap_chars`` into the next
one. Chunks are pre-tokenised independently. Both neighbours list the boundaries they see in
the overlap at which a non-space meets a white space (no match of the pattern crosses such a place,
wherever matching began); the first one on both lists is the seam. The text between two seams is
then encoded by the ranks, and the pieces' ids are concatenated in chunk order. Where an overlap
has no seam (a huge run without white space), the two chunks are encoded as one piece, so the result is
exact for any text. Decoding concatenates the bytes of the ids.

Texts of one chunk never leave the task that read them; only chunks of longer ones are shuffled, so
that a giant text is encoded by many tasks. These are known by 96 bits of hash of row and text, so that a task that runs
again makes the same rows; long rows that are equal in all columns are encoded once and counted. Null text counts as empty; an empty text has no ids.
Rows with equal ids are separate rows.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.llm._util import prepare, staged

CHUNK_CHARS, OVERLAP_CHARS, BATCH = 32_768, 1_024, 256


@lru_cache(maxsize=4)
def load_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})


@lru_cache(maxsize=4)
def byte_table(ranks_path: str) -> list[bytes]:
    ranks = load_ranks(ranks_path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return table


@lru_cache(maxsize=4)
def matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def seams(text: str, lo: int, hi: int, pattern: str) -> list[int]:
    """Boundaries in [lo, hi) of the pre-tokens of ``text`` at which a non-space meets a white space."""
    out = []
    for m in matcher(pattern).finditer(text, 0):
        at = m.start()
        if at >= hi:
            break
        if at >= lo and at > 0 and text[at].isspace() and not text[at - 1].isspace() and text[at] not in "\x1c\x1d\x1e\x1f":
            out.append(at)
    return out


def head_and_tail(text: str, chunk: int, overlap: int, first: bool, last: bool, pattern: str) -> tuple[list[int], list[int]]:
    """Seams that a chunk sees in its first ``overlap`` characters, and in the next chunk's."""
    heads = [] if first else seams(text, 1, overlap, pattern)
    tails = [] if last else [x - chunk for x in seams(text, chunk + 1, len(text), pattern)]
    return heads, tails


def _ids(values: list[int]) -> bytes:
    return array.array("I", values).tobytes()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(``id_col``, ``carry``, ids binary): each text's ids as little-endian unsigned 32-bit integers."""
    spark = df.sparkSession
    prepare(spark)
    named = {f"c{k}": c for k, c in enumerate((id_col, *carry))}
    own = [*named]
    types = ", ".join(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in named.items())
    src = df.select(*[F.col(c).alias(k) for k, c in named.items()], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunk = int(chunk_chars)
    overlap = min(OVERLAP_CHARS, chunk // 2)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks_path, pattern)
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                yield part[[*named]].assign(ids=[_ids(enc.encode_ordinary(t)) for t in part["text"]])

    short = src.where(F.length("text") <= chunk).mapInPandas(whole, f"{types}, ids binary")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, text in enumerate(pdf["text"]):
                starts = range(0, max(len(text), 1), chunk)
                for a in range(0, len(starts), 64):
                    ks = range(a, min(a + 64, len(starts)))
                    same = pdf[["row", *own]].iloc[[at] * len(ks)].reset_index(drop=True)
                    yield same.assign(k=[*ks], last=[k == len(starts) - 1 for k in ks], text=[text[starts[k] : starts[k] + chunk + overlap] for k in ks])

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 32):
                part = pdf.iloc[at : at + 32].copy()
                seen = [head_and_tail(t, chunk, overlap, k == 0, last, pattern) for t, k, last in zip(part["text"], part["k"], part["last"], strict=True)]
                part["heads"], part["tails"] = [x[0] for x in seen], [x[1] for x in seen]
                yield part

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks_path, pattern)
        for pdf in batches:
            ids = [_ids(enc.encode_ordinary(text[lo:hi])) for text, lo, hi in zip(pdf["text"], pdf["lo"], pdf["hi"], strict=True)]
            yield pdf[["row", *own, "k"]].assign(ids=ids)

    hashed = src.where(F.length("text") > chunk).groupBy(F.concat_ws("-", F.xxhash64(*own, "text"), F.hash(*own, "text")).alias("row"))
    long = hashed.agg(*[F.first(c).alias(c) for c in (*own, "text")], F.count(F.lit(1)).alias("copies"))
    long = long.select("row", *own, "copies", "text")
    own, types = [*own, "copies"], f"{types}, copies long"
    dealt = long.mapInPandas(windows, f"row string, {types}, k int, last boolean, text string").repartition(F.col("row"), F.col("k"))
    seen = staged(dealt.mapInPandas(pretokenise, f"row string, {types}, k int, last boolean, text string, heads array<int>, tails array<int>"), "bpe-chunks")
    # The seam before chunk k: the first place that chunk k - 1 (tails) and chunk k (heads) both list.
    seam = (
        seen.select("row", (F.col("k") + 1).alias("k"), "tails")
        .join(seen.select("row", "k", "heads"), ["row", "k"])
        .select("row", "k", F.get(F.array_intersect("heads", "tails"), F.lit(0)).alias("seam"))
    )
    cut = seen.drop("heads", "tails").join(seam, ["row", "k"], "left")
    # Chunks without a seam before them join the run of the chunk before; a run is one piece.
    by_row = Window.partitionBy("row").orderBy("k")
    runs = (
        seen.select("row", "k")
        .join(seam, ["row", "k"], "left")
        .select("row", "k", "seam", F.sum(F.when((F.col("k") == 0) | F.col("seam").isNotNull(), 1).otherwise(0)).over(by_row).alias("run"), F.lead("seam").over(by_row).alias("next_seam"))
    )
    whole_runs = (
        cut.select("row", *own, "k", F.substring("text", 1, chunk).alias("body"), "text")
        .join(runs, ["row", "k"])
        .groupBy("row", "run")
        .agg(
            *[F.first(c).alias(c) for c in own],
            F.min("k").alias("k"),
            F.sort_array(F.collect_list(F.struct("k", "body", F.substring("text", chunk + 1, overlap).alias("over"), "seam", "next_seam"))).alias("parts"),
        )
        .select(
            "row",
            *own,
            "k",
            F.concat(F.concat_ws("", F.col("parts.body")), F.element_at("parts", -1)["over"]).alias("text"),
            F.coalesce(F.col("parts")[0]["seam"], F.lit(0)).alias("lo"),
            (F.lit(chunk) * (F.size("parts") - 1) + F.coalesce(F.element_at("parts", -1)["next_seam"] + chunk, F.lit(chunk + overlap))).alias("hi"),
        )
    )
    encoded = whole_runs.mapInPandas(pieces, f"row string, {types}, k int, ids binary")
    joined = (
        encoded.groupBy("row")
        .agg(*[F.first(c).alias(c) for c in own], F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select(*own, F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
    )
    joined = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*named, "ids")
    return short.unionByName(joined).select(*[F.col(k).alias(c) for k, c in named.items()], "ids")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, bytes binary): the concatenated bytes of the ids; unknown ids raise."""
    prepare(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = byte_table(ranks_path)
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                yield pd.DataFrame({"id": part["id"], "bytes": [b"".join(map(table.__getitem__, array.array("I", x))) if x is not None else None for x in part["ids"]]})

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {id_type}, bytes binary").select(F.col("id").alias(id_col), "bytes")


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(``id_col``, ids binary, bytes binary): both directions of each text, kept on one row."""
    prepare(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = byte_table(ranks_path)
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                yield pd.DataFrame({"id": part["id"], "ids": part["ids"], "bytes": [b"".join(map(table.__getitem__, array.array("I", x))) for x in part["ids"]]})

    ids = encode(df, ranks_path, pattern, id_col, text_col, chunk_chars)
    return ids.withColumnRenamed(id_col, "id").mapInPandas(run, f"id {id_type}, ids binary, bytes binary").withColumnRenamed("id", id_col)
