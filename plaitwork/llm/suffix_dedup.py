"""Suffix-array dedup of byte strings: remove every byte that a repeated ``span``-byte string covers.

Two ``span``-byte strings (windows) are equal when their suffixes agree through ``span`` bytes, so windows
fall into the groups that a most-significant-digit radix sort of all suffixes, stopped at that depth, leaves
together. One row a suffix would be some ten times the text, so the suffixes are not sorted one by one:

* The first digit is the window's anchor: of its runs of ``GRAM`` bytes the one of least hash. Equal windows have equal
  anchors at equal offsets, and neighbouring windows mostly share theirs, so a row stands for a run of windows
  with one anchor, about 1 for each 70 bytes. Rows are dealt by anchor once, and pass 1 drops an anchor's
  only row.
* Pass 2, on the same deal, compares the whole runs of windows, by hash and length: a run that occurs again is
  repeated throughout. This settles the insides of copies.
* Pass 3 takes the digits of the bytes themselves: what is left, the edges where copies part, are the suffixes of
  each anchor's group, ordered by most-significant-digit passes of 8 bytes through ``span`` bytes. A pass orders inside the
  groups of the pass before and drops the suffixes that are alone; the groups left at the end are exactly the
  repeated windows. One copy of each different run is enough there. A group with over ``BIG_GROUP`` of them is never
  brought together: the task that cuts its runs from the texts settles what is repeated there, and deals the rest by window
  hash, packed in a row for each of as many buckets as there are ``BUCKET`` windows; a bucket counts repeats by hash.

Before the deal, a task settles the runs that it holds twice: it sends one of them under their anchor, marked
as repeated, and the others under keys of their own, so a passage in a third of all texts gives its
anchor a row for each lot of texts only. A run ends where another place in the text becomes the (last) least one, so no two
windows of one run are equal, and copies inside one text, overlapping or not, are found like any other.
Matches never cross texts. Runs are compared by 64 bits of anchor and 64 of content, windows of big groups by 128-bit polynomial
hashes over random odd bases, drawn once and fixed. Long texts are hashed in segments; a run cut there
is settled in pass 3.

Null counts as empty; texts under ``span`` bytes have no windows. Rows that repeat an id are texts of
their own: rows are told apart by 96 bits of hash of id and text, and equal rows repeat each other. Text is handled as UTF-8 bytes: kept bytes can end inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.llm._util import prepare, staged

SPAN, GRAM, BIG_GROUP, BUCKET, SEGMENT = 200, 32, 1_000, 500_000, 1_000_000

#: A window of a big group: its hash, its text's key, its start, and 2 where it speaks for windows that are settled, else 1.
WINDOW = np.dtype([("h", "<u8"), ("h2", "<u8"), ("row", "<i8"), ("row2", "<i4"), ("a", "<i4"), ("n", "<i4")])

_RNG = np.random.default_rng(77)
_TABLES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _RNG.integers(2**60, 2**63, 2, dtype=np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes_of(data: np.ndarray, lengths: tuple[int, ...], which: int) -> dict[int, np.ndarray]:
    """For each length, the polynomial hash of every run of that many bytes, by doubling."""
    base = _BASES[which]
    power = lambda e: np.uint64(pow(base, e, 2**64))
    level, size, done = _TABLES[which][data], 1, {x: (0, None) for x in lengths}
    while True:
        for x, (have, h) in done.items():
            if x & size:  # append this power of two to what is there
                n = len(data) - have - size + 1
                if n <= 0:
                    done[x] = (have + size, np.empty(0, np.uint64))
                elif h is None:
                    done[x] = (size, level[:n])
                else:
                    done[x] = (have + size, h[:n] * power(size) + level[have : have + n])
        if size * 2 > max(lengths):
            return {x: h for x, (_, h) in done.items()}
        level = level[:-size] * power(size) + level[size:] if len(level) > size else np.empty(0, np.uint64)
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, step = h, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(texts: list[bytes], span: int, most: int = SEGMENT) -> Iterator[list[tuple[int, int, bytes]]]:
    """Parts of ``texts``, (place in the list, offset, bytes), in lots of about ``most`` bytes.

    The parts of a long text overlap by ``span - 1`` bytes, so that each window is in just one.
    """
    lot, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - span + 1, 1), most):
            part = t[at : at + most + span - 1]
            if lot and size + len(part) > most:
                yield lot
                lot, size = [], 0
            lot.append((k, at, part))
            size += len(part)
    if lot:
        yield lot


def runs(parts: list[bytes], span: int) -> dict[str, np.ndarray] | None:
    """The runs of windows with one anchor: part (its place in the list), first, count, anchor, u, seen."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < span:
        return None
    sizes = np.array([len(t) for t in parts], np.int64)
    ends = np.cumsum(sizes)
    got = hashes_of(data, (GRAM, span), 0)
    win, grams = got[span], _mix(got[GRAM])
    low, newest = sliding_min(grams, span - GRAM + 1), grams[span - GRAM :]
    part = np.repeat(np.arange(len(parts)), sizes)[: len(win)]
    at = np.flatnonzero(np.arange(len(win)) + span <= ends[part])
    if not len(at):
        return None
    part, low, newest, win = part[at], low[at], newest[at], win[at]
    new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (part[1:] != part[:-1]) | (newest[1:] == low[1:])])
    count = np.diff(np.r_[new, len(at)])
    # The windows' mixed hashes, summed with their places in the run: equal runs have equal sums.
    place = np.arange(len(at)) - np.repeat(new, count)
    weight = _mix(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    u = np.add.reduceat(_mix(win) * weight, new)
    first = at[new] - (ends - sizes)[part[new]]
    # Of equal runs here, one speaks for all under their anchor; the others are settled and get keys of their own.
    anchor = low[new].copy()
    _, lead, code, n = np.unique(_mix(anchor) ^ u ^ count.astype(np.uint64), return_index=True, return_inverse=True, return_counts=True)
    seen = np.minimum(n[code], 2)
    other = lead[code] != np.arange(len(new))
    anchor[other] = _mix(anchor[other] + _mix(part[new][other].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * first[other].astype(np.uint64) + u[other]))
    return {"part": part[new], "first": first, "count": count, "anchor": anchor.view(np.int64), "u": u.view(np.int64), "seen": seen}


def hashed_windows(blobs: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every window of the blobs: its blob, its offset there and the two halves of its hash."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    ends = np.cumsum(sizes)
    h, h2 = hashes_of(data, (span,), 0)[span], hashes_of(data, (span,), 1)[span]
    owner = np.repeat(np.arange(len(blobs)), sizes)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + span <= ends[owner])
    owner = owner[at]
    return owner, at - (ends - sizes)[owner], h[at], _mix(h2[at])


def repeated_windows(blobs: list[bytes], copies: np.ndarray, anchors: np.ndarray, span: int) -> list[np.ndarray]:
    """For each blob, a mask of its windows that are there again, in it or another; copies: how often a blob is there.

    A most-significant-digit radix sort of the windows' suffixes, stopped at ``span`` bytes: the first digit is the anchor, the
    others are 8 bytes each (the last may overlap the one before).
    """
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(blobs)), sizes)
    at = np.flatnonzero(np.arange(len(data)) + span <= ends[owner])
    digits, padded = np.zeros(len(data), np.uint64), np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        digits = (digits << np.uint64(8)) | padded[k : k + len(data)]
    group = np.unique(anchors, return_inverse=True)[1][owner[at]]
    order = np.argsort(group, kind="stable")
    live, group = at[order], group[order]
    for depth in (*range(0, span - 8, 8), span - 8):
        digit = digits[live + depth]
        new = np.r_[True, group[1:] != group[:-1]][: len(live)]
        # Only groups in which the digit differs are ordered by it.
        differs = np.r_[False, digit[1:] != digit[:-1]][: len(live)] & ~new
        number = np.cumsum(new) - 1
        k = np.flatnonzero((np.bincount(number, weights=differs) > 0)[number]) if len(live) else number
        order = np.lexsort((digit[k], number[k]))
        live[k], digit[k] = live[k][order], digit[k][order]
        group = np.cumsum(new | np.r_[True, digit[1:] != digit[:-1]][: len(live)]) - 1
        keep = np.bincount(group, weights=copies[owner[live]])[group] > 1 if len(live) else np.zeros(0, bool)
        live, group = live[keep], group[keep]
    found = np.zeros(len(data), bool)
    found[live] = True
    return np.split(found[at], np.cumsum(sizes - span + 1)[:-1])


def window_rows(pdf: pd.DataFrame, span: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Rows (bucket, windows, row, row2, a, b) of a lot of runs, others null: packed windows for a bucket, or a text's stretches that are settled.

    A window is sent once, however often it is in the lot; windows that are there twice are settled but for one that speaks for them.
    """
    copies = pdf["copies"].to_numpy()
    owner, offset, h, h2 = hashed_windows(pdf["blob"].tolist(), span)
    _, lead, code = np.unique(h ^ h2, return_index=True, return_inverse=True)
    n = np.minimum(np.bincount(code, weights=copies[owner]), 2).astype(np.int32)
    row, row2 = (pdf[c].to_numpy()[owner] for c in ("row", "row2"))
    a = pdf["first"].to_numpy()[owner] + offset
    packed = np.empty(len(lead), WINDOW)
    for c, x in (("h", h[lead]), ("h2", h2[lead]), ("row", row[lead]), ("row2", row2[lead]), ("a", a[lead]), ("n", n)):
        packed[c] = x
    bucket = (packed["h"] % np.uint64(buckets)).astype(np.int64)
    own = np.unique(bucket)
    none = lambda k: [None] * k
    yield pd.DataFrame({"bucket": own, "windows": [packed[bucket == k].tobytes() for k in own], **{c: none(len(own)) for c in ("row", "row2", "a", "b")}})
    settled = np.flatnonzero((n[code] > 1) & (copies[owner] == 1))
    if len(settled):
        found = stretches(row[settled], row2[settled], a[settled], span)
        yield pd.DataFrame({"bucket": none(len(found)), "windows": none(len(found)), **{c: found[c] for c in ("row", "row2", "a", "b")}})


def stretches(row: np.ndarray, row2: np.ndarray, a: np.ndarray, span: int) -> pd.DataFrame:
    """(row, row2, a, b) for each text: the starts and ends of its maximal stretches of windows, as lists."""
    order = np.lexsort((a, row2, row))
    row, row2, a = row[order], row2[order], a[order]
    other = np.r_[True, (row[1:] != row[:-1]) | (row2[1:] != row2[:-1])]
    new = np.flatnonzero(other | np.r_[True, a[1:] > a[:-1] + 1])
    last = np.r_[new[1:] - 1, len(a) - 1]
    texts = np.flatnonzero(other)
    cut = np.searchsorted(new, texts[1:])
    return pd.DataFrame({"row": row[texts], "row2": row2[texts], "a": np.split(a[new].astype(np.int32), cut), "b": np.split((a[last] + span).astype(np.int32), cut)})


def repeated_in_bucket(parts: list[bytes], span: int) -> pd.DataFrame:
    """The stretches of the windows of a bucket that are there again."""
    w = np.frombuffer(b"".join(parts), WINDOW)
    w = w[np.lexsort((w["h2"], w["h"]))]
    new = np.flatnonzero(np.r_[True, (w["h"][1:] != w["h"][:-1]) | (w["h2"][1:] != w["h2"][:-1])])
    total = np.repeat(np.add.reduceat(w["n"], new), np.diff(np.r_[new, len(w)]))
    w = w[(total > 1) & (w["n"] == 1)]
    return stretches(w["row"], w["row2"], w["a"], span) if len(w) else pd.DataFrame({"row": [], "row2": [], "a": [], "b": []})


def whole_groups(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Lots of about ``most`` rows of a sorted partition, which never part the rows of an anchor."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for at in range(0, len(pdf), most):
            held.append(pdf.iloc[at : at + most])
            lot = pd.concat(held, ignore_index=True)
            last = lot["anchor"] == lot["anchor"].iloc[-1]
            if not last.all():
                yield lot[~last]
                lot = lot[last]
            held = [lot]
    if held:
        yield pd.concat(held, ignore_index=True)


def _intervals(mask: np.ndarray, start: int, span: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(start + int(a), start + int(b) - 1 + span) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``text``, the bytes removed and the maximal removed runs."""
    kept, at, removed, n = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            n += 1
        if b > end:
            a = max(a, end, 0)
            kept.append(text[at:a])
            removed += b - a
            at = end = b
    kept.append(text[at:])
    return b"".join(kept), removed, n


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, big_group: int = BIG_GROUP) -> DataFrame:
    """(``id_col``, n_bytes, n_removed, n_spans, kept binary), a row for each row of ``docs``."""
    if span < 2 * GRAM:
        raise ValueError(f"span must be {2 * GRAM} or more")
    spark = docs.sparkSession
    prepare(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = plain.select("id", F.xxhash64("id", "text").alias("row"), F.hash("id", "text").alias("row2"), F.encode("text", "UTF-8").alias("text"))
    row = ["row", "row2"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [pdf[c].to_numpy() for c in row]
            for lot in segments(pdf["text"].tolist(), span):
                r = runs([x[2] for x in lot], span)
                if r is not None:
                    own, offset = np.array([x[0] for x in lot])[r["part"]], np.array([x[1] for x in lot])[r["part"]]
                    yield pd.DataFrame({"row": keys[0][own], "row2": keys[1][own], "first": (r["first"] + offset).astype(np.int32), "count": r["count"].astype(np.int32), "anchor": r["anchor"], "u": r["u"], "seen": r["seen"].astype(np.int32)})

    schema = "row long, row2 int, first int, count int, anchor long, u long, seen int"
    found = keyed.where(F.octet_length("text") >= span).select(*row, "text").mapInPandas(find, schema)
    # All windows are over one deal by anchor. A kind: the equal runs of one anchor.
    group, kind = Window.partitionBy("anchor"), Window.partitionBy("anchor", "u", "count")
    again = found.withColumn("n", F.sum("seen").over(group)).where("n > 1")
    counted = again.withColumn("nr", F.row_number().over(kind.orderBy(*row, "first"))).withColumn("copies", F.sum("seen").over(kind))
    told = counted.withColumn("least", F.min("copies").over(group)).withColumn("kinds", F.sum(F.when(F.col("nr") == 1, 1).otherwise(0)).over(group))
    # Pass 3 gets one row of each kind of the anchors with several kinds of which one isn't settled.
    open_ = (F.col("kinds") > 1) & (F.col("least") == 1) & (F.col("nr") == 1)
    told = told.where((F.col("copies") > 1) | open_).select(*row, "first", "count", F.when(open_, F.col("anchor")).alias("anchor"), "kinds", F.least("copies", F.lit(2)).alias("copies"))
    left = staged(told, "runs")
    full = left.where("copies > 1").select(*row, F.col("first").alias("a"), (F.col("first") + F.col("count") - 1 + span).alias("b"))
    edges = left.where("anchor is not null")
    columns = ["first", "count", "anchor", "copies"]
    bytes_of = lambda e: F.substring("text", e["first"] + 1, e["count"] - 1 + span).alias("blob")
    cut = F.transform("runs", lambda e: F.struct(*[e[c].alias(c) for c in columns], bytes_of(e)))

    def blobs(some: DataFrame) -> DataFrame:
        by_row = some.groupBy(*row).agg(F.collect_list(F.struct(*columns)).alias("runs"))  # as many as the text has
        return keyed.select(*row, "text").join(by_row, row).select(*row, F.explode(cut).alias("e")).select(*row, "e.*")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, 8_192):
            masks = repeated_windows(pdf["blob"].tolist(), pdf["copies"].to_numpy(), pdf["anchor"].to_numpy(), span)
            out = [(r, r2, a, b) for r, r2, f, c, m in zip(pdf["row"], pdf["row2"], pdf["first"], pdf["copies"], masks, strict=True) if c == 1 for a, b in _intervals(m, int(f), span)]
            yield pd.DataFrame(out, columns=[*row, "a", "b"])

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2_048):
                yield from window_rows(pdf.iloc[at : at + 2_048], span, buckets)

    edge = blobs(edges.where(F.col("kinds") <= big_group)).repartition("anchor").sortWithinPartitions("anchor").mapInPandas(settle, "row long, row2 int, a int, b int")
    each = full.unionByName(edge).select(*row, F.array(F.struct("a", "b")).alias("spans"))
    big = edges.where(F.col("kinds") > big_group)
    windows = big.agg(F.sum("count")).first()[0]
    if windows:
        buckets = -(-windows // BUCKET)
        pairs = "row long, row2 int, a array<int>, b array<int>"
        sent = staged(blobs(big).mapInPandas(scatter, f"bucket long, windows binary, {pairs}"), "windows")
        met = sent.where("bucket is not null").groupBy("bucket").applyInPandas(lambda pdf: repeated_in_bucket(pdf["windows"].tolist(), span), pairs)
        settled = sent.where("bucket is null").select(*row, "a", "b").unionByName(met)
        each = each.unionByName(settled.select(*row, F.arrays_zip("a", "b").alias("spans")))
    spans = each.groupBy(*row).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # bounded by the text

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [remove(t, [(x["a"], x["b"]) for x in s] if s is not None else []) for t, s in zip(pdf["text"], pdf["spans"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(t) for t in pdf["text"]], "n_removed": [x[1] for x in done], "n_spans": [x[2] for x in done], "kept": [x[0] for x in done]})

    out = keyed.join(spans, row, "left").select("id", "text", "spans").mapInPandas(finish, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
