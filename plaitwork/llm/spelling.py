"""Spelling variant grouping: words one edit apart, each led to its commonest neighbour, by dense prefix-suffix tiling.

Words come with their counts. Two words are near if one inserted, deleted or replaced code point tells them apart. A word's form
is its near word of the largest count (ties: smallest in code-point order) where that is at least twice its own; its root is
where its forms end.

1. Groups. Of two near words, the longer of length L, the common prefix or the common suffix has L // 2 code points or more: one
   edit leaves one half whole. So words of length L and L - 1 meet by their first and by their last L // 2 code points, four rows a word.
2. Tiles. A group's words are dealt by hash to blocks of some ``BLOCK`` words, and each pair of blocks is a tile, a few
   thousand words at most, sent to a task of its own; a hot prefix is many tiles.
3. Inside a tile words are rows of padded code-point matrices, one aligned on the left, one on the right. All pairs are
   compared position by position; a pair is near if common prefix plus common suffix reaches the longer length minus one.
   A pair that both groups hold counts in that of its prefix only. Tiles give a word its number of near words and the best
   of them, so no pair leaves a task.
4. Roots by pointer doubling: counts at least double along the forms, so a chain of forms has 63 links at most.

Null or empty texts have no words. A null id counts as no characters in the hash that damages runs. Repeated rows count as
often as they are there. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm._util import LOWER, UPPER, prepare, staged

#: What a run of letters is, and which runs lose a code point.
RUN, DAMAGED = "[A-Za-zÀ-ÿ]+", 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of a block; cells of a tile that are compared at a time; rows that a task gathers before it compares.
BLOCK, CELLS, ROWS = 2_048, 1_000_000, 65_536


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, and their numbers.

    Of a run whose hash with its document's id is divisible by ``DAMAGED``, one code point is left out first.
    """
    runs = F.filter(F.regexp_extract_all(F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= min_length)
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _tiles(words: DataFrame, block: int) -> DataFrame:
    """(size, side, key, i, j, own, word, n): words by group and tile; i <= j are blocks, own the word's."""
    each = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    keys = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("key")), F.struct(F.lit(1).alias("side"), F.substring("word", -half, half).alias("key")))
    keyed = each.select("word", "n", "size", F.explode(keys).alias("k")).select("word", "n", "size", "k.*")
    longer = F.count(F.when(F.length("word") == F.col("size"), 1))
    groups = keyed.groupBy("size", "side", "key").agg(F.count(F.lit(1)).alias("members"), longer.alias("longer")).where("members > 1 and longer > 0")
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = keyed.join(groups, ["size", "side", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return cells.select("size", "side", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


def _codes(words: list[str], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words aligned on the left and on the right, padded by -1."""
    left = np.array(words, dtype=f"U{width}").view(np.int32).reshape(len(words), width)
    left = left.astype(np.int16 if left.max(initial=0) < 2**15 else np.int32)
    left[np.arange(width)[None, :] >= size[:, None]] = -1
    at = np.arange(width)[None, :] - (width - size)[:, None]
    right = np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), axis=1), left.dtype.type(-1))
    return left, right


def _near(left: np.ndarray, right: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int, suffixes: bool) -> np.ndarray:
    """near[c, x, y]: whether words a[c, x] and b[c, y] of tile c are near; places of -1 have no word."""
    half = longest // 2
    la, lb = (np.where(p >= 0, size[p], 0) for p in (a, b))
    # Positions without a symbol differ from each other, too.
    side = lambda codes, p, pad: np.where((p >= 0)[..., None] & (codes[p] >= 0), codes[p], codes.dtype.type(pad))
    out = (np.maximum(la[:, :, None], lb[:, None, :]) == longest) & (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (a[:, :, None] != b[:, None, :])

    def common(codes: np.ndarray, order: range, known: int, most: int) -> np.ndarray:
        """Common symbols in order, of which ``known`` are there already, up to ``most``."""
        x, y = side(codes, a, -1), side(codes, b, -2)
        total = np.full(out.shape, known, np.int16)
        run = out.copy()
        for j in order[known:most]:
            run &= x[:, :, None, j] == y[:, None, :, j]
            if not run.any():
                break
            total += run
        return total

    width = left.shape[1]
    ahead, back = range(width), range(width - 1, -1, -1)
    # A group's words share one half already; the other end counts up to what is still needed.
    if suffixes:
        prefix, suffix = common(left, ahead, 0, half), common(right, back, half, longest)
        out &= prefix < half  # else the group of the prefix has the pair
    else:
        prefix, suffix = common(left, ahead, half, longest), common(right, back, 0, longest - half)
    return out & (prefix + suffix >= longest - 1)


def compare(words: list[str], n: np.ndarray, longest: np.ndarray, side: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, near words, place of the best) for the words that have near ones in their tile. Tiles begin at ``starts``."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    left, right = _codes(words, size, int(size.max()))
    ends = np.r_[starts[1:], len(words)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lots: dict[tuple, list] = {}
    for at, to in zip(starts.tolist(), ends.tolist(), strict=True):
        rows = np.arange(at, to)
        if i[at] == j[at]:
            a = b = rows
        else:
            a, b = rows[own[at:to] == i[at]], rows[own[at:to] == j[at]]
        if len(a) and len(b):
            wide = lambda x: 1 << max(1, (len(x) - 1).bit_length())
            lots.setdefault((int(longest[at]), int(side[at]), a is b, wide(a), wide(b)), []).append((a, b))
    for (longer, suffixes, same, wa, wb), tiles in lots.items():
        strip = max(1, min(wa, CELLS // wb))
        per = max(1, CELLS // (wa * wb))
        for t in range(0, len(tiles), per):
            some = tiles[t : t + per]
            grid = [np.full((len(some), w), -1, np.int64) for w in (wa, wb)]
            for c, pair in enumerate(some):
                for g, rows in zip(grid, pair, strict=True):
                    g[c, : len(rows)] = rows
            for top in range(0, wa, strip):
                a = grid[0][:, top : top + strip]
                c, x, y = np.nonzero(_near(left, right, size, a, grid[1], longer, bool(suffixes)))
                p, q = a[c, x], grid[1][c, y]
                # In a block with itself each pair is there both ways.
                found.append((p, q))
                if not same:
                    found.append((q, p))
    p, q = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[q], -n[q], p))
    p, q = p[order], q[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][: len(p)])
    return p[first], np.diff(np.r_[first, len(p)]), q[first]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best): the number of near words, and the one of the largest count, for the words that have any."""
    prepare(words.sparkSession)
    cell = ["size", "side", "key", "i", "j"]
    schema = "word string, n_near long, rank struct<down: long, word: string>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def done(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            column = lambda c: table.column(c).to_numpy()
            p, count, q = compare(table.column("word").to_pylist(), column("n"), *map(column, ("size", "side", "i", "j", "own")), starts)
            word = table.column("word").combine_chunks()
            best = pa.StructArray.from_arrays([pa.array(-column("n")[q]), word.take(pa.array(q))], ["down", "word"])
            return pa.RecordBatch.from_arrays([word.take(pa.array(p)), pa.array(count.astype(np.int64)), best], names=["word", "n_near", "rank"])

        def begin(table: pa.Table) -> np.ndarray:
            new = np.zeros(max(0, table.num_rows - 1), bool)
            for c in cell:
                x = table.column(c).combine_chunks()
                new |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            return np.flatnonzero(np.r_[True, new])

        def gathered() -> Iterator[pa.Table]:
            held, rows = [], 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= ROWS:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
            if held:
                yield pa.Table.from_batches(held)

        rest = None
        for table in gathered():
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            starts = begin(table)
            rest = table.slice(int(starts[-1]))
            if len(starts) > 1:
                yield done(table.slice(0, int(starts[-1])), starts[:-1])
        if rest is not None and rest.num_rows:
            yield done(rest, np.zeros(1, np.int64))

    spark = words.sparkSession
    # A stated number of groups, so that small rows with much work aren't merged into few tasks.
    groups = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tiles = _tiles(words, block).repartition(groups, *cell).sortWithinPartitions(*cell)
    found = tiles.mapInArrow(run, schema)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("rank").alias("rank"))
    return best.select("word", "n_near", (-F.col("rank.down")).alias("best_n"), F.col("rank.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms(word, form)`` end, for each word that has one."""
    now = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.where("moved").isEmpty():
        later = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(later, "root", "left")
        now = staged(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
    return now.select("word", "root")


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words(word, n)``, whose words differ from each other."""
    known = staged(words.select("word", "n"), "spelling-words")
    near = known.join(near_words(known, block), "word", "left")
    led = F.col("best_n") >= 2 * F.col("n")
    formed = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
