"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A text's lines are split at ``\\n``; lines of nothing but white space are left out of the windows. A window is ``max_lines`` consecutive other
lines, or the shortest run of fewer lines that has ``min_words`` words. What is repeated is a run of lines that holds a whole window.

1. Fingerprints: of each window the position of its least line hash, the first of equals, is selected. Equal runs that hold a window
   have that position at the same place in it, so no repeat is missed. A selected position is one row, with the windows that it is the least of.
2. Positions are joined by fingerprint: only lines selected at two or more places anywhere go on.
3. Each matched position is extended both ways, over the windows that it stands for. These are compared by
   128 bits of hash; overlapping windows that are there again make up the maximal repeated run. So no pair of
   positions is ever made, and a line in a third of all texts costs a row for each of its places.
4. The first window of each kind, by document id, hash of the text and line, stays; the lines of later ones are deleted,
   with blank lines between them.

A repeated run without a whole window, such as one short line whose neighbours differ, stays. With ``copy_share``, a text of
which over that share of the words stands first in one single earlier text is a copy as a whole: it stays
as it is, for a comparison of documents to judge.

A null text has no lines and stays null. Rows with equal id and equal text count as one text, so
neither repeats the other; rows with equal or null ids and different texts are texts of their own, told apart by 96 bits
of hash of id and text. Null ids come first in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaitwork.llm._util import fresh, held, staged, text_key

MIN_WORDS, MAX_LINES = 30, 2

ROW = ["row", "row2"]


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_words(line: Column) -> Column:
    """Words of a line, by its spaces; 0 for nothing but white space."""
    return F.when(F.length(F.trim(F.translate(line, "\t\r", ""))) > 0, F.size(F.split(F.trim(line), " +"))).otherwise(0)


def positions(docs: DataFrame, id_col: str, text_col: str, min_words: int, max_lines: int) -> DataFrame:
    """(id, row, row2, print, ws): selected lines by their hash, with the windows that each is the least line of; row, row2: the text's key.

    ws: array<struct<a, b, w1, w2>>, windows from line a to line b (from 0), and the two halves of their hash.
    """
    lines = F.transform(text_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), line_words(x).alias("n")))

    def window(k: Column, size: Column) -> Column:
        """The window of ``size`` lines from the k-th on; null where the size is."""
        made = F.transform(F.array(F.slice("u", k + 1, size)), lambda part: F.struct(
            part[0]["i"].alias("a"),
            F.element_at(part, -1)["i"].alias("b"),
            (k + F.array_position(part["h"], F.array_min(part["h"])) - 1).cast("int").alias("at"),
            F.xxhash64(part["h"]).alias("w1"),
            F.xxhash64(F.lit(7), part["g"]).alias("w2"),
        ))
        return F.when(size.isNotNull(), F.get(made, 0))

    def short(k: Column) -> Column:
        """Lines of the shortest run of fewer than ``max_lines`` lines that has the words, or null."""
        n, found = F.lit(0), None
        for size in range(1, max_lines):
            n = n + F.get("u", k + (size - 1))["n"]
            found = F.when(n >= min_words, size) if found is None else found.when(n >= min_words, size)
        return F.lit(None).cast("int") if found is None else found

    full = F.transform("u", lambda x, k: window(k, F.when(k + max_lines <= F.size("u"), max_lines)))
    few = F.transform("u", lambda x, k: window(k, short(k)))
    # A line is in the windows that begin at it or at most max_lines - 1 before.
    starts = lambda c, k, most: [F.get(c, k - back) for back in range(most)]
    own = lambda k: F.filter(F.array(*starts("full", k, max_lines), *starts("few", k, max_lines - 1)), lambda w: w["at"] == k)
    bare = lambda ws: F.transform(ws, lambda w: F.struct(*[w[c].alias(c) for c in ("a", "b", "w1", "w2")]))
    picked = F.filter(F.transform("u", lambda x, k: F.struct(x["h"].alias("print"), bare(own(k)).alias("ws"))), lambda p: F.size(p["ws"]) > 0)
    keys = [k.alias(c) for k, c in zip(text_key(id_col, text_col), ROW, strict=True)]
    texts = docs.select(F.struct(F.col(id_col).alias("id"), *keys).alias("own"), F.filter(lines, lambda u: u["n"] > 0).alias("units"))
    units = held(texts, "u", F.col("units")).select("own", "u")
    both = held(held(units, "full", full), "few", few)
    return both.select("own", F.explode(picked).alias("p")).select("own.*", "p.*")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """(row, row2, spans, main): for each text with later repeated windows, its key, their array<struct<a, b>>, and those of
    them that stand first in the earlier text with the most of them."""
    selected = staged(positions(docs, id_col, text_col, min_words, max_lines), "line-positions")
    # Written tables on one side of each join: what is on the other side of a hot key is then split.
    prints = staged(selected.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "line-prints")
    extended = selected.join(prints, "print").select("id", *ROW, F.explode("ws").alias("w")).select("id", *ROW, "w.*")
    matched = staged(extended, "line-matches")
    place = F.struct("id", *ROW, "a")
    first = staged(matched.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-firsts")
    later = matched.join(first, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    # A text's windows, so both groups are bounded by it.
    by_source = later.groupBy(*ROW, F.col("first.row").alias("f"), F.col("first.row2").alias("f2")).agg(F.collect_set(F.struct("a", "b")).alias("own"))
    return by_source.groupBy(*ROW).agg(F.flatten(F.collect_list("own")).alias("spans"), F.max_by("own", F.struct(F.size("own"), "f", "f2")).alias("main"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_lines: int = MAX_LINES, copy_share: float | None = None) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text, and the numbers of its lines and of those deleted.

    The numbers' columns are __n_lines and __n_removed, or the same with more underscores if ``docs`` has those.
    """
    own, own2, spans, main, done = (fresh(docs, x) for x in ("row", "row2", "spans", "main", "done"))
    gone = repeated_lines(docs, id_col, text_col, min_words, max_lines).select(F.col("row").alias(own), F.col("row2").alias(own2), F.col("spans").alias(spans), F.col("main").alias(main))
    joined = docs.withColumns(dict(zip((own, own2), text_key(id_col, text_col), strict=True))).join(gone, [own, own2], "left")
    numbers = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda s: F.sequence(s["a"], s["b"]))))

    def cut(b: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(b["lines"]) - 1), b["gone"])
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + line_words(x))
        whole = F.lit(False) if copy_share is None else total(F.transform(b["main"], lambda i: F.get(b["lines"], i))) > total(b["lines"]) * copy_share
        return F.when(~whole, F.struct(F.array_join(F.transform(kept, lambda i: F.get(b["lines"], i)), "\n").alias("text"), F.size(b["gone"]).alias("n")))

    # Bound as one element, so that lines and numbers are made once.
    bound = F.array(F.struct(text_lines(F.col(text_col)).alias("lines"), numbers(F.col(spans)).alias("gone"), numbers(F.col(main)).alias("main")))
    ready = joined.withColumn(done, F.when(F.col(spans).isNotNull(), F.get(F.transform(bound, cut), 0)))
    text = F.when(F.col(done).isNull(), F.col(text_col)).otherwise(F.col(done)["text"])
    return ready.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(text_lines(F.col(text_col)))).cast("long").alias(fresh(docs, "n_lines")),
        F.coalesce(F.col(done)["n"], F.lit(0)).cast("long").alias(fresh(docs, "n_removed")),
    )
