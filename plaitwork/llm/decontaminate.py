"""Benchmark decontamination with DataFrame functions only.

Words are ``_util.words``. An item's windows are its runs of ``n`` consecutive words; an item with
fewer words, but not none, is one shorter window. A text is cut into words once; the 64-bit hash of each of its windows
is looked up in the set of the benchmark's hashes, and the windows that pass are verified against the items' full words.
Words inside any verified window are hit.

The set of hashes is broadcast while it has at most ``max_set`` values (16 bytes each), which is checked; past that,
hashes of texts and benchmark meet in a shuffle, by the same rows and with the same result. Only windows that pass carry
their words. Each row is judged by its own text: rows that share an id, or have none, are told apart by
96 bits of hash of id and text. Null or empty texts have no words. The text's other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaitwork.llm._util import WORD_PATTERN, fresh, held, staged, text_key, words

WINDOW, MAX_SET = 10, 2_000_000

ROW = ["row", "row2"]


def item_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, size int, gram string, h long), a row for each different window of each item."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    w = w.withColumn("size", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    windows = F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, F.col("size"))))
    return w.select("item", "size", F.explode(windows).alias("g")).select(
        "item", "size", F.concat_ws(" ", "g").alias("gram"), F.xxhash64(F.transform("g", lambda x: F.xxhash64(x))).alias("h")
    )


def text_windows(docs: DataFrame, id_col: str, text_col: str, sizes: list[int]) -> DataFrame:
    """(id, row, row2, w, pos, h): the hashes of every window of the sizes of every text, size by size; w are all its words.

    A row of pos 0 and h 0 stands for the text itself, so that texts without windows are there too. The hashes are made
    before they are exploded: rows then have the words by reference, and only those that are used copy any.
    """
    keys = [k.alias(c) for k, c in zip(text_key(id_col, text_col), ROW, strict=True)]
    cut = docs.select(F.struct(F.col(id_col).alias("id"), *keys).alias("own"), words(F.col(text_col)).alias("words"))
    src = held(held(cut, "w", F.col("words")).drop("words"), "wh", F.transform("w", lambda x: F.xxhash64(x)))
    each = [F.array(F.lit(0).cast("long"))]
    for k in sizes:
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - k + 1)).otherwise(F.array().cast("array<int>"))
        each.append(F.transform(starts, lambda i: F.xxhash64(F.slice("wh", i, k))))  # noqa: B023
    return held(src, "hashes", F.concat(*each)).drop("wh").select("own", "w", F.posexplode("hashes").alias("pos", "h")).select("own.*", "w", "pos", "h")


def window_place(sizes: list[int]) -> tuple[Column, Column]:
    """(at, size) of ``text_windows``' pos: its first word, from 0, and its words; -1 and 0 for the text itself."""
    at, size, before = F.when(F.col("pos") == 0, -1), F.when(F.col("pos") == 0, 0), F.lit(1)
    for k in sizes:
        until = before + F.greatest(F.size("w") - k + 1, F.lit(0))
        at, size, before = at.when(F.col("pos") < until, F.col("pos") - before), size.when(F.col("pos") < until, k), until
    return at.alias("at"), size.alias("size")


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, n: int, max_set: int) -> tuple[DataFrame, DataFrame]:
    """The texts (id, row, row2, n_words), a row each, and the verified windows (row, row2, at, size, items)."""
    spark = docs.sparkSession
    grams = staged(item_windows(benchmark, n), "benchmark-windows")
    sizes = [r["size"] for r in grams.select("size").distinct().orderBy("size").collect()]  # at most n
    known = grams.select("h").distinct()
    each, place = text_windows(docs, id_col, text_col, sizes), window_place(sizes)
    full = lambda rows: rows.select("id", *ROW, "w", *place).select(
        "id", *ROW, "at", "size", F.size("w").cast("long").alias("n_words"), F.when(F.col("at") >= 0, F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.greatest("size", F.lit(1))))).alias("gram")
    )
    if known.count() <= max_set:
        own = known.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("h"))).distinct()
        passed = full(each.join(F.broadcast(own), "h"))
    else:
        # Windows meet without their words, which are fetched for those that pass.
        met = each.where("pos > 0").select(*ROW, "pos", "h").join(known.hint("merge"), "h").groupBy(*ROW).agg(F.collect_set("pos").alias("own"))
        texts = docs.select(F.col(id_col).alias("id"), *[k.alias(c) for k, c in zip(text_key(id_col, text_col), ROW, strict=True)], F.col(text_col).alias("text"))
        asked = texts.join(met, ROW).select("id", *ROW, words(F.col("text")).alias("words"), "own")
        asked = held(asked, "w", F.col("words")).select("id", *ROW, "w", F.explode("own").alias("pos"))
        passed = full(each.where("pos = 0")).unionByName(full(asked))
    passed = staged(passed, "benchmark-hits")
    items = staged(grams.groupBy("gram").agg(F.collect_set("item").alias("items")), "benchmark-items")
    hits = passed.where("at >= 0").select(*ROW, "at", "size", "gram").join(items, "gram").drop("gram")
    return passed.where("at < 0").select("id", *ROW, "n_words"), hits


def gather(hits: DataFrame) -> DataFrame:
    """(row, row2, hit, items): the sorted places of a text's hit words, and its items; bounded by text and benchmark."""
    places = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))
    by_text = hits.groupBy(*ROW).agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return by_text.select(*ROW, F.array_sort(F.array_distinct(F.flatten(places))).alias("hit"), "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """A row for each document: ``id_col``, n_words, n_hit, items (sorted ids as strings), hit (sorted places of the hit words, from 0)."""
    texts, hits = find_windows(docs, benchmark, id_col, text_col, n, max_set)
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    full = texts.join(gather(hits), ROW, "left").select(F.col("id").alias(id_col), "n_words", none("hit", "int"), none("items", "string"))
    return full.select(id_col, "n_words", F.size("hit").cast("long").alias("n_hit"), "items", "hit")


def remove_words(text: Column, hit: Column) -> Column:
    """``text`` without the words at the sorted places ``hit``, what stands between them and what follows them up to the next word.

    The text is cut at its words (case kept) and put together from the stretches between runs of hit words, so that
    separators outside the runs stay as they were; the work is linear in the text.
    """
    # Bound as one element, so that the text is cut once.
    parts = F.array(F.struct(F.split(text, _ANY_CASE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(_ANY_CASE), F.lit(0)).alias("w"), hit.alias("hit")))

    def runs(b: Column) -> Column:
        first = F.filter(b["hit"], lambda x, i: (i == 0) | (F.get(b["hit"], i - 1) < x - 1))
        last = F.filter(b["hit"], lambda x, i: (i == F.size(b["hit"]) - 1) | (F.get(b["hit"], i + 1) > x + 1))
        spaced = F.zip_with(F.slice(b["gaps"], 1, F.size(b["w"])), b["w"], lambda g, x: F.concat(g, x))
        return F.struct(b["gaps"].alias("gaps"), b["w"].alias("w"), spaced.alias("spaced"), F.concat(F.array(F.lit(0)), F.transform(last, lambda x: x + 1)).alias("lo"), F.concat(first, F.array(F.size(b["w"]))).alias("hi"))

    def rebuilt(b: Column) -> Column:
        def stretch(lo: Column, k: Column) -> Column:
            hi = F.get(b["hi"], k)
            rest = F.array_join(F.slice(b["spaced"], lo + 2, F.greatest(hi - lo - 1, F.lit(0))), "")
            head = F.when(k == 0, F.get(b["gaps"], 0)).otherwise("")
            tail = F.when(hi < F.size(b["w"]), F.get(b["gaps"], hi)).otherwise("")
            return F.concat(head, F.when(lo < hi, F.concat(F.get(b["w"], lo), rest, tail)).otherwise(""))

        return F.concat(F.array_join(F.transform(b["lo"], stretch), ""), F.element_at(b["gaps"], -1))

    return F.get(F.transform(F.transform(parts, runs), rebuilt), 0)


#: The words' pattern before the change to lower case.
_ANY_CASE = WORD_PATTERN.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.5, n: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` without contamination: hit spans are cut out; a text of which over ``max_share`` is hit goes.

    Clean rows come back unchanged, with null and empty texts.
    """
    own, own2, share, hit = (fresh(docs, x) for x in ("row", "row2", "share", "hit"))
    texts, hits = find_windows(docs, benchmark, id_col, text_col, n, max_set)
    found = gather(hits).join(texts.drop("id"), ROW).groupBy(*[F.col(c).alias(x) for c, x in zip(ROW, (own, own2), strict=True)])
    marks = found.agg(F.first(F.size("hit") / F.col("n_words")).alias(share), F.first("hit").alias(hit))  # equal rows are equal in both
    joined = docs.withColumns(dict(zip((own, own2), text_key(id_col, text_col), strict=True))).join(marks, [own, own2], "left")
    kept = joined.where(F.col(share).isNull() | (F.col(share) <= max_share))
    text = F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(remove_words(F.col(text_col), F.col(hit)))
    return kept.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
