import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import public_tokenizers as tokens
import pytest
import tiktoken
from plaitwork.llm import bpe, decontaminate, jaccard, line_dedup, suffix_dedup, token_counts, token_files
from pyspark.sql import functions as F

RANKS = tokens.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own_encoding():
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("chunk", [40, 1_000, 32_768])
def test_bpe_round_trip(docs, own_encoding, chunk):
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["bytes"])) for r in bpe.encode_decode(docs, RANKS, tokens.PATTERN, chunk_chars=chunk).collect())
    want = Counter()
    for r in corpus.rows():
        text = r[1] or ""
        want[r[0], bpe._ids(own_encoding.encode_ordinary(text)), text.encode()] += 1
    assert got == want


def test_bpe_chunks_of_odd_texts(spark, own_encoding):
    rng = random.Random(3)
    made = ["".join(rng.choices(["a", "é", " ", "  ", "\n", "\n\n", "1", "'s", "!", "\x1c", " ", "漢", "\t", "'"], k=rng.randint(0, 200))) for _ in range(150)]
    made += ["a" * 500, " " * 500, "\n" * 300 + "b" * 300, "1 " * 200]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id int, text string")
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(df, RANKS, tokens.PATTERN, chunk_chars=24).collect()}
    assert got == {k: bpe._ids(own_encoding.encode_ordinary(t)) for k, t in enumerate(made)}


def test_bpe_empty_table(no_docs):
    assert bpe.encode_decode(no_docs, RANKS, tokens.PATTERN).count() == 0


def plain_hits(text, items, n=10):
    w, hit, found = corpus.words(text), set(), set()
    for item, own in items:
        k = min(n, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(w) - k + 1) if own else ():
            if tuple(w[i : i + k]) in grams:
                hit |= {*range(i, i + k)}
                found.add(str(item))
    return len(w), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("max_set", [2_000_000, 3])
def test_decontamination(docs, benchmark, max_set):
    items = [(r["item_id"], corpus.words(r["text"])) for r in benchmark.collect()]
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.find_hits(docs, benchmark, max_set=max_set).collect())
    assert got == Counter((r[0], *plain_hits(r[1], items)) for r in corpus.rows())
    assert sum(n for (_, _, hit, _), n in got.items() if hit) > 10


def test_decontamination_cuts_spans(spark, docs, no_docs, benchmark):
    df = spark.createDataFrame([(1, "Keep, this. ONE  two-three! And that?"), (2, "one two three"), (3, "clean  text\n"), (4, None), (5, "")], "doc_id int, text string")
    done = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, benchmark).collect()}
    assert done == {1: "Keep, this. And that?", 3: "clean  text\n", 4: None, 5: ""}
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, benchmark, max_set=0).collect()} == done
    cleaned = decontaminate.decontaminate(docs, benchmark)
    assert cleaned.columns == docs.columns
    assert decontaminate.find_hits(cleaned, benchmark).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(no_docs, benchmark).count() == 0
    assert decontaminate.find_hits(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def plain_windows(text, min_words=30, max_lines=2):
    """(a, b, lines) of each window, by the rule."""
    lines = (text or "").split("\n")
    units = [i for i, x in enumerate(lines) if x.replace("\t", "").replace("\r", "").strip(" ")]
    words = [len([x for x in lines[i].strip(" ").split(" ") if x]) for i in units]
    for k in range(len(units)):
        short = next((n for n in range(1, max_lines) if k + n <= len(units) and sum(words[k : k + n]) >= min_words), None)
        for n in [*([short] if short else []), *([max_lines] if k + max_lines <= len(units) else [])]:
            yield units[k], units[k + n - 1], tuple(lines[i] for i in units[k : k + n])


def plain_lines(rows, copy_share=None, **sizes):
    """{(id, text): numbers of deleted lines}"""
    seen, gone, main = defaultdict(list), defaultdict(set), defaultdict(lambda: defaultdict(set))
    for k, text in {(r[0], r[1]) for r in rows}:
        for a, b, own in plain_windows(text, **sizes):
            seen[own].append(((k is not None, k or 0), text, a, b, k))
    for places in seen.values():
        first, *later = sorted(places)
        for _, text, a, b, k in later:
            gone[k, text] |= {*range(a, b + 1)}
            main[k, text][first[4], first[1]] |= {(a, b)}
    size = lambda x: len([w for w in x.strip(" ").split(" ") if w]) if x.replace("\t", "").replace("\r", "").strip(" ") else 0
    for key in [*gone] if copy_share is not None else ():
        lines = key[1].split("\n")
        own = {i for a, b in max(main[key].values(), key=len) for i in range(a, b + 1)}
        if sum(size(lines[i]) for i in own) > copy_share * sum(map(size, lines)):
            del gone[key]
    return gone


def plain_cut_lines(text, gone):
    return text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def test_line_dedup(docs, no_docs):
    gone = plain_lines(corpus.rows())
    got = Counter((r["doc_id"], r["text"], r["__n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    want = Counter()
    for r in corpus.rows():
        own = gone.get((r[0], r[1]), ())
        want[r[0], plain_cut_lines(r[1], own), len(own)] += 1
    assert got == want and sum(map(bool, gone.values())) > 10
    for sizes in ({"min_words": 5, "max_lines": 1}, {"min_words": 12, "max_lines": 4}):
        gone = plain_lines(corpus.rows(), **sizes)
        other = Counter((r["doc_id"], r["__n_removed"]) for r in line_dedup.dedup_lines(docs, **sizes).collect())
        assert other == Counter((r[0], len(gone.get((r[0], r[1]), ()))) for r in corpus.rows())
    # Texts that stand mostly in one earlier text are left whole.
    some = plain_lines(corpus.rows(), 0.5)
    left = Counter((r["doc_id"], r["text"], r["__n_removed"]) for r in line_dedup.dedup_lines(docs, copy_share=0.5).collect())
    assert left == Counter((r[0], plain_cut_lines(r[1], own := some.get((r[0], r[1]), ())), len(own)) for r in corpus.rows()) and 3 < len(some) < len(gone)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = random.Random(12)
    a, b, c, d, e = (corpus.prose(rng, 60) for _ in range(5))
    lines = [x.split("\n") for x in (a, b, c, d, e)]
    shared = "\n".join(lines[0][:6])
    rows = [(1, a), (None, f"{shared}\n{b}"), (None, c), (None, None), (7, f"{shared}\n{d}"), (7, e), (7, e), (None, f"{b}\n{d}")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = [r["text"] for r in line_dedup.dedup_lines(df).collect()]
    # Without a line of its own that another row's decision took, and with no copy left of any window.
    left = Counter(x for t in got if t for x in t.split("\n"))
    assert set(left) == {x for t in lines for x in t} and c in got and got.count(e) == 2 and None in got
    once = [x[2] for t in set(got) if t for x in plain_windows(t)]
    assert len(once) == len(set(once))

    items = spark.createDataFrame([(1, " ".join(corpus.words(a)[:12])), (2, d)], "item_id int, text string")
    clean = Counter(r["text"] for r in decontaminate.decontaminate(df, items).collect())
    cut = lambda t: decontaminate.decontaminate(spark.createDataFrame([(1, t)], "doc_id int, text string"), items).collect()
    want = Counter(r["text"] for _, t in rows for r in cut(t))
    assert clean == want and clean[c] == 1 and clean[e] == 2 and d not in clean

    near = b.replace(b.split(" ")[30], "changed", 1)
    rows = [(1, a), (5, b), (5, c), (5, c), (None, d), (None, a), (None, e), (3, near), (None, None), (None, None)]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert kept == Counter([(1, a), (5, c), (5, c), (None, d), (None, e), (3, near), (None, None), (None, None)])


def plain_removed(rows, span):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i : i + span] for _, b in data for i in range(len(b) - span + 1))
    out = Counter()
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\x01" * span
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    return out


@pytest.mark.parametrize("big_group", [20_000, 1])
def test_suffix_dedup(docs, no_docs, big_group):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(docs, big_group=big_group).collect())
    assert got == plain_removed(corpus.rows(), 200)
    assert suffix_dedup.dedup(no_docs).count() == 0


def test_suffix_dedup_repeats_inside_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.segments, "__defaults__", (250,))
    rng = random.Random(4)
    block = "".join(rng.choices("abcdef", k=150))
    made = ["z" * 400, "ab" * 150, block * 3, block + "x" + block, "".join(rng.choices("ab", k=900)), block * 2 + "y", "z" * 64 + "q"]
    rows = [(k, t) for k, t in enumerate(made)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id int, text string"), span=64).collect())
    assert got == plain_removed(rows, 64)


def test_suffix_dedup_never_gathers_a_big_group(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    passage, some = ("".join(rng.choices("abcdefgh", k=n)) for n in (400, 260))
    own = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(150, 300)))
    rows = [(k if k % 7 else None, own() + passage + own() + (some + own() if k < 4 else "")) for k in range(400)]
    real = suffix_dedup.repeated_windows
    folder = str(tmp_path)

    def watched(blobs, *rest):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(str(len(blobs)))
        return real(blobs, *rest)

    monkeypatch.setattr(suffix_dedup, "repeated_windows", watched)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id int, text string"), big_group=20).collect())
    assert got == plain_removed(rows, 200)
    # The few edges of the rarer passage are compared in whole groups; the 400 of the common one never are.
    assert 0 < sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 40


def plain_neighbours(rows, n=5, threshold=0.8):
    """{(id, text): (links, least id reached, kept)}, a document for each different row; null ids come last."""
    sets = {}
    for k, text, *_ in rows:
        w = corpus.words(text)
        sets[k, text] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links = {a: {b for b in sets if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in sets}
    found = {}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            todo += links[(x := todo.pop())] - seen
            seen |= links[x]
        found[a] = (len(links[a]), min((k for k, _ in seen if k is not None), default=None), seen)
    return found


def plain_kept(found, kept):
    """Whether ``kept`` has one document of each group, one of its least id."""
    groups = {frozenset(x[2]): x[1] for x in found.values()}
    return len(kept) == len(groups) and all(len(own := g & kept) == 1 and next(iter(own))[0] == least for g, least in groups.items())


@pytest.mark.parametrize("block", [128, 2])
def test_jaccard(spark, docs, no_docs, block):
    found = plain_neighbours(corpus.rows())
    got = Counter(tuple(r)[:3] for r in jaccard.near_duplicates(docs, block_docs=block).collect())
    assert got == Counter((r[0], *found[r[0], r[1]][:2]) for r in corpus.rows()) and max(v[0] for v in found.values()) > 1
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect())
    assert plain_kept(found, {*kept}) and all(n == sum((k, t) == (r[0], r[1]) for r in corpus.rows()) for (k, t), n in kept.items())
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_jaccard_judges_rows_of_one_id_by_their_own_text(spark):
    rng = random.Random(31)
    t, u = corpus.prose(rng, 50), corpus.prose(rng, 60)
    rows = [(1, t), (2, t), (2, u), (3, u), (None, u), (None, None), (4, ""), (2, u)]
    got = Counter(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (None, 2, 2, False), (None, 0, None, True), (4, 0, 4, True)])


def test_jaccard_compares_only_blocks_that_share_a_bucket(spark):
    rng = random.Random(32)
    own = [[str(rng.random()) for _ in range(40)] for _ in range(12)]
    # A chain of near copies, each with the next, and one group that is split over blocks.
    chain = [w[:] for w in own[:1]]
    for _ in range(30):
        chain.append(chain[-1][2:] + [str(rng.random()) for _ in range(2)])
    group = [own[5][:k] + ["other"] + own[5][k:] for k in range(0, 40, 2)]
    rows = [(k, " ".join(w)) for k, w in enumerate([*chain, *group, *own[6:]])]
    got = {r["doc_id"]: tuple(r)[1:3] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=3).collect()}
    assert got == {k: v[:2] for (k, _), v in plain_neighbours(rows).items()}


def test_jaccard_of_one_bucket_of_many_blocks(spark, monkeypatch):
    """Near copies of one text, in more blocks than a task pairs at a time: all links are there, and no task makes all pairs of blocks."""
    base = corpus.words(corpus.prose(random.Random(21), 90))
    rows = [(k, " ".join([*base, f"tail{k}"])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "SQUARE", 8)
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in jaccard.near_duplicates(df, block_docs=4).collect()}
    assert got == {k: (399, 0, k == 0) for k in range(400)}


def test_jaccard_plan():
    bands, rows = jaccard.plan(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 200


def test_token_totals(spark, docs, no_docs, tmp_path):
    totals = token_counts.Totals(spark, str(tmp_path / "totals"))
    assert totals.totals().count() == 0
    state = Counter()

    def held():
        return {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()}

    def want():
        out = defaultdict(lambda: [0, 0])
        for (_, source, lang, version, n), times in state.items():
            out[source, lang, version][0] += times
            out[source, lang, version][1] += n * times
        return {k: tuple(v) for k, v in out.items() if any(v)}

    first = token_counts.count_words(docs, "v1").unionByName(token_counts.count_bpe(docs, "v2", RANKS, tokens.PATTERN))
    state.update(tuple(r)[1:] for r in first.collect())
    assert totals.apply("a", first) and held() == want()
    changes = [("revise", 3, "other", "fr", "v1", 5), ("revise", 77_777, "new", None, "v1", 2), ("delete", 5, None, None, None, None), ("delete", 6, None, None, "v2", None), ("delete", 88_888, None, None, None, None)]
    for c in changes:
        for x in [x for x in state if x[0] == c[1] and (c[4] is None or x[3] == c[4])]:
            del state[x]
        if c[0] == "revise":
            state[c[1:]] += 1
    batch = spark.createDataFrame(changes, token_counts.CHANGES)
    assert totals.apply("b", batch) and held() == want()
    assert not totals.apply("b", batch) and held() == want()
    assert totals.apply("c", batch.limit(0)) and held() == want()
    assert totals.committed() == ["a", "b", "c"]
    assert token_counts.copies(no_docs).count() == 0
    with pytest.raises(ValueError):
        totals.apply("../x", batch)


def plain_totals(batches):
    """Totals by (source, lang, version) after batches of (change, id, source, lang, version, n, seq), one change after another."""
    state = []
    for changes in batches:
        kind = {"insert": 0, "revise": 1, "delete": 2}
        once = [c for k, c in enumerate(changes) if c[0] != "revise" or c not in changes[:k]]
        for c in sorted(once, key=lambda c: (c[6] or 0, kind[c[0]], *((c[2] or "", c[3] or "", c[5] or 0) if c[0] == "revise" else ()))):
            if c[0] != "insert":
                state = [x for x in state if x[0] != c[1] or not (x[3] == c[4] or (c[0] == "delete" and c[4] is None))]
            if c[0] != "delete":
                state.append((c[1], c[2], c[3], c[4], c[5] or 0))
    out = defaultdict(lambda: [0, 0])
    for x in state:
        out[x[1:4]][0] += 1
        out[x[1:4]][1] += x[4]
    return {k: tuple(v) for k, v in out.items() if any(v)}


def test_token_totals_inside_a_batch(spark, tmp_path):
    rng = random.Random(11)
    fixed = [[("insert", 1, "s", "l", "v", 5, None), ("delete", 1, None, None, None, None, None)], [("insert", 2, "s", "l", "v", 5, None), ("revise", 2, "s", "l", "v", 9, None)]]
    drawn = [[(rng.choice(["insert", "insert", "revise", "delete"]), rng.choice([None, 1, 2, 3, 4]), rng.choice(["s", None]), "l", rng.choice(["v", "w", None]), rng.choice([None, 3, 8]), rng.choice([None, 0, 1, 2])) for _ in range(30)] for _ in range(3)]
    totals, done = token_counts.Totals(spark, str(tmp_path / "order")), []
    for k, batch in enumerate([*fixed, *drawn]):
        # A deletion has no counts of its own, and a null version of an insert is a version like any other.
        done.append(batch)
        totals.apply(f"b{k}", spark.createDataFrame(batch, f"{token_counts.CHANGES}, seq long"))
        assert {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()} == plain_totals(done)
    assert plain_totals(fixed) == {("s", "l", "v"): (1, 9)}


def test_token_totals_after_a_lost_driver(spark, docs, tmp_path):
    totals = token_counts.Totals(spark, str(tmp_path / "t"))
    changes = token_counts.count_words(docs, "v")
    # Entries of a batch that was never committed count for nothing, and are written over.
    changes.limit(3).select("doc_id", *token_counts.KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), F.lit(3).alias("bucket")).write.partitionBy("bucket").parquet(str(tmp_path / "t/entries/batch=a"))
    assert totals.totals().count() == 0
    totals.apply("a", changes)
    assert totals.totals().agg(F.sum("n_docs")).first()[0] == docs.count()


def file_options():
    return {"json_path": tokens.path("byte_bpe_50k.json"), "pattern": tokens.PATTERN}


def test_token_files(spark, docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    folder = f"file://{tmp_path}/files"
    token_files.write(docs, folder, **file_options())
    got = sorted((corpus.order(r["doc_id"]), r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read(spark, folder).collect())
    start, want = 0, []
    for k, text in sorted(((r[0], r[1] or "") for r in corpus.rows()), key=lambda x: (corpus.order(x[0]), x[1].encode())):
        ids = [*full.encode(text, add_special_tokens=False).ids, 0]
        want.append((corpus.order(k), start, len(ids), bpe._ids(ids)))
        start += len(ids)
    assert got == sorted(want)
    some = spark.createDataFrame([(3,), (1_003,), (1_000,), (99_999,), (None,)], "doc_id long")
    asked = sorted((corpus.order(r["doc_id"]), r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read(spark, folder, some).collect())
    assert asked == sorted(x for x in want if x[0] in {*map(corpus.order, (3, 1_003, 1_000, None))})
    token_files.write(no_docs, f"{folder}-none", **file_options())
    assert token_files.read(spark, f"{folder}-none").count() == 0


def test_fast_and_full_encoders_agree(monkeypatch):
    rng = random.Random(6)
    options = file_options()
    fast, full = token_files.encoder(options["json_path"], options["pattern"], 2), token_files.encoder(options["json_path"], None, 2)
    made = ["".join(rng.choices(["a", "the ", "é", " ", "\n", "\n\n", "12", "'s", "'ll", "!", " ", "漢", "\t", "𝄞", "́", "٣"], k=rng.randint(0, 80))) for _ in range(500)]
    made += ["a<|endoftext|>b", "", "x\x1cy \x1f z\x85 \u2028w", "a\u088fb c", "'s's ''d 'Re"]
    assert fast(made) == full(made) and fast([]) == []
    monkeypatch.setattr(token_files, "MEMO", 50)
    assert [x for t in made for x in fast([t])] == full(made)


def test_encoders_agree_on_every_code_point():
    options = file_options()
    fast, full = token_files.encoder(options["json_path"], options["pattern"], 2), token_files.encoder(options["json_path"], None, 2)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 65_536):
        made = ["".join(f"a{c}1{c} {c}{c}\n" for c in points[k : k + 64]) for k in range(at, min(at + 65_536, len(points)), 64)]
        assert fast(made) == full(made)


def test_encoder_cuts_where_pieces_meet(monkeypatch):
    rng = random.Random(8)
    options = file_options()
    fast, full = token_files.encoder(options["json_path"], options["pattern"], 2), token_files.encoder(options["json_path"], None, 2)
    signs = ["a", "B ", "é", "и", "漢", "½", "٣", "7", "'", "'s", "'re ", "’", ".", "<|", "|>", "endoftext", "\u0301", "\u088f", *" \t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u180e\x00"]
    made = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(4_000)]
    made += ["漢字、" * 90 + "x" * 200, "x" * 200 + "\u088f" * 100, " " * 200 + "a" + "\n" * 200, "a" * 100 + "<|endoftext|>" + " " * 100]
    assert fast(made) == full(made)
    monkeypatch.setattr(token_files, "LONG", 3)
    assert fast(made[::-1]) == full(made)[::-1]
    assert token_files.encoder(options["json_path"], r"\w+|\W+", 2)(made[:9]) == full(made[:9])


def test_encoder_cuts_by_the_pattern_only_what_is_new(monkeypatch):
    import regex

    scanned, compiled = [], regex.compile

    class Counted:
        def __init__(self, pattern):
            self.own = compiled(pattern)

        def findall(self, text):
            scanned.append(len(text))
            return self.own.findall(text)

    monkeypatch.setattr(regex, "compile", Counted)
    options = file_options()
    run = token_files.encoder.__wrapped__(options["json_path"], options["pattern"], 2)
    made = ["Words come back, 12 times: it's their habit.\n" * k for k in range(1, 60)]
    assert run(made) == token_files.encoder(options["json_path"], None, 2)(made)
    assert 0 < sum(scanned) < len(made[0]) * 3
    assert run(made[5:]) and sum(scanned) < len(made[0]) * 3


def test_encoder_keeps_what_was_used_last(monkeypatch):
    import regex

    scanned, compiled = [], regex.compile
    monkeypatch.setattr(regex, "compile", lambda p: type("Counted", (), {"findall": lambda _, text, own=compiled(p): scanned.append(text) or own.findall(text)})())
    options = file_options()
    run = token_files.encoder.__wrapped__(options["json_path"], options["pattern"], 2)
    monkeypatch.setattr(token_files, "MEMO", 20)
    for k in range(300):
        run([f"often used {k}"])
    assert scanned.count("often") == 1 and len(scanned) == 302


def test_lots_hold_every_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "LOT", 10)
    made = ["", "abc", "é" * 40, "", "", "x" * 10, "y", "zz" * 5, "", "q" * 11, ""]
    for kind in (pa.string(), pa.large_string()):
        parts = [pa.array(made, kind)[lot].to_pylist() for lot in token_files.lots(pa.array(made, kind))]
        assert sum(parts, []) == made and all(len(x) == 1 or sum(len(t.encode()) for t in x) <= 10 for x in parts)
        assert [*token_files.lots(pa.array([], kind))] == []


def test_damaged_frames_are_found(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.tok")
    with open(path, "wb") as f:
        writer = token_files.Writer(f, 2, frame_ids=8)
        for k in range(10):
            writer.add(k, bytes([k, 0]) * 5)
        writer.close()
    local = fs.LocalFileSystem()
    with local.open_input_file(path) as source:
        frames, table, width = token_files.read_table(source)
        assert len(frames) == 5 and table["n"].sum() == 50 and width == 2
        raw = [token_files.read_frame(source, x) for x in frames]
    assert [zlib.crc32(x) for x in raw] == [x[3] for x in frames]
    data = bytearray(open(path, "rb").read())
    data[frames[2][1] + 12] ^= 255
    open(path, "wb").write(data)
    with local.open_input_file(path) as source:
        token_files.read_frame(source, frames[1])
        with pytest.raises(Exception):  # noqa: B017, PT011
            token_files.read_frame(source, frames[2])


def test_digests_of_queries(spark, docs, tmp_path):
    from plaitwork.llm import registry

    docs.drop("__gone").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["decoded_sha256"], r["n_tokens"]) for r in registry.op2_bpe(spark, str(tmp_path)).collect()}
    assert got[1_000] == (hashlib.sha256(b"").hexdigest(), 0)
    totals = registry.op4_token_counts(spark, str(tmp_path))
    # All are inserted; copies of a smaller id's text go, by id, once.
    least = {}
    for r in corpus.rows():
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    gone = {r[0] for r in corpus.rows() if r[0] is not None and least[r[1] or ""] != r[0]}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    closed = lambda t: re.sub("[ \\t]{2,}", " ", t)
    want = defaultdict(lambda: [0, 0])
    revised = {(r[0], r[3], r[2], len(enc.encode_ordinary(closed(r[1])))) for r in corpus.rows() if r[1] and closed(r[1]) != r[1]}
    entries = [(r[0], r[3], r[2], "words-1", len(corpus.words(r[1]))) for r in corpus.rows()]
    entries += [(r[0], r[3], r[2], "bpe-multi-50k", len(enc.encode_ordinary(r[1] or ""))) for r in corpus.rows() if r[0] not in {x[0] for x in revised}]
    entries += [(k, source, lang, "bpe-multi-50k", n) for k, source, lang, n in revised]
    for k, source, lang, version, n in entries:
        if k not in gone:
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += n
    assert {tuple(r)[:3]: list(r)[3:] for r in totals.collect()} == dict(want) and gone
