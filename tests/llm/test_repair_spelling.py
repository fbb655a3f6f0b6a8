"""Conversation repair and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from plaitwork.llm import conversation, registry, spelling

TURNS = "conv_id long, turn long, role string, text string, seg int, kind string, audit string, fault int"
EXTRA = (1, "x", "K", 7)


def initial(role):
    return role[:1]


def faults(rows):
    """(role, text, fault) in order; rows are (turn, role, text)."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())):
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        fault = "b" if last is None else "d" if (role, text) in seen else "t" if last[1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit) by plain recursion from the end over pairs of cost and edits."""
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    for role, _, fault in reversed(rows):
        new = {}
        for s in range(4):
            ways = [(best[s][0] + 4, "D" + best[s][1])]
            if fault not in ("b", "d"):
                cut = 3 if fault == "t" else 0
                ways.append((best[after[s]][0] + 3 + cut, "R" + best[after[s]][1]))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial(role), {}).get(s)
                if to is not None:
                    ways.append((best[to][0] + cut, "K" + best[to][1]))
            new[s] = min(ways)
        for _ in range(4):
            for s in range(4):
                c, e = new[after[s]]
                new[s] = min(new[s], (c + 3, "I" + e))
        best = new
    return best[0]


def repaired(rows, audit):
    lines, state, left = [], 0, list(rows)
    for e in audit:
        if e == "I":
            lines.append(("assistant" if state == 2 else "user") + ":")
        else:
            role, text, _ = left.pop(0)
            if e == "D":
                continue
            if e == "K":
                lines.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[initial(role)]
                continue
            lines.append(("assistant" if state == 2 else "user") + f":{text}")
        state = 3 if state == 2 else 2
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(initial(x) for x in lines))
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = [(t[1], t[2] if t[2] is not None else " ", t[3] if t[3] is not None else " ") for t in turns if t[0] == conv]
        rows, numbers = faults(own), [t[0] for t in own if t[0] is not None]
        cost, audit = cheapest(rows)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(initial(a[0]) + initial(b[0]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *(sum(r[2] == f for r in rows) for f in "bdt"), illegal, cost, audit, repaired(rows, audit))
    return out


def made_turns(seed, convs=40):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    texts = ["Yes.", "No", "  ", "", "So? \n", "long " * 40 + "end.", None, " ", "é"]
    out = [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts + [f"text {k}." for k in range(20)])) for conv in [None, *range(convs)] for _ in range(rng.randint(1, 14))]
    out += [(900, k, "user" if k % 3 else "assistant", f"t{k % 50}.") for k in range(700)]  # a long one
    out += [(901, None, "user", "same."), (901, 1, "user", "cut")] * 150  # repeated rows
    out += [(902, k, "user", f"{k}.") for k in range(300)]  # one long run
    return out


def answered(df):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    turns = made_turns(seed)
    df = spark.createDataFrame([t + EXTRA for t in turns], TURNS).repartition(3)
    assert answered(conversation.repair(df)) == plain(turns)


def test_long_conversations_are_cut_into_segments(spark):
    df = spark.createDataFrame([t + EXTRA for t in made_turns(1)], TURNS)
    rows = conversation._faults(df.select("conv_id", "turn", "role", "text").na.fill(" ", ["role", "text"])).repartitionByRange(8, "conv_id", *conversation.ORDER)
    assert rows.withColumn("seg", F.spark_partition_id()).where("conv_id = 900").select("seg").distinct().count() > 1
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert answered(conversation.repair(df)) == plain(made_turns(1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_runs_by_powers():
    for symbol in range(9):
        end, m = conversation.END, conversation._power(symbol, 0)
        for n in range(1, 40):
            end = conversation._apply(m, end)
            assert conversation.before_run(symbol, n, conversation.END) == end == conversation._apply(conversation.run_matrix(symbol, n), conversation.END)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation.repair(empty).collect() == []
    named = spark.createDataFrame([(5,), (None,), (5,)], "conv_id long")
    zeros = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert answered(conversation.repair(empty, named)) == {5: zeros, None: zeros}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_query_by_plain_version_and_sql(spark, tmp_path):
    turns = [t for t in made_turns(3) if t[0] is None or t[0] < 900] + [(950 + k, 0, "user", "x.") for k in range(60)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = answered(registry.op11_conversation_repair(spark, str(tmp_path)))
    zeros = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {t[0]: zeros for t in turns} | plain(damaged(turns))
    assert any(v == zeros for v in got.values())
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    rows = db.execute(registry.OP11_SQL).fetchall()
    assert {r[0]: tuple(r[1:]) for r in rows} == got


def plain_words(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[p:] == b[p + 1 :] or (len(a) == len(b) and a[p + 1 :] == b[p + 1 :])


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_variants(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 8))): rng.randint(1, 40) for _ in range(400)} | {"a\U0001d11e" * 3: 9, "a\U0001d11e" * 2 + "a": 4, "aaaaaaaaa": 5, "aaaaaaaaaa": 5}
    df = spark.createDataFrame([*words.items()], "word string, n long")
    for block in (5, 2_048):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, block).collect()}
        assert got == plain_variants(words)


def test_words_of_texts(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abceé", k=rng.randint(4, 7))) for _ in range(120)]
    rows = [(k if k % 9 else None, " ".join(rng.choices(vocab, k=rng.randint(0, 80))).title()) for k in range(120)] + [(500, None), (501, ""), (502, "ab1cdefgh÷ijklm×" * 3), (3, "again again again")]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "doc_id long, text string, n int, word string, run int")
    want = plain_words(rows)
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in registry.op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == plain_variants(want)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {r[0]: tuple(r[1:]) for r in db.execute(registry.OP12_SQL).fetchall()} == got


def test_variants_of_nothing(spark, no_docs):
    assert spelling.variants(spelling.word_counts(no_docs)).collect() == []
