"""Conversation structure repair: the cheapest edits that make turns alternate, by a run-length min-plus program.

Turns are taken in order of turn (nulls first), then role, then md5 of the text. A turn's first fault counts: blank (nothing but white space),
duplicate (role and text stood earlier in the conversation), truncated (its last symbol doesn't end a sentence). Edits: keep 0,
rerole to user or assistant 3, delete 4, insert an empty user or assistant turn 3; blank and duplicate turns must go, and a truncated turn that
stays costs 3 more. The roles' initials that are left read ``(s?(ua)+)?``. Of the cheapest edits the ASCII-least string of initials is the audit.

1. A turn is a symbol, its role and fault; four states say what may follow. A symbol's transition is a 4 x 4 min-plus
   matrix with insertions before it; equal consecutive symbols are a run, passed by cached binary powers of the matrix.
2. Turns are cut into segments by ranges of (conversation, turn), so that no conversation is one task's work; a
   segment is one matrix. Each conversation's segments, one for each range at most, give every segment the costs at its end.
3. Choices are unrolled inside segments from those costs, for each state that a segment can start in, and put together.
4. Texts move once: a conversation's turns are streamed past its audit, in sorted order, into a hash. That hash is one
   stream by definition, so this last step reads a conversation in one task, of which it holds a batch at a time.

Equal turns of a conversation are counted first and move as one row. Null roles and texts count as one space: the turn is blank. A null
conversation id is a conversation. Columns other than the four are left out. Texts are told apart by md5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaitwork.llm._util import prepare, staged

#: What edits cost, and the initials of the edits in ASCII order.
RETAG, DELETE, INSERT, CUT = 3, 4, 3, 3
#: What a damaged row's remainder does, of ``DAMAGES`` remainders.
DAMAGES, DROPPED, EMPTIED, UNENDED, REPEATED, RETAGGED = 20, 0, 1, 2, 3, 4

FAR = 10**12
#: States: nothing yet, after system, after user, after assistant. What an inserted or reroled turn leads to, and is.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: Costs of what must still be inserted at a conversation's end.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: a turn that must go, then 1 + 2 * role + truncated; roles: system, user, assistant, any other.
GONE, ROLES = 0, "sua"

Vector, Matrix = tuple[int, ...], tuple[tuple[int, ...], ...]


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): turns with nulls of role and text as one space and faults put in by crc32 of id and turn."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))), F.lit(DAMAGES))
    text = F.when(kind == EMPTIED, "").when(kind == UNENDED, F.translate(own("text"), ".!?", "")).otherwise(own("text"))
    made = turns.select("conv_id", "turn", F.when(kind == RETAGGED, "user").otherwise(own("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == DROPPED, 0).when(F.col("kind") == REPEATED, 2).otherwise(1)
    return made.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(True), copies))).select("conv_id", "turn", "role", "text")


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(FAR, *(a[i][k] + v[k] for k in range(4))) for i in range(4))


def _moves(symbol: int) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) of a turn, without insertions."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if symbol != GONE:
        role, cut = divmod(symbol - 1, 2)
        kept = {0: [(START, SYSTEM)], 1: [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], 2: [(USER, ASSISTANT)], 3: []}[role]
        out += [("K", s, t, CUT * cut) for s, t in kept] + [("R", s, NEXT[s], RETAG + CUT * cut) for s in range(4)]
    return out


@lru_cache(maxsize=None)
def _power(symbol: int, k: int) -> Matrix:
    """The transition of 2^k turns of a symbol."""
    if k:
        return _product(_power(symbol, k - 1), _power(symbol, k - 1))
    inserts = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    for i in range(4):
        at, cost = i, 0
        for _ in range(3):
            at, cost = NEXT[at], cost + INSERT
            inserts[i][at] = min(inserts[i][at], cost)
    step = [[FAR] * 4 for _ in range(4)]
    for _, s, t, cost in _moves(symbol):
        step[s][t] = min(step[s][t], cost)
    return _product(tuple(map(tuple, inserts)), tuple(map(tuple, step)))


def _powers(symbol: int, length: int) -> Iterator[Matrix]:
    """Matrices whose product is that of ``length`` turns of a symbol."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            yield _power(symbol, k)


@lru_cache(maxsize=65_536)
def run_matrix(symbol: int, length: int) -> Matrix:
    out = None
    for m in _powers(symbol, length):
        out = m if out is None else _product(out, m)
    return out


def before_run(symbol: int, length: int, end: Vector) -> Vector:
    """The costs before a run, from those after it."""
    for m in _powers(symbol, length):
        end = _apply(m, end)
    return end


@lru_cache(maxsize=65_536)
def _unrolled(symbol: int, length: int, end: Vector, state: int) -> tuple[str, int]:
    ahead, out = [end], []
    for _ in range(length):
        ahead.append(_apply(_power(symbol, 0), ahead[-1]))
    moves = sorted((m for m in _moves(symbol)), key=lambda m: m[0])
    for k in range(length, 0, -1):
        here, after = ahead[k], ahead[k - 1]
        while True:
            options = [(e, t, after[t] + cost) for e, s, t, cost in moves if s == state] + [("I", NEXT[state], here[NEXT[state]] + INSERT)]
            edit, to = min((e, t) for e, t, total in options if total == here[state])
            out.append(edit)
            state = to
            if edit != "I":
                break
    return "".join(out), state


def unroll(symbol: int, length: int, end: Vector, state: int) -> tuple[str, int]:
    """The least of the cheapest edits of a run from a state, and the state after it; costs count from the least one, so that runs meet again."""
    least = min(end)
    known = _unrolled if length <= 64 else _unrolled.__wrapped__  # long strings aren't kept
    return known(symbol, length, tuple(x - least for x in end), state)


def trailing(state: int) -> str:
    """What a conversation that ends in a state still needs."""
    return "I" * (END[state] // INSERT)


def _symbol(role: str, fault: int) -> int:
    return GONE if fault in (1, 2) else 1 + 2 * (ROLES.find(role[:1]) if role[:1] in ROLES and role else 3) + (fault == 3)


def _runs(symbols: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(symbol, length) with equal neighbours put together."""
    return [(s, sum(n for _, n in own)) for s, own in groupby(symbols, key=lambda x: x[0])]


def _faults(turns: DataFrame) -> DataFrame:
    """(conv_id, placed, turn, role, print, n, fault): different turns with their numbers; fault 0 none, 1 blank, 2 duplicate, 3 truncated.

    placed: whether a turn number is there. fault is that of the first copy.
    """
    seen = r"[^\x20\x09-\x0D]"
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = turns.select("conv_id", F.col("turn").isNotNull().alias("placed"), "turn", "role", F.md5("text").alias("print"), (~F.col("text").rlike(seen)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    each = own.groupBy("conv_id", "placed", "turn", "role", "print").agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    each = staged(each, "turns")
    first = each.groupBy("conv_id", "role", "print").agg(F.min(F.struct("placed", "turn")).alias("first"))
    a, b = each.alias("a"), first.alias("b")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.print") == F.col("b.print")))
    again = ~F.struct("a.placed", "a.turn").eqNullSafe(F.col("b.first"))
    return both.select("a.conv_id", "a.placed", "a.turn", "a.role", "a.print", "a.n", F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0).alias("fault"))


def _and(df: DataFrame, fields: str) -> StructType:
    """The schema of ``df`` with more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


ORDER = ["placed", "turn", "role", "print"]


def _streamed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _groups(batches: Iterator, keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows) of sorted batches; a group's rows can span batches and are not gathered. A few rows are Python objects at a time."""
    rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _symbols(rows: Iterator[dict]) -> Iterator[tuple[dict, list[tuple[int, int]]]]:
    """Each row with its symbols: copies of a turn that isn't blank are duplicates of it."""
    for r in rows:
        first = (_symbol(r["role"], r["fault"]), 1)
        yield r, [first] if r["n"] == 1 else [first, (GONE, r["n"] - 1)]


LEGAL = ("su", "ua", "au")


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, matrix, first, last, illegal): a row a segment."""
    schema = _and(rows.select("conv_id", "seg"), "matrix array<bigint>, first string, last string, illegal bigint")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, kind = [], to_arrow_schema(schema)
        for (conv, seg), own in _groups(batches, ["conv_id", "seg"]):
            symbols, first, last, illegal = [], None, None, 0
            for r, s in _symbols(own):
                symbols += s
                initial = r["role"][:1]
                first = initial if first is None else first
                illegal += (last is not None and last + initial not in LEGAL) + (r["n"] - 1) * (initial * 2 not in LEGAL)
                last = initial
            matrix = None
            for s, n in _runs(symbols):
                matrix = run_matrix(s, n) if matrix is None else _product(matrix, run_matrix(s, n))
            out.append({"conv_id": conv, "seg": seg, "matrix": [x for row in matrix for x in row], "first": first, "last": last, "illegal": illegal})
            if len(out) >= 4_096:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return _streamed(rows, ["conv_id", "seg"], ORDER).mapInArrow(run, schema)


def _ends(segments: DataFrame) -> DataFrame:
    """(conv_id, seg, opens, end, cost, illegal): the costs at each segment's end, and, on a conversation's first, its cost and illegal neighbours."""
    listed = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "matrix", "first", "last", "illegal"))).alias("segs"))
    schema = _and(segments.select("conv_id", "seg"), "opens boolean, end array<bigint>, cost bigint, illegal bigint")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                segs, v, ends = r["segs"], END, []
                for s in reversed(segs):
                    ends.append(v)
                    v = _apply(tuple(tuple(s["matrix"][4 * k : 4 * k + 4]) for k in range(4)), v)
                between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(segs, segs[1:]))
                illegal = between + sum(s["illegal"] for s in segs)
                for k, (s, end) in enumerate(zip(segs, reversed(ends), strict=True)):
                    out.append({"conv_id": r["conv_id"], "seg": s["seg"], "opens": k == 0, "end": list(end), "cost": None if k else v[START], "illegal": None if k else illegal})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return listed.mapInArrow(run, schema)


def _audits(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, cost, illegal, audit) from rows by segment and the costs at segments' ends."""
    schema = _and(ends.select("conv_id", "seg", "cost", "illegal"), "ways array<struct<edits: string, state: int>>")
    none = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    body, head = ["placed", "turn", "role", "print", "n", "fault"], ["opens", "end", "cost", "illegal"]
    both = ends.select("conv_id", "seg", F.lit(0).alias("kind"), *head, *none(rows, body)).unionByName(rows.select("conv_id", "seg", F.lit(1).alias("kind"), *body, *none(ends, head)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, kind = [], to_arrow_schema(schema)
        for (conv, seg), own in _groups(batches, ["conv_id", "seg"]):
            known = next(own)
            runs = _runs([x for _, s in _symbols(own) for x in s])
            ahead = [tuple(known["end"])]
            for s, n in reversed(runs):
                ahead.append(before_run(s, n, ahead[-1]))
            ways = []
            for start in (START,) if known["opens"] else range(4):
                state, edits = start, []
                for (s, n), end in zip(runs, reversed(ahead[:-1]), strict=True):
                    made, state = unroll(s, n, end, state)
                    edits.append(made)
                ways.append({"edits": "".join(edits), "state": state})
            out.append({"conv_id": conv, "seg": seg, "cost": known["cost"], "illegal": known["illegal"], "ways": ways})
            if len(out) >= 4_096:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    made = _streamed(both, ["conv_id", "seg"], ["kind", *ORDER]).mapInArrow(run, schema)
    listed = made.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.array_sort(F.collect_list(F.struct("seg", "ways"))).alias("segs"))
    zero = F.struct(F.lit(START).alias("state"), F.array().cast("array<string>").alias("edits"))

    def follow(acc: Column, seg: Column) -> Column:
        way = F.get(seg["ways"], acc["state"])
        return F.struct(way["state"].alias("state"), F.concat(acc["edits"], F.array(way["edits"])).alias("edits"))

    ended = F.aggregate("segs", zero, follow)
    ends_with = F.element_at(F.array(*[F.lit(trailing(s)) for s in range(4)]), ended["state"] + 1)
    return listed.select("conv_id", "cost", "illegal", F.concat(F.array_join(ended["edits"], ""), ends_with).alias("audit"))


def _hashes(turns: DataFrame, known: DataFrame) -> DataFrame:
    """``known``, a row for each conversation with its audit, with repaired_sha256, by streaming its turns past it."""
    schema = _and(known, "repaired_sha256 string")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("placed", "boolean"), ("turn", turns.schema["turn"].dataType), ("role", "string"), ("print", "string"), ("text", "string"))]
    head = known.select("conv_id", F.lit(0).alias("kind"), *blank, F.struct(*[c for c in known.columns if c != "conv_id"]).alias("known"))
    body = turns.select("conv_id", F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("placed"), "turn", "role", F.md5("text").alias("print"), "text", F.lit(None).cast(head.schema["known"].dataType).alias("known"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, kind = [], to_arrow_schema(schema)
        for (conv,), own in _groups(batches, ["conv_id"]):
            known = next(own)["known"]
            lines, state, first = hashlib.sha256(), START, True

            def emit(role: str, text: str) -> None:
                nonlocal first
                lines.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False

            edits = iter(known["audit"])
            for r in own:
                for edit in edits:
                    if edit == "K":
                        emit(r["role"], r["text"])
                        state = (SYSTEM, USER, ASSISTANT)[ROLES.index(r["role"][:1])]
                    elif edit != "D":
                        emit(ROLE[state], "" if edit == "I" else r["text"])
                        state = NEXT[state]
                    if edit != "I":
                        break
            for _ in edits:  # insertions at the end
                emit(ROLE[state], "")
                state = NEXT[state]
            out.append({"conv_id": conv, **known, "repaired_sha256": lines.hexdigest()})
            if len(out) >= 1_024:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return _streamed(head.unionByName(body), ["conv_id"], ["kind", *ORDER]).mapInArrow(run, schema)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    ``turns`` (conv_id, turn, role, text). ``conversations`` (conv_id) names those to return, also without turns: zeros, an empty
    audit and the hash of nothing. gaps: turn numbers that are missing between the least and the greatest.
    """
    prepare(turns.sparkSession)
    own = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    full = turns.select("conv_id", "turn", own("role"), own("text"))
    rows = _faults(full).repartitionByRange("conv_id", *ORDER).withColumn("seg", F.spark_partition_id())
    rows = staged(rows, "turn-segments")
    audits = _audits(rows, staged(_ends(_segments(rows)), "turn-ends"))
    own_fault = lambda k: F.sum(F.when(F.col("fault") == k, F.col("n") if k != 3 else 1).otherwise(0))
    # Further copies of a turn that isn't blank are duplicates.
    more = F.sum(F.when(F.col("fault").isin(0, 3), F.col("n") - 1).otherwise(0))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = rows.groupBy("conv_id").agg(gaps.alias("gaps"), own_fault(1).alias("blank"), (own_fault(2) + more).alias("duplicate"), own_fault(3).alias("truncated"))
    ids = (turns if conversations is None else conversations).select("conv_id").distinct().alias("i")
    same = lambda t: F.col("i.conv_id").eqNullSafe(F.col(f"{t}.conv_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    known = ids.join(counts.alias("c"), same("c"), "left").join(audits.alias("a"), same("a"), "left")
    known = known.select("i.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    return _hashes(full, staged(known, "audits"))
