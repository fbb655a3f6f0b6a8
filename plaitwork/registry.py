"""Every query of the alignment engine, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.functions import prep, sql
from plaitwork.operators import align, chain, checks, schedule, tiles
from plaitwork.plans import oracle as O
from plaitwork.plans.workload import event_anchors, part_pairs, record_pairs, table, turn_pairs
from plaitwork.sources import generators, records, scratch, sinks

Query = Callable[[SparkSession, str], DataFrame]
RECORD, TURN, PART = ["doc_id", "rec"], ["conv_id", "turn"], ["p_partkey"]
#: Parameters of the length queries, as the tests of the fixed sizes use them.
LENGTHS = {"n": 8, "lo": 64, "hi": 512, "quantum": 8}
TILES, THRESHOLD = 128, 8

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@_query(O.sw_sql(O.RECORD_PAIRS, O.RECORD_KEYS))
def sw_score_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sw_scores(record_pairs(spark, sf_dir)).select(*RECORD, "score")


#: Symbols of a tile's sides in these queries, so that the parts' short texts have several tiles.
TILE = 4


def _tiled(local: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tiles.wavefront_scores(part_pairs(spark, sf_dir), PART, local=local, size=TILE).withColumn("score", F.col("score").cast("int"))

    return run


# Anti-diagonals of tiles, each pair over many tasks.
QUERIES["sw_score_wavefront"], SQL["sw_score_wavefront"] = _tiled(True), O.sw_sql(O.PART_PAIRS, O.PART_KEYS)
QUERIES["nw_score_wavefront"], SQL["nw_score_wavefront"] = _tiled(False), O.nw_sql(O.PART_PAIRS, O.PART_KEYS)


@_query()
def sw_score_tiled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns with the next, in tiles of 512 symbols a side."""
    return tiles.wavefront_scores(turn_pairs(spark, sf_dir), TURN, size=512)


@_query(O.sw_sql(O.TURN_PAIRS, O.TURN_KEYS))
def sw_score_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sw_scores(turn_pairs(spark, sf_dir)).select(*TURN, "score")


@_query(
    f"{O.sw_cte(O.TURN_PAIRS)} select conv_id, turn, cast(best as int) score, cast(least(greatest((n + {THRESHOLD - 1}) // {THRESHOLD}, 1), {TILES}) as int) team_size from w join p using (id) where w.k = m + n"
)
def sw_score_scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the next, in tasks of about the same number of cells, and the lanes that each pair is worth."""
    pairs = schedule.team_sizes(turn_pairs(spark, sf_dir), F.length("ref"), THRESHOLD, TILES)
    dealt = schedule.by_cost(pairs, 4 * spark.sparkContext.defaultParallelism, keys=TURN)
    return align.sw_scores(dealt).select(*TURN, "score", "team_size")


#: The bins and the buckets of each class of the query that shows the deal.
BINS, TURN_BUCKETS = 16, 64


@_query(
    f"""with recursive {O.TURN_PAIRS},
c as (select (length(query) + 1) * (length(ref) + 1) cells, (conv_id * 31 + turn) % {TURN_BUCKETS} bucket from p0),
b as (select cast(length(bin(cells)) - 1 as int) class, cast(bucket as int) bucket, count(*) n, cast(sum(cells) as bigint) cells from c group by all),
o as (select *, row_number() over (order by cells desc, class, bucket) i from b),
w(i, loads, bin) as (select 0, list_transform(range({BINS}), lambda x: cast(0 as bigint)), cast(null as int)
  union all select i, list_transform(range({BINS}), lambda x: loads[x + 1] + case when x = spot then cells else 0 end), cast(spot as int)
  from (select o.i, o.cells, loads, list_position(loads, list_min(loads)) - 1 spot from w join o on o.i = w.i + 1))
select class, bucket, n, cells, bin from o join w using (i)"""
)
def cost_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the turns' pairs: each class of cells in buckets by conversation and turn."""
    own = schedule.cell_buckets(turn_pairs(spark, sf_dir), bucket=F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(TURN_BUCKETS)))
    return schedule.cost_bins(own, BINS).withColumnsRenamed({"__class": "class", "__bucket": "bucket"})


@_query(O.sw_sql(O.PART_PAIRS, O.PART_KEYS))
def sw_score_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sw_scores(part_pairs(spark, sf_dir)).select(*PART, "score")


@_query(O.sw_sql(O.PART_PAIRS, O.PART_KEYS))
def sw_score_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs dealt in turns, whatever they are."""
    dealt = schedule.round_robin(part_pairs(spark, sf_dir), 4 * spark.sparkContext.defaultParallelism)
    return align.sw_scores(dealt).select(*PART, "score")


@_query(O.sw_sql(O.PART_PAIRS, O.PART_KEYS))
def sw_score_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sw_scores(part_pairs(spark, sf_dir), method="native").select(*PART, "score")


def _banded(band: int) -> Query:
    return lambda spark, sf_dir: align.sw_banded_scores(record_pairs(spark, sf_dir), band).select(*RECORD, "score")


for _band in (8, 16, 64):
    QUERIES[f"sw_banded_b{_band}"], SQL[f"sw_banded_b{_band}"] = _banded(_band), O.banded_sql(O.RECORD_PAIRS, O.RECORD_KEYS, _band)


def _banded_long(band: int) -> Query:
    return lambda spark, sf_dir: align.sw_banded_scores(record_pairs(spark, sf_dir, 128), band).select(*RECORD, "score")


for _band in (32, 64):
    # Records of 128 symbols, of which a band leaves a part out.
    QUERIES[f"sw_banded_long_b{_band}"], SQL[f"sw_banded_long_b{_band}"] = _banded_long(_band), O.banded_sql(O.record_pairs(128), O.RECORD_KEYS, _band)


@_query(O.argmax_sql(O.RECORD_PAIRS, O.RECORD_KEYS))
def sw_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sw_argmax(record_pairs(spark, sf_dir)).select(*RECORD, "score", "i", "j")


@_query(O.nw_sql(O.RECORD_PAIRS, O.RECORD_KEYS))
def nw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nw_scores(record_pairs(spark, sf_dir)).select(*RECORD, "score")


@_query(O.nw_sql(O.PART_PAIRS, O.PART_KEYS))
def nw_score_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nw_scores(part_pairs(spark, sf_dir), method="native").select(*PART, "score")


@_query(O.matrix_sql(O.PART_PAIRS, O.PART_KEYS))
def nw_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.strip_cells(align.nw_strips(part_pairs(spark, sf_dir), PART), PART)


@_query(O.suffix_sql(O.PART_PAIRS, O.PART_KEYS))
def nw_suffix_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.strip_cells(align.nw_strips(part_pairs(spark, sf_dir), PART, suffix=True), PART)


@_query(O.path_sql(O.PART_PAIRS, O.PART_KEYS))
def nw_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = align.nw_paths(part_pairs(spark, sf_dir))
    return paths.select(*PART, "score", F.posexplode("path").alias("ref_idx", "query_idx"))


@_query(O.alignment_sql(O.PART_PAIRS, O.PART_KEYS))
def nw_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nw_alignments(part_pairs(spark, sf_dir)).select(*PART, "score", "steps")


@_query()
def nw_path_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths of whole conversation turns; long pairs go by blocks."""
    paths = align.nw_paths(turn_pairs(spark, sf_dir))
    return paths.select(*TURN, "score", F.posexplode("path").alias("ref_idx", "query_idx"))


@_query()
def nw_alignment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nw_alignments(turn_pairs(spark, sf_dir)).select(*TURN, "score", "steps")


@_query()
def nw_split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nw_split(turn_pairs(spark, sf_dir)).select(*TURN, "score", "split")


@_query(O.nw_sql(O.TURN_PAIRS, O.TURN_KEYS).replace("cast(w.h1[n + 1] as int) score", "true valid, cast(n as int) point_count, cast(w.h1[n + 1] as int) score, cast(null as varchar) error"))
def check_path_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths traced by the alignments of whole turns, under the rules."""
    checked = checks.check_paths(align.nw_alignments(turn_pairs(spark, sf_dir)).drop("score"))
    return checked.select(*TURN, *[F.col(f"check.{c}").alias(c) for c in ("valid", "point_count", "score", "error")])


@_query(O.split_sql(O.PART_PAIRS, O.PART_KEYS))
def nw_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nw_split(part_pairs(spark, sf_dir)).select(*PART, "score", "split")


_SEGMENTS = f"""{O.PART_PAIRS.replace('p0', 'p1')},
p0 as (select p_partkey, substr(query, length(query) // 2 + 1) query, substr(ref, 1, length(ref) // 2) ref from p1)"""


@_query(O.nw_sql(_SEGMENTS, O.PART_KEYS))
def nw_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of each name with the first half of each type."""
    m, n = F.length("query"), F.length("ref")
    half = lambda x: F.floor(x / 2).cast("int")
    return align.nw_segment_scores(part_pairs(spark, sf_dir), half(m), m, F.lit(0), half(n)).select(*PART, "score")


def _chain(lookback: int) -> Query:
    return lambda spark, sf_dir: chain.chain_scores(event_anchors(spark, sf_dir), lookback)


for _lookback in (2, 4, 8, 16):
    QUERIES[f"chain_lb{_lookback}"], SQL[f"chain_lb{_lookback}"] = _chain(_lookback), O.chain_sql(_lookback)


@_query(O.one_chain_sql(8))
def chain_events_lb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, in order, as one chain over all tasks."""
    anchors = event_anchors(spark, sf_dir).withColumn("chain_id", F.lit(0))
    return chain.long_chain_scores(anchors, 8)


@_query(O.edges_sql(8))
def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.chain_edges(event_anchors(spark, sf_dir), 8)


_DRAWN = f"""with recursive g(c_custkey, nr, s) as (select c_custkey, -1, cast(xor(c_custkey, {prep.SEED_MASK}) as ubigint) from customer
  union all select c_custkey, nr + 1, (s * {prep.LCG_A} + {prep.LCG_C}) % {prep.LCG_M} from g where nr < 7),
l as (select c_custkey, cast(nr as int) nr, 64 + s % 449 len from g where nr >= 0)"""
_QUANTISED = "cast(greatest(64, least(((len + 7) // 8) * 8, 512)) as int)"


@_query(f"{_DRAWN} select c_custkey, nr, {_QUANTISED} len from l")
def lcg_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lengths for each customer, whose key is the seed."""
    return generators.lengths(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", **LENGTHS)


@_query(f"{_DRAWN} select c_custkey, nr, {_QUANTISED} qry_len, {_QUANTISED} ref_len from l")
def copied_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn lengths as those of both sides of pairs."""
    drawn = lcg_lengths(spark, sf_dir).withColumnRenamed("len", "qry_len")
    return drawn.withColumn("ref_len", prep.copied_length(F.col("qry_len")))


@_query(
    "select doc_id, cast(greatest(1, least(((n + 31) // 32) * 32, greatest(32, (4096 // 32) * 32))) as int) padded from (select doc_id, length(text) n from documents)"
)
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's length rounded up to whole records, between 1 and 4,096."""
    lo, hi = prep.clamp_bounds(F.lit(0), F.lit(4_096))
    return table(spark, sf_dir, "documents").select("doc_id", prep.quantise(F.length("text"), F.lit(32), lo, hi).cast("int").alias("padded"))


_PADDED = O.PART_PAIRS.replace("p_name query, lower(p_type) ref", "rpad(p_name, 40, chr(1)) query, rpad(lower(p_type), 40, chr(2)) ref")


@_query(f"""{O.sw_cte(_PADDED)} select p_partkey, cast(best as int) score, cast(best as int) padded_score from w join p using (id) where w.k = m + n""")
def pad_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of the parts' pairs, and of the same pairs padded to one length by symbols that match nothing."""
    pairs = part_pairs(spark, sf_dir).withColumn("q", prep.pad_tail(F.col("query"), F.lit(40), "\x01")).withColumn("r", prep.pad_tail(F.col("ref"), F.lit(40), "\x02"))
    both = align.sw_scores(align.sw_scores(pairs), "q", "r", "padded_score")
    return both.select(*PART, "score", "padded_score")


@_query("select doc_id, cast(length(text) as int) len, doc_id * length(text) pack_offset from documents")
def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("len"), (F.col("doc_id") * F.length("text")).alias("pack_offset"))


@_query("select doc_id, cast(length(text) as int) len, row_number() over (order by length(text), doc_id) - 1 rank from documents")
def sort_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("len"))
    return schedule.ranked_by_length(docs, F.col("len"), "doc_id")


@_query(f"with {O.TURN_PAIRS} select conv_id, turn, cast(length(query) as int) qry_len, cast(length(ref) as int) ref_len from p0")
def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select(*TURN, F.length("query").alias("qry_len"), F.length("ref").alias("ref_len"))


@_query(f"select doc_id, cast(least(greatest((length(text) + {THRESHOLD - 1}) // {THRESHOLD}, 1), {TILES}) as int) team_size from documents")
def team_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.team_sizes(table(spark, sf_dir, "documents"), F.length("text"), THRESHOLD, TILES).select("doc_id", "team_size")


@_query(
    f"""with t as (select doc_id, length(text) n, greatest({THRESHOLD}, (length(text) + {TILES - 1}) // {TILES}) w, least(greatest((length(text) + {THRESHOLD - 1}) // {THRESHOLD}, 1), {TILES}) team from documents)
select doc_id, cast(lane as int) lane, cast(least(lane * w, n) as int) lo, cast(least((lane + 1) * w, n) as int) hi from (select *, unnest(range(0, team)) lane from t)"""
)
def chunk_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.chunks(table(spark, sf_dir, "documents"), F.length("text"), THRESHOLD, TILES, ["doc_id"])


@_query(
    f"""with {O.PART_PAIRS} select p_partkey, cast(i as int) i, cast(least(i, n) as int) lo, cast(least(n, i + 4) as int) hi
from (select p_partkey, length(ref) n, unnest(range(0, length(query))) i from p0)"""
)
def band_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = part_pairs(spark, sf_dir).select(*PART, F.length("ref").alias("n"), F.posexplode(F.split("query", "")).alias("i", "_"))
    own = prep.band_limits(F.col("i"), F.col("n"), 4)
    return each.select(*PART, "i", own["lo"].alias("lo"), own["hi"].alias("hi"))


_TOKENS = r"""t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') t from documents),
r as (select doc_id, cast(k as int) rec_no, t[2 * k + 1] label, substr(t[2 * k + 2], 1, 32) seq from (select doc_id, t, unnest(range(0, len(t) // 2)) k from t))"""


@_query(f"with {_TOKENS} select doc_id, rec_no, label, seq from r")
def records_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(f"with {_TOKENS} select doc_id, cast(rec_no // 4 as int) seq_no, substr(string_agg(seq, '' order by rec_no), 1, 100) seq from r group by doc_id, rec_no // 4")
def records_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each four records of a text as one sequence of at most 100 symbols."""
    return records.concat_records(records.records(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 4, 100)


@_query(
    f"""with {_TOKENS}, n as (select doc_id, count(*) n from r group by doc_id)
select doc_id, cast(s as int) slot, rec_no, seq from (select doc_id, n, unnest(range(0, 64)) s from n) join r using (doc_id) where s % n = rec_no"""
)
def records_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-four records of each text, read cyclically."""
    docs = table(spark, sf_dir, "documents")
    held = docs.select("doc_id", F.explode(F.array(records.token_records(F.col("text")))).alias("r")).withColumn("n", F.size("r"))
    recs = held.select("doc_id", "n", F.posexplode("r").alias("rec_no", "r")).select("doc_id", "n", "rec_no", "r.seq")
    return records.wrap_records(recs, "doc_id", F.col("n"), 64)


@_query(
    r"""with t as (select list_filter(flatten(list(regexp_split_to_array(text, '\s+') order by doc_id)), lambda x: x <> '') t from documents where text is not null)
select cast(k as bigint) rec_no, t[2 * k + 1] label, substr(t[2 * k + 2], 1, 32) seq from (select t, unnest(range(0, len(t) // 2)) k from t)"""
)
def records_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts written as record files, and read back as one stream of records that span lines, splits and files."""
    path = scratch.scratch_folder(spark, "records")
    sinks.write_texts(table(spark, sf_dir, "documents"), "text", "doc_id", path)
    return records.read_records(spark, path)


#: Records for each text, more than the texts have on average: the file is read more than once.
WRAPPED = 400


@_query(
    rf"""with t as materialized (select row_number() over (order by doc_id, k) - 1 i, w from (select doc_id, unnest(x) w, unnest(range(len(x))) k from (
  select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> '') x from documents where text is not null))),
n as (select count(*) n, (select {WRAPPED} * count(*) from documents) wanted from t),
p as (select unnest(range(2 * wanted)) p, n from n),
r as (select p // 2 rec_no, p % 2 odd, w from p join t on t.i = p.p % p.n)
select rec_no, max(w) filter (odd = 0) label, substr(max(w) filter (odd = 1), 1, 32) seq from r group by rec_no"""
)
def records_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts' record files read over and over, until there are 400 records for each text."""
    docs, path = table(spark, sf_dir, "documents"), scratch.scratch_folder(spark, "records")
    sinks.write_texts(docs, "text", "doc_id", path)
    return records.read_wrapped(spark, path, WRAPPED * docs.count())


@_query(
    f"""{O.sw_cte(O.PART_PAIRS)}, {O.diagonals(O.banded_cell(4), '0', ', greatest(w.best, coalesce(list_max(w.h), 0))', 'best:0', name='v')}
select p_partkey, cast(v.best as int) actual, cast(w.best as int) expected from w join p using (id) join v using (id) where w.k = m + n and v.k = m + n and v.best <> w.best"""
)
def check_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts whose banded score isn't their full one."""
    pairs = part_pairs(spark, sf_dir)
    return checks.mismatches(align.sw_banded_scores(pairs, 4), align.sw_scores(pairs, method="native"), PART, "score")


@_query(f"{O.both_cte(O.PART_PAIRS)} select p_partkey, i, j, s.h actual, f.h expected from f join s using (id, i, j) join p using (id) where f.h <> s.h")
def check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells where the suffix matrix isn't the prefix matrix."""
    pairs = part_pairs(spark, sf_dir)
    own = lambda m: align.cells(m, PART)
    return checks.mismatches(own(align.nw_suffix_matrix(pairs)), own(align.nw_matrix(pairs)), [*PART, "i", "j"], "h")


@_query(O.check_path_sql(O.PART_PAIRS, O.PART_KEYS))
def check_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = checks.check_paths(align.nw_paths(part_pairs(spark, sf_dir)))
    return checked.select(*PART, *[F.col(f"check.{c}").alias(c) for c in ("valid", "point_count", "score", "error")])


def _changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths with some checkpoints changed, in five ways by part: none, every second one left out, one out of range, one moved, all turned around."""
    middle = lambda x: F.transform("path", lambda i, j: F.when(j == F.floor(F.size("path") / 2), x(i)).otherwise(i))
    kind = F.col("p_partkey") % 5
    changed = F.when(kind == 0, F.col("path")).when(kind == 1, F.transform("path", lambda i, j: F.when(j % 2 == 1, -1).otherwise(i)))
    changed = changed.when(kind == 2, middle(lambda i: F.length("query") + 3)).when(kind == 3, middle(lambda i: i + 1)).otherwise(F.reverse("path"))
    return align.nw_paths(part_pairs(spark, sf_dir)).withColumn("path", changed).drop("score")


_CHECKED = ("valid", "bad_ref", "bad_query", "point_count", "score", "error")


@_query(f"select * exclude (expected) from ({O.changed_paths_sql(O.PART_PAIRS)})")
def check_path_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_paths(_changed_paths(spark, sf_dir)).select(*PART, *[F.col(f"check.{c}").alias(c) for c in _CHECKED])


@_query(f"select p_partkey, score, expected from ({O.changed_paths_sql(O.PART_PAIRS, 'score <> expected')})")
def path_score_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths whose traced score isn't the optimum."""
    return checks.suboptimal_paths(_changed_paths(spark, sf_dir)).select(*PART, "check.score", "expected")


@_query(
    f"""with recursive {O.ANCHORS}, {O.chain_cte(2)}, {O.chain_cte(8, 'e')}
select chain_id, idx, cast(cs.score as int) actual, cast(es.score as int) expected from cs join es using (chain_id, idx) where cs.score <> es.score"""
)
def check_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors whose score with a look back of 2 isn't the one with 8."""
    anchors = event_anchors(spark, sf_dir)
    return checks.mismatches(chain.chain_scores(anchors, 2), chain.chain_scores(anchors, 8), ["chain_id", "idx"], "score")


_BAD = "case when n = 0 then 'passed' else 'failed(' || n || ')' end"


@_query(
    f"""with recursive {O.ANCHORS}, {O.chain_cte(2)}, {O.chain_cte(8, 'e')},
n as (select count(*) n from cs join es using (chain_id, idx) where cs.score <> es.score)
select 'local' batch, 'chain' app, 'lb8' test, 'passed' status, '0 differences' log
union all select 'local', 'chain', 'lb2', {_BAD}, n || ' differences' from n
union all select 'local', 'sw', 'rect', 'passed', '0 differences'"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run: the look back of 8 against itself, of 2 against it, and both ways of scoring the parts' pairs."""
    anchors, pairs = event_anchors(spark, sf_dir), part_pairs(spark, sf_dir)
    expected = chain.chain_scores(anchors, 8)
    runs = [
        ("chain", "lb8", checks.verdict(chain.chain_scores(anchors, 8), expected, ["chain_id", "idx"], "score")),
        ("chain", "lb2", checks.verdict(chain.chain_scores(anchors, 2), expected, ["chain_id", "idx"], "score")),
        ("sw", "rect", checks.verdict(align.sw_scores(pairs), align.sw_scores(pairs, method="native"), PART, "score")),
    ]
    log = F.concat(F.col("n_bad").cast("string"), F.lit(" differences"))
    rows = [df.select(F.lit("local").alias("batch"), F.lit(app).alias("app"), F.lit(test).alias("test"), sinks.run_status().alias("status"), log.alias("log")) for app, test, df in runs]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _in_sql(text: str, oracle: str, name: str) -> None:
    """A query in Spark SQL over the views part_pairs and anchors, and SQL of another engine for its rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql.register(spark)
        return spark.sql(text, part_pairs=part_pairs(spark, sf_dir), anchors=event_anchors(spark, sf_dir))

    QUERIES[name], SQL[name] = run, oracle


_in_sql("select p_partkey, r.* from (select p_partkey, sw_argmax(query, ref) r from {part_pairs}) t", O.argmax_sql(O.PART_PAIRS, O.PART_KEYS), "sw_argmax_sql")
_in_sql("select p_partkey, r.* from (select p_partkey, nw_split(query, ref) r from {part_pairs}) t", O.split_sql(O.PART_PAIRS, O.PART_KEYS), "nw_split_sql")
_in_sql(
    "select p_partkey, nw_score(query, ref) score, c.ref_idx, c.query_idx from {part_pairs} p, lateral nw_path_cells(p.query, p.ref) c",
    O.path_sql(O.PART_PAIRS, O.PART_KEYS),
    "nw_path_sql",
)
_in_sql(
    "select p_partkey, i, cast(first + k as int) j, h from (select p_partkey, s.i, s.j first, posexplode(s.h) as (k, h) from {part_pairs} p, lateral nw_strips(p.query, p.ref) s) t",
    O.matrix_sql(O.PART_PAIRS, O.PART_KEYS),
    "nw_matrix_sql",
)
_in_sql(
    "select p_partkey, c.valid, c.point_count, c.score, c.error from (select p_partkey, check_path(query, ref, nw_path(query, ref)) c from {part_pairs}) t",
    O.check_path_sql(O.PART_PAIRS, O.PART_KEYS),
    "check_path_sql",
)
_in_sql("select * from chain_scores(table(select * from {anchors}) partition by chain_id order by (idx, x, y), 8)", O.chain_sql(8), "chain_lb8_sql")
