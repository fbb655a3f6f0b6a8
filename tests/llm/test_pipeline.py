"""The pipeline's stages against plain versions, on a corpus with labels and a benchmark."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import corpus
import pytest
from pyspark.sql import functions as F
from test_other_operators import toxic_rows

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="module")
def tables(spark, benchmark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    made, labels = toxic_rows(n=400)
    rows = [*corpus.rows(), *[(r[0] + 10_000, *r[1:]) for r in made]]
    spark.createDataFrame(rows, corpus.SCHEMA).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(k + 10_000, q, y) for k, q, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    benchmark.write.parquet(str(top / "benchmark.parquet"))
    return str(top), {k + 10_000: y for k, _, y in labels}


def test_stages(spark, tables):
    import corpus_pipeline
    from test_text_operators import plain_cut_lines, plain_kept, plain_lines, plain_neighbours

    path, toxic = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = f"{path}/out-{name}"
        stage(spark, docs, path).write.parquet(out)
        docs = seen[name] = spark.read.parquet(out)
        if name != "bpe":
            assert docs.columns == before.columns
            assert docs.where("text is not null and n_chars <> length(text)").count() == 0
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "toxicity":
            gone = {k for k, _ in rows} - {r["doc_id"] for r in docs.collect()}
            assert len(gone & {k for k, y in toxic.items() if y}) > 0.9 * sum(toxic.values())
            assert not [k for k in gone if not toxic.get(k)]
        elif name == "line_dedup":
            lines = plain_lines(rows, corpus_pipeline.COPY_SHARE)
            cut = [(k, t, plain_cut_lines(t, lines.get((k, t)))) for k, t in rows]
            want = Counter((k, x) for k, t, x in cut if x == t or x.strip())
            assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == want
            # Near copies still are whole texts, so that the next stage finds them.
            far, near = plain_neighbours(rows), plain_neighbours([*want])
            copies = lambda found: len(found) - len({frozenset(v[2]) for v in found.values()})
            assert copies(near) >= 0.8 * copies(far) > 3
        elif name == "ngram_jaccard":
            assert plain_kept(plain_neighbours(rows), {(r["doc_id"], r["text"]) for r in docs.collect()})
        elif name == "bpe":
            want = Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
            assert Counter((r["doc_id"], r["decoded_sha256"]) for r in docs.collect()) == want
    assert corpus_pipeline.run(spark, path).count() == seen["bpe"].count()


def plain_cut(text, items, n=10):
    """The text without its benchmark words and what follows each of them, or None if it goes."""
    w, hit = corpus.words(text), set()
    for own in items:
        k = min(n, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(w) - k + 1) if own else ():
            if tuple(w[i : i + k]) in grams:
                hit |= {*range(i, i + k)}
    if not hit:
        return True, text
    if 2 * len(hit) > len(w):
        return False, None
    places = [m.span() for m in corpus.WORD.finditer(text.translate(corpus.LOWER))]
    out = [text[: places[0][0]]]
    for i, (at, _) in enumerate(places):
        if i not in hit:
            out.append(text[at : places[i + 1][0] if i + 1 < len(places) else len(text)])
    if len(places) - 1 in hit:
        out.append(text[places[-1][1] :])  # what stands after the last word stays
    return True, "".join(out)


def test_decontamination_stage(spark, tables, docs):
    import corpus_pipeline

    path, _ = tables
    items = [corpus.words(r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = [(k, t, *plain_cut(t, items)) for k, t in rows]
    want = Counter((k, x) for k, _, stays, x in plain if stays)
    got = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, path)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert sum(1 for _, t, stays, x in plain if stays and x != t) > 3 and sum(1 for x in plain if not x[2]) > 1


def test_stages_on_no_documents(spark, tables, no_docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, tables[0]).agg(F.count("*")).first()[0] == 0
