"""Every stage on the smallest tables, against brute force on what the one before kept."""

from collections import Counter

import pytest

import corpus_pipeline
from skyledger.llm import decontaminate as dc
from tests.llm import test_decontaminate as tiles
from tests.llm import test_packing, test_repeats, test_simhash
from tests.llm.test_quality import brute as quality_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, apply in corpus_pipeline.STAGES:
        path = str(root / name)
        apply(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
        out[-1].sort(key=lambda r: r.doc_id)
    return out


def test_the_stages_are_five_and_keep_the_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination",
        "best_fit_packing",
    ]
    for rows in stages[:5]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(stages[0]) > len(stages[1]) > len(stages[2])


def test_quality(stages):
    want = [r for r in stages[0] if quality_of(r.text)[-1]]
    assert Counter(stages[1]) == Counter(want)


def test_near_duplicates(stages):
    rows = stages[1]
    label = test_simhash.classes([test_simhash.brute(r.text) for r in rows])
    assert Counter(stages[2]) == Counter(rows[i] for i in set(label))


def test_repeated_passages(stages):
    figures = test_repeats.brute_words([(r.doc_id, r.text) for r in stages[2]])
    want = {}
    for r, (n, removed, digest) in zip(stages[2], figures):
        if removed < n or not n:
            want[r.doc_id] = (r, removed, digest)
    assert sorted(want) == [r.doc_id for r in stages[3]]
    import hashlib

    for r in stages[3]:
        before, removed, digest = want[r.doc_id]
        if not removed:
            assert r == before
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest
            assert (r.n_chars, r.lang, r.source) == (len(r.text), before.lang, before.source)


def test_benchmark_free(stages, spark):
    items = [tiles.split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seeds = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    kept = []
    for r in stages[3]:
        doc = tiles.split(r.text)
        grams = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        near = [w for w, s in zip(items, seeds) if s & grams]
        share = [sum(t[2] for t in tiles.brute_tiles(doc, w)) / len(w) for w in near]
        if not any(x >= dc.COVERAGE for x in share):
            kept.append(r)
    assert Counter(stages[4]) == Counter(kept)
    assert len(kept) < len(stages[3])


def test_packed(stages):
    test_packing.check(stages[5], stages[4], 2048)


def test_run_gives_the_last_stage(stages, spark):
    assert Counter(corpus_pipeline.run(spark, SF).collect()) == Counter(stages[5])


CLASHES = {
    "n_words": "int", "word_chars": "string", "n_symbols": "double", "N_DUP_LINES": "int",
    "n_repeat_words": "string", "base_failed": "int", "Kept": "string", "line_coverage": "int",
    "gram_coverage": "string", "kept_text": "int", "n_removed": "string", "removed_spans": "int",
    "tilings": "double",
}


def test_columns_named_like_results_come_through(spark, tmp_path):
    """Values and types after every stage, and rows without id, text or sizes of their own."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lost = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    none = docs.limit(2).withColumn("text", F.lit(None).cast("string"))
    docs = docs.unionByName(lost).unionByName(lost).unionByName(none).unionByName(docs.limit(9))
    docs = docs.coalesce(1).withColumn("row", F.monotonically_increasing_id())
    docs = docs.withColumns(
        {c: (F.col("row") + i).cast(t) for i, (c, t) in enumerate(CLASHES.items())}
    )
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    schema, given = docs.schema, {r.row: r for r in docs.collect()}
    for name, apply in corpus_pipeline.STAGES[:4]:
        apply(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
        rows = docs.collect()
        assert rows
        for r in rows:
            for c in ("doc_id", "lang", "source", *CLASHES):
                assert r[c] == given[r.row][c], (name, c)
            if r.text == given[r.row].text:
                assert r.n_chars == given[r.row].n_chars
            else:
                assert name != "quality_rules" and r.n_chars == len(r.text)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.count() >= docs.count()


def test_empty_table_and_no_sizes(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (tmp_path / "none").mkdir()
    for name, rows in (("none", docs.limit(0)), ("few", docs.drop("n_chars"))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(
            str(tmp_path / name / "benchmark.parquet")
        )
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (got.count() > 0) == (name == "few")
