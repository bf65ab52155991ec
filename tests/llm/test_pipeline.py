"""The pipeline's stages on planted cases and on odd rows, and every query that has SQL against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from seqweave.llm import queries

from .conftest import SCHEMA

DATA = "/root/testdata/sf0.001"


def through(spark, docs, tmp_path, stages=None):
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:stages]):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
    return seen


def test_stages_act_on_planted_cases(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 600 and 4000 and lang = 'en'").orderBy("doc_id").limit(150).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real]
    a, b = rows[0][1], rows[1][1]
    near = a.split()
    near[10] = near[40] = "changed"
    passage = " ".join(b.split()[:70])
    planted = [(90_000, a, "en", "s", 1), (90_001, " ".join(near), "en", "s", 1), (90_002, rows[2][1] + "\n" + passage, "en", "s", 1), (90_003, "### 123 !!! 456", "en", "s", 1), (90_004, rows[3][1] + " mail 34@mail7.example.com 4845168114407329", "en", "s", 1)]
    docs = spark.createDataFrame(rows + planted, SCHEMA)
    language, near_copies, repeats, private, packed = through(spark, docs, tmp_path)
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(docs) - ids(language) == {90_003}
    assert not ids(near_copies) & {90_000, 90_001} and rows[0][0] in ids(near_copies)
    text = {r.doc_id: r.text for r in repeats.collect()}
    assert 90_002 not in text or passage not in text[90_002]
    assert all("34@mail7.example.com" not in r.text and "4845168114407329" not in r.text for r in private.collect())
    assert ids(packed) == ids(private) and all(d.columns == docs.columns for d in (language, near_copies, repeats, private))


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    packed = through(spark, odd, tmp_path / "odd")[-1]
    assert packed.columns == ["doc_id", "n_tokens", "bucket", "pad_to", "batch", "slot"]
    assert all(d.count() == 0 for d in through(spark, empty, tmp_path / "empty"))


def test_stages_with_clashing_columns(spark, odd, clashing, tmp_path):
    """Columns named as helpers are change nothing and keep their values."""
    plain, named = through(spark, odd, tmp_path / "plain"), through(spark, clashing, tmp_path / "named")
    shown = lambda d: sorted(map(repr, d.select("doc_id", "lang", "n_chars").collect()))
    for a, b in zip(plain[:3], named):
        assert b.columns == clashing.columns and shown(a) == shown(b) and b.where("__key = 'x' and spans = 'x' and kept = 'x'").count() == a.count()
    assert sorted(map(repr, plain[-1].select("doc_id", "n_tokens").collect())) == sorted(map(repr, named[-1].select("doc_id", "n_tokens").collect()))


def test_two_texts_of_one_id_both_stay(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 900 and 4000").orderBy("doc_id").limit(40).collect()
    rows = [(i // 2, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(real)]
    language, near_copies, *_ = through(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    distinct = len({r.text for r in real})
    assert language.count() == len(rows) and near_copies.count() >= distinct - 3


def test_tables_of_earlier_stages_are_removed(spark):
    from seqweave.llm import common

    before = common.written()
    out = corpus_pipeline.run(spark, DATA)
    left = [p for p in common.written() if p not in before]
    assert not any(name in p for p in left for name in ("fingerprints", "picks", "anchors", "near-copies", "language")) and out.count() > 0
    common.discard_since(spark, before)
    assert common.written() == before


def test_run_equals_its_stages(spark, tmp_path):
    got = corpus_pipeline.run(spark, DATA)
    want = through(spark, spark.read.parquet(f"{DATA}/documents.parquet"), tmp_path)[-1]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = c.execute(queries.ORACLES[name])
    names = [d[0] for d in theirs.description]
    want = sorted((tuple(r) for r in theirs.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, DATA).collect()), key=repr) == want
