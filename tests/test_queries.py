"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqweave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA)
    theirs = duck.execute(registry.ORACLES[name])
    assert sorted(ours.columns) == sorted(c[0] for c in theirs.description)
    want = rows([c[0] for c in theirs.description], theirs.fetchall())
    assert rows(ours.columns, ours.collect()) == want and want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_exchange_for_consecutive_splits(spark):
    from seqweave.operators import islands

    d = spark.createDataFrame([("a", 0, "x", 0.0, 1.0, "s")], "k string, pos int, text string, start double, end double, speaker string").repartition(3)
    d = islands.segments(islands.sentences(islands.speaker_runs(d, ["k"]), ["k"]), ["k"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1


def test_a_fold_after_a_split_adds_no_exchange(spark):
    from seqweave.operators import folds, islands

    d = spark.createDataFrame([("a", 0, "x", 0, 1, "s")], "k string, pos int, text string, start long, end long, speaker string").repartition(3)
    d = folds.merge_tiny_segments(islands.segments(d, ["k"]), ["k"])
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(k") == 1 and d.count() == 1


def test_folds_survive_empty_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    from seqweave.operators import folds

    d = empty.selectExpr("conv_id", "cast(turn as int) as pos", "text", "0L as start", "0L as end", "role as speaker", "1 as morph_count", "1 as tokens")
    assert folds.token_capped_merge(d, ["conv_id"]).count() == 0 and folds.sentence_cues(d, ["conv_id"]).count() == 0


def test_a_task_holds_no_more_words_of_a_larger_table(spark, tmp_path):
    from seqweave.plans import views

    def most(n):
        words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), F.lit("-"), i.cast("string")), 512)), " ")
        spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), words.alias("text")).write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        parts = views.timed_words(spark, f"{tmp_path}/{n}").groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
        assert parts.agg(F.sum("n")).first()[0] == 20 * n
        return parts.agg(F.max("n")).first()[0]

    assert most(16_000) < 1.5 * most(4_000)


def test_sentence_cues_sort_twice(spark):
    from seqweave.operators import folds

    d = spark.createDataFrame([("a", 0, "x", 0, 1, "s", 1)], "k string, pos int, text string, start long, end long, speaker string, morph_count int").repartition(3)
    plan = folds.sentence_cues(d, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning(k") == 1


def test_next_tokens_within_long_sections(spark):
    """A section without marks, nulls in it and after it."""
    from seqweave.operators import folds

    n = 3000
    rows = [("a", i, "x。" if i == n - 1 else "x", float(i), i + 0.5, "s", None if i % 7 == 3 else i % 5) for i in range(n)] + [("a", n, "y", float(n), n + 0.5, "s", None), ("a", n + 1, "z。", n + 1.0, n + 1.5, "s", None)]
    d = spark.createDataFrame(rows, "k string, pos int, text string, start double, end double, speaker string, morph_count int")
    tokens = [r[6] or 0 for r in rows]
    want = [sum(tokens[i + 1 : n]) for i in range(n - 1)] + [0, 0, 0]
    assert [r.next_tokens for r in folds.next_section_tokens(d, ["k"]).orderBy("pos").collect()] == want
