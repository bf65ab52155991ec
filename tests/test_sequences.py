"""Operators over ordered rows against plain Python on random sequences, and the named edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from seqweave.operators import chunking, folds, islands, pairing, summaries

SCHEMA = "k int, pos int, text string, start double, end double, speaker string, ends_clause boolean, morph_count int"


def sequences(seed, groups=60):
    rng, rows = random.Random(seed), []
    for k in range(groups):
        t = 0.0
        for pos in range(rng.randrange(1, 40)):
            text = "".join(rng.choice("あいうえ") for _ in range(rng.randrange(1, 8))) + rng.choice(["", "", "", "、", "。", "!"])
            end = t + rng.choice([0.2, 0.5, 1.0])
            rows.append((k, pos, text, round(t, 3), round(end, 3), rng.choice("AAAB"), rng.random() < 0.2, rng.randrange(1, 5)))
            t = end + rng.choice([0.0, 0.0, 0.1, 0.3, 0.4, 0.6])
    return rows


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def segments_of(rows):
    out = []
    for r in rows:
        p = out[-1][-1] if out else None
        if p is None or p[5] != r[5] or r[3] - p[4] >= 0.1 or p[2][-1] in "。！？!?、," or p[6]:
            out.append([])
        out[-1].append(r)
    return out


def chars(units):
    return sum(len(u[2]) for u in units)


def merged(segs):
    out = []
    for s in segs:
        if out and chars(s) < 8 and s[0][5] == out[-1][-1][5] and not any("。" in u[2] for u in out[-1]) and s[0][3] - out[-1][-1][4] < 0.4:
            both = out[-1] + s
            if chars(both) <= 18:
                out[-1] = both
                continue
            cut = next((i for i in range(1, len(both)) if both[i - 1][2].endswith("。")), None)
            cut = cut or min(range(1, len(both)), key=lambda i: (abs(2 * chars(both[:i]) - chars(both)), i))
            out[-1:] = [both[:cut], both[cut:]]
        else:
            out.append(s)
    return out


def cues_of(rows):
    out, cur = [], []

    def ahead(i):
        n = 0
        for r in rows[i + 1 :]:
            if r[5] != rows[i][5]:
                break
            n += r[7]
            if r[2][-1] in "。！？!?、":
                break
        return n

    for i, r in enumerate(rows):
        if cur and (r[5] != cur[-1][5] or r[3] - cur[-1][4] >= 0.4):
            out.append(cur)
            cur = []
        cur.append(r)
        t = sum(u[7] for u in cur)
        if r[2][-1] in "。！？!?" or r[2][-1] == "、" and t >= 5 and not (ahead(i) <= 2 and t <= 7):
            out.append(cur)
            cur = []
    return out + [cur] if cur else out


def capped(cues):
    out = []
    for c in cues:
        if out and c[0][3] - out[-1][-1][4] < 0.4 and sum(u[7] for u in out[-1] + c) <= 20:
            out[-1] = out[-1] + c
        else:
            out.append(c)
    return out


def labels(groups):
    return {r[:2]: i for g in groups for i, part in enumerate(g) for r in part}


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_and_folds_match_plain_python(spark, seed):
    rows = sequences(seed)
    df, groups = spark.createDataFrame(rows, SCHEMA).repartition(5), by_key(rows)
    segs = islands.segments(df, ["k"])
    assert {(r.k, r.pos): r.segment_id for r in segs.collect()} == labels(segments_of(g) for g in groups.values())
    tiny = folds.merge_tiny_segments(segs, ["k"])
    assert {(r.k, r.pos): r.segment_id for r in tiny.collect()} == labels(merged(segments_of(g)) for g in groups.values())
    cues = folds.sentence_cues(df, ["k"])
    assert {(r.k, r.pos): r.cue_id for r in cues.collect()} == labels(cues_of(g) for g in groups.values())
    summed = islands.summarise(cues, ["k", "cue_id"])
    got = folds.token_capped_merge(summed, ["k"], order=("cue_id",)).join(cues.select("k", "pos", "cue_id"), ["k", "cue_id"])
    assert {(r.k, r.pos): r.group_id for r in got.collect()} == labels(capped(cues_of(g)) for g in groups.values())


def test_cap_and_comma_examples(spark):
    d = spark.createDataFrame([(0, 0, 0.0, 1.0, 12), (0, 1, 1.0, 2.0, 8), (0, 2, 2.0, 3.0, 1)], "k int, pos int, start double, end double, tokens int")
    assert [r.group_id for r in folds.token_capped_merge(d, ["k"]).orderBy("pos").collect()] == [0, 0, 1]
    for current, following, flushed in ((4, 9, False), (5, 2, False), (7, 2, False), (8, 2, True), (6, 3, True)):
        rows = [(0, 0, "あ、", 0.0, 1.0, "A", False, current), (0, 1, "い。", 1.0, 2.0, "A", False, following)]
        got = [r.cue_id for r in folds.sentence_cues(spark.createDataFrame(rows, SCHEMA), ["k"]).orderBy("pos").collect()]
        assert got == ([0, 1] if flushed else [0, 0])
    other = [(0, 0, "あ、", 0.0, 1.0, "A", False, 1), (0, 1, "い", 1.0, 2.0, "B", False, 9)]
    assert folds.next_section_tokens(spark.createDataFrame(other, SCHEMA), ["k"]).orderBy("pos").first().next_tokens == 0


def test_gap_rule_uses_ieee_difference(spark):
    d = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 1.4, 1.5), (1, 0, 0.0, 0.0), (1, 1, 0.4, 0.5)], "k int, pos int, start double, end double")
    got = islands.label_runs(d, islands.gap(["k"]) >= 0.4, ["k"], "g").orderBy("k", "pos").collect()
    assert [r.g for r in got] == [0, 0, 0, 1]


def test_summary_sentence_edges(spark):
    rows = [(0, 0, "a", 0.0, 1.0, None), (0, 1, "b", 1.0, 2.0, "A"), (0, 2, "c", 3.0, 4.0, "A"), (0, 3, "。API", 4.0, 5.0, "A"), (0, 4, "d", 5.0, 6.0, "A")]
    d = islands.summary_sentences(spark.createDataFrame(rows, "k int, pos int, text string, start double, end double, speaker string"), ["k"])
    assert [r.sentence_id for r in d.orderBy("pos").collect()] == [0, 0, 1, 1, 1]
    s = islands.sentences(spark.createDataFrame([(0, 0, "はい."), (0, 1, "そう")], "k int, pos int, text string"), ["k"])
    assert [r.sentence_id for r in s.orderBy("pos").collect()] == [0, 0]


def test_phrases_follow_prefixes(spark):
    tags = ["接頭辞", "名詞", "助詞", "動詞", "助動詞", "補助記号"]
    d = islands.phrases(spark.createDataFrame([(0, i, t) for i, t in enumerate(tags)], "k int, pos int, pos1 string"), ["k"])
    assert [r.phrase_id for r in d.orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1]
    m = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(p).alias("pos1")) for s, p in (("行く", "動詞"), ("ので", "助詞"), ("、", "補助記号"))])
    assert spark.range(1).select(islands.ends_clause(m, ["ので"]).alias("x")).first().x


def line_pairs(lines):
    out, i = [], 0
    need = lambda x: x[3] - x[2] < 0.6 or x[1] / (x[3] - x[2]) > 8
    while i < len(lines):
        a = lines[i]
        b = lines[i + 1] if i + 1 < len(lines) else None
        if a[1] <= 18 and b and (need(a) or need(b)) and b[1] <= 18 and b[2] - a[3] < 0.4:
            out.append((a[0], b[0]))
            i += 2
        else:
            out.append((a[0],))
            i += 1
    return out


def test_pairing_needs_no_fold(spark):
    rng, rows, want = random.Random(5), [], {}
    for k in range(80):
        t, lines = 0.0, []
        for i in range(rng.randrange(1, 25)):
            e = round(t + rng.choice([0.3, 0.8, 2.0, 4.0]), 3)
            lines.append((i, rng.choice([5, 9, 17, 18, 19]), t, e))
            t = round(e + rng.choice([0, 0, 0.2, 0.5]), 3)
        rows += [(k, *x, rng.choice("AB")) for x in lines]
        for c, p in enumerate(line_pairs(lines)):
            want |= {(k, i): (c, n) for n, i in enumerate(p)}
    d = pairing.pair_lines(spark.createDataFrame(rows, "k int, line_id int, chars int, start double, end double, speaker string"), ["k"])
    assert {(r.k, r.line_id): (r.cue_id, r.nth) for r in d.collect()} == want


def test_balanced_split_and_stops(spark):
    d = spark.createDataFrame([(0, i, "あいう") for i in range(3)] + [(1, 0, "ab。"), (1, 1, "cdefgh"), (1, 2, "ij")] + [(2, 0, "x")], "k int, pos int, text string")
    got = {(r.k, r.pos): r.line_no for r in pairing.balanced_split(d, ["k"]).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (1, 0): 0, (1, 1): 1, (1, 2): 1, (2, 0): 0}
    cut = {(r.k, r.pos): r.line_no for r in pairing.split_at_stop(d, ["k"]).collect()}
    assert cut[1, 0] == 0 and cut[1, 1] == cut[1, 2] == 1 and cut[0, 2] == 0


@pytest.mark.parametrize("n, size, last", [(499, 50, 49), (500, 100, 100)])
def test_chunk_sizes(spark, n, size, last):
    d = spark.range(n).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("t\n"), F.col("id")).alias("text"))
    c = chunking.chunks_with_context(d, ["k"]).orderBy("chunk_id").collect()
    assert c[0].num_blocks == size and c[-1].num_blocks == last and len(c[1].before) == 5 and c[1].before[0] == f"t\n{size - 5}"
    assert c[1].core[0] == f"t {size}" and c[0].before == [] and c[-1].after == []


def test_processing_check_and_reassembly(spark):
    d = spark.range(12).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("pos"), F.lit("a\nb").alias("text"))
    c = chunking.chunks_with_context(d, ["k"], size=5)
    out = chunking.process_chunks(c, lambda b, core, a: ["one two"] * (len(core) - (len(core) == 2)), ["k"])
    states = {r.chunk_id: r.state for r in chunking.check_chunks(c, out, ["k"]).collect()}
    assert states == {0: "ok", 1: "ok", 2: "mismatch"}
    got = [r.text for r in chunking.reassemble(d, c, out, ["k"]).orderBy("pos").collect()]
    assert got == ["one\ntwo"] * 11 + [""]


def test_range_repair_and_core(spark):
    t = spark.createDataFrame([(0, 1, 3, "a"), (0, 6, 8, "b")], "k int, start int, end int, summary string").withColumn("n", F.lit(10))
    assert [(r.start, r.end) for r in summaries.close_gaps(t, ["k"]).orderBy("start").collect()] == [(1, 5), (6, 10)]
    bad = spark.createDataFrame([(0, 1, 4, "a"), (0, 4, 6, "b"), (1, 2, 3, "a"), (2, 1, 11, "a"), (3, 1, 2, " ")], "k int, start int, end int, summary string").withColumn("n", F.lit(10))
    problems = {r.k for r in summaries.check_ranges(bad, ["k"]).where("problem is not null").collect()}
    assert problems == {0, 1, 2, 3}
    assert summaries.repair([(1, 3, "a"), (6, 8, "b")], 10) == [(1, 5, "a"), (6, 10, "b")]
    for wrong in ([(1, 4, "a"), (4, 6, "b")], [(2, 3, "a")], [(1, 11, "a")], [(1, 2, " ")], []):
        assert summaries.repair(wrong, 10) is None
    w = spark.createDataFrame([(0, 1, 20), (0, 21, 30), (0, 31, 40), (1, 1, 30), (1, 31, 40)], "k int, start int, end int").withColumns({"cursor": F.lit(0), "final": F.lit(False)})
    assert [(r.k, r.start) for r in summaries.core_region(w, ["k"]).orderBy("k", "start").collect()] == [(0, 1), (1, 1)]


@pytest.mark.parametrize("n, tiles", [(40, 8), (41, 9), (65, 13), (66, 14)])
def test_fallback_tiles_stay_aligned(spark, n, tiles):
    d = spark.range(n).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("pos"), F.lit("s").alias("text"))
    got = [(r.start, r.end) for r in summaries.summary_loop(d, ["k"]).orderBy("seq").collect()]
    assert got == [(i * 5 + 1, min(i * 5 + 5, n)) for i in range(tiles)]
    said = summaries.summary_loop(d, ["k"], lambda texts, recent: [(1, 10, "a"), (11, len(texts), "b")]).orderBy("seq").collect()
    assert said[0].start == 1 and said[-1].end == n and all(b.start == a.end + 1 for a, b in zip(said, said[1:]))
