import pytest
from pyspark.sql import functions as F

from seqweave.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: S.timecode(L(13.86)), "00:00:13,859"),
        (lambda: S.timecode(L(3661.5)), "01:01:01,500"),
        (lambda: S.timecode(L(59.9996)), "00:00:59,999"),
        (lambda: S.rounded_timecode(L(13.86)), "00:00:13,860"),
        (lambda: S.rounded_timecode(L(59.9996)), "00:00:59,1000"),
        (lambda: S.rounded_timecode(L(-1.0)), "00:00:00,000"),
        (lambda: S.parse_timecode(L("01:02:03,5")), 3723.5),
        (lambda: S.parse_timecode(L("1:2")), None),
        (lambda: S.clamp_ender(L("。"), L(2.0), L(3.5)), 2.1),
        (lambda: S.clamp_ender(L("。"), L(0.0), L(0.2)), 0.2),
        (lambda: S.clamp_ender(L("。"), L(2.0), L(2.2)), 2.1),
        (lambda: S.without_stops(L("はい。。")), "はい"),
        (lambda: S.without_stops(L("は。い")), "は。い"),
        (lambda: S.balance_words(L("a b c")), "a\nb c"),
        (lambda: S.balance_words(L("aa bb cc dd")), "aa bb\ncc dd"),
        (lambda: S.balance_words(L("word")), "word"),
        (lambda: S.repair_block(L("- foo - bar - baz"), L(False)), "- foo\n- bar\n- baz"),
        (lambda: S.repair_block(L("- foo — - bar"), L(False)), "- foo\n- bar"),
        (lambda: S.repair_block(L("aa bb"), L(True)), "aa\nbb"),
        (lambda: S.strip_language(L("ep.ja")), "ep"),
        (lambda: S.strip_language(L("ep.JA")), "ep"),
        (lambda: S.strip_language(L("ep.raw")), "ep.raw"),
        (lambda: S.strip_language(L("a.ja.ko")), "a.ja"),
        (lambda: S.strip_language(L("ja")), "ja"),
        (lambda: S.visible_chars(L("（笑）はい")), 2),
        (lambda: S.visible_chars(L("a(b(c)d)e")), 2),
        (lambda: S.visible_chars(L("a((((((((((x))))))))))b(c")), 4),
        (lambda: S.visible_chars(L("（a三b）はい（笑）")), 7),  # a byte of 三 is one of the wide bracket's
        (lambda: S.visible_chars(L("{x}a\\Nb \u3000")), 3),
        (lambda: S.pause(L(2)), 0.5),
        (lambda: S.pause(L(1)), None),
        (lambda: F.round(S.pause(L(10)), 6), 0.6),
        (lambda: S.sound_file(L("x [sound:a.mp3] y]")), "a.mp3"),
        (lambda: S.image_file(L("<img src='a.jpg'>")), "a.jpg"),
        (lambda: S.log_confidence(L(0.0)), 0.0),
        (lambda: S.slug(L("A-b 1")), "a_b_1"),
        (lambda: S.stable_id(L("deck")), int(__import__("hashlib").md5(b"deck").hexdigest()[:8], 16)),
        (lambda: S.escape(L("a<b & c")), "a&lt;b &amp; c"),
        (lambda: S.without_fence(L("```json\n[1]\n```")), "[1]"),
        (lambda: S.split_blocks(L(" a \n==\nb"), "=="), ["a", "b"]),
        (lambda: S.split_blocks(L(""), "=="), [""]),
        (lambda: S.speaker_lines(F.array(L("a"), L("b")), L(2)), "- a\n- b"),
        (lambda: S.speaker_lines(F.array(L("a"), L("b")), L(1)), "a\nb"),
        (lambda: S.strip(L("　 a　")), "a"),
        (lambda: S.episode(L("Show E07.srt")), "07"),
        (lambda: S.episode(L("Show - 01 - 12.mp4")), "12"),
        (lambda: S.episode(L("Show E07")), ""),
        (lambda: S.strip_language(L("ep.zh-Hant")), "ep"),
        (lambda: S.strip_language(L("ep.jpn")), "ep.jpn"),
        (lambda: S.strip_language(L(".en")), ""),
        (lambda: S.parse_times(L("00:00:01,5 --> 00:00:02"))[1], 2.0),
        (lambda: S.parse_times(L("00:00:01,5-->00:00:02"))[0], None),
        (lambda: S.parse_times(L("00:00:01,5 --> 00:00:02 X1"))[0], None),
        (lambda: S.numbered(F.array(L("a"), L("b"))), "1. a\n2. b"),
        (lambda: S.clock(L(3661.5)), "1:01:01.500"),
    ],
)
def test_scalar(spark, column, expected):
    assert value(spark, column()) == expected


def test_interpolation_shares_time(spark):
    for i, (a, b) in enumerate([(1.0, 1.1), (1.1, 1.2), (1.2, 1.3), (1.3, 1.4)]):
        x, y = S.interpolate(L(1.0), L(1.4), L(i), L(4))
        assert value(spark, x) == pytest.approx(a) and value(spark, y) == pytest.approx(b)


def test_lines_are_balanced_at_any_length(spark):
    import random
    import time

    rng = random.Random(3)

    def brute(t):
        w = t.split(" ")
        cuts = [(" ".join(w[:k]), " ".join(w[k:])) for k in range(1, len(w))]
        return "\n".join(min(cuts, key=lambda c: abs(len(c[0]) - len(c[1])))) if cuts else t

    texts = ["", " ", "  ", "a ", " a", "日本 é x"] + ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.balance_words(F.col("t")).alias("b")).collect()
    assert all(r.b == brute(r.t) for r in got)
    long, began = "word " * 50_000 + "end", time.perf_counter()
    top, bottom = spark.createDataFrame([(long,)], "t string").select(S.balance_words(F.col("t"))).first()[0].split("\n")
    assert f"{top} {bottom}" == long and abs(len(top) - len(bottom)) <= 5 and time.perf_counter() - began < 10


def test_doubles_are_printed_as_c_prints_them(spark):
    import random

    rng = random.Random(6)
    xs = [0.0, 0.25, 0.75, 1.15, 3.45, 6.55, 2.675, 1.005, 0.125, 99.995] + [rng.randrange(10**6) / 1000 for _ in range(3000)] + [rng.random() * 5000 for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.printed(F.col("x"), 1).alias("a"), S.printed(F.col("x"), 2).alias("b")).collect()
    assert all(r.a == float(f"{r.x:.1f}") and r.b == float(f"{r.x:.2f}") for r in got)
