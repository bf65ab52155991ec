import json

from pyspark.sql import functions as F

from seqweave import sources
from seqweave.operators import islands, transcripts
from seqweave.sources import sinks


def word(text, start, end, kind="word", speaker="s1"):
    return {"text": text, "start": start, "end": end, "type": kind, "speaker_id": speaker, "logprob": 0.0}


def test_transcript_to_cues(spark, tmp_path):
    doc = {"language_code": "jpn", "text": "", "words": [word("はい", 0.0, 0.5), word("。", 0.5, 2.0), word(" ", 2, 2, "spacing"), word("。API", 2.0, 2.4), word("そうです", 3.0, 4.0, speaker="s2"), word("", 4, 4)]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    words = sources.read_transcripts(spark, str(tmp_path / "a.json"))
    chars = sources.characters(words).orderBy("pos", "sub").collect()
    assert "".join(c.text for c in chars) == "はい。。APIそうです"
    assert chars[2].end == 0.6 and chars[3].start == 2.0 and abs(chars[3].end - 2.1) < 1e-9
    u = transcripts.units(words)
    assert "".join(r.text for r in u.orderBy("pos").collect()) == "はい。。APIそうです"
    for cues in (transcripts.watch_cues(u), transcripts.translation_cues(u)):
        rows = cues.orderBy("pos").collect()
        assert "".join(r.text for r in rows) == "はい。。APIそうです"
        lines = {}
        for r in rows:
            lines.setdefault((r.cue_id, r.line_no), set()).add(r.speaker)
        assert all(len(s) == 1 for s in lines.values())
    srt = sinks.srt_text(sinks.cue_lines(transcripts.watch_cues(u), ["transcript_id"]), ["transcript_id"])
    sinks.write_text(srt.withColumn("transcript_id", F.lit("a")), str(tmp_path / "out"), ["transcript_id"])
    back = sources.read_blocks(spark, str(tmp_path / "out" / "transcript_id=a"))
    assert back.count() == srt.count() and back.orderBy("pos").first().start == 0.0
    assert sinks.html_text(sinks.cue_lines(transcripts.watch_cues(u), ["transcript_id"]), ["transcript_id"]).count() == srt.count()


def test_blocks_strict_and_lenient(spark, tmp_path):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\na\r\n b \r\n\r\n2\r\nno time\r\nx\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\ny\r\n"
    (tmp_path / "b.srt").write_bytes(text.encode())
    strict = sources.read_blocks(spark, str(tmp_path / "b.srt")).orderBy("pos").collect()
    assert [(r.text, r.start, r.end) for r in strict] == [("a b", 1.0, 2.5), ("y", 3.0, 4.0)]
    assert sources.read_blocks(spark, str(tmp_path / "b.srt"), validate=False).count() == 3


def test_a_block_is_parsed_once(spark):
    times = {"1:2:3 --> 1 : 02:03.": (3723.0, 3723.0), "0:0:.5 --> 0:0:1,25\u3000": (0.5, 1.25), "0:0:1 --> 0:0:2 --> 0:0:3": None, "0:0:1 --> x": None, "x --> 0:0:1": None, "0:0:1": None, " --> ": None}
    files = spark.createDataFrame([("f", "\n\n".join(f"{i}\n{t}\nx" for i, t in enumerate(times)))], "transcript_id string, value string")
    valid, every = sources.parse_blocks(files), sources.parse_blocks(files, validate=False)
    assert [(r["index"], r.start, r.end) for r in valid.orderBy("pos").collect()] == [("0", 3723.0, 3723.0), ("1", 0.5, 1.25)]
    assert [(r.start, r.end) for r in every.orderBy("pos").collect()] == [t or (None, None) for t in times.values()]
    for d in (valid, every):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def test_sentences_of_mixed_inputs(spark, tmp_path):
    doc = {"language_code": "jpn", "text": "", "words": [word("はい。", 0.0, 0.5), word(" ", 0.6, 0.7), word("いえ", 2.0, 2.5)]}
    (tmp_path / "a.JSON").write_text(json.dumps(doc))
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02\nx\ny\n\n2\n00:00:03 --> 00:00:04\nz\n")
    got = sources.read_sentences(spark, [str(tmp_path / "a.JSON"), str(tmp_path / "b.srt")]).collect()
    assert sorted((r.text, r.start, r.end) for r in got) == [("x y", 1.0, 2.0), ("z", 3.0, 4.0), ("いえ", 2.0, 2.5), ("はい。", 0.0, 0.5)]
    assert {r.timecode for r in got if r.text == "いえ"} == {"00:00:02,000 --> 00:00:02,500"}


def test_chunk_files_and_transcripts(spark, tmp_path):
    from seqweave.operators import chunking

    blocks = spark.createDataFrame([("t", i, str(i + 1), "00:00:01,000 --> 00:00:02,000", "a\nb" if i == 2 else f"x{i}") for i in range(5)], "transcript_id string, pos int, index string, timecode string, text string")
    key = ["transcript_id"]
    chunks = chunking.chunks_with_context(blocks, key, size=2, context=1)
    rendered = chunks.select("transcript_id", "chunk_id", chunking.render_chunk(F.col("before"), F.col("core"), F.col("after")).alias("value"))
    sinks.write_chunks(rendered, chunks, blocks, str(tmp_path / "c"), key)
    back = spark.read.json(str(tmp_path / "c" / "original_line_counts")).first()
    assert back.two_line_blocks == [2] and spark.read.json(str(tmp_path / "c" / "metadata")).count() == 5
    assert spark.read.json(str(tmp_path / "c" / "chunks")).agg(F.sum("num_blocks")).first()[0] == 5
    docs = spark.createDataFrame([("jpn", 0.9, "t", "id", [])], "language_code string, language_probability double, text string, transcription_id string, words array<struct<text:string,start:double,end:double,type:string,speaker_id:string,logprob:double>>")
    sinks.write_transcripts(docs, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first().transcription_id == "id"


def test_provider_tokens(spark):
    rows = [("t", None, [(" area", 500, 900, None, 0.0, False), ("x", 900, 1000, "2", 0.5, False), (" ", 1000, 1000, "2", None, False), ("[laugh]", 1000, 1500, None, None, True)])]
    d = spark.createDataFrame(rows, "transcript_id string, text string, tokens array<struct<text:string,start_ms:bigint,end_ms:bigint,speaker:string,confidence:double,is_audio_event:boolean>>")
    got = sources.normalise_provider(d).first()
    assert got.text == " areax [laugh]"
    assert [(w.text, w.start, w.end, w.type, w.speaker_id) for w in got.words] == [
        (" ", 0.5, 0.5, "spacing", "speaker_0"), ("area", 0.5, 0.9, "word", "speaker_0"), ("x", 0.9, 1.0, "word", "speaker_2"), (" ", 1.0, 1.0, "spacing", "speaker_2"), ("[laugh]", 1.0, 1.5, "audio_event", "speaker_0"),
    ]
    assert got.words[1].logprob == 0.0 and got.words[2].logprob == -0.6931


def test_cards(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("audioclip\tscreenclip\ttext\tcontext\n[sound:a.mp3]\t<img src='a.jpg'>\tt\tc\nnone\t\tt\tc\n[sound:b.mp3]\t\tt\tc\n[sound:a.mp3]\t<img src='z.jpg'>\tu\tc\n")
    media = spark.createDataFrame([("a.mp3",), ("a.jpg",)], "file string")
    cards = sources.with_context(sources.playable_cards(sources.read_cards(spark, str(tmp_path / "c.tsv")), media), "Show")
    assert sorted((r.audio, r.image, r.context) for r in cards.collect()) == [("a.mp3", "", "Show | c"), ("a.mp3", "a.jpg", "Show | c")]
    assert sinks.notes(cards, "deck").where("Image = ''").count() == 1
    sinks.write_cards(cards, str(tmp_path / "out"))
    assert sources.read_cards(spark, str(tmp_path / "out")).count() == 2


def test_unfinished_summary_is_refused(spark):
    import pytest

    blocks = spark.createDataFrame([("t", i, str(i + 1), f"00:00:0{i},000 --> 00:00:0{i},900", "x") for i in range(4)], "transcript_id string, pos int, index string, timecode string, text string")
    topics = spark.createDataFrame([("t", 0, 1, 2, "a"), ("t", 1, 3, 4, "b")], "transcript_id string, seq int, start int, end int, summary string")
    got = [r.value for r in sinks.summary_text(topics, blocks, ["transcript_id"]).orderBy("block").collect()]
    assert got[0] == "1\n00:00:00,000 --> 00:00:01,900\na\n"
    with pytest.raises(Exception, match="finished"):
        sinks.summary_text(topics.where("seq = 0"), blocks, ["transcript_id"]).collect()


def test_nothing_crosses_transcripts(spark):
    d = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "transcript_id string, pos int, speaker string")
    assert {r.run_id for r in islands.speaker_runs(d, ["transcript_id"]).collect()} == {0}
