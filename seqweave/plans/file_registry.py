"""Queries over files, cards, provider results and summaries, all made from the tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunking, islands, summaries
from ..sources import files, sinks
from .registry import _BLOCKS, _GROUPS, _SUMMARY_SENTENCES, _TILES, KEY, _blocks, _groups, _returned, _sentence_table, query
from .views import TIMED, table, timed_words

_CODE = "printf('%02d:%02d:%02d,%03d', floor({x} / 3600)::INT, floor(floor({x}) % 3600 / 60)::INT, floor({x})::INT % 60, floor(({x} % 1) * 1000)::INT)"
_ROUNDED = "printf('%02d:%02d:%02d,%03d', floor({x} / 3600)::INT, floor({x} % 3600 / 60)::INT, floor({x} % 60)::INT, round_even(({x} % 1) * 1000, 0)::INT)"
_WHOLE = "printf('%02d:%02d:%02d,%03d', ({x} // 3600000)::INT, ({x} // 60000 % 60)::INT, ({x} // 1000 % 60)::INT, ({x} % 1000)::INT)"


def _whole_code(ms):
    part = lambda a, b: (F.floor(ms / a) % b).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 1000), part(60_000, 60), part(1000, 60), part(1, 1000))


def _subtitle_files(spark, sf_dir):
    """Sentences as subtitle files with a byte-order mark and CRLF: time lines and texts of six shapes, two of them not valid."""
    d = _sentence_table(spark, sf_dir).withColumn("v", (F.col("conv_id") + F.col("pos")) % 6)
    a, b = _whole_code(F.col("start")), _whole_code(F.col("end"))
    arrow = F.concat(a, F.lit(" --> "), b)
    line = (
        F.when(F.col("v") == 1, F.replace(arrow, F.lit(","), F.lit("."))).when(F.col("v") == 2, F.concat(F.left(a, F.lit(8)), F.lit(" --> "), F.left(b, F.lit(8))))
        .when(F.col("v") == 3, F.concat(a, F.lit("-->"), b)).when(F.col("v") == 4, F.concat(arrow, F.lit(" X1:10"))).when(F.col("v") == 5, F.concat(F.lit("  "), arrow, F.lit("  "))).otherwise(arrow)
    )
    body = F.when(F.col("v") == 1, F.concat("text", F.lit("\n \n again "))).when(F.col("v") == 5, F.lit("")).otherwise(F.col("text"))
    block = F.concat((F.col("pos") + 1).cast("string"), F.lit("\n"), line, F.lit("\n"), body)
    blocks = d.select("conv_id", "pos", block.alias("b")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("l"))
    whole = F.concat(F.lit("﻿"), F.array_join(F.transform("l", lambda x: x["b"]), "\n\n"), F.lit("\n"))
    return blocks.select(F.col("conv_id").cast("string").alias("transcript_id"), F.replace(whole, F.lit("\n"), F.lit("\r\n")).alias("value"))


_FILES = f"""{_SUMMARY_SENTENCES}, fi AS (SELECT conv_id, sentence_id, (conv_id + sentence_id) % 6 AS v, s, e, text, {_WHOLE.format(x="s")} AS a, {_WHOLE.format(x="e")} AS b FROM ss),
bl AS (SELECT *, CASE v WHEN 1 THEN replace(a || ' --> ' || b, ',', '.') WHEN 2 THEN a[1:8] || ' --> ' || b[1:8] WHEN 3 THEN a || '-->' || b WHEN 4 THEN a || ' --> ' || b || ' X1:10' ELSE a || ' --> ' || b END AS timecode,
  CASE WHEN v = 2 THEN (s // 1000)::DOUBLE WHEN v NOT IN (3, 4) THEN round(s / 1000.0::DOUBLE, 3) END AS start_s, CASE WHEN v = 2 THEN (e // 1000)::DOUBLE WHEN v NOT IN (3, 4) THEN round(e / 1000.0::DOUBLE, 3) END AS end_s,
  CASE v WHEN 1 THEN 3 WHEN 5 THEN 0 ELSE 1 END::INT AS n_lines FROM fi)"""


def _shown(blocks):
    return blocks.select("transcript_id", "pos", "index", "timecode", F.round("start", 3).alias("start_s"), F.round("end", 3).alias("end_s"), "text", "n_lines")


@query(f"""WITH {_FILES} SELECT conv_id::VARCHAR AS transcript_id, (row_number() OVER (PARTITION BY conv_id ORDER BY sentence_id) - 1)::INT AS pos, (sentence_id + 1)::VARCHAR AS "index", timecode, start_s, end_s,
  CASE v WHEN 1 THEN text || ' again' WHEN 5 THEN '' ELSE text END AS text, n_lines FROM bl WHERE v NOT IN (3, 4)""")
def srt_blocks_valid(spark, sf_dir):
    """Blocks of subtitle files, those without two readable times left out."""
    return _shown(files.parse_blocks(_subtitle_files(spark, sf_dir)))


@query(f"""WITH {_FILES} SELECT conv_id::VARCHAR AS transcript_id, sentence_id AS pos, (sentence_id + 1)::VARCHAR AS "index", timecode, start_s, end_s,
  CASE v WHEN 1 THEN text || chr(10) || ' ' || chr(10) || ' again' WHEN 5 THEN '' ELSE text END AS text, n_lines FROM bl""")
def srt_blocks_lenient(spark, sf_dir):
    """All blocks of subtitle files as written."""
    return _shown(files.parse_blocks(_subtitle_files(spark, sf_dir), validate=False))


def _cues(spark, sf_dir):
    """Groups of words as cues, in seconds, with a line for each speaker's run."""
    d = islands.speaker_runs(_groups(spark, sf_dir), ["conv_id", "group_id"], label="line_no").withColumnRenamed("group_id", "cue_id")
    return sinks.cue_lines(d.withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000), KEY)


_CUES = f"""{_GROUPS}, ln AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND speaker <> b THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, g ORDER BY pos) AS l FROM (SELECT *, lag(speaker) OVER (PARTITION BY conv_id, g ORDER BY pos) AS b FROM gr)),
lt AS (SELECT conv_id, g, l, string_agg(text, '' ORDER BY pos) AS text, arg_min(speaker, pos) AS sp, arg_min(s, pos) AS s, arg_max(e, pos) AS e FROM ln GROUP BY conv_id, g, l),
cu AS (SELECT conv_id, g, list(text ORDER BY l) AS lines, count(DISTINCT sp) AS n_sp, arg_min(sp, l) AS sp, arg_min(s, l) / 1000.0::DOUBLE AS s, arg_max(e, l) / 1000.0::DOUBLE AS e FROM lt GROUP BY conv_id, g)"""


@query(f"""WITH {_CUES}, x AS (SELECT *, row_number() OVER k AS n, least(e + 0.5::DOUBLE, lead(s) OVER k) AS shown FROM cu WINDOW k AS (PARTITION BY conv_id ORDER BY g))
SELECT conv_id, n::INT AS block, n || chr(10) || {_CODE.format(x="s")} || ' --> ' || {_CODE.format(x="shown")} || chr(10) ||
  CASE WHEN len(lines) > 1 AND n_sp > 1 THEN array_to_string(list_transform(lines, lambda t: '- ' || t), chr(10)) ELSE array_to_string(lines, chr(10)) END || chr(10) AS value FROM x""")
def srt_cues(spark, sf_dir):
    """Cues as a subtitle file's blocks."""
    return sinks.srt_text(_cues(spark, sf_dir), KEY)


@query(f"""WITH {_CUES}, r AS (SELECT conv_id, sp, (row_number() OVER (PARTITION BY conv_id ORDER BY min(g)) - 1) % 8 AS colour FROM cu GROUP BY conv_id, sp),
x AS (SELECT *, coalesce(lag(sp) OVER k = sp AND s - lag(e) OVER k >= 0.4::DOUBLE, false) AS pause FROM cu WINDOW k AS (PARTITION BY conv_id ORDER BY g))
SELECT conv_id, g AS block, CASE WHEN pause THEN '<li class="pause"></li>' || chr(10) ELSE '' END || '<li class="speaker' || colour || '"><time>' || printf('%d:%02d:%06.3f', floor(s / 3600)::INT, floor(s % 3600 / 60)::INT, s % 60) || '</time> ' ||
  array_to_string(list_transform(lines, lambda t: replace(replace(t, '&', '&amp;'), '<', '&lt;')), '<br>') || '</li>' AS value FROM x JOIN r USING (conv_id, sp)""")
def html_items(spark, sf_dir):
    """Cues as items of a page, in each speaker's colour."""
    return sinks.html_text(_cues(spark, sf_dir), KEY)


@query(f"""WITH {_CUES}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY g) AS n FROM cu)
SELECT conv_id, n::INT AS block, printf('Cue %4d  %8.2f-%8.2f  %5.1fs  %3dch  %dL  [%s]  %s', n::INT, s, e, e - s, list_sum(list_transform(lines, lambda t: length(t)))::INT, len(lines)::INT, sp, array_to_string(lines, ' / ')) AS value FROM x""")
def cue_listing(spark, sf_dir):
    """A line for each cue to look over."""
    return sinks.cue_listing(_cues(spark, sf_dir), KEY)


@query(f"""WITH {_TILES}, tc AS (SELECT *, {_ROUNDED.format(x="(s / 1000.0::DOUBLE)")} AS a, {_ROUNDED.format(x="(e / 1000.0::DOUBLE)")} AS b FROM ss)
SELECT conv_id, seq AS block, (seq + 1) || chr(10) || x.a || ' --> ' || y.b || chr(10) || 'part ' || seq || chr(10) AS value
FROM ti JOIN tc x USING (conv_id) JOIN tc y USING (conv_id) WHERE x.sentence_id = seq * 5 AND y.sentence_id = least((seq + 1) * 5, n) - 1""")
def summary_blocks(spark, sf_dir):
    """Summaries as a subtitle file's blocks, from their first sentence's start to their last one's end."""
    d = _sentence_table(spark, sf_dir)
    blocks = d.withColumn("timecode", F.concat(S.rounded_timecode(F.col("start") / 1000), F.lit(" --> "), S.rounded_timecode(F.col("end") / 1000)))
    topics = summaries.summary_loop(d, KEY).withColumn("summary", F.concat(F.lit("part "), F.col("seq").cast("string")))
    return sinks.summary_text(topics, blocks, KEY)


@query(f"""WITH {_BLOCKS}, x AS (SELECT *, (pos * 3)::VARCHAR || chr(10) || pos || ' --> ' || (pos + 1) || chr(10) AS head FROM bt)
SELECT doc_id, pos AS block, head || text || chr(10) AS value FROM x""")
def translated_blocks(spark, sf_dir):
    """Blocks under their index and time line as read."""
    b = _blocks(spark, sf_dir)
    n = lambda c: c.cast("string")
    return sinks.block_text(b.withColumn("index", n(F.col("pos") * 3)).withColumn("timecode", F.concat(n(F.col("pos")), F.lit(" --> "), n(F.col("pos") + 1))), ["doc_id"])


@query(f"""WITH {_BLOCKS},
b AS (SELECT k.doc_id, k.chunk_id, string_agg(c.text, chr(10) ORDER BY pos) AS t FROM ck k JOIN ch c ON c.doc_id = k.doc_id AND c.pos >= k.start_block - 5 AND c.pos < k.start_block GROUP BY 1, 2),
a AS (SELECT k.doc_id, k.chunk_id, string_agg(c.text, chr(10) ORDER BY pos) AS t FROM ck k JOIN ch c ON c.doc_id = k.doc_id AND c.pos >= k.end_block AND c.pos < k.end_block + 5 GROUP BY 1, 2),
o AS (SELECT doc_id, chunk_id, string_agg(replace(text, chr(10), ' '), chr(10) || '=====' || chr(10) ORDER BY pos) AS t FROM ch GROUP BY 1, 2)
SELECT doc_id, chunk_id, coalesce('[before]' || chr(10) || b.t || chr(10) || chr(10), '') || '[blocks]' || chr(10) || o.t || chr(10) || chr(10) || coalesce('[after]' || chr(10) || a.t || chr(10) || chr(10), '') AS value
FROM ck LEFT JOIN b USING (doc_id, chunk_id) LEFT JOIN a USING (doc_id, chunk_id) JOIN o USING (doc_id, chunk_id)""")
def chunk_inputs(spark, sf_dir):
    """Chunks as the texts that workers read."""
    d = chunking.chunks_with_context(_blocks(spark, sf_dir), ["doc_id"], size=7)
    return d.select("doc_id", "chunk_id", chunking.render_chunk(F.col("before"), F.col("core"), F.col("after")).alias("value"))


@query(f"WITH {_BLOCKS} SELECT doc_id, string_agg(CASE WHEN contains(text, chr(10)) THEN pos::VARCHAR END, ' ' ORDER BY pos) AS places FROM ch GROUP BY doc_id HAVING bool_or(contains(text, chr(10)))")
def two_line_blocks(spark, sf_dir):
    """Which blocks of each document had two lines or more."""
    d = sinks.two_line_blocks(_blocks(spark, sf_dir), ["doc_id"]).where("size(two_line_blocks) > 0")
    return d.select("doc_id", F.array_join(F.transform("two_line_blocks", lambda p: p.cast("string")), " ").alias("places"))


@query(f"""WITH {_BLOCKS} SELECT doc_id, coalesce(string_agg(CASE WHEN chunk_id = 1 THEN chunk_id::VARCHAR END, ' ' ORDER BY chunk_id), '') AS missing,
  coalesce(string_agg(CASE WHEN chunk_id <> 1 AND chunk_id % 3 = 2 THEN chunk_id::VARCHAR END, ' ' ORDER BY chunk_id), '') AS mismatched FROM ck GROUP BY doc_id""")
def failed_chunk_lists(spark, sf_dir):
    """Which chunks of each document didn't come back, and which came back with a wrong number of blocks."""
    chunks = chunking.chunks_with_context(_blocks(spark, sf_dir), ["doc_id"], size=7)
    d = chunking.failed_chunks(chunking.check_chunks(chunks, _returned(chunks), ["doc_id"]), ["doc_id"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return d.select("doc_id", text("missing"), text("mismatched"))


_CARDS = """ca AS (SELECT page_id, url, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages WHERE page_id % 3 <> 2 AND page_id % 4 <> 3),
pl AS (SELECT *, 'p' || page_id || '.mp3' AS audio, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id || '.jpg' ELSE '' END AS image FROM ca)"""


def _cards(spark, sf_dir):
    """Pages as cards: a third without a sound, a quarter of the sounds and half of the images not at hand."""
    p = table(spark, sf_dir, "pages")
    name = lambda end: F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(end))
    sound = F.when(F.col("page_id") % 3 != 2, F.concat(F.lit("a [sound:"), name(".mp3"), F.lit("] b]")))
    cards = p.select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), sound.alias("audioclip"), F.concat(F.lit("<img src='"), name(".jpg"), F.lit("'>")).alias("screenclip"), F.col("url").alias("text"), F.when(F.col("page_id") % 5 > 0, F.col("url")).alias("context"))
    media = p.where("page_id % 4 <> 3").select(name(".mp3").alias("file")).unionByName(p.where("page_id % 2 = 0").select(name(".jpg").alias("file")))
    return files.with_context(files.playable_cards(cards, media), "Show")


@query(f"""WITH {_CARDS} SELECT ('0x' || md5('deck')[1:8])::BIGINT AS deck_id, ('0x' || md5('deck_model')[1:8])::BIGINT AS model_id, '[sound:' || audio || ']' AS "Audio", CASE WHEN image <> '' THEN '<img src="' || image || '">' ELSE '' END AS "Image", url AS "Text",
  'Show | ' || CASE WHEN page_id % 5 > 0 THEN url ELSE '' END AS "Context" FROM pl""")
def card_notes(spark, sf_dir):
    """Notes of the cards whose sound is at hand."""
    return sinks.notes(_cards(spark, sf_dir), "deck")


@query(f"WITH {_CARDS} SELECT host, count(*) AS n_cards, sum(1 + (image <> '')::INT)::BIGINT AS n_media FROM pl GROUP BY host")
def card_counts(spark, sf_dir):
    """Cards of each host and the media that they show."""
    return sinks.card_counts(_cards(spark, sf_dir), ["host"])


@query(f"""WITH {TIMED}, i AS (
  SELECT conv_id, pos, 0 AS k, ' ' AS text, s, s AS e, 'spacing' AS type, speaker, 1 AS m FROM tv WHERE pos % 5 = 0
  UNION ALL SELECT conv_id, pos, 1, CASE WHEN pos % 5 = 2 THEN ' ' ELSE text END, s, e, CASE pos % 5 WHEN 2 THEN 'spacing' WHEN 3 THEN 'audio_event' ELSE 'word' END, speaker, m FROM tv)
SELECT conv_id::VARCHAR AS transcript_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos, k) - 1)::INT AS pos, text, round_even(s / 1000.0::DOUBLE, 3) AS "start", round_even(e / 1000.0::DOUBLE, 3) AS "end", type, 'speaker_' || CASE WHEN pos % 5 = 4 THEN '0' ELSE speaker END AS speaker, round_even(ln(1.0::DOUBLE / m), 4) AS logprob FROM i""")
def provider_words(spark, sf_dir):
    """A provider's tokens as canonical words: leading blanks, blanks alone, sounds, a missing speaker."""
    kind = F.col("pos") % 5
    text = F.when(kind == 0, F.concat(F.lit(" "), "text")).when(kind == 2, F.lit(" ")).otherwise(F.col("text"))
    token = F.struct("pos", text.alias("text"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), F.when(kind != 4, F.col("speaker")).alias("speaker"), (1 / F.col("morph_count")).alias("confidence"), (kind == 3).alias("is_audio_event"))
    docs = timed_words(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    made = docs.select(F.col("conv_id").cast("string").alias("transcript_id"), F.lit(None).cast("string").alias("text"), "tokens")
    return files.explode_words(files.normalise_provider(made))


_POS1 = ["名詞", "助詞", "接頭辞", "助動詞", "補助記号", "動詞"]


@query(f"""WITH {TIMED}, mo AS (SELECT conv_id, pos, {_POS1}[length(text) % 6 + 1] AS pos1, CASE WHEN length(text) % 6 = 1 THEN CASE WHEN pos % 2 = 0 THEN 'て' ELSE 'を' END ELSE text END AS surface FROM tv),
b AS (SELECT *, lag(pos1) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM mo),
p AS (SELECT *, sum(CASE WHEN before IS NULL THEN 0 WHEN pos1 = '接頭辞' OR (pos1 IN ('名詞', '動詞') AND before <> '接頭辞') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos)::INT AS phrase_id FROM b),
c AS (SELECT *, pos1 = '助動詞' OR (pos1 = '助詞' AND surface = 'て') AS closes FROM p),
g AS (SELECT conv_id, phrase_id, list(struct_pack(pos1 := pos1, closes := closes) ORDER BY pos) AS m, string_agg(surface, '' ORDER BY pos) AS text FROM c GROUP BY conv_id, phrase_id)
SELECT conv_id, phrase_id, text, m[-1].closes OR (m[-1].pos1 = '補助記号' AND len(m) > 1 AND m[-2].closes) AS ends_clause FROM g""")
def phrase_units(spark, sf_dir):
    """Phrases of words that stand as morphemes of six kinds, and which of them end a clause."""
    kind = F.length("text") % 6
    surface = F.when(kind == 1, F.when(F.col("pos") % 2 == 0, "て").otherwise("を")).otherwise(F.col("text"))
    m = timed_words(spark, sf_dir).select("conv_id", "pos", F.element_at(F.lit(_POS1), kind + 1).alias("pos1"), surface.alias("surface"))
    d = islands.phrases(m, KEY).groupBy("conv_id", "phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "surface", "pos1"))).alias("m"))
    return d.select("conv_id", "phrase_id", F.array_join(F.transform("m", lambda x: x["surface"]), "").alias("text"), islands.ends_clause(F.col("m"), ["て", "ば"]).alias("ends_clause"))


_GOOD = '[{"start": 6, "end": 9, "summary": "b"}, {"start": 1, "end": 4, "summary": "a"}]'
#: An answer, and why it can't be accepted.
_ANSWERS = [
    (_GOOD, None), (f"```json\n{_GOOD}\n```", None), (f" ```\n{_GOOD}", None), ('{"start": 1, "end": 2, "summary": "a"}', "not an array of objects"), ("[]", "not an array of objects"), ("[1, 2", "not an array of objects"), ("", "not an array of objects"),
    ('[{"start": 1, "summary": "a"}]', "missing key"), ('[{"start": 1, "end": "5", "summary": "a"}]', "not whole numbers"), ('[{"start": 1.5, "end": 5, "summary": "a"}]', "not whole numbers"), ('[{"start": 5, "end": 4, "summary": "a"}]', "reversed"),
    ('[{"start": 1, "end": 4, "summary": "  "}]', "blank"), ('[{"start": 2, "end": 4, "summary": "a"}]', "first is not 1"), ('[{"start": 1, "end": 4, "summary": "a"}, {"start": 4, "end": 6, "summary": "b"}]', "overlap"), ('[{"start": 1, "end": 400, "summary": "a"}]', "outside"),
]
_REASONS = ", ".join("NULL" if r is None else f"'{r}'" for _, r in _ANSWERS)


@query(f"""WITH a AS (SELECT doc_id, [{_REASONS}][doc_id % {len(_ANSWERS)} + 1] AS problem, 20 + doc_id % 5 AS n FROM documents)
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN '1-5 a, 6-' || n || ' b' END AS ranges FROM a""")
def parsed_answers(spark, sf_dir):
    """Answers of a summariser, good and bad ones in turn, checked and repaired."""
    raw = F.element_at(F.lit([a for a, _ in _ANSWERS]), (F.col("doc_id") % len(_ANSWERS) + 1).cast("int"))
    ranges, problem = summaries.parse_answer(raw, (20 + F.col("doc_id") % 5).cast("int"))
    shown = F.array_join(F.transform(ranges, lambda r: F.format_string("%d-%d %s", r["start"], r["end"], r["summary"])), ", ")
    return table(spark, sf_dir, "documents").select("doc_id", problem.alias("problem"), shown.alias("ranges"))


@query(f"""WITH {_SUMMARY_SENTENCES}, n AS (SELECT conv_id, count(*) * 60 AS n FROM ss GROUP BY conv_id), w AS (SELECT *, greatest(1, ceil(n / 25.0))::INT AS windows FROM n)
SELECT conv_id, windows, CASE WHEN windows > 40 THEN 'about ' || windows || ' windows; split the text' END AS warning FROM w""")
def window_plans(spark, sf_dir):
    """How many windows texts of sixty times these sentences take, and a warning where there are many."""
    n = _sentence_table(spark, sf_dir).groupBy("conv_id").agg((F.count(F.lit(1)) * 60).alias("n"))
    windows, warning = summaries.window_plan(F.col("n"))
    return n.select("conv_id", windows.alias("windows"), warning.alias("warning"))


@query(f"""WITH {_SUMMARY_SENTENCES}, w AS (SELECT conv_id, string_agg((sentence_id + 1) || '. ' || text, chr(10) ORDER BY sentence_id) AS t FROM ss WHERE sentence_id < 40 GROUP BY conv_id)
SELECT conv_id, '[premise]' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'about things' ELSE '(none)' END || chr(10) || '[before]' || chr(10) || CASE WHEN conv_id % 3 = 0 THEN '(first window)' ELSE '- (sentences 1-5) one' || chr(10) || '- (sentences 6-9) two' END || chr(10) || '[sentences]' || chr(10) || t AS brief FROM w""")
def window_briefs(spark, sf_dir):
    """What a summariser is given for each conversation's first window."""
    d = _sentence_table(spark, sf_dir).where("pos < 40").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("t"))
    done = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("summary")) for a, b, c in ((1, 5, "one"), (6, 9, "two"))])
    recent = F.when(F.col("conv_id") % 3 == 0, F.slice(done, 1, 0)).otherwise(done)
    return d.select("conv_id", summaries.brief(F.when(F.col("conv_id") % 2 == 0, "about things"), recent, F.col("t")).alias("brief"))


@query(f"""WITH {_TILES}, x AS (SELECT *, max(seq) OVER (PARTITION BY conv_id) AS final FROM ti)
SELECT conv_id, seq, seq * 5 + 1 + 100 AS "start", least((seq + 1) * 5, n) + 100 AS "end" FROM x WHERE seq > final - 3""")
def recent_ranges(spark, sf_dir):
    """The last three ranges of each conversation, moved on by a hundred sentences."""
    done = summaries.recent(summaries.summary_loop(_sentence_table(spark, sf_dir), KEY), KEY)
    return summaries.remap(done, F.lit(100)).select("conv_id", "seq", "start", "end")


@query(f"""WITH {TIMED}, t AS (SELECT conv_id, pos, speaker, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS text, s / 1000.0::DOUBLE AS s, e / 1000.0::DOUBLE AS e FROM tv WHERE pos % 10 <> 9),
b AS (SELECT *, lag(speaker) OVER k AS ps, s - lag(e) OVER k AS gap, right(lag(text) OVER k, 1) AS pc FROM t WINDOW k AS (PARTITION BY conv_id ORDER BY pos)),
f AS (SELECT *, sum(CASE WHEN ps IS NOT NULL AND (speaker <> ps OR gap >= 1 OR pc IN ('!', '?')) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS id FROM b),
g AS (SELECT conv_id, id, trim(string_agg(text, '' ORDER BY pos)) AS text, arg_min(s, pos) AS s, arg_max(e, pos) AS e FROM f GROUP BY conv_id, id)
SELECT conv_id::VARCHAR AS transcript_id, (row_number() OVER (PARTITION BY conv_id ORDER BY id) - 1)::INT AS pos, {_ROUNDED.format(x="s")} || ' --> ' || {_ROUNDED.format(x="e")} AS timecode, s AS "start", e AS "end", text FROM g WHERE text <> ''""")
def transcript_sentences(spark, sf_dir):
    """Sentences of transcripts, every fourth turn of blanks alone, every tenth word of another kind."""
    text = F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text"))
    kind = F.when(F.col("pos") % 10 == 9, "audio_event").otherwise("word")
    w = timed_words(spark, sf_dir).select(F.col("conv_id").cast("string").alias("transcript_id"), "pos", text.alias("text"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), kind.alias("type"), "speaker")
    return files.sentences(w)


@query(f"WITH {_SUMMARY_SENTENCES} SELECT conv_id, sentence_id, text FROM ss ORDER BY conv_id, sentence_id LIMIT 100")
def first_sentences(spark, sf_dir):
    return _sentence_table(spark, sf_dir).select("conv_id", F.col("pos").alias("sentence_id"), "text").orderBy("conv_id", "sentence_id").limit(100)


_STEMS = "CASE page_id % 4 WHEN 0 THEN 'Ep ' || page_id || '.JA' WHEN 1 THEN 'plain' || page_id WHEN 2 THEN 'raw.' || page_id || '.act' ELSE 'x.pt-br' END"


@query(f"""WITH p AS (SELECT page_id, '/in.put/' || page_id || '/' AS dir, {_STEMS} AS stem, CASE WHEN page_id % 3 = 0 THEN '.srt' ELSE '.json' END AS ending FROM pages),
q AS (SELECT *, dir || stem || ending AS path, CASE page_id % 4 WHEN 0 THEN 'Ep ' || page_id WHEN 3 THEN 'x' ELSE stem END AS bare FROM p)
SELECT page_id, regexp_replace(lower(bare), '[^a-z0-9]', '_', 'g') || '-' || sha1(path)[1:8] AS work, dir || bare || '.summary.en.srt' AS output, dir || stem || '.summary.en.srt' AS other FROM q""")
def summary_names(spark, sf_dir):
    """Names of the work folder and of both outputs for files of several namings."""
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    stem = F.when(kind == 0, F.concat(F.lit("Ep "), n, F.lit(".JA"))).when(kind == 1, F.concat(F.lit("plain"), n)).when(kind == 2, F.concat(F.lit("raw."), n, F.lit(".act"))).otherwise("x.pt-br")
    path = F.concat(F.lit("/in.put/"), n, F.lit("/"), stem, F.when(F.col("page_id") % 3 == 0, ".srt").otherwise(".json"))
    work, output, other = S.work_names(path)
    return table(spark, sf_dir, "pages").select("page_id", work.alias("work"), output.alias("output"), other.alias("other"))


@query(r"""WITH p AS (SELECT page_id, lpad((page_id % 100)::VARCHAR, 2, '0') AS n, url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 4 THEN '' ELSE n END AS episode, 'はい。か' AS bare, 'p' || n || '.mp3' AS sound, '[' || n || ']' AS answer, n || '|b' AS blocks,
  printf('%d:%02d:%06.3f', floor(page_id * 61.25 / 3600)::INT, floor(page_id * 61.25 % 3600 / 60)::INT, (page_id * 61.25)::DOUBLE % 60) AS clock, replace(replace(url || '?a<b&c', '&', '&amp;'), '<', '&lt;') AS escaped FROM p""")
def name_and_text_scalars(spark, sf_dir):
    """Episode numbers, final stops, sound tags, code fences, marked blocks, clock times and markup of made-up values."""
    n = F.lpad((F.col("page_id") % 100).cast("string"), 2, "0")
    kind = F.col("page_id") % 5
    name = F.when(kind == 0, F.concat(F.lit("Show - 01 - "), n, F.lit(".mp4"))).when(kind == 1, F.concat(F.lit("S02E"), n, F.lit("-x.mkv"))).when(kind == 2, F.concat(F.lit("E05.a "), n, F.lit(".srt"))).when(kind == 3, F.concat(F.lit("a-"), n, F.lit("-b"))).otherwise(F.concat(F.lit("Show E"), n))
    blocks = S.split_blocks(F.concat(F.lit(" "), n, F.lit("\n=|=\n b ")), "=|=")
    x = F.col("page_id") * F.lit(61.25)
    return table(spark, sf_dir, "pages").select(
        "page_id", S.episode(name).alias("episode"), S.without_stops(F.lit("はい。か。。")).alias("bare"), S.sound_file(F.concat(F.lit("x [sound:p"), n, F.lit(".mp3] [sound:z]"))).alias("sound"),
        S.without_fence(F.concat(F.lit("```json\n["), n, F.lit("]\n```"))).alias("answer"), F.array_join(blocks, "|").alias("blocks"), S.clock(x).alias("clock"), S.escape(F.concat("url", F.lit("?a<b&c"))).alias("escaped"),
    )


@query("SELECT regexp_extract(url, '//([^/]+)', 1) AS path, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def repeated_inputs(spark, sf_dir):
    """Hosts that are named more than once."""
    d = files.repeated_inputs(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("path")))
    return d.select("path", F.col("count").alias("n"))
