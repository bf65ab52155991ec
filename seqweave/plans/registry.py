"""Queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import chunking, folds, islands, pairing, summaries
from ..sources import files
from .views import COMMA, ENDERS, TIMED, table, timed_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["conv_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER k IS NULL OR lag(event_type) OVER k = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS run_id FROM f)
SELECT user_id, run_id, min(event_type) AS event_type, count(*) AS n, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event FROM r GROUP BY user_id, run_id
""")
def speaker_runs(spark, sf_dir):
    """Runs of one event type a user."""
    runs = islands.speaker_runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "event_type", ("ts", "event_id"))
    return runs.groupBy("user_id", "run_id").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"))


@query("""
WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER k >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS session_id FROM f)
SELECT user_id, session_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, session_id
""")
def gap_sessions(spark, sf_dir):
    """Sessions that end with a pause of twelve hours or more."""
    d = islands.gap_sessions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", F.expr("INTERVAL '12' HOUR"), ("ts", "event_id"))
    return d.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {TIMED}
SELECT conv_id, pos, round_even(s / 1000.0::DOUBLE, 3) AS start_s, round_even(e / 1000.0::DOUBLE, 3) AS end_s, round_even(ln(1.0::DOUBLE / m), 4) AS logprob FROM tv WHERE turn % 3 <> 2""")
def word_filter_project(spark, sf_dir):
    """Words of the kept kind with rounded times and log-probabilities."""
    kind = F.when(F.col("turn") % 3 == 2, "audio_event").otherwise("word")
    w = timed_words(spark, sf_dir).withColumn("type", kind).where("type = 'word'")
    return w.select("conv_id", "pos", F.bround(F.col("start") / 1000, 3).alias("start_s"), F.bround(F.col("end") / 1000, 3).alias("end_s"), F.bround(S.log_confidence(1 / F.col("morph_count")), 4).alias("logprob"))


@query(f"""WITH {TIMED}, t AS (SELECT conv_id, pos, CASE WHEN pos % 7 = 0 THEN right(text, 1) ELSE text END AS text, s / 1000.0::DOUBLE AS s, e / 1000.0::DOUBLE AS e FROM tv),
c AS (SELECT *, length(text) AS n, unnest(range(0, length(text))) AS i FROM t)
SELECT conv_id::VARCHAR AS transcript_id, pos, i::INT AS sub, text[i + 1:i + 1] AS ch, round(s + (e - s) * i / n, 6) AS start_s,
  CASE WHEN n = 1 THEN CASE WHEN text IN ('!', '?') AND e - s > 0.2 THEN round(s + 0.1, 6) ELSE round(e, 6) END ELSE round(s + (e - s) * (i + 1) / n, 6) END AS end_s FROM c""")
def char_interpolation(spark, sf_dir):
    """Characters of words with their share of the time; a long single mark, as every seventh word is made here, is cut short."""
    text = F.when(F.col("pos") % 7 == 0, F.right("text", F.lit(1))).otherwise(F.col("text"))
    w = timed_words(spark, sf_dir).select(F.col("conv_id").cast("string").alias("transcript_id"), "pos", text.alias("text"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), F.lit("word").alias("type"), "speaker")
    return files.characters(w).select("transcript_id", "pos", "sub", F.col("text").alias("ch"), F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


@query(f"""WITH {TIMED}, f AS (SELECT *, sum((pc IN ('.', '!', '?'))::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS id FROM tv)
SELECT conv_id, coalesce(id, 0)::INT AS sentence_id, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS units FROM f GROUP BY ALL""")
def sentence_split(spark, sf_dir):
    d = islands.sentences(timed_words(spark, sf_dir), KEY, ENDERS)
    return d.groupBy("conv_id", "sentence_id").agg(islands.spaced_text_of().alias("text"), F.count(F.lit(1)).alias("units"))


_SUMMARY_SENTENCES = f"""{TIMED}, f AS (SELECT *, sum(CASE WHEN pos > 0 AND (speaker <> ps OR gap >= 1000 OR pc IN ('.', '!', '?')) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos)::INT AS sentence_id FROM tv),
ss AS (SELECT conv_id, sentence_id, arg_min(speaker, pos) AS speaker, min(s) AS s, max(e) AS e, string_agg(text, ' ' ORDER BY pos) AS text FROM f GROUP BY conv_id, sentence_id)"""


@query(f"WITH {_SUMMARY_SENTENCES} SELECT conv_id, sentence_id, speaker, s AS start_ms, e AS end_ms, text FROM ss")
def summary_sentences(spark, sf_dir):
    d = islands.summary_sentences(timed_words(spark, sf_dir), KEY, 1000, ENDERS)
    d = islands.summarise(d, ["conv_id", "sentence_id"], islands.spaced_text_of())
    return d.select("conv_id", "sentence_id", "speaker", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


_SEGMENTS = f"""{TIMED}, f AS (SELECT *, sum(CASE WHEN pos > 0 AND (speaker <> ps OR gap >= 100 OR pc IN ('.', '!', '?', ',')) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos)::INT AS segment_id FROM tv),
sg AS MATERIALIZED (SELECT conv_id, segment_id, arg_min(speaker, pos) AS speaker, arg_min(s, pos) AS s, arg_max(e, pos) AS e, string_agg(text, '' ORDER BY pos) AS text, sum(length(text))::BIGINT AS chars, sum(m)::BIGINT AS tokens, count(*) AS units FROM f GROUP BY conv_id, segment_id)"""


def _segments(spark, sf_dir):
    return islands.segments(timed_words(spark, sf_dir), KEY, 100, ENDERS, COMMA)


@query(f"WITH {_SEGMENTS} SELECT conv_id, segment_id, speaker, s AS start_ms, e AS end_ms, text, chars, tokens, units FROM sg")
def maximal_segments(spark, sf_dir):
    d = islands.summarise(_segments(spark, sf_dir), ["conv_id", "segment_id"])
    return d.select("conv_id", "segment_id", "speaker", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text", "chars", "tokens", "units")


#: Segments one after the other: ``held`` may still change, ``gone`` is what the step put out, as segment num - 1.
_MERGED = f"""{_SEGMENTS}, us AS MATERIALIZED (SELECT conv_id, segment_id, list(struct_pack(pos := pos, text := text, s := s, e := e, speaker := speaker) ORDER BY pos) AS u FROM f GROUP BY conv_id, segment_id),
mb AS (
  SELECT conv_id, segment_id, 0 AS num, u AS held, u[1:0] AS gone FROM us WHERE segment_id = 0
  UNION ALL
  SELECT conv_id, segment_id, num + (cut > 0)::INT, CASE WHEN cut = 0 THEN units ELSE units[cut + 1:] END, CASE WHEN cut = 0 THEN units[1:0] ELSE units[1:cut] END FROM (
    SELECT *, CASE WHEN NOT joins THEN n_held WHEN total <= 18 THEN 0 ELSE coalesce(
        list_min(list_filter(range(1, len(units)), lambda i: suffix(units[i].text, '.'))),
        list_min(list_transform(range(1, len(units)), lambda i: struct_pack(d := abs(2 * list_sum(list_transform(units[1:i], lambda x: length(x.text))) - total), i := i))).i) END AS cut FROM (
      SELECT n.conv_id, n.segment_id, p.num, p.held || n.u AS units, len(p.held) AS n_held, list_sum(list_transform(p.held || n.u, lambda x: length(x.text))) AS total,
        list_sum(list_transform(n.u, lambda x: length(x.text))) < 8 AND n.u[1].speaker = p.held[-1].speaker AND len(list_filter(p.held, lambda x: contains(x.text, '.'))) = 0 AND n.u[1].s - p.held[-1].e < 400 AS joins
      FROM mb p JOIN us n ON n.conv_id = p.conv_id AND n.segment_id = p.segment_id + 1)))"""


@query(f"""WITH {_MERGED}, o AS (SELECT conv_id, num - 1 AS segment_id, unnest(gone) AS x FROM mb
  UNION ALL SELECT conv_id, num, unnest(held) FROM mb QUALIFY segment_id = max(segment_id) OVER (PARTITION BY conv_id))
SELECT conv_id, x.pos AS pos, segment_id FROM o""")
def segment_mergeback(spark, sf_dir):
    """Tiny segments joined to the one before; a step may rewrite what was put out last."""
    d = folds.merge_tiny_segments(_segments(spark, sf_dir), KEY, least_gap=400, stop=".")
    return d.select("conv_id", "pos", "segment_id")


_PACKED = f"""{_SEGMENTS}, pk AS (
  SELECT conv_id, segment_id, speaker, e, chars AS c, contains(text, '.') AS stop, right(text, 1) IN ('.', '!', '?') AS ended, 0 AS line_id FROM sg WHERE segment_id = 0
  UNION ALL
  SELECT n.conv_id, n.segment_id, n.speaker, n.e, CASE WHEN j THEN c + n.chars ELSE n.chars END, CASE WHEN j THEN stop OR contains(n.text, '.') ELSE contains(n.text, '.') END, right(n.text, 1) IN ('.', '!', '?'), line_id + (NOT j)::INT
  FROM (SELECT n.*, p.c, p.stop, p.line_id, (n.speaker = p.speaker AND p.c + n.chars <= 18 AND NOT p.ended AND n.s - p.e < 400 AND NOT p.stop) AS j FROM pk p JOIN sg n ON n.conv_id = p.conv_id AND n.segment_id = p.segment_id + 1) n)"""


def _packed(spark, sf_dir):
    segs = islands.summarise(_segments(spark, sf_dir), ["conv_id", "segment_id"])
    return folds.line_packing(segs, KEY, least_gap=400, enders=ENDERS, stop=".")


@query(f"WITH {_PACKED} SELECT conv_id, segment_id, line_id FROM pk")
def line_packing(spark, sf_dir):
    return _packed(spark, sf_dir).select("conv_id", "segment_id", "line_id")


_CUES = f"""{TIMED}, q AS (SELECT *, sum(CASE WHEN pos > 0 AND (speaker <> ps OR pc IN ('.', '!', '?', ',')) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS sec FROM tv),
st AS (SELECT conv_id, sec, sum(m) AS t, arg_min(speaker, pos) AS sp FROM q GROUP BY conv_id, sec),
nx AS MATERIALIZED (SELECT q.*, CASE WHEN st.sp = q.speaker THEN st.t ELSE 0 END AS nt FROM q LEFT JOIN st ON st.conv_id = q.conv_id AND st.sec = q.sec + 1),
cu AS (
  SELECT conv_id, pos, speaker, e, 0 AS id, CASE WHEN fl THEN 0 ELSE m END AS t, CASE WHEN fl THEN 1 ELSE 0 END AS nid, NOT fl AS op
  FROM (SELECT *, (right(text, 1) IN ('.', '!', '?') OR (right(text, 1) = ',' AND m >= 5 AND NOT (nt <= 2 AND m <= 7))) AS fl FROM nx WHERE pos = 0)
  UNION ALL
  SELECT conv_id, pos, speaker, e, here, CASE WHEN fl THEN 0 ELSE tt END, CASE WHEN fl THEN here + 1 ELSE here END, NOT fl
  FROM (SELECT *, (right(text, 1) IN ('.', '!', '?') OR (right(text, 1) = ',' AND tt >= 5 AND NOT (nt <= 2 AND tt <= 7))) AS fl
    FROM (SELECT n.*, CASE WHEN p.op AND (n.speaker <> p.speaker OR n.s - p.e >= 400) THEN p.nid + 1 ELSE p.nid END AS here, CASE WHEN p.op AND (n.speaker <> p.speaker OR n.s - p.e >= 400) THEN n.m ELSE p.t + n.m END AS tt
      FROM cu p JOIN nx n ON n.conv_id = p.conv_id AND n.pos = p.pos + 1)))"""


def _cues(spark, sf_dir):
    return folds.sentence_cues(timed_words(spark, sf_dir), KEY, ENDERS, COMMA, 400)


@query(f"WITH {_CUES} SELECT conv_id, pos, id AS cue_id FROM cu")
def sentence_cues(spark, sf_dir):
    return _cues(spark, sf_dir).select("conv_id", "pos", "cue_id")


_GROUPS = f"""{TIMED}, fo AS (SELECT conv_id, pos, e, 0 AS g, m AS t FROM tv WHERE pos = 0
  UNION ALL SELECT n.conv_id, n.pos, n.e, CASE WHEN n.s - p.e < 400 AND p.t + n.m <= 20 THEN p.g ELSE p.g + 1 END, CASE WHEN n.s - p.e < 400 AND p.t + n.m <= 20 THEN p.t + n.m ELSE n.m END
  FROM fo p JOIN tv n ON n.conv_id = p.conv_id AND n.pos = p.pos + 1),
gr AS (SELECT tv.*, fo.g FROM tv JOIN fo USING (conv_id, pos))"""


def _groups(spark, sf_dir):
    d = timed_words(spark, sf_dir).withColumn("tokens", F.col("morph_count"))
    return folds.token_capped_merge(d, KEY, least_gap=400).drop("tokens")


@query(f"""WITH {_GROUPS}, ln AS (SELECT *, sum(CASE WHEN lag_sp IS NOT NULL AND speaker <> lag_sp THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, g ORDER BY pos) AS l FROM (SELECT *, lag(speaker) OVER (PARTITION BY conv_id, g ORDER BY pos) AS lag_sp FROM gr)),
lt AS (SELECT conv_id, g, l, string_agg(text, ' ' ORDER BY pos) AS text, min(speaker) AS sp, min(s) AS s, max(e) AS e, sum(m) AS t FROM ln GROUP BY conv_id, g, l)
SELECT conv_id, g AS group_id, CASE WHEN count(*) > 1 AND count(DISTINCT sp) > 1 THEN string_agg('- ' || text, chr(10) ORDER BY l) ELSE string_agg(text, chr(10) ORDER BY l) END AS text, min(s) AS start_ms, max(e) AS end_ms, sum(t)::BIGINT AS tokens FROM lt GROUP BY conv_id, g""")
def token_capped_merge(spark, sf_dir):
    """Groups of at most 20 tokens, their speakers' lines with dashes."""
    lines = islands.speaker_runs(_groups(spark, sf_dir), ["conv_id", "group_id"], label="line_no")
    lines = islands.summarise(lines, ["conv_id", "group_id", "line_no"], islands.spaced_text_of())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    out = lines.groupBy("conv_id", "group_id").agg(ordered.alias("lines"), F.countDistinct("speaker").alias("n"), F.min("start").alias("start_ms"), F.max("end").alias("end_ms"), F.sum("tokens").alias("tokens"))
    return out.select("conv_id", "group_id", S.speaker_lines(F.col("lines"), F.col("n")).alias("text"), "start_ms", "end_ms", "tokens")


_LINES = f"""{_PACKED}, li AS MATERIALIZED (SELECT conv_id, line_id, sum(sg.chars)::BIGINT AS chars, arg_min(sg.s, segment_id) AS s, arg_max(sg.e, segment_id) AS e, arg_min(sg.speaker, segment_id) AS speaker FROM sg JOIN pk USING (conv_id, segment_id) GROUP BY conv_id, line_id)"""


@query(f"""WITH {_LINES}, nd AS (SELECT *, (e - s < 600 OR chars * 1000 > 8 * (e - s)) AS needs, row_number() OVER (PARTITION BY conv_id ORDER BY line_id) AS n FROM li),
cp AS (SELECT *, coalesce(chars <= 18 AND lead(chars) OVER k <= 18 AND (needs OR lead(needs) OVER k) AND lead(s) OVER k - e < 400, false) AS can FROM nd WINDOW k AS (PARTITION BY conv_id ORDER BY line_id)),
hd AS (SELECT *, can AND (n - coalesce(max(CASE WHEN NOT can THEN n END) OVER (PARTITION BY conv_id ORDER BY line_id), 0) - 1) % 2 = 0 AS head FROM cp),
sc AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY conv_id ORDER BY line_id), false)::INT AS nth FROM hd)
SELECT conv_id, line_id, nth, (sum(1 - nth) OVER (PARTITION BY conv_id ORDER BY line_id) - 1)::INT AS cue_id FROM sc""")
def cue_pairing(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    lines = packed.groupBy("conv_id", "line_id").agg(F.sum("chars").alias("chars"), F.min_by("start", "segment_id").alias("start"), F.max_by("end", "segment_id").alias("end"), F.min_by("speaker", "segment_id").alias("speaker"))
    return pairing.pair_lines(lines, KEY, least_gap=400, short=600, rate=0.008).select("conv_id", "line_id", "nth", "cue_id")


@query(f"""WITH {_SUMMARY_SENTENCES}, cm AS (SELECT conv_id, sentence_id, pos, text, NOT suffix(text, ',') AS plain, sum(length(text)) OVER k AS cum, sum(length(text)) OVER (PARTITION BY conv_id, sentence_id) AS tot, lead(pos) OVER k AS nxt FROM f WINDOW k AS (PARTITION BY conv_id, sentence_id ORDER BY pos)),
bs AS (SELECT conv_id, sentence_id, arg_min(pos, struct_pack(a := plain, d := abs(2 * cum - tot), p := pos)) AS b FROM cm WHERE nxt IS NOT NULL GROUP BY 1, 2)
SELECT conv_id, pos, CASE WHEN b IS NULL OR pos <= b THEN 0 ELSE 1 END AS line_no FROM cm LEFT JOIN bs USING (conv_id, sentence_id)""")
def balanced_split(spark, sf_dir):
    d = islands.summary_sentences(timed_words(spark, sf_dir), KEY, 1000, ENDERS)
    return pairing.balanced_split(d, ["conv_id", "sentence_id"], stop=",").select("conv_id", "pos", "line_no")


@query(f"""WITH {_SUMMARY_SENTENCES}, cm AS (SELECT conv_id, sentence_id, pos, text, instr(text, ',') AS off, sum(length(text)) OVER k AS cum, sum(length(text)) OVER w AS tot, max(pos) OVER w AS final
  FROM f WINDOW k AS (PARTITION BY conv_id, sentence_id ORDER BY pos), w AS (PARTITION BY conv_id, sentence_id)),
st AS (SELECT conv_id, sentence_id, min(pos) AS b, arg_min(cum - length(text) + off, pos) AS place, any_value(tot) AS tot, any_value(final) AS final FROM cm WHERE off > 0 GROUP BY 1, 2)
SELECT conv_id, cm.pos, CASE WHEN b IS NOT NULL AND place < st.tot AND b < st.final AND cm.pos > b THEN 1 ELSE 0 END AS line_no FROM cm LEFT JOIN st USING (conv_id, sentence_id)""")
def midtext_stop_split(spark, sf_dir):
    """Sentences cut behind the unit with their first comma."""
    d = islands.summary_sentences(timed_words(spark, sf_dir), KEY, 1000, ENDERS)
    return pairing.split_at_stop(d, ["conv_id", "sentence_id"], stop=",").select("conv_id", "pos", "line_no")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10)))))::INT AS i FROM documents),
w AS (SELECT doc_id, i, length(t) AS n, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS k FROM l),
c AS (SELECT doc_id, i, n, k, sum(length(word) + 1) OVER (PARTITION BY doc_id, i ORDER BY k) - 1 AS upper, count(*) OVER (PARTITION BY doc_id, i) AS words FROM w),
b AS (SELECT doc_id, i, arg_min(upper, struct_pack(d := abs(upper - (n - upper - 1)), k := k)) AS upper FROM c WHERE k < words GROUP BY doc_id, i)
SELECT doc_id, i, CASE WHEN upper IS NULL THEN t ELSE substring(t, 1, upper::BIGINT) || chr(10) || substring(t, upper::BIGINT + 2) END AS balanced FROM l LEFT JOIN b USING (doc_id, i)""")
def word_balance(spark, sf_dir):
    """All lines of documents as two lines of nearly equal length."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.select("doc_id", "i", S.balance_words(F.col("t")).alias("balanced"))


@query(f"WITH {_SUMMARY_SENTENCES} SELECT conv_id, sentence_id, least(e + 500, lead(s) OVER (PARTITION BY conv_id ORDER BY sentence_id)) AS shown_until FROM ss")
def cue_linger(spark, sf_dir):
    d = islands.summarise(islands.summary_sentences(timed_words(spark, sf_dir), KEY, 1000, ENDERS), ["conv_id", "sentence_id"])
    return d.select("conv_id", "sentence_id", islands.linger(KEY, 500, ("sentence_id",)).alias("shown_until"))


@query(f"""WITH {TIMED}, t AS (SELECT conv_id, pos, e / 1000.0::DOUBLE AS x FROM tv),
c AS (SELECT *, printf('%02d:%02d:%02d,%03d', floor(x / 3600)::INT, floor(floor(x) % 3600 / 60)::INT, floor(x)::INT % 60, floor((x % 1) * 1000)::INT) AS code, printf('%02d:%02d:%02d,%03d', floor(x / 3600)::INT, floor(x % 3600 / 60)::INT, floor(x % 60)::INT, round_even((x % 1) * 1000, 0)::INT) AS rounded FROM t)
SELECT conv_id, pos, code, rounded, code[1:2]::DOUBLE * 3600 + code[4:5]::DOUBLE * 60 + replace(code[7:], ',', '.')::DOUBLE AS parsed FROM c""")
def srt_timecodes(spark, sf_dir):
    x = F.col("end") / 1000
    d = timed_words(spark, sf_dir).select("conv_id", "pos", S.timecode(x).alias("code"), S.rounded_timecode(x).alias("rounded"))
    return d.withColumn("parsed", S.parse_timecode(F.col("code")))


_BLOCKS = """bl AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
bt AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN replace(line, ', ', ',' || chr(10)) ELSE line END AS text, count(*) OVER (PARTITION BY doc_id) AS n FROM bl),
ch AS (SELECT *, (pos // 7)::INT AS chunk_id FROM bt),
ck AS (SELECT doc_id, chunk_id, min(pos) AS start_block, max(pos) + 1 AS end_block, count(*)::INT AS num_blocks FROM ch GROUP BY doc_id, chunk_id)"""


def _blocks(spark, sf_dir):
    """Lines of documents as blocks, whole; every third is broken at its commas."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.withColumn("text", F.when(F.col("pos") % 3 == 0, F.replace("text", F.lit(", "), F.lit(",\n"))).otherwise(F.col("text")))


@query("""WITH r AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE 10000000 + l_partkey END AS key, l_orderkey, l_linenumber FROM lineitem),
p AS (SELECT key, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM r)
SELECT key, l_orderkey, l_linenumber, n AS n_blocks, (CASE WHEN n < 500 THEN pos // 50 ELSE pos // 100 END)::INT AS chunk_id FROM p""")
def chunk_sizes(spark, sf_dir):
    """Chunks of a hundred blocks, or of fifty where a key has under five hundred: suppliers' and parts' lines have both."""
    key = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).otherwise(F.lit(10_000_000) + F.col("l_partkey"))
    d = table(spark, sf_dir, "lineitem").select(key.alias("key"), "l_orderkey", "l_linenumber")
    d = d.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy("l_orderkey", "l_linenumber")) - 1)
    return chunking.with_chunks(d, ["key"]).select("key", "l_orderkey", "l_linenumber", "n_blocks", "chunk_id")


@query(f"""WITH {_BLOCKS},
b AS (SELECT k.doc_id, k.chunk_id, string_agg(c.text, '|' ORDER BY pos) AS t FROM ck k JOIN ch c ON c.doc_id = k.doc_id AND c.pos >= k.start_block - 5 AND c.pos < k.start_block GROUP BY 1, 2),
a AS (SELECT k.doc_id, k.chunk_id, string_agg(c.text, '|' ORDER BY pos) AS t FROM ck k JOIN ch c ON c.doc_id = k.doc_id AND c.pos >= k.end_block AND c.pos < k.end_block + 5 GROUP BY 1, 2),
o AS (SELECT doc_id, chunk_id, string_agg(replace(text, chr(10), ' '), '|' ORDER BY pos) AS t FROM ch GROUP BY 1, 2)
SELECT doc_id, chunk_id, start_block, end_block, num_blocks, coalesce(b.t, '') AS before_text, o.t AS core_text, coalesce(a.t, '') AS after_text FROM ck LEFT JOIN b USING (doc_id, chunk_id) LEFT JOIN a USING (doc_id, chunk_id) JOIN o USING (doc_id, chunk_id)""")
def chunk_with_context(spark, sf_dir):
    d = chunking.chunks_with_context(_blocks(spark, sf_dir), ["doc_id"], size=7)
    j = lambda c: F.array_join(c, "|")
    return d.select("doc_id", "chunk_id", "start_block", "end_block", "num_blocks", j("before").alias("before_text"), j("core").alias("core_text"), j("after").alias("after_text"))


def _returned(chunks: DataFrame) -> DataFrame:
    """What a worker gave back, here made up: nothing for chunk 1, the last block missing in every third chunk, dashes in some texts."""
    made = F.transform("core", lambda t, i: F.when(i % 4 == 0, F.concat(F.lit("- "), t, F.lit(" - "), F.reverse(t))).when(i % 4 == 1, F.concat(t, F.lit(" — "), t)).otherwise(F.concat(F.lit("<"), t, F.lit(">"))))
    cut = F.slice(made, F.lit(1), F.size(made) - F.when(F.col("chunk_id") % 3 == 2, 1).otherwise(0))
    return chunks.where("chunk_id <> 1").select("doc_id", "chunk_id", cut.alias("output"))


@query(f"""WITH {_BLOCKS}
SELECT doc_id, chunk_id, num_blocks, CASE WHEN chunk_id <> 1 THEN num_blocks - (chunk_id % 3 = 2)::INT END AS n_found, CASE WHEN chunk_id = 1 THEN 'missing' WHEN chunk_id % 3 = 2 THEN 'mismatch' ELSE 'ok' END AS state FROM ck""")
def chunk_count_check(spark, sf_dir):
    chunks = chunking.chunks_with_context(_blocks(spark, sf_dir), ["doc_id"], size=7)
    return chunking.check_chunks(chunks, _returned(chunks), ["doc_id"])


#: The blank nearest to the middle, that before it where both are as near, found on either side.
_BALANCE = """(SELECT CASE WHEN instr(x, ' ') = 0 THEN x ELSE substring(x, 1, upper) || chr(10) || substring(x, upper + 2) END FROM (SELECT x, CASE WHEN b > 0 AND (r = 0 OR abs(2 * (h - b) + 1 - n) <= abs(2 * (h + r - 1) + 1 - n)) THEN h - b ELSE h + r - 1 END AS upper
  FROM (SELECT x, n, h, instr(reverse(substring(x, 1, h)), ' ') AS b, instr(substring(x, h + 1), ' ') AS r FROM (SELECT x, length(x) AS n, (length(x) + 1) // 2 AS h FROM (SELECT {t} AS x)))))"""


@query(f"""WITH {_BLOCKS},
g AS (SELECT *, replace(text, chr(10), ' ') AS c, pos - (chunk_id * 7) AS i FROM ch JOIN ck USING (doc_id, chunk_id)),
m AS (SELECT *, CASE WHEN chunk_id = 1 OR (chunk_id % 3 = 2 AND i = num_blocks - 1) THEN '' WHEN i % 4 = 0 THEN '- ' || c || ' - ' || reverse(c) WHEN i % 4 = 1 THEN c || ' — ' || c ELSE '<' || c || '>' END AS x FROM g),
e AS (SELECT doc_id, pos, text, replace(x, ' — ', chr(10)) AS t FROM m),
r AS (SELECT doc_id, pos, CASE WHEN starts_with(t, '- ') AND contains(t[3:], ' - ') THEN replace(t, ' - ', chr(10) || '- ')
  WHEN contains(text, chr(10)) AND NOT contains(t, chr(10)) THEN {_BALANCE.format(t="t")} ELSE t END AS t FROM e),
l AS (SELECT doc_id, pos, unnest(string_split(t, chr(10))) AS x, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM r),
d AS (SELECT *, CASE WHEN starts_with(x, '- ') THEN x[3:] ELSE x END AS y FROM l),
z AS (SELECT doc_id, pos, i, CASE WHEN length(x) > 50 THEN CASE WHEN starts_with(x, '- ') THEN '- ' ELSE '' END || {_BALANCE.format(t="y")} ELSE x END AS x FROM d)
SELECT doc_id, pos, string_agg(x, chr(10) ORDER BY i) AS text FROM z GROUP BY doc_id, pos""")
def reassembly_repair(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    chunks = chunking.chunks_with_context(blocks, ["doc_id"], size=7)
    return chunking.reassemble(blocks, chunks, _returned(chunks), ["doc_id"]).select("doc_id", "pos", "text")


_TOPICS = """tp AS (SELECT d.source, (row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id))::INT AS p, count(*) OVER (PARTITION BY d.source)::INT AS n, coalesce(l.quality, 0) AS q, l.doc_id AS has FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"WITH {_TOPICS} SELECT source, p AS \"start\", coalesce(lead(p) OVER (PARTITION BY source ORDER BY p) - 1, n)::INT AS \"end\" FROM tp WHERE p = 1 OR q = 1")
def contiguity_repair(spark, sf_dir):
    """Ranges that begin at each document labelled good, closed up to the next one."""
    w = W.partitionBy("source")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    at = docs.select("source", F.row_number().over(w.orderBy("doc_id")).cast("int").alias("start"), F.count(F.lit(1)).over(w).cast("int").alias("n"), "quality")
    topics = at.where("start = 1 or quality = 1").withColumn("end", F.col("start"))
    return summaries.close_gaps(topics, ["source"]).select("source", "start", "end")


_TILES = f"""{_SUMMARY_SENTENCES}, nn AS (SELECT conv_id, count(*)::INT AS n FROM ss GROUP BY conv_id),
ti AS (SELECT conv_id, unnest(range(0, (n - 1) // 5 + 1))::INT AS seq, n FROM nn)"""


def _sentence_table(spark, sf_dir):
    d = islands.summarise(islands.summary_sentences(timed_words(spark, sf_dir), KEY, 1000, ENDERS), ["conv_id", "sentence_id"], islands.spaced_text_of())
    return d.select("conv_id", F.col("sentence_id").alias("pos"), "text", "start", "end")


@query(f"WITH {_TILES} SELECT conv_id, seq, seq * 5 + 1 AS \"start\", least((seq + 1) * 5, n) AS \"end\" FROM ti")
def core_region_commit(spark, sf_dir):
    """The loop over windows, each falling back to tiles: tiles stay aligned across windows."""
    return summaries.summary_loop(_sentence_table(spark, sf_dir), KEY).select("conv_id", "seq", "start", "end")


@query(f"""WITH {_TILES}, tc AS (SELECT conv_id, seq, a.s AS s, b.e AS e FROM ti JOIN ss a USING (conv_id) JOIN ss b USING (conv_id) WHERE a.sentence_id = seq * 5 AND b.sentence_id = least((seq + 1) * 5, n) - 1)
SELECT conv_id, seq, s AS first_time, e AS last_time FROM tc""")
def topic_timecodes(spark, sf_dir):
    blocks = _sentence_table(spark, sf_dir)
    n = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    topics = n.select("conv_id", F.posexplode(summaries.fallback_tiles(F.col("n"))).alias("seq", "r")).select("conv_id", "seq", "r.start", "r.end")
    return summaries.topic_times(topics, blocks, KEY).select("conv_id", "seq", "first_time", "last_time")


@query("""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '_', 'g') AS slug, sha1(url)[1:8] AS mark, ('0x' || md5(url)[1:8])::BIGINT AS id FROM pages""")
def stable_ids(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.slug(u).alias("slug"), S.path_mark(u).alias("mark"), S.stable_id(u).alias("id"))


_ENDINGS = "ja jp ko zh zh-hans zh-hant zh-cn zh-tw en es pt pt-br fr de it ru ar hi th vi id tr pl nl sv JA Zh-Hant jpn eng kor zho deu fra spa raw act".split()


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, {_ENDINGS}[(page_id % {len(_ENDINGS)} + 1)::INT] AS ending FROM pages),
q AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.' || ending WHEN 1 THEN ending ELSE host || '.' || ending END AS stem, ending FROM p)
SELECT page_id, CASE WHEN page_id % 5 = 1 OR lower(ending) IN ('jpn', 'eng', 'kor', 'zho', 'deu', 'fra', 'spa', 'raw', 'act') THEN stem ELSE left(stem, length(stem) - length(ending) - 1) END AS stem FROM q""")
def lang_suffix_strip(spark, sf_dir):
    """Names with every language code, some of other kinds, alone and behind a host's name."""
    ending = F.element_at(F.lit(_ENDINGS), (F.col("page_id") % len(_ENDINGS) + 1).cast("int"))
    host = F.regexp_extract("url", "//([^/]+)", 1)
    stem = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("."), ending)).when(F.col("page_id") % 5 == 1, ending).otherwise(F.concat(host, F.lit("."), ending))
    return table(spark, sf_dir, "pages").select("page_id", S.strip_language(stem).alias("stem"))


_PASS = r"regexp_replace({}, '\([^()]*\)', '', 'g')"
_PASSES = "t"
for _ in range(9):
    _PASSES = _PASS.format(_PASSES)


@query(rf"""WITH t AS (SELECT doc_id, '((a(b((c(' || text[1:20] || '))d)))e)' || '{{x}}' || text[21:] || '(' || '\N' || '）' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\{{[^}}]*\}}', '', 'g'), '\\[Nn]', '', 'g') AS t FROM t),
b AS (SELECT doc_id, {_PASSES} AS t FROM a),
c AS (SELECT doc_id, length(regexp_replace(t, '\s+', '', 'g'))::INT AS chars FROM b)
SELECT doc_id, chars, CASE WHEN chars >= 2 THEN greatest(0.5::DOUBLE, chars * 0.06::DOUBLE) END AS pause FROM c""")
def visible_chars_pause(spark, sf_dir):
    """Whole texts, their first words within brackets nested seven deep, a bracket without a partner behind them."""
    t = F.concat(F.lit("((a(b((c("), F.substring("text", 1, 20), F.lit("))d)))e){x}"), F.substring("text", 21, 1 << 30), F.lit("(\\N）"))
    d = table(spark, sf_dir, "documents").select("doc_id", S.visible_chars(t).alias("chars"))
    return d.withColumn("pause", S.pause(F.col("chars")))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '//([^/]+)', 1) AS stem, CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END AS pr FROM pages)
SELECT stem, page_id, n FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY pr, page_id) AS rn, count(*) OVER (PARTITION BY stem) AS n FROM p) WHERE rn = 1""")
def source_priority(spark, sf_dir):
    """The preferred page of each host and how many there are."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("stem"), F.when(F.col("url").startswith("https"), 0).otherwise(1).alias("pr"))
    return files.preferred(p, ["stem"], ["pr", "page_id"]).select("stem", "page_id", "n")


@query(f"""WITH {_GROUPS} SELECT conv_id, g AS group_id, string_agg(text, '' ORDER BY pos) AS text, arg_min(s, pos) AS start_ms, arg_max(e, pos) AS end_ms, arg_max(e, pos) - arg_min(s, pos) AS duration, sum(length(text))::BIGINT AS chars, count(DISTINCT speaker) AS n_speakers FROM gr GROUP BY conv_id, g""")
def cue_stats(spark, sf_dir):
    d = islands.summarise(_groups(spark, sf_dir), ["conv_id", "group_id"])
    return d.select("conv_id", "group_id", "text", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), (F.col("end") - F.col("start")).alias("duration"), "chars", "n_speakers")
