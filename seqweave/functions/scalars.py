"""Scalar functions over text, time codes and names, all as JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANGUAGE_CODES, LONG_LINE, SENTENCE_ENDERS

BLANK = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def interpolate(start: Column, end: Column, i: Column, n: Column) -> tuple[Column, Column]:
    """Share of character i of n in a token's time."""
    span = end - start
    return start + span * i / n, start + span * (i + 1) / n


def clamp_ender(text: Column, start: Column, end: Column, most: float = 0.2, kept: float = 0.1, enders: str = SENTENCE_ENDERS) -> Column:
    """End of a single sentence mark: a long one is cut to ``kept``."""
    return F.when((F.length(text) == 1) & F.instr(F.lit(enders), text).cast("boolean") & (end - start > most), start + kept).otherwise(end)


def clock(seconds: Column) -> Column:
    """H:MM:SS.mmm, rounded."""
    return F.format_string("%d:%02d:%06.3f", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60).cast("int"), seconds % 60)


def printed(x: Column, digits: int) -> Column:
    """A value from 0 on, rounded to ``digits`` places by what the double holds exactly, ties to even, as C prints it.

    The JVM rounds the shortest decimal that names the double instead. The product with 2 * 10 ** digits is taken without
    an error, in two parts, and compared with the odd number that lies half-way.
    """
    m = 2.0 * 10**digits
    c = x * 134217729.0
    high = c - (c - x)
    whole = x * m
    rest = (high * m - whole) + (x - high) * m
    n = F.floor(x * (m / 2))
    over_half = (whole - (2 * n + 1)) + rest
    return (n + F.when((over_half > 0) | ((over_half == 0) & (n % 2 == 1)), 1).otherwise(0)) / (m / 2)


def timecode(seconds: Column) -> Column:
    """HH:MM:SS,mmm with milliseconds cut off, as cue files are written."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, F.floor((seconds % 1) * 1000))


def rounded_timecode(seconds: Column) -> Column:
    """HH:MM:SS,mmm with milliseconds rounded half to even and no carry, negatives as zero, as summaries are written."""
    s = F.greatest(seconds, F.lit(0.0))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), F.floor(s % 60), F.bround((s % 1) * 1000).cast("int"))


def _cleaned(text: Column) -> Column:
    return F.replace(strip(text), F.lit(","), F.lit("."))


def _seconds(t: Column) -> Column:
    shape = r"^(\d+) *: *(\d+) *: *(\d+\.?\d*|\.\d+)$"
    part = lambda i: F.regexp_extract(t, shape, i)
    return F.when(F.regexp_like(t, F.lit(shape)), part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double"))


def parse_timecode(text: Column) -> Column:
    """Seconds of [H]H:MM:SS with or without ,mmm or .mmm; null for another shape."""
    return _seconds(_cleaned(text))


def line_times(line: Column) -> Column:
    """Seconds of each of a line's parts between ' --> ', null for one of another shape; every part is cleaned once."""
    return F.transform(F.transform(F.split(strip(line), " --> "), _cleaned), _seconds)


def both_times(times: Column) -> tuple[Column, Column]:
    """Start and end of line_times; null if they aren't two or one is null."""
    start, end = F.try_element_at(times, F.lit(1)), F.try_element_at(times, F.lit(2))
    whole = (F.size(times) == 2) & start.isNotNull() & end.isNotNull()
    return F.when(whole, start), F.when(whole, end)


def parse_times(line: Column) -> tuple[Column, Column]:
    """Start and end of a cue's time line: two time codes with ' --> ' between them and nothing else; null for another line."""
    return both_times(line_times(line))


def without_stops(text: Column) -> Column:
    return F.regexp_replace(text, "。+$", "")


def strip_language(stem: Column, codes: Sequence[str] = LANGUAGE_CODES) -> Column:
    """Without the last dotted part if it is a language code; once, and in any case."""
    last = F.substring_index(stem, ".", -1)
    known = (F.instr(stem, ".") > 0) & F.lower(last).isin(*codes)
    return F.when(known, F.left(stem, F.length(stem) - F.length(last) - 1)).otherwise(stem)


def work_names(path: Column) -> tuple[Column, Column, Column]:
    """Names for a file's summary: a work folder's, unique by path, the output, and the output where that is taken.

    The work name lacks the process and time marks that a single run may add: it is the same each time.
    """
    base = F.substring_index(path, "/", -1)
    folder = F.left(path, F.length(path) - F.length(base))
    ending = F.substring_index(base, ".", -1)
    stem = F.when(F.instr(base, ".") > 0, F.left(base, F.length(base) - F.length(ending) - 1)).otherwise(base)
    bare = strip_language(stem)
    return F.concat(slug(bare), F.lit("-"), path_mark(path)), F.concat(folder, bare, F.lit(".summary.en.srt")), F.concat(folder, stem, F.lit(".summary.en.srt"))


def numbered(texts: Column) -> Column:
    """Texts as lines numbered from 1."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(t, F.lit("")))), "\n")


def slug(stem: Column) -> Column:
    return F.regexp_replace(F.lower(stem), "[^a-z0-9]", "_")


def path_mark(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 8)


def stable_id(name: Column) -> Column:
    """First 32 bits of the name's MD5."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def sound_file(tag: Column) -> Column:
    return F.regexp_extract(tag, r"\[sound:(.*?)\]", 1)


def image_file(tag: Column) -> Column:
    return F.regexp_extract(tag, r"src='([^']*)'", 1)


def episode(name: Column) -> Column:
    """The last two digits that stand behind E, a dash or a blank and before a dot or a dash; '' without any."""
    return F.regexp_extract(name, r"^.*[E -]([0-9]{2})[.\-]", 1)


def without_fence(text: Column) -> Column:
    """Without the first line if it opens a code fence, and without the last if it is a bare one."""
    t = F.trim(text)
    body = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")
    return F.when(F.startswith(t, F.lit("```")), body).otherwise(t)


def log_confidence(confidence: Column) -> Column:
    return F.when(confidence > 0, F.ln(confidence)).otherwise(F.lit(0.0))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def visible_chars(text: Column) -> Column:
    """Characters to be read: braces' marks, line breaks, bracketed remarks and white space don't count.

    Brackets go with all that stands between them, nested to any depth; those without a partner stay. Wide brackets are matched
    by bytes, as the behaviour to be matched does: one that holds a character with a byte EF, BC or 89 in UTF-8 stays.
    """
    inner = r"\([^()]*\)"
    t = F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nn]", "")
    for _ in range(3):
        t = F.regexp_replace(t, inner, "")
    # few texts nest deeper: each further pass takes one level, and there are at most as many as there are open ones
    opened = F.length(t) - F.length(F.replace(t, F.lit("(")))
    deep = F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), t, lambda acc, _: F.when(acc.rlike(inner), F.regexp_replace(acc, inner, "")).otherwise(acc))
    t = F.when(t.rlike(inner), deep).otherwise(t)
    by_bytes = F.regexp_replace(F.decode(F.encode(t, "utf-8"), "iso-8859-1"), "\u00ef\u00bc\u0088[^\u00ef\u00bc\u0089]*\u00ef\u00bc\u0089", "")
    t = F.when(F.instr(t, "（") > 0, F.decode(F.encode(by_bytes, "iso-8859-1"), "utf-8")).otherwise(t)
    return F.length(F.regexp_replace(t, r"\s+", ""))


def pause(chars: Column, per_char: float = 0.06, least: float = 0.5, from_chars: int = 2) -> Column:
    return F.when(chars >= from_chars, F.greatest(F.lit(least), chars * per_char))


def balance_words(text: Column) -> Column:
    """Two lines of nearly equal length, cut between words; the first best place wins."""
    # the length of the upper line is the place of the blank, so the best one is the nearest to the middle on either side
    size = F.length(text)
    half = F.floor((size + 1) / 2).cast("int")
    before, behind = F.instr(F.reverse(F.substring(text, F.lit(1), half)), " "), F.instr(F.substring(text, half + 1, F.lit(1 << 30)), " ")
    left, right = half - before, half + behind - 1
    at = F.when((before > 0) & ((behind == 0) | (F.abs(2 * left + 1 - size) <= F.abs(2 * right + 1 - size))), left).otherwise(right)
    return F.when((before == 0) & (behind == 0), text).otherwise(F.concat(F.substring(text, F.lit(1), at), F.lit("\n"), F.substring(text, at + 2, F.lit(1 << 30))))


def repair_block(text: Column, had_two_lines: Column, long_line: int = LONG_LINE) -> Column:
    """A processed block in its final lines: dash breaks, run-together speakers, two lines kept two, long lines cut."""
    t = F.replace(text, F.lit(" — "), F.lit("\n"))
    joined = F.startswith(t, F.lit("- ")) & (F.instr(F.substring(t, 3, 1 << 30), " - ") > 0)
    two = had_two_lines & (F.instr(t, "\n") == 0)
    t = F.when(joined, F.replace(t, F.lit(" - "), F.lit("\n- "))).when(two, balance_words(t)).otherwise(t)

    def line(x):
        dashed = F.startswith(x, F.lit("- "))
        body = F.when(dashed, F.substring(x, 3, 1 << 30)).otherwise(x)
        cut = F.when(dashed, F.concat(F.lit("- "), balance_words(body))).otherwise(balance_words(body))
        return F.when(F.length(x) > long_line, cut).otherwise(x)

    return F.array_join(F.transform(F.split(t, "\n"), line), "\n")


def split_blocks(text: Column, marker: str) -> Column:
    """Blocks between markers, stripped; an empty text is one empty block."""
    return F.transform(F.split(text, "\\Q" + marker + "\\E"), strip)


def speaker_lines(lines: Column, n_speakers: Column) -> Column:
    """Lines joined, with dashes where more than one speaker has more than one line."""
    dashed = (F.size(lines) > 1) & (n_speakers > 1)
    return F.array_join(F.when(dashed, F.transform(lines, lambda x: F.concat(F.lit("- "), x))).otherwise(lines), "\n")
