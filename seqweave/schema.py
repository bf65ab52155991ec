"""Schemas and limits of time-coded sequences. Every table carries its order in ``pos``."""

from __future__ import annotations

WORD = "transcript_id string, pos int, text string, start double, end double, type string, speaker string, logprob double"
UNIT = "transcript_id string, pos int, text string, start double, end double, speaker string, ends_clause boolean, morph_count int"
BLOCK = "transcript_id string, pos int, index string, timecode string, start double, end double, text string, n_lines int"
CHUNK = "transcript_id string, chunk_id int, start_block int, end_block int, num_blocks int"
TOPIC = "transcript_id string, seq int, start int, end int, summary string"
TRANSCRIPT = "language_code string, language_probability double, text string, transcription_id string, words array<struct<text:string,start:double,end:double,type:string,speaker_id:string,logprob:double>>"
PROVIDER = "text string, tokens array<struct<text:string,start_ms:bigint,end_ms:bigint,speaker:string,confidence:double,is_audio_event:boolean>>"

SENTENCE_ENDERS = "。！？!?"
COMMA = "、"
SPLIT_GAP, MERGE_GAP, SENTENCE_GAP, LINGER = 0.1, 0.4, 1.0, 0.5
LINE_CHARS, TINY_CHARS = 18, 8
COMMA_TOKENS, COMMA_NEXT, COMMA_KEEP, GROUP_TOKENS = 5, 2, 7, 20
WINDOW, CORE, TILE = 40, 25, 5
CHUNK_BLOCKS, SMALL_CHUNK, SMALL_FILE, CONTEXT_BLOCKS = 100, 50, 500, 5
LONG_LINE, MANY_WINDOWS = 50, 40
LANGUAGE_CODES = tuple(sorted("ar de en es fr hi id it ja jp ko nl pl pt pt-br ru sv th tr vi zh zh-cn zh-hans zh-hant zh-tw".split()))
STARTER_POS = ("名詞", "動詞", "形容詞", "形状詞", "副詞", "連体詞", "接続詞", "感動詞", "代名詞")
