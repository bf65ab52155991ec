"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Words of the corpus are numbered in units (a task's share of the texts), and every distinct word goes to one
task of a hash partition of all words. There the words are laid out as one array of byte tokens with links to their
neighbours, and an inverted index holds, for each token pair that merges, the positions where it stands. Merges are applied in
rank order, each to all its positions in all words at once; only pairs at the touched neighbours are looked up anew.
So every word is replayed once in the corpus, however many texts hold it. The words' ids return to the units that asked and
are gathered into documents. Texts are split into words once; neither they nor their word numbers are exchanged: units lie in
buckets, where the answers join them.
"""

from __future__ import annotations

import base64
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Index, byte_strings, chunks, list_array, ragged, stored_by

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Ranks:
    """A vocabulary of byte strings by rank, and the rank of each pair of tokens whose bytes together are one."""

    def __init__(self, vocabulary: bytes):
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.size = max(ids.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = token
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank)
        order = np.argsort(keys)
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, end to end, and the number of tokens of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), sizes
    token = ranks.byte[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = -1
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}  # by token pair, left << 32 | right
    queue: list[tuple[int, int]] = []  # (rank, pair)

    def enter(at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        pair = token[at] << 32 | token[after[at]]
        rank = ranks.of(token[at], token[after[at]])
        at, pair, rank = at[rank >= 0], pair[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(pair, kind="stable")
        at, pair, rank = at[order], pair[order], rank[order]
        cuts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(pair))):
            k = int(pair[lo])
            if k not in index:
                index[k] = []
                heapq.heappush(queue, (int(rank[lo]), k))
            index[k].append(at[lo:hi])

    enter(np.flatnonzero(after >= 0))
    alive = np.ones(n, bool)
    while queue:
        # pairs of different tokens may make the same one: all of a rank are applied together, from the left
        rank, pairs = queue[0][0], []
        while queue and queue[0][0] == rank:
            pairs += index.pop(heapq.heappop(queue)[1])
        at = np.unique(np.concatenate(pairs))
        at = at[alive[at] & (after[at] >= 0)]
        at = at[ranks.of(token[at], token[after[at]]) == rank]
        if not len(at):
            continue
        # of pairs that overlap, the first, third, ... of each chain are merged
        chained = np.append(False, after[at[:-1]] == at[1:])
        if chained.any():
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = after[at]
        far = after[gone]
        token[at] = rank
        alive[gone] = False
        after[at] = far
        before[far[far >= 0]] = at[far >= 0]
        enter(np.unique(np.concatenate([at[far >= 0], before[at][before[at] >= 0]])))
    return token[alive], np.bincount(owner[alive], minlength=len(words))


def decode(ids: np.ndarray, counts: np.ndarray, ranks: Ranks) -> list[bytes]:
    """The bytes that each run of ``counts`` ids stands for."""
    lengths = np.fromiter(map(len, ranks.tokens), np.int64, ranks.size)
    data = np.frombuffer(b"".join(ranks.tokens), np.uint8)
    starts = np.cumsum(lengths) - lengths
    text = data[ragged(starts[ids], lengths[ids])].tobytes()
    total = np.append(0, np.cumsum(lengths[ids]))
    ends = total[np.cumsum(counts)] if len(counts) else []
    return [text[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]


#: Distinct words and bytes of text of a unit, bytes of text for each part of all words, and new words that are replayed together.
UNIT_WORDS, UNIT_BYTES, PART_BYTES, REPLAY_WORDS = 1 << 18, 64 << 20, 64 << 20, 1 << 18
#: Spark's own bound on buckets.
MOST_BUCKETS = 100_000
#: What a blob holds: words of one part, the part of each of a unit's words, documents.
ASSIGNED, DOCUMENTS = -1, -2
BLOBS = "unit long, part int, blob binary"
DOCUMENT_IDS = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("exact", pa.bool_())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, numbers byte plane by byte plane."""
    head = np.array([len(arrays), *(v for a in arrays for v in (ord(a.dtype.char), len(a)))], np.int64)
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    whole = head.tobytes() + body
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(data, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += size * dtype.itemsize
    return out


def blob_rows(units, parts, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["unit", "part", "blob"])


def number_words(df: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """Blobs of each unit: its distinct words for each part that has some, the part of each word, and documents as word numbers.

    Documents come with a 128-bit hash of the text's bytes. A word's part is a hash of it, so equal words of all units meet.
    """

    def run(batches):
        pattern, unit, ids, held = regex.compile(PATTERN), TaskContext.get().partitionId() << 20, Index(), 0
        for part in chunks(batches, "t"):
            column, ident = part.column("t"), part.column("d")
            flat, sizes = [], np.zeros(part.num_rows, np.int32)
            for i, t in enumerate(column.to_pylist()):
                words = pattern.findall(t) if t else []
                sizes[i] = len(words)
                flat.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            texts = byte_strings(column)
            held += sum(map(len, texts))
            marks = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in texts]), np.int64)
            nulls = ident.is_null().to_numpy(zero_copy_only=False) + np.uint8(2) * column.is_null().to_numpy(zero_copy_only=False)
            yield blob_rows([unit], [DOCUMENTS], [pack(pc.fill_null(ident, 0).to_numpy(), nulls.astype(np.uint8), sizes, marks, np.concatenate(flat))])
            if len(ids) > UNIT_WORDS or held > UNIT_BYTES:
                yield words_of(unit, ids)
                unit, ids, held = unit + 1, Index(), 0
        yield words_of(unit, ids)

    def words_of(unit: int, ids: Index):
        words = [w.encode() for w in ids]
        of = np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint32) % np.uint32(parts) if words else np.zeros(0, np.uint32)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edges))
        blobs = []
        for p in some.tolist():
            mine = [words[i] for i in order[edges[p] : edges[p + 1]].tolist()]
            blobs.append(pack(np.fromiter(map(len, mine), np.int32, len(mine)), np.frombuffer(b"".join(mine), np.uint8)))
        kind = np.uint8 if parts <= 256 else np.uint16 if parts <= 65536 else np.uint32
        return blob_rows([unit] * (len(some) + 1), [*some.tolist(), ASSIGNED], [*blobs, pack(of.astype(kind))])

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, BLOBS)


def replay_words(words: DataFrame, vocabulary, parts: int) -> DataFrame:
    """For each blob of words one of their numbers of ids and their ids. A part is a task, and replays each of its words once."""

    def run(batches):
        ranks = Ranks(vocabulary.value)
        token = np.uint16 if ranks.size <= 1 << 16 else np.uint32
        ids, flat, counts = Index(), np.zeros(0, token), np.zeros(0, np.int32)
        held = []  # blobs whose words wait to be replayed
        known = 0

        def answers():
            nonlocal flat, counts, known
            if len(ids) > known:
                new, n = replay(list(islice(ids, known, None)), ranks)
                flat, counts, known = np.concatenate([flat, new.astype(token)]), np.concatenate([counts, n.astype(np.int32)]), len(ids)
            starts = np.cumsum(counts, dtype=np.int64) - counts
            for unit, part, at in held:
                n = counts[at]
                yield blob_rows([unit], [part], [pack(n, flat[ragged(starts[at], n.astype(np.int64))])])
            held.clear()

        for batch in batches:
            for unit, part, blob in zip(*(batch.column(c).to_pylist() for c in ("unit", "part", "blob"))):
                lengths, data = unpack(blob)
                data, ends = data.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
                held.append((unit, part, np.fromiter((ids[data[a:b]] for a, b in zip([0, *ends[:-1]], ends)), np.int64, len(ends))))
                if len(ids) - known > REPLAY_WORDS or len(held) > 256:
                    yield from answers()
        yield from answers()

    return words.repartitionById(parts, F.col("part")).mapInArrow(run, BLOBS)


def gather(numbered: DataFrame, answers: DataFrame, vocabulary) -> DataFrame:
    """Documents' ids from the blobs of each unit and the answers to its words."""

    def run(unit: pa.Table, answered: pa.Table) -> pa.Table:
        ranks = Ranks(vocabulary.value)
        found = {p: unpack(b) for p, b in zip(answered.column("part").to_pylist(), answered.column("blob").to_pylist())}
        kinds, blobs = unit.column("part").to_pylist(), unit.column("blob").to_pylist()
        (of,), at, pieces = unpack(blobs[kinds.index(ASSIGNED)]), 0, []
        begin, sizes = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(int(of.max(initial=0)) + 2))
        for p, (n, flat) in found.items():
            mine = order[edges[p] : edges[p + 1]]
            sizes[mine] = n
            begin[mine] = at + np.cumsum(n, dtype=np.int64) - n
            at += len(flat)
            pieces.append(flat)
        tokens = np.concatenate(pieces).astype(np.int32) if pieces else np.zeros(0, np.int32)
        done = [documents(unpack(b), begin, sizes, tokens, ranks) for kind, b in zip(kinds, blobs) if kind == DOCUMENTS]
        return pa.Table.from_batches(done, DOCUMENT_IDS)

    def documents(arrays, begin, sizes, tokens, ranks):
        ident, nulls, counts, marks, flat = arrays
        n = sizes[flat]
        out = tokens[ragged(begin[flat], n)]
        per = np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts, dtype=np.int64))])
        digests = b"".join([xxhash.xxh3_128_digest(t) for t in decode(out, per, ranks)])
        exact = (np.frombuffer(digests, np.int64).reshape(-1, 2) == marks.reshape(-1, 2)).all(axis=1)
        lists = list_array(pa.array(out), per)
        if (nulls & 2).any():
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array((nulls & 2) > 0))
        return pa.RecordBatch.from_arrays([pa.array(ident, mask=(nulls & 1) > 0), lists, pa.array(per, pa.int32()), pa.array(exact)], names=["doc_id", "token_ids", "n_tokens", "exact"])

    documents_of = numbered.where("part < 0").groupBy("unit").cogroup(answers.groupBy("unit"))
    return documents_of.applyInArrow(run, "doc_id long, token_ids array<int>, n_tokens int, exact boolean")


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """doc_id, token_ids, n_tokens, exact: ids under the vocabulary at ``path``, as its own greedy encoder gives them.

    ``exact`` says that decoding gives the text's bytes again, as their 128-bit hashes tell; it is checked for every row. A
    null text has null ids, n_tokens 0 and is exact; an empty one has no ids; a very long one is encoded whole. Special
    tokens' strings are ordinary text. Each repeated row is encoded. Pairs of the same rank that overlap are merged
    from the left. An empty table gives no rows; other columns are not read. The driver reads ``path``, about 1 MB, and sends it to the executors.
    """
    vocabulary = _vocabulary(df, path)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(tasks, -(-size // PART_BYTES))
    buckets = min(max(tasks, -(-size // UNIT_BYTES)), MOST_BUCKETS)
    numbered = stored_by(number_words(df, doc_id, text, parts), "word-numbers", "unit", buckets)
    return gather(numbered, replay_words(numbered.where("part >= 0"), vocabulary, parts), vocabulary)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def decode_corpus(df: DataFrame, doc_id: str = "doc_id", token_ids: str = "token_ids", path: str = TOKENIZER) -> DataFrame:
    """doc_id, text from token ids; null ids give a null text, bytes that are no UTF-8 become replacement marks.

    An id outside the vocabulary is an error that names it. Very long rows are decoded whole, repeated ones each; an empty table gives
    no rows; other columns are not read.
    """
    vocabulary = _vocabulary(df, path)

    def run(batches):
        ranks = Ranks(vocabulary.value)
        for batch in batches:
            column = batch.column("t")
            counts = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() < ranks.size:
                raise ValueError(f"no token {ids[(ids < 0) | (ids >= ranks.size)][0]}")
            texts = decode(ids, counts, ranks)
            shown = [None if null else t.decode("utf-8", "replace") for t, null in zip(texts, column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(shown, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(token_ids).alias("t")).mapInArrow(run, "doc_id long, text string")
