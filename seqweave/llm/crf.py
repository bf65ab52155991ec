"""Language identification of words in code-switched text by a linear-chain conditional random field.

Features of a word: its affixes of one to three characters, its character n-grams of two and three, the word itself, all
in lower case and hashed into one table with a weight for each language, and the languages whose lexicon holds it, with
weights of their own. Learned transitions join neighbouring words; forward-backward gives each word's
probabilities. Words are those between ASCII white space.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Index, byte_strings, chunks, list_array, ragged

TABLE_BITS = 18
#: rows of a long document that are summed apart and joined by their transfer matrices
ROW = 256
_P1, _P2, _P3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2 ** TABLE_BITS, languages)
    start: np.ndarray  # probabilities of the first word's language, before its features
    transition: np.ndarray  # exp of the learned transition weights
    entries: np.ndarray  # hashes of the lexicons' words, rising
    member: np.ndarray  # (entries, languages): whose lexicon holds the word
    lexicon: np.ndarray  # (languages, languages): weights of being in a language's lexicon


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * _P2
    x ^= x >> np.uint32(15)
    x *= _P3
    return x >> np.uint32(32 - TABLE_BITS)


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words in lower case, two blanks before each and behind the last, and where each word begins and its length.

    Letters of any script and marks beyond ASCII count; ASCII marks and digits stand as one neutral sign.
    """
    text = (b"  " + b"  ".join(words) + b"  ").decode("utf-8", "replace").lower()
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    blanks = np.flatnonzero(c == 32)
    c = np.where(((c >= 97) & (c <= 122)) | (c >= 128), c, np.uint32(32))
    return c, blanks[1:-1:2] + 1, blanks[2::2] - blanks[1:-1:2] - 1


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all words, where each word's begin, and each word's hash; a word has six affixes, itself and its n-grams."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c, starts, sizes = _letters(words)
    two = (c[:-1] * np.uint32(0x10001)) ^ (c[1:] * np.uint32(0x9E37))
    three = (two[:-1] * np.uint32(0x85EB)) ^ c[2:]
    # n-grams run from the blank before the word to its last character
    at = ragged(starts - 1, sizes + 1)
    grams = np.empty((len(at), 2), np.uint32)
    grams[:, 0] = _mix(two[at], 1)
    grams[:, 1] = _mix(three[at], 2)
    # value of the whole word: the sum of its characters weighted by place
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x100000001B3, np.uint64))
    inner = ragged(starts, sizes)
    place = inner - np.repeat(starts, sizes)
    whole = np.add.reduceat(c[inner].astype(np.uint64) * powers[place], np.cumsum(sizes) - sizes)
    whole ^= whole >> np.uint64(29)
    last = starts + sizes
    affix = np.empty((len(words), 7), np.uint32)
    affix[:, 0] = _mix(c[starts], 3)
    affix[:, 1] = _mix(two[starts], 4)
    affix[:, 2] = _mix(three[starts], 5)
    affix[:, 3] = _mix(c[last - 1], 6)
    affix[:, 4] = _mix(two[last - 2], 7)
    affix[:, 5] = _mix(three[np.maximum(last - 3, 0)], 8)
    affix[:, 6] = _mix(whole.astype(np.uint32), 9)
    per = 2 * (sizes + 1) + 7
    begin = np.cumsum(per) - per
    out = np.empty(int(per.sum()), np.uint32)
    out[ragged(begin, np.full(len(words), 7))] = affix.ravel()
    out[ragged(begin + 7, per - 7)] = grams.ravel()
    return out, begin, whole


def has_letter(words: list[bytes]) -> np.ndarray:
    """Whether each word holds a letter or any byte beyond ASCII."""
    text = np.frombuffer(b" ".join(words).lower() + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.logical_or.reduceat(((text >= 97) & (text <= 122)) | (text >= 128), np.cumsum(sizes) - sizes)


def members(model: Model, marks: np.ndarray) -> np.ndarray:
    """(words, languages): whose lexicon holds each word, by the words' hashes."""
    if not len(model.entries):
        return np.zeros((len(marks), len(model.languages)), np.float32)
    at = np.minimum(np.searchsorted(model.entries, marks), len(model.entries) - 1)
    return np.where((model.entries[at] == marks)[:, None], model.member[at], np.float32(0))


def emissions(model: Model, words: list[bytes], block: int = 1 << 15) -> np.ndarray:
    """exp of each word's scores less its highest one, which leaves all probabilities as they are and can't overflow.

    A score is the sum of the weights of hashed features, over the root of their number so that long words don't
    shout, and of the lexicons'.
    """
    out = np.zeros((len(words), len(model.languages)), np.float32)
    for i in range(0, len(words), block):
        feats, begin, marks = word_features(words[i : i + block])
        n = np.diff(np.append(begin, len(feats)))
        out[i : i + block] = members(model, marks) @ model.lexicon
        for k in range(out.shape[1]):
            out[i : i + block, k] += np.add.reduceat(model.weights[:, k][feats], begin) / np.sqrt(n)
    return np.exp(out - out.max(axis=1, keepdims=True)) if out.size else out


def forward_backward(e: np.ndarray, lengths: np.ndarray, start: np.ndarray, a: np.ndarray, messages: bool = False):
    """Word marginals (words, L) of many sequences laid end to end; ``e`` holds exp of the emission scores.

    With ``messages`` also the messages from the left, a word's own emission included, and from the right, each
    up to a factor a word.

    Sequences are cut into rows of ROW words that advance together. The rows of a longer one are first summed
    to L x L transfer matrices, from which the messages at the cuts follow; so a step never waits for a long
    document, and no text is cut short.
    """
    L = e.shape[1]
    n_rows = -(-lengths // ROW)
    first_row = np.cumsum(n_rows) - n_rows
    of = np.repeat(np.arange(len(lengths)), n_rows)
    nth = np.arange(len(of)) - first_row[of]
    row_start = (np.cumsum(lengths) - lengths)[of] + nth * ROW
    row_len = np.minimum(lengths[of] - nth * ROW, ROW)
    order = np.argsort(-row_len, kind="stable")
    rs, rl = row_start[order], row_len[order]
    steps = int(rl[0]) if len(rl) else 0
    alive = np.searchsorted(-rl, -np.arange(1, steps + 1), "right")  # rows with more than t words

    ones = np.ones((L, L), np.float32)

    def norm(x):
        return x / np.maximum(x @ ones, np.float32(1e-30))

    left = np.repeat(start[None].astype(np.float32), len(of), 0)  # message into each row, before its first emission
    right = np.ones((len(of), L), np.float32)  # message into each row from behind
    long = np.flatnonzero((n_rows > 1)[of])
    if len(long):
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_len = long[np.argsort(rank[long])]
        ls, ll = row_start[by_len], row_len[by_len]
        m = np.repeat(np.eye(L, dtype=np.float32)[None], len(by_len), 0)
        for t in range(int(ll[0])):
            k = int(np.searchsorted(-ll, -(t + 1), "right"))
            step = m[:k] if t == 0 else (m[:k].reshape(-1, L) @ a).reshape(k, L, L)
            step = step * e[ls[:k] + t][:, None, :]
            m[:k] = step / np.maximum((step.reshape(k, -1) @ np.ones(L * L, np.float32))[:, None, None], np.float32(1e-30))
        where = {int(r): i for i, r in enumerate(by_len)}
        for d in np.flatnonzero(n_rows > 1):
            r0, r1 = int(first_row[d]), int(first_row[d] + n_rows[d])
            for r in range(r0 + 1, r1):
                left[r] = norm((left[r - 1] @ m[where[r - 1]]) @ a)
            for r in range(r1 - 2, r0 - 1, -1):
                right[r] = norm(a @ (m[where[r + 1]] @ right[r + 1]))
    out = np.empty_like(e)
    msg = left[order]
    for t in range(steps):
        k = alive[t]
        now = norm((msg[:k] if t == 0 else msg[:k] @ a) * e[rs[:k] + t])
        out[rs[:k] + t] = now
        msg[:k] = now
    back = right[order]
    ahead, behind = (out.copy(), np.empty_like(e)) if messages else (None, None)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = rs[:k] + t
        b = back[:k]
        if messages:
            behind[at] = b
        out[at] = norm(out[at] * b)
        b = norm((e[at] * b) @ a.T)
        back[:k] = b
    return (out, ahead, behind) if messages else out


def expected(e: np.ndarray, lengths: np.ndarray, start: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and the expected number of each pair of neighbouring languages (L, L).

    A pair's probability is alpha_t(i) a(i, j) e_{t+1}(j) beta_{t+1}(j), normalised for each t.
    """
    marg, ahead, behind = forward_backward(e, lengths, start, a, True)
    inside = np.ones(len(e), bool)
    inside[np.cumsum(lengths[lengths > 0]) - 1] = False
    x = np.flatnonzero(inside)
    right = e[x + 1] * behind[x + 1]
    # a reduced to one product of matrices: the sum over t of ahead_t / z_t (outer) right_t, times a
    z = np.einsum("ti,ij,tj->t", ahead[x], a, right)
    return marg, ((ahead[x] / np.maximum(z, 1e-30)[:, None]).T @ right) * a


def lexicons(pieces: list[tuple[int, int, list[int]]], n_words: int, languages: int) -> np.ndarray:
    """(words, languages): a word is in a language's lexicon if two documents of it or more hold the word, so that
    no document alone decides on its own words, and if no other language's documents hold it thrice as often.

    ``pieces`` holds (language, document, word numbers).
    """
    seen = {(y, d, w) for y, d, ws in pieces for w in ws}
    count = np.zeros((n_words, languages), np.int32)
    for y, _, w in seen:
        count[w, y] += 1
    return ((count >= 2) & (3 * count >= count.max(axis=1, keepdims=True, initial=0))).astype(np.float32)


def train(sample: list[tuple[str, str]], rounds: int = 30, seed: int = 7) -> Model:
    """Fit by Adagrad on the likelihood's gradient: counts seen less counts expected by forward-backward.

    ``sample`` holds (language, text). Pieces of up to 24 words of documents of different languages are laid
    end to end, so that sequences switch and each word's language is known.
    """
    rng = np.random.RandomState(seed)
    languages = sorted({lang for lang, _ in sample})
    code = {lang: i for i, lang in enumerate(languages)}
    L = len(languages)
    if not L:
        none = np.zeros((0, 0), np.float32)
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), none[0:0].ravel(), none, np.zeros(0, np.uint64), none, none)
    ids = Index()
    pieces = []
    for d, (lang, text) in enumerate(sample):
        words = text.encode().split()
        pieces += [(code[lang], d, [ids[w] for w in words[i : i + 24]]) for i in range(0, len(words), 24)]
    words = list(ids)
    feats, begin, marks = word_features(words)
    per = np.diff(np.append(begin, len(feats)))
    member = lexicons(pieces, len(words), L)
    rng.shuffle(pieces)
    seqs = [pieces[i : i + 3] for i in range(0, len(pieces), 3)]
    w, lex = np.zeros((1 << TABLE_BITS, L), np.float32), np.zeros((L, L), np.float32)
    trans, first = np.zeros((L, L), np.float32), np.zeros(L, np.float32)
    squares = [np.full_like(p, 1e-3) for p in (w, lex, trans, first)]

    def climb(p: np.ndarray, k: int, grad: np.ndarray, rate: float) -> None:
        squares[k] += grad * grad
        p += rate * grad / np.sqrt(squares[k])

    batch = 512
    for _ in range(max(1, -(-rounds * batch // max(1, len(seqs))))) if seqs else ():
        for i in range(0, len(seqs), batch):
            part = seqs[i : i + batch]
            flat = np.array([x for s in part for _, _, p in s for x in p], np.int64)
            gold = np.array([y for s in part for y, _, p in s for _ in p], np.int64)
            lengths = np.array([sum(len(p) for _, _, p in s) for s in part], np.int64)
            uniq, inv = np.unique(flat, return_inverse=True)
            at = ragged(begin[uniq], per[uniq])
            f, bounds = feats[at], np.cumsum(per[uniq]) - per[uniq]
            scale = 1 / np.sqrt(per[uniq])
            score = np.add.reduceat(w[f], bounds, axis=0) * scale[:, None] + member[uniq] @ lex
            e = np.exp(score - score.max(axis=1, keepdims=True))[inv].astype(np.float32)
            marg, hope = expected(e, lengths, _probabilities(first), np.exp(trans))
            delta = -marg
            delta[np.arange(len(gold)), gold] += 1
            by_word = np.zeros((len(uniq), L), np.float32)
            np.add.at(by_word, inv, delta)
            grad = np.zeros_like(w)
            spread = np.repeat(by_word * scale[:, None], per[uniq], axis=0)
            for k in range(L):
                grad[:, k] = np.bincount(f, weights=spread[:, k], minlength=len(w))
            climb(w, 0, grad / len(part) - 1e-5 * w, 0.5)
            climb(lex, 1, member[uniq].T @ by_word / len(part) - 1e-4 * lex, 0.2)
            begins, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths) - 1
            inside = np.ones(len(gold), bool)
            inside[ends] = False
            x = np.flatnonzero(inside)
            seen = np.zeros((L, L), np.float32)
            np.add.at(seen, (gold[x], gold[x + 1]), 1)
            climb(trans, 2, (seen - hope) / len(part) - 1e-4 * trans, 0.2)
            climb(first, 3, delta[begins].sum(axis=0) / len(part) - 1e-4 * first, 0.2)
    known = member.any(axis=1)
    entries, at = np.unique(marks[known], return_index=True)
    return Model(languages, w, _probabilities(first), np.exp(trans).astype(np.float32), entries, member[known][at], lex)


def _probabilities(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(initial=-np.inf))
    return (p / p.sum()).astype(np.float32)


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 400) -> Model:
    """Train on at most ``sample_rows`` labelled documents of each language, those with the least hash of doc_id and text.

    Rows equal in doc_id and text count once. Rows without lang or text are left out; sampled texts are read whole. A table
    without labels, an empty one too, gives a model of no languages. Other columns are not read.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    nth = F.dense_rank().over(W.partitionBy("l").orderBy("h"))
    edge = known.select("l", "h").withColumn("n", nth).where(F.col("n") <= sample_rows).groupBy("l").agg(F.max("h").alias("edge")).collect()
    if not edge:
        return train([])
    pick = F.lit(False)
    for r in edge:
        pick = pick | ((F.col("l") == r["l"]) & (F.col("h") <= r["edge"]))
    rows = known.where(pick).dropDuplicates(["l", "h"]).collect()
    return train([(r["l"], r["t"]) for r in sorted(rows, key=lambda r: (r["l"], r["h"]))])


SCHEMA = "doc_id long, lang string, share double, certainty double, n_words int, spans array<struct<start:int,end:int,lang:string>>, rejected boolean"


class Reader:
    """Labels texts; the scores of words seen before are kept as far as memory allows."""

    def __init__(self, model: Model, least_certainty: float):
        self.model, self.least_certainty = model, least_certainty
        self.forget()

    def forget(self) -> None:
        self.ids, self.scores, self.lettered = Index(), np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, bool)

    def read(self, texts: list[bytes]) -> list[pa.Array]:
        """Columns lang, share, certainty, n_words, spans, rejected of SCHEMA."""
        if len(self.ids) > 1 << 18:
            self.forget()
        model, ids, n, known = self.model, self.ids, len(texts), len(self.ids)
        L, names = len(model.languages), pa.array(model.languages, pa.string())
        flat, sizes = [], np.zeros(n, np.int64)
        for i, t in enumerate(texts):
            words = t.split()
            sizes[i] = len(words)
            flat.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        lang, share, certainty = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        run_start = run_end = run_lang = np.zeros(0, np.int64)
        run_count = np.zeros(n, np.int64)
        if L and len(flat):
            if len(ids) > known:
                words = list(islice(ids, known, None))
                self.scores = np.concatenate([self.scores, emissions(model, words)])
                self.lettered = np.concatenate([self.lettered, has_letter(words)])
            some = np.flatnonzero(sizes)
            marg = forward_backward(self.scores[flat], sizes[some], model.start, model.transition)
            best, top = marg.argmax(axis=1), marg.max(axis=1)
            at = np.cumsum(sizes[some]) - sizes[some]
            counts = np.stack([np.add.reduceat((best == k).astype(np.int64), at) for k in range(L)], axis=1)
            lang[some] = counts.argmax(axis=1)
            share[some] = counts.max(axis=1) / sizes[some]
            real = self.lettered[flat]
            certainty[some] = np.add.reduceat(np.where(real, top, 0).astype(np.float64), at) / np.maximum(np.add.reduceat(real.astype(np.int64), at), 1)
            new = np.ones(len(best), bool)
            new[1:] = best[1:] != best[:-1]
            new[at] = True
            r = np.flatnonzero(new)
            doc = np.repeat(some, sizes[some])[r]
            offset = np.zeros(n, np.int64)
            offset[some] = at
            run_start, run_end, run_lang = r - offset[doc], np.append(r[1:], len(best)) - offset[doc], best[r]
            run_count = np.bincount(doc, minlength=n)
        none = (sizes == 0) | (L == 0)
        shown = names.take(pa.array(run_lang)) if len(run_lang) else pa.array([], pa.string())
        spans = pa.StructArray.from_arrays([pa.array(run_start, pa.int32()), pa.array(run_end, pa.int32()), shown], names=["start", "end", "lang"])
        return [
            names.take(pa.array(lang, mask=none)) if L else pa.nulls(n, pa.string()),
            pa.array(np.round(share, 6)), pa.array(np.round(certainty, 6)), pa.array(sizes, pa.int32()),
            list_array(spans, run_count), pa.array(none | (certainty < self.least_certainty)),
        ]


def label(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least_certainty: float = 0.45) -> DataFrame:
    """Label every word: doc_id, lang (of most words), share (of words in it), certainty, n_words, spans, rejected.

    ``spans`` are runs of words [start, end) of one language; certainty is the mean, over words with a
    letter, of the highest probability. A document is rejected if it has no such word or if its certainty is under
    ``least_certainty``: it is then in none of the languages. Null, empty and blank texts have n_words 0, null lang and are rejected.
    Equal counts go to the language first in order. Very long texts are labelled whole, in one chain. Repeated rows are
    each labelled; an empty table gives no rows, and a model without languages rejects every row. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(shared.value, least_certainty)
        for part in chunks(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column("d"), *reader.read(byte_strings(part.column("t")))], names=["doc_id", "lang", "share", "certainty", "n_words", "spans", "rejected"])

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)


def accepted(df: DataFrame, model: Model, text: str = "text", lang: str = "lang", least_certainty: float = 0.45) -> DataFrame:
    """The rows of ``df`` that ``label`` doesn't reject, ``lang`` set to the language found; no exchange.

    Null, empty and blank texts go; very long ones are read whole; repeated rows are each judged; ties go as in
    ``label``; an empty table, or a model without languages, gives no rows. Other columns pass unchanged, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(shared.value, least_certainty)
        for part in chunks(batches, text):
            found, _, _, _, _, rejected = reader.read(byte_strings(part.column(text)))
            cols = [found if name == lang else c for name, c in zip(part.schema.names, part.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(pc.invert(rejected))

    return df.mapInArrow(run, df.schema)
