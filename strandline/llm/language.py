"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_batches

#: The longest piece, in characters, and the longest word that is scored in plain rather than in log space.
PIECE, PLAIN = 12, 40
#: Numbers that the sums of words of one length may hold at a time, for each of their characters.
CELLS = 1 << 15
#: Words whose scores a worker remembers for each model; then it starts afresh.
REMEMBERED = 600_000
START = "▁"
#: What only separates words.
STOPS = ".,;:!?|\"()"

_pieces: dict[str, dict[str, int]] = {}
_scorers: dict[str, Scorer] = {}


def vocabulary(model: str) -> dict[str, int]:
    """Pieces of a fixed public vocabulary, with their numbers, and -1 for what only begins one. model: a path, or the name
    of a public tokenizer."""
    if model not in _pieces:
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model if os.path.isabs(model) else public_tokenizers.path(model))
        known = {x: i for i in range(p.get_piece_size()) if len(x := p.id_to_piece(i)) <= PIECE}
        _pieces[model] = {x[:k]: -1 for x in known for k in range(1, len(x))} | known
    return _pieces[model]


def words_of(text: str) -> list[str]:
    text = text.lower()
    for c in STOPS:
        text = text.replace(c, " ")
    return text.split()


def edges_of(word: str, pieces: dict[str, int]) -> list[tuple[int, int, int]]:
    """(from, to, piece): the pieces found in a word with its start mark. A character that is no piece is the first of its
    byte pieces, which all languages share alike."""
    out, n, get = [], len(word), pieces.get
    for i in range(n):
        found = False
        for j in range(i + 1, n + 1):
            p = get(word[i:j])
            if p is None:
                break
            if p >= 0:
                out.append((i, j, p))
                found = found or j == i + 1
        if not found:
            out.append((i, i + 1, get(f"<0x{word[i].encode('utf-8', 'replace')[0]:02X}>", 0)))
    return out


BASE = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Pieces by the hash of their characters, for many substrings at a time."""

    def __init__(self, pieces: dict[str, int]):
        self.tables = {}
        for k in range(1, PIECE + 1):
            some = [(x, p) for x, p in pieces.items() if p >= 0 and len(x) == k]
            hashes = np.zeros(len(some), np.uint64)
            for c in np.array([[ord(y) for y in x] for x, _ in some], np.uint64).reshape(len(some), k).T:
                hashes = hashes * BASE + c + np.uint64(1)
            order = np.argsort(hashes)
            self.tables[k] = hashes[order], np.array([p for _, p in some], np.int64)[order]
        self.bytes = np.array([pieces.get(f"<0x{b:02X}>", 0) for b in range(256)])

    def find(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the pieces of k characters with these hashes, -1 for none."""
        keys, numbers = self.tables[k]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, numbers[at], -1)

    def first_byte(self, c: np.ndarray) -> np.ndarray:
        """The byte piece of the first byte of each character."""
        return self.bytes[np.select([c < 0x80, c < 0x800, c < 0x10000], [c, 0xC0 | (c >> 6), 0xE0 | (c >> 12)], 0xF0 | (c >> 18)).astype(np.int64) & 255]


_lookups: dict[int, Lookup] = {}


def lattices(words: list[str], pieces: dict[str, int], most: int = 8192) -> Iterator[tuple[int, list[int], dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]]:
    """Up to `most` words of one length at a time: (length, their places, {(from, to): (which of them, pieces)}), as edges_of() has them."""
    if id(pieces) not in _lookups:
        _lookups[id(pieces)] = Lookup(pieces)
    lookup = _lookups[id(pieces)]
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, places in by_length.items():
        for at in range(0, len(places), most):
            some = places[at : at + most]
            chars = np.empty((n + 1, len(some)), np.uint64)
            chars[0] = ord(START)
            if n:
                chars[1:] = np.array([words[k] for k in some], f"<U{n}").view(np.uint32).reshape(len(some), n).T
            arcs = {}
            for i in range(n + 1):
                hashes = np.zeros(len(some), np.uint64)
                for j in range(i + 1, min(n + 1, i + PIECE) + 1):
                    hashes = hashes * BASE + chars[j - 1] + np.uint64(1)
                    p = lookup.find(hashes, j - i)
                    if j == i + 1:
                        p = np.where(p >= 0, p, lookup.first_byte(chars[i]))
                    rows = np.flatnonzero(p >= 0)
                    if len(rows):
                        arcs[i, j] = rows, p[rows]
            yield n + 1, some, arcs


def stretch(logs: np.ndarray) -> float:
    """What each character adds to a log probability while words of fewer than PLAIN characters are summed in plain space.

    Half of the least log of a piece, turned round: sums of n characters then lie within exp(+-n * stretch), whatever the
    pieces, so that they neither vanish nor overflow. All ways to cut a word have all its characters, so the factor is the same.
    """
    return -float(logs.min()) / 2


def forward(n: int, rows: int, arcs: dict, prob: np.ndarray, factor: float = 1.0) -> np.ndarray:
    """alpha[j]: the sum over all segmentations of the first j characters, times factor ** j; rows x languages."""
    alpha = np.zeros((n + 1, rows, prob.shape[1]))
    alpha[0] = 1
    for j in range(1, n + 1):
        for i in range(max(0, j - PIECE), j):
            if (i, j) in arcs:
                r, p = arcs[i, j]
                alpha[j, r] += alpha[i, r] * (prob[p] * factor ** (j - i))
    return alpha


def expected(words: list[str], counts: np.ndarray, pieces: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words of one language; prob: one column."""
    out = np.zeros(len(prob))
    factor = float(np.exp(stretch(np.log(prob))))
    for n, places, arcs in lattices(words, pieces):
        alpha = forward(n, len(places), arcs, prob, factor)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[n] = 1
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + PIECE) + 1):
                if (i, j) in arcs:
                    r, p = arcs[i, j]
                    beta[i, r] += beta[j, r] * (prob[p, 0] * factor ** (j - i))
        for (i, j), (r, p) in arcs.items():
            part = alpha[i, r] * (prob[p, 0] * factor ** (j - i)) * beta[j, r] / alpha[n, r]
            out += np.bincount(p, part * counts[places][r], minlength=len(out))
    return out


def long_word(word: str, pieces: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """The same sum in log space, for words of any length."""
    word = START + word
    ahead: dict[int, list[tuple[int, int]]] = {}
    alpha = {0: np.zeros(logs.shape[1])}
    for at in range(len(word)):
        for _, j, p in edges_of(word[at : at + PIECE], pieces):
            if _ == 0:
                ahead.setdefault(at + j, []).append((at, p))
        into = ahead.pop(at + 1)
        alpha[at + 1] = np.logaddexp.reduce([alpha[i] + logs[p] for i, p in into], axis=0)
        alpha.pop(at + 1 - PIECE - 1, None)
    return alpha[len(word)]


class Scorer:
    """Log probabilities of words in each language, remembered."""

    def __init__(self, pieces: dict[str, int], logs: np.ndarray):
        self.pieces, self.logs, self.prob, self.stretch = pieces, logs, np.exp(logs), stretch(logs)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, logs.shape[1]))

    def learn(self, words: set[str]) -> None:
        if len(self.place) > REMEMBERED:
            self.place, self.scores = {}, self.scores[:0]
        new = list(words.difference(self.place))
        scores = np.zeros((len(new), self.logs.shape[1]))
        short = [k for k, w in enumerate(new) if len(w) < PLAIN]
        factor, most = float(np.exp(self.stretch)), max(64, CELLS // self.logs.shape[1])
        for n, places, arcs in lattices([new[k] for k in short], self.pieces, most):
            scores[[short[k] for k in places]] = np.log(forward(n, len(places), arcs, self.prob, factor)[n]) - n * self.stretch
        for k, w in enumerate(new):
            if len(w) >= PLAIN:
                scores[k] = long_word(w, self.pieces, self.logs)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, scores])

    def of(self, texts: list[str]) -> np.ndarray:
        """texts x languages; the words of many texts are learned at once."""
        out = np.zeros((len(texts), self.logs.shape[1]))
        at = 0
        while at < len(texts):
            some, held = [], 0
            while at + len(some) < len(texts) and held < 1 << 18:
                some.append(words_of(texts[at + len(some)]))
                held += len(some[-1])
            self.learn({w for words in some for w in words})
            for k, words in enumerate(some):
                out[at + k] = self.scores[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0)
            at += len(some)
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            seen: Counter = Counter()
            for text in texts:
                seen.update(words_of(text))
            # Long words, as of languages without spaces, are learned from in pieces.
            for word in [w for w in seen if len(w) >= PLAIN]:
                n = seen.pop(word)
                for at in range(0, len(word), PLAIN - 1):
                    seen[word[at : at + PLAIN - 1]] += n
            yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})


def _expect(model: str, langs: list[str], probs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = vocabulary(model)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                c = expected(rows["word"].tolist(), rows["n"].to_numpy(float), pieces, probs.value[:, [langs.index(lang)]])
                some = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "piece": some, "n": c[some]})

    return run


def fit(docs: DataFrame, *, model: str, sample: int, rounds: int, floor: float = 0.05) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, log probabilities of pieces x languages, log shares), by expectation maximisation; None without labels.

    docs: (doc_id, text, lang). About `sample` texts of each language are used, those with the least hashes. What comes to
    the driver has one number per piece of the fixed vocabulary and language.
    """
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    total = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return None
    langs = sorted(total)
    limit = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / total[k]))]), F.col("lang"))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit * (1 << 30)).select("lang", "text")
    words = chosen.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = durable(words)
    size = max(vocabulary(model).values()) + 1
    prob = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(prob)
        found = words.mapInPandas(_expect(model, langs, shared), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts = np.full((size, len(langs)), floor)
        for r in found.collect():
            counts[r["piece"], langs.index(r["lang"])] += r["n"]
        prob = counts / counts.sum(axis=0)
    n = np.array([total[k] for k in langs], float)
    return langs, np.log(prob), np.log(n / n.sum())


def identify(docs: DataFrame, *, model: str = "piece_bpe_32k.model", sample: int = 1500, rounds: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang).

    A text's probability in a language is the product over its words of the sum, over all ways to cut the word into pieces
    of the vocabulary, of the pieces' probabilities. score is the posterior of the best language; ties go to the first
    by name. Languages are learned from about `sample` labelled texts each that are not held out; lang serves for that alone. Words are
    cut at white space and ASCII stops; of a word of 40 characters or more, as in languages without spaces, consecutive parts are learned
    from, while it is scored whole. Pieces of more than 12 characters are left out. Very long texts are scored whole, by logs of their words.

    Texts that are null or have no letter, and all texts if nothing is labelled, are 'und' with score 0. Rows without doc_id
    are not held out and nothing is learned from them. Repeated rows are rows like any other, and an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    fitted = fit(docs.select("doc_id", "text", "lang"), model=model, sample=sample, rounds=rounds)
    if fitted is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    langs, logs, share = fitted
    shared = docs.sparkSession.sparkContext.broadcast((langs, logs, share))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        names, table, prior = shared.value
        key = f"{model}:{hash(table.tobytes())}"
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(vocabulary(model), table)
        letter = regex.compile(r"\p{L}")
        for texts in batches:
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if t and letter.search(t)]
            if some:
                total = _scorers[key].of([texts.iloc[k] for k in some]) + prior
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang[some] = np.array(names, object)[best]
                score[some] = 1 / odds
            yield pd.DataFrame({"lang": lang, "score": score})

    return rows.withColumn("p", predict("text")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
