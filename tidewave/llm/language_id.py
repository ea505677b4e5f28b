"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A forward pass sums the probabilities of all
segmentations of a word into pieces; a text's score is the sum of the logs over its words, and its posterior follows.
Piece probabilities are fitted by expectation maximisation over all segmentations of the training words.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import chunks, small_batches, value_hashes
from tidewave.llm.vocabulary import MARK, PIECES, Trie, pieces

#: About so many different texts of each language are drawn by their hash for training; fewer: all.
DOCS_PER_LANGUAGE = 800
ROUNDS = 4
#: Each piece counts as if seen so often in all of a language, by its share over all languages.
PRIOR = 50.0
UNKNOWN = 1e-7
#: A constant factor for each letter keeps the sums of long words within a double's range.
GROWTH = 12.0
#: Words of more letters are summed by themselves, with the sums scaled anew on the way.
LONG = 200
#: No piece is longer; the sums of so many places are carried on.
REACH = 64
#: Each language is a column of the model and of its tables; more are an error.
MOST_LANGUAGES = 1000
WORDS_AT_ONCE = 8_000
CELLS = 300_000


class Alphabet:
    """Codes of letters: 0 for what is no letter, 1 for a letter that no piece has, 2 for the start of a word."""

    def __init__(self, texts: list[str]):
        joined = {c for p in texts if len(p) > 1 for c in p}
        letters = sorted({c for p in texts for c in p if c != MARK}, key=lambda c: (c not in joined, c))
        self.codes = {MARK: 2} | {c: i + 3 for i, c in enumerate(letters)}
        self.size = len(letters) + 3
        #: Letters that occur in longer pieces have codes below this.
        self.joined = 3 + len(joined - {MARK})

    @functools.cached_property
    def table(self) -> np.ndarray:
        out = np.zeros(sys.maxunicode + 1, np.uint16)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                out[cp] = self.codes.get(c.lower() if len(c.lower()) == 1 else c, 1)
        return out


class Lattice:
    """All occurrences of pieces in some words, ordered so that one pass over the offsets sums all segmentations."""

    def __init__(self, trie: Trie, codes: np.ndarray, length: np.ndarray):
        """codes: the words one after another, each with its start mark; length counts the mark."""
        self.n = len(length)
        first = np.cumsum(length) - length
        word = np.repeat(np.arange(self.n), length)
        offset = np.arange(len(codes)) - first[word]
        start, size, piece = trie.edges(codes, length[word] - offset)
        lone = np.flatnonzero(codes == 1)
        start, size, piece = np.r_[start, lone], np.r_[size, np.ones(len(lone), np.int64)], np.r_[piece, np.full(len(lone), -1)]
        # a place for each code and one for the end of each word
        self.begin = first + np.arange(self.n)
        self.final = self.begin + length
        w = word[start]
        till = offset[start] + size
        order = np.argsort(till * (len(codes) + self.n + 1) + start + w + size)
        self.start, self.end, self.piece, self.word = (start + w)[order], (start + w + size)[order], piece[order], w[order]
        till = till[order]
        self.steps = np.searchsorted(till, np.arange(1, int(length.max(initial=0)) + 2))
        self.places = len(codes) + self.n
        self.size = size[order]
        self.weight = GROWTH**self.size

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: (pieces + 1, languages), the last row for unknown letters. Sums for every place, times GROWTH for each code."""
        alpha = np.zeros((self.places, p.shape[1]))
        alpha[self.begin] = 1
        for a, b in zip(self.steps[:-1].tolist(), self.steps[1:].tolist(), strict=True):
            if b > a:
                end = self.end[a:b]
                cut = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
                alpha[end[cut]] = np.add.reduceat(alpha[self.start[a:b]] * p[self.piece[a:b]] * self.weight[a:b, None], cut, axis=0)
        return alpha

    def expected(self, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each seen so many times. p has one column."""
        alpha, beta = self.forward(p)[:, 0], np.zeros(self.places)
        beta[self.final] = 1
        gain = p[self.piece, 0] * self.weight
        for a, b in zip(self.steps[-2::-1].tolist(), self.steps[:0:-1].tolist(), strict=True):
            np.add.at(beta, self.start[a:b], beta[self.end[a:b]] * gain[a:b])
        use = alpha[self.start] * gain * beta[self.end] * (count / np.maximum(alpha[self.final], 1e-300))[self.word]
        known = self.piece >= 0
        return np.bincount(self.piece[known], use[known], len(p) - 1)


class Scorer:
    """The tables of a vocabulary. The trie is made on first use and not sent along."""

    def __init__(self, vocabulary: list[str]):
        if max(map(len, vocabulary), default=0) > REACH:
            raise ValueError(f"pieces of over {REACH} letters aren't summed rightly")
        self.alphabet = Alphabet(vocabulary)
        self.vocabulary = vocabulary

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trie"}

    @functools.cached_property
    def trie(self) -> Trie:
        return Trie.of([[self.alphabet.codes[c] for c in p] for p in self.vocabulary], self.alphabet.joined, self.alphabet.size)

    @functools.cached_property
    def _values(self) -> np.ndarray:
        return np.random.default_rng(5).integers(0, 2**63, self.alphabet.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes of the distinct words with marks, their lengths, which distinct word each word is, text of each word)."""
        joined = "\n".join(t or "" for t in texts.to_pylist())
        code = self.alphabet.table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(code)
        letter = code > 0
        start = np.flatnonzero(letter & np.r_[True, ~letter[:-1]][:n])
        end = np.flatnonzero(letter & np.r_[~letter[1:], True][:n]) + 1
        lengths = np.array([len(t or "") + 1 for t in texts.to_pylist()], np.int64)
        doc = np.searchsorted(np.cumsum(lengths), start, side="right")
        h = value_hashes(self._values[code], start, end)
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        size = end[at] - start[at] + 1
        first = np.cumsum(size) - size
        out = np.full(int(size.sum()), 2, np.uint16)
        word = np.repeat(np.arange(len(at)), size)
        inner = np.arange(len(out)) - first[word]
        body = inner > 0
        out[body] = code[start[at][word[body]] + inner[body] - 1]
        return out, size, which, doc

    def logs(self, codes: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(words, languages): the log of the summed probability of each word."""
        out = np.zeros((len(size), p.shape[1]))
        first = np.cumsum(size) - size
        long = size > LONG + 1
        for k in np.flatnonzero(long).tolist():
            out[k] = self.long_logs(codes[first[k] : first[k] + size[k]], p)
        if long.any():
            out[~long] = self.logs(codes[np.repeat(~long, size)], size[~long], p)
            return out
        block = (first * p.shape[1]) // CELLS
        cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(size)] if len(size) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = Lattice(self.trie, codes[first[a] : first[b - 1] + size[b - 1]], size[a:b])
            out[a:b] = np.log(np.maximum(x.forward(p)[x.final], 1e-300)) - size[a:b, None] * np.log(GROWTH)
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of what may stand in one word; -1 is the piece of an unknown letter."""
        start, size, piece = self.trie.edges(codes, len(codes) - np.arange(len(codes)))
        lone = np.flatnonzero(codes == 1)
        return np.r_[start, lone], np.r_[size, np.ones(len(lone), np.int64)], np.r_[piece, np.full(len(lone), -1)]

    def long_logs(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The same of one word of any length, place by place."""
        start, size, piece = self.edges(codes)
        return _long_sums(start, start + size, p[piece] * GROWTH ** size[:, None], len(codes))[-1] - len(codes) * np.log(GROWTH)

    def long_expected(self, codes: np.ndarray, p: np.ndarray, count: float) -> np.ndarray:
        """Expected uses of each piece over all segmentations of one word of any length, seen so many times."""
        start, size, piece = self.edges(codes)
        n, gain = len(codes), p[piece] * GROWTH ** size[:, None]
        ahead = _long_sums(start, start + size, gain, n)
        behind = _long_sums(n - start - size, n - start, gain, n)[::-1]
        with np.errstate(under="ignore"):
            use = count * np.exp(ahead[start] + np.log(gain) + behind[start + size] - ahead[-1])[:, 0]
        known = piece >= 0
        return np.bincount(piece[known], use[known], len(p) - 1)


def _long_sums(start: np.ndarray, end: np.ndarray, gain: np.ndarray, n: int) -> np.ndarray:
    """(n + 1, languages): the log of the sum over all ways from place 0 to each place of the product of gains on the way.

    After each REACH places the last ones, which is as far as a piece goes, are divided by the largest sum among them.
    """
    order = np.argsort(end, kind="stable")
    start, gain = start[order], gain[order]
    cuts = np.searchsorted(end[order], np.arange(1, n + 2)).tolist()
    alpha, scale, at = np.zeros((n + 1, gain.shape[1])), np.zeros(gain.shape[1]), np.zeros((n + 1, gain.shape[1]))
    alpha[0] = 1
    for to in range(1, n + 1):
        a, b = cuts[to - 1], cuts[to]
        if b > a:
            alpha[to] = (alpha[start[a:b]] * gain[a:b]).sum(axis=0)
        at[to] = scale
        if to % REACH == 0:
            last = slice(max(0, to - REACH), to + 1)
            top = np.maximum(alpha[last].max(axis=0), 1e-300)
            alpha[last] /= top
            scale = scale + np.log(top)
            at[last] = scale
    return np.log(np.maximum(alpha, 1e-300)) + at


def letter_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the mark of a word's start, lower-cased; the mark and all letters alone."""
    found = {p.lower() for p, _ in pieces(path) if p.lstrip(MARK).isalpha() and p.count(MARK) == p.startswith(MARK) and len(p.lower()) == len(p)}
    return sorted(found | {MARK} | {c for p in found for c in p})


@functools.lru_cache(maxsize=2)
def scorer(path: str) -> Scorer:
    """The tables of the vocabulary at path, made once in the driver."""
    out = Scorer(letter_pieces(path))
    out.alphabet.table  # noqa: B018
    return out


class Model:
    """scorer, the languages, and a probability for each piece and language.

    A Python worker keeps the object, and so the trie, from task to task as long as its broadcast is in use.
    """

    def __init__(self, scorer_: Scorer, languages: list[str], p: np.ndarray):
        self.scorer, self.languages, self.p = scorer_, languages, p

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        s = self.scorer
        codes, size, which, doc = s.words(texts)
        n, k = len(texts), len(self.languages)
        if not k:
            return ["und"] * n, [0.0] * n
        logs = s.logs(codes, size, self.p)
        total = np.stack([np.bincount(doc, logs[which, j], n) for j in range(k)], axis=1)
        some = np.bincount(doc, minlength=n) > 0
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, share, 0.0).tolist()


def train(labelled: DataFrame, path: str = PIECES, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """labelled (text, lang), nulls left out. The model holds one number for each piece and language.

    Of each language about docs_per_language different texts are drawn by their hash, all if there are fewer; copies of a
    text count once. Words of any length are learned from whole. Other columns are ignored. No labelled text: a model of no
    language; over MOST_LANGUAGES values of lang: an error.
    """
    spark = small_batches(labelled.sparkSession)
    labelled = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    tables = scorer(path)
    n_pieces, languages = len(tables.vocabulary), sorted(sizes)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MOST_LANGUAGES} are learned at once")
    if not languages:
        return Model(tables, [], np.zeros((n_pieces + 1, 0)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))])
    drawn = labelled.where(F.pmod("h", F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003).dropDuplicates(["lang", "h"])
    shared = spark.sparkContext.broadcast(tables)

    def count(batches):
        for b in chunks(batches, "text"):
            langs = b.column("lang").to_pylist()
            codes, size, which, doc = shared.value.words(b.column("text"))
            first = np.cumsum(size) - size
            lang = np.array([languages.index(x) for x in langs])
            pair, n = np.unique(which * len(languages) + lang[doc], return_counts=True)
            word = pair // len(languages)
            yield pa.RecordBatch.from_pydict({"lang": [languages[x] for x in (pair % len(languages)).tolist()], "word": [codes[first[w] : first[w] + size[w]].tobytes() for w in word.tolist()], "n": n})

    def fit(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        trie = shared.value.trie
        too_long = pdf.word.str.len() > 2 * (LONG + 1)
        long, long_seen = [np.frombuffer(w, np.uint16) for w in pdf.word[too_long]], pdf.n[too_long].tolist()
        pdf = pdf[~too_long]
        seen, p, uses = pdf.n.to_numpy().astype(float), np.full((n_pieces + 1, 1), UNKNOWN), None
        for k in range(ROUNDS + 1):
            if k:
                p[:-1, 0] = (uses + 1e-3) / (uses.sum() + 1e-3 * n_pieces)
            uses = np.zeros(n_pieces)
            for w, n in zip(long, long_seen, strict=True):
                if k:
                    uses += shared.value.long_expected(w, p, n)
                else:
                    piece = shared.value.edges(w)[2]
                    uses += np.bincount(piece[piece >= 0], minlength=n_pieces) * n
            for at in range(0, len(pdf), WORDS_AT_ONCE):
                part = pdf.word.iloc[at : at + WORDS_AT_ONCE]
                x = Lattice(trie, np.frombuffer(b"".join(part), np.uint16), np.array([len(w) // 2 for w in part]))
                n = seen[at : at + WORDS_AT_ONCE]
                known = x.piece >= 0
                uses += x.expected(p, n) if k else np.bincount(x.piece[known], weights=n[x.word][known], minlength=n_pieces)
        some = np.flatnonzero(uses > 1e-6)
        return pd.DataFrame({"lang": key_[0], "piece": some, "uses": uses[some]})

    counted = drawn.select("text", "lang").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = counted.groupBy("lang").applyInPandas(fit, "lang string, piece long, uses double").toPandas()
    uses = np.zeros((n_pieces, len(languages)))
    uses[fitted.piece.to_numpy(np.int64), [languages.index(x) for x in fitted.lang]] = fitted.uses
    total = np.maximum(uses.sum(axis=0), 1e-9)
    common = (uses / total).mean(axis=1) + 1e-9
    common /= common.sum()
    p = (uses + PRIOR * common[:, None]) / (total + PRIOR)
    return Model(tables, languages, np.concatenate([p, np.full((1, len(languages)), UNKNOWN)]))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns keep of docs (all by default), and lang_pred and lang_score, or names, of the whole text.

    `und` and 0 if the text is null or has no letter, or if no language was learned; equal scores go to the first name.
    Only text is looked at. Every row comes back once, repeated rows as often as they are there. A column of keep that
    bears one of the names gives way to the result; choose other names to have both.
    """
    small_batches(docs.sparkSession)
    taken = {n.lower() for n in names}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    m = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias(names[0]))
    schema = source.select(*keep, names[0], F.lit(0.0).alias(names[1])).schema

    def run(batches):
        for b in chunks(batches, names[0]):
            best, score = m.value.predict(b.column(names[0]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
