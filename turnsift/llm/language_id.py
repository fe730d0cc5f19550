"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public vocabulary. A word (a
maximal run of letters, lower-cased, with the vocabulary's word mark in front) has the probability
of *all* its segmentations, summed by the forward algorithm; a text is the product over its words.
The language with the largest posterior under equal priors wins, its posterior is the score.

Training counts the pieces of all labelled training documents: words are counted per task, cut by
the vocabulary's own tokenizer, and the counts summed in Spark; what reaches the driver is at most
one number per language and piece. Nothing but the text and the label is used.

Contract: one row per input row. A null text or one without letters is ``und`` with score 0, and
so is everything if no document is labelled. Equal posteriors go to the smaller label. Training
documents are those with a non-null label and crc32(doc_id as text) mod 5 not 0; a row without
doc_id is neither trained on nor held out. A run of letters is one word however long it is; short
words are scored side by side, longer ones one by one in constant memory, with the same result.
Forward probabilities are rescaled before they underflow, however rare a piece is, and scores are
summed text by text. Extra columns are ignored by
``identify`` and kept by ``accepted``.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnsift.llm.texts import bounded_batches, mix, span_hashes, text_slices

UNKNOWN = "und"
PIECE_FILE = "piece_bpe_32k.model"
FOLDS = 5
SMOOTHING = 0.1
LEAST_SCORE = 0.5
#: Forward probabilities below this are rescaled (by powers of two, so nothing is rounded).
LEAST_FORWARD = 2.0**-300
#: Longer words are scored one by one.
ABREAST = 40
#: Letters of a long word whose pieces are looked up at once.
LOOKED_UP = 4096
#: Words whose probabilities a worker remembers, and words a task counts before it cuts them.
CACHED_WORDS = 300_000

_MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = regex.compile(r"\p{L}")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """The letter pieces of a vocabulary by number; number 0 stands for an unknown letter.

    Substrings are looked up by a 64-bit rolling hash in an open-addressed array, so that a
    column of substrings is one array operation. The array also holds the prefixes of pieces (as
    -1): beyond what is neither, no longer piece can start."""

    def __init__(self, path: str):
        model = tokenizer(path)
        self.number: dict[str, int] = {}
        #: Number of every piece of the tokenizer.
        self.of_id = np.zeros(model.get_piece_size(), np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            letters = piece.removeprefix(_MARK)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (not letters or letters.isalpha()):
                self.number[piece] = self.of_id[i] = len(self.number) + 1
        self.longest = max(map(len, self.number))
        entries = {piece[:n]: -1 for piece in self.number for n in range(1, len(piece))} | self.number
        self._mask = (1 << (2 * len(entries)).bit_length()) - 1
        self._hashes = np.zeros(self._mask + 1, np.uint64)
        self._numbers = np.zeros(self._mask + 1, np.int64)
        self._probes = 1
        value: dict[str, int] = {"": 0}
        for entry in sorted(entries, key=len):
            value[entry] = (value[entry[:-1]] * int(_STEP) + ord(entry[-1]) + 1) % (1 << 64)
        places = mix(np.array([value[entry] for entry in entries], np.uint64)) & np.uint64(self._mask)
        for (entry, number), at in zip(entries.items(), places.astype(np.int64).tolist()):
            probes = 1
            while self._numbers[at]:
                at, probes = (at + 1) & self._mask, probes + 1
            self._hashes[at], self._numbers[at] = value[entry], number
            self._probes = max(self._probes, probes)

    @staticmethod
    def longer(value: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Hashes of substrings with one more letter."""
        return value * _STEP + letters + np.uint64(1)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for prefixes, 0 for neither."""
        at = (mix(value) & np.uint64(self._mask)).astype(np.int64)
        found = np.where(self._hashes[at] == value, self._numbers[at], 0)
        left = np.flatnonzero((found == 0) & (self._numbers[at] != 0))
        for step in range(1, self._probes):
            if not len(left):
                break
            now = (at[left] + step) & self._mask
            found[left] = np.where(self._hashes[now] == value[left], self._numbers[now], 0)
            left = left[(found[left] == 0) & (self._numbers[now] != 0)]
        return found


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in _LETTERS.findall(every)]] = True
    return table


class Words:
    """The words of some texts as code points, in the order of the texts: maximal runs of letters,
    lower-cased."""

    def __init__(self, texts: list[str | None]):
        plain = [text.replace("\0", " ") if text else "" for text in texts]
        self.codes = np.frombuffer("\0".join(plain).lower().encode("utf-32-le"), np.uint32)
        inside = np.concatenate(([False], _letter_table()[self.codes], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        self.starts, self.sizes = starts, ends - starts
        self.hashes = span_hashes(self.codes, starts, ends)
        breaks = np.flatnonzero(self.codes == 0)
        self.rows = np.concatenate(([0], np.searchsorted(starts, breaks), [len(starts)]))

    def strings(self, chosen: np.ndarray) -> list[str]:
        sizes = self.sizes[chosen] + 1
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = self.codes[np.minimum(at + np.repeat(self.starts[chosen], sizes), len(self.codes) - 1)].copy()
        codes[np.cumsum(sizes) - 1] = 32
        return codes.tobytes().decode("utf-32-le").split(" ")[:-1]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


class Model:
    """Piece probabilities, one column per language."""

    def __init__(self, path: str, languages: list[str], counts: np.ndarray):
        self.path, self.languages = path, languages
        self.share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)

    def word_scores(self, words: Words, chosen: np.ndarray) -> np.ndarray:
        """Log probability of the chosen words in every language (forward algorithm)."""
        known = pieces(self.path)
        out = np.zeros((len(chosen), len(self.languages)))
        sizes = words.sizes[chosen]
        for k in np.flatnonzero(sizes > ABREAST):
            start = words.starts[chosen[k]]
            out[k] = self._long_word(words.codes[start : start + sizes[k]])
        for size in np.unique(sizes[sizes <= ABREAST]):
            members = np.flatnonzero(sizes == size)
            n = int(size) + 1
            for start in range(0, len(members), 8192):
                part = members[start : start + 8192]
                letters = np.full((n, len(part)), ord(_MARK), np.uint64)
                letters[1:] = words.codes[words.starts[chosen[part]] + np.arange(size)[:, None]]
                forward = np.zeros((n + 1, len(part), len(self.languages)))
                forward[0] = 1.0
                scale = np.zeros(forward.shape[1:], np.int64)  # powers of two taken out so far
                for a in range(n):
                    low = forward[a] < LEAST_FORWARD
                    if low.any():
                        power = np.where(low, np.frexp(forward[a])[1], 0)
                        reached = slice(a, a + known.longest + 1)
                        forward[reached] = np.ldexp(forward[reached], -power)
                        scale += power
                    live = np.arange(len(part))
                    value = np.zeros(len(part), np.uint64)
                    for b in range(a + 1, n + 1):
                        value = known.longer(value, letters[b - 1, live])
                        number = known.find(value)
                        if b == a + 1:  # an unknown letter still has a probability
                            forward[b] += forward[a] * self.share[np.maximum(number, 0)]
                        else:
                            hit = number > 0
                            at = live[hit]
                            forward[b][at] += forward[a][at] * self.share[number[hit]]
                        open_ = number != 0
                        live, value = live[open_], value[open_]
                        if not len(live):
                            break
                out[part] = np.log(forward[n]) + scale * np.log(2.0)
        return out


    def _long_word(self, codes: np.ndarray) -> np.ndarray:
        """The same for one word. Pieces of a stretch of letters are looked up together; the recursion
        keeps as many columns as a piece has letters, the newest first."""
        known, longest = pieces(self.path), pieces(self.path).longest
        letters = np.concatenate(([ord(_MARK)], codes)).astype(np.uint64)
        ring = np.zeros((longest, len(self.languages)))
        ring[0] = 1.0
        scale = np.zeros(len(self.languages), np.int64)
        for start in range(0, len(letters), LOOKED_UP):
            ends = np.arange(start, min(start + LOOKED_UP, len(letters)))
            first = max(0, start - longest + 1)
            # numbers[n - 1, e]: piece of n letters that ends with letter e
            numbers = np.zeros((longest, len(ends)), np.int64)
            begins = np.arange(first, ends[-1] + 1)
            value = np.zeros(len(begins), np.uint64)
            for n in range(1, longest + 1):
                inner = begins + n <= len(letters)
                begins, value = begins[inner], value[inner]
                value = known.longer(value, letters[begins + n - 1])
                number = known.find(value)
                here = (number > 0) & (begins + n - 1 >= start) & (begins + n - 1 <= ends[-1])
                numbers[n - 1, begins[here] + n - 1 - start] = number[here]
                begins, value = begins[number != 0], value[number != 0]
            for column in numbers.T:
                share = self.share[column]
                share[1:][column[1:] == 0] = 0.0  # only a single letter may be unknown
                now = (ring * share).sum(axis=0)
                ring[1:] = ring[:-1].copy()
                ring[0] = now
                low = now < LEAST_FORWARD
                if low.any():
                    power = np.where(low, np.frexp(now)[1], 0)
                    ring = np.ldexp(ring, -power)
                    scale += power
        return np.log(ring[0]) + scale * np.log(2.0)


class Scorer:
    """Text scores of a model, with a bounded memory of words already scored."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # ascending
        self.scores = np.zeros((0, len(self.model.languages)))

    def _scored(self, words: Words) -> np.ndarray:
        """Scores of all words."""
        distinct, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inner = at < len(self.hashes)
        new[inner] = self.hashes[at[inner]] != distinct[inner]
        scores = np.empty((len(distinct), len(self.model.languages)))
        scores[~new] = self.scores[at[~new]]
        scores[new] = self.model.word_scores(words, first[new])
        if len(self.hashes) > CACHED_WORDS:
            self._clear()
            self.hashes, self.scores = distinct, scores
        else:
            hashes = np.concatenate((self.hashes, distinct[new]))
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.scores = hashes[order], np.concatenate((self.scores, scores[new]))[order]
        return scores[back]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = Words(texts)
        if not len(self.model.languages) or not len(words.starts):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(words.rows))
        totals = np.stack([np.bincount(row, column, minlength=len(texts)) for column in self._scored(words).T], axis=1)
        best = totals.argmax(axis=1)
        scores = 1.0 / np.exp(totals - totals[np.arange(len(texts)), best][:, None]).sum(axis=1)
        lettered = np.diff(words.rows) > 0
        return (
            [self.model.languages[k] if some else UNKNOWN for k, some in zip(best, lettered)],
            np.where(lettered, scores, 0.0).tolist(),
        )


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None) -> Model:
    """A model of all rows with a non-null label."""
    path = path or public_tokenizers.path(PIECE_FILE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def cut() -> None:
            for language, counted in words.items():
                into = sums.setdefault(language, np.zeros(len(known.number) + 1, np.int64))
                ids = tokenizer(path).encode(list(counted), num_threads=1)
                times = np.repeat(list(counted.values()), [len(x) for x in ids]) if ids else []
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
                into += np.bincount(known.of_id[flat], times, minlength=len(into)).astype(np.int64)
            words.clear()

        for batch in batches:
            for part in text_slices(batch):
                found = Words(part.column("text").to_pylist())
                languages, code = np.unique(part.column("lang").to_numpy(zero_copy_only=False), return_inverse=True)
                code = np.repeat(code, np.diff(found.rows))
                for k, language in enumerate(languages):
                    own = np.flatnonzero(code == k)
                    _, first, times = np.unique(found.hashes[own], return_index=True, return_counts=True)
                    into = words.setdefault(str(language), Counter())
                    for word, n in zip(found.strings(own[first]), times.tolist()):
                        into[word] += n
                if sum(map(len, words.values())) > CACHED_WORDS:
                    cut()
        cut()
        for language, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(into[at])],
                ["lang", "piece", "n"],
            )

    rows = (
        bounded_batches(labelled).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .filter("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(count, "lang string, piece int, n long")
        .groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        .toArrow()  # at most one row per language and piece
    )
    languages = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(pieces(path).number) + 1, len(languages)))
    column = {language: i for i, language in enumerate(languages)}
    for language, piece, n in zip(*(c.to_pylist() for c in rows.columns)):
        counts[piece, column[language]] = n
    return Model(path, languages, counts)


def train_on_fold(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out(F.col("doc_id"))))


def _predicted(model, keep: list[str], least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for part in text_slices(batch):
                languages, scores = scorer.predict(part.column("text").to_pylist())
                if least is not None:
                    good = [lang != UNKNOWN and score >= least for lang, score in zip(languages, scores)]
                    yield part.filter(pa.array(good, pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(n) for n in keep), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                        [*keep, "lang_pred", "score"],
                    )

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train_on_fold(docs))
    narrow = bounded_batches(docs).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return narrow.mapInArrow(
        _predicted(shared, ["doc_id", "held_out"], None),
        "doc_id long, held_out boolean, lang_pred string, score double",
    )


def accepted(docs: DataFrame, model: Model | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text is in a known language with at least that score, columns as given."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train_on_fold(docs))
    return bounded_batches(docs).mapInArrow(_predicted(shared, [], least), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
