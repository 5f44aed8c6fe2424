"""Reading level of each text: smoothed unigram language models, one per level.

The models are trained on rated texts.  A level's model holds the share of each word (and of
commas and semicolons, which tell nested sentences from plain ones) in the running prose of its
texts; a text gets the level whose model, weighted by how common the level is, makes its prose
most likely.  Words of all languages share the models, so the language column is not needed.

Running prose is what is left of a text without listings and markup: tags, headings, tables, hex
dumps, log lines, paths and rule bodies are taken out line by line.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
#: Rated texts used for training at most; taken by a hash of the id, so by no order of the data.
MAX_TRAINING_TEXTS = 20_000

_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>|&[a-z]{2,8};|&#\d{1,7};")
_FENCE = re.compile(r"^(?:```|~~~)")
_LISTING = re.compile(
    r"^(?:[|#{}\[\]$%>\\]"  # tables, headings, brackets, prompts
    r"|\d{1,2}:\d{2}(?::\d{2})?\b|\d{4}-\d{2}-\d{2}[T ]\d{2}:|\[?\d{4}/\d{2}/\d{2}"  # log lines
    r"|(?:0x)?[0-9a-fA-F]{6,16}:?\s"  # hex dumps
    r"|(?:/|[A-Za-z]:\\|\.{1,2}/)\S*$|\S+$"  # paths and lone words
    r"|(?:rule|private rule|import|include|meta|strings|condition)\b[^.]*[{:\"]"  # rule bodies
    r"|[-=_*+~.]{3,}$)"
)
_BULLET = re.compile(r"^(?:[-*+•–]|\d{1,3}[.)]|[a-z]\))\s+")
_WORD = re.compile(r"[^\W\d_]+|[,;]")
_ENDS = (".", "!", "?", ";", "…", '."', ".)", ".»", ".“", "!”", "?”", ".”")
#: A line without a full stop and fewer words than this is a heading, not prose.
HEADING_WORDS = 5
#: A line of which less than this share of characters belongs to words is a listing.
WORD_SHARE = 0.5


def prose_words(text: str | None) -> list[str]:
    """The words, commas and semicolons of a text's running prose, in lower case."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    words: list[str] = []
    fenced = False
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or _LISTING.match(line):
            continue
        bullet = _BULLET.match(line)
        if bullet:
            line = line[bullet.end() :]
        found = _WORD.findall(line.lower())
        if not bullet and len(found) < HEADING_WORDS and not line.endswith(_ENDS):
            continue
        if sum(map(len, found)) < WORD_SHARE * (len(line) - line.count(" ")):
            continue
        words += found
    return words


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of each level, once per task: the counts of a text go to all its ratings' levels."""
    counts: list[Counter] = [Counter() for _ in range(LEVELS)]
    texts = [0.0] * LEVELS
    for batch in batches:
        for text, ratings in zip(batch.column("text").to_pylist(), batch.column("ratings").to_pylist()):
            words = Counter(prose_words(text))
            if not words:
                continue
            for level in ratings:
                texts[level - 1] += 1 / len(ratings)
                for word, n in words.items():
                    counts[level - 1][word] += n / len(ratings)
    rows = [(level + 1, word, n) for level, c in enumerate(counts) for word, n in c.items()]
    rows += [(level + 1, "", n) for level, n in enumerate(texts) if n]  # the empty word holds the texts
    if rows:
        levels, words_, ns = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(words_, pa.string()), pa.array(ns, pa.float64())], names=["level", "word", "n"])


class ReadingModel:
    """Log-probabilities of words per level; unknown words carry no evidence."""

    def __init__(self, words: dict[str, np.ndarray], prior: np.ndarray) -> None:
        self.words, self.prior = words, prior

    @classmethod
    def fit(cls, counts: list[tuple[int, str, float]], smoothing: float = 0.5) -> ReadingModel:
        texts = np.zeros(LEVELS)
        by_word: dict[str, np.ndarray] = {}
        for level, word, n in counts:
            if word:
                by_word.setdefault(word, np.zeros(LEVELS))[level - 1] += n
            else:
                texts[level - 1] += n
        total = sum(by_word.values(), np.zeros(LEVELS)) + smoothing * max(1, len(by_word))
        words = {w: np.log((c + smoothing) / total) for w, c in by_word.items()}
        prior = np.log((texts + smoothing) / (texts.sum() + LEVELS * smoothing))
        return cls(words, prior)

    def scores(self, words: list[str]) -> np.ndarray | None:
        """Log posterior of each level up to a constant; None without any prose."""
        if not any(w not in ",;" for w in words):
            return None
        total = self.prior.copy()
        for word, n in Counter(words).items():
            p = self.words.get(word)
            if p is not None:
                total += n * p
        return total


def train(documents: DataFrame, labels: DataFrame, max_texts: int = MAX_TRAINING_TEXTS, smoothing: float = 0.5, seed: str = "reading") -> ReadingModel:
    """Fit the models on at most ``max_texts`` rated documents.

    A rater counts once per document; ratings outside 1..5 and null ratings are left out.  Which
    documents are used follows from a hash of their ids.  The sample bounds the rows that are
    broadcast (ids and ratings) and the vocabulary that comes to the driver.
    """
    rated = labels.filter(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, LEVELS))
    rated = rated.select("doc_id", "rater", F.col("reading_level").cast("int").alias("level")).distinct()
    rated = rated.groupBy("doc_id").agg(F.array_sort(F.collect_list("level")).alias("ratings"))
    # The exact top by hash: each task keeps its own first max_texts, and these are merged.
    sample = rated.withColumn("h", F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))).orderBy("h", "doc_id").limit(max_texts).drop("h")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "ratings")
    counts = texts.mapInArrow(_train_counts, "level int, word string, n double").groupBy("level", "word").agg(F.sum("n").alias("n"))
    return ReadingModel.fit(sorted(tuple(r) for r in counts.collect()), smoothing)


def _score(model_words: list[str], table: bytes, prior: list[float]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(table, dtype=np.float64).reshape(-1, LEVELS) if model_words else np.zeros((0, LEVELS))
        index = {w: i for i, w in enumerate(model_words)}
        start = np.array(prior)
        for batch in batches:
            levels, margins, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                words = prose_words(text)
                n_words = len(words) - words.count(",") - words.count(";")
                sizes.append(n_words)
                if not n_words:
                    levels.append(None)
                    margins.append(None)
                    continue
                ids = [i for w in words if (i := index.get(w)) is not None]
                total = start + np.bincount(ids, minlength=len(rows)) @ rows if ids else start
                best = int(total.argmax())
                levels.append(best + 1)
                post = np.exp(total - total[best])
                margins.append(float(post[3:].sum() / post.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(levels, pa.int32()), pa.array(margins, pa.float64())], names=["doc_id", "prose_words", "reading_level", "p_demanding"])

    return score


def reading_levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """Level of each document: ``doc_id, prose_words, reading_level, p_demanding``.

    ``p_demanding`` is the posterior of levels 4 and 5 together.  Defined cases: a text without
    running prose (null, empty, headings or listings only) has 0 words and a null level; ties go
    to the lower level; repeated rows come out as often as they come; a text of any length is
    read whole.  Only ``doc_id`` and ``text`` are read.
    """
    words = sorted(model.words)
    table = np.array([model.words[w] for w in words]).tobytes() if words else b""
    scored = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored.mapInArrow(_score(words, table, model.prior.tolist()), "doc_id bigint, prose_words int, reading_level int, p_demanding double")
