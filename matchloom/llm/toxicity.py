"""Toxicity: two class-conditional Kneser-Ney models of words, compared by the length-normalised log-likelihoods of a whole text.

A word is a run of letters and their marks, lower-cased, of any length; in scripts written without blanks, two letters, one word beginning at each letter.
Spark counts, by class, in how many labelled texts each word is found (Kneser-Ney counts contexts, not occurrences, so no single text can teach a word
by repeating it).  Each class keeps what its count has beyond a discount and passes the rest on to the counts that both classes share:

    p(word | class) = max(n_class - d, 0) / N_class + left_class * n_both / N_both

where ``left_class`` is the discounted share of the class's counts, so that the probabilities of all counted words sum to one.  The discount is
``ALONE`` plus what the class would have of the word if it held it ``OFTEN`` times as often as the other class does.  So a rare word and one that
both classes use about alike are judged by the shared counts under both models, which differ by ``left`` only (one constant, the base), and the
size of a class or of a language in it lends no evidence.  A word that no labelled text has is taken as such a word.

The measures of a text are the mean over all of its words of log p(word | toxic) - log p(word | ordinary), and the highest such mean over ``PASSAGE``
words in a row (over the text, if it is shorter), both less the base.  The score is a logistic function of the two, fitted on at most ``SAMPLE``
documents of one fold with counts of the other three; then the counts of all four folds make the final models.

Counts grow with the labelled texts and stay in Spark.  Scoring needs the words beyond their discount only, as all others have the base exactly.  Up to
``BROADCAST_ROWS`` of them (16 bytes each) are broadcast; beyond that, the words of the texts are joined to them.  Both ways give the same scores.
Words are equal if 64-bit hashes of all their code points are.

Edge cases: a null or empty text, and one without letters, measures nothing over the base; a text of any length is read whole; without labels of both kinds
every score is 0; if the calibration fold or the other three have one kind only, a text's mean must be a tenth over the base for a score of one half; a null
``doc_id`` is scored and not held out; repeated rows are scored alike and, in ``labels``, count as their mean; other columns of any name are kept by
``without_toxic`` and else not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, remembered, split_of
from .labels import sample, targets, with_targets
from .words import Lanes, chunks

ALONE = 1.0
OFTEN = 4.0
PASSAGE = 32
SAMPLE = 4000
CALIBRATION_FOLD = 1
THRESHOLD = 0.5
BROADCAST_ROWS = 1_000_000
HELD = 1_000_000
SLICE = 1 << 17
#: Names of columns that are unlike any of the input.
EVIDENCE = ("__evidence_0", "__evidence_1")
KEYS = ("__text_1", "__text_2")
COUNTS = ("ordinary", "toxic", "ordinary_held", "toxic_held")


def letters() -> np.ndarray:
    """0 for code points that are no letters or marks, 1 for those that are, 2 for letters of scripts written without blanks."""
    kind = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x30000)], np.uint8)
    for a, b in ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)):
        kind[a:b] *= 2
    return kind


_LETTERS: list[np.ndarray] = []


def letter_kinds() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(letters())
    return _LETTERS[0]


class Words:
    """The words in some texts: which text each is of, where it starts and stops in their code points, and its hash."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        # a line end after each text parts it from the next
        offsets = np.cumsum([0, *(len(t) + 1 for t in low)])
        points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letter_kinds()[np.minimum(points, 0x2FFFF)]
        edge, end = kind > 0, kind > 0
        edge[1:] &= kind[1:] != kind[:-1]
        end[:-1] &= kind[1:] != kind[:-1]
        # every letter of a script without blanks begins a word of two, but for the last of several
        self.start = np.nonzero(edge | ((kind == 2) & ~end))[0]
        run = np.nonzero(end)[0] + 1
        stop = run[np.cumsum(edge)[self.start] - 1]
        self.stop = np.where(kind[self.start] == 2, np.minimum(self.start + 2, stop), stop)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = np.zeros(len(self.start), np.uint64)
        for a in range(0, len(self.start), SLICE):
            start, stop = self.start[a : a + SLICE], self.stop[a : a + SLICE]
            data = points[start[0] : stop[-1]].view(np.uint8)
            self.hash[a : a + SLICE] = Lanes(data, 4 * (start - start[0]), 4 * (stop - start[0])).hashes()


def count_words(docs: DataFrame) -> DataFrame:
    """h and, by class and by whether the fold is the calibration's (``COUNTS``), the number of texts in (text, y, fold) that have the word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y, fold = batch.column("text").to_pylist(), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            group = y + 2 * (fold == CALIBRATION_FOLD)
            for i, j in chunks(np.concatenate(([0], np.cumsum([len(t or "") for t in texts]))), HELD):
                words = Words(texts[i:j])
                distinct, number = np.unique(words.hash, return_inverse=True)
                if len(distinct):
                    once = np.unique(words.row * len(distinct) + number)
                    of, number = group[i:j][once // len(distinct)], once % len(distinct)
                    counts = [pa.array(np.bincount(number[of == g], minlength=len(distinct)).astype(np.int64)) for g in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *counts], ["h", *COUNTS])

    rows = docs.select("text", "y", "fold").transform(mapped, counted, "h long, " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.groupBy("h").agg(*(F.sum(c).alias(c) for c in COUNTS))


def ratios(counts: DataFrame) -> tuple[DataFrame, float] | None:
    """From (h, ordinary, toxic): h and ratio of the words beyond their discount, and the base, the ratio of all others; None if a class has no words."""
    classes = ("ordinary", "toxic")
    sizes = counts.agg(*(F.sum(c) for c in classes)).first()
    if not sizes[0] or not sizes[1]:
        return None
    whole = float(sizes[0] + sizes[1])
    both = F.col("ordinary") + F.col("toxic")
    discount = [F.lit(ALONE) + both * (OFTEN * n / (OFTEN * n + whole - n)) for n in sizes]
    taken = counts.agg(*(F.sum(F.least(F.col(c), d)) for c, d in zip(classes, discount, strict=True))).first()
    left = [float(d) / n for d, n in zip(taken, sizes, strict=True)]
    beyond = [F.greatest(F.col(c) - d, F.lit(0.0)) for c, d in zip(classes, discount, strict=True)]
    p = [b / float(n) + both * (part / whole) for b, n, part in zip(beyond, sizes, left, strict=True)]
    return counts.where((beyond[0] > 0) | (beyond[1] > 0)).select("h", F.log(p[1] / p[0]).alias("ratio")), float(np.log(left[1] / left[0]))


class Model:
    """Ratios over the base, and the logistic function of the measures.

    ``rows`` is the frame of (h, over); ``table`` has them as arrays in order of hash if they are few enough to be sent to every task, else None.
    """

    def __init__(self, found: tuple[DataFrame, float] | None, most: int = BROADCAST_ROWS):
        self.table, self.rows = (np.zeros(0, np.uint64), np.zeros(0)), None
        self.slope, self.shift = np.zeros(2), -50.0
        if found is not None:
            self.rows = cut(found[0].select("h", (F.col("ratio") - found[1]).alias("over")))
            self.slope, self.shift = np.array([40.0, 0.0]), -4.0
            got = self.rows.limit(most + 1).toPandas()
            self.table = None
            if len(got) <= most:
                h = got["h"].to_numpy(np.int64).view(np.uint64)
                order = np.argsort(h)
                self.table = (h[order], got["over"].to_numpy(float)[order])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton steps on the logistic loss with a small ridge."""
        if not len(y) or y.min() == y.max():
            return
        scale = np.maximum(x.std(0), 1e-9)
        a = np.concatenate((x / scale, np.ones((len(x), 1))), 1)
        ridge = np.array([0.1, 0.1, 1e-3])
        w = np.zeros(3)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
            w -= np.clip(np.linalg.solve(h, a.T @ (p - y) + ridge * w), -3, 3)
        self.slope, self.shift = w[:2] / scale, float(w[2])

    def logit(self) -> Column:
        z = sum((F.col(c) * F.lit(float(w)) for c, w in zip(EVIDENCE, self.slope, strict=True)), F.lit(self.shift))
        return F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))


def measures(over: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of texts of so many words each, whose log ratios over the base follow one another: their mean, and the highest mean of a passage."""
    out = np.zeros((len(size), 2))
    first = np.concatenate(([0], np.cumsum(size)))
    total = np.concatenate(([0.0], np.cumsum(over)))
    filled = np.nonzero(size)[0]
    if len(filled):
        out[filled, 0] = (total[first[filled + 1]] - total[first[filled]]) / size[filled]
        # passages begin where a whole one fits, and at the text's start
        length = np.repeat(np.minimum(size[filled], PASSAGE), size[filled])
        begin = np.arange(len(over))
        last = np.repeat(first[filled + 1], size[filled])
        mean = np.where(begin + length <= last, total[np.minimum(begin + length, last)] - total[begin], -np.inf) / length
        out[filled, 1] = np.maximum.reduceat(mean, first[filled])
    return out


def evidence(table: tuple, texts: list[str | None]) -> np.ndarray:
    """The measures of each text."""
    words = Words(texts)
    over = np.zeros(len(words.hash))
    if len(table[0]):
        at = np.minimum(np.searchsorted(table[0], words.hash), len(table[0]) - 1)
        over = np.where(table[0][at] == words.hash, table[1][at], 0.0)
    return measures(over, np.bincount(words.row, minlength=len(texts)))


def evidence_rows(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns and the measures of every text."""
    if model.table is None:
        return joined_evidence(docs, model, *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model.table)
    types = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity", tuple)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.zeros((batch.num_rows, 2))
            for a, b in chunks(np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))):
                x[a:b] = evidence(shared.value, texts[a:b])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c) for c in x.T.copy())], [*keep, *EVIDENCE])

    return docs.select(*keep, *(["text"] if "text" not in keep else [])).transform(mapped, run, ", ".join(f"`{c}` {types[c]}" for c in keep) + "".join(f", {c} double" for c in EVIDENCE))


def joined_evidence(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """As ``evidence_rows``, for ratios that are too many to broadcast: the words of the texts meet them in a join, and what one text has comes back together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, k1, k2 = batch.column("text").to_pylist(), batch.column(KEYS[0]).to_numpy(), batch.column(KEYS[1]).to_numpy()
            for i, j in chunks(np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))):
                words = Words(texts[i:j])
                row = words.row
                columns = (k1[i:j][row], k2[i:j][row], np.bincount(row, minlength=j - i)[row], np.arange(len(row)) - np.searchsorted(row, row), words.hash.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "words", "number", "h"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number, over = batch.column("words").to_numpy(), batch.column("number"), batch.column("over")
            x = np.zeros((batch.num_rows, 2))
            for a, b in chunks(np.concatenate(([0], np.cumsum(size)))):
                first = np.cumsum(size[a:b]) - size[a:b]
                lengths = number[a:b].value_lengths().to_numpy()
                dense = np.zeros(int(size[a:b].sum()))
                dense[np.repeat(first, lengths) + number[a:b].flatten().to_numpy()] = over[a:b].flatten().to_numpy()
                x[a:b] = measures(dense, size[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("__k1"), batch.column("__k2"), *(pa.array(c) for c in x.T.copy())], ["__k1", "__k2", *EVIDENCE])

    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({KEYS[0]: F.xxhash64(text), KEYS[1]: F.xxhash64(F.lit(1), text)})
    distinct = keyed.select(*KEYS, "text").dropDuplicates(list(KEYS))
    rows = distinct.transform(mapped, run, "k1 long, k2 long, words long, number long, h long")
    met = rows.join(model.rows, "h").groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.first("words").alias("words"), F.collect_list(F.struct("number", "over")).alias("met"))
    lists = met.select("__k1", "__k2", "words", F.col("met.number").alias("number"), F.col("met.over").alias("over"))
    of = lists.transform(mapped, measured, "__k1 long, __k2 long" + "".join(f", {c} double" for c in EVIDENCE))
    out = keyed.join(of, (F.col(KEYS[0]) == F.col("__k1")) & (F.col(KEYS[1]) == F.col("__k2")), "left")
    return out.select(*(F.col(f"`{c}`") for c in keep), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in EVIDENCE))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = SAMPLE, broadcast: int = BROADCAST_ROWS) -> Model:
    """Counts over every labelled document outside fold 0; the logistic function is fitted with the counts of three folds on the labels of the fourth."""
    known = targets(labels, target).select("doc_id", "y", "fold")
    docs = docs.select("doc_id", "text")
    counts = cut(count_words(with_targets(docs, known)))
    model = Model(ratios(counts.select("h", *((F.col(c) + F.col(f"{c}_held")).alias(c) for c in COUNTS[:2]))), broadcast)
    three = ratios(counts.select("h", *COUNTS[:2])) if model.rows is not None else None
    if three is not None:
        held = with_targets(docs, sample(known.where(F.col("fold") == CALIBRATION_FOLD).select("doc_id", "y"), most))
        got = evidence_rows(held, Model(three, broadcast), "doc_id", "y").collect()
        x, y = np.array([[r[c] for c in EVIDENCE] for r in got]).reshape(-1, 2), np.array([r.y for r in got], np.float64)
        model.calibrate(x, y)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    fold = F.coalesce(split_of() == 0, F.lit(False)).alias("held_out")
    rows = evidence_rows(docs.select("doc_id", "text", fold), model, "doc_id", "held_out")
    return rows.select("doc_id", "held_out", (1 / (1 + F.exp(-model.logit()))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns; the model learns from these documents."""
    model = train(docs, labels, broadcast=broadcast)
    cutoff = float(np.log(threshold / (1 - threshold)))
    return evidence_rows(docs, model, *docs.columns).where(model.logit() < cutoff).select(*docs.columns)
