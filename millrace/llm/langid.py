"""Language identification as mixture inference.

A text is a bag of byte trigrams of its lower-cased letters, drawn from a mixture of language models. For each
document, expectation-maximisation estimates the proportions of a set of languages; the set grows from the best
single language while a further one raises the likelihood by more than a penalty that grows with the logarithm of the
number of trigrams. The predicted language is the one with the largest proportion, which is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare
from .textkit import BLOCK_BYTES

#: Labelled rows to fit on, about, for each language (a seeded sample of rows, so that copies of a text count like others); all
#: rows of rarer languages.
FIT_ROWS = 3000
MAX_LANGUAGES = 4096
#: The model's size, which is what reaches the driver and each worker: its trigrams are the most frequent of the fitted rows,
#: MAX_GRAMS at most and LEAST_GRAMS at least, with MAX_CELLS for trigrams times languages in between; all others are one.
MAX_GRAMS, LEAST_GRAMS, MAX_CELLS = 30_000, 4_000, 2_000_000
#: A trigram shares two of its three characters with its neighbours: likelihood gains count a third.
OVERLAP = 3.0

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, codes, bounds) of consecutive texts, a few megabytes at a time: the codes of text i of the block lie at
    bounds[i]:bounds[i + 1]. Anything but letters counts as one space; texts begin and end with a space."""
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    texts = pc.binary_join_element_wise(space, pc.utf8_lower(texts.cast(pa.large_string())).fill_null(""), space, none)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1))
        x = _LETTERS[data[offsets[a] : offsets[b]]]
        space = x == 0x20
        keep = ~(space[:-1] & space[1:])
        x = x.astype(np.int32)
        codes = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        ok = np.flatnonzero(keep[:-1] & keep[1:])  # two spaces in a row also separate the texts
        yield a, b, codes[ok], np.searchsorted(ok, offsets[a : b + 1] - offsets[a])
        a = b


class Model:
    """Trigram probabilities of each language; index 0 stands for all trigrams outside the model."""

    def __init__(self, languages: list[str], codes: np.ndarray, counts: np.ndarray, totals: np.ndarray, penalty: float):
        self.languages, self.codes, self.penalty = languages, codes, penalty
        rest = np.maximum(totals - counts.sum(0), 0) + 1.0
        smooth = np.vstack([rest, counts + 0.5])
        self.p = smooth / smooth.sum(0)
        self.log_p = np.log(self.p)
        self._index: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}  # the index is rebuilt in each worker rather than sent

    def index(self) -> np.ndarray:
        if self._index is None:
            self._index = np.zeros(1 << 24, np.int16)
            self._index[self.codes] = np.arange(1, len(self.codes) + 1)
        return self._index

    def forget(self) -> None:
        """Give the index's memory back: workers live on after their task."""
        self._index = None

    def mixture(self, codes: np.ndarray) -> dict[int, float]:
        """Proportions of the languages selected for a text."""
        c = np.bincount(self.index()[codes], minlength=len(self.codes) + 1)
        at = np.flatnonzero(c)
        c, p, n = c[at].astype(float), self.p[at], float(len(codes))
        best = int(np.argmax(c @ self.log_p[at]))
        chosen, share = [best], np.ones(1)
        if n == 0:
            return {best: 1.0}
        threshold = self.penalty * np.log(n + 1) * OVERLAP
        while len(chosen) < len(self.languages):
            mix = p[:, chosen] @ share
            slope = (c / mix) @ p / n  # over 1 where more of a language raises the likelihood
            slope[chosen] = 0
            new = int(np.argmax(slope))
            if n * (slope[new] - 1) <= threshold:  # the likelihood is concave: it can't rise by more
                break
            trial = [*chosen, new]
            q, w = p[:, trial], np.append(share * 0.9, 0.1)
            for _ in range(60):
                old, w = w, w * ((c / (q @ w)) @ q) / n
                if np.abs(w - old).max() < 1e-4:
                    break
            if c @ (np.log(q @ w) - np.log(mix)) <= threshold:
                break
            chosen, share = trial, w
        return dict(zip(chosen, (share / share.sum()).tolist()))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, penalty: float = 3.0) -> Model | None:
    """The model of a table of texts with languages; None where no row has both.

    Fits on all rows of languages with up to ``fit_rows`` rows, and on a seeded sample of about that many of the others. The text and the language
    are all that is read.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, fit_rows / sizes[k]))]), F.col("lang"))
    sample = rows.filter(F.rand(17) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in np.unique(langs):
                for _, _, codes, _ in trigrams(batch.column(1).filter(pa.array(langs == lang))):
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    counts = Table(sample.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "langid-counts")
    n_grams = min(MAX_GRAMS, max(LEAST_GRAMS, MAX_CELLS // len(languages)))
    top = counts.df.groupBy("code").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "code").limit(n_grams)
    codes = np.array(sorted(r[0] for r in top.select("code").collect()), np.int64)
    totals = {r[0]: r[1] for r in counts.df.groupBy("lang").agg(F.sum("n")).collect()}
    least = counts.df.join(F.broadcast(spark.createDataFrame([(int(c),) for c in codes], "code int")), "code").toArrow()  # at most MAX_CELLS rows
    table = np.zeros((len(codes), len(languages)))
    where = {k: i for i, k in enumerate(languages)}
    for lang, code, n in zip(least["lang"].to_pylist(), least["code"].to_numpy(), least["n"].to_numpy()):
        table[np.searchsorted(codes, code), where[lang]] += n
    counts.drop()
    return Model(languages, codes, table, np.array([float(totals.get(k, 0)) for k in languages]), penalty)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred``, ``score`` and ``mixture`` (language -> proportion).

    ``und`` with score 0 and an empty mixture for null texts, texts without letters, and without a model. Whole texts
    are read, however long. Ties go to the language first by name.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"))
    schema = rows.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "mixture": F.create_map(F.lit(""), F.lit(0.0))}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            text = batch.column(0)
            letters = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_pylist()
            pred, score, mixture = ["und"] * len(text), [0.0] * len(text), [[]] * len(text)
            for a, b, codes, bound in trigrams(text) if m is not None else ():
                for i in range(a, b):
                    if letters[i]:
                        found = m.mixture(codes[bound[i - a] : bound[i - a + 1]])
                        k = max(found, key=lambda x: (found[x], -x))
                        pred[i], score[i] = m.languages[k], min(1.0, found[k])
                        mixture[i] = [(m.languages[x], v) for x, v in sorted(found.items())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64()))],
                names=["_keep", "lang_pred", "score", "mixture"])
        if m is not None:
            m.forget()

    return rows.mapInArrow(predict, schema).select("_keep.*", "lang_pred", "score", "mixture")
