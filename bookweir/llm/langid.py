"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.llm.work import begin, bounds, map_texts, once, quoted

#: Buckets of the hashed n-grams (so the model has languages x buckets numbers, whatever the corpus is).
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams (one row per order), the text of each place, and letters per text.

    Letters are lower-cased; any stretch of other characters is one space, as is the edge of a text.
    """
    known = once("letters", _letters)
    lowered = [(t or "").lower() + " " for t in texts.to_pylist()]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    is_letter = known[codes]
    text = np.repeat(np.arange(len(lowered)), lengths)
    counts = np.bincount(text[is_letter], minlength=len(lowered))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes = np.where(is_letter, codes, np.uint32(32))[keep]
    text = text[keep]
    # A gram ends at its place; what lies before the text's start is a space.
    out, total = np.empty((len(ORDERS), len(codes)), np.int64), np.zeros(len(codes), np.uint32)
    starts = np.searchsorted(text, np.arange(len(lowered)))
    for k in range(max(ORDERS)):
        back = np.full(len(codes), 32, np.uint32)
        back[k:] = codes[: len(codes) - k]
        for j in range(k):
            first = starts + j
            back[first[first < len(codes)]] = 32
        total = total + (back + np.uint32(k + 1)) * _FACTORS[k]
        out[k] = ((total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)
    return out, text, counts


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log-probabilities (bucket x language), from every labelled row.

    Each task counts its rows into one array per language; the arrays are summed by
    Spark, so the driver gets one number per language and bucket.
    """
    inputs = docs.select(F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang"))
    inputs = inputs.filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches):
        begin("letters")
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for lo, hi in bounds(lengths, 1 << 20):
                grams, text, letters = ngrams(texts.slice(lo, hi - lo))
                names = sorted(set(langs[lo:hi]))
                of_text = np.array([names.index(x) for x in langs[lo:hi]])
                of_place = of_text[text]
                for i, name in enumerate(names):
                    sums = found.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    for row in grams:
                        sums[:BUCKETS] += np.bincount(row[of_place == i], minlength=BUCKETS)
                    sums[BUCKETS] += np.count_nonzero((of_text == i) & (letters > 0))
        for name, sums in found.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array(used), pa.array(sums[used])], names=["lang", "bucket", "n"]
            )

    counts = inputs.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()
    names = sorted(table["lang"].unique())
    matrix = np.zeros((BUCKETS + 1, len(names)))
    matrix[table["bucket"].to_numpy(), [names.index(x) for x in table["lang"]]] = table["n"]
    grams, rows = matrix[:BUCKETS] + SMOOTHING, matrix[BUCKETS] + SMOOTHING
    return names, np.vstack([np.log(grams / grams.sum(axis=0)), np.log(rows / rows.sum())])


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Each row (struct `row` of the columns in `keep`, all by default) and `out`: lang_pred and score.

    The score is the posterior of the best language. Null texts and texts without a
    letter, and all texts of a model without languages, are `und` with score 0; repeated
    rows get the same answer; an empty table gives an empty result.
    """
    names, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def work(texts: pa.Array) -> list:
        names, matrix = sent.value
        if not names:
            return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
        grams, text, letters = ngrams(texts)
        total = np.tile(matrix[BUCKETS], (len(texts), 1))
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        present = text[starts]
        for row in grams:
            if len(row):
                total[present] += np.add.reduceat(matrix[row], starts, axis=0)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        said = [names[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist())]
        return [pa.array(said, pa.string()), pa.array(np.where(letters > 0, score, 0.0))]

    return map_texts(docs, text_col, "lang_pred string, score double", work, keep, limit=1 << 20, kept="letters")


def is_held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 when divided by 4 (null id: not)."""
    ident = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    return F.crc32(ident.cast("binary")) % 4 == 2


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; learnt from the rows that aren't held out."""
    model = train(docs.filter(~is_held_out(id_col)), text_col, lang_col)
    found = identify(docs, model, text_col, keep=[id_col]).select(F.col("row")[id_col].alias(id_col), "out.*")
    return found.select(id_col, is_held_out(id_col).alias("held_out"), "lang_pred", "score")
