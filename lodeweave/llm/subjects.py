"""Problem 8: subject areas of documents, by complement naive Bayes, expectation-maximization and calibration.

A word's weight for a subject is the log of its rate in all text over its rate in the complement, the
text of the other subjects. The first weights come from labelled documents; each round then scores the
sentences of all documents, takes a document's sentence shares as its subjects, and counts anew, first
by documents, at last by sentences. A document's share of sentences on a subject becomes an independent
posterior per subject, calibrated on the labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Size of the model: words are hashed into so many cells, of which 0 stands for no word.
CELLS = 1 << 16
#: Labelled documents used at most, the first by hash; the model is fitted on them, all documents are scored.
MAX_LABELLED = 50_000
TOKEN = re.compile(r"[^\W_]+|[.!?](?=\s)|[。！？｡]|[\r\n]+")
#: Runs of signs that are written without blanks (Thai to Khmer, kana, Han characters); each two that follow each other count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
#: Letters of a word's stem. Related languages share so much of their cognates; longer endings would part them.
STEM = 6
#: Pseudo-counts of the first count, over labelled documents, and of those over all; and the weights below which a word is noise there.
PRIOR, TAU = (2.0, 20.0), (0.8, 0.5)
#: Shares of sentences from which a document counts for a subject in a round over documents, and fully.
GIVEN = (0.05, 0.12)
#: Evidence a sentence needs in the first round and later, and how sharply it decides.
FIRST, LATER, SHARP = 0.8, 1.1, 4.0
#: Rounds end when the weights change by no more than this part of their sum. Where labels are few, more rounds drift away from them.
STILL = 0.1
#: Pseudo-cases, and where they hold the slope, the threshold and the share of labels that are missing of a subject that has few.
PSEUDO, SLOPE, THRESHOLD, MISSING = 20.0, 40.0, 0.175, 0.1
#: Subjects at most; their weights are the model's size.
MAX_SUBJECTS = 1000


class Cells(dict):
    """Cell of a word's stem: its first STEM letters, without accents, case and a plural s; -1 ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        if not (word[0].isalnum()):
            cell = -1
        else:
            low = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
            if len(low) > 3 and low.endswith("s") and not low.endswith("ss"):
                low = low[:-1]
            cell = 0 if low.isdigit() or not low else 1 + zlib.crc32(low[:STEM].encode()) % (CELLS - 1)
        self[word] = cell
        return cell


def tokens(text: str) -> list[str]:
    """Words and ends of sentences of a text; a run without blanks gives its pairs of neighbouring signs."""
    if not text.isascii() and UNSPACED.search(text):
        text = UNSPACED.sub(lambda m: f" {' '.join(map(''.join, zip(m[0], m[0][1:]))) or m[0]} ", text)
    return TOKEN.findall(text)


def _features():
    def run(batches):
        cells = Cells()
        for batch in batches:
            ids = [list(map(cells.__getitem__, tokens(t))) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2)], ["id", "cells", "marks"])

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by group, from 0 to n - 1; groups stand in order."""
    out = np.zeros((n, values.shape[1]))
    if len(group):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out[group[first]] = np.add.reduceat(values, first, axis=0)
    return out


def sentence_scores(flat: np.ndarray, doc: np.ndarray, docs: int, weights: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(share, p, sentence, home): shares of subjects per document, posteriors per sentence, the sentence of
    each word and the document of each sentence. The shares of a first look are the prior of the second."""
    k = weights.shape[1]
    starts = np.r_[True, (doc[1:] != doc[:-1]) | (flat[:-1] == -1)] if len(flat) else np.zeros(0, bool)
    sentence = np.cumsum(starts) - 1
    n = int(sentence[-1]) + 1 if len(flat) else 0
    home = doc[starts]
    worded = np.bincount(sentence[flat > 0], minlength=n) > 0
    known = np.flatnonzero((flat > 0) & weights.any(axis=1)[flat])
    score = _sums(weights[flat[known]], sentence[known], n)
    told = score > 0
    size = np.maximum(np.bincount(home[worded], minlength=docs), 1)[:, None]
    prior = 0.0
    for _ in range(2):
        z = np.concatenate([SHARP * score + prior, np.full((n, 1), SHARP * need)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True)) if n else z
        p /= p.sum(axis=1, keepdims=True)
        share = _sums(p[worded, :k], home[worded], docs) / size
        prior = np.where(told, np.log((0.15 + share[home]) / 0.25), 0.0)
    return share, p[:, :k], sentence, home


def _counts(kind: str, model, need: float, k: int):
    """Sufficient statistics of a task's documents: (cell, n, by subject); cell -1 holds the totals."""
    def run(batches):
        weights = model.value if model else None
        n, by, total, mass = np.zeros(CELLS), np.zeros((CELLS, k)), 0.0, np.zeros(k)
        for batch in batches:
            docs = batch.num_rows
            flat, doc = _lists(batch.column(0))
            marks = np.zeros((docs, k))
            m, row = _lists(batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1))
            marks[row[m >= 0], m[m >= 0]] = 1
            labelled = np.bincount(row, minlength=docs) > 0
            if kind == "labels":
                word = flat > 0
                pair = np.unique(doc[word].astype(np.int64) * CELLS + flat[word])
                of, cell = pair // CELLS, pair % CELLS
                n += np.bincount(cell, minlength=CELLS)
                for c in range(k):
                    by[:, c] += np.bincount(cell, weights=marks[of, c], minlength=CELLS)
                total, mass = total + docs, mass + marks.sum(axis=0)
                continue
            share, p, sentence, home = sentence_scores(flat, doc, docs, weights, need)
            if kind == "documents":
                given = np.maximum(np.clip((share - GIVEN[0]) / (GIVEN[1] - GIVEN[0]), 0, 1), marks)
                used = (given.max(axis=1) >= 0.5) | labelled
                row_weight, rows = given, doc
                word = (flat > 0) & used[doc]
            else:
                doubt = np.where(labelled[home, None] & (marks[home] == 0), 0.05, 1.0)
                row_weight, rows = p * doubt, sentence
                word = flat > 0
            cells, rows = flat[word], rows[word]
            n += np.bincount(cells, minlength=CELLS)
            total += len(cells)
            for c in range(k):
                some = np.flatnonzero((row_weight[:, c] > 1e-3)[rows])
                w = row_weight[rows[some], c]
                by[:, c] += np.bincount(cells[some], weights=w, minlength=CELLS)
                mass[c] += w.sum()
        at = np.flatnonzero(n)
        rows = np.concatenate([by[at], mass[None]])
        cell = np.append(at, -1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * k), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.append(n[at], total)), lists], ["cell", "n", "by"])

    return run


def complement_weights(n: np.ndarray, by: np.ndarray, total: float, mass: np.ndarray, prior: float, noise: float) -> np.ndarray:
    """log(rate of a word) - log(its rate outside the subject), with pseudo-counts at the subject's own share; noise as 0."""
    part = np.where(total > 0, mass / max(total, 1e-9), 0.0)
    rest = np.maximum(n[:, None] - by, 0)
    w = np.log((n[:, None] + prior) / max(total, 1.0)) - np.log((rest + prior * (1 - part) + 1e-9) / np.maximum(total - mass, 1.0))
    w[(w < noise) | (mass <= 0)[None, :]] = 0
    return w


def _sum(features: DataFrame, kind: str, weights, need: float, k: int):
    """Statistics of all documents; at most CELLS + 1 rows reach the driver, whatever the corpus."""
    model = None if weights is None else features.sparkSession.sparkContext.broadcast(weights)
    parts = features.select("cells", "marks").mapInArrow(_counts(kind, model, need, k), "cell int, n double, by array<double>")
    sums = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("by", F.lit(c))) for c in range(k)]).alias("by")).toArrow()
    cell = sums.column("cell").to_numpy()
    n, by = np.zeros(CELLS), np.zeros((CELLS, k))
    if not len(cell):
        return n, by, 0.0, np.zeros(k)
    rows = sums.column("by").combine_chunks().flatten().to_numpy().reshape(-1, k)
    count = sums.column("n").to_numpy()
    word = cell >= 0
    n[cell[word]], by[cell[word]] = count[word], rows[word]
    return n, by, float(count[~word].sum()), rows[~word].sum(axis=0)


def _shares(model, k: int):
    def run(batches):
        for batch in batches:
            flat, doc = _lists(batch.column(1))
            share = sentence_scores(flat, doc, batch.num_rows, model.value, LATER)[0]
            words = np.bincount(doc[flat > 0], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(share.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(words.astype(np.int64)), batch.column(2)], ["id", "share", "words", "marks"])

    return run


def calibrate(share: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, thresholds), one of each per subject: P(subject) = 1 / (1 + exp(-slope * (share - threshold))).

    Labels are noisy: one may be missing, or wrong. Per subject expectation-maximization tells how likely a document
    deals with it by share and label, fits the logistic curve to that by Newton's method, and then the shares of missing
    and of wrong labels. Pseudo-cases hold the numbers where the labels are few.
    """
    slopes, least = np.full(share.shape[1], SLOPE), np.full(share.shape[1], THRESHOLD)
    for c in range(share.shape[1]):
        x, y = share[:, c], marked[:, c] > 0
        beta, missing, wrong = np.array([SLOPE, -SLOPE * THRESHOLD]), MISSING, 0.01
        rows = np.stack([x, np.ones(len(x))], axis=1)
        # pseudo-cases to both sides of the usual threshold, with the posteriors of the usual curve
        held = np.stack([THRESHOLD + np.array([-2.0, -1.0, 1.0, 2.0]) / SLOPE, np.ones(4)], axis=1)
        want = 1 / (1 + np.exp(-held @ beta))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
            yes, no = p * np.where(y, 1 - missing, missing), (1 - p) * np.where(y, wrong, 1 - wrong)
            r = yes / np.maximum(yes + no, 1e-300)
            before = beta
            for _ in range(5):
                p, q = (1 / (1 + np.exp(-np.clip(z @ beta, -30, 30))) for z in (rows, held))
                grad = rows.T @ (r - p) + PSEUDO / 4 * (held.T @ (want - q))
                hess = (rows * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ rows + PSEUDO / 4 * (held * (q * (1 - q))[:, None]).T @ held
                beta = beta + np.clip(np.linalg.solve(hess + 1e-9 * np.eye(2), grad), -10, 10)
            missing = (r[~y].sum() + PSEUDO * MISSING) / (r.sum() + PSEUDO)
            wrong = ((1 - r)[y].sum() + PSEUDO * 0.01) / ((1 - r).sum() + PSEUDO)
            if np.abs(beta - before).max() < 1e-4:
                break
        if beta[0] > 0:
            slopes[c], least[c] = beta[0], -beta[1] / beta[0]
    return slopes, least


def subject_areas(docs: DataFrame, areas: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, document_rounds: int = 8, sentence_rounds: int = 8, still: float = STILL, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, subject, share, posterior, words) of every document and every subject whose posterior is at least a half.

    Rounds over documents, then over sentences, go on until the weights change by less than `still` of their sum; the numbers of
    rounds are a safety stop, and a warning tells where it ended them. Labels that are null or name no subject stand for none; contradicting labels count side by side.
    Null, empty and blank texts have no subject; repeated rows of a document give one. With no subjects,
    no labels or no documents the result is empty. Columns beyond those named are left out.
    """
    names = sorted(r[0] for r in areas.select("subject").filter("subject is not null").distinct().limit(MAX_SUBJECTS + 1).collect())
    k = len(names)
    if k > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, subject string, share double, posterior double, words long"
    if not k:
        return docs.sparkSession.createDataFrame([], schema)
    number = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("subject")) - 1, F.lit(-1))
    marks = labels.filter(F.col("subject").isNotNull()).select(F.col(id_col).alias("id"), number.cast("int").alias("m")).groupBy("id").agg(F.collect_set("m").alias("marks"))
    marks = materialize(marks.orderBy(F.xxhash64("id"), "id").limit(max_labelled), "labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    features = materialize(rows.select("id", "text", "marks").mapInArrow(_features(), f"id {kind}, cells array<int>, marks array<int>"), "features")
    weights = complement_weights(*_sum(features.filter("marks is not null"), "labels", None, 0.0, k), PRIOR[0], TAU[0])
    for step, rounds, need in (("documents", document_rounds, FIRST), ("sentences", sentence_rounds, LATER)):
        for _ in range(rounds):
            new = complement_weights(*_sum(features, step, weights, need, k), PRIOR[1], TAU[1])
            moved, weights = np.abs(new - weights).sum() / max(np.abs(new).sum(), 1e-9), new
            if moved <= still:
                break
        else:
            if rounds:
                warnings.warn(f"subject areas: the {step} still move by {moved:.3f} after {rounds} rounds", stacklevel=2)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    scored = lambda rows: rows.select("id", "cells", "marks").mapInArrow(_shares(model, k), f"id {kind}, share array<double>, words long, marks array<int>")
    known = scored(features.filter("marks is not null")).select("share", "marks").toArrow()
    share = np.array(known.column("share").to_pylist(), float).reshape(-1, k)
    marked = np.array([[c in m for c in range(k)] for m in known.column("marks").to_pylist()], float).reshape(-1, k)
    slope, least = calibrate(share, marked)
    lits = lambda x: F.array(*map(F.lit, x.tolist()))
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("subject"), F.col("share"), lits(slope).alias("slope"), lits(least).alias("least"))
    out = scored(features).select("id", "words", F.explode(each).alias("x")).select("id", "words", "x.*").filter("share >= least")
    posterior = 1 / (1 + F.exp(-F.col("slope") * (F.col("share") - F.col("least"))))
    return out.groupBy("id", "subject").agg(F.max("share").alias("share"), F.max(posterior).alias("posterior"), F.max("words").alias("words")).withColumnRenamed("id", id_col)
