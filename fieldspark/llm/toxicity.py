"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its posterior labels.

1. Lexicons. From a bounded sample of labelled rows (``SAMPLE`` rows by hash, of the rows that may be learned from) come words and word
   beginnings that toxic texts have far more often than others: at most ``ENTRIES`` per kind.
2. Voters. Words and beginnings of three lengths are dealt to voters; pattern voters look at how many and how densely they occur. A voter
   says toxic or abstains.
3. Label model. All texts are reduced to their vote pattern, one of 2^V, and counted: corpus-wide counts, at most 2^V rows. A factor model
   p(y, votes) with one accuracy weight per voter, a propensity, and a weight for each correlated pair of voters is fitted to these
   counts by expectation maximisation. Pairs count as correlated if they agree much more often inside a class than chance says.
4. Classifier. Logistic regression on lexicon hits and vote counts, trained on the posterior labels of the sampled texts.

Learning uses labels only from rows with crc32(doc_id as text) mod 3 <> 1; labels, language, source and id are no inputs of a score.

Odd inputs: null and empty texts are scored like a text without any hit; a document labelled several times counts as toxic if any label
says so; null labels are no labels; without labelled toxic rows nothing can be learned and every score is 0; repeated rows each give their
row; an empty table gives an empty result. Columns that clash with the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import stored, table
from fieldspark.llm.queries import query
from fieldspark.llm.words import ALNUM, pieces, split_words, with_columns
from fieldspark.session import cut_lineage

#: Bound of the sample of labelled rows that lexicons and classifier are fitted on.
SAMPLE = 20_000
#: Entries of each lexicon kind at most, and toxic texts of the sample that must hold one; of few toxic texts, half of them.
ENTRIES, SUPPORT = 192, 6
#: Bytes of a word that a beginning has; 0 stands for the whole word.
KINDS = (0, 4, 5, 6)
#: Voters per kind, and pattern voters.
PER_KIND = 3
THRESHOLD = 0.7
HELD_OUT = 1


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def _features(words, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word's feature of a kind: the whole word, or its first bytes if it is longer."""
    if not kind:
        return words.hashes(), words.rows()
    longer = np.flatnonzero(words.size > kind)
    heads = words.joined[words.joined_at[longer, None] + np.arange(kind)].astype(np.uint64) + np.uint64(1)
    code = np.zeros(len(longer), np.uint64)
    for j in range(kind):
        code = code * np.uint64(257) + heads[:, j]
    return code, words.rows()[longer]


def mine(sample: DataFrame) -> list[np.ndarray]:
    """For each kind the features of toxic texts, the most telling first: counted per task, summed by Spark, at most ENTRIES kept."""

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = split_words(part.column("text"), ALNUM)
                toxic = np.asarray(part.column("toxic")).astype(np.int64)
                for kind in KINDS:
                    code, row = _features(words, kind)
                    order = np.lexsort((row, code))
                    code, row = code[order], row[order]
                    new = np.ones(len(code), bool)
                    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
                    code, row = code[new], row[new]
                    distinct, at = np.unique(code, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(distinct), kind)), pa.array(distinct.view(np.int64)),
                            pa.array(np.bincount(at, weights=toxic[row], minlength=len(distinct)).astype(np.int64)),
                            pa.array(np.bincount(at, minlength=len(distinct)).astype(np.int64)),
                        ],
                        ["kind", "code", "toxic", "n"],
                    )

    n, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return [np.zeros(0, np.uint64) for _ in KINDS]
    counts = sample.select("text", "toxic").mapInArrow(count, "kind long, code long, toxic long, n long")
    counts = counts.groupBy("kind", "code").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(F.col("toxic") >= min(SUPPORT, max(2, -(-toxic // 2))))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n - toxic + 1.0))
    scored = counts.withColumn("odds", odds).where("odds > 3")
    out = []
    for kind in KINDS:
        top = scored.where(F.col("kind") == kind).orderBy(F.desc("odds"), F.desc("toxic"), "code").limit(ENTRIES).select("code").collect()
        out.append(np.array([r[0] for r in top], np.int64).view(np.uint64))
    return out


class Voters:
    """Lexicon hits of a text and the votes they make."""

    def __init__(self, lexicons: list[np.ndarray]):
        self.lexicons = [(np.sort(x), np.argsort(x)) for x in lexicons]
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in lexicons])))
        self.n_entries = int(self.starts[-1])
        self.n_voters = len(lexicons) * PER_KIND + 2

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry) of all hits, and words per row."""
        words = split_words(column, ALNUM)
        rows, entries = [], []
        for k, (known, order) in enumerate(self.lexicons):
            if not len(known):
                continue
            code, row = _features(words, KINDS[k])
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[at] == code
            rows.append(row[hit])
            entries.append(order[at[hit]] + self.starts[k])
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(rows or empty), np.concatenate(entries or empty), words.per_row()

    def votes(self, row: np.ndarray, entry: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Rows x voters: entries of a kind are dealt to its voters in turn; two pattern voters see repetition and density."""
        kind = np.searchsorted(self.starts[1:], entry, "right")
        voter = kind * PER_KIND + (entry - self.starts[kind]) % PER_KIND
        out = np.zeros((len(n_words), self.n_voters), np.int64)
        np.add.at(out, (row, voter), 1)
        whole = np.bincount(row, minlength=len(n_words))
        votes = out > 0
        votes[:, -2] = whole >= 4
        votes[:, -1] = whole * 100 >= np.maximum(n_words, 1)
        return votes

    def patterns(self, column: pa.Array) -> np.ndarray:
        return self.votes(*self.hits(column)) @ (1 << np.arange(self.n_voters))

    def inputs(self, column: pa.Array) -> np.ndarray:
        """Inputs of the classifier: how often each entry occurs (up to 3), the votes, and the log of the number of hits."""
        row, entry, n_words = self.hits(column)
        counts = np.zeros((len(n_words), self.n_entries), np.float32)
        np.add.at(counts, (row, entry), 1)
        votes = self.votes(row, entry, n_words).astype(np.float32)
        total = np.log1p(np.bincount(row, minlength=len(n_words))).astype(np.float32)
        return np.concatenate([np.minimum(counts, 3), votes, total[:, None]], 1)


@dataclass
class LabelModel:
    """p(y, v) ~ exp(prior y + sum (propensity + accuracy y) v + sum coupling v v') over all vote patterns v, y = 0 or 1."""

    prior: float
    propensity: np.ndarray
    accuracy: np.ndarray
    pairs: list[tuple[int, int]]
    coupling: np.ndarray

    def energies(self, votes: np.ndarray) -> np.ndarray:
        base = votes @ self.propensity
        for (a, b), w in zip(self.pairs, self.coupling, strict=True):
            base = base + w * votes[:, a] * votes[:, b]
        return np.stack([base, base + self.prior + votes @ self.accuracy], 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        e = self.energies(votes)
        return 1 / (1 + np.exp(e[:, 0] - e[:, 1]))


def all_patterns(n: int) -> np.ndarray:
    return ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(np.float64)


def fit_label_model(counts: np.ndarray, n: int, share: float, rounds: int = 15, steps: int = 12) -> LabelModel:
    """Expectation maximisation on the counts of all patterns. ``share``: share of toxic rows to begin with."""
    every = all_patterns(n)
    weight = counts / max(1, counts.sum())
    share = min(max(share, 1e-4), 0.5)
    # to begin with: texts with votes are toxic
    start = 1 / (1 + np.exp(-(3.0 * np.minimum(every.sum(1), 3) - 4.5)))
    seen = weight @ every
    inside = (weight * start) @ every / max(1e-9, weight @ start)
    outside = np.clip((weight * (1 - start)) @ every / max(1e-9, weight @ (1 - start)), 1e-5, 1 - 1e-5)
    inside = np.clip(inside, 1e-4, 1 - 1e-4)
    # pairs that agree inside a class more often than its single rates say
    joint = (every * (weight * start)[:, None]).T @ every / max(1e-9, weight @ start)
    spread = np.sqrt(np.outer(inside * (1 - inside), inside * (1 - inside)))
    excess = (joint - np.outer(inside, inside)) / spread
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if excess[a, b] > 0.2 and seen[a] > 0 and seen[b] > 0]
    logit = lambda p: np.log(p / (1 - p))
    model = LabelModel(logit(share), logit(outside), logit(inside) - logit(outside), pairs, np.zeros(len(pairs)))
    together = [every[:, a] * every[:, b] for a, b in pairs]
    for _ in range(rounds):
        post = model.posterior(every)
        target = np.concatenate(([weight @ post], weight @ every, (weight * post) @ every, [weight @ t for t in together]))
        for _ in range(steps):  # maximisation: observed moments against those of the model
            e = model.energies(every)
            p = np.exp(e - e.max())
            p /= p.sum()
            both = p.sum(1)
            have = np.concatenate(([p[:, 1].sum()], both @ every, p[:, 1] @ every, [both @ t for t in together]))
            step = np.clip((target - have) / (np.minimum(have, 1 - have) + 0.01), -1, 1) * 0.3
            model.prior += step[0]
            model.propensity = np.clip(model.propensity + step[1 : n + 1] * 0.5, -14, 2)
            model.accuracy = np.clip(model.accuracy + step[n + 1 : 2 * n + 1] * 0.5, 0, 14)  # no voter speaks for clean texts
            model.coupling = np.clip(model.coupling + step[2 * n + 1 :] * 0.5, -4, 8)
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, n: np.ndarray, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of rows that occur n times, both classes weighing alike; Adam on the whole matrix."""
    w, b = np.zeros(x.shape[1]), 0.0
    toxic = y > 0.5
    weight = n * np.where(toxic, 0.5 / max(1.0, n[toxic].sum()), 0.5 / max(1.0, n[~toxic].sum()))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        d = weight * (p - y)
        g = np.concatenate((x.T @ d + l2 * w, [d.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass
class ToxicityModel:
    voters: Voters
    label_model: LabelModel | None
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.label_model is None:
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(self.voters.inputs(column) @ self.weights + self.bias, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, toxic: at most ``size`` labelled documents that may be learned from, the first ones by hash."""
    one = labels.where("doc_id is not null and toxic is not null").where(fold() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    # at most ``size`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(cut_lineage(chosen)), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> ToxicityModel:
    sample = stored(labelled_sample(docs, labels, size), "labelled")
    voters = Voters(mine(sample))
    none = ToxicityModel(voters, None, np.zeros(0), 0.0)
    if not voters.n_entries:
        return none
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(voters)

    def pattern_counts(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                value, n = np.unique(shared.value.patterns(part.column("text")), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["pattern", "n"])

    counts = np.zeros(1 << voters.n_voters)
    found = docs.select("text").mapInArrow(pattern_counts, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()
    for pattern, n in found:  # at most 2^V rows
        counts[pattern] = n
    share = sample.agg(F.avg("toxic")).first()[0]
    label_model = fit_label_model(counts, voters.n_voters, share)

    def inputs(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                x = shared.value.inputs(part.column("text"))
                votes = x[:, shared.value.n_entries : -1] @ (1 << np.arange(shared.value.n_voters))
                rows = [r.tobytes() for r in x.astype(np.float16)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(votes.astype(np.int64))], ["x", "pattern"])

    # texts without a vote have equal inputs: one row with a count stands for them
    given = sample.select("text").mapInArrow(inputs, "x binary, pattern long").groupBy("x", "pattern").count().collect()
    x = np.stack([np.frombuffer(r[0], np.float16) for r in given]).astype(np.float64)
    post = label_model.posterior(all_patterns(voters.n_voters)[[r[1] for r in given]])
    weights, bias = fit_linear(x, post, np.array([r[2] for r in given], np.float64))
    return ToxicityModel(voters, label_model, weights, bias)


FIELDS = [T.StructField("score", T.DoubleType())]


def score_toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, size))
    scored = with_columns(docs, "text", FIELDS, lambda column: [pa.array(model.value.scores(column))])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, columns as they were."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return score_toxicity(rows, labels).where("predicted = 0").select("_row.*")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", "predicted")
