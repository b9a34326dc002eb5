"""Toxicity by weak supervision.

Voters are a fixed lexicon and patterns mined from labelled rows: whole words, and word
beginnings that go on ("stem+"). A voter votes toxic or abstains. The generative label model has
for every voter the chances p1 and p0 to vote on a toxic and on a clean text (its accuracy), and
for every pair the correlation that remains within the classes. Accuracies start from labelled
rows and are drawn towards the rank-one factor of the voters' covariance over all
documents; correlations come from that covariance less what the classes explain, and discount
voters that say the same thing. The model's posterior labels train a linear
(logistic) classifier over the presence of mined words and stems, which scores every text.

Labels are learned only from rows that ``learn`` admits. Voters, classifier features and labelled rates are
counted over all admitted rows, voter statistics over all documents. Only the classifier's weights are fitted on a bounded
sample: SAMPLE labelled rows and SAMPLE other documents with their posteriors (those of smallest id hash). All texts are
scored in full.

Rules: null text is empty and scored like any; null ids are scored and never learned from; null
labels are ignored, repeated ones count each; without labels the lexicon's default rates are used; an
empty table gives an empty result; other columns are ignored by ``score`` and carried by ``keep_clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .common import MARKS, blocks, hash_of, in_arrow

# Common insults.
LEXICON = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
#: Most labelled rows, and as many other documents, that the classifier's weights are fitted on.
SAMPLE = 20_000
VOTERS, FEATURES = 96, 2048
#: Bits of the sieve that keeps most texts without a label from being dealt; its broadcast has at most SIEVE / 64 rows.
SIEVE = 1 << 25
#: Least likelihood ratio statistic of a mined feature, and least share of toxic rows for a voter.
LEAST_G, LEAST_SHARE = 24.0, 0.7
STEMS = (4, 5, 6, 7, 8, 9)
THRESHOLD = 0.7
SUBSUMED = 0.9
#: Prior rates of a lexicon voter, worth PRIOR_ROWS rows.
PRIOR = (0.25, 0.001)
PRIOR_ROWS = 8.0
#: How often a row's given label is taken to be right.
LABEL_TRUST = 0.98
#: Weaker ties between voters are taken as none.
LEAST_CORRELATION = 0.3
#: Weight of the covariance factor against labelled rates.
MOMENT_WEIGHT = 0.2


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def features(block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and going-on stems, and the text of each."""
    words, start, end, bounds = block.words(lower=True, breaks=MARKS)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, owner = [words], [text]
    for n in STEMS:
        long = np.flatnonzero(end - start > n)
        # A stem's hash must not equal that of the word spelled alike.
        found.append(~block.prefix.spans(start[long], start[long] + n))
        owner.append(text[long])
    return np.concatenate(found), np.concatenate(owner)


def stem_hash(stem: str) -> int:
    return ~hash_of(stem)


def _present(block, known: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, index of a known feature)."""
    values, owner = features(block)
    at = np.searchsorted(known, values.view(np.int64))
    at[at == len(known)] = 0
    hit = known[at] == values.view(np.int64) if len(known) else np.zeros(len(values), bool)
    pairs = np.unique(owner[hit] * len(order) + order[at[hit]])
    return pairs // max(1, len(order)), pairs % max(1, len(order))


def _count(batches):
    for batch, block in blocks(batches, "text", 1 << 20):
        values, owner = features(block)
        yes, no = np.asarray(batch.column("yes")), np.asarray(batch.column("no"))
        once = np.unique(np.stack([values.view(np.int64), owner]), axis=1)
        names, at = np.unique(once[0], return_inverse=True)
        pos, neg = (np.bincount(at, weights=n[once[1]], minlength=len(names)).astype(np.int64) for n in (yes, no))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(pos), pa.array(neg)], ["f", "pos", "neg"])


def _find(known, order):
    def run(batches):
        for batch, block in blocks(batches, "text", 1 << 20):
            text, at = _present(block, known, order)
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(at))], ["id", "found"])

    return run


def _moments(known, order, n):
    def run(batches):
        both, rows = np.zeros((n + 1, n + 1), dtype=np.int64), 0
        for batch, block in blocks(batches, "text", 1 << 20):
            text, at = _present(block, known, order)
            dense = np.zeros((batch.num_rows, n + 1), dtype=np.float32)
            dense[text, at] = 1
            dense[:, n] = 1
            both += np.rint(dense.T @ dense).astype(np.int64)
            rows += batch.num_rows
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], ["i", "j", "n"])

    return run


def _gain(pos, neg, pos_all, neg_all):
    """Signed likelihood ratio statistic of a feature: positive where it speaks for toxic."""

    def term(a, b):
        return F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))

    both, whole = pos + neg, float(pos_all + neg_all)
    g = 2 * (term(pos, both * (pos_all / whole)) + term(neg, both * (neg_all / whole)) + term(pos_all - pos, (whole - both) * (pos_all / whole)) + term(neg_all - neg, (whole - both) * (neg_all / whole)))
    return F.when(pos * neg_all >= neg * pos_all, g).otherwise(-g)


class Model:
    """known: sorted feature hashes; weight, bias: the classifier. voters, p1, p0, correlation, prior: the label model."""

    def __init__(self, known, weight, bias, voters, p1, p0, correlation, prior):
        self.known, self.weight, self.bias = known, weight, bias
        self.voters, self.p1, self.p0, self.correlation, self.prior = voters, p1, p0, correlation, prior


def posterior(votes: np.ndarray, p1, p0, correlation, prior) -> np.ndarray:
    """Chance of toxic for rows of 0/1 votes: naive Bayes with correlated voters discounted."""
    if not votes.shape[1]:
        return np.full(len(votes), prior)
    off = correlation - np.diag(np.diag(correlation))
    off = np.where(off > LEAST_CORRELATION, off, 0)
    discount = 1 / (1 + off.sum(axis=1))
    yes, no = discount * np.log(p1 / p0), discount * np.log((1 - p1) / (1 - p0))
    logit = np.log(prior / (1 - prior)) + votes @ (yes - no) + no.sum()
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _rates(pos, neg, pos_all, neg_all, in_lexicon, joint, rows):
    """p1, p0, within-class correlations and prior from labelled counts and all documents' joint votes."""
    prior = min(max((pos_all + 1.0) / (pos_all + neg_all + 10.0), 0.005), 0.5)
    a, b = np.where(in_lexicon, PRIOR_ROWS, 0.5), np.where(in_lexicon, PRIOR_ROWS, 0.5)
    p1 = (pos + a * PRIOR[0]) / (pos_all + a)
    p0 = (neg + b * PRIOR[1]) / (neg_all + b)
    p1, p0 = np.clip(p1, 1e-4, 1 - 1e-4), np.clip(p0, 1e-5, 1 - 1e-4)
    n = len(pos)
    if rows == 0 or n == 0:
        return p1, p0, np.eye(n), prior
    mean = np.diag(joint) / rows
    cov = joint / rows - np.outer(mean, mean)
    scale = prior * (1 - prior)
    # Rank-one factor of the covariances that speak for a common cause: cov_ij ~ scale * d_i * d_j.
    d = np.maximum(p1 - p0, 1e-6)
    use = (cov > 0) & ~np.eye(n, dtype=bool)
    factor = d.copy()
    for _ in range(30):
        top, low = (use * cov) @ factor, scale * (use @ (factor * factor))
        factor = np.where(low > 0, np.clip(top / np.maximum(low, 1e-12), d / 2, d * 2), factor)
    d = (1 - MOMENT_WEIGHT) * d + MOMENT_WEIGHT * factor
    p1 = np.clip(p0 + d, 1e-4, 1 - 1e-4)
    left = cov - scale * np.outer(d, d)
    spread = np.sqrt(np.clip(np.diag(left), 1e-9, None))
    correlation = np.clip(left / np.outer(spread, spread), -1, 1)
    np.fill_diagonal(correlation, 1)
    return p1, p0, correlation, prior


def _train(found: list[np.ndarray], target: np.ndarray, n: int, l2: float = 0.05, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over binary features: Newton steps, each by conjugate gradients."""
    weight = np.zeros(n + 1)
    if not len(found):
        weight[n] = -4.0
        return weight[:n], weight[n]
    sizes = np.array([len(x) for x in found])
    rows = np.repeat(np.arange(len(found)), sizes + 1)
    cols = np.full(len(rows), n)
    last = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(rows), dtype=bool)
    inner[last] = False
    cols[inner] = np.concatenate(found)
    ridge = np.full(n + 1, l2)
    ridge[n] = 1e-6

    def loss(w):
        z = np.bincount(rows, weights=w[cols], minlength=len(found))
        return np.logaddexp(0, z).sum() - (target * z).sum() + (ridge * w * w).sum() / 2, z

    now, margin = loss(weight)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        grad = np.bincount(cols, weights=(p - target)[rows], minlength=n + 1) + ridge * weight
        curve = np.maximum(p * (1 - p), 1e-6)
        move, left = np.zeros(n + 1), -grad
        way, size = left.copy(), grad @ grad
        goal = size * 1e-6
        for _ in range(60):
            if size <= goal or size == 0:
                break
            bent = np.bincount(cols, weights=(curve * np.bincount(rows, weights=way[cols], minlength=len(found)))[rows], minlength=n + 1) + ridge * way
            step = size / (way @ bent)
            move, left = move + step * way, left - step * bent
            new = left @ left
            way, size = left + new / size * way, new
        for scale in (1.0, 0.5, 0.25, 0.1, 0.02):
            then, there = loss(weight + scale * move)
            if then < now:
                break
        else:
            break
        weight, gain, now, margin = weight + scale * move, now - then, then, there
        if gain < 1e-6 * len(found):
            break
    return weight[:n], weight[n]


def _sieve(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of docs whose id may be one of known's ids i: all that are, and few others while known has few rows against SIEVE.

    Equal ids must have equal hashes, so ids of two types, or of types with several forms of a value, all pass.
    """
    kind = docs.schema["id"].dataType
    if kind != known.schema["i"].dataType or not (isinstance(kind, IntegralType) or kind == StringType()):
        return docs

    def bit(name):
        return F.pmod(F.xxhash64(name), F.lit(SIEVE))

    words = known.select(bit("i").alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("bits"))
    near = docs.withColumn("b", bit("id")).join(F.broadcast(words), F.shiftright("b", 6) == F.col("w"))
    return near.filter("getbit(bits, int(b % 64)) = 1").select(*docs.columns)


def labelled(docs: DataFrame, admitted: DataFrame) -> DataFrame:
    """id and text of every row of docs(id, text) with a label in admitted(i, toxic), and how many labels say yes and no.

    Labels and texts are dealt by id at every size of the labels, so the cost grows in proportion; the sieve leaves out most texts without a label before that.
    """
    known = admitted.groupBy("i").agg(F.count_if("toxic").alias("yes"), F.count_if(~F.col("toxic")).alias("no"))
    return _sieve(docs, admitted).join(known.hint("shuffle_hash"), F.col("id") == F.col("i")).select("id", "text", "yes", "no")


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on labels(label_id, label_col) whose row satisfies learn (a condition on label_id)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Mined words, their rates and the prior count every admitted labelled row.
    admitted = labels.filter(learn & F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).select(F.col(label_id).alias("i"), (F.col(label_col) > 0).alias("toxic"))
    rows = labelled(docs, admitted)
    pos_all, neg_all = (n or 0 for n in rows.agg(F.sum("yes"), F.sum("no")).first())
    mined = []
    if pos_all and neg_all:
        counts = in_arrow(rows, _count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        gain = _gain(F.col("pos").cast("double"), F.col("neg").cast("double"), pos_all, neg_all)
        counts = counts.filter("pos + neg > 2").withColumn("g", gain).filter(F.abs("g") >= LEAST_G)
        mined = counts.orderBy(F.abs("g").desc(), "f").limit(FEATURES).collect()
    lexicon = {hash_of(w) for w in LEXICON}
    by_name = {r.f: (r.pos, r.neg) for r in mined}
    names = np.array(sorted(lexicon | set(by_name)), dtype=np.int64)
    # The lexicon first, then mined voters by gain.
    chosen = sorted(lexicon) + [r.f for r in mined if r.f not in lexicon and r.g > 0 and r.pos >= LEAST_SHARE * (r.pos + r.neg)][: VOTERS - len(lexicon)]
    voters = np.searchsorted(names, np.array(chosen, dtype=np.int64))
    n = len(voters)
    order = np.arange(len(names))
    place = np.full(len(names), -1)
    place[voters] = np.arange(n)
    voter_names = np.sort(np.array(chosen, dtype=np.int64))
    voter_order = place[np.searchsorted(names, voter_names)]
    joint = np.zeros((n + 1, n + 1))
    for r in in_arrow(docs.select("text"), _moments(voter_names, voter_order, n), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        joint[r.i, r.j] = r.n
    # A voter that hardly ever votes without an earlier one adds nothing (a longer form of its stem).
    kept: list[int] = []
    for j in range(n):
        if all(joint[i, j] < SUBSUMED * max(joint[j, j], 1) for i in kept):
            kept.append(j)
    chosen = [chosen[j] for j in kept]
    joint = joint[np.ix_([*kept, n], [*kept, n])]
    n = len(kept)
    place[:] = -1
    place[voters[kept]] = np.arange(n)
    count = np.array([by_name.get(f, (0, 0)) for f in chosen], dtype=float)
    p1, p0, correlation, prior = _rates(count[:, 0], count[:, 1], pos_all, neg_all, np.array([f in lexicon for f in chosen], dtype=bool), joint[:n, :n], joint[n, n])
    # Rows that the classifier is fitted on; both sides are bounded by the parameter, hence the broadcasts.
    known_rows = admitted.orderBy(F.xxhash64("i"), "i", "toxic").limit(sample)
    rows = docs.join(F.broadcast(known_rows), F.col("id") == F.col("i")).select("id", "text", "toxic")
    others = docs.select(F.col("id").alias("i")).filter("i is not null").orderBy(F.xxhash64("i"), "i").limit(sample).distinct()
    others = others.join(F.broadcast(known_rows.select("i").distinct()), "i", "left_anti")
    unlabelled = docs.join(F.broadcast(others), F.col("id") == F.col("i")).select("id", "text")
    seen = [(at, None) for at in _lists(in_arrow(unlabelled.select("id", "text"), _find(names, order), _found_schema(docs)).select("found").toArrow())]
    found = in_arrow(rows.select(F.struct("id", "toxic").alias("id"), "text"), _find(names, order), "id struct<id:%s,toxic:boolean>, found array<long>" % docs.schema["id"].dataType.simpleString())
    found = found.select("id.toxic", "found").toArrow()
    seen += zip(_lists(found), found.column("toxic").to_pylist())
    # One row for each voter alone, so that a rare one is known to the classifier too.
    seen += [(np.array([j]), None) for j in voters[kept]]
    votes = np.zeros((len(seen), n))
    for i, (at, _) in enumerate(seen):
        mine = place[at]
        votes[i, mine[mine >= 0]] = 1
    target = posterior(votes, p1, p0, correlation, prior)
    given = np.array([0.5 if t is None else LABEL_TRUST if t else 1 - LABEL_TRUST for _, t in seen])
    target = target * given / (target * given + (1 - target) * (1 - given)) if len(seen) else target
    weight, bias = _train([at for at, _ in seen], target, len(names))
    return Model(names, weight, bias, np.array(chosen), p1, p0, correlation, prior)


def _lists(found: pa.Table) -> list[np.ndarray]:
    """The column ``found`` as arrays that share memory: a sample of rows takes little room on the driver."""
    column = found.column("found").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _found_schema(docs: DataFrame) -> str:
    return f"id {docs.schema['id'].dataType.simpleString()}, found array<long>"


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (double, 0 to 1) of every row of df."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known, weight, bias = model.known, model.weight, model.bias

    def run(batches):
        order = np.arange(len(known))
        for batch, block in blocks(batches, "text", 1 << 20):
            text, at = _present(block, known, order)
            margin = np.bincount(text, weights=weight[at], minlength=batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["id", "score"])

    return in_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of df whose score is under the threshold, with all their columns."""
    known, weight, bias = model.known, model.weight, model.bias

    def run(batches):
        order = np.arange(len(known))
        for batch, block in blocks(batches, text_col, 1 << 20):
            text, at = _present(block, known, order)
            margin = np.bincount(text, weights=weight[at], minlength=batch.num_rows) + bias
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))) < threshold))

    return df.mapInArrow(run, df.schema)
