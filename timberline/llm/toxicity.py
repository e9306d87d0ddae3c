"""Toxicity by weak supervision: word and pattern voters, a generative label model, and a linear classifier.

Voters say toxic, clean or nothing about a text. The label model treats the true label as hidden: it estimates by
expectation maximisation how often each voter is right, and from what is left over how strongly voters depend on each
other, so that voters which repeat one another share their weight. It learns from a sample of texts, most of which have
no label: given labels are one more, fallible, voter, which is silent about the others. A logistic regression is then
trained on the posterior labels of the whole sample, and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .wordhash import slices

#: Labelled rows that train the model at most, picked by a hash of their id.
SAMPLE = 20_000
#: Texts without a label that train the model besides, picked by a hash of id and text: so many on average, twice as many
#: at most.
UNLABELLED = 10_000
#: Voters of mined words at most.
MINED = 200
#: Lengths of mined word beginnings; a lexicon writes them with ^ before them. Inflected words share them.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A general list of insults; mined words come on top.
INSULTS = (
    "idiot idiots moron morons stupid scum worthless clown clowns loser losers trash pathetic disgusting dumb fool fools imbecile "
    "retard retarded jerk creep filth filthy vermin parasite parasites garbage lowlife degenerate cretin bastard bastards bitch "
    "asshole dickhead prick whore slut pig pigs rat rats swine maggot kill die hate ugly freak subhuman savages coward liar "
    "shut idiota imbécil estúpido estúpida basura escoria payaso perdedor asqueroso asco idiotas cretino débile stupide ordure "
    "racaille clochard imbécile crétin abruti minable dégoûtant trottel dumm dummkopf abschaum arschloch versager müll ekelhaft"
).split()
_WORD = re.compile(r"\w+")
_YOU = re.compile(r"\b(?:you|your|youre|ur|du|dein|tu|tus|vous|toi|ustedes)\b")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter and whether it is an upper-case one."""
    every = "".join(map(chr, range(0x110000)))
    return tuple(np.fromiter(map(kind, every), bool, len(every)) for kind in (str.isalpha, str.isupper))


def upper_share(text: str) -> float:
    """Upper-case characters to letters, in the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, upper = _letters()
    return np.count_nonzero(upper[codes]) / (np.count_nonzero(letter[codes]) or 1)


def patterns(text: str, tokens: list[str], insults: int) -> list[float]:
    """Numbers that do not come from single words."""
    n = max(1, len(tokens))
    return [insults, insults / n, np.log1p(insults), text.count("!") / max(1, len(text)) * 100, upper_share(text)]


def _votes(text: str, lexicon: dict[str, int]) -> tuple[list[int], list[float]]:
    """-1 clean, 0 nothing, 1 toxic for each word and pattern voter; and the classifier's features."""
    tokens = words(text)
    hits: list[int] = []
    for t, n in Counter(tokens).items():
        for x in (t, *(f"^{t[:k]}" for k in BEGINNINGS if len(t) > k)):
            if x in lexicon:
                hits += [lexicon[x]] * n
    found = set(hits)
    votes = [1 if k in found else 0 for k in range(len(lexicon))]
    distinct, density = len(found), len(hits) / max(1, len(tokens))
    votes += [
        1 if distinct >= 2 else -1 if not distinct else 0,
        1 if len(hits) >= 3 else -1 if not hits else 0,
        1 if density >= 0.01 else -1 if density == 0 else 0,
        1 if hits and _YOU.search(text.lower()) else 0,
        1 if hits and text.count("!") >= 3 else 0,
    ]
    counts = np.bincount(hits, minlength=len(lexicon)) if hits else np.zeros(len(lexicon))
    return votes, [*np.minimum(counts, 3), distinct, *patterns(text, tokens, len(hits))]


@dataclass(frozen=True)
class LabelModel:
    """prior: share of toxic; accuracy[j, y, v]: chance that voter j says v - 1 of a text of label y; weight[j]."""

    prior: float
    accuracy: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = (np.log(self.accuracy[:, 1]) - np.log(self.accuracy[:, 0])) * self.weight[:, None]
        total = np.log(self.prior / (1 - self.prior)) + sum((votes == v) @ odds[:, v + 1] for v in (-1, 0, 1))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_labels(votes: np.ndarray, start: np.ndarray, anchor: tuple[float, float] = (0.95, 0.02), rounds: int = 30) -> LabelModel:
    """Expectation maximisation from first posteriors; weights from the correlations that the labels leave unexplained.

    The last voter is the annotator, who is silent (0) about most texts and whose chances to say toxic of toxic and of
    clean texts, where they speak, are given: voters that all repeat one another could not tell their own errors from the
    labels'.
    """
    n, m = votes.shape
    p, weight = start.astype(np.float32), np.full(m, 1 / np.sqrt(m))
    for _ in range(rounds):
        accuracy = np.empty((m, 2, 3))
        for v in (-1, 0, 1):
            said = (votes == v).astype(np.float32)
            accuracy[:, 1, v + 1] = (p @ said + 0.1) / (p.sum() + 0.3)
            accuracy[:, 0, v + 1] = ((1 - p) @ said + 0.1) / ((1 - p).sum() + 0.3)
        accuracy[-1] = [[1 - anchor[1], 1, anchor[1]], [1 - anchor[0], 1, anchor[0]]]  # silence says nothing
        prior = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
        expected = [(accuracy[:, y, 2] - accuracy[:, y, 0]).astype(np.float32) for y in (0, 1)]
        rest = votes - (np.outer(1 - p, expected[0]) + np.outer(p, expected[1]))
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        related = np.abs((rest.T @ rest) / n / np.outer(spread, spread))
        related[-1], related[:, -1] = 0, 0
        weight = 1 / np.where(related > 0.1, related, 0).sum(1).clip(1)
        new = LabelModel(prior, accuracy, weight).posterior(votes).astype(np.float32)
        moved = np.abs(new - p).max()
        p = new
        if moved < 1e-6:
            break
    return LabelModel(prior, accuracy, weight)


def fit_line(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps; the last weight is the constant."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        gradient, curve = -ridge * np.r_[w[:-1], 0], np.diag(np.full(len(w), ridge))
        for a in range(0, len(x), 4096):
            some = np.c_[x[a : a + 4096], np.ones(len(x[a : a + 4096]))]
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            gradient += some.T @ (target[a : a + 4096] - p)
            curve += (some * (p * (1 - p))[:, None]).T @ some
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_column: Column) -> Column:
    return (F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def _lexicon(train: DataFrame, most: int) -> dict[str, int]:
    """Numbered words and word beginnings: those that toxic training texts hold eight times as often as clean ones, and
    2 % of the toxic ones at all; and the general list, without words that training texts use otherwise (as one language's insult is
    another's article)."""
    totals = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, n = totals["t"] or 0, totals["n"]
    if not toxic or toxic == n:
        return {w: k for k, w in enumerate(INSULTS)}
    each = train.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("words"))
    starts = [F.transform(F.filter("words", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.lit("^"), F.substring(w, 1, k))) for k in BEGINNINGS]
    each = each.select("toxic", F.explode(F.array_distinct(F.concat("words", *starts))).alias("word")).filter("length(word) > 2")
    counts = each.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    counts = written(counts.withColumn("ratio", (F.col("t") / toxic) / ((F.col("n") - F.col("t") + 0.5) / (n - toxic))), "words")
    mined = [r["word"] for r in counts.filter((F.col("ratio") >= 8) & (F.col("t") >= max(3, 0.02 * toxic))).orderBy(F.desc("t"), "word").limit(most).collect()]
    other = {r["word"] for r in counts.filter(F.col("word").isin(INSULTS) & (F.col("n") >= 3) & (F.col("ratio") < 3)).collect()}
    return {w: k for k, w in enumerate(dict.fromkeys([*mined, *(w for w in INSULTS if w not in other)]))}


def _rows(lexicon: dict[str, int]):
    """The label (0: none), votes (int8) and features (float32) of each text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_votes(x.as_py() or "", lexicon) for x in batch.column(0)]
            packed = [pa.array([np.array(x[k], kind).tobytes() for x in got], pa.binary()) for k, kind in ((0, np.int8), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *packed], ["label", "votes", "features"])

    return run


@dataclass(frozen=True)
class Model:
    """Lexicon, means and scales of features (2 rows), weights of the classifier, and the label model behind it (None:
    there was nothing to learn from)."""

    lexicon: dict[str, int]
    scale: np.ndarray
    weights: np.ndarray
    labels: LabelModel | None

    def features(self, texts: pa.Array) -> np.ndarray:
        return np.array([_votes(x.as_py() or "", self.lexicon)[1] for x in texts], float).reshape(len(texts), -1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = (self.features(texts) - self.scale[0]) / self.scale[1]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        """What the label model says without the annotator."""
        votes = np.array([[*_votes(x.as_py() or "", self.lexicon)[0], 0] for x in texts], np.int8).reshape(len(texts), -1)
        return self.labels.posterior(votes)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """A model from texts that are not held out: at most `sample` labelled ones, which are broadcast to their texts, and
    some `unlabelled` others. Their votes and features come to the driver, a byte and four for each voter."""
    known = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("toxic")).filter("toxic IN (0, 1)").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("label_id"))).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    share = min(1.0, unlabelled / max(1, docs.count()))
    picked = ~held_out(F.col("id")) & (F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) < int(share * (1 << 40)))
    met = texts.join(F.broadcast(known), texts["id"] == known["label_id"], "left")
    rows = written(met.filter(F.col("toxic").isNotNull() | picked).select("text", "toxic"), "training")
    lexicon = _lexicon(rows.filter("toxic IS NOT NULL"), MINED)
    label = F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, -1).otherwise(0)
    some = rows.select("text", label.alias("label"))
    some = some.filter("label <> 0").union(some.filter("label = 0").limit(2 * unlabelled))
    got = some.mapInArrow(_rows(lexicon), "label int, votes binary, features binary").toArrow()
    width, said = len(lexicon) + 6, got.column("label").to_numpy().astype(np.int8)
    if not ((said == 1).any() and (said == -1).any()):  # nothing to learn from: the word count decides
        weights = np.zeros(width + 1)
        weights[len(lexicon)], weights[-1] = 2.0, -3.0
        return Model(lexicon, np.array([np.zeros(width), np.ones(width)]), weights, None)
    matrix = lambda name, kind: np.frombuffer(b"".join(got.column(name).to_pylist()), kind).reshape(len(said), -1)
    votes, features = np.c_[matrix("votes", np.int8), said], matrix("features", np.float32)
    del got
    # the first posteriors of texts without a label come from voters judged by the labelled ones
    spoken, start = said != 0, np.where(said == 1, 0.9, 0.02)
    first = fit_labels(votes[spoken], start[spoken])
    model = fit_labels(votes, np.where(spoken, start, first.posterior(votes)))
    scale = np.array([features.mean(0, dtype=float), np.maximum(features.std(0, dtype=float), 1e-3)])
    return Model(lexicon, scale, fit_line(((features - scale[0]) / scale[1]).astype(np.float32), model.posterior(votes)), model)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, held_out, score, predicted for every row of docs; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1_000_000):
                p = model.scores(batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_column)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Train on labels of rows whose crc32 of the id as text is no multiple of 5, and score every row of docs.

    Null and empty texts are scored as empty. A null id counts as an empty id text, and has no label. Of repeated
    labels the larger counts; null labels are left out; without labels of both kinds a fixed word count decides. Very
    long texts are read whole, in time in proportion to them. Other columns of both tables are left out.
    """
    return score(docs, train(docs, labels, id_column, text_column, **options), id_column, text_column)
