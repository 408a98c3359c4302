"""Toxicity: a linear classifier that must not care which group a sentence names.

Features are hashed words and word beginnings, so that unseen forms of a known stem count. Every labelled text of the fit gets
counterfactual copies: where it names a group, with the identity terms swapped for others of their set; and always pairs with one or the
other of two terms of a set put in at a hashed place. Training adds ``penalty`` times the squared difference of the scores of a text and
its swapped copy, and of the two texts of a pair (before the logistic function). A term that stood beside abuse in the labels then earns
no weight that the others of its set lack, and neither does one that only looks like an abusive word.

The model is fitted on at most about ``SAMPLE_PER_CLASS`` labelled rows of each class, chosen by a hash of their id; scoring is a pass
over whole texts with the few learned weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from tallymill.llm.common import sliced, table, with_fields

#: Labelled rows of each class that a fit looks at, as an expected number: the only sample in this operator.
SAMPLE_PER_CLASS = 4000
#: Features are numbers below 2 ** HASH_BITS; at most MOST_FEATURES with a likelihood ratio of EVIDENCE or more, in at least MIN_DOCS toxic texts, take part.
HASH_BITS, MOST_FEATURES, EVIDENCE, MIN_DOCS = 20, 768, 24.0, 3
#: A feature is this many times as frequent in toxic texts as in others, at least.
MIN_LIFT = 12
PREFIXES = (4, 5, 6)
PENALTY, RIDGE, STEPS = 1.0, 1e-3, 30
#: The bias at most: a text without any known feature scores 0.38 or less, even if most labelled texts without one are toxic.
MOST_BIAS = -0.5
#: Terms that name a group, in sets whose members stand for one another, in English, German, French and Spanish. Fixed values.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    ("schwarze", "weiße", "asiaten", "latinos"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("gehörlose", "blinde", "behinderte", "autisten"),
    ("alte", "junge"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("homosexuel", "lesbienne", "hétérosexuel", "bisexuel"),
    ("noirs", "blancs", "asiatiques"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("sourds", "aveugles", "handicapés", "autistes"),
    ("vieux", "jeunes"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("homosexual", "lesbiana", "heterosexual", "bisexuales"),
    ("negros", "blancos", "asiáticos"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
    ("sordos", "ciegos", "discapacitados", "autistas"),
    ("viejos", "jóvenes"),
)
#: Swapped copies of a text at most; each moves every term on by another place in its set.
SWAPS = 3
#: Pairs of a text with one and with another term put in.
INSERTS = 2

_word = re.compile(r"[^\W\d_]+")


def features(chunk: str) -> list[int]:
    """Hashed features of what stands between two white spaces: its words and their beginnings."""
    from xxhash import xxh32_intdigest

    out, mask = [], (1 << HASH_BITS) - 1
    for word in _word.findall(chunk.lower()):
        out.append(xxh32_intdigest(word.encode()) & mask)
        out += [xxh32_intdigest(word[:n].encode(), n) & mask for n in PREFIXES if len(word) > n]
    return out


class _Featurizer:
    def __init__(self):
        self.memo: dict[str, list[int]] = {}

    def __call__(self, chunks: set[str]) -> np.ndarray:
        """Sorted features that a set of chunks has."""
        if len(self.memo) > 300_000:
            self.memo.clear()
        for c in chunks:
            if c not in self.memo:
                self.memo[c] = features(c)
        found = set().union(*map(self.memo.__getitem__, chunks))
        return np.sort(np.fromiter(found, np.uint32, len(found)))


def swapped(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[str]:
    """Copies of a text with its identity terms exchanged; none if it has none."""
    where = {t: s for s in reversed(terms) for t in s}
    if not where.keys() & set(_word.findall(text.lower())):
        return []

    def moved(k: int) -> str:
        def other(m: re.Match) -> str:
            group = where.get(m[0].lower())
            return m[0] if group is None else group[(group.index(m[0].lower()) + k) % len(group)]

        return _word.sub(other, text)

    most = max(len(where[w]) for w in _word.findall(text.lower()) if w in where)
    return [moved(k) for k in range(1, min(SWAPS, most - 1) + 1)]


def inserted(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[str, str, int]]:
    """INSERTS pairs (term, other term of its set, place) for a text, by a hash of it: both terms go in after so many of the runs between white space."""
    from xxhash import xxh3_64_intdigest

    sets, n, out = [s for s in terms if len(s) > 1], len(text.split()), []
    for i in range(INSERTS if sets else 0):
        h = xxh3_64_intdigest(text, i)
        chosen = sets[h % len(sets)]
        one = (h >> 16) % len(chosen)
        out.append((chosen[one], chosen[(one + 1 + (h >> 24) % (len(chosen) - 1)) % len(chosen)], (h >> 32) % (n + 1)))
    return out


def with_term(text: str, term: str, place: int) -> str:
    """The runs of a text with a term put in after so many of them."""
    runs = text.split()
    return " ".join([*runs[:place], term, *runs[place:]])


_GAP = pa.struct([("gone", pa.binary()), ("come", pa.binary())])
_TRAIN = pa.schema([("toxic", pa.int32()), ("own", pa.binary()), ("swaps", pa.list_(_GAP)), ("inserts", pa.list_(_GAP))])
_TRAIN_DDL = "toxic int, own binary, swaps array<struct<gone:binary,come:binary>>, inserts array<struct<gone:binary,come:binary>>"


def _gap(one: np.ndarray, other: np.ndarray) -> dict[str, bytes]:
    """What sets the features of two texts apart: gone are those that only the first has, come those that only the second has."""
    return {"gone": np.setdiff1d(one, other, True).tobytes(), "come": np.setdiff1d(other, one, True).tobytes()}


def training_row(text: str, toxic: int, featurize: _Featurizer, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict:
    """A row of _TRAIN."""
    chunks = set(text.split())
    own = featurize(chunks)
    swaps = [_gap(own, featurize(set(c.split()))) for c in swapped(text, terms)]
    # features don't depend on places, and what the pair differs in is what either term has alone and the text lacks
    less = lambda term: np.setdiff1d(featurize({term}), own, True)
    inserts = [_gap(less(a), less(b)) for a, b, _ in inserted(text, terms)]
    return {"toxic": toxic, "own": own.tobytes(), "swaps": swaps, "inserts": inserts}


def training_rows(docs: DataFrame, labels: DataFrame, terms: tuple[tuple[str, ...], ...], per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(toxic, own features, what swaps change, what inserted pairs differ in) of the sampled labelled rows whose text may be learned from. A document with several labels is toxic if one says so, and one with several rows is learned from one of its texts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    cut = F.lit(0)
    for value, n in sizes.items():
        cut = F.when(F.col("toxic") == value, F.lit(int(min(1.0, per_class / n) * (1 << 30)))).otherwise(cut)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = _Featurizer()
        for batch in sliced(batches, 200):
            rows = [training_row(text, toxic, featurize, terms) for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_TRAIN)

    # the sample has a bounded number of rows of two numbers
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("t.text", "toxic").mapInArrow(run, _TRAIN_DDL)


class Model:
    """Weights by hashed feature, and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def of_chunk(self, chunk: str) -> list[int]:
        return [f for f in features(chunk) if f in self.weights]

    def score(self, text: str) -> float:
        """0 to 1. Each feature counts once, as in training."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        found, memo = set(), self.memo
        for chunk in set(text.split()):
            known = memo.get(chunk)
            if known is None:
                known = memo[chunk] = self.of_chunk(chunk)
            if known:
                found.update(known)
        total = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


Gap = tuple[np.ndarray, np.ndarray]


def fit(rows: list[tuple[int, np.ndarray, list[Gap], list[Gap]]], penalty: float = PENALTY, n_terms: int = sum(map(len, IDENTITY_TERMS))) -> Model:
    """Fits to (toxic, features, gaps of swapped copies, gaps of inserted pairs), gaps as (gone, come). Without toxic rows every score is near 0; without any rows too.

    The squared differences are averaged over all swapped copies, and over the inserted pairs that a term has, of n_terms, so that the
    penalty curbs a term alike however many others there are.
    """
    y = np.array([r[0] for r in rows], np.float64)
    if not len(rows) or not y.any():
        return Model({}, -5.0)
    if y.all():
        return Model({}, 5.0)
    size = 1 << HASH_BITS
    seen = np.zeros((2, size), np.int64)
    for toxic, own, *_ in rows:
        seen[toxic][own] += 1  # features of a text are distinct
    n = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    pos, neg = seen[1].astype(np.float64), seen[0].astype(np.float64)
    both = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, e: np.where(k > 0, k * np.log(k / e), 0.0)
        ratio = 2 * (part(pos, both * n[1] / n.sum()) + part(neg, both * n[0] / n.sum()) + part(n[1] - pos, (n.sum() - both) * n[1] / n.sum()) + part(n[0] - neg, (n.sum() - both) * n[0] / n.sum()))
    good = np.flatnonzero((pos >= MIN_DOCS) & (pos * n[0] > MIN_LIFT * neg * n[1]) & (ratio >= EVIDENCE))
    chosen = np.sort(good[np.argsort(-ratio[good], kind="stable")][:MOST_FEATURES])
    column = np.full(size, -1, np.int64)
    column[chosen] = np.arange(len(chosen))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(chosen)), np.float32)
        for i, s in enumerate(sets):
            cols = column[s]
            out[i, cols[cols >= 0]] = 1
        return out

    x = np.hstack([matrix([r[1] for r in rows]), np.ones((len(rows), 1), np.float32)])  # the last column is the bias

    def spread(gaps: list[Gap]) -> np.ndarray:
        """The sum of the squares of gaps in chosen features."""
        out = np.zeros((len(chosen), len(chosen)))
        some = [g for g in gaps if any((column[s] >= 0).any() for s in g)]
        for i in range(0, len(some), 1000):
            part = some[i : i + 1000]
            gap = (matrix([g for g, _ in part]) - matrix([c for _, c in part])).astype(np.float64)
            out += gap.T @ gap
        return out

    swaps, inserts = ([g for r in rows for g in r[k]] for k in (2, 3))
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])  # both classes weigh the same
    curb = np.zeros((len(chosen) + 1, len(chosen) + 1))
    curb[:-1, :-1] = RIDGE * np.eye(len(chosen)) + 2 * penalty * (spread(swaps) / max(1, len(swaps)) + spread(inserts) * n_terms / max(1, 2 * len(inserts)))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(share @ (np.logaddexp(0, z) - y * z) + w @ curb @ w / 2)

    w = np.zeros(len(chosen) + 1)
    for _ in range(STEPS):  # Newton's method, with shorter steps where a whole one leads up
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + curb @ w
        bend = (x * (share * p * (1 - p))[:, None].astype(np.float32)).T @ x + curb + 1e-9 * np.eye(len(w))
        step, now, size_of = np.linalg.solve(bend, slope), loss(w), 1.0
        while size_of > 1e-3 and loss(w - size_of * step) > now:
            size_of /= 2
        w = w - size_of * step
        if size_of * np.abs(step).max() < 1e-4:
            break
    return Model({int(f): float(v) for f, v in zip(chosen, w[:-1], strict=True) if v}, min(float(w[-1]), MOST_BIAS))


def train(docs: DataFrame, labels: DataFrame, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = PENALTY, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model of the sampled rows, which the driver holds; they are sorted there, so that sums don't depend on where rows lie."""
    rows = sorted(training_rows(docs, labels, terms, per_class).collect(), key=lambda r: (r.toxic, bytes(r.own)))
    return fit([unpacked(r) for r in rows], penalty, sum(len(s) for s in terms if len(s) > 1))


def unpacked(row: dict) -> tuple[int, np.ndarray, list[Gap], list[Gap]]:
    """A training row for fit."""
    array = lambda raw: np.frombuffer(raw, np.uint32)
    return row["toxic"], array(row["own"]), *([(array(g["gone"]), array(g["come"])) for g in row[k]] for k in ("swaps", "inserts"))


def with_score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and ``score``, a row for each row, repeated or not; null and empty texts get the score of a text without known words. A column named score gives way, others may have any name and hold nulls; an empty table gives no rows."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    position = len(keep)
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                scores = [own.score(t or "") for t in part.column(position).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:position], pa.array(scores, pa.float64())], [*keep, "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_whole_text"))
    return rows.mapInArrow(run, with_fields(rows.schema[:position], {"score": DoubleType()}))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score below one half, unchanged, whatever their columns are called; of repeated rows all or none stay, an empty table stays empty."""
    scored = with_score(docs.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), train(docs, labels), ["_all"])
    return scored.where(F.col("score") < 0.5).select("_all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = with_score(docs, train(docs, labels), ["doc_id"])
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
