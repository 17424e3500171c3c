"""Toxicity: words hidden by leetspeak, spacing or repetition are restored first, then the text is scored.

Noisy channel: a suspicious token is a lattice of the letters each character may stand for; repeated letters and separators
may have been put in, and where separators stand a word may end. Viterbi search finds the likeliest letters under a character trigram model, counted over all
documents, to which the words that tell toxic documents apart (learned from labels) add their own trigrams.

Score: words, and their beginnings of 4 and 5 letters, that occur in more toxic than other training documents beyond
chance (likelihood ratio, corrected for the number of candidates) are a lexicon with log odds; a logistic regression
over their sum, number and density gives the probability. Lexicon and regression are fitted on a bounded sample of
labelled rows (`sample`), of which copies (equal sets of words, equal label) count once; the trigrams are counted over everything.

Defined results: null and empty texts have no words and get the score of a text without toxic words; tokens of
any length are decoded; several labels of one doc_id count as their largest; without labels of both kinds
every score is the share of toxic labels, or 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, LEXICON, THRESHOLD = 20_000, 20_000, 0.3

# What characters stand for in leetspeak, and what is put between letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
BETWEEN = " .-_*·~'’,"
ENDS = " .-_·~"  # of these, what may also part two words

ALPHABET = "\x00abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿœ"
N = len(ALPHABET) + 1  # the last is any other letter
INDEX = np.full(0x10000, N - 1, "i2")
for _i, _c in enumerate(ALPHABET):
    INDEX[ord(_c)] = _i

WORD = re.compile(r"[^\W\d_]+")
_L = r"[^\W\d_]"
_S = "[" + re.escape("".join(c for c in LEET if not c.isdigit())) + r"\d]"
SPACED = re.compile(r"(?<!\S)(?:\w[ ]){3,}\w(?!\w)")  # s p a c e d
TRIPLE = re.compile(rf"({_L})\1\1")  # looong
INSIDE = re.compile(
    rf"{_S}*{_L}+(?:{_S}|[.\-_*·~]+{_L}|{_L})*{_S}{_L}(?:{_S}|{_L})*"  # a leet sign before a letter, inside a word
    rf"|{_S}{{1,3}}{_L}{{2,}}"
    rf"|(?:{_L}[.\-_*·~]+){{3,}}{_L}"  # s.e.p.a.r.a.t.e.d
    rf"|{_L}+[*#]+{_L}+"
)
# The branches of INSIDE for long tokens: the first without backtracking, the run that it reads, and the others.
LEETED = re.compile(rf"{_S}*+{_L}(?:(?:{_L}|{_S}*+[.\-_*·~]++{_L})*+{_S}++{_L})++(?:{_S}|{_L})*+")
RUN = re.compile(rf"{_S}*+{_L}(?:{_L}|{_S}*+[.\-_*·~]++{_L})*+{_S}*+")
OTHERS = re.compile(rf"{_S}{{1,3}}{_L}{{2,}}+|(?:{_L}[.\-_*·~]++){{3,}}{_L}")
CENSORED, LETTERS = re.compile(rf"{_L}++[*#]++{_L}++"), re.compile(rf"{_L}++")
AROUND = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def inside(token: str) -> list[str]:
    """Matches of INSIDE. What a failed try has read of a long token is not read again, so the time stays linear."""
    if len(token) <= 200:
        return [m[0] for m in INSIDE.finditer(token)]
    out, at, plain, uncensored = [], 0, 0, 0
    while at < len(token):
        m = None
        if at >= plain and not (m := LEETED.match(token, at)) and (run := RUN.match(token, at)):
            plain = run.end()
        m = m or OTHERS.match(token, at)
        if not m and at >= uncensored and not (m := CENSORED.match(token, at)) and (run := LETTERS.match(token, at)):
            uncensored = run.end()
        if m:
            out.append(m[0])
        at = m.end() if m else at + 1
    return out


def suspicious(low: str) -> list[str]:
    """Tokens of a lower-case text that may hide a word, each once for each place it stands at."""
    tokens = low.split()
    out = SPACED.findall(low) if "1111" in "".join(["1" if len(t) == 1 or (len(t) == 2 and not t[1].isalnum()) else "0" for t in tokens]) else []
    for t in tokens:
        if not t.isalpha():
            core = t.strip(AROUND)
            if not core.isalpha():
                out += inside(t.rstrip(".,;:?!"))
            elif len(core) < len(t) and t[0] in LEET and len(t) - len(core) <= 2:
                out.append(t.rstrip(AROUND))  # a leading sign may be a letter
    if TRIPLE.search(low):
        out += [w for w in WORD.findall(low) if TRIPLE.search(w)]
    return out


def trigrams(text: str) -> np.ndarray:
    """Indices of the character trigrams of the words, two starts and one end to each word."""
    code = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
    letters = INDEX[code].astype("i4")
    other = letters == N - 1
    if other.any():
        alpha = np.array([chr(c).isalpha() for c in np.unique(code[other])])
        gap = np.isin(code, np.unique(code[other])[~alpha])
        letters[gap] = 0
    letters = np.concatenate([[0, 0], letters, [0]])
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    keep = (b > 0) | (c > 0)
    a = np.where(b == 0, 0, a)
    return (a * N + b)[keep] * N + c[keep]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts over all documents; at most N ** 3 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, "i8")
        for b in common.slices(batches, "text", 1_000_000):
            total += np.bincount(trigrams("\n".join(t for t in b.column("text").to_pylist() if t)), minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(N**3, "f8")
    out[rows["at"].to_numpy("i8")] = rows["n"].to_numpy("f8")
    return out


class Restorer:
    """Viterbi decoding of suspicious tokens under a trigram model."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float] | None = None):
        counts = counts.copy()
        if lexicon:
            share = counts.sum() / (2 * len(lexicon)) + 1
            for w in lexicon:
                np.add.at(counts, trigrams(w), share / (len(w) + 1))
        cube = counts.reshape(N, N, N)
        bi = cube.sum(0)
        uni = bi.sum(0) + 1
        p1 = uni / uni.sum()
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        self.cost = (-np.log((cube + 2 * p2[None]) / (cube.sum(2, keepdims=True) + 2))).astype("f4")
        self.slack = 2 * float(self.cost.max() - self.cost.min()) + 4
        self.known: dict[str, str] = {}

    def restore(self, token: str) -> str:
        """The letters that most likely were meant."""
        token = token.lower()
        if len(token) > 200:
            return self._viterbi(token)
        if token not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[token] = self._viterbi(token)
        return self.known[token]

    def _viterbi(self, token: str) -> str:
        if not any(c.isalpha() for c in token):
            return token
        # Two letters and the last sign read, with the cost and the letters so far, linked backwards.
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for c in token:
            index = int(INDEX[ord(c)]) if ord(c) < 0x10000 else N - 1
            ways = [(c, 0.05)] if c.isalpha() else [(x, 0.7) for x in LEET.get(c, "")]
            if c in "*#":
                ways += [(x, 2.5) for x in "aeiou"]
            skip = 0.4 if c in BETWEEN else 3.0 if not c.isalnum() else None
            new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, last), (cost, word) in states.items():
                for x, extra in ways:
                    i = index if x == c else int(INDEX[ord(x)])
                    key, total = (b, i, x), cost + extra + float(self.cost[a, b, i])
                    if key not in new or total < new[key][0]:
                        new[key] = (total, (word, x))
                drop = 0.5 if c.isalpha() and c == last else 1.0 if last and last in LEET.get(c, "") else skip
                if drop is not None:
                    key, total = (a, b, last), cost + drop
                    if key not in new or total < new[key][0]:
                        new[key] = (total, word)
                if b and c in ENDS:  # a word may end here
                    key, total = (0, 0, ""), cost + skip + float(self.cost[a, b, 0])
                    if key not in new or total < new[key][0]:
                        new[key] = (total, (word, " "))
            if not new:
                return token
            # After two letters more, all states go on alike: who is further behind than those can cost cannot win.
            least = min(cost for cost, _ in new.values()) + self.slack
            states = {k: v for k, v in new.items() if v[0] <= least}
        word = min(((cost + (float(self.cost[a, b, 0]) if b else 0.0), word) for (a, b, _), (cost, word) in states.items()), key=lambda x: x[0])[1]
        out = []
        while word:
            word, x = word
            out.append(x)
        return "".join(reversed(out)).strip() or token

    def text(self, text: str) -> str:
        """The whole text with its suspicious tokens restored."""
        for t in sorted(set(suspicious(text.lower())), key=len, reverse=True):
            text = re.sub(re.escape(t), lambda _, t=t: self.restore(t), text, flags=re.I)
        return text


def counted(text: str | None, restorer: Restorer | None) -> tuple[Counter, int]:
    """Counts of the words, restored ones too, and the number of words that the text shows."""
    low = (text or "").lower()
    words = Counter(WORD.findall(low))
    n = words.total()
    if restorer is not None:
        for t in suspicious(low):
            for w in WORD.findall(restorer.restore(t)):
                words[w] += 1
    return words, n


def features(text: str | None) -> set[str]:
    """Words and their beginnings."""
    words = counted(text, None)[0].keys()
    return {*words, *(w[:4] + "…" for w in words if len(w) > 4), *(w[:5] + "…" for w in words if len(w) > 5)}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Lexicon, regression and restorer; its size is bounded by LEXICON and the alphabet."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None, share: float, counts: np.ndarray):
        self.lexicon, self.weights, self.share, self.counts = lexicon, weights, share, counts
        self.restorer: Restorer | None = None
        self.begins: tuple[dict[str, float], dict[str, float]] = {}, {}

    def __getstate__(self):
        return self.__dict__ | {"restorer": None}

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        if self.restorer is None:
            self.restorer = Restorer(self.counts, {w: v for w, v in self.lexicon.items() if not w.endswith("…")})
            begins = lambda size: {w[:-1]: v for w, v in self.lexicon.items() if w.endswith("…") and len(w) == size + 1}
            self.begins = begins(4), begins(5)
        words, n = counted(text, self.restorer)
        weight, hits = 0.0, 0
        four, five = self.begins
        for w, k in words.items():
            size = len(w)
            for v in (self.lexicon.get(w), four.get(w[:4]) if size > 4 else None, five.get(w[:5]) if size > 5 else None):
                if v is not None:
                    weight, hits = weight + v, hits + k
        return math.log1p(weight), math.log1p(hits), math.log1p(1000 * hits / max(n, 20))

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.share
        z = float(self.weights[0] + np.dot(self.weights[1:], self.evidence(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learned(texts: DataFrame, marked: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, y of the rows drawn; of texts with the same set of words and the same label one stays."""
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` rows at most

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            sig = [xxhash.xxh3_128_digest(b" ".join(sorted(set((t or "").lower().encode("utf-8", "surrogatepass").split())))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("text"), pa.array(sig, pa.binary())], names=["doc_id", "y", "text", "sig"])

    drawn = common.cut(texts.join(chosen, "doc_id").mapInArrow(signed, "doc_id long, y int, text string, sig binary"))  # `sample` documents
    once = drawn.groupBy("sig", "y").agg(F.min("doc_id").alias("doc_id"))
    return common.cut(drawn.join(F.broadcast(once), ["sig", "y", "doc_id"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("y").alias("y")), old=[drawn], files=common.FEWEST_FILES)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic, of the rows that may be learned from."""
    spark = docs.sparkSession
    common.tune(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = count_trigrams(texts)
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    rows = learned(texts, marked, sample)
    n0, n1 = (rows.where(f"y {op} 0").count() for op in ("<=", ">"))
    if not n0 or not n1:
        return Model({}, None, n1 / (n0 + n1) if n0 + n1 else 0.0, counts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def told():
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in seen)], names=["f", "n0", "n1"])
            seen[0].clear()
            seen[1].clear()

        for b in common.slices(batches, "text", 1_000_000):
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen[y > 0].update(features(t))
            if len(seen[0]) + len(seen[1]) > 100_000:
                yield from told()
        yield from told()

    tallied = rows.mapInArrow(tally, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    tallied = common.cut(tallied.where("n1 >= 2"), files=common.FEWEST_FILES)
    candidates = max(tallied.count(), 10)
    a, b, c, d = F.col("n1"), F.col("n0"), F.lit(n1) - F.col("n1"), F.lit(n0) - F.col("n0")
    part = lambda k, e: F.when((k > 0) & (e > 0), k * F.log(F.try_divide(k, e))).otherwise(0.0)
    total = float(n0 + n1)
    ratio = 2 * (part(a, (a + b) * n1 / total) + part(b, (a + b) * n0 / total) + part(c, (c + d) * n1 / total) + part(d, (c + d) * n0 / total))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    best = tallied.withColumn("g", ratio).withColumn("w", odds).where(f"w > 1 and g > {2 * math.log(candidates)}").orderBy(F.desc("g"), "f").limit(LEXICON)
    lexicon = {r.f: r.w for r in best.select("f", "w").collect()}  # LEXICON rows at most
    model = Model(lexicon, None, n1 / total, counts)
    shared = spark.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            x = np.array([shared.value.evidence(t) for t in b.column("text").to_pylist()], "f8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), b.column("y")], names=["a", "b", "c", "y"])

    seen = rows.mapInArrow(told, "a double, b double, c double, y int").toPandas()  # `sample` rows at most
    model.weights = _logistic(seen[["a", "b", "c"]].to_numpy("f8"), (seen["y"] > 0).to_numpy("f8"))
    common.drop(rows, tallied)
    return model


def score(docs: DataFrame, model: Model, out: str = "toxicity_score") -> DataFrame:
    """docs with the column out; rows and other columns as they are, but for a former column of that name."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shared.value.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=[*b.schema.names, out])

    from pyspark.sql import types as T

    docs = docs.drop(out).withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(common.fold(F.col("doc_id"), 4) != 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    held = common.fold(F.col("doc_id"), 4) == 2
    scored = score(docs, model).withColumnRenamed("toxicity_score", "score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
