"""Language identification with averaged hashed subword embeddings and a linear softmax.

A word's subwords are its character 1- to 4-grams between boundary marks and the word itself, hashed
into a table of embeddings. A text is the mean of its subwords' embeddings; a linear softmax over
it gives the languages. Both layers are trained by stochastic gradient descent in numpy on a bounded
sample: the ``per_language`` labelled rows with the least id hash of each language, cut into short
and long segments. A share of the sample is held back to fit a temperature, so that scores are
calibrated, and to set the two bounds of rejection: a least probability, and a least familiarity. The
latter is for text unlike all that was learned, of which a softmax may be sure all the same: the share of
a text's subwords of three characters and more that training has met, which may be lower in a short text.

Prediction is one pass without a shuffle over whole texts: embeddings and softmax fold into one row
of numbers per hash cell, a task scores each distinct word once and sums words. The model is a fixed
size (cells x languages) and is broadcast.

Edge cases: a null text or one without a letter is ``und`` with score 0, and is rejected. Rows
without text, language or id are never learned from. Without any labelled row everything is ``und``.
Equal texts get equal predictions; ids and labels of a row are never inputs. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import made_once, per_worker, rows_of

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdParams:
    per_language: int = 1000  # bound of the sample, in rows of each language; Spark limits groups of up to 1000 early
    cells: int = 1 << 16
    width: int = 16
    longest: int = 4  # characters of the longest subword
    epochs: int = 5
    least_steps: int = 600  # a small sample is gone over more often
    batch: int = 64
    rate: float = 4.0
    calibration: float = 0.2  # share of the sample that sets temperature and threshold
    most_rejected: float = 0.0003  # share of correctly labelled segments that each bound of rejection may lose
    telling: int = 3  # characters of the shortest subword that counts for familiarity
    seed: int = 7
    remember: int = 300_000  # words a worker remembers


def subword_codes(word: str, params: LangIdParams) -> tuple[list[int], list[int]]:
    """Hashes of a lower-case word's subwords, those too short to tell familiar text and the others; none for a word without a letter."""
    if not any(map(str.isalpha, word)):
        return [], []
    marked = f"<{word}>"
    short = [marked[i : i + n] for n in range(1, params.telling) for i in range(n == 1, len(marked) - n + 1 - (n == 1))]
    long = [marked[i : i + n] for n in range(params.telling, params.longest + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(s.encode()) for s in short], [zlib.crc32(s.encode()) for s in (*long, marked)]


def grams_of(words: list[str], params: LangIdParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``subword_codes`` of many words: the short ones of all, how many each word has, and the same of the long ones.

    In ASCII words a subword is a slice of bytes, so a word is encoded once.
    """
    crc, short, long, n_short, n_long = zlib.crc32, [], [], [], []
    for word in words:
        if word.isascii():
            at_short, at_long, marked = len(short), len(long), f"<{word}>".encode()
            size = len(marked)
            for n in range(1, params.telling):
                edge = n == 1
                short += [crc(marked[i : i + n]) for i in range(edge, size - n + 1 - edge)]
            for n in range(params.telling, params.longest + 1):
                long += [crc(marked[i : i + n]) for i in range(size - n + 1)]
            long.append(crc(marked))
            n_short.append(len(short) - at_short)
            n_long.append(len(long) - at_long)
        else:
            a, b = subword_codes(word, params)
            short += a
            long += b
            n_short.append(len(a))
            n_long.append(len(b))
    return np.array(short, np.int64), np.array(n_short, np.int64), np.array(long, np.int64), np.array(n_long, np.int64)


def sums_by_word(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of the given sizes; 0 for an empty run."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    held = np.flatnonzero(sizes)
    if len(held):
        starts = (np.cumsum(sizes) - sizes)[held]
        out[held] = np.add.reduceat(values, starts, axis=0)
    return out


def word_scores(words: list[str], table: np.ndarray, seen: np.ndarray, params: LangIdParams) -> np.ndarray:
    """Of each word: the sum of its subwords' rows of ``table``, their number, the share of telling ones that were met, and 1; zeros without a letter."""
    short, n_short, long, n_long = grams_of(words, params)
    k = table.shape[1]
    out = np.zeros((len(words), k + 3))
    out[:, :k] = sums_by_word(table[short % params.cells], n_short) + sums_by_word(table[long % params.cells], n_long)
    out[:, k] = n_short + n_long
    out[:, k + 1] = sums_by_word(seen[long % SEEN_CELLS].astype(np.float64), n_long) / np.maximum(n_long, 1)
    out[:, k + 2] = n_long > 0
    return out


def subwords(word: str, params: LangIdParams) -> list[int]:
    """Cells of a word's subwords in the table of embeddings."""
    short, long = subword_codes(word, params)
    return [code % params.cells for code in short + long]


def telling_subwords(word: str, params: LangIdParams) -> list[int]:
    """Cells, in the table of subwords met, of those that tell familiar text from other."""
    return [code % SEEN_CELLS for code in subword_codes(word, params)[1]]


#: Cells of the table of subwords met in training, a byte each.
SEEN_CELLS = 1 << 21


@dataclass
class Familiarity:
    """What text of the learned languages is like: mean share of met subwords, its spread by word and by text, and the deviation allowed."""

    seen: np.ndarray
    mean: float = 0.0
    by_word: float = 0.0
    by_text: float = 0.0
    allowed: float = 0.0

    def spread(self, words: int) -> float:
        return max(1e-9, self.by_word / words**0.5 + self.by_text)

    def least(self, words: int) -> float:
        """The least mean share of a text of so many different words: a word's repetitions tell nothing more."""
        return self.mean - self.allowed * self.spread(words) - 1e-9


def familiarity(sample: list[tuple[str, str]], held_back: np.ndarray, params: LangIdParams) -> Familiarity:
    """Subwords are learned from the rows that are not held back; the bound is set by those that are, whole and in pieces."""
    known = {w for (text, _), back in zip(sample, held_back, strict=True) if not back for w in WORD.findall(text.lower())}
    seen = np.zeros(SEEN_CELLS, np.bool_)
    for word in known:
        seen[telling_subwords(word, params)] = True
    out = Familiarity(seen)
    cached: dict[str, float] = {}
    texts = []
    for (text, _), back in zip(sample, held_back, strict=True):
        if back:
            words = [w for w in WORD.findall(text.lower()) if any(map(str.isalpha, w))]
            for w in {w for w in words if w not in cached}:
                cached[w] = float(seen[telling_subwords(w, params)].mean())
            if words:
                texts.append(words)
    if not texts:
        return out
    share = lambda words: float(np.mean([cached[w] for w in words]))
    means = np.array([share(t) for t in texts])
    out.mean, out.by_text = float(means.mean()), float(means.std())
    out.by_word = float(np.std([cached[w] for t in texts for w in t]))
    parts = [t[i : i + n] for t in texts for n in (2, 8, 40, len(t)) for i in range(0, len(t), n)]
    deviation = [(out.mean - share(p)) / out.spread(len(set(p))) for p in parts]
    out.allowed = max(0.0, float(np.quantile(deviation, 1 - params.most_rejected, method="higher")))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # cells x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: Familiarity


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, params: LangIdParams) -> list[tuple[str, str]]:
    """(text, lang) of at most ``per_language`` rows a language that are not held out."""
    rank = F.xxhash64("doc_id")
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out())
    order = Window.partitionBy("lang").orderBy("rank")
    # Spark keeps only per_language rows of a partition before it shuffles; texts are not read yet
    least = usable.select("lang", rank.alias("rank")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= params.per_language)
    most = {r["lang"]: r["most"] for r in least.groupBy("lang").agg(F.max("rank").alias("most")).collect()}
    if not most:
        return []
    wanted = F.lit(False)
    for lang, limit in sorted(most.items()):
        wanted = wanted | ((F.col("lang") == lang) & (rank <= limit))
    # ids may repeat and so may ranks: the bound is on rows
    rows = usable.where(wanted).select(rank.alias("rank"), "text", "lang").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))).where(F.col("n") <= params.per_language).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["rank"], r["text"], r["lang"]))]


def segments(sample: list[tuple[str, str]], params: LangIdParams) -> tuple[list[list[int]], list[str], np.ndarray]:
    """Subword cells and language of three segments of each text, and the number of the text."""
    rng = np.random.default_rng(params.seed)
    known: dict[str, list[int]] = {}
    cells, langs, owner = [], [], []
    for number, (text, lang) in enumerate(sample):
        words = WORD.findall(text.lower())
        for length in (2, 8, 40):
            start = int(rng.integers(0, max(1, len(words) - length + 1)))
            found = []
            for w in words[start : start + length]:
                if w not in known:
                    known[w] = subwords(w, params)
                found += known[w]
            if found:
                cells.append(found)
                langs.append(lang)
                owner.append(number)
    return cells, langs, np.array(owner, np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(sample: list[tuple[str, str]], params: LangIdParams) -> Model:
    languages = sorted({lang for _, lang in sample})
    k = len(languages)
    cells, langs, owner = segments(sample, params)
    rng = np.random.default_rng(params.seed + 1)
    embed = rng.normal(0, 0.1, (params.cells, params.width))
    weights, bias = rng.normal(0, 0.1, (params.width, k)), np.zeros(k)
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[lang] for lang in langs], np.int64)
    every = max(2, round(1 / params.calibration))
    back = owner % every == 0
    learn = np.flatnonzero(~back)

    def forward(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(cells[r]) for r in rows])
        flat = np.concatenate([cells[r] for r in rows]).astype(np.int64)
        mean = np.add.reduceat(embed[flat], np.concatenate([[0], sizes.cumsum()[:-1]])) / sizes[:, None]
        return mean, mean @ weights + bias, flat, sizes

    batches = -(-len(learn) // params.batch)
    epochs = max(params.epochs, -(-params.least_steps // batches)) if batches else 0
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), batches):
            rate = params.rate * (1 - step / steps)
            step += 1
            mean, logits, flat, sizes = forward(rows)
            error = softmax(logits)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            to_embed = (error @ weights.T) / sizes[:, None]
            weights -= rate * (mean.T @ error)
            bias -= rate * error.sum(axis=0)
            np.add.at(embed, flat, -rate * np.repeat(to_embed, sizes, axis=0))
    temperature, threshold = 1.0, 0.0
    if len(kept := np.flatnonzero(back)):
        logits = forward(kept)[1]
        choices = np.geomspace(0.05, 5, 60)
        loss = [-np.log(softmax(logits / t)[np.arange(len(kept)), y[kept]] + 1e-12).mean() for t in choices]
        temperature = float(choices[int(np.argmin(loss))])
        p = softmax(logits / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[kept]]
        if len(right):
            threshold = float(np.quantile(right, params.most_rejected))
    return Model(languages, embed @ weights, bias, temperature, threshold, familiarity(sample, np.arange(len(sample)) % every == 0, params))


def identify(spark: SparkSession, docs: DataFrame, params: LangIdParams = LangIdParams(), model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted, per row of ``docs``; extra columns are dropped."""
    if model is None:
        model = train(training_sample(docs, params), params)
    return predict(spark, docs, model, params)


def predict(spark: SparkSession, docs: DataFrame, model: Model, params: LangIdParams = LangIdParams(), carry: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """Predictions per row under ``names``; ``carry`` names columns of ``docs`` to keep beside them."""
    # arrays and numbers only: a broadcast names its classes, and workers need not have this package
    sent = spark.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.threshold, astuple(model.familiar)))
    cell = per_worker(spark)
    others = [F.col(f"`{c}`") for c in carry if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    kept = [c for c in rows.columns if c in carry or c == "doc_id"]
    if not carry:
        rows = rows.withColumn("held_out", is_held_out())
        kept.append("held_out")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, bias, temperature, threshold, likeness = sent.value
        familiar = Familiarity(*likeness)
        k = len(languages)
        held = made_once(cell, lambda: {"number": {}, "scores": np.zeros((1024, k + 3))})  # of a word: languages, subwords, share of those met, 1
        for batch in batches:
            langs, values, accepted = [], [], []
            if len(held["number"]) > params.remember:
                held["number"] = {}
            number, scores = held["number"], held["scores"]
            for (text,) in rows_of(iter([batch]), "text", at_once=200):
                words = WORD.findall((text or "").lower()) if k else []
                distinct = set(words)
                fresh = list(distinct.difference(number))
                for begin in range(0, len(fresh), 4096):
                    some = fresh[begin : begin + 4096]
                    at = len(number)
                    while at + len(some) > len(scores):
                        scores = held["scores"] = np.concatenate([scores, np.zeros_like(scores)])
                    scores[at : at + len(some)] = word_scores(some, table, familiar.seen, params)
                    number.update(zip(some, range(at, at + len(some)), strict=True))
                total = scores[np.fromiter(map(number.__getitem__, words), np.int64, len(words))].sum(axis=0)
                if total[k] == 0:
                    langs.append(UNDETERMINED)
                    values.append(0.0)
                    accepted.append(False)
                    continue
                p = softmax((total[None, :k] / total[k] + bias) / temperature)[0]
                langs.append(languages[int(p.argmax())])
                values.append(float(p.max()))
                accepted.append(bool(values[-1] >= threshold and total[k + 1] / total[k + 2] >= familiar.least(len(distinct))))
            carried = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.record_batch([*carried, pa.array(langs, pa.string()), pa.array(values, pa.float64()), pa.array(accepted, pa.bool_())], names=[*kept, *names])

    return rows.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
