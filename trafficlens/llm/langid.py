"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A word is its letters, lower-cased; its features are its character 2- to 4-grams with end marks, hashed into a fixed
number of buckets. A text is the mean of its feature embeddings. As the softmax is linear in that
mean, a trained model is a table of class scores per bucket, and a text's score is a sum over its words.

Training takes a bounded sample: ``PASSAGES`` passages of 1 to ``LONGEST`` words, drawn from anywhere in the text, of
``PER_LANGUAGE`` labelled documents of each language (by order of a hash of the id), and of the ``LANGUAGES`` languages
with most documents. The tasks draw them, so texts may be of any length; short passages make the scores of short texts as
careful as those of long ones. A part of the sample is held back to fit the temperature of the scores and the rejection threshold: the largest that rejects at most
``MISS`` of the held-back passages. Buckets that training never saw count as zero evidence, so foreign text drifts
towards equal scores and is rejected.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; without any labelled row
everything is ``und``; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, per_process, row_key, table

BUCKETS = 1 << 15
DIM = 16
PER_LANGUAGE = 300
LANGUAGES = 1000
PASSAGES = 8
LONGEST = 64
MISS = 0.001
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Scores (buckets x languages, float32), bias, temperature, rejection threshold."""

    languages: tuple[str, ...]
    weights: object
    bias: object
    temperature: float
    threshold: float


def _letters():
    """For each code point, whether it is a letter."""
    import numpy as np
    return per_process("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def letters_of(text: str):
    """Code points of the lower-cased letters, with a single zero for whatever stands between words and at the ends."""
    import numpy as np
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    return codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]


def features_of(codes):
    """Buckets of all 2- to 4-grams that lie within one word, its end marks included."""
    import numpy as np
    if len(codes) < 3:
        return np.empty(0, np.int64)
    word = codes != 0
    found, rolled = [], codes
    for n in (2, 3, 4):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) ^ codes[n - 1:] * np.uint32(0x9E3779B1)
        inside = np.ones(len(rolled), bool)
        for k in range(1, n - 1):
            inside &= word[k:k + len(rolled)]
        mixed = rolled[inside] ^ (rolled[inside] >> np.uint32(15))
        found.append(((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64))
    return np.concatenate(found)


def _softmax(z):
    import numpy as np
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def passages(text: str, passages: int = PASSAGES) -> list[str]:
    """Runs of whole words from places of the text that its own letters choose; their letters in lower case."""
    import numpy as np
    from zlib import crc32
    codes = letters_of(text)
    gaps = np.flatnonzero(codes == 0)
    words = len(gaps) - 1
    if words < 1:
        return []
    rng = np.random.default_rng(crc32(codes.tobytes()))
    spans = set()
    for _ in range(passages):
        n = min(words, int(rng.integers(1, LONGEST + 1)))
        first = int(rng.integers(0, words - n + 1))
        spans.add((first, n))
    read = lambda a, b: np.where(codes[a:b] == 0, 32, codes[a:b]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [read(gaps[first] + 1, min(gaps[first + n], gaps[first] + _WORD)) for first, n in sorted(spans)]


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit a model on the driver to passages (see :func:`passages`); the caller bounds their number."""
    import numpy as np
    languages = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    features, target = [], []
    for text, label in zip(texts, labels):
        ids = features_of(letters_of(text))
        if len(ids):
            features.append(np.unique(ids, return_counts=True))
            target.append(languages.index(label))
    if not features:
        return Model((), np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    order = rng.permutation(len(features))
    held, fit = order[::5], np.setdiff1d(order, order[::5])
    if not len(fit):
        fit = held
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    weight, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    seen = np.zeros(BUCKETS, bool)
    steps, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, counts = features[i]
            share = counts / counts.sum()
            mean = share @ embed[ids]
            error = _softmax(mean @ weight + bias)
            error[target[i]] -= 1
            step = rate * (1 - steps / total)
            back = weight @ error
            weight -= step * np.outer(mean, error)
            bias -= step * error
            embed[ids] -= step * 20 * np.outer(share, back)
            seen[ids] = True
            steps += 1
    embed[~seen] = 0
    scores = (embed @ weight).astype(np.float32)
    logits = np.stack([(features[i][1] / features[i][1].sum()) @ scores[features[i][0]] for i in held]) + bias
    truth = np.array(target)[held]
    at = np.arange(len(truth))
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0),
                      key=lambda t: -np.log(_softmax(logits / t)[at, truth] + 1e-12).mean())
    best = _softmax(logits / temperature).max(axis=1)
    threshold = min(float(np.quantile(best, MISS)), 0.9)
    return Model(languages, scores, bias, float(temperature), threshold)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """The bounded training sample: passages ``t`` of so many texts of each language ``l``, by order of a hash of the id.

    The texts are chosen on narrow rows; no text is shuffled.
    """
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("i"), row_key(text).alias("k"), text.alias("t"), docs[f"`{lang_col}`"].alias("l"))
    rows = rows.where("t IS NOT NULL AND l IS NOT NULL AND crc32(CAST(i AS STRING)) % 5 != 0")
    ranked = rows.select("i", "k", "l", F.xxhash64("i").alias("h")).withColumn(
        "r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "k")))
    picked = ranked.where(F.col("r") <= per_language)
    most = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    picked = picked.join(most.select("l"), "l").select("i", "k", "l").distinct()

    def draw(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(t, l) for t, l in zip(part.column("t").to_pylist(), part.column("l").to_pylist())]
                drawn = [(p, l) for t, l in found for p in passages(t)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in drawn], pa.string()),
                                                  pa.array([l for _, l in drawn], pa.string())], names=["t", "l"])

    # PER_LANGUAGE * LANGUAGES narrow rows at most, so they may be sent to the tasks that hold the texts
    chosen = rows.join(F.broadcast(picked), ["i", "k", "l"]).select("t", "l")
    return chosen.mapInArrow(draw, "t string, l string").distinct()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """Train on the labelled documents whose crc32 of the id is no multiple of five."""
    rows = sample(docs, id_col, text_col, lang_col, per_language).collect()  # bounded by the sizes of the sample
    rows.sort()
    return train([r["t"] for r in rows], [r["l"] for r in rows])


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, calibrated score and rejection of each whole text."""
    import numpy as np
    langs, scores, rejected = [], [], []
    columns = np.ascontiguousarray(np.asarray(model.weights, np.float32).T)
    for text in texts:
        total, n = np.zeros(len(columns)), 0
        for at in range(0, len(text or ""), _STEP):  # a step takes the characters before it along, so no feature is lost
            ids = features_of(letters_of(text[at:at + _STEP])) if len(text) <= _STEP else _step(text, at)
            n += len(ids)
            if len(ids):
                counts = np.bincount(ids, minlength=BUCKETS).astype(np.float32)
                total += columns @ counts if len(columns) else 0
        if not n or not model.languages:
            langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
            continue
        p = _softmax((total / n + model.bias) / model.temperature)
        k = int(p.argmax())
        langs.append(model.languages[k]), scores.append(min(1.0, float(p[k])))
        rejected.append(bool(p[k] < model.threshold))
    return langs, scores, rejected


_STEP = 1 << 20  # characters of a very long text that are taken at once
_WORD = 4096  # letters beyond which a word may be cut


def _step(text: str, at: int):
    """Features of one step of a very long text; words that reach over its end are left to the next step."""
    def edge(place: int) -> int:
        end = min(place + _WORD, len(text))
        while 0 < place < end and text[place - 1].isalpha() and text[place].isalpha():
            place += 1
        return place
    return features_of(letters_of(text[edge(at):edge(at + _STEP)]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
            names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Add language, score and rejection to the kept columns (all by default); reads whole texts, no shuffle."""
    from pyspark.sql import types as T
    kept = docs.columns if keep is None else keep
    at_text = kept.index(text_col) if text_col in kept else len(kept)  # the text travels once
    base = docs.select(*[docs[f"`{c}`"] for c in kept], *[docs[f"`{text_col}`"]][:at_text + 1 - len(kept)])
    fields = base.schema.fields[:len(kept)]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()),
                           T.StructField(names[2], T.BooleanType())])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores, rejected = score_texts(model, part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(fields)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(rejected, pa.bool_())], names=schema.names)

    return base.mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose language the model accepts, with their columns."""
    model = fit(docs, id_col, text_col, lang_col)
    names = [fresh(docs.columns, n) for n in ("_lang_pred", "_lang_score", "_lang_rejected")]
    return predict(docs, model, text_col, names=tuple(names)).where(~F.col(names[2])).drop(*names)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return predict(rows, fit(docs), keep=["doc_id", "held_out"])
