"""Quality classifier by co-training of two views of a page.

The content view is what the words look like: shares of hashed word shapes and of hashed words. The metadata view is
what is known about the page around its words: source, language, length, and layout figures (lines, their lengths,
repeats). Each view has a linear classifier. In every round both label the documents that have no label; what one view
is confident about joins the training rows of the other. At the end, both scores are calibrated on held-back labelled
rows and combined by a logistic fit, which scores every document.

A classifier is fitted by least squares on +1 and -1, both classes weighing the same, so a round is one pass over all
rows: tasks add up outer products, a second stage adds up those, and the driver solves a system of fixed size. Labelled
rows, unlabelled rows and statistics are never sampled. Calibration counts rows in a fixed grid of scores.

Labels are an average of a document's label rows, cut at one half. A fifth of the labelled documents (by crc32 of the
id) is held back from every fit. ``keep`` is false where the combined score is under the level that at most ``LOST`` of
the held-back good documents fall under.

Defined results: a null or empty text has an empty content view and counts as length zero; null source, language or id
are values like any other (a null id has no label); labels that are null or of unknown documents are ignored; without
labels of both classes every score is 0.5 and everything is kept; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lookup, kept_by, materialise, per_process, row_key, table

SHAPES, WORDS = 64, 64
CONTENT = SHAPES + WORDS + 1
META = 40
ROUNDS = 3
CONFIDENT = 0.95
LOST = 0.005
GRID = 40
_FOLDS = 5


def _code(chunk: str) -> int:
    """Bucket of a chunk's shape times the number of word buckets, plus the bucket of its word."""
    from zlib import crc32
    shape, last = [], ""
    for c in chunk:
        now = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if now != last:
            shape.append(now)
            last = now
    long = "+" if len(chunk) > 24 else ""
    word = "".join(ch for ch in chunk.lower() if ch.isalpha())
    return (crc32(("".join(shape) + long).encode("utf-8", "surrogatepass")) % SHAPES * WORDS
            + crc32(word.encode("utf-8", "surrogatepass")) % WORDS)


def content_view(text: str):
    """Square roots of the shares of shapes and words, and a constant."""
    import numpy as np
    known = kept_by("cotraining", "codes", lambda: Lookup(_code))
    chunks = text.split()
    out = np.zeros(CONTENT, np.float32)
    out[-1] = 1
    if chunks:
        codes = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        out[:SHAPES] = np.sqrt(np.bincount(codes // WORDS, minlength=SHAPES) / len(chunks))
        out[SHAPES:-1] = np.sqrt(np.bincount(codes % WORDS, minlength=WORDS) / len(chunks))
    return out


def meta_view(source: str | None, lang: str | None, text: str):
    """Hashed source and language, bands of the length, and layout figures."""
    from zlib import crc32

    import numpy as np
    out = np.zeros(META, np.float32)
    out[crc32(b"s" + (source or "").encode("utf-8", "surrogatepass")) % 12] = 1
    out[12 + crc32(b"l" + (lang or "").encode("utf-8", "surrogatepass")) % 6] = 1
    out[18 + min(len(text).bit_length(), 20) // 2] = 1
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        sizes = np.array([len(x) for x in lines])
        out[29] = 1 - len(set(lines)) / len(lines)
        out[30] = np.log1p(sizes.mean()) / 10
        out[31] = np.log1p(len(lines)) / 10
        out[32] = (sizes < 40).mean()
        out[33] = text.count("|") / len(text) * 10
        out[34] = sum(x[-1:] in ".!?…:\"" for x in lines) / len(lines)
        out[35] = text.count(" ") / len(text) * 4
        out[36] = min(1.0, text.count("http") / len(lines))
    out[-1] = 1
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             lang_col: str = "lang") -> DataFrame:
    """(doc_id, k_text, content, meta): both views of every document as bytes of 8-bit values."""
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), row_key(text).alias("k_text"), text.alias("text"),
                       docs[f"`{source_col}`"].cast("string").alias("source"),
                       docs[f"`{lang_col}`"].cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            content = [_packed(content_view(t)) for t in texts]
            meta = [_packed(meta_view(s, lang, t)) for s, lang, t in
                    zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k_text"),
                                              pa.array(content, pa.binary()), pa.array(meta, pa.binary())],
                                             ["doc_id", "k_text", "content", "meta"])

    def _packed(view):
        import numpy as np
        return np.clip(np.rint(view * 255), 0, 255).astype(np.uint8).tobytes()

    return rows.mapInArrow(run, f"doc_id {kind}, k_text bigint, content binary, meta binary")


@dataclass(frozen=True)
class View:
    """Weights of a view's classifier and its calibration: probability = sigmoid(a * score + b)."""

    weights: object
    a: float
    b: float

    def chance(self, x):
        import numpy as np
        return 1 / (1 + np.exp(-np.clip(self.a * (x @ self.weights) + self.b, -30, 30)))


def _matrix(column, width: int):
    import numpy as np
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    return raw.astype(np.float64) / 255


def _sums(rows: DataFrame, views: tuple[View, View] | None, confident: float):
    """Per view and class: outer products, sums and numbers of the rows to learn from. One pass over all rows."""
    import numpy as np
    sizes = [n * n + n + 1 for n in (CONTENT, META) for _ in (0, 1)]
    total = sum(sizes)

    def run(batches):
        import pyarrow as pa
        out = np.zeros(total)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [_matrix(batch.column("content"), CONTENT), _matrix(batch.column("meta"), META)]
            y = np.array([-1 if v is None else v for v in batch.column("y").to_pylist()])
            # each view learns from the labels and, where there are none, from what the other view is sure of
            target = [y.copy(), y.copy()]
            if views:
                for own, other in ((0, 1), (1, 0)):
                    p, free = views[other].chance(x[other]), y == -1
                    target[own][free & (p >= confident)] = 1
                    target[own][free & (p <= 1 - confident)] = 0
            at = 0
            for k, n in enumerate((CONTENT, META)):
                for c in (0, 1):
                    part = x[k][target[k] == c]
                    out[at:at + n * n] += (part.T @ part).ravel()
                    out[at + n * n:at + n * n + n] += part.sum(axis=0)
                    out[at + n * n + n] += len(part)
                    at += n * n + n + 1
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    def add(batches):
        import pyarrow as pa
        out = np.zeros(total)
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                out += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(run, "sums binary").repartition(8).mapInArrow(add, "sums binary")
    whole, out, at = np.zeros(total), [], 0
    for row in parts.collect():  # eight rows of fixed size
        whole += np.frombuffer(row["sums"])
    for n in (CONTENT, META):
        pair = []
        for _ in (0, 1):
            raw = whole[at:at + n * n + n + 1]
            pair.append((raw[:n * n].reshape(n, n), raw[n * n:-1], raw[-1]))
            at += n * n + n + 1
        out.append(pair)
    return out


def _solve(pair):
    """Least squares on -1 and +1 with both classes weighing the same."""
    import numpy as np
    (a0, s0, n0), (a1, s1, n1) = pair
    n0, n1 = max(n0, 1), max(n1, 1)
    return np.linalg.solve(a0 / n0 + a1 / n1 + 1e-3 * np.eye(len(s0)), s1 / n1 - s0 / n0)


def _grid(rows: DataFrame, weights) -> list:
    """(bin of content score, bin of metadata score, label, rows) of the held-back labelled rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            score = [_matrix(batch.column(c), n) @ w for c, n, w in (("content", CONTENT, weights[0]),
                                                                     ("meta", META, weights[1]))]
            bins = [np.clip(((s + 2) / 4 * GRID).astype(np.int64), 0, GRID - 1) for s in score]
            yield pa.RecordBatch.from_arrays([pa.array(bins[0]), pa.array(bins[1]), batch.column("held").cast("int64")],
                                             ["i", "j", "y"])

    counted = rows.where("held IS NOT NULL").mapInArrow(run, "i bigint, j bigint, y bigint").groupBy("i", "j", "y").count()
    return [tuple(r) for r in counted.collect()]  # at most two rows per cell of the grid


def _logistic(x, y, weight):
    """Logistic fit of a few weighted points by Newton steps, with a slight pull towards zero."""
    import numpy as np
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta += np.linalg.solve(bend, slope)
    return beta


def _centre(bins):
    import numpy as np
    return (np.asarray(bins) + 0.5) / GRID * 4 - 2


@dataclass(frozen=True)
class Classifier:
    """Both views, the weights of their log odds and a constant, and the score under which a document is dropped."""

    content: View
    meta: View
    combine: tuple[float, float, float]
    level: float

    def scores(self, content, meta):
        """Content, metadata and combined score of rows of features."""
        import numpy as np
        a, b = self.content.chance(content), self.meta.chance(meta)
        z = self.combine[0] * np.log(a / (1 - a)) + self.combine[1] * np.log(b / (1 - b)) + self.combine[2]
        return a, b, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Add ``y`` (label to learn from) and ``held`` (label held back) to feature rows; both null without a label."""
    value = labels.select(labels[f"`{id_col}`"].alias("label_id"), labels[f"`{label_col}`"].alias("label")).where(
        "label_id IS NOT NULL AND label IS NOT NULL").groupBy("label_id").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label"))
    back = F.crc32(F.col("doc_id").cast("string")) % _FOLDS == 0
    joined = rows.join(value, rows["doc_id"] == value["label_id"], "left")
    return joined.select("doc_id", "k_text", "content", "meta", F.when(~back, F.col("label")).alias("y"),
                         F.when(back, F.col("label")).alias("held"))


def train(rows: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, lost: float = LOST) -> Classifier | None:
    """Co-train on (content, meta, y, held); one pass over all rows a round and one for each calibration."""
    import numpy as np
    views = None
    for k in range(rounds + 1):  # the first pass has the labels alone
        sums = _sums(rows, views, confident)
        if k == 0 and (sums[0][0][2] == 0 or sums[0][1][2] == 0):
            return None
        weights = [_solve(pair) for pair in sums]
        grid = _grid(rows, weights)
        made = []
        for axis, w in enumerate(weights):
            x = _centre([g[axis] for g in grid])
            a, b = _logistic(x[:, None], np.array([g[2] for g in grid]), np.array([g[3] for g in grid])) if grid else (1, 0)
            made.append(View(w, float(a), float(b)))
        views = (made[0], made[1])
    if not grid:
        return Classifier(*views, (0.5, 0.5, 0.0), 0.0)
    odds = np.column_stack([v.a * _centre([g[axis] for g in grid]) + v.b for axis, v in enumerate(views)])
    y, n = np.array([g[2] for g in grid]), np.array([g[3] for g in grid], float)
    combine = _logistic(odds, y, n)
    final = Classifier(*views, tuple(map(float, combine)), 0.0)
    # the level is read from the same grid: the highest score of a cell that loses no more than the allowed good rows
    score = 1 / (1 + np.exp(-np.clip(odds @ combine[:2] + combine[2], -30, 30)))
    good = np.where(y == 1, n, 0)
    order = np.argsort(score)
    before = np.concatenate(([0], np.cumsum(good[order])[:-1]))
    allowed = before <= lost * good.sum()
    return Classifier(final.content, final.meta, final.combine, min(0.5, float(score[order][allowed].max())))


def classify(rows: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, k_text, content_score, meta_score, score, keep) of every feature row."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            scores = (np.full(n, 0.5),) * 3
            if model and n:
                scores = model.scores(_matrix(batch.column("content"), CONTENT), _matrix(batch.column("meta"), META))
            keep = scores[2] >= (model.level if model else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k_text"), *map(pa.array, scores),
                                              pa.array(keep)],
                                             ["doc_id", "k_text", "content_score", "meta_score", "score", "keep"])

    return rows.select("doc_id", "k_text", "content", "meta").mapInArrow(
        run, f"doc_id {kind}, k_text bigint, content_score double, meta_score double, score double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
            text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Scores of all documents; trains when called, over features written to the shared folder."""
    rows = materialise(labelled(features(docs, id_col, text_col, source_col, lang_col), labels, id_col, label_col))
    return classify(rows, train(rows))


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("k_text")
