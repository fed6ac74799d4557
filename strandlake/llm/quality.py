"""Quality rules: counts over a text's words, and a labelling of its lines as content or boilerplate."""

from __future__ import annotations



import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plus, with_text

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LOWER = bytes(range(97, 123))
FEATURES = ("bias", "words", "symbols", "bars", "upper", "exclaims", "digits", "repeats", "adjacent", "ends", "seen", "short", "no_letters")
#: Labelled rows of each class that training may gather, and lines of one such text.
MOST_LABELLED, MOST_LINES = 2000, 2000
#: Lines of all texts that the field is trained on, together: at 4 bytes a feature, 26 MB on the driver.
MOST_TRAINED_LINES = 500_000


def repeated_words(ids: list[int], distinct: int) -> int:
    """Positions covered by 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    a = np.array(ids, np.int64)
    if distinct < 2_000_000:
        code = (a[:-2] * distinct + a[1:-1]) * distinct + a[2:]
    else:
        pair = np.unique(a[:-2] * distinct + a[1:-1], return_inverse=True)[1]
        code = pair * distinct + a[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(a), bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        twice[hit + k] = True
    return int(twice.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in text:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(ids, len(known))


def line_features(text: bytes) -> tuple[list[tuple], list[int]]:
    """A feature row and the number of words of every line that has a word."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        m = len(line)
        letters = m - len(line.translate(None, LOWER))
        upper = m - len(line.translate(None, UPPER))
        adjacent = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
        rows.append(
            (
                1.0,
                min(n, 200) / 100,
                min(1.0, (m - len(line.translate(None, SYMBOLS))) / n / 2),
                min(1.0, line.count(b"|") / n * 2),
                upper / (letters + upper or 1),
                min(1.0, line.count(b"!") / n),
                min(1.0, (m - len(line.translate(None, DIGITS))) / m * 4),
                1 - len(set(words)) / n,
                adjacent / n,
                float(words[-1][-1:] in b".!?"),
                float(line in seen),
                float(n < 4),
                float(letters + upper == 0),
            )
        )
        sizes.append(n)
        seen.add(line)
    return rows, sizes


class LineField:
    """A linear-chain conditional random field over two labels, 1 for content and 0 for boilerplate: ``weights[label, feature]`` and ``moves[from, to]``."""

    def __init__(self, weights=None, moves=None):
        self.weights = np.zeros((2, len(FEATURES))) if weights is None else np.asarray(weights, float)
        self.moves = np.zeros((2, 2)) if moves is None else np.asarray(moves, float)

    def decode(self, scores: list[list[float]]) -> list[int]:
        """The most likely labels (Viterbi) for rows of label scores; ties go to content."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        a = b = 0.0
        back = []
        for i, (s0, s1) in enumerate(scores):
            if i:
                from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
                a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
                back.append((from0, from1))
            else:
                a, b = s0, s1
        label = int(b >= a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]

    def marginals(self, x: np.ndarray, mask: np.ndarray):
        """Forward-backward over sequences padded to one length: log normalisers, label and pair probabilities."""
        scores = x @ self.weights.T
        n, length, _ = scores.shape
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = scores[:, 0]
        for t in range(1, length):
            step = np.logaddexp(alpha[:, t - 1, 0, None] + self.moves[0], alpha[:, t - 1, 1, None] + self.moves[1]) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            after = scores[:, t + 1] + beta[:, t + 1]
            step = np.logaddexp(self.moves[:, 0] + after[:, 0, None], self.moves[:, 1] + after[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
        logz = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - logz[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + self.moves + (scores[:, 1:] + beta[:, 1:])[:, :, None] - logz[:, None, None, None]) * (mask[:, 1:] & mask[:, :-1])[..., None, None]
        return logz, p, pair

    def train(self, texts: list[np.ndarray], good: list[bool], rounds: int = 3, steps: int = 120, l2: float = 1e-3) -> LineField:
        """Maximum likelihood by Adam. Only texts are labelled: first a good text's lines all count as content and a bad one's as boilerplate; then lines of bad texts that the field takes for content are relabelled so, but for the worst of each text, and it is trained anew."""
        if not texts or all(good) or not any(good):
            return self
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        chunks = []
        for i in range(0, len(order), 128):
            own = [j for j in order[i : i + 128]]
            length = max(len(texts[j]) for j in own)
            x, mask, y = np.zeros((len(own), length, len(FEATURES))), np.zeros((len(own), length), bool), np.zeros((len(own), length), int)
            for k, j in enumerate(own):
                x[k, : len(texts[j])], mask[k, : len(texts[j])], y[k] = texts[j], True, int(good[j])
            chunks.append([x, mask, y, np.array([good[j] for j in own])])
        total = sum(c[1].sum() for c in chunks)
        for r in range(rounds):
            if r:
                for c in chunks:
                    p = self.marginals(c[0], c[1])[1][..., 1]
                    new = p >= 0.5
                    new[np.arange(len(p)), np.where(c[1], p, 2).argmin(1)] = False
                    c[2] = np.where(c[3][:, None], 1, new)
            m = v = np.zeros(self.weights.size + 4)
            for t in range(1, steps + 1):
                gw, gm = np.zeros_like(self.weights), np.zeros_like(self.moves)
                for x, mask, y, _ in chunks:
                    _, p, pair = self.marginals(x, mask)
                    gold = np.eye(2)[y] * mask[..., None]
                    gw += np.einsum("ntk,ntf->kf", gold - p, x)
                    both = (mask[:, 1:] & mask[:, :-1])[..., None, None]
                    gm += (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both - pair).sum((0, 1))
                theta = np.concatenate([self.weights.ravel(), self.moves.ravel()])
                g = np.concatenate([gw.ravel(), gm.ravel()]) / total - l2 * theta
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                theta = theta + 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                self.weights, self.moves = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        return self


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[list[np.ndarray], list[bool]]:
    """Line features of at most ``most`` labelled texts of each class, drawn by a hash of ``doc_id``, and whether each is good. A document of both labels counts as bad.

    Rows of one ``doc_id`` count as one text, the least of them. Texts are taken in the order of the hash until they have
    ``MOST_TRAINED_LINES`` lines together, so what reaches the driver has a bound in bytes however long they are.
    """
    one = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    few = drawn[0].unionByName(drawn[1])  # at most 2 * most rows of two numbers

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            made = [line_features(text or b"")[0] for text in batch.column(0).cast(pa.binary()).to_pylist()]
            some = pa.array([i for i, x in enumerate(made) if 0 < len(x) <= MOST_LINES], pa.int64())
            x = pa.array([np.array(made[i], "<f4").tobytes() for i in some.to_pylist()], pa.binary())
            few_rows = batch.take(some)
            yield pa.RecordBatch.from_arrays([x, few_rows.column(1).cast(pa.bool_()), few_rows.column(2), few_rows.column(3)], ["x", "good", "draw", "doc_id"])

    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    made = texts.select("text", "quality", F.xxhash64("doc_id").alias("draw"), "doc_id").mapInArrow(features, "x binary, good boolean, draw long, doc_id " + docs.schema["doc_id"].dataType.simpleString())
    # One row a drawn text, at most 2 * most of them.
    upto = F.sum(F.length("x")).over(Window.orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = made.withColumn("_upto", upto).where(F.col("_upto") <= MOST_TRAINED_LINES * len(FEATURES) * 4).select("x", "good").collect()
    rows.sort(key=lambda r: (r["good"], bytes(r["x"])))
    return [np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(float) for r in rows], [r["good"] for r in rows]


def judge(docs: DataFrame, field: LineField, min_content: float = 0.5) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed, kept``.

    The base rules fail a text of under 50 words, or of which more than half lie in repeated 3-word windows. Of the
    others those stay whose lines labelled content (Viterbi) hold at least ``min_content`` of the words. Null or empty
    text: no words, fails. Texts are read whole, where they lie; nothing is dealt out. Columns of those names are
    replaced, others pass through. Empty table: empty result.
    """

    def look(batches):
        import pyarrow as pa

        weights = field.weights.T

        def make(texts):
            counts, shares, feats, spans = [], [], [], []
            for text in texts:
                text = text or b""
                counts.append(base_counts(text))
                rows, sizes = line_features(text)
                spans.append((len(feats), sizes))
                feats += rows
            scores = (np.array(feats) @ weights).tolist() if feats else []
            for (at, sizes), c in zip(spans, counts):
                labels = field.decode(scores[at : at + len(sizes)]) if sizes else []
                shares.append(sum(n for n, y in zip(sizes, labels) if y) / c[0] if c[0] else 0.0)
            failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            out = {n: pa.array([c[i] for c in counts], pa.int64()) for i, n in enumerate(names)}
            out["content_share"] = pa.array(shares, pa.float64())
            out["base_failed"] = pa.array(failed, pa.bool_())
            out["kept"] = pa.array([not f and s >= min_content for f, s in zip(failed, shares)], pa.bool_())
            return out

        yield from with_text(batches, make)

    more = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"
    return docs.mapInArrow(look, plus(docs, more))


def train_field(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> LineField:
    """A field trained on the labelled rows of ``labels`` (``doc_id, quality``); without both classes it is all zeros and takes every line for content."""
    return LineField().train(*labelled(docs, labels, most))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, field)
