"""Quality by line labels: a linear-chain conditional random field marks each line content or boilerplate.

Every line becomes one of 2^10 feature codes. The field has a weight per feature and label pair and a weight per pair of
neighbouring labels; Viterbi decoding gives the best label sequence of a document. A document stays when enough of its
words stand in content lines and the base rules do not reject it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, kept, slices

SYMBOLS = b"#*$%&|<>"
#: Bounds of the sample that the field is fitted on: labelled documents, and the lines a document of it may have.
FIT_DOCUMENTS, FIT_LINES = 2000, 400
#: Share of the words that must stand in content lines.
CONTENT_SHARE = 0.5
N_FEATURES = 10
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))


def line_code(line: bytes, words: list[bytes], seen: bool) -> int:
    """The feature code of one line with words."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    letters = len(line) - len(line.translate(None, _LETTERS))
    upper = len(line) - len(line.translate(None, _UPPER))
    chars = len(line) - line.count(b" ")
    last = words[-1]
    bits = (5 * symbols > n, symbols > 0, 5 * upper > 3 * letters and letters > 3, seen, n >= 6 and 2 * len(set(words)) < n,
            n < 4, last[-1:] in b".!?", 5 * line.count(b"!!") > n, chars > 12 * n or 2 * chars < 5 * n,
            5 * (len(line) - len(line.translate(None, _DIGITS))) > chars)
    return sum(1 << i for i, bit in enumerate(bits) if bit)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words (a power of two) that occur twice or more in the list."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    step = 1
    while step < width:  # names of windows of 2, 4, 8 ... words, each made of two shorter ones
        _, ids = np.unique(ids[:-step] * (len(words) + 1) + ids[step:], return_inverse=True)
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-width] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[dict[str, int], list[int], list[int]]:
    """Base counts of a text, and the feature code and the number of words of each of its lines with words."""
    text = text or ""
    raw = text.encode()
    seen: set[bytes] = set()
    words_all: list[bytes] = []
    codes, sizes, dup = [], [], 0
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        codes.append(line_code(line, words, again))
        sizes.append(len(words))
        words_all += words
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    base = {"n_words": len(words_all), "word_chars": len(text) - blanks, "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": dup, "n_repeat_words": repeated_words(words_all)}
    return base, codes, sizes


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass(frozen=True)
class Field:
    """Weights of label 1 (content) over label 0 per feature with a bias last, and of each pair of neighbouring labels."""
    emit: tuple[float, ...] = (0.0,) * (N_FEATURES + 1)
    move: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def scores(self) -> np.ndarray:
        """For each code, the score of content minus the score of boilerplate."""
        bits = (np.arange(1 << N_FEATURES)[:, None] >> np.arange(N_FEATURES)) & 1
        return bits @ np.array(self.emit[:-1]) + self.emit[-1]


def viterbi(codes: list[int], scores: list[float], move: tuple[float, ...]) -> list[int]:
    """The best labels of a sequence of codes; on a tie content wins."""
    if not codes:
        return []
    b, c, back = 0.0, scores[codes[0]], []
    for code in codes[1:]:
        bb, cb, bc, cc = b + move[0], c + move[2], b + move[1], c + move[3]
        back.append((cb >= bb, cc >= bc))
        b, c = (cb if cb >= bb else bb), (cc if cc >= bc else bc) + scores[code]
    label = int(c >= b)
    out = [label]
    for from_b, from_c in reversed(back):
        label = int(from_c if label else from_b)
        out.append(label)
    return out[::-1]


def fit(sequences: list[tuple[int, list[int]]], rounds: int = 150, rate: float = 0.5, decay: float = 2e-3) -> Field:
    """Conditional likelihood of (label, codes) sequences, by gradient ascent with forward-backward sums.

    The given label of a document is the label of all its lines. Documents of both labels weigh the same in sum. Weights of
    neighbouring labels are held small, because labels never change within a training document. Without documents of both
    labels the field is all zero, which keeps everything.
    """
    sequences = [(y, c) for y, c in sequences if c]
    if len({y for y, _ in sequences}) < 2:
        return Field()
    sequences.sort(key=lambda s: (-len(s[1]), s))
    y = np.array([s[0] for s in sequences])
    n = np.array([len(s[1]) for s in sequences])
    longest = n[0]
    codes = np.zeros((len(sequences), longest), np.int64)
    for i, (_, c) in enumerate(sequences):
        codes[i, :len(c)] = c
    weight = np.where(y == 1, 0.5 / (n * (y == 1)).sum(), 0.5 / (n * (y == 0)).sum())
    live = [int((n > t).sum()) for t in range(longest)]  # rows are sorted, so those with a line t come first
    emit, move = np.zeros(N_FEATURES + 1), np.zeros((2, 2))
    bits = np.concatenate([(np.arange(1 << N_FEATURES)[:, None] >> np.arange(N_FEATURES)) & 1, np.ones((1 << N_FEATURES, 1), np.int64)], 1).astype(float)
    for _ in range(rounds):
        s = (bits @ emit)[codes]
        fwd = np.zeros((longest, len(y), 2))
        fwd[0, :, 1] = s[:, 0]
        for t in range(1, longest):
            k = live[t]
            into = fwd[t - 1, :k, :, None] + move
            fwd[t, :k] = np.logaddexp(into[:, 0], into[:, 1])
            fwd[t, :k, 1] += s[:k, t]
        back = np.zeros((longest, len(y), 2))
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            after = back[t + 1, :k].copy()
            after[:, 1] += s[:k, t + 1]
            out = move + after[:, None, :]
            back[t, :k] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        total = np.logaddexp(back[0, :, 0], back[0, :, 1] + s[:, 0])
        g_emit, g_move = np.zeros_like(emit), np.zeros((2, 2))
        for t in range(longest):
            k = live[t]
            p = np.exp(fwd[t, :k, 1] + back[t, :k, 1] - total[:k])
            g_emit += ((y[:k] - p) * weight[:k]) @ bits[codes[:k, t]]
            if t:
                after = back[t, :k].copy()
                after[:, 1] += s[:k, t]
                pair = np.exp(fwd[t - 1, :k, :, None] + move + after[:, None, :] - total[:k, None, None])
                g_move -= np.einsum("i,iab->ab", weight[:k], pair)
                for label in (0, 1):
                    g_move[label, label] += weight[:k][y[:k] == label].sum()
        emit += rate * 20 * (g_emit - decay * emit)
        move += rate * (g_move - 0.2 * move)
    return Field(tuple(round(float(x), 6) for x in emit), tuple(round(float(x), 6) for x in move.ravel()))


def fit_sample(docs: DataFrame, labels: DataFrame, n_documents: int = FIT_DOCUMENTS, max_lines: int = FIT_LINES) -> list[tuple[int, list[int]]]:
    """(quality, line codes) of at most ``n_documents`` labelled documents, chosen by a hash of their ids.

    Documents of more than ``max_lines`` lines are not used for the fit. Both bounds hold at every size of the input.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_documents))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            q, codes = [], []
            for quality, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = measure(text)[1]
                if len(found) <= max_lines:
                    q.append(int(quality))
                    codes.append(np.array(found, np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(codes, pa.binary())], ["quality", "codes"])

    return sorted((r.quality, np.frombuffer(bytes(r.codes), np.int16).tolist()) for r in rows.mapInArrow(code, "quality int, codes binary").collect())


def assess(docs: DataFrame, field: Field, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: base counts, base verdict, words in content lines, lines, and whether it stays.

    A null or empty text has no words and fails the base rules. Repeated rows and null ids are judged on their own. Whole
    texts are read, however long. An empty table gives an empty result; extra columns of ``docs`` are ignored.
    """
    scores, move = field.scores().tolist(), field.move
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_content_words", "n_lines", "n_content_lines"]
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 3

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, codes, sizes = measure(text)
                labels = viterbi(codes, scores, move)
                content = sum(n for n, label in zip(sizes, labels) if label)
                failed = base_fails(base["n_words"], base["n_repeat_words"])
                rows.append((doc_id, *base.values(), failed, not failed and content >= content_share * base["n_words"], content, len(codes), sum(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
               "kept boolean, n_content_words long, n_lines long, n_content_lines long")


def good_rows(docs: DataFrame, field: Field, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns; each row is judged by its own text, whatever its id.

    Only the text goes to Python and only the verdict comes back.
    """
    scores, move = field.scores().tolist(), field.move

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        kept("quality")  # nothing, but what other stages left in this worker goes
        keep = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), texts=0):
            for text in part.column(0):
                base, codes, sizes = measure(text.as_py())
                content = sum(n for n, label in zip(sizes, viterbi(codes, scores, move)) if label)
                keep.append(not base_fails(base["n_words"], base["n_repeat_words"]) and content >= content_share * base["n_words"])
        return pa.array(keep, pa.bool_())

    return docs.where(good(F.col("text")))


def line_labels(text: str | None, field: Field) -> list[tuple[str, bool]]:
    """The lines with words of one text, each with whether it is content."""
    _, codes, _ = measure(text)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return list(zip(lines, map(bool, viterbi(codes, field.scores().tolist(), field.move))))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit the field on a bounded sample of labelled documents and assess every document."""
    return assess(docs, fit(fit_sample(docs, labels)))
