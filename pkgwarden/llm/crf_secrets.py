"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

A text is cut into lines, a line into tokens: runs of letters, digits and ``_ + / . -``, and every
other character that is no white space by itself. A token has features of its shape (length,
kinds of characters, changes between them, longest runs, signs inside), of the words around it and of
the file (shares of digits and of ``= :``). The field scores the tags outside, begin and inside; the
best tag sequence of a line is found by Viterbi decoding.

It is trained by the exact gradient of the likelihood on two tables: the labelled lines of
``secret_shapes``, and windows of at most ``DOC_TOKENS`` tokens of each of at most ``FIT_DOCS``
documents of different texts, around the patterns' matches and elsewhere, tagged as the patterns match.
Every window is seen a second time without its words, so shapes and file features have to
tell secrets that no known word announces.

Decoding is exact and short: a token for which outside is better whatever its neighbours are is
outside in the best sequence, so only the runs between such tokens are decoded, many at a time.

Spans are code points, end exclusive. Pattern spans always stay; a decoded span
(it holds no white space, and ``LEAST_CHARS`` or more characters) is added as ``crf`` unless it lies inside a pattern span. Null and empty texts have no spans. Texts are worked on whole, about
a million characters at a time or one longer text alone (about 150 bytes of arrays a character).
Rows of equal texts have equal spans; ties of tag sequences go to outside first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.llm.codes import U64, SliceHasher, chunks, code_points, mix
from pkgwarden.llm.secret_shapes import labelled_lines

#: Kinds of spans, in the order of spans that start together. The patterns are fixed values.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.I | re.A,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: As ``[0-9a-f]+`` of 16 and more characters: runs are maximal either way.
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Documents that the field is trained on, at most, and tokens taken from each, at most.
FIT_DOCS = 1_500
DOC_TOKENS = 48
#: Shorter decoded spans are no secrets.
LEAST_CHARS = 6
#: Tokens of a window of a document: so many before and after.
AROUND = 10
ROUNDS = 50
PENALTY = 1e-4

Span = tuple[int, int, int]
"""Start, number of the kind, end."""


def pattern_spans(text: str) -> list[Span]:
    """Matches of the patterns, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """What the field learns to tag: the value of an assignment, or the whole match."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(start, end) for start, kind, end in pattern_spans(text) if kind]
    return sorted(found)


# ---- tokens and features -------------------------------------------------------------------

_SPACE, _MARK, _SYMBOL, _LOWER, _UPPER, _DIGIT, _OTHER = range(7)
_CLASSES = np.full(128, _MARK, np.uint8)
_CLASSES[[*range(33)]] = _SPACE
_CLASSES[127] = _SPACE
_CLASSES[[ord(c) for c in "_+/.-"]] = _SYMBOL
_CLASSES[ord("a") : ord("z") + 1] = _LOWER
_CLASSES[ord("A") : ord("Z") + 1] = _UPPER
_CLASSES[ord("0") : ord("9") + 1] = _DIGIT
_LENGTHS = np.array([2, 4, 8, 12, 16, 20, 32, 40])

_WORDS = 1 << 13
_SHAPES = (len(_LENGTHS) + 1) * 64
_CHANGES = (len(_LENGTHS) + 1) * 8
_FILES = (len(_LENGTHS) + 1) * 16
_RUNS = 6 * 5 * 4
_SIGNS = 4 * 4 * 4 * 3 * 2
#: Sizes of the feature groups: shape of the token, of the one before, of the one after; changes;
#: file; longest runs; signs; place in the line; word before, before that, after, own word. A word may
#: be missing, or hidden in training.
GROUPS = (
    _SHAPES, _SHAPES + 1, _SHAPES + 1, _CHANGES, _FILES, _RUNS, _SIGNS, 4, *[_WORDS + 2] * 4,
)
WORD_GROUPS = slice(8, 12)
_BASES = np.concatenate(([0], np.cumsum(GROUPS)))


@dataclass
class Tokens:
    """Tokens of several texts: document, place, line and global feature numbers of each."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    new_line: np.ndarray
    features: np.ndarray


def tokens_of(texts: list[str]) -> Tokens:
    """Tokens of texts and their features, computed for all of them together."""
    # A line feed between texts ends the last line of each.
    joined = "\n".join(texts) + "\n"
    codes = code_points(joined)
    limits = np.cumsum([len(t) + 1 for t in texts])
    kinds = np.where(codes < 128, _CLASSES[np.minimum(codes, 127)], _OTHER)
    before = np.concatenate(([_SPACE], kinds[:-1]))
    word = kinds >= _SYMBOL
    starts = np.flatnonzero((kinds == _MARK) | (word & (before < _SYMBOL)))
    after = np.concatenate((kinds[1:], [_SPACE]))
    ends = np.flatnonzero((kinds == _MARK) | (word & (after < _SYMBOL))) + 1
    doc = np.searchsorted(limits, starts, "right")
    count = len(starts)
    if not count:
        empty = np.empty(0, np.int64)
        return Tokens(empty, empty, empty, empty.astype(bool), np.empty((0, len(GROUPS)), np.int32))

    def within(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return sums[ends] - sums[starts]

    length = ends - starts
    size = np.searchsorted(_LENGTHS, length, "right")
    digits, lower, upper = (within(kinds == k) for k in (_DIGIT, _LOWER, _UPPER))
    symbols, other = within(kinds == _SYMBOL), within(kinds == _OTHER)
    letters_af = within((codes >= ord("a")) & (codes <= ord("f")))
    hexadecimal = digits + letters_af == length
    shape = size * 64 + (
        (lower > 0) + 2 * (upper > 0) + 4 * (digits > 0) + 8 * (symbols > 0) + 16 * hexadecimal
        + 32 * (other > 0)
    )
    # The longest runs of small letters, of digits and of capitals.
    turns = np.flatnonzero(np.diff(kinds, prepend=255))
    run = np.repeat(np.diff(np.append(turns, len(kinds))), np.diff(np.append(turns, len(kinds))))
    edges = np.stack([starts, np.minimum(ends, len(kinds) - 1)], axis=1).ravel()

    def longest(kind: int, limits: list[int]) -> np.ndarray:
        found = np.maximum.reduceat(np.where(kinds == kind, run, 0), edges)[::2]
        return np.searchsorted(limits, found, "right")

    runs = (longest(_LOWER, [1, 2, 3, 5, 8]) * 5 + longest(_DIGIT, [1, 2, 4, 8])) * 4 + longest(
        _UPPER, [1, 2, 5]
    )
    dashes, dots, slashes = (np.minimum(within(codes == ord(c)), 3) for c in "-./")
    other_signs = np.minimum(within((codes == ord("_")) | (codes == ord("+"))), 2)
    dashed = digits + letters_af + within((codes >= 65) & (codes <= 70)) + within(codes == 45) == length
    signs = (((dashes * 4 + dots) * 4 + slashes) * 3 + other_signs) * 2 + dashed
    changed = np.concatenate(([0], (kinds[1:] != kinds[:-1]).astype(np.int64)))
    sums = np.cumsum(changed)
    changes = np.minimum((sums[ends - 1] - sums[starts]) // 2, 7)
    lines = np.cumsum(codes == 10)
    line = lines[starts]
    new_line = np.concatenate(([True], line[1:] != line[:-1]))
    last = np.concatenate((new_line[1:], [True]))

    plain = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(U64)
    words = (SliceHasher(mix(plain + U64(1)))(starts, ends) >> U64(64 - 13)).astype(np.int64)

    def beside(values: np.ndarray, step: int, none: int) -> np.ndarray:
        """Values of the token ``step`` places on, within the line."""
        moved = np.full(count, none, np.int64)
        if step > 0:
            moved[:-step] = np.where(line[step:] == line[:-step], values[step:], none)
        else:
            moved[-step:] = np.where(line[:step] == line[-step:], values[:step], none)
        return moved

    sizes = np.maximum(np.diff(limits, prepend=0), 1)
    at = np.concatenate(([0], limits[:-1]))
    totals = [np.add.reduceat(m.astype(np.int64), at) for m in (
        (codes >= 48) & (codes <= 57), (codes == ord("=")) | (codes == ord(":")))]
    digit_share = np.searchsorted([0.01, 0.03, 0.1], totals[0] / sizes, "right")
    mark_share = np.searchsorted([0.001, 0.005, 0.02], totals[1] / sizes, "right")
    file = (digit_share * 4 + mark_share)[doc]
    found = np.stack(
        [
            shape,
            beside(shape, -1, _SHAPES),
            beside(shape, 1, _SHAPES),
            size * 8 + changes,
            size * 16 + file,
            runs,
            signs,
            new_line + 2 * last,
            beside(words, -1, _WORDS),
            beside(words, -2, _WORDS),
            beside(words, 1, _WORDS),
            words,
        ],
        axis=1,
    )
    offsets = at[doc]
    return Tokens(
        doc, starts - offsets, ends - offsets, new_line, (found + _BASES[:-1]).astype(np.int32)
    )


# ---- the field -----------------------------------------------------------------------------

OUT, BEGIN, INSIDE = range(3)


@dataclass
class Field:
    """Weights of the features and of the steps from tag to tag."""

    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros((len(features), 3), np.float32)
        for column in features.T:
            total += self.weights[column]
        return total


def _layers(lengths: np.ndarray, starts: np.ndarray):
    """Positions of the first, second, ... item of many sequences, longest sequence first."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    at = 0
    while (active := int(np.searchsorted(-lengths, -at, "left"))) > 0:
        yield starts[:active] + at
        at += 1


def viterbi(scores: np.ndarray, new_line: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tag of every token; sequences begin where ``new_line`` is set."""
    tags = np.zeros(len(scores), np.int8)
    if not len(scores):
        return tags
    # The least that changing tag t to outside gains through the steps on either side, of which
    # one is missing at the ends of a line.
    enter = np.minimum((steps[:, OUT][:, None] - steps).min(axis=0), 0)
    leave = np.minimum((steps[OUT][None, :] - steps).min(axis=1), 0)
    margin = np.min([scores[:, OUT] - scores[:, t] + enter[t] + leave[t] for t in (1, 2)], axis=0)
    first, last = new_line, np.append(new_line[1:], True)
    fixed = margin > 1e-4
    open_ = ~fixed
    if not open_.any():
        return tags
    begins = open_ & (first | np.append(True, fixed[:-1]))
    starts = np.flatnonzero(begins)
    stops = open_ & (last | np.append(fixed[1:], True))
    lengths = np.flatnonzero(stops) - starts + 1
    # Steps from and to the outside token on either side, where the line goes on.
    from_out = np.where(first[starts], 0.0, 1.0)[:, None] * steps[OUT][None, :]
    to_out = np.where(last[starts + lengths - 1], 0.0, 1.0)[:, None] * steps[:, OUT][None, :]
    order = np.argsort(-lengths, kind="stable")
    best = scores[starts[order]] + from_out[order]
    came = np.zeros((len(scores), 3), np.int8)
    ended = np.empty_like(best)
    layers = list(_layers(lengths, starts))
    for i, at in enumerate(layers):
        if i:
            paths = best[: len(at), :, None] + steps[None, :, :]
            came[at] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[at]
        ended[: len(at)] = best
    tag = (ended + to_out[order]).argmax(axis=1).astype(np.int8)
    for i in range(len(layers) - 1, -1, -1):
        at = layers[i]
        tags[at] = tag[: len(at)]
        if i:
            tag[: len(at)] = came[at, tag[: len(at)]]
    return tags


def train_field(features: np.ndarray, new_line: np.ndarray, tags: np.ndarray) -> Field:
    """Maximise the penalised likelihood of the tags: forward-backward and Adagrad."""
    total = int(_BASES[-1])
    weights, steps = np.zeros((total, 3)), np.zeros((3, 3))
    if not len(features):
        return Field(weights.astype(np.float32), steps)
    starts = np.flatnonzero(new_line)
    lengths = np.diff(np.append(starts, len(features)))
    layers = list(_layers(lengths, starts))
    gold = np.eye(3)[tags]
    follows = ~new_line[1:]
    gold_steps = np.zeros((3, 3))
    np.add.at(gold_steps, (tags[:-1][follows], tags[1:][follows]), 1)
    flat = features.ravel()
    squares, square_steps = np.full(weights.shape, 1e-6), np.full((3, 3), 1e-6)

    def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
        top = values.max(axis=axis, keepdims=True)
        return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)

    for _ in range(ROUNDS):
        scores = weights[features].sum(axis=1)
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        for i, at in enumerate(layers):
            ahead[at] = scores[at]
            if i:
                ahead[at] += log_sum(ahead[at - 1][:, :, None] + steps, 1)
        expected_steps = np.zeros((3, 3))
        for at in reversed(layers[1:]):
            behind[at - 1] = log_sum(steps[None] + (scores[at] + behind[at])[:, None, :], 2)
        whole = log_sum(ahead + behind, 1)
        for at in layers[1:]:
            pair = (
                ahead[at - 1][:, :, None]
                + steps[None]
                + (scores[at] + behind[at])[:, None, :]
                - whole[at][:, None, None]
            )
            expected_steps += np.exp(pair).sum(axis=0)
        error = gold - np.exp(ahead + behind - whole[:, None])
        for tag in range(3):
            slope = np.bincount(flat, np.repeat(error[:, tag], features.shape[1]), total)
            slope -= PENALTY * len(features) * 1e-3 * weights[:, tag]
            squares[:, tag] += slope * slope
            weights[:, tag] += 0.3 * slope / np.sqrt(squares[:, tag])
        slope = gold_steps - expected_steps
        square_steps += slope * slope
        steps += 0.3 * slope / np.sqrt(square_steps)
    return Field(weights.astype(np.float32), steps)


def tag_spans(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of the tokens that lie in the spans of their documents."""
    tags = np.zeros(len(tokens.start), np.int8)
    limits = np.searchsorted(tokens.doc, np.arange(len(spans) + 1))
    for i, own in enumerate(spans):
        low, high = limits[i], limits[i + 1]
        for start, end in own:
            a = low + np.searchsorted(tokens.end[low:high], start, "right")
            b = low + np.searchsorted(tokens.start[low:high], end, "left")
            inside = slice(a, b)
            tags[inside] = INSIDE
            if b > a:
                tags[a] = BEGIN
    return tags


def windows_of(text: str, spans: list[tuple[int, int]], most: int = DOC_TOKENS) -> Windows:
    """At most ``most`` tokens of a text, in windows of neighbours of one line.

    Windows lie around the given spans first and then around tokens drawn by their place.
    """
    tokens = tokens_of([text])
    count = len(tokens.start)
    tags = tag_spans(tokens, [spans])
    keep = np.zeros(count, bool)
    order = np.argsort(mix(np.arange(count).astype(U64)), kind="stable")
    order = np.concatenate((order[tags[order] == BEGIN], order[tags[order] != BEGIN]))
    line = np.cumsum(tokens.new_line)
    for at in order.tolist():
        low, high = max(at - AROUND, 0), min(at + AROUND + 1, count)
        own = np.arange(low, high)[line[low:high] == line[at]]
        new = own[~keep[own]]
        if keep.sum() + len(new) > most:
            break
        keep[new] = True
    first = tokens.new_line | np.append(True, ~keep[:-1])
    return Windows(tokens.features[keep], first[keep], tags[keep])


@dataclass
class Windows:
    """Tokens that the field is trained on: features, where a window begins, tags."""

    features: np.ndarray
    first: np.ndarray
    tags: np.ndarray

    @staticmethod
    def joined(parts: list[Windows]) -> Windows:
        columns = zip(*[(p.features, p.first, p.tags) for p in parts], strict=True)
        return Windows(*[np.concatenate(c) for c in columns])

    def without_words(self) -> Windows:
        hidden = self.features.copy()
        hidden[:, WORD_GROUPS] = _BASES[:-1][WORD_GROUPS] + _WORDS + 1
        return Windows(hidden, self.first, self.tags)


def fit_windows(parts: list[Windows]) -> Field:
    """Train on the labelled lines and on windows of documents, each with its words and without."""
    known = [windows_of(text, spans, 1_000) for text, spans in labelled_lines()]
    whole = Windows.joined(known + parts)
    both = Windows.joined([whole, whole.without_words()])
    return train_field(both.features, both.first, both.tags)


def fit_texts(texts: list[str]) -> Field:
    """Train on the labelled lines and on some texts, tagged as the patterns match."""
    return fit_windows([windows_of(t, secret_parts(t)) for t in texts if t])


def decoded_spans(texts: list[str], model: Field) -> list[list[Span]]:
    """Spans that the field tags, for each text."""
    tokens = tokens_of(texts)
    tags = viterbi(model.scores(tokens.features), tokens.new_line, model.steps)
    found: list[list[Span]] = [[] for _ in texts]
    inside = tags != OUT
    if not inside.any():
        return found
    # A span begins at a begin tag, at an inside tag after outside, and after any white space, which
    # a secret does not hold.
    before = np.append(False, inside[:-1])
    apart = np.append(True, tokens.start[1:] != tokens.end[:-1]) | tokens.new_line
    begins = inside & ((tags == BEGIN) | ~before | apart)
    after = np.append(begins[1:] | ~inside[1:], True)
    starts, stops = np.flatnonzero(begins), np.flatnonzero(inside & after)
    long = tokens.end[stops] - tokens.start[starts] >= LEAST_CHARS
    for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
        found[tokens.doc[s]].append((int(tokens.start[s]), 3, int(tokens.end[e])))
    return found


def all_spans(texts: list[str | None], model: Field) -> list[list[Span]]:
    """Pattern spans, and decoded spans that reach beyond each of them, by start and kind.

    A decoded span may overlap pattern spans: where a pattern covers only a part of a token, the
    field's span is the whole one.
    """
    result: list[list[Span]] = []
    for part in chunks(texts):
        own = [t or "" for t in texts[part]]
        for text, added in zip(own, decoded_spans(own, model), strict=True):
            fixed = pattern_spans(text)
            wider = [a for a in added if not any(f[0] <= a[0] and a[2] <= f[2] for f in fixed)]
            result.append(sorted(fixed + wider))
    return result


# ---- Spark ---------------------------------------------------------------------------------

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def train(docs: DataFrame, text: str = "text", max_docs: int = FIT_DOCS) -> Field:
    """Train on at most ``max_docs`` documents of different texts: those of the smallest hashes.

    Only their hashes are broadcast. Windows (bounded by ``DOC_TOKENS``) are cut out where the texts
    are and meet in one task, which hands the model's weights to the driver.
    """
    texts = docs.select(F.col(text).alias("_text")).filter("_text <> ''")
    drawn = texts.withColumn("_draw", F.xxhash64("_text"))
    chosen = drawn.select("_draw").distinct().orderBy("_draw").limit(max_docs)
    sample = drawn.join(F.broadcast(chosen), "_draw")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for draw, one in zip(frame["_draw"], frame["_text"], strict=True):
                own = windows_of(one, secret_parts(one))
                yield pd.DataFrame(
                    {
                        "draw": [draw],
                        "features": [own.features.tobytes()],
                        "first": [own.first.tobytes()],
                        "tags": [own.tags.tobytes()],
                    }
                )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # In a fixed order, and copies of a text once.
        found = {row.draw: row for frame in batches for row in frame.itertuples()}
        parts = [
            Windows(
                np.frombuffer(row.features, np.int32).reshape(-1, len(GROUPS)),
                np.frombuffer(row.first, bool),
                np.frombuffer(row.tags, np.int8),
            )
            for _, row in sorted(found.items())
        ]
        model = fit_windows(parts)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "steps": [model.steps.tobytes()]})

    cut_out = sample.mapInPandas(cut, "draw long, features binary, first binary, tags binary")
    learnt = cut_out.repartition(1).mapInPandas(learn, "weights binary, steps binary").first()
    return Field(
        np.frombuffer(learnt.weights, np.float32).reshape(-1, 3),
        np.frombuffer(learnt.steps, np.float64).reshape(3, 3),
    )


def find_secrets(docs: DataFrame, model: Field, text: str = "text") -> Column:
    """A column function: the spans of a whole text (``kind, start, end``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        spans = all_spans(texts.tolist(), shared.value)
        return pd.Series(
            [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in spans],
            dtype=object,
        )

    return find(F.col(text))


def redact(docs: DataFrame, model: Field, mark: str = "[SECRET]", text: str = "text") -> Column:
    """A column function: the text with every span replaced by a mark; null for null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def cover(texts: pd.Series) -> pd.Series:
        whole = texts.tolist()
        found = []
        for one, spans in zip(whole, all_spans(whole, shared.value), strict=True):
            parts, at = [], 0
            for start, _, end in spans:
                if end <= at:
                    continue
                if start >= at:
                    parts += [one[at:start], mark]
                at = end
            found.append(one if not spans else "".join(parts) + one[at:])
        return pd.Series(found, dtype=object)

    return cover(F.col(text))
