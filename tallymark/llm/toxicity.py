"""Toxicity: undo obfuscation as a noisy channel, then score the restored words."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .labelled import held_out, training_texts

#: At most this many labelled documents are learned from.
SAMPLE = 20_000
#: Word beginnings and words that carry a weight.
FEATURES = 512
#: Spans whose reading a worker keeps, twice; names it counts before passing them on; and
#: bytes or characters it looks at together.
KEPT_SPANS, MOST_COUNTED, AT_ONCE = 50_000, 100_000, 1 << 19
#: A document is rejected from this score on.
REJECT = 0.7

# Letters that digits and signs are written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Costs in nats: a letter written as a sign; three or more equal letters read as fewer, and two read
#: as one, which many words are spelt with; separators between single letters, if they are noise and
#: if they are not. Separators of longer pieces cost GAP each if they are noise and nothing if they are not.
SIGN, REPEAT, TWICE, NOISE, GAP = 2.5, 1.0, 6.0, 0.1, 1.5

#: The language model's symbols: 0 word boundary, 1-26 the letters a-z, 27 any other letter.
SYMBOLS, ORDER = 28, 4
_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[0xC0:] = 27  # first bytes of longer characters; following bytes are skipped
_OF = {chr(96 + code): code for code in range(1, 27)}

#: What a character is: a line break, a separator, a letter, a sign for a letter, or another letter or digit.
BREAK, SEPARATOR, LETTER, MARK, OTHER, UNSEEN = range(6)
_KINDS = np.full(0x110000, UNSEEN, np.uint8)
#: Pieces of at most this many letters may belong to a word that was split.
PIECE = 3

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(re.escape(c) for c in LEET)
_PIECES = re.compile(rf"((?:_|[^\w{_SIGNS}])+)")
#: What can be read otherwise within a piece.
_RUN = re.compile(rf"([^\W\d_])\1+|([{_SIGNS}])\2*")

#: A reading of a part of a span: the symbols that the model sees, the text read, and its cost.
Reading = tuple[tuple[int, ...], str, float]


def _kinds(codes: np.ndarray) -> np.ndarray:
    """Kind of each code point."""
    kinds = _KINDS[codes]
    if (kinds == UNSEEN).any():
        for code in np.unique(codes[kinds == UNSEEN]).tolist():
            char = chr(code)
            kind = BREAK if char == "\n" else MARK if char in LEET else LETTER if char.isalpha() else OTHER if char.isalnum() else SEPARATOR
            _KINDS[code] = kind
        kinds = _KINDS[codes]
    return kinds


def find_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of a lower-cased text that may be obfuscated, by a few passes over arrays.

    These are words that mix letters and signs, words with a letter twice or
    more in a row, and rows of two or more pieces on one line, each a single
    character or up to three letters. A row is cut where all of its readings
    agree on the last three letters: the next part starts with these again.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds(codes)
    inside = np.concatenate([[False], kinds >= LETTER, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends

    def count(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    letter = kinds == LETTER
    letters, marks = (upto[ends] - upto[starts] for upto in (count(letter), count(kinds == MARK)))
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & letter[1:]
    again = count(again)
    size = ends - starts
    plain = letters + marks == size
    alone = plain & (letters > 0) & ((marks > 0) | (again[ends] > again[starts]))
    short = plain & ((size == 1) | ((letters == size) & (size <= PIECE)))
    lines = count(kinds == BREAK)
    # Rows of short pieces: a piece goes on with the row of the one before it on its line.
    on = np.zeros(len(starts) + 1, bool)
    on[1:-1] = short[1:] & short[:-1] & (lines[starts[1:]] == lines[ends[:-1]])
    row = np.cumsum(~on[:-1]) - 1
    heads = np.flatnonzero(~on)
    upto = count(letters > 0)
    taken = ((np.diff(heads) > 1) & (upto[heads[1:]] > upto[heads[:-1]])) | alone[heads[:-1]]
    # Three letters in one reading leave one state, so a row can be read up to them and on from them.
    sure = (size == 3) & (letters == 3) & (again[ends] == again[starts])
    parts = np.flatnonzero(~on[:-1] | (sure & on[1:]))
    following = np.append(parts[1:], len(starts))
    lasts = np.where(on[following], following, following - 1)
    taken = taken[row[parts]]
    return starts[parts[taken]], ends[lasts[taken]]


class Letters:
    """Character language model: log probability of a symbol after three others."""

    def __init__(self, counts: np.ndarray) -> None:
        grams = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
        chance = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for order in range(1, ORDER + 1):
            seen = grams.sum(axis=tuple(range(ORDER - order)))
            total = seen.sum(axis=-1, keepdims=True)
            chance = (seen + 5.0 * chance) / (total + 5.0)  # smoothed with the shorter context
        self.cost = (-np.log(chance)).astype(np.float32).reshape(-1)
        self._start()

    def _start(self) -> None:
        self.costs = array("f", self.cost.tobytes())
        #: Spans and their readings: those met lately, and those met before them.
        self.recent: dict[str, str] = {}
        self.earlier: dict[str, str] = {}
        self.pieces: dict[str, list[list[Reading]]] = {}

    def __getstate__(self) -> np.ndarray:
        return self.cost

    def __setstate__(self, cost: np.ndarray) -> None:
        self.cost = cost
        self._start()

    def restore(self, text: str) -> str:
        """Lower-cased ``text`` with its obfuscated spans decoded."""
        return self.restore_all([text])[0]

    def restore_all(self, texts: list[str]) -> list[str]:
        """Each text lower-cased, with its obfuscated spans decoded."""
        texts = [text.lower() for text in texts]
        together = "\n".join(texts)
        starts, ends = find_spans(together)
        sizes = np.array([len(text) + 1 for text in texts], np.int64)
        stops = np.cumsum(sizes)
        upto = np.searchsorted(starts, stops).tolist()
        starts, ends = starts.tolist(), ends.tolist()
        out, first, read = [], 0, self._read
        for stop, size, last in zip(stops.tolist(), sizes.tolist(), upto):
            at, parts = stop - size, []
            for start, end in zip(starts[first:last], ends[first:last]):
                found = read(together[start:end])
                if start >= at:
                    parts.append(together[at:start])
                    parts.append(found)
                else:  # it starts with the piece that the part before it ends with
                    parts.append(found[at - start :])
                at = end
            parts.append(together[at : stop - 1])
            out.append("".join(parts))
            first = last
        return out

    def _read(self, span: str) -> str:
        found = self.recent.get(span)
        if found is None:
            found = self.earlier.get(span)
            if found is None:
                found = self.decode(span)
            if len(span) < 100:
                if len(self.recent) >= KEPT_SPANS:
                    self.earlier, self.recent = self.recent, {}
                self.recent[span] = found
        return found

    def decode(self, span: str) -> str:
        """Cheapest path through the lattice of readings of ``span`` (Viterbi); of equal ones the first."""
        costs = self.costs
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last three symbols
        for readings in self.lattice(span):
            ahead: dict[int, tuple[float, tuple | None]] = {}
            for state, (cost, text) in paths.items():
                for symbols, read, extra in readings:
                    new, total = state, cost + extra
                    for symbol in symbols:
                        if symbol or new % SYMBOLS:  # boundaries in a row are one
                            new = new * SYMBOLS + symbol
                            total += costs[new]
                            new %= SYMBOLS**3
                    known = ahead.get(new)
                    if known is None or total < known[0]:
                        ahead[new] = (total, (text, read))
            paths = ahead
        best = min(paths.items(), key=lambda item: item[1][0] + (costs[item[0] * SYMBOLS] if item[0] % SYMBOLS else 0.0))[1][1]
        parts = []
        while best:
            best, read = best
            parts.append(read)
        return "".join(reversed(parts))

    def lattice(self, span: str) -> list[list[Reading]]:
        """Readings of each part of a span, as written first; parts follow each other.

        A part is a run of equal characters, or the separators between two pieces
        and what follows in one reading, so their number does not depend on how
        long runs are.
        """
        pieces, gap = _PIECES.split(span), []
        parts: list[list[Reading]] = []
        for at, piece in enumerate(pieces):
            if at % 2:
                lone, many = len(pieces[at - 1]) == 1 == len(pieces[at + 1]), len(piece)
                kept = GAP + (many - 1) * NOISE if lone else 0.0
                gap = [((0,), piece, kept), ((), "", many * (NOISE if lone else GAP))]
            else:
                known = self.pieces.get(piece)
                if known is None:
                    known = self._piece(piece)
                    if len(piece) < 30 and len(self.pieces) < KEPT_SPANS:
                        self.pieces[piece] = known
                if at and len(known[0]) == 1:  # what is read in one way goes with the separators before it
                    symbols, text, _ = known[0][0]
                    parts.append([(before + symbols, read + text, extra) for before, read, extra in gap])
                    parts.extend(known[1:])
                else:
                    parts.extend([gap] if at else [])
                    parts.extend(known)
        return parts

    def _piece(self, piece: str) -> list[list[Reading]]:
        """Readings of the signs and runs of a piece, and of what is between them."""
        parts: list[list[Reading]] = []
        at = 0
        for run in _RUN.finditer(piece):
            start, end = run.span()
            if at < start:
                parts.append([(tuple([_OF.get(c, 27) for c in piece[at:start]]), piece[at:start], 0.0)])
            parts.append(self._run(piece[start], end - start))
            at = end
        if at < len(piece):
            parts.append([(tuple([_OF.get(c, 27) for c in piece[at:]]), piece[at:], 0.0)])
        return parts

    def _run(self, char: str, many: int) -> list[Reading]:
        """Readings of a character ``many`` times in a row."""
        if char.isalpha():
            code = _OF.get(char, 27)
            # From the fourth on, each costs the same and leaves the same context.
            further = (many - 3) * self.costs[((code * SYMBOLS + code) * SYMBOLS + code) * SYMBOLS + code] if many > 3 else 0.0
            readings = [((code,) * min(many, 3), char * many, further)]
            if many == 2:
                readings.append(((code,), char, TWICE))
            elif many > 2:
                readings += [((code,) * some, char * some, REPEAT) for some in (1, 2, 3)]
            return readings
        readings = [((0,), char * many, 0.0)]
        letters = LEET.get(char, "")
        readings += [((_OF[letter],), letter, SIGN + REPEAT * (many > 1)) for letter in letters]
        if many == 2:
            readings += [((_OF[a], _OF[b]), a + b, 2 * SIGN) for a in letters for b in letters]
        elif many > 2:
            readings += [((_OF[letter],) * 2, letter * 2, SIGN + REPEAT) for letter in letters]
        return readings


def slices(texts: pd.Series) -> Iterator[list[str]]:
    """A batch of texts in parts of about ``AT_ONCE`` characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each run of four symbols occurs in all documents.

    Tasks count their own texts into an array whose size the alphabet sets
    (28^4), and the sums of these are all that reaches the driver.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for text in (part for frame in frames for part in slices(frame["text"])):
            raw = np.frombuffer("  ".join(text).lower().encode("utf-8", "replace"), np.uint8)
            for at in range(0, len(raw), AT_ONCE):
                part = raw[at : at + AT_ONCE]
                codes = _CODE[part[(part & 0xC0) != 0x80]]
                codes = codes[(codes != 0) | (np.append(1, codes[:-1]) != 0)]  # boundaries in a row are one
                codes = np.concatenate([[0, 0], codes, [0]])
                grams = ((codes[:-3] * SYMBOLS + codes[1:-2]) * SYMBOLS + codes[2:-1]) * SYMBOLS + codes[3:]
                total += np.bincount(grams, minlength=len(total))
        found = np.flatnonzero(total)
        yield pd.DataFrame({"gram": found, "n": total[found]})

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def features(text: str) -> set[str]:
    """Words of a text (marked by an end) and their beginnings of 4 to 6 letters."""
    found = set()
    for word in set(_WORD.findall(text)):
        found.add(word + "$")
        found.update(word[:size] for size in (4, 5, 6) if len(word) > size)
    return found


class Weights:
    """Logistic model over features of restored texts."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float) -> None:
        self.of = dict(zip(names, weights.tolist()))
        self.bias = bias

    def score(self, restored: str) -> float:
        """Probability that a restored text is toxic."""
        total, of = self.bias, self.of
        seen = set()
        for word in set(_WORD.findall(restored)):
            if word + "$" in of:
                total += of[word + "$"]
            for size in (4, 5, 6):
                if len(word) > size and word[:size] in of:
                    seen.add(word[:size])
        total += sum(of[f] for f in seen)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, total))))


def fit_logistic(rows: list[list[int]], labels: np.ndarray, size: int, ridge: float = 1e-5, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps with adaptive rates."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.array([i for r in rows for i in r], np.int64)
    weights, bias = np.zeros(size), math.log((labels.sum() + 1.0) / (len(labels) - labels.sum() + 1.0))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        logit = np.bincount(at, weights[which], minlength=len(rows)) + bias
        wrong = (1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))) - labels) / len(labels)
        slope = np.append(np.bincount(which, wrong[at], minlength=size) + ridge * weights, wrong.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, letters: Letters, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Weights | None:
    """Learn weights from at most ``most`` labelled documents; None if there are none."""
    sample = training_texts(docs, labels, "toxic", most, id_col, text_col)

    def restore(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": [t for part in slices(frame["text"]) for t in letters.restore_all(part)], "label": frame["label"]})

    restored = cut(sample.mapInPandas(restore, "text string, label int"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, toxic = Counter(), Counter()
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"]):
                found = features(text)
                seen.update(found)
                if label:
                    toxic.update(found)
                if len(seen) > MOST_COUNTED:
                    yield counted(seen, toxic)
                    seen, toxic = Counter(), Counter()
        if seen:
            yield counted(seen, toxic)

    def counted(seen: Counter, toxic: Counter) -> pd.DataFrame:
        return pd.DataFrame({"name": list(seen), "n": list(seen.values()), "toxic": [toxic[f] for f in seen]})

    sizes = restored.agg(F.count("*"), F.sum("label")).first()
    if not sizes[0]:
        return None
    total, bad = sizes[0], sizes[1] or 0
    sums = restored.mapInPandas(count, "name string, n long, toxic long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1) * (total - bad + 1) / (F.col("n") - F.col("toxic") + 0.5))
    best = sums.where("toxic >= 3").withColumn("odds", odds).where("odds > 2")
    best = best.orderBy(F.desc(F.col("toxic") * F.col("odds")), "name").limit(FEATURES).select("name")
    names = [r[0] for r in best.collect()]
    index = {name: i for i, name in enumerate(names)}

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [sorted(index[f] for f in features(t) if f in index) for t in frame["text"]]
            yield pd.DataFrame({"found": found, "label": frame["label"]})

    rows = restored.mapInPandas(held, "found array<int>, label int").toPandas()
    weights, bias = fit_logistic([list(r) for r in rows["found"]], rows["label"].to_numpy(np.float64), len(names))
    return Weights(names, weights, bias)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, most: int = SAMPLE, restored: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Restore every text and score it.

    A character model of order four is counted over all documents. Words that
    mix letters and signs, letters repeated twice or more, and single letters or
    pieces of up to three with separators between them are read as lattices, and Viterbi finds
    their most likely reading: signs for letters, repeats for up to three,
    separators for nothing, each at a cost. The time for a text is linear in its
    length; a run of equal characters is one step. Words and word beginnings of the
    restored text then give a logistic score, learned from at most ``most``
    labelled documents that are not held out. Whole texts are restored and
    scored; nothing but the score depends on labels.

    Returns ``row`` (struct of all input columns), ``held_out``, ``score`` and, if
    asked for, the ``restored`` text.

    A null or empty text gets the score of a text without words. Without labels
    every score is 0. Null ids are scored, are not held out, and teach nothing.
    Repeated rows get equal scores. An empty table gives an empty result.
    """
    letters = Letters(letter_counts(docs, text_col))
    weights = fit(docs, labels, letters, most, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast((letters, weights))  # 28^4 costs and FEATURES weights

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters, weights = model.value
        for text in texts:
            if weights is None:
                yield pd.Series(np.zeros(len(text)))
            else:
                yield pd.Series([weights.score(t) for part in slices(text) for t in letters.restore_all(part)], dtype=float)

    @F.pandas_udf("string")
    def restore(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters, _ = model.value
        for text in texts:
            yield pd.Series([t for part in slices(text) for t in letters.restore_all(part)], dtype=object)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        held_out(F.col(f"`{id_col}`")).alias("held_out"),
        judge(text).alias("score"),
        *[restore(text).alias("restored")] * restored,
    )


def keep_harmless(docs: DataFrame, labels: DataFrame, reject: float = REJECT, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with scores under ``reject``, all columns as given."""
    judged = score_toxicity(docs, labels, most, id_col=id_col, text_col=text_col)
    return judged.where(F.col("score") < reject).select("row.*")
