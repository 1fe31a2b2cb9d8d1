"""Packing: token sequences of a fixed length by first-fit decreasing in random groups."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 2
#: UTF-8 bytes of the texts of a group, about. A group is packed by itself, so it bounds a task.
GROUP_BYTES = 8 << 20
#: Bytes of words and ids that a worker keeps, twice: those met lately, and those met before them.
KEPT_BYTES = 48 << 20
#: Bytes that are split into words at once, and ids that leave a task at once.
AT_ONCE, IDS_AT_ONCE = 4 << 20, 1 << 20
_PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_SPACE = re.compile(rb"\s")

_workers: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of texts by a public tokenizer that drops white space, one word at a time.

    The tokenizer never merges across white space, so a text's ids are its words'
    ids, one after the other, and each distinct word has to be encoded once. All
    encoding is the tokenizer's; words it can only cut at their end are sent to
    it together, which saves most of the cost of a call.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([t.endswith("</w>") for t in tokens])
        self.recent: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        self.held = 0  # bytes of what is recent

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        raws = []
        for text in texts:
            raw = text.encode("utf-8", "replace")
            # Lower-casing A-Z first only makes words equal sooner; the names of
            # special tokens are compared before the tokenizer lowers anything.
            raws.append(raw if b"<|" in raw else raw.lower())
        out: list[bytes] = []
        batch: list[bytes] = []
        size = 0
        for raw in raws:
            if len(raw) > AT_ONCE:  # a long text in parts, each ending where a word ends
                out.extend(self._encode_batch(batch))
                batch, size = [], 0
                out.append(b"".join(ids for part in _word_parts(raw) for ids in self._encode_batch([part])))
                continue
            batch.append(raw)
            size += len(raw)
            if size >= AT_ONCE:
                out.extend(self._encode_batch(batch))
                batch, size = [], 0
        out.extend(self._encode_batch(batch))
        return out

    def _encode_batch(self, raws: list[bytes]) -> list[bytes]:
        """Arrow splits texts into words and numbers the distinct ones; only those are looked up."""
        if not raws:
            return []
        split = pc.ascii_split_whitespace(pa.array(raws, pa.large_string()))
        words = split.flatten().dictionary_encode()
        found = self._find(words.dictionary.cast(pa.large_binary()).to_pylist())
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)
        cuts = ends[split.offsets.to_numpy()].tolist()
        data = ids.buffers()[2].to_pybytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _find(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; words of letters are kept without the punctuation at their end."""
        found = list(map(self.recent.get, words))
        new: list[int] = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = self.earlier.get(words[i])
                if ids is None:
                    new.append(i)
                else:
                    self._keep(words[i], ids)
                    found[i] = ids
        if new:
            encoded = self._encode_words([words[i] for i in new])
            for i in new:
                found[i] = encoded[words[i]]
        return found

    def _kept(self, word: bytes) -> bytes | None:
        ids = self.recent.get(word)
        if ids is None:
            ids = self.earlier.get(word)
            if ids is not None:
                self._keep(word, ids)
        return ids

    def _keep(self, word: bytes, ids: bytes) -> None:
        """Words that are not met while as many others are go first."""
        self.recent[word] = ids
        self.held += len(word) + len(ids) + 150  # with what Python needs for them
        if self.held > KEPT_BYTES:
            self.earlier, self.recent, self.held = self.recent, {}, 0

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        plain: dict[bytes, None] = {}  # in order of first sight
        whole: dict[bytes, None] = {}
        tails: dict[bytes, tuple[bytes, bytes]] = {}

        def asked(part: bytes, among: dict[bytes, None]) -> None:
            if part not in found and part not in among:
                ids = self._kept(part)
                if ids is None:
                    among[part] = None
                else:
                    found[part] = ids

        for word in words:
            core = word.rstrip(_PUNCTUATION)
            text = core.decode()
            if core and text.isalpha() and text.lower().isalpha():
                if core == word:
                    plain[core] = None  # looked for already
                else:
                    asked(core, plain)
                    tails[word] = (core, word[len(core) :])
                    asked(word[len(core) :], whole)
            else:
                whole[word] = None
        new = self._encode_together(list(plain))
        rest = list(whole)
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        new.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in encoded)))
        for word, ids in new.items():
            self._keep(word, ids)
        found.update(new)
        for word, (core, tail) in tails.items():
            found[word] = found[core] + found[tail]
        return found

    def _encode_together(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters only: each ends with its one word-end token."""
        if not words:
            return {}
        text = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            return dict(zip(words, (np.array(e.ids, "<u4").tobytes() for e in encoded)))
        raw, cuts = ids.tobytes(), (stops * 4).tolist()
        return {word: raw[a:b] for word, a, b in zip(words, [0, *cuts], cuts)}


def _word_parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``AT_ONCE`` bytes, cut at white space."""
    start = 0
    while start < len(raw):
        found = _SPACE.search(raw, start + AT_ONCE)
        end = found.start() if found else len(raw)
        yield raw[start:end]
        start = end


def _word_ids(path: str) -> WordIds:
    """One per Python worker; workers live longer than tasks."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def _mixed(value: int, turn: int) -> int:
    """Another signed 64-bit value for every turn; the value itself at turn 0."""
    return (value + turn * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)


def tokenize(docs: DataFrame, tokenizer: str, length: int, id_col: str = "doc_id", text_col: str = "text", checksum: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids of every document, end id included.

    Returns ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian 32-bit; null if
    only their ``checksum`` is asked for), ``ids_crc32`` and ``spread``, a hash of id, text and, for full
    pieces, place. The only columns read are id and text.
    """
    path, width = tokenizer, 4 * length
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "spread"]

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, times = _word_ids(path), Counter()
        for frame in frames:
            rows: list[tuple] = []
            held = 0
            sizes = frame["text"].str.len().to_numpy()
            for _, part in frame.groupby((np.cumsum(sizes) - sizes) // AT_ONCE, sort=False):
                for key, mixed, ids in zip(part["id"], part["spread"], words.encode(part["text"].tolist())):
                    ids += end
                    total = len(ids) // 4
                    # Repeated rows go to different groups, and so do the full pieces of a document.
                    mixed, times[mixed] = _mixed(mixed, times[mixed]), times[mixed] + 1
                    for start in range(0, len(ids), width):
                        piece = ids[start : start + width]
                        group = _mixed(mixed, start // width + 1) if len(piece) == width else mixed
                        kept = None if checksum else piece
                        rows.append((key, start // 4, len(piece) // 4, total, kept, zlib.crc32(piece), group))
                        held += 64 if checksum else len(piece)
                        if held >= 4 * IDS_AT_ONCE:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.col(f"`{id_col}`").cast("string")  # text, so that null ids survive pandas
    return docs.select(key.alias("id"), text.alias("text"), F.xxhash64(key, text).alias("spread")).mapInPandas(
        cut_up, "doc_id string, start long, length long, doc_tokens long, ids binary, ids_crc32 long, spread long"
    )


class Tournament:
    """First bin with enough room, in a tree whose nodes know the most room below."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; the bin's number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_number = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return bin_number


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; the largest first, ties in the given order."""
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(len(sizes), length)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: dict[int, int] = {}
    for i in order.tolist():
        size = int(sizes[i])
        bin_number = tree.place(size)
        offset = used.get(bin_number, 0)
        bins[i], offsets[i] = bin_number, offset
        used[bin_number] = offset + size
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = GROUP_BYTES,
    checksum: bool = False,
) -> DataFrame:
    """Token sequences of at most ``length``, with every id of every document once.

    A document (its ids, then the end id 2) longer than a sequence is cut into
    full pieces and a rest. A full piece is a sequence; rests are dealt to random
    groups by a hash of id and text, and first-fit decreasing runs in each group
    on its own, the first fitting bin found in a tournament tree of room left.
    Groups get about ``group_bytes`` of text, whatever documents are long, and full
    pieces are spread over them one by one, so tasks stay the same at any
    input size, and each group wastes at most a few sequences' worth of room.

    Returns one row per piece: ``doc_id`` (type as given), ``start``, ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``ids_crc32`` and ``ids`` (binary,
    little-endian 32-bit). With ``checksum`` the ids stay in the task that makes
    them, and ``ids`` is left out.

    A null or empty text is the end id alone; null ids stay null. Repeated rows
    are packed each by itself. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    amount = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long") + 8)).first()[0] or 0
    groups = max(1, -(-amount // group_bytes))
    pieces = tokenize(docs, tokenizer, length, id_col, text_col, checksum)
    pieces = pieces.withColumn("group", F.pmod("spread", F.lit(groups))).drop("spread", *["ids"] * checksum)
    ids = [] if checksum else ["ids"]
    schema = "doc_id string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long" + ", ids binary" * (not checksum)

    def pack_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        sizes = frame["length"].to_numpy(np.int64)
        full = sizes == length
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bins[full] = np.arange(full.sum())
        bins[~full], offsets[~full] = first_fit_decreasing(sizes[~full], length)
        bins[~full] += full.sum()
        # Groups are spaced so far apart that their sequences cannot meet.
        frame["sequence_id"] = (int(frame["group"].iloc[0]) << 32) + bins
        frame["offset"] = offsets
        return frame[["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", *ids]]

    packed = pieces.groupBy("group").applyInPandas(pack_group, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
