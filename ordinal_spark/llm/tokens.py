"""Encoding texts with a public tokenizer file inside Arrow tasks.

The file's content travels as a broadcast (a few MB whatever the input), so
executors need no copy of it. Where a tokenizer drops white space (its
normaliser only folds, and its splitter takes pieces without blanks), the ids
of a text are the ids of its blank- and line-separated words one after
another; each worker then encodes a word once and looks it up afterwards.

New words of ASCII and Latin-1 letters are cut into the pieces that the
tokenizer's own splitting pattern takes from them, and the library encodes new
pieces, many at a time, with the file's model. Every piece ends with one id
whose token has the end-of-word suffix, which tells pieces apart. All other
words, and any batch whose counts disagree, go through the whole tokenizer word
by word. Other tokenizers get whole texts.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer, pre_tokenizers

from .text import ragged

WORDS_KEPT, PIECES_KEPT = 700_000, 300_000  # of a worker's memories; beyond, the most used quarter stays
TOGETHER = 2_000              # new pieces that are encoded as one text
WORDS_TOGETHER = 20_000       # new words that are cut into pieces at once
# words of other than visible ASCII and Latin-1 letters, which NFC leaves and lower-casing takes letter by letter
ODD_LINE = regex.compile("^[!-~À-ÖØ-öø-ÿ]*[^!-~À-ÖØ-öø-ÿ\n][^\n]*$", regex.MULTILINE)
MARK = "\x01"
_FOLDING = {"NFC", "NFD", "Lowercase"}
_encoders: dict[tuple[str, int], "Encoder"] = {}


def drops_space(spec: dict) -> bool:
    """Whether words apart by a blank or line feed are encoded independently."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    pres = pre.get("pretokenizers", [pre] if pre else [])
    folds = all(x["type"] in _FOLDING or x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " " for x in norms)
    if not (folds and len(pres) == 2 and pres[0]["type"] == "Split" and pres[0]["behavior"] == "Removed" and pres[0]["invert"]):
        return False
    if pres[1]["type"] != "ByteLevel" or pres[1]["add_prefix_space"] or pres[1]["use_regex"]:
        return False
    pattern = pres[0]["pattern"].get("Regex")
    return (bool(pattern) and not regex.search(pattern, " \n") and spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix")
            and not any(set(" \n") & set(x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])))


class Memo(dict):
    """Numbers words as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class Ragged:
    """Ids of numbered things, as arrays that grow."""

    def __init__(self) -> None:
        self.n = self.used = 0
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def append(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        while len(self.size) < self.n + len(sizes):
            self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        mine = slice(self.n, self.n + len(sizes))
        self.size[mine], self.start[mine] = sizes, self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.n, self.used = self.n + len(sizes), self.used + len(ids)

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.start[at], self.size[at])]


class Uses:
    """How often numbered things were met, halved whenever a memory is cut."""

    def __init__(self) -> None:
        self.n = np.zeros(1024, np.int64)

    def count(self, at: np.ndarray) -> None:
        more = np.bincount(at)
        if len(more) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros(max(len(self.n), len(more) - len(self.n)), np.int64)])
        self.n[:len(more)] += more


def most_used(memo: Memo, ids: Ragged, uses: Uses, keep: int) -> tuple[Memo, Ragged, Uses]:
    """The memory of the ``keep`` most used things, numbered anew."""
    n = np.zeros(len(memo), np.int64)
    n[:min(len(n), len(uses.n))] = uses.n[:len(n)]
    held = np.sort(np.argsort(-n, kind="stable")[:keep])
    names, new, own, fresh = list(memo), Memo(), Ragged(), Uses()
    new.update((names[i], j) for j, i in enumerate(held.tolist()))
    own.append(ids.size[held], ids.of(held))
    fresh.n = n[held] // 2
    return new, own, fresh


def printable_bytes() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for their
    byte, the other bytes for characters from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


class Encoder:
    """``words``: how many words its memory keeps, and at most half as many pieces."""

    def __init__(self, content: bytes, words: int = WORDS_KEPT) -> None:
        self.words_kept, self.pieces_kept = words, min(PIECES_KEPT, words // 2)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        self.by_word = drops_space(spec)
        if self.by_word:
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.special = [x["content"] for x in spec.get("added_tokens", [])]
            self.bytes = printable_bytes()
            vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max([*vocab.values(), *(x["id"] for x in spec.get("added_tokens", []))]) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.piece, self.piece_ids, self.piece_uses = Memo(), Ragged(), Uses()
        self.word, self.words, self.word_uses = Memo(), Ragged(), Uses()

    def forget(self) -> None:
        """Keep what is used most of memories that have grown too large."""
        if len(self.word) > self.words_kept:
            self.word, self.words, self.word_uses = most_used(self.word, self.words, self.word_uses, self.words_kept // 4)
        if len(self.piece) > self.pieces_kept:
            self.piece, self.piece_ids, self.piece_uses = most_used(self.piece, self.piece_ids, self.piece_uses, self.pieces_kept // 4)

    def _learn_pieces(self) -> None:
        new, self.piece.new = self.piece.new, []
        for i in range(0, len(new), TOGETHER):
            group = new[i:i + TOGETHER]
            seen = " ".join(p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes) for p in group)
            ids = np.array(self.pieces.encode_batch_fast([seen], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(group) or (len(ids) and last[-1] != len(ids)):
                alone = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                self.piece_ids.append(np.array([len(x) for x in alone], np.int64), np.array([i for x in alone for i in x], np.uint32))
            else:
                self.piece_ids.append(np.diff(np.concatenate([[0], last])), ids)

    def _learn_words(self) -> None:
        new, self.word.new = self.word.new, []
        for i in range(0, len(new), WORDS_TOGETHER):
            self._learn(new[i:i + WORDS_TOGETHER])

    def _learn(self, new: list[str]) -> None:
        joined = "\n".join(new)
        odd = set(ODD_LINE.findall(joined))
        if any(x in joined for x in self.special):
            odd |= {w for w in new if any(x in w for x in self.special)}
        plain = [w for w in new if w not in odd] if odd else new
        # a mark after each word is a piece by itself
        cut = self.cut.findall(f" {MARK} ".join([*plain, ""]).lower())
        at = np.fromiter(map(self.piece.__getitem__, cut), np.int64, len(cut))
        if self.piece.new:
            self._learn_pieces()
        self.piece_uses.count(at)
        marks = np.flatnonzero(at == self.piece[MARK]) if plain else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([[-1], marks])) - 1
        at = np.delete(at, marks)
        each = np.zeros(len(new), np.int64)
        each[[i for i, w in enumerate(new) if w not in odd] if odd else slice(None)] = counts
        owner = np.repeat(np.arange(len(new)), each)
        sizes = np.bincount(owner, self.piece_ids.size[at], len(new)).astype(np.int64)
        ids = self.piece_ids.of(at)
        others = [i for i, w in enumerate(new) if w in odd] if odd else []
        if others:
            whole = [x.ids for x in self.tokenizer.encode_batch_fast([new[i] for i in others], add_special_tokens=False)]
            begin = np.cumsum(sizes) - sizes
            ids = np.insert(ids, np.repeat(begin[others], [len(x) for x in whole]), [i for x in whole for i in x])
            sizes[others] = [len(x) for x in whole]
        self.words.append(sizes, ids.astype(np.uint32))

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, where each text's begin)."""
        self.forget()
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()  # each distinct word is looked up once
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.word.__getitem__, distinct), np.int64, len(distinct))
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        if self.word.new:
            self._learn_words()
        self.word_uses.count(number)  # texts of this chunk count once
        return at, split.offsets.to_numpy()[:-1].astype(np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Ids in each text."""
        if not texts:
            return np.zeros(0, np.int64)
        if not self.by_word:
            return np.array([len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], np.int64)
        at, begin = self._words(texts)
        return np.add.reduceat(self.words.size[at], begin)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids in each text)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        at, begin = self._words(texts)
        return self.words.of(at), np.add.reduceat(self.words.size[at], begin)


def load(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """(version digest, broadcast content) of a tokenizer file."""
    with open(path, "rb") as f:
        content = f.read()
    return hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)


def encoder(version: str, content: Broadcast, words: int = WORDS_KEPT) -> Encoder:
    """The worker's encoder for a version and a size of memory."""
    if (version, words) not in _encoders:
        _encoders[version, words] = Encoder(content.value, words)
    return _encoders[version, words]


def drop_encoders() -> None:
    """Let a worker's encoders go, and give back what its allocators would
    keep of them."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
