"""BPE with word ends, of texts whose unsplit pieces may be very long: encoding by tree concatenation, and decoding.

A text is normalised (NFC, white space, lower case), split into words and these into pieces; a
piece is merged by rank. All distinct pieces of a batch are merged together in numpy, one rank
a round each. A long piece is cut into leaves that are merged at once like any other pieces,
and its halves are then joined level by level: the tokens on both sides of every join of a level
are encoded again together, in windows that grow until the outermost token on each side is the
one that was there. Then every two neighbours are what they would be alone, which makes the
whole the encoding of the piece. That holds if each merge makes a token of its own from tokens made
earlier; a vocabulary for which it doesn't hold is merged without cutting.

Edge cases: a null text counts as empty; an empty or blank text gives no ids; texts and pieces
of any length are encoded whole; strings of special tokens in a text are those tokens; bytes that
the vocabulary lacks give nothing; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import buffer_of, slices

#: Bytes of a leaf, and tokens on each side of a join that are encoded again at first.
LEAF, WINDOW = 64, 4
#: Words that a worker remembers before it starts afresh, and the longest that it remembers.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64
_NONE = np.int64(2**62)

# Letters and numbers of Unicode 16, and its pairs of capital (first, last) and small letter (offset),
# that the interpreter's tables of Unicode 15.1 lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_SMALL = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]

# Marks that came after the tables by which the vocabulary's texts were composed; they stay where they are, and block.
LATE_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]

#: Small sigma is the same at a word's end.
_LOWER = {0x3A3: 0x3C3} | {c: c + by for a, b, by in NEW_SMALL for c in range(a, b + 1)}
_ODD_CAPITALS = set(map(chr, _LOWER))
_WORDS = regex.compile(r"\S+")


def _inside(codes: list[int]) -> str:
    """The inside of a character class with these code points, given in ascending order."""
    spans: list[list[int]] = []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)


_LATE = {chr(c) for a, b in LATE_MARKS for c in range(a, b + 1)}
_AT_LATE = regex.compile("([" + _inside(sorted(map(ord, _LATE))) + "])")


def piece_patterns() -> tuple[str, str, set[str]]:
    """Contractions, runs of letters, single numbers, runs of anything else but white space: (any text's pattern, a fast one, characters that it mustn't meet).

    The fast pattern has the regex module's own classes, which differ for code points new to it.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    inside, odd = {}, set()
    for kind, more in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        ours = {ord(c) for c in every if unicodedata.category(c)[0] == kind} | {c for a, b in more for c in range(a, b + 1)}
        odd |= ours ^ {ord(c) for c in regex.findall(rf"\p{{{kind}}}", every)}
        inside[kind] = _inside(sorted(ours))
    form = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\\s{L}{N}]+"
    return form.format(**inside), form.format(L=r"\p{L}", N=r"\p{N}"), set(map(chr, odd))


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it prints in Latin-1, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + rest.index(b)) for b in range(256)]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each span, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class TreeCodec:
    """Encoder and decoder of one vocabulary (the text of its JSON file), by value."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        signs = byte_characters()
        self.inner = np.array([vocab.get(s, -1) for s in signs], np.int64)
        self.last = np.array([vocab.get(s + self.end, -1) for s in signs], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.shift = max(vocab.values()).bit_length()
        keys = np.array([vocab[a] << self.shift | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], _NONE), np.append(order, _NONE)
        self.made = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        # What each token is made of, and whether tokens can be joined as above.
        parts = {i: (i,) for i in [*self.inner.tolist(), *self.last.tolist()] if i >= 0}
        self.proper = True
        for (a, b), new in zip(pairs, self.made.tolist(), strict=False):
            left, right = parts.get(vocab[a]), parts.get(vocab[b])
            if left is None or right is None or new in parts:
                self.proper = False
                break
            parts[new] = left + right
        n = max(vocab.values()) + 1
        self.part_size = np.array([len(parts.get(i, ())) for i in range(n)], np.int64)
        self.part_start = np.cumsum(self.part_size) - self.part_size
        self.parts = np.array(list(chain.from_iterable(parts.get(i, ()) for i in range(n))), np.int64)
        self.patterns = piece_patterns()
        self.digest = hashlib.sha256(text.encode()).hexdigest()

    def ready(self) -> TreeCodec:
        """Adds what a worker works out for itself: patterns, and its memory of words."""
        self.exact, self.fast, self.odd = (*map(regex.compile, self.patterns[:2]), self.patterns[2])
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # No word has a space in it, so these stand for the special tokens among words.
        self.fixed = {f" {t}": np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.known = dict(self.fixed)
        return self

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of ids merged by rank, leftmost first among equals: the ids left and the sizes of their spans. A round merges one rank in every span."""
        n = len(sizes)
        span, done = np.repeat(np.arange(n), sizes), []
        while len(ids):
            key = np.full(len(ids), _NONE)
            same = span[1:] == span[:-1]
            key[:-1][same] = ids[:-1][same] << self.shift | ids[1:][same]
            at = np.searchsorted(self.keys, key)
            rank = np.where((self.keys[at] == key) & (key < _NONE), self.ranks[at], _NONE)
            first = np.flatnonzero(np.append(True, ~same))
            count = np.diff(np.append(first, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, first), count)
            over = least == _NONE
            if over.any():
                done.append((span[over], ids[over]))
                live = ~over
                ids, span, rank, least = ids[live], span[live], rank[live], least[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == least)
            # Of hits that overlap (three or more equal tokens in a row) every second one from the left.
            opens = np.append(True, (hit[1:] != hit[:-1] + 1) | (span[hit[1:]] != span[hit[:-1]]))
            hit = hit[(hit - hit[np.flatnonzero(opens)][np.cumsum(opens) - 1]) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, span = ids[keep], span[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        span, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(span, kind="stable")], np.bincount(span, minlength=n)

    def join(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Each pair of neighbouring encodings as one, all windows of a size at a time."""
        out: list[np.ndarray] = [None] * len(pairs)
        todo, w = list(range(len(pairs))), WINDOW
        while todo:
            sides = [(pairs[k][0][-w:], pairs[k][1][:w]) for k in todo]
            window = np.concatenate([x for s in sides for x in s])
            size = self.part_size[window]
            bases = self.parts[_spread(self.part_start[window], size)]
            ends = np.cumsum([len(a) + len(b) for a, b in sides])
            total = np.append(0, np.cumsum(size))[np.append(0, ends)]
            ids, sizes = self.merge(bases, np.diff(total))
            at, wider = 0, []
            for k, n, (a, b) in zip(todo, sizes.tolist(), sides, strict=True):
                new, (left, right) = ids[at : at + n], pairs[k]
                at += n
                if (w >= len(left) or new[0] == a[0]) and (w >= len(right) or new[-1] == b[-1]):
                    out[k] = np.concatenate([left[:-w], new, right[w:]])
                else:
                    wider.append(k)
            todo, w = wider, 2 * w
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit integers: leaves of all of them at once, then the levels of all trees."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[buf]
        ids[ends - 1] = self.last[buf[ends - 1]]
        leaves = -(-size // LEAF) if self.proper else np.ones(len(raw), np.int64)
        tree = np.cumsum(leaves) - leaves
        owner = np.repeat(np.arange(len(raw)), leaves)
        lo = (ends - size)[owner] + (np.arange(len(owner)) - tree[owner]) * LEAF
        hi = np.where(np.arange(len(owner)) + 1 == (tree + leaves)[owner], ends[owner], lo + LEAF)
        sizes = hi - lo
        if (ids < 0).any():
            there = ids >= 0
            sizes = np.diff(np.append(0, np.cumsum(there))[np.append(lo, ends[-1])])
            ids = ids[there]
        ids, sizes = self.merge(ids, sizes)
        cuts = np.append(0, np.cumsum(sizes)).tolist()
        growing = {k: [ids[cuts[j] : cuts[j + 1]] for j in range(t, t + n) if cuts[j] < cuts[j + 1]] for k, (t, n) in enumerate(zip(tree.tolist(), leaves.tolist(), strict=True)) if n > 1}
        data = ids.astype("<u4").tobytes()
        out = [data[4 * cuts[t] : 4 * cuts[t + 1]] for t in tree.tolist()]
        while growing:
            pairs = [(k, i) for k, own in growing.items() for i in range(0, len(own) - 1, 2)]
            joined = iter(self.join([(growing[k][i], growing[k][i + 1]) for k, i in pairs]))
            for k, own in list(growing.items()):
                growing[k] = [next(joined) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)]
                if len(growing[k]) < 2:
                    out[k] = b"".join(x.astype("<u4").tobytes() for x in growing.pop(k))
        return out

    def pieces(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word."""
        plain = self.odd.isdisjoint(set().union(*words))
        return [self.fast.findall(w) if plain or self.odd.isdisjoint(w) else self.exact.findall(w) for w in words]

    def words(self, text: str) -> list[str]:
        """The normalised words of a text; a special token is a space and its content."""
        if self.around is not None and any(t in text for t in self.special):
            return [w for k, s in enumerate(self.around.split(text)) for w in ([f" {s}"] if k % 2 else self._plain(s))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            used = set(text)
            text = unicodedata.normalize("NFC", text) if _LATE.isdisjoint(used) else "".join([unicodedata.normalize("NFC", s) for s in _AT_LATE.split(text)])
            if not _ODD_CAPITALS.isdisjoint(used):
                text = text.translate(_LOWER)
        text = text.lower()
        # str.split() takes these four for white space.
        return _WORDS.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Each distinct word of all of them is encoded once."""
        each = [self.words(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = dict(self.fixed)
        known = self.known
        new = [w for w in set(chain.from_iterable(each)) if w not in known]
        long = [w for w in new if len(w) > CACHE_CHARS]
        if new:
            split = self.pieces(new)
            distinct = list(set(chain.from_iterable(split)))
            code = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
            for w, own in zip(new, split, strict=True):
                known[w] = code[own[0]] if len(own) == 1 else b"".join([code[p] for p in own])
        out = [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") for own in each]
        for w in long:
            del known[w]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The ids' tokens with a space between them; ids that the vocabulary lacks give nothing."""
        return " ".join([self.texts[i] for i in ids if i in self.texts])


_READY: dict[str, TreeCodec] = {}


def on_worker(shared: TreeCodec) -> TreeCodec:
    """The worker's own codec of a vocabulary, by the digest of its file."""
    if shared.digest not in _READY:
        _READY.clear()
        _READY[shared.digest] = shared.ready()
    return _READY[shared.digest]


def read_codec(path: str) -> TreeCodec:
    with open(path, encoding="utf-8") as f:
        return TreeCodec(f.read())


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Per document: the `keep` columns, n_tokens, ids (array<int>, if asked for), ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256.

    The codec, of the vocabulary's size, is broadcast; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_codec(path))
    inp = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-1])
    extra = ", ids array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = on_worker(shared.value)
        text_of = c.texts.__getitem__
        for batch in batches:
            for lo, hi in slices(buffer_of(batch.column(batch.num_columns - 1))[1]):
                part = batch.slice(lo, hi - lo)
                every = c.encode_all([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                sha = [hashlib.sha256(got.tobytes()).hexdigest() for got in every]
                back = [hashlib.sha256(" ".join(map(text_of, got.tolist())).encode()).hexdigest() for got in every]
                cols = [*part.columns[:-1], pa.array([len(got) for got in every], pa.int64())]
                if ids:
                    at = np.cumsum([0, *[len(got) for got in every]]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(every).astype(np.int32))))
                cols += [pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[:-1], "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"])

    return inp.mapInArrow(run, f"{head}, n_tokens long{extra}, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and text: the ids' tokens with a space between them; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_codec(path))

    @F.pandas_udf("string")
    def text_of(col):
        c = on_worker(shared.value)
        return col.map(lambda x: None if x is None else c.decode(x))

    return encoded.select(*keep, text_of(F.col(ids_col)).alias("text"))
