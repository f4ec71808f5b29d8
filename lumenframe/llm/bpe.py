"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of the tree are the ranks of neighbouring symbol pairs, keyed
``rank * width + position``, so the root is the leftmost pair of the lowest
rank.  A merge rewrites at most three leaves, each followed by a walk to the
root; merging stops when the root holds no pair.  `merge_word` is the scalar
form for pieces of any length.  `merge_words` runs many short pieces side by
side: one tree is one row of a matrix and every step is a numpy operation over
all rows that still have a pair to merge.

Edge cases: a null text is the empty text; an empty text has no ids and decodes
to the empty text; a piece of any length is merged in O(n log n); the text of a
special token becomes that token's id, as the tokenizers library does by
default.  Rows are independent, so ties, repeated rows and empty tables need no
special rule; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stream, table

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most pieces whose ids a worker remembers; beyond it the memory starts anew.
CACHE_PIECES = 500_000
#: Pieces of at most so many bytes go through the matrix form.
WIDEST = 64
NO_PAIR = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The tables of one tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * self.size
        for text, i in ids.items():
            self.token[i] = bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        self.ranks = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        self.number = [str(i) for i in range(self.size)]
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), NO_PAIR where they don't merge or either is absent (negative)."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (a >= 0) & (b >= 0), self.key_rank[at], NO_PAIR)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_word(voc: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece; the scalar segment tree."""
    n = len(piece)
    sym = [int(voc.of_byte[b]) for b in piece]
    if n < 2:
        return sym
    width = 1 << (n - 1).bit_length()
    size, ranks, made = voc.size, voc.ranks, voc.made
    # Above every key, whatever the width.
    none = len(made) * width
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = ranks.get(sym[i] * size + sym[i + 1])
        if r is not None:
            tree[width + i] = r * width + i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    def pair(i: int, j: int) -> int:
        r = ranks.get(sym[i] * size + sym[j]) if 0 <= i and j < n else None
        return none if r is None else r * width + i

    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        k = after[j]
        sym[i], sym[j] = int(made[rank]), -1
        after[i] = k
        if k < n:
            before[k] = i
        put(j, none)
        put(i, pair(i, k))
        if before[i] >= 0:
            put(before[i], pair(before[i], i))
    return [s for s in sym if s >= 0]


def _merge_rows(voc: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Ids (as little-endian uint16/uint32 bytes) of pieces of at most `width` bytes, one tree each."""
    m = len(pieces)
    lens = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    sym = np.full((m, width + 1), -1, np.int64)
    sym[:, :width] = np.where(np.arange(width) < lens[:, None], voc.of_byte[raw], -1)
    after = np.tile(np.arange(1, width + 2), (m, 1))
    before = np.tile(np.arange(-1, width), (m, 1))
    after[:, width] = width
    tree = np.full((m, 2 * width), NO_PAIR, np.int64)
    first = voc.rank_of(sym[:, :-1], sym[:, 1:])
    tree[:, width:] = np.where(first < NO_PAIR, first * width + np.arange(width), NO_PAIR)
    level = width
    while level > 1:
        level >>= 1
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    flat_tree, flat_sym, flat_after, flat_before = tree.ravel(), sym.ravel(), after.ravel(), before.ravel()
    w1, w2 = width + 1, 2 * width
    rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
    while len(rows):
        s, t = rows * w1, rows * w2
        rank, i = np.divmod(flat_tree[t + 1], width)
        j = flat_after[s + i]
        k = flat_after[s + j]
        flat_sym[s + i] = voc.made[rank]
        flat_sym[s + j] = -1
        flat_after[s + i] = k
        flat_before[s + k] = i
        h = flat_before[s + i]
        inner = np.maximum(h, 0)
        mine = flat_sym[s + i]
        right = voc.rank_of(mine, flat_sym[s + k])
        left = voc.rank_of(np.where(h >= 0, flat_sym[s + inner], -1), mine)
        flat_tree[t + width + j] = NO_PAIR
        flat_tree[t + width + i] = np.where(right < NO_PAIR, right * width + i, NO_PAIR)
        has = h >= 0
        flat_tree[(t + width + inner)[has]] = np.where(left < NO_PAIR, left * width + inner, NO_PAIR)[has]
        for leaf in (j, i, inner):
            node = (leaf + width) >> 1
            while node[0]:
                flat_tree[t + node] = np.minimum(flat_tree[t + 2 * node], flat_tree[t + 2 * node + 1])
                node = node >> 1
        rows = rows[flat_tree[rows * w2 + 1] < NO_PAIR]
    alive = sym[:, :width] >= 0
    ids = sym[:, :width][alive].astype("<u2" if voc.size <= 1 << 16 else "<u4")
    unit, ends = ids.itemsize, np.cumsum(alive.sum(axis=1))
    blob, starts = ids.tobytes(), np.concatenate([[0], ends[:-1]])
    return [blob[a:b] for a, b in zip((starts * unit).tolist(), (ends * unit).tolist())]


def merge_words(voc: Vocabulary, pieces: list[str]) -> list[bytes]:
    """Ids of many pieces, in order, as little-endian bytes."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    out: list[bytes] = [b""] * len(raw)
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(raw):
        groups.setdefault(max(2, 1 << max(0, len(p) - 1).bit_length()), []).append(i)
    kind = "<u2" if voc.size <= 1 << 16 else "<u4"
    for width, members in groups.items():
        if width > WIDEST:
            for i in members:
                out[i] = np.array(merge_word(voc, raw[i]), kind).tobytes()
            continue
        step = max(1, 1_000_000 // width)
        for a in range(0, len(members), step):
            part = members[a : a + step]
            for i, ids in zip(part, _merge_rows(voc, [raw[i] for i in part], width)):
                out[i] = ids
    return out


class Encoder:
    """Encodes batches of texts; remembers the ids of pieces it has met."""

    def __init__(self, path: str):
        self.voc = vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.find = regex.compile(PIECES).findall
        self.kind = "<u2" if self.voc.size <= 1 << 16 else "<u4"

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, merge_words(self.voc, new)))

    def ids_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of `kind`."""
        cut: list[list[tuple[int | None, list[str]]]] = []
        for text in texts:
            parts: list[tuple[int | None, list[str]]] = []
            if text:
                if self.voc.splitter is not None and any(s in text for s in self.voc.special):
                    for p in self.voc.splitter.split(text):
                        if p in self.voc.special:
                            parts.append((self.voc.special[p], []))
                        elif p:
                            parts.append((None, self.find(p)))
                else:
                    parts.append((None, self.find(text)))
            cut.append(parts)
        self._learn({w for parts in cut for _, words in parts for w in words})
        get, kind = self.known.__getitem__, self.kind
        return [b"".join(np.array([sp], kind).tobytes() if sp is not None else b"".join(map(get, words)) for sp, words in parts) for parts in cut]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.ids_bytes([text])[0], self.kind).tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes of the ids in order, read as UTF-8; broken sequences become U+FFFD."""
        return b"".join(map(self.voc.token.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(rows: dict[str, list], text: str, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a batch with at most `limit` characters, or a single text."""
    a, size = 0, 0
    for i, t in enumerate(rows[text]):
        n = len(t or "")
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(rows[text]):
        yield a, len(rows[text])


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>: the token ids of every text."""
    path = path or tokenizer_path()

    def run(batches):
        enc = encoder(path)
        for rows in batches:
            for a, b in _texts(rows, text):
                yield {key: rows[key][a:b], "ids": [np.frombuffer(x, enc.kind).tolist() for x in enc.ids_bytes(rows[text][a:b])]}

    return stream(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, text: the texts of id arrays; null ids give a null text."""
    path = path or tokenizer_path()

    def run(batches):
        enc = encoder(path)
        for rows in batches:
            yield {key: rows[key], "text": [None if x is None else enc.decode(x) for x in rows["ids"]]}

    return stream(tokens.select(key, "ids"), run, f"{key} {dict(tokens.dtypes)[key]}, text string")


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass."""
    path = path or tokenizer_path()

    def run(batches):
        enc = encoder(path)
        number = enc.voc.number.__getitem__
        for rows in batches:
            for a, b in _texts(rows, text):
                n, ids_sha, text_sha = [], [], []
                for raw in enc.ids_bytes(rows[text][a:b]):
                    ids = np.frombuffer(raw, enc.kind).tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                yield {key: rows[key][a:b], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return stream(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
