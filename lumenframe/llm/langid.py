"""Language identification by a string kernel.

The kernel of two texts is the cosine of their blended spectra: the sets of all
byte 1-, 2-, 3- and 4-grams that occur in the lower-cased text.  Landmark texts
of every language give a Nyström map of the kernel, one-versus-rest ridge
regression on the mapped sample gives one column for each language, and both
fold into a single matrix, so a batch is scored by two matrix products:
presence x landmarks, then kernel x columns.  Every gram of any landmark has a
column: the DENSE columns held by most landmarks are multiplied densely, the rest
through lists of the landmarks that hold them.  Grams that no landmark holds count
in a text's norm only; that scales all its columns alike.

The fit reads a bounded sample of labelled rows (SAMPLE of each language, fewer
where there would be more than MOST_ROWS in all, but one of every language at
least, however many there are), chosen by a hash of the id; scoring reads every
row and every whole text.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is
every text if there is no labelled row; very long texts are scored whole and
in a batch of their own; ties go to the language that sorts first; repeated
rows get equal results; a row without an id is in no fold; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import doc_hash, held_out, sample_by_class, stream, table

#: Labelled rows of each language that the fit reads, and how many of them are landmarks.
SAMPLE, LANDMARKS = 250, 40
#: Most rows and landmarks, but for one of every language.
MOST_ROWS, MOST_LANDMARKS = 8000, 512
GRAMS = (1, 2, 3, 4)
RIDGE = 1e-2
#: Columns of the dense product, for the grams that most landmarks hold; all others are looked up in lists.
DENSE = 8192
#: Bits of a gram's key that lead to its place among the keys.
TABLE_BITS = 18
#: Texts and bytes of one matrix product.
BLOCK_ROWS, BLOCK_BYTES = 64, 1_500_000
_LETTER = regex.compile(r"\p{L}")
#: ASCII characters that aren't letters become spaces.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MIX = np.uint32(0x9E3779B1)


def gram_keys(raw: np.ndarray, n: int) -> np.ndarray:
    """Keys of all byte n-grams (n up to 4) of a buffer, in order: mixed well, and different for different grams."""
    h = np.zeros(len(raw) - n + 1, np.uint32)
    for i in range(n):
        h = (h << np.uint32(8)) | raw[i : len(raw) - n + 1 + i]
    return h * _MIX


def buffer(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.uint8).astype(np.uint32)


def plain(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" "


class Columns:
    """The column of every gram of the landmarks, by the gram's length; the grams of most landmarks come first."""

    def __init__(self, keys: list[np.ndarray], columns: list[np.ndarray]):
        """Sorted keys for each of GRAMS, and their columns."""
        shift = np.uint32(32 - TABLE_BITS)
        self.shift, self.count = shift, sum(map(len, keys))
        # One more key, so that every place can be read.
        self.keys = [np.append(k, np.uint32(0)) for k in keys]
        self.columns = [np.append(c, -1).astype(np.int32) for c in columns]
        self.start = [np.searchsorted(k >> shift, np.arange((1 << TABLE_BITS) + 1)).astype(np.int32) for k in keys]

    def of(self, which: int, key: np.ndarray) -> np.ndarray:
        """Columns of the keys of grams of length GRAMS[which]; -1 where no landmark holds the gram."""
        keys, columns, start = self.keys[which], self.columns[which], self.start[which]
        slot = key >> self.shift
        at, end = start[slot], start[slot + np.uint32(1)]
        out = np.where((at < end) & (keys[at] == key), columns[at], np.int32(-1))
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        step = 1
        while len(left):
            here = at[left] + step
            hit = keys[here] == key[left]
            out[left[hit]] = columns[here[hit]]
            left = left[~hit & (here + 1 < end[left])]
            step += 1
        return out


class KernelModel:
    """columns: of all grams of the landmarks; landmarks: (m, DENSE + 1) presence over norm of the first DENSE columns;
    lists: for the other columns the bounds and numbers of the landmarks that hold them; norms: of the landmarks; out: (m, languages)."""

    def __init__(self, langs: list[str], columns: Columns, landmarks: np.ndarray, lists: tuple[np.ndarray, np.ndarray], norms: np.ndarray, out: np.ndarray, scale: float):
        self.langs, self.columns, self.landmarks, self.lists, self.norms, self.out, self.scale = langs, columns, landmarks, lists, norms, out, scale

    def presence(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of 0/1 over the first DENSE columns (a last one is cleared); (row, column) of the others; the number of each row's grams."""
        p = np.zeros((len(raws), DENSE + 1), np.float32)
        flat = p.ravel()
        text = buffer(raws)
        owner = np.repeat(np.arange(len(raws), dtype=np.int64), [len(r) for r in raws])
        sparse, unseen = [], np.zeros(len(raws), np.int64)
        for which, n in enumerate(GRAMS):
            if len(text) >= n:
                key, row = gram_keys(text, n), owner[: len(text) - n + 1]
                if n > 1:
                    # Grams over the seam of two texts are skipped.
                    whole = row == owner[n - 1 :]
                    key, row = key[whole], row[whole]
                column = self.columns.of(which, key)
                flat[row * (DENSE + 1) + np.where(column < 0, DENSE, np.minimum(column, DENSE))] = 1
                rare, new = column >= DENSE, column < 0
                sparse.append(np.unique(row[rare] * self.columns.count + column[rare]))
                # Grams that no landmark holds count in the norm.
                unseen += np.bincount(np.unique((row[new] << 32) | key[new]) >> 32, minlength=len(raws))
        p[:, DENSE] = 0
        row, column = np.divmod(np.concatenate(sparse), max(1, self.columns.count))
        return p, row, column, p.sum(axis=1) + np.bincount(row, minlength=len(raws)) + unseen

    def kernel(self, raws: list[bytes]) -> np.ndarray:
        p, row, column, size = self.presence(raws)
        m = len(self.norms)
        bounds, members = self.lists
        first, many = bounds[column - DENSE], bounds[column - DENSE + 1] - bounds[column - DENSE]
        place = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        shared = np.bincount(np.repeat(row, many) * m + members[place], minlength=len(raws) * m).reshape(len(raws), m)
        return ((p @ self.landmarks.T + shared / self.norms) / np.sqrt(np.maximum(size, 1.0))[:, None]).astype(np.float32)

    def margins(self, raws: list[bytes]) -> np.ndarray:
        return self.kernel(raws) @ self.out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        block: list[int] = []
        raws: list[bytes] = []
        size = 0

        def flush() -> None:
            if block:
                m = self.margins(raws)
                e = np.exp(self.scale * (m - m.max(axis=1, keepdims=True)))
                p = e / e.sum(axis=1, keepdims=True)
                for i, k in zip(block, m.argmax(axis=1).tolist()):
                    langs[i] = self.langs[k]
                for i, v in zip(block, p.max(axis=1).tolist()):
                    scores[i] = float(min(1.0, v))
            block.clear()
            raws.clear()

        for i, t in enumerate(texts):
            if t and _LETTER.search(t):
                raw = plain(t)
                if block and (len(block) >= BLOCK_ROWS or size + len(raw) > BLOCK_BYTES):
                    flush()
                    size = 0
                block.append(i)
                raws.append(raw)
                size += len(raw)
        flush()
        return langs, scores

    @staticmethod
    def fit(texts: list[str | None], labels: list[str]) -> "KernelModel":
        """Learn from rows in the given order: the first LANDMARKS of each language are the landmarks."""
        rows = [(plain(t), y) for t, y in zip(texts, labels) if t and _LETTER.search(t)]
        langs = sorted({y for _, y in rows})
        if not langs:
            return KernelModel([], Columns([], []), np.zeros((0, 0), np.float32), (np.zeros(1, np.int64), np.zeros(0, np.int32)), np.zeros(0), np.zeros((0, 0)), 1.0)
        per = max(1, min(LANDMARKS, MOST_LANDMARKS // len(langs)))
        chosen = [r for y in langs for r, _ in [x for x in rows if x[1] == y][:per]]
        held = [[np.unique(gram_keys(buffer([r]), n)) if len(r) >= n else np.zeros(0, np.uint32) for r in chosen] for n in GRAMS]
        found = [np.unique(np.concatenate(h), return_counts=True) for h in held]
        # The grams that most landmarks hold first.
        order = np.argsort(-np.concatenate([c for _, c in found]), kind="stable")
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        columns = Columns([k for k, _ in found], np.split(column, np.cumsum([len(k) for k, _ in found])[:-1]))
        none = (np.zeros(max(0, columns.count - DENSE) + 1, np.int64), np.zeros(0, np.int32))
        model = KernelModel(langs, columns, np.zeros((0, DENSE + 1), np.float32), none, np.zeros(0), np.zeros((0, 0)), 1.0)
        parts = [model.presence(chosen[a : a + BLOCK_ROWS]) for a in range(0, len(chosen), BLOCK_ROWS)]
        model.norms = np.sqrt(np.concatenate([size for *_, size in parts]))
        model.landmarks = (np.concatenate([p for p, *_ in parts]) / model.norms[:, None]).astype(np.float32)
        member = np.concatenate([row + i * BLOCK_ROWS for i, (_, row, _, _) in enumerate(parts)])
        place = np.concatenate([c for _, _, c, _ in parts]) - DENSE
        model.lists = (np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(none[0]) - 1))]).astype(np.int64), member[np.argsort(place, kind="stable")].astype(np.int32))
        kmm = np.concatenate([model.kernel(chosen[a : a + BLOCK_ROWS]) for a in range(0, len(chosen), BLOCK_ROWS)]).astype(float)
        value, vector = np.linalg.eigh(kmm)
        half = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
        knm = np.concatenate([model.kernel([r for r, _ in rows[a : a + BLOCK_ROWS]]) for a in range(0, len(rows), BLOCK_ROWS)]).astype(float)
        z = knm @ half
        y = np.array([[1.0 if l == k else -1.0 for k in langs] for _, l in rows])
        share = np.array([sum(l == k for _, l in rows) for k in langs], float)
        w = np.array([1 / share[langs.index(l)] for _, l in rows])
        w *= len(rows) / w.sum()
        beta = np.linalg.solve(z.T @ (w[:, None] * z) + RIDGE * len(rows) / 100 * np.eye(z.shape[1]), z.T @ (w[:, None] * y))
        model.out = half @ beta
        model.scale = 4.0
        return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> KernelModel:
    """Learn from docs (doc_id, text, lang) with a language."""
    known = docs.where("lang is not null and doc_id is not null")
    picked = sample_by_class(known.select("doc_id", "lang"), "lang", sample, total=MOST_ROWS).select("doc_id").distinct()
    # `picked` is bounded by the sample of each language, so it is the side to broadcast.
    rows = sorted(known.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "lang").collect(), key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[1] or ""))
    return KernelModel.fit([r[1] for r in rows], [r[2] for r in rows])


_MODELS: dict[bytes, KernelModel] = {}


def identify(docs: DataFrame, model: KernelModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.columns, model.landmarks, model.lists, model.norms, model.out.astype(np.float32), model.scale))
    tag = np.random.default_rng().bytes(12)

    def run(batches):
        if tag not in _MODELS:
            _MODELS.clear()
            _MODELS[tag] = KernelModel(*shared.value)
        m = _MODELS[tag]
        for rows in batches:
            langs, scores = m.predict(rows[text])
            yield {key: rows[key], "lang_pred": langs, "score": scores}

    return stream(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.where(doc_hash() % 3 != 1))
    return identify(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
