"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of every kind.  The base
generators (email, ip, card, phone) follow fixed definitions and their spans
always stay.  Looser generators propose what those miss: obfuscated addresses,
telephone numbers in other groupings, cards of other lengths or separators,
national numbers, bank accounts, longer and masked network addresses, and keys.
Boosted trees score each proposal from its format and its context; a span is
kept where the calibrated probability reaches its kind's threshold and no base
span or better proposal overlaps it.  Context is learned too: each word's log
odds of standing before or after personal data of a kind.

The labelled spans come from a seeded grammar (`pii_examples`), so a fit needs no
rows and gives the same model everywhere.  Four disjoint parts of the examples
serve the words' log odds, the trees, the calibration and the thresholds.

Edge cases: a null text is the empty text and holds nothing; texts, runs and
spans of any length are searched whole, in time linear in the text; an empty
table gives an empty result; equal scores prefer the earlier, then the longer
span; repeated rows are treated alike; other columns are not read, and clashing
names among them are left as they are.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_text, stream, table
from .boosting import BoostedTrees
from .pii_examples import example

#: Kinds with fixed definitions, in report order; the further kinds come from the model alone.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A digit run that fails from its first digit fails from every other, so runs are entered only at their first.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: around each @, the longest local part that no earlier match reaches into."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        at = text.find("@", max(at + 1, end))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    at = 0
    while m := _IP.search(text, at):
        at = m.end()
        # Parts may be of any length, so they are compared as texts.
        if all(len(d) < 3 or (len(d) == 3 and d <= "255") for d in (p.lstrip("0") for p in m.group().split("."))):
            out.append(m.span())
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The spans of the fixed definitions, by kind as listed, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        out += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# Looser generators: kind, what a text must hold in lower case (any of several), whether it must hold a digit, pattern.
# Runs without a length are entered at their first character and never given back; numbers have the lengths of their formats.
_LOOSE = (
    ("email", ("(at)", "[at]", "{at}"), False, re.compile(r"(?<![\w.+-])[\w.+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++", re.I)),
    ("email", (" dot ",), False, re.compile(r"(?<![\w.+-])[\w.+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++", re.I)),
    ("ip", ("[.]", "(.)", "[dot]"), True, re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![\w.]?[0-9])", re.I)),
    ("ip", (":",), True, re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("phone", ("",), True, re.compile(r"(?<![\w.+(/-])(?:\+[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{1,5}\)?[ ./-]{1,2}){1,4}[0-9]{2,7}(?!\w|[.-][0-9])")),
    ("phone", ("",), True, re.compile(r"(?<![\w.+/-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?!\w|[.-][0-9])")),
    ("card", ("",), True, re.compile(r"(?<![\w.+-])[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![\w-])")),
    ("card", ("",), True, re.compile(r"(?<![\w.+-])(?:[0-9]{4}[ .-]?){3}[0-9]{1,7}(?![\w-])")),
    ("ssn", ("-",), True, re.compile(r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", ("",), True, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("secret", ("=", ":"), False, re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|(?:api|access)[_-]?key) ?[=:] ?[\"']?([^\s\"',;]{6,}+)", re.I)),
    ("secret", ("",), True, re.compile(r"(?<![\w/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+(?![\w/+=-])")),
)


def loose_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Proposals of the looser generators; they may overlap each other and base spans."""
    if not text:
        return []
    digit = _DIGIT.search(text) is not None
    lower = text.lower()
    out = []
    for kind, needs, needs_digit, pattern in _LOOSE:
        if (digit or not needs_digit) and any(x in lower for x in needs):
            # The span is the group, where a pattern has one.
            out += [(kind, *m.span(pattern.groups)) for m in pattern.finditer(text)]
    return out


_WORDS = re.compile(r"[^\W\d_]+")
#: Characters of context before and after a span, and the words taken from them.
BEFORE, AFTER = 48, 24
WORDS_BEFORE, WORDS_AFTER = 5, 2
#: A word's log odds stay within these.
ODDS = 3.0


def _only(keep: str) -> bytes:
    """A byte table that turns everything but `keep` into spaces."""
    return bytes(c if chr(c) in keep else 32 for c in range(256))


_DIGITS, _UPPER, _LOWER, _ALPHA = map(_only, (string.digits, string.ascii_uppercase, string.ascii_lowercase, string.ascii_letters))
_NO_VOWELS = bytes(c for c in range(256) if chr(c) not in "aeiouAEIOU")
_DOUBLED = bytes(sum(divmod(2 * (c - 48), 10)) if 48 <= c < 58 else 0 for c in range(256))


def luhn(digits: str) -> bool:
    raw = digits.encode()
    plain = raw[::-2]
    return (sum(plain) - 48 * len(plain) + sum(raw[-2::-2].translate(_DOUBLED))) % 10 == 0


def account_checks(s: str) -> bool:
    """Whether a bank account number passes its checksum."""
    s = s.replace(" ", "")
    return s[:2].isalpha() and s[2:4].isdigit() and 15 <= len(s) <= 34 and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def form(kind: str, s: str) -> list[float]:
    """Features of the span itself."""
    raw = s.encode("ascii", "replace")
    n, count = len(raw), raw.count
    groups, letters = raw.translate(_DIGITS).split(), raw.translate(_ALPHA).split()
    upper, lower = raw.translate(_UPPER).split(), raw.translate(_LOWER).split()
    digits, alpha = b"".join(groups), sum(map(len, letters))
    sizes = list(map(len, groups)) or [0]
    return [
        n, len(digits), len(sizes), max(sizes), min(sizes), sizes[0], sizes[1] if len(sizes) > 1 else 0, sizes[-1],
        kind == "card" and luhn(digits.decode()), kind == "iban" and account_checks(s), len(set(raw)) / n, len(digits) / n, len(set(digits)), digits[:1] in b"3456",
        sum(map(len, upper)), sum(map(len, lower)), max(map(len, letters), default=0), alpha, len(raw.translate(None, _NO_VOWELS)) / max(1, alpha), (len(groups) + len(upper) + len(lower)) / n, len(set(raw)),
        count(b"-"), count(b"_"), count(b" "), count(b"."), count(b"/"), count(b":"), count(b"("), s[0] == "+", count(b"[") + count(b"{") + count(b"<") + count(b"$"),
    ]


def surroundings(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The last words before a span and the first after it, in lower case."""
    return _WORDS.findall(text[max(0, a - BEFORE) : a].lower())[-WORDS_BEFORE:], _WORDS.findall(text[b : b + AFTER].lower())[:WORDS_AFTER]


def last_part(s: str) -> str:
    """The last word of a span, as a word of context: endings of addresses speak for themselves."""
    found = _WORDS.findall(s[-16:].lower())
    return f".{found[-1]}" if found else "."


def features(text: str, kind: str, a: int, b: int, odds: dict[tuple[str, str], float]) -> list[float]:
    """Format of the span, then its context."""
    s = text[a:b]
    before, after = surroundings(text, a, b)
    spoken = [odds.get((kind, w), 0.0) for w in before] or [0.0]
    lead = text[max(0, a - 4) : a].rstrip()
    return form(kind, s) + [
        sum(spoken), max(spoken), min(spoken), spoken[-1], sum([odds.get((kind, w + "<"), 0.0) for w in after]), odds.get((kind, last_part(s)), 0.0),
        a == 0 or text[a - 1].isspace(), b == len(text) or text[b].isspace() or text[b] in ".,;:!?)",
        lead.endswith((":", "#", "no.", "nr.")), lead.endswith(("=", '="', "='", ': "', ": '")), "$" in text[max(0, a - 2) : a] or "%" in text[b : b + 2],
    ]


def word_odds(made: list[tuple[str, str, int, int, int]]) -> dict[tuple[str, str], float]:
    """Smoothed log odds of each kind's words of context, against the kind's own odds."""
    seen: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for text, kind, a, b, good in made:
        before, after = surroundings(text, a, b)
        total[kind][good] += 1
        for w in {*before, *(w + "<" for w in after), last_part(text[a:b])}:
            seen[kind, w][good] += 1
    out = {}
    for (kind, w), (bad, good) in seen.items():
        if bad + good >= 5:
            prior = math.log((total[kind][1] + 1) / (total[kind][0] + 1))
            out[kind, w] = max(-ODDS, min(ODDS, math.log((good + 1) / (bad + 1)) - prior))
    return out


class SpanModel:
    """Words' log odds; for each kind its trees, and the calibrated probability from which its spans stay."""

    def __init__(self, odds: dict[tuple[str, str], float], trees: dict[str, BoostedTrees], thresholds: dict[str, float]):
        self.odds, self.trees, self.thresholds = odds, trees, thresholds

    def rows(self, made: list[tuple[str, str, int, int, int]], kind: str) -> tuple[np.ndarray, np.ndarray]:
        mine = [m for m in made if m[1] == kind]
        return np.array([features(t, k, a, b, self.odds) for t, k, a, b, _ in mine], float), np.array([m[4] for m in mine], float)


#: Share of the spans above a threshold that are personal: a redaction that is not wanted costs more than one missed.
PRECISION = 0.95
#: Shares of the examples for the words, the trees, the calibration and the thresholds.
PARTS = (0.3, 0.35, 0.15, 0.2)


@lru_cache(maxsize=1)
def model(examples: int = 36_000, seed: int = 7) -> SpanModel:
    """Learned from examples of the grammar; a kind's threshold is the least at which PRECISION of its part's spans are personal."""
    rnd = random.Random(seed)
    made = [example(rnd) for _ in range(examples)]
    cuts = np.cumsum([int(examples * p) for p in PARTS[:3]]).tolist()
    words, grown, scaled, judged = (made[a:b] for a, b in zip([0, *cuts], [*cuts, examples]))
    fitted = SpanModel(word_odds(words), {}, {})
    for k in KINDS:
        trees = fitted.trees[k] = BoostedTrees().fit(*fitted.rows(grown, k)).calibrate(*fitted.rows(scaled, k))
        x, y = fitted.rows(judged, k)
        p = trees.probability(x)
        order = np.argsort(-p, kind="stable")
        good = np.flatnonzero(np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= PRECISION)
        fitted.thresholds[k] = float(p[order][good[-1]]) if len(good) else math.inf
    return fitted


def find_spans(texts: list[str | None], fitted: SpanModel) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, both by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    taken: dict[int, bytearray] = {}
    rows: dict[str, list[tuple[int, int, int]]] = {}
    for i, text in enumerate(texts):
        proposals = loose_spans(text)
        if proposals:
            # One mark a character, so that overlaps are told in time linear in the spans.
            marks = taken[i] = bytearray(len(text))
            for _, a, b in base[i]:
                marks[a:b] = b"\1" * (b - a)
            for kind, a, b in dict.fromkeys(proposals):
                if marks.find(1, a, b) < 0:
                    rows.setdefault(kind, []).append((i, a, b))
    scored = []
    for kind, spans in rows.items():
        x = np.array([features(texts[i], kind, a, b, fitted.odds) for i, a, b in spans], float)
        p = fitted.trees[kind].probability(x).tolist()
        scored += [(-q, a, a - b, kind, i) for q, (i, a, b) in zip(p, spans) if q >= fitted.thresholds[kind]]
    more: dict[int, list] = {}
    for _, a, length, kind, i in sorted(scored):
        b = a - length
        if taken[i].find(1, a, b) < 0:
            taken[i][a:b] = b"\1" * (b - a)
            more.setdefault(i, []).append((kind, a, b))
    rank = {k: n for n, k in enumerate(KINDS)}
    return [(s, sorted(s + more.get(i, []), key=lambda z: (rank[z[0]], z[1]))) for i, s in enumerate(base)]


def held_out_quality(examples: int = 20_000, seed: int = 11) -> dict[str, tuple[float, float, float]]:
    """kind -> threshold, precision and recall on examples whose leads the fit has not seen."""
    fitted, rnd = model(), random.Random(seed)
    made = [example(rnd, True) for _ in range(examples)]
    out = {}
    for k in KINDS:
        x, y = fitted.rows(made, k)
        stays = fitted.trees[k].probability(x) >= fitted.thresholds[k]
        out[k] = (fitted.thresholds[k], float(y[stays].mean()) if stays.any() else math.nan, float(y[stays].sum() / max(1.0, y.sum())))
    return out


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda z: (z[1], -z[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<kind,start,end>>, base (same type), redacted: the operator's own result."""
    fitted = model()
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for rows in batches:
            found = find_spans(rows[text], fitted)
            yield {key: rows[key], "spans": [as_rows(s) for _, s in found], "base": [as_rows(b) for b, _ in found], "redacted": [redact(t, s) for t, (_, s) in zip(rows[text], found)]}

    return stream(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, spans {kind}, base {kind}, redacted string")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base kinds, base_sha256, spans: the same search without carrying texts out."""
    fitted = model()

    def run(batches):
        for rows in batches:
            found = find_spans(rows[text], fitted)
            out = {f"n_{k}": [sum(s[0] == k for s in b) for b, _ in found] for k in BASE}
            yield {key: rows[key], **out, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(s) for _, s in found]}

    return stream(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def redact_rows(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows of `docs` with personal data in their texts replaced, and the column of lengths brought up to date."""
    fitted = model()

    def start():
        return lambda texts: [redact(t, s) for t, (_, s) in zip(texts, find_spans(texts, fitted))]

    return map_text(docs, text, start, length)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
