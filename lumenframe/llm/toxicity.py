"""Toxicity by a weighted finite-state pattern grammar.

Six small transducers read the words of a clause as symbols: negation, reported
speech, targets (you, they, names of groups), insults, threats, and the clause as
a whole.  Each rewrites or weighs the symbols that the one before it lets
through; composed, they are one deterministic machine whose state is the tuple of
their states, and whose state at the end of a clause tells what the clause is:

* a *threat*: a threatening word after a target;
* *directed*: an insult close before or behind a target;
* *compound*: several insults;
* *plain*: one insult among other words;
* none of these: no word of the lists, or an insult that stands alone, as in a
  heading, a list or an answer of one word.  Such a clause weighs nothing.

A matched clause weighs as much as its weightiest word, raised beside a target
and lowered in the scope of a negation or of reported speech.  The score of a
document is a logistic of its clauses' total and greatest weight and number, and
of the total of those that are more than plain: how much a plain clause says, and
how much more the others do, is learned from the labels.

Function words of the grammar are fixed lists.  The insults are learned: words
and word stems (the first STEMS bytes) that labelled toxic documents hold far
more often than clean ones, weighed by the log of that ratio, over a bounded
sample of labelled rows (SAMPLE of each class).  A word or stem is in only if
its counts are beyond chance, with the number of candidates allowed for.  Scoring
reads every whole text; only texts that hold a pattern word are walked, the
others have no match by definition.

Edge cases: null, empty and blank texts have no match; a clause may be of any
length; without labelled rows the insults are empty and threats alone count;
ties in the lexicon go to the word that sorts first; repeated rows get equal
scores; a row without an id is in no fold; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, doc_hash, held_out, sample_by_class, stream, table

#: Labelled documents of each class that the fit reads, and most learned words.
SAMPLE, LEXICON = 20_000, 2_000
#: A learned word is in so many toxic documents at least; its counts are beyond chance by the log of the number of candidates and so many nats more.
LEAST_DOCS, LEAST_EVIDENCE = 3, 3.0
#: Lengths in bytes of the stems that are counted beside whole words.
STEMS = (4, 5, 6, 7)

#: Fixed word lists of the grammar (English, German, French, Spanish).
TARGET = frozenset("you your yours u he she they them him her his their those these people everyone du dich dir ihr euch sie er tu toi te vous ton ta il elle ils elles leur tú ti vos usted ustedes él ella ellos".split())
NEGATION = frozenset("not never no none isn't aren't don't doesn't wasn't nicht kein keine nie niemals pas jamais aucun nunca jamás".split())
REPORT = frozenset("said says say saying called calls wrote writes quoted quote quotes claimed reported according alleged sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split())
THREAT = frozenset("kill murder hurt destroy strangle shoot stab beat töten umbringen tuer frapper matar golpear".split())
#: Symbols: other, insult, threat, target, negation, report, quotation mark, insult behind a target.
OTHER, INSULT, THREAT_, TARGET_, NEGATION_, REPORT_, QUOTE, DIRECTED = range(8)
#: What a clause is.
NOTHING, PLAIN, COMPOUND, DIRECT, MENACE = range(5)

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
#: ASCII characters other than letters and the apostrophe become spaces before words are looked up.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_CURLY = re.compile("[‐-‟…«» ¡¿]")


class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol, factor), given as a rule."""

    #: The state of the last transducer of a composition.
    last = staticmethod(lambda state: state)

    def __init__(self, start: tuple, step: Callable):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: what this one writes, the other reads; factors multiply."""

        def step(state, symbol):
            a, b = state
            a, symbol, f = self.step(a, symbol)
            b, symbol, g = other.step(b, symbol)
            return (a, b), symbol, f * g

        both = Transducer((self.start, other.start), step)
        both.last = lambda state: other.last(state[1])
        return both

    def compiled(self, symbols: int, end: Callable) -> tuple[list[list[tuple[int, int, float]]], list[int]]:
        """The reachable states as a table [state][symbol] -> (state, symbol, factor), and `end` of the last transducer's state for each."""
        index, todo, rows = {self.start: 0}, [self.start], []
        for state in todo:
            row = []
            for s in range(symbols):
                to, out, f = self.step(state, s)
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row.append((index[to], out, f))
            rows.append(row)
        return rows, [end(self.last(state)) for state in index]


def negation(scope: int = 3) -> Transducer:
    """A negation weakens matches among the next `scope` words."""

    def step(left, s):
        if s == NEGATION_:
            return scope, OTHER, 1.0
        return max(0, left - 1), s, 0.3 if left and s in (INSULT, THREAT_) else 1.0

    return Transducer(0, step)


def reported() -> Transducer:
    """A reporting verb weakens matches to the end of the clause; inside quotation marks more so."""

    def step(state, s):
        verb, quoted = state
        if s == QUOTE:
            return (verb, not quoted), QUOTE, 1.0
        if s == REPORT_:
            return (True, quoted), OTHER, 1.0
        factor = (0.4 if verb else 1.0) * (0.6 if quoted else 1.0)
        return (verb, quoted), s, factor if s in (INSULT, THREAT_) else 1.0

    return Transducer((False, False), step)


def targets(reach: int = 4) -> Transducer:
    """A target among the last `reach` words strengthens an insult and directs it; a threat needs one to count."""

    def step(left, s):
        if s == TARGET_:
            return reach, TARGET_, 1.0
        if s == QUOTE:
            return left, s, 1.0
        out, factor = (DIRECTED, 1.25) if left and s == INSULT else (OTHER, 0.0) if s == THREAT_ and not left else (s, 1.0)
        return max(0, left - 1), out, factor

    return Transducer(0, step)


def insults() -> Transducer:
    """A further insult right after one strengthens it."""

    def step(last, s):
        now = s in (INSULT, DIRECTED)
        return (last if s == QUOTE else int(now)), s, 1.1 if last and now else 1.0

    return Transducer(0, step)


def threats() -> Transducer:
    """A second threat in a clause counts half."""

    def step(seen, s):
        return (1 if s == THREAT_ else seen), s, 0.5 if seen and s == THREAT_ else 1.0

    return Transducer(0, step)


def clauses(reach: int = 4) -> Transducer:
    """Words and insults of the clause (two stands for more), words in which a target directs the last insult, and whether any is directed or a threat."""

    def step(state, s):
        words, found, open_, directed, threat = state
        if s == QUOTE:
            return state, s, 1.0
        insult = s in (INSULT, DIRECTED)
        directed = directed or s == DIRECTED or (s == TARGET_ and open_ > 0)
        return (min(2, words + 1), min(2, found + insult), reach if insult else max(0, open_ - 1), directed, threat or s == THREAT_), s, 1.0

    return Transducer((0, 0, 0, False, False), step)


def clause_kind(state: tuple) -> int:
    words, found, _, directed, threat = state
    if threat:
        return MENACE
    return DIRECT if directed else COMPOUND if found > 1 else PLAIN if found and words > 1 else NOTHING


GRAMMAR, KINDS = negation().then(reported()).then(targets()).then(insults()).then(threats()).then(clauses()).compiled(7, clause_kind)
#: The weight of a threat, on the scale of the learned log ratios.
THREAT_WEIGHT = 3.0


def plain_words(low: str) -> set[bytes]:
    """The distinct words of a lower-cased text as UTF-8."""
    if not low.isascii():
        low = _CURLY.sub(" ", low)
    return set(low.encode("utf-8", "replace").translate(_PLAIN).split())


class Lexicon:
    """insult: weight of a word (UTF-8), or of a stem (ending in *)."""

    def __init__(self, insult: dict[bytes, float]):
        self.insult = insult
        self.stems = {w[:-1]: v for w, v in insult.items() if w.endswith(b"*")}
        self.lengths = sorted({len(w) for w in self.stems}, reverse=True)
        self.words = frozenset(w for w in insult if not w.endswith(b"*")) | frozenset(w.encode() for w in THREAT)
        self.symbol = {w: REPORT_ for w in REPORT} | {w: NEGATION_ for w in NEGATION} | {w: TARGET_ for w in TARGET} | {w: THREAT_ for w in THREAT} | {q: QUOTE for q in '"“”«»'}

    def weight(self, word: str) -> float:
        """The weight of a word that no fixed list holds; 0 if it is no insult."""
        raw = word.encode("utf-8", "replace")
        best = self.insult.get(raw, 0.0)
        for n in self.lengths:
            if len(raw) >= n:
                best = max(best, self.stems.get(raw[:n], 0.0))
        return best

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """(what it is, weight) of the matched clauses of a text."""
        if not text:
            return []
        low = text.lower()
        words = plain_words(low)
        if self.words.isdisjoint(words) and all(self.stems.keys().isdisjoint({w[:n] for w in words}) for n in self.lengths):
            return []
        out = []
        for clause in _CLAUSE.findall(low):
            state, most = 0, 0.0
            for word in _TOKEN.findall(clause):
                word = word.replace("’", "'")
                s = self.symbol.get(word)
                weight = THREAT_WEIGHT
                if s is None:
                    weight = self.weight(word)
                    s = INSULT if weight else OTHER
                state, s, factor = GRAMMAR[state][s]
                if s in (INSULT, DIRECTED, THREAT_):
                    most = max(most, factor * weight)
            if KINDS[state] and most:
                out.append((KINDS[state], most))
        return out


def summary(matches: list[tuple[int, float]]) -> list[float]:
    weights = [w for _, w in matches]
    return [math.log1p(sum(weights)), max(weights, default=0.0), math.log1p(len(weights)), math.log1p(sum(w for k, w in matches if k > PLAIN))]


#: Coefficients of the summary before any label is seen.
BEFORE = (0.0, 0.0, 0.0, 0.5)


class ToxicityModel:
    def __init__(self, insult: dict[bytes, float], coef: list[float], bias: float):
        self.lexicon, self.coef, self.bias = Lexicon(insult), coef, bias

    def judge(self, text: str | None) -> tuple[int, float]:
        """Number of matched clauses, score."""
        found = self.lexicon.matches(text)
        m = self.bias + sum(c * v for c, v in zip(self.coef, summary(found)))
        return len(found), 1 / (1 + math.exp(-max(-60.0, min(60.0, m))))

    def score(self, text: str | None) -> float:
        return self.judge(text)[1]


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 2.0) -> tuple[list[float], float]:
    """Logistic regression of rows that stand for n documents each, held near BEFORE, by Newton steps halved until the loss falls."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty, centre = np.array([ridge] * x.shape[1] + [0.1]), np.array([*BEFORE, 0.0])

    def loss(w):
        m = z @ w
        return float((n * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (penalty * (w - centre) ** 2).sum())

    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step, size, now = np.linalg.solve(h, z.T @ (n * (y - p)) - penalty * (w - centre)), 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    # What is more than plain never says less.
    w[3] = max(0.0, w[3])
    return w[:-1].tolist(), float(w[-1])


def candidates(text: str | None) -> set[bytes]:
    """The distinct words and stems of a text; stems end in *."""
    words = plain_words((text or "").lower())
    out = set(words)
    for n in STEMS:
        out |= {w[:n] + b"*" for w in words if len(w) >= n}
    return out


def without_idle_stems(found: dict[bytes, tuple[int, float]]) -> dict[bytes, float]:
    """Drops a stem where one longer stem or word stands for nearly all of its documents."""
    longest: dict[bytes, int] = {}
    for w, (t, _) in found.items():
        body = w.rstrip(b"*")
        for n in range(1, len(body) + (not w.endswith(b"*"))):
            longest[body[:n]] = max(longest.get(body[:n], 0), t)
    return {w: v for w, (t, v) in found.items() if not w.endswith(b"*") or longest.get(w[:-1], 0) < 0.9 * t}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled rows: docs (doc_id, text), labels (doc_id, label in 0/1)."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    picked = sample_by_class(marked, "y", sample)
    # A thinned class counts as much as it has labelled rows, so that odds do not depend on how many there are.
    labelled = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    per_row = {y: max(1.0, n / sample) for y, n in labelled.items()}
    # `picked` is bounded by the sample (two times SAMPLE ids), so it is the side to broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def counted(batches):
        for b in batches:
            toxic, clean, n = Counter(), Counter(), Counter(b["y"])
            for t, y in zip(b["text"], b["y"]):
                (toxic if y else clean).update(candidates(t))
            words = sorted(set(toxic) | set(clean))
            # The empty word carries the numbers of documents.
            yield {"word": [b""] + words, "t": [n[1]] + [toxic[w] for w in words], "c": [n[0]] + [clean[w] for w in words]}

    scratch = Scratch(docs.sparkSession, "toxicity")
    counts = stream(rows.select("text", "y"), counted, "word binary, t long, c long", 4096).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = scratch.keep(counts.where((F.col("t") >= LEAST_DOCS) | (F.length("word") == 0)), "counts")
    head = counts.agg(F.max(F.when(F.length("word") == 0, F.col("t"))), F.max(F.when(F.length("word") == 0, F.col("c"))), F.count(F.lit(1))).first()
    insult: dict[bytes, float] = {}
    if head[0] and head[1]:
        toxic_docs, clean_docs, tried = head
        # Weighted counts add up to the number of rows that were read.
        scale = (toxic_docs + clean_docs) / (toxic_docs * per_row[1] + clean_docs * per_row[0])
        t, c = F.col("t") * F.lit(scale * per_row[1]), F.col("c") * F.lit(scale * per_row[0])
        share = toxic_docs * per_row[1] * scale / (toxic_docs + clean_docs)
        own = t / (t + c)
        # Evidence: how much likelier the split of t + c documents is at the word's own rate than at the classes' shares.
        gain = t * F.log(own / share) + F.when(F.col("c") > 0, c * F.log((1 - own) / (1 - share))).otherwise(0.0)
        weight = F.log((F.col("t") + 0.5) / (toxic_docs + 1)) - F.log((F.col("c") + 0.5) / (clean_docs + 1))
        fixed = [w.encode() for w in TARGET | NEGATION | REPORT | THREAT]
        best = counts.where((F.length("word") > 0) & ~F.col("word").isin(fixed)).select("word", "t", gain.alias("gain"), weight.alias("weight"))
        best = best.where((F.col("gain") >= math.log(tried) + LEAST_EVIDENCE) & (F.col("weight") > 2.0)).orderBy(F.desc("gain"), "word").limit(LEXICON).collect()
        insult = without_idle_stems({bytes(r["word"]): (r["t"], round(r["weight"], 6)) for r in best})
    scratch.drop(counts)
    lexicon = Lexicon(insult)

    def summed(batches):
        for b in batches:
            x = [summary(lexicon.matches(t)) for t in b["text"]]
            yield {"y": b["y"], **{f"x{i}": [v[i] for v in x] for i in range(4)}}

    got = stream(rows.select("text", "y"), summed, "y int, x0 double, x1 double, x2 double, x3 double").groupBy("y", *(F.round(f"x{i}", 1).alias(f"x{i}") for i in range(4))).agg(F.count(F.lit(1)).alias("n")).collect()
    got = sorted(tuple(r) for r in got)
    if len({r[0] for r in got}) < 2:
        return ToxicityModel(insult, [1.0, 0.5, 0.0, BEFORE[3]], -3.0)
    seen = [sum(r[5] for r in got if r[0] == y) for y in (0, 1)]
    scale = sum(seen) / (seen[0] * per_row[0] + seen[1] * per_row[1])
    return ToxicityModel(insult, *logistic(np.array([r[1:5] for r in got]), np.array([float(r[0]) for r in got]), np.array([r[5] * per_row[r[0]] * scale for r in got])))


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_matches, score."""
    given = (model.lexicon.insult, model.coef, model.bias)

    def run(batches):
        m = ToxicityModel(*given)
        for rows in batches:
            judged = [m.judge(t) for t in rows[text]]
            yield {key: rows[key], "n_matches": [n for n, _ in judged], "score": [p for _, p in judged]}

    return stream(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, n_matches long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").where(doc_hash() % 3 != 1)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches")
