"""Toxicity: Levenshtein automata over a trie of learned terms, and scores of the windows around what they find."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import checkpoint, map_texts, table
from .quality import held_out

#: Words: letters and digits, with signs that stand for letters inside.
_WORD = re.compile(r"[^\W_](?:[\w*@$]*[^\W_])?")
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^“”\n]{1,300}”|„[^„“\n]{1,300}[“”]|«[^«»\n]{1,300}»|‹[^‹›\n]{1,300}›|(?<!\w)'[^'\n]{1,300}'(?!\w)")
# Words that report what others say, and words that address someone.
_REPORTS = frozenset("said says say called calls call named word words term terms quote quoted wrote meaning means sagte sagt nannte nennt wort wörter begriff dit disait appelé mot mots terme dijo dice llamó palabra palabras término".split())
_ADDRESS = frozenset("you your you're u yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
#: Words on either side that count for a window, and those before a term in which reporting words count.
WINDOW, BEFORE = 10, 4
_LEAST_STEM = 4


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a whole text."""
    return _WORD.findall((text or "").lower())


def edits_allowed(length: int) -> int:
    """Edits by which a word may miss a term of ``length`` letters."""
    return 0 if length < 4 else 1 if length < 8 else 2


@dataclass
class Term:
    """A learned term; a stem stands for all words that begin with it, without edits."""

    text: str
    stem: bool
    weight: float
    misspelt: float = 0.0


class _Node:
    __slots__ = ("children", "most", "stem", "term")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.term = self.stem = -1
        self.most = -1  # the most edits that a term below allows


class Matcher:
    """The trie of terms met with the Levenshtein automaton of a word, made deterministic as it is needed.

    A state is the set of trie nodes that the letters so far lead to, each with
    its fewest edits; nodes below which no term allows so many are left out, so
    that most words end in the empty state after a few letters. Steps taken once
    are kept, up to ``most_states`` states, and then made anew.
    """

    def __init__(self, terms: list[Term], most_states: int = 50_000, most_words: int = 200_000) -> None:
        self.terms, self.most_states, self.most_words = terms, most_states, most_words
        self.root = _Node()
        for i, t in enumerate(terms):
            node, path = self.root, [self.root]
            for letter in t.text:
                node = node.children.setdefault(letter, _Node())
                path.append(node)
            if t.stem:
                node.stem = i
            else:
                node.term = i
            for p in path:
                p.most = max(p.most, 0 if t.stem else edits_allowed(len(t.text)))
        self.letters = frozenset(letter for t in terms for letter in t.text)
        self.clear()

    def clear(self) -> None:
        self.steps: list[dict[str, int]] = []
        self.states: list[tuple[tuple[_Node, int], ...]] = []
        self.numbers: dict[frozenset, int] = {}
        self.known: dict[str, tuple[int, int] | None] = {}
        self.first = self._number({self.root: 0})

    def _number(self, nodes: dict[_Node, int]) -> int:
        # a letter of a term may be missing
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in node.children.values():
                if e < nodes.get(child, 9) - 1 and e + 1 <= child.most:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset((id(n), e) for n, e in nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(tuple(nodes.items()))
            self.steps.append({})
        return self.numbers[key]

    def _next(self, state: int, letter: str) -> int:
        nodes: dict[_Node, int] = {}
        for node, e in self.states[state]:
            child = node.children.get(letter)
            if child is not None and e <= child.most and e < nodes.get(child, 9):
                nodes[child] = e
            if e + 1 <= node.most:
                if e + 1 < nodes.get(node, 9):
                    nodes[node] = e + 1  # a letter too many
                for other in node.children.values():
                    if other is not child and e + 1 <= other.most and e + 1 < nodes.get(other, 9):
                        nodes[other] = e + 1  # another letter
        self.steps[state][letter] = n = self._number(nodes)
        return n

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term of a word: fewest edits, then highest weight, then first; stems at no edits only."""
        try:
            return self.known[word]
        except KeyError:
            pass
        if len(self.states) > self.most_states or len(self.known) > self.most_words:
            self.clear()
        state, stem = self.first, None
        node = self.root
        for letter in word:
            if node is not None:
                node = node.children.get(letter)
                if node is not None and node.stem >= 0:
                    stem = node.stem
            step = self.steps[state].get(letter if letter in self.letters else "")
            state = self._next(state, letter if letter in self.letters else "") if step is None else step
            if not self.states[state]:
                break
        found = [(e, -self.terms[n.term].weight, n.term) for n, e in self.states[state] if n.term >= 0 and e <= edits_allowed(len(self.terms[n.term].text))]
        if stem is not None:
            found.append((0, -self.terms[stem].weight, stem))
        best = min(found, default=None)
        self.known[word] = out = None if best is None else (best[2], best[0])
        return out


def best_window(text: str | None, matcher: Matcher) -> float:
    """The score of the window that scores most; 0 without a term.

    A term counts by its weight: a quarter of it within quotation marks, half
    after a reporting word, and more where someone is addressed nearby. A window
    adds up half of what other terms within ``WINDOW`` words count, to a limit.
    """
    words = words_of(text)
    hits = {w: m for w in set(words) if (m := matcher.match(w)) is not None}
    if not hits:
        return 0.0
    lower = text.lower()
    quotes = [m.span() for m in _QUOTED.finditer(lower)]
    starts = [m.start() for m in _WORD.finditer(lower)] if quotes else []
    at = [i for i, w in enumerate(words) if w in hits]
    ends = np.array([b for _, b in quotes])
    score = np.zeros(len(at))
    for j, i in enumerate(at):
        term, edits = hits[words[i]]
        t = matcher.terms[term]
        s = t.weight if not edits else t.misspelt
        if quotes:
            q = int(np.searchsorted(ends, starts[i], side="right"))
            s *= 0.25 if q < len(quotes) and quotes[q][0] <= starts[i] else 1
        if not _REPORTS.isdisjoint(words[max(0, i - BEFORE) : i]):
            s *= 0.5
        elif not _ADDRESS.isdisjoint(words[max(0, i - BEFORE) : i + BEFORE + 1]):
            s *= 1.25
        score[j] = s
    place = np.array(at)
    sums = np.concatenate(([0], np.cumsum(score)))
    near = sums[np.searchsorted(place, place + WINDOW, side="right")] - sums[np.searchsorted(place, place - WINDOW)] - score
    return float((score + np.minimum(near / 2, score)).max())


@dataclass
class Model:
    """Terms, and how the score of a text's best window becomes a probability."""

    terms: list[Term]
    slope: float
    constant: float
    matcher: Matcher | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "slope": self.slope, "constant": self.constant, "matcher": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        self.matcher = self.matcher or Matcher(self.terms)
        x = np.array([best_window(t, self.matcher) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(x * self.slope + self.constant, -50, 50)))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Weights of largest likelihood less ``strength`` times their squared distance from ``prior``; the last is the constant."""
    z = np.column_stack((x, np.ones(len(x))))
    w = prior.astype(float).copy()
    keep = np.full(len(w), strength)
    keep[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - keep * (w - prior)
        change = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), gradient)
        w += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-9:
            break
    return w


# ------------------------------------------------------------------ learning


def _odds(a: float, b: float, n1: int, n0: int, doubt: float = 1.0) -> float:
    """Log odds that a toxic text holds a term rather than another one, less ``doubt`` standard errors."""
    odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    return odds - doubt * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def toxic_words(sample: DataFrame, *, most: int) -> list[tuple[str, int]]:
    """Words of toxic texts in the sample, and in how many different places they stand there: one a text, copies of a passage once."""

    def work(x: dict[str, list]) -> dict[str, object]:
        out, place = [], []
        for text in x["text"]:
            words = words_of(text)
            seen = {}
            for i, w in enumerate(words):
                if w not in seen:
                    seen[w] = " ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])
            out += seen
            place += seen.values()
        return {"word": out, "place": place}

    pairs = map_texts(sample.where("label = 1"), ["text"], "word string, place string", work)
    counts = pairs.groupBy("word", F.xxhash64("place").alias("p")).agg(F.lit(1).alias("one")).groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("a"))
    return [(r["word"], r["a"]) for r in counts.orderBy(F.col("a").desc(), "word").limit(most).collect()]


def text_counts(sample: DataFrame, forms: dict[str, int]) -> tuple[Counter, Counter]:
    """In how many clean, and how many toxic, texts of the sample a word stands (``w``), or one that begins with a stem (``w*``)."""
    lengths = sorted({len(f) - 1 for f in forms if f.endswith("*")})

    def work(x: dict[str, list]) -> dict[str, object]:
        counts: Counter = Counter()
        known: dict[str, tuple[str, ...]] = {}
        for label, text in zip(x["label"], x["text"], strict=True):
            seen: set[str] = set()
            for w in set(words_of(text)):
                if w not in known:
                    known[w] = tuple(f for f in (w, *(f"{w[:n]}*" for n in lengths if n <= len(w))) if f in forms)
                seen.update(known[w])
            counts.update((label, f) for f in seen)
        return {"label": [k[0] for k in counts], "form": [k[1] for k in counts], "n": list(counts.values())}

    rows = map_texts(sample, ["label", "text"], "label int, form string, n long", work).groupBy("label", "form").agg(F.sum("n").alias("n")).collect()
    clean, toxic = (Counter({r["form"]: r["n"] for r in rows if r["label"] == label}) for label in (0, 1))
    return clean, toxic


def choose_terms(words: list[tuple[str, int]], counts: tuple[Counter, Counter], n1: int, n0: int, *, terms: int, least_odds: float = 2.0) -> list[Term]:
    """The lexicon: each word by itself or by one of its stems, whichever is surer, and of these the surest ``terms``.

    A stem needs three words and eight places. Of equally sure stems the longest
    is taken, so that no more words begin with it than must.
    """
    clean, toxic = counts
    by_stem: dict[str, list[int]] = {}
    for w, a in words:
        for m in range(_LEAST_STEM, len(w) + 1):
            by_stem.setdefault(w[:m], []).append(a)
    sure = {s: _odds(min(sum(c), toxic[f"{s}*"]), clean[f"{s}*"], n1, n0) for s, c in by_stem.items() if len(c) >= 3 and sum(c) >= 8}
    alone = {w: _odds(a, clean[w], n1, n0) if a >= 3 else -math.inf for w, a in words}
    chosen: dict[str, list[str]] = {}
    for w, own in alone.items():
        best = max(((sure[w[:m]], m) for m in range(_LEAST_STEM, len(w) + 1) if w[:m] in sure), default=(-math.inf, 0))
        if best[0] > own:
            chosen.setdefault(w[: best[1]], []).append(w)
    stems = {s for s, members in chosen.items() if len(members) >= 3 and sure[s] >= least_odds}
    single = [w for w, own in alone.items() if own >= least_odds and not any(w[:m] in stems for m in range(_LEAST_STEM, len(w) + 1))]
    found = [*(Term(s, True, sure[s]) for s in stems), *(Term(w, False, alone[w]) for w in single)]
    return sorted(found, key=lambda t: (-t.weight, t.text))[:terms]


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_rows: int = 20_000, most_words: int = 50_000, terms: int = 400, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn terms, how far their misspellings can be trusted, and the windows' weights.

    All from at most ``max_rows`` labelled rows outside the held-out part (those
    with the smallest hashes of ids), whose texts are written once to the
    checkpoint folder. ``most_words`` words of toxic texts at most are considered
    and ``terms`` kept. An id labelled twice counts once, with its largest label;
    of several texts of one id the first in order counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")  # max_rows bounds it
    sample = checkpoint(sample.groupBy("_id", "label").agg(F.min("text").alias("text")).select("label", "text"))
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    base = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else 0.0
    if not n1 or not n0:
        return Model([], 0.0, base)
    words = toxic_words(sample, most=most_words)
    forms = {w: a for w, a in words if a >= 2}
    totals: dict[str, list[int]] = {}
    for w, a in words:
        for m in range(_LEAST_STEM, len(w) + 1):
            totals.setdefault(f"{w[:m]}*", []).append(a)
    forms |= {s: sum(c) for s, c in totals.items() if len(c) >= 3 and sum(c) >= 8}
    found = choose_terms(words, text_counts(sample, forms), n1, n0, terms=terms)
    trusted = misspelt_terms(sample, found, n1, n0)
    model = Model(trusted, 1.0, 0.0)

    def work(x: dict[str, list]) -> dict[str, object]:
        matcher = model.matcher = model.matcher or Matcher(model.terms)
        return {"label": x["label"], "x": [best_window(t, matcher) for t in x["text"]]}

    rows = map_texts(sample, ["label", "text"], "label int, x double", work).groupBy("label", "x").agg(F.count(F.lit(1)).alias("n")).collect()  # max_rows at most
    rows = sorted((r["label"], r["x"], r["n"]) for r in rows)
    many = np.repeat(np.arange(len(rows)), [r[2] for r in rows])
    slope, constant = fit_logistic(np.array([r[1] for r in rows])[many, None], np.array([r[0] for r in rows], float)[many], np.array([1.0, min(base, 0.0) - 1.0]))
    return Model(trusted, float(slope), float(constant))


def misspelt_terms(sample: DataFrame, terms: list[Term], n1: int, n0: int) -> list[Term]:
    """The terms with a weight for their misspellings, by the toxic and clean texts that hold such words and not the term itself.

    Where no clean text of the sample does, they count nearly as the term; else
    by their own odds, so that a term near an everyday word has no misspellings.
    """
    model = Model(terms, 1.0, 0.0)

    def work(x: dict[str, list]) -> dict[str, object]:
        matcher = model.matcher = model.matcher or Matcher(model.terms)
        counts: Counter = Counter()
        for label, text in zip(x["label"], x["text"], strict=True):
            met = {m for w in set(words_of(text)) if (m := matcher.match(w)) is not None}
            counts.update((label, t) for t in {t for t, e in met if e and (t, 0) not in met})
        return {"label": [k[0] for k in counts], "term": [k[1] for k in counts], "n": list(counts.values())}

    rows = map_texts(sample, ["label", "text"], "label int, term int, n long", work).groupBy("label", "term").agg(F.sum("n").alias("n")).collect()
    n = {(r["label"], r["term"]): r["n"] for r in rows}
    out = []
    for i, t in enumerate(terms):
        toxic, clean, most = n.get((1, i), 0), n.get((0, i), 0), 0.9 * t.weight
        odds = math.log((toxic + 1) / (n1 + 2)) - math.log((clean + 0.25) / (n0 + 2)) - 0.5
        out.append(Term(t.text, t.stem, t.weight, min(most, max(0.0, odds)) if clean else most))
    return out


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and prediction for every whole text."""

    def work(x: dict[str, list]) -> dict[str, object]:
        s = model.scores(x["_text"])
        return {"doc_id": x["_id"], "held_out": x["_held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held_out"), F.col(text_col).alias("_text"))
    return map_texts(rows, ["_id", "_held_out", "_text"], "doc_id long, held_out boolean, score double, predicted int", work)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """Learn from labelled documents, then score all documents.

    Only a text's words enter its score. A null or empty text holds no term and
    gets that score; a null id stays null and is not held out; repeated rows are
    scored each; with labels of one kind or none every text has one score, of
    their share. An empty table gives no rows. Other columns are not read.
    """
    return score(docs, train(docs, labels, max_rows=max_rows), threshold=threshold)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
