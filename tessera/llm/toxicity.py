"""Toxicity scores from a learned lexicon, misspellings included.

A bounded sample of labelled rows gives the lexicon: whole words, and stems that many words share, which stand in
toxic texts far more often than in clean ones.  The lexicon's trie is intersected with the automaton of one edit
(insertion, deletion, substitution or swap of neighbours) and made deterministic, so one table walk a character finds
exact and misspelled terms of any number of words at once, whole words and stems alike, the first letter included.  A
likeness that clean texts of the sample use at least as often as toxic ones is no hit, and a term with several such
likenesses, more than it has others, is looked for as it is: evidence decides, not length.  Texts with hits are read
again with the words around each hit: hits inside quotation marks, or near words of reporting, count apart from plain
abuse.  A logistic model over these counts, fitted on the same sample with prior weights, gives the score.

Null and empty texts get the score of a text without hits.  Repeated labels of a document count once (toxic wins);
repeated rows are scored as rows of their own.  Very long texts are read whole, a window of words at a time.  A word
that is like several terms is exact if any is; an empty table gives no rows.  Kept columns may have any names; one with
the name of an output column gives way to it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ChunkTable, durable, scored, text_bytes

WORD = re.compile(r"[^\W_]+")
WORD_OR_END = re.compile(r"[^\W_]+|\n")
LETTERS = re.compile(r"[^\W\d_]{4,}")
#: Quotation marks, and words that report what somebody else said.
OPEN, CLOSE = "\"“«„‘‹", "\"”»“’›"
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word term insult slur reported dit dijo sagte".split())
WINDOW = 8
EXACT, FUZZY = 1, 2
APART = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII that no word holds
PREFIXES = range(4, 8)
MANY_FORMS = 3
#: Prior weights of exact, misspelled, quoted exact and quoted misspelled hits, each as log(1 + n).
PRIOR = np.array([6.0, 2.0, 2.0, 0.7])


@dataclass
class Lexicon:
    """Terms (a trailing $ marks whole words, others are stems) and the deterministic automaton that finds them.

    Terms in `exact_only` are found as they are, all others with one edit anywhere too, the first letter included.
    Whether a term is found in a word does not depend on the other terms.
    """

    terms: list[str]
    exact_only: frozenset[str] = frozenset()
    symbols: dict[str, int] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.int32))
    found: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))  # 4 * term + kind at a word's end

    def __post_init__(self) -> None:
        trie: list[dict[str, int]] = [{}]
        whole: dict[int, int] = {}
        stem: dict[int, int] = {}
        fuzzy = set()  # nodes on the way to a term that may be misspelled
        for k, term in enumerate(self.terms):
            node, path = 0, [0]
            for c in term.removesuffix("$"):
                node = trie[node].setdefault(c, len(trie))
                if node == len(trie):
                    trie.append({})
                path.append(node)
            (whole if term.endswith("$") else stem)[node] = k
            if term not in self.exact_only:
                fuzzy.update(path)
        self.symbols = {c: i + 1 for i, c in enumerate(sorted({c for t in self.terms for c in t} - {"$"}))}
        wild = [*self.symbols, ""]
        misspelled = [t not in self.exact_only for t in self.terms]

        # A state is a set of (node, edits, awaited): awaited is the letter that completes a swap.  Node -1 stands for
        # a stem that was read, with 4 * term + kind in place of edits: whatever follows, it stays found.
        def closed(states: set) -> frozenset:
            out = set()
            for node, edits, awaited in states:
                out.add((node, edits, awaited))
                if node >= 0 and edits == 0 and not awaited:  # a letter of the term is missing
                    out.update((n, 1, "") for n in trie[node].values() if n in fuzzy)
            for node, edits, awaited in list(out):
                if node in stem and not awaited and (edits == 0 or misspelled[stem[node]]):
                    out.add((-1, 4 * stem[node] + (FUZZY if edits else EXACT), ""))
            stems = [e for n, e, _ in out if n == -1]
            if exact := [e for e in stems if e & 3 == EXACT]:
                return frozenset({(-1, min(exact), "")})
            out = {s for s in out if s[0] >= 0 and (s[1] == 0 or s[2] or (s[0], 0, "") not in out)}
            return frozenset(out | ({(-1, min(stems), "")} if stems else set()))

        def after(states: frozenset, c: str) -> frozenset:
            out = set()
            for node, edits, awaited in states:
                if node == -1:
                    out.add((node, edits, awaited))
                elif awaited:
                    if c == awaited:
                        out.add((node, edits, ""))
                else:
                    if c in trie[node]:
                        out.add((trie[node][c], edits, ""))
                    if edits == 0 and node in fuzzy:
                        out.add((node, 1, ""))  # a letter too many
                        for x, n in trie[node].items():
                            if n in fuzzy and x != c:
                                out.add((n, 1, ""))  # another letter
                                if c in trie[n] and trie[n][c] in fuzzy:
                                    out.add((trie[n][c], 1, x))  # swapped
            return closed(out)

        def hit(states: frozenset) -> int:
            ends = [(n, e) for n, e, awaited in states if n in whole and not awaited]
            best = [4 * whole[n] + EXACT for n, e in ends if not e] or [e for n, e, _ in states if n == -1 and e & 3 == EXACT]
            best = best or [4 * whole[n] + FUZZY for n, e in ends if misspelled[whole[n]]] or [e for n, e, _ in states if n == -1]
            return min(best, default=0)

        start = closed({(0, 0, "")})
        number, todo, rows = {frozenset(): 0, start: 1}, deque([start]), [[0] * (len(wild))]
        while todo:
            s = todo.popleft()
            row = []
            for c in wild:
                t = after(s, c)
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
                row.append(number[t])
            rows.append(row)
        self.moves = np.array([[r[-1], *r[:-1]] for r in rows], np.int32)  # column 0: any other character
        self.found = np.array([hit(s) for s in number], np.int32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """For each word 0, or 4 * term + EXACT or FUZZY."""
        out = np.zeros(len(words), np.int32)
        if not words or not self.terms:
            return out
        text = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        of = np.zeros(max(map(ord, self.symbols)) + 2, np.int32)
        for c, i in self.symbols.items():
            of[ord(c)] = i
        text = of[np.minimum(text, len(of) - 1)]
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        state, live, at = np.ones(len(words), np.int32), np.arange(len(words)), 0
        while len(live):
            live = live[length[live] > at]
            state[live] = self.moves[state[live], text[start[live] + at]]
            live = live[state[live] > 0]
            at += 1
        return self.found[state]


@dataclass
class Model:
    lexicon: Lexicon
    ignored: frozenset[str]  # likenesses of terms that clean texts use
    weights: np.ndarray  # of the features
    bias: float

    def hits(self, chunks: list[bytes]) -> list[bytes]:
        """One byte group for every chunk that has a hit, for ChunkTable."""
        words = WORD_OR_END.findall(b"\n".join(chunks).decode("utf-8", "replace").lower())
        known = list(set(words) - {"\n"})
        mark = {w: h for w, h in zip(known, self.lexicon.look_up(known).tolist(), strict=True) if h and w not in self.ignored}
        out, row = [b""] * len(chunks), 0
        for w in words:
            if w == "\n":
                row += 1
            elif w in mark:
                out[row] += b"\1\0\0\0"
        return out

    def features(self, text: str) -> np.ndarray:
        """log(1 + n) of plain and quoted, exact and misspelled hits."""
        text = text.lower()
        n = np.zeros(4)
        spans: list[tuple[str, int, int]] = []
        seen = 0  # of spans, whose hits are counted
        for more in chain(batched(((m.group(), m.start(), m.end()) for m in WORD.finditer(text)), 10_000), [()]):
            spans += more
            ready = len(spans) - WINDOW if more else len(spans)  # hits whose window is there
            kinds = self.lexicon.look_up([w for w, _, _ in spans[seen : max(seen, ready)]])
            for k in np.flatnonzero(kinds).tolist():
                word, start, end = spans[i := seen + k]
                if word in self.ignored:
                    continue
                around = spans[max(0, i - WINDOW) : i + WINDOW + 1]
                before, behind = text[around[0][1] : start], text[end : around[-1][2] + 1]
                marks = sum(before.count(c) for c in OPEN) % 2 == 1 and any(c in behind for c in CLOSE)
                quoted = marks or any(w in REPORTING for w, _, _ in around)
                n[2 * quoted + (int(kinds[k]) & 3) - 1] += 1
            seen = max(seen, ready)
            spans, seen = spans[max(0, seen - WINDOW) :], min(seen, WINDOW)
        return np.log1p(n)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + features @ self.weights)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method for weighted logistic regression whose weights are drawn to PRIOR."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(PRIOR, -4.0)
    strength = np.append(np.full(len(PRIOR), 1.0), 0.05)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + strength * (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(strength), gradient)
        w -= step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    w[:-1] = np.maximum(w[:-1], 0)  # a hit never speaks for a text
    return w[:-1], float(w[-1])


def _terms(text: str) -> set[str]:
    """Whole words (with a trailing $) and prefixes of the words of a text."""
    words = set(LETTERS.findall(text.lower()))
    return {w + "$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


def _choose(docs: DataFrame, labels: DataFrame, usable: Column, most: dict[int, int]) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """Texts (stored) of about most[y] usable labelled rows with toxic = y, the share taken and the number taken."""
    rows = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, most[y] / counted.get(y, 1)) for y in most}
    rate = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    ids = rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    texts = durable(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic")), "labelled")  # bounded by `most`
    return texts, share, {y: round(counted.get(y, 0) * share[y]) for y in most}


def train(docs: DataFrame, labels: DataFrame, usable: Column, most_toxic: int = 3000, most_clean: int = 6000) -> Model:
    """Lexicon and weights from a hash-chosen sample of at most about most_toxic + most_clean labelled rows."""
    texts, share, taken = _choose(docs, labels, usable, {0: most_clean, 1: most_toxic})

    def toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in map(pa.StringScalar.as_py, b.column(0)):
                words = LETTERS.findall((text or "").lower())
                look = min((zlib.crc32(w.encode()) for w in words), default=0)  # near copies mostly agree on it
                found = sorted(_terms(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([look] * len(found), pa.int64())], ["term", "look"])

    toxic = texts.where("toxic = 1").select("text").mapInArrow(toxic_terms, "term string, look long")
    least = max(4, round(0.004 * taken[1]))
    support = {r["term"]: r["n"] for r in toxic.groupBy("term", "look").count().groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}

    def clean_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for text in map(pa.StringScalar.as_py, b.column(0)):
                n.update(_terms(text or "") & support.keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    clean = texts.where("toxic = 0").select("text").mapInArrow(clean_terms, "term string, n long")
    against = {r["term"]: r["n"] for r in clean.groupBy("term").agg(F.sum("n").alias("n")).collect()} if support else {}
    strong = {
        t: n for t, n in support.items()
        if (n + 0.5) / (taken[1] + 1) >= 20 * (against.get(t, 0) + 0.5) / (taken[0] + 1) and against.get(t, 0) <= max(1, 0.1 * n)
    }
    lexicon = Lexicon(specific(strong))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, likeness, term = [], [], []
            for text, y in zip(map(pa.StringScalar.as_py, b.column(0)), b.column(1).to_pylist(), strict=True):
                words = list(set(WORD.findall((text or "").lower())))
                fuzzy = [(w, h >> 2) for w, h in zip(words, lexicon.look_up(words).tolist(), strict=True) if h & 3 == FUZZY]
                likeness += [w for w, _ in fuzzy]
                term += [k for _, k in fuzzy]
                toxic += [y] * len(fuzzy)
            yield pa.RecordBatch.from_arrays([pa.array(likeness, pa.string()), pa.array(term, pa.int64()), pa.array(toxic, pa.int64())], ["word", "term", "toxic"])

    seen = texts.mapInArrow(hits, "word string, term long, toxic long")
    words = seen.groupBy("word").agg(F.first("term").alias("term"), F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    ignored = {r["word"] for r in words if r["n"] - r["bad"] >= 1 and r["bad"] <= r["n"] - r["bad"]}
    # a term that has more different likenesses in clean texts than in toxic ones is looked for as it is
    clean_forms, toxic_forms = (Counter(r["term"] for r in words if (r["word"] in ignored) == c) for c in (True, False))
    common = {lexicon.terms[k] for k, n in clean_forms.items() if n >= MANY_FORMS and n > toxic_forms[k]}
    model = Model(Lexicon(lexicon.terms, frozenset(common)), frozenset(ignored), PRIOR, 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([model.features(t.as_py() or "") for t in b.column(0)]).reshape(-1, len(PRIOR))
            arrays = [b.column(1), *(pa.array(c, pa.float64()) for c in x.T)]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", *(f"x{i}" for i in range(len(PRIOR)))])

    schema = "toxic long, " + ", ".join(f"x{i} double" for i in range(len(PRIOR)))
    like = texts.mapInArrow(features, schema)
    rows = like.groupBy(*like.columns).count().collect()  # texts with the same counts are one row
    x = np.array([[r[f"x{i}"] for i in range(len(PRIOR))] for r in rows]).reshape(-1, len(PRIOR))
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.array([r["count"] / share[int(r["toxic"])] for r in rows], float)
    model.weights, model.bias = fit(x, y, weight)
    return model


def specific(strong: dict[str, int]) -> list[str]:
    """Of terms that extend one another the longest that still has almost all texts of the shorter one.

    Whole words stay beside a shorter stem, since a misspelled end is theirs and not the stem's.
    """
    ordered = sorted(strong, key=lambda t: (len(t), t))
    kept: list[str] = []
    dropped: set[str] = set()
    longer: dict[str, list[str]] = {}
    for t in ordered:
        for n in PREFIXES:
            if len(t.removesuffix("$")) >= n and t[:n] != t:
                longer.setdefault(t[:n], []).append(t)
    for t in ordered:
        if t in dropped:
            continue
        if any(strong[x] >= 0.9 * strong[t] for x in longer.get(t, [])):
            continue  # a longer one says the same
        kept.append(t)
        dropped.update(longer.get(t, []))
    return sorted({*kept, *(t for t in dropped if t.endswith("$"))})


def score_documents(docs: DataFrame, model: Model, *keep: str, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of `keep`, with score and predicted.  Only the text takes part in a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the lexicon

    def judge() -> Callable[[pa.Array], list]:
        m = shared.value
        table = ChunkTable(m.hits, APART, 16 << 20)
        empty = float(m.score(np.zeros(len(PRIOR))))

        def of(texts: pa.Array) -> list:
            scores = [empty] * len(texts)
            for i, found in enumerate(table.joined(text_bytes(texts))):
                if found:
                    scores[i] = float(m.score(m.features(texts[i].as_py())))
            return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]

        return of

    return scored(docs, keep, text_column, "score double, predicted int", judge)
