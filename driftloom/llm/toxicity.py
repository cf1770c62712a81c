"""Toxicity by a learned lexicon, found through Levenshtein automata over its trie.

Training learns terms (words, and stems that many words share) whose contexts lie
in documents labelled toxic and hardly in others.  Scoring walks the trie of the
terms with the Levenshtein automaton of each word, so misspelled terms count too;
a window around each hit tells quotation and mention from abuse, and a logistic
curve fitted on the training rows turns the summed evidence into a score.

Cost: a word is looked up once in a batch; the automaton runs only on words that
share an unchanged half with some term (one edit leaves one half whole).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled rows that the model is fitted on, at most about so many (hash sample).
MAX_TRAINING_ROWS = 12_000
MIN_CONTEXTS, MIN_STEM_CONTEXTS, MIN_STEM_WORDS = 3, 5, 3
#: A term is in so many toxic documents that a word without meaning would be in none but these with this chance.
CHANCE = 1e-5
#: A term's share of the clean documents is at most so much of its share of the toxic ones.
CLEAN_SHARE = 0.02
STEM_LENGTHS = range(4, 8)
FUZZY_LENGTH = 5
WINDOW = 6
#: What a hit counts for in quotation marks, or near words that mention rather than use.
QUOTED, MENTIONED, FUZZY = 0.15, 0.4, 0.6

WORD = re.compile(r"[^\W_](?:[\w@$!]*[^\W_])?")
#: Signs that stand for letters.
FOLD = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Words that report or discuss another's words.
MENTION_WORDS = frozenset("said says called quote quoted quotes word words term wrote writes slur insult sagte nannte zitat wort dit cité citation mot dijo llamó cita palabra".split())
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Trie:
    """Nested dictionaries; the key ``""`` holds the term that ends at a node."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term

    def within_one(self, word: str) -> str | None:
        """A term at Levenshtein distance 1 at most, the closest and then least one.

        The automaton's states are (characters of ``word`` read, edits); each step
        down the trie advances the whole set of states, and a branch ends where no
        state is left.
        """
        n, best = len(word), None

        def closure(states: set[tuple[int, int]]) -> set[tuple[int, int]]:
            return states | {(i + 1, 1) for i, e in states if e == 0 and i < n}

        stack = [(self.root, closure({(0, 0)}))]
        while stack:
            node, states = stack.pop()
            term = node.get("")
            if term is not None:
                edits = min((e for i, e in states if i == n), default=2)
                if edits < 2 and (best is None or (edits, term) < best):
                    best = (edits, term)
            for ch, child in node.items():
                if ch == "":
                    continue
                after = set()
                for i, e in states:
                    if i < n and word[i] == ch:
                        after.add((i + 1, e))
                    if e == 0:
                        after.add((i, 1))  # ch is missing from the word
                        if i < n:
                            after.add((i + 1, 1))  # another letter in its place
                if after:
                    stack.append((child, closure(after)))
        return best[1] if best else None


@dataclass
class Model:
    """Terms with weights, words that look like terms but are clean, and the curve."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    slope: float = 0.0
    bias: float = -20.0

    def __post_init__(self) -> None:
        fuzzy = [t for t in self.terms if len(t) >= FUZZY_LENGTH]
        self.trie = Trie(sorted(fuzzy))
        self.heads = {t[:len(t) // 2] for t in fuzzy}
        self.tails = {t[len(t) // 2:] for t in fuzzy}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.seen: dict[str, tuple[float, bool]] = {}

    def near(self, word: str) -> str | None:
        """The term that ``word`` misspells by one edit."""
        if len(word) < FUZZY_LENGTH - 1 or not (
            any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)
        ):
            return None
        return self.trie.within_one(word)

    def weigh(self, word: str) -> float:
        """Evidence of one word by itself; 0 for most."""
        found = self.terms.get(word)
        if found:
            return found
        for k in STEM_LENGTHS:
            stem = self.stems.get(word[:k]) if len(word) >= k else None
            if stem:
                return stem
        folded = word.translate(FOLD)
        if folded != word and folded in self.terms:
            return FUZZY * self.terms[folded]
        if word in self.clean:
            return 0.0
        term = self.near(folded)
        return FUZZY * self.terms[term] if term else 0.0

    def evidence(self, text: str | None) -> float:
        """Summed evidence of a whole text, by context."""
        lowered = (text or "").lower()
        tokens = WORD.findall(lowered)
        if len(self.seen) > 400_000:
            self.seen.clear()
        seen, hits = self.seen, {}
        for w in set(tokens):
            v = seen.get(w)
            if v is None:
                v = seen[w] = self.weigh(w)
            if v:
                hits[w] = v
        if not hits:
            return 0.0
        total, spans = 0.0, list(WORD.finditer(lowered))
        for i, w in enumerate(tokens):
            if w not in hits:
                continue
            lo, hi = max(0, i - WINDOW), min(len(tokens) - 1, i + WINDOW)
            total += hits[w] * _context(lowered[spans[lo].start():spans[i].start()], lowered[spans[i].end():spans[hi].end() + 1], tokens[lo:i] + tokens[i + 1:hi + 1])
        return total

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(evidence)))))


def _context(before: str, after: str, around: list[str]) -> float:
    """1 for abuse, less inside quotation marks or beside mentioning words."""
    opened = max(before.rfind(c) for c in OPENING)
    closed = max((before.rfind(c) for c in CLOSING if c not in OPENING), default=-1)
    inside = opened > closed and not (before[opened] == '"' and before.count('"') % 2 == 0)
    if inside and any(c in after for c in CLOSING):
        return QUOTED
    return MENTIONED if MENTION_WORDS.intersection(around) else 1.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows outside the held-out fold, a hash sample of at most about ``limit``.

    Several labels of a document count as its greatest; null labels don't count.
    """
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = known.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * limit / n))
    # at most about ``limit`` rows of 12 bytes: the size bound that permits the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of toxic texts with hashes of their context, form and document; terms of clean texts with a count of documents."""
    import xxhash

    names, types = ["term", "stem", "context", "form", "doc", "clean"], (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    for batch in batches:
        toxic: dict[tuple, None] = {}
        clean: Counter[tuple[str, bool]] = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = words_of(text)
            if label:
                doc = xxhash.xxh64_intdigest(text or "") >> 1
                for a, w, b in zip(["", *tokens], tokens, [*tokens[1:], ""]):  # noqa: B905
                    at, form = xxhash.xxh64_intdigest(f"{a} {b}") >> 1, xxhash.xxh64_intdigest(w) >> 1
                    toxic[(w, False, at, form, doc)] = None
                    for k in STEM_LENGTHS:
                        if len(w) > k:
                            toxic[(w[:k], True, at, form, doc)] = None
            else:
                forms = set(tokens)
                clean.update((w, False) for w in forms)
                clean.update({(w[:k], True) for w in forms for k in STEM_LENGTHS if len(w) > k})
            if len(toxic) > 50_000:
                yield rows([(*k, 0) for k in toxic])
                toxic.clear()
            if len(clean) > 200_000:
                yield rows([(w, s, None, None, None, n) for (w, s), n in clean.items()])
                clean.clear()
        if toxic or clean:
            yield rows([(*k, 0) for k in toxic] + [(w, s, None, None, None, n) for (w, s), n in clean.items()])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> Model:
    """Learns terms, look-alikes and the curve.  All terms that pass come to the driver: they are bounded by the training rows.

    Without toxic or without clean training rows the model knows no term and every score is near 0.
    """
    tables = Scratch(docs.sparkSession, "toxicity")
    rows = tables.keep(training_rows(docs, labels, limit), "train")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sum(n for k, n in counts.items() if k), sum(n for k, n in counts.items() if not k)
    if not n_toxic or not n_clean:
        return Model()
    raw = tables.keep(rows.select("text", F.col("toxic").cast("boolean").alias("toxic")).mapInArrow(_term_rows, "term string, stem boolean, context long, form long, doc long, clean long"), "terms")
    rate = CLEAN_SHARE * n_clean / n_toxic
    # plain sums first: only terms that can still pass get distinct counts
    sums = raw.groupBy("term", "stem").agg(F.count("context").alias("rows"), F.sum("clean").alias("clean"))
    sums = sums.filter((F.col("rows") >= MIN_CONTEXTS) & (F.length("term") >= 3) & (F.col("clean") <= F.col("rows") * rate)).drop("rows")
    distinct = lambda c: F.count_distinct(c).alias(f"{c}s")
    terms = raw.filter("context is not null").join(sums.withColumnRenamed("clean", "in_clean"), ["term", "stem"]).groupBy("term", "stem").agg(distinct("context"), distinct("form"), distinct("doc"), F.max("in_clean").alias("clean"))
    least_docs = max(MIN_CONTEXTS, math.ceil(math.log(CHANCE) / math.log(n_toxic / (n_toxic + n_clean))))
    enough = F.when(F.col("stem"), (F.col("contexts") >= MIN_STEM_CONTEXTS) & (F.col("forms") >= MIN_STEM_WORDS)).otherwise(F.col("contexts") >= MIN_CONTEXTS)
    # copies of a document share their contexts, and one document can hold many: both must be several
    kept = terms.filter(enough & (F.col("docs") >= least_docs) & (F.col("clean") <= F.col("docs") * rate)).orderBy("stem", "term").collect()
    weight = lambda r: math.log((r["docs"] + 0.5) / n_toxic) - math.log((r["clean"] + 0.5) / n_clean)
    words = {r["term"]: max(0.1, weight(r)) for r in kept if not r["stem"]}
    stems = {r["term"]: max(0.1, weight(r)) for r in kept if r["stem"]}
    model = Model(words, stems)

    # clean words that one edit turns into a term, learned on one half of the rows and proven on the other
    def look_alikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for text in batch.column(0).to_pylist() for w in set(words_of(text)) if w not in model.terms and model.near(w.translate(FOLD))}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0
    clean = rows.filter("toxic = 0").filter(half).select("text").mapInArrow(look_alikes, "word string").distinct().collect()
    model = Model(words, stems, frozenset(r["word"] for r in clean))
    held = rows.filter(~half).select("text", "toxic").mapInArrow(_evidence_rows(model), "evidence double, toxic int").toPandas()
    model.bias, model.slope = logistic(np.log1p(held["evidence"].to_numpy(float)), held["toxic"].to_numpy(float))
    tables.clear()
    return model


def _evidence_rows(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["evidence", "toxic"])

    return work


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """(bias, slope) by damped Newton steps; the slope is 0 at least."""
    if not len(x):
        return -20.0, 0.0
    a, w = np.column_stack([np.ones(len(x)), x]), np.array([-2.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad, hess = a.T @ (p - y) + ridge * w, (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(max(0.0, w[1]))


SCORE_SCHEMA = "doc_id long, evidence double, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, evidence, score and predicted of every whole text; null and empty texts have no evidence.

    One pass without exchange; the model goes along with the task, its size is
    bounded by the training sample.  Repeated rows are scored each for itself, other
    columns play no part, an empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.evidence(t) for t in batch.column(1).to_pylist()]
            scores = [model.score(e) for e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "evidence", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(work, SCORE_SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they were."""
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(model.evidence(t)) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, schema)
