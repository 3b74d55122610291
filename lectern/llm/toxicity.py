"""Toxicity by a weighted grammar of composed finite-state transducers.

A text is cut into clauses and every word becomes a symbol: strong insult, mild insult, threat, one of three kinds of
persons, negation, reported speech, or other. Five transducers read the symbols side by side. Each is a bimachine: one
deterministic automaton reads the clause from the left, one from the right, and the output at a word depends on the
states on both sides. ``compose`` builds the product of all five, once:

* insult and threat: pass on their own symbols, all others give nothing;
* target: an insult is *framed* by a person up to ``REACH`` words before or after it ("you clown", "trash like him"),
  a threat by the person it is aimed at: after it, or, for pronouns that stand before their verb, on either side;
* negation: one up to three words before, or two after a threat, lowers the word to a fifth;
* reported speech: a verb of saying before or after it in the clause lowers it to a fifth.

The lexicon gives every word two weights, framed and bare. Mild insults and threats are next to nothing when bare, so
"take out the trash" and "kill the process" are no matches and "you are trash" and "I will kill you" are. A clause
scores its highest word. A text scores ``1 - exp(-RATE * evidence)``, where evidence is the highest clause by words of
the fixed lists, or the sum of all clauses by learned words divided by the square root of ``1 + words / LONG``, if that is
more: several matches of learned words tell more than one, but less in a text so long that some must be there by chance.

Weights: fixed lists start the lexicon, and labelled rows that are not held out correct and extend it. A fixed word's
bare weight moves from its prior to its precision in the labelled texts. Whole words and word beginnings of four to
eight letters are counted in toxic and other training texts; one enters when the likelihood ratio says that it marks
toxic texts, weighted by its smoothed precision above one half, so that a word that clean texts hold now and then needs
others beside it; a beginning enters only if no single word makes up half of its toxic texts. A beginning counts, in
learning as in scoring, only in texts where at least one of ``DENSE`` words has it.

At most about ``TRAIN_ROWS`` labelled rows are used, drawn by a hash, one of each group of texts that share the least
four hashes of their words, so that copies of one text do not teach their rare words.

Defined results: a null or empty text has no clause and scores 0; a doc_id with several labels is toxic if
any label is 1; null labels are ignored; repeated rows are scored one by one; an empty table gives an empty
result; without labels the fixed lists alone decide; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, held_out

TRAIN_ROWS = 30_000
THRESHOLD = 0.3
RATE = 1.2
REACH = 4
LONG = 30
DENSE = 150
DAMPED = 0.2
PREFIXES = (4, 5, 6, 7, 8)
MIN_TOXIC_DOCS = 3
#: A learned word weighs nothing at this smoothed precision and 1 at full precision.
SURE = 0.5
#: Between the two its weight grows with this power, so that a doubtful word alone stays under the threshold.
POWER = 1.5
#: Labelled texts that the prior of a fixed word counts for.
PRIOR_TEXTS = 2.0
#: Terms counted by a worker before it hands the counts on.
COUNTED_TERMS = 200_000
#: A word's classes kept by a worker before it starts afresh.
KEPT_WORDS = 300_000

# Word lists.
INSULTS = (
    "idiot idiots moron morons imbecile scum dumbass bastard bitch asshole "
    "idiota imbécil idiote imbécile connard connasse dummkopf trottel abschaum arschloch"
).split()
MILD_INSULTS = (
    "stupid loser losers trash worthless pathetic disgusting clown clowns "
    "estúpido estúpida basura asqueroso asquerosa payaso inútil stupide ordure minable dégoûtant dumm erbärmlich wertlos widerlich"
).split()
THREATS = "kill hurt murder destroy beat stab shoot strangle matar mataré golpear tuer frapper détruire töten umbringen schlagen vernichten".split()
SUBJECTS = "he she they du ihr tu tú ti usted ustedes ellos".split()
PERSONS = "you your yours yourself u him her them".split()
CLITICS = "dich dir euch te toi vous".split()
NEGATIONS = "not never isn't aren't wasn't don't won't nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say wrote writes claimed called quoted reported according sagte schrieb behauptete dit écrit dijo escribió".split()

CLAUSE = re.compile(r"[.!?;:\n\r]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SYMBOLS = OTHER, INSULT, MILD, THREAT, SUBJECT, PERSON, CLITIC, NEGATION, REPORT = tuple(range(9))
#: Framed and bare weights that the fixed lists start with.
STARTING = {INSULT: (1.1, 0.6), MILD: (1.0, 0.2), THREAT: (1.0, 0.2)}


class Bimachine:
    """``left`` and ``right`` step states over symbols from either end; ``out(symbol, l, r)`` gives (framed, gain).

    ``l`` and ``r`` are the states before the symbol and after it, each as read from its own end.
    """

    def __init__(self, left, right, out):
        self.left, self.right, self.out = left, right, out


def _still(state: int, symbol: int) -> int:
    return 0


def _since(reach: int, *symbols: int):
    """Counts down from the last of ``symbols``."""
    return lambda state, symbol: reach if symbol in symbols else max(0, state - 1)


def insult_machine() -> Bimachine:
    return Bimachine(_still, _still, lambda x, l, r: (False, 1.0 if x in (INSULT, MILD, THREAT) else 0.0))


def threat_machine(reach: int = 3) -> Bimachine:
    """A threat is framed by the one it is aimed at."""
    return Bimachine(_since(reach, CLITIC), _since(reach, PERSON, CLITIC), lambda x, l, r: (x == THREAT and l + r > 0, 1.0))


def target_machine() -> Bimachine:
    near = _since(REACH, SUBJECT, PERSON, CLITIC)
    return Bimachine(near, near, lambda x, l, r: (x in (INSULT, MILD) and l + r > 0, 1.0))


def negation_machine() -> Bimachine:
    return Bimachine(_since(3, NEGATION), _since(2, NEGATION), lambda x, l, r: (False, DAMPED if l or (r and x == THREAT) else 1.0))


def report_machine() -> Bimachine:
    seen = lambda state, symbol: 1 if state or symbol == REPORT else 0
    return Bimachine(seen, seen, lambda x, l, r: (False, DAMPED if l or r else 1.0))


def _product(steps: list) -> tuple[dict[tuple[int, int], int], list[tuple[int, ...]]]:
    """The reachable product of automata that all start in 0: its transitions and its states."""
    first = (0,) * len(steps)
    number, states, table = {first: 0}, [first], {}
    for at in states:
        for symbol in SYMBOLS:
            after = tuple(step(s, symbol) for step, s in zip(steps, at, strict=True))
            if after not in number:
                number[after] = len(states)
                states.append(after)
            table[number[at], symbol] = number[after]
    return table, states


class Composed:
    """The composition of bimachines: framed if any frames, the product of all gains."""

    def __init__(self, *machines: Bimachine):
        self.left, lefts = _product([m.left for m in machines])
        self.right, rights = _product([m.right for m in machines])
        self.out = {}
        for x in SYMBOLS:
            for i, l in enumerate(lefts):
                for j, r in enumerate(rights):
                    each = [m.out(x, a, b) for m, a, b in zip(machines, l, r, strict=True)]
                    gain = math.prod(g for _, g in each)
                    if gain:
                        self.out[x, i, j] = (any(f for f, _ in each), gain)

    def read(self, symbols: list[int]) -> list[tuple[bool, float]]:
        """(framed, gain) of each symbol of a clause; gain 0 where nothing is put out."""
        state, rights = 0, []
        for x in reversed(symbols):
            rights.append(state)
            state = self.right[state, x]
        state, found = 0, []
        for x, r in zip(symbols, reversed(rights), strict=True):
            found.append(self.out.get((x, state, r), (False, 0.0)))
            state = self.left[state, x]
        return found


class Grammar:
    def __init__(self, weights: dict[str, tuple[float, float]]):
        """weights: framed and bare weight of ``=word`` for whole words, ``word beginning`` for beginnings."""
        self.machine = Composed(insult_machine(), threat_machine(), target_machine(), negation_machine(), report_machine())
        self.weights = weights
        kinds = ((SUBJECTS, SUBJECT), (PERSONS, PERSON), (CLITICS, CLITIC), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (MILD_INSULTS, MILD), (INSULTS, INSULT))
        self.fixed = {word: kind for words, kind in kinds for word in words}
        self.memo: dict[str, tuple[int, tuple[float, float]]] = {}

    def symbol(self, word: str) -> tuple[int, tuple[float, float], str | None]:
        """The word's symbol, its weights and what they were learned for: the word, its beginning or nothing."""
        found = self.memo.get(word)
        if found is None:
            options = [f"={word}"] if f"={word}" in self.weights else [word[:n] for n in PREFIXES if len(word) > n and word[:n] in self.weights]
            term = max(options, key=self.weights.get, default=None)
            kind = self.fixed.get(word, OTHER if term is None else INSULT)
            found = (kind, self.weights[term] if kind in STARTING and term else (0.0, 0.0), None if word in self.fixed else term)
            if len(self.memo) >= KEPT_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def clause(self, words: list[str], sparse: frozenset[str] | set[str] = frozenset()) -> tuple[float, float]:
        """The weight of the clause's highest match by the fixed lists and by learned terms; ``sparse`` ones do not match."""
        symbols = [self.symbol(w) for w in words]
        read = self.machine.read([kind for kind, _, _ in symbols])
        scores = [(gain * weight[0 if framed else 1], term) for (framed, gain), (_, weight, term) in zip(read, symbols, strict=True) if term not in sparse]
        return max((s for s, term in scores if term is None), default=0.0), max((s for s, term in scores if term), default=0.0)

    def _read(self, text: str) -> tuple[list[tuple[str, float, float]], int]:
        parts = [(part, WORD.findall(part)) for part in CLAUSE.split(text.lower())]
        n_words = sum(len(words) for _, words in parts)
        begins: Counter[str] = Counter()
        telling = []
        for part, words in parts:
            marked = [s for s in map(self.symbol, words) if s[1][0]]
            begins.update(term for _, _, term in marked if term and term[0] != "=")
            if marked:
                telling.append((part, words))
        sparse = {b for b, n in begins.items() if n * DENSE < n_words}
        return [(part.strip(), *s) for part, words in telling if max(s := self.clause(words, sparse)) > 0], n_words

    def matched(self, text: str) -> list[tuple[str, float]]:
        """The clauses that score, with their scores."""
        return [(part, max(fixed, learned)) for part, fixed, learned in self._read(text)[0]]

    def score(self, text: str) -> float:
        clauses, n_words = self._read(text)
        if not clauses:
            return 0.0
        return 1 - math.exp(-RATE * max(max(fixed for _, fixed, _ in clauses), sum(learned for _, _, learned in clauses) / math.sqrt(1 + n_words / LONG)))


def fixed_weights() -> dict[str, tuple[float, float]]:
    return {f"={w}": STARTING[kind] for words, kind in ((INSULTS, INSULT), (MILD_INSULTS, MILD), (THREATS, THREAT)) for w in words}


def _terms(text: str) -> set[str]:
    """``=word`` for the words of a text and the beginnings that are dense in it; the empty term for the text itself."""
    words = WORD.findall(text.lower())
    begins = Counter(w[:n] for w in words for n in PREFIXES if len(w) > n)
    return {"", *(f"={w}" for w in words), *(b for b, n in begins.items() if n * DENSE >= len(words))}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, texts = Counter(), Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array([toxic[t] for t in texts], pa.int64()), pa.array(list(texts.values()), pa.int64())], names=["term", "k", "n"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            terms = _terms(text.as_py() or "")
            texts.update(terms)
            if label:
                toxic.update(terms)
            if len(texts) > COUNTED_TERMS:
                yield made()
                toxic.clear()
                texts.clear()
    yield made()


def _training_texts(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """toxic and text of what is learned from."""
    marks = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.filter(drawn(F.xxhash64("doc_id"), max_rows / max(1, marks.count())))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    least = F.slice(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), 1, 4)
    return (
        docs.select(F.col("doc_id"), F.col("text").cast("string"))
        .join(F.broadcast(marks), "doc_id")  # about max_rows rows of two numbers
        .groupBy(least.alias("copies"))
        .agg(F.max("toxic").alias("toxic"), F.max_by("text", F.struct("toxic", F.length("text"), "text")).alias("text"))
        .select("toxic", "text")
    )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> dict[str, tuple[float, float]]:
    """The lexicon's weights from labelled rows that are not held out."""
    weights = fixed_weights()
    counted = _training_texts(docs, labels, max_rows).mapInArrow(_counts, "term string, k long, n long").groupBy("term").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    # the terms of a bounded sample, without those that hardly any toxic text or more clean than toxic ones hold
    telling = (F.col("k") >= MIN_TOXIC_DOCS) & (F.col("k") > SURE * F.col("n"))
    kept = counted.filter(telling | (F.col("term") == "") | F.col("term").isin(list(weights))).collect()
    whole = next((r for r in kept if r["term"] == ""), None)
    if whole is None or not whole["k"] or whole["k"] == whole["n"]:
        return weights
    base, needed = whole["k"] / whole["n"], 2 * math.log(whole["n"]) + 12
    leading: dict[str, int] = {}  # of each beginning, the count of its commonest word
    for r in kept:
        if r["term"].startswith("="):
            for size in PREFIXES:
                begin = r["term"][1 : 1 + size]
                leading[begin] = max(leading.get(begin, 0), r["k"])
    for r in kept:
        term, k, n = r["term"], r["k"], r["n"]
        if term in weights:
            framed, bare = weights[term]
            known = (k + PRIOR_TEXTS * bare) / (n + PRIOR_TEXTS)
            bare = max(0.0, known - base) if n > PRIOR_TEXTS else bare
            weights[term] = (max(bare, framed * min(1.0, (k + PRIOR_TEXTS) / (n + PRIOR_TEXTS))), bare)
        elif term and k > SURE * n and leading.get(term, 0) < k / 2:
            gain = 2 * (k * math.log(k / n / base) + ((n - k) * math.log((n - k) / n / (1 - base)) if n > k else 0))
            if gain >= needed:
                weight = max(0.0, ((k + 0.5) / (n + 1) - SURE) / (1 - SURE)) ** POWER
                weights[term] = (weight, weight)
    return weights


def _score(weights: dict[str, tuple[float, float]]):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(weights)
        for batch in batches:
            scores = [grammar.score(t.as_py() or "") for t in batch.column(2)]
            predicted = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted], schema=schema)

    return run


def score_documents(docs: DataFrame, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string")).mapInArrow(
        _score(weights), "doc_id long, held_out boolean, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their own columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(weights)
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(t.as_py() or "") < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
