"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into classes; a negation transducer, a reported-speech
transducer and a pattern transducer are composed with it into one machine that reads a
clause and names the pattern that each abusive word completes. The lexicon has fixed words
and word beginnings learned from labelled texts. Patterns are weighted by how often
labelled texts of either label hold them.
"""

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineglass.llm.common import stored

# The words of each class in English, German, French and Spanish.
INSULT = """
    idiot idiots idiotic moron morons imbecile stupid dumb fool scum trash garbage filth vermin clown loser losers
    worthless pathetic disgusting useless coward liar pig bastard bitch whore retard
    dumm dummkopf abschaum trottel versager widerlich nutzlos schwein arschloch
    imbécile crétin débile connard salaud ordure minable pourriture
    imbécil estúpido estúpida inútil basura asqueroso patético cabrón escoria
""".split()
THREAT = """
    kill murder hurt destroy strangle stab shoot
    töten umbringen verprügeln erschießen
    tuer égorger frapper
    matar golpear destruir
""".split()
TARGET = """
    you your yours yourself u they them these those he she him her people
    du dich dir dein deine ihr euch sie
    tu te toi ton vous votre eux
    usted ustedes vosotros ellos ellas
""".split()
NEGATION = """
    not never isn't aren't don't doesn't wasn't won't cannot can't without
    nicht kein keine niemals
    pas jamais aucun
    nunca jamás tampoco
""".split()
REPORTED = """
    said says say wrote writes called calls claimed reported quoted allegedly
    sagte sagt schrieb nannte behauptete
    dit écrit appelé prétend
    dijo dice escribió llamó
""".split()

# Words after a negation that it reaches, and words between a target and what is said of it.
NEGATION_REACH = 3
TARGET_REACH = 4
PATTERNS = ["insult_at", "insult", "threat_at", "threat", "learned", "learned_weak", "negated", "reported"]
# Clauses of one pattern counted apart; the last stands for that many or more.
MOST = 3
THRESHOLD = 0.3

# The lexicon is learned from at most about so many labelled rows; weights come from all.
SAMPLE = 12_000
# Lengths of word beginnings, and how many of them the learned lexicon holds at most.
BEGINNINGS = range(4, 11)
LEARNED = 5_000
# Evidence for a beginning, in nats, and shares of label 1 among its texts for either class.
EVIDENCE, STRONG, WEAK = 8.0, 0.9, 0.5

CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


class Transducer(NamedTuple):
    """A deterministic machine: (state, symbol) leads to (next state, output)."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, str]]

    def read(self, symbols: Iterator[str]) -> Iterator[str]:
        state = self.start
        for symbol in symbols:
            state, out = self.arcs[state, symbol]
            yield out


def compose(first: Transducer, then: Transducer, alphabet: str) -> Transducer:
    """One machine that feeds what ``first`` puts out to ``then``."""
    start = (first.start, then.start)
    arcs, todo = {}, [start]
    seen = {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            to_a, middle = first.arcs[a, symbol]
            to_b, out = then.arcs[b, middle]
            arcs[state, symbol] = (to_a, to_b), out
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                todo.append((to_a, to_b))
    return Transducer(start, arcs)


# Classes: I insult, T threat, L and M learned (strong and weak), Y target, N negation,
# R reported speech, O other; x an abusive word that is denied, q one that is reported.
ABUSIVE = "ITLM"
CLASSES = ABUSIVE + "YNRO"


def negation() -> Transducer:
    """Mark abusive words within reach of a negation as denied."""
    arcs = {}
    for left in range(NEGATION_REACH + 1):
        for symbol in CLASSES:
            to = NEGATION_REACH if symbol == "N" else max(left - 1, 0)
            arcs[left, symbol] = to, "x" if left and symbol in ABUSIVE else symbol
    return Transducer(0, arcs)


def reported() -> Transducer:
    """Mark abusive words after a verb of speech as reported."""
    arcs = {}
    for heard in (False, True):
        for symbol in CLASSES + "x":
            arcs[heard, symbol] = heard or symbol == "R", "q" if heard and symbol in ABUSIVE + "x" else symbol
    return Transducer(False, arcs)


def patterns() -> Transducer:
    """Name the pattern that an abusive word completes, knowing how near a target stands before it."""
    names = {"I": "insult", "T": "threat"}
    arcs = {}
    for left in range(TARGET_REACH + 1):
        for symbol in CLASSES + "xq":
            to = TARGET_REACH if symbol == "Y" else max(left - 1, 0)
            out = {"x": "negated", "q": "reported", "L": "learned", "M": "learned_weak"}.get(symbol, "")
            if symbol in names:
                out = names[symbol] + ("_at" if left else "")
            arcs[left, symbol] = to, out
    return Transducer(0, arcs)


@cache
def machine() -> Transducer:
    return compose(negation(), compose(reported(), patterns(), CLASSES + "x"), CLASSES)


class Lexicon:
    """The lexical transducer: words to classes, by fixed words and learned beginnings."""

    def __init__(self, beginnings: dict[str, str]):
        self.beginnings = beginnings
        self.words: dict[str, str] = {}
        for symbol, words in zip("RNYTI", (REPORTED, NEGATION, TARGET, THREAT, INSULT)):
            self.words.update(dict.fromkeys(words, symbol))
        self.search = None

    def symbol(self, word: str) -> str:
        if (own := self.words.get(word)) or len(word) < BEGINNINGS[0]:
            return own or "O"
        return min((self.beginnings.get(word[:n], "O") for n in BEGINNINGS), default="O")

    def hits(self, low: str) -> list[int]:
        """Where abusive words may begin."""
        if self.search is None:
            self.search = ahocorasick.Automaton()
            for word in (*INSULT, *THREAT, *self.beginnings):
                self.search.add_word(word, len(word))
            self.search.make_automaton()
        starts = {end + 1 - size for end, size in self.search.iter(low)}
        return sorted(k for k in starts if not k or not low[k - 1].isalpha())

    def matched(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end and pattern of every abusive word, clause by clause, over the whole text.

        Places count characters of the lower-cased text.
        """
        low = (text or "").lower()
        hits = self.hits(low)
        found, k = [], 0
        for clause in CLAUSE.finditer(low) if hits else ():
            while k < len(hits) and hits[k] < clause.start():
                k += 1
            if k == len(hits):
                break
            if hits[k] >= clause.end():
                continue
            words = list(WORD.finditer(low, clause.start(), clause.end()))
            named = machine().read(self.symbol(w[0]) for w in words)
            found += [(w.start(), w.end(), name) for w, name in zip(words, named) if name]
        return found


BEGUN = pa.schema([("label", pa.int32()), ("beginning", pa.string()), ("context", pa.int64())])
# Rows that a task holds before it hands them on; a text's own rows stay together.
HELD = 50_000


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The beginnings of a text's words; for label 1 also the words around each, as a number.

    A row for each; they leave the task by the part, so its memory does not grow with its texts.
    """

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, BEGUN.types)], schema=BEGUN)

    columns = [], [], []
    for batch in batches:
        for label, text in zip(batch.column("label"), batch.column("text")):
            label = label.as_py()
            words = WORD.findall((text.as_py() or "").lower())
            found = {(w[:n], -1) for w in set(words) for n in BEGINNINGS if n <= len(w)}
            if label == 1:
                for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                    context = zlib.crc32(f"{before} {after}".encode())
                    found.update((w[:n], context) for n in BEGINNINGS if n <= len(w))
            for column, values in zip(columns, ([label] * len(found), (b for b, _ in found), (c for _, c in found))):
                column.extend(values)
            if len(columns[0]) >= HELD:
                yield part()
                columns = [], [], []
    yield part()


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``label`` of the documents that may be learned from."""
    rows = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Word beginnings that texts of label 1 hold far more often than others.

    Fitted on a sample of about ``sample`` labelled rows by the hash of their id. How often
    a beginning counts for label 1 is bounded by the number of different word pairs around
    it, so that copies of one text do not make a word of it suspect.
    """
    known = known_labels(labels)
    share = min(1.0, sample / max(known.count(), 1))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # the sample bounds it
    rows = texts.select("label", "text").mapInArrow(_begun, "label int, beginning string, context long")
    pairs = rows.groupBy("beginning", "context").agg(
        F.sum(F.when(F.col("context") == -1, F.col("label")).otherwise(0)).alias("ones"),
        F.sum(F.when(F.col("context") == -1, 1 - F.col("label")).otherwise(0)).alias("zeros"),
    )
    found = pairs.groupBy("beginning").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum((F.col("context") >= 0).cast("int")).alias("contexts")
    )
    base = some.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < base < 1:
        return Lexicon({})
    ones = F.least("ones", "contexts")
    precision = ones / (ones + F.col("zeros"))
    evidence = ones * F.log(precision / base) + F.col("zeros") * F.log(F.greatest(1 - precision, F.lit(1e-9)) / (1 - base))
    best = (
        found.where(ones > 0)
        .select("beginning", precision.alias("precision"), evidence.alias("evidence"))
        .where((F.col("evidence") >= EVIDENCE) & (F.col("precision") >= WEAK))
        .orderBy(F.desc("evidence"), "beginning")
        .limit(LEARNED)
        .collect()
    )
    classes = {r["beginning"]: "L" if r["precision"] >= STRONG else "M" for r in best}
    # A longer beginning says nothing new below a shorter one of its own or a stronger class.
    spare = {b for b in classes for n in BEGINNINGS if n < len(b) and classes.get(b[:n], "O") <= classes[b]}
    return Lexicon({b: c for b, c in classes.items() if b not in spare})


FOUND = "array<struct<start:int,end:int,pattern:string>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))


def matches(text: Column, lexicon: Lexicon, spark: SparkSession) -> Column:
    """All matches of a text as an array; null and empty texts have none."""
    sent = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        own = sent.value
        rows = [[dict(zip(("start", "end", "pattern"), m)) for m in own.matched(t.as_py())] for t in texts]
        return pa.array(rows, _FOUND)

    return run(text)


def spans(found: str) -> Column:
    """Matched places as text: pattern:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["pattern"], m["start"], m["end"])), ",")


def counts(found: Column) -> Column:
    """Matches of each pattern, up to ``MOST``, as an array in the order of ``PATTERNS``."""

    def times(pattern: str) -> Column:
        return F.least(F.size(F.filter(found, lambda m: m["pattern"] == pattern)), F.lit(MOST))

    return F.array(*map(times, PATTERNS))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


Weights = tuple[float, list[list[float]]]


def learn(counted: DataFrame, labels: DataFrame) -> Weights:
    """Log odds of label 1: a constant, and one for each pattern and number of matches.

    Every labelled row that is not held out is counted, in one aggregation whose result
    has ``2 * (MOST + 1) * len(PATTERNS)`` rows at most. A document with several labels has
    the greatest; null labels and labels without a document are left out. Without labels
    the weights are those of even odds.
    """
    rows = (
        counted.join(known_labels(labels), "doc_id")
        .select("label", F.posexplode("counts").alias("pattern", "times"))
        .groupBy("label", "pattern", "times")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    seen = {(r["label"], r["pattern"], r["times"]): r["n"] for r in rows}
    total = [sum(seen.get((label, 0, m), 0) for m in range(MOST + 1)) + 1 for label in (0, 1)]

    def odds(pattern: int, times: int) -> float:
        share = [(seen.get((label, pattern, times), 0) + 0.5) / (total[label] + MOST) for label in (0, 1)]
        return math.log(share[1] / share[0])

    return math.log(total[1] / total[0]), [[odds(p, m) for m in range(MOST + 1)] for p in range(len(PATTERNS))]


def score(counted: Column, weights: Weights) -> Column:
    """The probability of label 1 from an array of counts."""
    constant, table = weights
    total = F.lit(constant)
    for p, row in enumerate(table):
        total = total + F.element_at(F.array(*map(F.lit, row)), counted[p] + 1)
    return 1 / (1 + F.exp(-total))


def counted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, the matched places and their counts for every row."""
    found = docs.select("doc_id", matches(F.col("text"), lexicon, docs.sparkSession).alias("found"))
    return found.select("doc_id", "found", counts(F.col("found")).alias("counts"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, Weights, DataFrame]:
    """Lexicon and weights, and the stored counts of every row."""
    lexicon = learn_lexicon(docs, labels)
    seen = stored(counted(docs, lexicon), "toxic")
    return lexicon, learn(seen, labels), seen


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the matched places of every row.

    Null and empty texts have the score of a text without a match; repeated rows are scored
    alike; a row without an id is never learned from and not held out; an empty table gives
    no rows; no column but the text plays a part in a score.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, weights, seen = fit(source, labels)
    value = score(F.col("counts"), weights)
    return seen.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        value.alias("score"),
        F.when(value >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "found",
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score lies below the threshold, as they are; no text is shuffled."""
    lexicon, weights, _ = fit(docs.select("doc_id", "text"), labels)
    found = matches(F.col("text"), lexicon, docs.sparkSession)
    return docs.where(score(counts(found), weights) < THRESHOLD)
