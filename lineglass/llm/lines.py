"""Line dedup by winnowing, with exact ranks.

A line ends at a line break, after a single mark that ends a sentence or a clause and after
common word ends. What is still long is cut by a second rule, and then at every word, so
that equal passages are cut alike wherever they stand, but for a few words at their edges.
Lines whose hash says so are anchors, and the gram of lines from each on is a print; a
shortest run of lines with enough words that holds none has the gram at its least hash. So
every run has a print that its own lines decide, and equal runs have equal ones. Runs at prints
that occur more than once are hashed, and go if an earlier place has them; overlapping runs
add up. No run is left out, so it does not matter in which of the earlier texts it stands.
The first copy stays.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words in the whole lines of a run.
MIN_WORDS = 30
# Words of a line at most. What of a passage shares a line with the text around it is no
# more than that at each end, so a passage of MIN_WORDS + 2 * LONG words is always met.
LONG = 10

# One line of so many is an anchor, by its hash.
ANCHORS = 8
# Lines of a gram, of which prints are made.
GRAM = 5

# A line has at least one word: white space belongs to the line before it.
NEXT = r"(?=[^\S\n]*\S)"
# An end is a character and what has to be true behind it; the first test only says no early.
ENDS = (r"[\n ]", r"(?<=[\n.!?;:,nsNS] ?)(?:(?<=\n)|(?<=[^!?][.!?;:,] )|(?<=[aiAI][nsNS] ))" + NEXT)
LONG_ENDS = (" ", r"(?<=[nrstNRST] )" + NEXT)
WORD_ENDS = (" ", NEXT)
# Stands after each end while a text is cut; texts that hold it themselves are cut without it.
MARK = r"\u0001"


def lines_sql(text: str) -> str:
    """The lines of a text with all their characters: put together they are the text."""
    text = f"coalesce({text}, '')"
    return f"if(instr({text}, '{MARK}') > 0, {_cut(text, _at_ends)}, {_cut(text, _at_marks)})"


def _cut(text: str, split: Callable[[str, tuple[str, str]], str]) -> str:
    """Cut those parts that have too many words; nothing but a part itself decides."""
    words = f"if({_long('v')}, {split('v', WORD_ENDS)}, array(v))"
    parts = f"if({_long('u')}, flatten(transform({split('u', LONG_ENDS)}, v -> {words})), array(u))"
    return f"flatten(transform({split(text, ENDS)}, u -> {parts}))"


def _long(part: str) -> str:
    return f"octet_length({part}) > {2 * LONG} and octet_length(substring_index({part}, ' ', {LONG + 1})) < octet_length({part})"


def _at_marks(text: str, ends: tuple[str, str]) -> str:
    return f"split(regexp_replace({text}, '{_quoted(''.join(ends))}', '$0{MARK}'), '{MARK}', -1)"


def _at_ends(text: str, ends: tuple[str, str]) -> str:
    return f"split({text}, '{_quoted(f'(?<={ends[0]}){ends[1]}')}', -1)"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _with_lines(body: str) -> str:
    """``body`` with ``l``: hash ``h`` of each line, line ``w`` of each word, first word ``s`` of each line."""
    words = "flatten(transform(t, (x, i) -> array_repeat(i, octet_length(x) - octet_length(replace(x, ' ', '')) + 1)))"
    starts = "filter(sequence(0, size(w) - 1), k -> k = 0 or w[k] <> w[k - 1])"
    hashes = "transform(t, x -> xxhash64(x))"
    row = _let("w", words, f"named_struct('h', {hashes}, 'w', w, 's', {starts})")
    return _let("t", f"transform({lines_sql('text')}, u -> btrim(u, ' \\n\\r\\t'))", _let("l", row, body))


def _keyed(docs: DataFrame) -> DataFrame:
    """``_doc`` and ``_hash`` name a text. Rows without an id count as one document, as rows with one id do."""
    return docs.withColumns({"_doc": _doc(), "_hash": F.xxhash64("text")})


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def prints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_doc``, ``_hash``, ``v`` and ``at``: the prints of every text and the lines where they begin.

    The shortest run from a line on is in every longer run from there. Its print is the gram
    of the first anchor in it, else of its least line hash, the first of equal ones; a run of
    fewer lines than a gram is a print as a whole.
    """
    anchors = f"filter(sequence(0, size(l.h) - 1), i -> pmod(l.h[i], {ANCHORS}) = 0)"
    # Lines up to an anchor, from the one before it on, whose runs end within its gram.
    after = "if(j = 0, 0, d[j - 1] + 1)"
    bound = f"least(coalesce(get(l.s, e + {GRAM - 1}), size(l.w)), size(l.w)) - {min_words}"
    others = (
        f"flatten(transform(concat(d, array(size(l.h))), (e, j) -> if(coalesce(get(l.s, {after}) <= {bound}, false), "
        f"filter(sequence({after}, least(e, size(l.h) - 1)), i -> l.s[i] <= {bound}), cast(array() as array<int>))))"
    )
    lines = f"l.w[l.s[i] + {min_words - 1}] - i + 1"
    least = _let("z", f"slice(l.h, i + 1, {lines} - {GRAM - 1})", "cast(array_position(z, array_min(z)) as int) + i - 1")
    at = f"array_distinct(concat(filter(d, p -> p + {GRAM} <= size(l.h)), transform(filter(o, i -> {lines} >= {GRAM}), i -> {least})))"
    grams = f"transform({at}, p -> struct(xxhash64({', '.join(f'l.h[p + {k}]' for k in range(GRAM))}) as v, p as at))"
    whole = f"transform(filter(o, i -> {lines} < {GRAM}), i -> struct(xxhash64(slice(l.h, i + 1, {lines})) as v, i as at))"
    found = _let("d", anchors, _let("o", others, f"concat({grams}, {whole})"))
    few = f"if(size(l.w) < {min_words}, cast(array() as array<struct<v:bigint,at:int>>), {found})"
    return _keyed(docs).select("_doc", "_hash", F.inline(F.expr(_with_lines(few))))


def places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_doc``, ``_hash`` and ``_at``, the lines with prints that occur more than once."""
    order = W.partitionBy("v").orderBy("_doc")
    near = prints(docs, min_words).withColumns({"a": F.lag("_doc").over(order), "b": F.lead("_doc").over(order)})
    again = near.where("a is not null or b is not null")
    return again.groupBy("_doc", "_hash").agg(F.array_sort(F.collect_set("at")).alias("_at"))


def hashed_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc``, ``text_hash``, ``g`` and ``at`` for every shortest run of enough words at ``_at``.

    ``g`` is the hash of the run's lines, ``at`` its first line above eight bits for the
    number of its lines. A run is one that begins or ends with the line of a word and holds
    as many words from there as are needed; so every longer run is covered by such runs.
    ``docs`` is keyed and has ``_at``, lines in order; a run is hashed if it holds one of them.
    """
    last = min_words - 1
    first = f"greatest(l.s[p] - {last}, if(j = 0, 0, l.s[_at[j - 1] + 1]))"
    near = f"flatten(transform(_at, (p, j) -> sequence(greatest({first}, 0), coalesce(get(l.s, p + 1), size(l.w)) - 1)))"
    at = (
        f"array_distinct(transform(filter({near}, k -> k + {min_words} <= size(l.w) and (k = 0 or l.w[k] <> l.w[k - 1] "
        f"or k + {min_words} = size(l.w) or l.w[k + {last}] <> l.w[k + {min_words}])), "
        f"k -> shiftleft(cast(l.w[k] as long), 8) + l.w[k + {last}] - l.w[k] + 1))"
    )
    runs = (
        f"transform({at}, x -> named_struct('g', "
        "xxhash64(slice(l.h, cast(shiftright(x, 8) as int) + 1, cast(x & 255 as int))), 'at', x))"
    )
    # Names every column, so that this join and the last one need the same and read one shuffle.
    row = ", ".join(f"`{c}`" for c in docs.columns if c != "_at")
    return docs.select(_doc().alias("doc"), F.col("_hash").alias("text_hash"), F.inline(F.expr(_let("r", f"struct({row})", _with_lines(runs)))))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc``, ``text_hash`` and ``runs``, the first and last line of every later repeated run.

    Runs are ranked among their equals, never paired. ``docs`` is keyed.
    """
    order = W.partitionBy("g").orderBy("doc", "at")
    near = docs.join(places(docs.select("doc_id", "text"), min_words), ["_doc", "_hash"])
    again = hashed_runs(near, min_words).withColumn("n", F.rank().over(order)).where("n > 1")
    own = again.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    runs = "transform(ats, x -> named_struct('a', cast(x >> 8 as int), 'b', cast((x >> 8) + (x & 255) - 1 as int)))"
    # Runs overlap; as one list they do not, and one step reads them.
    merged = (
        f"aggregate({runs}, cast(array() as array<struct<a:int,b:int>>), (m, r) -> case "
        "when size(m) = 0 or r.a > element_at(m, -1).b + 1 then array_append(m, r) "
        "when r.b <= element_at(m, -1).b then m "
        "else array_append(slice(m, 1, size(m) - 1), named_struct('a', element_at(m, -1).a, 'b', r.b)) end)"
    )
    return own.select("doc", "text_hash", F.expr(merged).alias("runs"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, without the later repeated runs in ``text``; adds ``removed_lines``.

    The first copy is the one with the least id, then the first place. Null and empty texts,
    and rows without a repeated run, stay as they are; a text that repeats as a whole becomes
    empty; rows with the same id are one document, so equal rows never remove each other;
    rows without an id count as the first document; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    runs = repeated_runs(keyed, min_words)
    met = keyed.join(runs.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("runs").alias("_runs")), ["_doc", "_hash"], "left")
    # What is kept lies between the runs: from each one's end to the next one's start.
    between = (
        "transform(sequence(0, size(_runs)), k -> named_struct('from', if(k = 0, 0, get(_runs, k - 1).b + 1), "
        "'to', if(k = size(_runs), 1000000000, get(_runs, k).a)))"
    )
    kept = (
        f"aggregate(array({lines_sql('text')}), '', (s, l) -> concat(s, array_join(flatten("
        f"transform({between}, g -> slice(l, g.from + 1, g.to - g.from))), '')))"
    )
    gone = "aggregate(_runs, 0, (s, r) -> s + r.b - r.a + 1)"
    columns = [
        F.expr(f"if(_runs is null, text, {kept})").alias("text") if c == "text" else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return met.select(*columns, F.expr(f"if(_runs is null, 0, {gone})").alias("removed_lines"))
