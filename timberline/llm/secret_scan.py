"""Secrets in texts: fixed patterns, and values in a credential context that take many guesses.

What takes few guesses is a matter of the language around it: the words of the corpus itself, by their counts over all of
its texts, are the dictionary from which values are guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guess_cost import Guesser, guesses_log10
from .shared import written
from .wordhash import slices

# Patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more; each match takes the whole run
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

#: What names a credential, wider than ASSIGN, and the value after it: up to the closing quote, or a run of characters.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?|authorization)["']?\x20*(?:=>|:=|[:=])\x20*(?:(?:bearer|basic)\x20+)?(?:"((?:\\.|[^"\\\n])+)"|'((?:\\.|[^'\\\n])+)'|["']?([^\s"'<>,;]+))""",
    re.IGNORECASE | re.ASCII,
)
#: Where the next field of a query string ends a value without quotes.
_FIELD = re.compile(r"&\w+=")
#: Lower-case parts, one of which every match of ASSIGN or CONTEXT has.
_PARTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization")
KINDS = ("assign", "access", "hex", "guess")

SPANS = "array<struct<kind: string, from: int, to: int>>"
_SPAN = pa.struct([("kind", pa.string()), ("from", pa.int32()), ("to", pa.int32())])


def base_spans(text: str, hint: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in code points, in order."""
    out = []
    if hint is None:
        hint = text.lower()
    if any(x in hint for x in _PARTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, base: list[tuple[int, int, int]], least_log10: float, shortest: int, hint: str, cost=guesses_log10) -> list[tuple[int, int, int]]:
    """Values in a credential context whose cheapest guess costs least_log10 or more, or of which base spans hold a part;
    none that a base span holds whole."""
    if not any(x in hint for x in _PARTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:
            field = _FIELD.search(text, a, b)
            b = a + len(text[a : field.start() if field else b].rstrip(".!?)]}%*#$&"))
        if b - a < shortest or any(s <= a and b <= e for s, _, e in base):
            continue
        if any(s < b and a < e for s, _, e in base) or cost(text[a:b]) >= least_log10:
            out.append((a, 3, b))
    return out


def all_spans(text: str | None, least_log10: float = 8.05, shortest: int = 8, cost=guesses_log10) -> list[tuple[int, int, int]]:
    text = text or ""
    hint = text.lower()
    base = base_spans(text, hint)
    return sorted(base + guessed_spans(text, base, least_log10, shortest, hint, cost))


#: Words of the corpus in the dictionary at most, letters of each at most (so it holds some 2 MB at most), and how often
#: a word stands in the corpus at least.
DICTIONARY, LETTERS, OFTEN = 50_000, 24, 5


def corpus_words(docs: DataFrame, text_column: str = "text", most: int = DICTIONARY) -> list[str]:
    """The words (runs of 3 to LETTERS letters, in lower case) of all texts that stand there OFTEN times or more, most
    common first; if there are more than `most`, only those of counts that keep the list within it. What follows a
    credential name does not count, as copies would make a secret a common word."""
    text = F.lower(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    told = text.contains(_PARTS[0])
    for part in _PARTS[1:]:
        told |= text.contains(part)
    text = F.when(told, F.regexp_replace(text, r"(?:pass[a-z]*|pwd|secret|token|key|credentials?|authorization)[\"']?\x20*(?:=>|:=|[:=])\x20*\S+", " ")).otherwise(text)
    words = docs.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter(F.length("word").between(3, LETTERS))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN), "words")
    # at most some hundred classes of counts; the list is cut at one of them
    size = F.floor(F.log2("n") * 8)
    classes = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True)
    held, least = 0, None
    for r in classes:
        held += r["words"]
        if held > most:
            break
        least = r["size"]
    if least is None:
        return []
    return [r["word"] for r in sorted(counts.filter(size >= least).collect(), key=lambda r: (-r["n"], r["word"]))]


class _Cost:
    """A guesser that is built where and when it is first used."""

    def __init__(self, words: list[str]):
        self.words, self.guesser = " ".join(words), None

    def __call__(self, value: str) -> float:
        if self.guesser is None:
            self.guesser = Guesser(self.words.split(" "))
        return self.guesser(value)


def _found(least_log10: float, shortest: int, cost: _Cost):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                spans = [[{"kind": KINDS[k], "from": i, "to": j} for i, k, j in all_spans(x.as_py(), least_log10, shortest, cost)] for x in batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, pa.list_(_SPAN))], ["id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_log10: float = 8.05, shortest: int = 8, words: list[str] | None = None) -> DataFrame:
    """id_column and spans (kind, from, to in code points; to exclusive) of every whole text, one row for each input row.

    Kinds: assign, access, hex (fixed patterns, leftmost without overlap within a kind) and guess (a value of at least
    `shortest` characters after a credential name that takes 10**least_log10 guesses or more, or that another kind
    holds in part; the whole of it). words: the dictionary for guesses; None: that of the texts themselves. Null or empty
    text: no spans. Ids may be null or repeat; very long texts are searched whole, in time in proportion to them; an empty
    table gives an empty result; other columns are left out.
    """
    cost = _Cost(corpus_words(docs, text_column) if words is None else words)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_found(least_log10, shortest, cost), f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_column)


def redact_secrets(docs: DataFrame, text_column: str = "text", least_log10: float = 8.05, shortest: int = 8, by: str = "[secret]", words: list[str] | None = None) -> DataFrame:
    """docs with every found span, overlapping or touching ones as one, replaced. Rows and other columns stay; null stays
    null; an empty table stays empty."""
    at, cost = docs.columns.index(text_column), _Cost(corpus_words(docs, text_column) if words is None else words)

    def clean(text: str | None) -> str | None:
        spans = all_spans(text, least_log10, shortest, cost)
        if not spans:
            return text
        out, done, upto = [], 0, -1
        for a, _, b in spans:
            if a >= upto:
                out += [text[done:a], by]
            done = upto = max(upto, b)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                columns = [x.slice(a, b - a) for x in batch.columns]
                columns[at] = pa.array([clean(x.as_py()) for x in columns[at]], columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def spans_text(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of those kinds, comma-joined in the order of the spans."""
    return F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["from"], x["to"])), ",")
