"""Text statistics of each document that tell natural prose from lists, tables and junk.

A document is read as lines. Long texts are cut into chunks; a chunk gives partial counts: those of
its complete lines, and the open first and last line as fragments. Partial counts are merged by an
associative operation that joins the fragments at a boundary into a line. Documents of many chunks
are merged in a tree. Ratios and the kind follow from the merged counts.

A cut is made only where no pattern can read across it: after a line end, or after a single blank
between a word and a word outside any tag. A stretch without such a place stays in one chunk. So the
counts and the kind of a text do not depend on whether and where it is cut.

Null, empty and blank texts have no lines, null ratios and no kind. Rows are independent of each
other, so repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CHUNK = 65_536
FAN = 32
DISTINCT = 64

# Frequent function words of the larger European languages.
COMMON = frozenset(
    """a à ao aos às as até com como da das de do dos e é ela ele em entre era esta este eu foi há isso já mais mas me mesmo
    muito na não nas nem no nos o os ou para pela pelo por quando que se sem ser seu sua são só sob sobre também tem um uma
    al con de del donde el ella en era es esta este fue ha hay la las le lo los más no o para pero por que qué se según si sin
    sobre su sus un una y ya durante desde hasta
    an and are as at be but by about after for from had has have he her his if in is it its not of on or over she that the
    their there they this to was we were which will with would said some any been because
    au aux avec ce ces dans des du elle est et il ils je leur les mais ne nous ont ou par pas plus pour qu qui sa ses son sont
    sur une vous aber als am auch auf aus bei das dem den der die durch ein eine einen er für ich im ist mit nach nicht noch
    nur oder sich sie sind und vom von war wie wird zu zum zur
    che ci di è gli il nel nella non per più si sono alla della dei delle anche questo
    het een van en dat niet zijn op te voor met maar ook och att som på är av för den det inte med
    в и на не что с по к из как это у от за для был она он они""".split()
)
WORD = re.compile(r"[^\W_]+")
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
MARKER = re.compile(r"\s*(?:[•‣◦▪■●○·*→►✓✔+\-–—]|\(?\d{1,3}(?:[.)ºª°]|\.?-)|\(?[a-zA-Z]\)|[ivxIVX]{1,4}[.)]|\[[ xX✓]?\]|[☐☑☒])[\s\xa0]+\S")
ENDERS = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")
GAPS = re.compile(r"(?<=\S)[ \xa0]{2,}(?=\S)")
CELLS = re.compile(r"</?t[dhr]\b[^>]*>", re.I)
BAD = re.compile(r"[�¤§ƒ©ÂÃ¨¬¦\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]|(?<=[^\W\d_])\?(?=[^\W\d_])")
CODE = tuple("{}<>[]=_\\`~^&") + ("()", ");", '":')
TIGHT = re.compile(r",(?:(?<=[^\s],)(?=[^\s\d])|(?<=[^\s\d],)(?=\d)|(?=,))")
TAGS = re.compile(r"#\w")
SEMIS = re.compile(r";(?=\S)")
ARROWS = re.compile(r"»| > | · | / ")
LONG = 20
HEADING = 30
FINAL = ".!?…:\"”»"

SUMS = (
    "chars letters digits words alpha common long mixed bad code enders stops pipes arrows tabs semis tight gaps cells tags word_chars"
).split()
FLAGS = "marker ends_common ends_stop".split()
FRAGMENT = [*SUMS, *FLAGS]
KINDS = "item row sentence middle noise rule".split()
COUNTS = [*SUMS, "lines", *(f"{k}_lines" for k in KINDS), *(f"{k}_words" for k in KINDS), "common_ends", "stop_ends"]
NONE = -1
_at = {name: k for k, name in enumerate(FRAGMENT)}
_ct = {name: k for k, name in enumerate(COUNTS)}


FIELD = 32
MASK = (1 << FIELD) - 1


class _WordInfo(dict):
    """What a word adds to the sums, packed into one integer of 32-bit fields; computed once a word."""

    def __missing__(self, word: str) -> int:
        low, letters = word.lower(), sum(map(str.isalpha, word))
        plain = len(word) < 8 or word.isdigit() or word.isalpha() and (word.islower() or word.istitle() or word.isupper())
        size = len(word)
        parts = (low in COMMON, not plain, letters > 0, size if size > LONG else 0, size, size - letters)
        value = sum(int(x) << FIELD * k for k, x in enumerate(parts))
        if len(self) > 200_000:
            self.clear()
        if size <= 40:
            self[word] = value
        return value


_info = _WordInfo()
_EXTRA = {"bad": BAD, "tight": TIGHT, "gaps": GAPS, "cells": CELLS, "tags": TAGS, "semis": SEMIS, "arrows": ARROWS}
# a character without which the pattern finds nothing
_NEEDS = {"bad": frozenset("�¤§ƒ©ÂÃ¨¬¦?\x7f").union(map(chr, (*range(9), *range(14, 32), *range(127, 160)))), "tight": frozenset(","),
          "gaps": frozenset(" \xa0"), "cells": frozenset("<"), "tags": frozenset("#"), "semis": frozenset(";"), "arrows": frozenset("»>·/")}
Hints = tuple[dict[str, re.Pattern], tuple[str, ...]]
ALL_HINTS: Hints = (_EXTRA, CODE)


def _hints(text: str) -> Hints:
    """The rarer patterns and signs that occur in a text at all; its lines need not be searched for the others."""
    there = set(text)
    patterns = {name: p for name, p in _EXTRA.items() if not _NEEDS[name].isdisjoint(there) and p.search(text)}
    return patterns, tuple(c for c in CODE if c in text) if there.intersection('{}<>[]=_\\`~^&(;"') else ()


def fragment(text: str, hints: Hints = ALL_HINTS, begins: bool = True) -> list[int]:
    """The summary of a part of a line; ``begins``: the line begins with it."""
    solid = sum(map(len, text.split()))
    if not solid:
        return [0] * len(FRAGMENT)
    words = WORD.findall(text)
    packed = sum(map(_info.__getitem__, words))
    common, mixed, alpha, long, word_chars, digits = (packed >> FIELD * k & MASK for k in range(6))
    last = words[-1] if words else ""
    stripped = text.rstrip()
    marker = MARKER.match(text) if begins else None
    extra = {name: len(pattern.findall(text)) for name, pattern in hints[0].items()}.get
    code = sum(map((text[marker.end() :] if marker else text).count, hints[1])) if hints[1] else 0
    return [
        solid, word_chars - digits, digits, len(words), alpha, common, long, mixed, extra("bad", 0), code, len(ENDERS.findall(text)),
        text.count(",") + text.count(";") + text.count(":"), text.count("|") + text.count("│"), extra("arrows", 0), text.count("\t"),
        extra("semis", 0), extra("tight", 0), extra("gaps", 0), extra("cells", 0), extra("tags", 0), word_chars,
        int(marker is not None), int(bool(last) and _info[last] & 1 and stripped.endswith(last)), int(stripped[-1] in FINAL),
    ]


def join(a: list[int], b: list[int]) -> list[int]:
    """The summary of two neighbouring parts of a line."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    return [*(x + y for x, y in zip(a[: len(SUMS)], b[: len(SUMS)])), a[_at["marker"]], b[_at["ends_common"]], b[_at["ends_stop"]]]


def line_kind(f: list[int]) -> int:
    """Index into KINDS of a complete line that is not blank."""
    g = dict(zip(FRAGMENT, f))
    words, share = g["alpha"], g["common"] / max(1, g["words"])
    if not g["words"]:
        return KINDS.index("rule")
    code = g["code"] - 2 * g["cells"] > 0.06 * g["chars"]
    if g["cells"] >= 2:
        return KINDS.index("row")
    if not code and share < 0.3:
        marks = g["pipes"] >= 2 or g["tabs"] >= 1 or g["semis"] >= 1 or g["tight"] >= 1
        if marks or (g["gaps"] >= 1 and not g["marker"] and g["words"] / (g["gaps"] + 1) <= 6):
            return KINDS.index("row")
    parts = g["pipes"] + g["arrows"] + g["gaps"]
    if parts >= 4 and parts * 4 >= g["words"] and share < 0.3 and not g["enders"]:
        return KINDS.index("noise")
    if g["marker"] and words <= 12 and not g["enders"] > 1:
        return KINDS.index("item")
    if words >= 6 and share >= 0.15 and (g["ends_stop"] or g["enders"]):
        return KINDS.index("sentence")
    if words >= 13 and share >= 0.15 or words >= 13 and g["stops"] + g["enders"] >= words / 15 and not code:
        return KINDS.index("sentence")
    if g["words"] > 14 or code or g["words"] >= 8 and share < 0.1 and not g["stops"] + g["enders"] + g["marker"]:
        return KINDS.index("noise")
    if words >= 7 and share >= 0.15:
        return KINDS.index("middle")
    return KINDS.index("item")


def _count(counts: list[int], f: list[int], kind: int) -> None:
    for k in range(len(SUMS)):
        counts[k] += f[k]
    counts[_ct["lines"]] += 1
    counts[_ct["item_lines"] + kind] += 1
    counts[_ct["item_words"] + kind] += f[_at["words"]]
    counts[_ct["common_ends"]] += f[_at["ends_common"]]
    counts[_ct["stop_ends"]] += f[_at["ends_stop"]]


class State:
    """Partial counts of consecutive text: ``counts`` of complete lines, the ``edge`` kinds and words of
    the first and last of them, the open ``head`` and ``tail`` fragments (head alone if no line break was
    met), and up to DISTINCT + 1 distinct word hashes."""

    __slots__ = ("counts", "edge", "head", "tail", "seen")

    def __init__(self, counts: list[int], edge: list[int], head: list[int], tail: list[int], seen: list[int]) -> None:
        self.counts, self.edge, self.head, self.tail, self.seen = counts, edge, head, tail, seen

    @classmethod
    def of(cls, text: str, inside: bool = False) -> State:
        """The state of a piece; ``inside``: it goes on inside a line."""
        lines, hints = BREAK.split(text), _hints(text)
        out = cls([0] * len(COUNTS), [NONE] * 4, fragment(lines[0], hints, not inside), [], [])
        for line in lines[1:-1]:
            out.line(fragment(line, hints))
        if len(lines) > 1:
            out.tail = fragment(lines[-1], hints)
        distinct = set(WORD.findall(text[:2000]))  # more words are looked at only if these are few
        if len(distinct) <= DISTINCT:
            distinct = set(WORD.findall(text))
        out.seen = list(range(DISTINCT + 1)) if len(distinct) > DISTINCT else sorted({xxhash.xxh3_64_intdigest(w) >> 1 for w in distinct})
        return out

    def line(self, f: list[int]) -> None:
        if f[0]:
            kind = line_kind(f)
            _count(self.counts, f, kind)
            if self.edge[0] == NONE:
                self.edge[:2] = [kind, f[_at["words"]]]
            self.edge[2:] = [kind, f[_at["words"]]]

    def merge(self, other: State) -> State:
        """This text followed by ``other``, cut at a place that ``chunks`` may choose."""
        seen = list(dict.fromkeys([*self.seen, *other.seen]))[: DISTINCT + 1]
        if not self.tail:
            head = join(self.head, other.head)
            return State(other.counts, other.edge, head, other.tail, seen)
        if not other.tail:
            return State(self.counts, self.edge, self.head, join(self.tail, other.head), seen)
        out = State(self.counts[:], self.edge[:], self.head, other.tail, seen)
        out.line(join(self.tail, other.head))
        out.counts = [x + y for x, y in zip(out.counts, other.counts)]
        if other.edge[0] != NONE:
            out.edge = [*(out.edge[:2] if out.edge[0] != NONE else other.edge[:2]), *other.edge[2:]]
        return out

    def closed(self) -> dict[str, int]:
        """All counts of the whole text, with the edge lines."""
        out = State([0] * len(COUNTS), [NONE] * 4, [], [], [])
        out.line(self.head)
        first = out.edge[:2]
        out.counts = [x + y for x, y in zip(out.counts, self.counts)]
        out.edge = [*(first if first[0] != NONE else self.edge[:2]), *(self.edge[2:] if self.edge[2] != NONE else first)]
        if self.tail:
            out.line(self.tail)
        return dict(zip(COUNTS, out.counts)) | dict(zip(("first_kind", "first_words", "last_kind", "last_words"), out.edge)) | {"distinct": len(self.seen)}


def kind_of(c: dict[str, int]) -> str | None:
    """``list``, ``table`` or ``junk`` where hardly anything stands in sentences, else null."""
    if not c["lines"]:
        return None
    words, chars, lines = c["words"], c["chars"], c["lines"]
    if c["letters"] + c["digits"] < 0.3 * chars and c["row_lines"] < 2 and not c["pipes"]:
        return "junk"
    share = c["common"] / max(1, words)
    if c["bad"] > 0.12 * chars or c["long"] > 0.35 * chars and share < 0.2:
        return "junk"
    if words >= 6 and c["distinct"] <= 12 and c["distinct"] * 6 <= words:
        return "junk"
    if c["tags"] * 2 >= words and words >= 4:
        return "junk"
    if c["common_ends"] > 0.1 * lines and share >= 0.2 and c["common_ends"] >= 3:
        return None  # running text, broken anywhere
    sentence, mark = KINDS.index("sentence"), KINDS.index("middle")
    prose = c["sentence_words"]
    listed = c["item_lines"] + c["row_lines"]
    spoken = [(c[f"{k}_lines"], c[f"{k}_words"]) for k in ("item", "middle", "sentence")]
    edges = [c[f"{e}_words"] for e in ("first", "last") if lines > 2 and c[f"{e}_words"] <= HEADING and c[f"{e}_kind"] in (sentence, mark)]
    mean = (sum(w for _, w in spoken) - sum(edges)) / max(1, sum(n for n, _ in spoken) - len(edges))
    if mean >= 9 or c["middle_lines"] and listed < c["middle_lines"] and c["sentence_lines"] > c["middle_lines"]:
        prose += c["middle_words"]
    if lines > 2 and listed + c["noise_lines"] >= 2:  # a heading or a source note may stand in a sentence
        for edge in ("first", "last"):
            if c[f"{edge}_words"] > HEADING:
                continue
            if c[f"{edge}_kind"] == sentence or c[f"{edge}_kind"] == mark and prose > c["sentence_words"]:
                prose -= min(prose, c[f"{edge}_words"])
    if prose > 0.2 * words:
        return None
    if lines <= 2 and c["pipes"] + c["arrows"] + c["gaps"] >= 4 and c["digits"] * 10 < c["letters"] and not c["cells"]:
        return "junk"
    if c["code"] - 2 * c["cells"] > 0.08 * chars and not c["cells"]:
        return "junk"
    if c["mixed"] > 0.25 * words:
        return "junk"
    if lines <= 2 and words >= 8 and share <= 0.2 and not c["sentence_lines"] + c["row_lines"] + c["stops"] + c["enders"]:
        return "junk"
    noise = c["noise_words"]
    if c["row_lines"] >= 2 and c["row_lines"] >= c["item_lines"]:
        return "table" if c["row_words"] >= noise else "junk"
    if c["item_lines"] + c["middle_lines"] >= 2 and c["item_words"] + c["middle_words"] >= noise:
        return "list"
    if c["row_lines"] >= 1 and c["row_words"] >= noise and lines - c["rule_lines"] <= 3:
        return "table"
    if noise:
        return "junk"
    return None


STATE = "id long, part long, counts array<long>, edge array<long>, head array<long>, tail array<long>, seen array<long>"
_LISTS = ("counts", "edge", "head", "tail", "seen")


def _states(rows: list[tuple]) -> pa.RecordBatch:
    ids, parts, states = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(parts, pa.int64())]
        + [pa.array([getattr(s, n) for s in states], pa.list_(pa.int64())) for n in _LISTS],
        ["id", "part", *_LISTS],
    )


# places to cut (a line end, or a blank between two words; ordinals' raised letters may belong to a list marker) and tags
PLACES = re.compile(BREAK.pattern + r"|(?<=[^\W_ªº]) (?=[^\W_])|[<>]")


def chunks(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """Pieces of at most ``size`` characters, longer only where a stretch has no place to cut; with each, whether it
    goes on inside a line of the piece before."""
    at, inside = 0, False
    good: tuple[int, bool] | None = None  # the last place to cut, and whether it lies inside a line
    tag = False
    for place in PLACES.finditer(text):
        sign, end = place.group(), place.end()
        if sign in "<>":
            tag = sign == "<"
            continue
        if sign == " ":
            if tag:
                continue
        else:
            tag = False
        if end - at > size and good:
            yield text[at : good[0]], inside
            (at, inside), good = good, None
        if end - at > size:
            yield text[at:end], inside
            at, inside, good = end, sign == " ", None
        else:
            good = end, sign == " "
    if good and len(text) - at > size:
        yield text[at : good[0]], inside
        at, inside = good
    if at < len(text) or not at:
        yield text[at:], inside


STATS = (
    "id long, words long, lines long, chars long, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "stop_line_share double, common_word_share double, sentence_word_share double, item_line_share double, row_line_share double, kind string"
)


def _given(ids: list[int], states: list[State]) -> pa.RecordBatch:
    columns: dict[str, list] = {part.split()[0]: [] for part in STATS.split(", ")}
    for i, state in zip(ids, states):
        c = state.closed()
        ratio = lambda a, b: a / b if b else None
        row = (
            i, c["words"], c["lines"], c["chars"], ratio(c["word_chars"], c["words"]), ratio(c["chars"] - c["letters"] - c["digits"], c["chars"]),
            ratio(c["digits"], c["chars"]), ratio(c["stop_ends"], c["lines"]), ratio(c["common"], c["words"]), ratio(c["sentence_words"], c["words"]),
            ratio(c["item_lines"], c["lines"]), ratio(c["row_lines"], c["lines"]), kind_of(c),
        )
        for name, value in zip(columns, row):
            columns[name].append(value)
    kinds = [pa.int64()] * 4 + [pa.float64()] * 8 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds)], list(columns))


def text_statistics(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """STATS rows of ``docs(id, text)``, one for each row."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 500):
                yield _given(batch.column(0)[lo : lo + 500].to_pylist(), [State.of(t or "") for t in texts[lo : lo + 500]])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = list(chunks(text, chunk))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int64()), pa.array([h for _, h in pieces]), pa.array([p for p, _ in pieces])],
                    ["id", "part", "inside", "text"],
                )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            yield _states([(i, p, State.of(t, h)) for i, p, h, t in zip(*columns)])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        state = None
        for lists in zip(*(pdf[n] for n in _LISTS)):
            after = State(*([int(x) for x in v] for v in lists))
            state = after if state is None else state.merge(after)
        first = pdf.iloc[0]
        return pd.DataFrame([[first["id"], first["part"] // FAN, *(getattr(state, n) for n in _LISTS)]], columns=["id", "part", *_LISTS])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in range(2, 7)]
            yield _given(batch.column(0).to_pylist(), [State(*x) for x in zip(*lists)])

    docs = docs.select(F.col("id").cast("long"), F.col("text").cast("string"))
    short = docs.filter(f"text is null or length(text) <= {chunk}").mapInArrow(whole, STATS)
    long = docs.filter(f"length(text) > {chunk}")
    parts = long.mapInArrow(split, "id long, part long, inside boolean, text string").repartition("id", "part")
    states = cut(parts.mapInArrow(partial, STATE), "chunks")
    number = (states.agg(F.max("part")).first()[0] or 0) + 1
    while number > 1:
        states = states.groupBy("id", F.floor(F.col("part") / FAN).alias("node")).applyInPandas(lambda pdf: merged(pdf), STATE)
        number = -(-number // FAN)
    return short.union(states.mapInArrow(closed, STATS))
