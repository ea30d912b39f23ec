"""Several values packed in one field: dialects are chosen by minimum description length.

A dialect is a set of delimiters, with or without quotes, or a bracketed list. Every distinct field is cut at every
delimiter it contains; each stretch that is a value under some set of delimiters is counted over all fields. A value's
code length is the negative logarithm of its share, and what no code book holds is spelled out at ``CHAR_BITS`` a character.
A field's dialect is the one whose cheapest reading costs least, over all sets of the delimiters in the field. Within a
dialect unquoted neighbours may be read as one value of the code book that holds the delimiter itself, as in "Arts,
Crafts" among plain names; that costs ``INNER_BITS`` for each delimiter. The code book says how far such a value reaches.

Fields are cut once per distinct content. Only cutting and the choice within one field run in Python (on Arrow batches);
counting and looking up code lengths are joins and map-side combined aggregates. The stretches of a field grow with its
length times the number of its delimiters, not with the number of dialects.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import SPACE, squeezed
from tallyloom.session import written

# What may separate values, and what may quote them.
DELIMITERS = ",;|/\n\r\t\u3001\uff0c\uff1b\uff5c\u2022\u00b7"
QUOTES = "\"'"
CHAR_BITS = 8.0
INNER_BITS = 2.0
DELIMITER_BITS = 3.0
QUOTE_BITS = 3.0


def _unquoted(body: str, quote: str) -> str:
    return re.sub(r"\\(.)", r"\1", body.replace(quote * 2, quote), flags=re.S)


class Cut(NamedTuple):
    """A text cut at every delimiter: the pieces as (start, end, value), value being None for an unquoted piece, and the
    delimiter after each piece, "" after the last. ``closing`` are the delimiters that may follow a closing quote."""

    text: str
    quote: str
    closing: str
    pieces: list[tuple[int, int, str | None]]
    after: list[str]

    def value(self, i: int, j: int) -> tuple[str, bool]:
        """What pieces i to j - 1 are as one value ("" if blank), and whether that is a quoted one."""
        full = [p for p in self.pieces[i:j] if p[2] is not None or self.text[p[0] : p[1]].strip()]
        if len(full) == 1 and full[0][2] is not None:
            return full[0][2] if full[0][2].strip() else "", True
        return (self.text[full[0][0] : full[-1][1]].strip() if full else ""), False


def cut(text: str, delimiters: str, quote: str = "", closing: str = "") -> Cut:
    """``text`` cut at ``delimiters``. A quoted piece ends with a quote that one of ``closing``, or the end, follows."""
    plain = rf"([^{re.escape(delimiters)}]*)([{re.escape(delimiters)}]|\Z)" if delimiters else r"(.*)(\Z)"
    pattern = rf"(?s:{plain})"
    if quote:
        stop = rf"[^\S{re.escape(closing)}]*([{re.escape(closing)}]|\Z)" if closing else r"\s*(\Z)"
        pattern = rf"(?s:[^\S{re.escape(delimiters)}]*{quote}(.*?)(?<!\\){quote}{stop}|{plain})"
    pieces, after = [], []
    for m in re.finditer(pattern, text):
        if quote and m[1] is not None:
            pieces.append((m.start(), m.end() - len(m[2]), _unquoted(m[1], quote)))
        else:
            pieces.append((m.start(m.lastindex - 1), m.end(m.lastindex - 1), None))
        after.append(m[m.lastindex] if not (quote and m[1] is not None) else m[2])
        if not after[-1]:
            break
    return Cut(text, quote, closing, pieces, after)


def _following(text: str, quote: str) -> list[str]:
    """The delimiters that follow a quote somewhere, with nothing but white space between."""
    return [d for d in DELIMITERS if d in "".join(re.findall(rf"{quote}(\s*\S?)", text))]


def cuts(text: str) -> list[Cut]:
    """The ways to tell quoted pieces from plain ones, plainest first: without quotes, and for each quote with each set of
    the delimiters that follow one somewhere."""
    seen = "".join(d for d in DELIMITERS if d in text)
    out = [cut(text, seen)]
    for q in (q for q in QUOTES if text.count(q) > 1):
        follow = _following(text, q)
        out += [cut(text, seen, q, "".join(c)) for k in range(len(follow) + 1) for c in combinations(follow, k)]
    return out


def listed(text: str) -> list[list[str] | Cut]:
    """The readings of a bracketed list: as JSON, else cut at commas, with each quote."""
    body = text.strip()
    if body[:1] != "[" or body[-1:] != "]" or len(body) < 2:
        return []
    try:
        values = json.loads(body)
        if all(isinstance(v, str) for v in values):
            return [[v for v in values if v.strip()]]
    except ValueError:
        pass
    body = body[1:-1]
    return [cut(body, ",", q, "," if q else "") for q in ("", *(q for q in QUOTES if body.count(q) > 1))]


def _stretches(c: Cut) -> Iterator[tuple[int, int]]:
    """Every (i, j) such that pieces i to j - 1 are one piece under some set of delimiters: none of the two delimiters at
    its ends stands inside. At most one end per start and delimiter."""
    for i in range(len(c.pieces)):
        inside: set[str] = set()
        for j in range(i, len(c.pieces)):
            d = c.after[j]
            if d not in inside:
                yield i, j + 1
            inside.add(d)
            if i and d == c.after[i - 1]:
                break


def _reach(c: Cut, marks: int, blanks: int) -> int:
    """How many pieces a value of the code book may span: one more than it holds delimiters, or blanks if some are cut at."""
    return 1 + marks + (blanks if any(d.isspace() for d in c.after) else 0)


def candidates(text: str, marks: int, blanks: int) -> dict[str, bool]:
    """The values that readings of ``text`` may hold, each with whether it is one piece of some dialect. Values that span
    pieces hold at most ``marks`` delimiters and ``blanks`` blanks."""
    found: dict[str, bool] = {}
    for c in [*cuts(text), *listed(text)]:
        if isinstance(c, list):
            found.update(dict.fromkeys(c, True))
            continue
        reach = _reach(c, marks, blanks)
        for i in range(len(c.pieces)):
            for j in range(i + 2, min(i + reach, len(c.pieces)) + 1):
                found.setdefault(c.value(i, j)[0], False)
        for i, j in _stretches(c):
            found[c.value(i, j)[0]] = True
    found.pop("", None)
    return found


def _cheapest_under(c: Cut, used: frozenset[str], bits: Callable[[str], float | None], book: Callable[[str], float | None], reach: int) -> tuple[float, list[str]]:
    """The cheapest reading of a cut under a set of delimiters: its cost without the dialect's own, and its values."""
    ends = [j + 1 for j, d in enumerate(c.after) if d in used or not d]
    starts = [0, *ends]
    cost = [0.0] + [float("inf")] * len(ends)
    back: list[tuple[int, str]] = [(0, "")] * len(starts)
    for k, i in enumerate(starts[:-1]):
        value, quoted = c.value(i, starts[k + 1])
        one = bits(value) if value else 0.0
        if one is not None and cost[k] + one < cost[k + 1]:
            cost[k + 1], back[k + 1] = cost[k] + one, (k, value)
        if quoted or not value:
            continue
        for n in range(k + 2, len(starts)):
            if starts[n] - i > reach:
                break
            whole, last = c.value(i, starts[n]), c.value(starts[n - 1], starts[n])
            if last[1]:
                break
            if last[0] and (price := book(whole[0])) is not None and cost[k] + price + INNER_BITS * (n - k - 1) < cost[n]:
                cost[n], back[n] = cost[k] + price + INNER_BITS * (n - k - 1), (k, whole[0])
    values, at = [], len(ends)
    while at:
        at, value = back[at]
        if value:
            values.append(value)
    return cost[-1], values[::-1]


def _least_cost(c: Cut, bits: Callable[[str], float | None], book: Callable[[str], float | None], reach: int) -> float:
    """No reading of a cut costs less, whatever the set of delimiters: every stretch may stand beside every other."""
    cost = [0.0] + [float("inf")] * len(c.pieces)
    ends: dict[int, list[tuple[int, bool]]] = {}
    for i, j in _stretches(c):
        ends.setdefault(i, []).append((j, True))
    for i in range(len(c.pieces)):
        for j, single in [*ends.get(i, ()), *((j, False) for j in range(i + 2, min(i + reach, len(c.pieces)) + 1))]:
            value = c.value(i, j)[0]
            price = 0.0 if not value else bits(value) if single else book(value)
            if price is not None:
                cost[j] = min(cost[j], cost[i] + price)
    return cost[-1]


def cheapest(text: str, prices: dict[str, tuple[float, bool]], marks: int, blanks: int) -> tuple[str, str, float, list[str]]:
    """Delimiters, quote, cost and values of the cheapest reading; ties to the plainest dialect. ``prices`` gives each value's
    bits and whether the code book holds it. All sets of a cut's delimiters count; they are tried by size, and no larger
    ones once their own cost and the least a reading costs can't beat the best."""
    bits = lambda v: prices[v][0] if v in prices else None
    book = lambda v: prices[v][0] if v in prices and prices[v][1] else None
    best: tuple[str, str, float, list[str]] = ("", "", float("inf"), [])
    for c in cuts(text):
        reach = _reach(c, marks, blanks)
        follow = _following(text, c.quote) if c.quote else []
        free = [d for d in DELIMITERS if d in c.after and d not in follow]
        least = _least_cost(c, bits, book, reach)
        for k in range(len(free) + 1):
            own = DELIMITER_BITS * (k + len(c.closing)) + (QUOTE_BITS if c.quote else 0.0)
            if own + least >= best[2] - 1e-9:
                break
            for more in combinations(free, k):
                cost, values = _cheapest_under(c, frozenset([*more, *c.closing]), bits, book, reach)
                if own + cost < best[2] - 1e-9:
                    best = ("".join(sorted([*more, *c.closing], key=DELIMITERS.index)), c.quote, own + cost, values)
    for c in listed(text):
        if isinstance(c, list):
            quote, cost, values = "", sum(bits(v) for v in c), c
        else:
            quote, (cost, values) = c.quote, _cheapest_under(c, frozenset(","), bits, book, _reach(c, marks, blanks))
        cost += DELIMITER_BITS + (QUOTE_BITS if quote else 0.0)
        if cost < best[2] - 1e-9:
            best = ("[", quote, cost, values)
    return best


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _values(marks: int, blanks: int):
    kinds = {"field": pa.string(), "weight": pa.int64(), "value": pa.string(), "single": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for field, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(field, weight, v, single) for v, single in candidates(field, marks, blanks).items()]
                if len(rows) > 20_000:
                    yield _table(rows, kinds)
                    rows = []
            yield _table(rows, kinds)

    return run


def _choose(marks: int, blanks: int):
    kinds = {"field": pa.string(), "pos": pa.int32(), "value": pa.string(), "delimiters": pa.string(), "quote": pa.string(), "bits": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for field, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                delimiters, quote, cost, chosen = cheapest(field, {v["value"]: (v["bits"], v["known"]) for v in values}, marks, blanks)
                out += [(field, i + 1, v, delimiters, quote, cost) for i, v in enumerate(chosen)]
            yield _table(out, kinds)

    return run


def unpacked(df: DataFrame, key: str, field: str, vocabulary: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """``(key, pos, value, delimiters, quote, bits)``: one row per value packed in ``field``, ``pos`` counting from 1.

    ``vocabulary`` (column ``name``) is the code book, if there is one: its values are coded by their frequency and others
    spelled out. Without it, the code book is every value that stands in two fields or more, its spelling shared out among
    them. Values are compared by :func:`~tallyloom.functions.text.squeezed` and come out as written, without quotes,
    escapes and surrounding white space; ``name`` in the vocabulary may repeat, null and blank names are ignored.

    Null and blank fields, and fields of nothing but delimiters, have no values; empty places aren't counted by ``pos``; a
    value that occurs twice comes out twice. Repeated rows come out as often as they occur. An empty table gives no rows."""
    rows = df.select(df[key].alias("key"), df[field].cast("string").alias("field"))
    fields = rows.where("field is not null").groupBy("field").agg(F.count("*").alias("weight"))
    spelled = F.lit(CHAR_BITS) * F.length("plain")
    marks = lambda c: F.length(c) - F.length(F.translate(c, DELIMITERS, ""))
    blanks = lambda c: F.size(F.split(F.trim(c), rf"[{SPACE}]+")) - 1
    found = "field string, weight bigint, value string, single boolean"

    def values(reach: tuple[int, int]) -> DataFrame:
        return written(fields.mapInArrow(_values(*reach), found).select("*", squeezed(F.col("value")).alias("plain")))

    def counted(of: DataFrame) -> tuple[DataFrame, float]:
        single = of.where("single")
        return single.groupBy("plain").agg(F.sum("weight").alias("n"), F.max(marks("value")).alias("marks")), float(single.agg(F.sum("weight")).first()[0] or 1)

    # How far a value of the code book reaches: two numbers.
    if vocabulary is not None:
        names = vocabulary.select(vocabulary[name].cast("string").alias("name")).withColumn("plain", squeezed(F.col("name"))).where("plain <> ''")
        reach = tuple(x or 0 for x in names.agg(F.max(marks("name")), F.max(blanks("plain"))).first())
        spans = values(reach)
        counts, total = counted(spans)
        book = names.select("plain").distinct().join(counts, "plain", "left").select("plain", F.log2(F.lit(total + 1) / (F.coalesce("n", F.lit(0)) + 1)).alias("bits"))
    else:
        counts, total = counted(values((0, 0)))
        known = counts.where("n > 1")
        reach = tuple(x or 0 for x in known.agg(F.max("marks"), F.max(blanks("plain"))).first())
        book = written(known.select("plain", (F.log2(F.lit(total + 1) / F.col("n")) + spelled / F.col("n")).alias("bits")))
        spans = values(reach)
    coded = spans.join(book, "plain", "left").where(F.col("single") | F.col("bits").isNotNull())
    coded = coded.select("field", "value", F.coalesce("bits", F.log2(F.lit(total + 1)) + spelled).alias("bits"), F.col("bits").isNotNull().alias("known"))
    gathered = coded.groupBy("field").agg(F.collect_list(F.struct("value", "bits", "known")).alias("values"))
    chosen = gathered.mapInArrow(_choose(*reach), "field string, pos int, value string, delimiters string, quote string, bits double")
    tidy = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return rows.join(chosen, "field").select(F.col("key").alias(key), "pos", tidy.alias("value"), "delimiters", "quote", "bits")
