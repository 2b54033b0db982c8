"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test texts."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches, keeps, only
from sunmesh.sources.tables import materialise

#: Consecutive words of an item that make a window.
WINDOW = 10
#: Bytes of item texts in one automaton; more items are scanned by several passes, each with its own.
AUTOMATON_BYTES = 8 << 20

# A-Z in lower case; every byte that is no digit, letter or part of a non-ASCII character is a space.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Windows:
    """The windows of a set of items, searched all at once."""

    def __init__(self, items: list[tuple[str, str | None]]):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        sizes: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            n = min(WINDOW, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                key = b" ".join(words[i : i + n])
                owners.setdefault(key, set()).add(item)
                sizes[key] = n
        self.automaton = ahocorasick.Automaton()
        for key, who in owners.items():
            # Latin-1 makes one character of each byte.
            self.automaton.add_word(f" {key.decode('latin-1')} ", (sizes[key], tuple(sorted(who))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """``(begin, end)`` word ranges of all occurrences, and the items they belong to."""
        if self.empty or not words:
            return np.zeros((0, 2), np.int64), set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return np.zeros((0, 2), np.int64), set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.searchsorted(spaces, [e for e, _ in found])
        sizes = np.array([n for _, (n, _) in found])
        return np.stack([ends - sizes, ends], 1), {i for _, (_, who) in found for i in who}


def merged(ranges: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges as one."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    begin = np.flatnonzero(first)
    return np.stack([ranges[begin, 0], reach[np.concatenate([begin[1:], [len(ranges)]]) - 1]], 1)


def character_spans(text: str, ranges: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges as character offsets of the original text."""
    data = text.encode()
    places = [m.span() for m in _RUN.finditer(data.translate(_TABLE))]
    return [(len(data[: places[a][0]].decode()), len(data[: places[b - 1][1]].decode())) for a, b in ranges.tolist()]


_automata: dict[tuple, Windows] = {}
keeps("automata", _automata.clear)

_SPANS = "_spans array<struct<word_begin:int,word_end:int,char_begin:int,char_end:int>>"
_STRUCT = pa.struct([("word_begin", pa.int32()), ("word_end", pa.int32()), ("char_begin", pa.int32()), ("char_end", pa.int32())])


def _scan(items, text_at: int, first: bool):
    """Append what one automaton finds; later passes add to what the earlier ones found."""

    def run(batches):
        only("automata")
        key = tuple(items.value)
        if key not in _automata:
            _automata.clear()
            _automata[key] = Windows(items.value)
        windows = _automata[key]
        for batch in batches:
            kept = batch.columns if first else batch.columns[:-3]
            before = [None] * batch.num_rows if first else list(zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist()))
            counts, spans, names = [], [], []
            for text, earlier in zip(batch.column(text_at).to_pylist(), before):
                words = words_of(text)
                ranges, who = windows.find(words)
                if earlier:
                    old = [(s["word_begin"], s["word_end"]) for s in earlier[0]]
                    ranges, who = np.concatenate([ranges, np.array(old, np.int64).reshape(-1, 2)]), who | set(earlier[1])
                ranges = merged(ranges)
                counts.append(len(words))
                places = character_spans(text, ranges) if len(ranges) else []
                spans.append([dict(zip(("word_begin", "word_end", "char_begin", "char_end"), (a, b, *p))) for (a, b), p in zip(ranges.tolist(), places)])
                names.append(sorted(who, key=lambda i: (i is None, i or "")))
            found = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_STRUCT)), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[f"c{i}" for i in range(len(kept) + 3)])

    return run


def _slices(benchmark: DataFrame, limit: int):
    """Items in slices of bounded size, read one after the other."""
    items, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").distinct()
    for row in rows.toLocalIterator():
        items.append((row["i"], row["text"]))
        held += len((row["text"] or "").encode()) + len(row["i"] or "")
        if held >= limit:
            yield items
            items, held = [], 0
    if items:
        yield items


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``n_words, spans, items`` added.

    ``spans`` are the merged places where windows of ``benchmark`` (``item_id,
    text``) occur, in words and in characters of the original text; ``items``
    the ids, as strings, of the items these windows belong to. Words are runs of
    digits, letters and non-ASCII characters with A-Z in lower case. An item of
    fewer than ten words is one window, one without words has none; null texts
    have no words, and a null id is an item of its own. Repeated items count once, repeated documents each get a
    row; an empty benchmark finds nothing. Columns of ``docs`` may have any
    names. No shuffle: each text is scanned once for every ``automaton_bytes``
    of item texts, so what is broadcast, and what is on the driver, is bounded;
    between two scans the table is stored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = docs.columns
    # Positions stand for names, so that clashing ones are no matter.
    current = docs.toDF(*(f"c{i}" for i in range(len(names))))
    width, at, first = len(names), names.index(text), True
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    for items in itertools.chain(_slices(benchmark, automaton_bytes), [None]):
        if items is None and not first:
            break
        if not first:
            current = materialise(current, "scanned")
        schema = f"{fields}, c{width} bigint, {_SPANS.replace('_spans', f'c{width + 1}')}, c{width + 2} array<string>"
        current = current.mapInArrow(_scan(spark.sparkContext.broadcast(items or []), at, first), schema)
        first = False
    return current.toDF(*names, "n_words", "spans", "items")


def n_hit(spans: Column) -> Column:
    """Words inside occurrences."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["word_end"] - s["word_begin"])
