"""Benchmark decontamination: texts streamed through a suffix automaton of the benchmark items.

An item's window is ``window`` consecutive words, or the whole item if it has fewer. Texts and items
are lower-cased in A-Z and read as words of ASCII digits, letters and non-ASCII characters. A word
inside an occurrence of a window is hit. Defined results: null and empty texts have no words and no
hits; items without words match nothing; rows that repeat are judged alike, each for itself; items
sharing an item_id count once and a null item_id counts as the empty id. Only the text column is
read, so other columns may have any names but ``FOUND``.

The automata are sent to the executors: items are cut into blocks of at most ``BLOCK_WORDS`` words
(one longer item makes a block of its own), one automaton and one pass over the texts per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.automaton import NEVER, SuffixAutomaton
from sluice.llm.common import ALNUM_TABLE, alnum_words, utf8
from sluice.session import written

WINDOW = 10
BLOCK_WORDS = 500_000
MAX_COVERAGE = 0.5
FOUND = "__benchmark_found"
WORD = re.compile(rb"[^ ]+")


class Items:
    """The automaton of one block of items and what an alarm in a state means."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.automaton = SuffixAutomaton([words for _, words in items])
        link, length = self.automaton.link, self.automaton.length
        owners: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for item_id, words in items:
            for n, state in self.automaton.prefixes(words):
                if n >= window:
                    owners.setdefault(self.window_state(state), set()).add(item_id)
            if len(words) < window:
                whole.setdefault(state, set()).add(item_id)
        # Per state: the items whose window ends here, and (words, items) of short items that end here.
        self.owners = {s: owners[self.window_state(s)] for s in range(1, len(link)) if length[s] >= window}
        self.short = {}
        self.limit = [NEVER] * len(link)
        for s in range(1, len(link)):
            short = [(length[t], whole[t]) for t in self.automaton.suffixes(s) if t in whole]
            if short:
                self.short[s] = short
            self.limit[s] = min([n for n, _ in short] + [window] * (length[s] >= window), default=NEVER)

    def window_state(self, state: int) -> int:
        link, length = self.automaton.link, self.automaton.length
        while length[link[state]] >= self.window:
            state = link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged (first, last + 1) spans of hit words, and the ids of the items that occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        for i, state, length in self.automaton.alarms(words, self.limit):
            reach = 0
            if length >= self.window:
                reach = self.window
                found |= self.owners[state]
            for n, ids in self.short.get(state, ()):
                if n <= length:
                    reach = max(reach, n)
                    found |= ids
            first = i + 1 - reach
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append([first, i + 1])
        return spans, found


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(map(list, spans)):
        if out and out[-1][1] >= first:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([first, end])
    return out


def without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text.translate(ALNUM_TABLE))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[str, list[bytes]]] = []
    total = 0
    chosen = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), utf8().alias("text")).distinct()
    for row in chosen.toLocalIterator():
        words = alnum_words(bytes(row["text"]))
        if not words:
            continue
        if block and total + len(words) > block_words:
            yield block
            block, total = [], 0
        block.append((row["id"], words))
        total += len(words)
    yield block


def ended(elements: Iterator) -> Iterator[tuple]:
    """Every element of some, with whether it is the last one."""
    before = next(elements)
    for element in elements:
        yield before, False
        before = element
    yield before, True


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """``docs`` with the struct ``FOUND``: n_words, spans (flat word positions), items (sorted ids), and kept: with
    ``cut``, a text with hits without its spans, else null.

    The pass over the last block also cuts, so a task needs one Python worker. Spark would run a deterministic
    function once more, in further workers, for a filter on its result.
    """
    kind = "n_words long, spans array<int>, items array<string>, kept string"
    out = docs.withColumn(FOUND, F.lit(None).cast(f"struct<{kind}>"))
    for number, (block, last) in enumerate(ended(blocks(items, block_words))):
        if number:
            out = written(out, "decontaminate")
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(Items(block, window))
        cuts = cut and last

        @F.pandas_udf(kind)
        def found(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
            matcher = shared.value
            for texts, before in batches:
                rows = []
                for text, old_spans, old_items in zip(texts, before["spans"], before["items"]):
                    words = alnum_words(text)
                    spans, ids = matcher.hits(words)
                    if old_spans is not None and len(old_spans):
                        spans = merged([*spans, *zip(old_spans[::2], old_spans[1::2])])
                        ids = ids | set(old_items)
                    kept = without(text, spans).decode("utf-8", "replace") if cuts and spans else None
                    rows.append((len(words), [int(x) for span in spans for x in span], sorted(ids), kept))
                yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "kept"])

        out = out.withColumn(FOUND, found.asNondeterministic()(utf8(), F.col(FOUND)))
    return out


def hit_words() -> Column:
    """Words inside spans: first, end, first, end ... summed with alternating signs, which ends on a plus."""
    return F.aggregate(f"{FOUND}.spans", F.lit(0).cast("long"), lambda total, x: x.cast("long") - total)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    ids = F.col(f"{FOUND}.items")
    return (
        scan(docs, items, window)
        .select(
            "doc_id", F.col(f"{FOUND}.n_words").alias("n_words"), hit_words().alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``; rows with more than ``max_coverage`` of their words hit go.

    ``n_chars``, if there, is counted anew for texts that were cut; null texts stay null.
    """
    spans = F.col(f"{FOUND}.spans")
    out = scan(docs, items, window, cut=True).where(hit_words() <= F.col(f"{FOUND}.n_words") * F.lit(max_coverage))
    out = out.withColumn("text", F.when(F.size(spans) > 0, F.col(f"{FOUND}.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

