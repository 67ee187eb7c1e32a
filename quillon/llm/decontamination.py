"""Benchmark decontamination by approximate matching of whole test items.

An item of n characters may differ by k = floor(n * RATE) edits.  Cut into k + 1 pieces, at least one piece
of any such copy is unchanged, so an Aho-Corasick automaton over all pieces finds every place worth
looking at; Myers' bit-parallel edit distance then measures the item against the text around it.  Both
sides are compared as plain words: lower case, ASCII punctuation as blanks, single blanks between.  An
item of under LEAST_CHARS characters has no budget: it must stand there as it is, between word boundaries.

Items are filed in blocks of bounded size in shared storage.  The documents are scanned once: a task holds
BUFFER_BYTES of texts and lets one block after the other search them, so neither the driver nor a task
ever holds more than a block of items, however large the benchmark is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import file_system, new_path, store
from .words import plain

RATE, LEAST_CHARS = 0.05, 20
BLOCK_BYTES, BUFFER_BYTES = 4 << 20, 32 << 20
HITS = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def budget(n: int, rate: float = RATE) -> int:
    return int(n * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of about equal length that make up the item."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``text`` where ``pattern`` ends within ``k`` edits; the first of equals.

    Myers' algorithm with the whole pattern in one big integer; the text may start anywhere.
    """
    m = len(pattern)
    if not m:
        return None
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= k and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """Automaton and pieces of a block of items (id, plain text, rows of it)."""

    def __init__(self, items: Sequence[tuple[int, str, int]], rate: float):
        import ahocorasick

        self.items, places = [(i, t, budget(len(t), rate) if len(t) >= LEAST_CHARS else 0, n) for i, t, n in items], {}
        for at, (_, text, k, _) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                places.setdefault(piece, []).append((at, offset))
        self.auto = ahocorasick.Automaton()
        for piece, at in places.items():
            self.auto.add_word(piece, (len(piece), at))
        if places:
            self.auto.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> list[dict]:
        """The best match of each item that the whole text holds within its budget."""
        s = plain(text)
        if self.empty or not s:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, at) in self.auto.iter(s):
            for n, offset in at:
                starts.setdefault(n, set()).add(end - size + 1 - offset)
        out = []
        for n, wanted in starts.items():
            item, pattern, k, rows = self.items[n]
            best, done = None, -1
            if len(pattern) < LEAST_CHARS:
                wanted = [a for a in wanted if s[a - 1 : a] in ("", " ") and s[a + len(pattern) : a + len(pattern) + 1] in ("", " ")]
            for start in sorted(wanted):
                # the match of one piece fixes where the item starts, up to k; neighbours share a window
                lo, hi = max(0, start - k), min(len(s), start + len(pattern) + k)
                if hi <= done:
                    continue
                if s.startswith(pattern, max(0, start)) and start >= 0:
                    best = (0, start, start + len(pattern))
                    break
                done = hi
                if (found := myers(pattern, s[lo:hi], k)) and (best is None or found[0] < best[0]):
                    best = found[0], start, lo + found[1]
            if best:
                out += [{"item_id": item, "distance": best[0], "start": max(0, best[1]), "end": best[2]}] * rows
        return sorted(out, key=lambda h: (h["item_id"] is None, h["item_id"]))


@dataclass(frozen=True)
class Block:
    """A file of items in shared storage; its length is the number of different (id, text) in it."""

    path: str
    items: int

    def __len__(self) -> int:
        return self.items

    def load(self) -> list[tuple[int, str, int]]:
        import pyarrow as pa

        fs, path = file_system(self.path)
        with fs.open_input_stream(path, compression=None) as f:
            return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(f).read_all().columns), strict=True))


def item_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, short: bool = False) -> list[Block]:
    """Files of the test items' plain texts, of about ``block_bytes`` each; only their names come to the driver.

    ``short`` picks the items of under LEAST_CHARS characters instead of the others.  Equal rows become one
    with a count.  Null texts and those without a word hold nothing to look for.
    """
    folder = new_path(benchmark.sparkSession, "items")

    @F.pandas_udf("string")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([plain(t) for t in texts], dtype=object)

    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("text"))
    size = F.length("text")
    rows = store(rows.where((size > 0) & (size < LEAST_CHARS if short else size >= LEAST_CHARS)).groupBy("id", "text").agg(F.count("*").alias("n")), "items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches) -> Iterator:
        import pyarrow as pa

        held, held_bytes = [], 0

        def close():
            path = f"{folder}/{uuid.uuid4().hex}.arrow"
            fs, p = file_system(path)
            fs.create_dir(p.rpartition("/")[0], recursive=True)
            whole = pa.Table.from_batches(held)
            with fs.open_output_stream(p, compression=None) as f, pa.ipc.new_stream(f, whole.schema) as w:
                w.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([whole.num_rows], pa.int64())], names=["path", "items"])

        for batch in batches:
            sizes = batch.column(1).to_pylist()
            first = 0
            for i, t in enumerate(sizes):
                held_bytes += len(t)
                if held_bytes >= block_bytes:
                    held.append(batch.slice(first, i + 1 - first))
                    yield close()
                    held, held_bytes, first = [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield close()

    # by a hash of id and text, both distinct here, so that no block is hot
    spread = rows.repartition(max(1, -(-total // block_bytes)), F.xxhash64("id", "text")).sortWithinPartitions("id", "text")
    manifest = store(spread.mapInArrow(write, "path string, items long"), "item-blocks")
    return [Block(*r) for r in manifest.orderBy("path").collect()]


def hits(text: Column, blocks: Sequence[Block], rate: float = RATE) -> Column:
    """Array of the items that a whole text holds, by id.

    One pass over the texts: the task holds some of them and lets each block search them in turn.
    """

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: list[Matcher] = []  # a single block stays loaded

        def search(held: list[pd.Series]) -> Iterator[pd.Series]:
            found = [[[] for _ in texts] for texts in held]
            for block in blocks:
                matcher = kept[0] if kept else Matcher(block.load(), rate)
                if len(blocks) == 1:
                    kept[:] = [matcher]
                for texts, own in zip(held, found, strict=True):
                    for t, f in zip(texts, own, strict=True):
                        f += matcher.find(t)
            for own in found:
                yield pd.Series([sorted(f, key=lambda h: (h["item_id"] is None, h["item_id"], h["distance"], h["end"])) for f in own], dtype=object)

        held, size = [], 0
        for texts in batches:
            held.append(texts)
            size += sum(len(t) for t in texts if t is not None)
            if len(blocks) == 1 or size >= BUFFER_BYTES:
                yield from search(held)
                held, size = [], 0
        yield from search(held)

    return find(text)


def _all_blocks(benchmark: DataFrame) -> list[Block]:
    return [*item_blocks(benchmark), *item_blocks(benchmark, short=True)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each test item that a document holds within its edit budget.

    ``start`` (of the anchor) and ``end`` count characters of the document's plain text.  Null and empty
    texts hold nothing, and null items or ones without a word are held by nothing; an empty table on either
    side gives no row.  Repeated documents each report; repeated items report once a row of theirs.  Of
    equally good places the first counts.  Other columns, whatever their names, are ignored.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(hits(F.col(text_col), _all_blocks(benchmark), rate)).alias("h"))
    return found.select("doc_id", "h.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Docs that hold no test item; same columns, no shuffle.

    Null and empty texts hold none and stay, as does everything if the benchmark is empty; repeated rows
    stand or fall together.  Long texts are searched whole.  No column is added, so none can clash.
    """
    return docs.where(F.size(hits(F.col(text_col), _all_blocks(benchmark), rate)) == 0)
