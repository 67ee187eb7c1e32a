"""Token counts that survive edits: a segment tree of pre-tokens for each document.

A leaf holds a run of pre-tokens (their lengths and token counts); inner nodes hold the sums of
characters and tokens below them.  An edit finds its place by walking down the character sums, splits
only the touched pre-tokens plus a little context again, encodes only those, and adds the difference to
the sums on the way up.  Context: a pre-token depends on its own characters and at most the two that
follow (and a special token's string, where there is one), so splitting starts at the pre-token three
characters before the edit and stops as soon as a new boundary meets an old one behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import local_schema, put_back, set_aside
from .tokenizing import SPECIAL, encoder

LEAF = 64
CONTEXT = 3
RESULT = "n_tokens long, n_tokens_after long, n_chars_after long, n_pre_tokens long, n_reencoded_chars long"
TREE = "text string, chars binary, tokens binary"
EDITS = "array<struct<pos:int,del:int,ins:string>>"


class SegmentTree:
    """Sums of characters and tokens over leaves of up to LEAF pre-tokens."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.build([(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])])

    def build(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.leaves, self.size = leaves, 1
        while self.size < len(leaves):
            self.size *= 2
        self.c, self.t = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (c, t) in enumerate(leaves):
            self.c[self.size + i], self.t[self.size + i] = sum(c), sum(t)
        for i in range(self.size - 1, 0, -1):
            self.c[i], self.t[i] = self.c[2 * i] + self.c[2 * i + 1], self.t[2 * i] + self.t[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.c[1]

    @property
    def n_tokens(self) -> int:
        return self.t[1]

    def find(self, pos: int) -> tuple[int, int, int]:
        """(leaf, place in it, first character) of the pre-token that holds character ``pos``; past the end: one behind the last."""
        if pos >= self.c[1]:
            last = len(self.leaves) - 1
            return last, len(self.leaves[last][0]), self.c[1]
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if pos >= start + self.c[node]:
                start += self.c[node]
                node += 1
        chars = self.leaves[node - self.size][0]
        for k, n in enumerate(chars):
            if pos < start + n:
                return node - self.size, k, start
            start += n
        raise AssertionError("sums don't match the leaves")

    def set_leaf(self, i: int, chars: list[int], tokens: list[int]) -> None:
        """Put new pre-tokens in a leaf; only the sums above it change."""
        node = self.size + i
        dc, dt = sum(chars) - self.c[node], sum(tokens) - self.t[node]
        self.leaves[i] = (chars, tokens)
        while node:
            self.c[node] += dc
            self.t[node] += dt
            node //= 2

    def replace(self, first: tuple[int, int], last: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """Put new pre-tokens in place of those from ``first`` up to, not including, ``last``."""
        (i, a), (j, b) = first, last
        if i == j:
            c, t = self.leaves[i]
            self.set_leaf(i, c[:a] + chars + c[b:], t[:a] + tokens + t[b:])
        else:
            c, t = self.leaves[j]
            rest = c[b:], t[b:]
            for k in range(i + 1, j):
                self.set_leaf(k, [], [])
            self.set_leaf(j, *rest)
            c, t = self.leaves[i]
            self.set_leaf(i, c[:a] + chars, t[:a] + tokens)
        if len(self.leaves[i][0]) > 8 * LEAF:
            c, t = [x for leaf in self.leaves for x in leaf[0]], [x for leaf in self.leaves for x in leaf[1]]
            self.__init__(c, t)


class Document:
    """A text with its tree."""

    def __init__(self, enc, text: str, tree: SegmentTree | None = None):
        self.enc, self.text, self.reencoded = enc, text, 0
        self.form = enc.form(text)
        if not enc.plain:
            tree = SegmentTree([len(text)] if text else [], [len(enc.ids(text))] if text else [])
        elif tree is None:
            pieces = enc.pattern(self.form).findall(text)
            tree = SegmentTree(list(map(len, pieces)), enc.counts(pieces))
        self.tree = tree

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters at ``pos`` by ``insert``; both ends are clamped to the text."""
        pos = max(0, min(pos, len(self.text)))
        end = min(len(self.text), pos + max(0, delete))
        new = self.text[:pos] + insert + self.text[end:]
        enc, reach = self.enc, self.enc.reach
        if not enc.plain:
            self.__dict__ |= vars(Document(enc, new)) | {"reencoded": self.reencoded + len(new)}
            return
        # a special string that the edit makes lies around it; one that the edit breaks has set the form before
        self.form = max(self.form, enc.form(insert), enc.form(new[max(0, pos - reach) : pos + len(insert) + reach]))
        tree, shift = self.tree, len(insert) - (end - pos)
        i, a, start = tree.find(max(0, pos - CONTEXT - reach * (self.form == SPECIAL)))
        j, b, old = tree.find(end)
        pieces, at = [], start
        for m in enc.pattern(self.form).finditer(new, start):
            while old < at - shift or old < end:  # the first old boundary not before the new one
                if b >= len(tree.leaves[j][0]):
                    if j + 1 >= len(tree.leaves):
                        break
                    j, b = j + 1, 0
                    continue
                old += tree.leaves[j][0][b]
                b += 1
            if at >= pos + len(insert) and old == at - shift and old >= end:
                break
            pieces.append(m.group())
            at = m.end()
        else:
            j, b = len(tree.leaves) - 1, len(tree.leaves[-1][0])
        tree.replace((i, a), (j, b), list(map(len, pieces)), enc.counts(pieces))
        self.text, self.reencoded = new, self.reencoded + at - start


def attach_edits(docs: DataFrame, edits: DataFrame, *, id_col: str = "doc_id", most: int = 100_000) -> DataFrame:
    """Docs with a column ``edits`` from a table (doc_id, seq, pos, del, ins), in ``seq`` order.

    A document with more than ``most`` edits raises, as one list is held in a row.
    """
    listed = edits.groupBy(F.col(id_col).alias("_edit_of")).agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "del", "ins"))).alias("_edits"))
    listed = listed.withColumn("_edits", F.when(F.size("_edits") > most, F.raise_error(F.lit(f"over {most} edits of a document"))).otherwise(F.col("_edits")))
    rows, moved = set_aside(docs.select(*local_schema(docs, "edits")), "_edit_of", "_edits")
    joined = rows.join(listed, F.col(id_col) == F.col("_edit_of"), "left").withColumn("edits", F.transform("_edits", lambda e: F.struct(e["pos"].cast("int").alias("pos"), e["del"].cast("int").alias("del"), e["ins"].alias("ins"))))
    return put_back(joined.drop("_edit_of", "_edits"), moved)


def _pack(values: list[int]) -> bytes:
    from array import array

    return array("I", values).tobytes()


def _unpack(blob: bytes) -> list[int]:
    from array import array

    a = array("I")
    a.frombytes(blob)
    return a.tolist()


def build_trees(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, chars, tokens): the pre-tokens' lengths and token counts, from which a tree's sums follow."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def build(batches) -> Iterator:
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                trees = [Document(enc, t).tree.leaves for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([_pack([x for leaf in t for x in leaf[w]]) for t in trees], pa.binary()) for w in (0, 1))], names=["doc_id", "text", "chars", "tokens"])

    return rows.mapInArrow(build, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {TREE}")


def count_edited(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", trees: bool = False) -> DataFrame:
    """Token counts before and after each document's edits, encoding again only what the edits touch.

    ``edits_col`` holds (pos, del, ins) in order, positions in characters of the text so far.  With
    ``trees`` the rows carry stored trees (``build_trees``) and nothing else is encoded.  Null texts are
    empty texts; null edit lists are empty; null ``ins`` inserts nothing; a null ``pos`` or ``del`` is 0.
    Repeated rows each get their own result and an empty table none; other columns, whatever their names,
    are ignored.  Long texts are held whole, as a tree of their pre-tokens.
    """
    kept = [F.col("chars"), F.col("tokens")] if trees else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(edits_col), F.array().cast(EDITS)).alias("edits"), *kept)

    def count(batches) -> Iterator:
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns = [c.to_pylist() for c in part.columns[1:]]
                out = []
                for text, edits, *stored in zip(*columns, strict=True):
                    doc = Document(enc, text, SegmentTree(*map(_unpack, stored)) if stored else None)
                    before, pieces = doc.tree.n_tokens, sum(len(leaf[0]) for leaf in doc.tree.leaves)
                    for e in edits:
                        if e is not None:
                            doc.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                    out.append((before, doc.tree.n_tokens, len(doc.text), pieces, doc.reencoded))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=["doc_id", *(x.split()[0] for x in RESULT.split(", "))])
        enc.trim()

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")
