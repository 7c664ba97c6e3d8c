"""Token counts that follow edits.

A document is a segment tree: its leaves are runs of whole pre-tokens of about ``LEAF`` characters,
its nodes the sums of characters and tokens below. A leaf ends only between a character that is no
white space and a space before an ASCII letter; the splitting rule always cuts there, whatever
stands around, so the counts of leaves add up to the count of the text. An edit re-encodes the leaves
it touches with two characters of context, and more only while the new border is no such place;
then the sums above are updated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.llm.encoder import default_path, encoder

LEAF = 512
CONTEXT = 2  # the splitting rule looks at most so far beyond what it takes
TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
EDITED = TREES + ", n_tokens_before long, n_edits long, n_rejected long, n_reencoded long"


def _is_border(text: str, at: int) -> bool:
    """Whether the splitting rule cuts before ``at`` in any case."""
    return (
        text[at] == " "
        and at + 1 < len(text)
        and text[at + 1].isascii()
        and text[at + 1].isalpha()
        and not text[at - 1].isspace()
    )


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, lo = [], 0
    while len(text) - lo > size:
        at = text.find(" ", lo + size)
        while at >= 0 and not _is_border(text, at):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[lo:at])
        lo = at
    if lo < len(text):
        out.append(text[lo:])
    return out


class TokenTree:
    """The tree of one document. ``count`` gives the tokens of a text."""

    def __init__(self, texts: list[str], tokens: list[int], count: Callable[[str], int]):
        self.count, self.n_reencoded = count, 0
        self._build(texts, tokens)

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        size = 1
        while size < max(1, len(texts)):
            size *= 2
        self.size, self.texts = size, texts + [""] * (size - len(texts))
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, (x, n) in enumerate(zip(texts, tokens, strict=True)):
            self.chars[size + i], self.tokens[size + i] = len(x), n
        for i in range(size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf of character ``at`` and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        i = self.size + leaf
        self.texts[leaf] = text
        dc, dt = len(text) - self.chars[i], tokens - self.tokens[i]
        while i and (dc or dt):
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def edit(self, at: int, delete: int, insert: str) -> None:
        total = self.chars[1]
        at = min(max(at, 0), total)
        delete = min(max(delete, 0), total - at)
        if not total:
            texts = leaves(insert)
            self._build(texts, [self._encode(x) for x in texts])
            return
        lo, before = self._find(max(at - CONTEXT, 0))
        hi, start_hi = self._find(min(at + delete + CONTEXT, total - 1))
        after = start_hi + len(self.texts[hi])
        old = "".join(self.texts[lo : hi + 1])
        k = at - before
        new = old[:k] + insert + old[k + delete :]
        while before and not (len(new) > 1 and _is_border("x" + new, 1)):
            lo, start = self._find(before - 1)
            new, before = self.texts[lo] + new, start
        while after < total and (not new or new[-1].isspace()):
            hi, start = self._find(after)
            new, after = new + self.texts[hi], start + len(self.texts[hi])
        parts = leaves(new) if len(new) > 4 * LEAF else [new]
        counts = [self._encode(x) for x in parts]
        if len(parts) <= hi - lo + 1:
            for i in range(lo, hi + 1):
                k = i - lo
                self._set(i, *((parts[k], counts[k]) if k < len(parts) else ("", 0)))
        else:
            full = [
                (x, self.tokens[self.size + i])
                for i, x in enumerate(self.texts)
                if x and not lo <= i <= hi
            ]
            n = sum(1 for x in self.texts[:lo] if x)
            full[n:n] = [p for p in zip(parts, counts, strict=True) if p[0]]
            self._build([x for x, _ in full], [c for _, c in full])

    def _encode(self, text: str) -> int:
        self.n_reencoded += len(text)
        return self.count(text)

    def row(self) -> tuple[str, list[int], list[int], int]:
        kept = [i for i in range(self.size) if self.texts[i]]
        return (
            "".join(self.texts),
            [self.chars[self.size + i] for i in kept],
            [self.tokens[self.size + i] for i in kept],
            self.tokens[1],
        )


def _arrow(rows: list[tuple], edited: bool) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    fields = [("doc_id", pa.int64()), ("text", pa.string()), ("leaf_chars", ints),
              ("leaf_tokens", ints), ("n_tokens", pa.int64())]
    if edited:
        more = ("n_tokens_before", "n_edits", "n_rejected", "n_reencoded")
        fields += [(n, pa.int64()) for n in more]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A tree for every row of ``docs`` (doc_id, text). A null text is the empty one."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                parts = leaves(text)
                counts = [len(enc.encode(x)) for x in parts]
                rows.append((doc_id, text, [len(x) for x in parts], counts, sum(counts)))
                held += len(text)
                if held > 1 << 22:
                    yield _arrow(rows, False)
                    rows, held = [], 0
            yield _arrow(rows, False)

    return docs.select("doc_id", "text").mapInArrow(run, TREES)


def apply_edits(trees: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Trees after ``edits`` (doc_id, seq, at, delete, insert), applied in the order of ``seq``.

    An edit removes ``delete`` characters at character ``at`` of the text as it then is and puts
    ``insert`` there. Positions outside the text move to its nearest end, a null ``delete`` is 0
    and a null ``insert`` empty; an edit with a null ``at`` is rejected and counted. Equal ``seq``
    go by (at, delete, insert). Edits without a document, or with a null doc_id, have no effect.
    Where a doc_id is repeated, the row with the greatest text takes the edits and the others stay
    as they are. Returns every row of ``trees`` with its counts before and after.

    Trees and edits of a document meet in one task and are streamed there in order, so that it
    holds one document and one Arrow batch, whatever the number of edits.
    """
    path = path or default_path()
    salt = F.coalesce("doc_id", F.xxhash64("text"))
    left = trees.select(
        "doc_id", salt.alias("_key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("del"), "text",
        "leaf_chars", "leaf_tokens",
    )
    none = F.lit(None).cast("array<int>")
    right = edits.where("doc_id IS NOT NULL").select(
        "doc_id", F.col("doc_id").alias("_key"), F.lit(1).alias("kind"),
        F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"),
        F.col("delete").cast("long").alias("del"), F.col("insert").alias("text"),
        none.alias("leaf_chars"), none.alias("leaf_tokens"),
    )
    both = left.unionByName(right).repartition("_key")
    both = both.sortWithinPartitions("doc_id", "kind", "seq", "at", "del", "text").drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        count = lambda x: len(enc.encode(x))
        row = tree = None  # the document that edits go to

        def done() -> tuple:
            if tree is not None:
                text, chars, tokens, total = tree.row()
                tail = (sum(row["leaf_tokens"]), row["n"], row["rejected"], tree.n_reencoded)
                return (row["doc_id"], text, chars, tokens, total, *tail)
            n = sum(row["leaf_tokens"])
            own = (row["doc_id"], row["text"], row["leaf_chars"], row["leaf_tokens"], n)
            return (*own, n, row["n"], row["rejected"], 0)

        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if row is not None:
                        rows.append(done())
                        held += len(rows[-1][1])
                    row, tree = {**r, "n": 0, "rejected": 0}, None
                elif row is not None and row["doc_id"] == r["doc_id"]:
                    if r["at"] is None:
                        row["rejected"] += 1
                        continue
                    if tree is None:
                        parts, k = [], 0
                        for n in row["leaf_chars"]:
                            parts.append(row["text"][k : k + n])
                            k += n
                        tree = TokenTree(parts, row["leaf_tokens"], count)
                    row["n"] += 1
                    tree.edit(r["at"], r["del"] or 0, r["text"] or "")
                if held > 1 << 22:
                    yield _arrow(rows, True)
                    rows, held = [], 0
        if row is not None:
            rows.append(done())
        yield _arrow(rows, True)

    return both.mapInArrow(run, EDITED)
