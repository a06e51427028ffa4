"""Exact duplicates: whole texts in compressed radix tries whose terminal nodes know the owner.

A task first puts its own texts into one trie, so that each group of copies leaves it as one text;
then these texts are dealt out and sorted by length and content hash, and put into a trie again. As
all texts below one length and hash come together, that subtree is done when the next begins.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codeq.llm.common import chunks, settle, through_arrow, whole_text


class Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes):
        self.label, self.children, self.entry = label, {}, None


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of the label agree with the key from ``at`` on; by bisection on slices."""
    if key.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Patricia trie of byte strings; edges hold whole strings, any node may be terminal.

    ``held`` has the bytes below each first byte of the root, for spilling.
    """

    def __init__(self):
        self.root, self.held = Node(b""), defaultdict(int)

    def place(self, key: bytes) -> Node:
        """The node of this key, made if need be."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held[key[0]] += len(key) - at + 200
                return child
            same = _shared(child.label, key, at)
            if same < len(child.label):
                upper = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = child = upper
                self.held[key[0]] += 200
            node, at = child, at + same
        return node

    def spill(self, first: int | None = None) -> Iterator[tuple[bytes, object]]:
        """Take out and yield (key, entry) below a first byte, or all."""
        if first is None:
            tops, self.root = [(b"", self.root)], Node(b"")
            self.held.clear()
        else:
            tops = [(b"", self.root.children.pop(first))]
            del self.held[first]
        while tops:
            above, node = tops.pop()
            key = above + node.label
            if node.entry is not None:
                yield key, node.entry
            tops.extend((key, child) for child in node.children.values())


def _better(a: tuple, b: tuple) -> bool:
    """Whether a stays rather than b: (doc_id or None, row); larger id first, then lesser row."""
    return ((a[0] is not None, a[0] or 0, -a[1]) > (b[0] is not None, b[0] or 0, -b[1]))


def _first_texts(docs: DataFrame, carry: bool, budget: int) -> DataFrame:
    """Rows of kind 0 (each document) and 1 (each text of a task, with its best row and count).

    The trie of a task holds at most about ``budget`` bytes; beyond that its largest subtree is
    written out and forgotten, and a later copy of a text in it simply opens an entry again.
    """
    payload = [f for f in docs.schema if f.name != "text"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.struct(*[F.col(f"`{f.name}`") for f in payload] if carry else
                                  [F.lit(0).alias("none")]).alias("row_of"), whole_text())
    schema = StructType([StructField(n, LongType()) for n in ("kind", "rep", "doc_id", "row", "n")])
    schema = schema.add("length", "long").add("hash", "binary").add("sha", "binary")
    schema = schema.add("row_of", source.schema["row_of"].dataType).add("text", "binary")
    names = schema.names

    def texts(entries) -> Iterator[dict[str, list]]:
        out, size = {n: [] for n in names}, 0
        for key, entry in entries:
            sha = hashlib.sha256(key).digest()
            for n, v in zip(names, (1, entry["rep"], *entry["best"], entry["n"], len(key), sha[:8],
                                    None, entry["row_of"], key), strict=True):
                out[n].append(v)
            size += len(key) + 200
            if size > 1 << 20:
                yield out
                out, size = {n: [] for n in names}, 0
        yield out

    def rows(batches):
        trie, number = Trie(), TaskContext.get().partitionId() << 36
        for doc_ids, payloads, values in chunks(batches, "doc_id", "row_of", "text"):
            out = {n: [] for n in names}
            for doc_id, row_of, value in zip(doc_ids, payloads, values, strict=True):
                number += 1
                key, mine = value.encode(), (doc_id, number)
                node = trie.place(key)
                if node.entry is None:
                    node.entry = {"rep": number, "best": mine, "n": 0, "row_of": row_of}
                elif _better(mine, node.entry["best"]):
                    node.entry["best"], node.entry["row_of"] = mine, row_of
                node.entry["n"] += 1
                if not carry:
                    for n, v in zip(names, (0, node.entry["rep"], doc_id, number, None, None, None,
                                            hashlib.sha256(key).digest(), None, None), strict=True):
                        out[n].append(v)
            if out["kind"]:
                yield out
            while sum(trie.held.values()) > budget:
                yield from texts(trie.spill(max(trie.held, key=trie.held.get)))
        yield from texts(trie.spill())
    return settle(through_arrow(source, rows, schema), "texts")


def _owners(texts: DataFrame, carry: bool) -> DataFrame:
    """Tries over all tasks' texts. One row per text with its best row, or per ``rep`` of it."""
    kind = texts.schema["row_of"].dataType
    schema = (StructType().add("row_of", kind).add("text", "string") if carry else
              StructType().add("rep", "long").add("keep_id", "long").add("keep_row", "long")
              .add("group_size", "long"))
    asked = ["rep", "doc_id", "row", "n", "length", "hash", *(["row_of"] if carry else []), "text"]

    def done(entries) -> dict[str, list]:
        out = {n: [] for n in schema.names}
        for key, entry in entries:
            if carry:
                out["row_of"].append(entry["row_of"])
                out["text"].append(key.decode())
            else:
                for rep in entry["reps"]:
                    for n, v in zip(schema.names, (rep, *entry["best"], entry["n"]), strict=True):
                        out[n].append(v)
        return out

    def rows(batches):
        trie, now = Trie(), None
        for lists in chunks(batches, *asked):
            for values in zip(*lists, strict=True):
                x = dict(zip(asked, values, strict=True))
                if now != (x["length"], x["hash"]):
                    if now is not None:
                        yield done(trie.spill())
                    now = (x["length"], x["hash"])
                node, mine = trie.place(x["text"]), (x["doc_id"], x["row"])
                if node.entry is None:
                    node.entry = {"best": mine, "n": 0, "reps": [], "row_of": x.get("row_of")}
                elif _better(mine, node.entry["best"]):
                    node.entry["best"], node.entry["row_of"] = mine, x.get("row_of")
                node.entry["n"] += x["n"]
                node.entry["reps"].append(x["rep"])
        yield done(trie.spill())

    dealt = texts.filter("kind = 1").select(*asked).repartition("length", "hash")
    return through_arrow(dealt.sortWithinPartitions("length", "hash"), _gathered(rows), schema)


def _gathered(rows):
    """Join the small results of single subtrees into larger ones."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for part in rows(batches):
            for n, values in part.items():
                held.setdefault(n, []).extend(values)
            size += sum(len(t) for t in part["text"]) if "text" in part else 16 * len(part["rep"])
            if size > 1 << 20:
                yield held
                held, size = {}, 0
        if held:
            yield held
    return run


def owners(docs: DataFrame, budget: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; null text is empty and a null doc_id the
    least. Of rows with that doc_id as well, one stays.
    """
    found = _first_texts(docs, False, budget)
    members = found.filter("kind = 0").select("rep", "doc_id", "row", "sha")
    return members.join(_owners(found, False), "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_texts(docs: DataFrame, budget: int = 16 << 20) -> DataFrame:
    """The documents that stay, with all their columns; a null text that stays is empty."""
    found = _owners(_first_texts(docs, True, budget), True)
    return found.select(*[F.col("text") if c == "text" else F.col(f"row_of.`{c}`") for c in docs.columns])
