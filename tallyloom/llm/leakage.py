"""Finding evaluation text inside a corpus.

All runs of ``seed`` successive words of the items go into one Aho-Corasick automaton. Each document's normal form is scanned once; every hit names places in items. Items with so many
hits as a passage must have are extended word by word to either side over at most one changed, dropped or added word in ``per_edit``. Offsets refer to the text as stored.

A passage of 12 or more words with an edit in eight holds five unedited words in a row, each equal to the item's or one slip from it. Runs of four equal words are
found by the automaton, and runs with a slip in a tree of the same runs, which is walked from the places of words that are a slip from a word of the items. So no
passage is missed, however many of its words have a slip.

An edit spoils at most ``seed`` of the runs it lies in, so a passage of n words with e edits has n - seed + 1 - seed * e of its runs in the document at least: five for 12 words
with one edit. Items with fewer are passed over. Where a run stands in many items, as boilerplate does, its places are arrays, and items are counted over all hits of a document at once.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textnorm import Words, near
from tallyloom.session import materialize, ship_package, spread

#: Characters of items in one automaton; a larger set is worked off in several passes over the corpus, one block of items after another.
BLOCK_CHARS = 20_000_000
#: Places of a run from which they are kept as arrays.
MANY = 32


class Passages:
    """The items of one block and their automaton."""

    def __init__(self, items: list[tuple[int, str]], least: int = 12, per_edit: int = 8, seed: int = 4) -> None:
        self.least, self.per_edit, self.seed = least, per_edit, seed
        self.split = Words()
        self.ids = [i for i, _ in items]
        self.words = [self.split(t)[0] if t else [] for _, t in items]
        #: Runs of an item that a document with a passage of it holds at least.
        self.runs = max(1, min(n - seed + 1 - seed * (n // per_edit) for n in range(least, least + 8 * per_edit * seed)))
        self.auto = ahocorasick.Automaton()
        #: The runs word by word; past the last word stand the places.
        self.tree: dict = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for p in range(len(words) - seed + 1):
                places.setdefault(f" {' '.join(words[p : p + seed])} ", []).append((k, p))
        for text, at in places.items():
            at = at if len(at) < MANY else np.array(at, np.int64)
            self.auto.add_word(text, at)
            node = self.tree
            for w in text.split():
                node = node.setdefault(w, {})
            node[""] = at
        #: Words of the items by what is left of them without one letter, and those a slip from a word seen before.
        self.by_rest: dict[str, list[str]] = {}
        for w in {w for text in places for w in text.split()}:
            for rest in _rests(w):
                self.by_rest.setdefault(rest, []).append(w)
        self.slips: dict[str, tuple[str, ...]] = {}
        self.longest = max((len(rest) for rest in self.by_rest), default=0)
        if places:
            self.auto.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, first offset, past-the-end offset, words of the item, edits) of the passages of each item in a text."""
        return [f[:5] for f in self.find_numbered(text)]

    def find_numbered(self, text: str | None) -> list[tuple[int, int, int, int, int, int]]:
        """(item id, first offset, past-the-end offset, words of the item, edits, number) of the passages of each item in a text, the longest first, numbered from 0; those of one
        item don't overlap."""
        if not text or self.empty:
            return []
        words, starts, ends = self.split(text)
        if len(words) < self.least - self.least // self.per_edit:
            return []
        joined = f" {' '.join(words)} "
        hits: dict[int, set[tuple[int, int]]] = {}
        many: list[tuple[int, np.ndarray]] = []
        at: list[int] | None = None
        n = 0
        for end, places in self.auto.iter(joined):
            if at is None:  # offset of the space after each word
                at, n = [], 0
                for w in words:
                    n += len(w) + 1
                    at.append(n)
                order = {x: j for j, x in enumerate(at)}
            d = order[end] - self.seed + 1
            if isinstance(places, list):
                for k, p in places:
                    hits.setdefault(k, set()).add((p, d))
            else:
                many.append((d, places))
        for d, places in self._slipped(words):
            if isinstance(places, list):
                for k, p in places:
                    hits.setdefault(k, set()).add((p, d))
            else:
                many.append((d, places))
        if many:
            self._add_many(hits, many)
        out = []
        for k, seeds in hits.items():
            if len(seeds) < self.runs or len({p for p, _ in seeds}) < self.runs:
                continue
            for nth, (first, last, n, e) in enumerate(self._extend(self.words[k], words, seeds)):
                out.append((self.ids[k], starts[first], ends[last], n, e, nth))
        return out

    def _add_many(self, hits: dict[int, set[tuple[int, int]]], many: list[tuple[int, np.ndarray]]) -> None:
        """Adds the places of runs that stand in many items, of items only that have enough different runs in all."""
        different = {id(x): x for _, x in many}.values()
        runs = np.bincount(np.concatenate([x[:, 0] for x in different]), minlength=len(self.ids))
        for k, seeds in hits.items():
            runs[k] += len({p for p, _ in seeds})
        enough = runs >= self.runs
        for d, x in many:
            for k, p in x[enough[x[:, 0]]].tolist():
                hits.setdefault(k, set()).add((p, d))

    def _near(self, word: str) -> tuple[str, ...]:
        """Words of the items that are a slip from a word."""
        if len(word) > self.longest + 1:
            return ()
        found = self.slips.get(word)
        if found is None:
            found = tuple({w for rest in _rests(word) for w in self.by_rest.get(rest, ()) if w != word and near(word, w)})
            if len(self.slips) < 200_000:
                self.slips[word] = found
        return found

    def _slipped(self, words: list[str]) -> Iterator[tuple[int, list[tuple[int, int]] | np.ndarray]]:
        """Place in the text and places in the items of each run in which at least one word has a slip."""
        others = {d: found for d, w in enumerate(words) if (found := self._near(w))}
        begun = -1
        for at in others:
            for d in range(max(begun + 1, at - self.seed + 1), min(at, len(words) - self.seed) + 1):
                begun = d
                nodes = [(self.tree, False)]
                for j in range(d, d + self.seed):
                    nodes = [(n[w], slip or i > 0) for n, slip in nodes for i, w in enumerate((words[j], *others.get(j, ()))) if w in n]
                    if not nodes:
                        break
                for n, slip in nodes:
                    if slip:
                        yield d, n[""]

    def _extend(self, item: list[str], doc: list[str], seeds: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """First and last word of the document, words of the item and edits of passages, the longest first; none overlaps a longer one."""
        found = []
        left = set(seeds)
        whole = -1  # up to here the document holds the whole item
        for p, d in sorted(seeds, key=lambda s: (s[1], s[0])):
            if (p, d) not in left:
                continue
            n = self.seed
            left.discard((p, d))
            while (p + n - self.seed + 1, d + n - self.seed + 1) in left:  # the run of seeds on the diagonal
                left.discard((p + n - self.seed + 1, d + n - self.seed + 1))
                n += 1
            if d + n - 1 <= whole:
                continue  # nothing longer can come
            most = len(item) // self.per_edit
            back = _reach(item, doc, p - 1, d - 1, -1, most)
            forth = _reach(item, doc, p + n, d + n, 1, most)
            best = None
            for ea, (la, da) in enumerate(back):
                for eb, (lb, db) in enumerate(forth):
                    length, edits = la + n + lb, ea + eb
                    if length >= self.least and edits * self.per_edit <= length and (best is None or length > best[2]):
                        best = (d - da, d + n - 1 + db, length, edits)
            if best:
                found.append(best)
                if best[2] == len(item):
                    whole = max(whole, best[1])
        out: list[tuple[int, int, int, int]] = []
        kept: list[tuple[int, int]] = []  # first and last word of those kept, in order
        for x in sorted(found, key=lambda x: (-x[2], x[3], x[0])):
            j = bisect.bisect_left(kept, (x[0], -1))
            if (j and kept[j - 1][1] >= x[0]) or (j < len(kept) and kept[j][0] <= x[1]):
                continue
            kept.insert(j, (x[0], x[1]))
            out.append(x)
        return out


def _rests(word: str) -> set[str]:
    """A word and what is left of it without one of its letters: two words a slip apart have one of these in common. Short words and numbers allow no slip."""
    if len(word) < 3 or word.isdigit():
        return set()
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _reach(item: list[str], doc: list[str], i: int, j: int, step: int, most: int) -> list[tuple[int, int]]:
    """For 0, 1, ... edits the most words of the item, and those of the document beside them, that match onwards from item[i] and doc[j], ending in a match."""
    n_item = len(item) - i if step > 0 else i + 1
    n_doc = len(doc) - j if step > 0 else j + 1

    def slide(a: int, b: int) -> int:
        s = 0
        while a + s < n_item and b + s < n_doc:
            x, y = item[i + step * (a + s)], doc[j + step * (b + s)]
            if x != y and not near(x, y):
                break
            s += 1
        return s

    s = slide(0, 0)
    front = {0: s}  # diagonal (words of doc less words of item): words of item used
    reached = [(s, s)]
    for _ in range(most):
        new: dict[int, int] = {}
        best = reached[-1]
        for diag, a in front.items():
            for da, db in ((1, 1), (1, 0), (0, 1)):
                x, y = a + da, a + diag + db
                if x > n_item or y > n_doc:
                    continue
                s = slide(x, y)
                k = y - x
                if x + s > new.get(k, -1):
                    new[k] = x + s
                if s and x + s > best[0]:
                    best = (x + s, y + s)
        if not new:
            break
        front = new
        reached.append(best)
    return reached


_OUT = pa.schema([("doc_id", pa.int64()), ("eval_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("words", pa.int32()), ("edits", pa.int32()), ("nth", pa.int32())])
#: The automaton of the block last used by this worker, under the name its scan was given.
_made: dict[str, Passages] = {}


def _passages(key: str, shared, options: tuple) -> Passages:
    if key not in _made:
        _made.clear()
        _made[key] = Passages(shared.value, *options)
    return _made[key]


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_id", item_text: str = "text", least: int = 12, per_edit: int = 8, seed: int = 4
) -> DataFrame:
    """doc_id, eval_id, start_pos, end_pos, words, edits, nth: the passages of each item that each document holds; nth is 0 for the longest, and passages of one item in a document
    don't overlap.

    A passage has at least ``least`` words of the item in a row, of which one in ``per_edit`` may be changed, dropped or added. Layout, markup, case, width, accents,
    look-alike and broken letters, punctuation, spelling variants and slips of one letter don't count, however many; each Chinese character is a word. Null and empty texts and items
    hold nothing; repeated documents and items each have their rows; no item or no document gives no rows. The items are the stated query set. Up to BLOCK_CHARS characters they are one
    automaton, and the corpus is scanned once, without a shuffle unless it has fewer partitions than there are cores. A larger set goes by blocks: each is read to the driver,
    scanned for, its rows stored, and released before the next.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = spread(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("length(text) > 0"), "doc_id")
    wanted = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text")).dropna()
    single = (wanted.agg(F.sum(F.length("text"))).first()[0] or 0) <= BLOCK_CHARS
    out = None
    for block in _blocks(wanted):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            passages = _passages(name, shared, (least, per_edit, seed))
            for batch in batches:
                rows = [(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in passages.find_numbered(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _OUT)], schema=_OUT)

        part = source.mapInArrow(scan, "doc_id bigint, eval_id bigint, start_pos bigint, end_pos bigint, words int, edits int, nth int")
        if not single:
            part = materialize(part, "passages")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of BLOCK_CHARS, or one item if it alone is longer; a block without items if there are none."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, t in items.toLocalIterator():
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    yield block
