"""Personal information inside free text: found by a skip-chain conditional random field and replaced by typed placeholders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.pii_crf import LABELS, SkipChain
from tallyloom.llm.pii_tokens import tokens
from tallyloom.session import ship_package, spread

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Made texts the field is trained on.
TRAINING_DOCUMENTS = 16_000
_NUMBERS = re.compile(r"N\d|L\d|G|PLUS|BRACKET|NUM|CNID|DNI|NIE|NINO|CARD|DOTTED")
_BRIDGE = {",", "NL", ".", "#", "-", "/", "LETTER", "'", "TAG"}
_WORDS = {"TITLE", "UPPER", "LOWER", "INITIAL", "LETTER"}


@lru_cache(1)
def trained(documents: int = TRAINING_DOCUMENTS) -> tuple:
    """Weights of the field; trained once per process."""
    from tallyloom.llm.pii_training import train

    return train(documents).state()


def spans_of(forms: list[str], classes: list[str], starts: list[int], ends: list[int], belief) -> list[tuple[int, int, str]]:
    """(first, past-the-end, kind) of the entities in label beliefs. The form of each is checked: it must be one that its kind can have."""
    best = belief.argmax(1).tolist()
    n = len(best)
    out: list[tuple[int, int, str]] = []
    i = 0
    while i < n:
        k = best[i]
        if not k:
            i += 1
            continue
        j = i + 1
        while j < n and (best[j] == k or (k == 4 and j + 1 < n and best[j + 1] == k and classes[j] in _BRIDGE) or (k == 4 and j + 2 < n and best[j + 2] == k and classes[j] in _BRIDGE and classes[j + 1] in _BRIDGE)):
            j += 1
        kind = LABELS[k]
        if kind in ("email", "phone", "id_number"):
            for t in range(i, j):  # each is one token
                if kind == "email" and classes[t] == "EMAIL":
                    out.append((starts[t], ends[t], kind))
                elif kind != "email" and classes[t] not in ("EMAIL", "PRICE") and _NUMBERS.match(classes[t]):
                    out.append((starts[t], ends[t], kind))
        else:
            a, b = i, j
            edge = lambda t: not (forms[t][0].isalnum() or (kind == "address" and classes[t] == "#" and t > i)) or classes[t] == "TAG"
            while a < b and (edge(a) or (kind == "name" and classes[a].startswith("C_") and b - a > 2 and not "㐀" <= forms[a][0] <= "鿿")):
                a += 1
            while b > a and edge(b - 1):
                b -= 1
            if a < b and (_is_name(forms[a:b]) if kind == "name" else _is_address(classes[a:b])):
                out.append((starts[a], ends[b - 1], kind))
        i = j
    return out


#: Particles of family names.
_PARTICLES = set("van von vom zu der den de del di da la las los le y e".split())


def _is_name(forms: list[str]) -> bool:
    """A given name or an initial, and a family name: two words, one of them longer than an initial, or two Chinese characters."""
    if all("㐀" <= f[0] <= "鿿" for f in forms):
        return len(forms) >= 2
    words = [f for f in forms if f[0].isalpha() and f.lower() not in _PARTICLES]
    return len(words) >= 2 and any(len(w.rstrip(".")) > 1 for w in words)


def _is_address(classes: list[str]) -> bool:
    """A street and a house number."""
    number = any(c == "HOUSE" or re.fullmatch(r"N\d", c) for c in classes)
    return number and len(classes) >= 2 and any(c not in (",", ".", "NL") and not c.startswith(("N", "L")) or c in _WORDS for c in classes)


class Finder:
    """A field and the rules for its results."""

    def __init__(self, state: tuple | None = None) -> None:
        self.model = SkipChain(*(state or trained()))

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        cut = [tokens(t or "") for t in texts]
        beliefs = self.model.beliefs([(f, c) for f, c, _, _ in cut])
        return [spans_of(*c, b) if len(b) else [] for c, b in zip(cut, beliefs)]


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder in place of each span and all else unchanged."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


_finders: dict[str, Finder] = {}


def _finder(name: str, shared) -> Finder:
    if name not in _finders:
        _finders.clear()
        _finders[name] = Finder(shared.value)
    return _finders[name]


def _scan(docs: DataFrame, doc_id: str, text: str, make, schema: pa.Schema, ddl: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    shared, name = spark.sparkContext.broadcast(trained()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(name, shared)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 2000):
                part = texts[i : i + 2000]
                rows = [row for d, t, spans in zip(ids[i : i + 2000], part, finder.find(part)) for row in make(d, t, spans)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return spread(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id").mapInArrow(run, ddl)


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_pos, end_pos, kind of each piece of personal information: email, phone, id_number, address or name.

    Positions count code points of the text as stored, from 0. Null and empty texts have none; rows with the same id each have their own; very long texts are
    read whole. No shuffle unless there are fewer partitions than cores; the field's weights, of fixed size, are broadcast.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string())])
    return _scan(docs, doc_id, text, lambda d, t, spans: [(d, a, b, k) for a, b, k in spans], schema, "doc_id bigint, start_pos bigint, end_pos bigint, kind string")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and found: every document with typed placeholders in place of personal information, and how many there are. A null text stays null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("found", pa.int32())])
    return _scan(docs, doc_id, text, lambda d, t, spans: [(d, None if t is None else masked(t, spans), len(spans))], schema, "doc_id bigint, text string, found int")
