"""Token counts with a whole-token shortcut.

Every vocabulary string is proved on the driver to encode alone as one token, or
is left out. In the tasks a pre-token among the proven strings counts one without
any merging; only the others go through the tokenizer's merges, each once per task
while it stays in a bounded table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import slices

LIMIT = 2048
REMEMBERED = 400_000  # counted strings that a task keeps

# The pre-token rule of the tokenizer for letters of ASCII and Latin-1, digits and signs.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# str.split() parts at these, the tokenizer's white space does not include them.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def prove_whole_tokens(definition: str) -> frozenset[str]:
    """The vocabulary strings that the tokenizer gives back alone as exactly that one token."""
    import json

    tokenizer = _tokenizer(definition)
    model = json.loads(definition)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    letters = _byte_letters()
    texts, ids = [], []
    for token, number in model["vocab"].items():
        if not token.endswith(suffix) or token == suffix:
            continue
        try:
            text = bytes(letters[c] for c in token[:len(token) - len(suffix)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if _PRE_TOKEN.fullmatch(text) and _PLAIN.fullmatch(text):
            texts.append(text)
            ids.append(number)
    codes = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, n, e in zip(texts, ids, codes, strict=True) if e.ids == [n])


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenCounter:
    """Counts the tokens of texts as the tokenizer gives them, without begin, end or padding."""

    def __init__(self, definition: str, whole: frozenset[str], special: tuple[str, ...]):
        self.tokenizer, self.whole, self.special = _tokenizer(definition), whole, special
        self.pieces: dict[str, int] = {}  # strings between white space
        self.merged: dict[str, int] = {}  # pre-tokens that are no whole token

    def _merge(self, parts: list[str]) -> None:
        """Tokens of pre-tokens, many in one call: white space keeps them apart, word_ids tell whose each token is."""
        for i in range(0, len(parts), 2000):
            some = parts[i:i + 2000]
            owners = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).word_ids, np.int64)
            self.merged.update(zip(some, np.bincount(owners, minlength=len(some)).tolist(), strict=True))

    def _learn(self, unknown: set[str]) -> None:
        plain = [p for p in unknown if _PLAIN.fullmatch(p)]
        odd = list(unknown.difference(plain))
        parts = [_PRE_TOKEN.findall(p.lower()) for p in plain]
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        self._merge(list(set(chain.from_iterable(parts)).difference(self.whole, self.merged)))
        merged = self.merged.get
        self.pieces.update((p, sum([merged(x, 1) for x in own])) for p, own in zip(plain, parts, strict=True))
        self.pieces.update(zip(odd, _lengths(self.tokenizer, odd), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        left = [bool(_SEPARATORS.search(t)) or any(s in t for s in self.special) for t in texts]
        parted = [[] if odd else t.split() for odd, t in zip(left, texts, strict=True)]
        unknown = set().union(*parted).difference(self.pieces)
        if unknown:
            self._learn(unknown)
        piece = self.pieces.__getitem__
        return [_lengths(self.tokenizer, [t])[0] if odd else sum(map(piece, own)) for odd, t, own in zip(left, texts, parted, strict=True)]


_counters: dict[str, TokenCounter] = {}


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, definition, whole, special = shared.value
        if key not in _counters:
            _counters.clear()
            _counters[key] = TokenCounter(definition, whole, special)
        counter = _counters[key]
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts):
                counts = counter.count([t or "" for t in texts[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(counts, pa.int64())],
                                                 names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a tokenizer definition of the pair-merging kind with word ends and
    byte letters; the driver reads it and sends it to the tasks. Null texts count
    as empty and have no tokens; ids pass through, null and repeated ones too.
    """
    import hashlib
    import json

    with open(path, encoding="utf-8") as file:
        definition = file.read()
    special = tuple(t["content"] for t in json.loads(definition).get("added_tokens", []))
    whole = prove_whole_tokens(definition)
    key = hashlib.sha256(definition.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, definition, whole, special))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text)
    counted = rows.mapInArrow(_count(shared), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
