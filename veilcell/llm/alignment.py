"""Alignment of two tokenizers over whole texts.

Both token lists spell the same bytes. After a text is tokenised whole by either,
it is parted at anchors: byte offsets where tokens of both end and the next token
of both begins with a space. Between two anchors lies a window, about a word, whose
alignment depends on nothing but its token ids; it is found once and remembered by
the two id lists.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from .texts import mix, slices
from .tokens import _byte_letters, _tokenizer

SLICE = 2 << 20  # bytes of text tokenised at once
REMEMBERED = 200_000  # windows that a task keeps, half of them older ones
WINDOW_TOKENS = 64  # longer windows are not kept
BROADCAST_PAIRS = 1_000_000
SALTS = 64

# The pre-token rule of byte-level definitions, and characters whose classes no Unicode version changes.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[\x00-\u024f]*")

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_LINKS = "array<struct<a: int, b: int, times: bigint>>"
_LINK_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())]))


def byte_level_entries(definition: str) -> list[bytes]:
    """Bytes of every entry of a byte-level vocabulary; entries that are no byte letters stand for their own UTF-8."""
    content = json.loads(definition)
    letters = _byte_letters()
    entries = dict(content["model"]["vocab"])
    added = {t["id"]: t["content"] for t in content.get("added_tokens", [])}
    out = [b""] * (1 + max(max(entries.values()), max(added, default=0)))
    for token, number in entries.items():
        plain = number not in added and all(c in letters for c in token)
        out[number] = bytes(letters[c] for c in token) if plain else token.encode()
    for number, token in added.items():
        out[number] = token.encode()
    return out


def merges_follow_ranks(definition: str) -> bool:
    """Proves that merging the pair with the least id of the result does what the definition's list of merges does.

    It does if every merge has a result of its own, in the order of ids, and every
    entry comes out of its own bytes by the merges alone: then two neighbours whose
    bytes make up an entry are always those of its merge.
    """
    model = json.loads(definition)["model"]
    vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    results = [vocabulary.get("".join(m), -1) for m in merges]
    if results != sorted(set(results)) or -1 in results or len(results) + 256 < len(_letters_only(vocabulary)):
        return False
    order = {m: i for i, m in enumerate(merges)}
    for left, right in merges:
        parts = list(left + right)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), len(order)))
            if (parts[best], parts[best + 1]) not in order:
                return False
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return True


def _letters_only(vocabulary: dict[str, int]) -> list[str]:
    letters = _byte_letters()
    return [t for t in vocabulary if all(c in letters for c in t)]


class ByteLevel:
    """Token ids of a byte-level definition, merged by ranks where that is proved to be the same."""

    def __init__(self, definition: str, by_ranks: bool):
        self.tokenizer = _tokenizer(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.fast = None
        if by_ranks:
            from tiktoken import Encoding

            letters, vocabulary = _byte_letters(), json.loads(definition)["model"]["vocab"]
            added = {t["content"] for t in json.loads(definition).get("added_tokens", [])}
            ranks = {bytes(letters[c] for c in t): vocabulary[t] for t in _letters_only(vocabulary) if t not in added}
            self.fast = Encoding("byte-level", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        plain = [self.fast is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if p else next(others).ids for t, p in zip(texts, plain, strict=True)]


def piece_entries(model: bytes) -> list[bytes]:
    """Bytes of every piece: U+2581 stands for a space, byte pieces for their byte."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_proto=model)
    return [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))]


class Vocabulary:
    """Token bytes by id, their lengths, and which begin with a space."""

    def __init__(self, entries: Sequence[bytes]):
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.spaced = np.array([e[:1] == b" " for e in entries])

    def spells(self, ids: Sequence[int], text: bytes) -> bool:
        return b"".join([self.entries[i] for i in ids]) == text

    def anchors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the ends before tokens that begin with a space, and of the last end; and how many tokens lie before."""
        ends = np.cumsum(self.lengths[ids])
        stops = np.append(np.flatnonzero(self.spaced[ids[1:]]) + 1, len(ids))
        return ends[stops - 1], stops


Window = tuple[str, list[int]]  # groups as text, links as a * 2^32 + b


def shared(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both of the numbers they share; both rise and end alike."""
    at = np.searchsorted(ends_b, ends_a)
    same = ends_b[at] == ends_a
    return np.flatnonzero(same), at[same]


class Aligner:
    """Groups and links of token lists, window by window; windows met before are looked up."""

    def __init__(self, a: Vocabulary, b: Vocabulary, remembered: int = REMEMBERED):
        self.a, self.b, self.half = a, b, max(1, remembered // 2)
        names = [str(i) for i in range(max(len(a.entries), len(b.entries)))]
        self.names = np.array([[n + after for n in names] for after in ",|;\n"], object)
        self.windows: dict[tuple[bytes, bytes], Window] = {}
        self.older: dict[tuple[bytes, bytes], Window] = {}

    def aligned(self, windows: Sequence[tuple[bytes, bytes]]) -> list[Window]:
        """Groups and links of windows given by their token ids: one link for each group, between its last tokens.

        Tokens are never empty, so no two of one side end at the same byte.
        """
        a, b = (np.frombuffer(b"".join([w[side] for w in windows]), np.int32).astype(np.int64) for side in (0, 1))
        last_a, last_b = shared(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        after = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after[0][last_a], after[1][last_b] = 1, 2
        after[1][np.cumsum([len(w[1]) // 4 for w in windows]) - 1] = 3
        sizes = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        begins = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
        told = np.empty(len(a) + len(b), object)
        for ids, mark, size, last, first in ((a, after[0], sizes[0], last_a, begins), (b, after[1], sizes[1], last_b, begins + sizes[0])):
            told[np.arange(len(ids)) + np.repeat(first - (last - size + 1), size)] = self.names[mark, ids]
        links = ((a[last_a] << 32) + b[last_b]).tolist()
        stops = np.searchsorted(last_a, np.cumsum([len(w[0]) // 4 for w in windows])).tolist()
        texts = "".join(told.tolist()).split("\n")
        return [(text, links[x:y]) for text, x, y in zip(texts, [0, *stops[:-1]], stops)]

    def _known(self, keys: Sequence[tuple[bytes, bytes]]) -> list[Window]:
        found = list(map(self.windows.get, keys))
        missing = [i for i, w in enumerate(found) if w is None]
        for i in missing:
            found[i] = self.older.get(keys[i])
        new = [i for i in missing if found[i] is None]
        if new:
            for i, w in zip(new, self.aligned([keys[i] for i in new]), strict=True):
                found[i] = w
        for i in missing:
            if len(keys[i][0]) + len(keys[i][1]) <= 4 * WINDOW_TOKENS:
                if len(self.windows) >= self.half:
                    self.windows, self.older = {}, self.windows
                self.windows[keys[i]] = found[i]
        return found

    def texts(self, a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[tuple[str, np.ndarray]]:
        """Groups and links of texts, each given by two token lists that spell the same bytes and begin with a space.

        So a text ends at an anchor too, and all are parted together; windows that
        occur more than once among them are looked up once.
        """
        sizes = np.cumsum([len(x) for x in a])
        all_a, all_b = np.concatenate(a).astype(np.int32, copy=False), np.concatenate(b).astype(np.int32, copy=False)
        (offsets_a, stops_a), (offsets_b, stops_b) = self.a.anchors(all_a), self.b.anchors(all_b)
        in_a, in_b = shared(offsets_a, offsets_b)
        one, other = (Side(ids, stops) for ids, stops in ((all_a, stops_a[in_a]), (all_b, stops_b[in_b])))
        with np.errstate(over="ignore"):
            names = mix(one.names * np.uint64(0x9E3779B97F4A7C15) + other.names)
        _, first, kind = np.unique(names, return_index=True, return_inverse=True)
        if not one.same_as(first[kind]) or not other.same_as(first[kind]):  # two windows of one name
            first = kind = np.arange(len(names))
        found = self._known(list(zip(one.parts(first), other.parts(first), strict=True)))
        groups = np.array([g for g, _ in found] + [None], object)[:-1][kind].tolist()
        many = np.array([len(links) for _, links in found], np.int64)
        flat = np.fromiter(chain.from_iterable([links for _, links in found]), np.int64, int(many.sum()))
        begins, times = (np.cumsum(many) - many)[kind], many[kind]
        links = flat[np.repeat(begins - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        last = np.searchsorted(one.stops, sizes, side="right")  # windows up to the end of each text
        upto = np.append(0, np.cumsum(times))
        return [(";".join(groups[x:y]), links[upto[x]:upto[y]]) for x, y in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


class Side:
    """Token ids of one tokenizer, parted into windows; ``names`` are hashes of the windows' ids."""

    def __init__(self, ids: np.ndarray, stops: np.ndarray):
        self.ids, self.stops, self.starts = ids, stops, np.append(0, stops[:-1])
        self.sizes = stops - self.starts
        self.place = np.arange(len(ids)) - np.repeat(self.starts, self.sizes)
        with np.errstate(over="ignore"):
            mixed = mix(ids.astype(np.uint64) + self.place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            self.names = mix(np.add.reduceat(mixed, self.starts) + self.sizes.astype(np.uint64))

    def parts(self, some: np.ndarray) -> list[bytes]:
        """The ids of some windows, as bytes."""
        data = self.ids.tobytes()
        return [data[x:y] for x, y in zip((4 * self.starts[some]).tolist(), (4 * self.stops[some]).tolist())]

    def same_as(self, other: np.ndarray) -> bool:
        """Whether every window holds the same ids as the window ``other`` names for it."""
        return bool((self.sizes == self.sizes[other]).all()
                    and (self.ids == self.ids[np.repeat(self.starts[other], self.sizes) + self.place]).all())


_loaded: dict[str, tuple] = {}


def _align(shared):
    """Tasks make no reference cycles, and looking for some in the remembered windows takes long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from aligned(batches)
        finally:
            gc.enable()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        key, definition, model, by_ranks = shared.value
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = (ByteLevel(definition, by_ranks), SentencePieceProcessor(model_proto=model),
                            Aligner(Vocabulary(byte_level_entries(definition)), Vocabulary(piece_entries(model))))
        byte_level, pieces, aligner = _loaded[key]
        for batch in batches:
            for first, end in slices(batch.column(1), SLICE):
                texts = [t or "" for t in batch.column(1)[first:end].to_pylist()]
                ids_a = byte_level.encode([" " + t for t in texts])
                ids_b = pieces.encode(texts, num_threads=1)
                spelled = [(" " + t).encode() for t in texts]
                good = [i for i, t in enumerate(texts) if t and aligner.a.spells(ids_a[i], spelled[i]) and aligner.b.spells(ids_b[i], spelled[i])]
                none = np.zeros(0, np.int64)
                counts, groups, codes, times = [(0, 0, 0, 0)] * len(texts), [""] * len(texts), [none] * len(texts), [none] * len(texts)
                sides = [[np.array(ids[i], np.int32) for i in good] for ids in (ids_a, ids_b)]
                for i, (groups[i], pairs) in zip(good, aligner.texts(*sides) if good else []):
                    codes[i], times[i] = np.unique(pairs, return_counts=True)
                    counts[i] = (len(ids_a[i]), len(ids_b[i]), len(pairs), len(pairs))
                bounds = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                flat = np.concatenate(codes)
                columns = [pa.array(flat >> 32, pa.int64()).cast(pa.int32()), pa.array(flat & 0xFFFFFFFF, pa.int64()).cast(pa.int32()),
                           pa.array(np.concatenate(times), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)], pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns, names=["a", "b", "times"])).cast(_LINK_TYPE)],
                    names=["doc_id", *_COUNTS, "groups", "links"])
    return run


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, links.

    ``path_a`` is a byte-level definition, which reads the text behind one space,
    ``path_b`` a piece model, which adds that space itself; the driver reads both and
    sends them to the tasks. Groups are ``a1,a2|b1;a3|b2,b3``; links are the pairs of
    ids that end together with their number in the document. A text that is null,
    empty, or not spelled by the tokens of both has zeros and no groups. Ids pass
    through, null and repeated ones too; other columns are not read.
    """
    import hashlib

    with open(path_a, encoding="utf-8") as file:
        definition = file.read()
    with open(path_b, "rb") as file:
        model = file.read()
    key = hashlib.sha256(definition.encode() + model).hexdigest()
    if not all(byte_level_entries(definition)) or not all(piece_entries(model)):
        raise ValueError("every token must stand for at least one byte")
    shared = docs.sparkSession.sparkContext.broadcast((key, definition, model, merges_follow_ranks(definition)))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_align(shared), f"doc_id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, groups string, links {_LINKS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of all documents by id pair: a, b, n, and whether n is the highest of its b (ties are)."""
    pairs = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("times").alias("n"))
    highest = pairs.groupBy("b").agg(F.max("n").alias("highest"))
    return pairs.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def with_pair_counts(ws: Workspace, aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Adds n_best (links whose pair is the commonest of its b) and count_sum (sum of the pairs' counts over links).

    ``aligned`` must be stored: it is read twice. The pairs are sent to all tasks
    while there are at most ``broadcast_pairs``; beyond that a document's distinct
    pairs meet them in a shuffle in which every pair is spread over ``SALTS`` keys,
    so one that all documents hold is no single task's work.
    """
    counts = ws.cut(pair_counts(aligned), "pairs")
    pair = F.shiftleft(F.col("a").cast("bigint"), 32) + F.col("b")
    known = counts.select(pair.alias("pair"), "n", "best")
    kept = [c for c in aligned.columns if c != "links"]
    rows = aligned.withColumn("__row", F.monotonically_increasing_id())  # before the links are parted
    rows = rows.select("__row", *kept, F.inline_outer("links")).select("__row", *kept, pair.alias("pair"), "times")
    if counts.count() <= broadcast_pairs:
        joined = rows.join(F.broadcast(known), "pair", "left")
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(known, ["pair", "__salt"], "left")
    best = F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best")
    total = F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("count_sum")
    return joined.groupBy("__row", *kept).agg(best, total).drop("__row")


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ws = Workspace(spark)
    aligned = align(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"),
                    public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    stored = ws.cut(aligned.select("doc_id", *_COUNTS, digest, "links"), "aligned")
    return with_pair_counts(ws, stored).select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
