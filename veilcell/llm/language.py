"""Language identification by fusing several kinds of evidence with Bayes' rule.

Text gives a likelihood per language from hashed letter trigrams. A declared
language (of a page's markup or of a table's column) counts by how reliable such
declarations proved over all rows. The prior of an address comes from its host,
smoothed towards its registered name, its suffix and the whole, with the row's
own share taken out. Tables without addresses use what they have, such as the
source of a document, as the only level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from .texts import mix, slices, text_bytes

SAMPLE_DOCUMENTS = 1500  # per language, to fit the letter model
SAMPLE_CHARACTERS = 4000  # of each, from its middle
BINS = 1 << 16
FULL_EVIDENCE = 200.0  # trigrams beyond which more text adds no more evidence
MIN_LETTERS = 8
MIN_CONFIDENCE = 0.6
PRIOR_ROWS = 20.0  # rows that the coarser level counts for in the finer one
DECLARED_ROWS = 2.0
BROADCAST_ROWS = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin) of every three bytes that hold a letter; other bytes than letters count as one space."""
    data, offsets = text_bytes(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = _LETTER[data]
    plain = np.where(letters, _LOWER[data], np.uint8(32)).astype(np.uint32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # of several spaces the first stays
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    plain = plain[keep]
    if len(plain) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (plain[:-2] << np.uint32(16)) | (plain[1:-1] << np.uint32(8)) | plain[2:]
    one = text[:-2] == text[2:]
    bins = (code * np.uint32(2654435761)) >> np.uint32(16)
    return text[:-2][one], bins[one].astype(np.int64)


class LetterModel:
    """Log-probabilities of trigram bins per language."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray):
        self.languages = list(languages)
        smooth = counts + 0.1
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)) if len(languages) else np.zeros((0, BINS))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood per text and language, scaled to at most FULL_EVIDENCE trigrams, and the trigrams."""
        text, bins = _trigrams(texts)
        n = np.bincount(text, minlength=len(texts)).astype(float)
        out = np.empty((len(texts), len(self.languages) + 1))
        for i, row in enumerate(self.log):
            out[:, i] = np.bincount(text, weights=row[bins], minlength=len(texts))
        # Neighbouring trigrams overlap, so a third of them count as independent.
        out[:, :-1] *= (np.minimum(n, FULL_EVIDENCE) / np.maximum(n, 1) / 3)[:, None]
        out[:, -1] = n
        return out


def _bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bin, n) of each slice of (language, text)."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            languages = batch.column(0)[a:b].dictionary_encode()
            text, bins = _trigrams(batch.column(1)[a:b])
            code = languages.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] * BINS + bins
            code, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([languages.dictionary.take(pa.array(code // BINS)), pa.array(code % BINS), pa.array(n.astype(np.int64))],
                                             names=["language", "bin", "n"])


def fit_letters(rows: DataFrame, text: str, language: str, key: str, documents: int = SAMPLE_DOCUMENTS) -> LetterModel:
    """Fits on a sample of about ``documents`` rows per declared language, SAMPLE_CHARACTERS of each.

    The rows are drawn by a hash of key and text below the share that gives that
    many, so nothing is sorted. Trigrams are counted on Spark; the driver gets one
    row per language and bin. Declarations are lower-cased, and all of them are
    told apart.
    """
    known = rows.where(F.col(language).isNotNull() & (F.length(language) > 0) & F.col(text).isNotNull())
    known = known.select(F.lower(F.col(language)).alias("language"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), key, text).alias("draw"))
    sizes = {r[0]: r["count"] for r in known.groupBy("language").count().collect()}
    names = sorted(sizes)
    counts = np.zeros((len(names), BINS))
    if not names:
        return LetterModel(names, counts)
    shares = rows.sparkSession.createDataFrame([(x, documents / sizes[x]) for x in names], "language string, share double")
    begin = F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARACTERS) / 2).cast("int") + 1)
    drawn = F.pmod("draw", F.lit(1 << 40)) < F.col("share") * float(1 << 40)
    sample = known.join(F.broadcast(shares), "language").where(drawn).select("language", F.col("text").substr(begin, F.lit(SAMPLE_CHARACTERS)).alias("text"))
    bins = sample.mapInArrow(_bin_counts, "language string, bin bigint, n bigint").groupBy("language", "bin").agg(F.sum("n").alias("n"))
    at = {x: i for i, x in enumerate(names)}
    for r in bins.toLocalIterator():
        counts[at[r.language], r.bin] = r.n
    return LetterModel(names, counts)


def _score(model: LetterModel, key_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.languages) + 1
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts):
                flat = pa.array(model.scores(texts[a:b]).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([c[a:b] for c in batch.columns[:-1]] + [lists], names=[*key_names, "scores"])
    return run


def host_levels(url: Column) -> list[Column]:
    """Suffix, registered name and host of an address, coarse to fine; null where there is no address."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return [F.element_at(F.split(host, r"\."), -1), F.substring_index(host, ".", -2), host]


def markup_language(html: Column) -> Column:
    """The primary language that a page's root element declares, lower-case; null if none."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def visible(html: Column) -> Column:
    """Markup and scripts replaced by spaces: enough for letter statistics."""
    html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(html, r"<[^>]*>|&#?[A-Za-z0-9]+;?", " ")


def _normalised(logs: Column) -> Column:
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda s, y: s + y))


def _vector_sum(n: int) -> list[Column]:
    return [F.sum(F.element_at("own", i + 1)).alias(f"c{i}") for i in range(n)]


def identify(ws: Workspace, rows: DataFrame, model: LetterModel, keys: Sequence[str], text: str, declared: str | None,
             levels: Sequence[str]) -> DataFrame:
    """The keys and declared, language, confidence, accepted of every row.

    ``keys`` pass through; ``declared`` names a column with the declared language
    and ``levels`` columns of host levels, coarse to fine. Text of null or without
    letters gives no likelihood; null declarations and hosts give no evidence of
    their own. Rows are accepted with MIN_LETTERS trigrams and a posterior of
    MIN_CONFIDENCE. Without any declared language in the data nothing is accepted.
    """
    n = len(model.languages)
    if not n:
        return rows.select(*keys, (F.col(declared) if declared else F.lit(None).cast("string")).alias("declared"),
                           F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    given = F.lower(F.col(declared)) if declared else F.lit(None).cast("string")
    level_names = [f"__level{i}" for i in range(len(levels))]
    base = rows.select(*keys, given.alias("__declared"), *[F.col(c).alias(a) for c, a in zip(levels, level_names, strict=True)], F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    scored = base.mapInArrow(_score(model, base.columns[:-1]), f"{kinds}, scores array<double>")
    likelihood = F.slice("scores", 1, n)
    scored = ws.cut(scored.withColumn("own", _normalised(likelihood)), "scores")

    overall = scored.agg(*_vector_sum(n), F.count(F.lit(1)).alias("rows")).first()
    share = [((overall[i] or 0.0) + 1.0 / n) / ((overall["rows"] or 0) + 1.0) for i in range(n)]
    lit = F.array(*[F.lit(float(x)) for x in share])
    out = scored.withColumn("__prior", lit)
    for i, name in enumerate(level_names):
        # Finer levels repeat the coarser ones in the key, so that equal names below different parents stay apart.
        key = level_names[:i + 1]
        table = scored.where(F.col(name).isNotNull()).groupBy(*key).agg(*_vector_sum(n), F.count(F.lit(1)).alias("__rows"))
        table = ws.cut(table.select(*[F.col(k).alias(f"{k}_t") for k in key], F.array(*[f"c{j}" for j in range(n)]).alias("__counts"), "__rows"), "level")
        table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
        on = F.col(f"{key[0]}_t").eqNullSafe(F.col(key[0]))
        for k in key[1:]:
            on = on & F.col(f"{k}_t").eqNullSafe(F.col(k))
        out = out.join(table, on, "left").drop(*[f"{k}_t" for k in key])
        # What the other rows of the level say, filled up with PRIOR_ROWS rows of the level above.
        finer = F.zip_with("__counts", F.zip_with("own", "__prior", lambda o, p: F.struct(o.alias("o"), p.alias("p"))),
                           lambda c, x: (F.greatest(c - x["o"], F.lit(0.0)) + PRIOR_ROWS * x["p"])
                           / (F.col("__rows") - 1 + PRIOR_ROWS))
        out = out.withColumn("__prior", F.when(F.col("__rows").isNull(), F.col("__prior")).otherwise(finer)).drop("__counts", "__rows")

    # P(declared | language): mixed with saying nothing about it.
    said = scored.where(F.col("__declared").isNotNull()).groupBy(F.col("__declared").alias("__said")).agg(*_vector_sum(n))
    said = ws.cut(said.select("__said", F.array(*[f"c{j}" for j in range(n)]).alias("__given")), "declared")
    kinds_said = said.count()
    sums = said.agg(*[F.sum(F.element_at("__given", j + 1)).alias(f"s{j}") for j in range(n)]).first()
    totals = F.array(*[F.lit(float(sums[j] or 0.0)) for j in range(n)])
    said = F.broadcast(said) if kinds_said <= BROADCAST_ROWS else said
    out = out.join(said, F.col("__said") == F.col("__declared"), "left")
    rate = F.zip_with("__given", totals, lambda g, t: (g + DECLARED_ROWS / max(1, kinds_said)) / (t + DECLARED_ROWS))
    flat = F.array(*[F.lit(1.0)] * n)
    evidence = F.when(F.col("__given").isNull(), flat).otherwise(rate)
    logs = F.zip_with(likelihood, F.zip_with("__prior", evidence, lambda p, e: F.log(p) + F.log(e)), lambda a, b: a + b)
    out = out.withColumn("__post", _normalised(logs))
    best = F.array_max("__post")
    names = F.array(*[F.lit(x) for x in model.languages])
    return out.select(*keys, F.col("__declared").alias("declared"),
                      F.element_at(names, F.array_position("__post", best).cast("int")).alias("language"), best.alias("confidence"),
                      ((F.element_at("scores", n + 1) >= MIN_LETTERS) & (best >= MIN_CONFIDENCE)).alias("accepted"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """All documents and all pages; a page has doc_id -1 - page_id, so that ids stay apart."""
    ws = Workspace(spark)
    docs, pages = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "pages"))
    model = fit_letters(docs, "text", "lang", "doc_id")
    of_docs = identify(ws, docs.withColumn("page_id", F.lit(None).cast("bigint")), model, ["doc_id", "page_id"], "text", "lang", ["source"])
    suffix, registered, host = host_levels(F.col("url"))
    rows = pages.select((-1 - F.col("page_id")).alias("doc_id"), "page_id", visible(F.col("html")).alias("text"),
                        markup_language(F.col("html")).alias("said"), suffix.alias("suffix"), registered.alias("registered"), host.alias("host"))
    of_pages = identify(ws, rows, model, ["doc_id", "page_id"], "text", "said", ["suffix", "registered", "host"])
    return of_docs.unionByName(of_pages)
