"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit for each rule that the document fails, so a policy is only a mask: it can
be changed, compared or taken apart rule by rule without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace

WINDOW = 3  # words of a window that may repeat
SYMBOLS = b"#*$%&|<>"
_INNER = bytes(range(0x80, 0xC0))  # bytes that continue a UTF-8 character
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters", "longest_word")


@dataclass(frozen=True)
class Rule:
    """A named condition under which a document fails; ``bit`` is its place in the ledger for good."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


# Bits are never given to another rule: ledgers already written keep their meaning.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 3 * n_words"),
    Rule(5, "long_words", "word_chars > 10 * n_words"),
    Rule(6, "capitals", "2 * n_capitals > n_letters"),
    Rule(7, "endless_word", "longest_word > 1000"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the rules that drop a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        by_name = {r.name: r.mask for r in RULES}
        return reduce(int.__or__, [by_name[name] for name in self.rules], 0)


POLICIES = (Policy("1", BASE), Policy("2", tuple(r.name for r in RULES)))


def repeated_words(words: Sequence[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that the text holds twice or more."""
    starts = len(words) - width + 1
    if starts < 2:
        return 0
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    windows = numbers[:starts]
    for j in range(1, width):  # pairs of numbers are numbered again, so they always fit
        pairs = windows * len(known) + numbers[j:j + starts]
        _, windows, times = np.unique(pairs, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[windows] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + width, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def measured(text: bytes) -> tuple[int, ...]:
    """The measurements of one text in the order of ``MEASURES``."""
    words = text.split()  # at 0x20 and 0x09-0x0D only, as the text is in bytes
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    small = len(text) - len(text.translate(None, _SMALL))
    return (len(words), len(b"".join(words).translate(None, _INNER)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words), capitals, capitals + small,
            max([len(w.translate(None, _INNER)) for w in words], default=0))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measured(t or b"") for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *MEASURES])


def rule_ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: doc_id, all measurements, and ``failed`` with the bit of every rule it fails.

    A null text has no words and measures 0 throughout, as an empty one does. Ids
    pass through, null and repeated ones too; an empty table gives no rows. Other
    columns are not read. Words are parted by ASCII white space, lines by ``\\n``;
    only lines with a word count.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_measure, ", ".join([f"doc_id {kind}", *[f"{m} bigint" for m in MEASURES]]))
    bits = [F.when(F.expr(r.fails), F.lit(r.mask)).otherwise(F.lit(0)).cast("bigint") for r in rules]
    return counted.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def with_verdicts(ledger: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` per policy."""
    return ledger.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablations(ledger: DataFrame, policy: Policy = POLICIES[-1], rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of a policy does: one row per rule with version, rule, n_docs, n_kept, n_failed, n_only, words_only.

    n_failed counts the documents that fail the rule, n_only those that would stay
    without it, words_only their words. Documents are first counted by their set
    of failed rules, at most 2^rules groups, so a rule costs no pass of its own.
    An empty ledger gives zeros.
    """
    mine = [r for r in rules if r.mask & policy.mask]
    sets = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("failed")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
    whole = [F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"),
             F.coalesce(F.sum(F.when(F.col("failed") == 0, F.col("docs"))), F.lit(0)).alias("n_kept")]
    each = [F.struct(F.lit(r.name).alias("rule"), *[
        F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).alias(name) for hit, c, name in (
            (F.col("failed").bitwiseAND(F.lit(r.mask).cast("bigint")) != 0, "docs", "n_failed"),
            (F.col("failed") == r.mask, "docs", "n_only"), (F.col("failed") == r.mask, "words", "words_only"))]) for r in mine]
    one = sets.agg(*whole, F.array(*each).alias("each"))
    return one.select(F.lit(policy.version).alias("version"), "n_docs", "n_kept", F.inline("each"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    ledger = Workspace(spark).cut(rule_ledger(spark.read.parquet(f"{folder}/documents.parquet")), "ledger")
    judged = with_verdicts(ledger)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~F.col("kept_1")).alias("base_failed"), F.col("kept_2").alias("kept"), "failed")


OP13_SQL = r"""
with parted as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
spots as (
  select r, unnest(w) as a, unnest(range(len(w))) as i from parted),
windows as (
  select r, i, a, lead(a) over o as b, lead(a, 2) over o as c from spots window o as (partition by r order by i)),
again as (
  select r, i, count(*) over (partition by r, a, b, c) as times from windows where c is not null),
hit as (
  select r, count(distinct i + j) as n from again, (values (0), (1), (2)) x(j) where times > 1 group by r),
m as (
  select p.doc_id, cast(len(w) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    cast(coalesce(hit.n, 0) as bigint) as n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as n_letters,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0) as longest_word
  from parted p left join hit using (r)),
f as (
  select *, cast((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > n_words)::int
    + 8 * (100 * n_dup_lines > 30 * n_lines)::int + 16 * (word_chars < 3 * n_words)::int + 32 * (word_chars > 10 * n_words)::int
    + 64 * (2 * n_capitals > n_letters)::int + 128 * (longest_word > 1000)::int as bigint) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed
from f
"""
