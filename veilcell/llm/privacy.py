"""Information-theoretic removal of personal data, with DataFrame functions only.

Patterns find the protected entities: addresses, numbers and cards. How much a
term of a document tells about an entity of it is its pointwise mutual information
with the entity over the corpus, as a share of the entity's own information. Terms
beyond one threshold are generalised, beyond a second one removed, wherever they
stand in a document with the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace

GENERALISE = 0.8  # share of an entity's information from which a term is generalised
REMOVE = 0.95
COMMON_SHARE = 1_000  # terms of more than 1/1000 of the documents are common
BLOCK = 256  # matches whose positions are summed in one list

KINDS = ("email", "ip", "card", "phone", "general", "remove")
TERM = r"\p{L}{3,}"

# The four patterns, so written that each start is tried once: a run of one class is
# entered at its beginning or at the end of the match before, and never given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed one time, also where ``use`` has it in a loop."""
    return F.get(F.transform(F.array(value), use), 0)


def located(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of spans in code points, end exclusive.

    The pieces between matches come from a split by the same pattern; positions
    are running sums of the lengths of pieces and matches, within blocks of BLOCK
    matches and over the blocks, so long lists are not copied per match. Only
    valid matches are kept.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
                       lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        longer = F.concat(state["spans"], F.array(span))
        return F.struct(end.alias("at"), (longer if valid is None else F.when(valid(pair["value"]), longer).otherwise(state["spans"])).alias("spans"))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]

    def all_spans(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["value"])))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), spans))

    cut = _once(pairs, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), lambda i: F.slice(p, i, BLOCK)))
    some = F.size(found) > 0 if valid is None else F.exists(found, valid)
    return F.when(some, _once(cut, all_spans)).otherwise(none)


def passes_luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """All entities of a text by position, then in the order of KINDS; matches that fail their test are dropped."""
    none = F.array().cast(f"array<{SPAN}>")
    digits = lambda value: F.regexp_replace(value, "[^0-9]", "")
    email = F.when(F.instr(text, "@") > 0, located(text, EMAIL, 0)).otherwise(none)
    ip = located(text, IP, 1, lambda value: value.rlike(IP_PARTS))
    card = located(text, CARD, 2, lambda value: F.when(F.length(digits(value)).between(14, 19), passes_luhn(digits(value))).otherwise(False))
    phone = F.when(F.instr(text, "+") > 0, located(text, PHONE, 3, lambda value: F.length(digits(value)).between(10, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column) -> Column:
    """The text with spaces in place of addresses, the only entities with letters in them."""
    found = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    blanks = F.concat(F.transform(found, lambda v: F.repeat(F.lit(" "), F.length(v))), F.array(F.lit("")))
    pieces = F.zip_with(F.split(text, EMAIL, -1), blanks, lambda gap, blank: F.concat(gap, blank))
    return F.when(F.instr(text, "@") > 0, F.array_join(pieces, "")).otherwise(text)


def find_entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, entities, words) of every whole text; words are the terms outside entities where there is an entity."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    rows = rows.select("doc_id", "text_hash", "text", base_spans(F.col("text")).alias("entities"))
    words = F.transform(located(masked(F.col("text")), TERM, 4), lambda s: F.struct(
        F.lower(s["value"]).alias("term"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", "text_hash", "entities", F.when(F.size("entities") > 0, words).alias("words"))


def told_terms(ws: Workspace, docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, term, at, disclosed) of terms that disclose an entity of their document, with all places of the term.

    Documents are counted over the whole corpus: those with the entity, with the
    term, and with both, anywhere in the text. ``disclosed`` is
    log(N * n(e,t) / (n(e) * n(t))) / log(N / n(e)), at most 1. Entities of the same
    documents have the same scores and are counted once as a set. As n(e,t) <= n(e),
    no term of more than N**(1 - G) * n(e)**G documents reaches the share G, so
    such pairs are not counted.
    """
    names = F.array_distinct(F.transform("entities", lambda e: F.concat_ws(":", e["kind"].cast("string"), F.lower(e["value"]))))
    key = ["doc_id", "text_hash"]
    holders = ws.cut(found.where(F.size("entities") > 0).groupBy(*key).agg(
        F.count(F.lit(1)).alias("times"), F.first(names).alias("names"), F.first("words").alias("words")), "holders")
    named = holders.select(*key, "times", F.explode("names").alias("entity"))
    sets = named.groupBy("entity").agg(F.sum("times").alias("with_entity"), F.bit_xor(F.xxhash64(*key, "times")).alias("x"),
                                       F.bit_xor(F.xxhash64("times", "text_hash", "doc_id")).alias("y"))
    of_docs = ws.cut(named.join(sets, "entity").groupBy(*key).agg(F.collect_set(F.struct("with_entity", "x", "y")).alias("sets")), "sets")
    n = float(found.count())
    most = F.lit(n ** (1 - GENERALISE) * (1 + 1e-9)) * F.pow("with_entity", F.lit(GENERALISE))
    largest = of_docs.select(F.explode("sets").alias("set")).agg(F.max("set.with_entity")).first()[0] or 0

    terms = ws.cut(holders.select(F.explode("words.term").alias("term")).distinct(), "terms")
    each = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TERM), F.lit(0)), F.lower)
    words = docs.select(F.explode(F.array_distinct(each)).alias("term"))
    # The same joins at any size, so that shuffles and disk grow with the input; the few terms of many documents, which cannot tell
    # an entity, go before the places of the others are shuffled: at most 1,000 times the terms of an average document.
    words = words.groupBy("term").agg(F.count(F.lit(1)).alias("with_term")).join(terms.hint("merge"), "term", "left_semi")
    counted = ws.cut(words, "counted")
    bound = n ** (1 - GENERALISE) * float(largest) ** GENERALISE * (1 + 1e-9)
    rare = counted.where(F.col("with_term") <= bound)
    common = counted.where(F.col("with_term") > max(bound, n / COMMON_SHARE)).select("term")

    places = (holders.select(*key, "times", F.explode("words").alias("w")).select(*key, "times", "w.*")
              .join(F.broadcast(common), "term", "left_anti").join(rare.hint("merge"), "term")
              .groupBy(*key, "times", "term", "with_term").agg(F.collect_list(F.struct("start", "end")).alias("at")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    owners = of_docs.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "sets")
    pairs = places.join(owners, same).select(*key, "times", "term", "with_term", "at", F.explode("sets").alias("set"))
    pairs = ws.cut(pairs.select(*key, "times", "term", "with_term", "at", "set.*").where((F.col("with_term") <= most) & (F.col("with_entity") < n)), "pairs")
    pair = ["with_entity", "x", "y", "term"]
    share = F.log(n * F.col("both") / (F.col("with_entity") * F.col("with_term"))) / F.log(n / F.col("with_entity"))
    told = pairs.groupBy(*pair, "with_term").agg(F.sum("times").alias("both")).select(*pair, F.least(share, F.lit(1.0)).alias("disclosed"))
    told = ws.cut(told.where(F.col("disclosed") >= GENERALISE), "told")
    return pairs.join(told.hint("merge"), pair).groupBy(*key, "term").agg(F.max("disclosed").alias("disclosed"), F.first("at").alias("at"))


def sanitisation(ws: Workspace, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, spans) of every document; spans also hold the terms to generalise or remove.

    Null texts count as empty; null ids and repeated rows keep their rows. Of
    several entities in a document the strongest disclosure of a term decides, and
    all its places in the document are marked.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = ws.cut(find_entities(docs), "entities")
    more = (told_terms(ws, docs, found).withColumn("kind", F.when(F.col("disclosed") >= REMOVE, 5).otherwise(4))
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "term", "kind", F.explode("at").alias("p"))
            .groupBy("__id", "__hash").agg(F.collect_list(F.expr("struct(p.start AS start, kind, p.end AS end, term AS value)")).alias("more")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    joined = found.select("doc_id", "text_hash", F.col("entities").alias("base")).join(more, same, "left")
    none = F.array().cast(f"array<{SPAN}>")
    return joined.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by the name of its kind in brackets; what is removed leaves nothing.

    Spans that overlap one before them are part of it.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:-1]], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1))
        later = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(later, piece).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.lit(2**31 - 1)))


def op5_privacy(spark: SparkSession, folder: str) -> DataFrame:
    rows = sanitisation(Workspace(spark), spark.read.parquet(f"{folder}/documents.parquet"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
                       F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
