import random
import re

from pyspark.sql import functions as F

from veilcell.llm import privacy as pv

from .helpers import documents, odd_rows

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    turned = [int(c) for c in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0


def expected(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, kind != 1 or all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", pv.base_spans(F.coalesce("text", F.lit(""))).alias("s")).orderBy("i").collect()
    return [[(s.start, s.kind, s.end) for s in r.s] for r in rows]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(0)
    pieces = ["a@b.c", "x.y+z@d-e.f.g", "_", "@", ".", "1.2.3.4", "256.1.1.1", "001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (706) 555-3138",
              "+", "(", ")", " ", "-", "5", "12", "é", "\U0001f600", "\n", "a", "%", "+49 30 1234567", "1.2.3.4.5.6.7.8", "378282246310005", "00000000000000"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b.c@d.e.f", "x@y..z", "9" * 3_000, "a" * 3_000 + "@", "a." * 9_000 + "@b" + ".c" * 9_000, "+1" * 9, None, ""]
    assert found(spark, texts) == [expected(t) for t in texts]


def test_terms_that_tell_an_entity_are_marked(spark, ws):
    rows = [(i, f"Please ask Zorblatt in room {i} the and the at zorb@example.org for more", "s") for i in range(6)]
    rows += [(100 + i, f"please ask for the other room and more number {i}", "s") for i in range(300)]
    rows += [*odd_rows(), (900, "mail zorb@example.org", "s")]
    got = {}
    texts = {d: t for d, t, _ in rows if d is not None}
    out = pv.sanitisation(ws, documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        got.setdefault(r.doc_id, r)
        assert [s for s in r.spans if s.kind < 4] == r.base
    marked = {texts[0][s.start:s.end].lower() for s in got[0].spans if s.kind >= 4}
    assert "zorblatt" in marked and not {"please", "ask", "the", "and", "room", "more"} & marked
    assert all(s.kind < 4 for s in got[100].spans)


def test_entity_of_one_text_is_assessed(spark, ws):
    rows = [(1, "please ask Zorblatt at zorb@example.org for more", "s")] + [(100 + i, f"please ask for more number {i}", "s") for i in range(300)]
    got = {r.doc_id: r.spans for r in pv.sanitisation(ws, documents(spark, rows)).collect()}
    assert [(s.value, s.kind) for s in got[1]] == [("zorblatt", 5), ("zorb@example.org", 0)]
    assert not any(got[100 + i] for i in range(300))


def test_terms_far_from_the_entity_are_marked(spark, ws):
    common = "please ask for more and more of the same " * 20
    text = f"zorb@example.org {common} signed Zorblatt {common} Zorblatt"
    rows = [(1, text, "s"), (None, text + ".", "s")] + [(100 + i, f"{common} signed number {i}", "s") for i in range(300)]
    got = {r.doc_id: r.spans for r in pv.sanitisation(ws, documents(spark, rows)).collect()}
    places = [i for i in range(len(text)) if text.startswith("Zorblatt", i)]
    for d in (1, None):
        assert [(s.start, s.value) for s in got[d]] == [(0, "zorb@example.org"), *[(i, "zorblatt") for i in places]]
    assert not any(got[100 + i] for i in range(300))


def test_terms_have_all_their_places(spark):
    text = "İstanbul été x@y.zz " + "ab abc 1.2.3.4 \U0001f600 wörter, " * 700 + "name@wort.de ende"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = pv.find_entities(df).first().words
    rest = re.sub(PATTERNS[0], lambda m: " " * len(m[0]), text)
    assert [(w.start, w.end) for w in got] == [m.span() for m in re.finditer(r"[^\W\d_]{3,}", rest)]
    assert all(text[w.start:w.end].lower() == w.term for w in got)


def test_redaction(spark):
    text = "é write a@b.c or 1.2.3.4 now"
    df = spark.createDataFrame([(text,)], "text string").withColumn("spans", pv.base_spans(F.col("text")))
    assert df.select(pv.redacted(F.col("text"), F.col("spans"))).first()[0] == "é write [EMAIL] or [IP] now"
    assert df.select(pv.redacted(F.col("text"), F.array().cast(f"array<{pv.SPAN}>"))).first()[0] == text


def test_empty_table(spark, ws):
    assert pv.sanitisation(ws, documents(spark, [])).count() == 0


def test_query_equals_plain_patterns(spark):
    import hashlib

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pv.op5_privacy(spark, folder).collect()}
    for d, t in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        spans = expected(t)
        text = ",".join(f"{pv.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[d][f"n_{n}"] for n in pv.KINDS[:4]] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(got[d].spans.split(","))
