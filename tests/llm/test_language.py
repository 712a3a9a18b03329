import random

import pyarrow as pa
from pyspark.sql import functions as F

from veilcell.llm import language as lg

from .helpers import documents, odd_rows

SAMPLES = {"en": "the house and the river are near that old town with many people who work there every day",
           "de": "das haus und der fluss sind nahe der alten stadt mit vielen menschen die dort jeden tag arbeiten",
           "fr": "la maison et la rivière sont près de cette vieille ville avec beaucoup de gens qui y travaillent"}


def labelled(spark, n=40):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        lang = list(SAMPLES)[i % 3]
        rows.append((i, " ".join(rng.sample(SAMPLES[lang].split(), 12)), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_text_decides_against_a_wrong_declaration(spark, ws):
    docs = labelled(spark)
    model = lg.fit_letters(docs, "text", "lang", "doc_id")
    assert model.languages == ["de", "en", "fr"]
    rows = docs.unionByName(spark.createDataFrame([(100, SAMPLES["fr"], "en"), (101, SAMPLES["de"], None), (102, "12 34", "en"), (103, None, None)], docs.schema))
    got = {r.doc_id: r for r in lg.identify(ws, rows.withColumn("source", F.lit("s")), model, ["doc_id"], "text", "lang", ["source"]).collect()}
    assert all(got[i].language == list(SAMPLES)[i % 3] and got[i].accepted for i in range(40))
    assert got[100].language == "fr" and got[101].language == "de"
    assert not got[102].accepted and not got[103].accepted


def test_all_declared_languages_are_told_apart(spark, ws):
    rng = random.Random(1)
    words = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(8)] for i in range(70)}
    rows = [(i * 3 + j, " ".join(w), x.upper() if j else x) for i, (x, w) in enumerate(words.items()) for j in range(3 if i else 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lg.fit_letters(docs, "text", "lang", "doc_id")
    assert model.languages == sorted(words)
    for i, w in enumerate(words.values()):
        assert model.scores(pa.array([" ".join(w)]))[0, :-1].argmax() == i


def test_hosts_help_short_texts(spark, ws):
    model = lg.fit_letters(labelled(spark), "text", "lang", "doc_id")
    pages = [(i, f"https://www.stadt.de/{i}", SAMPLES["de"]) for i in range(30)] + [(50, "http://www.stadt.de/x", "ist"), (51, None, "ist"), (52, "http://neu.de:80/", "ok")]
    pages += [(60 + i, f"https://town.co.uk/{i}", SAMPLES["en"]) for i in range(30)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, text string")
    suffix, registered, host = lg.host_levels(F.col("url"))
    df = df.select("page_id", "text", suffix.alias("suffix"), registered.alias("registered"), host.alias("host"), F.lit(None).cast("string").alias("said"))
    got = {r.page_id: r for r in lg.identify(ws, df, model, ["page_id"], "text", "said", ["suffix", "registered", "host"]).collect()}
    assert len(got) == len(pages)
    assert got[50].language == "de" and got[50].confidence > got[51].confidence
    assert got[52].language == "de"


def test_markup_and_addresses(spark):
    df = spark.createDataFrame([("<!DOCTYPE html>\n<HTML class='x' lang=\"DE-at\">", "https://u:p@A.b.Example.ORG:8080/x?q#f"), ("<p>", "nonsense"), (None, None)], "html string, url string")
    got = df.select(lg.markup_language(F.col("html")).alias("l"), F.array(*lg.host_levels(F.col("url"))).alias("h")).collect()
    assert [r.l for r in got] == ["de", None, None]
    assert got[0].h == ["org", "example.org", "a.b.example.org"] and got[1].h == [None] * 3 == got[2].h


def test_odd_rows(spark, ws):
    docs = documents(spark, odd_rows())
    model = lg.fit_letters(docs, "text", "lang", "doc_id")
    assert lg.identify(ws, docs, model, ["doc_id"], "text", "lang", ["source"]).count() == len(odd_rows())
    none = documents(spark, [])
    empty = lg.fit_letters(none, "text", "lang", "doc_id")
    assert empty.languages == [] and lg.identify(ws, none, empty, ["doc_id"], "text", "lang", ["source"]).count() == 0
    assert lg.identify(ws, docs, empty, ["doc_id"], "text", "lang", ["source"]).where("accepted").count() == 0
    assert lg.LetterModel(["a"], __import__("numpy").ones((1, lg.BINS))).scores(pa.array([None, "", "ab"])).shape == (3, 2)


def test_query_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.001"
    got = lg.op3_language_id(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    both = got.where("page_id is null").join(docs, "doc_id")
    assert both.count() == docs.count()
    assert both.where("language = lang and accepted").count() >= 0.97 * docs.count()
    assert got.where("page_id is not null").count() == spark.read.parquet(f"{folder}/pages.parquet").count()
