import re
from collections import Counter

from tests.compare import connect, differences
from veilcell.llm import rules

from .helpers import documents, odd_rows


def plain(text):
    """The measurements by their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = re.findall("[A-Za-z]", text)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(re.findall("[A-Z]", text)), len(letters),
            max(map(len, words), default=0))


TEXTS = [None, "", " \n\t\x0b\x0c\r ", "a", "a a", "a a a", "a a a a", "a b c a b c", "a b c x a b c", "Über all  é\x1cx\x85y",
         "one\ntwo\none\n\n \n one\none ", "###$ $ <b> | |", "A B " * 30, "x y z " * 40 + "p q", "\U0001f600 \U0001f600\n\U0001f600 \U0001f600"]


def test_measurements_equal_their_definition(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + odd_rows()
    got = rules.rule_ledger(documents(spark, rows)).select("doc_id", *rules.MEASURES).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((d, *plain(t))) for d, t, _ in rows)
    assert rules.rule_ledger(documents(spark, [])).count() == 0


def test_bits_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "s"), (2, good + " ### $$$", "s"), (3, "few words", "s"), (4, "FEW ###", "s"), (5, good.upper(), "s"), (6, None, "s")]
    ledger = rules.rule_ledger(documents(spark, rows))
    names = {r.doc_id: {x.name for x in rules.RULES if r.failed & x.mask} for r in ledger.collect()}
    assert names == {1: set(), 2: set(), 3: {"few_words"}, 4: {"few_words", "symbols", "capitals"}, 5: {"capitals"}, 6: {"few_words"}}
    kept = {r.doc_id: (r.kept_1, r.kept_2) for r in rules.with_verdicts(ledger).collect()}
    assert kept == {1: (True, True), 2: (True, True), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, False)}
    effect = {r.rule: (r.n_docs, r.n_kept, r.n_failed, r.n_only) for r in rules.ablations(ledger).collect()}
    assert effect["few_words"] == (6, 2, 3, 2) and effect["capitals"] == (6, 2, 2, 1) and effect["symbols"] == (6, 2, 1, 0)
    none = rules.ablations(rules.rule_ledger(documents(spark, []))).collect()
    assert len(none) == len(rules.RULES) and {(r.n_docs, r.n_failed, r.words_only) for r in none} == {(0, 0, 0)}


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(rules.op13_quality_rules(spark, folder), connect(folder), rules.OP13_SQL) == []


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    verdicts = rules.op13_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    good = verdicts.where("quality = 1 and not base_failed")
    assert good.where("kept").count() > 0.98 * good.count()
    assert verdicts.where("quality = 0 and kept").count() < 0.5 * verdicts.where("quality = 0").count()
