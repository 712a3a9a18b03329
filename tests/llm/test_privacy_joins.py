from veilcell.llm import privacy as pv

from .helpers import documents


def told(spark, ws, rows):
    docs = documents(spark, rows).select("doc_id", "text")
    return pv.told_terms(ws, docs, ws.cut(pv.find_entities(docs), "entities"))


def test_terms_are_joined_alike_at_any_size(spark, ws, capsys):
    rows = [(1, "please ask Zorblatt at zorb@example.org for more", "s")] + [(100 + i, f"please ask for more number {i}", "s") for i in range(300)]
    out = told(spark, ws, rows)
    assert {r.term for r in out.collect()} == {"zorblatt"}
    out.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_common_and_rare_terms_beside_an_entity(spark, ws):
    common = [(1000 + i, "please ask for more", "s") for i in range(2500)]
    rows = [(i, "please ask Zorblatt or Quentin at zorb@example.org and Zorblatt", "s") for i in (1, 2)] + [(3, "Quentin, please ask", "s"), *common]
    got = {(r.doc_id, r.term): (round(r.disclosed, 3), len(r.at)) for r in told(spark, ws, rows).collect()}
    assert got[(1, "zorblatt")] == got[(2, "zorblatt")] == (1.0, 2) and got[(1, "quentin")][0] < 1
    assert not {t for _, t in got} & {"please", "ask"}
