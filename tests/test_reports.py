"""Reconstruction, reports, clients, lineage trees, expectation files."""

from tenet.operators.reconstruct import reconstruct
from tenet.operators.report import client, failures, lineage_tree, parse_expectations, render
from tenet.store import Store


def test_reports(spark):
    s, _ = Store.empty(spark, clock=lambda: 1).ingest("checkout/errors CAUSED-BY db/slow @ 90%\ndb/slow CAUSED-BY disk @ 50%\ndisk IS hardware @ 4%\nservice EXPECTS owner #cardinality:one\na USES b\n  BECAUSE c\n    BECAUSE d")
    walk = reconstruct(s.claims, "checkout/errors")
    assert [v for v, _ in walk.visited] == ["checkout/errors", "db/slow", "disk"] and abs(walk.visited[2][1] - 0.8 * 0.9 * 0.8 * 0.5) < 1e-9
    out = render("# R\n```query\n?x USES ?y\n```\n{{?c CAUSE checkout/errors}}", s.query)
    assert "| a | b |" in out and out.endswith("db/slow")
    source, digest = client(s.claims)
    assert "class Service:" in source and "owner: str" in source and client(s.claims)[1] == digest
    root = s.claims.where("subject = 'a'").first()["id"]
    tree = lineage_tree(spark, s.claims, s.edges, root)
    assert tree["children"][0]["role"] == "BECAUSE" and tree["children"][0]["children"][0]["children"] == []
    good = parse_expectations("?x USES b\n  ?x = a\nzz USES ?y\n  none\n?c CAUSE ?e\nWHERE conf >= 80%\n  ?c = db/slow, ?e = checkout/errors\n?x IS hardware\n")
    assert failures(good, s.query) == []
    assert len(failures(parse_expectations("?x USES b\n  ?x = q\n"), s.query)) == 1
