import duckdb
import edge

from loadcast.llm import licences, oracles

WHOLE = ("Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1",
         "LGPL-3.0", "MPL-1.1", "MPL-2.0")


def test_whole_texts_of_longer_licences_are_known(spark):
    texts = {name: max((t for k, t in licences.KNOWN if k == name), key=len) for name in WHOLE}
    assert all(len(t) > 5000 for t in texts.values())
    rows = [edge.row(i, " ".join(texts[name].upper().split(" "))) for i, name in enumerate(WHOLE)]
    rows += [edge.row(100 + i, texts[name] + "\nand more") for i, name in enumerate(WHOLE)]
    found = {r.doc_id: (r.canonical_sha256, r.licence, r.notices) for r in licences.scan(edge.frame(spark, rows)).collect()}
    assert [found[i][1] for i in range(len(WHOLE))] == list(WHOLE)
    assert all(found[100 + i][1] is None for i in range(len(WHOLE)))
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
        assert {r[0]: r[1:] for r in db.execute(oracles.ORACLES["op4_licences"]).fetchall()} == found
