"""Repeated and missing ids."""


def test_deduplicate_leaves_rows_without_id_alone(edges):
    from tracelat.llm import minhash

    kept = [minhash.deduplicate(df).collect() for df in (edges, edges.repartition(5, "text"), edges.orderBy("text", ascending=False))]
    for rows in kept:
        assert {r.text for r in rows if r.doc_id is None} == {None, "no id but some text"}
        assert sum(r.doc_id is None for r in rows) == 2
        assert sorted(r.text for r in rows if r.doc_id == 8) == ["same id, other text", "same row twice here"]  # one row for each text
