"""Rows with one id, or none, whose texts differ only in the part that is edited."""

from tracelat.llm import simhash


def test_texts_that_differ_in_their_last_third_stay_apart(spark):
    head, ends = "one two three four five six seven eight nine ten ", ("alpha beta gamma ab", "delta kappa omega cd")
    rows = [(None, head + ends[0]), (None, head + ends[1]), (7, head + ends[0]), (7, head + ends[1]), (9, head + ends[0])]
    got = simhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 7), (False, 7), (False, 9), (True, 0), (True, 0)]
    alone = {r.doc_id: r.fingerprint for r in simhash.report(spark.createDataFrame([(1, rows[0][1]), (2, rows[1][1])], "doc_id long, text string")).collect()}
    assert alone[1] != alone[2]
    for doc, both in ((None, set(alone.values())), (7, set(alone.values())), (9, {alone[1]})):
        assert {r.fingerprint for r in got if r.doc_id == doc} == both


def test_ids_reach_every_copy_of_hot_texts(spark):
    """Thousands of rows with one text among others: dealt to several parts, every row gets the same ids as alone."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen " * 3
    rows = [(i, near) for i in range(1, 3001)] + [(5000, near + "then some more words that the copies lack"), (5001, "quite another text that nothing here is like at all"), (5002, None), (5003, "")]
    got = {r.doc_id: r for r in simhash.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), radius=20).collect()}
    assert len(got) == len(rows)
    for i in range(1, 3001):
        assert got[i].n_near == 3000 and got[i].near_ids == ([5000] if i == 1 else [1, 5000])
    assert got[5000].n_near == 3000 and got[5000].near_ids == [1]
    assert got[5001].near_ids == [] and got[5001].n_near == 0
    assert got[5002].near_ids == [] and got[5003].near_ids == [5002] and got[5002].n_near == got[5003].n_near == 1
    few = {r.doc_id: r for r in simhash.report(spark.createDataFrame(rows, "doc_id long, text string"), query=simhash.F.col("doc_id") % 50 == 0, radius=20).collect()}
    assert all((few[i].n_near, few[i].near_ids) == ((got[i].n_near, got[i].near_ids) if i % 50 == 0 else (None, None)) for i in got)
