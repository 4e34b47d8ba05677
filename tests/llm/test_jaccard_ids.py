"""Links where one doc_id has several different texts."""

from varileaf.llm import jaccard


def test_texts_of_one_id(spark):
    def words(a, n):
        return " ".join(f"{a}{i}" for i in range(n))

    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    given = [(1, a), (1, b), (2, b + " more"), (3, a + " end"), (4, c), (5, c + " tail"), (5, words("d", 40)), (6, words("d", 40) + " last"), (7, words("e", 30))]
    for order in (given, given[::-1]):
        out = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert {(i, c) for i, _, c in out} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)}
        assert {n for i, n, _ in out if i == 5} == {57, 36}
