"""Lines of which many share a key and few are alike."""

import random

from noticewing.llm import lines


def test_a_large_group_makes_no_row_for_each_pair(spark, monkeypatch):
    """240 lines alike by 0.77 to each other, of which some have a variant alike by 0.96: only those go."""
    rng = random.Random(7)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    common = [f"c{i}" for i in range(40)]
    sets = [common + own(6) for _ in range(240)]
    sets += [[*sets[k][:-1], *own(1)] for k in (100, 150, 200)]
    rows = [(k, " ".join(s)) for k, s in enumerate(sets)]
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {k for k, s in enumerate(sets) if any(jaccard(s, r) >= 0.8 for r in sets[:k])}
    assert want == {240, 241, 242}
    made = []

    def counted(name):
        old = getattr(lines, name)

        def new(first, *rest):
            made.append((name, first.columns, first.count()))
            return old(first, *rest)

        monkeypatch.setattr(lines, name, new)

    counted("_verified")
    counted("written")
    got = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {r["doc_id"] for r in got} == want
    keys = max(n for _, columns, n in made if "kind" in columns)
    assert all(n <= keys for _, _, n in made), made
