"""Terms looked for by position, against plain Python."""

import random
import re

from loomgraph.operators import terms


def times(term, text):
    lead = r"(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", term) else r"(?<=[A-Za-z0-9_])"
    tail = r"(?![A-Za-z0-9_])" if re.search(r"[A-Za-z0-9_]$", term) else ""
    return len(re.findall(lead + re.escape(term) + tail, text))


def test_places_of_terms_equal_plain_search(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice(["a", "b", "ab", " ", "-", ".", " ", "é", "😀", "\n"]) for _ in range(n))
    held = [(k % 7, text(rnd.randrange(60))) for k in range(60)]
    held += held[:5] + [(3, None), (4, ""), (None, "a b a b a"), (None, "a b a b a")]
    asked = sorted({text(rnd.randrange(1, 6)) for _ in range(80)} | {"a b a", "a a", "a b a b", "--", "a -"})
    docs = spark.createDataFrame(held, "doc int, text string").repartition(3)
    known = spark.createDataFrame([(t,) for t in [*asked, None, ""]], "term string")
    want: dict = {}
    for key, t in ((key, t) for key, x in held for t in asked for _ in range(times(t, x or ""))):
        want[key, t] = want.get((key, t), 0) + 1
    # in every task, and by a shuffle
    for most in (terms.HELD_BYTES, 0):
        assert {(r["doc"], r["term"]): r["n"] for r in terms.pick_terms(known, docs, held_bytes=most).collect()} == want
    assert terms.pick_terms(known.limit(0), docs).count() == 0 and terms.pick_terms(known, docs.limit(0)).count() == 0


def test_a_term_is_looked_for_by_the_token_that_fewest_have(spark):
    known = spark.createDataFrame([("the code",), ("the graph",), ("the",), ("a a",)], "term string")
    told = {r["term"]: (r["anchor"], r["at"], r["laps"]) for r in terms.anchors(known).collect()}
    assert told == {"the code": ("code", 2, False), "the graph": ("graph", 2, False), "the": ("the", 0, False), "a a": ("a", 0, True)}


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc int, text string")
    plan = terms.pick_terms(spark.createDataFrame([("a b",), ("a",)], "term string"), docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
