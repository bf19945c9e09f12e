"""Runs of words that make a target, against every run of a page."""

from stratadoc.functions import text as T
from stratadoc.operators import pages as P


def test_locate_text_against_every_run(spark):
    texts = {1: ["x", "", " ", "Ab", "c", "", "d", "ab", "CD"], 2: ["", "ab", "cd", None, "ab", " ", "cd"], 3: ["abc", "d"], 4: ["", "", "zz"]}
    words = [(page, 3 * k + 1, text, float(k), float(k) + 0.5) for page, line in texts.items() for k, text in enumerate(line)]
    targets = [(page, n, target) for page in texts for n, target in enumerate(["abcd", "AB c D", "Abcd", "ab", "d", "", "zz"])]
    form = lambda text: "".join(text.split()).lower()
    want = set()
    for page, n, target in targets:
        line = [w for w in words if w[0] == page]
        for i, first in enumerate(line):
            for j in range(i, len(line)):
                said = "".join(form(w[2]) for w in line[i : j + 1] if w[2] is not None)
                if target and said == form(target) and first[2] is not None and line[j][2] is not None and form(line[j][2]):
                    raw = "".join(w[2] for w in line[i : j + 1] if w[2] is not None)
                    want.add((page, n, first[1], line[j][1], first[3], line[j][4], "exact_text" if raw == target else "normalized_text"))
    given = spark.createDataFrame(words, "page_id int, word_no long, text string, x0 double, x1 double")
    df = P.locate_text(given, spark.createDataFrame(targets, "page_id int, target_id int, target string"), T.norm_text)
    # offsets are worked out for words that begin targets and for all other places, no more
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Window [sum(") <= 2
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 12
