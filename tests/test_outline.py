import random
import time

from quire.operators import stitching


def expected(pages, most):
    out, seen = {}, []
    for doc, n, md in sorted(pages):
        seen = seen if out and last == doc else []  # noqa: F821
        last = doc
        out[doc, n] = "\n".join(seen[-most:])
        seen = seen + [x for x in (md or "").split("\n") if x.split(" ")[0] in ("#", "##", "###", "####") and " " in x]
    return out


def test_outline_equals_a_fold(spark):
    rng = random.Random(4)
    pages = [(d, n, rng.choice([None, "", "words", "# a", f"## {n}\nx\n### b\n##### no\n#no", "\n".join(f"# {n}.{k}" for k in range(rng.randint(0, 9)))])) for d in range(30) for n in range(rng.randint(0, 40)) if rng.random() < 0.9]
    df = spark.createDataFrame(pages, "doc_id int, page_num int, md string")
    for most in (1, 5, 80):
        got = {(r.doc_id, r.page_num): r.outline for r in stitching.rolling_outline(df, most).collect()}
        assert got == expected(pages, most)


def test_outline_of_a_long_document(spark):
    """Work in proportion to the pages: a document of 40,000 takes less than eight times one of 10,000 in all."""

    def seconds(n):
        pages = spark.range(n).selectExpr("1 as doc_id", "cast(id as int) as page_num", "concat('# part ', id, '\n## a\n## b\n', if(id % 7 = 0, 'text', '# c')) as md")
        began = time.time()
        stitching.rolling_outline(pages).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(100)
    short = seconds(10_000)
    assert seconds(40_000) < 8 * short + 2
