"""The sample that tells a page's language: what is cut off it, and that it is worked out once."""

import re

from pyspark.sql import functions as F

from tessera.functions import language as L


def test_sample_is_worked_out_once_and_is_what_the_patterns_leave(spark):
    texts = ["---\nt: x\n---\n" + "слово и дело " * 4, "\n---\n---\n" + "слово " * 9, "abc\n---\nслово слово слово слово", "x$слово слово слово слово$ short", "$$a\nслово слово слово$$ $", "```\nслово слово слово слово\n``` `` word word word word", "```слово слово слово слово", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def short(t):
        for p in (r"\A[\s\S]{3}[\s\S]*?\n---\n", r"```[\s\S]*?```", r"\$\$[\s\S]*?\$\$", r"\$[^$\n]*\$"):
            t = re.sub(p, "", t)
        return len(t.strip(" ")) < 20

    # none of them is in Chinese, so only those whose sample is short pass
    out = df.select("i", L.language_matches(F.col("t"), F.lit("Chinese")).alias("fits"))
    assert {r.i: r.fits for r in out.collect() if texts[r.i] is not None} == {i: short(t) for i, t in enumerate(texts) if t is not None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^$\\n]*") == 1
