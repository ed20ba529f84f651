"""Texts are searched once, and only those that may hold a span."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.operators import spans
from ledgerloom.plans import queries


def test_each_recogniser_searches_a_text_once(spark):
    for query in (queries.q_entity_counts, queries.q_entity_modes):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= len(spans.RECOGNISERS)


def test_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    pieces = ["12-3456789", "123-45-6789", "a.b@c.de", "(123) 456-7890", "1234567890123456", "A12345678", "A1234567", "GB12ABCDEF123456789", "1.22.333.4", "_", "x", "9", "-", " ", "\u00e9", "."]
    texts = ["", None, "no mark", "@", "7", *("".join(rng.choices(pieces, k=6)) for _ in range(400))]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", spans.detect(F.col("text")).alias("s")).collect()
    for i, s in found:
        if texts[i] is None:
            assert s is None
        else:
            assert [(x.entity_type, x.start, x.end) for x in s] == [(k, *m.span()) for k, (p, _) in spans.RECOGNISERS.items() for m in re.finditer(p, texts[i], re.ASCII)]
