"""Rejection limits of operator 9: one odd row does not set them, every usable row counts, every label is learned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from molframe.llm import langid
from tests.llm import brute
from tests.llm.test_documents import language_rows


def usable(rows):
    return [r for r in rows if r[2] is not None and brute.remainder(r[0], 4) != 2]


def test_odd_rows_do_not_set_the_limit(spark):
    rng = np.random.default_rng(4)
    strange = lambda: " ".join("".join(rng.choice(list("qxzvwkj"), 6)) for _ in range(40))
    odd = [(5000 + k, strange(), "abc"[k % 3] * 2, "s", 0) for k in range(12)]
    models = langid.train(spark.createDataFrame(language_rows() + odd, brute.DOCS), sample_bytes=12000)
    assert models.languages == ["aa", "bb", "cc"] and (models.limit - models.median < 2).all()
    assert models.predict([strange()])[0][2]


def test_limits_take_all_rows_not_fitted_on(spark):
    frame = spark.createDataFrame(language_rows(), brute.DOCS)
    rows = langid.usable_rows(frame, sample_bytes=4000)
    fitted = rows.filter("fitted").count()
    assert 3 <= fitted < 100 and rows.count() == len(usable(language_rows()))
    models = langid.train(frame, sample_bytes=4000)
    left = rows.filter("NOT fitted").collect()
    for number, name in enumerate(models.languages):
        bits, chars = models.entropy([r.text for r in left if r.lang == name])
        own = bits[chars >= langid.PRIOR_CHARS, number]
        assert abs(np.median(own) - models.median[number]) < 0.05


def test_every_label_is_learned(spark):
    few = [(8000 + k, "ra ne vo ti " * 40000, "dd", "s", 0) for k in range(8)]
    frame = spark.createDataFrame(language_rows() + usable(few) + [(8100, "123 456", "ee", "s", 0)], brute.DOCS)
    assert langid.train(frame, sample_bytes=1).languages == ["aa", "bb", "cc", "dd"]
    assert langid.usable_rows(frame, sample_bytes=1).filter(F.col("fitted")).count() == 4
