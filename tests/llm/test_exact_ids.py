"""Ids that a double cannot tell apart, beside a null in the same batch, through every operator that runs Python."""

from __future__ import annotations

import pytest

from tallybar.llm import doc_fingerprint, fm_dedup, html_extract, license_scan, quality, radix_dedup, simhash
from tests.llm.helpers import table

IDS = [2**60 + 1, 2**60 + 3, None, 5]
TEXTS = ["the first of some texts that have nothing in common", "another one of them which says under the mit license", "third and without a name", "under the mit licence of old"]


def docs(spark):
    return table(spark, TEXTS, ids=IDS).coalesce(1)


MODEL = quality.Model(quality.np.array([1, 2]), quality.np.array([0.5, -0.5]), quality.np.array([-1.0, 1.0]))
OPERATORS = {
    "op1": lambda spark: simhash.near_duplicates(spark, docs(spark)),
    "op2": lambda spark: license_scan.scan(docs(spark)),
    "op3": lambda spark: radix_dedup.report(spark, docs(spark)),
    "op4": lambda spark: html_extract.extract(docs(spark).selectExpr("doc_id AS page_id", "source AS url", "text AS html")).withColumnRenamed("page_id", "doc_id"),
    "op6": lambda spark: doc_fingerprint.with_edited(spark, docs(spark)),
    "op6 alone": lambda spark: doc_fingerprint.fingerprint(spark, docs(spark)),
    "op7": lambda spark: fm_dedup.report(spark, docs(spark)),
    "op8": lambda spark: quality.scored(docs(spark), MODEL),
    "one of each": lambda spark: simhash.one_of_each(spark, docs(spark), null_ids_stay=False),
    "cut": lambda spark: radix_dedup.without_repeats(spark, docs(spark), 40),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_exact(spark, name):
    got = OPERATORS[name](spark)
    key = lambda x: (x is None, x)
    assert sorted((r["doc_id"] for r in got.collect()), key=key) == sorted(IDS, key=key)
    if name == "op1":
        assert {r["component_id"] for r in got.collect()} == set(IDS)


def test_training_keeps_large_ids(spark):
    labels = spark.createDataFrame([(IDS[0], 0, 0), (IDS[1], 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.train(spark, docs(spark), labels)
    assert model is not None and len(model.thresholds) == 2
