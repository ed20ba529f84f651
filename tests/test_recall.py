import pytest

from ledgerloom.plans import reports


def test_recall_takes_every_label(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "label 1200.")], "doc_id long, text string")
    truth = spark.range(1500).selectExpr("concat('label ', id, '.') AS expected")
    row = reports.recall(texts, truth).first()
    assert (row.hits, row.total) == (1, 1500)
    monkeypatch.setattr(reports, "MOST_LABELS", 1499)
    with pytest.raises(ValueError, match="1499"):
        reports.recall(texts, truth)
