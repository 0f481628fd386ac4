"""Documents that hold a benchmark text, found by the keyword index."""

from gritstone.jobs import evaluate


def test_known_items_of_every_kind(spark, tmp_path):
    items = ["one two three", "the of a", "lone", "x-y.z q r", "Two Three", "", None, "nowhere is zebra found", "three: four", "in the of it"]
    texts = ["so one two three: four.", "say the of an", "alone or lone", "a x-y.z q rs", "in the of its", None, "", "ONE TWO THREE", "Two Threesome is found"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(q, d) for q, item in enumerate(items) if item for d, text in enumerate(texts) if text and item in text}
    assert sorted(map(tuple, evaluate.known_items(spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 4
