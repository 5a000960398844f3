from marginalia.plans.text import language_gate

ENGLISH = "the water in the river is cold and it comes from the hills " * 5
HINDI = "पत्ती सूर्य के प्रकाश में अपना भोजन बनाती है " * 40


def test_every_result_is_judged_by_its_letters_and_words(spark, tmp_path):
    page = lambda text: {"pdf_page_number": 1, "cleaned_text": text}
    rows = [(1, [page(ENGLISH)]), (2, [page(ENGLISH + HINDI)]), (3, [page(HINDI)]), (4, [page(None)]), (5, []), (6, None), (7, [page("zq xw " * 30)])]
    spark.createDataFrame(rows, "result_id long, pages array<struct<pdf_page_number int, cleaned_text string>>").write.parquet(f"{tmp_path}/validation_results.parquet")
    got = {r.result_id: (r.samples, r.common_ratio > 0, r.english) for r in language_gate(spark, str(tmp_path)).collect()}
    assert got == {1: (1, True, True), 2: (1, True, False), **{i: (0, False, False) for i in (3, 4, 5, 6)}, 7: (1, False, False)}
