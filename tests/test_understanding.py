from pyspark.sql import functions as F

from lakeleaf.operators import understanding as N
from tests.test_operators import values


def test_routes(spark):
    t = F.col("t")
    asked = ["எழுத்தாளர்கள் பட்டியல்", "இந்த கதை யார் எழுதினார்", "மு. அருணன் எழுதிய கதைகள்", "கதைச் சுருக்கம் தருக", "who wrote this", "எந்த ஆண்டு வெளியானது", "plain words", None]
    assert values(spark, N.query_type(t), asked) == ["list_all_authors", "topic_author", "author_topics", "none", "topic_author", "none", "none", "none"]
    assert values(spark, N.route(t), ["how many issues", "மலர் 5 இதழ் 7", "மூன்றாவது மலர் இரண்டாவது இதழ்", "start year?", "other"]) == ["issue_count", "contents", "contents", "start_year", "vector_search"]
    assert [tuple(x) for x in values(spark, N.issue_numbers(t), ["மலர் 5 இதழ் 7", "மூன்றாவது மலர் இரண்டாவது இதழ்", "x"])] == [(5, 7), (3, 2), (None, None)]
    bank = N.Bank(canonical=(("kumar", "K. Kumar"),))
    assert values(spark, N.entity(t, bank), ["what did Kumar write", "மு. அருணன் எழுதிய கதைகள்"]) == ["K. Kumar", "மு. அருணன்"]


def test_names_and_lines(spark):
    t = F.col("t")
    names = ["VOL5-7-1951.docx", "VOL1-PONGAL-1948", "VOL_5_7_1951", "5-7-1951", "none"]
    assert [tuple(x) for x in values(spark, N.file_numbers(t), names)] == [("5", "7", "1951"), ("1", "பொங்கல் மலர்", "1948"), ("5", "7", "1951"), ("5", "7", "1951"), (None, None, None)]
    lines = ["காலமும் கருத்தும்    மு. அருணன்   12", "தலைப்பு ஒன்று .... 7", "no page", "மே தினம் அருணன் 33"]
    got = [x and tuple(x) for x in values(spark, N.contents_line(t), lines)]
    assert got == [("காலமும் கருத்தும்", "மு. அருணன்", "12"), ("தலைப்பு ஒன்று", None, "7"), None, ("மே தினம்", "அருணன்", "33")]
    assert values(spark, N.valid_author(t), ["மு. அருணன்", "abc def", "12", "ம…", None]) == [True, False, False, False, False]
    assert values(spark, N.to_sentence_end(t), ["One. Two. Thr", "no end here"]) == ["One. Two.", "no end here"]
