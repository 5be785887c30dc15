from millrace.functions import scripture


def test_references_are_read_or_refused(spark):
    wanted = {
        "john 3:16": "john 3:16",
        "John 3:16-18": "john 3:16-18",
        "1 cor 13": "1 corinthians 13",
        "first corinthians 13:4": "1 corinthians 13:4",
        "II Timothy 2": "2 timothy 2",
        "psalm 23": "psalms 23",
        "gen 1.1": "genesis 1:1",
        "song of songs 2": "song of solomon 2",
        "jude 5": "jude 1:5",
        "rev 22": "revelation 22",
        "ps 23": "psalms 23",
        "gn 1": "genesis 1",
        "Ioan 3:16": "john 3:16",
        "1 Corinteni 13": "1 corinthians 13",
        "Tehillim 23:1": "psalms 23:1",
        "Bereshit 1": "genesis 1",
        "hb 1": None,
        "john 22": None,
        "psalm 151": None,
        "ju 3": None,
        "hello 3": None,
        "john": None,
        "the gospel of john 3 and more": None,
        "john 3:18-16": None,
        "": None,
    }
    rows = scripture.parsed(spark.createDataFrame([(q,) for q in wanted], "q string"), "q").collect()
    assert {r["q"]: r["ref"] for r in rows} == wanted


def test_a_card_is_the_passage_asked_for_or_none(spark):
    refs = scripture.parsed(spark.createDataFrame([("john 3:16",), ("john 3:17",)], "q string"), "q")
    passages = spark.createDataFrame([("john 3:16", "text")], "ref string, text string")
    assert {r["ref"]: r["card"] for r in scripture.cards(refs, passages).collect()} == {"john 3:16": "text", "john 3:17": None}
