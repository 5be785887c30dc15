import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import retrieval as R
from millrace.operators import safety as X
from millrace.operators import signals as G


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "norm", "route"),
    [("  Où est  L'Église?! ", "ou est l eglise", "ou est l eglise"), ("हिन्दी", "हिन्दी", "हिन्दी"), ("John 3:16-18", "john 3 16 18", "john 3:16-18"), ("", "", "")],
)
def test_normal_forms(spark, raw, norm, route):
    assert one(spark, T.normalized(F.col("q")), q=raw) == norm and one(spark, T.routable(F.col("q")), q=raw) == route


@pytest.mark.parametrize(
    ("text", "lang"), [("हिन्दी", "hi"), ("שלום", "he"), ("привет", "ru"), ("what is the way", "en"), ("der die das", "de"), ("ce este care", "ro"), ("zzz", "en"), ("que", "es")]
)
def test_language(spark, text, lang):
    assert one(spark, T.detect_language(F.col("q")), q=text) == lang


def test_intent_tokens_and_snippets(spark):
    assert one(spark, T.conversational(F.col("q"), F.lit("en")), q="what is grace") is True
    assert one(spark, T.conversational(F.col("q"), F.lit("en")), q="what is") is False
    assert one(spark, T.conversational(F.col("q"), F.lit("ro")), q="de ce este") is True
    assert one(spark, T.tokens(F.col("q")), q="a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, T.snippet(F.col("q"), 20), q="One two. Three four five six") == "One two."
    assert one(spark, T.snippet(F.col("q"), 10), q="Onetwothree four") == "Onetwothre…"
    assert one(spark, T.similarity(F.col("q"), F.lit("word")), q="word") == 1.0
    assert one(spark, T.stripped_markdown(F.col("q")), q="# T\n**b** [l](u) `c`\n- i") == "T\nb l c\ni"


def test_urls(spark):
    n = lambda u: one(spark, U.normalized_url(F.col("q")), q=u)
    assert n("http://www.Ex.com/a/?utm_source=x&b=2&a=1#f") == "https://ex.com/a?a=1&b=2"
    assert n("https://ex.com") == "https://ex.com/" and n("not a url ") == "not a url"
    assert one(spark, U.host_candidates(F.col("q")), q="www.a.b.co") == ["a.b.co", "b.co"]
    reason = lambda u: one(spark, U.refusal(F.col("q"), F.lit("ex.com"), F.lit(1), F.lit(3), F.array(F.lit("secret")), F.array().cast("array<string>")), q=u)
    assert reason("https://ex.com/a") is None and reason("https://sub.ex.com/a") is None
    assert reason("https://other.com/") == "off-domain" and reason("ftp://ex.com/") == "unsupported scheme" and reason("x") == "unparseable url"
    assert reason("https://ex.com/a.PNG") == "refused extension" and reason("https://ex.com/wp-admin/") == "crawler trap path"
    assert reason("https://ex.com/a?SID=1") == "trap parameter" and reason("https://ex.com/1/2/3/4/5/6/7/8/9") == "path too deep" and reason("https://ex.com/secret") == "deny pattern"
    assert one(spark, U.content_type_refusal(F.col("q")), q="image/png") == "images are never fetched" and one(spark, U.content_type_refusal(F.col("q")), q="Text/HTML; charset=x") is None


def test_cover_density_prefers_full_and_close_matches():
    near, far = R.cover_density([[0], [1]], 100), R.cover_density([[0], [50]], 100)
    assert 0 < far < near < 1 and R.cover_density([[0], []], 100) == 0
    assert R.headline("a b the grace of x", ["grace"], 2, 3).count("<mark>grace</mark>") == 1


def test_zone_sizes_and_ladder(spark):
    assert [one(spark, R.zone_size(F.col("s")), s=v) for v in (0.03, 0.02, 0.012, 0.001)] == [5, 3, 2, 0]
    assert one(spark, R.zone_size(F.lit(None).cast("double")), s=1.0) == 0
    verdict = lambda tier, host, words, safe: one(spark, X.ladder(F.lit(tier), F.lit(host).cast("int"), F.lit(words), F.lit(safe).cast("double")), s=1.0)
    assert verdict("T1", 100, 500, None) == "safe" and verdict("T2", 100, 0, None) == "unsafe" and verdict("T2", None, 10, None) == "review" and verdict("T2", None, 0, None) == "safe"
    assert [verdict("T3", None, 0, s) for s in (0.95, 0.75, 0.2, None)] == ["safe", "review", "unsafe", "unclassified"]


def test_engagement_missing_measures_add_nothing(spark):
    null = F.lit(None).cast("double")
    assert one(spark, G.engagement_score(null, null, null, null, null), s=1.0) == 0.0
    assert one(spark, G.engagement_score(F.lit(180_000.0), F.lit(100.0), F.lit(100.0), F.lit(0.0), F.lit(1000.0)), s=1.0) == 100.0
