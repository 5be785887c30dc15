"""References to passages of the Bible: book, chapter, verses; null on any doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Books in order with their number of chapters (fixed values).
BOOKS = """genesis 50, exodus 40, leviticus 27, numbers 36, deuteronomy 34, joshua 24, judges 21, ruth 4, 1 samuel 31, 2 samuel 24,
1 kings 22, 2 kings 25, 1 chronicles 29, 2 chronicles 36, ezra 10, nehemiah 13, esther 10, job 42, psalms 150, proverbs 31, ecclesiastes 12,
song of solomon 8, isaiah 66, jeremiah 52, lamentations 5, ezekiel 48, daniel 12, hosea 14, joel 3, amos 9, obadiah 1, jonah 4, micah 7, nahum 3,
habakkuk 3, zephaniah 3, haggai 2, zechariah 14, malachi 4, matthew 28, mark 16, luke 24, john 21, acts 28, romans 16, 1 corinthians 16,
2 corinthians 13, galatians 6, ephesians 6, philippians 4, colossians 4, 1 thessalonians 5, 2 thessalonians 3, 1 timothy 6, 2 timothy 4, titus 3,
philemon 1, hebrews 13, james 5, 1 peter 5, 2 peter 3, 1 john 5, 2 john 1, 3 john 1, jude 1, revelation 22"""
#: Names that are no prefix of a book's: abbreviations, Romanian and Hebrew names, book by book (fixed values).
OTHER_NAMES = {
    "genesis": "gn, ge, geneza, facerea, bereshit",
    "exodus": "ex, exod, exodul, iesirea, shemot",
    "leviticus": "lv, leviticul, vayikra",
    "numbers": "nm, nb, numeri, bamidbar",
    "deuteronomy": "dt, deuteronomul, devarim",
    "joshua": "jos, iosua, yehoshua",
    "judges": "jdg, jg, judecatorii, judecatori, shoftim",
    "ruth": "rt, rut",
    "1 samuel": "1 sm, 1 shmuel",
    "2 samuel": "2 sm, 2 shmuel",
    "1 kings": "1 kgs, 1 regi, 1 imparati, 1 melachim",
    "2 kings": "2 kgs, 2 regi, 2 imparati, 2 melachim",
    "1 chronicles": "1 cronici, 1 divrei hayamim",
    "2 chronicles": "2 cronici, 2 divrei hayamim",
    "nehemiah": "ne, neemia",
    "esther": "est, estera",
    "job": "jb, iov, iyov",
    "psalms": "ps, pss, psalm, psalmul, psalmii, tehillim, tehilim",
    "proverbs": "pr, prv, proverbe, proverbele, mishlei",
    "ecclesiastes": "qoh, eclesiastul, kohelet",
    "song of solomon": "song of songs, canticles, cantarea cantarilor, shir hashirim",
    "isaiah": "is, isaia, yeshayahu",
    "jeremiah": "jr, ieremia, yirmiyahu",
    "lamentations": "lm, plangerile, plangeri, eicha",
    "ezekiel": "ez, ezechiel, yechezkel",
    "daniel": "dn",
    "hosea": "os, osea, hoshea",
    "joel": "jl, ioel, yoel",
    "amos": "am",
    "jonah": "iona, yonah",
    "micah": "mi, mica, michah",
    "habakkuk": "hb, habacuc",
    "zephaniah": "zep, tefania, tzefaniah",
    "haggai": "hg, hagai",
    "zechariah": "zec, zaharia",
    "malachi": "ml, maleahi, malachi",
    "matthew": "mt, matei",
    "mark": "mk, mr, marcu",
    "luke": "lk, luca",
    "john": "jn, ioan, evanghelia dupa ioan",
    "acts": "ac, fapte, faptele apostolilor",
    "romans": "rm, romani",
    "1 corinthians": "1 co, 1 corinteni",
    "2 corinthians": "2 co, 2 corinteni",
    "galatians": "ga, galateni",
    "ephesians": "efeseni",
    "philippians": "phil, filipeni",
    "colossians": "coloseni",
    "1 thessalonians": "1 th, 1 tesaloniceni",
    "2 thessalonians": "2 th, 2 tesaloniceni",
    "1 timothy": "1 tm, 1 timotei",
    "2 timothy": "2 tm, 2 timotei",
    "titus": "tt, tit",
    "philemon": "phm, filimon",
    "hebrews": "hb, evrei",
    "james": "jas, jm, iacov",
    "1 peter": "1 pt, 1 petru",
    "2 peter": "2 pt, 2 petru",
    "1 john": "1 jn, 1 ioan",
    "2 john": "2 jn, 2 ioan",
    "3 john": "3 jn, 3 ioan",
    "jude": "iuda",
    "revelation": "rv, apocalipsa, apocalypse",
}
ORDINALS = {"first": "1", "second": "2", "third": "3", "iii": "3", "ii": "2", "i": "1"}
SHORTEST = 3


def books(spark: SparkSession) -> DataFrame:
    """alias, book, number, chapters: every prefix of three or more letters that only one book has, and a few other names."""
    known = [(n, *entry.strip().rsplit(" ", 1)) for n, entry in enumerate(BOOKS.replace("\n", " ").split(","), 1)]
    claims: dict[str, set[int]] = {}
    for n, name, _ in known:
        ordinal, _, stem = name.partition(" ") if name[0].isdigit() else ("", "", name)
        for k in range(SHORTEST, len(stem) + 1):
            claims.setdefault(f"{ordinal} {stem[:k]}".strip(), set()).add(n)
        claims[name] = {n}
    rows = {alias: known[min(owners) - 1] for alias, owners in claims.items() if len(owners) == 1}
    others: dict[str, set[str]] = {}
    for name, given in OTHER_NAMES.items():
        for alias in given.split(", "):
            others.setdefault(alias, set()).add(name)
    # A name that two books are called by is refused, like a prefix that two books have.
    rows |= {alias: next(b for b in known if b[1] in names) for alias, names in others.items() if len(names) == 1}
    return spark.createDataFrame([(a, name, n, int(chapters)) for a, (n, name, chapters) in rows.items()], "alias string, book string, number int, chapters int")


def _parts(routable: Column) -> tuple[Column, ...]:
    text = F.lower(F.trim(routable))
    for word, digit in ORDINALS.items():
        text = F.regexp_replace(text, f"^{word}\\s+", f"{digit} ")
    pattern = "^((?:[123]\\s*)?[a-z][a-z ]*?)\\.?\\s+(\\d{1,3})(?:\\s*[:.,]\\s*(\\d{1,3})(?:\\s*-\\s*(\\d{1,3}))?)?$"
    name = F.regexp_replace(F.regexp_extract(text, pattern, 1), "^([123])\\s*", "$1 ")
    return name, *(F.regexp_extract(text, pattern, k).try_cast("int") for k in (2, 3, 4))


def parsed(queries: DataFrame, routable: str) -> DataFrame:
    """``queries`` plus ref (``book chapter:from-to``), book, chapter, verse, to_verse; null where the text is not clearly one reference.

    In a book of one chapter a lone number is a verse.
    """
    name, chapter, verse, last = _parts(F.col(routable))
    rows = queries.withColumns({"__name": name, "__c": chapter, "__v": verse, "__w": last})
    table = books(queries.sparkSession)  # a few hundred aliases
    met = rows.join(F.broadcast(table), rows["__name"] == table["alias"], "left")
    lone = (F.col("chapters") == 1) & F.col("__v").isNull() & (F.col("__c") > 1)
    c, v = F.when(lone, F.lit(1)).otherwise(F.col("__c")), F.when(lone, F.col("__c")).otherwise(F.col("__v"))
    sound = F.col("book").isNotNull() & c.between(1, F.col("chapters")) & (v.isNull() | (v >= 1)) & (F.col("__w").isNull() | (F.col("__w") >= v))
    keep = lambda x: F.when(sound, x)
    ref = F.concat("book", F.lit(" "), c.cast("string"), F.when(v.isNull(), "").otherwise(F.concat(F.lit(":"), v.cast("string"))), F.when(F.col("__w").isNull(), "").otherwise(F.concat(F.lit("-"), F.col("__w").cast("string"))))
    return met.select(*queries.columns, keep(ref).alias("ref"), keep(F.col("book")).alias("book_name"), keep(c).alias("chapter"), keep(v).alias("verse"), keep(F.col("__w")).alias("to_verse"))


def cards(references: DataFrame, passages: DataFrame) -> DataFrame:
    """References with the text of the passage asked for; null where there is no such passage, never another one."""
    return references.join(passages.select("ref", F.col("text").alias("card")), "ref", "left")
