import io
import tarfile
import zlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.sources import articles as A
from millrace.sources import web


def test_robots_most_specific_group_longest_rule_allow_on_ties():
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: millbot\nUser-agent: other\nDisallow: /*.pdf$\nCrawl-delay: 2\nSitemap: https://x/s.xml"
    assert not web.robots_allows(text, "someone", "/private/a")
    assert web.robots_allows(text, "someone", "/private/open/a")
    assert web.robots_allows(text, "millbot/2", "/private/a")
    assert not web.robots_allows(text, "millbot/2", "/a/b.pdf")
    assert web.robots_allows(text, "millbot/2", "/a/b.pdf?x")
    assert web.robots_allows("", "millbot", "/")
    assert web.robots_allows("User-agent: *\nDisallow:", "x", "/a")
    assert web.robots_allows("User-agent: *\nDisallow: /a\nAllow: /a", "x", "/a")
    groups, sitemaps = web.robots_groups(text)
    assert groups[1]["agents"] == ["millbot", "other"] and groups[1]["delay"] == 2.0 and sitemaps == ["https://x/s.xml"]
    assert web.robots_directives("millbot: noindex, nofollow", "millbot/2")["noindex"] and not web.robots_directives("otherbot: noindex", "millbot/2")["noindex"]
    assert web.robots_directives("NoIndex, follow") == {"noindex": True, "nofollow": False, "noarchive": False}


@pytest.mark.parametrize(
    ("xml", "kind", "n"),
    [
        ('<urlset xmlns="http://x"><url><loc>https://a/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a/2</loc></url></urlset>', "urlset", 2),
        ("<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>", "index", 1),
        ("<rss><channel><item><link>https://a/1</link><pubDate>Mon</pubDate></item></channel></rss>", "rss", 1),
        ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://a/1"/><updated>2024</updated></entry></feed>', "atom", 1),
        ("not xml", "unknown", 0),
        ("", "unknown", 0),
    ],
)
def test_sitemaps_and_feeds(xml, kind, n):
    found, entries = web.sitemap_entries(xml)
    assert (found, len(entries)) == (kind, n)


def test_html_main_content_metadata_and_links():
    body = " ".join(["word"] * 80)
    html = f"""<html lang="fr"><head><title>A &amp; B</title><meta name="description" content="desc"><link rel="canonical" href="https://x/a">
    <script>var t="</p>";</script></head><body><nav><a href="/n">nav</a></nav><main><h2>Head</h2><p>{body}<p>second<ul><li>one<li>two</ul></main>
    <div class="sidebar">side</div><footer>foot</footer></body></html>"""
    page = web.extract(html)
    assert page["title"] == "A & B" and page["lang"] == "fr" and page["description"] == "desc" and page["canonical"] == "https://x/a"
    assert "## Head" in page["text"] and "- one" in page["text"] and "second" in page["text"]
    assert not any(w in page["text"] for w in ("nav", "foot", "side", "var"))
    assert [x["href"] for x in page["links"]] == ["/n"] and len(page["blocks"]) == 5
    assert web.extract("")["text"] == "" and web.extract(None)["title"] is None


def test_deep_pages_json_ld_and_class_words():
    assert web.extract("<div>" * 5000 + "deep" + "</div>" * 5000)["text"] == "deep"
    data = '{"@graph": [{"@type": "Organization"}, {"@type": ["BlogPosting"], "headline": "Head", "author": [{"name": "A"}, "B"], "datePublished": "2024-01-02T03:04:05+02:00", "dateModified": "2099-01-01"}]}'
    html = f"""<html lang="en-US"><head><title>t</title><script type="application/ld+json">{{bad</script><script type="application/ld+json">{data}</script></head><body><main>
    <div class="commentary">{"alpha " * 50}</div><div class="comment-list">{"beta " * 50}</div><div class="post-header">gamma</div><div hidden>delta</div></main></body></html>"""
    page = web.extract(html, datetime(2025, 1, 1, tzinfo=timezone.utc))
    assert (page["title"], page["author"], page["published"], page["modified"], page["lang"]) == ("Head", "A, B", "2024-01-02T01:04:05Z", None, "en")
    assert "alpha" in page["text"] and "gamma" in page["text"] and "beta" not in page["text"] and "delta" not in page["text"]
    menu = "<div id=a>" + "<a href=/x>menu words here</a> " * 40 + "</div><div id=b>" + "prose words here " * 30 + "</div>"
    assert web.extract(menu)["text"].startswith("prose")
    assert web.instant("Mon, 01 Jan 2024 10:00:00 +0000") == "2024-01-01T10:00:00Z" and web.instant("soon") is None
    known = {web.block_hash("Related"), web.block_hash("Own title")}
    assert web.without_boilerplate(["# Related", "related", "Own  Title", "- Own title", "text"], known, "own title") == ["# Related", "Own  Title", "text"]
    assert web.plain_page("Title\n\nbody\fnext")["text"] == "Title\nbody\nnext"


def test_pdf_text_and_reasons():
    words = " ".join(f"word{i}" for i in range(30))
    stream = f"BT [(Hello) -250 (there)] TJ ({words}) Tj ET".encode()
    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(stream) + b"\nendstream\n"
    text, reason = web.pdf_text(pdf)
    assert reason is None and text.startswith("Hello there")
    assert web.pdf_text(b"GIF89a")[1] == "not_a_pdf"
    assert web.pdf_text(b"%PDF-1.4 /Encrypt 1 0 R")[1] == "encrypted"
    assert web.pdf_text(b"%PDF-1.4 nothing")[1] == "no_text_layer"
    assert web.pdf_text(b"%PDF-1.4\nstream\nBT (few words) Tj ET\nendstream")[1] == "thin_content"
    assert web.charset("text/html; charset=ISO-8859-1", b"") == "iso-8859-1" and web.charset(None, b'<meta charset="utf-16">') == "utf-16" and web.charset(None, b"") == "utf-8"


def test_chunks_sections_windows_and_slivers():
    assert A.chunks("too few words")[1] == "thin_content"
    short, _ = A.chunks(" ".join(["word"] * 60), "T")
    assert len(short) == 1 and short[0]["embed_text"].startswith("T\n\n")
    text = "# Top\n" + "\n\n".join("Sentence with some words here. " * 30 for _ in range(8)) + "\n## Sub\n```\n# not a heading\n```\n" + "more text " * 120
    found, reason = A.chunks(text, "Top")
    assert reason is None and all(c["tokens"] <= A.MAX_TOKENS + A.MIN_TOKENS // 4 for c in found)
    assert {c["heading_path"] for c in found} == {"Top", "Top > Sub"} and found[-1]["embed_text"].startswith("Top > Sub\n\n")
    one = "word " * 2000 + "."
    assert "".join(A.windows(one.strip())).split() == one.split()


def test_front_matter_maps_by_precedence(spark):
    listed = "---\ntags:\n  - a\n  - b\nslug: s\ncharacters: [x, y]\nnot an entry\n---\nbody"
    row = spark.createDataFrame([(listed,)], "raw string").select(*(c.alias(n) for n, c in A.mapped_page(F.col("raw")).items()), A.front_matter_errors(F.col("raw")).alias("errors")).first()
    assert (row["tags"], row["slug"], row["characters"], row["errors"], row["body"]) == (["a", "b"], "s", ["x", "y"], ["not an entry"], "body")
    raw = '---\ntitle: "T"\nsummary: s\nexcerpt: e\ntags: [a, "b"]\ncreated: 2024-01-02\nbroken line\n---\n# H\nbody text'
    rows = spark.createDataFrame([(raw,), ("# Only heading\ntext",)], "raw string")
    page = A.mapped_page(F.col("raw"))
    a, b = rows.select(*(c.alias(n) for n, c in page.items())).collect()
    assert (a["title"], a["description"], a["tags"], str(a["published"]), a["body"]) == ("T", "e", ["a", "b"], "2024-01-02", "# H\nbody text")
    assert (b["title"], b["description"], b["tags"]) == ("Only heading", None, [])


def test_files_lists_and_rows(spark, tmp_path):
    (tmp_path / "docs" / "node_modules").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# A")
    (tmp_path / "docs" / "b.txt").write_text("no")
    (tmp_path / "docs" / "node_modules" / "c.md").write_text("no")
    assert [r["raw"] for r in A.markdown_tree(spark, str(tmp_path / "docs")).collect()] == ["# A"]
    assert A.safe_join("/r", "a/../b.md") == "/r/b.md"
    with pytest.raises(ValueError):
        A.safe_join("/r", "../../etc/passwd")
    (tmp_path / "hosts.txt").write_text("# c\n0.0.0.0 Bad.example.com\n127.0.0.1 worse.org # x\nlocalhost\n")
    found = A.blocklist(spark, str(tmp_path / "hosts.txt"), "s1", "hosts")
    assert sorted(r["pattern"] for r in found.collect()) == ["bad.example.com", "worse.org"]
    assert A.reloaded(found, found.limit(0), "s1").count() == 2
    with tarfile.open(tmp_path / "list.tar.gz", "w:gz") as archive:
        for name, body in (("ads/domains", b"||bad.example.net^\n! note\n"), ("other/domains", b"fine.example.net\n")):
            entry = tarfile.TarInfo(name)
            entry.size = len(body)
            archive.addfile(entry, io.BytesIO(body))
    assert [r["pattern"] for r in A.archived_blocklist(spark, str(tmp_path / "list.tar.gz"), "ads/", "s2", "domains").collect()] == ["bad.example.net"]
    assert A.single_document(spark, str(tmp_path / "docs"), "a.md").first()["raw"] == "# A"
    (tmp_path / "r.csv").write_text('Host,Note\na.com,"x, ""y"""\n')
    row = A.rows_from_csv(spark, str(tmp_path / "r.csv")).first()
    assert (row["host"], row["note"]) == ("a.com", 'x, "y"')
    (tmp_path / "m.json").write_text('{"category": "c", "articles": [{"id": "1", "status": "published"}, {"id": "2", "status": "draft"}]}')
    assert [r["id"] for r in A.bundle(spark, str(tmp_path / "m.json")).collect()] == ["1"]
    A.written_report(found.limit(0), str(tmp_path / "out"))
    assert "source,match_type,pattern" in next((tmp_path / "out").glob("part-*")).read_text()


def test_webhooks_are_signed_fresh_and_not_replayed(spark):
    good = A.signature("k", "1000", "n1", "{}")
    rows = [(1, 1000, "n1", "{}", good), (2, 1000, "n1", "{}", good), (3, 1000, "n2", "{}", "bad"), (4, 1, "n3", "{}", A.signature("k", "1", "n3", "{}"))]
    calls = spark.createDataFrame(rows, "call_id bigint, timestamp_s bigint, nonce string, body string, signature string")
    found = {r["call_id"]: r["verdict"] for r in A.webhook_verdicts(calls, "k", 1100).collect()}
    assert found == {1: "accepted", 2: "replayed", 3: "bad signature", 4: "stale"}
    assert A.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_entities_and_coercion(spark):
    entities = spark.sql("SELECT 'e1' AS entity_key, true AS active, array(named_struct('alias', 'Été', 'lang', 'fr')) AS aliases UNION ALL SELECT 'e2', true, array(named_struct('alias', 'ete', 'lang', CAST(NULL AS STRING)))")
    queries = spark.createDataFrame([(1, "ete", "fr"), (2, "none", "fr")], "query_id int, normalized string, lang string")
    assert [(r["query_id"], r["entity_key"]) for r in A.entity_lookup(queries, entities).collect()] == [(1, "e1")]
    row = spark.createDataFrame([("12x", "Yes", "a, b,")], "n string, f string, l string").select(
        A.coerced("integer", F.col("n")).alias("n"), A.coerced("boolean", F.col("f")).alias("f"), A.coerced("list", F.col("l")).alias("l")
    ).first()
    assert (row["n"], row["f"], row["l"]) == (None, True, ["a", "b"])
