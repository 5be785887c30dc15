"""Articles from Markdown trees, feeds and bundles, rows from CSV and JSON, block lists, signed webhooks, sinks."""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import re
import tarfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.urls import content_hash

#: Chunk sizes in tokens and words (fixed values).
MAX_TOKENS, MIN_TOKENS, OVERLAP, SINGLE, THIN = 600, 400, 0.15, 100, 25
MAX_BYTES = 5 << 20
HMAC_WINDOW_S = 300
FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, raw of every Markdown file below ``root`` but hidden, vendored, built or oversized ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}").load(root)
    kept = files.filter(~F.col("path").rlike("/(\\.[^/]+|node_modules|dist|build)/") & (F.col("length") <= MAX_BYTES))
    return kept.select("path", F.decode("content", "UTF-8").alias("raw"))


def single_document(spark: SparkSession, root: str, path: str) -> DataFrame:
    """path, raw of one document below ``root``; a path that leaves it is refused, an oversized file gives no row."""
    file = spark.read.format("binaryFile").load(safe_join(root, path)).filter(F.col("length") <= MAX_BYTES)
    return file.select("path", F.decode("content", "UTF-8").alias("raw"))


def to_fetch(known: DataFrame, listing: DataFrame) -> DataFrame:
    """path, step of a remote tree (path, sha) against what is known: fetch, keep or withdraw; an empty listing withdraws nothing."""
    old, new = known.select("path", F.col("sha").alias("__old")), listing.select("path", F.col("sha").alias("__new"))
    step = F.when(F.col("__new").isNull(), "withdraw").when(F.col("__old").eqNullSafe(F.col("__new")), "keep").otherwise("fetch")
    met = old.join(new, "path", "full").select("path", step.alias("step"))
    return met if listing.limit(1).count() else met.withColumn("step", F.lit("keep"))


def pending(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """version, state of migrations (version, checksum): applied, changed since (which stops the run), or pending, in order."""
    done = applied.select("version", F.col("checksum").alias("__done"))
    state = F.when(F.col("__done").isNull(), "pending").when(F.col("__done") == F.col("checksum"), "applied").otherwise("changed")
    return migrations.join(done, "version", "left").select("version", state.alias("state"))


def safe_join(root: str, path: str) -> str:
    """``path`` below ``root``; refuses to leave it."""
    parts: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if not parts:
                raise ValueError("path leaves its root")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join([root.rstrip("/"), *parts])


_KEY = "^[A-Za-z_][\\w-]*\\s*:"


def _folded_lists(head: Column) -> Column:
    """Front matter with the items of a list on the line of its key."""
    return F.regexp_replace(head, "\\r?\\n[ \\t]*-[ \\t]+", ", ")


def front_matter_errors(raw: Column) -> Column:
    """Lines of the front matter that are neither an entry, nor blank, nor a comment."""
    lines = F.split(_folded_lists(F.regexp_extract(raw, FRONT, 1)), "\r?\n")
    return F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike("^\\s*#") & ~x.rlike(_KEY))


def front_matter(raw: Column) -> tuple[Column, Column]:
    """Front matter (map of its ``key: value`` lines, items of a list joined by commas) and body of an article; a malformed line is left out."""
    head, body = F.regexp_extract(raw, FRONT, 1), F.regexp_extract(raw, FRONT, 2)
    lines = F.filter(F.split(_folded_lists(head), "\r?\n"), lambda x: x.rlike(_KEY))
    entry = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), F.regexp_replace(F.trim(F.regexp_extract(x, ":(.*)$", 1)), "^[\"']|[\"']$", ""))
    # The first of repeated keys stands.
    keyed = F.filter(F.transform(lines, entry), lambda e: F.lit(True))
    unique = F.aggregate(
        keyed,
        F.array().cast("array<struct<col1:string,col2:string>>"),
        lambda acc, e: F.when(F.exists(acc, lambda a: a["col1"] == e["col1"]), acc).otherwise(F.concat(acc, F.array(e))),
    )
    return F.map_from_entries(unique), F.when(raw.rlike(FRONT), body).otherwise(raw)


def mapped_page(raw: Column) -> dict[str, Column]:
    """Columns of a page from an article, by precedence of front-matter names."""
    front, body = front_matter(raw)
    pick = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(front, F.lit(n)), F.lit("")) for n in names))
    several = lambda *names: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(pick(*names), F.lit("")), "[\\[\\]\"']", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    heading = F.nullif(F.regexp_extract(body, "(?m)^#\\s+(.+?)\\s*$", 1), F.lit(""))
    return {
        "title": F.coalesce(pick("title", "name"), heading),
        "description": pick("description", "excerpt", "summary"),
        "category": pick("category", "section"),
        "published": F.coalesce(pick("published", "created", "date"), pick("updated")).cast("date"),
        "language": F.coalesce(pick("language", "lang"), F.lit("en")),
        "tags": several("tags", "keywords"),
        "slug": pick("slug", "permalink"),
        "image": pick("image", "cover", "og_image"),
        "persona": pick("persona", "author"),
        "office": pick("office", "department"),
        "characters": several("characters", "people"),
        "related_slugs": several("related_slugs", "related"),
        "body": body,
        "word_count": F.size(F.filter(F.split(T.stripped_markdown(body), "\\s+"), lambda w: w != "")),
        "content_hash": content_hash(body),
    }


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.unaccent(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def filled_url(template: str, **fields: Column) -> Column:
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def tokens_of(text: str) -> int:
    return -(-len(text.split()) * 135 // 100)


def _heading(line: str) -> tuple[int, str] | None:
    """Level and text of a Markdown heading line."""
    bare = line.lstrip()
    level = len(bare) - len(bare.lstrip("#"))
    if len(line) - len(bare) > 3 or not 1 <= level <= 6 or not bare[level : level + 1].isspace():
        return None
    return level, T.plain(bare[level:].strip().rstrip("#").rstrip())


def sections(markdown: str) -> list[tuple[str, str]]:
    """(breadcrumb, body) of the parts under each heading; fences are not looked into."""
    lines = markdown.split("\n")
    fence = np.cumsum([line.lstrip()[:3] in ("```", "~~~") for line in lines])
    marks = [(k, h) for k, line in enumerate(lines) if fence[k] % 2 == 0 and (h := _heading(line))]
    out, open_at = [], {}
    for (k, head), end in zip([(-1, None), *marks], [*(k for k, _ in marks), len(lines)]):
        if head:
            open_at = {level: text for level, text in open_at.items() if level < head[0]} | {head[0]: head[1]}
        body = "\n".join(lines[k + 1 : end])
        if body.strip():
            out.append((" > ".join(open_at[level] for level in sorted(open_at)), body))
    return out


def _parts(text: str) -> tuple[list[str], list[int]]:
    """What a window may end after: paragraphs, and the sentences of those that are too long; and each part's paragraph."""
    parts, paragraph = [], []
    for k, block in enumerate(re.split(r"\n[ \t]*\n", text)):
        pieces = [block] if tokens_of(block) <= MAX_TOKENS else re.split(r"(?<=[.!?])\s+", block)
        pieces = [p.strip() for p in pieces if p.strip()]
        parts += pieces
        paragraph += [k] * len(pieces)
    return parts, paragraph


def windows(text: str) -> list[str]:
    """Windows of at most ``MAX_TOKENS`` over running token totals.

    A window takes as many whole parts as it holds (one at least, so a sentence is never cut); the next one begins as many
    whole parts back as make up ``OVERLAP`` of it, one at least, if there is room for them and the part that follows.  What is left
    over below a quarter of ``MIN_TOKENS`` joins the last window.
    """
    if tokens_of(text) <= MAX_TOKENS:
        return [text]
    parts, paragraph = _parts(text)
    total = np.cumsum([0, *map(tokens_of, parts)])
    n, lo, cuts = len(parts), 0, []
    while lo < n:
        hi = max(int(np.searchsorted(total, total[lo] + MAX_TOKENS, "right")) - 1, lo + 1)
        if cuts and hi == n and total[n] - total[lo] < MIN_TOKENS / 4:
            cuts[-1] = (cuts[-1][0], n)
            break
        cuts.append((lo, hi))
        if hi == n:
            break
        share = total[hi] - OVERLAP * (total[hi] - total[lo])
        back = max(min(int(np.searchsorted(total, share)), hi - 1), lo + 1)
        lo = back if total[hi + 1] - total[back] <= MAX_TOKENS else hi
    return ["".join(parts[k] + ("" if k + 1 == hi else " " if paragraph[k] == paragraph[k + 1] else "\n\n") for k in range(lo, hi)) for lo, hi in cuts]


def chunks(markdown: str, title: str | None = None) -> tuple[list[dict], str | None]:
    """Chunks (ordinal, heading_path, text, tokens, embed_text) of an article in plain text, or the reason for none."""
    body = re.sub(r"\A---\r?\n.*?\r?\n---\r?\n", "", markdown, count=1, flags=re.S)
    whole = T.plain(body)
    n = len(whole.split())
    if n < THIN:
        return [], "thin_content"
    parts = [("", whole)] if n < SINGLE else [(p, w) for p, b in sections(body) for t in (T.plain(b),) if t for w in windows(t)]
    out = []
    for path, text in parts or [("", whole)]:
        crumbs = [c for k, c in enumerate(path.split(" > ")) if c and not (k == 0 and c == title)]
        prefix = " > ".join(filter(None, [title, *crumbs]))
        out.append({"ordinal": len(out), "heading_path": path or None, "text": text, "tokens": tokens_of(text), "embed_text": f"{prefix}\n\n{text}" if prefix else text})
    return out, None


def chunked(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, heading_path, text, tokens of pages (page_id, text); one call a batch of pages."""

    def cut(batches):
        for batch in batches:
            rows = [(p, c["ordinal"], c["heading_path"], c["text"], c["tokens"]) for p, t in zip(batch["page_id"], batch["text"]) for c in chunks(t or "")[0]]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "heading_path", "text", "tokens"])

    return pages.select("page_id", "text").mapInPandas(cut, "page_id bigint, ordinal int, heading_path string, text string, tokens int")


def feed_changes(feed: DataFrame, high_water, full: bool = False) -> DataFrame:
    """Items after the (updated_at, id) mark, or all of them for a full walk."""
    if full or high_water is None:
        return feed
    at, last = high_water
    mark = F.lit(at).cast(feed.schema["updated_at"].dataType)
    return feed.filter((F.col("updated_at") > mark) | ((F.col("updated_at") == mark) & (F.col("id") > last)))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Published articles of category manifests ({category, articles: [...]})."""
    schema = "category string, articles array<struct<id:string,title:string,status:string,url:string,updated_at:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select("category", F.explode("articles").alias("a")).select("category", "a.*").filter("status = 'published'")


def blocklist(spark: SparkSession, path: str, source: str, kind: str) -> DataFrame:
    """source, match_type, pattern of a text list (``hosts``, ``domains`` or ``urls`` lines; gzip too)."""
    return listed_hosts(spark.read.text(path), source, kind)


def listed_hosts(lines: DataFrame, source: str, kind: str) -> DataFrame:
    """Hosts named by the lines (column ``value``) of a list."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    pattern = {
        "hosts": F.regexp_extract(line, "^(?:0\\.0\\.0\\.0|127\\.0\\.0\\.1)\\s+(\\S+)", 1),
        "domains": F.regexp_extract(line, "^(?:\\|\\||\\*\\.)?([a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})\\^?$", 1),
        "urls": F.regexp_extract(line, "^(?:https?://)?([^/\\s:]+)", 1),
    }[kind]
    found = lines.select(F.lower(pattern).alias("pattern")).filter(F.col("pattern").rlike("\\."))
    return found.distinct().select(F.lit(source).alias("source"), F.lit("host").alias("match_type"), "pattern")


def archived_blocklist(spark: SparkSession, path: str, member: str, source: str, kind: str) -> DataFrame:
    """``blocklist`` of the files below ``member`` in a tar archive, gzipped or not; one archive a task, line by line."""

    def read(batches):
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for entry in archive:
                        if entry.isfile() and entry.name.startswith(member):
                            lines = archive.extractfile(entry).read().decode("utf-8", "replace").splitlines()
                            yield pd.DataFrame({"value": lines}, dtype=object)

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "value string")
    return listed_hosts(lines, source, kind)


def reloaded(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """``old`` with the rows of a source replaced; an empty load keeps what there was."""
    if not new.limit(1).count():
        return old
    return old.filter(F.col("source") != source).unionByName(new)


def rows_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quote-aware CSV with lower-case column names, all strings."""
    rows = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    return rows.toDF(*(c.strip().lower() for c in rows.columns))


def validated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold to all rules, and the others with ``errors``."""
    errors = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda e: e.isNotNull())
    judged = rows.withColumn("errors", errors)
    return judged.filter(F.size("errors") == 0).drop("errors"), judged.filter(F.size("errors") > 0)


def coerced(kind: str, value: Column) -> Column:
    """Typed value of a form field, null if it does not parse."""
    if kind == "boolean":
        return F.when(F.lower(value).isin("true", "1", "yes", "on"), True).when(F.lower(value).isin("false", "0", "no", "off", ""), False)
    if kind == "list":
        return F.filter(F.transform(F.split(value, ","), lambda v: F.trim(v)), lambda v: v != "")
    return value.try_cast({"integer": "bigint", "number": "double", "text": "string", "date": "date"}[kind])


def merged_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """entity_key, name, active: new values win, entities that are no longer there are kept inactive."""
    a, b = old.select("entity_key", F.col("name").alias("__old")), new.select("entity_key", F.col("name").alias("__new"))
    return a.join(b, "entity_key", "full").select("entity_key", F.coalesce("__new", "__old").alias("name"), F.col("__new").isNotNull().alias("active"))


def entity_lookup(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity_key: the active entity one of whose aliases is the query, in its language, English or none; then by key."""
    alias = entities.filter("active").select("entity_key", F.explode("aliases").alias("a")).select("entity_key", T.normalized(F.col("a.alias")).alias("normalized"), F.col("a.lang").alias("alias_lang"))
    met = queries.join(alias, "normalized").filter(F.col("alias_lang").isNull() | (F.col("alias_lang") == F.col("lang")) | (F.col("alias_lang") == "en"))
    w = Window.partitionBy("query_id").orderBy((F.col("alias_lang") == F.col("lang")).desc_nulls_last(), "entity_key")
    return met.withColumn("k", F.row_number().over(w)).filter("k = 1").select("query_id", "entity_key")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def signature(secret: str, timestamp: str, nonce: str, body: str) -> str:
    return hmac.new(secret.encode(), f"{timestamp}.{nonce}.{body}".encode(), hashlib.sha256).hexdigest()


def webhook_verdicts(calls: DataFrame, secret: str, now_s: int) -> DataFrame:
    """``calls`` (timestamp_s, nonce, body, signature) plus verdict: stale, bad signature, replayed or accepted."""

    @F.pandas_udf("boolean")
    def signed(ts: pd.Series, nonce: pd.Series, body: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([hmac.compare_digest(signature(secret, str(t), n, b), g or "") for t, n, b, g in zip(ts, nonce, body, given)])

    w = Window.partitionBy("nonce", "__good").orderBy("timestamp_s", "call_id")
    judged = calls.withColumn("__good", signed("timestamp_s", "nonce", "body", "signature") & (F.abs(F.lit(now_s) - F.col("timestamp_s")) <= HMAC_WINDOW_S))
    return judged.withColumn(
        "verdict",
        F.when(F.abs(F.lit(now_s) - F.col("timestamp_s")) > HMAC_WINDOW_S, "stale")
        .when(~F.col("__good"), "bad signature")
        .when(F.row_number().over(w) > 1, "replayed")
        .otherwise("accepted"),
    ).drop("__good")


def written_report(report: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as one file of a folder, with its header even when empty; reports are short."""
    out = report.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if kind == "csv" else out.json(path)
