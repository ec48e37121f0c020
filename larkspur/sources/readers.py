"""Readers of articles, pages, feeds and documents in files."""

from __future__ import annotations

import html
import re
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import squeezed

ARTICLE = "id bigint, ts bigint, title string, lede string, url string, source string, lang string, entities array<string>, simhash string"
REQUIRED = ["id", "ts", "title", "lede", "url", "source", "lang"]


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON lines. Lines that are blank or no JSON objects are left out, and so are records that normalise_articles() rejects."""
    lines = spark.read.schema(f"{ARTICLE}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return normalise_articles(lines.where("_bad IS NULL").drop("_bad"))


def normalise_articles(df: DataFrame) -> DataFrame:
    """Records with all required fields, an id and a time other than 0; languages and fingerprints in lower case, no null lists or fingerprints."""
    kept = df.where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)).where("id <> 0 AND ts <> 0")
    return kept.withColumn("lang", F.lower("lang")).withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))).withColumn("simhash", F.lower(F.coalesce("simhash", F.lit(""))))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of whole JSON files; files that are no JSON give no rows."""
    return spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Columns path and text, a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS feed: title, url, published, source; items without one of the first three are left out."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, source string").load(path)
    return items.select("title", F.col("link").alias("url"), F.col("pubDate").alias("published"), "source").where("title <> '' AND url <> '' AND published <> ''")


class _Page(HTMLParser):
    _SKIPPED = {"script", "style", "nav", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs, self.links, self.meta, self.lang, self.canonical = "", [], [], {}, "", ""
        self._in, self._skip, self._text = "", 0, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in self._SKIPPED:
            self._skip += 1
        elif tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "link" and a.get("rel") == "canonical":
            self.canonical = a.get("href", "")
        elif tag == "meta" and a.get("content"):
            self.meta[(a.get("property") or a.get("name") or "").lower()] = a["content"]
        if tag in ("p", "title"):
            self._close()
            self._in, self._text = tag, []

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SKIPPED:
            self._skip = max(0, self._skip - 1)
        if tag == self._in:
            self._close()

    def handle_data(self, data: str) -> None:
        if self._in and not self._skip:
            self._text.append(data)

    def _close(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        if self._in == "title" and not self.title:
            self.title = text
        elif self._in == "p" and text:
            self.paragraphs.append(text)
        self._in, self._text = "", []


def resolve(href: str, base: str) -> str | None:
    """The absolute http(s) address of a link on a page, without its fragment; None for fragments, scripts, mail and telephone."""
    href = html.unescape(href.strip())
    if not href or href.startswith("#") or re.match(r"(?i)(?:javascript|mailto|tel|data):", href):
        return None
    full = urljoin(base, href).split("#", 1)[0]
    parts = urlsplit(full)
    return full if parts.scheme in ("http", "https") and parts.netloc else None


_LISTS = ("paragraphs", "links")
PAGE = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c in _LISTS else T.StringType()) for c in ("title", "paragraphs", "links", "description", "image", "site_name", "published_at", "lang", "canonical")])


def _page(source: str | None, base: str | None) -> dict:
    parser = _Page()
    try:
        parser.feed(source or "")
        parser.close()
        parser._close()
    except (AssertionError, ValueError):
        pass
    m = parser.meta
    links = list(dict.fromkeys(x for h in parser.links if (x := resolve(h, base or ""))))
    return {
        "title": parser.title or m.get("og:title", ""), "paragraphs": parser.paragraphs, "links": links, "description": m.get("description") or m.get("og:description", ""), "image": m.get("og:image", ""),
        "site_name": m.get("og:site_name", ""), "published_at": m.get("article:published_time", ""), "lang": parser.lang, "canonical": resolve(parser.canonical, base or "") or "" if parser.canonical else "",
    }


@F.pandas_udf(PAGE)
def page_of(source: pd.Series, base: pd.Series) -> pd.DataFrame:
    """Title, paragraphs, links and descriptions of an HTML text found at an address; empty parts for null and empty texts."""
    return pd.DataFrame([_page(s, b) for s, b in zip(source, base)], columns=PAGE.names)


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")", re.S)
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)


def _pdf_string(raw: bytes) -> str:
    def plain(m: re.Match[bytes]) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(x, b"" if x.strip() == b"" and x != b" " else x)

    value = _ESCAPE.sub(plain, raw)
    return value[2:].decode("utf-16-be", "ignore") if value.startswith(b"\xfe\xff") else value.decode("latin-1")


def pdf_text(content: bytes | None) -> str:
    """The shown strings of a PDF's streams, compressed ones included, a line a stream; '' for null and what is no PDF."""
    if not content or b"%PDF" not in content[:1024]:
        return ""
    lines = []
    for m in _STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        shown = ["".join(_pdf_string(s) for s in _STRING.findall(a)) if a else _pdf_string(b) for a, b in _SHOWN.findall(data)]
        if shown:
            lines.append(" ".join(x for x in shown if x))
    return "\n".join(lines)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Columns path and text of PDF files."""

    @F.pandas_udf(T.StringType())
    def text(content: pd.Series) -> pd.Series:
        return pd.Series([pdf_text(None if c is None else bytes(c)) for c in content])

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def fallback_paragraphs(page: Column) -> Column:
    """The texts between <p> and </p> of a page, without marks and squeezed, the empty ones left out; for pages of which the parser finds no paragraphs."""
    inner = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    plain = F.transform(inner, lambda x: squeezed(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
    for mark, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        plain = _replaced(plain, mark, sign)
    return F.filter(F.transform(plain, squeezed), lambda x: x != "")


def _replaced(texts: Column, mark: str, sign: str) -> Column:
    return F.transform(texts, lambda x: F.replace(x, F.lit(mark), F.lit(sign)))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """News items of a JSON list: title, url, source, summary, published_at; items without title, address or date are left out."""
    items = read_json(spark, path, "title string, url string, source string, summary string, published_at string")
    return items.where("trim(title) <> '' AND trim(url) <> '' AND trim(published_at) <> ''")


_COMPANY = "symbol string, name string, sector string, price double, `change` double, change_percent double, market_cap string, summary string, news array<struct<title: string, url: string, source: string, summary: string, published_at: string>>"


def read_market(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Companies by upper-cased symbol, the last of one symbol counting, and their news, one row an item with the symbol."""
    held = read_json(spark, path, f"companies array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in _COMPANY.split(', news ')[0].split(', '))}, news: {_COMPANY.split(', news ')[1]}>>")
    each = held.select(F.posexplode("companies").alias("_at", "_c")).select("_at", "_c.*").where("trim(symbol) <> ''").withColumn("symbol", F.upper(F.trim("symbol")))
    last = each.groupBy("symbol").agg(F.max(F.struct("_at", *[c for c in each.columns if c not in ("_at", "symbol")])).alias("_r")).select("symbol", "_r.*").drop("_at")
    return last.drop("news"), last.select("symbol", F.explode("news").alias("_n")).select("symbol", "_n.*")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Column word: the distinct words of a file with one a line, lower-cased; blank lines are left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


_GRAPH = "triples array<struct<subject: string, relation: string, object: string>>, synonyms array<struct<entity: string, synonyms: array<string>>>, sources array<struct<url: string, title: string, characters: bigint, paragraphs: bigint, preview: string, content: string, links: array<string>, fetched_at: string, verified_at: string, status: string>>"


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a graph's snapshot: triples, synonyms and sources, of which only the listed fields are kept."""
    held = read_json(spark, path, _GRAPH)
    return {name: held.select(F.explode(name).alias("_x")).select("_x.*") for name in ("triples", "synonyms", "sources")}


_ENTRY = "url string, normalized_url string, canonical_url string, title string, summary string, preview string, language string, published_at string, fetched_at string, character_count bigint, paragraph_count bigint, revision bigint, topics array<string>, quality_score double, ingest boolean, content_type string, category string, content_digest string, links array<string>"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a crawler's history, those of an older form with the fields of the present one; entries without an address are left out."""
    entries = read_json(spark, path, _ENTRY).where("trim(url) <> ''")
    none = F.array().cast("array<string>")
    defaults = {"normalized_url": F.col("url"), "canonical_url": F.lit(""), "revision": F.lit(1).cast("bigint"), "topics": none, "links": none, "ingest": F.lit(True), "content_type": F.lit("article"), "category": F.lit("global"), "character_count": F.length(F.coalesce("preview", F.lit(""))).cast("bigint"), "paragraph_count": F.lit(0).cast("bigint")}
    return entries.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()})
