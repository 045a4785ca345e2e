"""Web pages to rows: links, headings, tables, and lists of documents. Patterns run in the JVM, row by row, with nothing shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.normalise import text

#: What the commonest character references stand for; the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
#: Words of a table's headings that tell what a column holds, in order.
HEADINGS = (("title", "title|document|name|guidance"), ("kind", "type|category|topic"), ("date", "date|issued|posted|published"), ("status", "status"))


def visible(html: Column) -> Column:
    """html without comments, scripts and styles; null as empty."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")


def plain(html: Column) -> Column:
    """The text of a piece of html: tags become blanks, references characters, white space one blank; null if nothing is left."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, character in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(character))
    return text(out)


def title(html: Column) -> Column:
    return plain(F.regexp_extract(visible(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def joined_url(base: Column, href: Column) -> Column:
    """href as seen from a page: whole addresses stay, others go to the host or the folder of base."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(host, F.coalesce(F.nullif(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)", 1), F.lit("")), F.lit("/")))
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href)).when(href.rlike(r"^[?#]"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), href)).otherwise(F.concat(folder, href))


def links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, place (from 0), href, url, label of every link with an address, in the order of the page."""
    found = F.regexp_extract_all(visible(F.col(html)), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a\s*>"), F.lit(0))
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(found).alias("place", "_a"))
    href = F.regexp_extract("_a", r"(?is)\bhref\s*=\s*[\"']([^\"']*)", 1)
    return rows.select(key, "place", href.alias("href"), joined_url(F.col("_base"), href).alias("url"), plain(F.col("_a")).alias("label"))


def table_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table, row (from 0), header (all cells are headings), cells, and the html of each cell. Tables within tables aren't told apart."""
    tables = F.regexp_extract_all(visible(F.col(html)), F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))
    rows = pages.select(key, F.posexplode(tables).alias("table", "_t"))
    rows = rows.select(key, "table", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))).alias("row", "_r"))
    cells = F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
    header = (F.size(cells) > 0) & ~F.col("_r").rlike(r"(?is)<td\b")
    return rows.select(key, "table", "row", header.alias("header"), F.transform(cells, lambda c: plain(c)).alias("cells"), cells.alias("raw"))


def listed_documents(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, table, row, title, url, kind, date, status: a document for each table row with a link.

    A table's first row of headings tells which column is which; without one, the columns are title, kind, date and status. A
    row has its address from its first link, and its title from the column, or the link if that is empty.
    """
    tables = F.regexp_extract_all(visible(F.col(html)), F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))
    t = pages.select(key, F.col(url).alias("_base"), F.posexplode_outer(tables).alias("table", "_t")).filter("_t is not null")
    rows = F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    heads = F.transform(F.regexp_extract_all(F.coalesce(F.get(rows, F.lit(0)), F.lit("")), F.lit(r"(?is)<th\b[^>]*>(.*?)</th\s*>"), F.lit(1)), lambda c: F.lower(F.coalesce(plain(c), F.lit(""))))
    t = t.select(key, "_base", "table", heads.alias("_h"), F.posexplode_outer(rows).alias("row", "_r")).filter("_r is not null")
    cells = F.regexp_extract_all("_r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1))
    t = t.withColumn("_c", cells).filter(F.size("_c") > 0)

    def column(i: int, words: str) -> Column:
        told = F.array_position(F.transform("_h", lambda h: h.rlike(words)), F.lit(True)).cast("int") - 1
        return plain(F.get("_c", F.when(F.size("_h") == 0, F.lit(i)).otherwise(F.nullif(told, F.lit(-1)))))

    href = F.regexp_extract("_r", r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)", 1)
    label = plain(F.regexp_extract("_r", r"(?is)(<a\b[^>]*\bhref\b.*?</a\s*>)", 1))
    named = {name: column(i, words) for i, (name, words) in enumerate(HEADINGS)}
    out = t.filter(href != "").select(key, "table", "row", F.coalesce(named["title"], label).alias("title"), joined_url(F.col("_base"), href).alias("url"), named["kind"].alias("kind"), named["date"].alias("date"), named["status"].alias("status"))
    return out.filter("title is not null")
