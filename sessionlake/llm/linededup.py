"""Operator 9: boilerplate lines by their frequency within a site. DataFrame functions only.

`lines_of_html` cuts a page at block tags into lines of text; `drop_boilerplate` counts for each host
the pages that contain each line, divides by the host's pages, and drops lines that reach `ratio` of
them. A line on fewer than `least_pages` pages must reach the share `sure` (and two pages) instead, so that
chance repeats don't count on small hosts, but a menu on all of four pages does. Each page contributes a
line once, counts are pre-aggregated before they are shuffled, and a line travels as a 64-bit hash.

A host's boilerplate lines are at most its mean number of distinct lines a page divided by `ratio`, so
their list is bounded by the size of a page, not by the number of pages. The lists join their pages by
host: by broadcast if all hashes in all lists are few, so that lines are dropped without being shuffled,
else by a join whose large partitions Spark may split, since the lists are a stored table.

A page with null host (no host in its URL) belongs to the host '' ; a null html or text has no lines.
Lines are compared after trimming and collapsing white space; blank lines are dropped. A very long page is
one row like any other. Repeated rows are pages of their own. Other columns keep their names and values,
whatever they are called; only former columns named like the result's (site, lines, n_lines, n_dropped) are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, small_side, stored
from .ngramjoin import PERCENT

#: A line is boilerplate from this share of a site's pages on if it stands on LEAST_PAGES pages; on fewer, from SURE of them on.
RATIO, LEAST_PAGES, SURE = 0.1, 5, 0.5
#: The pipeline's ratio. A template's line stands on every page of a section, and few sites have more than some dozens of
#: sections; an author's own line stands on one page and its copies, which `least_own` keeps out of the counts.
STAGE_RATIO = 0.02
#: Documents alike in all but this share of their words are near copies: with c words shared and r of their own each, c / (c + 2 r) reaches PERCENT.
LEAST_OWN = (100 - PERCENT) / (100 + PERCENT)
#: Comments, scripts and styles go with all they hold (without an end, all the rest); block tags and line breaks cut lines.
BREAKS = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script[^>]*>|\z)|<style\b[^>]*>.*?(?:</style[^>]*>|\z)|</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|nav|article|section|header|footer|title|body|head|html|blockquote|pre)\b[^>]*>|\n"
TAGS = r"<[^>]*>"
#: The characters that HTML always escapes; other entities stay as they are written.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
BLANK = r"[ \t\r\f]+"


def host(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def lines_of_html(html: str) -> Column:
    return F.split(html, BREAKS)


def _text(line: Column) -> Column:
    line = F.regexp_replace(line, TAGS, "")
    for entity, plain in ENTITIES.items():
        line = F.replace(line, F.lit(entity), F.lit(plain))
    return line


def _clean(lines: Column, tags: bool) -> Column:
    if tags:
        lines = F.transform(lines, _text)
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, BLANK, " "))), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, lines: Column, site: Column, tags: bool = False, ratio: float = RATIO, least_pages: int = LEAST_PAGES, sure: float = SURE, least_own: float | None = None) -> DataFrame:
    """pages with `site`, `lines` (kept, in order), `n_lines` (before) and `n_dropped`; `site` and `lines` are expressions on
    pages. With `least_own`, a line is dropped only if it is as frequent on those pages alone that have more than this share
    of their words in other, less frequent lines: near copies of one page don't make its lines boilerplate."""
    names = [c for c in pages.columns if c not in ("site", "lines", "n_lines", "n_dropped")]
    # The pages' own columns travel in one struct, so that none can be called like a column made here.
    row = F.struct(*names) if names else F.struct(F.lit(0).alias("none"))
    cut = stored(pages.select(row.alias("row"), F.coalesce(site, F.lit("")).alias("site"), F.coalesce(_clean(lines, tags), F.array().cast("array<string>")).alias("lines")))
    each = cut.select("site", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    totals = stored(cut.groupBy("site").agg(F.count("*").alias("pages")))
    totals = small_side(totals, totals.count())

    def listed(each: DataFrame) -> DataFrame:
        """Each site's boilerplate lines, marked for broadcast if all lists together are small."""
        sure_of = (F.col("n") >= least_pages) | (F.col("n") >= F.lit(sure) * F.col("pages"))
        common = each.filter("n > 1").join(totals, "site").filter((F.col("n") >= F.lit(ratio) * F.col("pages")) & sure_of)
        lists = stored(common.groupBy("site").agg(F.array_sort(F.collect_set("line")).alias("drop")))
        return small_side(lists, lists.agg(F.coalesce(F.sum(F.size("drop") + 4), F.lit(0))).first()[0])

    lists = listed(each)
    if least_own is not None:
        words = lambda x: F.aggregate(x, F.lit(0), lambda n, line: n + F.size(F.split(line, " ")))
        own = F.filter("lines", lambda x: ~F.array_contains("drop", F.xxhash64(x)))
        told = cut.join(lists, "site").filter(words(own) > F.lit(least_own) * words(F.col("lines")))
        lists = listed(told.select("site", F.explode(F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), "drop")).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")))
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("drop", F.xxhash64(x)), F.lit(False)))
    out = cut.join(lists, "site", "left").withColumn("kept", kept)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "site", F.col("kept").alias("lines"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"))


@query
def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host("url").alias("host"), "html")
    found = drop_boilerplate(pages, lines_of_html("html"), F.col("host"), tags=True)
    return found.select("page_id", "host", F.col("n_lines").cast("bigint"), F.col("n_dropped").cast("bigint"), F.array_join("lines", "\n").alias("text"))


_PLAIN = f"regexp_replace(x, '{TAGS}', '', 'g')"
for _entity, _char in ENTITIES.items():
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
ORACLE = rf"""
with p as (
  select page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '') as host,
    list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{BREAKS}'),
      lambda x: trim(regexp_replace({_PLAIN}, '{BLANK}', ' ', 'g'), ' ')), lambda x: x <> '') as lines
  from pages
), e as (select host, unnest(list_distinct(lines)) as line from p
), c as (select host, line, count(*) as n from e group by all
), t as (select host, count(*) as pages from p group by all
), b as (select host, list(line) as dropped from c join t using (host) where n > 1 and n >= {RATIO} * pages and (n >= {LEAST_PAGES} or n >= {SURE} * pages) group by host
), k as (select page_id, host, lines, list_filter(lines, lambda x: not coalesce(list_contains(dropped, x), false)) as kept from p left join b using (host))
select page_id, host, cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(kept) as bigint) as n_dropped,
  array_to_string(kept, chr(10)) as text from k
"""


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines that recur within a source, on documents that aren't near copies, go from the texts of all
    its documents; one without any line left stays as empty text (linked with nothing, once in the mix, a piece of its end mark alone)."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    found = drop_boilerplate(row, F.split("row.text", "\n"), F.col("row.source").cast("string"), ratio=STAGE_RATIO, least_own=LEAST_OWN)
    text = F.when(F.col("n_dropped") > 0, F.array_join("lines", "\n")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
