"""Line dedup by site-relative frequency, with DataFrame functions only.

A line's ratio is the number of a host's pages that contain it, divided by the host's pages. Lines above
`ratio` on at least `min_pages` pages are boilerplate of that host and are dropped from its pages; the same line stays
on other hosts.

Pages are counted once per line, counts are combined before the shuffle, and only line hashes and page numbers move: page texts
meet again only with the hashes of their own dropped lines.

Defined cases: a null page or a page without text keeps a row with empty text; a null or unparsable address is the
host ''; kept columns named as a result of this operator raise ValueError; repeated rows count as pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

RATIO = 0.2
MIN_PAGES = 3
#: Block-level elements end a line.
BLOCKS = "p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|br|nav|article|section|header|footer|aside|main|tr|td|th|table|title|body|head|html|blockquote|pre"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def html_lines(html: Column) -> Column:
    """The non-empty text lines of a page: scripts, styles and comments go, block elements break lines."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    body = F.regexp_replace(body, f"(?i)</?({BLOCKS})( [^>]*)?/?>", "\n")
    body = F.regexp_replace(body, "<[^>]*>", "")
    lines = F.transform(F.split(body, "[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.filter(lines, lambda x: x != "")


def drop_boilerplate_lines(
    pages: DataFrame, *, group: Column, lines: Column, keep: list[str] | None = None, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """The columns `keep` of pages (by default all) with host, n_lines, n_dropped and clean_text (the remaining lines)."""
    columns = pages.columns if keep is None else keep
    taken = {c.lower() for c in columns}
    if taken & {"host", "n_lines", "n_dropped", "clean_text"}:
        raise ValueError("columns host, n_lines, n_dropped and clean_text are this operator's results; rename yours first")
    rows = materialize(
        pages.select(*[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(columns)], group.alias("_host"), lines.alias("_lines"), F.monotonically_increasing_id().alias("_row")), "lines"
    )
    hashed = rows.select("_host", "_row", F.array_distinct(F.transform("_lines", lambda x: F.xxhash64(x))).alias("_keys"))
    exploded = hashed.select("_host", "_row", F.explode("_keys").alias("_key"))
    totals = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    common = (
        exploded.groupBy("_host", "_key")
        .agg(F.count(F.lit(1)).alias("_with"))
        .where(F.col("_with") >= min_pages)
        .join(totals, "_host")
        .where(F.col("_with") > F.lit(ratio) * F.col("_pages"))
        .select(F.struct("_host", "_key").alias("_line"))
    )
    dropped = (
        exploded.select(F.struct("_host", "_key").alias("_line"), "_row")
        .join(common.hint("merge"), "_line")
        .groupBy("_row")
        .agg(F.collect_list("_line._key").alias("_gone"))
    )
    kept = F.filter("_lines", lambda x: ~F.array_contains(F.coalesce(F.col("_gone"), F.array().cast("array<bigint>")), F.xxhash64(x)))
    return (
        rows.join(dropped, "_row", "left")
        .withColumn("_kept", kept)
        .select(
            *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)],
            F.col("_host").alias("host"),
            F.size("_lines").cast("bigint").alias("n_lines"),
            (F.size("_lines") - F.size("_kept")).cast("bigint").alias("n_dropped"),
            F.array_join("_kept", "\n").alias("clean_text"),
        )
    )


def line_dedup(pages: DataFrame, *, url: str = "url", html: str = "html", keep: list[str] | None = None, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    return drop_boilerplate_lines(pages, group=host_of(F.col(url)), lines=html_lines(F.col(html)), keep=keep, ratio=ratio, min_pages=min_pages)
