"""Main text of web pages by a site style tree: the pages of a host are merged, and branches that
look or read alike on most of them are removed from each page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, stored
from emberlog.llm.dom import parse

#: Branches below this importance are removed.
IMPORTANCE = 0.2
#: How much a branch's own presentations count against what its children hold.
DECAY = 0.9
#: Pages of a host that must hold a branch before it is judged; a branch within an article that the
#: markup declares is judged only if so many, and at least this share of the host's pages, hold it.
MIN_PAGES, MIN_ARTICLE_PAGES, ARTICLE_SHARE = 5, 10, 0.5
#: The same for one text: such a share of the pages on which its branch occurs must hold it.
TEXT_SHARE, ARTICLE_TEXT_SHARE = 0.5, 0.9
#: Rows up to which the removed branches are sent to every executor; more are joined.
BROADCAST_ROWS = 500_000
PARSE_CHARS = 8 << 20

_BLOCK = "struct<chain:array<bigint>,text:string,aside:boolean>"
_SHAPE = "struct<branch:bigint,parent:bigint,depth:int,style:bigint,article:boolean>"


def page_host(url: Column) -> Column:
    """Lower-cased host after the first ://; null without one."""
    rest = F.substring_index(url, "://", 1)
    host = ascii_lower(F.regexp_extract(F.expr("substr(_url, length(substring_index(_url, '://', 1)) + 4)"), "^[^/?#]*", 0))
    return F.when(F.length(rest) < F.length(url), F.when(host != "", host))


def _parsed(batches):
    for batch in batches:
        ids, urls, hosts, pages = (batch.column(n) for n in ("_page", "_url", "_host", "_html"))
        sizes = np.cumsum(pa.compute.binary_length(pages).fill_null(0).to_numpy())
        first = 0
        while first < len(pages):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + PARSE_CHARS)))
            blocks, shapes = [], []
            for source in pages.slice(first, last - first):
                page = parse(source.as_py() or "")
                blocks.append([{"chain": c, "text": t, "aside": a} for c, t, a in page.blocks])
                shapes.append([{"branch": b, "parent": p, "depth": d, "style": s, "article": a} for b, (p, d, s, a) in page.shapes.items()])
            block = pa.struct([("chain", pa.list_(pa.int64())), ("text", pa.string()), ("aside", pa.bool_())])
            shape = pa.struct([("branch", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("style", pa.int64()), ("article", pa.bool_())])
            columns = [c.slice(first, last - first) for c in (ids, urls, hosts)]
            columns += [pa.array(blocks, pa.list_(block)), pa.array(shapes, pa.list_(shape))]
            yield pa.RecordBatch.from_arrays(columns, names=["_page", "_url", "_host", "blocks", "shapes"])
            first = last


def style_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged pages of each host: one row per branch, with the pages that hold it, their share of
    the host's, the entropy of the child sequences it shows and the mean importance of its texts;
    and one row per text of a branch, with the pages that hold it and its importance.

    Pages are counted map-side per (host, branch, presentation), so a host with a third of all
    pages moves as many rows per task as it has presentations.
    """
    sited = parsed.where("_host IS NOT NULL")
    totals = sited.groupBy("_host").agg(F.count("*").alias("total"))
    shapes = sited.select("_host", F.explode("shapes").alias("s")).select("_host", "s.*")
    styles = shapes.groupBy("_host", "branch", "parent", "depth", "article", "style").agg(F.count("*").alias("k"))
    # Contents: one row per page and distinct text of a branch; the text's id is the chain's last.
    contents = sited.select("_host", F.explode(F.expr("array_distinct(transform(blocks, b -> slice(b.chain, -2, 2)))")).alias("c"))
    contents = contents.where("size(c) = 2").groupBy("_host", F.col("c")[0].alias("branch"), F.col("c")[1].alias("text")).agg(F.count("*").alias("k"))
    nodes = styles.groupBy("_host", "branch").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("article").alias("article"),
        F.sum("k").alias("pages"), F.count("*").alias("styles"), F.sum(F.col("k") * F.ln("k")).alias("k_ln_k"),
    )
    counted = nodes.select("_host", "branch", "article", "pages")
    texts = contents.join(counted, ["_host", "branch"])
    # A text's entropy over the pages that hold it, on the scale of all pages of its branch.
    spread = F.when(F.col("pages") > 1, F.ln("k") / F.ln("pages")).otherwise(0.0)
    texts = texts.withColumn("importance", 1 - spread)
    leaf = texts.groupBy("_host", "branch").agg(F.avg("importance").alias("content"))
    even = F.ln("pages") - F.col("k_ln_k") / F.col("pages")
    nodes = nodes.join(leaf, ["_host", "branch"], "left").join(totals, "_host")
    nodes = nodes.select(
        "_host", "branch", "parent", "depth", "pages", "article", "content",
        (F.col("pages") / F.col("total")).alias("share"),
        F.when(F.col("pages") > 1, even / F.ln("pages")).otherwise(1.0).alias("own"),
        F.pow(F.lit(DECAY), F.col("styles")).alias("pass_on"),
    )
    return nodes, texts.select("_host", "branch", "text", "k", "pages", "article", "importance")


def composite_importance(nodes: DataFrame) -> DataFrame:
    """`nodes` with the composite importance of each branch: its own presentations' entropy and, by
    the more the more presentations it has, the mean importance of its children, content included,
    by the pages that show them; `most`, the highest importance of the branch and all below it. One
    round per depth, from the deepest; a round reads one level."""
    spark, rows = nodes.sparkSession, stored(nodes, "style-tree")
    levels = [r[0] for r in rows.select("depth").distinct().orderBy(F.desc("depth")).collect()]
    columns = [*rows.columns, "importance", "most"]
    found, below = [], None
    for level in levels:
        here = rows.where(F.col("depth") == level)
        has_text = F.col("content").isNotNull().cast("int")
        if below is None:
            here = here.withColumns({"weight": F.lit(0.0), "weighted": F.lit(0.0), "below": F.lit(0.0)})
        else:
            sums = below.groupBy("_host", F.col("parent").alias("branch")).agg(
                F.sum(F.col("pages") * 1.0).alias("weight"),
                F.sum(F.col("pages") * F.col("importance")).alias("weighted"),
                F.max("most").alias("below"),
            )
            here = here.join(sums, ["_host", "branch"], "left").na.fill(0.0, ["weight", "weighted", "below"])
        weight = F.col("weight") + F.col("pages") * has_text
        inner = (F.col("weighted") + F.when(F.col("content").isNull(), 0.0).otherwise(F.col("pages") * F.col("content"))) / weight
        importance = F.when(weight > 0, (1 - F.col("pass_on")) * F.col("own") + F.col("pass_on") * inner).otherwise(F.col("own"))
        here = here.withColumn("importance", importance).withColumn("most", F.greatest("importance", "below", "content"))
        below = stored(here.select(*columns), "style-level")
        found.append(below)
    if not found:
        return rows.withColumns({name: F.lit(None).cast("double") for name in columns[-2:]})
    whole = found[0]
    for level in found[1:]:
        whole = whole.unionAll(level)
    return whole


def extract_articles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: the id and url columns, text (blocks joined by line ends, '' if none), n_chars.

    Each page is parsed once; what its markup sets aside (menus, forms, hidden parts, branches named
    as adverts or comments, all outside a declared article) goes at once. The rest hangs on the
    style tree of the page's host: a branch is removed where its composite importance and that of
    all below it, or the importance of its text, is below IMPORTANCE and enough pages show it.

    Null html is an empty page. Null urls and urls without host have no site: markup alone decides.
    Repeated rows give repeated results and count as pages of their host; other columns are not
    read. An empty table gives an empty result.
    """
    source = pages.select(F.col(id_column).alias("_page"), F.col(url_column).alias("_url"), F.col(html_column).alias("_html"))
    source = source.withColumn("_host", page_host(F.col("_url"))).select("_page", "_url", "_host", "_html")
    kind = source.schema["_page"].dataType.simpleString()
    parsed = source.mapInArrow(_parsed, f"_page {kind}, _url string, _host string, blocks array<{_BLOCK}>, shapes array<{_SHAPE}>")
    parsed = stored(parsed.withColumn("_row", F.monotonically_increasing_id()), "pages")
    nodes, texts = style_tree(parsed)
    tree = composite_importance(nodes)
    enough = F.when(F.col("article"), (F.col("pages") >= MIN_ARTICLE_PAGES) & (F.col("share") >= ARTICLE_SHARE)).otherwise(F.col("pages") >= MIN_PAGES)
    low = tree.where(enough & (F.col("most") < IMPORTANCE)).select("_host", "branch")
    share = F.when(F.col("article"), ARTICLE_TEXT_SHARE).otherwise(TEXT_SHARE)
    least = F.when(F.col("article"), MIN_ARTICLE_PAGES).otherwise(MIN_PAGES)
    said = texts.where((F.col("importance") < IMPORTANCE) & (F.col("k") >= share * F.col("pages")) & (F.col("pages") >= least))
    removed = stored(low.unionAll(said.select("_host", F.col("text").alias("branch"))).distinct(), "removed")
    return _rendered(parsed, removed, broadcast=removed.count() <= BROADCAST_ROWS).select(
        F.col("_page").alias(id_column), F.col("_url").alias(url_column), "text", F.length("text").cast("bigint").alias("n_chars")
    )


def _rendered(parsed: DataFrame, removed: DataFrame, broadcast: bool) -> DataFrame:
    """Pages with `text`: the blocks that neither the markup nor a removed branch sets aside."""
    if broadcast:
        per_host = F.broadcast(removed.groupBy("_host").agg(F.collect_list("branch").alias("gone")))
        found = parsed.join(per_host, "_host", "left")
    else:
        # By page: a host's branches meet its pages one by one, the hot host's join is split by adaptive execution.
        branches = parsed.select("_row", "_host", F.explode(F.array_distinct(F.flatten("blocks.chain"))).alias("branch"))
        per_page = branches.join(removed, ["_host", "branch"]).groupBy("_row").agg(F.collect_list("branch").alias("gone"))
        found = parsed.join(per_page, "_row", "left")
    kept = F.expr("filter(blocks, b -> NOT b.aside AND NOT coalesce(arrays_overlap(b.chain, gone), false))")
    return found.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))
