"""Document trees: Markdown, plain text and paged files to node tables, and lookups in them.

A file is one row; a node has ``node_id, parent_id, doc_id, node_type, title, text, order, level, section_path, title_path,
source, page`` and ``ancestors`` (ids from the root down). Orders count through the document from the root at 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.lineage import written

NODES = (
    "node_id string, parent_id string, doc_id string, node_type string, title string, text string, `order` int, level int, section_path array<string>, "
    "title_path array<string>, source string, file_name string, source_type string, page int, ancestors array<string>"
)


def _lines(files: DataFrame) -> DataFrame:
    """files(path, text) to numbered lines with their document."""
    named = files.select(
        F.col("path").alias("source"), T.doc_id_of_path(F.col("path")).alias("doc_id"), T.basename(F.col("path")).alias("file_name"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("stem", F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""))
    return named.withColumn("lines", F.split("text", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"))


def _assembled(named: DataFrame, entries: DataFrame, source_type: str) -> DataFrame:
    """entries(doc_id, place, kind, title, text, depth, section_path, page, chain) to nodes: orders by place, parents from the chain of section places."""
    by_place = W.partitionBy("doc_id").orderBy("place")
    numbered = entries.withColumn("order", F.row_number().over(by_place).cast("int"))
    sections = numbered.filter("kind = 'section'").select("doc_id", F.col("place").alias("_p"), F.col("order").alias("_o"))
    links = numbered.select("doc_id", "place", F.posexplode_outer("chain").alias("_i", "_p")).join(sections, ["doc_id", "_p"], "left")
    chains = links.groupBy("doc_id", "place").agg(F.array_sort(F.collect_list(F.when(F.col("_o").isNotNull(), F.struct("_i", "_o")))).alias("_c"))
    full = numbered.join(chains, ["doc_id", "place"]).join(named.select("doc_id", "source", "file_name", "stem"), "doc_id")
    root_id = T.node_id(F.col("doc_id"), F.lit("document"), F.lit(0))
    up = F.concat(F.array(root_id), F.transform("_c", lambda x: T.node_id(F.col("doc_id"), F.lit("section"), x["_o"])))
    inner = full.select(
        T.node_id(F.col("doc_id"), F.col("kind"), F.col("order")).alias("node_id"), F.element_at(up, -1).alias("parent_id"), "doc_id", F.col("kind").alias("node_type"), "title", "text", "order",
        F.col("depth").cast("int").alias("level"), "section_path", F.concat(F.array("stem"), "section_path").alias("title_path"), "source", "file_name", F.lit(source_type).alias("source_type"), F.col("page").cast("int").alias("page"), up.alias("ancestors"),
    )
    none = F.array().cast("array<string>")
    roots = named.select(
        root_id.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "doc_id", F.lit("document").alias("node_type"), F.col("stem").alias("title"), F.col("root_text").alias("text"), F.lit(0).alias("order"), F.lit(0).alias("level"),
        none.alias("section_path"), F.array("stem").alias("title_path"), "source", "file_name", F.lit(source_type).alias("source_type"), F.lit(None).cast("int").alias("page"), none.alias("ancestors"),
    )
    return roots.unionByName(inner)


def _paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of body lines between headings, cut into paragraphs."""
    body = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("_body"))
    return body.select(*keys, F.posexplode(T.split_paragraphs(F.col("_body"))).alias("_i", "text"))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once a row; an expression used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _text_entries(lines: Column, stem: Column, root_text: Column) -> Column:
    """A file's nodes in order from its root: (kind, title, text, heading, back), ``back`` being how far before the node its section stands, null below the root."""
    none = F.lit(None).cast("string")

    def entry(kind: str, title: Column, text: Column, heading: Column, back: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), title.alias("title"), text.alias("text"), heading.alias("heading"), back.cast("int").alias("back"))

    def segment(ls: Column, ss: Column, hs: Column, h: Column, j: Column) -> Column:
        body = F.array_join(F.slice(ls, h + 2, F.coalesce(F.get(hs, j), F.size(ls)) - h - 1), "\n")
        title = F.when(h >= 0, F.regexp_replace(F.get(ss, h), "[:：]+$", ""))
        own = F.when(h >= 0, F.array(entry("section", title, F.lit(""), title, F.lit(None)))).otherwise(F.array().cast(own_kind))
        return F.concat(own, F.transform(T.split_paragraphs(body), lambda t, i: entry("paragraph", none, t, title, F.when(h >= 0, i + 1))))

    own_kind = "array<struct<kind:string,title:string,text:string,heading:string,back:int>>"

    def all_of(ls: Column, ss: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: T.heading_line(F.get(ss, i), F.coalesce(F.get(ss, i - 1), F.lit("")) == "", F.coalesce(F.get(ss, i + 1), F.lit("")) == ""))
        return _let(heads, lambda hs: F.flatten(F.transform(F.concat(F.array(F.lit(-1)), hs), lambda h, j: segment(ls, ss, hs, h, j))))

    body = _let(lines, lambda ls: _let(F.transform(ls, T.strip), lambda ss: all_of(ls, ss)))
    return F.concat(F.array(entry("document", stem, root_text, none, F.lit(None))), body)


def plain_text(files: DataFrame) -> DataFrame:
    """Plain text: flat sections from lines that look like headings; a trailing colon is not part of a title.

    A file is a row, so its nodes are made where it lies, by array functions: nothing is shuffled.
    """
    named = _lines(files)
    entries = _text_entries(F.col("lines"), F.col("stem"), T.normalize_text(F.col("text")))
    e = named.select("doc_id", "source", "file_name", "stem", F.posexplode(entries).alias("order", "e")).select("doc_id", "source", "file_name", "stem", "order", "e.*")
    none = F.array().cast("array<string>")
    root, inner = F.col("kind") == "document", F.col("back").isNotNull()
    root_id = T.node_id(F.col("doc_id"), F.lit("document"), F.lit(0))
    section_id = T.node_id(F.col("doc_id"), F.lit("section"), F.col("order") - F.col("back"))
    path = F.when(F.col("heading").isNotNull(), F.array("heading")).otherwise(none)
    return e.select(
        T.node_id(F.col("doc_id"), F.col("kind"), F.col("order")).alias("node_id"), F.when(root, F.lit(None)).when(inner, section_id).otherwise(root_id).alias("parent_id"), "doc_id", F.col("kind").alias("node_type"), "title", "text", "order",
        F.when(root, 0).when(inner, 2).otherwise(1).alias("level"), path.alias("section_path"), F.concat(F.array("stem"), path).alias("title_path"), "source", "file_name", F.lit("txt").alias("source_type"), F.lit(None).cast("int").alias("page"),
        F.when(root, none).when(inner, F.array(root_id, section_id)).otherwise(F.array(root_id)).alias("ancestors"),
    )


def paged(pages: DataFrame) -> DataFrame:
    """pages(path, page, text), pages from 1: a section 'Page n' for each page, its paragraphs below it."""
    cleaned = pages.withColumn("_clean", T.clean_pdf_page(F.coalesce("text", F.lit(""))))
    whole = cleaned.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_clean"))), lambda x: x["_clean"]), "\n\n").alias("text"))
    named = _lines(whole).withColumn("root_text", F.col("text"))
    none = F.array().cast("array<long>")
    base = cleaned.select(T.doc_id_of_path(F.col("path")).alias("doc_id"), "page", "_clean", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("head"))
    at = F.col("page").cast("long")
    sections = base.select("doc_id", F.struct(at.alias("a"), F.lit(-1).alias("b")).alias("place"), F.lit("section").alias("kind"), F.col("head").alias("title"), F.lit("").alias("text"), F.lit(1).alias("depth"), F.array("head").alias("section_path"), F.col("page").cast("int"), none.alias("_up"))
    paras = base.select("doc_id", "page", "head", F.posexplode(T.split_paragraphs(F.col("_clean"))).alias("_i", "text"))
    body = paras.select("doc_id", F.struct(at.alias("a"), F.col("_i").alias("b")).alias("place"), F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("title"), "text", F.lit(2).alias("depth"), F.array("head").alias("section_path"), F.col("page").cast("int"), F.array(at).alias("_up"))
    every = sections.unionByName(body)
    return _assembled(named, every.withColumn("chain", F.transform("_up", lambda a: F.struct(a.alias("a"), F.lit(-1).alias("b")))).drop("_up"), "pdf")


def markdown(files: DataFrame) -> DataFrame:
    """Markdown: nested sections from '#' lines (also inside fences). The stack of open headings is kept a document at a time in Python."""
    named = _lines(files).withColumn("root_text", T.normalize_text(F.col("text")))
    lines = named.select("doc_id", F.posexplode("lines").alias("at", "line")).withColumn("_h", T.markdown_heading(F.col("line")))
    by_line = W.partitionBy("doc_id").orderBy("at")
    lines = lines.withColumn("head", F.last(F.when(F.col("_h").isNotNull(), F.col("at")), ignorenulls=True).over(by_line))
    heads = lines.filter("_h is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("_h.level").alias("level"), F.col("_h.title").alias("title")))).alias("heads"))

    def nest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, hs in zip(pdf["doc_id"], pdf["heads"], strict=True):
                above: list[tuple[int, int, str]] = []
                for h in hs:
                    above = [x for i, x in enumerate(above) if all(y[0] < h["level"] for y in above[: i + 1])]
                    rows.append((doc, h["at"], h["level"], h["title"], [x[1] for x in above], [x[2] for x in above]))
                    above.append((h["level"], h["at"], h["title"]))
            yield pd.DataFrame(rows, columns=["doc_id", "head", "depth", "title", "up", "path"])

    nested = heads.mapInPandas(nest, "doc_id string, head int, depth int, title string, up array<long>, path array<string>")
    a = lambda c: (F.col(c) * 2 + 1).cast("long")
    raised = nested.withColumn("up", F.transform("up", lambda x: x * 2 + 1))
    sections = raised.select("doc_id", F.struct(a("head").alias("a"), F.lit(-1).alias("b")).alias("place"), F.lit("section").alias("kind"), "title", F.lit("").alias("text"), "depth", F.concat("path", F.array("title")).alias("section_path"), F.lit(None).cast("int").alias("page"), F.col("up").alias("_up"))
    paras = _paragraphs(lines.filter("_h is null"), ["doc_id", "head"]).join(raised, ["doc_id", "head"], "left")
    start = F.coalesce(a("head"), F.lit(0).cast("long"))
    body = paras.select("doc_id", F.struct(start.alias("a"), F.col("_i").alias("b")).alias("place"), F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("title"), "text", (F.coalesce("depth", F.lit(0)) + 1).alias("depth"), F.when(F.col("head").isNotNull(), F.concat("path", F.array("title"))).otherwise(F.array().cast("array<string>")).alias("section_path"), F.lit(None).cast("int").alias("page"), F.when(F.col("head").isNotNull(), F.concat("up", F.array(start))).otherwise(F.array().cast("array<long>")).alias("_up"))
    every = sections.unionByName(body)
    return _assembled(named, every.withColumn("chain", F.transform("_up", lambda x: F.struct(x.alias("a"), F.lit(-1).alias("b")))).drop("_up"), "md")


def chains(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestors, cyclic) from ``nodes(node_id, parent_id)`` alone, from the root down, by pointer doubling: after a round a node knows twice as
    many ancestors, so rounds follow the logarithm of the depth.

    A parent that isn't a node ends the chain. Nodes on a cycle, or below one, have no ancestors and are marked.
    """
    own = nodes.select("node_id", "parent_id").dropDuplicates(["node_id"])
    known = own.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_known"))
    link = own.join(known, "parent_id", "left").select("node_id", F.when(F.col("_known"), F.col("parent_id")).alias("up"))
    link = written(link.select("node_id", "up", F.when(F.col("up").isNotNull(), F.array("up")).otherwise(F.array().cast("array<string>")).alias("ancestors")), "chains")
    reach, n = 1, None
    while not link.filter("up is not null").isEmpty():
        n = link.count() if n is None else n
        if reach > n:
            break  # only what never reaches a root is left
        above = link.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("ancestors").alias("_above"))
        # a chain that meets itself would double for ever
        far = link.join(above, "up", "left").withColumn("_loop", F.array_contains("_above", F.col("node_id")) | F.array_contains("ancestors", F.col("node_id")))
        grown = F.when(F.coalesce("_loop", F.lit(False)), F.col("ancestors")).otherwise(F.concat(F.coalesce("_above", F.array().cast("array<string>")), "ancestors"))
        link = written(far.select("node_id", F.when(F.coalesce("_loop", F.lit(False)), F.col("up")).otherwise(F.col("_up")).alias("up"), grown.alias("ancestors")), "chains")
        reach *= 2
    cyclic = F.col("up").isNotNull()
    return link.select("node_id", F.when(cyclic, F.array().cast("array<string>")).otherwise(F.col("ancestors")).alias("ancestors"), cyclic.alias("cyclic"))


def rooted(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``ancestors``, derived from the parents where the column is missing."""
    if "ancestors" in nodes.columns:
        return nodes
    found = chains(nodes).select(F.col("node_id").alias("_of"), "ancestors")
    return nodes.join(found, nodes["node_id"] == found["_of"], "left").drop("_of")


def children(nodes: DataFrame) -> DataFrame:
    """(parent_id, children): ids in order, as an adjacency list."""
    kids = nodes.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("order", "node_id"))).alias("_c"))
    return kids.select("parent_id", F.transform("_c", lambda x: x["node_id"]).alias("children"))


def with_parent_title(nodes: DataFrame) -> DataFrame:
    up = nodes.select(F.col("node_id").alias("_pid"), F.col("title").alias("parent_title"))
    return nodes.join(up, nodes["parent_id"] == up["_pid"], "left").drop("_pid")


def parents(nodes: DataFrame) -> DataFrame:
    """Each node beside its parent's columns (prefix ``parent_``); nulls for roots and dangling ids."""
    up = nodes.select(*[F.col(c).alias(f"parent_{c}") for c in nodes.columns if c != "parent_id"])
    return nodes.join(up, nodes["parent_id"] == up["parent_node_id"], "left")


def section_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path): titles of the sections above each node, from the root down."""
    up = nodes.filter("node_type = 'section' and title is not null").select(F.col("node_id").alias("_a"), F.col("title").alias("_t"))
    links = rooted(nodes).select("node_id", F.posexplode_outer("ancestors").alias("_i", "_a")).join(up, "_a", "left")
    got = links.groupBy("node_id").agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_i", "_t")))).alias("_p"))
    return got.select("node_id", F.transform("_p", lambda x: x["_t"]).alias("path"))


def leaf_documents(nodes: DataFrame, leaf: str = "paragraph") -> DataFrame:
    """The leaves as passages, with their parent's title; ``seq`` grows by document and order (it isn't dense).

    Leaves are dealt to ranges of documents and sorted there; as ranges follow each other, partition and place make an ordered number without a
    global sort. They are written out, so that the numbers stay.
    """
    leaves = with_parent_title(nodes).filter(F.col("node_type") == leaf)
    placed = leaves.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "order", "node_id")
    return written(placed.withColumn("seq", F.monotonically_increasing_id()), "leaves")
