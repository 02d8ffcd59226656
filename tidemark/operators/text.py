"""Text of filings: visible text of HTML, sections, chunks, and ranked retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

# Elements whose content is not shown, that begin a new line, and that have no content.
HIDDEN = ["head", "ix:header", "ix:hidden", "ix:references", "ix:resources", "script", "style", "title"]
LINE = ["article", "blockquote", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ol", "p", "section", "table", "td", "th", "tr", "ul"]
EMPTY = ["br", "col", "hr", "img", "input", "link", "meta", "source"]


_BLANKS = re.compile("[ \t\u00a0]+")


class _Visible(HTMLParser):
    """Collects the shown text; `hidden` is the depth of open elements at which hiding began, or None."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.hidden: int | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in EMPTY:
            if tag == "br" and self.hidden is None:
                self.out.append("\n")
            return
        self.open.append(tag)
        style = next((v or "" for k, v in attrs if k == "style"), "")
        if self.hidden is None and (tag in HIDDEN or "display:none" in style.lower().replace(" ", "")):
            self.hidden = len(self.open)
        if self.hidden is None and tag in LINE:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in EMPTY and tag in self.open:
            while self.open.pop() != tag:
                pass
            if self.hidden is not None and len(self.open) < self.hidden:
                self.hidden = None

    def handle_data(self, data: str) -> None:
        if self.hidden is None and not data.isspace():
            self.out.append(data)


def visible(html: str | None) -> str | None:
    """The shown text of a page with white space brought to single spaces and at most one blank line; null stays null."""
    if html is None:
        return None
    p = _Visible()
    p.feed(html)
    p.close()
    lines = [" ".join(_BLANKS.split(line)).strip(" ") for line in "".join(p.out).split("\n")]
    # Of empty lines that follow each other the first stays.
    kept = [line for i, line in enumerate(lines) if line or (i and lines[i - 1])]
    return "\n".join(kept).strip()


def html_text(df: DataFrame, *, id: str, html: str) -> DataFrame:
    """(id, text): visible text, in Arrow batches; the nesting rules need a parser with a stack."""
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id: b["i"], "text": [visible(x) for x in b["h"]]})

    return df.selectExpr(f"`{id}` as i", f"`{html}` as h").mapInPandas(run, f"`{id}` {kind}, text string")


def words(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of more than one character, in order, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 1)


def chunks(df: DataFrame, *, text: str, size: int = 6000, overlap: int = 800) -> DataFrame:
    """df with chunk_no, start, end and chunk: windows of size characters every size - overlap, blank ones left out."""
    step = max(1, size - overlap)
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    d = df.where(n > 0).withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size, n))
    d = d.withColumn("chunk", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))).where(~F.col("chunk").rlike(r"^\s*$"))
    return d.withColumn("chunk_no", F.floor(F.col("start") / step).cast("int"))


# Fixed value: what begins a section's heading.
_HEADING = r"(?i)^\s*(?:(item\s+\d+[a-z]?)\b[.:)\-\s]|(part\s+[ivx]+)\b)"


def headers(c: Column) -> Column:
    """array<struct<position, label>> of lines such as 'Item 1A. Risk factors' and 'Part II', by 0-based position.

    One pass over the lines carries the position along. A heading's label is in title case with single spaces.
    """
    start = F.struct(F.lit(0).alias("position"), F.array().cast("array<struct<position:int,label:string>>").alias("found"))

    def line(acc: Column, x: Column) -> Column:
        # A heading that ends its line is followed by the line's end.
        ended = F.concat(x, F.lit("\n"))
        item, part = (F.regexp_replace(F.regexp_extract(ended, _HEADING, g), r"\s+", " ") for g in (1, 2))
        label = F.concat(F.when(item != "", F.concat(F.lit("Item "), F.upper(F.substring_index(item, " ", -1)))).otherwise(""), F.initcap(part))
        found = F.when(label != "", F.concat(acc["found"], F.array(F.struct(acc["position"].alias("position"), label.alias("label"))))).otherwise(acc["found"])
        return F.struct((acc["position"] + F.length(x) + 1).alias("position"), found.alias("found"))

    return F.aggregate(F.split(c, "\n", -1), start, line, lambda acc: acc["found"])


def label_at(position: Column, hs: Column) -> Column:
    """The label of the last header at or before position."""
    return F.try_element_at(F.filter(hs, lambda h: h["position"] <= position), F.lit(-1))["label"]


def snippet(text: Column, terms: Column, width: int = 240) -> Column:
    """width characters around the first of the terms, white space collapsed; the beginning if none occurs."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - width // 3, F.lit(1))
    return F.trim(F.regexp_replace(F.substring(text, start, F.lit(width)), r"\s+", " "))


def term_counts(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """(id, term, tf, length) with length the words of the document; documents without words give no row."""
    d = docs.select(F.col(id), words(F.col(text)).alias("__w")).withColumn("length", F.size("__w"))
    return d.select(id, "length", F.explode("__w").alias("term")).groupBy(id, "term", "length").agg(F.count("*").alias("tf"))


#: Queries may use so many different words for their list to travel with the documents; more are joined.
MOST_TERMS = 10_000


def bm25(docs: DataFrame, queries: DataFrame, *, id: str, text: str, query_id: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every document that shares a word with a query; a query's repeated words count each time.

    The corpus is read once: of each document the length and those words that some query uses are written, and both
    the statistics (of all documents) and the postings come from that narrow table. The words of the queries travel
    as one row while they are few; beyond MOST_TERMS all words of the documents are joined with them instead.
    """
    q = queries.select(F.col(query_id), F.explode(words(F.col(query))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qf"))
    wanted = q.select("term").distinct()
    few = wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    counted = docs.select(F.col(id), words(F.col(text)).alias("__w")).withColumn("length", F.size("__w"))
    if few:
        one = wanted.agg(F.collect_set("term").alias("__q"))
        counted = counted.join(F.broadcast(one)).select(id, "length", F.filter("__w", lambda w: F.array_contains("__q", w)).alias("__w"))
    narrow = cut(counted)
    stats = narrow.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    postings = narrow.select(id, "length", F.explode("__w").alias("term"))
    tf = (postings if few else postings.join(wanted, "term", "left_semi")).groupBy("term", id, "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = F.col("n"), F.col("avgdl")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.nullif(avgdl, F.lit(0.0))))
    # One row of statistics joins every posting: its size is fixed.
    scored = tf.join(df, "term").join(F.broadcast(stats)).select("term", id, weight.alias("w"))
    return scored.join(q, "term").groupBy(query_id, id).agg(F.sum(F.col("w") * F.col("qf")).alias("score"))


def top_k(scored: DataFrame, *, by: str, score: str, id: str, k: int) -> DataFrame:
    """The k best rows per group with rank_no, by score, ties by id; only positive scores."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id))
    return scored.where(F.col(score) > 0).withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def fuse(ranked: DataFrame, *, query_id: str, id: str, score: str, k: int = 60) -> DataFrame:
    """(id, rrf, best_score, queries): reciprocal-rank fusion of ranked lists (rank_no)."""
    return ranked.groupBy(id).agg(F.sum(F.lit(1.0) / (k + F.col("rank_no"))).alias("rrf"), F.max(score).alias("best_score"), F.array_sort(F.collect_set(query_id)).alias("queries"))


def search(docs: DataFrame, queries: DataFrame, *, id: str, text: str, query_id: str, query: str, per_query: int = 20, top: int = 10) -> DataFrame:
    """(id, rrf, best_score, queries, snippet): the best documents for several queries at once, best first."""
    ranked = top_k(bm25(docs, queries, id=id, text=text, query_id=query_id, query=query), by=query_id, score="score", id=id, k=per_query)
    best = fuse(ranked, query_id=query_id, id=id, score="score").orderBy(F.col("rrf").desc(), id).limit(top)
    # A query's words are a bounded list: they come from the call.
    terms = queries.agg(F.array_distinct(F.flatten(F.collect_list(words(F.col(query))))).alias("__t"))
    return best.join(docs.select(id, text), id).join(F.broadcast(terms)).select(id, "rrf", "best_score", "queries", snippet(F.col(text), F.col("__t")).alias("snippet"))
