"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements, told apart by their path, and its blocks of text. Per host:

1. Each token has an occurrence vector: how often it occurs in each page. Vectors are kept as
   commutative sums of hashes of (page, count), so they are built by partial aggregation and no page
   list is ever gathered. Tokens with equal vectors form an equivalence class.
2. Classes with element tokens on at least LEAST_SUPPORT of the host's pages are valid. They are
   nested by path into the template of the host: a tree whose root class is on every page.
3. Text in any valid class, not only the root's, belongs to the template, like the tags around it.
   What is left are the slots; headings and paragraphs inside an article are slots even if they
   repeat from page to page. Empty pages are not counted.
4. All slots of a page are its text, whichever class they are in, but those of classes that stand
   beside the article (menus, notices, adverts, forms, comments by element or class name). A class
   name is only followed where less than half of the text of the pages with that class is in its slots.
5. A page with nothing but template text, such as a copy, has the text of the host's main class, found
   by descending from the root to the class that still holds nearly all slot text.

Pages are shuffled once, to meet their host's template; the templates are small, and a host with very many
pages is dealt out by salt. Defined cases: null html is empty and has empty text; pages without a
usable url form one host; a host with few pages has a template of all its elements, without template
text; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from slipstream.llm.common import map_batches, written
from slipstream.llm.html_pages import ARTICLE_TAGS, CONTENT, ROOT, TEXT_TAGS, hinted, read_page, tag

LEAST_SUPPORT = 0.05
LEAST_PAGES = 8
"""Text joins the template only on hosts with so many pages."""
MOST_OF_TEXT, ARTICLE_SHARE = 0.8, 0.3
SALTS = 16

_HINTS = pa.list_(pa.struct([("node", pa.int64()), ("beside", pa.bool_())]))
_TEXTS = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.int64())]))


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", host("url"))


def _add(total: int, page: int, count: int) -> int:
    return total + xxhash.xxh3_64_intdigest(count.to_bytes(8, "little"), page) & 0xFFFFFFFFFFFFFFFF


def token_vectors(pages: DataFrame) -> DataFrame:
    """Per host and token: path, its parent and role, text hash (null for an element), support, vector, chars of slot text within, and of the pages with it."""

    def make():
        def step(batch):
            support: dict = defaultdict(int)
            vector: dict = defaultdict(int)
            chars: dict = defaultdict(int)
            around: dict = defaultdict(int)
            known: dict = {}
            for where, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page_id", "url", "html"))):
                page = read_page(html)
                if not page.parent and not page.blocks:
                    continue  # an empty page says nothing about the template
                key = xxhash.xxh3_64_intdigest(f"{page_id} {url}") ^ xxhash.xxh3_64_intdigest(html)
                counts: dict = {(node, None): n for node, n in page.counts.items()}
                slot = page.chars()
                for b in page.blocks:
                    text = b.node, xxhash.xxh3_64_intdigest(b.text) >> 1
                    counts[text] = counts.get(text, 0) + 1
                for (node, text), n in counts.items():
                    token = where, node, text
                    support[token] += 1
                    vector[token] = _add(vector[token], key, n)
                    if text is None:
                        chars[token] += slot[node]
                        around[token] += slot[ROOT]
                        known[token] = page.parent.get(node), page.role[node]
            tokens = list(support)
            return pa.RecordBatch.from_arrays([
                pa.array([t[0] for t in tokens]), pa.array([t[1] for t in tokens], pa.int64()),
                pa.array([known.get(t, (None, None))[0] for t in tokens], pa.int64()),
                pa.array([known.get(t, (None, None))[1] for t in tokens], pa.string()),
                pa.array([t[2] for t in tokens], pa.int64()), pa.array([support[t] for t in tokens], pa.int64()),
                pa.array(np.array([vector[t] for t in tokens], np.uint64).view(np.int64)),
                pa.array([chars.get(t, 0) for t in tokens], pa.int64()), pa.array([around.get(t, 0) for t in tokens], pa.int64()),
            ], ["host", "node", "parent", "role", "text", "support", "vector", "chars", "around"])

        return step

    schema = "host string, node long, parent long, role string, text long, support long, vector long, chars long, around long"
    parts = map_batches(pages, make, schema)
    # sums of 64-bit hashes may wrap; decimals keep them exact under ANSI rules
    wide = F.sum(F.col("vector").cast("decimal(20,0)")) % F.lit(1 << 62).cast("decimal(20,0)")
    return parts.groupBy("host", "node", "text").agg(
        F.max("parent").alias("parent"), F.max("role").alias("role"), F.sum("support").alias("support"),
        wide.cast("long").alias("vector"), F.sum("chars").alias("chars"), F.sum("around").alias("around"),
    )


def templates(vectors: DataFrame) -> DataFrame:
    """Per host: the path of the main class, which paths with telling words stand beside the article, and the template's text (path, hash)."""
    root = vectors.where((F.col("node") == ROOT) & F.col("text").isNull())
    tokens = vectors.join(root.select("host", F.col("support").alias("pages")), "host")
    valid = F.col("support") >= F.col("pages") * LEAST_SUPPORT
    tokens = tokens.where(valid & (F.col("text").isNull() | (F.col("support") >= LEAST_PAGES)))
    tokens = tokens.select("host", F.struct("node", "parent", "role", "text", "vector", "support", "chars", "around").alias("token"))

    def deduce(t: pa.Table) -> pa.Table:
        rows = t["token"].to_pylist()
        elements = [e for e in rows if e["text"] is None]
        hints = [{"node": e["node"], "beside": 2 * e["chars"] < e["around"]} for e in elements if hinted(e["role"])]
        columns = {"main": (main_class(elements), pa.int64()), "hints": (hints, _HINTS), "texts": (template_text(rows), _TEXTS)}
        return pa.table({"host": t["host"].slice(0, 1), **{name: pa.array([x], kind) for name, (x, kind) in columns.items()}})

    schema = "host string, main long, hints array<struct<node:long,beside:boolean>>, texts array<struct<node:long,text:long>>"
    return tokens.groupBy("host").applyInArrow(deduce, schema)


def template_text(tokens: list[dict]) -> list[dict]:
    """The text tokens in a class with elements: they occur as often as these in each page."""
    classes = {(e["vector"], e["support"]) for e in tokens if e["text"] is None}
    return [{"node": t["node"], "text": t["text"]} for t in tokens if t["text"] is not None and (t["vector"], t["support"]) in classes]


def main_class(elements: list[dict]) -> int:
    """The path of the class whose slots hold the article, found down the tree of nested classes."""
    by_node = {e["node"]: e for e in elements}
    classes: dict = defaultdict(int)
    below: dict = defaultdict(list)
    for e in elements:
        classes[e["vector"], e["support"]] += 1
        if e["node"] != ROOT:
            below[e["parent"]].append(e["node"])
    order = [ROOT]
    for node in order:
        order += below[node]
    # the article with the most slot text below each path; of two that share it, the inner one
    article: dict = {}
    for node in reversed(order):
        held = [article[n] for n in below[node] if n in article]
        held += [n for n in below[node] if tag(by_node[n]["role"]) in ARTICLE_TAGS and n not in article]
        for n in below[node]:
            inner = article.get(n)
            if inner is not None and tag(by_node[n]["role"]) in ARTICLE_TAGS and by_node[inner]["chars"] < MOST_OF_TEXT * by_node[n]["chars"]:
                held.append(n)
        if held:
            article[node] = max(held, key=lambda n: (by_node[n]["chars"], n))
    here = ROOT
    while True:
        chars = max(1, by_node[here]["chars"]) if here in by_node else 1
        inner = article.get(here)
        if inner is not None and by_node[inner]["chars"] >= ARTICLE_SHARE * chars:
            here = inner
            continue
        open_ = [n for n in below[here] if tag(by_node[n]["role"]) not in CONTENT]
        # of equal amounts of text, the larger class is the firmer part of the template
        best = max(open_, key=lambda n: (by_node[n]["chars"], classes[by_node[n]["vector"], by_node[n]["support"]], n), default=None)
        if best is None or by_node[best]["chars"] < MOST_OF_TEXT * chars:
            return here
        here = best


def slot_text(html: str, main: int, hints: dict, texts: set) -> str:
    """The blocks of all slots in page order, joined by one space."""
    page = read_page(html)
    beside = page.beside(hints)
    blocks = [b for b in page.blocks if not b.aside and b.node not in beside]
    article = {n for n in page.within(page.articles()) if tag(page.role[n]) in TEXT_TAGS}
    kept = [b for b in blocks if b.node in article or (b.node, xxhash.xxh3_64_intdigest(b.text) >> 1) not in texts]
    if not kept:  # all of it is on many pages
        slots = page.within({main} if main in page.counts else page.articles())
        kept = [b for b in blocks if b.node in slots]
    return " ".join(b.text for b in kept)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    rows = _page_rows(pages)
    template = written(templates(written(token_vectors(rows))))
    salted = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "main", "hints", "texts")

    def make():
        def step(batch):
            out = []
            for page, main, hints, texts in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "hints", "texts"))):
                known = {(t["node"], t["text"]) for t in texts or ()}
                beside = {h["node"]: h["beside"] for h in hints or ()}
                out.append(slot_text(page, ROOT if main is None else main, beside, known))
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

        return step

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_batches(rows, make, f"page_id {kind}, url string, text string, n_chars long")
