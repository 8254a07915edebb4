"""Markup residue in texts, cleaned by wrapper induction.

Each text is a page of its host (a column, such as the table or site it comes
from). Its tree (see ``dom``) is cut into the regions below its root. Regions
of the same host with the same root are aligned by simple tree matching: a
region whose tree is alike enough to a template widens it, else it opens a
new one. Nodes of a template are its constant part; the texts below them are
slots. A slot that says the same on all of at least MIN_PAGES pages belongs to
the template too (boilerplate), any other is content.

Records are marked through the templates: a record has markup if a region of
it belongs to an induced template; its clean text is what the template's slots
hold, in the reading order of the tree.

Regions are pre-aggregated to distinct skeletons (trees without texts, equal
neighbours as one) before anything is aligned, so a template seen on a third of
all pages is one row there. The alignment streams over the skeletons of a
(host, root) and holds its templates only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.llm.dom import SIGNS, Tree, align, fragments, likeness, parse, render, skeleton, slots, unskeleton

#: Regions at least this alike (twice the matched nodes over all nodes) share a template.
LIKE = 0.5
#: Pages that must agree before a slot's text is taken for boilerplate.
MIN_PAGES = 20
_CONVENTIONS = r"</?i>|\{\\an[1-9]\}"


def suspect(content: str) -> Column:
    """Whether a text holds any sign of markup beyond caption conventions."""
    return F.regexp_replace(F.col(content), _CONVENTIONS, "").rlike(SIGNS)


def find_regions(df: DataFrame, keys: list[str], content: str = "content", host: str | None = None) -> DataFrame:
    """(keys, content, _host, _regions): texts with elements, and the (root, skeleton, texts) of each."""
    region = T.StructType([T.StructField("root", T.StringType()), T.StructField("skel", T.StringType()), T.StructField("said", T.ArrayType(T.StringType()))])
    schema = T.StructType(
        [*(df.schema[k] for k in keys), T.StructField(content, T.StringType()), T.StructField("_host", T.StringType()), T.StructField("_regions", T.ArrayType(region))]
    )
    arrow = pa.list_(pa.struct([("root", pa.string()), ("skel", pa.string()), ("said", pa.list_(pa.string()))]))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, regions = [], []
            for i, text in enumerate(batch.column(n).to_pylist()):
                found = fragments(parse(text))
                if found:
                    at.append(i)
                    regions.append([{"root": f.label, "skel": skeleton(f), "said": slots(f)} for f in found])
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(regions, arrow)], names=[*keys, content, "_host", "_regions"])

    source = df.select(
        *keys, F.col(content).cast("string").alias(content), (F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit("")).alias("_host")
    )
    return source.where(suspect(content)).mapInArrow(run, schema)


def induce_templates(regions: DataFrame) -> DataFrame:
    """(_host, skel, template, pages, fixed): the template of each distinct skeleton.

    template names the aligned tree, with ``+`` for repeated and ``?`` for
    optional nodes; fixed are the places of slots that hold boilerplate.
    """
    said = regions.select("_host", F.explode("_regions").alias("_r")).select("_host", "_r.root", "_r.skel", F.posexplode_outer("_r.said").alias("_p", "_t"))
    slot = said.groupBy("_host", "root", "skel", "_p").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.count(F.lit(1)).alias("_n"))
    skeletons = slot.groupBy("_host", "root", "skel").agg(
        F.max("_n").alias("pages"),
        F.array_sort(F.collect_set(F.when((F.col("_low") == F.col("_high")) & (F.col("_low") != "") & (F.col("_n") >= MIN_PAGES), F.col("_p")))).alias("fixed"),
    )
    schema = T.StructType([*(skeletons.schema[c] for c in ("_host", "root", "skel", "pages", "fixed")), T.StructField("template", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[str, str], list[Tree]] = {}
        number: list[int] = []
        home: list[tuple[str, str]] = []
        rows: list[pa.RecordBatch] = []
        for batch in batches:
            rows.append(batch)
            for host, root, skel in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tree = unskeleton(skel)
                templates = own.setdefault((host, root), [])
                best = max(range(len(templates)), key=lambda k: likeness(templates[k], tree), default=-1)
                if best >= 0 and likeness(templates[best], tree) >= LIKE:
                    templates[best] = align(templates[best], tree)
                else:
                    best = len(templates)
                    templates.append(tree)
                number.append(best)
                home.append((host, root))
        at = 0
        for batch in rows:
            names = [str(own[home[at + i]][number[at + i]]) for i in range(batch.num_rows)]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "template"])

    # All skeletons of one root meet in one task, the commonest first, so templates don't depend on the partitioning.
    ordered = skeletons.repartition("_host", "root").sortWithinPartitions("_host", "root", F.desc("pages"), "skel")
    return ordered.mapInArrow(run, schema)


def find_markup(df: DataFrame, keys: list[str], content: str = "content", host: str | None = None) -> DataFrame:
    """(keys, host, n_regions, templates): each record that holds markup.

    Null, empty and plain texts don't come out; repeated rows come out once
    per distinct keys. Other columns are not read, and may be named anything.
    """
    regions = find_regions(df, keys, content, host).persist(StorageLevel.MEMORY_AND_DISK)
    templates = induce_templates(regions).select("_host", "skel", "template")
    each = regions.select(*keys, "_host", F.explode(F.array_distinct("_regions.skel")).alias("skel"))
    return (
        each.join(templates, ["_host", "skel"])
        .groupBy(*keys, F.col("_host").alias("host"))
        .agg(F.size(F.collect_set("skel")).alias("n_regions"), F.array_sort(F.collect_set("template")).alias("templates"))
    )


def clean_markup(df: DataFrame, keys: list[str], content: str = "content", host: str | None = None) -> DataFrame:
    """(keys, host, content, clean, templates): the clean text of each record that holds markup.

    Headings, lists, code and formulas keep a plain form (``dom.render``),
    boilerplate regions go. Cases as in find_markup; a record delivered with
    several contents comes out once for each.
    """
    regions = find_regions(df, keys, content, host).persist(StorageLevel.MEMORY_AND_DISK)
    found = induce_templates(regions).select("_host", "skel", "template", F.size("fixed").alias("_fixed"))
    each = regions.select(*keys, content, "_host", F.posexplode("_regions").alias("_at", "_r")).select(
        *keys, content, "_host", "_at", F.col("_r.skel").alias("skel"), F.size("_r.said").alias("_slots")
    )
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("host", T.StringType()), *(T.StructField(c, T.StringType()) for c in (content, "clean", "templates"))])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, names = [], []
            for text, parts in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True):
                clean.append(render(parse(text), frozenset(p["_at"] for p in parts if p["_dull"])))
                names.append(json.dumps(sorted({p["template"] for p in parts})))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(clean, pa.string()), pa.array(names, pa.string())], names=schema.names)

    rows = (
        each.join(found, ["_host", "skel"])
        .withColumn("_dull", (F.col("_slots") > 0) & (F.col("_fixed") == F.col("_slots")))
        .groupBy(*keys, F.col("_host").alias("host"), content)
        .agg(F.array_sort(F.collect_set(F.struct("_at", "_dull", "template"))).alias("_parts"))
    )
    return rows.select(*keys, "host", content, "_parts").mapInArrow(run, schema)
