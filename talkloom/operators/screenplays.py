"""The screenplay store: search over scenes, replacing a project's scenes, and export as Fountain and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import preview
from ..functions.vectors import cosine
from .retrieval import ratio, search_text, top_k

SCENE_COLUMNS = ("scene_id", "scene_number", "heading", "title", "narrative_order", "status")


def search_scenes(scenes: DataFrame, query: str, vector: list[float] | None = None, embeddings: DataFrame | None = None, slug: str | None = None, k: int = 5) -> DataFrame:
    """(scene columns, score, preview): the k best scenes by cosine with ``vector``; by the ratio of lower-cased texts where there
    is no vector or no scene in question has an embedding. ``scenes``: the scene columns, project and text; ``embeddings``: scene_id, vector. [RET3]"""
    rows = scenes.filter(F.col("project") == slug) if slug else scenes
    shown = [*SCENE_COLUMNS, "score", preview(F.col("text")).alias("preview")]
    by_text = lambda: rows.withColumn("score", ratio(F.lit(query.lower()), F.lower("text")))
    if vector is None or embeddings is None:
        return top_k(by_text(), "score", "scene_id", k, floor=False).select(*shown)
    asked = F.array(*[F.lit(float(x)) for x in vector])
    found = rows.join(embeddings.select("scene_id", "vector"), "scene_id").withColumn("score", cosine(F.col("vector"), asked, 0.0, strict=False)).drop("vector")
    some = found.agg(F.count("*") > 0).scalar()
    return top_k(found.unionByName(by_text().filter(~some)), "score", "scene_id", k, floor=False).select(*shown)


def retrieve_templates(prompt: str, snippets: DataFrame, memories: DataFrame, order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(snippets, memories) for a request: the style card if it is about scripts, the best snippet of each keyword it names, and the
    memories of the first topic that it touches. Both carry ``route``. [RET7]"""
    low = prompt.lower()
    of_tags = lambda tags: search_text(snippets, "", F.concat_ws(" ", "title", "body"), order, 1, F.col("tags"), list(tags))
    picked = [of_tags(fixed.STYLE_TAGS).withColumn("route", F.lit("style"))] if any(w in low for w in fixed.SCRIPT_WORDS) else []
    picked += [of_tags(tags).withColumn("route", F.lit(word)) for word, tags in fixed.SNIPPET_ROUTES if word in low]
    none = snippets.limit(0).withColumn("score", F.lit(0.0)).withColumn("route", F.lit(""))
    for found in picked:
        none = none.unionByName(found)
    asked, n = next(((q, n) for words, q, n in fixed.MEMORY_ROUTES if any(w in low for w in words)), (None, 0))
    if asked is None:
        return none, memories.limit(0).withColumn("score", F.lit(0.0)).withColumn("route", F.lit(""))
    return none, search_text(memories, asked, F.col("text"), order, n, F.col("tags"), ["film"]).withColumn("route", F.lit(asked))


def replace_project(project: int, scenes: DataFrame, elements: DataFrame, characters: DataFrame, new_scenes: DataFrame, new_elements: DataFrame, new_characters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenes, elements, characters) with the project's scenes and their elements replaced, and characters that are absent added. [SNK10]

    Old tables: scenes (id, project_id, scene_number, location, narrative_order, status), elements (id, scene_id, element_type, order_index,
    content), characters (id, project_id, name). New ones without ids, elements by scene_number. Ids go on from the largest there is.
    """
    after = lambda old, order: (F.coalesce(old.agg(F.max("id")).scalar(), F.lit(0)) + F.row_number().over(Window.orderBy(*order))).cast("long")
    added = new_scenes.withColumn("id", after(scenes, ["scene_number"])).withColumn("project_id", F.lit(project).cast("long")).withColumn("narrative_order", F.col("scene_number").cast("double")).withColumn("status", F.lit("active"))
    gone = scenes.filter(F.col("project_id") == project).select(F.col("id").alias("scene_id"))
    parts = new_elements.join(added.select("scene_number", F.col("id").alias("scene_id")), "scene_number").withColumn("id", after(elements, ["scene_number", "order_index"]))
    known = characters.filter(F.col("project_id") == project).select("name")
    people = new_characters.select("name").distinct().join(known, "name", "left_anti").withColumn("id", after(characters, ["name"])).withColumn("project_id", F.lit(project).cast("long"))
    return (
        scenes.filter(F.col("project_id") != project).unionByName(added.select(scenes.columns)),
        elements.join(gone, "scene_id", "left_anti").select(elements.columns).unionByName(parts.select(elements.columns)),
        characters.unionByName(people.select(characters.columns)),
    )


def _spoken(each) -> Column:
    return F.flatten(F.transform(F.coalesce("lines", F.array().cast("array<struct<text:string,translation:string>>")), each))


def _documents(projects: DataFrame, scenes: DataFrame, elements: DataFrame, element: Column, before: Column, after: Column, head: Column, tail: Column) -> DataFrame:
    """(project_id, text): lines of the title, of each scene in order around those of its elements in order, and the end."""
    empty = F.array().cast("array<string>")
    in_order = lambda items: F.flatten(F.transform(F.array_sort(items), lambda x: x["l"]))
    inner = elements.withColumn("l", F.filter(element, lambda x: x.isNotNull())).groupBy("scene_id").agg(in_order(F.collect_list(F.struct(F.col("order_index").alias("o"), F.col("l")))).alias("inner"))
    lines = F.concat(before, F.coalesce("inner", empty), after)
    outer = scenes.join(inner, "scene_id", "left").withColumn("l", lines).groupBy("project_id").agg(in_order(F.collect_list(F.struct(F.col("scene_number").alias("o"), F.col("scene_id").alias("i"), F.col("l")))).alias("outer"))
    whole = F.concat(F.filter(head, lambda x: x.isNotNull()), F.coalesce("outer", empty), tail)
    return projects.join(outer, "project_id", "left").select("project_id", F.array_join(whole, "\n").alias("text"))


def fountain(projects: DataFrame, scenes: DataFrame, elements: DataFrame, translations: bool = True, in_parentheses: bool = True) -> DataFrame:
    """(project_id, text) in Fountain format. [SNK18]

    projects (project_id, title, author, draft_date), scenes (project_id, scene_id, scene_number, heading), elements (scene_id, order_index,
    element_type, text, character, parenthetical, lines of (text, translation)).
    """
    blank, text = F.lit(""), F.coalesce("text", F.lit(""))
    shown = lambda x: F.lit(translations) & (F.length(x["translation"]) > 0)
    said = (lambda x: F.when(shown(x), F.array(x["text"], F.concat(F.lit("("), x["translation"], F.lit(")")))).otherwise(F.array(x["text"]))) if in_parentheses else (lambda x: F.array(F.when(shown(x), F.concat(x["text"], F.lit(" -- "), x["translation"])).otherwise(x["text"])))
    aside = F.when(F.length("parenthetical") > 0, F.concat(F.lit("("), F.col("parenthetical"), F.lit(")")))
    element = F.when(F.col("element_type") == "action", F.array(text, blank)).when(F.col("element_type") == "dialogue", F.concat(F.array(F.upper(F.coalesce("character", F.lit("UNKNOWN"))), aside), _spoken(said), F.array(blank)))
    element = element.when(F.col("element_type") == "transition", F.array(F.concat(F.lit("> "), F.coalesce("text", F.lit("CUT TO:"))), blank)).otherwise(F.array().cast("array<string>"))
    named = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    head = F.array(F.concat(F.lit("Title: "), F.col("title")), named("Author", "author"), named("Draft date", "draft_date"), blank, blank)
    return _documents(projects, scenes, elements, element, F.array(F.col("heading"), blank), F.array(blank), head, F.array().cast("array<string>"))


def html(projects: DataFrame, scenes: DataFrame, elements: DataFrame, translations: bool = True, style: str = "body { font-family: monospace; }", unknown_author: str = "Unknown") -> DataFrame:
    """(project_id, text) as an HTML page; the columns are those of ``fountain``. [SNK18]"""
    div = lambda name, c: F.concat(F.lit(f'<div class="{name}">'), c, F.lit("</div>"))
    text = F.coalesce("text", F.lit(""))
    translated = lambda x: F.when(F.lit(translations) & (F.length(x["translation"]) > 0), div("dialogue translation", F.concat(F.lit("("), x["translation"], F.lit(")"))))
    aside = F.when(F.length("parenthetical") > 0, div("parenthetical", F.concat(F.lit("("), F.col("parenthetical"), F.lit(")"))))
    spoken = _spoken(lambda x: F.array(div("dialogue", x["text"]), translated(x)))
    element = F.when(F.col("element_type") == "action", F.array(div("action", F.replace(text, F.lit("\n"), F.lit("<br>"))))).when(F.col("element_type") == "dialogue", F.concat(F.array(div("character", F.upper(F.coalesce("character", F.lit("UNKNOWN")))), aside), spoken))
    element = element.when(F.col("element_type") == "transition", F.array(div("transition", F.coalesce("text", F.lit("CUT TO:"))))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit(f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="UTF-8">\n<style>{style}</style>\n</head>\n<body>'), div("title", F.col("title")), div("author", F.coalesce(F.nullif("author", F.lit("")), F.lit(unknown_author))))
    return _documents(projects, scenes, elements, element, F.array(div("scene-heading", F.col("heading"))), F.array().cast("array<string>"), head, F.array(F.lit("</body></html>")))
