"""Scene and session operations by name, with declared parameters, over DataFrames. A change gives a new DataFrame; nothing is changed in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import screenplays, tables
from .registry import Parameter, Registry, Tool


@dataclass
class SceneStore:
    """Tables of the screenplay store.

    projects (id, slug, title), scenes (id, project_id, scene_number, heading, title, summary, tags, narrative_order, status, text),
    elements (id, scene_id, element_type, order_index, content), relations (a, b, kind), embeddings (scene_id, vector).
    """

    projects: DataFrame
    scenes: DataFrame
    elements: DataFrame
    relations: DataFrame
    embeddings: DataFrame | None = None
    default_project: str | None = None

    def scene(self, number: int | None = None, scene_id: int | None = None, project: str | None = None) -> DataFrame:
        """The one scene of this id, or of this number in the project; LookupError if there is none. [RET6]"""
        if scene_id is not None:
            return tables.resolve_one(self.scenes, F.col("id") == scene_id)
        owner = tables.resolve_one(self.projects, F.col("slug") == (project or self.default_project)).select(F.col("id").alias("project_id"))
        return tables.resolve_one(self.scenes.join(F.broadcast(owner), "project_id", "left_semi"), F.col("scene_number") == number)

    def search(self, query: str, top_k: int = 5, project_slug: str | None = None, vector: list[float] | None = None) -> DataFrame:
        """[RET3]"""
        named = self.scenes.join(self.projects.select(F.col("id").alias("project_id"), F.col("slug").alias("project")), "project_id").withColumnRenamed("id", "scene_id")
        return screenplays.search_scenes(named, query, vector, self.embeddings, project_slug or self.default_project, top_k)

    def get(self, scene_number: int | None = None, scene_id: int | None = None, project_slug: str | None = None) -> DataFrame:
        """The scene with its elements in order, its outgoing links and its project. [RET4, JN3]"""
        one = self.scene(scene_number, scene_id, project_slug)
        parts = self.elements.select(F.col("scene_id").alias("id"), "order_index", "element_type", "content")
        whole = tables.nested(one, parts, "id", "order_index", ["order_index", "element_type", "content"], "elements")
        links = self.relations.select(F.col("a").alias("id"), F.col("b").alias("scene_id"), "kind")
        whole = tables.nested(whole, links, "id", "scene_id", ["scene_id", "kind"], "related")
        owner = self.projects.select(F.col("id").alias("project_id"), F.col("slug").alias("project_slug"), F.col("title").alias("project_title"))
        return whole.join(owner, "project_id")

    def update(self, scene_number: int, project_slug: str | None = None, **values) -> bool:
        """Sets the given fields of a scene; whether any was given. [SNK11]"""
        given = {k: v for k, v in values.items() if v is not None}
        own = self.scene(scene_number, project=project_slug).first().id
        cells = {k: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v).cast(dict(self.scenes.dtypes)[k]) for k, v in given.items()}
        if cells:
            self.scenes = tables.patch(self.scenes, F.col("id") == own, cells).select(self.scenes.columns)
        return bool(given)

    def reorder(self, scene_number: int, project_slug: str | None = None, after_scene: int | None = None, before_scene: int | None = None) -> float:
        """Moves a scene between two, after one or before one; its new place. [RET9, WIN9]"""
        one = self.scene(scene_number, project=project_slug).first()
        place = lambda n: None if n is None else self.scene(n, project=project_slug).first().narrative_order
        low, high = place(after_scene), place(before_scene)
        others = self.scenes.filter((F.col("project_id") == one.project_id) & (F.col("id") != one.id))
        next_ = others.filter(F.col("narrative_order") > low).agg(F.min("narrative_order")).first()[0] if low is not None and high is None else None
        previous = others.filter(F.col("narrative_order") < high).agg(F.max("narrative_order")).first()[0] if high is not None and low is None else None
        to = tables.between(low, high, next_, previous)
        self.scenes = tables.patch(self.scenes, F.col("id") == one.id, {"narrative_order": F.lit(to)}).select(self.scenes.columns)
        return to

    def link(self, from_scene: int, to_scene: int, relation_type: str = "sequence", project_slug: str | None = None) -> bool:
        """[RET8, SNK13]"""
        a, b = (self.scene(n, project=project_slug).first().id for n in (from_scene, to_scene))
        new = self.scenes.sparkSession.createDataFrame([(a, b, relation_type)], "a long, b long, kind string")
        self.relations = tables.insert_edge(self.relations, self.scenes, new)
        return True

    def registry(self) -> Registry:
        """scene_search, scene_get, scene_update, scene_reorder and scene_link."""
        number, text, project = Parameter(int, required=True), Parameter(str), {"project_slug": Parameter(str, required=self.default_project is None)}
        found = Registry()
        for name, run, parameters, any_of in (
            ("scene_search", self.search, {"query": Parameter(str, required=True), "top_k": Parameter(int, low=1, high=20), "project_slug": text}, ()),
            ("scene_get", self.get, {"scene_number": Parameter(int), "scene_id": Parameter(int), "project_slug": text}, ("scene_number", "scene_id")),
            ("scene_update", self.update, {"scene_number": number, "title": text, "summary": text, "tags": Parameter(list), "narrative_order": Parameter(float), "status": text, **project}, ()),
            ("scene_reorder", self.reorder, {"scene_number": number, "after_scene": Parameter(int), "before_scene": Parameter(int), **project}, ()),
            ("scene_link", self.link, {"from_scene": number, "to_scene": number, "relation_type": text, **project}, ()),
        ):
            found.register(Tool(name, run, "scenes", parameters, any_of))
        return found


TURNS = "session string, place long, op string, text string"


@dataclass
class SessionStore:
    """Sessions as a log of turns and of 'create', 'clear' and 'delete' marks (session, place, op, text); the batch twin of ``streams.sessions``. [STR10]"""

    log: DataFrame
    current: str | None = None
    most: int = 20

    def _append(self, session: str, op: str, text: str | None = None) -> None:
        place = (self.log.agg(F.max("place")).first()[0] or 0) + 1
        self.log = self.log.unionByName(self.log.sparkSession.createDataFrame([(session, place, op, text)], TURNS))

    def list(self) -> DataFrame:
        """(session, turns, active): the sessions that are there, their turns since they were last cleared, and how many of them count."""
        last = Window.partitionBy("session")
        marked = self.log.withColumn("gone", F.max(F.when(F.col("op") == "delete", F.col("place"))).over(last)).withColumn("clear", F.max(F.when(F.col("op") == "clear", F.col("place"))).over(last))
        there = marked.filter(F.col("place") > F.coalesce("gone", F.lit(-1)))
        turns = F.count_if((F.col("op") == "turn") & (F.col("place") > F.coalesce("clear", F.lit(-1))))
        return there.groupBy("session").agg(turns.alias("turns")).withColumn("active", F.least("turns", F.lit(self.most).cast("long")))

    def get(self, session: str) -> DataFrame:
        """LookupError if there is no such session."""
        return tables.resolve_one(self.list(), F.col("session") == session)

    def create(self, session: str) -> str:
        self._append(session, "create")
        self.current = session
        return session

    def add(self, text: str, session: str | None = None) -> None:
        """A turn; a session is made by its first one."""
        self._append(session or self.current, "turn", text)

    def switch(self, session: str) -> str:
        self.current = self.get(session).first().session
        return self.current

    def history(self, session: str, last_n: int = 10) -> DataFrame:
        """The last turns since the session was last cleared or deleted, oldest first."""
        self.get(session)
        own = self.log.filter(F.col("session") == session)
        since = own.filter(F.col("op").isin("clear", "delete")).agg(F.coalesce(F.max("place"), F.lit(-1))).scalar()
        return own.filter((F.col("op") == "turn") & (F.col("place") > since)).orderBy(F.desc("place")).limit(last_n).orderBy("place").select("place", "text")

    def clear(self, session: str) -> None:
        self.get(session)
        self._append(session, "clear")

    def delete(self, session: str) -> None:
        self.get(session)
        self._append(session, "delete")
        self.current = None if self.current == session else self.current

    def registry(self) -> Registry:
        name, found = {"session": Parameter(str, required=True)}, Registry()
        for tool, run, parameters in (
            ("session_list", self.list, {}), ("session_create", self.create, name), ("session_get", self.get, name), ("session_switch", self.switch, name), ("session_delete", self.delete, name), ("session_clear", self.clear, name),
            ("session_history", self.history, name | {"last_n": Parameter(int, low=1)}),
        ):
            found.register(Tool(tool, run, "sessions", parameters))
        return found
