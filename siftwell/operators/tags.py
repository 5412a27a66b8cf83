"""Tags as a forest, their bridges to sections, and research topics.

Trees are walked with recursive queries, level by level, over the tag table
alone. A walk stops after MAX_DEPTH levels, which also ends a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clean_tag_name
from siftwell.operators.relational import absent, counted

MAX_DEPTH = 64


def _recursive(tags: DataFrame, sql: str) -> DataFrame:
    return tags.sparkSession.sql(sql, tags=tags)


def paths(tags: DataFrame, separator: str = " > ") -> DataFrame:
    """id, name, parent_id, root_id, depth, path and path_ids of every tag, from its root down."""
    return _recursive(
        tags,
        f"""
        WITH RECURSIVE walk (id, name, parent_id, root_id, depth, path, path_ids) AS (
            SELECT id, name, parent_id, id, 0, name, array(id) FROM {{tags}} WHERE parent_id IS NULL
            UNION ALL
            SELECT t.id, t.name, t.parent_id, w.root_id, w.depth + 1, concat(w.path, '{separator}', t.name), concat(w.path_ids, array(t.id))
            FROM walk w JOIN {{tags}} t ON t.parent_id = w.id WHERE w.depth < {MAX_DEPTH}
        ) SELECT * FROM walk""",
    )


def ancestors(tags: DataFrame, tag_id: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """tag_id, ancestor_id and distance, of one tag, of those in ``own`` (rows of tags), or of all."""
    start = "" if tag_id is None else f"AND id = {int(tag_id)}"
    return tags.sparkSession.sql(
        f"""
        WITH RECURSIVE up (tag_id, ancestor_id, distance) AS (
            SELECT id, parent_id, 1 FROM {{own}} WHERE parent_id IS NOT NULL {start}
            UNION ALL
            SELECT u.tag_id, t.parent_id, u.distance + 1 FROM up u JOIN {{tags}} t ON t.id = u.ancestor_id WHERE t.parent_id IS NOT NULL AND u.distance < {MAX_DEPTH}
        ) SELECT * FROM up""",
        tags=tags,
        own=tags if own is None else own,
    )


def descendants(tags: DataFrame, tag_id: int) -> DataFrame:
    """descendant_id and distance of all tags below one."""
    return _recursive(
        tags,
        f"""
        WITH RECURSIVE down (descendant_id, distance) AS (
            SELECT id, 1 FROM {{tags}} WHERE parent_id = {int(tag_id)}
            UNION ALL
            SELECT t.id, d.distance + 1 FROM down d JOIN {{tags}} t ON t.parent_id = d.descendant_id WHERE d.distance < {MAX_DEPTH}
        ) SELECT * FROM down""",
    )


def roots(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("parent_id").isNull())


def with_flags(tags: DataFrame) -> DataFrame:
    """Tags with is_root and has_children."""
    parents = tags.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("__p")).distinct()
    return tags.join(parents, F.col("id") == F.col("__p"), "left").withColumns({"is_root": F.col("parent_id").isNull(), "has_children": F.col("__p").isNotNull()}).drop("__p")


def nested(tags: DataFrame, limit: int = 10_000) -> list[dict]:
    """The forest as nested dicts, for a display: of at most ``limit`` tags, by path."""
    rows = paths(tags).orderBy("path").limit(limit).collect()
    nodes = {r.id: {"id": r.id, "name": r.name, "children": []} for r in rows}
    for r in rows:
        if r.parent_id in nodes:
            nodes[r.parent_id]["children"].append(nodes[r.id])
    return [nodes[r.id] for r in rows if r.parent_id is None]


def with_new_names(tags: DataFrame, names: DataFrame, now) -> DataFrame:
    """Tags and those of ``names`` (name, parent_id) that are missing, ids going on from the largest; a tag that exists keeps its parent."""
    wanted = names.select(clean_tag_name(F.col("name")).alias("name"), F.col("parent_id").cast("long")).where(F.col("name").isNotNull())
    fresh = absent(wanted.groupBy("name").agg(F.min("parent_id").alias("parent_id")), tags, "name")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    numbered = fresh.withColumn("__n", F.row_number().over(Window.orderBy("name"))).crossJoin(F.broadcast(top))
    return tags.unionByName(numbered.select((F.col("__top") + F.col("__n")).alias("id"), "name", "parent_id", F.lit(now).cast("timestamp").alias("created_at")))


def parent_conflicts(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Names that exist under another parent than the one asked for."""
    asked = names.select(F.col("name").alias("__name"), F.col("parent_id").cast("long").alias("asked_parent_id"))
    return tags.join(asked, F.col("name") == F.col("__name")).where(~F.col("parent_id").eqNullSafe(F.col("asked_parent_id"))).select("id", "name", "parent_id", "asked_parent_id")


def flatten(hierarchy, parent: str | None = None) -> list[tuple[str, str | None]]:
    """(name, parent's name) of a nested dict or list of names, parents first."""
    out: list[tuple[str, str | None]] = []
    items = hierarchy.items() if isinstance(hierarchy, dict) else [(x, None) if isinstance(x, str) else (None, x) for x in hierarchy or []]
    for name, below in items:
        if name is None:
            out += flatten(below, parent)
            continue
        out.append((name, parent))
        out += flatten(below or [], name)
    return out


def with_hierarchy(tags: DataFrame, hierarchy, now) -> DataFrame:
    """Tags and those of a nested dict or list, a level at a time."""
    pairs = flatten(hierarchy)
    level = {None: 0}
    for name, parent in pairs:
        level.setdefault(name, level[parent] + 1)
    spark = tags.sparkSession
    for depth in range(1, max(level.values()) + 1):
        rows = spark.createDataFrame([(n, p) for n, p in pairs if level[n] == depth], "name string, parent string")
        parents = tags.select(F.col("id").alias("parent_id"), F.col("name").alias("__parent"))
        tags = with_new_names(tags, rows.join(parents, F.col("parent") == F.col("__parent"), "left").select("name", "parent_id"), now)
    return tags


def moved(tags: DataFrame, tag_id: int, parent_id: int | None) -> DataFrame:
    """Tags with one under a new parent; a move below itself raises."""
    if parent_id is not None and (parent_id == tag_id or not descendants(tags, tag_id).where(F.col("descendant_id") == parent_id).isEmpty()):
        raise ValueError("a tag can't move below itself")
    return tags.withColumn("parent_id", F.when(F.col("id") == tag_id, F.lit(parent_id).cast("long")).otherwise(F.col("parent_id")))


def linked(bridge: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, now, replace: bool = False) -> DataFrame:
    """A bridge table with every pair of ``left`` and ``right`` ids (column id); pairs that exist stay as they are.

    ``left`` and ``right`` are what a caller names, so the pairs are as many as asked for. With
    ``replace``, other pairs of the left ids go.
    """
    pairs = left.select(F.col("id").alias(left_key)).distinct().join(right.select(F.col("id").alias(right_key)).distinct())
    kept = bridge
    if replace:
        gone = bridge.join(left.select(F.col("id").alias(left_key)), left_key, "left_semi").join(pairs, [left_key, right_key], "left_anti")
        kept = bridge.join(gone, [left_key, right_key], "left_anti")
    fresh = pairs.join(bridge, [left_key, right_key], "left_anti").withColumn("created_at", F.lit(now).cast("timestamp"))
    return kept.unionByName(fresh)


def unlinked(bridge: DataFrame, left_key: str, left_id: int, right_key: str | None = None, right_ids: list[int] | None = None) -> DataFrame:
    """A bridge table without some or all pairs of one id."""
    gone = F.col(left_key) == left_id
    if right_ids is not None and right_key:
        gone = gone & F.col(right_key).isin(right_ids)
    return bridge.where(~gone)


def popular(tags: DataFrame, section_tags: DataFrame, limit: int | None = 20) -> DataFrame:
    """Tags by the number of their sections, unused ones last."""
    out = counted(tags, section_tags, "id", "tag_id").orderBy(F.desc("section_count"), "id")
    return out.limit(limit) if limit is not None else out


def sections_with_tag(sections: DataFrame, section_tags: DataFrame, tag_ids: list[int], document_id: int | None = None, embeddings: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Sections that have any of the tags, each once; optionally of one document, and those with an embedding only."""
    own = section_tags.where(F.col("tag_id").isin(tag_ids)).select(F.col("section_id").alias("__s"))
    out = sections.join(own, F.col("id") == F.col("__s"), "left_semi")
    if document_id is not None:
        out = out.where(F.col("document_id") == document_id)
    if embeddings is not None:
        out = out.join(embeddings.select(F.col("source_id").alias("__e")), F.col("id") == F.col("__e"), "left_semi")
    out = out.orderBy("id")
    return out.limit(limit) if limit is not None else out


def tags_of_section(tags: DataFrame, section_tags: DataFrame, section_id: int, with_ancestors: bool = False) -> DataFrame:
    own = tags.join(section_tags.where(F.col("section_id") == section_id).select(F.col("tag_id").alias("__t")), F.col("id") == F.col("__t"), "left_semi")
    if not with_ancestors:
        return own
    up = ancestors(tags, own=own).select("ancestor_id").distinct()
    return own.unionByName(tags.join(up, F.col("id") == F.col("ancestor_id"), "left_semi")).dropDuplicates(["id"])


def tag_lists(section_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """section_id and tags, the sorted names of each section's tags."""
    return section_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("section_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))


def resolved(tags: DataFrame, references: list) -> DataFrame:
    """The tags that ids and names refer to, each once; one that doesn't exist raises. The references are what a caller names."""
    ids, names = [r for r in references if isinstance(r, int)], [r for r in references if isinstance(r, str)]
    if len(ids) + len(names) < len(references):
        raise ValueError("a tag is referred to by its id or its name")
    found = tags.where(F.col("id").isin(ids) | F.col("name").isin(names))
    known = found.select("id", "name").collect()
    missing = [r for r in references if r not in {k for row in known for k in row}]
    if missing:
        raise ValueError(f"no tag {missing[0]}")
    return found


def topics_by_tag(topics: DataFrame, topic_tags: DataFrame, tag_id: int) -> DataFrame:
    own = topic_tags.where(F.col("tag_id") == tag_id).select(F.col("research_topic_id").alias("__t"))
    return topics.join(own, F.col("id") == F.col("__t"), "left_semi")


def topic_tag_counts(topic_tags: DataFrame, limit: int = 20) -> DataFrame:
    return topic_tags.groupBy("tag_id").agg(F.count("*").alias("topic_count")).orderBy(F.desc("topic_count"), "tag_id").limit(limit)


def related_topics(topic_sections: DataFrame, topic_id: int, limit: int = 5) -> DataFrame:
    """Topics that share the most sections with one."""
    own = topic_sections.where(F.col("research_topic_id") == topic_id).select(F.col("section_id").alias("__s")).distinct()
    others = topic_sections.where(F.col("research_topic_id") != topic_id).join(own, F.col("section_id") == F.col("__s"), "left_semi")
    return others.groupBy("research_topic_id").agg(F.countDistinct("section_id").alias("overlap")).orderBy(F.desc("overlap"), "research_topic_id").limit(limit)


def recommended_topics(topic_tags: DataFrame, section_tags: DataFrame, sections: DataFrame, document_id: int, limit: int = 10) -> DataFrame:
    """Topics by how many of their tags a document's sections have."""
    own = section_tags.join(sections.where(F.col("document_id") == document_id).select(F.col("id").alias("__s")), F.col("section_id") == F.col("__s"), "left_semi").select("tag_id").distinct()
    return topic_tags.join(own, "tag_id").groupBy("research_topic_id").agg(F.countDistinct("tag_id").alias("matching_tags")).orderBy(F.desc("matching_tags"), "research_topic_id").limit(limit)
