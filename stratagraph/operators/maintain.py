"""Derived tables kept up to date by what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import stored
from ..sources.versioned import VersionedTables
from . import link

#: How each reference was last linked.
LINKS = "id bigint, from_uri string, ref_kind string, rule string, n bigint, uri string, outcome string"
#: Tables that are made from files, and replaced file by file.
OF_FILES = ["symbols", "edges", "references", "imports", "embeddings", "file_hash"]
#: Tables of these on which linking rests.
LINKED_FROM = ["symbols", "references", "imports", "edges"]


def link_changes(store: VersionedTables) -> int:
    """Bring the table ``links`` up to date; how many references were decided.

    The first time, and after one of the tables it rests on was replaced as a whole, these are all. Else
    they are the references of files that changed since the version linked last, and those whose name gained
    or lost a symbol in these files: every rule looks a symbol up by the reference's name, so no other
    outcome can differ. What is known of the changed files at that version is read from it.
    """
    change = store.begin()
    now, since = change.began, change.state.get("notes", {}).get("linked", 0)
    load = lambda name: store.load(name, now)
    changed = store.changed(LINKED_FROM, since) if since else None
    if changed is None:
        found = stored(link.link(load("references"), load("symbols"), load("edges"), load("imports")))
        change.overwrite("links", found.withColumn("owner", F.col("id").cast("string")))
    else:
        changed = stored(changed)
        if changed.isEmpty():
            return 0
        of = lambda name, version: store.load_changed(name, changed, version)
        sides = [stored(of(name, version)) for name in ("symbols", "edges") for version in (since, now)]
        names = stored(link.changed_names(*sides))
        refs = stored(link.is_affected(load("references"), names, changed.withColumnRenamed("owner", "file_path")))
        found = stored(link.relink(refs, load("symbols"), load("edges"), load("imports")))
        gone = of("references", since).select("id").unionByName(refs.select("id"))
        change.replace(gone.select(F.col("id").cast("string").alias("owner")), links=found.withColumn("owner", F.col("id").cast("string")))
    change.notes["linked"] = now
    change.commit()
    return found.count()
