"""Commits over several tables: all or nothing, conflicts as rows, and counts that equal a full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import editing
from docloom.operators.editing import apply_edits, wiki
from docloom.sources.snapshots import Lost, Snapshots

EDIT = "slug string, title string, content string, page_type string, base_version int, author string, at timestamp"


def edits(spark, rows):
    return spark.createDataFrame([(s, f"T {s}", c, "note", b, a, None) for s, c, b, a in rows], EDIT)


def tables(store, version=None):
    return {name: sorted(map(tuple, store.read(name, version).collect()), key=repr) for name in editing.TABLES}


def outcomes(found):
    return sorted((r.slug or "", r.author, r.outcome) for r in found.collect())


def test_batches_equal_a_full_recomputation(spark, tmp_path):
    rng, store = random.Random(2), wiki(spark, f"{tmp_path}/wiki", 8)
    slugs, versions, text, revisions = [f"p{i}" for i in range(12)], {}, {}, 0
    for batch in range(4):
        rows = []
        for slug in rng.sample(slugs, 6):
            content = " ".join(f"[[{rng.choice([*slugs, 'nowhere', ' p1 |text'])}]] x" for _ in range(rng.randrange(4)))
            stale = slug in versions and rng.random() < 0.3
            rows.append((slug, content, versions.get(slug, 0) - stale if slug in versions else None, "stale" if stale else "good"))
        found, version = apply_edits(store, edits(spark, rows))
        assert version == batch + 1 and all((o == "conflict") == (a == "stale") for _, a, o in outcomes(found))
        for slug, content, _, author in rows:
            if author == "good":
                versions[slug], text[slug], revisions = versions.get(slug, 0) + 1, content, revisions + 1
        pages = store.read("pages")
        assert {(r.slug, r.version, r.content) for r in pages.collect()} == {(s, versions[s], text[s]) for s in versions}
        links = editing._links(pages, "content")
        assert sorted(map(tuple, links.collect())) == sorted(map(tuple, store.read("links").collect()))
        counts = links.groupBy(F.col("to_slug").alias("slug")).agg(F.count("*").alias("n"))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, store.read("backlinks").collect()))
        assert {r.slug for r in editing.orphans(store).collect()} == set(versions) - {r.slug for r in counts.collect()}
        assert store.read("revisions").count() == revisions and store.read("index").count() == len(versions)
    assert {r.slug for r in store.read("pages", 1).collect()} <= set(versions) and store.read("revisions", 1).count() < revisions


def test_of_two_writers_one_loses(spark, tmp_path):
    store = wiki(spark, f"{tmp_path}/wiki", 4)
    apply_edits(store, edits(spark, [("a", "one [[b]]", None, "x"), ("b", "two", None, "x")]))
    base = store.version()
    first, second = (editing.judge(store, edits(spark, [("a", f"{w} [[b]] [[c]]", 1, w)]), base) for w in ("first", "second"))
    changes = [editing.prepare(store, w, base) for w in (first, second)]
    assert store.commit(base, changes[0]) == base + 1
    after = tables(store)
    with pytest.raises(Lost):
        store.commit(base, changes[1])
    assert tables(store) == after and [r.content for r in store.read("pages").where("slug = 'a'").collect()] == ["first [[b]] [[c]]"]
    found, version = apply_edits(store, edits(spark, [("a", "late", 1, "second"), ("d", "new", None, "second")]))  # judged on what the first left
    assert outcomes(found) == [("a", "second", "conflict"), ("d", "second", "created")] and version == base + 2


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    store, other, done = wiki(spark, f"{tmp_path}/wiki", 4), wiki(spark, f"{tmp_path}/wiki", 4), []
    commit = Snapshots.commit

    def late(self, base, changes):
        if self is store and not done:
            done.append(apply_edits(other, edits(spark, [("a", "theirs", None, "other")])))
        return commit(self, base, changes)

    monkeypatch.setattr(Snapshots, "commit", late)
    found, version = apply_edits(store, edits(spark, [("a", "mine", None, "me"), ("b", "mine", None, "me")]))
    assert version == 2 and outcomes(found) == [("a", "me", "conflict"), ("b", "me", "created")]
    assert {(r.slug, r.content) for r in store.read("pages").collect()} == {("a", "theirs"), ("b", "mine")}


def test_half_written_changes_are_not_seen(spark, tmp_path, monkeypatch):
    store = wiki(spark, f"{tmp_path}/wiki", 4)
    apply_edits(store, edits(spark, [("a", "[[b]]", None, "x")]))
    before = tables(store)
    monkeypatch.setattr(Snapshots, "added", lambda *a: 1 / 0)  # pages are written by then
    with pytest.raises(ZeroDivisionError):
        apply_edits(store, edits(spark, [("a", "[[c]]", 1, "x")]))
    monkeypatch.undo()
    assert tables(store) == before and store.version() == 1


def test_edge_cases(spark, tmp_path):
    store = wiki(spark, f"{tmp_path}/wiki", 4)
    found, version = apply_edits(store, edits(spark, []))
    assert (found.count(), version, store.read("pages").count()) == (0, 0, 0)
    table = "| Mã | Tên |\n|-|-|\n" + "".join(f"| {i} | người {i} |\n" for i in range(20))
    rows = [("a", table, None, "1"), ("a", "again", None, "2"), (None, "no slug", None, "3"), ("z", "of no page", 4, "4"), ("e", None, 0, "5")]
    found, version = apply_edits(store, edits(spark, rows).withColumn("was", F.lit("clash")).withColumn("old", F.lit("clash")))
    assert outcomes(found) == [("", "3", "conflict"), ("a", "1", "created"), ("a", "2", "conflict"), ("e", "5", "created"), ("z", "4", "conflict")]
    found, version = apply_edits(store, edits(spark, [("a", "| Mã | Tên |\n|-|-|\n| 1 | người 1 |", 1, "6"), ("e", "[[e]]", 1, "7")]))
    assert outcomes(found) == [("a", "6", "rows_lost"), ("e", "7", "updated")] and store.read("links").count() == 0
