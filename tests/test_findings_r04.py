"""Steps rewritten for the findings of round 4 give what the plain definitions give."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from postmatch.operators import candidates as C
from postmatch.operators import dedup, keyed, ranking
from postmatch.plans import bindings as B
from postmatch.plans import daily_run as D
from postmatch.plans.registered_run import inputs
from postmatch.plans.registered_sources import ingest_source
from postmatch.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_members_of_classes_are_dealt_to_as_many_tasks_as_their_pairs_need(spark, monkeypatch):
    """by the few bytes of classes alone, one task would make nearly all pairs; cells of a hot class are dealt, too."""
    monkeypatch.setattr(keyed, "TASK_ROWS", 500)
    pairs = spark.createDataFrame([(q, c, "near") for q in range(40) for c in (1, 2, 3, None) if (q + (c or 0)) % 3], "seq long, class_id long, proximity string")
    members = spark.createDataFrame([(1 if i % 4 else 2, i) for i in range(400)] + [(1, 5), (9, 1), (None, 2)], "class_id long, profile_id long")
    got = C.expanded(pairs, members)
    want = pairs.join(members, "class_id")
    rows = lambda df: sorted(tuple(r) for r in df.select("seq", "class_id", "proximity", "profile_id").collect())
    assert rows(got) == rows(want) and len(rows(got)) > 10_000
    assert got.rdd.getNumPartitions() > 20
    hot = keyed.dealt_join(pairs, members, ["class_id"], F.col("seq"), F.col("profile_id"), rows=10, spread=True)
    assert rows(hot) == rows(want)
    assert rows(C.expanded(pairs.filter("seq < 0"), members)) == []


def test_unsent_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """the pairs of classes that were sent nothing came from one task."""
    monkeypatch.setattr(keyed, "TASK_ROWS", 500)
    marked = spark.createDataFrame([(q, c, True if q == 7 else None) for q in range(40) for c in (1, 2)], "seq long, class_id long, _touched boolean")
    members = spark.createDataFrame([(1 + i % 2, i) for i in range(400)] + [(1, 0)], "class_id long, profile_id long")
    sent = spark.createDataFrame([(4, 7), (5, 7), (5, 7), (6, 8), (None, 7)], "profile_id long, seq long")
    got = C.unsent_members(marked, members, sent)
    want = marked.drop("_touched").join(members, "class_id").join(sent.filter("seq = 7"), ["profile_id", "seq"], "left_anti")
    rows = lambda df: sorted(tuple(r) for r in df.select("seq", "class_id", "profile_id").collect())
    assert rows(got) == rows(want) and got.rdd.getNumPartitions() > 30
    counts = {r["seq"]: r["candidates"] for r in C.unsent_counts(marked, members, sent).collect()}
    assert counts == {r["seq"]: r["count"] for r in want.groupBy("seq").count().collect()}


def test_profiles_are_scored_along_their_list_only_as_far_as_needed(spark, monkeypatch):
    """F3 F4: rounds of any size choose what scoring all pairs chooses, and do not score all of them."""
    monkeypatch.setattr(D, "FIRST_PLACES", 1)
    monkeypatch.setattr(D, "FURTHER", 2)
    given = inputs(spark, SF)
    profiles = given.profiles.filter("profile_id % 3 = 0")
    twice = profiles.unionByName(profiles.filter("profile_id % 9 = 0")).unionByName(profiles.filter("profile_id = 6").withColumn("city", F.lit("City 7")))
    met, numbers = [], D.scoring.score_numbers
    monkeypatch.setattr(D.scoring, "score_numbers", lambda pairs: met.append(pairs.count()) or numbers(pairs))
    run = D.daily_run(D.Inputs(**{**given.__dict__, "profiles": twice}), k=3)
    columns = ["profile_id", "position", "score", "score_before_limits", "priority"]
    want, got = (sorted(tuple(r) for r in df.select(*columns).collect()) for df in (ranking.select_top(run.scored, 3, seq="arrival"), run.selected))
    assert got == want and len(want) > 40
    assert len(met) > 1 and sum(met) < run.scored.count()


def test_links_of_classes_write_numbers_not_words(spark, monkeypatch):
    """every round wrote the words of all members once per prefix word; now words are written once a class at most."""
    rng = random.Random(11)
    rows = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(30)]
        rows += [(len(rows) + i, f"b{family % 2}", sorted(set(rng.sample(words, 27)) | {f"x{i % 3}"})) for i in range(12)]
    classes = spark.createDataFrame(rows, "class long, ad_key string, words array<string>")
    written, cut = [], dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    for small in (2, 5, 1000):
        monkeypatch.setattr(dedup, "SMALL_GROUP", small)
        links = {tuple(sorted(r)) for r in dedup._link_classes(classes).collect()}
        groups = {}
        for r in dedup.connected_groups(classes, dedup._link_classes(classes)).collect():
            groups[r["class"]] = r["grp"]
        near = lambda a, b, least: a[1] == b[1] and len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])) >= least
        pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b, 0.8)}
        assert pairs and all(groups[a] == groups[b] for a, b in pairs)
        assert links <= {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b, 0.6 - 1e-9)}
    assert written and not any("words" in c and "_word" in c for c in written)


def test_a_micro_batch_checks_each_event_once(spark, monkeypatch, tmp_path):
    """every step of the ingest checked the whole batch again; what is held is let go after the batch."""
    ingest_source(spark, SF).limit(200).write.parquet(f"{tmp_path}/in")
    seen, check = spark.sparkContext.accumulator(0), ingest.check_events

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    monkeypatch.setattr(ingest, "check_events", lambda events: check(events.withColumn("name", counted.asNondeterministic()("name"))))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    query = ingest.start_ingest(ingest.read_event_files(spark, f"{tmp_path}/in"), lambda: B.profiles(spark, SF), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    accepted, rejected = (spark.read.parquet(f"{tmp_path}/out/{name}") for name in ("accepted", "rejected"))
    assert seen.value == 200 == accepted.count() + rejected.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held


def test_counters_count_pairs_by_their_classes(spark):
    """candidates and their postings are counted from classes, not by making every pair twice."""
    given = inputs(spark, SF)
    run = D.daily_run(given)
    counts = {r["step"]: r["rows"] for r in D.counters(given, run).collect()}
    assert counts["candidates"] == run.candidates.count() > counts["postings"] == run.candidates.select("seq").distinct().count() > 0
    assert {tuple(r) for r in run.candidates_of.collect()} == {tuple(r) for r in run.candidates.groupBy("seq").count().collect()}
    nothing = run.candidates_of.filter("seq < 0")
    assert {r["rows"] for r in D.counters(given, replace(run, candidates_of=nothing)).collect() if r["step"] in ("candidates", "postings")} == {0}
