"""Tables whose rows change, against a dictionary that does the same."""

import random

import pytest

from filescope.sources import store

FILES, CHILDREN = "id string, level string, n long", "id string, file_id string, said string"


def filled(spark, path, buckets=5):
    return store.Store(spark, f"file://{path}", buckets=buckets)


def test_random_changes_against_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    s = filled(spark, tmp_path)
    files, notes, past = {}, {}, {}
    for turn in range(7):
        kind = rng.choice(["write", "write", "delete", "compact"]) if turn else "write"
        if kind == "write":
            new = {f"f{rng.randrange(30)}": (rng.choice("AB"), turn) for _ in range(12)}
            said = {f"m{rng.randrange(60)}": (f"f{rng.randrange(30)}", f"t{turn}") for _ in range(15)}
            said = {m: (notes[m][0] if m in notes else f, t) for m, (f, t) in said.items()}  # a row stays with its file
            s.upsert({"files": spark.createDataFrame([(k, *v) for k, v in new.items()], FILES), "messages": spark.createDataFrame([(k, *v) for k, v in said.items()], CHILDREN)})
            files |= new
            notes |= said
        elif kind == "delete":
            dead = {f"f{rng.randrange(30)}" for _ in range(6)}
            s.delete(spark.createDataFrame([(d,) for d in dead], "id string"))
            files = {k: v for k, v in files.items() if k not in dead}
            notes = {k: v for k, v in notes.items() if v[0] not in dead}
        else:
            s.compact()
        past[s.versions()[-1]] = (dict(files), dict(notes))
        assert {r["id"]: (r["level"], r["n"]) for r in s.read("files").collect()} == files
        assert {r["id"]: (r["file_id"], r["said"]) for r in s.read("messages").collect()} == notes
    for version, (f, m) in past.items():
        assert {r["id"] for r in s.read("files", version).collect()} == set(f) and s.read("messages", version).count() == len(m)
    s.compact()
    assert s.vacuum() > 0 and {r["id"] for r in s.read("files").collect()} == set(files)
    one = next(iter(files))
    assert [r["id"] for r in s.lookup("files", one).collect()] == [one]


def test_deleted_files_take_their_children_and_may_come_back(spark, tmp_path):
    s = filled(spark, tmp_path)
    child = lambda *rows: spark.createDataFrame(list(rows), CHILDREN)
    s.upsert({"files": spark.createDataFrame([("a", "x", 1), ("b", "x", 1), (None, "x", 1), ("b", "x", 1)], FILES), "findings": child(("1", "a", "p"), ("2", "b", "p")), "analyses": child(("3", "a", "p")), "messages": child(("4", "a", "p"))})
    s.delete(spark.createDataFrame([("a",), ("nobody",), (None,)], "id string"))
    left = {t: sorted(r["id"] for r in s.read(t).collect()) for t in store.TABLES}
    assert left == {"files": ["b"], "findings": ["2"], "analyses": [], "messages": []}
    s.upsert({"files": spark.createDataFrame([("a", "y", 2)], FILES)})
    assert sorted(r["level"] for r in s.read("files").collect()) == ["x", "y"] and s.read("analyses").count() == 0
    s.compact()
    assert sorted(r["level"] for r in s.read("files").collect()) == ["x", "y"] and s.read("analyses").count() == 0


def test_writers_at_once_and_other_columns(spark, tmp_path):
    s, other = filled(spark, tmp_path), filled(spark, tmp_path)
    row = spark.createDataFrame([("a", "x", 1)], FILES)
    state = other._state()
    s.upsert({"files": row})
    with pytest.raises(store.Conflict):
        other._commit(state)
    with pytest.raises(ValueError, match="other columns"):
        s.upsert({"files": row.drop("n")})
    with pytest.raises(LookupError):
        s.read("messages")
    assert filled(spark, tmp_path, buckets=99).buckets == 5


def test_what_compaction_and_lookup_read(spark, tmp_path):
    s = filled(spark, tmp_path, buckets=16)
    s.upsert({"files": spark.createDataFrame([(f"f{i}", "x", i) for i in range(200)], FILES)})
    s.compact()
    before = s._state()["base"]["files"]
    s.upsert({"files": spark.createDataFrame([("f7", "y", 7)], FILES)})
    s.compact()
    after = s._state()["base"]["files"]
    assert len(before) == len(after) == 16 and sum(before[b] != after[b] for b in before) == 1
    found = s.lookup("files", "f7")
    read = {f.rsplit("/", 2)[1] for f in found.inputFiles() if "_bucket=" in f}
    assert [r["level"] for r in found.collect()] == ["y"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and len(read) >= 1
