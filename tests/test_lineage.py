from conftest import rows

from cdclake.operators import lineage as G
from cdclake.plans.jobs import lineage_of


def edges_of(spark, *runs):
    events = G.lineage_events(spark, *runs[0])
    for run in runs[1:]:
        events = events.unionByName(G.lineage_events(spark, *run))
    return G.lineage_edges(events)


def test_a_run_is_a_start_and_a_complete_event(spark):
    got = G.lineage_events(spark, "j", ["a"], ["b"]).collect()
    assert [r["eventType"] for r in got] == ["START", "COMPLETE"]
    assert len({r["run"]["runId"] for r in got}) == 1
    assert got[0]["inputs"][0].asDict() == {"namespace": "lake", "name": "a"}


def test_edges_are_deduplicated(spark):
    edges = edges_of(spark, ("j", ["a", "b"], ["c"]), ("j", ["b", "a", "a"], ["c"]))
    assert rows(edges.drop("version")) == [
        ("cdclake.j", "input", "lake.a"), ("cdclake.j", "input", "lake.b"),
        ("cdclake.j", "output", "lake.c")]


def test_an_unfinished_run_has_no_edges(spark):
    started = G.lineage_events(spark, "j", ["a"], ["b"]).where("eventType = 'START'")
    assert G.lineage_edges(started).isEmpty()


def test_diamonds_and_cycles_end(spark):
    edges = edges_of(spark, ("1", ["a"], ["b", "c"]), ("2", ["b"], ["d"]), ("3", ["c"], ["d"]),
                     ("4", ["d"], ["a"]), ("5", ["z"], ["a"]))
    assert rows(G.upstream(edges, "lake.d")) == [
        ("lake.a", 2), ("lake.b", 1), ("lake.c", 1), ("lake.z", 3)]
    assert rows(G.downstream(edges, "lake.z")) == [
        ("lake.a", 1), ("lake.b", 2), ("lake.c", 2), ("lake.d", 3)]


def test_runs_of_one_job_on_other_tables_do_not_mix(spark):
    edges = edges_of(spark, ("copy", ["a"], ["b"]), ("copy", ["x"], ["y"]))
    assert rows(G.upstream(edges, "lake.b")) == [("lake.a", 1)]


def test_marts_name_their_true_inputs(spark, lake):
    edges = edges_of(spark, *lineage_of(lake))
    up = {r["dataset"].split(".")[-1] for r in
          G.upstream(edges, f"lake.{lake.gold}.daily_revenue").collect()}
    assert up == {"orders", "order_items", "cdc_events"}
    down = {r["dataset"].split(".")[-1] for r in
            G.downstream(edges, f"lake.{lake.silver}.payments").collect()}
    assert down == set()


def test_a_store_is_walked_from_both_ends_by_the_buckets_of_its_frontier(
        spark, tmp_path, monkeypatch):
    """A chain in many buckets: each step opens one of them."""
    edges = edges_of(spark, *[(f"j{i}", [f"d{i}"], [f"d{i + 1}"]) for i in range(6)])
    store = G.Adjacency(spark, str(tmp_path / "store"), 64).write(edges)
    opened, step = [], store._step

    def counted(direction, name, level, only):
        opened.append(len(only))
        return step(direction, name, level, only)

    monkeypatch.setattr(store, "_step", counted)
    assert rows(store.walk("lake.d2", "downstream")) == [
        (f"lake.d{i}", i - 2) for i in range(3, 7)]
    assert rows(store.walk("lake.d2", "upstream")) == [("lake.d0", 2), ("lake.d1", 1)]
    assert rows(store.walk("lake.nothing", "upstream")) == []
    assert set(opened) == {1}


def test_a_crowded_dataset_and_a_self_loop(spark, tmp_path):
    edges = edges_of(spark, *[(f"j{i}", ["hub"], [f"x{i}"]) for i in range(40)],
                     ("loop", ["hub"], ["hub", "x0"]))
    store = G.Adjacency(spark, str(tmp_path / "store"), 4).write(edges, ["downstream"])
    assert rows(store.walk("lake.hub", "downstream")) == sorted(
        ((f"lake.x{i}", 1) for i in range(40)), key=repr)
    assert store.walk("lake.x1", "downstream").isEmpty()


def test_paths_of_a_single_dataset_are_stored_without_versions(spark, tmp_path):
    """Each of the runs has several datasets on neither, one or both sides; some run twice."""
    runs = [(f"j{i}", [f"d{i * k % 11}" for k in range(1, 2 + i % 3)],
             [f"d{(i + k * k) % 13}" for k in range(1, 2 + i // 3 % 3)]) for i in range(18)]
    runs += [("none", [], ["d0"]), ("end", ["d0"], []), ("loop", ["d1"], ["d1"])]
    events = G.lineage_events(spark, *runs[0])
    for run in [*runs[1:], *runs[:4]]:
        events = events.unionByName(G.lineage_events(spark, *run))
    plain, far = G.lineage_edges(events), G.lineage_edges(events, far=True)
    for start in ("lake.d0", "lake.d5", "lake.d12"):
        assert rows(G.upstream(far, start)) == rows(G.upstream(plain, start))
        assert rows(G.downstream(far, start)) == rows(G.downstream(plain, start))
    single = far.where("direct")
    store = G.Adjacency(spark, str(tmp_path / "store"), 4).write(single, ["upstream"])
    assert [n for n in store.folder.names("upstream") if "=" in n] == ["step=direct"]
    wanted = {(f"lake.{o}", f"lake.{i}") for _, ins, outs in runs if 1 in (len({*ins}), len({*outs}))
              for i in ins for o in outs}
    stored = spark.read.parquet(f"{store.root}/upstream").select("at", "to")
    assert rows(stored) == sorted(wanted, key=repr)


def test_a_failed_write_does_not_raise(spark):
    assert G.emit_lineage(spark, "no_such_namespace.events", [("j", ["a"], ["b"])]) is False
