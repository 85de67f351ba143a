"""Round trips of sources and sinks."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from orrery.sources import readers, writers


def test_designs_by_role(spark, tmp_path):
    df = spark.createDataFrame([(1, "seed"), (2, "pool")], "id int, role string")
    writers.write_designs(df, f"{tmp_path}/d")
    assert [r["id"] for r in readers.designs(spark, f"{tmp_path}/d", "pool").collect()] == [2]
    with pytest.raises(AnalysisException):
        writers.write_designs(df, f"{tmp_path}/d")
    writers.write_designs(df.where("id = 1"), f"{tmp_path}/d", force=True)
    assert readers.designs(spark, f"{tmp_path}/d").count() == 1


def test_optional_design(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/o")
    why = [readers.optional_design(spark, p, c)[1] for p, c in ((None, "id"), ("", "id"), (f"{tmp_path}/none", "id"), (f"{tmp_path}/o", "x"), (f"{tmp_path}/o", "id"))]
    assert why == ["disabled", "missing_path", "missing_file", "missing_key", "loaded"]


def test_arrays_and_tables(spark, tmp_path):
    x = np.arange(6.0).reshape(3, 2)
    np.savez(tmp_path / "a.npz", theta_raw=x, other=np.ones(2))
    np.save(tmp_path / "b.npy", x)
    np.savetxt(tmp_path / "c.txt", x, header="k p")
    (tmp_path / "d.csv").write_text("a,b\n0,1\n2,3\n4,5\n")
    for name in ("a.npz", "b.npy", "c.txt", "d.csv"):
        got = readers.points(spark, f"{tmp_path}/{name}", ["theta_raw"] if name == "a.npz" else None)
        assert sorted(r["values"] for r in got.collect()) == x.tolist()


def test_simulation_tables(spark, tmp_path):
    for i in (3, 5):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "Pk_z0.txt").write_text("# k P\n0.1 2\n0.2 4\n")
    got = readers.simulation_tables(spark, str(tmp_path), 10.0).orderBy("simulation", "k").collect()
    assert [tuple(r) for r in got] == [("3", 0.1, 20), ("3", 0.2, 40), ("5", 0.1, 20), ("5", 0.2, 40)]


def test_checks_end_the_query(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"id": "a", "weight": 1, "timeout": 2}, {"id": "a", "weight": 1, "timeout": 2}]')
    with pytest.raises(Exception, match="unique"):
        readers.cases(spark, f"{tmp_path}/cases.json").collect()
    axis = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (9.0,)], "k double")
    assert readers.k_axis(axis, "k", 0.0, 1.0, 2).count() == 2
    with pytest.raises(Exception, match="axis must have"):
        readers.k_axis(axis, "k", 0.0, 1.0, 3).collect()
    assert readers.covers(axis, axis.where("k < 1"), "k").first()["covers"]


def test_registry_last_wins_and_union(spark, tmp_path):
    (tmp_path / "r.csv").write_text("order,condition,v\n1,a,5\n2,b,6\n3,a,7\n")
    assert sorted((r["condition"], r["v"]) for r in readers.registry(spark, f"{tmp_path}/r.csv", "condition", "order").collect()) == [("a", 7), ("b", 6)]
    writers.write_union([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2,)], "a int")], f"{tmp_path}/u")
    assert spark.read.csv(f"{tmp_path}/u", header=True).columns == ["a", "b"]


def test_states_cache_and_log(spark, tmp_path):
    for v in (1, 2):
        writers.write_state(spark.createDataFrame([(v,)], "s int"), f"{tmp_path}/s", v)
    assert [r["s"] for r in writers.latest_state(spark, f"{tmp_path}/s").collect()] == [2]
    make = lambda s: s.range(4)
    assert [writers.cached(spark, f"{tmp_path}/c", {"a": 1}, make)[1] for _ in range(2)] == ["missing", "hit"]
    writers.append_progress(spark.createDataFrame([("fit",)], "event string"), f"{tmp_path}/log")
    writers.append_progress(spark.createDataFrame([("pick",)], "event string"), f"{tmp_path}/log")
    assert {r["event"] for r in spark.read.json(f"{tmp_path}/log").collect()} == {"fit", "pick"}
    assert writers.latex_rows(spark.createDataFrame([("a_b", 1.5)], "n string, v double"), ["n", "v"]).first()["value"] == "a\\_b & 1.5 \\\\"


def test_catalog_and_box(spark):
    catalog = readers.Catalog()
    catalog.register("Linear", lambda s: s.range(2))
    assert catalog.resolve(spark, "linear").count() == 2
    with pytest.raises(KeyError):
        catalog.resolve(spark, "none")
    steps = readers.Extensions()
    steps.register("double", lambda df: df.withColumn("id", F.col("id") * 2))
    assert [r["id"] for r in steps.apply(spark.range(2)).collect()] == [0, 2]
    unit = spark.createDataFrame([([0.5, 1.0],)], "u array<double>")
    assert readers.in_box(unit, "u", [0, 10], [2, 20], True).first()["u"] == [1, 20]


def test_reports_and_replay(spark, tmp_path):
    field = spark.createDataFrame([(1, 0.5, 0.1, 0.02, 25), (2, 1.5, 0.1, 0.03, 12), (3, None, None, None, 0)], "id long, mean double, std double, se double, n long")
    manifest = {r["name"]: r for r in writers.write_bias_field(field, f"{tmp_path}/bias").collect()}
    assert {n: r["rows"] for n, r in manifest.items()} == {"field": 3, "density": 3, "support": 1}
    assert [r["density"] for r in spark.read.parquet(f"{tmp_path}/bias/density").orderBy("id").collect()] == [0.25, 0.75, 0.0]
    assert spark.read.parquet(f"{tmp_path}/bias/support").first().asDict() == {"points": 3, "usable": 2, "high_confidence": 1, "finite": 2}
    again = {r["name"]: r for r in writers.write_bias_field(field.repartition(3), f"{tmp_path}/bias2").collect()}
    assert again["field"]["digest"] == manifest["field"]["digest"] and spark.read.json(f"{tmp_path}/bias/manifest").count() == 3

    facts = spark.createDataFrame([(0.1, 2.0, 2.2), (0.1, 4.0, 4.0), (0.2, 1.0, 0.5)], "k double, truth double, pred double")
    writers.write_evaluation(facts, f"{tmp_path}/eval", "k", "truth", "pred")
    curve = {r["k"]: r for r in spark.read.parquet(f"{tmp_path}/eval/curve").collect()}
    assert abs(curve[0.1]["mean"] - 0.05) < 1e-9 and curve[0.2]["mean"] == -0.5

    (tmp_path / "sel.json").write_text('{"iteration": 1, "position": 1, "theta_unit": [0.5, 0.25]}\n{"iteration": 1, "position": 0, "theta_raw": [2.0, 4.0]}\n{"iteration": 2, "position": 0, "theta_raw": [1.0, 1.0]}\n')
    got = readers.replay(spark, f"{tmp_path}/sel.json", 1, [0.0, 2.0], [4.0, 10.0]).collect()
    assert [(list(r["theta_raw"]), list(r["theta_unit"])) for r in got] == [([2.0, 4.0], [0.5, 0.25]), ([2.0, 4.0], [0.5, 0.25])]


def test_rising_axes(spark, tmp_path):
    for name, ks in (("good", (1, 2, 3)), ("bad", (1, 3, 2))):
        (tmp_path / name / "7").mkdir(parents=True)
        (tmp_path / name / "7" / "p.txt").write_text("# k p\n" + "".join(f"{k} {k * 2}\n" for k in ks))
    assert [(r["simulation"], r["k"], r["power"]) for r in readers.simulation_tables(spark, f"{tmp_path}/good").orderBy("k").collect()] == [("7", 1.0, 2.0), ("7", 2.0, 4.0), ("7", 3.0, 6.0)]
    with pytest.raises(Exception, match="rise"):
        readers.simulation_tables(spark, f"{tmp_path}/bad").collect()


def test_stale_parts_alone_are_made_again(spark, tmp_path):
    from orrery.sources.writers import refreshed

    made = []

    def table(prints, settings=None, keep=None):
        parts = spark.createDataFrame(list(prints.items()), "part string, fingerprint string")

        def build(wanted):
            names = sorted(r["part"] for r in wanted.collect())
            made.append(names)
            return spark.createDataFrame([(n, f"{n}{prints[n]}{i}") for n in names for i in range(2)], "part string, x string")

        out, state, changed = refreshed(spark, f"{tmp_path}/t", settings or {"k": 1}, parts, build)
        return sorted(r["x"] for r in out.collect()), state, changed

    assert table({"a": "1", "b": "1"}) == (["a10", "a11", "b10", "b11"], "missing", [])
    assert table({"a": "1", "b": "1"}) == (["a10", "a11", "b10", "b11"], "hit", [])
    assert table({"a": "1", "b": "2", "c": "1"}) == (["a10", "a11", "b20", "b21", "c10", "c11"], "stale", [])
    assert table({"b": "2", "c": "1"}) == (["b20", "b21", "c10", "c11"], "stale", [])
    assert table({"b": "2", "c": "1"}, {"k": 2, "m": None}) == (["b20", "b21", "c10", "c11"], "stale", ["k", "m"])
    assert table({"b": "2", "c": "1"}, {"k": 2, "m": None})[1] == "hit"
    assert made == [["a", "b"], ["b", "c"], [], ["b", "c"]]
