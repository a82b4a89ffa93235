import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaindex.plans import assess
from areaindex.plans.export import final_projection
from areaindex.plans.variables import AREA_VARIABLES, burden_variables
from areaindex.sources import (
    apply_dict,
    land,
    read_csv_clean,
    read_estimates,
    read_polygons,
    scratch_dir,
    drop_landed,
    estimates_from,
    feature_lines,
    fetched_once,
    release,
    write_estimates,
    write_features,
    write_table,
)
from areaindex.sources import estimates as estimates_module
from areaindex.sources import landing
from areaindex.sources.estimates import ESTIMATES_SCHEMA

from test_spatial import VERTEX, square


def estimates(spark, state_share=1):
    data = [
        (f"06{c:03d}{t:06d}", f"Area {t}", code, float(t + i), 1.0, y, s)
        for y, s in [(2017, "06"), (2012, "06"), (2017, "53")]
        for c in (1, 3)
        for t in range(4)
        for i, code in enumerate(["B25003_003", "B25003_001", "B99"])
    ]
    return spark.createDataFrame(data, ESTIMATES_SCHEMA)


def test_estimates_prune_to_one_partition(spark):
    path = scratch_dir(spark, "t")
    write_estimates(estimates(spark), path)
    names = {"totrent": "B25003_003", "totten": "B25003_001"}
    tidy = read_estimates(spark, path, names, "06", 2017)
    assert tidy.count() == 16 and {r.variable for r in tidy.collect()} == set(names)
    plan = tidy._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(variable" in plan
    wide = read_estimates(spark, path, names, "06", 2017, output="wide", keep_moe=True)
    assert wide.columns == ["geoid", "name", "totrent_e", "totrent_m", "totten_e", "totten_m"] and wide.count() == 8
    assert read_estimates(spark, path, names, ["06", "53"], 2017, output="wide").columns[2:] == list(names)
    kept = read_estimates(spark, path, names, "06", 2017, cache=True)
    assert kept.count() == 16 and not set(kept.inputFiles()) & set(tidy.inputFiles())


def test_fetched_once_and_found_again(spark, rows):
    path = scratch_dir(spark, "t")
    write_estimates(estimates(spark), path)
    names = {"totrent": "B25003_003", "totten": "B25003_001"}
    plain = read_estimates(spark, path, names, "06", 2017)
    first = read_estimates(spark, path, names, "06", 2017, cache=True)
    again = read_estimates(spark, path + "/", dict(names), ["06"], 2017, cache=True)
    assert rows(again) == rows(plain) and again.schema == plain.schema
    assert set(again.inputFiles()) == set(first.inputFiles()) and not set(again.inputFiles()) & set(plain.inputFiles())
    # Other selections have copies of their own.
    others = [({"totten": "B25003_001"}, "06", 2017, {}), (names, "53", 2017, {}), (names, "06", 2012, {}), (names, "06", 2017, {"output": "wide"})]
    files = [set(read_estimates(spark, path, n, s, y, cache=True, **more).inputFiles()) for n, s, y, more in others]
    assert not any(f & set(first.inputFiles()) for f in files)
    # A change elsewhere leaves the copy; a change of what it was made from does not.
    more = estimates(spark).withColumn("geoid", F.concat("geoid", F.lit("x")))
    more.filter("state = '53'").write.mode("append").partitionBy("year", "state").parquet(path)
    assert set(read_estimates(spark, path, names, "06", 2017, cache=True).inputFiles()) == set(first.inputFiles())
    more.filter("state = '06'").write.mode("append").partitionBy("year", "state").parquet(path)
    changed = read_estimates(spark, path, names, "06", 2017, cache=True)
    assert changed.count() == 2 * first.count() and not set(changed.inputFiles()) & set(first.inputFiles())


def test_released_copies_are_fetched_anew(spark):
    calls, paths = [], [scratch_dir(spark, "t"), scratch_dir(spark, "t")]
    for path in paths:
        spark.range(5).write.parquet(path)

    def fetch(path):
        def build():
            calls.append(path)
            return spark.read.parquet(path)

        return fetched_once(spark, path, [path], {"what": "all"}, build)

    for path in [*paths, *paths]:
        assert fetch(path).count() == 5
    assert calls == paths
    release(spark, paths[0])
    assert fetch(paths[0]).count() == fetch(paths[1]).count() == 5 and calls == [*paths, paths[0]]
    release(spark)
    assert fetch(paths[1]).count() == 5 and len(calls) == 4


def test_two_sessions_that_fetch_at_once_leave_one_copy(spark):
    path = scratch_dir(spark, "t")
    spark.range(5).write.parquet(path)

    def build():
        fetched_once(spark, path, [path], {}, lambda: spark.read.parquet(path))  # the other is first
        return spark.read.parquet(path)

    copy = fetched_once(spark, path, [path], {}, build)
    assert copy.count() == 5 and len({f.rsplit("/", 1)[0] for f in copy.inputFiles()}) == 1


@pytest.mark.parametrize("cells", [10**7, 0])
def test_dictionary_table_of_any_size(spark, rows, cells):
    """Broadcast or shuffled, a table gives what its literals give; missing names and codes match nothing."""
    df = spark.createDataFrame([("a", f"B{i % 3}", float(i)) for i in range(60)] + [("n", None, 1.0)], "geoid string, variable string, _x double")
    literal = {"x": "B1", "y": "B1", "z": "B2"}
    many = spark.range(100_000).selectExpr("concat('name', id) AS name", "concat('code', id) AS code")
    own = spark.createDataFrame([*literal.items(), ("x", "B1"), (None, "B0"), ("w", None)], "name string, code string")
    got = estimates_module._apply_table(df, many.unionByName(own), "variable", broadcast_cells=cells)
    assert rows(got) == rows(apply_dict(df, literal)) and got.columns == df.columns


def test_dictionary_table_in_a_read(spark, rows):
    path = scratch_dir(spark, "t")
    write_estimates(estimates(spark), path)
    names = spark.createDataFrame([("totrent", "B25003_003")], "name string, code string")
    want = read_estimates(spark, path, {"totrent": "B25003_003"}, "06", 2017)
    for cache in (False, True, True):
        assert rows(read_estimates(spark, path, names, "06", 2017, cache=cache)) == rows(want)
    with pytest.raises(ValueError, match="listed"):
        read_estimates(spark, path, names, "06", 2017, output="wide")


def test_two_names_on_one_code(spark, rows):
    df = spark.createDataFrame([("a", "B1", 1.0), ("a", "B2", 2.0), ("a", "B3", 3.0)], "geoid string, variable string, estimate double")
    names = {"x": "B1", "y": "B1", "z": "B2"}
    assert rows(estimates_from(df, names).select("variable", "estimate")) == [("x", 1.0), ("y", 1.0), ("z", 2.0)]
    assert rows(estimates_from(df, names, "wide", id_cols=["geoid"])) == [("a", 1.0, 1.0, 2.0)]


def test_areas_without_vertices_have_a_null_geometry(spark):
    df = spark.createDataFrame([("a",), ("b",)], "geo_id string")
    poly = spark.createDataFrame(square("a", 0, 0), VERTEX)
    lines = {r.geo_id: r.feature for r in feature_lines(df, poly).collect()}
    assert '"geometry":null' in lines["b"] and '"MultiPolygon"' in lines["a"]


def test_dropped_tables_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "_root", lambda spark: (tmp_path / "own").as_uri())
    landed = land(spark.range(3).toDF("id"))
    assert landed.count() == 3
    drop_landed(spark)
    assert not (tmp_path / "own").exists()


def test_csv_tokens_and_leading_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("geoid,v,w\n06001, 3 ,NA\n06003,NA, \n06005,,x\n")
    schema = T.StructType([T.StructField("geoid", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("w", T.StringType())])
    got = [tuple(r) for r in read_csv_clean(spark, str(tmp_path / "a.csv"), schema).orderBy("geoid").collect()]
    assert got == [("06001", 3.0, None), ("06003", None, None), ("06005", None, "x")]


def test_compressed_round_trip(spark, rows):
    df = spark.createDataFrame([("06001", 1.5, None), ("06003", None, "a, \"b\"")], "geoid string, v double, t string")
    path = scratch_dir(spark, "csv")
    write_table(df, path)
    files = spark.read.text(path).inputFiles()
    assert all(f.endswith(".bz2") for f in files)
    assert rows(read_csv_clean(spark, path, df.schema)) == rows(df)


def test_features_round_trip(spark, rows):
    poly = spark.createDataFrame(square("a", 0, 0, 4) + square("a", 1, 1, 1, number=1) + square("a", 9, 9, part=1) + square("b", 5, 5), VERTEX)
    names = spark.createDataFrame([("a", "Long column content"), ("b", None)], "geo_id string, a_name_longer_than_ten string")
    path = scratch_dir(spark, "geo")
    write_features(names, poly, path)
    attributes, vertices = read_polygons(spark, path, names.schema)
    assert rows(attributes) == rows(names)
    assert rows(vertices.select(*poly.columns)) == rows(poly)


def test_reads_plain_polygons(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"type":"Feature","properties":{"geo_id":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}\n'
    )
    schema = T.StructType([T.StructField("geo_id", T.StringType())])
    _, vertices = read_polygons(spark, str(tmp_path / "p.json"), schema)
    assert vertices.count() == 4 and vertices.agg(F.sum("x")).first()[0] == 2.0


def test_landed_table_is_independent_of_its_source(spark):
    df = land(spark.range(10).withColumn("v", F.lit(1)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10 and "Range" not in plan


@pytest.fixture(scope="module")
def landed_inputs(spark):
    """A 4 x 4 grid of areas in two counties with all named estimates."""
    ids = [(f"06{1 + 2 * (i // 8):03d}{i:06d}", i) for i in range(16)]

    def value(name, i):
        if name.startswith("HHInc_"):
            return 10.0 + (i * 7) % 5
        fixed = {"race_tot": 4000.0, "race_White": 900.0 + 200 * (i % 8), "totten": 1000.0, "totrent": 300.0 + 50 * (i % 8),
                 "st_totenroll": 4000.0, "st_colenroll": 100.0, "st_proenroll": None, "medrent": 900.0 + 40 * i,
                 "mhhinc": 90000.0 + 500 * i}
        return fixed.get(name, 100.0 + i)

    schema = "geoid string, name string, variable string, estimate double, moe double"
    new = spark.createDataFrame(
        [(g, f"Area {i}", n, None if (n == "totrent" and i == 15) else value(n, i), 5.0) for g, i in ids for n in AREA_VARIABLES], schema
    )
    old = spark.createDataFrame([(g, f"Area {i}", "medrent12", 800.0 + 10 * i, 5.0) for g, i in ids], schema)
    burden = spark.createDataFrame(
        [(g, n, 1000.0 if n == "ir_tot_tot" else 10.0 + (i * 3 + k) % 7) for g, i in ids for k, n in enumerate(burden_variables())],
        "geoid string, variable string, estimate double",
    )
    poly = spark.createDataFrame([s for g, i in ids for s in square(g, i % 4, i // 4)], VERTEX)
    city = spark.createDataFrame(square("city", 0, 0, 2), VERTEX)
    return new, old, burden, poly, city


def test_assessment_from_landed_inputs(spark, landed_inputs):
    new, old, burden, poly, city = landed_inputs
    types = new.select("geoid").distinct().withColumn("neigh_type", F.lit("White-Latinx"))
    selected = spark.createDataFrame([("city",)], "geo_id string")
    out = assess.assess_estimates(new, old, burden, poly, [(selected, city)], types, band_factor=1.5)
    got = {r.geoid: r for r in out.collect()}
    assert len(got) == 16
    assert sum(r.big_city for r in got.values()) == 4
    assert [r.tier1 for g, r in got.items() if g.endswith("015")] == ["Poor Data Quality"]
    corner = got["06001000000"]
    assert corner.tr_medrent12 == pytest.approx(856.0) and corner.tr_pchrent == pytest.approx(900 / 856 - 1)
    assert corner.tr_medrent_lag == pytest.approx(((940 + 1060) * 1 + 1100 * 0.5) / 2.5)
    assert corner.tr_pstudents == pytest.approx(0.025) and corner.tr_pPOC == pytest.approx(1 - 900 / 4000)
    assert all(r.tier1 is None or r.tr_dq == 0 or r.v_VLI == 1 or r.v_POC == 1 for r in got.values())
    assert final_projection(out).columns[:4] == ["geoid", "county", "neigh_type", "big_city"]


def test_renamed_area_loses_its_old_rent_unless_joined_by_id(spark, landed_inputs):
    new, old, *_ = landed_inputs
    renamed = old.withColumn("name", F.when(F.col("geoid") == "06001000000", "Other").otherwise(F.col("name")))
    for by_geoid, missing in ((False, 1), (True, 0)):
        wide = assess.wide_vintages(new, renamed, by_geoid=by_geoid)
        assert wide.filter("medrent12 is null").count() == missing
