from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek import fixed_values as fv
from sparkseek.functions import paths as P
from sparkseek.functions import text as X

PATHS = {
    "hardware/interfaces/automotive/vehicle/2.0/Vehicle.cpp": "hidl_legacy",
    "hidl/foo.cpp": "hidl_legacy",
    "a/types.hal": "hidl_legacy",
    "system/sepolicy/private/app.te": "selinux",
    "vendor/x/vss/speed.yaml": "vss",
    "pkg/ICar.aidl": "aidl",
    "frameworks/native/libs/libbinder/x.cc": "binder",
    "hardware/interfaces/automotive/x.java": "vhal",
    "system/core/powerpolicy/x.xml": "startup_power",
    "packages/services/Car/service/A.java": "carservice",
    "packages/apps/Settings/A.kt": "hmi",
    "frameworks/base/core/A.java": "frameworks",
    "system/x.cpp": "native",
    "vendor/oem/a.java": "customer",
    "tools/a.java": "other",
    "Packages\\Services\\Car\\A.java": "carservice",
}


def column(spark, values, expression, name="path"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_layers(spark):
    assert column(spark, list(PATHS), P.guess_layer("path")) == list(PATHS.values())


@pytest.mark.parametrize("segment", fv.BASE_EXCLUDED_SEGMENTS)
def test_every_excluded_segment_is_listed_once(segment):
    assert fv.BASE_EXCLUDED_SEGMENTS.count(segment) == 1


def test_index_filter(spark):
    paths = [f"src/{s}/A.java" for s in fv.BASE_EXCLUDED_SEGMENTS] + ["src/FooTest.java", "src/x_gen/a.java", "a/b.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert df.where(P.should_index("path", F.lit(10))).count() == 0
    kept = {r.path for r in df.where(P.should_index("path", F.lit(10), "customer")).collect()}
    dropped = {f"src/{s}/A.java" for s in fv.CUSTOMER_EXCLUDED_SEGMENTS} | {"a/b.py"}
    assert kept == set(paths) - dropped
    sizes = spark.createDataFrame([("a/b.java", 400_000), ("a/b.java", 400_001)], "path string, n long")
    assert [r[0] for r in sizes.orderBy("n").select(P.should_index("path", "n", max_bytes=400_000)).collect()] == [True, False]
    assert sizes.where(P.should_index("path", "n")).count() == 2
    module = spark.createDataFrame([("a/Android.bp", "hidl_interface {}")], "path string, c string")
    assert module.select(P.should_index("path", F.lit(1), "base", "c")).first()[0] is False


def test_scope(spark):
    paths = ["vendor", "vendor/a.c", "vendors/a.c", "x/vendor/a.c"]
    assert column(spark, paths, P.under_roots("path", ["vendor"])) == [True, True, False, False]
    assert column(spark, paths, P.under_roots("path", ["."])) == [True] * 4


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab./-_", min_size=1, max_size=12), min_size=150, max_size=150))
def test_suffix_and_stem_follow_path_rules(spark, names):
    names = [n for n in names if n.strip("/.") and not n.endswith(("/", "."))]
    expected = [(PurePosixPath(n).suffix.lower(), PurePosixPath(n).stem) for n in names]
    got = column(spark, names, F.struct(P.suffix("path"), P.stem("path")))
    assert [tuple(g) for g in got] == expected


def test_norm_path(spark):
    assert column(spark, [" ./A\\B.java ", "../x", "/y/Z"], P.norm_path("path")) == ["a/b.java", "x", "y/z"]


def test_tokens_and_keywords(spark):
    q = "after resume PERF_VEHICLE_SPEED from IVehicle at com.a.Foo.bar(Foo.java:1) CarPropertyService the end"
    assert column(spark, ["A.b 1x _y z"], X.code_tokens("q"), "q")[0] == ["a.b", "_y"]
    words = column(spark, [q], X.code_keywords("q"), "q")[0]
    assert words[:4] == ["PERF_VEHICLE_SPEED", "IVehicle", "CarPropertyService", "com.a.Foo.bar"]
    assert "com.a.Foo" in words and len(words) == len(set(words))
    plain = column(spark, ["the one two three four five six seven eight nine ten eleven twelve"], X.code_keywords("q"), "q")[0]
    assert plain == "one two three four five six seven eight nine ten".split()
    assert column(spark, ["éIERLE", "IERLE"], F.size(X.find_all("q", fv.INTERFACE_ID_PATTERN)), "q") == [0, 1]


def test_legacy_queries(spark):
    assert column(spark, ["version 12.0.1", "speed"], X.mentions_legacy("q"), "q") == [True, False]


def test_strip_covers_all_white_space(spark):
    assert column(spark, [" \x1c a  \n"], X.strip("q"), "q") == ["a"]


def test_sections_and_diffs(spark):
    answer = "## Cause\nx\n## Unit Test here\nbody\nmore\n## Patch\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y\n```\nz"
    assert column(spark, [answer], X.section("q", "unit test"), "q") == ["body\nmore"]
    assert column(spark, [answer], X.first_diff("q"), "q") == ["--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y"]
    assert column(spark, [answer], X.added_lines("q"), "q") == ["y"]
    assert column(spark, [answer], X.diff_targets("q"), "q") == [["f"]]


def test_mined_paths(spark):
    assert column(spark, ["see src/a.java, and\nlib/b.c src/a.java /abs/c.h"], X.mined_paths("q"), "q") == [["src/a.java", "lib/b.c"]]
