import pytest

from sparkseek.config import Settings
from sparkseek.plans import indexing
from sparkseek.plans.search import HybridSearch
from sparkseek.sources import changes, files, labels, notes, stores
from sparkseek.streaming.refresh import refresh_on_changes

FILES = "path string, size_bytes long, text string"
SCHEMA_ROWS = [("vendor/a/Speed.java", 10, "class Speed { int speed; }"), ("device/b/Door.java", 10, "door code"), ("tools/c.java", 10, "outside scope")]


def build(spark, provider, tenant, rows, base=False):
    frame = spark.createDataFrame(rows, FILES)
    return indexing.build_store(frame, provider.folder(base=base, tenant=tenant), "base" if base else "customer")


def test_tenants_are_apart(spark, tmp_path):
    provider = stores.StoreProvider(spark, str(tmp_path), "hashing-64")
    one, two = stores.Tenant("one"), stores.Tenant("two")
    build(spark, provider, one, [("vendor/base/Base.java", 10, "shared base code")], base=True)
    build(spark, provider, one, SCHEMA_ROWS)
    build(spark, provider, two, [("vendor/t/Secret.java", 10, "secret speed words")])
    session = stores.Session.open(one, provider)
    assert not [f for f in session.store.table("chunks").inputFiles() if "/two/" in f]
    found = HybridSearch(session.store, None).search(spark.createDataFrame([(1, "secret speed")], "query_id int, query string")).collect()
    assert {r.path for r in found} == {"vendor/a/Speed.java", "device/b/Door.java", "vendor/base/Base.java"}
    assert {r.store for r in found} == {"base", "customer"}
    assert stores.resolve_tenant(provider, None) == stores.Tenant("base")


@pytest.mark.parametrize("customer", ["a/../b", "..", "_base", "", "a/b", ".hidden", "a..b"])
def test_hostile_names_are_refused(spark, tmp_path, customer):
    with pytest.raises(ValueError):
        stores.StoreProvider(spark, str(tmp_path)).open(stores.Tenant(customer))


def test_guards(spark, tmp_path):
    provider = stores.StoreProvider(spark, str(tmp_path), "hashing-64")
    with pytest.raises(FileNotFoundError):
        provider.open(stores.Tenant("nobody"))
    build(spark, provider, stores.Tenant("one"), SCHEMA_ROWS)
    with pytest.raises(ValueError, match="embedding model"):
        stores.StoreProvider(spark, str(tmp_path), "other").open(stores.Tenant("one"))
    layer = provider.open(stores.Tenant("one")).layers[0]
    with pytest.raises(ValueError):
        stores.CompositeStore([layer, layer])
    with pytest.raises(Exception):
        stores.Tenant("x").customer = "y"


def contents(spark, folder):
    manifest = stores.read_manifest(spark, folder)
    rows = spark.read.parquet(f"{folder}/{manifest.data}/chunks").collect()
    return sorted((r.chunk_id, r.content, tuple(r.embedding)) for r in rows), manifest


def test_refresh_equals_full_build(spark, tmp_path):
    provider = stores.StoreProvider(spark, str(tmp_path))
    tenant, twin = stores.Tenant("one"), stores.Tenant("twin")
    build(spark, provider, tenant, SCHEMA_ROWS)
    after = [("vendor/a/Speed.java", 10, "class Speed { long speed; }"), ("vendor/new/Door.java", 10, "door code"), ("vendor/big.java", 500_000, "too big")]
    frame = spark.createDataFrame(after, FILES)
    indexing.refresh_store(frame, provider.customer_folder(tenant), "customer", git_sha="s2")
    build(spark, provider, twin, after)
    got, manifest = contents(spark, provider.customer_folder(tenant))
    assert got == contents(spark, provider.customer_folder(twin))[0]
    assert manifest.count == 3 and manifest.git_sha == "s2" and manifest.scope == "automotive"


def test_stream_of_changes(spark, tmp_path):
    provider = stores.StoreProvider(spark, str(tmp_path / "stores"))
    tenant = stores.Tenant("one")
    folder = provider.customer_folder(tenant)
    build(spark, provider, tenant, SCHEMA_ROWS)
    spark.createDataFrame([("device/b/Door.java", "D"), ("vendor/n.java", "A")], "path string, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    after = spark.createDataFrame([SCHEMA_ROWS[0], ("vendor/n.java", 5, "new file")], FILES)
    stream = spark.readStream.schema("path string, status string").parquet(str(tmp_path / "in"))
    writer = refresh_on_changes(stream, lambda: after, folder, "customer").option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [c[0] for c in contents(spark, folder)[0]] == ["vendor/a/Speed.java::0", "vendor/n.java::0"]


def test_flat_store(spark, tmp_path):
    rows = [("a/x.java", 0, "old speed code")] + [(f"a/{w}.java", 0, f"{w} file") for w in ("door", "seat", "horn", "lamp")]
    spark.createDataFrame(rows, "path string, idx int, content string").write.parquet(str(tmp_path / "flat/chunks"))
    store = stores.open_flat(spark, str(tmp_path / "flat"))
    search = HybridSearch(store, None, embed=None)
    hit = search.search(spark.createDataFrame([(1, "speed")], "query_id int, query string")).first()
    assert (hit.path, hit.store) == ("a/x.java", "base")


def test_scan_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for path, data in {"vendor/A.java": b"caf\xc3\xa9 \xff bad\r\nend", "vendor/out/B.java": b"x", "tools/C.KT": b"y", "vendor/big.c": b"x" * 400_001,
                       "vendor/m.bp": b"hidl_interface {}", "vendor/read.me": b"z"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    found = {r.path: r.text for r in files.scan_tree(spark, str(root), "customer", max_bytes=400_000).collect()}
    assert found == {"vendor/A.java": "café  bad\nend", "tools/C.KT": "y"}
    assert len({r.path: r.text for r in files.scan_tree(spark, str(root), "customer").collect()}["vendor/big.c"]) == 400_001
    scoped = files.scan_tree(spark, str(root), "customer", ["vendor", "vendor/out", "nowhere"], max_bytes=400_000)
    assert [r.path for r in scoped.collect()] == ["vendor/A.java"]
    assert all("/tree/vendor/" in path for path in scoped.inputFiles())  # nothing else is listed
    fallback = files.scan_tree(spark, str(root), "customer", ["nowhere"], max_bytes=400_000)
    assert fallback.count() == 2


def test_guarded_reads(spark):
    tree = spark.createDataFrame([("a/b.c", "x" * 30)], "path string, text string")
    asked = spark.createDataFrame([("a/b.c",), ("./a/../a/b.c",), ("../etc/passwd",), ("/etc/passwd",), ("/src/a/b.c",), ("a/none",)], "path string")
    got = {r.path: r.content for r in files.read_sources(asked, tree, "/src", 10).collect()}
    assert got["a/b.c"] == got["./a/../a/b.c"] == got["/src/a/b.c"] == "x" * 10 + files.TRUNCATED
    assert got["../etc/passwd"].startswith("[refused") and got["/etc/passwd"].startswith("[refused")
    assert got["a/none"].startswith("[error")


def test_changes_and_labels(spark, tmp_path):
    lines = spark.createDataFrame([("R100\told.c\tnew.c",), ("M\ta.c",), ("D\tb.c",), ("junk",)], "value string")
    assert sorted(map(tuple, changes.parse_name_status(lines).collect())) == [("a.c", "M"), ("b.c", "D"), ("new.c", "A"), ("old.c", "D")]
    assert changes.git_head(str(tmp_path)) is None and changes.git_changes(spark, str(tmp_path), "a", "b") is None
    (tmp_path / "l.jsonl").write_text('{"id": "1", "bug": "b", "gold_files": ["x/y.c"]}\n\n{"id": "2", "bug": "c", "logcat": null, "gold_files": []}\n')
    read = labels.read_labels(spark, str(tmp_path / "l.jsonl"))
    assert read.count() == 2 and [tuple(r) for r in labels.gold(read).collect()] == [("1", "x/y.c")]


def test_notes(tmp_path):
    for name in ("20-b.md", "10-a.md", "CONTRACT.md", "30-selinux_linux.md"):
        (tmp_path / name).write_text(name)
    assert notes.load_folder(tmp_path) == ["CONTRACT.md", "10-a.md", "20-b.md", "30-selinux_linux.md"]
    assert notes.pack_notes(tmp_path, ["selinux_linux", "sdv_vss"]) == "30-selinux_linux.md"


def test_settings_file(tmp_path):
    from sparkseek import load_settings

    (tmp_path / "s.yaml").write_text("ranking:\n  rrf_k: 10\n  unknown: 1\nretrieval:\n  default_scope: full\n")
    s = load_settings(tmp_path / "s.yaml")
    assert s.ranking.rrf_k == 10 and s.scope_roots() == (".",) and s.scope_roots("nonsense") == Settings().retrieval.index_roots
    assert load_settings(None) == Settings()


