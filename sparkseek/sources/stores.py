"""Tenant stores: one folder per tenant and version, opened through one guarded factory.

    <root>/_base/<version>/                      shared layer
    <root>/<customer>/<project>/<version>/       one customer's layer

Each holds `manifest.json`, which names the data folder currently in force, and that folder with the tables `chunks`,
`postings`, `vocabulary`, `stats` and `files`. A rebuild writes a new data folder and then replaces the manifest, so readers always
see one complete version. A session only ever reads the folders of its own tenant: there is no filter to forget.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, postings
from ..workspace import written
from .shared_files import exists, open_fs

#: Tables of a store's data folder.
TABLES = ("chunks", "postings", "vocabulary", "stats", "files")
_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


@dataclass(frozen=True)
class Tenant:
    customer: str
    project: str = "default"
    version: str = "aosp15"

    @property
    def slug(self) -> str:
        return f"{self.customer}/{self.project}/{self.version}"


@dataclass(frozen=True)
class Manifest:
    embed_model: str
    count: int = 0
    git_sha: str | None = None
    index_roots: list[str] | None = None
    scope: str | None = None
    data: str | None = None


# -- small text files through Hadoop, so that any shared file system works ---------------------------------------


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = open_fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then put in place."""
    target, fs = open_fs(spark, path)
    side = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(side, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    # One step, so that readers see the old text or the new one at any time.
    jvm, kind = spark._jvm, "Options$Rename"
    rename = getattr(jvm.org.apache.hadoop.fs, kind)
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(side, target, how)


def read_manifest(spark: SparkSession, folder: str) -> Manifest | None:
    text = read_text(spark, f"{folder}/manifest.json")
    if text is None:
        return None
    values = json.loads(text)
    return Manifest(**{k: values.get(k) for k in Manifest.__dataclass_fields__ if k in values})


def write_manifest(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    write_text(spark, f"{folder}/manifest.json", json.dumps(asdict(manifest), indent=2))


# -- opened stores ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layer:
    """One opened store folder; `name` is 'base' or 'customer'."""

    name: str
    tables: dict
    manifest: Manifest | None

    def table(self, which: str) -> DataFrame:
        return self.tables[which].withColumn("store", F.lit(self.name))


class CompositeStore:
    """A base layer and at most one customer layer behind one set of tables."""

    def __init__(self, layers: list[Layer], name: str = "composite"):
        if not layers:
            raise ValueError("a composite store needs at least one layer")
        if sum(layer.name == "customer" for layer in layers) > 1:
            raise ValueError("a composite store holds at most one customer layer")
        self.layers, self.name = list(layers), name

    def table(self, which: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [layer.table(which) for layer in self.layers])

    def index_roots(self) -> list[str] | None:
        """Roots of all layers, in layer order."""
        known = [r for layer in self.layers if layer.manifest and layer.manifest.index_roots for r in layer.manifest.index_roots]
        return list(dict.fromkeys(known)) or None


def _open_folder(spark: SparkSession, folder: str, name: str, embed_model: str | None) -> Layer:
    manifest = read_manifest(spark, folder)
    if manifest and manifest.embed_model and embed_model and manifest.embed_model != embed_model:
        raise ValueError(
            f"store {name!r} was built with embedding model {manifest.embed_model!r}, not {embed_model!r}: "
            "re-index it or change the setting"
        )
    data = f"{folder}/{manifest.data}" if manifest and manifest.data else folder
    tables = {t: spark.read.parquet(f"{data}/{t}") for t in TABLES if exists(spark, f"{data}/{t}")}
    if "chunks" in tables and "postings" not in tables:  # written before there were postings
        tables |= _derived(tables["chunks"])
    elif "chunks" in tables:
        tables["documents"] = tables["chunks"]
    return Layer(name, tables, manifest)


def open_flat(spark: SparkSession, folder: str) -> CompositeStore:
    """The older single-folder layout: only a `chunks` table, no manifest. Counts and statistics are derived."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    if "terms" not in chunks.columns:
        tokens = chunks.withColumn("_tokens", F.col("tokens") if "tokens" in chunks.columns else X.code_tokens("content"))
        chunks = tokens.withColumn("dl", F.size("_tokens")).withColumn("terms", bm25.term_counts(F.col("_tokens"))).drop("_tokens")
    chunks = chunks.withColumn("content_len", F.length("content"))
    return CompositeStore([Layer("base", {"chunks": chunks} | _derived(chunks), None)], name="flat")


def _derived(chunks: DataFrame) -> dict:
    """The search tables of chunks that a store holds none for, written for the application."""
    keys = ["path", "idx", "content_len"]
    documents = written(postings.placed(chunks.select(*keys, "dl", "terms"), keys), "flat-documents").withColumn("store", F.lit("base"))
    rows = written(postings.postings(documents), "flat-postings")
    vocabulary = postings.vocabulary(rows)
    stats = bm25.collection_stats(documents, vocabulary)
    frames = {"documents": documents.drop("terms"), "postings": rows, "vocabulary": vocabulary, "stats": stats}
    return {name: frame.drop("store") for name, frame in frames.items()}


class StoreProvider:
    """The only place where a tenant becomes a folder."""

    def __init__(self, spark: SparkSession, root: str, embed_model: str | None = None):
        self.spark, self.root, self.embed_model = spark, root.rstrip("/"), embed_model

    @staticmethod
    def _checked(part: str, what: str) -> str:
        if not _SAFE.fullmatch(part or "") or ".." in part:
            raise ValueError(f"{what} {part!r} is not a plain name")
        return part

    def base_folder(self, version: str) -> str:
        return f"{self.root}/_base/{self._checked(version, 'version')}"

    def customer_folder(self, tenant: Tenant) -> str:
        parts = [self._checked(getattr(tenant, f), f) for f in ("customer", "project", "version")]
        return "/".join([self.root, *parts])

    def folder(self, *, base: bool, tenant: Tenant) -> str:
        """Where an index build writes to."""
        return self.base_folder(tenant.version) if base else self.customer_folder(tenant)

    def open(self, tenant: Tenant) -> CompositeStore:
        layers = []
        for name, folder in (("base", self.base_folder(tenant.version)), ("customer", self.customer_folder(tenant))):
            if exists(self.spark, folder):
                layers.append(_open_folder(self.spark, folder, name, self.embed_model))
        if not layers:
            raise FileNotFoundError(f"no store for tenant {tenant.slug!r} below {self.root}: build one first")
        return CompositeStore(layers, tenant.slug)


def resolve_tenant(provider: StoreProvider, customer: str | None, project: str = "default", version: str = "aosp15",
                   default_customer: str | None = "base") -> Tenant | None:
    """The named tenant; without a name the default one if a shared layer exists; else none (flat store)."""
    if customer:
        return Tenant(customer, project, version)
    if default_customer and exists(provider.spark, provider.base_folder(version)):
        return Tenant(default_customer, project, version)
    return None


@dataclass(frozen=True)
class Session:
    """A tenant pinned to its opened store."""

    tenant: Tenant
    store: CompositeStore

    @classmethod
    def open(cls, tenant: Tenant, provider: StoreProvider) -> "Session":
        return cls(tenant, provider.open(tenant))
