"""Service catalogs and monorepos: discovery within bounds, entity descriptions, workspaces, rules and settings."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.text import matches
from strataspark.sources.documents import listing, load, load_all, mapping, read_rows

# Folders that are not entered, and the bounds of a discovery.
PRUNED = (".git", "node_modules", "target", "dist", "build", "vendor", ".venv", "__pycache__")
MAX_DEPTH, MAX_BYTES, MAX_FILES = 12, 1 << 20, 5000


def discover(files: DataFrame, names: tuple[str, ...] = ("catalog-info.yaml", "catalog-info.yml"), depth: int = MAX_DEPTH, max_bytes: int = MAX_BYTES, most: int = MAX_FILES) -> DataFrame:
    """(path, skipped) of the files(path, length) of these names: null, or why one is left out: pruned, too_deep,
    too_large, or too_many after the first `most` in the order of paths."""
    parts = F.split("path", "/")
    rows = files.where(F.element_at(parts, -1).isin(*names))
    folders = F.slice(parts, 1, F.size(parts) - 1)
    why = F.when(F.arrays_overlap(folders, F.array(*[F.lit(p) for p in PRUNED])), "pruned").when(F.size(folders) > depth, "too_deep").when(F.col("length") > max_bytes, "too_large")
    rows = rows.select("path", why.alias("skipped"))
    taken = rows.where("skipped is null").orderBy("path").limit(most)
    over = rows.where("skipped is null").join(taken.select("path"), "path", "left_anti").select("path", F.lit("too_many").alias("skipped"))
    return rows.where("skipped is not null").unionAll(taken).unionAll(over)


ENTITIES = (
    "source_path string, reference string, kind string, owner string, owner_kind string, system string, domain string, parent string, "
    "depends_on array<string>, provides_apis array<string>, consumes_apis array<string>, project string, modelled boolean, coverage string"
)
# Kinds of entities that are modelled, versions that are read, and the members of a spec that are.
KINDS = ("Component", "API", "Resource", "System", "Domain", "Group", "User", "Location", "Template")
VERSIONS = ("backstage.io/v1alpha1", "backstage.io/v1beta1")
READ = {"type", "lifecycle", "owner", "system", "domain", "subcomponentOf", "dependsOn", "providesApis", "consumesApis", "definition", "profile", "children", "parent", "members", "memberOf", "targets", "target"}


def reference(text: str, kind: str, namespace: str = "default") -> str:
    """[kind:][namespace/]name in full, lower-cased."""
    head, _, rest = text.rpartition(":")
    space, _, name = rest.rpartition("/")
    return f"{head or kind}:{space or namespace}/{name}".lower()


def entities(docs: DataFrame) -> DataFrame:
    """ENTITIES of catalog files(path, content), one row for each document of a file. Entities of unknown kinds are
    rows that are not `modelled`; what is read in part, or lacks an owner or a definition, is partial."""

    def read(path, content):
        for doc in load_all(content):
            doc, meta = mapping(doc), mapping(mapping(doc).get("metadata"))
            kind, name, version = doc.get("kind"), meta.get("name"), doc.get("apiVersion")
            if not isinstance(kind, str) or not isinstance(name, str) or version not in VERSIONS:
                continue
            spec, space = mapping(doc.get("spec")), meta.get("namespace") if isinstance(meta.get("namespace"), str) else "default"

            def one(key, default, allowed, spec=spec, space=space, kind=kind):
                v = spec.get(key)
                return reference(v, default, space) if isinstance(v, str) and kind in allowed else None

            def many(key, default, spec=spec, space=space):
                return sorted({reference(v, default, space) for v in listing(spec.get(key)) if isinstance(v, str)})

            owner = one("owner", "group", KINDS)
            partial = bool(set(spec) - READ) or (kind == "Component" and owner is None) or (kind == "API" and "definition" not in spec)
            project = mapping(meta.get("annotations")).get("github.com/project-slug")
            yield (
                path, reference(name, kind, space), kind.lower(), owner, owner.split(":")[0] if owner else None, one("system", "system", ("Component", "API", "Resource")), one("domain", "domain", ("System",)),
                one("subcomponentOf", "component", ("Component",)), many("dependsOn", "component"), many("providesApis", "api"), many("consumesApis", "api"), project if isinstance(project, str) else None,
                kind in KINDS, "partial" if partial else "verified",
            )

    return read_rows(docs, read, ENTITIES)


WORKSPACE = "path string, tool string, pattern string"


def workspace_patterns(docs: DataFrame) -> DataFrame:
    """(path, tool, pattern) that files at the top of a repository declare as member packages: package.json, pnpm, Cargo,
    go.work, Maven modules and Gradle includes; a turbo.json or nx.json gives its tool without a pattern."""

    def read(path, content):
        name = path.rsplit("/", 1)[-1]
        if name == "package.json":
            w = mapping(load(content)).get("workspaces")
            for p in listing(w) or listing(mapping(w).get("packages")):
                yield (path, "npm", str(p))
        elif name in ("pnpm-workspace.yaml", "pnpm-workspace.yml"):
            for p in listing(mapping(load(content)).get("packages")):
                yield (path, "pnpm", str(p))
        elif name in ("turbo.json", "nx.json"):
            yield (path, name.split(".")[0], None)
        elif name == "Cargo.toml":
            try:
                doc = tomllib.loads(content)
            except tomllib.TOMLDecodeError:
                return
            for p in listing(mapping(doc.get("workspace")).get("members")):
                yield (path, "cargo", str(p))
        elif name == "go.work":
            for block in re.findall(r"(?m)^\s*use\s*(?:\(([^)]*)\)|(\S+))", content):
                for p in " ".join(block).split():
                    yield (path, "go", p.removeprefix("./"))
        elif name == "pom.xml":
            for p in re.findall(r"<module>\s*([^<\s]+)\s*</module>", content):
                yield (path, "maven", p)
        elif name in ("settings.gradle", "settings.gradle.kts"):
            for group in re.findall(r"(?m)^\s*include\s*\(?([^\n)]*)", content):
                for p in re.findall(r"""['"]:?([^'"]+)['"]""", group):
                    yield (path, "gradle", p.replace(":", "/"))

    return read_rows(docs, read, WORKSPACE)


def packages(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """(package, directory, dependencies) of package.json files in docs(path, content) whose folder a pattern of
    workspace_patterns covers (all if there is none), with the dependencies that are packages here too."""

    def read(path, content):
        doc = mapping(load(content))
        if path.rsplit("/", 1)[-1] == "package.json" and isinstance(doc.get("name"), str):
            deps = {d for k in ("dependencies", "devDependencies", "peerDependencies") for d in mapping(doc.get(k))}
            yield (doc["name"], path.rpartition("/")[0], sorted(deps))

    found = read_rows(docs, read, "package string, directory string, dependencies array<string>").where("directory <> ''")
    globs = sorted({r["pattern"] for r in manifests.where("pattern is not null").select("pattern").distinct().limit(1000).collect()})  # lines of files at the top
    if globs:
        ok = F.lit(False)
        for g in globs:
            ok = ok | matches(F.col("directory"), g.rstrip("/").replace("**", "*"))
        found = found.where(ok)
    names = found.select(F.explode("dependencies").alias("d"), "package").join(found.select(F.col("package").alias("d")).distinct(), "d", "left_semi")
    inner = names.groupBy("package").agg(F.array_sort(F.collect_set("d")).alias("dependencies"))
    return found.select("package", "directory").join(inner, "package", "left").select("package", "directory", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"))


def package_imports(specifiers: DataFrame, packages_: DataFrame) -> DataFrame:
    """(specifier, package, rest) of specifiers(specifier): the workspace package that is its longest prefix at a slash."""
    parts = F.split("specifier", "/")
    each = specifiers.select("specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("package"))
    hit = each.join(packages_.select("package").distinct(), "package")
    w = Window.partitionBy("specifier").orderBy(F.desc(F.length("package")))
    best = hit.withColumn("k", F.row_number().over(w)).where("k = 1")
    return best.select("specifier", "package", F.expr("substring(specifier, length(package) + 2)").alias("rest"))


# Kinds of rules and severities.
RULE_KINDS = ("forbidden_dependency", "layers", "no_new_cycle", "api_compatibility")
SEVERITIES = ("error", "warning", "info")


def read_rules(text: str) -> list[dict]:
    """The rules of a JSON or YAML file (a list, or `rules` of a mapping), checked: id and kind are needed, ids are
    unique, an unknown kind or severity is an error."""
    doc = load(text)
    rules = listing(doc) or listing(mapping(doc).get("rules"))
    seen: set[str] = set()
    for r in rules:
        r = mapping(r)
        if not isinstance(r.get("id"), str) or not r["id"]:
            raise ValueError("a rule without id")
        if r["id"] in seen:
            raise ValueError(f"rule {r['id']!r} occurs twice")
        if r.get("kind") not in RULE_KINDS:
            raise ValueError(f"rule {r['id']!r} is of the unknown kind {r.get('kind')!r}")
        if r.setdefault("severity", "error") not in SEVERITIES:
            raise ValueError(f"rule {r['id']!r} has the unknown severity {r['severity']!r}")
        seen.add(r["id"])
    return rules


# Settings of a scan and what they are without a file.
SETTINGS = {"exclude": [], "max_files": 50_000, "max_bytes": 1 << 20, "languages": []}


def read_settings(text: str) -> dict:
    """SETTINGS with what the `scan` table of a TOML file says; unknown names, wrong types and negative bounds are errors."""
    given = mapping(tomllib.loads(text).get("scan", {}))
    for k, v in given.items():
        if k not in SETTINGS or type(v) is not type(SETTINGS[k]):
            raise ValueError(f"setting {k!r} is unknown or of the wrong type")
        if isinstance(v, int) and v < 0:
            raise ValueError(f"setting {k!r} is negative")
    return SETTINGS | given
