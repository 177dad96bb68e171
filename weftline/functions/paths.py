"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.config import DOCKER, LOCKFILES, MANIFESTS, SPEC_CONFIG


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")


def directory_key(path: Column, depth: int = 2, root: str | None = None, with_name: bool = False) -> Column:
    """The first `depth` directories; files at the root have none (`root`); with_name counts the name as one."""
    p = _parts(path)
    dirs = p if with_name else F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))
    key = F.array_join(F.slice(dirs, 1, depth), "/")
    return F.when(key == "", F.lit(root)).otherwise(key)


def deep_key(path: Column, depth: int = 2) -> Column:
    """The first `depth` directories of paths that have a directory below them or a file beside: three parts or more."""
    p = _parts(path)
    return F.when(F.size(p) >= depth + 1, F.array_join(F.slice(p, 1, depth), "/"))


def parent_directory(path: Column) -> Column:
    p = _parts(path)
    key = F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/")
    return F.when(key != "", key)


def key_set(paths: Column, key) -> Column:
    """The different keys of an array of paths."""
    return F.array_distinct(F.filter(F.transform(paths, key), lambda k: k.isNotNull()))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_class(path: Column) -> Column:
    """One of eight classes; the first rule that fits wins."""
    low = F.lower(path)
    name = basename(low)
    starts = lambda *xs: name.rlike("^(" + "|".join(x.replace(".", r"\.") for x in xs) + ")")
    ends = lambda *xs: name.rlike(r"\.(" + "|".join(xs) + ")$")
    return (
        F.when(F.contains(low, F.lit(".github/workflows")), "ci_workflow")
        .when(ends("lock") | name.isin(*LOCKFILES), "lockfile")
        .when(starts("requirements") | name.isin(*MANIFESTS), "manifest")
        .when(starts("dockerfile") | name.isin(*DOCKER), "docker")
        .when(starts("readme"), "readme")
        .when(starts("changelog") | ends("md", "rst", "txt"), "other_docs")
        .when(starts(".gitignore", ".env") | ends("yml", "yaml", "toml", "ini", "cfg", "json"), "other_config")
        .otherwise("source")
    )


def is_spec_config(path: Column) -> Column:
    return file_class(path).isin(*SPEC_CONFIG)


def is_pure_config(paths: Column) -> Column:
    return (F.size(paths) > 0) & F.forall(paths, is_spec_config)


def has_strict_source(paths: Column) -> Column:
    return F.exists(paths, lambda p: file_class(p) == "source")


def is_generated(path: Column) -> Column:
    """Lock files, drawings, build output and paths that say so: no source to merge by hand."""
    low = F.lower(path)
    return basename(low).rlike(r"\.lock$") | basename(low).isin("package-lock.json", "go.sum", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock") | low.rlike(r"\.svg$|(^|/)dist/|generated")


def path_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the first two components, names counted; 0 if either is empty."""
    ka, kb = (key_set(x, lambda p: directory_key(p, 2, with_name=True)) for x in (a, b))
    union = F.size(F.array_union(ka, kb))
    return F.when(union > 0, F.size(F.array_intersect(ka, kb)) / union).otherwise(0.0)


#: Language by file suffix.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "cs": "csharp", "yml": "yaml", "yaml": "yaml", "json": "config", "toml": "config", "ini": "config", "cfg": "config", "env": "config", "sql": "sql"}


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))), F.lit("generic"))


def repo_of_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"repos/([^/]+/[^/]+)", 1), F.lit(""))
