"""Symbol events of changed files, and definition/use relations between the two sides of a pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.paths import language
from weftline.sources.scratch import settle

NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
# What each language's lines say about symbols, as (kind, expression with the name in group 1).
RULES: dict[str, list[tuple[str, str]]] = {
    "python": [("def", rf"(?m)^\s*def\s+{NAME}\s*\("), ("class", rf"(?m)^\s*class\s+{NAME}\b"), ("import", r"(?m)^\s*import\s+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"), ("import", r"(?m)^\s*from\s+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\s+import"), ("use", rf"\b{NAME}\s*\("), ("env", r"os\.environ(?:\.get)?\(\s*[\"']([A-Z0-9_]+)[\"']"), ("config_key", r"[\"']([A-Za-z][A-Za-z0-9_.]+)[\"']"), ("route", r"@(?:app|router|bp)\.(?:route|get|post|put|delete|patch)\(\s*[\"']([^\"']+)[\"']")],
    "javascript": [("def", rf"function\s+{NAME}\s*\("), ("def", rf"(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?\("), ("class", rf"class\s+{NAME}\b"), ("export", rf"export\s+(?:async\s+)?(?:function|class|const|let|var|default)\s+{NAME}"), ("import", r"from\s+[\"']([^\"']+)[\"']"), ("import", r"require\(\s*[\"']([^\"']+)[\"']\s*\)"), ("use", rf"\b{NAME}\s*\("), ("env", r"process\.env\.([A-Z0-9_]+)"), ("route", r"(?:app|router)\.(?:get|post|put|delete|patch|use)\(\s*[\"']([^\"']+)[\"']")],
    "go": [("def", rf"func\s+(?:\([^)]+\)\s+)?{NAME}\s*\("), ("class", rf"type\s+{NAME}\s+struct"), ("import", r'"([^"]+)"'), ("use", rf"\b{NAME}\s*\(")],
    "java": [("class", rf"(?:class|interface|enum)\s+{NAME}\b"), ("def", rf"(?:public|private|protected|static|final|\s)+{NAME}\s*\("), ("import", r"import\s+([a-zA-Z0-9_.]+);"), ("use", rf"\b{NAME}\s*\(")],
    "rust": [("def", rf"fn\s+{NAME}\s*\("), ("class", rf"struct\s+{NAME}\b"), ("use", rf"\b{NAME}\s*\("), ("import", r"use\s+([a-zA-Z0-9_:]+)")],
    "csharp": [("class", rf"(?:class|interface|record|struct)\s+{NAME}\b"), ("def", rf"(?:public|private|protected|internal|static|\s)+{NAME}\s*\("), ("use", rf"\b{NAME}\s*\(")],
    "config": [("config_key", r"(?m)^[\s-]*([A-Za-z_][A-Za-z0-9_.-]*)\s*:"), ("config_key", r"(?m)^\s*\"([A-Za-z_][A-Za-z0-9_.-]*)\"\s*:"), ("env", r"(?m)^([A-Z][A-Z0-9_]+)="), ("schema", rf"(?i)\b(?:create|alter|drop)\s+table\s+{NAME}")],
}
RULES["typescript"] = RULES["javascript"]
RULES["yaml"] = RULES["sql"] = RULES["config"]
RULES["generic"] = [("ident", NAME), *RULES["config"]]
PREFIXED = ("def", "class", "config_key", "env", "schema", "ident")
# Names too common to say anything.
STOP = ("self", "this", "that", "init", "main", "test", "data", "item", "value", "type", "name", "info", "get", "set", "len", "str", "int", "list", "dict", "true", "false", "none", "null", "return", "print", "log")
DELETED = tuple(f"deleted_{k}" for k in PREFIXED)
# Relation, confidence, kinds on the changing side, kinds on the other, and the kinds whose files are told of either.
RELATIONS = (
    ("changed_definition_used_by_partner", 0.91, ("def", "class", "export"), ("use", "import"), "def", "use"),
    ("deleted_definition_used_by_partner", 0.93, (*DELETED, "deleted_export"), ("use", "import"), "deleted_def", "use"),
    ("exported_change_used_by_partner", 0.88, ("export",), ("use", "import"), "export", "use"),
    ("config_key_producer_consumer", 0.80, ("config_key", "deleted_config_key"), ("config_key", "use", "env"), "config_key", "config_key"),
    ("env_var_producer_consumer", 0.85, ("env", "deleted_env"), ("env", "use"), "env", "env"),
    ("schema_field_intersection", 0.80, ("schema", "deleted_schema"), ("schema", "use", "ident"), "schema", "use"),
)
IMPORTS = ("import_path_dependency", 0.70, "def", "import")
WEAK = ("identifier_similarity_fallback", 0.35, ("ident", "def", "class"), ("use", "ident"), "def", "use")
#: Kinds as bits, and those whose files are kept.
KINDS = ("def", "class", "export", "use", "import", "env", "config_key", "route", "schema", "ident", *DELETED, "deleted_export")
FILED = ("def", "use", "export", "config_key", "env", "schema", "import")


def split_diff(patch: Column) -> Column:
    """Added and deleted text of a unified diff."""
    lines = F.split(F.coalesce(patch, F.lit("")), "\n")
    side = lambda sign: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substring(x, 2, 1 << 30)), "\n")
    return F.struct(side("+").alias("added"), side("-").alias("deleted"))


def _events(text: Column, lang: Column, deleted: bool) -> Column:
    """Array of (kind, name): one branch a language, so that each row pays for its own rules only."""
    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("name"))

    out = None
    for name, rules in RULES.items():
        parts = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), named("deleted_" + k if deleted and k in PREFIXED else k)) for k, p in rules]
        found = F.flatten(F.array(*parts))
        out = F.when(lang == name, found) if out is None else out.when(lang == name, found)
    return F.filter(F.coalesce(out, F.array().cast("array<struct<kind:string,name:string>>")), lambda e: F.length(e["name"]) >= 3)


def symbol_events(files: DataFrame, key: list[str], path: str = "path", patch: str | None = "patch", text: str | None = None) -> DataFrame:
    """key, file, lang, kind, name: distinct events of patches (added and deleted lines) or of whole texts."""
    d = files.withColumn("lang", language(F.col(path)))
    if text:
        ev = _events(F.coalesce(F.col(text), F.lit("")), F.col("lang"), False)
    else:
        d = d.withColumn("_d", split_diff(F.col(patch)))
        ev = F.concat(_events(F.col("_d.added"), F.col("lang"), False), _events(F.col("_d.deleted"), F.col("lang"), True))
    e = d.select(*key, F.col(path).alias("file"), "lang", F.explode(ev).alias("e"))
    return e.select(*key, "file", "lang", "e.kind", "e.name").where(~F.lower("name").isin(*STOP)).distinct()


def profiles(events: DataFrame, by: list[str]) -> DataFrame:
    """One row a name: its kinds as bits, and for some kinds the first file (the deleted one's, where there is no other)."""
    bit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, 1 << i))), F.col("kind")), F.lit(0))
    first = lambda k: F.coalesce(F.min(F.when(F.col("kind") == k, F.col("file"))), F.min(F.when(F.col("kind") == f"deleted_{k}", F.col("file"))))
    return events.groupBy(*by, "name").agg(F.bit_or(bit).alias("mask"), F.struct(*(first(k).alias(k) for k in FILED), F.min(F.when(F.col("kind") == "deleted_def", F.col("file"))).alias("deleted_def")).alias("at"))


def related(met: DataFrame, pair: list[str]) -> DataFrame:
    """Evidence of names that both sides have; met: pair key, name, mask_a, at_a, mask_b, at_b.  Each relation is a test of bits."""
    bits = lambda kinds: sum(1 << KINDS.index(k) for k in set(kinds))
    found = []
    for x, y, way in (("a", "b", "A->B"), ("b", "a", "B->A")):
        for relation, confidence, changing, other, of, user in (*RELATIONS, *([WEAK] if way == "A->B" else [])):
            hit = (F.col(f"mask_{x}").bitwiseAND(bits(changing)) > 0) & (F.col(f"mask_{y}").bitwiseAND(bits(other)) > 0)
            if relation == WEAK[0]:
                hit = hit & (F.length("name") >= 6)
            found.append(F.when(hit, F.struct(F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(way).alias("direction"), F.coalesce(F.col(f"at_{x}.{of}"), F.lit("")).alias("definition_file"), F.coalesce(F.col(f"at_{y}.{user}"), F.lit("")).alias("consumer_file"))))
    g = met.select(*pair, F.col("name").alias("symbol"), F.inline(F.array_compact(F.array(*found))))
    few = F.row_number().over(Window.partitionBy(*pair).orderBy("symbol")) <= 8
    weak = g.where(F.col("relation") == WEAK[0]).withColumn("_few", few).where("_few").drop("_few")
    return g.where(F.col("relation") != WEAK[0]).unionByName(weak)


def imported(files: DataFrame, imports: DataFrame, definitions: DataFrame, pair: list[str]) -> DataFrame:
    """A changed file whose path an import of the other side names.  files: pair, side, file; imports: pair, side, file, name; definitions: pair, side, name, file."""
    stem = F.regexp_replace(F.replace(F.col("a.file"), F.lit("\\"), F.lit("/")), r"\.[^.]*$", "")
    path = F.regexp_replace("b.name", r"\.|::", "/")
    near = F.contains(stem, path) | (F.substring_index(stem, "/", -1) == F.substring_index("b.name", ".", -1))
    a, b = files.alias("a"), imports.groupBy(*pair, "side", "name").agg(F.min("file").alias("file")).alias("b")
    on = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in pair] + [F.col("a.side") != F.col("b.side"), near]
    dep = a.join(b, on).select(*(F.col(f"a.{p}").alias(p) for p in pair), F.col("a.side").alias("side"), F.col("b.name").alias("name"), F.col("a.file").alias("changed_file"), F.col("b.file").alias("consumer_file")).distinct()
    dep = dep.join(definitions.groupBy(*pair, "side", "name").agg(F.min("file").alias("definition_file")), [*pair, "side", "name"], "left")
    return dep.select(*pair, F.col("name").alias("symbol"), F.lit(IMPORTS[0]).alias("relation"), F.lit(IMPORTS[1]).alias("confidence"), F.when(F.col("side") == "A", "A->B").otherwise("B->A").alias("direction"), F.coalesce("definition_file", F.lit("")).alias("definition_file"), "consumer_file", "changed_file")


def detect(events: DataFrame, pair: list[str], side: str = "side") -> DataFrame:
    """Evidence of each pair: relation, direction, symbol, files and confidence.

    events: pair key, side ('A' or 'B'), file, kind, name.  Each side is reduced to one row a name first, so both meet
    by one equi-join on (pair, name), and the relation table is a test of bits; imports meet changed files within the pair.
    """
    e = events.select(*pair, F.col(side).alias("side"), "file", "kind", "name")
    half = lambda s: profiles(e.where(F.col("side") == s.upper()), pair).select(*pair, "name", F.col("mask").alias(f"mask_{s}"), F.col("at").alias(f"at_{s}"))
    met = half("a").join(half("b"), [*pair, "name"])
    files = e.select(*pair, "side", "file").distinct()
    defs = e.where(F.col("kind").isin("def", "deleted_def")).select(*pair, "side", "name", "file")
    return related(met, pair).withColumn("changed_file", F.lit(None).cast("string")).unionByName(imported(files, e.where("kind = 'import'"), defs, pair))


def detect_requests(pairs: DataFrame, events: DataFrame, pair: list[str], request: str = "pr", sides: tuple[str, str] = ("pr_a", "pr_b")) -> DataFrame:
    """As detect(), from the events of requests: these are reduced once a request, before they are copied to its pairs."""
    p = settle(profiles(events, [request]))
    half = lambda s, i: p.select(F.col(request).alias(sides[i]), "name", F.col("mask").alias(f"mask_{s}"), F.col("at").alias(f"at_{s}"))
    asked = [b for kinds in (*RELATIONS, WEAK) for b in kinds[2]]
    useful = sum(1 << KINDS.index(k) for k in set(asked) | {k for r in (*RELATIONS, WEAK) for k in r[3]})
    met = pairs.select(*pair).join(half("a", 0).where(F.col("mask_a").bitwiseAND(useful) > 0), sides[0]).join(half("b", 1), [sides[1], "name"])
    both = lambda d, *cols: reduce(DataFrame.union, [pairs.select(*pair).join(d.withColumnRenamed(request, sides[i]), sides[i]).select(*pair, F.lit("AB"[i]).alias("side"), *cols) for i in (0, 1)])
    imports = events.where("kind = 'import'").select(request, "name", "file").distinct()
    out = related(met, pair).withColumn("changed_file", F.lit(None).cast("string"))
    if imports.isEmpty():
        return out
    defs = events.where(F.col("kind").isin("def", "deleted_def")).select(request, "name", "file")
    return out.unionByName(imported(both(events.select(request, "file").distinct(), "file"), both(imports, "name", "file"), both(defs, "name", "file"), pair))


def ranked_evidence(evidence: DataFrame, pair: list[str], strong: float = 0.5, weak: int = 3) -> DataFrame:
    """By confidence, then in the order of the relation table; weak evidence only where there is no strong, and then the first few."""
    w = Window.partitionBy(*pair)
    turn = F.element_at(F.create_map(*(F.lit(x) for i, r in enumerate((*RELATIONS, IMPORTS, WEAK)) for x in (r[0], i))), F.col("relation"))
    t = evidence.withColumn("_turn", turn).withColumn("_best", F.max("confidence").over(w))
    t = t.withColumn("place", F.row_number().over(w.orderBy(F.desc("confidence"), "_turn", "direction", "symbol", "changed_file")))
    return t.where(F.when(F.col("_best") >= strong, F.col("confidence") >= strong).otherwise(F.col("place") <= weak)).drop("_best", "_turn")


def verdict(evidence: DataFrame, pair: list[str], strong: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """prediction, direction, the leading strong evidence and how much there is; with `pairs`, also those without any.

    Without strong evidence direction and relation are "none" and the symbol is empty.
    """
    e = ranked_evidence(evidence, pair, strong)
    s = F.col("confidence") >= strong
    ab, ba = F.bool_or(s & (F.col("direction") == "A->B")), F.bool_or(s & (F.col("direction") == "B->A"))
    g = e.groupBy(*pair).agg(F.bool_or(s).alias("prediction"), ab.alias("ab"), ba.alias("ba"), F.min(F.struct("place", "relation", "symbol", "definition_file", "consumer_file", "confidence")).alias("t"), F.count("*").alias("n_evidence"))
    if pairs is not None:
        g = pairs.select(*pair).join(g, pair, "left")
    sure = F.coalesce("prediction", F.lit(False))
    way = F.when(F.col("ab") & F.col("ba"), "both").when(F.col("ab"), "A->B").when(F.col("ba"), "B->A").otherwise("none")
    told = lambda c, none: F.when(sure, F.col(f"t.{c}")).otherwise(none).alias(c)
    return g.select(*pair, sure.alias("prediction"), way.alias("direction"), told("relation", "none"), told("symbol", ""), told("definition_file", ""), told("consumer_file", ""), F.coalesce("t.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def verification_bundle(verdicts: DataFrame, evidence: DataFrame, pair: list[str], context: DataFrame | None = None, top: int = 20) -> DataFrame:
    """What a human needs to check a verdict: one row a pair, with the verdict, its first `top` pieces of evidence as a list, the
    columns of `context` (titles, patches) and empty fields for the answer."""
    e = ranked_evidence(evidence, pair).where(F.col("place") <= top)
    listed = e.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("place", "relation", "direction", "symbol", "definition_file", "consumer_file", "confidence"))).alias("evidence"))
    out = verdicts.join(listed, pair, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(listed.schema["evidence"].dataType)))
    if context is not None:
        out = out.join(context, pair, "left")
    return out.withColumns({c: F.lit("") for c in ("human_label", "human_note", "verified_by")})
