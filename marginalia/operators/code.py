"""Source files: symbols, uses, imports and their resolution. Python through its own parser, other languages by line patterns."""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD_LINES = 400
#: Suffix -> language.
LANGUAGES = {"py": "python", "rs": "rust", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "go": "go"}
# Declaration patterns by language: pattern with name, kind.
DECLARATIONS = {
    "rust": ((r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait")),
    "ts": ((r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)", "function"), (r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:export\s+)?type\s+(\w+)\s*[=<]", "type"), (r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\(", "function")),
    "go": ((r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"^type\s+(\w+)\s+struct", "struct"), (r"^type\s+(\w+)\s+interface", "interface")),
}


def language(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


@lru_cache(maxsize=1)
def _tree(source: str) -> ast.Module | None:
    """The syntax tree, kept for the next call: symbols, uses and imports of a file are taken one after another."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return None


def symbols(path: str, source: str) -> list[tuple[str, str, int, int, int | None]]:
    """(name, kind, first line, last line, first line of the symbol around it)."""
    lang = language(path)
    if lang == "python":
        if (tree := _tree(source)) is None:
            return []
        out = []

        def visit(node, around):
            for child in ast.iter_child_nodes(node):
                inner = around
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    out.append((child.name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno, around))
                    inner = child.lineno
                visit(child, inner)

        visit(tree, None)
        return out
    found = []
    lines = source.split("\n")
    for number, line in enumerate(lines, 1):
        for pattern, kind in DECLARATIONS.get(lang, ()):
            if m := re.match(pattern, line):
                found.append((m[1], kind, number, _block_end(lines, number - 1), None))
                break
    return [(n, k, a, b, max((x[2] for x in found if x[2] < a and x[3] >= b), default=None)) for n, k, a, b, _ in found]


def _block_end(lines: list[str], at: int) -> int:
    """Line on which the braces that open from here are closed."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*", "", lines[i])
        opened |= "{" in bare
        depth += bare.count("{") - bare.count("}")
        if (opened and depth <= 0) or (not opened and ";" in bare):
            return i + 1
    return len(lines) if opened else at + 1


def uses(path: str, source: str) -> list[tuple[str, str | None, str, int, int]]:
    """(name, qualifier, relation, first line, last line) of direct calls and type references."""
    if language(path) != "python":
        out = []
        for number, line in enumerate(source.split("\n"), 1):
            if any(re.match(p, line) for p, _ in DECLARATIONS.get(language(path), ())):
                line = line.split("{", 1)[-1] if "{" in line else ""
            out += [(m[2], m[1], "calls", number, number) for m in re.finditer(r"(?:(\w+)(?:\.|::))?\b(\w+)\(", line) if m[2] not in {"if", "for", "while", "switch", "match", "return", "fn", "func", "function"}]
        return list(dict.fromkeys(out))
    if (tree := _tree(source)) is None:
        return []
    out = []

    def named(node, relation):
        if isinstance(node, ast.Name):
            out.append((node.id, None, relation, node.lineno, node.end_lineno))
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            out.append((node.attr, node.value.id, relation, node.lineno, node.end_lineno))

    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            named(node.func, "calls")
        for kind in ("annotation", "returns"):
            if getattr(node, kind, None) is not None:
                named(getattr(node, kind), "references")
    return list(dict.fromkeys(out))


def imports(path: str, source: str) -> list[tuple[int, list[str], str, str, str]]:
    """(line, candidate files in order, local name, target name, kind) of project-internal imports in the head of a file.

    kind: symbol, namespace, or edge where nothing is bound. Which candidates exist is decided by a join."""
    lang, out = language(path), []
    here = posixpath.dirname(path)
    head = source.split("\n")[:HEAD_LINES]
    if lang == "python":
        if (tree := _tree(source)) is None:
            return []
        module = lambda dotted: [f"{dotted}.py", f"{dotted}/__init__.py"]
        for node in (n for n in ast.walk(tree) if getattr(n, "lineno", 0) <= HEAD_LINES):
            if isinstance(node, ast.Import):
                for a in node.names:
                    out.append((node.lineno, module(a.name.replace(".", "/")), a.asname or a.name, "", "namespace"))
            elif isinstance(node, ast.ImportFrom):
                up = here
                for _ in range(max(0, node.level - 1)):
                    up = posixpath.dirname(up)
                base = posixpath.join(up if node.level else "", (node.module or "").replace(".", "/")).rstrip("/")
                for a in node.names:
                    if a.name == "*":
                        out.append((node.lineno, module(base), "*", "*", "edge"))
                    else:
                        out.append((node.lineno, [*module(posixpath.join(base, a.name)), *module(base)], a.asname or a.name, a.name, "symbol"))
    elif lang == "ts":
        pattern = re.compile(r"""(?:import|export)\s+(type\s+)?(?:(.+?)\s+from\s+)?["'](\.[^"']*)["']|require\(\s*["'](\.[^"']*)["']\s*\)""")
        for number, line in enumerate(head, 1):
            for m in pattern.finditer(line):
                spec = posixpath.normpath(posixpath.join(here, m[3] or m[4]))
                files = [spec, re.sub(r"\.js$", ".ts", spec), *(spec + e for e in (".ts", ".tsx", ".js", ".jsx")), *(f"{spec}/index{e}" for e in (".ts", ".tsx", ".js", ".jsx"))]
                bound = m[2] or ""
                suffix = "-type" if m[1] else ""
                names = re.search(r"\{([^}]*)\}", bound)
                whole = re.search(r"\*\s+as\s+(\w+)", bound)
                if whole:
                    out.append((number, files, whole[1], "", "namespace" + suffix))
                elif names:
                    for part in filter(None, (x.strip() for x in names[1].split(","))):
                        own = re.split(r"\s+as\s+", part.removeprefix("type ").strip())
                        out.append((number, files, own[-1], own[0], "symbol" + ("-type" if part.startswith("type ") else suffix)))
                else:
                    out.append((number, files, "", "", "edge"))
    elif lang == "rust":
        stem = posixpath.basename(path).removesuffix(".rs")
        own = here if stem in ("main", "lib", "mod") else posixpath.join(here, stem)
        root = re.match(r"^(.*?src)(?:/|$)", here)
        crate = root[1] if root else here
        for number, line in enumerate(head, 1):
            if m := re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", line):
                out.append((number, [f"{own}/{m[1]}.rs", f"{own}/{m[1]}/mod.rs"], "", "", "edge"))
            elif m := re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?use\s+crate::([\w:]+?)(?:::\{([^}]*)\})?(?:\s+as\s+(\w+))?\s*;", line):
                paths = [f"{m[1]}::{x.strip()}" for x in m[2].split(",") if x.strip()] if m[2] else [m[1]]
                for p in paths:
                    p, _, alias = p.partition(" as ")
                    parts = p.split("::")
                    files = [f for k in range(len(parts), 0, -1) for f in (f"{crate}/{'/'.join(parts[:k])}.rs", f"{crate}/{'/'.join(parts[:k])}/mod.rs")]
                    out.append((number, files, alias or m[3] or parts[-1], parts[-1], "symbol"))
    elif lang == "go":
        block = False
        for number, line in enumerate(head, 1):
            if re.match(r"\s*import\s*\($", line):
                block = True
            elif block and line.strip() == ")":
                block = False
            elif (m := re.match(r'\s*(?:import\s+)?([\w.]+\s+)?"([^"]+)"', line)) and (block or line.lstrip().startswith("import")):
                alias = (m[1] or "").strip()
                name = "" if alias in (".", "_") else alias or m[2].rsplit("/", 1)[-1]
                out.append((number, ["go:" + m[2]], name, "", "namespace" if name else "edge"))
    return out


def _explode(files: DataFrame, function, columns: list[str], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *r) for p, s in zip(frame["path"], frame["source"], strict=True) if s for r in function(p, s)]
            yield pd.DataFrame(rows, columns=["path", *columns])

    return files.select("path", "source").mapInPandas(run, "path string, " + schema)


_SYMBOLS = "name string, kind string, start_line int, end_line int, parent_start_line int"
_USES = "name string, qualifier string, relation string, start_line int, end_line int"
_IMPORTS = "line int, candidates array<string>, local_name string, target_name string, kind string"


def symbol_table(files: DataFrame) -> DataFrame:
    return _explode(files, symbols, ["name", "kind", "start_line", "end_line", "parent_start_line"], _SYMBOLS)


def use_table(files: DataFrame) -> DataFrame:
    """Uses with the symbol that holds them: the largest last line among equals of a first line, by the widest one."""
    found = _explode(files, uses, ["name", "qualifier", "relation", "start_line", "end_line"], _USES)
    return found.dropDuplicates()


def parsed(files: DataFrame) -> DataFrame:
    """``path, symbols, uses, imports``: all that a file declares, uses and imports, from one parse; to be written once and read by each of the three tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, symbols(p, s), uses(p, s), imports(p, s)) for p, s in zip(frame["path"], frame["source"], strict=True) if s]
            yield pd.DataFrame(rows, columns=["path", "symbols", "uses", "imports"])

    # structs are given as tuples, by place
    return files.select("path", "source").mapInPandas(run, f"path string, symbols array<struct<{_SYMBOLS}>>, uses array<struct<{_USES}>>, imports array<struct<{_IMPORTS}>>")


def parsed_table(parsed_: DataFrame, column: str) -> DataFrame:
    """One of the tables of ``parsed``: ``path`` and the fields of ``column``."""
    out = parsed_.select("path", F.explode(column).alias("x")).select("path", "x.*")
    return out.dropDuplicates() if column == "uses" else out


def unmeasured(files: DataFrame) -> DataFrame:
    """Why a file has no symbols: its language has no parser here."""
    low = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    return files.select("path", F.when(~low.isin(list(LANGUAGES)), "unsupported-language").alias("unmeasured"))


def import_tables(files: DataFrame, go_module: str | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``edges(src, dst, start_line)`` and ``bindings(src, dst, start_line, local_name, target_name, kind)``.

    The first candidate that exists is taken. A Go import is a directory and leads to all its files but tests. ``found`` are the
    imports where they are known already. Paths are as many as files, however small they compress, so they are never broadcast."""
    if found is None:
        found = _explode(files, imports, ["line", "candidates", "local_name", "target_name", "kind"], _IMPORTS)
    found = found.withColumn("_id", F.xxhash64("path", "line", "local_name", "target_name", F.array_join("candidates", "|")))
    tried = found.select("path", "_id", "line", "local_name", "target_name", "kind", F.posexplode("candidates").alias("ord", "dst")).where(~F.startswith("dst", F.lit("go:")))
    exists = tried.join(files.select(F.col("path").alias("dst")).hint("merge"), "dst")
    best = exists.groupBy("path", "_id").agg(F.min(F.struct("ord", "dst", "line", "local_name", "target_name", "kind")).alias("m")).select("path", "m.*")
    out = best.select(F.col("path").alias("src"), "dst", F.col("line").alias("start_line"), "local_name", "target_name", "kind")
    if go_module:
        folders = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select(F.col("path").alias("dst"), F.regexp_replace("path", r"/?[^/]*\z", "").alias("folder"))
        go = found.select("*", F.explode("candidates").alias("c")).where(F.startswith("c", F.lit(f"go:{go_module}")))
        go = go.withColumn("folder", F.regexp_replace(F.substring("c", len(go_module) + 4, 10_000), "^/", ""))
        out = out.unionByName(go.join(folders.hint("merge"), "folder").select(F.col("path").alias("src"), "dst", F.col("line").alias("start_line"), "local_name", "target_name", "kind"))
    out = out.where("src <> dst")
    return out.select("src", "dst", "start_line").distinct(), out.where("kind <> 'edge'").distinct()


def resolve_uses(uses_: DataFrame, bindings: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Uses that mean exactly one top-level symbol, in the own file or through a binding; type bindings serve references only."""
    top = symbols_.where("parent_start_line is null").select(F.col("path").alias("dst"), F.col("name").alias("target"), F.col("start_line").alias("target_line"))
    keys = ["path", "name", "qualifier", "relation", "start_line", "end_line"]
    top = top.hint("merge")
    own = uses_.where("qualifier is null").join(top, (F.col("path") == F.col("dst")) & (F.col("name") == F.col("target")))
    b = bindings.select(F.col("src"), F.col("dst").alias("b_dst"), "local_name", "target_name", F.col("kind").alias("b_kind")).hint("merge")
    allowed = ~F.endswith("b_kind", F.lit("-type")) | (F.col("relation") == "references")
    direct = uses_.where("qualifier is null").join(b, (F.col("path") == F.col("src")) & (F.col("name") == F.col("local_name"))).where(F.startswith("b_kind", F.lit("symbol")) & allowed)
    direct = direct.join(top, (F.col("b_dst") == F.col("dst")) & (F.col("target_name") == F.col("target")))
    spaced = uses_.where("qualifier is not null").join(b, (F.col("path") == F.col("src")) & (F.col("qualifier") == F.col("local_name"))).where(allowed)
    spaced = spaced.join(top, (F.col("b_dst") == F.col("dst")) & (F.col("name") == F.col("target")))
    columns = [*keys, "dst", "target", "target_line"]
    every = own.select(columns).unionByName(direct.select(columns)).unionByName(spaced.select(columns)).distinct()
    return every.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.struct("dst", "target", "target_line")).alias("m")).where("c = 1").select(*keys, "m.*")


def containers(uses_: DataFrame, symbols_: DataFrame) -> DataFrame:
    """The symbol around each use that starts last; of equals the one with the largest last line, then the last name."""
    s = symbols_.select("path", F.col("name").alias("container"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    inside = uses_.join(s.hint("merge"), "path").where("start_line between c_start and c_end")
    keys = ["path", "name", "qualifier", "relation", "start_line", "end_line"]
    return inside.groupBy(*keys).agg(F.max(F.struct("c_start", "c_end", "container")).alias("m")).select(*keys, F.col("m.container").alias("container"), F.col("m.c_start").alias("container_start_line"))


def symbol_context(name: str, symbols_: DataFrame, resolved: DataFrame, held: DataFrame, limit: int = 20) -> DataFrame:
    """``relation, path, name, start_line, total``: what a symbol contains, what calls it and what refers to it; totals before the limit."""
    own = symbols_.where(F.col("name") == name)
    inner = symbols_.alias("i").join(own.alias("o").hint("merge"), (F.col("i.path") == F.col("o.path")) & (F.col("i.parent_start_line") == F.col("o.start_line"))).select(F.lit("contains").alias("relation"), F.col("i.path").alias("path"), F.col("i.name").alias("name"), F.col("i.start_line").alias("start_line"))
    keys = ["path", "name", "relation", "start_line", "end_line"]
    used = resolved.where(F.col("target") == name).join(held.drop("qualifier").hint("merge"), keys, "left").select("relation", "path", F.coalesce("container", F.lit("(file)")).alias("name"), "start_line")
    every = inner.unionByName(used.distinct())
    # a relation's rows are cut within each task before they meet; totals are one row a relation
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("relation").orderBy("path", "start_line", "name"))).where(F.col("_n") <= limit).drop("_n")
    return first.join(F.broadcast(every.groupBy("relation").agg(F.count("*").alias("total"))), "relation").select("relation", "path", "name", "start_line", "total")


def largest_symbols(symbols_: DataFrame, path: str, limit: int = 5) -> DataFrame:
    return symbols_.where(F.col("path") == path).orderBy(F.desc(F.col("end_line") - F.col("start_line")), "start_line").limit(limit)


def incremental(old_rows: DataFrame, old: DataFrame, new: DataFrame, derive) -> DataFrame:
    """Rows of files whose (mtime, size) is unchanged and measured stay; the others are derived, vanished ones go."""
    same = old.where("unmeasured is null").join(new.select("path", "mtime", "size"), ["path", "mtime", "size"]).select("path")
    return old_rows.join(same, "path", "left_semi").unionByName(derive(new.join(same, "path", "left_anti")))


def prune_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose two ends still exist."""
    live = files.select("path")
    return edges.join(live.withColumnRenamed("path", "src"), "src", "left_semi").join(live.withColumnRenamed("path", "dst"), "dst", "left_semi")


def code_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """``path, root, relative`` of the files below a root, each once: the first root that holds a file has it, though a later one may be deeper.

    Roots are configuration, so they become one expression: no join and, but for repeated files, no shuffle."""
    if not roots:
        raise ValueError("no code roots configured")
    found = F.lit(None).cast("struct<root:int,relative:string>")
    for i, root in reversed(list(enumerate(r.rstrip("/") for r in roots))):
        held = F.startswith("path", F.lit(root + "/"))
        found = F.when(held, F.struct(F.lit(i).alias("root"), F.substring("path", len(root) + 2, 1 << 30).alias("relative"))).otherwise(found)
    return files.select("path", found.alias("at")).where("at is not null").select("path", "at.root", "at.relative").distinct()
