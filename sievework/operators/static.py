"""Static rules over source text: Python by its syntax tree, JavaScript, TypeScript, Go and Rust by lexers.

Only what needs a program's structure runs in Python, one file a call; suppression, severity and thresholds stay columns. JavaScript's rules are in
operators/taint.py. Those of Go and Rust work on text with comments and strings blanked, so they see calls, not trees; the README lists what that leaves out.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship, spread
from . import taint

LANGUAGES = {"ts": "js", "tsx": "js", "js": "js", "jsx": "js", "py": "py", "go": "go", "rs": "rs"}

# Rule names, by the shapes that lexed code has.
GO_RULES = (("SAST/GoUnsafe", r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"unsafe"'), ("SAST/GoExecCommand", r"\bexec\s*\.\s*Command\s*\("), ("SAST/GoPanic", r"(?<![\w.])panic\s*\("))
RUST_RULES = (("SAST/RustUnsafeBlock", r"\bunsafe\s*\{"), ("SAST/RustCommandNew", r"\bCommand\s*::\s*new\s*\("), ("SAST/RustUnwrap", r"\.\s*unwrap\s*\(\s*\)"), ("SAST/RustExpect", r"\.\s*expect\s*\("))
NODES = {"js": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?])", "go": r"\b(?:if|for|case)\b|&&|\|\|", "rs": r"\b(?:if|for|while|loop)\b|=>|&&|\|\|", "py": r"\b(?:if|elif|for|while|except|and|or)\b"}
LIMITS = {"LongFunction": 50, "TooManyParameters": 5, "DeepNesting": 4}


def blanked(text: str, language: str, strings: bool = True) -> str:
    """The text with comments, and the insides of strings, as spaces; places and line breaks stay."""
    quote = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`" if language == "js" else r"\"(?:\\.|[^\"\\])*\"|`[^`]*`" if language == "go" else r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'"
    comment = r"//[^\n]*|/\*.*?\*/"
    hide = lambda s: re.sub(r"[^\n]", " ", s)

    def keep(m: re.Match) -> str:
        s = m[0]
        if s.startswith(("//", "/*")):
            return hide(s)
        return s[0] + hide(s[1:-1]) + s[-1] if strings else s

    return re.sub(f"{comment}|{quote}", keep, text, flags=re.S)


def literals(text: str, language: str) -> list[tuple[int, str]]:
    """(line, content) of the string literals; a longer one counts by its first line."""
    if language == "py":
        try:
            return [(n.lineno, n.value) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
        except (SyntaxError, ValueError):
            return []
    quote = r"\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`((?:\\.|[^`\\])*)`"
    kept = blanked(text, language, strings=False)
    return [(kept.count("\n", 0, m.start()) + 1, next(g for g in m.groups() if g is not None)) for m in re.finditer(quote, kept)]


def _python(text: str) -> Iterator[tuple[str, int]]:
    for n in ast.walk(ast.parse(text)):
        if not isinstance(n, ast.Call):
            continue
        f = n.func
        if isinstance(f, ast.Name) and f.id in ("eval", "exec"):
            yield ("SAST/PythonEval" if f.id == "eval" else "SAST/PythonExec"), n.lineno
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            if f.value.id == "pickle" and f.attr in ("load", "loads"):
                yield "SAST/PythonPickle", n.lineno
            if f.value.id == "yaml" and f.attr == "load":
                yield "SAST/PythonYamlLoad", n.lineno
        if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords):
            yield "SAST/PythonSubprocessShell", n.lineno


def functions_of(text: str, language: str) -> list[tuple[str, int, int, int, int]]:
    """(name, line, lines, parameters, depth) of a JavaScript or Python file's functions."""
    if language == "py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []

        def depth(n: ast.AST) -> int:
            own = isinstance(n, (ast.If, ast.For, ast.While, ast.With, ast.Try))
            return own + max((depth(c) for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef))), default=0)

        return [(n.name, n.lineno, n.end_lineno - n.lineno + 1, len(n.args.args) + len(n.args.kwonlyargs), max((depth(c) for c in n.body), default=0)) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    code, out = blanked(text, language), []
    for m in re.finditer(r"\bfunction\b\s*([\w$]*)\s*\(([^)]*)\)\s*\{|([\w$]+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>\s*\{", code):
        level = most = 1
        i = m.end()
        while i < len(code) and level:
            level += (code[i] == "{") - (code[i] == "}")
            most = max(most, level)
            i += 1
        given = (m[2] if m[2] is not None else m[4]) or ""
        out.append((m[1] or m[3] or "<anonymous>", code.count("\n", 0, m.start()) + 1, code.count("\n", m.start(), i) + 1, len([p for p in given.split(",") if p.strip()]), most - 1))
    return out


def scan_text(path: str, text: str) -> list[tuple[str, int]]:
    """(rule, line) of a source file, complexity rules with their measurement; JavaScript's other rules are in operators/taint.py."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if language is None:
        return []
    if language == "py":
        try:
            out = list(_python(text))
        except (SyntaxError, ValueError, RecursionError):
            out = []
    elif language == "js":
        out = []
        for name, line, size, parameters, depth in functions_of(text, "js"):
            for rule, n in (("LongFunction", size), ("TooManyParameters", parameters), ("DeepNesting", depth)):
                if n > LIMITS[rule]:
                    out.append((f"SMELL/{rule} ({n}, max {LIMITS[rule]}: {name})", line))
    else:
        code = blanked(text, language)
        raw = blanked(text, language, strings=False)
        rules = GO_RULES if language == "go" else RUST_RULES
        out = [(r, c.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1) for r, p in rules for c in [raw if r == "SAST/GoUnsafe" else code] for m in re.finditer(p, c)]
    return sorted(set(out), key=lambda x: (x[1], x[0]))


def scan(files: DataFrame, key: str = "path") -> DataFrame:
    """path, line and rule of all static findings of the files (path, text)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sievework.operators.static import scan_text

        for b in batches:
            yield pd.DataFrame([(p, line, rule) for p, t in zip(b["path"], b["text"], strict=True) for rule, line in scan_text(p, t or "")], columns=["path", "line", "rule"])

    named = files.select(F.col(key).alias("path"), "text")
    script = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*(e for e, of in LANGUAGES.items() if of == "js"))
    return spread(named).mapInPandas(run, "path string, line int, rule string").unionByName(taint.scan(named.where(script)))


def literal_lines(files: DataFrame) -> DataFrame:
    """path, line and content of the string literals of source files; the text scan then runs on those."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sievework.operators.static import LANGUAGES, literals

        for b in batches:
            rows = [(p, line, s) for p, t in zip(b["path"], b["text"], strict=True) if (lang := LANGUAGES.get(p.rsplit(".", 1)[-1])) for line, s in literals(t or "", lang)]
            yield pd.DataFrame(rows, columns=["path", "line", "content"])

    return spread(files.select("path", "text")).mapInPandas(run, "path string, line int, content string")


def complexity_nodes(added: DataFrame) -> DataFrame:
    """path and nodes: branches, loops and conditions on added lines (path, content)."""
    of = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    n = F.lit(0)
    for language, pattern in NODES.items():
        ends = [e for e, k in LANGUAGES.items() if k == language]
        n = F.when(of.isin(*ends), F.regexp_count("content", F.lit(pattern))).otherwise(n)
    return added.groupBy("path").agg(F.sum(n).cast("long").alias("nodes"))


def imports(files: DataFrame) -> DataFrame:
    """test and import of the modules that files (path, text) name."""
    patterns = r"""(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+)|use\s+([\w:]+))|(?:from|require\()\s*["']([^"']+)["']"""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(patterns), F.lit(i)) for i in (1, 2, 3, 4)))
    return files.select(F.col("path").alias("test"), F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("raw")).select(
        "test", F.when(F.col("raw").contains("/"), F.col("raw")).otherwise(F.regexp_replace("raw", r"::|\.", "/")).alias("import")
    )
