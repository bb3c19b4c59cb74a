"""Shell lines: words against shlex, installs by their rules, folders, wrappers, nested shells."""

import random
import shlex

import pytest
from pyspark.sql import functions as F

from sievework.operators import shell

#: line: what it installs, as (folder, manager, args or None).
LINES = [
    ("npm i lodash", [("/p", "npm", ["install", "lodash"])]),
    ("cd web && pnpm add -D vite", [("/p/web", "pnpm", ["add", "-D", "vite"])]),
    ("CI=1 sudo -E npm ci", [("/p", "npm", ["ci"])]),
    ("yarn", [("/p", "yarn", ["install"])]),
    ("python3 -m pip install requests", [("/p", "pip", ["install", "requests"])]),
    ("python -m pip install x", [("/p", "pip", ["install", "x"])]),
    ("pip3 install x", [("/p", "pip", ["install", "x"])]),
    ("uv pip install httpx", [("/p", "pip", ["install", "httpx"])]),
    ("uv add 'fastapi>=0.110'", [("/p", "uv", ["add", "fastapi>=0.110"])]),
    ("bash -c 'cargo add serde'", [("/p", "cargo", ["add", "serde"])]),
    ("cd a; sh -c \"cd b && sh -c 'npm install x'; npm clean-install\" && yarn", [("/p/a", "yarn", ["install"]), ("/p/a/b", "npm", ["ci"]), ("/p/a/b", "npm", ["install", "x"])]),
    ("/usr/bin/bun i", [("/p", "bun", ["install"])]),
    ("/usr/bin/npm install", [("/p", "npm", ["install"])]),
    ("sudo -u root npm i x", [("/p", "npm", ["install", "x"])]),
    ("npm test && npm run build && pip list && cargo build", []),
    ("echo npm install x", []),
    ("echo 'a; npm install x'", []),
    ("tee x # npm i evil", []),
    ("npm i a#b", [("/p", "npm", ["install", "a#b"])]),
    ("npm --prefix packages/app install f", [("/p/packages/app", "npm", ["install", "f"])]),
    ("npm --registry https://r.example ci", [("/p", "npm", ["ci", "--registry", "https://r.example"])]),
    ("env -C web FOO=1 nice -n 5 timeout 60 pnpm --filter app add vite", [("/p/web", "pnpm", ["add", "vite", "--filter", "app"])]),
    ("sudo -D web --user=dummy yarn --cwd app add x", [("/p/web/app", "yarn", ["add", "x"])]),
    ("bun --cwd=site i", [("/p/site", "bun", ["install"])]),
    ("env -C web npm ci && npm ci", [("/p", "npm", ["ci"]), ("/p/web", "npm", ["ci"])]),
    ("env --chdir /abs npm ci", [("/abs", "npm", ["ci"])]),
    ("sudo -uDweb npm i", [("/p", "npm", ["install"])]),
    ("timeout -k 5 -- 60 npm i", [("/p", "npm", ["install"])]),
    ("npm --some-new-option value install x", [("/p", "npm", None)]),
    ("npm --some-new-option value test", []),
    ("env -S 'npm install x'", [("/p", None, None)]),
    ("env --split-string='npm i'", [("/p", None, None)]),
    ("sudo -u", []),
    ("timeout npm", []),
    ("npm install -g typescript", [("/p", "npm", None)]),
    ("npm --location=global i x", [("/p", "npm", None)]),
    ("yarn global add x", [("/p", "yarn", None)]),
    ("poetry add requests", [("/p", "poetry", None)]),
    ("cargo install ripgrep", [("/p", "cargo", None)]),
    ("uv tool install ruff", [("/p", "uv", None)]),
    ("uv --offline sync", [("/p", "uv", ["sync"])]),
    ("npm i $(cat deps.txt)", [("/p", "npm", None)]),
    ('npm i "$X"', [("/p", "npm", None)]),
    ("npm i 'x$y'", [("/p", "npm", ["install", "x$y"])]),
    ("npm i a\\\n  b", [("/p", "npm", ["install", "a", "b"])]),
    ("(cd x; npm i)", [("/p/x", "npm", ["install"])]),
    ("bash -c", []),
    ("", []),
    (None, []),
]


def test_installs(spark):
    lines = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "id int, command string")
    got: dict[int, list] = {}
    for r in shell.installs(lines, folder=F.lit("/p")).collect():
        assert (r["args"] is None) == (r["why"] is not None) == (r["names"] is None)
        got.setdefault(r["id"], []).append((r["folder"], r["manager"], r["args"]))
    for i, (line, want) in enumerate(LINES):
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str), line


@pytest.mark.parametrize(
    ("line", "names"),
    [
        ("pip install -r req.txt --upgrade flask", ["flask"]),
        ("pip install --find-links wh -f other git+https://git.example/x 'mine @ git+https://git.example/mine' ./local dist/pkg-1.0-py3-none-any.whl /abs/pkg --index corp requests~=2.31 'Flask[async]'", ["requests", "flask"]),
        ("cargo add Serde@1.0 --features derive tokio", ["serde", "tokio"]),
        ("npm i left-pad@1 @s/x@2 @t/y", ["left-pad", "@s/x", "@t/y"]),
        ("npm ci", []),
    ],
)
def test_names(spark, line, names):
    assert shell.installs(spark.createDataFrame([(line,)], "command string")).first()["names"] == names


def test_words_are_shlex_words(spark):
    rng = random.Random(3)
    parts = ["a", "b c", "'", '"', "\\", "x#y", " ", "é", "#", "'a b'", '"c d"', "\\ ", "$", "e"]
    lines = []
    while len(lines) < 400:
        line = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        try:
            lexer = shlex.shlex(line, posix=True)
            lexer.whitespace_split, lexer.escapedquotes, lexer.commenters = True, '"', ""
            words = list(lexer)
        except ValueError:
            continue
        # A backslash within double quotes stands for the next character here, and for itself there.
        if not ('"' in line and "\\" in line) and "#" not in line.replace("x#y", ""):
            lines.append((line, words))
    got = spark.createDataFrame(lines, "line string, want array<string>").select("line", "want", F.flatten(F.transform(shell.simple_commands(F.col("line")), lambda c: c["words"])).alias("got"))
    for r in got.collect():
        assert r["got"] == r["want"], r["line"]
