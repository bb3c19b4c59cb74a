"""Lockfiles read entry by entry, whole or in parts."""

import random
import tracemalloc

from sievework.sources import lockfiles as K

NPM = '{"packages": {"": {"name": "é"}' + "".join(f',"node_modules/p{i}": {{"version": "1.{i}.0", "integrity": "sha512-x"}}' for i in range(300)) + "}}"
CARGO = "version = 3\n" + "".join(f'[[package]]\nname = "p{i}"\nversion = "1"\ndependencies = [\n "a 1",\n]\n' for i in range(300)) + '[metadata]\nk = "v"\n'
PARTS = {
    "package-lock.json": ['{"packages": {', "}", "}}", '"a": {"version": "1"}', '"b": {"dependencies": {"c": "1"}}', '"x": 1', '"packages": {}', ",", " ", ":", "NaN", '"dependencies": {}, ', '"q": 5'],
    "bun.lock": ['{"packages": {', '"a": ["a@1", "", {}, "sha512-x"]', ",", "}", "}}", " "],
    "Cargo.lock": ["version = 3\n", '[[package]]\nname = "a"\nversion = "1"\n', 'x = """\n', '"""\n', "[metadata]\n", "package = []\n", "[[patch.unused]]\n", "[package.x]\n", "\n", "[[ package ]]\n", "# [[package]]\n"],
    "uv.lock": ['[[package]]\nname = "a"\n', '[[packages]]\nname = "p"\n', 'version = "1"\n', "package = []\n", "[tool]\n", "[package]\n"],
    "requirements.txt": ["a==1", " \\\n", "\n", "\r", "\r\n", "  --hash=sha256:x", "b @ git+https://h/b@m", "\x0c"],
    "yarn.lock": ["a@1:\n", '  version "1"\n', "\n", "b@2:\n", '  dependencies:\n    c "1"\n'],
}


def test_entry_by_entry_reads_as_whole(monkeypatch):
    for name, n in (("BLOCKS", 2), ("LETTERS", 3), ("ROWS", 2)):
        monkeypatch.setattr(K, name, n)
    rng, read = random.Random(2), 0
    for _ in range(6000):
        name = rng.choice(list(PARTS))
        text = "".join(rng.choice(PARTS[name]) for _ in range(rng.randrange(12)))
        try:
            want = list(K.PARSERS[K.FORMATS[name]](text, True))
        except Exception as e:  # noqa: BLE001
            want = f"{type(e).__name__}: {e}"[:300]
        got = K.parse(name, text)
        assert (got[0]["error"] if isinstance(want, str) else [{c: r[c] for c in w} for r, w in zip(got, want, strict=True)]) == want, text
        read += not isinstance(want, str)
    assert read > 2000


def test_large_lockfile_in_little_memory():
    """All rows of a file, and of all files of a task, were held as dictionaries and then as a frame: 9 to 13 times the text for each."""
    n = 40000
    npm = '{"packages": {"": {"name": "root"}' + "".join(f',"node_modules/p{i}": {{"version": "1.0", "resolved": "https://registry.invalid/p/-/p.tgz", "integrity": "sha512-x"}}' for i in range(n)) + "}}"
    cargo = "".join(f'[[package]]\nname = "p{i}"\nversion = "1.0.0"\nsource = "registry+https://index.invalid"\n\n' for i in range(n))
    list(K.batches("a/package-lock.json", NPM))  # imports
    for path, text, rows in (("a/package-lock.json", npm, n + 1), ("a/Cargo.lock", cargo, n)):
        tracemalloc.start()
        found = sum(b.num_rows for b in K.batches(path, text))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == rows and peak < 4 * len(text)


def _rows(df):
    return sorted((r["lockfile"], r["idx"], r["name"], r["version"], tuple(r["requires"]), r["error"]) for r in df.collect())


def test_files_in_parts(spark):
    """A brand's packages had to be one row; parts of one file may be as many rows, cut anywhere."""
    texts = {"x/package-lock.json": NPM, "x/Cargo.lock": CARGO, "y/package-lock.json": NPM[:-1], "z/go.sum": ""}
    parts = [(p, i, t[i : i + 97]) for p, t in texts.items() for i in range(0, max(len(t), 1), 97)]
    random.Random(1).shuffle(parts)
    want = sorted((r["lockfile"], r["idx"], r["name"], r["version"], tuple(r["requires"]), r["error"]) for p, t in texts.items() for r in K.parse(p, t))
    assert len(want) == 602 and sum(r[-1] is not None for r in want) == 1
    assert _rows(K.packages(spark.createDataFrame(parts, "path string, n int, text string"), "n")) == want
    files = spark.createDataFrame([*texts.items(), ("no.txt", "a==1"), ("w/go.sum", None)], "path string, text string")
    assert _rows(K.packages(files)) == want
    twice = K.packages(spark.createDataFrame([("requirements.txt", "a==1"), ("requirements.txt", "b==1")], "path string, text string").coalesce(1))
    assert sorted(r["name"] for r in twice.collect()) == ["a", "b"]
