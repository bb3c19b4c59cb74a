"""Shell lines: their simple commands, what those run in which folder, and the dependency installs among them.

A line is cut into pieces by one pattern (quoted parts, escapes, comments, separators, blanks, plain runs), and a fold over the pieces
keeps the word, the command and whether the shell computes part of it. Wrappers before a program, the options before a manager's subcommand, and the
folders that ``cd`` leads to are folds over words and commands in the same way, so a line's whole screening is expressions on one row. Bodies of ``sh -c`` become lines of their
own, round by round, until none is left. A fold copies what it has gathered with each step, which suits lines, not files: a
line's cost grows with the square of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import settled, spread

# Commands that run another command; for each the short options and the long ones that take a value, those that change folder, and the words before the command.
WRAPPERS = {
    "sudo": ("ugpCDrtTU", ("user", "group", "prompt", "close-from", "chdir", "role", "type", "command-timeout", "other-user", "host"), ("-D", "--chdir"), 0),
    "doas": ("uC", (), (), 0),
    "env": ("uCS", ("unset", "chdir", "split-string"), ("-C", "--chdir"), 0),
    "nice": ("n", ("adjustment",), (), 0),
    "time": ("fo", ("format", "output"), (), 0),
    "timeout": ("sk", ("signal", "kill-after"), (), 1),
    "exec": ("a", (), (), 0),
    "nohup": ("", (), (), 0),
    "command": ("", (), (), 0),
}
SHELLS = ("bash", "sh", "zsh", "dash")
# Options of the JavaScript managers before their subcommand: those with a value, those without, and those that change folder.
NPM_VALUES = ("prefix", "C", "workspace", "w", "userconfig", "globalconfig", "cache", "registry", "loglevel", "location", "tag", "omit", "include", "install-strategy", "before", "script-shell", "otp", "scope", "cpu", "os", "libc")
NPM_FLAGS = (
    "g", "global", "D", "save-dev", "S", "save", "E", "save-exact", "O", "save-optional", "P", "save-prod", "B", "save-bundle", "f", "force", "offline", "prefer-offline", "prefer-online", "ignore-scripts", "silent", "s", "q", "quiet",
    "d", "dd", "ddd", "verbose", "legacy-peer-deps", "strict-peer-deps", "dry-run", "workspaces", "ws", "include-workspace-root", "foreground-scripts", "y", "yes", "audit", "fund", "production", "package-lock-only",
)
PNPM_VALUES = ("dir", "C", "filter", "F", "workspace-dir", "reporter", "loglevel", "registry")
PNPM_FLAGS = ("r", "recursive", "w", "workspace-root", "s", "silent", "g", "global", "D", "save-dev", "P", "save-prod", "O", "save-optional", "E", "save-exact", "offline", "prefer-offline", "ignore-scripts", "frozen-lockfile", "stream", "aggregate-output")
YARN_VALUES = ("cwd", "registry", "modules-folder", "cache-folder", "network-timeout")
YARN_FLAGS = ("silent", "s", "offline", "prefer-offline", "ignore-scripts", "frozen-lockfile", "immutable", "production", "non-interactive", "verbose", "W", "ignore-workspace-root-check")
BUN_VALUES = ("cwd", "config", "c", "registry", "backend", "cache-dir")
BUN_FLAGS = ("g", "global", "d", "D", "dev", "production", "p", "silent", "verbose", "frozen-lockfile", "ignore-scripts", "no-save", "dry-run", "f", "force", "exact", "E", "optional")
GLOBALS = {"npm": (NPM_VALUES, NPM_FLAGS, ("prefix", "C")), "pnpm": (PNPM_VALUES, PNPM_FLAGS, ("dir", "C")), "yarn": (YARN_VALUES, YARN_FLAGS, ("cwd",)), "bun": (BUN_VALUES, BUN_FLAGS, ("cwd",))}
# Managers, what their subcommands are called, and options of pip, uv and cargo that take a value.
INSTALLERS = ("npm", "pnpm", "yarn", "bun", "pip", "uv", "cargo", "poetry")
NPM_INSTALL = ("install", "i", "in", "ins", "inst", "insta", "instal", "isnt", "isnta", "isntal", "isntall", "add")
NPM_CI = ("ci", "clean-install", "ic", "install-clean", "isntall-clean")
UNCLEAR_WORDS = ("install", "i", "add", "ci", "clean-install", "a")
PIP_VALUES = (
    "-r", "--requirement", "-c", "--constraint", "-e", "--editable", "-t", "--target", "-d", "--dest", "-i", "--index-url", "--extra-index-url", "-f", "--find-links", "--trusted-host", "--platform", "--python-version", "--implementation",
    "--abi", "--root", "--prefix", "--src", "--upgrade-strategy", "-C", "--config-settings", "--global-option", "--no-binary", "--only-binary", "--progress-bar", "--log", "--proxy", "--retries", "--timeout", "--exists-action", "--cert",
    "--client-cert", "--cache-dir", "--report", "--python", "--keyring-provider", "--root-user-action", "--use-feature", "--use-deprecated", "--group", "--index", "--default-index", "--optional", "--extra", "--rev", "--tag", "--branch",
    "--package", "--project", "--directory", "--marker", "-m", "-p", "-P", "--upgrade-package", "--reinstall-package", "--refresh-package", "--no-build-isolation-package", "--script",
)
CARGO_VALUES = ("--features", "-F", "--rename", "--manifest-path", "--target", "--branch", "--tag", "--rev", "--git", "--path", "--registry", "-p", "--package")

PIECE = r"""'[^']*'?|"(?:\\[\s\S]|[^"\\])*"?|\\[\s\S]?|(?<![^\s;&|()])(?<!\\\s)#[^\n]*|[;&|()\n]|[^\S\n]+|[$`]|[^\s'"\\$`;&|()]+"""

_WORDS = "array<string>"
_none = lambda kind: F.lit(None).cast(kind)
_words = lambda: F.array().cast(_WORDS)


def joined(folder: Column, target: Column) -> Column:
    """A path as seen from a folder: absolute ones stand for themselves."""
    return F.when(target.startswith("/") | (folder == ""), target).otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), target))


def simple_commands(line: Column) -> Column:
    """array<struct<words, dynamic>>: the simple commands of a shell line; dynamic where the shell computes a word."""
    pieces = F.regexp_extract_all(line, F.lit(f"({PIECE})"), F.lit(1))
    blank = F.struct(F.array().cast(f"array<struct<words:{_WORDS},dynamic:boolean>>").alias("done"), _words().alias("words"), _none("string").alias("word"), F.lit(False).alias("dynamic"))

    def step(s: Column, p: Column) -> Column:
        first, n = F.substring(p, 1, 1), F.length(p)
        quoted = lambda q: F.substring(p, F.lit(2), F.when((n > 1) & p.endswith(q), n - 2).otherwise(n - 1))
        double = quoted('"')
        text = (
            F.when(first == "'", quoted("'"))
            .when(first == '"', F.regexp_replace(double, r"\\([\s\S])", "$1"))
            .when(first == "\\", F.when(p == "\\\n", "").otherwise(F.substring(p, F.lit(2), F.lit(1))))
            .otherwise(p)
        )
        computed = first.isin("$", "`") | ((first == '"') & F.regexp_replace(double, r"\\[\s\S]", "").rlike("[$`]"))
        closes, comment = p.rlike(r"\A[;&|()\n]\z"), (first == "#") & s["word"].isNull()
        gap = ~closes & ~comment & p.rlike(r"\A\s+\z")
        words = F.when(s["word"].isNull(), s["words"]).otherwise(F.array_append(s["words"], s["word"]))
        ends = closes | comment
        done = F.when(ends & (F.size(words) > 0), F.array_append(s["done"], F.struct(words.alias("words"), s["dynamic"].alias("dynamic")))).otherwise(s["done"])
        return F.struct(
            done.alias("done"), F.when(ends, _words()).when(gap, words).otherwise(s["words"]).alias("words"),
            F.when(ends | gap, _none("string")).otherwise(F.concat(F.coalesce(s["word"], F.lit("")), text)).alias("word"), (F.when(ends, False).otherwise(s["dynamic"] | computed)).alias("dynamic"),
        )

    # A line break at the end closes what is open.
    return F.aggregate(F.array_append(pieces, F.lit("\n")), blank, step, lambda s: s["done"])


def _pick(name: Column, of: dict, otherwise: Column) -> Column:
    out = otherwise
    for key, value in of.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def _base(word: Column) -> Column:
    return F.element_at(F.split(word, "/"), -1)


def unwrapped(words: Column) -> Column:
    """struct<rest, here, why>: a command's words from its program on, without assignments and wrappers; the folder (relative or not) that wrappers lead to; why they can't be told apart, else null."""
    blank = F.struct(F.lit("open").alias("mode"), F.lit("").alias("wrapper"), F.lit(False).alias("moves"), F.lit("").alias("here"), _words().alias("rest"), _none("string").alias("why"), F.lit("").alias("option"))
    wrapper = lambda f: lambda w: _pick(w, {k: F.lit(f(v)) for k, v in WRAPPERS.items()}, F.lit(f(("", (), (), 0))))
    waits = wrapper(lambda v: v[3])
    longs = wrapper(lambda v: " " + " ".join(v[1]) + " ")
    movers = wrapper(lambda v: " " + " ".join(v[2]) + " ")

    def step(s: Column, w: Column) -> Column:
        kind, mode = s["wrapper"], s["mode"]
        long_name, inline = F.regexp_extract(w, r"^--([^=]*)", 1), F.regexp_extract(w, r"^--[^=]*=([\s\S]*)$", 1)
        is_long, has_inline = w.startswith("--") & (w != "--"), w.rlike("^--[^=]*=")
        takes = is_long & longs(kind).contains(F.concat(F.lit(" "), long_name, F.lit(" ")))
        is_short = ~w.startswith("--") & w.startswith("-") & (F.length(w) > 1)
        # The pattern follows from the wrapper, so each has its own literal one.
        short = lambda i: _pick(kind, {k: F.regexp_extract(w, f"^-[^{v[0]}]*([{v[0]}])([\\s\\S]*)$", i) for k, v in WRAPPERS.items() if v[0]}, F.lit(""))
        letter, rest = short(1), short(2)
        moves_long = movers(kind).contains(F.concat(F.lit(" --"), long_name, F.lit(" ")))
        moves_short = (letter != "") & movers(kind).contains(F.concat(F.lit(" -"), letter, F.lit(" ")))
        split = (is_long & (long_name == "split-string")) | (is_short & (kind == "env") & (letter == "S"))
        option = (mode == "options") & (w.startswith("-") & (F.length(w) > 1))
        value_next = F.when(is_long, takes & ~has_inline).otherwise(is_short & (letter != "") & (rest == ""))
        value_here = F.when(is_long, F.when(takes & has_inline & moves_long, inline)).otherwise(F.when((letter != "") & (rest != "") & moves_short, rest))
        waiting = (mode == "options") & ~option & (waits(kind) > 0)
        opening = (mode == "open") | ((mode == "options") & ~option & (waits(kind) == 0))
        assigns = w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=")
        wraps = _base(w).isin(*WRAPPERS)
        out_mode = (
            F.when(mode.isin("rest", "stuck"), mode)
            .when(mode == "value", F.lit("options"))
            .when(mode == "skip", F.lit("open"))
            .when(option & split, F.lit("stuck"))
            .when(option & (w == "--"), F.when(waits(kind) > 0, "skip").otherwise("open"))
            .when(option & value_next, F.lit("value"))
            .when(option, F.lit("options"))
            .when(waiting, F.lit("open"))
            .when(opening & assigns, F.lit("open"))
            .when(opening & wraps, F.lit("options"))
            .otherwise(F.lit("rest"))
        )
        here = F.when((mode == "value") & s["moves"], joined(s["here"], w)).when(option & ~split & value_here.isNotNull(), joined(s["here"], value_here)).otherwise(s["here"])
        why = F.when(option & split, F.when(is_long, F.concat(F.lit("`"), kind, F.lit(" --split-string` builds the command from a string"))).otherwise(F.lit("`env -S` builds the command from a string"))).otherwise(s["why"])
        return F.struct(
            out_mode.alias("mode"), F.when(opening & ~assigns & wraps, _base(w)).otherwise(kind).alias("wrapper"), (option & value_next & F.when(is_long, moves_long).otherwise(moves_short)).alias("moves"), here.alias("here"),
            F.when(out_mode == "rest", F.array_append(s["rest"], w)).otherwise(s["rest"]).alias("rest"), why.alias("why"), F.when(option & value_next, w).otherwise(s["option"]).alias("option"),
        )

    def finish(s: Column) -> Column:
        unfinished = F.when(s["mode"] == "value", F.concat(F.lit("`"), s["option"], F.lit("` has no value"))).when((s["mode"] == "skip") | ((s["mode"] == "options") & (waits(s["wrapper"]) > 0)), F.concat(F.lit("`"), s["wrapper"], F.lit("` has no command")))
        return F.struct(s["rest"].alias("rest"), s["here"].alias("here"), F.coalesce(s["why"], unfinished).alias("why"))

    return F.aggregate(words, blank, step, finish)


def subcommand(words: Column) -> Column:
    """The first word that is no option and all behind it; empty if there is none."""
    at = F.array_position(F.transform(words, lambda w: ~w.startswith("-")), True)
    return F.when(at > 0, F.slice(words, at.cast("int"), F.size(words))).otherwise(_words())


def _managed(program: Column, words: Column) -> Column:
    """struct<args, here, unclear> of a JavaScript manager's words: its subcommand first, options before it moved behind; the folder they lead to; the option that leaves it unclear."""
    follows = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1).alias("next")))
    blank = F.struct(F.lit("options").alias("mode"), _words().alias("found"), _words().alias("leading"), F.lit("").alias("here"), F.lit(False).alias("moves"), _none("string").alias("unclear"))
    table = lambda i: lambda name: _pick(program, {k: name.isin(*v[i]) for k, v in GLOBALS.items()}, F.lit(False))
    values, flags, movers = table(0), table(1), table(2)

    def step(s: Column, x: Column) -> Column:
        w, mode = x["w"], s["mode"]
        option = (mode == "options") & w.startswith("-")
        bare = F.regexp_replace(w, "^--?", "")
        name, inline, has_inline = F.regexp_extract(bare, "^[^=]*", 0), F.regexp_extract(bare, r"^[^=]*=([\s\S]*)$", 1), bare.contains("=")
        value_next = ~has_inline & values(name)
        known = has_inline | values(name) | flags(name) | name.startswith("no-")
        unclear = option & ~known & x["next"].isNotNull() & ~x["next"].startswith("-")
        out_mode = F.when(mode.isin("found", "unclear"), mode).when(mode == "value", "options").when(unclear, "unclear").when(option & value_next & x["next"].isNotNull(), "value").when(option, "options").otherwise("found")
        here = F.when((mode == "value") & s["moves"], joined(s["here"], w)).when(option & has_inline & movers(name), joined(s["here"], inline)).otherwise(s["here"])
        keeps = ((mode == "value") & ~s["moves"]) | (option & ~unclear & ~movers(name))
        return F.struct(
            out_mode.alias("mode"), F.when(out_mode == "found", F.array_append(s["found"], w)).otherwise(s["found"]).alias("found"), F.when(keeps, F.array_append(s["leading"], w)).otherwise(s["leading"]).alias("leading"), here.alias("here"),
            (option & movers(name)).alias("moves"), F.when(unclear, w).otherwise(s["unclear"]).alias("unclear"),
        )

    return F.aggregate(follows, blank, step, lambda s: F.struct(F.when(F.size(s["found"]) > 0, F.concat(s["found"], s["leading"])).otherwise(_words()).alias("args"), s["here"].alias("here"), s["unclear"].alias("unclear")))


def _names(manager: Column, args: Column) -> Column:
    """The packages that an install's arguments (subcommand first) name."""
    given = F.slice(args, 2, F.greatest(F.size(args), F.lit(1)))
    after = lambda options: F.transform(given, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(given, i - 1), F.lit("")).isin(*options).alias("value")))
    # An option's value that looks like an option is taken for a value by the one before it only.
    plain = lambda options: F.transform(F.filter(after(options), lambda x: ~x["value"] & ~x["w"].startswith("-")), lambda x: x["w"])
    source = lambda w: w.contains("://") | w.rlike(r"^(?:git\+|hg\+|svn\+|bzr\+|[./~])|[/\\]|\.(?:whl|tar\.gz|zip|tar\.bz2|tgz)$")
    python = F.transform(F.filter(plain(PIP_VALUES), lambda w: ~source(w)), lambda w: F.lower(F.trim(F.regexp_extract(w, r"^[^><=!~\[;@]*", 0))))
    crates = F.transform(plain(CARGO_VALUES), lambda w: F.lower(F.trim(F.regexp_extract(w, "^[^@]*", 0))))
    scripts = F.transform(F.filter(given, lambda w: ~w.startswith("-")), lambda w: F.when(w.startswith("@"), F.regexp_extract(w, r"^(?:@[^/]*/[^@]*|@[^/]*$)", 0)).otherwise(F.regexp_extract(w, "^[^@]*", 0)))
    named = F.get(args, F.lit(0)).isin("install", "i", "add")
    return F.filter(F.when(manager.isin("pip", "uv"), python).when(manager == "cargo", crates).when(named, scripts).otherwise(_words()), lambda n: n != "")


def recognised(each: DataFrame) -> DataFrame:
    """Commands (program, given: its words) with ``install``, struct<manager, args, here, why>: what can be planned has args, another why; null if it is none.

    Column by column, so that each is made once for all rules that read it."""
    js = F.col("program").isin(*GLOBALS)
    after = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    each = settled(each.withColumn("led", F.when(js, _managed(F.col("program"), F.col("given")))))
    each = each.withColumn("words_", F.when(js, F.col("led.args")).otherwise(F.col("given")))
    each = each.withColumn("sub", subcommand(F.col("words_"))).withColumn("tail", after(F.col("sub"))).withColumn("nested", subcommand(F.col("tail")))
    each = each.withColumn("module", F.array_position("given", "-m").cast("int")).withColumn("of_module", subcommand(F.slice("given", F.col("module") + 2, F.greatest(F.size("given"), F.lit(1)))))
    program, word, nested = F.col("program"), F.get("sub", F.lit(0)), F.get("nested", F.lit(0))
    wide = F.exists("words_", lambda a: a.isin("-g", "--global") | a.startswith("--location=global"))
    each = each.withColumn("wide", wide).withColumn("word", word).withColumn("inner", nested)
    word, inner, wide = F.col("word"), F.col("inner"), F.col("wide")
    unplanned = "which isn't planned"
    rules = [
        ("npm", "install", (program == "npm") & word.isin(*NPM_INSTALL) & ~wide), ("npm", "ci", (program == "npm") & word.isin(*NPM_CI) & ~wide),
        ("pnpm", "add", (program == "pnpm") & (word == "add") & ~wide), ("pnpm", "install", (program == "pnpm") & word.isin("install", "i") & ~wide),
        ("yarn", "add", (program == "yarn") & (word == "add")), ("yarn", "install", (program == "yarn") & (word.isNull() | (word == "install"))),
        ("bun", "add", (program == "bun") & word.isin("add", "a") & ~wide), ("bun", "install", (program == "bun") & word.isin("install", "i") & ~wide),
        ("pip", "install", ((program == "pip") | program.startswith("pip3")) & (word == "install")), ("uv", "add", (program == "uv") & (word == "add")), ("uv", "sync", (program == "uv") & (word == "sync")), ("cargo", "add", (program == "cargo") & (word == "add")),
    ]
    refused = [
        ("npm", f"a global npm install, {unplanned}", (program == "npm") & word.isin(*NPM_INSTALL, *NPM_CI)), ("pnpm", f"a global pnpm install, {unplanned}", (program == "pnpm") & word.isin("add", "install", "i")),
        ("yarn", f"a global yarn install, {unplanned}", (program == "yarn") & (word == "global")), ("bun", f"a global bun install, {unplanned}", (program == "bun") & word.isin("add", "a", "install", "i")),
        ("uv", f"a tool's install by uv, {unplanned}", (program == "uv") & (word == "tool") & (inner == "install")), ("poetry", f"an install by Poetry, {unplanned}", (program == "poetry") & word.isin("add", "install")),
        ("cargo", "an install by cargo, which runs build scripts and isn't planned", (program == "cargo") & (word == "install")),
    ]
    modules = ((program == "python") | program.startswith("python3")) & (F.col("module") > 0) & (F.get("given", F.col("module")) == "pip") & (F.get("of_module", F.lit(0)) == "install")
    through = (program == "uv") & (word == "pip") & (inner == "install")
    unclear = js & F.col("led.unclear").isNotNull()
    opaque = F.concat(F.lit("a "), program, F.lit(" command where `"), F.col("led.unclear"), F.lit("` may take a value, so its subcommand is unclear"))
    first = lambda of, value: F.coalesce(*(F.when(test, value(x)) for *x, test in of))
    each = each.withColumns({
        "planned": F.when(~unclear, first(rules, lambda x: F.struct(F.lit(x[0]).alias("manager"), F.lit(x[1]).alias("name")))),
        "refused": F.when(unclear, F.when(F.exists("given", lambda w: w.isin(*UNCLEAR_WORDS)), F.struct(program.alias("manager"), opaque.alias("why")))).otherwise(first(refused, lambda x: F.struct(F.lit(x[0]).alias("manager"), F.lit(x[1]).alias("why")))),
        "pip_args": F.when(modules, F.col("of_module")).when(through, F.col("nested")),
    })
    args = F.when(F.col("planned").isNotNull(), F.concat(F.array("planned.name"), F.col("tail"))).otherwise(F.col("pip_args"))
    each = each.withColumn("args", args)
    manager = F.coalesce("planned.manager", F.when(F.col("args").isNotNull(), F.lit("pip")), "refused.manager")
    here = F.coalesce("led.here", F.lit(""))
    found = F.when(manager.isNotNull(), F.struct(manager.alias("manager"), F.col("args").alias("args"), here.alias("here"), F.when(F.col("args").isNull(), F.col("refused.why")).alias("why")))
    return each.withColumn("install", found).drop("args", "led", "words_", "sub", "tail", "nested", "module", "of_module", "wide", "word", "inner", "planned", "refused", "pip_args")


def located(lines: DataFrame) -> DataFrame:
    """Lines (body, folder, and other columns) by their commands: nth, words, dynamic, rest, why and the folder each runs in; a cd leads the commands behind it."""
    # Settled, as the optimiser would copy the folds into every place that reads them.
    lines = settled(lines.withColumn("commands", simple_commands(F.col("body"))))
    lines = settled(lines.withColumn("runs", F.transform("commands", lambda c: unwrapped(c["words"]))))
    target = lambda r: F.get(r["rest"], F.lit(1))
    leads = F.transform("runs", lambda r: F.when(r["why"].isNull() & _base(F.coalesce(F.get(r["rest"], F.lit(0)), F.lit(""))).isin("cd", "pushd") & ~target(r).startswith("-"), target(r)))
    lines = lines.withColumn("leads", leads)
    # Folders before each command; one more behind the last.
    folders = F.aggregate("leads", F.array("folder"), lambda s, to: F.array_append(s, F.when(to.isNull(), F.element_at(s, -1)).otherwise(joined(F.element_at(s, -1), to))))
    each = lines.withColumn("folders", folders).select("*", F.posexplode("commands").alias("nth", "c")).withColumn("r", F.get("runs", F.col("nth"))).withColumn("from", F.get("folders", F.col("nth")))
    here = F.when(F.col("r.here") == "", F.col("from")).otherwise(joined(F.col("from"), F.col("r.here")))
    return each.withColumns({"words": F.col("c.words"), "dynamic": F.col("c.dynamic"), "rest": F.col("r.rest"), "why": F.col("r.why"), "folder": here}).drop("commands", "runs", "leads", "folders", "c", "r", "from")


def installs(lines: DataFrame, column: str = "command", folder: Column | None = None) -> DataFrame:
    """One row an install in shell lines, with the columns of lines: at (its place, by line and nested line), folder, manager, args (null where it can't be planned), names, why (it can't, else null) and text."""
    keep = [F.col(c) for c in lines.columns]
    level = spread(lines).select(F.struct(*keep).alias("row"), F.col(column).alias("body"), (F.lit("") if folder is None else folder).alias("folder"), F.array().cast("array<int>").alias("above"))
    found = None
    while True:
        each = located(level).withColumn("at", F.array_append("above", F.col("nth"))).drop("above", "nth", "body")
        each = each.withColumn("program", _base(F.get("rest", F.lit(0)))).withColumn("given", F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))))
        flag = F.array_position("given", "-c").cast("int")
        each = settled(each.withColumn("body", F.when(F.col("why").isNull() & F.col("program").isin(*SHELLS) & (flag > 0), F.get("given", flag))))
        text = F.array_join(F.when(F.col("why").isNull(), F.col("rest")).otherwise(F.col("words")), " ")
        stuck = F.col("why").isNotNull() & text.rlike("|".join(INSTALLERS))
        unknown = F.struct(_none("string").alias("manager"), _none(_WORDS).alias("args"), F.lit("").alias("here"), F.concat("why", F.lit(", so what it runs is unknown")).alias("why"))
        rows = recognised(each.where(F.col("body").isNull())).withColumn("install", F.when(stuck, unknown).when(F.col("why").isNull(), F.col("install"))).where("install is not null")
        computed = F.lit("its arguments are computed by the shell ($… or `…`), so what it installs is unknown")
        open_ = ~F.col("dynamic") | F.col("why").isNotNull()
        rows = rows.select(
            "row.*", "at", F.when(F.col("install.here") == "", F.col("folder")).otherwise(joined(F.col("folder"), F.col("install.here"))).alias("folder"), "install.manager", F.when(open_, F.col("install.args")).alias("args"),
            F.when(open_, F.col("install.why")).otherwise(computed).alias("why"), text.alias("text"),
        )
        rows = rows.withColumn("names", F.when(F.col("args").isNotNull(), _names(F.col("manager"), F.col("args"))))
        found = rows if found is None else found.unionByName(rows)
        level = each.where(F.col("body").isNotNull()).select("row", "body", "folder", F.col("at").alias("above"))
        if level.isEmpty():
            return found
