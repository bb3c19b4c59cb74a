"""Requirements of package managers, read in Python: npm and Cargo ranges, PEP 440 specifiers, Poetry's caret and tilde."""

from __future__ import annotations

import re

_VERSION = re.compile(r"^[v=]*\s*(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


def key(version: str) -> tuple | None:
    """A tuple that compares by SemVer precedence, of a full version."""
    m = _VERSION.match(version.strip())
    if not m or any(not (p or "").isdigit() for p in m.group(1, 2, 3)):
        return None
    pre = tuple((1, 0, p) if not p.isdigit() else (0, int(p), "") for p in m[4].split(".")) if m[4] else ()
    return (*map(int, m.group(1, 2, 3)), not pre, pre)


def _bounds(op: str, spec: str, default_caret: bool) -> tuple | None:
    """(low, high) of one comparator: low <= version < high by key; None if it can't be read."""
    m = _VERSION.match(spec)
    if not m:
        return None
    parts = [int(p) if (p or "").isdigit() else None for p in m.group(1, 2, 3)]
    n = next((i for i, p in enumerate(parts) if p is None), 3)
    full = [p if i < n else 0 for i, p in enumerate(parts)]
    pre = tuple((1, 0, p) if not p.isdigit() else (0, int(p), "") for p in m[4].split(".")) if m[4] and n == 3 else ()
    low = (*full, not pre, pre)
    least = lambda a, b, c: (a, b, c, False, ())  # noqa: E731  below every pre-release of a.b.c
    top = (10**18, 0, 0, True, ())

    def after(level: int) -> tuple:
        if level < 0:
            return top
        up = [*full[:level], full[level] + 1, *([0] * (2 - level))]
        return least(*up)

    if n == 0:
        return (least(0, 0, 0), top) if op in ("", "=", "^", "~", ">=", "<=") else (top, top)
    if op == "" and default_caret:
        op = "^"
    if op in ("", "="):
        return (low, (*low[:4], (*low[4], (0, 0, "")))) if n == 3 and pre else (low, (*full[:2], full[2], True, ((9,),))) if n == 3 else (low, after(n - 1))
    if op == "^":
        level = next((i for i in range(n) if full[i]), n - 1)
        return low, after(level)
    if op == "~":
        return low, after(1 if n >= 2 else 0)
    if op == ">=":
        return low, top
    if op == ">":
        return ((*low[:4], (*low[4], (0, 0, ""))) if pre else (*full, True, ((9,),)), top) if n == 3 else (after(n - 1), top)
    if op == "<":
        return least(0, 0, 0), low if n == 3 else least(*full)
    if op == "<=":
        return (least(0, 0, 0), (*low[:4], (*low[4], (0, 0, ""))) if pre else (*full, True, ((9,),))) if n == 3 else (least(0, 0, 0), after(n - 1))
    return None


def _semver(requirement: str, version: str, npm: bool) -> bool | None:
    v = key(version)
    if v is None:
        return None
    answers = []
    for part in requirement.split("||") if npm else [requirement]:
        part = part.strip()
        hyphen = re.match(r"^(\S+)\s+-\s+(\S+)$", part)
        if npm and hyphen:
            comparators = [(">=", hyphen[1]), ("<=", hyphen[2])]
        else:
            found = re.findall(r"(\^|~>?|>=|<=|>|<|=)?\s*([0-9xX*v][^\s,]*)", part) if part else [("", "*")]
            rest = re.sub(r"(\^|~>?|>=|<=|>|<|=)?\s*([0-9xX*v][^\s,]*)", "", part).replace(",", "").strip()
            if rest or not found:
                return None
            comparators = [(op.replace("~>", "~"), s) for op, s in found]
        bounds = [_bounds(op, s, not npm) for op, s in comparators]
        if any(b is None for b in bounds):
            return None
        ok = all(low <= v < high for low, high in bounds)
        # A pre-release counts only where the requirement names one of the same version.
        if ok and not v[3]:
            ok = any("-" in s and (k := key(s)) is not None and k[:3] == v[:3] for _, s in comparators)
        answers.append(ok)
    return any(answers)


def _pep440(requirement: str, version: str) -> bool | None:
    from packaging.specifiers import InvalidSpecifier, SpecifierSet
    from packaging.version import InvalidVersion, Version

    text = requirement.strip()
    text = "" if text == "*" else text
    if m := re.match(r"^([~^])\s*(\d+(?:\.\d+)*)$", text):  # Poetry's own forms
        parts = [*map(int, m[2].split("."))]
        at = next((i for i, p in enumerate(parts) if p), len(parts) - 1) if m[1] == "^" else min(1, len(parts) - 1)
        text = f">={m[2]},<{'.'.join(map(str, [*parts[:at], parts[at] + 1]))}"
    elif re.match(r"^\d", text):
        text = f"=={text}"
    try:
        return SpecifierSet(text).contains(Version(version), prereleases=True)
    except (InvalidSpecifier, InvalidVersion):
        return None


def allows(ecosystem: str, requirement: str, version: str) -> bool | None:
    """Whether the requirement admits the version; None for what can't be read."""
    if ecosystem == "Go":
        return True
    if ecosystem == "PyPI":
        return _pep440(requirement, version)
    return _semver(requirement.strip(), version, ecosystem == "npm")
