"""Rule patterns are written for Python's ``re``; the JVM evaluates them.

``prepare_pattern`` checks one pattern, rewrites the few constructs the two dialects spell
differently, and says when only Python can run it. The translation works on single patterns of the
small template dimension and never on document text.
"""

from __future__ import annotations

import re
import string
import warnings
from dataclasses import dataclass

try:
    from re import _constants as _codes
    from re import _parser as _tree
except ImportError:  # pragma: no cover
    import sre_constants as _codes
    import sre_parse as _tree

# Java flag prefixes that reproduce Python's matching modes. U: Unicode classes and
# case; d: only \n ends a line.
SEARCH = "(?imUd)"  # IGNORECASE | MULTILINE
ANCHOR = "(?iUd)"  # IGNORECASE
MATCH = "(?Ud)"  # re.match, case-sensitive


@dataclass(frozen=True)
class Prepared:
    java: str | None  # translated pattern without flags; None when invalid
    groups: int  # capture groups, -1 when invalid
    python_syntax: bool  # uses syntax only Python has
    optional_group: bool  # a match may leave group 1 unset
    error: str | None


def _group_one_may_be_absent(tree) -> bool:
    """True when a match can leave group 1 unset (Python then fails on None)."""

    def walk(node, optional: bool) -> bool:
        for op, arg in node:
            if op is _codes.SUBPATTERN:
                if arg[0] == 1 and optional:
                    return True
                if walk(arg[-1], optional):
                    return True
            elif op is _codes.BRANCH:
                if any(walk(branch, True) for branch in arg[1]):
                    return True
            elif op in (_codes.MAX_REPEAT, _codes.MIN_REPEAT, _codes.POSSESSIVE_REPEAT):
                if walk(arg[2], optional or arg[0] == 0):
                    return True
            elif op is _codes.ATOMIC_GROUP:
                if walk(arg, optional):
                    return True
            elif op in (_codes.ASSERT, _codes.ASSERT_NOT):
                if walk(arg[1], optional or op is _codes.ASSERT_NOT):
                    return True
            elif op is _codes.GROUPREF_EXISTS:
                return True
        return False

    return walk(tree, False)


_OCTAL = re.compile(r"\\[0-3][0-7]{2}")
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_INLINE_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?[:)]")


def _translate(pattern: str, names: dict[str, int]) -> tuple[str, bool]:
    out: list[str] = []
    python_syntax = False
    i, n = 0, len(pattern)
    in_class = False
    class_start = -1
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            if e == "Z" and not in_class:
                out.append(r"\z")
            elif e == "U" and i + 10 <= n:
                out.append(r"\x{%s}" % pattern[i + 2 : i + 10].lstrip("0").rjust(1, "0"))
                i += 10
                continue
            elif e in "N0" or (in_class and e in "b123456789") or _OCTAL.match(pattern, i):
                python_syntax = True  # names, octal codes, a backspace: spelt otherwise or refused by the JVM
                out.append(c + e)
            elif e == "v":
                out.append(r"\x0B")
            else:
                out.append(c + e)
            i += 2
            continue
        if in_class:
            if c == "]" and i > class_start:
                in_class = False
                out.append(c)
            elif c in "[]" or (c in "&~-|" and pattern[i : i + 2] == c * 2):
                out.append("\\" + c)
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            class_start = i
            continue
        if c == "(" and pattern.startswith("(?P<", i):
            i = pattern.index(">", i) + 1
            out.append("(")
            continue
        if c == "(" and pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(r"(?:\%d)" % names[pattern[i + 4 : end]])
            i = end + 1
            continue
        if c == "(" and pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
            continue
        if c == "(" and (flags := _INLINE_FLAGS.match(pattern, i)):
            if set(flags.group(1) + (flags.group(2) or "")) & set("axLu"):
                python_syntax = True
        if c == "{":
            quantifier = _QUANTIFIER.match(pattern, i)
            if quantifier and (quantifier.group(1) or quantifier.group(3)):
                low = quantifier.group(1) or "0"
                out.append("{" + low + quantifier.group(2) + quantifier.group(3) + "}")
                i = quantifier.end()
            else:
                out.append(r"\{")
                i += 1
            continue
        if c == "}":
            out.append(r"\}")
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out), python_syntax


def prepare_pattern(pattern: str | None) -> Prepared:
    if not pattern:
        return Prepared(None, 0, False, False, None)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            compiled = re.compile(pattern)
            tree = _tree.parse(pattern)
    except (re.error, OverflowError, RecursionError) as exc:
        return Prepared(None, -1, False, False, str(exc))
    java, python_syntax = _translate(pattern, compiled.groupindex)
    optional = compiled.groups > 0 and _group_one_may_be_absent(tree)
    python_only = python_syntax or _has_conditional(tree) or _jvm_may_refuse(tree)
    return Prepared(java, compiled.groups, python_only, optional, None)


_INT_MAX = 2**31 - 1


def _jvm_may_refuse(tree, behind: bool = False) -> bool:
    """Constructs both dialects can spell but the JVM may not compile: a reference to a group inside a
    look-behind, and counts beyond 32 bits. Told from the pattern alone, so that a store of any size
    gets the same answer and a refused pattern never reaches the JVM."""
    for op, arg in tree:
        if op is _codes.GROUPREF:
            refused = behind
        elif op in (_codes.MAX_REPEAT, _codes.MIN_REPEAT, _codes.POSSESSIVE_REPEAT):
            low, high, body = arg
            beyond = low > _INT_MAX or (high is not _codes.MAXREPEAT and high > _INT_MAX)
            refused = beyond or _jvm_may_refuse(body, behind)
        elif op is _codes.SUBPATTERN:
            refused = _jvm_may_refuse(arg[-1], behind)
        elif op is _codes.BRANCH:
            refused = any(_jvm_may_refuse(branch, behind) for branch in arg[1])
        elif op is _codes.ATOMIC_GROUP:
            refused = _jvm_may_refuse(arg, behind)
        elif op in (_codes.ASSERT, _codes.ASSERT_NOT):
            refused = _jvm_may_refuse(arg[1], behind or arg[0] < 0)
        else:
            refused = False
        if refused:
            return True
    return False


def _has_conditional(tree) -> bool:
    return "GROUPREF_EXISTS" in repr(tree)


# What each date code accepts, as in Python's strptime.
DATE_CODES = {
    "d": r"(3[0-1]|[1-2][0-9]|0[1-9]|[1-9]| [1-9])",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "Y": r"([0-9]{4})",
    "y": r"([0-9]{2})",
    "H": r"(2[0-3]|[0-1][0-9]|[0-9])",
    "M": r"([0-5][0-9]|[0-9])",
    "S": r"([0-5][0-9]|[0-9])",
}


def date_pattern(fmt: str) -> tuple[str, str] | None:
    """A strptime format as (Java pattern, replacement giving year-month-day).

    None when the format uses a code outside DATE_CODES, or one code twice.
    """
    regex, position, groups, i = [r"\A"], {}, 0, 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            if code == "%":
                regex.append("%")
            elif code in DATE_CODES and code not in position:
                groups += 1
                position[code] = groups
                regex.append(DATE_CODES[code])
            else:
                return None
            i += 2
        elif c.isspace():
            while i < len(fmt) and fmt[i].isspace():
                i += 1
            regex.append(r"\s+")
        else:
            regex.append("\\" + c if not c.isalnum() and c.isascii() else c)
            i += 1
    if "y" in position and "Y" in position:
        return None
    year = position.get("Y", position.get("y"))
    parts = [
        f"${year}" if year else "1900",
        f"${position['m']}" if "m" in position else "1",
        f"${position['d']}" if "d" in position else "1",
    ]
    return "(?iU)" + "".join(regex) + r"\z", "-".join(parts)


def _group_one(tree):
    """The part of a pattern that is its group 1, None without one."""
    for op, arg in tree:
        if op is _codes.SUBPATTERN and arg[0] == 1:
            return arg[-1]
        parts = arg if isinstance(arg, (list, tuple)) else (arg,)
        nested = [p for a in parts for p in (a if isinstance(a, list) else [a]) if isinstance(p, _tree.SubPattern)]
        found = next((g for g in map(_group_one, nested) if g is not None), None)
        if found is not None:
            return found
    return None


def never_empty(pattern: str) -> bool:
    """Whether what a match captures (its group 1, or all of it without groups) has a character at least."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = _tree.parse(pattern, re.IGNORECASE | re.MULTILINE)
    part = _group_one(tree) if tree.state.groups > 1 else tree
    return part is not None and part.getwidth()[0] > 0


_PLAIN_CLASS = re.compile(r"\[(?:[A-Za-z0-9 .,:;/_#+-]|\\[dw.-])+\]")
_COUNT = re.compile(r"\{\d+(,\d*)?\}")


def within_line(java: str) -> str | None:
    """The translated pattern so that in a whole text, under ``SEARCH``, it finds exactly what it finds in the single lines.

    None unless that is certain: nothing in it may take a line feed, and only a leading ``^`` may look at its surroundings.
    """
    out, i = [], 0
    if java.startswith("^"):
        out, i = ["^"], 1
    while i < len(java):
        c, e = java[i], java[i + 1 : i + 2]
        if c == "\\":
            if e == "s":
                out.append(r"[\s&&[^\n]]")
            elif e in ("d", "w", "S") or (e and e in string.punctuation):
                out.append(c + e)
            else:
                return None
            i += 2
            continue
        taken = _PLAIN_CLASS.match(java, i) if c == "[" else _COUNT.match(java, i) if c == "{" else None
        if taken:
            out.append(taken[0])
            i = taken.end()
            continue
        if c in "[{$^\n" or (c == "(" and e == "?" and not java.startswith("(?:", i)):
            return None
        if c == "(":
            out.append("(?:")
            i += 3 if e == "?" else 1
            continue
        out.append(c)
        i += 1
    return "".join(out)
