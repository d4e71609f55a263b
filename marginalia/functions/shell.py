"""Shell commands: words, stateful redaction, families, reads and writes. Python behind Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[redacted]"
# Parts of names that hold credentials, words that set a name, words before the real program.
KEYISH = ("token", "secret", "key", "pass", "pwd", "auth", "credential")
SETTERS = frozenset("set setenv export declare typeset env local set-item set-variable new-variable si sv".split())
PREFIXES = frozenset("sudo doas env time nohup nice ionice stdbuf command builtin exec noglob nocorrect".split())
PREFIX_FLAGS = frozenset("-u -n -c -e -g -p -d -t -l".split())
FAMILIES = {
    "verification": {"pytest", "jest", "vitest", "go", "make", "ninja", "gradle", "mvn", "tox"},
    "vcs": {"git"},
    "listing": {"find", "ls", "grep", "rg", "ag", "fd", "tree", "du", "locate", "Get-ChildItem", "gci", "dir", "Select-String", "sls"},
}
VERIFYING = {"cargo": {"test", "build", "clippy", "check", "bench"}, **dict.fromkeys(("npm", "pnpm", "yarn", "bun"), {"test", "run", "build", "ci"})}
READERS = frozenset("cat head tail sed".split())
WRITERS = frozenset("tee cp mv touch dd install truncate".split())

_WORD = re.compile(r"""(?:[^\s"'\\]|\\.|\\$|"(?:[^"\\]|\\.)*"?|'[^']*'?)+""", re.S)
_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
_BASE64 = re.compile(r"[A-Za-z0-9+=_-]{32,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_.-]{17,}")


def words(command: str) -> list[tuple[int, int]]:
    """Spans of the words, quotes and escapes kept together."""
    return [m.span() for m in _WORD.finditer(command)]


def unquote(word: str) -> str:
    """Quotes go; a backslash before a letter or another path part is kept."""
    word = re.sub(r'"((?:[^"\\]|\\.)*)"?', lambda m: re.sub(r'\\(["\\$`])', r"\1", m[1]), word) if '"' in word else word
    word = re.sub(r"'([^']*)'?", r"\1", word)
    return re.sub(r"\\([\s'\"$`&|;<>()])", r"\1", word)


def keyish(word: str) -> bool:
    return any(k in word.lstrip("-").lower() for k in KEYISH)


def _redact_word(word: str) -> tuple[str, bool]:
    """The word without what it gives away, and whether the next word is a secret."""
    for mark in "=:":
        key, found, value = word.partition(mark)
        if found and keyish(key.strip("'\"")) and (mark == ":" or (key and value)):
            return (f"{key}{mark}{REDACTED}", False) if value else (word, True)
    if word.startswith("-") and "=" not in word and keyish(word):
        glued = not word.startswith("--") and len(word.lstrip("-")) > 2
        return (REDACTED, False) if glued else (word, True)
    scheme, found, tail = word.partition("://")
    login, at, rest = tail.partition("@")
    if found and at and ":" in login and "/" not in login:
        return f"{scheme}://{REDACTED}@{rest}", False
    word = _HEX.sub(REDACTED, _JWT.sub(REDACTED, word))
    mixed = lambda m: REDACTED if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) else m[0]
    return _BASE64.sub(mixed, word), False


def redact(command: str) -> str:
    """Assignments, headers, flags, logins, tokens and long random runs lose their values; setters lose what they set."""
    out, at = [], 0
    state, flags = "", 0  # "", value: this word is one; name: a setter went before; maybe: a key that "=" may follow; seek: flags, then a value
    for start, end in words(command):
        word = command[start:end]
        plain, shown, after = unquote(word), word, ""
        if state == "value":
            shown = REDACTED
        elif state == "seek" and plain.startswith("-"):
            flags -= 1
            after = "seek" if flags else "name"
        elif state == "seek":
            shown = REDACTED
        elif state == "maybe" and plain == "=":
            after = "value"
        elif state == "name" and "=" not in plain and keyish(plain):
            after, flags = "seek", 3
        elif plain.lower() in SETTERS or (state == "name" and plain.startswith("-")):
            after = "name"
        else:
            shown, is_next = _redact_word(word)
            after = "value" if is_next else "maybe" if "=" not in plain and keyish(plain) else ""
        out += [command[at:start], shown]
        at, state = end, after
    return "".join(out) + command[at:]


def program(command: str) -> tuple[str, list[str]]:
    """The real program behind prefixes and assignments, by its base name, and its arguments."""
    rest, behind = command.split(), False
    while rest:
        word = rest[0]
        if word in PREFIXES or "=" in word:
            behind = True
        elif behind and word.startswith("-"):
            if word in PREFIX_FLAGS and len(rest) > 1 and not rest[1].startswith("-"):
                rest = rest[1:]
        else:
            return re.split(r"[/\\]", word)[-1], rest[1:]
        rest = rest[1:]
    return "", []


def family(command: str) -> str:
    name, rest = program(command)
    if rest and rest[0] in VERIFYING.get(name, ()):
        return "verification"
    return next((f for f, names in FAMILIES.items() if name in names), "generic")


def _unquoted(command: str) -> str:
    return re.sub(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'", "''", command)


def is_write(command: str) -> bool:
    """A redirection outside quotes, a writing program, or an in-place editor."""
    bare = _unquoted(command)
    if re.search(r"(?<![0-9&>-])>{1,2}(?!&)", bare):
        return True
    for part in re.split(r"&&|\|\||[;|\n]", bare):
        name, rest = program(part)
        if name in WRITERS or (name in ("sed", "perl") and any(re.match(r"-[a-z]*i", x) for x in rest)):
            return True
    return False


def read_target(command: str) -> str | None:
    """The one file that a plain cat, head, tail or sed -n reads."""
    if re.search(r"[|;&<>`$]", _unquoted(command)):
        return None
    name, rest = program(command)
    if name not in READERS or (name == "sed" and "-n" not in rest):
        return None
    rest = [unquote(command[a:b]) for a, b in words(command)][1:]
    values = {"-n", "-c"} if name in ("head", "tail") else set()
    files, skip = [], False
    for x in rest:
        if skip:
            skip = False
        elif x in values:
            skip = True
        elif not x.startswith("-"):
            files.append(x)
    if name == "sed":
        files = files[1:]
    return files[0] if len(files) == 1 else None


def _column(function, kind: str):
    @F.pandas_udf(kind)
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else function(x))

    return apply


def redacted(command: Column) -> Column:
    return _column(redact, "string")(command)


def family_of(command: Column) -> Column:
    return _column(family, "string")(command)


def writes(command: Column) -> Column:
    return _column(is_write, "boolean")(command)


def reads(command: Column) -> Column:
    return _column(read_target, "string")(command)
