"""Facts of one source text: declarations with extents, containers, bases and parameter counts, and calls with
receivers and argument counts. Small helpers that Spark tasks run on each row's text; a text is looked
at as a mask, in which comments and strings are blank and every offset is where it was. What is called from
where, and which definition is meant, is decided by joins of these facts.

Calls in the holes of interpolated strings are calls; their arguments are not counted. Those in comments and
other strings are calls where `everywhere` is asked for."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from functools import cache
from typing import NamedTuple

UNKNOWN, VARIADIC, EXTENSION, MOST_SPAN = -1, 99, 1, 4000
BARE, EXPR, IDENT, SELF, NEW = range(5)
# Words that stand for the own object (fixed values).
SELF_WORDS = frozenset("this me mybase myclass self cls mymodule".split())
# What is blanked, by language: comments and strings (fixed values).
_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|@\"(?:[^\"]|\"\")*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
BLANKS = {
    "python": r"#[^\n]*|'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "vbnet": r"'[^\n]*|\"(?:[^\"\n]|\"\")*\"",
    "csharp": _C_LIKE,
    "javascript": _C_LIKE + r"|`(?:\\.|[^`\\])*`",
    "typescript": _C_LIKE + r"|`(?:\\.|[^`\\])*`",
}
# Declarations by language: the groups are the kind's word and the name (fixed values).
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|abstract|partial|readonly|new|extern|unsafe)\s+)"
_VB_MODIFIERS = r"(?:(?:public|private|protected|friend|shared|overrides|overridable|mustoverride|async|partial|readonly|default)\s+)"
_TYPE = r"[A-Za-z_][\w.]*(?:<[^;(){}=]*>)?(?:\[[\],]*\])*\??"
DECLARATIONS = {
    "python": [r"^[ \t]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)"],
    "csharp": [
        rf"^[ \t]*{_MODIFIERS}*(class|interface|struct|enum|record)[ \t]+(?:(?:class|struct)[ \t]+)?(\w+)",
        rf"^[ \t]*{_MODIFIERS}*(event|delegate)[ \t]+{_TYPE}[ \t]+(\w+)",
        rf"^[ \t]*{_MODIFIERS}+({_TYPE})[ \t]+(\w+)[ \t]*(?:<[\w, ]*>)?(?=[ \t]*[({{]|[ \t]*=>|[ \t]*\n[ \t]*[({{])",
        rf"^[ \t]*{_MODIFIERS}+()([A-Z]\w*)[ \t]*(?=\()",
        rf"^[ \t]+({_TYPE})[ \t]+(\w+)[ \t]*(?=\([^()]*\)\s*\{{)",
    ],
    "vbnet": [rf"(?i)^[ \t]*{_VB_MODIFIERS}*(class|module|structure|interface|enum|sub|function|property|event)[ \t]+(\w+)"],
    "javascript": [
        r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?(function|class|interface|type|enum)[ \t*]+([A-Za-z_$][\w$]*)",
        r"^[ \t]*(?:export[ \t]+)?(const|let|var)[ \t]+([A-Za-z_$][\w$]*)(?:[ \t]*:[^=\n]*)?[ \t]*=[ \t]*(?=(?:async[ \t]*)?(?:function\b|(?:\([^()]*\)|[\w$]+)[ \t]*(?::[^=\n]*)?=>))",
        r"^[ \t]+(?:(?:public|private|protected|static|readonly)[ \t]+)*()([A-Za-z_$][\w$]*)[ \t]*=[ \t]*(?=(?:async[ \t]*)?(?:function\b|(?:\([^()]*\)|[\w$]+)[ \t]*=>))",
        r"(?:^[ \t]+|[{;}][ \t]*)(?:(?:public|private|protected|static|async|readonly|get|set)[ \t]+)*()(?!(?:if|for|while|switch|catch|return|function)\b)([A-Za-z_$][\w$]*)(?=[ \t]*\([^()]*\)[^;\n]*\{)",
    ],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]
TYPES = frozenset("class interface struct structure enum record module type".split())
PROPERTY = re.compile(r"@(?:\w+\.)*(?:property|cached_property|setter|getter)\b")
# What stands before an interpolated string, and a hole in it, by language.
INTERPOLATED = {"csharp": (r"\$", r"\{[^{}]*\}"), "python": (r"\b[rR]?[fF][rR]?", r"\{[^{}]*\}"), "javascript": ("", r"\$\{[^{}]*\}"), "typescript": ("", r"\$\{[^{}]*\}")}
KINDS = {"def": "function", "function": "function", "sub": "method", "const": "function", "let": "function", "var": "function", "": "method"}
# Words before a parenthesis that are no calls (fixed values).
NO_CALLS = frozenset("if for foreach while switch catch return using lock nameof typeof sizeof def class function new and or not in elif print sub property event delegate await throw when async".split())
# A name is tried from its first letter only.
CALL = re.compile(r"(?<![A-Za-z_$])([A-Za-z_$][\w$]*+)\s*+\(")
#: Declarations of a name with a type, by language: how they are written (LU stands for a capital letter), and which
#: groups are the name and the type.
_TYPED = {
    "csharp": [(r"\b(LU\w*)(?:<[^<>;()\n]*>)?(?:\[\])?\s+([^\W\d]\w*)\s*(?=[;=,){])", 2, 1), (r"(?<![^\W\d])([^\W\d]\w*+)\s*+=\s*new\s+(LU\w*)", 1, 2)],
    "vbnet": [(r"(?i)\b([^\W\d]\w*)\s+As\s+(?:New\s+)?([^\W\d][\w.]*)", 1, 2), (r"(?i)\b([^\W\d]\w*)\s*=\s*New\s+([^\W\d][\w.]*)", 1, 2)],
    "typescript": [(r"((?:[^\W\d]|\$)[\w$]*)\s*\??:\s*(LU\w*)", 1, 2), (r"((?:[^\W\d]|\$)[\w$]*)\s*=\s*new\s+(LU\w*)", 1, 2)],
    "javascript": [(r"((?:[^\W\d]|\$)[\w$]*)\s*=\s*new\s+(LU\w*)", 1, 2)],
}
# What follows the name of a property.
_VALUE = re.compile(r"\s*(?:\{|=>)")
_OPENED, _BRACES = re.compile(r"=>\s*\{|[{;]|=>"), re.compile(r"[{}]")
_BRACKET_AT = re.compile(r"[\w$]*\s*(?:<[\w, ]*>)?\s*(?::[^=\n]*)?(?:=\s*(?:async\s*)?(?:function\s*[\w$]*\s*)?)?")
_BLANK = {language: re.compile(pattern, re.S) for language, pattern in BLANKS.items()}
_DECLARED = {language: [re.compile(p, re.M) for p in patterns] for language, patterns in DECLARATIONS.items()}


class Symbol(NamedTuple):
    name: str
    qualified: str
    kind: str
    container: str | None
    line: int
    end_line: int  # 0: unknown
    pmin: int
    pmax: int
    pflags: int
    at: int  # offset of the name
    bases: str  # bare names, parted by commas


class Call(NamedTuple):
    callee: str
    line: int
    at: int
    recv: str | None
    recv_kind: int
    argc: int


class Site(NamedTuple):
    callee: str
    line: int
    at: int
    recv: str | None
    recv_kind: int
    argc: int
    recv_type: str | None
    caller: str | None
    caller_line: int  # 0: at file scope
    caller_kind: str | None
    caller_in: str | None


@cache
def _typed(language: str) -> list[tuple[re.Pattern, int, int]]:
    # Those beyond the first plane stand apart, as a set with both is searched one by one.
    first, rest = ("".join(c for c in map(chr, range(*r)) if unicodedata.category(c) == "Lu") for r in ((0x10000,), (0x10000, 0x20000)))
    capital = f"(?=[A-Z\\u0080-\\U0010ffff])(?:[{first}]|[{rest}])"
    return [(re.compile(pattern.replace("LU", capital)), name, type_) for pattern, name, type_ in _TYPED.get(language, ())]


def declared_types(text: str, language: str) -> dict[str, str]:
    """Types by name: fields, parameters, locals and `= new T` with the bare name of their type. Names that a text
    declares with several types are left out: unknown is better than wrong."""
    found: dict[str, set[str]] = defaultdict(set)
    for pattern, name, type_ in _typed(language):
        if language != "vbnet" and "new" in pattern.pattern and "new" not in text:
            continue
        for m in pattern.finditer(text):
            found[m[name]].add(m[type_].rsplit(".", 1)[-1])
    return {name: types.pop() for name, types in found.items() if len(types) == 1 and "" not in types}


def masked(text: str, language: str) -> str:
    blank = _BLANK.get(language)
    return blank.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if blank else text


def holes(text: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of the code within interpolated strings."""
    if language not in INTERPOLATED:
        return []
    before, hole = (re.compile(x) for x in INTERPOLATED[language])
    out = []
    for string in _BLANK[language].finditer(text):
        at = string.start()
        quoted = text[at] == "`" if not before.pattern else text[at] in "\"'@" and any(m.end() == at for m in before.finditer(text, max(0, at - 3), at))
        if quoted:
            out += [(at + h.start(), at + h.end()) for h in hole.finditer(string[0])]
    return out


# What changes depth or parts items, once generic arguments are out of the way.
_MARKS = re.compile(r"[()\[\]{},]")
_GENERIC = re.compile(r"(?<=\w)<(?:[\w\s,.?\[\]]|\([^()<>]*\))*>")
_UNSURE = re.compile(r"(?<=\w)<|[(,]\s*(?:\*|\.\.\.)")


def plain(mask: str) -> str:
    """The mask with lists of generic arguments as one word, inner ones first; offsets stay."""
    while "<" in mask:
        following = _GENERIC.sub(lambda m: "_" * len(m[0]), mask)
        if following == mask:
            break
        mask = following
    return mask


def groups(mask: str) -> dict[int, tuple[int, int]]:
    """For each opening parenthesis its end and its number of items, as sums over the marks at its depth.
    UNKNOWN where the group is longer than MOST_SPAN or holds a spread or an angle that stays open; left out
    where it is not closed by its like."""
    mask = plain(mask)
    unsure = [m.end() - 1 for m in _UNSURE.finditer(mask)]
    opened: dict[int, int] = {}  # depth -> the bracket that is open there
    commas: dict[int, int] = defaultdict(int)
    doubtful: set[int] = set()
    out: dict[int, tuple[int, int]] = {}
    depth, doubt = 0, 0
    for m in _MARKS.finditer(mask):
        while doubt < len(unsure) and unsure[doubt] < m.start():
            doubtful.add(opened.get(depth, -1))
            doubt += 1
        if m[0] == ",":
            commas[opened.get(depth, -1)] += 1
        elif m[0] in "([{":
            depth += 1
            opened[depth] = m.start()
        elif depth:
            start = opened.pop(depth)
            depth -= 1
            if mask[start] + m[0] == "()":
                sure = start not in doubtful and m.start() - start <= MOST_SPAN
                out[start] = m.start(), UNKNOWN if not sure else commas[start] + bool(commas[start] or mask[start + 1 : m.start()].strip())
    return out


def items(inner: str) -> list[str]:
    """Top-level items of a list."""
    flat = plain(inner)
    deep, cuts = 0, [-1]
    for m in _MARKS.finditer(flat):
        deep += {"(": 1, "[": 1, "{": 1, ",": 0}.get(m[0], -1)
        if m[0] == "," and not deep:
            cuts.append(m.start())
    parts = [inner[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], len(inner)], strict=True)]
    return [p for p in parts if p]


# Parameters that a call may leave out, and those that take any number, by language.
_OMITTED = {"csharp": r"(?s).*=", "vbnet": r"(?i)(?:\w+\s+)*?optional\b", "javascript": r"(?s)[\w$]+\s*\?|.*=", "typescript": r"(?s)(?:(?:public|private|protected|readonly)\s+)*[\w$]+\s*\?|.*="}
_REPEATED = {"csharp": r"params\s", "vbnet": r"(?i)(?:\w+\s+)*?paramarray\b", "javascript": r"\.\.\.", "typescript": r"\.\.\."}


def arity(inner: str | None, language: str, kind: str) -> tuple[int, int, int]:
    """(fewest, most, flags) of a parameter list."""
    if inner is None or language not in _OMITTED or kind in TYPES or kind in ("property", "event"):
        return UNKNOWN, UNKNOWN, 0
    listed = items(inner)
    repeated = [bool(re.match(_REPEATED[language], p)) for p in listed]
    needed = sum(not r and not re.match(_OMITTED[language], p) for p, r in zip(listed, repeated, strict=True))
    own = language == "csharp" and bool(listed) and bool(re.match(r"this\s", listed[0]))
    return needed, VARIADIC if any(repeated) else len(listed), EXTENSION if own else 0


def bases(header: str, language: str) -> str:
    """Bare names of the types that a declaration's header names as bases."""
    if language == "csharp":
        named = re.search(r":(.*)", re.split(r"\bwhere\b", header)[0], re.S)
        listed = items(named[1]) if named else []
    elif language in ("javascript", "typescript"):
        listed = [p for part in re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|$)", header, re.S) for p in items(part)]
    else:
        listed = []
    bare = [re.match(r"[\w.$]*", re.sub(r"<.*", "", p, flags=re.S).strip())[0].rsplit(".", 1)[-1] for p in listed]
    return ",".join(dict.fromkeys(b for b in bare if b))


def receiver(mask: str, start: int) -> tuple[str | None, int]:
    """What the call whose name begins at start was made on."""
    head = mask[max(0, start - 400) : start].rstrip()
    if head.endswith("::"):
        return None, EXPR
    if not head.endswith("."):
        return None, NEW if head[-3:].lower() == "new" and not _word(head[-4:-3]) else BARE
    head = head[:-1].rstrip(" \t\r\n!?")
    k = len(head)
    while k and _word(head[k - 1]):
        k -= 1
    word = head[k:]
    if not word or word[0].isdigit():
        return None, EXPR
    return word, SELF if word.lower() in SELF_WORDS else IDENT


def _word(sign: str) -> bool:
    return sign.isalnum() or sign in ("_", "$")


class Source:
    """One text with its lines, declarations and brackets."""

    def __init__(self, text: str, language: str) -> None:
        self.language, self.text = language, text.replace("\r\n", "\n")
        self.mask = masked(self.text, language)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.mask))]
        self.groups = groups(self.mask)
        self.symbols = self._symbols()

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def _found(self) -> list[tuple[int, str, str]]:
        """(offset of the name, kind, name) in order; one declaration a place."""
        found: dict[int, tuple[int, str, str]] = {}
        for pattern in _DECLARED.get(self.language, ()):
            for m in pattern.finditer(self.mask):
                word, name = m[1].lower(), m[2]
                if m.start(2) in found or name.lower() in NO_CALLS or word in ("return", "await", "throw", "new", "else", "delegate"):
                    continue
                value = self.language == "csharp" and word not in TYPES and bool(_VALUE.match(self.mask, m.end(2)))
                kind = word if word in TYPES or word in ("property", "event") else "property" if value else KINDS.get(word, "method")
                if self.language == "python" and word == "def" and self._decorated(self.line(m.start(2)) - 1):
                    kind = "property"
                found[m.start(2)] = m.start(2), kind, name
        named = {name for _, kind, name in found.values() if kind in TYPES}
        if self.language == "csharp":
            found = {at: (at, "constructor" if kind == "method" and name in named else kind, name) for at, kind, name in found.values()}
        return [found[at] for at in sorted(found)]

    def _row(self, number: int) -> str:
        return self.mask[self.starts[number - 1] : self.starts[number] if number < len(self.starts) else len(self.mask)]

    def _decorated(self, above: int) -> bool:
        """Whether decorators right above make a function a property."""
        while above >= 1 and (row := self._row(above).strip()).startswith("@"):
            if PROPERTY.match(row):
                return True
            above -= 1
        return False

    def _end(self, at: int, behind: int) -> int:
        """Last line of the body of the declaration at a place, searched behind its parameters; 0: unknown."""
        line = self.line(at)
        if self.language == "python":
            own = len(self._row(line)) - len(self._row(line).lstrip())
            end = line
            for i in range(line + 1, len(self.starts) + 1):
                row = self._row(i)
                if row.strip():
                    if len(row) - len(row.lstrip()) <= own and not row.lstrip().startswith(")"):
                        break
                    end = i
            return end
        if self.language == "vbnet":
            word = self.mask[self.starts[line - 1] : at].split()[-1].lower()
            depth = 0
            for m in re.compile(rf"(?im)^[ \t]*(end[ \t]+)?(?:{_VB_MODIFIERS}*){word}\b").finditer(self.mask, self.starts[line - 1]):
                depth += -1 if m[1] else 1
                if not depth:
                    return self.line(m.start())
            return 0
        opened = _OPENED.search(self.mask, behind)
        if not opened or not opened[0].endswith("{"):
            return 0
        depth = 0
        for m in _BRACES.finditer(self.mask, opened.end() - 1):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return self.line(m.start())
        return 0

    def _symbols(self) -> list[Symbol]:
        out: list[Symbol] = []
        open_: list[Symbol] = []
        for at, kind, name in self._found():
            line = self.line(at)
            bracket = _BRACKET_AT.match(self.mask, at).end()
            group = self.groups.get(bracket) if self.mask[bracket : bracket + 1] == "(" else None
            end = self._end(at, group[0] if group else at)
            while open_ and (open_[-1].end_line < line):
                open_.pop()
            owner = next((s for s in reversed(open_) if s.kind in TYPES), None)
            if kind == "function" and owner is not None:
                kind = "method"
            inner = self.mask[bracket + 1 : group[0]] if group else None
            container = owner.name if owner else None
            prefix = (owner.qualified if self.language == "python" else owner.name) + "." if owner else ""
            body = self.mask.find("{", at)
            named = bases(self.mask[at + len(name) : body], self.language) if kind in TYPES and body > 0 else ""
            symbol = Symbol(name, prefix + name, kind, container, line, end, *arity(inner, self.language, kind), at, named)
            out.append(symbol)
            if end:
                open_.append(symbol)
        return out

    def calls(self, everywhere: bool = False) -> list[Call]:
        """Calls in order; a declaration's own name is none. Arguments in strings and comments are not counted."""
        own = {(s.line, s.name.lower()) for s in self.symbols}
        inside = [] if everywhere else holes(self.text, self.language)
        starts = [a for a, _ in inside]
        out = []
        for m in CALL.finditer(self.text):
            at, line, k = m.start(), self.line(m.start()), bisect_right(starts, m.start()) - 1
            code = self.mask[at] == self.text[at]
            if m[1].lower() in NO_CALLS or (line, m[1].lower()) in own or not (code or everywhere or (k >= 0 and at < inside[k][1])):
                continue
            out.append(Call(m[1], line, at, *receiver(self.mask if code else self.text, at), self.groups.get(m.end() - 1, (0, UNKNOWN))[1] if code else UNKNOWN))
        return out

    def sites(self, everywhere: bool = False, types: dict[str, str] | None = None) -> list[Site]:
        """Calls with the declared type of their receiver and the innermost declaration around their line, one of
        unknown extent being open to the end of the text. Declarations are opened and closed in one sweep."""
        types = declared_types(self.text, self.language) if types is None else types
        open_: list[Symbol] = []
        out, k = [], 0
        for c in self.calls(everywhere):
            while k < len(self.symbols) and self.symbols[k].line <= c.line:
                open_.append(self.symbols[k])
                k += 1
            while open_ and open_[-1].end_line and max(open_[-1].line, open_[-1].end_line) < c.line:
                open_.pop()
            s = open_[-1] if open_ else None
            held = (s.name, s.line, s.kind, s.name if s.kind in TYPES else s.container) if s else (None, 0, None, None)
            out.append(Site(*c, types.get(c.recv) if c.recv_kind == IDENT else None, *held))
        return out
