"""Schema patterns as Java regular expressions, translated once on the driver.

The dialect: the whole value must match; ``.`` leaves out line ends; ``\\i \\c`` are name
characters, ``\\d`` decimal digits, ``\\w`` letters, marks, numbers and symbols; classes may
subtract a class; ``\\p{IsBlock}`` names a Unicode block; ``^`` and ``$`` are plain characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from .text import NAME_REST, NAME_START

_ESCAPES = {"n": "\\n", "r": "\\r", "t": "\\t"}
_CLASSES = {
    "s": " \\t\\n\\r", "i": f":{NAME_START}", "c": f":{NAME_REST}", "d": "\\p{Nd}", "w": "\\p{L}\\p{M}\\p{N}\\p{S}",
}
_PLAIN_ESCAPES = set(".\\?*+{}()[]|-^$")
#: Blocks that Java knows under another name.
_BLOCKS = {"Greek": "GreekandCoptic", "CombiningMarksforSymbols": "CombiningDiacriticalMarksforSymbols"}


class PatternError(ValueError):
    """A pattern that isn't one of the dialect."""


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.p):
            raise PatternError("pattern ends early")
        self.at += 1
        return self.p[self.at - 1]

    def alternatives(self, depth: int = 0) -> str:
        out: list[str] = []
        while self.at < len(self.p):
            c = self.take()
            if c == ")":
                if not depth:
                    raise PatternError("unmatched )")
                self.at -= 1
                break
            if c == "(":
                out.append(f"(?:{self.alternatives(depth + 1)}")
                if self.peek() != ")":
                    raise PatternError("unmatched (")
                out.append(self.take())
            elif c == "[":
                out.append(self.char_class())
            elif c == "\\":
                out.append(self.escape(False))
            elif c == ".":
                out.append("[^\\n\\r]")
            elif c in "|":
                out.append(c)
            elif c in "?*+":
                if not out or out[-1] == "|":
                    raise PatternError(f"nothing to repeat before {c}")
                out.append(c)
            elif c == "{":
                m = re.compile(r"(\d+)(,(\d*))?\}").match(self.p, self.at)
                if not m or not out or out[-1] == "|":
                    raise PatternError("bad quantifier")
                if m[3] and int(m[3]) < int(m[1]):
                    raise PatternError("quantifier out of order")
                self.at = m.end()
                out.append("{" + m[0])
            elif c in "]}":
                raise PatternError(f"unmatched {c}")
            else:
                out.append(re.sub(r"([\^$&#])", r"\\\1", c) if c != " " else " ")
        return "".join(out)

    def escape(self, inside: bool) -> str:
        c = self.take()
        if c in _ESCAPES:
            return _ESCAPES[c]
        if c.lower() in _CLASSES:
            body = _CLASSES[c.lower()]
            return f"[^{body}]" if c.isupper() else body if inside else f"[{body}]"
        if c in "pP":
            if self.take() != "{" or "}" not in self.p[self.at :]:
                raise PatternError("bad property")
            end = self.p.index("}", self.at)
            name, self.at = self.p[self.at : end], end + 1
            if name.startswith("Is"):
                block = name[2:].replace("-", "")
                return f"\\{c}{{In{_BLOCKS.get(block, block)}}}"
            if not re.fullmatch(r"L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|Z[slp]?|S[mcko]?|C[cfon]?", name):
                raise PatternError(f"unknown category {name}")
            return f"\\{c}{{{name}}}"
        if c in _PLAIN_ESCAPES:
            return "\\" + c
        raise PatternError(f"unknown escape \\{c}")

    def char_class(self) -> str:
        negated = self.peek() == "^"
        if negated:
            self.take()
        items, minus = [], ""
        while True:
            c = self.take()
            if c == "]":
                break
            if c == "-" and self.peek() == "[" and items:
                self.take()
                minus = self.char_class()
                if self.take() != "]":
                    raise PatternError("a subtraction ends its class")
                break
            if c == "[":
                raise PatternError("[ in a class")
            items.append(self.escape(True) if c == "\\" else re.sub(r"([\^&\[\]#])", r"\\\1", c) if c != "-" else self.hyphen(items))
        if not items:
            raise PatternError("empty class")
        body = "".join(items)
        if minus:
            return f"[{'[^' + body + ']' if negated else '[' + body + ']'}&&[^{minus}]]"
        return f"[{'^' if negated else ''}{body}]"

    def hyphen(self, items: list[str]) -> str:
        """A range where it stands between two characters, else itself."""
        return "-" if items and self.peek() not in ("]", "") else "\\-"


def translate(pattern: str) -> str:
    """The Java pattern; raises PatternError."""
    t = _Translator(pattern)
    return rf"\A(?:{t.alternatives()})\z"


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(translate(pattern))
